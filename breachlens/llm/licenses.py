"""Operator 7: license scans by ordered signature rules, in DataFrame functions only.

A text is normalised to words joined by single blanks. Rules are regular expressions over that
form; each belongs to a keyword, and a rule is run only on texts that hold its keyword. All
detections of a text become word intervals; a detection inside of another one's interval is
suppressed unless it has a higher priority. Everything stays within the row: there is no
shuffle, and a text's number of detections only concerns its own row.

Words: A-Z lower-cased, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows are
scanned each; equal intervals of equal priority keep the first rule in order; base phrases are
never suppressed; columns besides the id and the text are not read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachlens.llm.common import ascii_lower

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are always reported, with their labels.
BASE = [
    ("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"),
]


@dataclass(frozen=True)
class Rule:
    """A signature: what it detects, the keyword that gates it, its pattern over words joined
    by blanks, how sure it is (0 to 1), and its priority (higher wins)."""

    label: str
    keyword: str
    pattern: str
    weight: float
    priority: int


#: Label, keyword, and how the license is named (patterns over normalised words). Whatever a pattern
#: matches must hold its keyword, so names without a common one have a row each.
NAMES = [
    ("mit", "mit", "mit"),
    ("mit", "expat", "expat"),
    ("x11", "x11", "x11"),
    ("isc", "isc", "isc"),
    ("0bsd", "0bsd", "0bsd"),
    ("0bsd", "zero clause bsd", "zero clause bsd"),
    ("bsd-2", "bsd", "bsd 2 clause|2 clause bsd|simplified bsd|two clause bsd"),
    ("bsd-3", "bsd", "bsd 3 clause|3 clause bsd|new bsd|revised bsd|three clause bsd|modified bsd"),
    ("bsd-4", "bsd", "bsd 4 clause|4 clause bsd|original bsd|four clause bsd"),
    ("bsd", "bsd", "bsd(?: style)?"),
    ("apache-1.1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("apache-2", "apache", "apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?"),
    ("apache-2", "asl 2", "asl 2(?: 0)?"),
    ("gpl-1", "gpl", "gpl ?v?1(?: 0)?"),
    ("gpl-2", "gpl", "gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gpl", "gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl-2", "general public", "gnu general public license(?: version| v) ?2"),
    ("gpl-3", "general public", "gnu general public license(?: version| v) ?3"),
    ("gpl", "general public", "gnu general public"),
    ("lgpl-2.1", "lgpl", "lgpl ?v?2(?: 0| 1)?(?: only| or later)?"),
    ("lgpl-3", "lgpl", "lgpl ?v?3(?: 0)?(?: only| or later)?"),
    ("lgpl", "lesser general", "gnu lesser general public"),
    ("agpl-3", "agpl", "agpl ?v?3(?: 0)?(?: only| or later)?"),
    ("agpl-3", "affero", "gnu affero general public"),
    ("mpl-1.1", "mpl", "mpl 1 1"),
    ("mpl-2", "mpl", "mpl 2(?: 0)?"),
    ("mpl-2", "mozilla", "mozilla public"),
    ("epl-1", "eclipse", "eclipse public license(?: version| v)? ?1(?: 0)?"),
    ("epl-2", "eclipse", "eclipse public license(?: version| v)? ?2(?: 0)?"),
    ("cddl", "cddl", "cddl(?: 1 [01])?"),
    ("eupl", "eupl", "eupl(?: 1 [12])?"),
    ("artistic-2", "artistic", "artistic(?: license)? 2(?: 0)?"),
    ("artistic", "artistic", "(?:perl )?artistic"),
    ("boost", "boost", "boost software"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl"),
    ("ofl", "open font", "(?:sil )?open font"),
    ("python", "python software", "python software foundation"),
    ("php", "php", "php"),
    ("openssl", "openssl", "openssl"),
    ("ms-pl", "microsoft public", "microsoft public"),
    ("cc-by-nc", "cc by nc", "cc by nc(?: [1-4] [05])?(?! (?:sa|nd) )"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc by", "cc by(?: [1-4] [05])?(?! (?:sa|nc|nd) )"),
    ("cc-by-sa", "cc by sa", "cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by nd", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creative commons", "creative commons attribution(?! (?:share|non|no))"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?derivs"),
    ("odbl", "open database", "open database"),
]
#: How a license is spoken of: pattern around its name, weight, priority.
PHRASES = [
    ("spdx license identifier (?:{})", 1.0, 3),
    ("(?:licensed|released|distributed|available|published|provided) under(?: the)?(?: terms of)?(?: the)? (?:{})(?: license| licence)?", 0.9, 2),
    ("under(?: the)?(?: terms of)?(?: the)? (?:{}) licen[sc]e", 0.8, 2),
    ("(?:{}) licen[sc]e(?:d)?", 0.6, 1),
]
#: Signatures of their own.
OTHERS = [
    Rule("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy", 1.0, 3),
    Rule("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose", 0.95, 3),
    Rule("bsd", "redistribution and use", "redistribution and use in source and binary forms", 0.9, 3),
    Rule("apache-2", "apache", "apache org licenses license 2 0", 1.0, 3),
    Rule("gpl", "gnu", "gnu org licenses(?: gpl)?", 0.8, 2),
    Rule("cc-by-nc", "cc by nc", "cc by nc(?: [1-4] [05])?(?! (?:sa|nd) )", 0.9, 2),
    Rule("cc-by", "creativecommons", "creativecommons org licenses by [1-4]", 0.9, 2),
    Rule("cc-by-sa", "creativecommons", "creativecommons org licenses by sa", 0.9, 2),
    Rule("cc-by-nc", "creativecommons", "creativecommons org licenses by nc", 0.9, 2),
    Rule("cc0", "creativecommons", "creativecommons org publicdomain zero", 0.9, 2),
    Rule("public-domain", "public domain", "(?:released|dedicated|placed|is) (?:to|in|into) the public domain", 0.8, 2),
    Rule("proprietary", "all rights reserved", "all rights reserved", 0.5, 1),
    Rule("proprietary", "proprietary", "proprietary and confidential", 0.7, 2),
    Rule("ogl", "open government", "open government licen[sc]e", 0.8, 2),
    Rule("unknown", "licen", "licen[sc]ed under", 0.2, 0),
    Rule("unknown", "licen", "see(?: the)? licen[sc]e(?: file)?", 0.2, 0),
]


def rules() -> list[Rule]:
    """All rules in order: names in phrases, then signatures of their own."""
    named = [
        Rule(label, keyword, phrase.format(name), weight, priority)
        for label, keyword, name in NAMES for phrase, weight, priority in PHRASES
    ]
    return named + OTHERS


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _bind(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _table(among: list[Rule]) -> Column:
    """The rules as a constant array."""
    rows = [{"rule": i, "label": r.label, "keyword": f" {r.keyword}", "pattern": f" (?:{r.pattern})(?= )",
             "weight": r.weight, "priority": r.priority} for i, r in enumerate(among)]
    kind = "array<struct<rule:int,label:string,keyword:string,pattern:string,weight:double,priority:int>>"
    return F.from_json(F.lit(json.dumps(rows)), kind)


def _intervals(padded: Column, rule: Column) -> Column:
    """Where a rule's pattern occurs, as intervals of words."""
    def placed(cut):
        matches = F.regexp_extract_all(padded, rule["pattern"], F.lit(0))
        # Every word has one blank before it, so blanks count words.
        return F.aggregate(
            F.arrays_zip(cut.alias("a"), matches.alias("b")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,last:int>>").alias("found")),
            lambda acc, x: F.struct(
                (acc["at"] + _blanks(x["a"]) + F.coalesce(_blanks(x["b"]), F.lit(0))).alias("at"),
                F.when(x["b"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(
                    (acc["at"] + _blanks(x["a"])).alias("start"),
                    (acc["at"] + _blanks(x["a"]) + _blanks(x["b"]) - 1).alias("last"),
                )))).alias("found"),
            ),
        )["found"]

    found = _bind(F.split(padded, rule["pattern"], -1), placed)
    return F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), (-x["last"]).alias("minus_last"), (-rule["priority"]).alias("minus_priority"),
        rule["rule"].alias("rule"), rule["label"].alias("label"), rule["weight"].alias("weight"),
    ))


DETECTION = "array<struct<start:int,minus_last:int,minus_priority:int,rule:int,label:string,weight:double>>"


def detections(padded: Column, among: list[Rule]) -> Column:
    """All detections of a text, gated by keyword, in order of start, then longest first."""
    gated = F.filter(_table(among), lambda r: F.contains(padded, r["keyword"]))
    return F.sort_array(F.flatten(F.transform(gated, lambda r: _intervals(padded, r))))


def kept(found: Column) -> Column:
    """Without detections inside of an earlier interval of at least their priority.

    In order of start, longest first, an interval lies inside of another one if that came
    before and ends no earlier; per priority, the furthest end so far is all that matters.
    """
    levels = sorted({r.priority for r in rules()}, reverse=True)
    ends = F.struct(*[F.lit(-1).alias(f"p{p}") for p in levels])
    start = F.struct(ends.alias("ends"), F.array().cast(DETECTION).alias("kept"))

    def step(acc, x):
        inside = F.lit(False)
        for p in levels:
            inside = inside | ((F.lit(-p) <= x["minus_priority"]) & (acc["ends"][f"p{p}"] >= -x["minus_last"]))
        new_ends = F.struct(*[
            F.when(x["minus_priority"] == -p, F.greatest(acc["ends"][f"p{p}"], -x["minus_last"]))
            .otherwise(acc["ends"][f"p{p}"]).alias(f"p{p}") for p in levels
        ])
        return F.struct(
            new_ends.alias("ends"),
            F.when(inside, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(x))).alias("kept"),
        )

    return F.aggregate(found, start, step)["kept"]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.trim(F.regexp_replace(ascii_lower(text), NO_WORD, " "))
    normal = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select(
        "id", F.concat(F.lit(" "), words, F.lit(" ")).alias("padded")
    )
    padded = F.col("padded")
    nothing = F.array().cast(DETECTION)
    base_rules = [Rule(label, phrase, phrase, 1.0, 9) for phrase, label in BASE]
    gates = [F.contains(padded, F.lit(f" {phrase} ")) for phrase, _ in BASE]
    base = F.when(gates[0] | gates[1] | gates[2], detections(padded, base_rules)).otherwise(nothing)
    # A text without any keyword skips all rules.
    among = rules()
    gate = "|".join(sorted({r.keyword for r in among}))
    own = F.when(F.rlike(padded, F.lit(f" (?:{gate})")), detections(padded, among)).otherwise(nothing)
    found = normal.select(
        "id", F.when(F.length(padded) <= 2, F.lit(0)).otherwise(_blanks(padded) - 1).cast("long").alias("n_words"),
        base.alias("base"), own.alias("own"),
    )
    chosen = found.select("id", "n_words", "base", kept(F.col("own")).alias("own"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda x: x["label"])))
    labels = F.array_sort(F.array_distinct(F.transform(F.concat("base", "own"), lambda x: x["label"])))
    return chosen.select(
        F.col("id").alias(id_col), "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda x: x["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda x: x["start"])).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform(F.concat("base", "own"), lambda x: x["weight"])), F.lit(0.0)).alias("score"),
        F.transform("own", lambda x: F.struct(
            x["start"].alias("first"), (-x["minus_last"]).alias("last"), x["label"].alias("label"),
        )).alias("detections"),
    )
