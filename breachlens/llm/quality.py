"""Operator 8: quality rules as a short-circuit cascade, in DataFrame functions only.

Base measures are columns of each row. The cascade is a list of rules, each a condition that
rejects a row. Cost and selectivity of every rule are estimated on a sample, and rules are
ordered by rejections per cost: a row that an early rule rejects is not seen by later ones.
The order changes the work, never the verdict, so the sample may be bounded.

Defined cases: a null text has no words and fails the base; so does an empty one; repeated
rows are judged each; columns besides the id and the text are not read by `judge`, and
`keep_clean` returns the rows it keeps with all their columns.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breachlens.llm.common import SPACES, fresh

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: The sample on which the rules' cost and selectivity are estimated: the first rows whose texts
#: are not longer than this. It decides the order of the rules and nothing else.
SAMPLE_ROWS, SAMPLE_CHARS = 500, 20_000
#: Words among which repetition is judged. The share of distinct words falls as a text grows, so a
#: longer one is judged by the mean over its consecutive blocks of so many words.
BLOCK_WORDS = 1000


def words_of(text: Column) -> Column:
    """The runs of `[^\\x20\\x09-\\x0D]` as an array; null and empty texts have none."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(
        F.split(inner, r"[\x20\x09-\x0D]+", -1)
    )


def base_measures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, words, lines and the base columns), computed within each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    split = first.select("id", "text", words_of(F.col("text")).alias("words"),
                         F.filter(F.split(text, "\n", -1), lambda x: F.length(F.trim(x, F.lit(SPACES))) > 0).alias("lines"))
    n = F.size("words")
    # One hash of each window. Windows of a text that differ collide with a chance of its
    # squared length over 2^64.
    windows = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)),
        lambda i: F.xxhash64(*[F.element_at(F.col("words"), (i + k).cast("int")) for k in range(WINDOW)]),
    )).otherwise(F.array().cast("array<bigint>"))
    hashed = split.select("*", windows.alias("windows"))
    # Few texts repeat a window: only they are sorted.
    order = F.sort_array(F.transform(F.col("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = hashed.select("*", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"), order
    ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("sorted"))
    twice = F.filter(F.col("sorted"), lambda x, i: (
        (F.get(F.col("sorted"), i - 1)["h"] == x["h"]) | (F.get(F.col("sorted"), i + 1)["h"] == x["h"])
    ))
    starts = found.select("*", F.sort_array(F.transform(twice, lambda x: x["i"])).alias("starts"))
    covered = F.aggregate(
        F.transform(F.col("starts"), lambda p, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(F.col("starts"), i + 1) - p, F.lit(WINDOW))
        )), F.lit(0).cast("long"), lambda acc, x: acc + x,
    )
    return starts.select(
        "id", "text", "words", "lines",
        n.cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    ).withColumn(
        # The last condition never holds. Being non-deterministic, it keeps filters above this
        # projection: pushed below, they would repeat all measures inside of each lambda.
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
        | (F.monotonically_increasing_id() < 0),
    )


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def rules() -> list[Rule]:
    """Rules over the base measures; each holds only for plain junk."""
    n, chars = F.col("n_words"), F.col("word_chars")
    text = F.coalesce(F.col("text"), F.lit(""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    distinct = F.when(n <= BLOCK_WORDS, F.size(F.array_distinct("words"))).otherwise(F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(BLOCK_WORDS)), F.lit(0),
        lambda acc, at: acc + F.size(F.array_distinct(F.slice("words", at + 1, BLOCK_WORDS))),
    ))
    return [
        Rule("symbols", F.col("n_symbols") * 10 > n * 3),
        Rule("short_words", chars < 2 * n),
        Rule("long_words", chars > 25 * n),
        Rule("same_lines", (F.size("lines") >= 3) & (F.col("n_dup_lines") * 2 > F.size("lines"))),
        Rule("few_letters", letters * 2 < chars),
        Rule("shouting", F.length(F.regexp_replace(text, r"[^\p{Lu}]", "")) * 2 > letters),
        Rule("one_word_repeated", distinct * 5 < n - 20),
        Rule("bullets", (F.size("lines") >= 3) & (
            F.size(F.filter("lines", lambda x: F.trim(x).rlike(r"^[-*•●]"))) * 10 > F.size("lines") * 9)),
        Rule("cut_lines", (F.size("lines") >= 3) & (
            F.size(F.filter("lines", lambda x: F.trim(x).rlike(r"(\.\.\.|…)$"))) * 10 > F.size("lines") * 3)),
    ]


def ordered(docs: DataFrame, text_col: str, among: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on a sample, the most worthwhile first.

    The sample is taken by a few tasks, as many as its rows need, and not by a scan of all.
    """
    short = docs.select(F.lit(0).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where(
        F.length("text") <= SAMPLE_CHARS
    )
    taken = docs.sparkSession.createDataFrame(short.take(sample_rows), short.schema)
    sample = base_measures(taken, "id", "text").where(~F.col("base_failed")).persist()
    try:
        def timed(condition: Column) -> tuple[float, int, int]:
            started = time.perf_counter()
            row = sample.agg(F.count(F.when(condition, 1)).alias("r"), F.count("*").alias("n")).first()
            return time.perf_counter() - started, row["r"], row["n"]

        timed(F.lit(True))
        floor = timed(F.lit(True))[0]

        def worth(rule: Rule) -> float:
            seconds, rejected, rows = timed(rule.rejects)
            return (rejected + 1) / (rows + 2) / max(seconds - floor, 1e-3)

        return [r for _, r in sorted(((worth(r), r) for r in among), key=lambda x: -x[0])]
    finally:
        sample.unpersist()


def cascade(order: list[Rule]) -> Column:
    """The name of the first rule that rejects a row, null if none; later ones are not run."""
    found = F.when(F.col("base_failed"), F.lit("base"))
    for rule in order:
        found = found.when(F.coalesce(rule.rejects, F.lit(False)), F.lit(rule.name))
    return found.otherwise(F.lit(None).cast("string"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, base measures, base_failed, rejected_by, kept) for every row."""
    measured = base_measures(docs, id_col, text_col)
    order = ordered(docs, text_col, rules(), sample_rows)
    return measured.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", cascade(order).alias("rejected_by"),
    ).withColumn("kept", F.col("rejected_by").isNull())


def keep_clean(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows that no rule rejects, with the columns they came with."""
    row = fresh(docs, "row")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row), F.col(f"`{text_col}`").alias("text"))
    measured = base_measures(packed, row, "text")
    order = ordered(docs, text_col, rules(), sample_rows)
    return measured.where(cascade(order).isNull()).select(F.col("id").alias(row)).select(f"{row}.*")
