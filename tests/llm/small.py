"""Hand-made documents with every awkward case, and plain loops for what operators return."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that operators use inside, as columns of the input.
CLASHING = "n_words string, id string, words string, unit int, rid string, label int, start string, part string, row int"


def lower(text: str | None) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(r: random.Random, n: int, among: int = 400) -> str:
    syllables = ["th", "er", "in", "on", "été", "sch", "ou", "ñe", "ll", "a", "Ti"]
    vocabulary = ["".join(r.choice(syllables) for _ in range(1 + i % 4)) + str(i % 7) * (i % 11 == 0) for i in range(among)]
    out = []
    for _ in range(n):
        out.append(r.choice(vocabulary) + r.choice(["", "", "", ",", ".", ".\n", "!"]))
    return " ".join(out)


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    r = random.Random(seed)
    plain = [prose(r, r.randint(12, 150)) for _ in range(30)]
    passage = prose(r, 90)
    near = plain[3].split(" ")
    near[len(near) // 2] = "changed"
    rows: list[tuple[int | None, str | None]] = list(enumerate(plain))
    rows += [
        (100, None), (101, ""), (102, " \n\t\x0b "), (103, "one"), (104, "ONE"), (105, "a b c"), (106, "A  b\nc"),
        (107, plain[3]), (108, " ".join(near)), (109, plain[4] + " " + passage), (110, passage + plain[5]),
        (111, passage), (112, "x " * 3000), (113, prose(r, 6000)), (114, "same line here\n" * 6),
        (115, "Under the MIT License. cc-by-nc CC BY NC; Apache License, Version 2.0"),
        (116, "#$% *** &&& <<>> || %%%% #### $$$ one two three four"),
        (117, "naïve İstanbul don't <|endoftext|>   é é 中国 🙂 a\x1cb x\x85y"),
        (118, plain[6]), (118, plain[6]), (None, plain[7]), (None, None),
    ]
    return rows


def frame(spark, rows, partitions: int = 3) -> DataFrame:
    clash = ("w", "i", "x", 1, "r", 2, "s", "p", 3)
    return spark.createDataFrame(
        [(*row, *clash) for row in rows], f"doc_id bigint, text string, {CLASHING}"
    ).repartition(partitions)


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], f"doc_id bigint, text string, {CLASHING}")


def components(rows, width: int, percent: int):
    """Set size and component of each row, by all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        w = words(lower(text))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    inverse = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            inverse[x].append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in inverse[x] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    ids = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        ids[find(i)].append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def covered(rows, length: int):
    """For each text which of its bytes a repeated string of that length covers."""
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        marks = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                marks[i:i + length] = [True] * length
        out.append((b, marks))
    return out
