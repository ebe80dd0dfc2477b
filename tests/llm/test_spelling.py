from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from breachlens.llm import spelling
from breachlens.llm.acceptors import Acceptors
from tests.llm import small


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows, least_length=6, least_n=5):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = small.lower(run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_n}
    forms, near = {}, {}
    for w in n:
        others = sorted((-n[o], o) for o in n if one_edit(w, o))
        near[w] = len(others)
        forms[w] = others[0][1] if others and -others[0][0] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n[w], near[w], n[forms[w]] if forms[w] else None))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus(seed=5):
    """Few letters, so that many words are near, with frequencies from one to hundreds."""
    r = random.Random(seed)
    words = ["".join(r.choice("abÀé") for _ in range(r.randint(4, 9))) for _ in range(300)]
    words += [w[:2] + "ab" * 40 + w[2:] for w in words[:10]] + ["x" * 200, "x" * 201, "x" * 100 + "y" + "x" * 99]
    rows = []
    for i in range(60):
        text = []
        for w in words:
            text += [w if r.random() < 0.8 else w.upper().replace("É", "é")] * int(r.paretovariate(0.6)) if r.random() < 0.3 else []
        r.shuffle(text)
        rows.append((i * 1000 + 7, r.choice([" ", "\n", ", ", "1"]).join(text)))
    return rows + [(None, rows[0][1]), (None, None), (3, ""), (3, "one"), *rows[:3]]


def test_equals_comparing_all_words(spark):
    rows = corpus() + small.texts()
    assert found(spelling.group_variants(small.frame(spark, rows))) == plain(rows)


def test_parts_dealt_out_again_change_nothing(spark, monkeypatch):
    rows = corpus(6)
    monkeypatch.setattr(spelling, "PART", 3)
    monkeypatch.setattr(spelling, "MIDDLE", 2)
    assert found(spelling.group_variants(small.frame(spark, rows))) == plain(rows)


def test_long_chains_of_forms(spark):
    """Each word has five times as many of the next: the root is at the end."""
    words = ["aaaaaaa"[:6 - i] + "bbbbbbb"[:i] + "cc" for i in range(6)]
    text = " ".join(" ".join([w] * (5 * 5 ** i)) for i, w in enumerate(words))
    got = {r["word"]: r for r in spelling.group_variants(small.frame(spark, [(1, text)])).collect()}
    assert {r["root"] for r in got.values()} == {words[-1]}
    assert [tuple(r) for r in sorted(got.values())] == plain([(1, text)])


def test_damage_is_by_document(spark):
    rows = [(i, "wonderful") for i in range(2000)]
    got = found(spelling.group_variants(small.frame(spark, rows), least_n=1))
    assert got == plain(rows, least_n=1) and len(got) > 1


def test_empty(spark):
    assert spelling.group_variants(small.empty(spark)).collect() == []
    assert spelling.group_variants(small.frame(spark, [(1, None), (2, "a b")])).collect() == []


def test_a_word_of_a_million_letters(spark):
    word = "ab" * 500_000
    rows = [(i, word) for i in range(6)] + [(i, word + "c") for i in range(6)] + [(9, "shorter " * 9)]
    got = spelling.group_variants(small.frame(spark, rows, partitions=1)).collect()
    damaged = sum(crc32(f"{i}:{w}".encode()) % 199 == 0 for i in range(6) for w in (word, word + "c"))
    assert sorted((len(r["word"]), r["n"], r["n_near"]) for r in got) == [(7, 9, 0), (10 ** 6, 6, 1), (10 ** 6 + 1, 6, 1)]
    assert not damaged


@pytest.mark.parametrize("seed", range(4))
def test_compositions_give_each_pair_once(seed):
    r = random.Random(seed)
    words = sorted({"".join(r.choice("abc") for _ in range(4)) for _ in range(60)})
    longer = sorted({"".join(r.choice("abc") for _ in range(5)) for _ in range(90)})
    machine = Acceptors()
    a, b = machine.accept(words), machine.accept(longer)
    replaced = list(machine.replaced(a))
    assert sorted(map(sorted, replaced)) == sorted([x, y] for x in words for y in words if x < y and one_edit(x, y))
    assert sorted(machine.deleted(b, a)) == sorted((x, y) for x in longer for y in words if one_edit(x, y))


def test_acceptors_are_minimal():
    machine = Acceptors()
    machine.accept(sorted(["tap", "taps", "top", "tops"]))
    assert len(machine.final) == 5  # "", t, ta or to, p, s
