"""Operators on single texts, against plain loops and the tokenizers library."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from breachlens.llm import bpe, hpylm, licenses, packing, quality, vocab, wordpiece
from breachlens.llm import registry as llm
from breachlens.session import shared_dir
from check import actual, difference, expected
from tests.llm.small import empty, frame, lower, prose, texts, words


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def library():
    return vocab.library_tokenizer(vocab.read(vocab.public_path(vocab.WORD_BPE)))


def test_token_counts_are_those_of_greedy_longest_match(spark):
    known = set(wordpiece.vocabulary(vocab.read(vocab.public_path(vocab.BYTE_BPE))))

    def pieces(word: bytes) -> int:
        count = 0
        while word:
            size = next(n for n in range(len(word), 0, -1) if word[:n] in known)
            word, count = word[size:], count + 1
        return count

    want = Counter()
    for doc_id, text in texts():
        counts = [pieces(b" " + w.encode()) for w in words(text)]
        want[(doc_id, len(counts), sum(counts), max(counts, default=0))] += 1
    assert multiset(wordpiece.token_counts(frame(spark, texts()))) == want
    assert wordpiece.token_counts(empty(spark)).collect() == []


def test_automaton_says_so_if_a_word_cannot_be_cut():
    automaton = wordpiece.LongestMatch([b"ab", b"abc", b"c"])
    assert [automaton.count(w) for w in (b"abcab", b"abab", b"abx", b"a", b"")] == [2, 2, -1, -1, 0]


def test_encoding_and_decoding_are_those_of_the_library(spark, library):
    want, decoded = Counter(), Counter()
    for doc_id, text in texts():
        ids = library.encode(text or "", add_special_tokens=False).ids
        plain = library.decode(ids, skip_special_tokens=False)
        want[(doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256(plain.encode()).hexdigest())] += 1
        decoded[(doc_id, plain)] += 1
    docs = frame(spark, texts())
    assert multiset(bpe.round_trip(docs)) == want
    assert multiset(bpe.decode(bpe.encode(docs))) == decoded
    assert bpe.round_trip(empty(spark)).collect() == []


def test_merging_with_a_heap_is_merging(library, monkeypatch):
    model, r = bpe.Bpe(vocab.read(vocab.public_path(vocab.WORD_BPE))), random.Random(5)
    for n in (2, 3, 50, 400):
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "theain"):
            symbols = [model.vocab[r.choice(letters)] for _ in range(n)]
            monkeypatch.setattr(bpe, "LONG", 1000)
            want = model.merge(symbols)
            monkeypatch.setattr(bpe, "LONG", 1)
            assert model.merge(symbols) == want


def test_a_word_of_a_million_letters(spark, library):
    r = random.Random(6)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(1_000_000))
    word = re.sub("[0-9]", "q", word)
    ids = library.encode(word, add_special_tokens=False).ids
    started = time.time()
    got = bpe.round_trip(spark.createDataFrame([(1, word)], "doc_id bigint, text string")).first()
    assert time.time() - started < 60
    assert (got.n_tokens, got.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_speculation_is_verified_before_it_is_taken(library):
    model = bpe.Bpe(vocab.read(vocab.public_path(vocab.WORD_BPE)))
    sample = ["ththerein", "aaaaaaa", "onheatingly", "eauouon", "zzxqj", "internationalisation", "été"]
    shown = [model.words(w)[0] for w in sample]
    got = model.encode_words(shown)
    assert got == [library.encode(w, add_special_tokens=False).ids for w in sample]
    assert any(model.propose(w) != ids for w, ids in zip(shown, got)), "no word needed exact merging"


def test_pieces_tile_documents_and_sequences(spark, library):
    docs = frame(spark, texts())
    pieces = packing.pack(docs, window=64).collect()
    ids_of = defaultdict(list)
    for doc_id, text in texts():
        ids_of[doc_id].append(np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for doc_id, copies in ids_of.items():
        # Pieces of rows with one id are told apart by their place in the whole.
        placed = sorted(by_doc[doc_id], key=lambda p: p.sequence_id * 64 + p.offset)
        joined, got = b"", []
        for p in placed:
            if p.start == 0 and joined:
                got.append(joined)
                joined = b""
            assert p.start * 4 == len(joined) and len(p.ids) == 4 * p.length
            joined += p.ids
        assert sorted([*got, joined]) == sorted(copies)
    sizes = []
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        sizes.append(at)
    assert sorted(by_sequence) == list(range(len(sizes)))
    assert sorted(sizes)[1:] == [64] * (len(sizes) - 1)
    whole = packing.sequences(packing.pack(docs, window=64)).collect()
    assert sum(len(s.ids) for s in whole) == sum(len(p.ids) for p in pieces)
    assert packing.pack(empty(spark)).collect() == []


def base_of(text):
    w = words(text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines, seen = [x for x in (text or "").split("\n") if words(x)], set()
    twice = sum(x in seen or seen.add(x) is not None for x in lines)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), twice, len(covered), failed)


def test_quality_measures(spark):
    got = quality.judge(frame(spark, texts()))
    base = got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert multiset(base) == Counter((i, *base_of(t)) for i, t in texts())
    assert got.where("base_failed and kept").collect() == []
    assert got.where("not kept and rejected_by is null").collect() == []
    assert quality.judge(empty(spark)).collect() == []


def test_the_order_of_rules_does_not_change_the_verdict(spark):
    measured = quality.base_measures(frame(spark, texts()), "doc_id", "text").persist()
    forward = measured.select("id", quality.cascade(quality.rules()).isNull().alias("k"))
    backward = measured.select("id", quality.cascade(quality.rules()[::-1]).isNull().alias("k"))
    assert multiset(forward) == multiset(backward)
    order = quality.ordered(frame(spark, texts()), "text", quality.rules(), 5)
    assert {r.name for r in order} == {r.name for r in quality.rules()}
    measured.unpersist()


def test_expected_verdicts_of_long_texts(spark):
    """The expected result judges repetition by blocks, too: in both directions it matters."""
    r = random.Random(12)
    few = " ".join(prose(r, 1, 10_000) for _ in range(900))
    words_ = ["w" + "".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(330)]
    long = " ".join(r.choice(words_) for _ in range(9000))  # under a fifth in all, over it in each block
    rows = [(1, few), (2, long), (3, " ".join(r.choice(words_[:90]) for _ in range(3000))), (4, None)]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = quality.judge(docs).drop("rejected_by")
    assert difference(actual(got), expected(db, llm.OP8_SQL)) is None
    assert {x.doc_id: x.kept for x in got.collect()} == {1: True, 2: True, 3: False, 4: False}


def test_clean_documents_keep_their_columns(spark):
    docs = frame(spark, texts())
    kept = quality.keep_clean(docs)
    assert kept.columns == docs.columns
    judged = quality.judge(docs).where("kept").select("doc_id")
    assert multiset(kept.select("doc_id")) == multiset(judged)


def test_a_long_clean_text_is_not_taken_for_one_word_repeated(spark):
    r = random.Random(5)
    clean = [f"{r.choice('bcdfg')}ord{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(2000)]
    few = clean[:150]
    rows = [(n, " ".join(r.choice(clean) for _ in range(n))) for n in (900, 30_001)]
    rows += [(n + 1, " ".join(r.choice(few) for _ in range(n))) for n in (900, 30_001)]
    got = {i.doc_id: i for i in quality.judge(frame(spark, rows)).collect()}
    assert got[900].kept and got[30_001].kept
    assert got[901].rejected_by == got[30_002].rejected_by == "one_word_repeated"
    assert [i.doc_id for i in quality.keep_clean(frame(spark, rows)).orderBy("doc_id").collect()] == [900, 30_001]


def phrase_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


MORE = [
    (200, "cc by nc cc by nc CC-BY-NC"), (201, "SPDX-License-Identifier: GPL-3.0-only"),
    (202, "released under the Apache License, Version 2.0"), (203, "licensed under cc by nc sa 4.0 license"),
    (204, "the limit license of summit licenses"), (205, "All rights reserved. See the LICENSE file."),
]


def test_license_phrases(spark):
    rows = texts() + MORE
    got = licenses.scan(frame(spark, rows))
    base = got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert multiset(base) == Counter((i, *phrase_places(t)) for i, t in rows)
    found = {r.doc_id: r for r in got.collect()}
    assert found[201].labels == "gpl-3" and found[202].labels == "apache-2"
    assert found[203].labels == "cc-by-nc,cc-by-nc-sa"  # a base phrase always stays
    assert found[204].labels == "" and found[204].score == 0
    assert [(d.first, d.last) for d in found[202].detections] == [(0, 7)]
    assert all(0 <= r.score <= 1 for r in found.values())
    assert licenses.scan(empty(spark)).collect() == []


def test_there_are_hundreds_of_rules_and_each_can_match():
    assert len(licenses.rules()) > 200
    for rule in licenses.rules():
        re.compile(rule.pattern)


def examples(pattern):
    """Every text that a pattern matches, lookaheads left aside."""
    from re import _parser as parser

    def of(parsed):
        out = [""]
        for kind, value in parsed:
            kind = str(kind)
            if kind == "LITERAL":
                more = [chr(value)]
            elif kind == "IN":
                more = [chr(c) for k, v in value for c in (range(v[0], v[1] + 1) if str(k) == "RANGE" else [v])]
            elif kind == "SUBPATTERN":
                more = of(value[3])
            elif kind == "BRANCH":
                more = [x for branch in value[1] for x in of(branch)]
            elif kind == "MAX_REPEAT":
                assert value[:2] == (0, 1)
                more = ["", *of(value[2])]
            else:
                assert kind == "ASSERT_NOT", kind
                more = [""]
            out = [a + b for a in out for b in more]
        return out

    return of(parser.parse(pattern))


def test_whatever_a_rule_matches_passes_its_gate():
    for rule in licenses.rules():
        found = examples(rule.pattern)
        assert found and all(f" {rule.keyword}" in f" {x} " for x in found), rule


def test_licenses_by_their_other_names(spark):
    rows = [(1, "released under the Expat license"), (2, "licensed under ASL 2.0"), (3, "zero-clause BSD license"),
            (4, "the 0BSD license"), (5, "MIT license"), (6, "2-clause BSD license")]
    found = {r.doc_id: r.labels.split(",") for r in licenses.scan(frame(spark, rows)).collect()}
    assert "mit" in found[1] and "apache-2" in found[2]
    assert found[3] == found[4] == ["0bsd"] and found[5] == ["mit"] and found[6] == ["bsd-2"]


def test_scores_learn_from_training_documents_alone(spark, monkeypatch):
    monkeypatch.setattr(hpylm, "UNIT_TOKENS", 2000)
    rows = texts()
    got = defaultdict(list)
    for r in hpylm.score(frame(spark, rows)).collect():
        got[r.doc_id].append(r)
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    tokens = [(i, [*words(lower(t)), ""]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if not held[i] for w in ws)
    total, types = sum(counts.values()), len(counts)
    for i, ws in tokens:
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in ws)
        same = [r for r in got[i] if r.n_tokens == len(ws) and abs(r.base_score - base) < 1e-6 * max(1, abs(base))]
        assert same and all(r.held_out == held[i] and r.train_tokens == total for r in same)
        assert all(r.n_known == sum(counts[w] > 0 for w in ws) and r.score < 0 for r in same)
    assert sum(map(len, got.values())) == len(rows)
    assert hpylm.score(empty(spark)).collect() == []


def test_predictive_probabilities_sum_to_one():
    """Over all words and the unknown one, in a context seen and in one not seen."""
    keys = np.arange(1, 6, dtype=np.int64)
    pairs = [[(7, 3), (263, 1)], [(7, 1)], [(263, 40)], [(7, 2), (519, 5)], []]  # the last is unknown
    contexts = [np.array([c for c, _ in p] + [65], np.int32).tobytes() for p in pairs]
    counts = [np.array([n for _, n in p] + [0], np.int64).tobytes() for p in pairs]
    model = {"words": 5, "d0": 0.4, "d1": 0.6, "d2": 0.7}
    own = hpylm.Restaurants(keys, contexts, counts, model)

    def totals():
        out = []
        for at, c, t, n in ((np.zeros(5, int), own.c0, own.t0, 1), (own.parent, own.c1, own.t1, 257), (own.context, own.c2, own.t2, 65537)):
            out.append((np.bincount(at, weights=c, minlength=n), np.bincount(at, weights=t, minlength=n)))
        return out

    before = totals()
    for number in range(1, 4):
        own.sweep(before, number)
        before = totals()
        assert (own.t2 <= own.c2).all() and (own.t1 <= own.c1).all() and ((own.t2 > 0) == (own.c2 > 0)).all()
        assert own.root(before).sum() == pytest.approx(1)
        unseen = own.leaves(before)[own.context == 65]
        assert unseen.sum() == pytest.approx(1)


def plain_scores(rows, held, sweeps, burn_in):
    """The model over whole words as contexts by dictionaries, each sweep over all pairs."""
    tokens = [(i, [w.encode() for w in [*words(lower(t)), ""]]) for i, t in rows]
    pairs, learned = Counter(), Counter()
    for i, ws in tokens:
        for pair in zip([b"", *ws], ws):
            pairs[pair] += not held[i]
            learned[pair[1]] += not held[i]
    listed, vocabulary = sorted(pairs), sorted(learned)
    c = np.array([pairs[p] for p in listed])
    hashes = {w: np.uint64(hpylm.word_hash(w)) for w in vocabulary}
    of_context = np.array([vocabulary.index(u) for u, _ in listed])
    of_word = np.array([vocabulary.index(w) for _, w in listed])
    key0 = np.array([hashes[w] for w in vocabulary])
    key1 = hpylm.pair_hash(key0[of_context] | np.uint64(1), key0[of_word])
    size, n = 1 + sum(x > 0 for x in learned.values()), len(vocabulary)

    def totals(t1):
        return np.bincount(of_context, t1, n), np.bincount(of_word, t1, n).astype(int)

    t1 = np.minimum(c, 1)
    tables, c0 = totals(t1)
    t0 = np.minimum(c0, 1)
    customers = np.bincount(of_context, c, n)
    d1 = hpylm.discount_of(sum(c == 1), sum(c == 2))
    d0 = hpylm.discount_of(sum(c0 == 1), sum(c0 == 2))
    mean = np.zeros(len(listed))
    for number in range(1, sweeps + 1):
        root = (c0 - d0 * t0 + (1 + d0 * t0.sum()) / size) / (1 + c0.sum())
        weight = (1 + d0 * t0.sum()) / size
        t1 = hpylm.seated(c, (1 + d1 * tables[of_context]) * root[of_word], d1, key1, number * 3)
        tables, c0 = totals(t1)
        t0 = hpylm.seated(c0, np.full(n, weight), d0, key0, number * 3 + 2)
        root = (c0 - d0 * t0 + (1 + d0 * t0.sum()) / size) / (1 + c0.sum())
        unknown = (1 + d0 * t0.sum()) / size / (1 + c0.sum())
        assert root[[learned[w] > 0 for w in vocabulary]].sum() + unknown == pytest.approx(1)
        if number > burn_in:
            mean += (c - d1 * t1 + (1 + d1 * tables[of_context]) * root[of_word]) / (1 + customers[of_context])
    logs = dict(zip(listed, np.log10(mean / (sweeps - burn_in))))
    return sorted((str(i), sum(logs[p] for p in zip([b"", *ws], ws))) for i, ws in tokens)


def test_scores_are_those_of_contexts_of_whole_words(spark, monkeypatch):
    """However the pairs are dealt out; words with one ending do not share a restaurant."""
    rows = texts() + [(400 + i, "the band plays") for i in range(0, 90, 2)] + [(401 + i, "the hand waves") for i in range(0, 90, 2)]
    rows += [(600 + i, t) for i in range(14) for t in ("the band plays", "the band waves")]
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    want = plain_scores(rows, held, hpylm.SWEEPS, hpylm.BURN_IN)
    for chars, tokens in ((16_000_000, 2000), (2000, 1 << 22)):
        monkeypatch.setattr(hpylm, "PART_CHARS", chars)
        monkeypatch.setattr(hpylm, "UNIT_TOKENS", tokens)
        got = hpylm.score(frame(spark, rows)).collect()
        found = sorted((str(r.doc_id), r.score) for r in got)
        assert [i for i, _ in found] == [i for i, _ in want]
        assert [x for _, x in found] == pytest.approx([x for _, x in want], rel=1e-5)
    doc = next(i for i in range(600, 614) if held[i])
    waves, plays = (x for i, x in found if i == str(doc))
    assert plays > waves + 0.5


def test_lists_of_pairs_take_few_bytes(spark):
    """Numbers need no list of their own, equal words are neighbours, and what was seated goes."""
    unit = hpylm.Unit()
    for i in range(400):
        unit.add(prose(random.Random(i), 100), i % 7 == 2)
    dealt = list(unit.dealt(4))
    at = 0
    for _, start, contexts, learned, counts in dealt:
        assert start == at and len(contexts) == len(learned) == len(counts)
        order = list(zip(learned.tolist(), contexts.tolist()))
        assert order == sorted(set(order))
        assert (hpylm.unpacked(hpylm.packed(contexts), np.uint64) == contexts).all()
        at += len(learned)
    assert sorted({n for t in unit.document_tokens(4) for n in t.tolist()}) == list(range(at))
    assert len(hpylm.unpacked(hpylm.packed(np.zeros(0, np.int64)), np.int64)) == 0
    folder = Path(shared_dir(spark).removeprefix("file:")) / "llm"
    before = set(folder.glob("lm-*"))
    hpylm.score(frame(spark, texts())).collect()
    left = {f.name.rpartition("-")[0] for f in set(folder.glob("lm-*")) - before}
    assert left == {"lm-back"}
