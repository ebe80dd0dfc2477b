"""Operators that compare rows with each other, and the pipeline, against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from breachlens.llm import anchors, jaccard, suffix_dedup, suffixes, urls, vafile
from breachlens.llm import registry as llm
from check import actual, connect, difference, expected
from tests.llm.small import components, covered, empty, frame, prose, texts

DIRECTORY = "/root/testdata/sf0.001"


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


# Operator 1


RULES = llm.OP1_RULES
URLS = [
    None, "", "no scheme", "https://", "https://A.Example.NET/en/1", "http://example.net/fr/2?x=/en/", "x://net/", "x://net",
    "ftp://sub.example.com/de/9#t", "http://example.com/DE/9", "http://notexample.com/de/9", "http://b.org/fr/", "http://b.org/fr",
    "HTTP://ÄB.org/x?y://z", "http://h:80?q", "http://h#f", "http://a//b///c",
    "http://deep.org/" + "/".join("abcdefghij"), "http://x.org/0123456789abcdef0123/p",
]


def host_and_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    stop = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:stop]


def rule_of(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.text), default=None)


def pages(spark, found):
    return spark.createDataFrame(
        [(i, u, "h", "p", 1, "v") for i, u in enumerate(found)],
        "page_id bigint, url string, host string, path string, n int, verdict string",
    )


def test_rules_and_parsing_of_urls(spark):
    found = URLS + URLS[4:7]
    got = urls.judge(pages(spark, found), spark.createDataFrame([], "url string, bad int"), RULES)
    want = Counter()
    for i, url in enumerate(found):
        host, path = host_and_path(url)
        rule = rule_of(host, path)
        want[(i, host, path, rule and rule.text, rule.verdict if rule else "allow")] += 1
    assert multiset(got.select("page_id", "host", "path", "rule", "verdict")) == want
    nothing = pages(spark, [None]).where("false")
    assert urls.judge(nothing, spark.createDataFrame([], "url string, bad int"), RULES).collect() == []


def test_branches_that_differ_are_kept_apart_and_judged(spark):
    bad = [(f"http://h.org/bad/{i}", 1) for i in range(40)] + [("http://h.org/bad/0", None)]
    good = [(f"http://h.org/{d}/{i}", 0) for d in ("a", "b") for i in range(40)]
    many = [f"http://h.org/{w}" for w in ("u", "v")] + [f"http://k.org/word{chr(97 + i)}" for i in range(12)]
    found = [u for u, _ in bad + good] + many
    got = urls.judge(pages(spark, found), spark.createDataFrame(bad + good, "url string, bad int"), [])
    rows = {found[r.page_id]: r for r in got.collect()}
    assert rows["http://h.org/bad/7"].verdict == "block" and rows["http://h.org/bad/7"].template == "/bad/*"
    assert rows["http://h.org/a/7"].verdict == rows["http://h.org/b/7"].verdict == "allow"
    assert rows["http://h.org/a/7"].template == rows["http://h.org/b/7"].template == "/~-/*", "like branches are merged"
    assert rows["http://k.org/wordc"].template == "/*", "a node with many rare children is variable"
    host = (40 + 5 * 40 / 120) / 125
    assert rows["http://h.org/bad/7"].purity == pytest.approx((40 + 5 * host) / 45)


# Operator 3


def vectors(spark, rows):
    return spark.createDataFrame(
        [(i, v, 1, "x", "y") for i, v in rows], "vec_id bigint, embedding array<float>, id int, score string, rank string"
    )


def best(rows, step, k):
    clean = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    queries = {i: min(v for j, v in clean if j == i) for i, _ in clean if i % step == 0}
    for q, query in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in clean if i != q)[:k]
        out.update((q, n, i, -s) for n, (s, i) in enumerate(scores, 1))
    return out


@pytest.mark.parametrize("block, queries", [(8192, 1024), (40, 3)])
def test_top_k_is_exact(spark, monkeypatch, block, queries):
    monkeypatch.setattr(vafile, "BLOCK", block)
    monkeypatch.setattr(vafile, "QUERIES", queries)
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)]) for i in range(150)]
    rows += [(i, [0.5, -0.5, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]) for i in range(150, 180)]  # ties
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 8), (203, [float("inf")] * 8), (204, [2.0, 1.0]),
             (205, []), (None, [1.0] * 8), (20, [0.1] * 8), (206, [1e6] * 8), (207, [-1e6, 1e6] * 4)]
    from pyspark.sql import functions as F

    got = vafile.search(vectors(spark, rows), F.col("id") % 20 == 0, k=7)
    assert multiset(got) == best(rows, 20, 7)


def test_blocks_meet_without_copies_of_either_side(spark, monkeypatch):
    """Queries were broadcast once for each block of rows, which broke the driver on large tables."""
    monkeypatch.setattr(vafile, "BLOCK", 40)
    monkeypatch.setattr(vafile, "QUERIES", 3)
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(8)]) for i in range(400)]
    from pyspark.sql import functions as F

    got = vafile.search(vectors(spark, rows), F.col("id") % 20 == 0, k=7)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert multiset(got) == best(rows, 20, 7)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # neither side is small
    try:
        assert multiset(vafile.search(vectors(spark, rows), F.col("id") % 20 == 0, k=7)) == best(rows, 20, 7)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_fewer_rows_than_k(spark):
    from pyspark.sql import functions as F

    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5])]
    assert multiset(vafile.search(vectors(spark, rows), F.col("id") % 20 == 0)) == best(rows, 20, 20)
    assert vafile.search(vectors(spark, []), F.col("id") % 20 == 0).collect() == []


def test_vectors_too_large_for_exact_scores_are_refused(spark):
    schema = "vec_id bigint, embedding array<float>"
    large = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1.0, 1.0])], schema)
    with pytest.raises(Exception, match="too large for exact scores"):
        vafile.search(large, F.col("id") == 0).collect()
    many = spark.createDataFrame([(0, [float(1 << 22)] * 200)], schema)
    with pytest.raises(ValueError, match="fit a long"):
        vafile.search(many, F.col("id") == 0)
    right = spark.createDataFrame([(0, [float(1 << 22)] * 60), (1, [float(-(1 << 22))] * 60)], schema)
    assert [r.score for r in vafile.search(right, F.col("id") == 0).collect()] == [-60 * 2 ** 56]


def test_bounds_hold_the_score():
    r = np.random.default_rng(0)
    values = r.integers(-60, 60, (300, 5)).astype(np.int32)
    queries = r.integers(-60, 60, (9, 5))
    edges = np.quantile(values, np.arange(1, vafile.CELLS) / vafile.CELLS, axis=0).T
    cells = np.stack([np.searchsorted(edges[d], values[:, d], side="right") for d in range(5)], 1).astype(np.uint8)
    low = np.full((5, vafile.CELLS), vafile.LIMIT, np.int32)
    high = -low
    for d in range(5):
        np.minimum.at(low[d], cells[:, d], values[:, d])
        np.maximum.at(high[d], cells[:, d], values[:, d])
    lower, upper = vafile._bounds(queries, cells.tobytes(), low.tobytes(), high.tobytes(), 5)
    exact = queries @ values.T
    assert (lower <= exact).all() and (exact <= upper).all()


# Operator 9


def test_suffix_sorting_finds_every_repeat():
    r = random.Random(3)
    for _ in range(200):
        letters, length = r.choice([b"ab", b"abc", b"a", b"\x00\x01\xff"]), r.choice([3, 5, 8])
        pieces = [bytes(r.choice(letters) for _ in range(r.randint(length, 40))) for _ in range(r.randint(2, 6))]
        starts = [r.randint(1, len(p) - length + 1) for p in pieces]
        count = Counter(p[i:i + length] for p, n in zip(pieces, starts) for i in range(n))
        want = [[i for i in range(n) if count[p[i:i + length]] > 1] for p, n in zip(pieces, starts)]
        assert [m.tolist() for m in suffixes.repeated_starts(pieces, starts, length)] == want


def test_suffixes_come_in_order():
    text, order, begins = suffixes.sorted_suffixes([b"mississippi", b"missouri"], [11, 8], 20)
    ends = {0: 11, 12: 20}
    shown = [text[i:ends[12 if i >= 12 else 0]] for i in order]
    assert shown == sorted(shown) and sorted(order) == [*range(11), *range(12, 20)] and begins == [0, 12]


def test_every_window_has_one_anchor_wherever_it_stands():
    r = random.Random(4)
    common = bytes(r.randrange(97, 101) for _ in range(90))
    seen = {}
    for front in (0, 13, 57):
        text = bytes(r.randrange(97, 101) for _ in range(front)) + common
        hashes, at, _ = anchors.anchored(np.frombuffer(text, np.uint8), 50)
        for i in range(len(text) - 49):
            key = text[i:i + 50]
            found = (int(hashes[i]), int(at[i]) - i)
            assert seen.setdefault(key, found) == found


@pytest.mark.parametrize("group, segment", [(3000, 8_000_000), (2, 700)])
def test_repeated_passages(spark, monkeypatch, group, segment):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    rows = texts()
    want = Counter()
    for (doc_id, _), (raw, marks) in zip(rows, covered(rows, 120)):
        kept = bytes(b for b, m in zip(raw, marks) if not m)
        spans = sum(m and not (i and marks[i - 1]) for i, m in enumerate(marks))
        want[(doc_id, len(raw), sum(marks), spans, hashlib.sha256(kept).hexdigest())] += 1
    docs = frame(spark, rows)
    assert multiset(suffix_dedup.remove_repeats(docs, length=120).drop("spans")) == want
    if group > 2:
        assert suffix_dedup.remove_repeats(empty(spark)).collect() == []
        kept = suffix_dedup.cleaned(docs, length=120)
        assert kept.columns == docs.columns
        left = [bytes(b for b, m in zip(raw, marks) if not m) for raw, marks in covered(rows, 120)]
        plain = Counter(
            (i, t if not any(m) else k.decode(errors="ignore"))
            for (i, t), k, (_, m) in zip(rows, left, covered(rows, 120)) if k or not any(m)
        )
        assert multiset(kept.select("doc_id", "text")) == plain


def without_repeated_words(rows, width):
    """Each text without the words of any run of `width` words that occurs twice."""
    split = [list(re.finditer(r"[^\x20\x09-\x0D]+", t or "")) for _, t in rows]
    count = Counter(tuple(m[0] for m in ms[i:i + width]) for ms in split for i in range(len(ms) - width + 1))
    out = []
    for (_, t), ms in zip(rows, split):
        gone = {i + k for i in range(len(ms) - width + 1) if count[tuple(m[0] for m in ms[i:i + width])] > 1 for k in range(width)}
        cuts = [(ms[i].start(), ms[i].end() if i + 1 not in gone else ms[i + 1].start()) for i in sorted(gone)]
        kept = "".join(c for i, c in enumerate(t or "") if not any(a <= i < b for a, b in cuts))
        out.append((kept, bool(gone)))
    return out


@pytest.mark.parametrize("group, segment", [(3000, 8_000_000), (2, 700)])
def test_passages_of_over_fifty_words_go(spark, monkeypatch, group, segment):
    """Shorter than 400 bytes or not; two short repeats side by side are no long one."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    r = random.Random(8)

    def some(n):
        return " ".join("".join(r.choice("abcdefghij") for _ in range(r.choice([2, 3, 4, 5]))) for _ in range(n))

    short, long, left, right = some(51), some(50), some(30), some(30)
    many = [short.replace(" ", "\n", k) for k in range(4)]  # white space does not count
    rows = [(i, f"{some(60)} {p} {some(40)}") for i, p in enumerate(many)]
    rows += [(10 + i, f"{some(60)} {long} {some(40)}") for i in range(2)]
    rows += [(20, f"{some(9)} {left} {right} {some(9)}"), (21, f"{left} {some(9)}"), (22, f"{right} {some(9)}")]
    rows += [(30, "é " * 70 + some(20)), (31, some(70) + " " + many[1] + " " + some(5) + " " + many[2]), (32, short), (33, None), (34, "")]
    got = suffix_dedup.cleaned(frame(spark, rows), words=51)
    want = [(i, t if not gone else kept) for (i, t), (kept, gone) in zip(rows, without_repeated_words(rows, 51)) if kept.strip() or not gone]
    assert len(short.encode()) < 400 and short not in dict(want)[0] and long in dict(want)[10] and 32 not in dict(want)
    assert multiset(got.select("doc_id", "text")) == Counter(want)


def test_the_pipeline_removes_passages_of_over_fifty_words(spark):
    r = random.Random(9)
    passage = " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(55))
    rows = [(i, f"{prose(r, 90)} {passage} {prose(r, 90)}") for i in range(3)]
    assert len(passage) < 400
    docs = frame(spark, rows)
    for _, stage in corpus_pipeline.STAGES[2:-1]:
        docs = stage(spark, docs, "")
    assert docs.count() == 3 and not any(passage in d.text for d in docs.collect())


# Operator 10


@pytest.mark.parametrize("width, percent, block", [(4, 85, 20_000), (5, 80, 20_000), (2, 60, 3)])
def test_components_of_similar_documents(spark, monkeypatch, width, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(width)
    rows = texts()
    for family in range(4):
        base = prose(r, 60, 900).split(" ")
        for copy in range(9):
            own = list(base)
            for _ in range(copy % 5):
                own[r.randrange(len(own))] = r.choice(["new", "other", "words"])
            rows.append((300 + 10 * family + copy, " ".join(own)))
    got = jaccard.join(frame(spark, rows), words=width, percent=percent)
    assert multiset(got) == Counter(components(rows, width, percent))


def test_links_between_components_are_not_lost(spark):
    """A chain: each document links with the next, the lowest with hardly any."""
    r = random.Random(9)
    chain = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(25):
        rows.append((k if k != 12 else 99, " ".join(chain)))
        chain[r.randrange(60)] = f"x{k}"
    got = jaccard.join(frame(spark, rows), words=2, percent=80)
    assert multiset(got) == Counter(components(rows, 2, 80))


def test_pairs_of_many_long_lists_are_made_once(spark):
    """80 groups apart that share 12 lists: a pair comes from one of the lists and not from each."""
    sketch = jaccard.odd_sketch(np.arange(40, dtype=np.uint64))
    lists = spark.range(80 * 12).selectExpr("7 + id % 12 token", "id DIV 12 rid", "40 n", "CAST(id % 12 AS INT) pos").repartition(4)
    sketches = spark.createDataFrame([(i, 40, sketch) for i in range(80)], "rid bigint, n bigint, sketch binary")
    labels = spark.createDataFrame([(0, 0), (1, 0)], "node bigint, label bigint")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that lists lie in different tasks
    try:
        made = Counter((r.a, r.b) for r in jaccard._met(lists, labels, sketches, 80).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert set(made) == {(a, b) for a in range(80) for b in range(a)} - {(1, 0)}
    assert set(made.values()) == {1}


def test_one_document_of_each_component_stays(spark):
    rows = texts()
    docs = frame(spark, rows, 1)
    kept = jaccard.deduplicate(docs, words=4, percent=85)
    assert kept.columns == docs.columns
    want = components(rows, 4, 85)
    of_row = {row: c for row, (_, n, c) in zip(rows, want) if n}
    left = [(r.doc_id, r.text) for r in kept.collect()]
    assert Counter(of_row[row] for row in left if row in of_row) == Counter(set(of_row.values()))
    assert Counter(row for row in left if row not in of_row) == Counter(row for row in rows if row not in of_row)
    assert jaccard.deduplicate(empty(spark)).collect() == []
    assert jaccard.join(empty(spark)).collect() == []


# Queries and the pipeline


@pytest.fixture(scope="module")
def db():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", sorted(llm.oracle_sql(corpus_pipeline)))
def test_query(spark, db, name):
    assert difference(actual(entry.queries()[name](spark, DIRECTORY)), expected(db, entry.oracle_sql()[name])) is None


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def without_passages(found, n):
    """Texts without the runs of words that a repeated passage of n words covers."""
    places = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for t in found]
    split = [[t[a:b] for a, b in own] for t, own in zip(found, places)]
    count = Counter(tuple(w[i:i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for text, w, own in zip(found, split, places):
        gone = set()
        for i in range(len(w) - n + 1):
            if count[tuple(w[i:i + n])] > 1:
                gone.update(range(i, i + n))
        for i in sorted(gone, reverse=True):
            # With the white space to the next word, if that goes too.
            stop = own[i + 1][0] if i + 1 in gone else own[i][1]
            text = text[:own[i][0]] + text[stop:]
        out.append(text)
    return out


def test_the_pipeline_takes_awkward_rows(spark):
    r = random.Random(4)
    long = " ".join(prose(r, 400, 4000) for _ in range(30))
    rows = [*texts(), (200, long), (201, long), (None, long + " other"), (202, prose(r, 3000, 3000))]
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == frame(spark, rows).columns, name
    kept = docs.collect()
    assert 202 in {d.doc_id for d in kept} and len({200, 201, None} & {d.doc_id for d in kept if len(d.text) > 10_000}) == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() > 0
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []


def test_pipeline_by_stages(spark):
    """Each stage against a plain version of it, on what the one before has left."""
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in seen.collect()]
        after = stage(spark, seen, DIRECTORY)
        if name == "packing":
            assert {r.doc_id for r in after.collect()} == {i for i, _ in before}
            break
        assert after.columns == columns
        left = {r.doc_id: r.text for r in after.collect()}
        if name == "ngram_jaccard_join":
            of = {i: c for i, n, c in components(before, 5, 80)}
            assert Counter(of[i] for i in left) == Counter(set(of.values()))
        elif name == "suffix_array_dedup":
            plain = dict(zip([i for i, _ in before], without_passages([t for _, t in before], 51)))
            assert left == {i: t for i, t in plain.items() if t.strip() or not dict(before)[i].strip()}
            assert left != dict(before)
        seen = spark.createDataFrame(after.collect(), after.schema)
    assert corpus_pipeline.run(spark, DIRECTORY).count() > 0
