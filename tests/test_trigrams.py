"""Searches by an index against scans of all texts."""

import random

import pytest
from pyspark.sql import functions as F

from breachlens.operators import trigrams
from breachlens.operators.filters import contains_text
from breachlens.plans import details
from tests.small import make, random_rows

TEXTS = [
    None, "", "ab", "abc", "ABC", "a%c", "a_c", "back\\slash", "100% sure", "under_score", "İstanbul Ğ", "straße", "ΟΔΟΣ ΟΔΟΣΗ",
    "two\nlines abc", "x" * 1000, "%", "\\", "日本語のテキスト",
]
PATTERNS = [
    "", "a", "ab", "abc", "bc", "A%C", "a_c", "a\\_c", "100\\%", "%", "_", "___", "\\", "k\\s", "İstan", "istan", "SSE", "οδος", "ΟΔΟΣ",
    "es abc", "lin%abc", "xxxx", "本語の", "語_テ", "no such", "er_sc", "abc%abc",
]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("abC %_") for _ in range(r.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, name STRING").repartition(3)
    return df, trigrams.write_index(df, str(tmp_path_factory.mktemp("grams")), "id", "name")


def test_patterns_match_as_in_a_scan(spark, indexed):
    df, index = indexed
    r = random.Random(4)
    patterns = PATTERNS + ["".join(r.choice("abc %_") for _ in range(r.randint(1, 6))) for _ in range(15)]
    for pattern in patterns:
        want = sorted(x.id for x in df.filter(contains_text("name", pattern)).collect())
        assert sorted(x.id for x in index.matching(df, "name", pattern).collect()) == want, pattern


def test_only_texts_with_all_groups_are_read(spark, indexed):
    df, index = indexed
    assert index.having(["ab"]) is None and index.having([]) is None
    found = {x.id for x in index.having(["ABC", "slash"]).collect()}
    assert found == set()
    assert {x.id for x in index.having(["100% s"]).collect()} == {TEXTS.index("100% sure")}
    text = index.matching(df, "name", "a%100_sure").explain
    plan = index.having(["sure"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan and callable(text)


def test_stretches_of_patterns():
    assert trigrams.pattern_stretches("ab%c_d") == ["ab", "c", "d"]
    assert trigrams.pattern_stretches("a\\%b\\c\\\\") == ["a%b\\c\\"]
    assert trigrams.pattern_stretches("%_") == []


def test_detail_search_with_an_index(spark, tmp_path):
    rows = random_rows(6)
    tables = make(spark, rows, natural=True)
    index = details.write_search_index(tables, str(tmp_path / "i"))
    for term in ("a", "web", "kritik", "10.0.0", "name", "zzz", "", "7."):
        plain, found = (details.detail_search(tables, term, **k).collect() for k in ({}, {"index": index}))
        assert sorted(map(str, plain)) == sorted(map(str, found)), term


def test_several_columns_do_not_run_together(spark, tmp_path):
    df = spark.createDataFrame([(1, "ab", "cd"), (1, "xyz", None), (2, None, None)], "id INT, a STRING, b STRING")
    index = trigrams.write_index(df, str(tmp_path / "i"), "id", "a", "b")
    assert sorted(r.gram for r in index.postings.collect()) == ["xyz"]
    assert [r.id for r in index.search(df, ["xyz"], F.col("a") == "xyz").collect()] == [1]
