"""Stored pages against a sorted list."""

import random

import pytest

from breachlens.plans.pages import store_pages


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    return [(r.choice([None, 1, 2, 3]), r.choice("abc"), i % 7) for i in range(500)]


def ordered(rows):
    """By a descending (NULL last) and then the rest ascending."""
    return sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), x[1], x[2]))


def test_pages_are_those_of_the_sorted_rows(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "a INT, b STRING, c INT").repartition(5)
    pages, want = store_pages(df, str(tmp_path / "p"), [("a", False)]), ordered(rows)
    assert pages.count() == 500
    for size in (50, 33, 501):
        got = [[tuple(r)[:3] for r in pages.page(n, size).collect()] for n in range(-(-500 // size) + 1)]
        assert [x for page in got for x in page] == want
        assert all(len(page) == size for page in got[:500 // size]) and got[-1] == []
    last, walked = None, []
    while page := pages.after(last, 60).collect():
        walked += [tuple(r)[:3] for r in page]
        last = page[-1].row
    assert walked == want
    with pytest.raises(ValueError, match="page"):
        pages.page(-1)


def test_a_page_opens_few_row_groups(spark, tmp_path):
    df = spark.range(20_000).selectExpr("id", "id % 10 AS digit").repartition(4)
    pages = store_pages(df, str(tmp_path / "p"), [("id", True)])
    page = pages.page(300, 50)
    text = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(row" in text and "LessThanOrEqual(row" in text and "Window" not in text
    assert [r.id for r in page.collect()] == list(range(15_000, 15_050))


def test_few_rows_none_and_a_clashing_name(spark, tmp_path):
    empty = store_pages(spark.createDataFrame([], "a INT"), str(tmp_path / "e"))
    assert empty.count() == 0 and empty.page(0).collect() == [] and empty.after(None).collect() == []
    same = store_pages(spark.createDataFrame([(1,)] * 7, "a INT"), str(tmp_path / "s"))
    assert [len(same.page(n, 3).collect()) for n in range(4)] == [3, 3, 1, 0]
    with pytest.raises(ValueError, match="row"):
        store_pages(spark.createDataFrame([(1,)], "row INT"), str(tmp_path / "c"))
    with pytest.raises(ValueError, match="nothing"):
        store_pages(spark.createDataFrame([(1,)], "a INT"), str(tmp_path / "d"), [("nothing", True)])
