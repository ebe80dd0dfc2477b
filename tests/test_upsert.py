import random

import pytest

from breachlens.operators.checks import duplicate_keys, fk_orphans, key_collisions, pk_duplicates
from breachlens.operators.upsert import upsert, upsert_metrics, versioned_upsert
from tests.small import frame, make


def step_by_step(stored, feed):
    """The rule as it is stated: one fed row after another."""
    state = dict(stored)
    for key, order, version, value in sorted(feed, key=lambda r: r[1]):
        if key not in state or state[key][0] != version:
            state[key] = (version, value)
    return state


def test_versioned_upsert_equals_the_sequential_rule(spark):
    r = random.Random(5)
    versions = ["a", "b", None]
    stored = {k: (r.choice(versions), -1) for k in range(0, 700, 2)}
    feed = [
        (k, order, r.choice(versions), order)
        for order, k in enumerate(r.choices(range(100, 600), k=4000))
    ]
    old = frame(spark, [(k, *v) for k, v in stored.items()], "k BIGINT, version STRING, value BIGINT")
    new = frame(spark, feed, "k BIGINT, seq BIGINT, version STRING, value BIGINT")
    got = versioned_upsert(old, new, "k", "version", "seq", ["value"])
    assert {r.k: (r.version, r.value) for r in got.collect()} == step_by_step(stored, feed)
    # Once applied, the same feed's last versions change nothing.
    last = {k: v for k, _, v, _ in sorted(feed, key=lambda r: r[1])}
    again = frame(spark, [(k, 1, v, -9) for k, v in last.items()], "k BIGINT, seq BIGINT, version STRING, value BIGINT")
    twice = versioned_upsert(got, again, "k", "version", "seq", ["value"])
    assert sorted(twice.collect()) == sorted(got.select(*twice.columns).collect())


@pytest.mark.parametrize("stored, fed, want", [
    (("A", 0), ["B", "A"], ("A", 2)),
    (("A", 0), [None, "A"], ("A", 2)),
    (("A", 0), ["A", "A"], ("A", 0)),
    ((None, 0), [None], (None, 0)),
    (None, ["A", "A"], ("A", 1)),
    (("A", 0), [], ("A", 0)),
])
def test_versioned_upsert_cases(spark, stored, fed, want):
    old = frame(spark, [(1, *stored)] if stored else [], "k BIGINT, version STRING, value BIGINT")
    rows = [(1, i, v, i) for i, v in enumerate(fed, 1)]
    new = frame(spark, rows, "k BIGINT, seq BIGINT, version STRING, value BIGINT")
    got = versioned_upsert(old, new, "k", "version", "seq", ["value"]).collect()
    assert [(r.version, r.value) for r in got] == [want]


def test_upsert(spark):
    schema = "k BIGINT, a STRING, b STRING"
    old = frame(spark, [(1, "x", None), (2, "x", "y"), (3, None, "z")], schema)
    new = frame(spark, [(2, "x", "y"), (3, None, None), (4, "n", "n")], schema)
    got = upsert(old, new, "k", ["a", "b"])
    want = [(1, "x", None), (2, "x", "y"), (3, None, None), (4, "n", "n")]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    counts = {r.status: r.n for r in upsert_metrics(old, new, "k", ["a", "b"]).collect()}
    assert counts == {"inserted": 1, "changed": 1, "same": 1}
    twice = upsert(got, new, "k", ["a", "b"])
    assert sorted(map(tuple, twice.collect()), key=lambda r: r[0]) == want
    assert {r.status for r in upsert_metrics(got, new, "k", ["a", "b"]).collect()} == {"same"}


def test_checks(spark):
    tables = make(spark, {
        "folder": [(1, "t", "f"), (1, "t", "g")], "scan": [(1, 1, "t", "s"), (2, 7, "t", "s"), (3, None, "t", "s")],
        "scan_run": [(10, 1, 0, 0), (11, 9, 0, 0)], "host": [(5, 10, 1, "a", None), (6, 99, 1, "b", None)],
        "host_vuln": [(1, 5, 10, 4), (2, 8, 10, 4), (3, 5, 10, 44)], "plugin": [(4,) + (None,) * 10],
        "vuln_output": [(1, "80"), (77, "80"), (77, None)],
    })
    found = {(r.constraint_name, r.key_value, r.n) for r in fk_orphans(tables).collect()}
    assert found == {
        ("scan_folder", "7", 1), ("scan_run_scan", "9", 1), ("host_scan_run", "99", 1),
        ("host_vuln_host", "8", 1), ("host_vuln_plugin", "44", 1), ("vuln_output_host_vuln", "77", 2),
    }
    assert [(r.folder_id, r.n) for r in duplicate_keys(tables.folder, ["folder_id"]).collect()] == [(1, 2)]
    natural = make(spark, {
        "folder": [(1, "t", "f"), (1, "t", "g")], "host_vuln": [(1, 5, 10, 4)], "vuln_output": [(1, "80")],
    }, natural=True)
    counts = {r.table_name: (r.n_rows, r.n_keys, r.n_duplicate_keys) for r in pk_duplicates(natural).collect()}
    assert counts["folder"] == (2, 1, 1) and counts["host_vuln"] == (1, 1, 0) and counts["scan"] == (0, 0, 0)
    ids = frame(spark, [(1, 1, 1), (1, 1, 1), (2, 1, 2), (2, 1, 3)], "id BIGINT, a BIGINT, b BIGINT")
    assert [(r.id, r.n_keys) for r in key_collisions(ids, "id", ["a", "b"]).collect()] == [(2, 2)]
