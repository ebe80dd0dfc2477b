from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from breachlens.llm import clustering
from breachlens.llm.common import discard, staged


def plain(rows, k, rounds, scale, dims, seed="2"):
    """Lloyd's rounds in whole numbers, all pairs measured."""
    kept = [
        (i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    drawn = sorted((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in drawn[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        owners = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), o in zip(kept, owners) if o == j]
            if own:
                centroids[j] = [sum(column) // len(own) for column in zip(*own)]
    last = [nearest(v) for _, v in kept]
    whole = sum(d for d, _ in last)
    return sorted(
        (-1 if i is None else i, j, d, sum(e for e, o in last if o == j), whole,
         hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
        for (i, _), (d, j) in zip(kept, last)
    )


def found(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.collect())


def frame(spark, rows):
    clash = [(*r, "o", 1, "x", 2) for r in rows]
    return spark.createDataFrame(
        clash, "vec_id bigint, embedding array<float>, own string, cluster int, ids string, v int"
    ).repartition(3)


def vectors(n, dims, seed=1):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(6, dims))
    return [(i, (middles[i % 6] + 0.2 * r.normal(size=dims)).astype(np.float32).tolist()) for i in range(n)]


def test_equals_measuring_all_pairs(spark):
    rows = vectors(300, 5)
    awkward = [
        (None, rows[0][1]), (7, rows[7][1]), (8, rows[9][1]), (9, rows[9][1]), (1000, None), (1001, []), (1002, [1.0] * 4),
        (1003, [1.0, 2.0, None, 0.0, 1.0]), (1004, [float("nan")] * 5), (1005, [float("inf")] + [0.0] * 4), (1006, [0.0] * 5),
    ]
    for k, rounds in ((7, 5), (40, 3), (1, 2)):
        got = clustering.cluster(frame(spark, rows + awkward), k=k, rounds=rounds, scale=16, dims=5)
        assert found(got) == plain(rows + awkward, k, rounds, 16, 5)


def test_many_equal_vectors_are_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(i, [0.0, 1.0]) for i in range(40, 80)]
    got = clustering.cluster(frame(spark, rows), k=6, rounds=4, scale=4, dims=2)
    assert found(got) == plain(rows, 6, 4, 4, 2)


def test_few_vectors_and_none(spark):
    rows = vectors(3, 4)
    assert found(clustering.cluster(frame(spark, rows), k=10, rounds=2, scale=8, dims=4)) == plain(rows, 10, 2, 8, 4)
    empty = clustering.cluster(frame(spark, rows).limit(0), k=10, dims=4)
    assert empty.collect() == [] and empty.columns[0] == "vec_id"


def test_large_components(spark):
    rows = [(i, [float(2 ** 21 + 1000 * i), float(-(2 ** 22) * (i % 3))]) for i in range(30)]
    got = clustering.cluster(frame(spark, rows), k=4, rounds=3, scale=16, dims=2)
    assert found(got) == plain(rows, 4, 3, 16, 2)
    with pytest.raises(PySparkException, match="too large"):
        clustering.cluster(frame(spark, [(1, [1e30, 0.0])]), k=1, dims=2)


def test_bounds_hold_and_save_work():
    """Bounds loosened by total displacements never exclude a nearer centroid, and spare pairs."""
    r = np.random.default_rng(3)
    middles = r.integers(-900, 900, (12, 8))
    x = (middles[r.integers(0, 12, 4000)] + r.integers(-60, 60, (4000, 8))).astype(np.int32)
    history = [x[:12].astype(np.int64)]
    bounds, measured = clustering.Bounds.start(x, history[0]), 0
    for _ in range(8):
        counts, sums = bounds.sums(12)
        history.append(np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], history[-1]))
        moved = clustering.displacements(history)
        measured += bounds.assign(history, moved)
        d = clustering.squared_all(x, history[-1])
        assert (bounds.own == d.argmin(axis=1)).all()
        true = np.sqrt(d)
        assert (bounds.lower - moved[bounds.measured, np.arange(12)] <= true + 1e-6).all()
        assert (bounds.upper + moved[bounds.measured_upper, bounds.own] >= true[np.arange(4000), bounds.own] - 1e-6).all()
    assert measured < 0.5 * 8 * x.shape[0] * 12


def test_discarded_folders_are_gone(spark):
    df = staged(spark, spark.range(3).toDF("a"), "gone")
    discard(spark, df)
    with pytest.raises(PySparkException):
        spark.read.parquet(df.inputFiles()[0].rpartition("/")[0]).count()
