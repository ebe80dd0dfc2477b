"""Operator 13: centroid clustering with ns-bounds.

Every vector keeps an upper bound of the distance to its own centroid and a lower bound of the
distance to every other one, each with the round in which it was measured. Centroids of all
rounds are kept, so a bound is loosened by the norm of its centroid's total displacement since
that round, which is never more than the sum of the drifts in between. Only pairs of vector and
centroid whose loosened bounds overlap are measured again, exactly.

Vectors are kept in blocks of BLOCK, with their bounds: one pass over the blocks is one round. A
block carries its sums per centroid, so that a round's new centroids are sums over blocks. The
blocks of the round before are deleted once the next ones are written.

Components are integers, and so are squared distances; bounds are floating-point numbers that are
rounded to the safe side. The result is that of measuring all pairs in all rounds.

Defined cases: vectors that are null, of another number of components, or that hold a null or
non-finite component take no part; a component beyond LARGEST after scaling raises an error, as
squared distances would not fit a long; a null id is kept, and is written as empty text where the
first centroids are drawn; repeated rows are vectors of their own, also as first centroids; equal
hashes are ordered by components; with fewer vectors than centroids there are fewer centroids; an
empty table gives no rows; columns besides the id and the vector are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachlens.llm.common import arrow_schema, as_batch, discard, staged

#: Vectors of a block.
BLOCK = 1024
#: Components after scaling: 2 * LARGEST squared, times 64 components, is below 2^63.
LARGEST = 1 << 27
#: Products of components up to this size add up exactly as floating-point numbers.
EXACT = 1 << 22
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12

_STATE = "ids array<bigint>, x binary, own binary, upper binary, measured_upper binary, lower binary, measured binary, "
_SUMS = "counts array<bigint>, sums array<bigint>"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int, dims: int) -> DataFrame:
    """(id, v): the vectors that take part, as integers."""
    whole = F.transform(vector_col, lambda x: F.floor(F.when(
        F.abs(x.cast("double") * scale) <= LARGEST, x.cast("double") * scale
    ).otherwise(F.raise_error(F.lit("a component is too large to be clustered exactly")).cast("double"))).cast("int"))
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    fit = F.col(vector_col).isNotNull() & (F.size(vector_col) == dims) & F.coalesce(finite, F.lit(False))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fit, whole).alias("v")).where("v is not null")


def first_centroids(rows: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose hashes are the smallest."""
    written = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    drawn = rows.select(F.sha2(written, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in drawn], dtype=np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to one centroid."""
    apart = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", apart, apart)


def squared_all(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        both = np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ c.T) + np.einsum("ij,ij->i", c, c)
        return both.astype(np.int64)
    return np.stack([squared(x, c) for c in centroids], axis=1)


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """[round, centroid]: how far a centroid now is from where it was in a round, rounded up."""
    now = history[-1]
    return np.stack([np.sqrt(np.stack([squared(now[j:j + 1], c)[0] for j, c in enumerate(old)])) * _UP for old in history])


def _rounded_down(squares: np.ndarray) -> np.ndarray:
    return np.nextafter((np.sqrt(squares) * _DOWN).astype(np.float32), np.float32(0))


class Bounds:
    """What a block knows: own centroids, and bounds with the rounds they were measured in."""

    def __init__(self, x, own, upper, measured_upper, lower, measured):
        self.x, self.own, self.upper, self.measured_upper = x, own, upper, measured_upper
        self.lower, self.measured = lower, measured

    @classmethod
    def start(cls, x: np.ndarray, centroids: np.ndarray) -> "Bounds":
        """All pairs, measured in round 0."""
        d = squared_all(x, centroids)
        own = d.argmin(axis=1).astype(np.int32)
        n = len(x)
        upper = np.sqrt(d[np.arange(n), own]) * _UP
        return cls(x, own, upper, np.zeros(n, np.int32), _rounded_down(d), np.zeros(d.shape, np.int32))

    def assign(self, history: list[np.ndarray], moved: np.ndarray) -> int:
        """Own centroids of the present round. Returns how many pairs were measured."""
        now, centroids = len(history) - 1, history[-1]
        n, k = self.lower.shape
        rows, every = np.arange(n), np.arange(k)
        lower = self.lower.astype(np.float64) * _DOWN - moved[self.measured, every]
        lower[rows, self.own] = np.inf
        upper = self.upper + moved[self.measured_upper, self.own]
        doubtful = np.flatnonzero((lower <= upper[:, None]).any(axis=1))
        if not len(doubtful):
            return 0
        # The own distance first: the bound it gives settles most rows.
        own, x = self.own[doubtful], self.x[doubtful]
        apart = x.astype(np.int64) - centroids[own]
        best = np.einsum("ij,ij->i", apart, apart)
        self.upper[doubtful], self.measured_upper[doubtful] = np.sqrt(best) * _UP, now
        self.lower[doubtful, own], self.measured[doubtful, own] = _rounded_down(best), now
        open_pairs = lower[doubtful] <= self.upper[doubtful][:, None]
        nearest = own.copy()
        for j in np.flatnonzero(open_pairs.any(axis=0)):
            at = np.flatnonzero(open_pairs[:, j])
            d = squared(x[at], centroids[j])
            self.lower[doubtful[at], j], self.measured[doubtful[at], j] = _rounded_down(d), now
            closer = (d < best[at]) | ((d == best[at]) & (j < nearest[at]))
            best[at[closer]], nearest[at[closer]] = d[closer], j
        self.own[doubtful] = nearest
        self.upper[doubtful] = np.sqrt(best) * _UP
        return len(doubtful) + int(open_pairs.sum())

    def own_squared(self, centroids: np.ndarray) -> np.ndarray:
        apart = self.x.astype(np.int64) - centroids[self.own]
        return np.einsum("ij,ij->i", apart, apart)

    def sums(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        totals = np.zeros((k, self.x.shape[1]), np.int64)
        order = np.argsort(self.own, kind="stable")
        owned, starts = np.unique(self.own[order], return_index=True)
        if len(owned):
            totals[owned] = np.add.reduceat(self.x[order].astype(np.int64), starts, axis=0)
        return np.bincount(self.own, minlength=k), totals

    def columns(self, ids: pa.Array, k: int) -> dict:
        counts, totals = self.sums(k)
        return {
            "ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "x": [self.x.tobytes()], "own": [self.own.tobytes()],
            "upper": [self.upper.tobytes()], "measured_upper": [self.measured_upper.tobytes()],
            "lower": [self.lower.tobytes()], "measured": [self.measured.astype(np.uint16).tobytes()],
            "counts": [counts.tolist()], "sums": [totals.ravel().tolist()],
        }

    @classmethod
    def read(cls, batch: pa.RecordBatch, i: int, k: int, dims: int) -> "Bounds":
        def column(name, kind):
            return np.frombuffer(batch.column(name)[i].as_py(), dtype=kind)

        return cls(
            column("x", np.int32).reshape(-1, dims), column("own", np.int32).copy(), column("upper", np.float64).copy(),
            column("measured_upper", np.int32).copy(), column("lower", np.float32).reshape(-1, k).copy(),
            column("measured", np.uint16).reshape(-1, k).astype(np.int32),
        )


def _started(rows: DataFrame, centroids: np.ndarray, dims: int) -> DataFrame:
    """The first round: blocks of vectors, as they lie in the partitions."""
    schema, k = arrow_schema(_STATE + _SUMS), len(centroids)

    def task(batches):
        ids, held, n = [], [], 0

        def emit():
            x = np.concatenate(held)
            return as_batch(Bounds.start(x, centroids).columns(pa.concat_arrays(ids), k), schema)

        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                ids.append(part.column(0))
                held.append(part.column(1).flatten().to_numpy().reshape(-1, dims).astype(np.int32))
                n += part.num_rows
                if n >= BLOCK:
                    yield emit()
                    ids, held, n = [], [], 0
        if n:
            yield emit()

    return rows.select("id", "v").mapInArrow(task, _STATE + _SUMS)


def _next_round(blocks: DataFrame, history: list[np.ndarray]) -> DataFrame:
    schema, moved = arrow_schema(_STATE + _SUMS), displacements(history)
    k, dims = history[-1].shape

    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                bounds = Bounds.read(batch, i, k, dims)
                bounds.assign(history, moved)
                yield as_batch(bounds.columns(batch.column("ids")[i].values, k), schema)

    return blocks.select(*[c.split()[0] for c in _STATE.rstrip(", ").split(", ")]).mapInArrow(task, _STATE + _SUMS)


def _assigned(blocks: DataFrame, history: list[np.ndarray]) -> DataFrame:
    """The last assignment: blocks of (id, cluster, distance)."""
    ddl = "ids array<bigint>, cluster array<int>, distance array<bigint>"
    schema, moved = arrow_schema(ddl), displacements(history)
    k, dims = history[-1].shape

    def task(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                bounds = Bounds.read(batch, i, k, dims)
                bounds.assign(history, moved)
                yield as_batch({
                    "ids": pa.array([batch.column("ids")[i].values.to_pylist()], pa.list_(pa.int64())),
                    "cluster": [bounds.own.tolist()], "distance": [bounds.own_squared(history[-1]).tolist()],
                }, schema)

    return blocks.drop("counts", "sums").mapInArrow(task, ddl)


def _moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The new centroids: floors of the exact means; centroids without vectors stay. Totals are
    decimals, which no number of vectors overflows; there are as many as components of centroids."""
    k, dims = centroids.shape

    def total(column: str):
        parts = blocks.select(F.posexplode(column).alias("at", "part"))
        return parts.groupBy("at").agg(F.sum(F.col("part").cast("decimal(19,0)")).alias("total"))

    counts = {r["at"]: int(r["total"]) for r in total("counts").collect()}
    new = centroids.copy()
    for r in total("sums").collect():
        j, d = divmod(r["at"], dims)
        if counts.get(j):
            new[j, d] = int(r["total"]) // counts[j]
    return new


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64, seed: str = "2",
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector that
    takes part, after `rounds` rounds of assignment and means, and one more assignment."""
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vector_col, scale, dims)
    history = [first_centroids(rows, k, seed)]
    if not len(history[0]):
        return spark.createDataFrame(
            [], f"{id_col} bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
        )
    blocks = staged(spark, _started(rows, history[0], dims), "clustering")
    for _ in range(rounds - 1):
        history.append(_moved(blocks, history[-1]))
        before, blocks = blocks, staged(spark, _next_round(blocks, history), "clustering")
        discard(spark, before)
    history.append(_moved(blocks, history[-1]))
    last = staged(spark, _assigned(blocks, history), "clustered")
    discard(spark, blocks)

    found = last.select(F.inline(F.arrays_zip("ids", "cluster", "distance"))).withColumnRenamed("ids", id_col)
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()
    known = {r["cluster"]: int(r["inertia"]) for r in inertia}
    whole = sum(known.values())
    described = spark.createDataFrame([
        (j, known[j], whole, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest())
        for j, c in enumerate(history[-1]) if j in known
    ], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(described), "cluster").select(
        id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
