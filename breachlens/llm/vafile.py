"""Operator 3: exact top-k search by vector-approximation files.

Components are integers, floor(scale * x). A sample gives each dimension its cell borders; every
row is then stored as one byte per dimension, its cells, beside its exact components, in blocks
of about BLOCK rows. A block knows the least and largest component in each of its cells, so a
row's cells bound its inner product with any query from both sides.

1. Queries, in blocks too, meet the cells of every block. The k largest lower bounds of a query
   over all blocks give a threshold that its kth result cannot fall below.
   Blocks meet where they are read: few queries are broadcast, many are read by each task that needs
   them. Neither side is copied into a shuffle or a broadcast once for each block of the other.
2. Rows whose upper bound reaches the threshold are looked at exactly, in falling order of upper
   bounds, until the kth score so far is above the next bound.

The sample of SAMPLE rows only sets the borders; every row is indexed, and results are exact.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do
rows without an id; missing components of shorter vectors count as 0; a component above 2^28 in size
raises an error, and so do vectors of so many or so large components that a score might not fit a
long; rows of an id that is repeated are all candidates of other ids, and the least of its vectors is the query's; ties go to the smaller id; an empty table
gives no rows; columns besides the id and the vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breachlens.llm.common import arrow_schema, as_batch, staged

BLOCK, QUERIES = 8192, 8192
#: Queries of a block whose bounds are held at once.
STEP = 512
SAMPLE, CELLS = 10_000, 32
LIMIT = 1 << 28


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): valid vectors as integers."""
    whole = F.transform(vector_col, lambda x: F.floor(F.when(
        F.abs(x.cast("double") * scale) <= F.lit(float(LIMIT)), x.cast("double") * scale
    ).otherwise(F.raise_error(F.lit("a component is too large for exact scores")).cast("double"))).cast("int"))
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(
        F.col(id_col).cast("long").alias("id"), whole.alias("v")
    )


def borders(rows: DataFrame, dims: int) -> np.ndarray:
    """Cell borders of each dimension: quantiles over a sample. It is written first, as the driver
    would else get the first SAMPLE rows of every task."""
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v")
    sample = staged(rows.sparkSession, chosen, "va-sample").toPandas()["v"]
    values = np.zeros((len(sample), dims))
    for i, v in enumerate(sample):
        values[i, :len(v)] = v
    if not len(values):
        return np.zeros((dims, CELLS - 1))
    return np.quantile(values, np.arange(1, CELLS) / CELLS, axis=0).T.copy()


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """A list array as a matrix, filled up with 0."""
    lengths = np.asarray(vectors.value_lengths(), dtype=np.int64)
    out = np.zeros((len(lengths), dims), dtype=np.int32)
    out[np.arange(dims) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(rows: DataFrame, block: str, dims: int, extra: list[str]) -> DataFrame:
    """(block, ids, exact, ...): the rows of each block as one row of binary columns."""
    ddl = ", ".join([f"{block} int", "ids binary", "exact binary", *(f"{c} binary" for c in extra)])
    schema = arrow_schema(ddl)

    def task(batches):
        held: dict[int, list] = {}

        def emit(number):
            parts = list(zip(*held.pop(number)))
            return as_batch({
                block: [number], "ids": [np.concatenate(parts[0]).tobytes()],
                "exact": [np.concatenate(parts[1]).tobytes()],
                **{c: [np.concatenate(p).tobytes()] for c, p in zip(extra, parts[2:])},
            }, schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column(0).to_numpy()
            ids, exact = batch.column(1).to_numpy(), _matrix(batch.column(2), dims)
            more = [batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(len(extra))]
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                number = int(numbers[a])
                for done in [n for n in held if n != number]:
                    yield emit(done)
                held.setdefault(number, []).append((ids[a:b], exact[a:b], *(m[a:b] for m in more)))
        for done in list(held):
            yield emit(done)

    dealt = rows.select(block, "id", "v", *extra).repartition(block).sortWithinPartitions(block)
    return dealt.mapInArrow(task, ddl)


def _approximated(blocks: DataFrame, dims: int, edges: np.ndarray) -> DataFrame:
    """With each row's cells, and the least and largest component of the block in each cell."""
    ddl = "block int, ids binary, exact binary, cells binary, low binary, high binary"
    schema = arrow_schema(ddl)

    def task(batches):
        for batch in batches:
            for number, ids, exact in zip(*(batch.column(i) for i in range(3))):
                values = np.frombuffer(exact.as_py(), dtype=np.int32).reshape(-1, dims)
                cells = np.empty(values.shape, dtype=np.uint8)
                low = np.full((dims, CELLS), LIMIT, dtype=np.int32)
                high = -low
                for d in range(dims):
                    cells[:, d] = np.searchsorted(edges[d], values[:, d], side="right")
                    np.minimum.at(low[d], cells[:, d], values[:, d])
                    np.maximum.at(high[d], cells[:, d], values[:, d])
                yield as_batch({
                    "block": [number.as_py()], "ids": [ids.as_py()], "exact": [exact.as_py()],
                    "cells": [cells.tobytes()], "low": [low.tobytes()], "high": [high.tobytes()],
                }, schema)

    return blocks.select("block", "ids", "exact").mapInArrow(task, ddl)


def _spans(cells: bytes, low: bytes, high: bytes, dims: int):
    """Middles and half widths of the rows' cells, a column for each row, and the largest size of a
    component. Halves of whole numbers are exact."""
    codes = np.frombuffer(cells, dtype=np.uint8).reshape(-1, dims)
    every = np.arange(dims)
    lo = np.frombuffer(low, dtype=np.int32).reshape(dims, CELLS)[every, codes].astype(np.float64)
    hi = np.frombuffer(high, dtype=np.int32).reshape(dims, CELLS)[every, codes].astype(np.float64)
    return ((lo + hi) / 2).T, ((hi - lo) / 2).T, max(np.abs(lo).max(initial=0), np.abs(hi).max(initial=0))


def _within(queries: np.ndarray, middles: np.ndarray, halves: np.ndarray, largest: float):
    """Lower and upper bounds of all inner products, with room for rounding."""
    sizes = np.abs(queries).astype(np.float64)
    at, reach = queries.astype(np.float64) @ middles, sizes @ halves
    reach += (sizes.sum(axis=1) * largest * 1e-13)[:, None]
    return at - reach, at + reach


def _bounds(queries: np.ndarray, cells: bytes, low: bytes, high: bytes, dims: int):
    return _within(queries, *_spans(cells, low, high, dims))


def _met(blocks: DataFrame, queries: DataFrame, columns: list[str]) -> DataFrame:
    """Each block of queries beside each block of rows: the stated queries against all rows.

    A product of the two, without a key: joined by their numbers, each block of queries would be
    broadcast, or each block of rows shuffled, as often as there are blocks of the other.
    """
    return blocks.select(*columns).crossJoin(queries.withColumnsRenamed({"ids": "qids", "exact": "qexact"}))


def _pairs(batches):
    """The rows of batches, one at a time, as buffers that are not copied."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_buffer() for c in batch.columns]


def search(
    vectors: DataFrame, is_query, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score): the k largest inner products of each query row with all
    other rows. `is_query` is a condition on the column `id`."""
    spark = vectors.sparkSession
    rows = staged(spark, quantised(vectors, id_col, vector_col, scale), "va-rows")
    total = rows.agg(
        F.count("*").alias("n"), F.countDistinct(F.when(is_query, F.col("id"))).alias("q"), F.max(F.size("v")).alias("d"),
        F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("largest"),
    ).first()
    if (total["d"] or 0) * (total["largest"] or 0) ** 2 >= 1 << 63:
        raise ValueError("a score of these vectors might not fit a long")
    dims, n_blocks, n_queries = total["d"] or 1, -(-total["n"] // BLOCK) or 1, -(-total["q"] // QUERIES) or 1
    edges = borders(rows, dims)
    numbered = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
    blocks = staged(spark, _approximated(_packed(numbered, "block", dims, []), dims, edges), "va-blocks")
    asked = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")).withColumn(
        "qblock", F.pmod(F.xxhash64("id"), F.lit(n_queries)).cast("int")
    )
    wanted = staged(spark, _packed(asked, "qblock", dims, []), "va-queries")

    first_ddl = "query_id bigint, bound double"
    first_schema = arrow_schema(first_ddl)

    def lower_bounds(batches):
        for ids, cells, low, high, qids, q in _pairs(batches):
            ids, qids = np.frombuffer(ids, dtype=np.int64), np.frombuffer(qids, dtype=np.int64)
            queries = np.frombuffer(q, dtype=np.int32).reshape(-1, dims)
            spans = _spans(cells, low, high, dims)
            for start in range(0, len(qids), STEP):
                some = qids[start:start + STEP]
                bound, _ = _within(queries[start:start + STEP].astype(np.int64), *spans)
                bound[some[:, None] == ids[None, :]] = -np.inf
                best = bound if len(ids) <= k else -np.partition(-bound, k - 1, axis=1)[:, :k]
                query = np.repeat(some, best.shape[1])
                flat = best.ravel()
                keep = np.isfinite(flat)
                yield as_batch({"query_id": pa.array(query[keep]), "bound": pa.array(flat[keep])}, first_schema)

    met = _met(blocks, wanted, ["ids", "cells", "low", "high"])
    bounds = met.select("ids", "cells", "low", "high", "qids", "qexact").mapInArrow(lower_bounds, first_ddl)
    of_query = Window.partitionBy("query_id")
    thresholds = bounds.withColumn("at", F.row_number().over(of_query.orderBy(F.desc("bound")))).where(
        F.col("at") <= k
    ).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("bound")).otherwise(float("-inf")).alias("threshold"))
    sharp = asked.join(thresholds, asked["id"] == thresholds["query_id"], "left").select(
        "qblock", "id", "v", F.coalesce("threshold", F.lit(float("-inf"))).alias("threshold")
    )
    wanted = staged(spark, _packed(sharp, "qblock", dims, ["threshold"]), "va-queries")

    ddl = "query_id bigint, id bigint, score bigint"
    schema = arrow_schema(ddl)

    def exact(batches):
        for ids, cells, low, high, rows_, qids, q, least in _pairs(batches):
            ids, qids = np.frombuffer(ids, dtype=np.int64), np.frombuffer(qids, dtype=np.int64)
            values = np.frombuffer(rows_, dtype=np.int32).reshape(-1, dims)
            every = np.frombuffer(q, dtype=np.int32).reshape(-1, dims)
            least = np.frombuffer(least, dtype=np.float64)
            spans = _spans(cells, low, high, dims)
            for start in range(0, len(qids), STEP):
                queries = every[start:start + STEP].astype(np.int64)
                _, upper = _within(queries, *spans)
                reach = upper >= least[start:start + STEP, None]
                out = []
                for i in np.flatnonzero(reach.any(axis=1)):
                    query, number = queries[i], qids[start + i]
                    near = np.flatnonzero(reach[i] & (ids != number))
                    near = near[np.argsort(-upper[i][near], kind="stable")]
                    scores, found = np.empty(0, np.int64), np.empty(0, np.int64)
                    for first in range(0, len(near), 128):
                        if len(scores) >= k and scores[k - 1] > upper[i][near[first]]:
                            break  # the kth result is certain
                        part = near[first:first + 128]
                        scores = np.concatenate([scores, values[part].astype(np.int64) @ query])
                        found = np.concatenate([found, ids[part]])
                        best = np.lexsort((found, -scores))[:k]
                        scores, found = scores[best], found[best]
                    out.append((np.full(len(found), number), found, scores))
                if out:
                    a, b, c = (np.concatenate(x) for x in zip(*out))
                    yield as_batch({"query_id": pa.array(a), "id": pa.array(b), "score": pa.array(c)}, schema)

    met = _met(blocks, wanted, ["ids", "cells", "low", "high", "exact"])
    scored = met.select("ids", "cells", "low", "high", "exact", "qids", "qexact", "threshold").mapInArrow(exact, ddl)
    best = of_query.orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score"
    )
