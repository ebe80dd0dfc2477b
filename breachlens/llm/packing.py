"""Operator 4: packing by concatenation and cutting.

First pass: texts become ids, each followed by an end id, and every row gets its offset
within its partition. The partition totals, one number each, are turned into global offsets
by a prefix sum. Second pass: a row's global offset tells which fixed windows it touches, and
each touched window becomes a boundary record, a piece.

Only the last sequence can be shorter than the window, so there is hardly any padding.

Defined cases: a null or empty text is its end id alone; repeated rows are packed each; an
empty table has no pieces; a text longer than a window is cut over several sequences; columns
besides the id and the text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breachlens.llm.common import arrow_schema, as_batch, map_batches, staged
from breachlens.llm.vocab import (
    WORD_BPE, ChunkMemo, WordEncoder, in_worker, public_path, read, slices, special_tokens,
)

#: Up to so many partitions their totals (16 bytes each) are broadcast; beyond, joined.
BROADCAST_PARTITIONS = 1_000_000


def tokenized(docs: DataFrame, id_col: str, text_col: str, end_id: int, path: str | None) -> DataFrame:
    """(id, part, start, n, ids): ids as little-endian 32-bit numbers, the end id included;
    start counts the ids before the row in its partition."""
    shared = docs.sparkSession.sparkContext.broadcast(read(path or public_path(WORD_BPE)))
    id_type = docs.schema[id_col].dataType.simpleString()
    ddl = f"{id_col} {id_type}, part int, start bigint, n bigint, ids binary"
    schema = arrow_schema(ddl)

    def make():
        def learned() -> ChunkMemo:
            words = WordEncoder(shared.value)

            def encode(missing: list[str]) -> list[bytes]:
                return [np.array(ids, dtype="<u4").tobytes() for ids in words(missing)]

            return ChunkMemo(encode, bytes.__add__, special_tokens(words.library))

        memo = in_worker(f"packing {zlib.crc32(shared.value)}", learned)
        end = np.array([end_id], dtype="<u4").tobytes()
        part, total = TaskContext.get().partitionId(), 0

        def step(batch: pa.RecordBatch):
            nonlocal total
            texts = batch.column(1).to_pylist()
            for start, stop in slices(texts):
                ids = [b"".join(parts) + end for parts in memo.lists(texts[start:stop])]
                sizes = np.fromiter((len(i) // 4 for i in ids), dtype=np.int64, count=len(ids))
                yield as_batch({
                    id_col: batch.column(0).slice(start, stop - start),
                    "part": pa.array(np.full(len(ids), part, dtype=np.int32)),
                    "start": pa.array(total + np.cumsum(sizes) - sizes),
                    "n": pa.array(sizes), "ids": ids,
                }, schema)
                total += int(sizes.sum())

        return step

    return map_batches(docs.select(id_col, F.col(text_col).cast("string")), make, ddl)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1,
    path: str | None = None,
) -> DataFrame:
    """One row per piece: (id, start, length, ids, doc_tokens, sequence_id, offset).

    The ids are staged once in the shared folder, so both passes see the same partitions.
    """
    rows = staged(docs.sparkSession, tokenized(docs, id_col, text_col, end_id, path), "packing")
    totals = rows.groupBy("part").agg(F.sum("n").alias("__total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    if rows.inputFiles() and len(rows.inputFiles()) <= BROADCAST_PARTITIONS:
        bases = F.broadcast(bases)  # at most one row for each file of the first pass
    at = F.col("__base") + F.col("start")
    first, last = F.floor(at / window), F.floor((at + F.col("n") - 1) / window)

    def piece(w):
        begin = F.greatest(w * window, F.col("at"))
        stop = F.least((w + 1) * window, F.col("at") + F.col("n"))
        start, length = begin - F.col("at"), stop - begin
        return F.struct(
            start.alias("start"), length.alias("length"),
            F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int")).alias("ids"),
            w.alias("sequence_id"), (begin - w * window).alias("offset"),
        )

    located = rows.join(bases, "part").select(
        id_col, "n", "ids", at.alias("at"),
        first.cast("long").alias("first"), last.cast("long").alias("last"),
    )
    pieces = located.select(
        id_col, F.col("n").alias("doc_tokens"),
        F.explode(F.transform(F.sequence("first", "last"), piece)).alias("p"),
    )
    return pieces.select(
        id_col, "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset",
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the pieces of each sequence joined; a sequence is at most a window."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))
