"""Operator 9: removal of repeated passages by suffix sorting.

Every byte that is covered by a passage of `length` bytes which starts twice or more anywhere,
in one document or several, is removed. Passages are judged on the input.

1. Windows of `length` bytes are grouped by their anchors (see `anchors`): runs of windows with
   one anchor form a stretch, and only stretches whose anchor hash occurs again matter.
2. Equal stretches are counted as one. All windows of a stretch that occurs twice are repeated.
3. Different stretches of one anchor hash are brought together with their bytes, their suffixes
   are sorted in two stages (see `suffixes`), and neighbours with a common prefix of `length`
   mark repeated windows. Anchors with more than `GROUP` different stretches are dealt out by
   the hashes of the windows instead, so that no task holds an unbounded group.
4. Marked windows go back to every occurrence of their stretch, and to the documents.

Passages of `words` words are found the same way, if asked for instead: each word is put as the 8 bytes
of its hash, and the passages searched for are then 8 * words bytes long. White space between
words does not count. A window that begins within a word's hash adds no passage: it holds words - 1
whole words, and of the two at its ends 8 bytes together, which only agree if one of them does.

Stretches are held for equal by 64-bit hashes of their bytes beside the 64-bit hash of their
anchor.

Defined cases: a null or empty text has 0 bytes and nothing to remove; a document below
`length` bytes keeps all; of equal documents no copy keeps a repeated byte; repeated rows are
documents of their own; columns besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breachlens.llm.anchors import anchored
from breachlens.llm.common import Memo, arrow_schema, as_batch, bloom_joins, map_batches, staged
from breachlens.llm.suffixes import repeated_starts

#: So many different stretches of an anchor are sorted in one task at most.
GROUP = 3000
#: Bytes looked at together, and bytes of a segment of a long document.
BUFFER, SEGMENT = 2_000_000, 8_000_000
STRETCH = np.dtype([("start", "<i4"), ("windows", "<i4"), ("anchor", "<i8"), ("content", "<i8")])


def content_hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def lettering():
    """A function that puts each word of a text as the 8 bytes of its hash."""
    hashes = Memo(content_hash)

    def letters(text: bytes) -> bytes:
        words = text.split()
        return np.fromiter(map(hashes.__getitem__, words), dtype="<i8", count=len(words)).tobytes()

    return letters


def of_words(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The bytes of the words whose 8 bytes the runs cover whole."""
    places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)] if runs else []
    return [(places[-(-a // 8)][0], places[b // 8 - 1][1]) for a, b in runs]


def stretches(texts: list[bytes], length: int) -> list[np.ndarray]:
    """The stretches of each text. A text longer than SEGMENT is looked at in segments that
    overlap by length - 1 bytes, so that each window lies in just one."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    segments: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        nonlocal segments, size
        raw = b"".join([s[2] for s in segments])
        if len(raw) >= length:
            anchor, at, _ = anchored(np.frombuffer(raw, dtype=np.uint8), length)
            sizes = np.fromiter((len(s[2]) for s in segments), dtype=np.int64, count=len(segments))
            ends = np.cumsum(sizes)
            owner = np.repeat(np.arange(len(segments)), sizes)[:len(at)]
            starts = np.flatnonzero(np.arange(len(at)) + length <= ends[owner])
            if len(starts):
                new = np.ones(len(starts), dtype=bool)
                new[1:] = (at[starts][1:] != at[starts][:-1]) | (owner[starts][1:] != owner[starts][:-1])
                first = starts[new]
                last = np.append(starts[np.flatnonzero(new)[1:] - 1], starts[-1])
                out = np.empty(len(first), dtype=STRETCH)
                out["windows"], out["anchor"] = last - first + 1, anchor[first].view(np.int64)
                out["content"] = [content_hash(raw[a:b + length]) for a, b in zip(first.tolist(), last.tolist())]
                seg = owner[first]
                base = np.fromiter((s[1] for s in segments), dtype=np.int64, count=len(segments))
                out["start"] = first - (ends - sizes)[seg] + base[seg]
                cuts = np.searchsorted(seg, np.arange(len(segments) + 1))
                for k, s in enumerate(segments):
                    if cuts[k] < cuts[k + 1]:
                        found[s[0]].append(out[cuts[k]:cuts[k + 1]])
        segments, size = [], 0

    for i, text in enumerate(texts):
        for base in range(0, max(1, len(text)), SEGMENT):
            part = text[base:base + SEGMENT + length - 1]
            segments.append((i, base, part))
            size += len(part)
            if size >= BUFFER:
                flush()
    if segments:
        flush()
    return [np.concatenate(f) if f else np.empty(0, dtype=STRETCH) for f in found]


def _read_documents(docs: DataFrame, id_col: str, text_col: str, length: int, by_words: bool) -> DataFrame:
    """(rid, doc_id, n_bytes, full_sha, text, stretches) of each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"rid bigint, doc_id {kind}, n_bytes bigint, full_sha string, text binary, stretches binary"
    schema = arrow_schema(ddl)

    def make():
        import zstandard

        squeeze, letters = zstandard.ZstdCompressor(level=6), lettering()
        base, row = TaskContext.get().partitionId() << 33, 0

        def step(batch):
            nonlocal row
            texts = [t.as_py() for t in batch.column(1)]
            start = 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and size < BUFFER:
                    size += len(texts[stop] or "")
                    stop += 1
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[start:stop]]
                yield as_batch({
                    "rid": list(range(base + row, base + row + len(raw))),
                    "doc_id": batch.column(0).slice(start, stop - start), "n_bytes": [len(r) for r in raw],
                    "full_sha": [hashlib.sha256(r).hexdigest() for r in raw],
                    "text": [None if t is None else squeeze.compress(r) for t, r in zip(texts[start:stop], raw)],
                    "stretches": [s.tobytes() for s in stretches([letters(r) for r in raw] if by_words else raw, length)],
                }, schema)
                row += len(raw)
                start = stop

        return step

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")), make, ddl)


def _occurrences(read: DataFrame) -> DataFrame:
    """(rid, start, windows, anchor, content): a row per stretch."""
    ddl = "rid bigint, start int, windows int, anchor bigint, content bigint"
    schema = arrow_schema(ddl)

    def make():
        def step(batch):
            parts = [np.frombuffer(b.as_py(), dtype=STRETCH) for b in batch.column(1)]
            all_parts = np.concatenate(parts) if parts else np.empty(0, dtype=STRETCH)
            rids = np.repeat(batch.column(0).to_numpy(), [len(p) for p in parts])
            return as_batch({
                "rid": pa.array(rids), **{n: pa.array(np.ascontiguousarray(all_parts[n])) for n in STRETCH.names},
            }, schema)
        return step

    return map_batches(read.select("rid", "stretches"), make, ddl)


def _pieces(kinds: DataFrame, read: DataFrame, length: int, by_words: bool) -> DataFrame:
    """(anchor, part, content, first, windows, known, piece): the bytes of one stretch of each
    kind; of crowded anchors a row per window, whose part is the window's hash. Of the known
    ones, which occur twice, all windows are repeated; they are there for the others' sake."""
    wanted = kinds.where(F.col("different") > 1).groupBy("rid").agg(F.collect_list(
        F.struct(
            "start", "windows", "anchor", "content", (F.col("different") > GROUP).alias("crowded"),
            (F.col("c") > 1).alias("known"),
        )
    ).alias("wanted"))
    ddl = "anchor bigint, part bigint, content bigint, first int, windows int, known boolean, piece binary"
    schema = arrow_schema(ddl)

    def make():
        import zstandard

        expand, letters = zstandard.ZstdDecompressor(), lettering()

        def step(batch):
            for blob, wanted in zip(batch.column(0), batch.column(1)):
                text = expand.decompress(blob.as_py())
                text = letters(text) if by_words else text
                rows = []
                for w in wanted.as_py():
                    a, n = w["start"], w["windows"]
                    if w["crowded"]:
                        rows += [(w["anchor"], content_hash(text[a + k:a + k + length]) or 1, w["content"], k, 1, w["known"], None)
                                 for k in range(n)]
                    else:
                        rows.append((w["anchor"], 0, w["content"], 0, n, w["known"], text[a:a + n - 1 + length]))
                for i in range(0, len(rows), 10_000):
                    yield as_batch(dict(zip(schema.names, map(list, zip(*rows[i:i + 10_000])))), schema)

        return step

    # All pass. Spark filters ahead of a shuffle only for the sake of a side that is filtered, and
    # only if that is a plain table.
    rids = staged(read.sparkSession, wanted.select("rid"), "suffix-rids").where(F.col("rid") >= 0)
    texts = read.select("rid", "text").join(rids, "rid")
    return map_batches(texts.join(wanted, "rid").select("text", "wanted"), make, ddl)


def _repeats(pieces: DataFrame, length: int) -> DataFrame:
    """(anchor, content, first, stop): byte ranges of stretches that repeated windows cover."""
    ddl = "anchor bigint, content bigint, first int, stop int"
    schema = arrow_schema(ddl)

    def ranges(starts: np.ndarray):
        """Covered byte ranges of ascending window starts."""
        if not len(starts):
            return []
        cut = np.flatnonzero(np.diff(starts) > length) + 1
        return [(int(g[0]), int(g[-1]) + length) for g in np.split(starts, cut)]

    def task(batches):
        group, key, lone = [], None, None

        def ended():
            if len(group) < 2:
                return []
            marked = repeated_starts([g[1] for g in group], [g[2] for g in group], length)
            return [(key[0], g[0], a, b) for g, m in zip(group, marked) if not g[3] for a, b in ranges(m)]

        for batch in batches:
            out = []
            rows = zip(*(batch.column(i).to_pylist() for i in range(7)))
            for anchor, part, content, first, windows, known, piece in rows:
                own = [] if known else [(anchor, content, first, first + length)]
                if (anchor, part) != key:
                    out += ended()
                    group, key, lone = [], (anchor, part), None
                    if part:
                        lone = own
                        continue
                elif part:
                    out += (lone or []) + own
                    lone = None
                    continue
                group.append((content, piece, windows, known))
            if out:
                yield as_batch(dict(zip(schema.names, map(list, zip(*out)))), schema)
        out = ended()
        if out:
            yield as_batch(dict(zip(schema.names, map(list, zip(*out)))), schema)

    dealt = pieces.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(task, ddl)


def _covered(docs: DataFrame, id_col: str, text_col: str, length: int, by_words: bool = False) -> DataFrame:
    """(rid, doc_id, n_bytes, full_sha, text, marks): the staged documents with the byte ranges
    to remove as (start, [(first, stop), ...]) of each stretch; null if there are none."""
    spark = docs.sparkSession
    read = staged(spark, _read_documents(docs, id_col, text_col, length, by_words), "suffix-docs")
    occurrences = _occurrences(read)
    once = occurrences.groupBy("anchor", "content").agg(
        F.count("*").alias("c"), F.min(F.struct("rid", "start", "windows")).alias("one"),
    )
    of_anchor = Window.partitionBy("anchor")
    kinds = staged(spark, once.withColumn("different", F.count("*").over(of_anchor)).where(
        (F.col("c") > 1) | (F.col("different") > 1)
    ).select("anchor", "content", "c", "different", "one.*"), "suffix-kinds")
    repeats = _repeats(_pieces(kinds, read, length, by_words), length)
    whole = kinds.where(F.col("c") > 1).select(
        "anchor", "content", F.lit(0).alias("first"), (F.col("windows") - 1 + length).alias("stop"),
    )
    marks = repeats.union(whole).groupBy("anchor", "content").agg(
        F.collect_list(F.struct("first", "stop")).alias("ranges")  # at most one for each window
    )
    # Written, so that the join below has nothing but shuffles on either side: one stretch may
    # have a large share of all occurrences, and only such a join is split.
    with bloom_joins(spark):
        marks = staged(spark, marks, "suffix-marks")
    of_doc = occurrences.join(marks, ["anchor", "content"]).groupBy("rid").agg(
        F.collect_list(F.struct("start", "ranges")).alias("marks")
    )
    return read.drop("stretches").join(of_doc, "rid", "left")


def merged(marks) -> list[tuple[int, int]]:
    """Maximal runs of bytes that any range covers."""
    runs: list[list[int]] = []
    for a, b in sorted((m["start"] + r["first"], m["start"] + r["stop"]) for m in marks for r in m["ranges"]):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for run in runs for x in run), len(text)]
    return b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans): what is removed of each document."""
    covered = _covered(docs, id_col, text_col, length)
    kind = covered.schema["doc_id"].dataType.simpleString()
    ddl = (f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
           "spans array<struct<start:bigint,stop:bigint>>")
    schema = arrow_schema(ddl)

    def make():
        import zstandard

        expand = zstandard.ZstdDecompressor()
        nothing = hashlib.sha256(b"").hexdigest()

        def step(batch):
            removed, counts, shas, spans = [], [], [], []
            for n, sha, blob, marks in zip(*(batch.column(i) for i in range(1, 5))):
                runs = merged(marks.as_py() or [])
                gone = sum(b - a for a, b in runs)
                removed.append(gone)
                counts.append(len(runs))
                spans.append([{"start": a, "stop": b} for a, b in runs])
                if not gone:
                    shas.append(sha.as_py())
                elif gone == n.as_py():
                    shas.append(nothing)
                else:
                    shas.append(hashlib.sha256(without(expand.decompress(blob.as_py()), runs)).hexdigest())
            return as_batch({
                "doc_id": batch.column(0), "n_bytes": batch.column(1), "n_removed": removed, "n_spans": counts,
                "kept_sha256": shas, "spans": spans,
            }, schema)

        return step

    found = map_batches(covered.select("doc_id", "n_bytes", "full_sha", "text", "marks"), make, ddl)
    return found.withColumnRenamed("doc_id", id_col)


def cleaned(docs: DataFrame, text_col: str = "text", length: int = 400, words: int | None = None) -> DataFrame:
    """The documents without their repeated passages of `length` bytes or, if given, of `words`
    words, with the columns they came with. Bytes of a character that is cut go with it; documents
    of which nothing, or white space around repeated words, is left go."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("rest"), F.col(f"`{text_col}`").alias("text"))
    covered = _covered(packed, "rest", "text", 8 * words if words else length, bool(words))
    kind = covered.schema["doc_id"].dataType.simpleString()

    def make():
        import zstandard

        expand = zstandard.ZstdDecompressor()

        def step(batch):
            texts, keep = [], []
            for i, (blob, marks) in enumerate(zip(batch.column(1), batch.column(2))):
                blob = blob.as_py()
                text = b"" if blob is None else expand.decompress(blob)
                runs = merged(marks.as_py() or [])
                kept = without(text, of_words(text, runs) if words else runs)
                if (kept.strip() if words else kept) or not runs:
                    keep.append(i)
                    texts.append(None if blob is None else kept.decode("utf-8", "ignore"))
            rest = batch.column(0).take(pa.array(keep, pa.int64()))
            return pa.RecordBatch.from_arrays([rest, pa.array(texts, pa.string())], names=["rest", "text"])

        return step

    plain = map_batches(covered.select("doc_id", "text", "marks"), make, f"rest {kind}, text string")
    return plain.select(*[
        F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns
    ])
