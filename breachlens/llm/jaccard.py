"""Operator 10: n-gram Jaccard join by grouped prefixes.

A document is the set of its distinct word shingles, as 64-bit hashes. Two documents link when
100 * intersection >= percent * union. Sets are put into one global order, frequent shingles
last; sets that link must share a shingle among the first few of that order, their prefixes.

1. Documents with equal sets form one group (so those with equal prefix and size that differ
   are told apart by their sets); from here on only groups are handled.
2. Groups that share a prefix shingle are candidates, unless their sizes or the places of the
   shingle rule a link out. Each group is first held against the lowest group it shares a list
   with, which ties large groups of near copies together without pairing all of them.
3. All other candidates are looked at only if their groups are not yet in one component. So no
   link between components is lost, and links within one are not needed.
   Candidates are held against each other by odd sketches first: bit i of a sketch tells whether
   an odd number of shingles falls on i, so sets differ in at least as many shingles as their
   sketches differ in bits. A sketch has two bits for each shingle and can be folded to fewer.
   Only pairs that pass are verified on whole sets.
4. Components are expanded to the members of the groups.

Two shingles collide with a chance of 2^-64; a collision changes a size or an intersection by
one. Words: A-Z lower-cased, then `[^\\x20\\x09-\\x0D]+`.

Defined cases: a document with fewer words than a shingle has one shingle, all of them; without
words it has none, links with nothing and is its own component; repeated rows are members of
one group; rows without an id take part, and a component's id is the smallest id in it, null
only if it has none; columns besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breachlens.llm.common import (
    Memo, arrow_schema, as_batch, bloom_joins, lower_bytes, map_batches, staged,
)
from breachlens.llm.components import components

#: So many of the most frequent shingles come last in the order (8 bytes each are broadcast).
FREQUENT = 1 << 16
#: A list of groups that share a shingle is paired in blocks of about this many groups.
BLOCK = 20_000
#: Bits of the smallest sketch, which lists carry, and of the largest.
SKETCH, LARGEST_SKETCH = 512, 1 << 20
#: Lists up to this length are looked through for rows without a possible partner.
SHORT = 256
#: Rounds in which groups are held against hubs of their lists before all that are still apart are
#: compared, hubs of a list in each, and rows of a list for which that is worth while. They spare
#: work and change no result.
ROUNDS, HUBS, LONG = 4, 6, 64
#: Lists of LONG rows and more that a row names, those of the smallest shingles, so that a pair is made in one.
LEADS = 4
#: Pairs that are looked at together.
PAIRS = 250_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def word_hashes(low: bytes, memo: dict) -> np.ndarray:
    """The hashes of the words of a lower-cased text."""
    words = low.split()
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def shingle_set(hashes: np.ndarray, words: int) -> np.ndarray:
    """The distinct shingles in ascending order."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, words)
    with np.errstate(over="ignore"):
        h = np.full(n - width + 1, width, dtype=np.uint64)
        for k in range(width):
            h = h * PRIME + hashes[k:n - width + 1 + k]
        return np.unique(mixed(h))


def needed(n, percent: int):
    """The least intersection of a set of n with any set it links with."""
    return -(-percent * n // 100)


def overlap(a: int, b: int, percent: int) -> int:
    """The least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def in_order(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A set in the global order: rare ones by hash, then frequent ones from less to more."""
    if not len(frequent) or not len(shingles):
        return shingles
    place = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    often = frequent[place] == shingles
    late = shingles[often]
    return np.concatenate([shingles[~often], late[np.argsort(rank[place[often]], kind="stable")]])


DOCS = "rid bigint, doc_id {kind}, n bigint, set_key binary, sketch binary, text binary, counts binary"


def odd_sketch(shingles: np.ndarray) -> bytes:
    bits = min(LARGEST_SKETCH, max(SKETCH, 1 << (2 * len(shingles)).bit_length()))
    falls = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((falls & 1).astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch of fewer bits, `size` bytes, as 64-bit words: the parts of the larger one added up."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, dtype=np.uint64).reshape(-1, size // 8), axis=0)


def close(apart, n1, n2, percent: int):
    """Whether sets of sizes n1, n2 that differ in `apart` shingles or more can link."""
    return (n1 + n2 - apart) // 2 >= -(-percent * (n1 + n2) // (100 + percent))


def smallest(column: pa.Array) -> np.ndarray:
    """The smallest sketches of a column of sketches, as rows."""
    return np.array([folded(s, SKETCH // 8) for s in column.to_pylist()], dtype=np.uint64).reshape(-1, SKETCH // 64)


def _read_documents(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """One row per document with its set's fingerprint and its compressed text; besides, rows
    with the shingles that a task has seen in several documents, and how often."""
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = DOCS.format(kind=kind)
    schema = arrow_schema(ddl)

    def task(batches):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1)
        memo = Memo(word_hash)
        base, row = TaskContext.get().partitionId() << 33, 0
        held, size = [], 0

        def often():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            several = counts > 1
            tokens, counts = tokens[several], counts[several].astype(np.uint64)
            for i in range(0, len(tokens), 1 << 15):
                blob = np.concatenate([tokens[i:i + (1 << 15)], counts[i:i + (1 << 15)]]).tobytes()
                yield as_batch({
                    "rid": [None], "doc_id": [None], "n": [None], "set_key": [None], "sketch": [None], "text": [None],
                    "counts": [blob],
                }, schema)

        for batch in batches:
            rids, sizes, keys, sketches, texts = [], [], [], [], []
            for text in batch.column(1):
                plain = text.as_py()
                shingles = shingle_set(word_hashes(lower_bytes(plain), memo), words)
                rids.append(base + row)
                row += 1
                sizes.append(len(shingles))
                keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                sketches.append(odd_sketch(shingles))
                texts.append(None if plain is None else squeeze.compress(plain.encode("utf-8", "surrogatepass")))
                held.append(shingles)
                size += len(shingles)
                if size > 4_000_000:
                    yield from often()
                    held, size = [], 0
            yield as_batch({
                "rid": rids, "doc_id": batch.column(0), "n": sizes, "set_key": keys, "sketch": sketches, "text": texts,
                "counts": [None] * len(rids),
            }, schema)
        if held:
            yield from often()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(task, ddl)


def _frequent(read: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles in ascending order, and their ranks from rare to frequent."""
    ddl = "token bigint, c bigint"
    schema = arrow_schema(ddl)

    def make():
        def step(batch):
            for blob in batch.column(0):
                both = np.frombuffer(blob.as_py(), dtype=np.uint64)
                half = len(both) // 2
                yield as_batch({
                    "token": pa.array(both[:half].view(np.int64)), "c": pa.array(both[half:].astype(np.int64)),
                }, schema)
        return step

    counts = map_batches(read.where(F.col("counts").isNotNull()).select("counts"), make, ddl)
    top = counts.groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") > 8).orderBy(F.desc("c"), "token").limit(FREQUENT)
    tokens = np.array([row.token for row in top.collect()], dtype=np.int64).view(np.uint64)
    order = np.argsort(tokens)
    rank = -np.arange(len(tokens))
    return tokens[order], rank[order]


def _prefixes(groups: DataFrame, words: int, percent: int, frequent, rank) -> DataFrame:
    """(token, rid, n, pos): the prefix shingles of each group."""
    shared = groups.sparkSession.sparkContext.broadcast((frequent, rank))  # FREQUENT rows at most
    ddl = "token bigint, rid bigint, n int, pos int"
    schema = arrow_schema(ddl)

    def make():
        import zstandard

        expand, memo = zstandard.ZstdDecompressor(), Memo(word_hash)

        def step(batch):
            tokens, rids, sizes = [], [], []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = word_hashes(lower_bytes(expand.decompress(text.as_py())), memo)
                shingles = in_order(shingle_set(hashes, words), *shared.value)
                n = len(shingles)
                tokens.append(shingles[:n - needed(n, percent) + 1])
                rids.append(rid)
                sizes.append(n)
            lengths = np.array([len(t) for t in tokens], dtype=np.int64)
            total = int(lengths.sum())
            starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
            return as_batch({
                "token": pa.array(np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)),
                "rid": pa.array(np.repeat(np.array(rids, dtype=np.int64), lengths)),
                "n": pa.array(np.repeat(np.array(sizes, dtype=np.int32), lengths)),
                "pos": pa.array((np.arange(total) - starts).astype(np.int32)),
            }, schema)

        return step

    return map_batches(groups.select("rid", "text"), make, ddl)


def possible(n1, p1, n2, p2, percent: int):
    """Whether sets of sizes n1, n2 with a common shingle at places p1, p2 can link."""
    least = -(-percent * (n1 + n2) // (100 + percent))
    most = np.minimum(p1, p2) + 1 + np.minimum(n1 - p1, n2 - p2) - 1
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    return (most >= least) & (100 * small >= percent * large)


def pairs_of_lists(new: np.ndarray, closed: np.ndarray):
    """Of lists that begin where `new` is set, all pairs of rows of the closed ones: each row
    with the later rows of its list."""
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(new))
    partners = np.zeros(len(new), dtype=np.int64)
    rows = np.arange(begins[0], len(new))
    partners[begins[0]:] = np.where(np.repeat(closed, ends - begins), np.repeat(ends, ends - begins) - rows - 1, 0)
    left = np.repeat(np.arange(len(new)), partners)
    return left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(partners) - partners, partners)


def _without_partner(new, n, pos, percent: int) -> np.ndarray:
    """Rows of short lists that cannot link with any other of their list by size and place."""
    begins = np.flatnonzero(new)
    none = np.zeros(len(new), dtype=bool)
    if not len(begins):
        return none
    sizes = np.diff(np.append(begins, len(new)))
    closed = (sizes > 1) & (sizes <= SHORT)
    closed[-1] = False  # it may go on
    left, right = pairs_of_lists(new, closed)
    good = possible(n[left].astype(np.int64), pos[left], n[right].astype(np.int64), pos[right], percent)
    none[begins[0]:] = np.repeat(closed, sizes)
    none[left[good]] = False
    none[right[good]] = False
    return none


def _lists(prefixes: DataFrame, percent: int) -> DataFrame:
    """(token, rid, n, pos, hub, likely): rows of shingles that several groups share, with the
    lowest of those groups. Streams over rows in order, so a long list takes no memory; of short
    lists, rows without any possible partner are left out."""
    ddl = "token bigint, rid bigint, n int, pos int, hub bigint, likely boolean"
    schema = arrow_schema(ddl)

    def task(batches):
        last = None  # the last row, not written yet: whether its list goes on is open
        hub = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(4)]
            if last is not None:
                cols = [np.concatenate([[a], c]) for a, c in zip(last, cols)]
            token, rid, n, pos = cols
            new = np.ones(len(token), dtype=bool)
            new[1:] = token[1:] != token[:-1]
            if hub is not None and last is not None and not hub[-1]:
                new[0] = False  # the held row stands within its list
            ends = np.ones(len(token), dtype=bool)
            ends[:-1] = new[1:]
            at = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
            h_rid, h_n, h_pos = rid[at], n[at], pos[at]
            if not new[0]:
                own = at == 0
                h_rid, h_n, h_pos = (np.where(own, v, a) for v, a in zip(hub[:3], (h_rid, h_n, h_pos)))
            keep = ~(new & ends) & ~_without_partner(new, n, pos, percent)
            keep[-1] = False
            yield as_batch({
                "token": pa.array(token[keep]), "rid": pa.array(rid[keep]),
                "n": pa.array(n[keep].astype(np.int32)), "pos": pa.array(pos[keep].astype(np.int32)),
                "hub": pa.array(h_rid[keep]),
                "likely": pa.array(possible(n, pos, h_n, h_pos, percent)[keep]),
            }, schema)
            last = [c[-1] for c in cols]
            hub = (h_rid[-1], h_n[-1], h_pos[-1], bool(new[-1]))
        if last is not None and not hub[3]:
            token, rid, n, pos = last
            yield as_batch({
                "token": [int(token)], "rid": [int(rid)], "n": [int(n)], "pos": [int(pos)], "hub": [int(hub[0])],
                "likely": [bool(possible(np.int64(n), np.int64(pos), np.int64(hub[1]), np.int64(hub[2]), percent))],
            }, schema)

    dealt = prefixes.repartition("token").sortWithinPartitions("token", "rid")
    return dealt.mapInArrow(task, ddl)


def _sketched(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can link by their sketches."""
    ddl = "a bigint, b bigint"
    schema = arrow_schema(ddl)

    def make():
        def step(batch):
            good = []
            for n1, s1, n2, s2 in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                size = min(len(s1), len(s2))
                apart = int(np.bitwise_count(folded(s1, size) ^ folded(s2, size)).sum(dtype=np.int64))
                good.append(close(apart, n1, n2, percent))
            good = np.array(good, dtype=bool)
            return as_batch({
                "a": pa.array(batch.column(0).to_numpy()[good]), "b": pa.array(batch.column(1).to_numpy()[good]),
            }, schema)
        return step

    def side(name: str) -> DataFrame:
        return sketches.select(F.col("rid").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))

    met = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").select("a", "b", "n_a", "s_a", "n_b", "s_b")
    return map_batches(met, make, ddl)


def _hub_pairs(lists: DataFrame, labels: DataFrame, percent: int, round_: int) -> DataFrame:
    """(a, b): each group beside up to HUBS others of another component, those that share most of
    its lists among the hubs of these lists. A list's hubs are drawn by hashes, other ones in
    each round, so that they are the same in lists that hold the same groups."""
    known = lists.select("token", "rid", "n", "pos").hint("merge").join(
        labels.select(F.col("node").alias("rid"), "label"), "rid", "left"
    ).withColumn("label", F.coalesce("label", "rid"))
    drawn = known.groupBy("token").agg(F.array(*[
        F.min(F.struct(F.xxhash64(F.lit(HUBS * round_ + k), "rid").alias("h"), "rid", "n", "pos", "label")) for k in range(HUBS)
    ]).alias("hubs")).select("token", F.explode(F.array_distinct(F.transform("hubs", lambda h: h.dropFields("h")))).alias("hub"))
    n1, p1, n2, p2 = (F.col(c).cast("bigint") for c in ("n", "pos", "hub.n", "hub.pos"))
    least = F.ceil(percent * (n1 + n2) / F.lit(100.0 + percent) - 1e-9)
    can = (F.least(p1, p2) + F.least(n1 - p1, n2 - p2) >= least) & (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))
    met = known.hint("merge").join(drawn, "token").where((F.col("label") != F.col("hub.label")) & can)
    shared = met.groupBy(F.col("rid").alias("a"), F.col("hub.rid").alias("b")).agg(F.count("*").alias("shared"))
    best = Window.partitionBy("a").orderBy(F.desc("shared"), "b")  # a group is in few lists, and a list has HUBS hubs
    return shared.withColumn("place", F.row_number().over(best)).where(F.col("place") <= HUBS).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()


def _across(lists: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b): possible pairs of a list whose groups lie in different components."""
    return _met(lists, labels, sketches, percent).distinct()


def _met(lists: DataFrame, labels: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """As _across, but a pair may come from several tasks.

    A long list is cut into blocks, and each pair of blocks is a task's work of its own. Near copies share
    many long lists, so each group names its first LEADS of them, and a pair that shares one of these is left
    to the first one shared: a pair that links passes all filters in any list it shares."""
    small_ddl = "rid bigint, sketch binary"
    small_schema = arrow_schema(small_ddl)

    def make_small():
        return lambda batch: as_batch({
            "rid": batch.column(0), "sketch": [row.tobytes() for row in smallest(batch.column(1))],
        }, small_schema)

    small = map_batches(sketches.select("rid", "sketch"), make_small, small_ddl)
    known = small.hint("merge").join(labels.select(F.col("node").alias("rid"), "label"), "rid", "left").select(
        "rid", "sketch", F.coalesce("label", "rid").alias("label")
    )
    labelled = lists.select("token", "rid", "n", "pos").hint("merge").join(known.select("rid", "label"), "rid")
    sizes = labelled.groupBy("token").agg(
        F.count("*").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"),
    ).where(F.col("lo") != F.col("hi")).select("token", "m")
    leads = labelled.join(sizes.where(F.col("m") >= LONG), "token").groupBy("rid").agg(
        F.slice(F.sort_array(F.collect_list("token")), 1, LEADS).alias("leads")
    )
    carried = known.select("rid", "sketch").hint("merge").join(leads, "rid", "left")
    # What is missing is the list's own shingle, which is before none.
    named = [f"lead{k}" for k in range(LEADS)]
    lead = [F.coalesce(F.when(F.col("m") >= LONG, F.get("leads", F.lit(k))), "token").alias(c) for k, c in enumerate(named)]
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rid"), blocks).cast("int")
    dealt = labelled.hint("merge").join(sizes, "token").hint("merge").join(carried, "rid").select(
        "token", "rid", "n", "pos", "label", "sketch", own.alias("own"), blocks.alias("blocks"), *lead,
    ).select(
        "token", "rid", "n", "pos", "label", "sketch", "own", *named,
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select(
        "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        "rid", "n", "pos", "label", "own", "sketch", *named,
    )
    ddl = "a bigint, b bigint"
    schema = arrow_schema(ddl)

    def pairs(rows, new):
        """Of whole lists: every row with the later rows of its list, in bounded portions."""
        token, i, j, rid, n, pos, label, own, sketch, lead = rows
        count = len(rid)
        stops = np.append(np.flatnonzero(new)[1:], count)[np.cumsum(new) - 1]
        partners = stops - np.arange(count) - 1
        totals = np.cumsum(partners)
        start = 0
        while start < count:
            done = totals[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(totals, done + PAIRS, side="right")))
            own_partners = partners[start:stop]
            left = np.repeat(np.arange(start, stop), own_partners)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(own_partners) - own_partners, own_partners)
            # Pairs within a block belong to the task of that block alone.
            good = (label[left] != label[right]) & ((i[left] == j[left]) | (own[left] != own[right]))
            left, right = left[good], right[good]
            good = possible(n[left], pos[left], n[right], pos[right], percent)
            left, right = left[good], right[good]
            apart = np.bitwise_count(sketch[left] ^ sketch[right]).sum(axis=1, dtype=np.int64)
            good = close(apart, n[left].astype(np.int64), n[right].astype(np.int64), percent)
            left, right = left[good], right[good]
            before = (lead[left][:, :, None] == lead[right][:, None, :]).any(axis=2) & (lead[left] < token[left][:, None])
            good = ~before.any(axis=1)
            if good.any():
                a, b = rid[left[good]], rid[right[good]]
                yield np.stack([np.maximum(a, b), np.minimum(a, b)])
            start = stop

    def found(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [
                *(batch.column(k).to_numpy() for k in range(8)), smallest(batch.column(8)),
                np.stack([batch.column(9 + k).to_numpy() for k in range(LEADS)], axis=1),
            ]
            if rest is not None:
                rows = [np.concatenate([r, c]) for r, c in zip(rest, rows)]
            token, i, j = rows[:3]
            new = np.ones(len(token), dtype=bool)
            new[1:] = (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            last = int(np.flatnonzero(new)[-1])
            if last:
                yield from pairs([r[:last] for r in rows], new[:last])
            rest = [r[last:] for r in rows]
        if rest is not None:
            new = np.zeros(len(rest[0]), dtype=bool)
            new[0] = True
            yield from pairs(rest, new)

    def task(batches):
        """Each pair once from a task, however many shingles it shares, as long as memory allows."""
        held, size = [], 0
        for both in found(batches):
            held.append(both)
            size += both.shape[1]
            if size > 2 * PAIRS:
                held = [np.unique(np.concatenate(held, axis=1), axis=1)]
                size = held[0].shape[1]
                if size > PAIRS:
                    yield as_batch({"a": pa.array(held[0][0]), "b": pa.array(held[0][1])}, schema)
                    held, size = [], 0
        if held:
            both = np.unique(np.concatenate(held, axis=1), axis=1)
            yield as_batch({"a": pa.array(both[0]), "b": pa.array(both[1])}, schema)

    sorted_rows = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return sorted_rows.mapInArrow(task, ddl)


def _verified(pairs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): the pairs whose sets link, by exact intersections. `pairs` is a written table."""
    spark = pairs.sparkSession
    ids = pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct()
    ids = staged(spark, ids, "jaccard-ids").where(F.col("rid") >= 0)
    # All ids pass. Spark filters ahead of a shuffle only for the sake of a side that is filtered.
    with bloom_joins(spark):
        texts = staged(spark, rows.select("rid", "text").join(ids, "rid"), "jaccard-texts")
    ddl = "a bigint, b bigint"
    schema = arrow_schema(ddl)

    def make():
        import zstandard

        expand, memo = zstandard.ZstdDecompressor(), Memo(word_hash)

        def value(blob: bytes) -> np.ndarray:
            return shingle_set(word_hashes(lower_bytes(expand.decompress(blob)), memo), words)

        sets = Memo(value, 64)

        def step(batch):
            a, b = [], []
            for i, j, x, y in zip(*(batch.column(k) for k in range(4))):
                s, t = sets[x.as_py()], sets[y.as_py()]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(t) - both):
                    a.append(i.as_py())
                    b.append(j.as_py())
            return as_batch({"a": a, "b": b}, schema)

        return step

    second = texts.select(F.col("rid").alias("b"), F.col("text").alias("y"))
    first = texts.select(F.col("rid").alias("a"), F.col("text").alias("x"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y")
    return staged(spark, map_batches(joined, make, ddl), "jaccard-links")


def _labelled(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The staged documents, and (set_key, label) of every group: the lowest rid it can reach."""
    spark = docs.sparkSession
    read = staged(spark, _read_documents(docs, id_col, text_col, words), "jaccard-docs")
    rows = read.where(F.col("rid").isNotNull()).drop("counts")
    frequent, rank = _frequent(read)
    groups = staged(
        spark, rows.where(F.col("n") > 0).groupBy("set_key").agg(F.min("rid").alias("rid")), "jaccard-groups"
    )
    # The hints in this module keep plans the same at every size: all sides grow with the input.
    lead = rows.hint("merge").join(groups.select("rid"), "rid").select("rid", "text")
    lists = staged(spark, _lists(_prefixes(lead, words, percent, frequent, rank), percent), "jaccard-lists")
    starred = lists.where((F.col("rid") != F.col("hub")) & F.col("likely")).groupBy(F.col("rid").alias("a")).agg(
        F.min("hub").alias("b")
    )
    candidates = lists.select("rid").distinct()
    sketches = rows.select("rid", "n", "sketch").hint("merge").join(candidates, "rid")
    sketches = staged(spark, sketches, "jaccard-sketches")
    close_pairs = staged(spark, _sketched(starred, sketches, percent), "jaccard-pairs")
    links = _verified(close_pairs, rows, words, percent)
    labels = components(links, "jaccard-labels")
    crowded = lists.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") >= LONG).select("token")
    long_lists = staged(spark, lists.select("token", "rid", "n", "pos").join(crowded, "token", "left_semi"), "jaccard-long")
    for round_ in range(0 if long_lists.isEmpty() else ROUNDS):
        pairs = _hub_pairs(long_lists, labels, percent, round_)
        more = _verified(staged(spark, _sketched(pairs, sketches, percent), "jaccard-pairs"), rows, words, percent)
        if more.isEmpty():
            break
        links = links.union(more)
        labels = components(links, "jaccard-labels")
    close_pairs = _sketched(_across(lists, labels, sketches, percent), sketches, percent)
    more = _verified(staged(spark, close_pairs, "jaccard-pairs"), rows, words, percent)
    if more.limit(1).count():
        labels = components(links.union(more), "jaccard-labels")
    return rows, groups.join(labels.withColumnRenamed("node", "rid"), "rid", "left").select(
        "set_key", F.coalesce("label", "rid").alias("label"),
    )


def join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
) -> DataFrame:
    """(id, n_shingles, component_id): one row per document; component_id is the least id of
    the documents that links lead to."""
    rows, labels = _labelled(docs, id_col, text_col, words, percent)
    narrow = rows.select("doc_id", "n", "set_key")
    least = narrow.where(F.col("n") > 0).groupBy("set_key").agg(F.min("doc_id").alias("least"))
    of_label = least.join(labels, "set_key")
    of_component = of_label.groupBy("label").agg(F.min("least").alias("component_id"))
    of_set = of_label.join(of_component, "label").select("set_key", "component_id")
    found = narrow.where(F.col("n") > 0).join(of_set, "set_key").select("doc_id", "n", "component_id")
    alone = narrow.where(F.col("n") == 0).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.union(alone).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def deduplicate(docs: DataFrame, text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The first document of each component, with the columns it came with; documents without
    words all stay."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(F.lit(0).alias("_"), *others).alias("rest"), F.col(f"`{text_col}`").alias("text"))
    rows, labels = _labelled(packed, "rest", "text", words, percent)
    linked = rows.where(F.col("n") > 0).select("rid", "set_key").join(labels, "set_key")
    # Written, so that Spark knows how many go: texts only shuffle if they are too many to broadcast.
    gone = staged(docs.sparkSession, linked.where(F.col("rid") != F.col("label")).select("rid"), "jaccard-gone")
    kept = rows.select("rid", F.col("doc_id").alias("rest"), "text").join(gone, "rid", "left_anti").select("rest", "text")

    def make():
        import zstandard

        expand = zstandard.ZstdDecompressor()

        def step(batch):
            texts = [b and expand.decompress(b).decode("utf-8", "surrogatepass") for b in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["rest", "text"])

        return step

    kind = kept.schema["rest"].dataType.simpleString()
    plain = map_batches(kept, make, f"rest {kind}, text string")
    return plain.select(*[
        F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns
    ])
