"""Operator 5: language-model scores by a hierarchical Pitman-Yor model.

The context of a word is the whole word before it. Each context is a restaurant; without the
word before, it is the restaurant of all words, whose parent is uniform over the training words
and one for all unknown ones.

A Gibbs sweep seats the customers of each word anew in all restaurants, given the tables that
were held there after the sweep before. After some sweeps the predictive probabilities are
averaged over the next ones. Draws are functions of word, context and sweep, so a lost task is
repeated to the letter. Customers of a dish after the 64th are seated in blocks.

Pairs of a context and a word are dealt out by their hash to parts, as many as the text asks
for, so neither a frequent word nor a frequent context makes one part large. After each sweep
the parts send the tables of their contexts and words to those contexts' and words' owners, which
sum them up, seat the words in the restaurant of all words, and send the totals back to the
parts that asked. No total is broadcast, however many contexts there are.

Counts cover all training documents: each unit of documents has its own list of pairs, the lists
are summed up by part, and the results go back to the units.

Tokens: A-Z lower-cased; words `[^\\x20\\x09-\\x0D]+`, then one end, which is the empty word. The
first word's context is the end of a document. Words are told apart by hashes of 63 bits.

Defined cases: a null or empty text is its end alone; a null id counts as the empty text for the
remainder; without training documents there is one unknown word, of probability 1; repeated rows
are scored, and learned from, each; columns besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachlens.llm.common import arrow_schema, as_batch, discard, lower_bytes, released, staged
from breachlens.llm.seating import discount_of, seated

#: Tokens of a unit of documents, which has one list.
UNIT_TOKENS = 1 << 22
SWEEPS, BURN_IN = 4, 1
STRENGTH = 1.0
#: Characters of all texts for each part: some two million pairs at most.
PART_CHARS = 16_000_000
PLACE_BITS = np.int64(32)
#: The lowest bit of a hash tells contexts from words.
CONTEXT = np.uint64(1)
#: The parents of contexts given as numbers, see Restaurants.
PARENTS, PARENT_START = 1 << 16, 1 << 8


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little") & ~1


def pair_hash(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = contexts * np.uint64(0x9E3779B97F4A7C15) + words
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def parent_of(contexts: np.ndarray) -> np.ndarray:
    """The parent of a context that is given as a number."""
    return np.where(contexts == PARENTS, PARENT_START, contexts & 255)


def predictive(c, t, discount, customers, tables, parent):
    """The probability of dishes with c customers at t tables, by their restaurant's totals."""
    return (c - discount * t + (STRENGTH + discount * tables) * parent) / (STRENGTH + customers)


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and for each value its number among them: np.unique with less memory."""
    order = np.argsort(values)
    values = values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    numbers = np.empty(len(values), np.int32)
    numbers[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return values[new], numbers


class Unit:
    """Documents with one list of words in contexts."""

    def __init__(self):
        class Places(dict):
            def __missing__(self, word):
                self[word] = place = len(self)
                return place

        self.places = Places()
        self.places[b""] = 0
        self.docs: list[np.ndarray] = []
        self.out: list[bool] = []
        self.size = 0

    def add(self, text: str | None, out: bool) -> None:
        words = lower_bytes(text).split()
        words.append(b"")
        self.docs.append(np.fromiter(map(self.places.__getitem__, words), dtype=np.int32, count=len(words)))
        self.out.append(out)
        self.size += len(words)

    def listed(self, parts: int):
        """(contexts, words, cuts, tokens): the pairs of a context and a word by part and, within one,
        in order of word and context, where each part begins and ends, and for each token its
        number among them."""
        hashes = np.fromiter(map(word_hash, self.places), dtype=np.uint64, count=len(self.places))
        known, rank = np.unique(hashes, return_inverse=True)
        pairs, tokens = numbered(self._codes(rank))
        contexts = known[pairs & ((1 << PLACE_BITS) - 1)] | CONTEXT
        words = known[pairs >> PLACE_BITS]
        part = (pair_hash(contexts, words) >> np.uint64(20)) % np.uint64(parts)
        part = part.astype(np.uint16 if parts <= 1 << 16 else np.int64)  # short numbers are sorted faster
        order = np.argsort(part, kind="stable")
        at = np.empty(len(order), np.int32)
        at[order] = np.arange(len(order), dtype=np.int32)
        return contexts[order], words[order], np.searchsorted(part[order], np.arange(parts + 1)), at[tokens]

    def _codes(self, rank: np.ndarray) -> np.ndarray:
        """For each token the ranks of its word and its context as one number."""
        flat = rank[np.concatenate(self.docs)]
        codes = flat << PLACE_BITS
        codes[:1] |= rank[0]  # every document ends with the empty word, which has place 0
        codes[1:] |= flat[:-1]
        return codes

    def document_tokens(self, parts: int):
        tokens = self.listed(parts)[-1]
        ends = np.cumsum([len(d) for d in self.docs])
        return [tokens[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def dealt(self, parts: int):
        """(part, number of its first pair, contexts, words, training counts)."""
        contexts, words, cuts, tokens = self.listed(parts)
        trained = ~np.repeat(np.array(self.out, dtype=bool), [len(d) for d in self.docs])
        counts = np.bincount(tokens[trained], minlength=len(words)).astype(np.int32)
        for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist())):
            if a < b:
                yield k, a, contexts[a:b], words[a:b], counts[a:b]


def _units(docs: DataFrame, id_col: str, text_col: str, folds: int, held: int, ddl: str, emit) -> DataFrame:
    """Run `emit(unit number, unit, ids)` on every unit of documents. Units only depend on how
    the rows lie in the input's partitions."""
    def task(batches):
        base, made = TaskContext.get().partitionId() << 24, 0
        unit, ids = Unit(), []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                plain = doc_id.as_py()
                unit.add(text.as_py(), zlib.crc32(("" if plain is None else str(plain)).encode()) % folds == held)
                ids.append(doc_id)
                if unit.size >= UNIT_TOKENS:
                    yield from emit(base + made, unit, ids)
                    made += 1
                    unit, ids = Unit(), []
        if ids:
            yield from emit(base + made, unit, ids)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(task, ddl)


def _lists(docs: DataFrame, id_col: str, text_col: str, folds: int, held: int, parts: int) -> DataFrame:
    ddl = "unit bigint, part int, start bigint, contexts binary, words binary, counts binary"
    schema = arrow_schema(ddl)

    def emit(number, unit, ids):
        for part, start, *pairs in unit.dealt(parts):
            yield as_batch(dict(zip(schema.names, [[number], [part], [start], *([packed(a)] for a in pairs)])), schema)

    return _units(docs, id_col, text_col, folds, held, ddl, emit)


def packed(array: np.ndarray) -> bytes:
    """Compressed, the first bytes of all numbers before the second ones, and so on: high bytes are mostly the same."""
    import zstandard

    planes = np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.itemsize).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpacked(blob: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _documents(docs: DataFrame, id_col: str, text_col: str, folds: int, held: int, parts: int) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"unit bigint, doc_id {kind}, held_out boolean, tokens binary"
    schema = arrow_schema(ddl)

    def emit(number, unit, ids):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        blobs = [squeeze(t.tobytes()) for t in unit.document_tokens(parts)]
        for a in range(0, len(ids), 1000):
            yield as_batch({
                "unit": [number] * len(ids[a:a + 1000]), "doc_id": pa.array([i.as_py() for i in ids[a:a + 1000]], schema.field("doc_id").type),
                "held_out": unit.out[a:a + 1000], "tokens": blobs[a:a + 1000],
            }, schema)

    return _units(docs, id_col, text_col, folds, held, ddl, emit)


def _by(column: str, batches):
    """(value, its rows) of batches that are sorted by the column of that name."""
    value, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if rows and row[column] != value:
                yield value, rows
                rows = []
            value = row[column]
            rows.append(row)
    if rows:
        yield value, rows


def _parts(lists: DataFrame, owners: int) -> DataFrame:
    """A row for each part: (part, once, twice, keys, ends, contexts, words, counts, units, sizes,
    starts, which): its contexts and words by owner, where each owner's end, which of them make
    up each pair, the pairs' training counts, and for each unit how many pairs it has, the number
    there of the first, and which they are, as differences. All lists of pairs are in order of word
    and context, so that equal words are neighbours and differences are small."""
    ddl = ("part int, once bigint, twice bigint, keys binary, ends binary, contexts binary, words binary, "
           "counts binary, units binary, sizes binary, starts binary, which binary")
    schema = arrow_schema(ddl)

    def task(batches):
        for part, rows in _by("part", batches):
            contexts, words = ([unpacked(r[k], np.uint64) for r in rows] for k in ("contexts", "words"))
            sizes = np.array([len(w) for w in words], np.int64)
            counts = np.concatenate([unpacked(r["counts"], np.int32) for r in rows])
            contexts, context = np.unique(np.concatenate(contexts), return_inverse=True)
            # With return_index the sort is stable, which merges lists that are in order already.
            words, _, word = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
            _, first, which = np.unique(word << PLACE_BITS | context, return_index=True, return_inverse=True)
            counts = np.bincount(which, weights=counts, minlength=len(first)).astype(np.int64)
            keys = np.concatenate([contexts, words])
            owner = ((keys >> np.uint64(20)) % np.uint64(owners)).astype(np.int64)
            order = np.argsort(owner, kind="stable")
            at = np.empty(len(keys), np.int32)
            at[order] = np.arange(len(keys), dtype=np.int32)
            ends = np.cumsum(sizes)
            steps = np.diff(which, prepend=0).astype(np.int32)
            steps[ends - sizes] = which[ends - sizes]
            yield as_batch(dict(zip(schema.names, [[part], [int((counts == 1).sum())], [int((counts == 2).sum())], *([packed(a)] for a in (
                keys[order], np.cumsum(np.bincount(owner, minlength=owners)), at[context[first]], at[len(contexts) + word[first]],
                counts, np.array([r["unit"] for r in rows], np.int64), sizes,
                np.array([r["start"] for r in rows], np.int64), steps,
            ))])), schema)

    return lists.repartition(owners, "part").sortWithinPartitions("part").mapInArrow(task, ddl)


class Restaurants:
    """The seating of a batch of words in three levels of restaurants, all held in one place, whose
    contexts are numbers. The queries seat by parts instead."""

    def __init__(self, keys: np.ndarray, contexts: list[bytes], counts: list[bytes], model: dict):
        self.model = model
        self.context = np.frombuffer(b"".join(contexts), np.int32).astype(np.int64)
        self.c2 = np.frombuffer(b"".join(counts), np.int64)
        n = len(keys)
        self.word = np.repeat(np.arange(n), [len(c) // 4 for c in contexts])
        codes, self.up = np.unique(self.word * 512 + parent_of(self.context), return_inverse=True)
        self.word1, self.parent = codes >> 9, codes & 511
        spread = np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            self.key0 = keys.view(np.uint64)
            self.key1 = self.key0[self.word1] + (self.parent.astype(np.uint64) + np.uint64(1)) * spread
            self.key2 = self.key0[self.word] + (self.context.astype(np.uint64) + np.uint64(1000)) * spread
        self._take(np.minimum(self.c2, 1), None, None)

    def _take(self, t2, t1, t0) -> None:
        """New tables from the leaves up; those not given are one for each dish that is there."""
        self.t2 = t2
        self.c1 = np.bincount(self.up, weights=self.t2, minlength=len(self.word1)).astype(np.int64)
        self.t1 = np.minimum(self.c1, 1) if t1 is None else t1(self.c1)
        self.c0 = np.bincount(self.word1, weights=self.t1, minlength=len(self.key0)).astype(np.int64)
        self.t0 = np.minimum(self.c0, 1) if t0 is None else t0(self.c0)

    def _level(self, c, t, discount, context, totals, parent):
        return predictive(c, t, discount, totals[0][context], totals[1][context], parent)

    def root(self, totals) -> np.ndarray:
        zero = np.zeros(len(self.key0), np.int64)
        return self._level(self.c0, self.t0, self.model["d0"], zero, totals[0], 1 / self.model["words"])

    def middle(self, totals) -> np.ndarray:
        return self._level(self.c1, self.t1, self.model["d1"], self.parent, totals[1], self.root(totals)[self.word1])

    def leaves(self, totals) -> np.ndarray:
        """The predictive probability of each word in each of its contexts."""
        return self._level(self.c2, self.t2, self.model["d2"], self.context, totals[2], self.middle(totals)[self.up])

    def sweep(self, totals, number: int) -> None:
        d0, d1, d2 = (self.model[d] for d in ("d0", "d1", "d2"))
        root, middle = self.root(totals), self.middle(totals)
        opening2 = (STRENGTH + d2 * totals[2][1][self.context]) * middle[self.up]
        opening1 = (STRENGTH + d1 * totals[1][1][self.parent]) * root[self.word1]
        opening0 = np.full(len(self.key0), (STRENGTH + d0 * totals[0][1][0]) / self.model["words"])
        self._take(
            seated(self.c2, opening2, d2, self.key2, number * 3),
            lambda c: seated(c, opening1, d1, self.key1, number * 3 + 1),
            lambda c: seated(c, opening0, d0, self.key0, number * 3 + 2),
        )


class Part:
    """The pairs of a part. A pair's dish is its word, its restaurant the context."""

    def __init__(self, row: dict, model: dict):
        self.model = model
        self.keys, self.ends = unpacked(row["keys"], np.uint64), unpacked(row["ends"], np.int64)
        self.context, self.word = unpacked(row["contexts"], np.int32), unpacked(row["words"], np.int32)
        self.c = unpacked(row["counts"], np.int64)
        self.pair = pair_hash(self.keys[self.context], self.keys[self.word])

    def root(self, number: int, totals: list) -> np.ndarray:
        """The probability of each pair's word in the restaurant of all words after a sweep."""
        customers, tables = self.model["history"][number]
        first, second = totals[number]
        p = predictive(first, second, self.model["d0"], customers, tables, 1 / self.model["words"])
        return p[self.word]

    def seat(self, number: int, totals: list) -> np.ndarray:
        """The tables of each pair after a sweep, by the totals of the one before."""
        if not number:
            return np.minimum(self.c, 1)
        opening = (STRENGTH + self.model["d1"] * totals[number - 1][0][self.context]) * self.root(number - 1, totals)
        return seated(self.c, opening, self.model["d1"], self.pair, number * 3)

    def leaves(self, number: int, totals: list, tables: np.ndarray) -> np.ndarray:
        """The predictive probability of each pair after a sweep."""
        customers = totals[-1][0][self.context]
        return predictive(self.c, tables, self.model["d1"], customers, totals[number][0][self.context], self.root(number, totals))

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Totals of the pairs' values by context and by word."""
        n = len(self.keys)
        return (np.bincount(self.context, values, n) + np.bincount(self.word, values, n)).astype(np.int64)


def _totals_of(rows: list[dict], last: int, keys: np.ndarray) -> list:
    """For each sweep from 0 to `last`, and then for the training counts as they are, the totals by
    key as (customers, tables) of words in the restaurant of all words; of contexts both are their
    tables, or their customers in the last one. Those that no row has are left out. Rows hold tables
    of words alone, and none of the training counts."""
    found: list = [None] * (last + 2)
    for row in sorted(rows, key=lambda r: r["owner"]):
        at = row["sweep"]
        found[at] = found[at] or ([], [])
        for into, name in zip(found[at], ("first", "second")):
            if row[name] is not None:
                into.append(unpacked(row[name], np.int64))
    is_word = (keys & CONTEXT) == 0

    def filled(first: list, second: list):
        customers = np.concatenate(first)
        tables = customers.copy()
        if second:
            tables[is_word] = np.concatenate(second)
        return customers, tables

    return [f and filled(*f) for f in found]


TOTALS = "sweep int, part int, owner int, first binary, second binary, customers bigint, tables bigint, once bigint, twice bigint"


def _sent(parts: DataFrame, totals: DataFrame | None, model: dict, number: int) -> DataFrame:
    """(owner, part, keys, tables, counts): of each part for each owner the sums after a sweep;
    the training counts only come with the first."""
    ddl = "owner int, part int, keys binary, tables binary, counts binary"
    schema = arrow_schema(ddl)

    def batches_of(row: dict, rows: list[dict]):
        own = Part(row, model)
        tables = own.summed(own.seat(number, _totals_of(rows, number, own.keys)))
        counts = own.summed(own.c) if not number else None
        cuts = [0, *own.ends.tolist()]
        for owner, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a < b:
                yield as_batch(dict(zip(schema.names, [
                    [owner], [row["part"]], [packed(own.keys[a:b])], [packed(tables[a:b])],
                    [None if counts is None else packed(counts[a:b])],
                ])), schema)

    narrow = parts.select("part", "keys", "ends", "contexts", "words", "counts")
    if totals is None:
        def task(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    yield from batches_of(row, [])

        return narrow.mapInArrow(task, ddl)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [b for row in left.to_pylist() for b in batches_of(row, right.to_pylist())]
        return pa.Table.from_batches(found, schema)

    before = totals.where((F.col("part") >= 0) & (F.col("sweep") == number - 1))
    return narrow.groupBy("part").cogroup(before.groupBy("part")).applyInArrow(both, ddl)


def _owned(sent: DataFrame, owners: int, model: dict, number: int, last: int) -> DataFrame:
    """The totals after a sweep for each part that asked, and as part -1 the sums of each owner."""
    schema = arrow_schema(TOTALS)

    def task(batches):
        for owner, rows in _by("owner", batches):
            asked = [unpacked(r["keys"], np.uint64) for r in rows]
            keys, places = np.unique(np.concatenate(asked), return_inverse=True)
            is_word = (keys & CONTEXT) == 0

            def total(name):
                return np.bincount(places, np.concatenate([unpacked(r[name], np.int64) for r in rows]), len(keys)).astype(np.int64)

            first = total("tables")
            second = first.copy()
            c = first[is_word]
            if number:
                weight = (STRENGTH + model["d0"] * model["history"][number - 1][1]) / model["words"]
                second[is_word] = seated(c, np.full(len(c), weight), model["d0"], keys[is_word], number * 3 + 2)
            else:
                second[is_word] = np.minimum(c, 1)
            counts = total("counts") if not number else None
            cuts = np.cumsum([0, *map(len, asked)])
            for r, a, b in zip(rows, cuts.tolist(), cuts[1:].tolist()):
                own = places[a:b]
                yield as_batch(dict(zip(schema.names, [
                    [number], [r["part"]], [owner], [packed(first[own])], [packed(second[own[is_word[own]]])], *[[None]] * 4
                ])), schema)
                if counts is not None:
                    yield as_batch(dict(zip(schema.names, [
                        [last + 1], [r["part"]], [owner], [packed(counts[own])], [None], *[[None]] * 4
                    ])), schema)
            n = 0 if counts is None else int(counts[is_word].sum())
            yield as_batch(dict(zip(schema.names, [
                [number], [-1], [owner], [None], [None], [int(c.sum())], [int(second[is_word].sum())],
                [int((c == 1).sum())], [int((c == 2).sum())],
            ])), schema)
            yield as_batch(dict(zip(schema.names, [
                [last + 1], [-1], [owner], [None], [None], [n], [int((c > 0).sum())], [0], [0]
            ])), schema)

    return sent.repartition(owners, "owner").sortWithinPartitions("owner").mapInArrow(task, TOTALS)


def _returned(parts: DataFrame, totals: DataFrame, model: dict, sweeps: int, burn_in: int) -> DataFrame:
    """(unit, start, counts, logs): for each unit, from the pair of number `start` on, the pairs'
    words' counts and, averaged over the sweeps after the burn-in, the logarithms of the pairs'
    probabilities."""
    ddl = "unit bigint, start bigint, counts binary, logs binary"
    schema = arrow_schema(ddl)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        for row in left.to_pylist():
            own = Part(row, model)
            held = _totals_of(right.to_pylist(), sweeps, own.keys)
            mean = np.zeros(len(own.c))
            for number in range(1, sweeps + 1):
                if number > burn_in:
                    mean += own.leaves(number, held, own.seat(number, held))
            logs = np.log10(mean / (sweeps - burn_in)).astype(np.float32)
            counts = held[-1][0][own.word]
            steps = unpacked(row["which"], np.int32)
            at = 0
            for unit, n, start in zip(*(unpacked(row[k], np.int64).tolist() for k in ("units", "sizes", "starts"))):
                pairs = np.cumsum(steps[at:at + n])
                found.append(as_batch(dict(zip(schema.names, [
                    [unit], [start], [packed(counts[pairs])], [packed(logs[pairs])]
                ])), schema))
                at += n
        return pa.Table.from_batches(found, schema)

    return parts.groupBy("part").cogroup(totals.where("part >= 0").groupBy("part")).applyInArrow(both, ddl)


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2,
    sweeps: int = SWEEPS, burn_in: int = BURN_IN,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    Documents whose crc32(id) has the remainder `held` by `folds` are not learned from.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(8, -(-chars // PART_CHARS))
    with released(spark):
        parts = staged(spark, _parts(_lists(docs, id_col, text_col, folds, held, buckets), buckets), "lm-parts")
    single = parts.agg(F.sum("once"), F.sum("twice")).first()
    model = {"words": 1, "d0": 0.5, "d1": discount_of(single[0] or 0, single[1] or 0), "history": []}
    total = types = 0
    held_totals, written = None, [parts]
    for number in range(sweeps + 1):
        with released(spark):
            new = staged(spark, _owned(_sent(parts, held_totals, model, number), buckets, model, number, sweeps), "lm-totals")
        sums = {r["sweep"]: r for r in new.where("part < 0").groupBy("sweep").agg(
            *[F.sum(c).alias(c) for c in ("customers", "tables", "once", "twice")]
        ).collect()}
        if not number and sums:
            total, types = sums[sweeps + 1]["customers"], sums[sweeps + 1]["tables"]
            model |= {"words": types + 1, "d0": discount_of(sums[0]["once"], sums[0]["twice"])}
        model = model | {"history": [*model["history"], (sums[number]["customers"], sums[number]["tables"]) if sums else (0, 0)]}
        held_totals = new if held_totals is None else held_totals.union(new)
        written.append(new)
    with released(spark):
        back = staged(spark, _returned(parts, held_totals, model, sweeps, burn_in), "lm-back")
    for frame in written:
        discard(spark, frame)
    documents = _documents(docs, id_col, text_col, folds, held, buckets)
    kind = documents.schema["doc_id"].dataType.simpleString()
    ddl = (f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
           "base_score double, score double")
    schema = arrow_schema(ddl)
    base = math.log10(total + types + 1)

    def unit(texts: pa.Table, lists: pa.Table) -> pa.Table:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        parts = [
            (start, unpacked(c, np.int64), unpacked(g, np.float32))
            for start, c, g in zip(*(lists.column(k).to_pylist() for k in ("start", "counts", "logs")))
        ]
        size = max((start + len(c) for start, c, _ in parts), default=1)
        counts, logs = np.zeros(size, np.int64), np.zeros(size)
        for start, c, log in parts:
            counts[start:start + len(c)], logs[start:start + len(c)] = c, log
        known, plain = counts > 0, np.log10(counts + 1.0) - base
        out: list[list] = [[] for _ in range(5)]
        for tokens in texts.column("tokens").to_pylist():
            at = np.frombuffer(expand(tokens), np.int32)
            for into, v in zip(out, (len(at), int(known[at].sum()), total, float(plain[at].sum()), float(logs[at].sum()))):
                into.append(v)
        columns = [texts.column("doc_id"), texts.column("held_out"), *(
            pa.array(v, f.type) for v, f in zip(out, list(schema)[2:])
        )]
        return pa.Table.from_arrays(columns, schema=schema)

    both = documents.groupBy("unit").cogroup(back.groupBy("unit"))
    return both.applyInArrow(unit, ddl).withColumnRenamed("doc_id", id_col)
