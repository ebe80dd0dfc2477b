"""Operator 6: BPE encoding and decoding by speculation and verification.

A word is first cut greedily into the longest tokens. Such a cut is what merging would give
if and only if each token is reachable and no merge ever crosses the border of two adjacent
tokens. The second condition is tested for all adjacent pairs of a batch at once, by undoing
merges from the latest to the earliest; words with a failing pair are merged exactly.

Defined cases: a null or empty text has no ids and decodes to the empty text; strings of
special tokens in a text become their ids, as the library does; ties of merges go to the
left; repeated rows are encoded one by one; a word may be as long as a text, and takes time in
proportion to its length but for a logarithm; columns besides the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachlens.llm.common import arrow_schema, as_batch, map_batches
from breachlens.llm.vocab import (
    WORD_BPE, ChunkMemo, byte_alphabet, in_worker, is_plain, library_tokenizer, public_path, read, slices,
)

NEVER = 1 << 40
#: Words of more symbols are merged with a heap.
LONG = 200
NO_MERGE = np.int64(NEVER)


class Bpe:
    """Merges, splits and tokens of a BPE file with word ends, whose ids follow its merges."""

    def __init__(self, data: bytes):
        model = json.loads(data)
        self.end = model["model"]["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.rank = {(self.vocab[a], self.vocab[b]): self.vocab[a + b] for a, b in merges}
        self.base = min(self.rank.values(), default=len(self.vocab))
        if list(self.rank.values()) != list(range(self.base, self.base + len(merges))):
            raise ValueError("token ids must follow the order of the merges")
        self.left = np.arange(self.base + len(merges), dtype=np.int64)
        self.right = self.left.copy()
        pairs = np.array(list(self.rank), dtype=np.int64).reshape(-1, 2)
        self.left[self.base:], self.right[self.base:] = pairs[:, 0], pairs[:, 1]
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], order + self.base
        self.longest = max((len(t) for t in self.vocab), default=1)
        self.reachable: dict[int, bool] = {}
        library = library_tokenizer(data)
        self.normalize = library.normalizer.normalize_str
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.shown = dict(enumerate(byte_alphabet()))
        self.apart = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    def propose(self, word: str) -> list[int]:
        """Greedy longest tokens; the last one carries the word end."""
        ids, start, n, vocab = [], 0, len(word), self.vocab
        while start < n:
            for stop in range(min(n, start + self.longest), start, -1):
                found = vocab.get(word[start:stop] + self.end if stop == n else word[start:stop])
                if found is not None:
                    break
            else:
                raise ValueError("a byte is missing in the vocabulary")
            ids.append(found)
            start = stop
        return ids

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether merging their joined text gives just the pair.

        The latest merge on either side is undone again and again; a merge across the border
        that comes before the last undone one would have been taken instead.
        """
        result = np.ones(len(first), dtype=bool)
        at = np.arange(len(first))
        limit = np.full(len(first), NO_MERGE)
        while len(at):
            keys = first << 32 | second
            place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[place] == keys, self.pair_ids[place], NO_MERGE)
            crossed = across < limit
            result[at[crossed]] = False
            go = ~crossed & (np.maximum(first, second) >= self.base)
            at, first, second = at[go], first[go], second[go]
            in_first = first > second
            limit = np.where(in_first, first, second + 1)
            first, second = np.where(in_first, self.right[first], first), np.where(in_first, second, self.left[second])
        return result

    def symbols(self, token: int) -> list[int]:
        if token < self.base:
            return [token]
        return self.symbols(int(self.left[token])) + self.symbols(int(self.right[token]))

    def merge(self, ids: list[int]) -> list[int]:
        """Exact merging: the earliest merge first, from left to right. A merged token's own
        merges come later than the one that made it. Long words are merged with a heap, as
        looking through all pairs for each merge would take the square of their length."""
        if len(ids) > LONG:
            return self._merge_long(ids)
        ids, rank = list(ids), self.rank
        ranks = [rank.get(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            ids[at:at + 2] = [best]
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get((ids[at - 1], best), NEVER)
            if at < len(ranks):
                ranks[at] = rank.get((best, ids[at + 1]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap of (merge, place) over a linked list; an entry whose pair has
        changed since is passed over."""
        ids, rank = list(ids), self.rank
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(rank[pair], i) for i, pair in enumerate(zip(ids, ids[1:])) if pair in rank]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j == len(ids) or rank.get((ids[i], ids[j])) != best:
                continue
            ids[i], ids[j], after[i] = best, -1, after[j]
            if after[i] < len(ids):
                before[after[i]] = i
                found = rank.get((best, ids[after[i]]))
                if found is not None:
                    heapq.heappush(heap, (found, i))
            if before[i] >= 0:
                found = rank.get((ids[before[i]], best))
                if found is not None:
                    heapq.heappush(heap, (found, before[i]))
        return [i for i in ids if i >= 0]

    def is_reachable(self, token: int) -> bool:
        known = self.reachable.get(token)
        if known is None:
            known = self.reachable[token] = self.merge(self.symbols(token)) == [token]
        return known

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of words in the tokenizer's byte alphabet."""
        proposed = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, proposed), dtype=np.int64, count=len(words))
        flat = np.fromiter((i for ids in proposed for i in ids), dtype=np.int64, count=int(sizes.sum()))
        if not len(flat):
            return proposed
        word = np.repeat(np.arange(len(words)), sizes)
        inner = word[1:] == word[:-1]
        failed = np.zeros(len(words), dtype=bool)
        if inner.any():
            failed[word[1:][inner][~self.compatible(flat[:-1][inner], flat[1:][inner])]] = True
        lost = [t for t in np.unique(flat).tolist() if not self.is_reachable(t)]
        if lost:
            failed[word[np.isin(flat, lost)]] = True
        for i in np.flatnonzero(failed):
            w = words[i]
            ids = [self.vocab[c] for c in w[:-1]] + [self.vocab[w[-1] + self.end]]
            proposed[i] = self.merge(ids)
        return proposed

    def words(self, text: str) -> list[str | int]:
        """A text as words in the byte alphabet, with special tokens as ids."""
        if is_plain(text):
            return [text if text.isascii() else text.encode().decode("latin-1").translate(self.shown)]
        out: list[str | int] = []
        start = 0
        for found in [*self.apart.finditer(text), None]:
            part = text[start:found.start() if found else len(text)]
            if part:
                out.extend(w for w, _ in self.split(self.normalize(part)))
            if found:
                out.append(self.special[found.group()])
                start = found.end()
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of many texts; each distinct word is encoded once."""
        cut = [self.words(t) for t in texts]
        distinct = list({w for ws in cut for w in ws if isinstance(w, str)})
        ids = dict(zip(distinct, self.encode_words(distinct)))
        return [[i for w in ws for i in (ids[w] if isinstance(w, str) else [w])] for ws in cut]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks: what a tokenizer without a decoder gives."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def _digest_parts(bpe: Bpe, ids: list[int]) -> tuple[int, bytes, bytes]:
    return len(ids), " ".join(map(str, ids)).encode(), bpe.decode(ids).encode()


def _joined(a: tuple[int, bytes, bytes], b: tuple[int, bytes, bytes]) -> tuple[int, bytes, bytes]:
    return (a[0] + b[0], a[1] + b" " + b[1], a[2] + b" " + b[2]) if a[0] and b[0] else a if a[0] else b


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of each whole text as an array."""
    data = read(path or public_path(WORD_BPE))
    shared = docs.sparkSession.sparkContext.broadcast(data)  # one vocabulary file
    id_type = docs.schema[id_col].dataType.simpleString()
    ddl = f"{id_col} {id_type}, ids array<int>"
    schema = arrow_schema(ddl)

    def make():
        bpe = Bpe(shared.value)
        memo = ChunkMemo(bpe.encode, list.__add__, list(bpe.special))

        def step(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            for start, stop in slices(texts):
                lists = memo.lists(texts[start:stop])
                ids = [[i for part in parts for i in part] for parts in lists]
                yield as_batch({id_col: batch.column(0).slice(start, stop - start), "ids": ids}, schema)

        return step

    return map_batches(docs.select(id_col, F.col(text_col).cast("string")), make, ddl)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text): token ids back to text; null ids decode to the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read(path or public_path(WORD_BPE)))
    id_type = encoded.schema[id_col].dataType.simpleString()
    ddl = f"{id_col} {id_type}, text string"
    schema = arrow_schema(ddl)

    def make():
        bpe = Bpe(shared.value)
        return lambda batch: as_batch(
            {id_col: batch.column(0), "text": [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]}, schema
        )

    return map_batches(encoded.select(id_col, ids_col), make, ddl)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each whole text, encoded and decoded.

    The digests are built from each chunk's ids and their decoding, so that no array of ids
    of a long text is held.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read(path or public_path(WORD_BPE)))
    id_type = docs.schema[id_col].dataType.simpleString()
    ddl = f"{id_col} {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema = arrow_schema(ddl)

    def make():
        def learned() -> ChunkMemo:
            bpe = Bpe(shared.value)

            def encode(words: list[str]):
                return [_digest_parts(bpe, ids) for ids in bpe.encode(words)]

            return ChunkMemo(encode, _joined, list(bpe.special))

        memo = in_worker(f"bpe {zlib.crc32(shared.value)}", learned)

        def step(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            counts, digests, decoded = [], [], []
            for start, stop in slices(texts):
                for parts in memo.lists(texts[start:stop]):
                    parts = [p for p in parts if p[0]]
                    counts.append(sum(p[0] for p in parts))
                    digests.append(hashlib.sha256(b" ".join([p[1] for p in parts])).hexdigest())
                    decoded.append(hashlib.sha256(b" ".join([p[2] for p in parts])).hexdigest())
            return as_batch({
                id_col: batch.column(0), "n_tokens": counts, "ids_sha256": digests, "decoded_sha256": decoded,
            }, schema)

        return step

    return map_batches(docs.select(id_col, F.col(text_col).cast("string")), make, ddl)
