"""Operator 2: token counts by a linear longest-match automaton.

The vocabulary is a trie. Each node has a failure link to the node that remains when the
longest tokens at its front are popped, and the number of those tokens. A word is walked once:
on a missing child the popped tokens are counted and the link is followed. No piece is built.

A word is a maximal run of `[^\\x20\\x09-\\x0D]`; it starts with a mark of the vocabulary (the
byte alphabet's blank), which word-initial tokens begin with. Every single byte is a token, so
each word has pieces.

Defined cases: a null or empty text has 0 words and 0 tokens; repeated rows are counted each;
columns besides the id and the text are not read.
"""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breachlens.llm.common import Memo, arrow_schema, as_batch, map_batches
from breachlens.llm.vocab import BYTE_BPE, byte_alphabet, chunked, public_path, read


class LongestMatch:
    """The automaton over byte strings."""

    def __init__(self, tokens: list[bytes]):
        self.child: list[dict[int, int]] = [{}]
        token_end = [False]
        for token in tokens:
            node = 0
            for byte in token:
                following = self.child[node].get(byte)
                if following is None:
                    following = self.child[node][byte] = len(self.child)
                    self.child.append({})
                    token_end.append(False)
                node = following
            token_end[node] = node != 0
        self.link = [-1] * len(self.child)
        self.popped = [0] * len(self.child)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for byte, below in self.child[node].items():
                queue.append(below)
                if token_end[below]:
                    self.link[below], self.popped[below] = 0, 1
                    continue
                at, count = self.link[node], self.popped[node]
                while at >= 0 and byte not in self.child[at]:
                    count += self.popped[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[below], self.popped[below] = self.child[at][byte], count

    def count(self, word: bytes) -> int:
        """How many pieces greedy longest match cuts the word into; -1 if it cannot."""
        child, link, popped = self.child, self.link, self.popped
        node, count = 0, 0
        for byte in word:
            while byte not in child[node]:
                if link[node] < 0:
                    return -1
                count += popped[node]
                node = link[node]
            node = child[node][byte]
        while node:
            if link[node] < 0:
                return -1
            count += popped[node]
            node = link[node]
        return count


def vocabulary(data: bytes) -> list[bytes]:
    """Tokens as bytes. A token with the blank behind its front can match in no word."""
    back = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
    found = []
    for token in json.loads(data)["model"]["vocab"]:
        if all(c in back for c in token):
            raw = b"".join(back[c] for c in token)
            if b" " not in raw[1:]:
                found.append(raw)
    return found


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_words, n_tokens, longest_word): words, their pieces, and the most pieces of a word."""
    shared = docs.sparkSession.sparkContext.broadcast(read(path or public_path(BYTE_BPE)))
    id_type = docs.schema[id_col].dataType.simpleString()
    ddl = f"{id_col} {id_type}, n_words bigint, n_tokens bigint, longest_word bigint"
    schema = arrow_schema(ddl)

    def make():
        automaton = LongestMatch(vocabulary(shared.value))
        memo = Memo(lambda word: automaton.count(b" " + word))

        def step(batch: pa.RecordBatch):
            words, tokens, longest = [], [], []
            for text in batch.column(1):
                counts = [memo[w] for w in chunked(text.as_py())]
                words.append(len(counts))
                tokens.append(sum(counts))
                longest.append(max(counts, default=0))
            return as_batch(
                {id_col: batch.column(0), "n_words": words, "n_tokens": tokens, "longest_word": longest}, schema
            )

        return step

    return map_batches(docs.select(id_col, F.col(text_col).cast("string")), make, ddl)
