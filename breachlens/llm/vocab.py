"""Vocabulary files: read once by the driver, sent to tasks as bytes of a fixed size."""

from __future__ import annotations

import os
import re
import sys
import types
from collections.abc import Callable, Iterator

from breachlens.llm.common import lower_bytes

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
#: Texts are handled in slices of about this many characters, to bound a worker's memory.
SLICE_CHARS = 2_000_000


def public_path(name: str) -> str:
    """Where a public vocabulary file lies; every operator also takes a path of its own."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def library_tokenizer(data: bytes):
    """The library's tokenizer without its threads: Spark runs one task per core already."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(data)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if it can be printed, else one of the
    characters from U+0100 on, in turn."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def is_plain(word: str) -> bool:
    """Lower-case letters below U+0250 alone: normalisation does not change them."""
    return word.isalpha() and word.lower() == word and max(word) < "\u0250"


class WordEncoder:
    """Ids of single words by the library. A word of lower-case letters below U+0250 is not
    changed by normalisation nor cut, so it goes to the library's model at once."""

    def __init__(self, data: bytes):
        self.library = library_tokenizer(data)
        self.tokenize = self.library.model.tokenize
        self.shown = dict(enumerate(byte_alphabet()))

    def __call__(self, words: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = []
        others = []
        for word in words:
            if is_plain(word):
                shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
                out.append([t.id for t in self.tokenize(shown)])
            else:
                others.append(word)
                out.append(None)
        if others:
            late = iter(self.library.encode_batch(others, add_special_tokens=False))
            out = [next(late).ids if ids is None else ids for ids in out]
        return out


def special_tokens(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def chunked(text: str | None) -> list[bytes]:
    """The parts of a text between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that together are short, or of one long text."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE_CHARS:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


#: ASCII characters that a word tokenizer cuts from the letter or digit before them. The
#: apostrophe is not among them, as it may begin a suffix.
PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PLAIN = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


class ChunkMemo(dict):
    """What a tokenizer that lower-cases and drops white space makes of the chunks between
    white space. It treats each by itself, so a text's ids are those of its chunks in turn.

    `encode` gets many words at once; `join` puts two values together. Texts are lower-cased
    and punctuation at the end of a chunk is taken as a word of its own, which changes no id
    and leaves fewer words to encode. Chunks with special tokens are left as they are. When it
    holds `most` chunks it begins a new generation; of the one before, those met again stay.
    """

    def __init__(self, encode: Callable, join: Callable, specials: list[str], most: int = 400_000):
        super().__init__()
        self.encode, self.join, self.most = encode, join, most
        self.special = re.compile(b"|".join(re.escape(s.encode()) for s in specials) or rb"(?!)").search
        self.special_low = [lower_bytes(s) for s in specials]
        self.pending: list[bytes] = []
        self.older: dict = {}

    def __missing__(self, chunk: bytes):
        value = self.older.get(chunk)
        if value is None:
            self.pending.append(chunk)
        else:
            self[chunk] = value
        return value

    def _learn(self) -> None:
        cuts, words = {}, {}
        for chunk in dict.fromkeys(self.pending):
            word = chunk.rstrip(PUNCTUATION)
            if word and word != chunk and word[-1] in PLAIN and not self.special(chunk):
                cuts[chunk] = word, chunk[len(word):]
            else:
                cuts[chunk] = (chunk,)
            for part in cuts[chunk]:
                if part not in self:
                    known = self.older.get(part)
                    if known is None:
                        words[part] = None
                    else:
                        self[part] = known
        for word, value in zip(words, self.encode([w.decode("utf-8", "surrogatepass") for w in words])):
            self[word] = value
        for chunk, parts in cuts.items():
            if len(parts) == 2:
                self[chunk] = self.join(self[parts[0]], self[parts[1]])

    def lists(self, texts: list[str | None]) -> list[list]:
        """The values of the chunks of each text."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        self.pending = []
        out, missing = [], []
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            low = lower_bytes(raw)
            chunks = (raw if any(s in low for s in self.special_low) else low).split()
            before = len(self.pending)
            out.append(list(map(self.__getitem__, chunks)))
            missing.append(len(self.pending) - before)
        if self.pending:
            self._learn()
            late = iter(self.pending)
            for values, n in zip(out, missing):
                i = -1
                for _ in range(n):
                    i = values.index(None, i + 1)
                    values[i] = self[next(late)]
        return out


def in_worker(name: str, make: Callable):
    """An object that lives as long as its Python worker, so that one task goes on with what
    earlier tasks of the worker have learned."""
    kept = sys.modules.setdefault("_llm_worker", types.ModuleType("_llm_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]
