"""Suffix sorting of short byte strings in two stages.

A suffix is direct if it is smaller than its successor (the suffix one byte on). Only direct
ones are sorted; all others are induced: when suffix j is reached in order and suffix j - 1 is
larger than j, then j - 1 is the next in the front part of its first byte's bucket.
"""

from __future__ import annotations

import numpy as np


def sorted_suffixes(pieces: list[bytes], starts: list[int], length: int) -> tuple[bytes, list[int], list[int]]:
    """The suffixes that begin at the first `starts[k]` bytes of each piece, in order of their
    first `length` bytes, as positions in the joined text; besides, where each piece begins.

    Where inducing needs them, suffixes behind these are sorted too; they are in the result.
    """
    text = b"\0".join([*pieces, b""])
    arr = np.frombuffer(text, dtype=np.uint8)
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    begins = np.cumsum(sizes + 1) - sizes - 1
    # A suffix is smaller than the next one if the next byte that differs is larger. The byte
    # behind a piece counts as smaller than all.
    follow = arr[1:].astype(np.int16)
    own = arr[:-1].astype(np.int16)
    ends = begins + sizes
    follow[ends[sizes > 0] - 1] = -1
    differs = own != follow
    at = np.where(differs, np.arange(len(own)), len(own))
    at = np.minimum.accumulate(at[::-1])[::-1]
    direct = (follow > own)[np.minimum(at, len(own) - 1)]
    wanted = np.zeros(len(text), dtype=bool)
    for begin, end, n in zip(begins.tolist(), ends.tolist(), starts):
        stop = begin + n
        while stop < end and not direct[stop - 1]:
            stop += 1  # up to a direct suffix, from which the ones before are induced
        wanted[begin:stop] = True
    piece_end = np.repeat(ends, sizes + 1)
    seeds = np.flatnonzero(wanted[:-1] & direct)
    stops = np.minimum(seeds + length, piece_end[seeds])
    front: list[list[int]] = [[] for _ in range(256)]
    back: list[list[int]] = [[] for _ in range(256)]
    # A bucket at a time, so that the keys of one first byte are held and not those of all.
    firsts = arr[seeds]
    for byte in np.unique(firsts).tolist():
        own = np.flatnonzero(firsts == byte)
        positions = seeds[own].tolist()
        keys = [text[i:j] for i, j in zip(positions, stops[own].tolist())]
        back[byte] = [positions[k] for k in sorted(range(len(keys)), key=keys.__getitem__)]
    induced = np.zeros(len(text) + 1, dtype=np.uint8)
    induced[1:-1] = wanted[:-1] & ~direct  # shifted by one: asked for the suffix before j
    induced = induced.tobytes()
    for end in ends.tolist():
        if end and induced[end]:
            front[text[end - 1]].append(end - 1)
    out: list[int] = []
    for byte in range(256):
        bucket = front[byte]
        for j in bucket:  # grows while it is read
            if induced[j]:
                front[text[j - 1]].append(j - 1)
        for j in back[byte]:
            if induced[j]:
                front[text[j - 1]].append(j - 1)
        out += bucket
        out += back[byte]
    return text, out, begins.tolist()


def repeated_starts(pieces: list[bytes], starts: list[int], length: int) -> list[np.ndarray]:
    """For each piece the starts (below `starts[k]`) whose `length` bytes start twice or more
    among all pieces: neighbours in suffix order with a common prefix of that length."""
    text, order, begins = sorted_suffixes(pieces, starts, length)
    ok = np.zeros(len(text) + 1, dtype=bool)
    for begin, n in zip(begins, starts):
        ok[begin:begin + n] = True
    positions = np.array(order, dtype=np.int64)
    positions = positions[ok[positions]]
    found = np.zeros(len(text) + 1, dtype=bool)
    if len(positions) > 1:
        a, b = positions[:-1], positions[1:]
        # The first and last bytes tell most neighbours apart.
        arr = np.frombuffer(text, dtype=np.uint8)
        near = np.flatnonzero((arr[a] == arr[b]) & (arr[a + length - 1] == arr[b + length - 1]) & (arr[a + length // 2] == arr[b + length // 2]))
        same = [k for k, i, j in zip(near.tolist(), a[near].tolist(), b[near].tolist())
                if text[i:i + length] == text[j:j + length]]
        found[a[same]] = True
        found[b[same]] = True
    return [np.flatnonzero(found[begin:begin + n]) for begin, n in zip(begins, starts)]
