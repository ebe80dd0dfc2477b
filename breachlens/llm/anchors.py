"""Windows of a fixed length, grouped by content: every window has an anchor, the smallest
hash among the short grams in it, the first one on ties. Equal windows have equal anchors at
equal places, so repeats are only to be looked for among windows of one anchor."""

from __future__ import annotations

import numpy as np

#: Bytes of a gram.
GRAM = 32
PRIME = 0x9E3779B97F4A7C15
_PLACE_BITS = np.uint64(24)
#: Positions within a buffer must fit into the place bits.
MOST = 1 << 24
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) ^ (
    np.arange(1, 257, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7) >> np.uint64(17)
)


def gram_hashes(buffer: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on."""
    with np.errstate(over="ignore"):
        h, width = _BYTES[buffer], 1
        while width < GRAM:
            h = h[:-width] * np.uint64(pow(PRIME, width, 1 << 64)) + h[width:]
            width *= 2
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(27))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of `width` values, by minima from block borders."""
    n = len(values)
    pad = -n % width
    full = np.concatenate([values, np.full(pad, ~np.uint64(0))]).reshape(-1, width)
    forward = np.minimum.accumulate(full, axis=1).ravel()
    backward = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n - width + 1], forward[width - 1:n])


def anchored(buffer: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor position) of each window of `length` bytes, and all gram hashes."""
    hashes = gram_hashes(buffer)
    places = np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least((hashes >> _PLACE_BITS << _PLACE_BITS) | places, length - GRAM + 1)
    at = (least & np.uint64(MOST - 1)).astype(np.int64)
    return hashes[at], at, hashes
