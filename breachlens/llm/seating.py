"""Chinese restaurants: seating the customers of many dishes at once."""

from __future__ import annotations

import numpy as np

#: Customers of a dish that are seated one by one; later ones in blocks of doubling size.
SINGLY = 64


def uniforms(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that only depend on key and salt: a draw made again is the same."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def seated(counts: np.ndarray, opening: np.ndarray, discount: float, keys: np.ndarray, salt: int) -> np.ndarray:
    """How many tables the customers of each dish take when all of them are seated anew.

    `opening` is the weight of a new table for the dish: (strength + discount * all tables of
    the restaurant) * the dish's probability in the parent. The others of the restaurant stay.
    """
    tables = np.minimum(counts, 1).astype(np.int64)
    at = np.flatnonzero(counts > 1)
    n = 1
    while len(at) and n < SINGLY:
        weight = opening[at]
        new = uniforms(keys[at], salt * 1000 + n) * (n - discount * tables[at] + weight) < weight
        tables[at] += new
        n += 1
        at = at[counts[at] > n]
    while len(at):
        block = np.minimum(counts[at], 2 * n) - n
        weight = opening[at]
        chance = weight / (n + block / 2 - discount * tables[at] + weight)
        mean, spread = block * chance, np.sqrt(block * chance * (1 - chance))
        radius = np.sqrt(-2 * np.log(uniforms(keys[at], salt * 1000 + 500 + n.bit_length())))
        angle = 2 * np.pi * uniforms(keys[at], salt * 1000 + 600 + n.bit_length())
        drawn = np.floor(mean + spread * radius * np.cos(angle) + 0.5)
        tables[at] += np.clip(drawn, 0, block).astype(np.int64)
        n *= 2
        at = at[counts[at] > n]
    return tables


def discount_of(once: int, twice: int) -> float:
    """A discount from how many dishes have one customer and two."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
