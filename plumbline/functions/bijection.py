"""Keyed permutations of 0..n-1: the place of a row follows from its number alone.

A number is cut into two digits, and in turn each digit is moved by a keyed hash of the other (a Feistel network), which
is a bijection of all pairs of digits whatever the hash is. Pairs beyond n - 1 are mapped again until they fall below n
(cycle walking), which keeps it one. Nothing is sorted and no table of positions exists; the inverse costs the same.
As plain column expressions the steps multiply when the optimizer copies them, so they run on Arrow batches.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

STEPS = 6
# Moduli of the hash of a digit (fixed values).
FIRST, SECOND = 2_147_483_647, 2_147_483_629


def digits(n: int) -> tuple[int, int]:
    """How many values the two digits have; their product passes n by less than its square root."""
    high = max(1, isqrt(n))
    return high, max(1, -(-n // high))


@lru_cache(maxsize=8)
def keys(seed: int, rounds: int) -> np.ndarray:
    """(a, b, c, d) for each step of permutations 0..rounds, from the hash that `columns.portable_hash` has for the parts."""
    drawn = np.array([[int(hashlib.md5(f"{seed}:{r}:{s}".encode()).hexdigest()[:15], 16) for s in range(2 * STEPS)] for r in range(rounds + 1)], np.int64)
    low, high = drawn & ((1 << 30) - 1), drawn >> 30
    return np.stack([1 + low[:, 0::2], high[:, 0::2], 1 + low[:, 1::2], high[:, 1::2]], 2)


def moved(at: np.ndarray, of: np.ndarray, n: int, inverse: bool = False) -> np.ndarray:
    """Places of `at` (0..n-1) under the permutations whose keys are the rows of `of`, or what is there if `inverse`."""
    size = digits(n)
    out, left = at.copy(), np.arange(len(at))
    while len(left):
        parts, own = list(np.divmod(out[left], size[1])), of[left]
        for s in reversed(range(STEPS)) if inverse else range(STEPS):
            a, b, c, d = own[:, s].T
            mine = s % 2
            drawn = ((parts[1 - mine] * a + b) % FIRST * c + d) % SECOND % size[mine]
            parts[mine] = (parts[mine] - drawn if inverse else parts[mine] + drawn) % size[mine]
        out[left] = parts[0] * size[1] + parts[1]
        left = left[out[left] >= n]
    return out


def moved_once(at: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """Places of `at` (0..n-1) under one permutation, whose keys are (a, b, c, d) for each step; as `moved`, with scalars."""
    size, out = digits(n), None

    def rest(x: np.ndarray, by: int) -> np.ndarray:
        return x - x // by * by

    left, now = None, at
    while True:
        high = now // size[1]
        parts = [high, now - high * size[1]]
        for s, (a, b, c, d) in enumerate(key.tolist()):
            mine = s % 2
            parts[mine] = rest(parts[mine] + rest(rest(rest(parts[1 - mine] * a + b, FIRST) * c + d, SECOND), size[mine]), size[mine])
        now = parts[0] * size[1] + parts[1]
        if out is None:
            out, left = now, np.flatnonzero(now >= n)
        else:
            out[left] = now
            left = left[now >= n]
        if not len(left):
            return out
        now = out[left]


def place(at: str, number: str, n: int, rounds: int, seed: int, inverse: bool = False) -> Column:
    """The place of `at` under permutation `number` (up to `rounds`), or what is at that place if `inverse`."""
    @F.pandas_udf("long")
    def run(positions: pd.Series, numbers: pd.Series) -> pd.Series:
        return pd.Series(moved(positions.to_numpy(np.int64), keys(seed, rounds)[numbers.to_numpy(np.int64)], n, inverse))

    return run(F.col(at), F.col(number))
