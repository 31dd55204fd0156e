"""Hashed words of whole record batches, without a Python step per word.

A word is a run of ASCII letters and digits or bytes of non-ASCII characters, lower-cased. Its hash is
a polynomial over its bytes, read off one running sum of the batch, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)
_IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_powers = [np.ones(1, "u8"), np.ones(1, "u8")]


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _INVERSE)):
            steps = np.full(max(n, 1 << 21), base, "u8")
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def lowered(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The lower-cased texts, joined by line feeds, and the end of each text in there."""
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    sizes = pc.binary_length(low).to_numpy(zero_copy_only=False).astype("i8")
    return b"\n".join(low.cast(pa.binary()).to_pylist()), np.cumsum(sizes + 1) - 1


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch, in order, and the number of words of each text."""
    data, ends = lowered(texts)
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, "u8"), np.zeros(len(ends), "i8")
    inside = np.concatenate([[False], _IN_WORD[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edges[::2], edges[1::2]
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    return hashes_between(raw, start, stop), counts


def hashes_between(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from each start to its stop; equal bytes have equal hashes wherever they lie."""
    power, inverse = _power_tables(len(raw) + 1)
    running = np.zeros(len(raw) + 1, "u8")
    np.cumsum((raw.astype("u8") + np.uint64(1)) * power[:-1], out=running[1:])
    value = (running[stop] - running[start]) * inverse[start]
    return mixed(value ^ ((stop - start).astype("u8") << np.uint64(56)))


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hash of ordered pairs of hashes."""
    return mixed(first * np.uint64(0x9FB21C651E98DF25) + mixed(second + np.uint64(0x2545F4914F6CDD1D)))


class Table:
    """Values by 64-bit key, for whole arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: float):
        order = np.argsort(keys)
        self.keys, self.values, self.missing = keys[order], values[order], missing

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (``missing`` where there is none) and whether there is one."""
        if not len(self.keys):
            return np.full(len(keys), self.missing), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return np.where(found, self.values[at], self.missing), found


_NO_KEY = np.uint64(2**64 - 1)


class Probed:
    """Values by 64-bit key (not the largest one): an open table with linear probing that holds every key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(8, int(len(keys)).bit_length() + 1))
        home = (mixed(keys) >> self.shift).astype("i8")
        order = np.argsort(home, kind="stable")
        step = np.arange(len(keys))
        slot = np.maximum.accumulate(home[order] - step) + step  # each at home or next to the one before
        size = max((1 << 64 - int(self.shift)), int(slot[-1]) + 1 if len(slot) else 0) + 1  # the last slot stays free
        self.key, self.value = np.full(size, _NO_KEY), np.zeros(size)
        self.key[slot], self.value[slot] = keys[order], values[order]

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none) and whether there is one."""
        slot = (mixed(keys) >> self.shift).astype("i8")
        there = self.key[slot]
        hit = there == keys
        open_at = np.flatnonzero(~hit & (there != _NO_KEY))
        while len(open_at):
            slot[open_at] += 1
            there = self.key[slot[open_at]]
            found = there == keys[open_at]
            hit[open_at[found]] = True
            open_at = open_at[~found & (there != _NO_KEY)]
        return np.where(hit, self.value[slot], 0.0), hit
