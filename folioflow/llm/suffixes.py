"""Suffix order of an integer text by prefix doubling, to a bounded depth."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int, packed: int = 1, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The cyclic suffixes in order of their first depth symbols at least (in any order where those are equal), and each position's place.

    packed: how many symbols of so many bits are compared at once to begin with.
    """
    n = len(text)
    first = text.astype(np.uint64)
    known = 1
    while known * 2 <= packed:
        first = first << np.uint64(bits * known) | np.roll(first, -known)
        known *= 2
    order = np.argsort(first)
    first = first[order]
    starts = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    del first
    sizes = np.diff(np.append(starts, n))
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(starts.astype(np.int32), sizes)
    active = order[np.repeat(sizes > 1, sizes)].astype(np.int32)
    del order
    while known < depth and len(active):
        ahead = active + np.int32(known)
        ahead[ahead >= n] -= np.int32(n)
        key = rank[active].astype(np.uint64) << np.uint64(32) | rank[ahead].astype(np.uint64)
        by = np.argsort(key)
        active, key = active[by], key[by]
        own = key >> np.uint64(32)
        group = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        part = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        of_group = group[np.searchsorted(group, part, side="right") - 1]
        sizes = np.diff(np.append(part, len(key)))
        rank[active] = np.repeat((own[part].astype(np.int64) + part - of_group).astype(np.int32), sizes)
        active = active[np.repeat(sizes > 1, sizes)]
        known *= 2
    order = np.argsort(rank)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


class WaveletMatrix:
    """Rank and symbol queries on a text of symbols below 2**bits, one packed bit vector a level."""

    def __init__(self, text: np.ndarray, bits: int) -> None:
        self.bits, self.n = bits, len(text)
        self.words: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        self.zeros: list[int] = []
        current = text
        for level in range(bits - 1, -1, -1):
            bit = (current >> level) & 1 == 1
            packed = np.zeros((len(bit) // 64 + 1) * 64, bool)
            packed[: len(bit)] = bit
            words = np.packbits(packed, bitorder="little").view("<u8")
            self.words.append(words)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]))
            self.zeros.append(int(len(bit) - bit.sum()))
            current = np.concatenate([current[~bit], current[bit]])

    def ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """How many ones the level has before each place."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[level][block] + np.bitwise_count(self.words[level][block] & mask)

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where places end up after the levels that the symbols choose: differences are ranks."""
        for level in range(self.bits):
            one = self.ones(level, at)
            bit = (symbol >> (self.bits - 1 - level)) & 1 == 1
            at = np.where(bit, self.zeros[level] + one, at - one)
        return at

    def symbols_in(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every symbol in each range [low, high), with its descended ends."""
        prefix = np.zeros(len(low), np.int64)
        for level in range(self.bits):
            a, b = self.ones(level, low), self.ones(level, high)
            zero, one = (high - b) > (low - a), b > a
            prefix = np.concatenate([prefix[zero] << 1, prefix[one] << 1 | 1])
            low, high = np.concatenate([(low - a)[zero], self.zeros[level] + a[one]]), np.concatenate([(high - b)[zero], self.zeros[level] + b[one]])
        return prefix, low, high
