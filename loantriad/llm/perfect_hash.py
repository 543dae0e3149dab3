"""Minimal perfect hashing of whole numbers, in buckets that are built apart and looked up together.

A bucket's keys are hashed into a bitmap of ``ROOM`` bits a key; keys that fall on a bit alone have found their place, the
others go on to a smaller bitmap with another hash, until none is left. A key's index is the number of set bits before its
own, so indexes run from 0 to n - 1 without gaps. The keys are kept in that order: a key that was not built in is
recognised.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

from loantriad.llm.common import mix

BUCKETS = 256
ROOM = 2

_U = np.uint64


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(_U) + _U(0x9E3779B97F4A7C15)) >> _U(56)).astype(np.int64)


def _places(keys: np.ndarray, level: int, size) -> np.ndarray:
    salted = keys.astype(_U) * _U(0xD6E8FEB86659FD93) + _U((level + 1) * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
    return (mix(salted) % np.asarray(size, _U)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """Bits of each level, the bitmaps one after the other, and the (distinct) keys in the order of their index."""
    sizes, maps, ordered, left = [], [], [], keys
    while len(left):
        size = -(-ROOM * len(left) // 64) * 64
        at = _places(left, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        ordered.append(left[placed][np.argsort(at[placed])])
        sizes.append(size)
        maps.append(np.packbits(alone, bitorder="little").tobytes())
        left = left[~placed]
    return sizes, b"".join(maps), np.concatenate(ordered) if ordered else keys


@dataclass
class Level:
    words: np.ndarray  # bitmaps of all buckets
    before: np.ndarray  # index of the first set bit of each word
    offset: np.ndarray  # first bit of each bucket
    size: np.ndarray  # bits of each bucket


class PerfectHash:
    """Buckets looked up together; index ``first[b]`` is the least of bucket b."""

    def __init__(self, rows: Iterable[tuple[int, list[int], bytes, np.ndarray]]):
        """rows: bucket, sizes, bitmaps, keys as ``build`` gives them."""
        rows = sorted(rows, key=lambda r: r[0])
        self.first = np.zeros(BUCKETS + 1, np.int64)
        for b, _, _, keys in rows:
            self.first[b + 1] = len(keys)
        self.first = np.cumsum(self.first)
        self.keys = np.concatenate([keys for _, _, _, keys in rows]) if rows else np.empty(0, np.uint32)
        self.levels: list[Level] = []
        taken = self.first[:-1].copy()
        read = {b: 0 for b, _, _, _ in rows}
        for depth in range(max((len(sizes) for _, sizes, _, _ in rows), default=0)):
            words, before = [], []
            offset, size, at = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), 0
            for b, sizes, maps, _ in rows:
                if depth >= len(sizes):
                    continue
                part = np.frombuffer(maps, np.uint64, sizes[depth] // 64, read[b])
                ones = np.cumsum(np.bitwise_count(part), dtype=np.int64)
                words.append(part)
                before.append(taken[b] + np.concatenate([[0], ones[:-1]]))
                taken[b] += ones[-1]
                read[b] += sizes[depth] // 8
                offset[b], size[b] = at, sizes[depth]
                at += sizes[depth]
            self.levels.append(Level(np.concatenate(words), np.concatenate(before), offset, size))

    def __len__(self) -> int:
        return len(self.keys)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 for keys that were not built in."""
        out = np.full(len(keys), -1, np.int64)
        todo, buckets = np.arange(len(keys)), bucket_of(keys)
        for depth, level in enumerate(self.levels):
            todo = todo[level.size[buckets[todo]] > 0]
            if not len(todo):
                break
            b = buckets[todo]
            bit = level.offset[b] + _places(keys[todo], depth, level.size[b])
            word, shift = level.words[bit >> 6], (bit & 63).astype(_U)
            here = (word >> shift) & _U(1) == _U(1)
            lower = np.bitwise_count(word & ((_U(1) << shift) - _U(1)))
            out[todo[here]] = level.before[bit[here] >> 6] + lower[here]
            todo = todo[~here]
        known = out >= 0
        known[known] = self.keys[out[known]] == keys[known]
        return np.where(known, out, -1)
