"""A minimal perfect hash of keys that are known, in bit arrays with ranks, and the keys themselves to verify hits."""

from __future__ import annotations

import numpy as np

from lodestone.llm._text import U64, expand, mix, same_runs

_LEVELS = 48


class PerfectHash:
    """slots(h) is the slot, 0 to n - 1, of each hash of a key, and any slot or -1 for other hashes: the caller compares
    the key that is stored there. In each level the hashes that are alone in their place get it, the others go on to the
    next one; a slot is the rank of its place. The few hashes left at the end, and hashes that repeat, are found by search."""

    def __init__(self, h: np.ndarray):
        h = np.asarray(h, U64)
        self.n, self.sizes, bits, left = len(h), [], [], np.unique(h)
        for level in range(_LEVELS):
            if not len(left):
                break
            size = -(-2 * len(left) // 64) * 64
            at = self._place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            self.sizes.append(size)
            left = left[~alone[at]]
        self.words = np.concatenate(bits) if bits else np.zeros(0, np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.rank = (np.cumsum(ones) - ones).astype(np.int64)
        self.rest, self.found = left, int(ones.sum())

    @staticmethod
    def _place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(h ^ U64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) % U64(size)).astype(np.int64)

    def slots(self, h: np.ndarray) -> np.ndarray:
        out, todo, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            if not len(todo):
                return out
            at = self._place(h[todo], level, size)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            here = (self.words[word] >> bit) & U64(1) == 1
            low = self.words[word[here]] & ((U64(1) << bit[here]) - U64(1))
            out[todo[here]] = self.rank[word[here]] + np.bitwise_count(low).astype(np.int64)
            todo, base = todo[~here], base + size // 64
        if len(self.rest) and len(todo):
            i = np.minimum(np.searchsorted(self.rest, h[todo]), len(self.rest) - 1)
            here = self.rest[i] == h[todo]
            out[todo[here]] = self.found + i[here]
        return out


class NumberKeys:
    """Slots of 64-bit keys. A hit is one whose stored key is equal; others have -1."""

    def __init__(self, keys: np.ndarray):
        self.hash = PerfectHash(mix(keys.astype(U64)))
        self.keys = np.zeros(len(keys), np.int64)
        self.keys[self.hash.slots(mix(keys.astype(U64)))] = keys

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self.hash.slots(mix(keys.astype(U64)))
        hit = slot >= 0
        hit[hit] = self.keys[slot[hit]] == keys[hit]
        return np.where(hit, slot, -1)


class ByteKeys:
    """Slots of byte strings, each with a group (a small number): stored one after the other and compared byte by byte. Keys
    whose hash another key has are kept apart, in a dict, with the last slots."""

    def __init__(self, h: np.ndarray, group: np.ndarray, body: np.ndarray, length: np.ndarray):
        begin = np.cumsum(length) - length
        _, first = np.unique(h, return_index=True)
        twice = np.ones(len(h), bool)
        twice[first] = False
        first = np.flatnonzero(~twice)
        self.hash = PerfectHash(h[first])
        order = np.empty(len(first), np.int64)
        order[self.hash.slots(h[first])] = first
        self.n = len(h)
        self.length, self.group = length[order], group[order]
        self.body = body[expand(begin[order], self.length)] if len(order) else body[:0]
        self.begin = np.cumsum(self.length) - self.length
        raw = body.tobytes()
        self.odd = {(int(group[i]), raw[begin[i] : begin[i] + length[i]]): len(first) + j for j, i in enumerate(np.flatnonzero(twice).tolist())}

    def find(self, h: np.ndarray, group: np.ndarray, body: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        slot = self.hash.slots(h)
        some = np.flatnonzero(slot >= 0)
        at = slot[some]
        fine = (self.group[at] == group[some]) & same_runs(body, begin[some], length[some], self.body, self.begin[at], self.length[at])
        out = np.full(len(h), -1, np.int64)
        out[some[fine]] = at[fine]
        if self.odd:
            raw = body.tobytes()
            for i in np.flatnonzero(out < 0).tolist():
                out[i] = self.odd.get((int(group[i]), raw[begin[i] : begin[i] + length[i]]), -1)
        return out
