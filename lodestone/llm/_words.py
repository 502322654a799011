"""A table from byte strings to token ids that grows as words are met, kept as arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from lodestone.llm._text import distinct_runs, expand, run_hashes, same_runs


def _merged(a: tuple, b: tuple) -> tuple:
    order = np.argsort(h := np.concatenate([a[0], b[0]]), kind="stable")
    return (h[order], *(np.concatenate([x, y])[order] for x, y in zip(a[1:], b[1:])))


class Pool:
    """An array that grows."""

    def __init__(self, kind: np.dtype):
        self.data, self.used = np.zeros(1 << 16, kind), 0

    def add(self, x: np.ndarray) -> int:
        """Appends x; where it begins."""
        if self.used + len(x) > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros(max(len(x), self.used), self.data.dtype)])
        self.data[self.used : self.used + len(x)] = x
        self.used += len(x)
        return self.used - len(x)


class WordTable:
    """learn(words) gives the numbers of ids of new words, and all their ids. Words are found by a 64-bit hash and then
    compared byte by byte; those whose hash another word has are kept in a dict. Up to `cache` words that were learned are
    kept, some 60 bytes each; then the table starts anew, with the words of `start` (their bytes, lengths, numbers of ids
    and ids) if it is given."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], kind: np.dtype, cache: int = 1_000_000, start: tuple[np.ndarray, ...] | None = None):
        self.learn, self.kind, self.cache, self.start = learn, kind, cache, start
        self.clear()

    def clear(self) -> None:
        none = lambda kind: np.zeros(0, kind)
        self.tiers = [(none(np.uint64), none(np.int64), none(np.int32), none(np.int64), none(np.int32)) for _ in range(2)]
        self.flat, self.raw, self.known = Pool(self.kind), Pool(np.dtype(np.uint8)), 0
        self.odd: dict[bytes, tuple[int, int]] = {}
        if self.start and len(self.start[1]):
            body, length, n, ids = self.start
            self._add(run_hashes(body, np.cumsum(length) - length, length), body, length, n, ids)
            self.tiers[0], self.tiers[1], self.known = self.tiers[1], self.tiers[0], 0
        self.base = (self.flat.used, self.raw.used)

    def _add(self, h: np.ndarray, body: np.ndarray, length: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Joins the small tier, which joins the large one when it has grown. A hash that is there, or twice among the
        new ones, keeps its first word; others of it are odd."""
        at = self.flat.add(ids) + np.cumsum(n) - n
        where = self.raw.add(body) + np.cumsum(length) - length
        _, first = np.unique(h, return_index=True)
        taken = np.ones(len(h), bool)
        taken[first] = False
        for th, *_ in self.tiers:
            if len(th):
                taken |= th[np.minimum(np.searchsorted(th, h), len(th) - 1)] == h
        for i in np.flatnonzero(taken).tolist():
            self.odd[self.raw.data[where[i] : where[i] + length[i]].tobytes()] = (int(at[i]), int(n[i]))
        i = first[~taken[first]]  # in the order of the hashes
        self.tiers[1] = _merged(self.tiers[1], (h[i], at[i], n[i].astype(np.int32), where[i], length[i].astype(np.int32)))
        self.known += len(h)
        if len(self.tiers[1][0]) > 200_000:
            self.tiers[0] = _merged(self.tiers[0], self.tiers[1])
            self.tiers[1] = tuple(x[:0] for x in self.tiers[1])

    def _find(self, h: np.ndarray, body: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known, at, n = np.zeros(len(h), bool), np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for th, ta, tn, tr, ts in self.tiers:
            if len(th):
                i = np.minimum(np.searchsorted(th, h), len(th) - 1)
                hit = np.flatnonzero(th[i] == h)
                k = i[hit]
                hit = hit[same := same_runs(body, begin[hit], length[hit], self.raw.data, tr[k], ts[k].astype(np.int64))]
                known[hit], at[hit], n[hit] = True, ta[k[same]], tn[k[same]]
        if self.odd:
            raw = body.tobytes()
            for i in np.flatnonzero(~known).tolist():
                if (got := self.odd.get(raw[begin[i] : begin[i] + length[i]])) is not None:
                    known[i], (at[i], n[i]) = True, got
        return known, at, n

    def ids(self, body: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """body: the bytes of all words one after the other; cut: where each begins (none is empty). The number of
        ids of each word, and all ids."""
        if not len(cut):
            return np.zeros(0, np.int64), np.zeros(0, self.kind)
        length = np.diff(np.append(cut, len(body)))
        distinct, where, back = distinct_runs(body, cut, length)
        begin, length = cut[where], length[where]
        if self.known > self.cache or self.flat.used - self.base[0] + (self.raw.used - self.base[1]) // 4 > 8 * self.cache:
            self.clear()
        known, place, n = self._find(distinct, body, begin, length)
        if not known.all():
            fresh = np.flatnonzero(~known)
            size = length[fresh]
            new = body[expand(begin[fresh], size)]
            raw, stop = new.tobytes(), np.cumsum(size).tolist()
            self._add(distinct[fresh], new, size, *self.learn([raw[a:b] for a, b in zip([0, *stop[:-1]], stop)]))
            known, place, n = self._find(distinct, body, begin, length)
        size = n[back]
        return size, self.flat.data[expand(place[back], size)]
