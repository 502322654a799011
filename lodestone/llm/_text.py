"""Vectorised words, hashes and row slices shared by the text operators.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased: in UTF-8 that is
a run of bytes that are 0-9, a-z or not ASCII, so whole batches are cut with byte tables and no regex.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose bits all depend on all bits of x."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # not glibc
    _TRIM = None


def tidy() -> None:
    """Gives freed memory back to the system: Python workers live on between stages, beside other workers."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20, max_rows: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Runs of at most max_rows rows whose texts have at most max_bytes together; a longer text comes alone and whole."""
    i = batch.schema.get_field_index(column)
    size = pc.binary_length(batch.column(i)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(size), 0
    while start < batch.num_rows:
        base = ends[start] - size[start]
        stop = min(start + max_rows, max(start + 1, int(np.searchsorted(ends, base + max_bytes, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop
    tidy()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the offsets of its rows in them; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


#: A random number for each byte at each of 64 places; later places mix in the number of their stretch of 64.
_PLACES = 64
_AT = np.random.default_rng(20240117).integers(0, 2**64, _PLACES * 256, dtype=U64)


def run_hashes(body: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes (the runs lie one after the other; none is empty): the sum of a random number
    for each byte at its place, so no structure of the bytes, however long, makes two runs meet."""
    if not len(begin):
        return np.zeros(0, U64)
    at = np.arange(len(body), dtype=np.int32) - np.repeat(begin.astype(np.int32), length)
    if int(length.max()) <= _PLACES:
        f = _AT[(at << 8) + body]
    else:
        f = _AT[((at & (_PLACES - 1)) << 8) + body]
        far = np.flatnonzero(at >= _PLACES)
        f[far] = mix(f[far] ^ mix((at[far] >> 6).astype(U64)))
    return mix(np.add.reduceat(f, begin) + length.astype(U64))


def expand(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices place[0], place[0] + 1, ... (size[0] of them), place[1], ..."""
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    kind = np.int32 if total + int(place.max(initial=0)) < 1 << 31 else np.int64
    return np.repeat((place - (stop - size)).astype(kind), size) + np.arange(total, dtype=kind)


def same_runs(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Whether run i of a equals run i of b, byte by byte."""
    out = a_size == b_size
    i = np.flatnonzero(out & (a_size > 0))
    if len(i):
        size = a_size[i]
        equal = a[expand(a_at[i], size)] == b[expand(b_at[i], size)]
        if not equal.all():
            out[i] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    return out


def distinct_runs(body: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each distinct run, the first run that is it, and which of these each run is. Runs of one hash are
    compared byte by byte; should two differ, all are told apart as bytes."""
    h = run_hashes(body, begin, length)
    distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
    rep = where[back]
    if not (np.array_equal(length, length[rep]) and np.array_equal(body, body[expand(begin[rep], length)])):
        raw, seen = body.tobytes(), {}
        back = np.array([seen.setdefault(raw[a : a + n], len(seen)) for a, n in zip(begin.tolist(), length.tolist())])
        _, where = np.unique(back, return_index=True)
        distinct = h[where]
    return distinct, where, back


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words one after the other, where each begins and how long it is, and for each row where its
    words begin (one more entry at the end)."""
    n = len(offsets) - 1
    none = np.zeros(0, np.int64)
    if not len(data):
        return data, none, none, np.zeros(n + 1, np.int64)
    low = _LOWER[data]
    mask = _IN_WORD[low]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = mask[inner]
    starts = np.flatnonzero(first)
    if not len(starts):
        return data[:0], none, none, np.zeros(n + 1, np.int64)
    kept = low[mask]
    begin = np.flatnonzero(first[mask])
    return kept, begin, np.diff(np.append(begin, len(kept))), np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word, and for each row where its words begin (one more entry at the end)."""
    kept, begin, length, bounds = cut_words(data, offsets)
    return run_hashes(kept, begin, length), bounds


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive words, whatever rows they are in."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    mul = powers(k + 1, 0xD6E8FEB86659FD93)
    out = h[:n] * mul[1]
    for j in range(1, k):
        out += h[j : j + n] * mul[j + 1]
    return mix(out)


def shingle_sets(h: np.ndarray, bounds: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; a row of fewer words, but some, has one."""
    g, out = grams(h, k), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(grams(h[a:b], b - a) ^ U64(b - a))
        else:
            out.append(np.zeros(0, U64))
    return out
