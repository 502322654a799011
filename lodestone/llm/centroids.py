"""Centroid clustering: Lloyd's rounds with Elkan's bounds, in exact integers.

Vectors are turned into integers, floor(scale * x). Each vector keeps an upper bound of the distance to its own centroid and
a lower bound of that to each of the k centroids. When centroids move, bounds move by as much; half the distance
between two centroids tells where the own one must be nearest. Only what neither bound excludes is computed, as an
exact integer. Bounds are doubles that are rounded outwards at each step, and a centroid is skipped only if it is
strictly farther, so results, ties (to the smaller number) included, are those of computing all distances.

A round is one walk over the written vectors: each task moves the bounds, assigns anew and writes its vectors, and with
them the sums and numbers of its vectors by cluster. Sums are cut into limbs of 32 bits, which Spark adds up as
decimals, so they are exact whatever their size; the driver gets k centroids. Folders of rounds before the last are removed.

Vectors of another length than `dim`, null ones, and those with a null or non-finite component are left out. Vectors
with components of 2^26 and more are computed with Python's integers, beside the others. A distance, or sum of
distances, that passes 64 bits is null. Rows that repeat are each a vector. Initial centroids are the k vectors with the
smallest hash of their id; those with a null id come last, and ties of a repeated id go by the vectors' bytes. With fewer
than k vectors there are as many clusters as vectors; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from lodestone.llm._spark import materialise, scratch_dir
from lodestone.llm._text import tidy
from lodestone.operators.scratch import discard

#: Components below this are added and squared in 64 bits, for up to 512 of them.
NARROW = 1 << 26
_LIMB = 32
STATE = "vec_id bigint, x binary, wide array<string>, own int, upper double, lower binary, sums array<struct<cluster:int,dim:int,limb:int,v:bigint>>"


def _integer(x: float, scale: int) -> int:
    return math.floor(Fraction(x) * scale)


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to c: in 64 bits where both are narrow, else as Python's integers."""
    if x.dtype == object or c.dtype == object:
        d = x.astype(object) - c.astype(object)
        return (d * d).sum(axis=1) if len(d) else np.zeros(0, object)
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def _narrowed(rows: list[list[int]], dim: int) -> np.ndarray:
    """An int64 array if all fits, else one of Python's integers."""
    if all(-NARROW < v < NARROW for r in rows for v in r):
        return np.array(rows, np.int64).reshape(len(rows), dim)
    out = np.empty((len(rows), dim), object)
    for i, r in enumerate(rows):
        out[i] = r
    return out


def roots(d2: np.ndarray, up: bool) -> np.ndarray:
    """Doubles that are not below (up) or not above the square roots of exact integers."""
    if d2.dtype == object:
        most = np.finfo(np.float64).max
        r = [math.isqrt(int(v)) + (1 if up else 0) for v in d2]
        out = np.array([(np.inf if up else most) if v > int(most) else float(v) for v in r], np.float64).reshape(len(r))
    else:
        out = np.sqrt(d2.astype(np.float64))
    for _ in range(2):  # one for the square's rounding, one for the root's
        out = np.nextafter(out, np.inf if up else -np.inf)
    return np.where(d2 == 0, 0.0, np.maximum(out, 0)) if not up else out


class Centroids:
    """k centroids with what the bounds need: half the distances between them, and how far each has moved."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None):
        dim = len(rows[0])
        self.k = len(rows)
        self.at = [_narrowed([r], dim)[0] for r in rows]
        self.half = np.zeros((self.k, self.k))
        for j in range(self.k):
            for i in range(j):
                d2 = _squares(self.at[i][None, :], self.at[j])
                self.half[i, j] = self.half[j, i] = np.nextafter(roots(d2, False)[0] / 2, 0)
        moved = [_squares(_narrowed([b], dim), a) for b, a in zip(before or rows, self.at)]
        self.shift = np.array([roots(m, True)[0] if m[0] else 0.0 for m in moved])

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """own, upper and lower after these centroids have come, and how many distances were computed."""
        lower = np.maximum(0, np.nextafter(lower - self.shift[None, :], -np.inf))
        upper = np.where(self.shift[own] > 0, np.nextafter(upper + self.shift[own], np.inf), upper)
        other = self.half + np.where(np.eye(self.k, dtype=bool), np.inf, 0)
        todo = np.flatnonzero(~(upper < other.min(axis=1)[own]))
        own, done = own.copy(), 0
        if not len(todo):
            return own, upper, lower, done
        exact = np.zeros(len(x), object if x.dtype == object or any(c.dtype == object for c in self.at) else np.int64)
        open_ = np.zeros(len(x), bool)  # the own distance is not known yet
        open_[todo] = True

        def known(rows: np.ndarray) -> int:
            rows = rows[open_[rows]]
            for j in np.unique(own[rows]):
                r = rows[own[rows] == j]
                d2 = _squares(x[r], self.at[j])
                exact[r], upper[r] = d2, roots(d2, True)
                lower[r, j] = roots(d2, False)
            open_[rows] = False
            return len(rows)

        for j in range(self.k):
            maybe = lambda r: (own[r] != j) & ~(upper[r] < lower[r, j]) & ~(upper[r] < self.half[own[r], j])  # noqa: E731, B023
            rows = todo[maybe(todo)]
            done += known(rows)
            rows = rows[maybe(rows)]
            if not len(rows):
                continue
            d2 = _squares(x[rows], self.at[j])
            done += len(rows)
            lower[rows, j] = roots(d2, False)
            nearer = (d2 < exact[rows]) | ((d2 == exact[rows]) & (j < own[rows]))
            win = rows[nearer]
            own[win], exact[win], upper[win] = j, d2[nearer], roots(d2[nearer], True)
        return own, upper, lower, done


def _limbs(totals: dict[tuple[int, int], int], counts: np.ndarray) -> list[dict]:
    """Sums by cluster and dimension in signed limbs; dimension -1 is the number of vectors, -2 the number of distances."""
    out = [{"cluster": c, "dim": -1, "limb": 0, "v": int(n)} for c, n in enumerate(counts) if n]
    for (c, d), v in totals.items():
        sign, v, limb = (-1 if v < 0 else 1), abs(v), 0
        while v:
            if part := v & ((1 << _LIMB) - 1):
                out.append({"cluster": c, "dim": d, "limb": limb, "v": sign * part})
            v >>= _LIMB
            limb += 1
    return out


def _rows_of(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """A column of equally long byte strings, without nulls, as the rows of a matrix."""
    flat = np.frombuffer(column.buffers()[2], kind) if len(column) else np.zeros(0, kind)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] // flat.itemsize if len(column) else 0
    return flat[first : first + len(column) * width].reshape(-1, width)


def _bytes_of(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a column of byte strings."""
    cuts = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(rows))])


def _read(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors: the narrow ones, then the others."""
    x, wide = batch.column(1), batch.column(2)
    rows = np.flatnonzero(np.array(x.is_valid()))
    if len(rows):
        yield rows, _rows_of(x.take(pa.array(rows)) if x.null_count else x, np.int64, dim)
    rows = np.flatnonzero(np.array(wide.is_valid()))
    if len(rows):
        full = np.empty((len(rows), dim), object)
        for i, r in enumerate(wide.take(pa.array(rows)).to_pylist()):
            full[i] = [int(v) for v in r]
        yield rows, full


def _round(state: DataFrame, now: list[list[int]], before: list[list[int]] | None, dim: int) -> DataFrame:
    k = len(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Centroids(now, before)
        totals: dict[tuple[int, int], int] = {}
        counts, done = np.zeros(k, np.int64), 0
        for batch in batches:
            n = batch.num_rows
            own = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int32)
            upper = batch.column(4).to_numpy(zero_copy_only=False).copy()
            lower = _rows_of(batch.column(5), np.float64, k).copy()
            for rows, x in _read(batch, dim):
                own[rows], upper[rows], lower[rows], d = c.assign(x, own[rows], upper[rows], lower[rows])
                done += d
                for j in np.unique(own[rows]):
                    for i, v in enumerate(x[own[rows] == j].sum(axis=0).tolist()):
                        totals[j, i] = totals.get((j, i), 0) + v
            counts += np.bincount(own, minlength=k)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(own), pa.array(upper), _bytes_of(lower), pa.nulls(n, sums)], names=names)
            tidy()
        none = pa.nulls(1)
        tail = _limbs({(int(j), i): v for (j, i), v in totals.items()} | ({(0, -2): done} if done else {}), counts)
        yield pa.RecordBatch.from_arrays([*(none.cast(t) for t in (pa.int64(), pa.binary(), pa.list_(pa.string()), pa.int32(), pa.float64(), pa.binary())), pa.array([tail], sums)], names=names)

    names = ["vec_id", "x", "wide", "own", "upper", "lower", "sums"]
    sums = pa.list_(pa.struct([("cluster", pa.int32()), ("dim", pa.int32()), ("limb", pa.int32()), ("v", pa.int64())]))
    return state.mapInArrow(run, STATE)


def _sums(state: DataFrame) -> dict[tuple[int, int], int]:
    """Exact sums by cluster and dimension."""
    parts = state.filter("sums IS NOT NULL").select(F.explode("sums").alias("s")).select("s.*")
    got = parts.groupBy("cluster", "dim", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out: dict[tuple[int, int], int] = {}
    for r in got:
        out[r["cluster"], r["dim"]] = out.get((r["cluster"], r["dim"]), 0) + (int(r["v"]) << (_LIMB * r["limb"]))
    return out


def integers(vecs: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id, and the integers of a kept vector: x (int64 as bytes) or, if one is not narrow, wide (decimal)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            size = v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(size == dim)
            flat = v.take(pa.array(rows)).flatten().fill_null(np.nan).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            fine = np.isfinite(flat).all(axis=1)
            rows, flat = rows[fine], flat[fine]
            narrow = (np.abs(flat) < NARROW / (2 * scale)).all(axis=1)
            ints = np.floor(np.where(narrow[:, None], flat, 0) * scale).astype(np.int64)
            x = pc.if_else(pa.array(narrow), _bytes_of(ints), pa.scalar(None, pa.binary()))
            wide = [None if ok else [str(_integer(u, scale)) for u in row] for ok, row in zip(narrow.tolist(), flat.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), x, pa.array(wide, pa.list_(pa.string()))], names=["vec_id", "x", "wide"])
            tidy()

    return vecs.mapInArrow(run, "vec_id bigint, x binary, wide array<string>")


def _vector(row) -> list[int]:
    return np.frombuffer(bytes(row["x"]), np.int64).tolist() if row["x"] is not None else [int(v) for v in row["wide"]]


def _distances(state: DataFrame, now: list[list[int]], dim: int) -> DataFrame:
    """vec_id, cluster and the exact distance, null if it passes 64 bits."""
    at = [_narrowed([r], dim)[0] for r in now]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, out = batch.column(3).to_numpy(zero_copy_only=False), [None] * batch.num_rows
            for rows, x in _read(batch, dim):
                for j in np.unique(own[rows]):
                    here = np.flatnonzero(own[rows] == j)
                    for i, d in zip(rows[here].tolist(), _squares(x[here], at[j]).tolist()):
                        out[i] = d if d < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(out, pa.int64())], names=["vec_id", "cluster", "distance"])
            tidy()

    return state.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def centroid_clusters(vecs: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 8, dim: int = 64, scale: int = 1024, rounds: int = 10, seed: int = 3, report: list | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. report gets the number of exact distances of
    each round."""
    spark = vecs.sparkSession
    kept = materialise(integers(vecs.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast(ArrayType(vecs.schema[embedding].dataType.elementType)).alias("v")), dim, scale))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast(BinaryType()), 256)
    ties = [F.col("vec_id").isNull(), h, F.col("wide").isNotNull()]
    least = kept.select("x", "wide", h.alias("h"), "vec_id").orderBy(*ties, "x", "wide").limit(k).collect()
    if not least:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    now, before = [_vector(r) for r in least], None
    zero = F.lit(bytes(8 * len(now)))
    state = kept.select("vec_id", "x", "wide", F.lit(0).alias("own"), F.lit(float("inf")).alias("upper"), zero.alias("lower"))
    last = None
    for i in range(rounds + 1):
        path = scratch_dir(spark)
        done = materialise(_round(state, now, before, dim), path)
        discard(spark, last)
        totals, last = _sums(done), path
        state = done.filter("sums IS NULL").select("vec_id", "x", "wide", "own", "upper", "lower")
        if report is not None:
            report.append(totals.get((0, -2), 0))
        if i < rounds:
            before, now = now, [[totals.get((c, d), 0) // n for d in range(dim)] if (n := totals.get((c, -1), 0)) else now[c] for c in range(len(now))]
    found = materialise(_distances(state, now, dim))
    discard(spark, last)
    each = {r["cluster"]: r for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("sum"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()}
    sums = [None if c not in each or each[c]["lost"] else int(each[c]["sum"]) for c in range(len(now))]
    total = None if any(r["lost"] for r in each.values()) else sum(s for s in sums if s is not None)
    long = lambda v: F.lit(v if v is not None and v < 1 << 63 else None).cast("bigint")
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    of = lambda values: F.get(F.array(*values), F.col("cluster"))
    return found.select("vec_id", "cluster", "distance", of(map(long, sums)).alias("cluster_inertia"), long(total).alias("inertia"), of(map(F.lit, shas)).alias("centroid_sha256"))
