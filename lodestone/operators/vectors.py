"""Near-duplicate vectors in random-projection buckets, and an index of cells for exact nearest neighbours.

Vectors that are null, empty, zero or hold a null or non-finite component take part in nothing. Lengths must be equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators.relational import top_k
from lodestone.operators.scratch import materialise
from lodestone.operators.search import norm


def usable(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & (norm(v) > 0)


def _unit(column: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in column])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


#: Bins that one task call verifies.
BINS = 200


# -- near-duplicates ------------------------------------------------------------------------------------------------


def meeting_chance(width: float) -> float:
    """The chance that two points share a bucket of a random projection whose width is so many times their distance."""
    tail = math.erfc(width / math.sqrt(2))
    return 1 - tail - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-width * width / 2))


def tables_needed(width: float, projections: int, recall: float) -> int:
    """Tables in one of which a pair just at the threshold meets with the wanted chance."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meeting_chance(width) ** projections)))


def representatives(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key and rep: the smallest key of the rows with an equal vector. A copy of a vector is a row here and nowhere else."""
    fine = rows.filter(usable(vector)).select(key, vector)
    least = fine.groupBy(F.col(vector).alias("__v")).agg(F.min(key).alias("rep"))
    return fine.join(least, fine[vector] == least["__v"]).select(key, "rep")


def near_pairs(rows: DataFrame, key: str, vector: str, threshold: float = 0.99, recall: float = 0.999, width: float = 4.0, projections: int = 8, block: int = 1024, seed: int = 11) -> DataFrame:
    """a, b, score: the pairs of different vectors, each by its smallest key, with at least this cosine; a < b.

    A pair at the threshold is at most sqrt(2 - 2 * threshold) apart on the unit sphere. Buckets of `projections` random
    projections, `width` times as wide, are a table; there are as many tables as the recall needs. A bucket of more
    than `block` vectors is dealt into blocks, and each two blocks meet in one bin, so that no task gets an unbounded
    group; a pair leaves only the first table in which it meets. Pairs found are verified by their cosine."""
    reach = math.sqrt(2 - 2 * threshold)
    tables = tables_needed(width, projections, recall)
    fine = rows.filter(usable(vector)).groupBy(F.col(vector).alias("v")).agg(F.min(key).alias("key"))
    kind = dict(rows.dtypes)[key]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = _unit(pdf["v"])
            r = np.random.default_rng([seed, x.shape[1]])
            planes, shift = r.standard_normal((tables * projections, x.shape[1])), r.random(tables * projections)
            odd = r.integers(0, 1 << 63, projections, dtype=np.int64) | 1
            cell = np.floor(x @ planes.T / (width * reach) + shift).astype(np.int64).reshape(len(x), tables, projections)
            with np.errstate(over="ignore"):
                labels = (cell * odd).sum(axis=2)
            yield pd.DataFrame({"key": pdf["key"], "v": pdf["v"], "labels": list(labels)})

    labelled = materialise(fine.mapInPandas(label, f"key {kind}, v {dict(rows.dtypes)[vector]}, labels array<bigint>"))
    each = labelled.select("key", F.posexplode("labels").alias("tab", "label"))
    crowds = each.groupBy("tab", "label").agg(F.count("*").alias("n")).filter("n > 1").select("tab", "label", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    crowds = materialise(crowds)
    dealt = each.join(crowds, ["tab", "label"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    bins = dealt.select("key", "tab", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    bins = bins.select("key", "tab", "label", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def verify(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["tab", "label", "i", "j", "key"], kind="stable")
        names = g[["tab", "label", "i", "j"]].to_numpy()
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(g)]
        units, every, own, keys = _unit(g["v"]), np.stack(g["labels"].to_numpy()), g["own"].to_numpy(), g["key"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at, end in zip(cuts[:-1], cuts[1:]):
            x, labels, (tab, _, i, j) = units[at:end], every[at:end], names[at]
            s = x @ x.T
            fits = np.triu(s >= threshold, 1)
            if i != j:
                fits &= own[at:end, None] != own[None, at:end]
            a, b = np.nonzero(fits)
            new = (labels[a, :tab] != labels[b, :tab]).all(axis=1)
            a, b = a[new], b[new]
            out.append((keys[at:end][a], keys[at:end][b], s[a, b]))
        a, b, s = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"a": a, "b": b, "score": s})

    # some bins, which are bounded each, are one call
    slots = max(1, (crowds.agg(F.coalesce(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2), F.lit(0.0))).first()[0] // BINS))
    slot = F.pmod(F.xxhash64("tab", "label", "i", "j"), F.lit(int(slots)))
    return bins.join(labelled, "key").groupBy(slot.alias("slot")).applyInPandas(verify, f"a {kind}, b {kind}, score double")


# -- nearest neighbours ---------------------------------------------------------------------------------------------

#: Rounding of distances of unit vectors in double precision, with room to spare.
_SLACK = 1e-7


class CellIndex:
    """An inverted file: each vector is stored in the cell of its nearest centre, with its distance to it. A search reads
    the nearest cells of a query first; of the others, by the triangle inequality, only those that can hold a nearer
    vector than the k-th found so far, and in them only such vectors. So results are exact."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | None = None):
        """An index that build() wrote; schema: of its rows, needed only where it may be empty."""
        self.spark, self.path, self.schema = spark, path, schema
        self.read: list[int] = []  # pairs of query and cell that searches have read, and that there are

    @staticmethod
    def build(rows: DataFrame, key: str, vector: str, path: str, cells: int | None = None, sample: int = 20_000, rounds: int = 8, files: int = 4) -> CellIndex:
        """Centres are fitted on at most about `sample` vectors (a bound on labelled work, by hash of the key); every
        vector is indexed. A cell is written by up to `files` tasks, so a large one is no single task."""
        spark = rows.sparkSession
        fine = rows.filter(usable(vector)).select(F.col(key).alias("key"), F.col(vector).alias("v"))
        n = fine.count()
        share = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))
        got = fine.filter(share).orderBy("key").limit(2 * sample).toPandas()
        centres = _centres(_unit(got["v"]) if len(got) else np.zeros((0, 1)), cells or max(1, min(1024, int(math.sqrt(n)))), rounds)
        sent = spark.sparkContext.broadcast(centres)

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    d = _distances(_unit(pdf["v"]), sent.value)
                    cell = d.argmin(axis=1)
                    yield pdf.assign(cell=cell, d=d[np.arange(len(d)), cell])

        kinds = dict(fine.dtypes)
        placed = fine.mapInPandas(assign, f"key {kinds['key']}, v {kinds['v']}, cell int, d double")
        placed.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(files))).write.partitionBy("cell").parquet(f"{path}/rows")
        index = CellIndex(spark, path, placed.schema)
        known = index.rows().groupBy("cell").agg(F.max("d").alias("far"), F.min("d").alias("near"), F.count("*").alias("n"))
        table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
        table.join(known, "cell").write.parquet(f"{path}/cells")
        return index

    def rows(self) -> DataFrame:
        read = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return read.parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, qkey: str, qvector: str, k: int, probe: int = 4) -> DataFrame:
        """qkey, key, score, rank of the k nearest rows to each query, ties by key."""
        cells = self.spark.read.parquet(f"{self.path}/cells").orderBy("cell").toPandas()  # at most the number of centres
        asked = materialise(queries.filter(usable(qvector)).select(F.col(qkey).alias("q"), F.col(qvector).alias("qv")))
        kinds, n = dict(asked.dtypes), asked.count()
        slots, parts = _slots(cells["n"].tolist())
        sent = self.spark.sparkContext.broadcast((np.array(cells["centre"].tolist(), np.float64), cells["cell"].to_numpy(), cells["far"].to_numpy(), cells["near"].to_numpy(), np.array(slots)))

        def plan(first: bool):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                centres, names, far, near, slot = sent.value
                for pdf in batches:
                    if not len(pdf) or not len(names):
                        continue
                    d = _distances(_unit(pdf["qv"]), centres)
                    order = np.argsort(d, axis=1, kind="stable")
                    wanted = np.zeros(d.shape, bool)
                    np.put_along_axis(wanted, order[:, :probe], True, axis=1)
                    if not first:
                        # a k-th cosine of s is a distance of sqrt(2 - 2 s); queries with fewer rows so far look everywhere
                        limit = np.sqrt(np.maximum(0, 2 - 2 * pdf["least"].fillna(-np.inf).to_numpy()))[:, None] + _SLACK
                        wanted = ~wanted & (d - far <= limit) & (near - d <= limit)
                    a, c = np.nonzero(wanted)
                    if not len(a):
                        continue
                    start = np.flatnonzero(np.r_[True, (np.diff(a) != 0) | (np.diff(slot[c]) != 0)])  # one row a query and slot
                    at = a[start]
                    yield pd.DataFrame({"q": pdf["q"].to_numpy()[at], "qv": pdf["qv"].to_numpy()[at], "slot": slot[c[start]], "cells": np.split(names[c], start[1:]), "least": np.nan if first else pdf["least"].to_numpy()[at]})

            return run

        shape = f"q {kinds['q']}, qv {kinds['qv']}, slot int, cells array<int>, least double"
        probes = materialise(asked.mapInPandas(plan(True), shape))
        dealt = self.spark.createDataFrame([(int(c), s, parts[s]) for c, s in zip(cells["cell"], slots)], "cell int, slot int, parts int")
        best = materialise(top_k(self._nearest(probes, dealt, n, k), ["q"], [F.desc("score"), F.asc("key")], k, "rank"))
        kth = best.filter(F.col("rank") == k).select("q", F.col("score").alias("least"))
        more = materialise(asked.join(kth, "q", "left").mapInPandas(plan(False), shape))
        pairs = probes.unionByName(more).agg(F.coalesce(F.sum(F.size("cells")), F.lit(0))).first()[0]
        self.read = [pairs, n * len(cells)]
        both = best.drop("rank").unionByName(self._nearest(more, dealt, n, k))
        out = top_k(both, ["q"], [F.desc("score"), F.asc("key")], k, "rank")
        return out.select(F.col("q").alias(qkey), "key", "score", F.col("rank").cast("bigint").alias("rank"))

    def _nearest(self, wanted: DataFrame, dealt: DataFrame, asked: int, k: int) -> DataFrame:
        """q, key, score: of the rows in the wanted cells of a slot the k best by query, if they reach its k-th score so far.
        A block of queries meets a slot of rows in one call; both are bounded, so a hot cell is many calls."""
        rows, blocks = self.rows(), max(1, math.ceil(asked / SLOT))
        kinds = dict(rows.dtypes)
        read = [r["c"] for r in wanted.select(F.explode("cells").alias("c")).distinct().collect()]  # at most the number of centres
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        rows = rows.filter(F.col("cell").isin(*read)).join(F.broadcast(dealt), "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("block", every(F.lit(blocks)))
        wanted = wanted.join(F.broadcast(dealt.select("slot", "parts").distinct()), "slot").withColumn("part", every(F.col("parts"))).withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
        shape = f"q {dict(wanted.dtypes)['q']}, key {kinds['key']}, score double"

        of = ["slot", "part", "block"]
        return wanted.drop("parts").groupBy(*of).cogroup(rows.drop("parts", "d").groupBy(*of)).applyInPandas(lambda w, h: _best(w, h, k), shape)


#: Rows of a slot, and queries of a block, about.
SLOT = 8_192
#: Cosines that are held at once.
_HELD = 1 << 19


def _slots(sizes: list[int]) -> tuple[list[int], list[int]]:
    """The slot of each cell, and of each slot into how many parts its rows are dealt: more than one for a large cell."""
    slots, parts, held = [], [], 0
    for n in sizes:
        if not parts or held + n > SLOT:
            parts.append(0)
            held = 0
        held += n
        slots.append(len(parts) - 1)
        parts[-1] = math.ceil(held / SLOT)
    return slots, parts


def _best(want: pd.DataFrame, have: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of each query of one block and slot. Products of matrices choose candidates, with room for their
    rounding; cosines are summed as Spark's expression does it, so equal vectors get equal scores wherever they stand."""
    if not len(want) or not len(have):
        return pd.DataFrame({"q": [], "key": [], "score": []})
    have = have.sort_values("key", na_position="first", kind="stable")
    # of equal vectors those with the k smallest keys are enough
    nth = pd.Series([np.asarray(v).tobytes() for v in have["v"]]).to_frame("v").groupby("v").cumcount().to_numpy()
    have = have[nth < k]
    q, v = (np.array([np.asarray(x, dtype=np.float64) for x in c]) for c in (want["qv"], have["v"]))
    qn, vn = (np.sqrt(_summed(x, x)) for x in (q, v))
    qu, vu, least, cell = q / qn[:, None], v / vn[:, None], want["least"].fillna(-np.inf).to_numpy(), have["cell"].to_numpy()
    asks = pd.DataFrame({"at": np.repeat(np.arange(len(want)), want["cells"].map(len)), "cell": np.concatenate(want["cells"].tolist())}).groupby("cell")["at"]
    found = [(np.zeros(0, int), np.zeros(0, int))]
    for c, at in asks:
        own = np.flatnonzero(cell == c)
        at, step = at.to_numpy(), max(1, _HELD // max(1, len(own)))
        for i in range(0, len(at) if len(own) else 0, step):
            some = at[i : i + step]
            s = qu[some] @ vu[own].T
            hits = s >= least[some, None] - _SLACK
            if len(own) > k and hits.sum() > 2 * k * len(some):
                hits &= s >= np.partition(s, len(own) - k, axis=1)[:, len(own) - k, None] - _SLACK
            a, b = np.nonzero(hits)
            found.append((some[a], own[b]))
    a, b = (np.concatenate(x) for x in zip(*found))
    score = np.concatenate([np.zeros(0), *(_summed(q[a[i : i + _HELD // 8]], v[b[i : i + _HELD // 8]]) for i in range(0, len(a), _HELD // 8))]) / (qn[a] * vn[b])
    order = np.lexsort((b, -score, a))  # rows stand in the order of their keys
    a, b, score = a[order], b[order], score[order]
    first = np.searchsorted(a, a) + k > np.arange(len(a))
    return pd.DataFrame({"q": want["q"].to_numpy()[a[first]], "key": have["key"].to_numpy()[b[first]], "score": score[first]})


def _summed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of rows, added from the first component to the last."""
    out = np.zeros(len(x))
    for i in range(x.shape[1]):
        out += x[:, i] * y[:, i]
    return out


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T))


def _centres(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Means of a few rounds of k-means from points that are spread over the sample."""
    at = x[np.unique(np.linspace(0, max(len(x) - 1, 0), min(k, len(x))).astype(int))] if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(rounds if len(x) else 0):
        own = _distances(x, at).argmin(axis=1)
        n = np.bincount(own, minlength=len(at))
        sums = np.zeros_like(at)
        np.add.at(sums, own, x)
        at = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], at)
    return at
