"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosine, connected components.

Vectors are normalised in double precision. Equal vectors form a class first, so a group of copies is one row. The
signs of `bits` random projections are a class's label in a table; there are as many tables as a pair at the
threshold needs to meet in one of them with the target recall, and bits grow with the logarithm of the number of
classes: a class expects 1 / 32 strangers in its bucket, at any size, so hardly a vector is sent for nothing. Classes that meet are compared by their cosine, in blocks; pairs
leave a task only as numbers of links and as edges to the root of their part.

A vector that is null, empty, zero or holds a null or non-finite component links with nothing; vectors of different
lengths never link. A null vec_id has null component_id and no links. Rows that repeat a vec_id are one vector in
component ids, and each counts as a row in n_links. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import bin_slots, grouped_arrays, materialise, pair_bins
from lodestone.llm._text import U64, mix
from lodestone.llm.components import components, parts_of


def tables_for(threshold: float, bits: int, recall: float) -> int:
    same = 1 - math.acos(threshold) / math.pi
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - same**bits)))


@lru_cache(maxsize=4)
def _planes(dim: int, tables: int, bits: int) -> np.ndarray:
    """One row for each bit, so that those of the first tables are one piece of memory."""
    return np.random.default_rng([dim, 977]).standard_normal((tables * bits, dim))


def _unit(vec: list | np.ndarray | None) -> np.ndarray | None:
    if vec is None or not len(vec):
        return None
    v = np.array([np.nan if x is None else x for x in vec], dtype=np.float64)
    if not np.isfinite(v).all():
        return None
    v = v / (np.abs(v).max() or 1)
    norm = math.sqrt(float(v @ v))
    return v / norm if norm > 0 else None


def _prepared(vecs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [_unit(v) for v in batch.column(1).to_pylist()]
            raw = [None if u is None else u.tobytes() for u in units]
            prints = np.array([0 if u is None else int(mix(u.view(U64) * (2 * np.arange(len(u), dtype=U64) + U64(1))).sum(dtype=U64).view(np.int64)) for u in units], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), pa.array(raw, pa.binary())], names=["vec_id", "fp", "unit"])

    return vecs.mapInArrow(run, "vec_id bigint, fp bigint, unit binary")


def _labelled(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for a in range(0, len(whole), 1000):
                pdf = whole.iloc[a : a + 1000]
                labels: list = [None] * len(pdf)
                dims = np.array([len(u) // 8 for u in pdf["unit"]])
                for dim in np.unique(dims):
                    rows = np.flatnonzero(dims == dim)
                    x = np.frombuffer(b"".join(pdf["unit"].iloc[rows]), dtype=np.float64).reshape(len(rows), dim)
                    for r, c in zip(rows, _codes(x, tables, bits, tables)):
                        labels[r] = c
                yield pd.DataFrame({"cid": pdf["cid"], "labels": labels})

    return classes.select("cid", "unit").mapInPandas(run, "cid bigint, labels array<bigint>")


def _codes(x: np.ndarray, tables: int, bits: int, first: int) -> np.ndarray:
    """The labels of vectors of one length in the first so many tables."""
    signs = (x @ _planes(x.shape[1], tables, bits)[: first * bits].T > 0).reshape(len(x), first, bits)
    return (signs @ (1 << np.arange(bits)).astype(np.int64)) ^ (x.shape[1] << 48) | 1 << 46


def _verify(threshold: float, tables: int, bits: int):
    def run(g: dict[str, np.ndarray]) -> dict[str, np.ndarray] | None:
        x = np.frombuffer(b"".join(g["unit"]), dtype=np.float64).reshape(len(g["cid"]), -1)
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        if g["i"][0] != g["j"][0]:
            linked &= g["blk"][:, None] != g["blk"][None, :]
        t = int(g["tab"][0])
        if not linked.any():
            return None
        if t:
            labels = _codes(x, tables, bits, t)
            if len(x) == 2:
                if (labels[0] == labels[1]).any():
                    return None
            else:
                for earlier in range(t):
                    linked &= labels[:, earlier][:, None] != labels[:, earlier][None, :]
        links = linked @ g["mult"]
        some = links > 0
        return {"cid": g["cid"][some], "links": links[some], "root": g["cid"][parts_of(linked)][some]} if some.any() else None

    return run


def embedding_near_dedup(vecs: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = 0.95, recall: float = 0.9999, per_bucket: float = 1 / 32, block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept. recall: of a pair just at the threshold, by the tables together."""
    rows = materialise(_prepared(vecs.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))))
    whole = F.sha2(F.col("unit"), 256)
    named = rows.filter("unit IS NOT NULL AND vec_id IS NOT NULL")
    classes = named.groupBy("fp", "unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")).select(F.xxhash64(whole).alias("cid"), "rep", "mult", "unit")
    classes = materialise(classes)
    bits = min(44, max(8, math.ceil(math.log2(max(2, classes.count()) / per_bucket))))
    tables = tables_for(threshold, bits, recall)
    members = materialise(pair_bins(materialise(_labelled(classes, tables, bits)), "cid", "labels", block))
    binned = members.join(classes.select("cid", "mult", "unit"), "cid")
    found = materialise(grouped_arrays(binned, ["tab", "lab", "i", "j"], _verify(threshold, tables, bits), "cid bigint, links bigint, root bigint", bin_slots(members)))
    reps = classes.select("cid", "rep")
    edges = found.filter("cid <> root").select("cid", "root").distinct().join(reps.select("cid", F.col("rep").alias("u")), "cid").join(reps.select(F.col("cid").alias("root"), F.col("rep").alias("v")), "root").select("u", "v")
    again = named.groupBy("vec_id").agg(F.count_distinct("fp").alias("n")).filter("n > 1").select("vec_id")
    edges = edges.union(named.join(again, "vec_id").select("fp", F.xxhash64(whole).alias("cid"), F.col("vec_id").alias("u")).join(reps, "cid").select("u", F.col("rep").alias("v")))
    part = components(edges)
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    of_class = materialise(classes.join(links, "cid", "left").join(part, classes["rep"] == part["node"], "left").select("cid", F.coalesce("component", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links")))
    out = rows.select("vec_id", F.xxhash64(whole).alias("cid")).join(of_class, "cid", "left")
    of = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("bigint").alias("n_links"), of.alias("component_id"), (F.col("vec_id").isNull() | (of == F.col("vec_id"))).alias("kept"))
