"""Connected components by alternating large-star and small-star rounds, all in DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import materialise


def parts_of(linked: np.ndarray) -> np.ndarray:
    """The smallest member that each member reaches, by a square of links."""
    m = len(linked)
    if m == 2:
        return np.array([0, 0 if linked[0, 1] else 1])
    root = np.arange(m)
    while True:  # smallest root over neighbours, with pointer jumping
        new = np.minimum(np.where(linked, root[None, :], m).min(axis=1, initial=m), root)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60, kind: str = "bigint") -> DataFrame:
    """edges(u, v) -> (node, component): the smallest node that each node of an edge reaches. kind: the type of nodes.

    Rows with a null end, loops and repeated edges change nothing; an empty table gives an empty one. A star's
    centre may have any degree: minima are pre-aggregated and the join back on the centre is one that AQE splits.
    Each round is written to the shared folder, so lineage stays short. Raises after max_rounds without a fixpoint
    (rounds grow with the square of the logarithm of the longest path).
    """
    edges = materialise(edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").cast(kind).alias("u"), F.least("u", "v").cast(kind).alias("v")).distinct())
    before = _state(edges)
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = materialise(small.filter("u <> v").distinct())
        after = _state(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after
    raise RuntimeError(f"no fixpoint in {max_rounds} rounds")
