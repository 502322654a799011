"""Grouped maps over sorted partitions, and bins of candidate pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._text import tidy
from lodestone.operators.scratch import materialise, scratch_dir

__all__ = ["grouped_arrays", "grouped_map", "materialise", "pair_bins", "scratch_dir"]


def _dealt(df: DataFrame, keys: list[str], slots: tuple[Column, int] | None) -> DataFrame:
    """The rows of a key together and in order; by a hash, or slots[0] (the same for all rows of a key) modulo slots[1]."""
    parts = df.repartition(*keys) if slots is None else df.repartitionById(slots[1], F.pmod(slots[0], F.lit(slots[1])).cast("int"))
    return parts.sortWithinPartitions(*keys)


def grouped_map(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, slots: tuple[Column, int] | None = None) -> DataFrame:
    """fn over the rows of each key. Like applyInPandas, but one Python call takes many small groups, and its
    memory is one group and one Arrow batch: the rows arrive sorted, so Spark's sort spills instead."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            change = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
            change[0] = not held or bool((held[-1][keys].iloc[-1] != pdf[keys].iloc[0]).any())
            cuts = [*change.nonzero()[0].tolist(), len(pdf)]
            if cuts[0] > 0:
                held.append(pdf.iloc[: cuts[0]])
            done = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if held:
                    done.append(fn(pd.concat(held) if len(held) > 1 else held[0]))
                held = [pdf.iloc[a:b]]
            if done := [x for x in done if len(x)]:
                yield pd.concat(done)
            tidy()
        if held:
            yield fn(pd.concat(held) if len(held) > 1 else held[0])

    return _dealt(df, keys, slots).mapInPandas(run, schema)


def grouped_arrays(df: DataFrame, keys: list[str], fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray] | None], schema: str, slots: tuple[Column, int] | None = None) -> DataFrame:
    """grouped_map for many tiny groups: fn takes and gives arrays by column name, without pandas for each group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] | None = None
        for pdf in batches:
            if not len(pdf):
                continue
            cols = {c: pdf[c].to_numpy() for c in pdf.columns}
            if held is not None:
                cols = {c: np.concatenate([held[c], cols[c]]) for c in cols}
            n = len(next(iter(cols.values())))
            change = np.zeros(n, dtype=bool)
            change[0] = True
            for k in keys:
                change[1:] |= cols[k][1:] != cols[k][:-1]
            cuts = np.flatnonzero(change).tolist()
            done = [x for a, b in zip(cuts[:-1], cuts[1:]) if (x := fn({c: v[a:b] for c, v in cols.items()})) is not None]
            held = {c: v[cuts[-1] :] for c, v in cols.items()}
            if done:
                yield pd.DataFrame({c: np.concatenate([d[c] for d in done]) for c in done[0]})
            tidy()
        if held is not None and (x := fn(held)) is not None:
            yield pd.DataFrame(x)

    return _dealt(df, keys, slots).mapInPandas(run, schema)


def label_groups(classes: DataFrame, key: str, labels: str) -> DataFrame:
    """tab, lab, m, s1, s2: of each label that several classes have in a table how many do, and sums that tell who.
    A label of 0 is none."""
    each = classes.select(key, F.posexplode(labels).alias("tab", "lab")).filter("lab <> 0")
    return each.groupBy("tab", "lab").agg(F.count("*").alias("m"), F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias("s1"), F.sum(F.xxhash64(F.col(key), F.lit(7)).cast("decimal(38,0)")).alias("s2")).filter("m > 1")


def pair_bins(classes: DataFrame, key: str, labels: str, block: int, groups: DataFrame | None = None) -> DataFrame:
    """Bins of at most about 2*block members that together hold every pair of classes with an equal label.

    classes: one row per class with a bigint key and an array of labels, one per table (0: none). Members with equal
    labels in a table form a group; groups of the same members in several tables are one. A group of more than `block`
    members is dealt into blocks, and each two blocks meet in one bin, so no task gets an unbounded group and no
    pair is emitted. Returns tab, lab, i, j (the bin), slot (bins of a group have consecutive ones), blk (the member's
    block) and the key.
    """
    groups = label_groups(classes, key, labels) if groups is None else groups
    each = classes.select(key, F.posexplode(labels).alias("tab", "lab"))
    bins = groups.groupBy("m", "s1", "s2").agg(F.min(F.struct("tab", "lab")).alias("b")).select("b.*", F.ceil(F.col("m") / block).cast("int").alias("n_blk"))
    dealt = each.join(bins, ["tab", "lab"]).select(key, "tab", "lab", "n_blk", F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.col("n_blk")).cast("int").alias("blk"))
    pairs = dealt.select(key, "tab", "lab", "blk", "n_blk", F.explode(F.sequence(F.lit(0), F.col("n_blk") - 1)).alias("o"))
    i, j = F.least("blk", "o").cast("bigint"), F.greatest("blk", "o")
    slot = F.pmod(F.xxhash64("tab", "lab"), F.lit(1 << 40)) + (i * (2 * F.col("n_blk") - i - 1) / 2).cast("bigint") + j
    return pairs.select(key, "tab", "lab", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), slot.alias("slot"), "blk")


def bin_slots(members: DataFrame, rows: int = 512) -> tuple[Column, int]:
    """How to deal the bins of a written table of members to tasks: in turn, to as many as there are `rows` of rows,
    at most spark.sql.shuffle.partitions. By a hash, several large bins would meet in one task."""
    most = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.col("slot"), max(1, min(most, -(-members.count() // rows)))
