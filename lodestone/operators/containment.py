"""Joins of texts that contain each other, without comparing all with all.

A text that contains another one has all its q-grams. Each needle is looked up by its rarest q-gram only (in how many
haystacks, counted exactly), so candidates are few even where most grams are common; then the containment is checked. Needles
of fewer than q characters are looked up by themselves, among the grams of their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.scratch import materialise

#: Rows of a broadcast side, at most.
BROADCAST_ROWS = 1_000_000


def _grams(text: Column, q: Column) -> Column:
    """The distinct grams of q characters; none of a shorter text."""
    last = F.length(text) - q + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, q)))).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, needle: str, haystacks: DataFrame, haystack: str, q: int = 4) -> DataFrame:
    """All columns of both sides, for each haystack that contains the needle. Columns must have different names. Null and
    empty needles and null haystacks join with nothing; rows that repeat are each joined."""
    width = F.least(F.length("__n"), F.lit(q))
    own = materialise(needles.select(F.col(needle).alias("__n")).filter("__n <> ''").distinct().select("__n", width.alias("__w"), F.explode(_grams(F.col("__n"), width)).alias("__g")))
    wanted = own.select("__g").distinct()
    widths = sorted(r[0] for r in own.select("__w").distinct().collect())  # q at most
    small = wanted.count() <= BROADCAST_ROWS
    texts = haystacks.select(F.col(haystack).alias("__h")).filter("__h IS NOT NULL").distinct()
    every = F.flatten(F.array(*(_grams(F.col("__h"), F.lit(w)) for w in widths))) if widths else F.array().cast("array<string>")
    found = materialise(texts.select("__h", F.explode(every).alias("__g")).join(F.broadcast(wanted) if small else wanted, "__g", "left_semi"))
    counts = found.groupBy("__g").agg(F.count("*").alias("c"))
    rarest = own.join(counts, "__g", "left").groupBy("__n").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), F.col("__g").alias("g"))).alias("r")).filter("r.c > 0").select("__n", F.col("r.g").alias("__g"))
    pairs = rarest.join(found, "__g").filter(F.contains("__h", "__n")).select("__n", "__h")
    out = pairs.withColumnsRenamed({"__n": needle, "__h": haystack}).join(needles, needle).join(haystacks, haystack)
    return out.select(*needles.columns, *haystacks.columns)


def either_way(a: DataFrame, x: str, b: DataFrame, y: str, q: int = 4) -> DataFrame:
    """The distinct pairs of rows of which one's text contains the other's."""
    order = [*a.columns, *b.columns]
    return containing(a, x, b, y, q).select(*order).union(containing(b, y, a, x, q).select(*order)).distinct()
