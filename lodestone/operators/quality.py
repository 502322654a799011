"""Audits of a knowledge base: invariants, drift, duplicates, distributions, coverage. Each gives rows, not prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.relational import junk_name


def check(name: str, bad: DataFrame, column: str = "bad") -> DataFrame:
    """name, bad, passed of a one-row table with a number of bad rows."""
    return bad.select(F.lit(name).alias("check"), F.col(column).cast("bigint").alias("bad"), (F.col(column) == 0).alias("passed"))


def invariants(concepts: DataFrame, passages: DataFrame, keys: list[str], kinds: list[str]) -> DataFrame:
    """Keys that repeat, confidences out of range, unknown types, and concepts of passages that are not there. The
    first three are one pass over the concepts."""
    one = concepts.agg((F.count("*") - F.count_distinct(F.struct(*keys))).alias("repeated"), F.count_if((F.col("confidence") < 0) | (F.col("confidence") > 1) | F.col("confidence").isNull()).alias("range"), F.count_if(~F.col("concept_type").isin(*kinds)).alias("kind"))
    orphans = concepts.select("passage_id").join(passages.select("passage_id"), "passage_id", "left_anti").agg(F.count("*").alias("bad"))
    each = one.select(F.explode(F.array(F.struct(F.lit("repeated_keys").alias("check"), F.col("repeated").alias("bad")), F.struct(F.lit("confidence_range").alias("check"), F.col("range").alias("bad")), F.struct(F.lit("known_types").alias("check"), F.col("kind").alias("bad")))).alias("x"))
    return each.select("x.check", F.col("x.bad").cast("bigint").alias("bad"), (F.col("x.bad") == 0).alias("passed")).unionByName(check("orphans", orphans))


def coverage(rows: DataFrame, present: Column, least: float) -> DataFrame:
    """rows, with, percent, passed."""
    g = rows.agg(F.count("*").alias("rows"), F.count_if(present).alias("having"))
    return g.withColumn("percent", F.round(F.try_divide(100.0 * F.col("having"), F.col("rows")), 4)).withColumn("passed", F.col("percent") >= least)


def drift(stores: dict[str, DataFrame], key: str) -> DataFrame:
    """missing_in, n for each store: keys that some other store has. One shuffle by key for all stores."""
    names = list(stores)
    parts = None
    for i, n in enumerate(names):
        d = stores[n].select(key).distinct().withColumn("__s", F.lit(1 << i))
        parts = d if parts is None else parts.unionByName(d)
    seen = parts.groupBy(key).agg(F.bit_or("__s").alias("__s"))
    counts = seen.agg(*(F.count_if(F.col("__s").bitwiseAND(1 << i) == 0).alias(n) for i, n in enumerate(names)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("missing_in"), F.col(n).alias("n")) for n in names))).alias("x")).select("x.*")


def duplicate_report(docs: DataFrame, key: str, text: str, rank: Column) -> DataFrame:
    """hash, copies, kept: groups of equal texts and the key of the row that ranks first."""
    h = docs.select(key, F.sha2(F.col(text), 256).alias("hash"), rank.alias("__r"))
    g = h.groupBy("hash").agg(F.count("*").alias("copies"), F.min(F.struct("__r", key))[key].alias("kept"))
    return g.filter("copies > 1")


def concept_quality(concepts: DataFrame) -> DataFrame:
    """concepts, distinct names, share of junk names, means a passage."""
    g = concepts.agg(F.count("*").alias("concepts"), F.count_distinct("concept").alias("names"), F.count_if(junk_name(F.col("concept"))).alias("junk"), F.count_distinct("passage_id").alias("passages"))
    return g.select("concepts", "names", F.round(F.try_divide(100.0 * F.col("junk"), F.col("concepts")), 4).alias("junk_percent"), F.round(F.try_divide(F.col("concepts") * 1.0, F.col("passages")), 4).alias("per_passage"))


def coverage_status(titles: Column, concepts: Column, code: Column) -> Column:
    most = F.greatest(titles, concepts)
    return F.when((most == 0) & (code == 0), "missing").when((most < 5) & (code < 2), "thin").otherwise("ok")


def grade(share: Column) -> Column:
    return F.when(share >= 0.9, "A").when(share >= 0.8, "B").when(share >= 0.7, "C").otherwise("F")


def latency_report(runs: DataFrame, by: str, seconds: str, failed: Column, concepts: str | None = None) -> DataFrame:
    """by, runs, failure_rate in percent, mean_ms, p95_ms (the value at place floor(0.95 n) of the sorted ones, from 0),
    mean_concepts of the runs that did not fail, and runs a minute, were they run one after the other."""
    w = Window.partitionBy(by)
    rows = runs.select(by, F.col(seconds).alias("__s"), failed.alias("__f"), (F.col(concepts) if concepts else F.lit(0)).alias("__c"))
    ranked = rows.withColumn("__r", F.row_number().over(w.orderBy("__s")) - 1).withColumn("__n", F.count("*").over(w))
    p95 = F.max(F.when(F.col("__r") == F.floor(F.col("__n") * 0.95), F.col("__s")))
    return ranked.groupBy(by).agg(
        F.count("*").alias("runs"), F.round(F.avg(F.col("__f").cast("double")) * 100, 1).alias("failure_rate"), F.round(F.avg("__s") * 1000, 1).alias("mean_ms"), F.round(p95 * 1000, 1).alias("p95_ms"),
        F.round(F.avg(F.when(~F.col("__f"), F.col("__c"))), 1).alias("mean_concepts"), F.round(F.count("*") / F.sum("__s") * 60, 1).alias("per_minute"))
