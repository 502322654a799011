"""Writers: tables with upserts, training exports, graph dumps and reports.

A table that is upserted is a folder of numbered versions; readers take the newest one that is complete. So a job that
is broken off leaves the table as it was, and one that runs again writes the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import relational as R


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        v = self._versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{v[-1]}") if v else self.spark.createDataFrame([], self.schema)

    def replace(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """Writes change(the table) as the next version, and returns its number."""
        n = max(self._versions(), default=0) + 1
        change(self.read()).write.mode("overwrite").parquet(f"{self.path}/v{n}")
        return n

    def upsert(self, new: DataFrame, keys: list[str], order: str) -> int:
        return self.replace(lambda old: R.upsert_last(old, new, keys, order).select(*old.columns))

    def insert_ignore(self, new: DataFrame, keys: list[str], order: str) -> int:
        return self.replace(lambda old: R.insert_ignore(old, new, keys, order).select(*old.columns))

    def delete(self, ids: DataFrame, keys: list[str]) -> int:
        return self.replace(lambda old: old.join(ids.select(*keys), keys, "left_anti").select(*old.columns))


def write_all(df: DataFrame, path: str, formats: tuple[str, ...] = ("parquet", "csv", "json")) -> None:
    """The table in each format below the path. CSV has no arrays: they are joined by commas."""
    for f in formats:
        out = df.select(*(F.array_join(c, ",").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes)) if f == "csv" else df
        w = out.write.mode("overwrite")
        (w.option("header", True) if f == "csv" else w).format(f).save(f"{path}/{f}")


def training_lines(df: DataFrame, columns: list[str]) -> DataFrame:
    """value: one JSON object a row, for write.text()."""
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


def question_pairs(concepts: DataFrame, most: int = 3) -> DataFrame:
    """question, answer for each concept: what it is found in, by its first titles."""
    g = concepts.groupBy("concept").agg(F.slice(F.array_sort(F.collect_set("title")), 1, most).alias("t"))
    return g.select(F.concat(F.lit("Where is "), F.replace("concept", F.lit("_"), F.lit(" ")), F.lit(" discussed?")).alias("question"), F.array_join("t", "; ").alias("answer"))


def graph_dump(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    training_lines(nodes, nodes.columns).write.mode("overwrite").text(f"{path}/nodes")
    training_lines(edges, edges.columns).write.mode("overwrite").text(f"{path}/edges")


def vector_collection(df: DataFrame, path: str, collection: str) -> None:
    """Vectors by collection, which a reader's filter on it prunes to."""
    df.withColumn("collection", F.col(collection)).write.mode("overwrite").partitionBy("collection").parquet(path)


def markdown_table(df: DataFrame, title: str, most: int = 50) -> str:
    """A report of the first rows of a small table."""
    rows = df.limit(most).collect()
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
    return "\n".join([f"## {title}", "", head, *(f"| {' | '.join(str(v) for v in r)} |" for r in rows)]) + "\n"


def file_system(spark, path: str):
    """The Hadoop file system of a path, and the path as it takes it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p
