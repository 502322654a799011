"""A registry of queries, and the mapping of the driver's tables onto the domain.

The domain's tables are views of the driver's: a customer is a document, an order a passage of it, a line item with its
part a concept of the passage, a supplier a code file, an event an item of a feed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: SQL of the domain's views, for the oracles; domain() below has the same in DataFrames.
VIEWS = """
documents_kb AS (SELECT c_custkey AS doc_id, c_name AS title, c_mktsegment AS venue, 1990 + c_custkey % 35 AS year, c_nationkey AS nation FROM customer),
passages AS (SELECT o_orderkey AS passage_id, o_custkey AS doc_id, o_orderkey % 6 - 1 AS page_num, o_orderpriority AS section, round(o_totalprice / 500000, 4) AS quality, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus AS status FROM orders),
passage_concepts AS (SELECT l_orderkey AS passage_id, l_linenumber AS seq, l_partkey AS part_id, replace(p_name, ' ', '_') AS concept, lower(p_type) AS concept_type, p_brand AS field, round(1 - 5 * l_discount, 2) AS confidence, l_returnflag AS version, l_shipdate AS created_at FROM lineitem JOIN part ON l_partkey = p_partkey),
code_files AS (SELECT s_suppkey AS file_id, 'repo' || CAST(s_nationkey AS VARCHAR) AS repo, s_name AS path, s_acctbal AS size, CASE WHEN s_suppkey % 3 = 0 THEN 'python' WHEN s_suppkey % 3 = 1 THEN 'sql' ELSE 'r' END AS language FROM supplier),
code_chunks AS (SELECT l_orderkey * 8 + l_linenumber AS chunk_id, l_suppkey AS file_id, replace(p_name, ' ', '_') AS name, l_linenumber AS start_line, p_brand AS org, lower(p_type) AS chunk_type FROM lineitem JOIN part ON l_partkey = p_partkey),
feed AS (SELECT event_id, ts, event_type AS source, user_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""


class Tables:
    """Loads the driver's tables and the domain's views of them; nothing is read before it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def documents_kb(self) -> DataFrame:
        return self("customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("venue"), (F.lit(1990) + F.col("c_custkey") % 35).alias("year"), F.col("c_nationkey").alias("nation"))

    @property
    def passages(self) -> DataFrame:
        return self("orders").select(F.col("o_orderkey").alias("passage_id"), F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 6 - 1).alias("page_num"), F.col("o_orderpriority").alias("section"), F.round(F.col("o_totalprice") / 500000, 4).alias("quality"), F.year("o_orderdate").alias("year"), F.col("o_orderstatus").alias("status"))

    @property
    def passage_concepts(self) -> DataFrame:
        part = self("part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("concept"), F.lower("p_type").alias("concept_type"), F.col("p_brand").alias("field"))
        lines = self("lineitem").select(F.col("l_orderkey").alias("passage_id"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part_id"), F.round(1 - 5 * F.col("l_discount"), 2).alias("confidence"), F.col("l_returnflag").alias("version"), F.col("l_shipdate").alias("created_at"))
        return lines.join(part, lines["part_id"] == part["p_partkey"]).select("passage_id", "seq", "part_id", "concept", "concept_type", "field", "confidence", "version", "created_at")

    @property
    def code_files(self) -> DataFrame:
        lang = F.when(F.col("s_suppkey") % 3 == 0, "python").when(F.col("s_suppkey") % 3 == 1, "sql").otherwise("r")
        return self("supplier").select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit("repo"), F.col("s_nationkey").cast("string")).alias("repo"), F.col("s_name").alias("path"), F.col("s_acctbal").alias("size"), lang.alias("language"))

    @property
    def code_chunks(self) -> DataFrame:
        part = self("part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.col("p_brand").alias("org"), F.lower("p_type").alias("chunk_type"))
        lines = self("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_suppkey").alias("file_id"), F.col("l_linenumber").alias("start_line"), "l_partkey")
        return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("chunk_id", "file_id", "name", "start_line", "org", "chunk_type")

    @property
    def feed(self) -> DataFrame:
        return self("events").select("event_id", "ts", F.col("event_type").alias("source"), "user_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Registers fn(tables) -> DataFrame. sql is a SELECT over the driver's tables and the domain's views; further
    common table expressions may come first, after a leading comma."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            begin = f"WITH {'RECURSIVE ' if recursive else ''}{VIEWS.strip()}"
            ORACLE[name] = f"{begin}{sql}" if sql.lstrip().startswith(",") else f"{begin}\n{sql}"
        return fn

    return register
