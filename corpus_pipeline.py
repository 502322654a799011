"""Corpus pipeline: language ID, n-gram Jaccard join, benchmark decontamination, PII, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what each returns to the shared folder and
reads it again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, langid, pii
from lodestone.llm._spark import materialise
from lodestone.llm.decontaminate import without_leaks
from lodestone.llm.ngram_join import BROADCAST_ROWS, ngram_join

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language is undetermined: a null text, or one without any letter. A missing lang is
    filled with the predicted one (ties: the first name), or stays missing if no row to learn from has one. Rows that
    repeat are each kept; an empty table stays empty; other columns than those of documents go."""
    docs = docs.select(*COLUMNS)
    model = langid.train(docs.filter(langid.remainder("doc_id", 4) != 2))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    known = langid.predict(docs, model, keep=COLUMNS)
    return known.filter("lang_pred <> 'und'").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest doc_id. Where doc_ids repeat, rows that differ in doc_id or
    text are documents of their own, so of equal rows one stays, and no text goes that isn't near another one. A null
    doc_id is in no group and stays, as do texts without words; an empty table stays empty."""
    docs = docs.select(*COLUMNS)
    if docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        gone = materialise(ngram_join(docs).filter("NOT kept").select("doc_id"))
        if gone.count() <= BROADCAST_ROWS:  # else texts are shuffled once, by doc_id
            gone = F.broadcast(gone)
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    once = docs.filter("doc_id IS NOT NULL").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    once = materialise(once.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "rest.*"))
    joined = ngram_join(once.select("row", "text"), doc_id="row").select(F.col("doc_id").alias("row"), "class_id")
    least = joined.join(once.select("row", "doc_id"), "row").groupBy("class_id").agg(F.min(F.struct("doc_id", "row"))["row"].alias("row"))
    return once.join(least, "row", "left_semi").select(*COLUMNS).unionByName(docs.filter("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words of a benchmark window go; null and wordless texts and rows that repeat stay. An empty table,
    of documents or of the benchmark, takes nothing away."""
    return without_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become marks such as [EMAIL], and n_chars follows the text (a null text stays null, as its number
    of characters). All rows stay; an empty table stays empty."""
    return pii.redact(docs.select(*COLUMNS), pii.train(docs)).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of ids, and digests of the ids and of the bytes that they decode to; a row for each row of docs."""
    return byte_bpe.digest(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("tokens", tokens)]
#: No stage but the third can be put as SQL: models, MinHash, connected components and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
