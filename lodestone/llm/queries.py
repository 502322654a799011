"""The registered query of each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, html_extract, oracles, pii, rans
from lodestone.llm._spark import materialise, scratch_dir
from lodestone.llm.centroids import centroid_clusters
from lodestone.llm.collocations import collocations
from lodestone.llm.decontaminate import find_leaks, leak_digest
from lodestone.llm.embedding_dedup import embedding_near_dedup
from lodestone.llm.langid import language_id
from lodestone.llm.ngram_join import ngram_join
from lodestone.llm.toxicity import toxicity
from lodestone.llm.token_rollup import RollupStore, counted, tokens_of
from lodestone.llm.url_filter import filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, counted by the two public tokenizers, are put in; those in German are then cleaned (runs of white space
    are one space) and their counts revised; documents whose text is also that of a smaller doc_id are taken out, by
    the counts that they have by then. The second batch is sent again, as after a broken job, and changes nothing."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    cleaned = F.when(F.col("lang") == "de", F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")))
    rows = docs.select("doc_id", "source", "lang", F.sha2("text", 256).alias("same"), "text", cleaned.alias("cleaned"))
    rows = materialise(tokens_of(rows, {"old": "text", "new": "cleaned"}, ["doc_id", "source", "lang", "same"]))
    old, new = ({"byte_bpe_50k": F.col(f"{k}_byte"), "word_bpe_49k": F.col(f"{k}_word")} for k in ("old", "new"))
    store = RollupStore(spark, scratch_dir(spark))
    store.commit("1-insert", counted(rows, old))
    german = rows.filter("lang = 'de'")
    revised = counted(german, old, -1).union(counted(german, new))
    store.commit("2-revise", revised)
    later = {k: F.when(F.col("lang") == "de", new[k]).otherwise(old[k]).alias(k) for k in old}
    skinny = rows.filter("same IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "source", "lang", "same", *later.values())
    group = skinny.groupBy("same", "source", "lang", *later).agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))  # copies are summed before they are sent
    kept = F.when(F.col("least") == F.min("least").over(Window.partitionBy("same")), 1).otherwise(0)
    again = group.withColumn("gone", F.col("n") - kept).filter("gone > 0")
    store.commit("3-delete", counted(again, {k: F.col(k) for k in later}, -F.col("gone")))
    store.commit("2-revise", revised)
    store.compact()
    return store.totals()


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.digest(pii.find_pii(docs, pii.train(docs)))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(_table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_digest(find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(_table(spark, sf_dir, "embeddings"))


def op8_rans_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.digest(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ", ".join(f"('{host}', '{path}', '{verdict}')" for verdict, host, path in oracles.URL_RULES)
    return filter_urls(_table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {rules} AS rules(host, path, verdict)"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(_table(spark, sf_dir, "embeddings"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_token_counts": op2_token_counts,
    "op3_pii": op3_pii,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_language_id": op6_language_id,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_rans_token_ids": op8_rans_token_ids,
    "op9_toxicity": op9_toxicity,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_url_filters": op11_url_filters,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_phrase_collocations": op13_phrase_collocations,
}

#: The first ten cannot be put as SQL: tokenizers, models, min-wise hashes and coders.
ORACLE_SQL: dict[str, str] = {
    "op11_url_filters": oracles.URL_FILTERS,
    "op12_centroid_clustering": oracles.CENTROIDS,
    "op13_phrase_collocations": oracles.COLLOCATIONS,
}
