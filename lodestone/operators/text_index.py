"""A stored positional index of texts: postings with places, block maxima, statistics.

The folder holds, by segment: `postings` (term, block, key, n, tf, places), split into folders by a hash of the term and sorted
by term and block within files, so a query reads only row groups of its terms; a row without a term for each document, in a folder of
their own; `maxima` (term, block, df and the largest tf and smallest length by tf in the block); and `segments`, which names
the segments that are complete and how many documents and terms each has. A batch of documents is a segment; one that broke
off is not named, and is not read. Documents are dealt into blocks by a hash of their key, so blocks are alike at any size.

Writing shuffles the texts once, into as many tasks as they have bytes for; a task inverts its documents and sorts what it has.

A query reads postings only. For the best k, blocks are read in the order of their bounds: a block whose bound, from its
maxima, is below the k-th score found so far is skipped, so results equal those of reading all.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.containment import BROADCAST_ROWS
from lodestone.operators.relational import top_k
from lodestone.operators.scratch import materialise
from lodestone.operators.search import ENDINGS, LONG, STOP_WORDS, cover_of, split_words

K1, B = 1.2, 0.75
#: Terms of a batch of queries that are also put into the scan's filter; with more, the join alone chooses.
MOST_TERMS = 5_000
#: The folder of the rows that have no term: one for each document.
_DOCS = -1
#: Terms that are inverted at once.
_TERMS = 1 << 20


def _part(tf: Column, n: Column, df: Column, docs: Column, mean: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, block, t (words in order) to key, block, n, term, tf, places: one row for each term of a document, and one without."""
    for batch in batches:
        ends, at = np.cumsum(np.asarray(pc.list_value_length(batch["t"]), dtype=np.int64)), 0
        while at < len(batch):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TERMS, "right")))
            yield _inverted_slice(batch.slice(at, upto - at))
            at = upto


def _inverted_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each distinct word is made a term, as terms() does it, once."""
    coded = batch["t"].flatten().dictionary_encode()
    words, codes = coded.dictionary, np.asarray(coded.indices)
    stems = pc.if_else(pc.greater_equal(pc.utf8_length(words), LONG), pc.replace_substring_regex(words, ENDINGS, ""), words).dictionary_encode()
    kept = ~np.asarray(pc.is_in(words, pa.array(["", *STOP_WORDS], words.type)))[codes]
    doc = np.repeat(np.arange(len(batch)), np.asarray(pc.list_value_length(batch["t"])))[kept]
    n = np.bincount(doc, minlength=len(batch))
    place = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    own_code = np.asarray(stems.indices, dtype=np.int64)[codes[kept]]
    pair = own_code * len(n) + doc
    order = np.argsort(pair, kind="stable")  # so places stay in order
    first = np.flatnonzero(np.diff(pair[order], prepend=-1))
    own = np.concatenate([doc[order[first]], np.arange(len(n))])  # the rows without a term come last
    offsets = np.concatenate([first, np.full(len(n) + 1, len(order))]).astype(np.int32)
    term = pa.concat_arrays([stems.dictionary.take(pa.array(own_code[order[first]])), pa.nulls(len(n), stems.dictionary.type)])
    places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[order]))
    columns = {"key": batch["key"].take(pa.array(own)), "block": batch["block"].take(pa.array(own)), "n": pa.array(n[own].astype(np.int32)), "term": term, "tf": pa.array(np.diff(offsets)), "places": places}
    return pa.RecordBatch.from_pydict(columns)


class TextIndex:
    """One index. blocks and buckets are fixed when the first documents are added; a task of writing gets about task_bytes of texts."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint", blocks: int = 64, buckets: int = 16, task_bytes: int = 32 << 20):
        self.spark, self.path, self.key_type = spark, path, key_type
        self.blocks, self.buckets, self.task_bytes = blocks, buckets, task_bytes
        self.read: tuple[int, int] = (0, 0)  # blocks that the last top-k query has read, and that have its terms

    # -- writing ----------------------------------------------------------------------------------------------------

    def add(self, docs: DataFrame, key: str, text: str) -> str | None:
        """Adds the documents whose key is new, as a segment; its name, or None if there is none. Rows without a key go; of
        rows that repeat a key the smallest text counts; a null or empty text has no terms and counts as a document."""
        rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast(self.key_type).alias("key"), F.col(text).alias("text"))
        rows = self._without(self._once(rows))
        seg = uuid.uuid4().hex
        # blocks hang on the same hash as the tasks, so a task has few blocks, or a part of one
        block, tasks = F.pmod(F.hash("key"), F.lit(self.blocks)).cast("int"), self._tasks(rows)
        cut = rows.repartition(tasks, "key").select("key", block.alias("block"), split_words(F.coalesce("text", F.lit(""))).alias("t"))
        posts = cut.mapInArrow(_inverted, f"key {self.key_type}, block int, n int, term string, tf int, places array<int>")
        bucket = F.when(F.col("term").isNull(), F.lit(_DOCS)).otherwise(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int"))
        posts = posts.withColumn("bucket", bucket).sortWithinPartitions("bucket", "term", "block", "key")
        posts.write.partitionBy("bucket").parquet(f"{self.path}/postings/seg={seg}")
        most = self._read("postings", [seg]).groupBy("bucket", "term", "block").agg(F.count("*").alias("df"), F.max("tf").alias("tf"), F.min(F.col("n") / F.col("tf")).alias("ratio"))
        most.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{self.path}/maxima/seg={seg}")
        known = self._read("docs", [seg]).agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"))
        if known.first()["docs"] == 0:
            return None
        known.select(F.lit(seg).alias("seg"), "docs", "terms").coalesce(1).write.mode("append").parquet(f"{self.path}/segments")
        return seg

    @staticmethod
    def _once(rows: DataFrame) -> DataFrame:
        """One row a key. Only keys are counted, and texts of keys that repeat compared; without such keys nothing is moved."""
        repeated = materialise(rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"))
        n = repeated.limit(BROADCAST_ROWS + 1).count()
        if n > BROADCAST_ROWS:
            return rows.groupBy("key").agg(F.min("text").alias("text"))
        if n == 0:
            return rows
        smallest = rows.join(F.broadcast(repeated), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
        return rows.join(F.broadcast(repeated), "key", "left_anti").unionByName(smallest)

    def _without(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is new. Many known keys are joined by a hash table of each task, so texts are not sorted."""
        if not self.segments():
            return rows
        known = self.docs().select("key")
        few = self.statistics()[0] <= BROADCAST_ROWS
        return rows.join(F.broadcast(known) if few else known.hint("shuffle_hash"), "key", "left_anti")

    def _tasks(self, rows: DataFrame) -> int:
        """Tasks for the texts: a divisor of the blocks' number or a multiple of it, as far as that is a power of two."""
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        n = max(math.ceil(size / self.task_bytes), min(self.spark.sparkContext.defaultParallelism, math.ceil(size / (1 << 20))), 1)
        return self.blocks * math.ceil(n / self.blocks) if n > self.blocks else min(self.blocks, 1 << math.ceil(math.log2(n)))

    def segments(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/segments")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        return sorted(r["seg"] for r in self.spark.read.schema("seg string, docs bigint, terms bigint").parquet(f"{self.path}/segments").select("seg").collect())

    # -- reading ----------------------------------------------------------------------------------------------------

    def _read(self, table: str, segs: list[str]) -> DataFrame:
        folder = "maxima" if table == "maxima" else "postings"
        shape = {"postings": f"term string, block int, key {self.key_type}, n int, tf int, places array<int>, bucket int", "maxima": "term string, block int, df bigint, tf int, ratio double, bucket int"}[folder]
        out = None
        for seg in segs:
            own = self.spark.read.schema(shape).parquet(f"{self.path}/{folder}/seg={seg}")
            out = own if out is None else out.unionByName(own)
        out = self.spark.createDataFrame([], shape) if out is None else out
        return out.filter(F.col("bucket") == _DOCS).select("key", "n") if table == "docs" else out.filter(F.col("bucket") >= 0)

    def docs(self) -> DataFrame:
        return self._read("docs", self.segments())

    def _of(self, table: str, words: Iterable[str]) -> DataFrame:
        """The rows of these terms: folders are chosen by the terms' hashes, row groups by the terms."""
        words = sorted(set(words))
        rows = self._read(table, self.segments())
        if not words:
            return rows.filter(F.lit(False))
        got = self.spark.range(1).select(F.explode(F.array(*map(F.lit, words))).alias("term")).select(F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int").alias("b")).distinct().collect()
        return rows.filter(F.col("bucket").isin(*(r["b"] for r in got)) & F.col("term").isin(*words))

    def postings(self, words: Iterable[str]) -> DataFrame:
        return self._of("postings", words)

    def statistics(self) -> tuple[int, float]:
        """The number of documents and their mean number of terms."""
        if not self.segments():
            return 0, 0.0
        r = self.spark.read.schema("seg string, docs bigint, terms bigint").parquet(f"{self.path}/segments").agg(F.sum("docs").alias("d"), F.sum("terms").alias("t")).first()
        return r["d"], r["t"] / r["d"]

    def all_terms(self, query: list[str]) -> DataFrame:
        """key of the documents that have all the terms."""
        n = len(set(query))
        return self.postings(query).groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") == n).select("key")

    def cover_density(self, query: list[str]) -> DataFrame:
        """key, score: 1 / the length of the shortest run with all terms, of the documents that have them."""
        words = sorted(set(query))
        own = [F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"p{i}") for i, w in enumerate(words)]
        rows = self.postings(words).groupBy("key").agg(F.count("*").alias("m"), *own).filter(F.col("m") == len(words))
        return rows.select("key", cover_of([F.col(f"p{i}") for i in range(len(words))]).alias("score"))

    def bm25(self, query: list[str], k: int | None = None) -> DataFrame:
        """key, score of the documents with some term; with k: of the k best, ties by key, without reading blocks that
        cannot hold one."""
        docs, mean = self.statistics()
        words = sorted(set(query))
        if not docs or not words:
            return self.postings([]).select("key", F.lit(0.0).alias("score"))
        times = {w: query.count(w) for w in words}
        maxima = self._of("maxima", words).groupBy("term", "block").agg(F.sum("df").alias("df"), F.max("tf").alias("tf"), F.min("ratio").alias("ratio")).collect()  # at most terms times blocks
        dfs = {w: sum(r["df"] for r in maxima if r["term"] == w) for w in words}
        weight = F.element_at(F.create_map(*(x for w in words for x in (F.lit(w), F.lit(float(times[w]))))), F.col("term"))
        df = F.element_at(F.create_map(*(x for w in words for x in (F.lit(w), F.lit(float(dfs[w]))))), F.col("term"))
        score = F.sum(weight * _part(F.col("tf"), F.col("n"), df, F.lit(float(docs)), F.lit(mean))).alias("score")
        posts = self.postings(words)
        if k is None:
            return posts.groupBy("key").agg(score)
        bounds, held = {}, {}
        for b, w, bound, n in self._bounds(maxima, times, dfs, docs, mean):
            bounds[b] = bounds.get(b, 0.0) + bound
            held[b] = max(held.get(b, 0), n)
        order = sorted(bounds, key=lambda b: (-bounds[b], b))
        first, seen = [], 0
        while order and (seen < k or len(first) ** 2 < len(bounds)):  # some of the best blocks, with k documents at least
            first.append(order.pop(0))
            seen += held[first[-1]]
        best = lambda blocks: posts.filter(F.col("block").isin(*blocks)).groupBy("key").agg(score).orderBy(F.desc("score"), "key").limit(k)
        found = materialise(best(first)) if first else posts.groupBy("key").agg(score)
        rest = order
        if found.count() >= k:
            least = found.agg(F.min("score")).first()[0]
            rest = [b for b in order if bounds[b] * (1 + 1e-9) >= least]
        self.read = (len(first) + len(rest), len(bounds))
        return (found.unionByName(best(rest)) if rest else found).orderBy(F.desc("score"), "key").limit(k)

    @staticmethod
    def _bounds(maxima: list, times: dict[str, int], dfs: dict[str, int], docs: int, mean: float) -> Iterable[tuple[int, str, float, int]]:
        """block, term, the most that the term can add to a score in it, and its documents there."""
        for r in maxima:
            df = dfs[r["term"]]
            idf = math.log(1 + (docs - df + 0.5) / (df + 0.5))
            yield r["block"], r["term"], times[r["term"]] * idf * (K1 + 1) / (1 + K1 * ((1 - B) / r["tf"] + B * r["ratio"] / mean)), r["df"]

    def _near(self, table: str, asked: DataFrame) -> DataFrame:
        """Rows of a table in which those of the column term of asked are; with many terms these are all rows."""
        few = [r["term"] for r in asked.select("term").distinct().limit(MOST_TERMS + 1).collect()]
        return self._of(table, few) if len(few) <= MOST_TERMS else self._read(table, self.segments())

    def postings_of(self, asked: DataFrame) -> DataFrame:
        """The postings of the terms in the column term of asked."""
        return self._near("postings", asked).join(asked.select("term").distinct(), "term", "left_semi")

    def search(self, queries: DataFrame, qkey: str, words: str, k: int, digits: int | None = None) -> DataFrame:
        """qkey, key, score, rank: the k best of each query (an array of terms) by BM25, all queries in one plan. Terms that a
        query repeats count as often. With digits, scores are rounded before they are compared, so equals go by key."""
        docs, mean = self.statistics()
        asked = materialise(queries.select(F.col(qkey).alias("q"), F.explode(words).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times")))
        posts, maxima = (self._near(t, asked) for t in ("postings", "maxima"))
        known = asked.join(maxima.groupBy("term").agg(F.sum("df").cast("double").alias("df")), "term")
        hits = posts.select("term", "key", "tf", "n").join(known, "term")
        score = F.sum(F.col("times") * _part(F.col("tf"), F.col("n"), F.col("df"), F.lit(float(docs)), F.lit(mean or 1.0)))
        score = score if digits is None else F.round(score, digits)
        best = top_k(hits.groupBy("q", "key").agg(score.alias("score")), ["q"], [F.desc("score"), F.asc("key")], k, "rank")
        return best.select(F.col("q").alias(qkey), "key", "score", F.col("rank").cast("bigint").alias("rank"))
