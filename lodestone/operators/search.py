"""Lexical and vector retrieval, fusion and query expansion.

Retrieval takes a stated, small set of queries against all rows: queries are broadcast, rows are scored where they lie,
and a top-k by query is cut before its shuffle (Spark pushes row_number() <= k below the exchange). Orders are total:
score first, then the id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.scratch import materialise

from lodestone.functions.text import STOP_WORDS
from lodestone.operators.relational import top_k

#: A query table may be broadcast up to this many rows; beyond it queries are dealt out in blocks.
MOST_QUERIES = 10_000


# -- lexical --------------------------------------------------------------------------------------------------------


#: What stem() takes off words of so many letters or more.
ENDINGS, LONG = "(ingly|edly|ings|ing|ies|ied|ed|es|s|ly)$", 5


def stem(word: Column) -> Column:
    """A light stemmer: plural and verbal endings of words of five letters or more."""
    return F.when(F.length(word) >= LONG, F.regexp_replace(word, ENDINGS, "")).otherwise(word)


def split_words(text: Column) -> Column:
    """What stands between other characters than letters and digits, in lower case; some are empty."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def terms(text: Column) -> Column:
    """Stemmed words in order, without stop words."""
    w = F.filter(split_words(text), lambda x: (x != "") & ~x.isin(*STOP_WORDS))
    return F.transform(w, lambda x: stem(x))


def term_frequencies(text: Column) -> Column:
    """A map of the terms to their numbers."""
    t = terms(text)
    return F.map_from_entries(F.transform(F.array_distinct(t), lambda x: F.struct(x, F.size(F.filter(t, lambda y: y == x)))))


def has_all_terms(tokens: Column, query: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.array_contains(tokens, q) for q in query), F.lit(True))


def tf_of(tokens: Column, term: str) -> Column:
    return F.size(F.filter(tokens, lambda x: x == term))


def saturated_rank(tokens: Column, query: list[str], weight: float = 0.1) -> Column:
    """The sum over the query's terms of weight * (1 - 1 / (1 + tf))."""
    return reduce(lambda a, b: a + b, (weight * (1 - 1 / (1 + tf_of(tokens, q).cast("double"))) for q in query), F.lit(0.0))


def weighted_fields(fields: list[tuple[Column, float]], query: list[str]) -> Column:
    """Saturated ranks of several fields, each with its weight, e.g. 1 for names, 0.4 for signatures, 0.2 for bodies."""
    return reduce(lambda a, b: a + b, (saturated_rank(c, query, w) for c, w in fields))


def cover_density(tokens: Column, query: list[str]) -> Column:
    """1 / the length of the shortest run of tokens that has all the query's terms, 0 if there is none.

    For each end at a term, the run reaches back to the earliest of the terms' last places before it."""
    return cover_of([_places(tokens, q) for q in query])


def cover_of(places: list[Column]) -> Column:
    """cover_density() of the places of each term."""
    ends = F.array_sort(F.array_distinct(F.flatten(F.array(*places))))

    def length(e: Column) -> Column:
        lasts = [F.array_max(_upto(p, e)) for p in places]
        return F.when(reduce(lambda a, b: a & b, (x.isNotNull() for x in lasts)), e - (F.least(*lasts) if len(lasts) > 1 else lasts[0]) + 1)

    best = F.array_min(F.transform(ends, length))
    return F.coalesce(1.0 / best, F.lit(0.0))


def _places(tokens: Column, term: str) -> Column:
    return F.array_compact(F.transform(tokens, _if_equal(term)))


def _if_equal(term: str) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.when(x == term, i)


def _upto(places: Column, end: Column) -> Column:
    return F.filter(places, lambda i: i <= end)


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of the documents that have some term. Statistics are over all documents, which are read once: the
    numbers of terms, a few integers a document, are written and read twice."""
    t = docs.select(key, terms(F.col(text)).alias("t"))
    tfs = t.select(key, F.size("t").alias("n"), *(tf_of(F.col("t"), q).alias(f"tf{i}") for i, q in enumerate(query)))
    tfs = materialise(tfs)
    stats = tfs.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(query))))
    hits = tfs.filter(reduce(lambda a, c: a | c, (F.col(f"tf{i}") > 0 for i in range(len(query)))))

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        return F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / F.col("mean")))

    return hits.join(F.broadcast(stats)).select(key, reduce(lambda a, c: a + c, map(part, range(len(query)))).alias("score"))


# -- vectors --------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for zero vectors."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def nearest(rows: DataFrame, key: str, vector: str, query: list[float], k: int, condition: Column | None = None) -> DataFrame:
    """The k rows nearest to one query, after the condition: key, score."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = rows if condition is None else rows.filter(condition)
    return rows.select(key, cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def nearest_join(rows: DataFrame, key: str, vector: str, queries: DataFrame, qkey: str, qvector: str, k: int) -> DataFrame:
    """qkey, key, score, rank of the k nearest rows to each query. At most MOST_QUERIES queries are taken; there is a
    product of queries and rows, which is the work of an exact search, and each batch keeps its k best of each."""
    n = queries.count()
    if n > MOST_QUERIES:
        raise ValueError(f"{n} queries; deal them out in blocks of {MOST_QUERIES}")
    got = queries.select(qkey, qvector).toPandas()
    ids, q = got[qkey].tolist(), np.array([np.asarray(v, dtype=np.float64) for v in got[qvector]])
    sent = rows.sparkSession.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1, keepdims=True) if n else q))
    types = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        for pdf in batches:
            if not len(pdf) or not ids:
                continue
            x = np.array([np.asarray(v, dtype=np.float64) for v in pdf["v"]])
            size = np.linalg.norm(x, axis=1)
            pdf, x = pdf[size > 0].reset_index(drop=True), x[size > 0] / size[size > 0, None]
            s = x @ q.T
            for j, i in enumerate(ids):
                best = pd.DataFrame({"q": i, "key": pdf["key"], "score": s[:, j]}).sort_values(["score", "key"], ascending=[False, True]).head(k)
                yield best

    near = rows.select(F.col(key).alias("key"), F.col(vector).alias("v")).mapInPandas(run, f"q {dict(queries.dtypes)[qkey]}, key {types[key]}, score double")
    return top_k(near, ["q"], [F.desc("score"), F.asc("key")], k, "rank").select(F.col("q").alias(qkey), F.col("key").alias(key), "score", F.col("rank").cast("bigint").alias("rank"))


# -- fusion ---------------------------------------------------------------------------------------------------------


def rank_fusion(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """key, score: the sum over ranked lists (key, rank from 1) of 1 / (k + rank), and the first list that had it."""
    parts = [d.select(key, "rank", F.lit(i).alias("list")) for i, d in enumerate(lists)]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min("list").alias("first_list"))


def explained_fusion(channels: dict[str, DataFrame], key: str, k: int = 60) -> DataFrame:
    """key, score, trace: rank fusion of channels (key, rank, score and, if a channel has it, path: what led to the item), with
    what each channel added. trace has a struct for each channel that had the item, in the order of channels: channel, rank,
    score (the channel's own), part (1 / (k + rank)) and path. score is the sum of the parts, in that order."""
    parts = []
    for i, (name, d) in enumerate(channels.items()):
        path = F.col("path").cast("array<string>") if "path" in d.columns else F.array().cast("array<string>")
        entry = F.struct(F.lit(i).alias("at"), F.lit(name).alias("channel"), F.col("rank").cast("bigint").alias("rank"), F.col("score").cast("double").alias("score"), (1.0 / (k + F.col("rank"))).alias("part"), path.alias("path"))
        parts.append(d.select(key, entry.alias("entry")))
    trace = F.array_sort(F.collect_list("entry"))  # at most one for each channel
    fused = reduce(lambda a, b: a.unionByName(b), parts).groupBy(key).agg(trace.alias("trace"))
    score = F.aggregate("trace", F.lit(0.0), lambda s, x: s + x["part"])
    return fused.select(key, score.alias("score"), F.transform("trace", lambda x: x.dropFields("at")).alias("trace"))


def hybrid(lists: list[DataFrame], key: str, n: int, k: int = 60) -> DataFrame:
    """key, score, first_list: the n best of several lists (key, score), each cut to its n best, by reciprocal ranks.
    Ties go by the first list that had an item, then by key."""
    order = [F.desc("score"), F.asc(key)]
    cut = [top_k(d.orderBy(*order).limit(n).withColumn("__one", F.lit(1)), ["__one"], order, n, "rank") for d in lists]
    fused = rank_fusion(cut, key, k).withColumn("score", F.round("score", 12))
    return fused.orderBy(F.desc("score"), "first_list", key).limit(n)


def position_fusion(lists: list[tuple[DataFrame, float]], key: str, boost: float = 0.1) -> DataFrame:
    """key, score: for each list (1 - (rank - 1) / its length) * weight, and a boost for keys of more than one list."""
    parts = []
    for d, w in lists:
        n = d.agg(F.count("*").alias("__n"))
        parts.append(d.join(F.broadcast(n)).select(key, ((1 - (F.col("rank") - 1) / F.col("__n")) * w).alias("s")))
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy(key).agg((F.sum("s") + F.when(F.count("*") > 1, boost).otherwise(0.0)).alias("score"))


def channel_fusion(vector: DataFrame, graph: DataFrame, key: str) -> DataFrame:
    """vector(key, semantic), graph(key, graph, related): 0.6 semantic + 0.4 graph, + 0.2 in both, + 0.05 for each
    related hit."""
    j = vector.join(graph, key, "full_outer")
    both = F.col("semantic").isNotNull() & F.col("graph").isNotNull()
    score = 0.6 * F.coalesce("semantic", F.lit(0.0)) + 0.4 * F.coalesce("graph", F.lit(0.0)) + F.when(both, 0.2).otherwise(0.0) + 0.05 * F.coalesce("related", F.lit(0))
    return j.select(key, score.alias("score"))


class Reranker(Protocol):
    def scores(self, query: str, texts: list[str]) -> list[float]: ...


class OverlapReranker:
    """The share of the query's words that a text has."""

    def scores(self, query: str, texts: list[str]) -> list[float]:
        q = set(query.lower().split())
        return [len(q & set(t.lower().split())) / max(1, len(q)) for t in texts]


def rerank(candidates: DataFrame, key: str, text: str, query: str, model: Reranker, chars: int = 512) -> DataFrame:
    """candidates with a column rerank_score; the model sees the first `chars` characters, which is its input size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "rerank_score": model.scores(query, [(t or "")[:chars] for t in pdf[text]])})

    return candidates.select(key, text).mapInPandas(run, f"{key} {dict(candidates.dtypes)[key]}, rerank_score double")


class Embedder(Protocol):
    size: int

    def vectors(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashed words, of length 1."""

    def __init__(self, size: int = 64):
        self.size = size

    def vectors(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.size] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


def embed(df: DataFrame, key: str, text: str, model: Embedder) -> DataFrame:
    """key, vector; equal texts are embedded once in a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes, distinct = pd.factorize(pdf[text].fillna(""))
            v = model.vectors(list(distinct))
            yield pd.DataFrame({key: pdf[key], "vector": [v[c].tolist() for c in codes]})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, vector array<double>")


# -- expansion ------------------------------------------------------------------------------------------------------


def detected_domains(text: Column, families: dict[str, tuple[str, ...]]) -> Column:
    """The families of which some word occurs."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(reduce(lambda a, b: a | b, (low.contains(w) for w in ws)), F.lit(f)) for f, ws in families.items())))


def expanded_query(query: Column, synonyms: dict[str, tuple[str, ...]], most: int = 15) -> Column:
    """The query and the synonyms of the terms in it, joined by OR; `most` terms at most."""
    low = F.lower(query)
    more = F.flatten(F.array_compact(F.array(*(F.when(low.contains(k), F.array(*map(F.lit, v))) for k, v in synonyms.items()))))
    return F.array_join(F.slice(F.array_distinct(F.concat(F.array(query), more)), 1, most), " OR ")


def bridge_boost(score: Column, text: Column, families: dict[str, tuple[str, ...]], factor: float = 1.2) -> Column:
    return F.when(F.size(detected_domains(text, families)) >= 2, score * factor).otherwise(score)


def multi_hop(first: DataFrame, postings: DataFrame, families: dict[str, tuple[str, ...]], n: int, top: int = 10, hops: int = 5, each: int = 3, factor: float = 1.2) -> DataFrame:
    """id, score: the n best of first(id, score) and of one hop from it over postings(id, concept, score).

    The hop leads from the `top` best hits to the `hops` concepts that most of them have (ties: by name), and on to the
    `each` best items of each. An item keeps its score of first, else its best one of the hop; `factor` raises items
    whose concepts touch two families or more. What is broadcast is `hops` concepts and the merged hits, so first must
    have a limit."""
    best = first.orderBy(F.desc("score"), "id").limit(top).select("id")
    wanted = postings.join(F.broadcast(best), "id", "left_semi").groupBy("concept").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "concept").limit(hops).select("concept")
    near = top_k(postings.join(F.broadcast(wanted), "concept", "left_semi"), ["concept"], [F.desc("score"), F.asc("id")], each)
    both = first.select("id", "score", F.lit(0).alias("list")).unionByName(near.select("id", "score", F.lit(1).alias("list")))
    both = both.groupBy("id").agg(F.min(F.struct("list", (-F.col("score")).alias("s"))).alias("m")).select("id", (-F.col("m.s")).alias("score"))
    of = postings.join(F.broadcast(both.select("id")), "id", "left_semi").groupBy("id").agg(F.array_join(F.collect_set("concept"), " ").alias("text"))
    return both.join(of, "id", "left").select("id", bridge_boost(F.col("score"), F.coalesce("text", F.lit("")), families, factor).alias("score")).orderBy(F.desc("score"), "id").limit(n)


def abstracted(problem: str, patterns: dict[str, tuple[str, ...]], most: int = 3) -> list[str]:
    """The first `most` queries that stand for the problem's words in other fields, in the patterns' order."""
    low = problem.lower()
    return list(dict.fromkeys(q for word, queries in patterns.items() if word in low for q in queries))[:most]


def merged_searches(results: list[DataFrame], n: int) -> DataFrame:
    """id, score: the n best of several results (id, score); an item of more than one keeps its score in the first."""
    parts = [d.select("id", "score", F.lit(i).alias("list")) for i, d in enumerate(results)]
    first = reduce(lambda a, b: a.unionByName(b), parts).groupBy("id").agg(F.min_by("score", "list").alias("score"))
    return first.orderBy(F.desc("score"), "id").limit(n)


def mentions_both(text: Column, a: str, b: str) -> Column:
    """Any word of a, and any word of b."""
    low = F.lower(text)
    some = lambda s: reduce(lambda x, y: x | y, (low.contains(w) for w in s.lower().split()))
    return some(a) & some(b)


def answer_mode(question: Column, modes: dict[str, tuple[str, ...]]) -> Column:
    """The mode with the most of its words in the question; the first one on ties or none."""
    low = F.lower(question)
    counts = [(F.lit(m), reduce(lambda a, b: a + b, (low.contains(w).cast("int") for w in ws))) for m, ws in modes.items()]
    best = F.greatest(*(c for _, c in counts))
    return F.coalesce(*(F.when(c == best, m) for m, c in counts))


def template_search(question: str, templates: dict[str, list[str]], words: dict[str, tuple[str, ...]], vectors: DataFrame, model: Embedder, n: int) -> DataFrame:
    """id, score of the n rows of vectors(id, vector) nearest to made-up answers: the templates of the question's mode
    (that with the most of its words in it, the first on ties), filled with it and embedded. A row that several answers
    find keeps its score for the first."""
    low = question.lower()
    mode = max(templates, key=lambda m: sum(w in low for w in words.get(m, ())))
    answers = model.vectors([t.format(question=question) for t in templates[mode]])
    return merged_searches([nearest(vectors, "id", "vector", v.tolist(), n) for v in answers], n)


def golden_hits(results: DataFrame, golden: DataFrame) -> DataFrame:
    """results(query_id, rank, text), golden(query_id, terms, k): the terms that occur, in a spelling with blanks or
    hyphens too, in the first k results, and their number."""
    j = results.join(golden, "query_id").filter("rank <= k")
    forms = lambda t: F.array(t, F.replace(t, F.lit("_"), F.lit(" ")), F.replace(t, F.lit("_"), F.lit("-")))
    hits = j.select("query_id", F.explode(F.filter("terms", lambda t: F.exists(forms(F.lower(t)), lambda v: F.lower(F.col("text")).contains(v)))).alias("term"))
    found = hits.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("hits"))
    return golden.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("hits", F.array().cast("array<string>")).alias("hits"), F.coalesce(F.size("hits"), F.lit(0)).alias("n"))
