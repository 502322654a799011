"""Queries of retrieval and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import search as S
from lodestone.operators import vectors as V
from lodestone.operators.relational import top_k
from lodestone.operators.scratch import materialise, scratch_dir
from lodestone.operators.text_index import TextIndex
from lodestone.plans.registry import Tables, query

#: SQL of the terms of a text: words without stop words, stemmed.
_STOP = ", ".join(f"'{w}'" for w in S.STOP_WORDS)
_TERMS = "list_transform(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '' AND x NOT IN (" + _STOP + ")), lambda x: CASE WHEN length(x) >= 5 THEN regexp_replace(x, '(ingly|edly|ings|ing|ies|ied|ed|es|s|ly)$', '') ELSE x END)"
_TOK = f", tok AS (SELECT doc_id, source, {_TERMS} AS t FROM documents)"
QUERY = ["thth", "anth"]


def _tf(i: int) -> str:
    return f"len(list_filter(t, lambda x: x = '{QUERY[i]}'))"


@query("txt_01_all_terms_match", _TOK + " SELECT doc_id FROM tok WHERE list_contains(t, 'thth') AND list_contains(t, 'anth')")
def _(t: Tables):
    return t("documents").select("doc_id", S.terms(F.col("text")).alias("t")).filter(S.has_all_terms(F.col("t"), QUERY)).select("doc_id")


@query("txt_02_saturated_rank", _TOK + f" SELECT doc_id, round(0.1 * (1 - 1.0 / (1 + {_tf(0)})) + 0.1 * (1 - 1.0 / (1 + {_tf(1)})), 6) AS score FROM tok WHERE list_contains(t, 'thth') OR list_contains(t, 'anth')")
def _(t: Tables):
    d = t("documents").select("doc_id", S.terms(F.col("text")).alias("t"))
    return d.filter(F.array_contains("t", QUERY[0]) | F.array_contains("t", QUERY[1])).select("doc_id", F.round(S.saturated_rank(F.col("t"), QUERY), 6).alias("score"))


@query("txt_02_bm25", _TOK + f""", f AS (SELECT doc_id, len(t) AS n, {_tf(0)} AS a, {_tf(1)} AS b FROM tok), s AS (SELECT count(*) AS docs, avg(n) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM f)
SELECT doc_id, round(ln(1 + (s.docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (s.docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)), 6) AS score FROM f, s WHERE a > 0 OR b > 0""")
def _(t: Tables):
    return S.bm25(t("documents"), "doc_id", "text", QUERY).withColumn("score", F.round("score", 6))


_PLACES = ", pl AS (SELECT doc_id, list_filter(range(len(t)), lambda i: t[i + 1] = 'thth') AS a, list_filter(range(len(t)), lambda i: t[i + 1] = 'anth') AS b FROM tok), ab AS (SELECT doc_id, unnest(a) AS a, b FROM pl WHERE len(a) > 0 AND len(b) > 0), cover AS (SELECT doc_id, round(1.0 / min(list_min(list_transform(b, lambda x: abs(x - a))) + 1), 6) AS score FROM ab GROUP BY doc_id)"


@query("txt_03_cover_density", _TOK + _PLACES + " SELECT doc_id, score FROM cover")
def _(t: Tables):
    d = t("documents").select("doc_id", S.terms(F.col("text")).alias("t")).filter(S.has_all_terms(F.col("t"), QUERY))
    return d.select("doc_id", F.round(S.cover_density(F.col("t"), QUERY), 6).alias("score"))


_INDEXES: dict[tuple[str, str], TextIndex] = {}


def _index(t: Tables) -> TextIndex:
    """The index of documents, made once for a session: in two parts, the second of which also has what is known."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _INDEXES:
        index, d = TextIndex(t.spark, scratch_dir(t.spark)), t("documents").select("doc_id", "text")
        index.add(d.filter("doc_id % 3 = 0"), "doc_id", "text")
        index.add(d, "doc_id", "text")
        _INDEXES[key] = index
    return _INDEXES[key]


@query("txt_01_indexed_match", _TOK + " SELECT doc_id FROM tok WHERE list_contains(t, 'thth') AND list_contains(t, 'anth')")
def _(t: Tables):
    return _index(t).all_terms(QUERY).select(F.col("key").alias("doc_id"))


_BM25 = _TOK + f""", f AS (SELECT doc_id, len(t) AS n, {_tf(0)} AS a, {_tf(1)} AS b FROM tok), s AS (SELECT count(*) AS docs, avg(n) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM f),
bm AS (SELECT doc_id, ln(1 + (s.docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (s.docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)) AS score FROM f, s WHERE a > 0 OR b > 0)"""


@query("txt_02_indexed_bm25", _BM25 + " SELECT doc_id, round(score, 6) AS score FROM bm")
def _(t: Tables):
    return _index(t).bm25(QUERY).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query("txt_02_indexed_best", _BM25 + " SELECT round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank, doc_id FROM bm QUALIFY rank <= 20")
def _(t: Tables):
    best = _index(t).bm25(QUERY, 20).withColumn("one", F.lit(1))
    return top_k(best, ["one"], [F.desc(F.round("score", 9)), F.asc("key")], 20, "rank").select(F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"), F.col("key").alias("doc_id"))


@query("txt_03_indexed_cover", _TOK + _PLACES + " SELECT doc_id, score FROM cover")
def _(t: Tables):
    return _index(t).cover_density(QUERY).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


_ITEMS = ", it AS (SELECT item_id, list_slice(" + _TERMS + ", 1, 6) AS w FROM benchmark), aw AS (SELECT item_id, unnest(w) AS term FROM it), asked AS (SELECT item_id, term, count(*) AS times FROM aw GROUP BY ALL)"


@query("rnk_03_batch_lexical", _TOK + _ITEMS + """, st AS (SELECT count(*) AS docs, avg(len(t)) AS m FROM tok), each AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM tok), tf AS (SELECT doc_id, n, term, count(*) AS tf FROM each GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
sc AS (SELECT item_id, doc_id, sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / m))) AS score FROM asked JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL)
SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc QUALIFY rank <= 5""")
def _(t: Tables):
    """The first words of all benchmark items as queries, in one plan over the postings."""
    asked = t("benchmark").select("item_id", F.slice(S.terms(F.col("text")), 1, 6).alias("w"))
    best = _index(t).search(asked, "item_id", "w", 8).withColumn("r", F.round("score", 9))
    return top_k(best.drop("rank"), ["item_id"], [F.desc("r"), F.asc("key")], 5, "rank").select("item_id", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("txt_04_weighted_fields", "SELECT c.chunk_id, c.name, any_value(round((1 - 1.0 / (1 + CASE WHEN name LIKE '%red%' THEN 1 ELSE 0 END)) * 1.0 + (1 - 1.0 / (1 + CASE WHEN chunk_type = 'red' THEN 1 ELSE 0 END)) * 0.4, 6)) AS score FROM code_chunks c WHERE regexp_matches(name, '(^|_)red(_|$)') GROUP BY c.chunk_id, c.name")
def _(t: Tables):
    c = t.code_chunks.select("chunk_id", "name", F.split("name", "_").alias("a"), F.array("chunk_type").alias("b")).filter(F.array_contains("a", "red"))
    return c.select("chunk_id", "name", F.round(S.weighted_fields([(F.col("a"), 1.0), (F.col("b"), 0.4)], ["red"]), 6).alias("score")).distinct()


@query("txt_05_position_fusion", """, a AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer ORDER BY rank LIMIT 40), b AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_name, c_custkey) AS rank FROM customer WHERE c_acctbal > 5000 ORDER BY rank LIMIT 30), s AS (SELECT id, (1 - (rank - 1) / 40.0) * 0.7 AS s FROM a UNION ALL SELECT id, (1 - (rank - 1) / 30.0) * 0.3 FROM b)
SELECT id, round(sum(s) + CASE WHEN count(*) > 1 THEN 0.1 ELSE 0 END, 6) AS score FROM s GROUP BY id""")
def _(t: Tables):
    c = t("customer").withColumnRenamed("c_custkey", "id")
    cut = lambda d, order, k: top_k(d.withColumn("one", F.lit(1)), ["one"], order, k, "rank").select("id", "rank")
    a = cut(c.orderBy(F.desc("c_acctbal"), "id").limit(40), [F.desc("c_acctbal"), F.asc("id")], 40)
    b = cut(c.filter("c_acctbal > 5000").orderBy("c_name", "id").limit(30), [F.asc("c_name"), F.asc("id")], 30)
    return S.position_fusion([(a, 0.7), (b, 0.3)], "id").withColumn("score", F.round("score", 6))


_Q = ", q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 3)"
_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), q)"


def _vector(t: Tables, i: int) -> list[float]:
    return list(t("embeddings").filter(F.col("vec_id") == i).first()["embedding"])


@query("vec_01_cosine_top_k", _Q + f" SELECT vec_id, round({_COS}, 6) AS score FROM embeddings, q WHERE label <> 0 ORDER BY {_COS} DESC, vec_id LIMIT 20")
def _(t: Tables):
    return S.nearest(t("embeddings"), "vec_id", "embedding", _vector(t, 3), 20, F.col("label") != 0).withColumn("score", F.round("score", 6))


@query("vec_02_per_collection_cap", _Q + f", r AS (SELECT label, vec_id, {_COS} AS s, row_number() OVER (PARTITION BY label ORDER BY {_COS} DESC, vec_id) AS r FROM embeddings, q) SELECT label, vec_id, round(s, 6) AS score FROM r WHERE r <= 5 ORDER BY s DESC, vec_id LIMIT 15")
def _(t: Tables):
    q = F.array(*(F.lit(float(x)) for x in _vector(t, 3)))
    s = t("embeddings").select("label", "vec_id", S.cosine(F.col("embedding"), q).alias("score"))
    return top_k(s, ["label"], [F.desc("score"), F.asc("vec_id")], 5).orderBy(F.desc("score"), "vec_id").limit(15).withColumn("score", F.round("score", 6))


@query("vec_03_best_per_title", """, q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id < 4), s AS (SELECT label, vec_id, max(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q)) AS s FROM embeddings, q GROUP BY 1, 2)
SELECT label, arg_max(vec_id, (s, -vec_id)) AS vec_id, round(max(s), 6) AS score FROM s WHERE s >= 0.05 GROUP BY label""")
def _(t: Tables):
    qs = F.greatest(*(S.cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in _vector(t, i)))) for i in range(4)))
    s = t("embeddings").select("label", "vec_id", qs.alias("s")).filter("s >= 0.05")
    return s.groupBy("label").agg(F.max_by("vec_id", F.struct("s", -F.col("vec_id"))).alias("vec_id"), F.round(F.max("s"), 6).alias("score"))


@query("vec_04_nearest_join", """, q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 100 = 0), r AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS s, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id) AS r FROM embeddings, q)
SELECT query_id, vec_id, round(s, 6) AS score, r AS rank FROM r WHERE r <= 5""")
def _(t: Tables):
    e = t("embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return S.nearest_join(e, "vec_id", "embedding", queries, "query_id", "q", 5).withColumn("score", F.round("score", 6))


@query("vec_04_cell_index", """, q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 20 = 0), r AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS s, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) DESC, vec_id) AS r FROM embeddings, q)
SELECT query_id, vec_id, round(s, 6) AS score, r AS rank FROM r WHERE r <= 10""")
def _(t: Tables):
    e = t("embeddings")
    index = V.CellIndex.build(e, "vec_id", "embedding", scratch_dir(t.spark))
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return index.search(queries, "query_id", "q", 10).select("query_id", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


#: The embeddings, and a disturbed copy of each: by nothing, a little or much, as its number says.
_DISTURBED = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings UNION ALL SELECT vec_id + 10000000, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + 0.001 * (vec_id % 40) * ((i * 7 + vec_id) % 11 - 5)) FROM embeddings"


def _disturbed(t: Tables):
    e = t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    moved = F.transform("v", lambda x, i: x + 0.001 * (F.col("vec_id") % 40) * (((i + 1) * 7 + F.col("vec_id")) % 11 - 5))
    return e.unionByName(e.withColumn("v", moved).withColumn("vec_id", F.col("vec_id") + 10_000_000))  # one after the other: moved uses the old number


@query("vec_05_near_duplicates", f", d AS MATERIALIZED ({_DISTURBED}), c AS MATERIALIZED (SELECT min(vec_id) AS id, v FROM d GROUP BY v) SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.v, y.v), 6) AS score FROM c x JOIN c y ON x.id < y.id AND list_cosine_similarity(x.v, y.v) >= 0.99")
def _(t: Tables):
    return V.near_pairs(_disturbed(t), "vec_id", "v", 0.99, recall=0.99999).withColumn("score", F.round("score", 6))


@query("vec_05_representatives", f", d AS ({_DISTURBED}) SELECT vec_id, min(vec_id) OVER (PARTITION BY v) AS rep FROM d")
def _(t: Tables):
    return V.representatives(_disturbed(t), "vec_id", "v")


@query("vec_06_embed_text")
def _(t: Tables):
    return S.embed(t("benchmark"), "item_id", "text", S.HashingEmbedder(32))


def _channels(t: Tables):
    """Two ranked lists of document ids: by BM25, and by nearness of the vector of the same number."""
    lex = S.bm25(t("documents"), "doc_id", "text", QUERY).select(F.col("doc_id").alias("id"), F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id").limit(50)
    vec = S.nearest(t("embeddings"), "vec_id", "embedding", _vector(t, 3), 50).select(F.col("vec_id").alias("id"), F.round("score", 9).alias("score"))
    number = lambda d: top_k(d.withColumn("one", F.lit(1)), ["one"], [F.desc("score"), F.asc("id")], 50, "rank").select("id", "rank")
    return number(lex), number(vec)


_CHANNELS = _TOK + f""", f AS (SELECT doc_id, len(t) AS n, {_tf(0)} AS a, {_tf(1)} AS b FROM tok), s AS (SELECT count(*) AS docs, avg(n) AS m, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM f),
bm AS (SELECT doc_id AS id, round(ln(1 + (s.docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / m)) + ln(1 + (s.docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / m)), 9) AS score FROM f, s WHERE a > 0 OR b > 0),
q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 3), cs AS (SELECT vec_id AS id, round({_COS}, 9) AS score FROM embeddings, q),
lex AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM bm QUALIFY rank <= 50), vec AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM cs QUALIFY rank <= 50),
fused AS (SELECT id, sum(1.0 / (60 + rank)) AS score FROM (SELECT * FROM lex UNION ALL SELECT * FROM vec) GROUP BY id)"""


@query("rnk_01_reciprocal_rank_fusion", _CHANNELS + " SELECT id, round(score, 9) AS score FROM fused")
def _(t: Tables):
    return S.rank_fusion(list(_channels(t)), "id").select("id", F.round("score", 9).alias("score"))


@query("rnk_02_rerank")
def _(t: Tables):
    """The best 50 of the fused channels over all documents and vectors, as far as a document has that number."""
    fused = S.rank_fusion(list(_channels(t)), "id").select(F.col("id").alias("doc_id"), "score").join(t("documents").select("doc_id").distinct(), "doc_id", "left_semi")
    best = fused.orderBy(F.desc("score"), "doc_id").limit(50).select("doc_id")
    return S.rerank(t("documents").select("doc_id", "text").join(F.broadcast(best), "doc_id"), "doc_id", "text", "the of and in", S.OverlapReranker())


@query("rnk_03_hybrid_search")
def _(t: Tables):
    fused = S.rank_fusion(list(_channels(t)), "id").orderBy(F.desc("score"), "id").limit(50)
    texts = t("documents").select(F.col("doc_id").alias("id"), "text").join(F.broadcast(fused), "id")
    return texts.select("id", "score").join(S.rerank(texts, "id", "text", " ".join(QUERY), S.OverlapReranker()), "id").orderBy(F.desc("rerank_score"), F.desc("score"), "id").limit(10)


@query("rnk_04_concept_lookup", "SELECT * FROM (SELECT DISTINCT ON (passage_id) passage_id, concept, confidence, title FROM passage_concepts JOIN passages USING (passage_id) JOIN documents_kb USING (doc_id) WHERE concept ILIKE '%widget%' ORDER BY passage_id, confidence DESC, concept) ORDER BY confidence DESC, passage_id LIMIT 25")
def _(t: Tables):
    from lodestone.operators.relational import distinct_on, matches_any

    hits = distinct_on(t.passage_concepts.filter(matches_any(F.col("concept"), ["widget"])), ["passage_id"], [F.desc("confidence"), F.asc("concept")])
    j = hits.join(t.passages.select("passage_id", "doc_id"), "passage_id").join(t.documents_kb.select("doc_id", "title"), "doc_id")
    return j.orderBy(F.desc("confidence"), "passage_id").limit(25).select("passage_id", "concept", "confidence", "title")


@query("rnk_05_three_channels", """, g AS (SELECT DISTINCT b.concept AS id FROM passage_concepts a JOIN passage_concepts b USING (passage_id) WHERE a.concept = 'red_ring'), a AS (SELECT concept AS id, row_number() OVER (ORDER BY count(*) DESC, concept) AS rank FROM passage_concepts GROUP BY concept QUALIFY rank <= 20), b AS (SELECT concept AS id, row_number() OVER (ORDER BY avg(confidence) DESC, concept) AS rank FROM passage_concepts GROUP BY concept QUALIFY rank <= 20), c AS (SELECT id, row_number() OVER (ORDER BY id) AS rank FROM g QUALIFY rank <= 20)
SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS channels FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY id""")
def _(t: Tables):
    p = t.passage_concepts
    stats = p.groupBy(F.col("concept").alias("id")).agg(F.count("*").alias("n"), F.avg("confidence").alias("m"))
    near = p.filter("concept = 'red_ring'").select("passage_id").distinct().join(p, "passage_id").select(F.col("concept").alias("id")).distinct()
    one = lambda d, *order: top_k(d.withColumn("one", F.lit(1)), ["one"], list(order), 20, "rank").select("id", "rank")
    lists = [one(stats, F.desc("n"), F.asc("id")), one(stats, F.desc("m"), F.asc("id")), one(near, F.asc("id"))]
    both = lists[0].union(lists[1]).union(lists[2])
    return both.groupBy("id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"), F.count("*").alias("channels"))


_EXPLAINED = _BM25 + f""", q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 3),
lex AS (SELECT doc_id AS id, round(score, 9) AS s, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank, [] AS path FROM bm QUALIFY rank <= 30),
vec AS (SELECT vec_id AS id, round({_COS}, 9) AS s, row_number() OVER (ORDER BY round({_COS}, 9) DESC, vec_id) AS rank, [] AS path FROM embeddings, q QUALIFY rank <= 30),
near AS (SELECT doc_id AS id, count(DISTINCT passage_id) AS s, list_sort(list(DISTINCT concept)) AS path FROM passage_concepts JOIN passages USING (passage_id) WHERE contains(concept, 'ring') GROUP BY doc_id),
gra AS (SELECT id, s, row_number() OVER (ORDER BY s DESC, id) AS rank, path FROM near QUALIFY rank <= 30),
al AS (SELECT 0 AS c, 'vector' AS channel, id, s, rank, path FROM vec UNION ALL SELECT 1, 'lexical', * FROM lex UNION ALL SELECT 2, 'graph', id, s, rank, path FROM gra)
"""


@query("rnk_05_explained", _EXPLAINED + "SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score, string_agg(channel || ':' || rank || ':' || CAST(round(s * 1000) AS BIGINT) || ':' || len(path), ' ' ORDER BY c) AS trace, max(coalesce(path[1], '')) AS first_step FROM al GROUP BY id")
def _(t: Tables):
    """Vectors, words and the concept graph, fused, with what each channel added and the concepts that led to a document."""
    cut = lambda d: top_k(d.withColumn("one", F.lit(1)), ["one"], [F.desc("score"), F.asc("id")], 30, "rank").drop("one")
    vec = S.nearest(t("embeddings"), "vec_id", "embedding", _vector(t, 3), 60).select(F.col("vec_id").alias("id"), F.round("score", 9).alias("score"))
    lex = _index(t).bm25(QUERY, 60).select(F.col("key").alias("id"), F.round("score", 9).alias("score"))
    ring = t.passage_concepts.filter(F.col("concept").contains("ring")).join(t.passages.select("passage_id", "doc_id"), "passage_id")
    gra = ring.groupBy(F.col("doc_id").alias("id")).agg(F.count_distinct("passage_id").alias("score"), F.array_sort(F.collect_set("concept")).alias("path"))
    fused = S.explained_fusion({"vector": cut(vec), "lexical": cut(lex), "graph": cut(gra)}, "id")
    told = F.transform("trace", lambda x: F.concat_ws(":", x["channel"], x["rank"], F.round(x["score"] * 1000).cast("bigint"), F.size(x["path"])))
    first = F.array_max(F.transform("trace", lambda x: F.coalesce(F.try_element_at(x["path"], F.lit(1)), F.lit(""))))
    return fused.select("id", F.round("score", 9).alias("score"), F.array_join(told, " ").alias("trace"), first.alias("first_step"))


_MORE = [*QUERY, "ithth"]
_HYBRID = _CHANNELS + f""", gr AS (SELECT doc_id AS id, count(DISTINCT passage_id) AS score FROM passage_concepts JOIN passages USING (passage_id) WHERE contains(concept, 'ring') GROUP BY doc_id),
ex AS (SELECT doc_id AS id, round({' + '.join(f"0.1 * (1 - 1.0 / (1 + len(list_filter(t, lambda x: x = '{q}'))))" for q in _MORE)}, 9) AS score FROM tok WHERE {' OR '.join(f"list_contains(t, '{q}')" for q in _MORE)}),
al AS (SELECT 0 AS list, id, rank FROM vec UNION ALL SELECT 1, id, rank FROM lex UNION ALL SELECT 2, id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM gr QUALIFY rank <= 50 UNION ALL SELECT 3, id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM ex QUALIFY rank <= 50)
SELECT id, round(sum(1.0 / (60 + rank)), 9) AS score, min(list) AS first_list FROM al GROUP BY id ORDER BY round(sum(1.0 / (60 + rank)), 12) DESC, min(list), id LIMIT 50"""


@query("rnk_06_hybrid_with_graph", _HYBRID)
def _(t: Tables):
    """Nearest vectors, words by BM25, documents by their passages with a concept, and the expanded query's words, fused."""
    vec = S.nearest(t("embeddings"), "vec_id", "embedding", _vector(t, 3), 50).select(F.col("vec_id").alias("id"), F.round("score", 9).alias("score"))
    lex = S.bm25(t("documents"), "doc_id", "text", QUERY).select(F.col("doc_id").alias("id"), F.round("score", 9).alias("score"))
    ring = t.passage_concepts.filter(F.col("concept").contains("ring")).select("passage_id").distinct()
    graph = t.passages.join(ring, "passage_id").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").cast("double").alias("score"))
    words = t("documents").select(F.col("doc_id").alias("id"), S.terms(F.col("text")).alias("t")).filter(F.arrays_overlap("t", F.array(*map(F.lit, _MORE))))
    return S.hybrid([vec, lex, graph, words.select("id", F.round(S.saturated_rank(F.col("t"), _MORE), 9).alias("score"))], "id", 50).withColumn("score", F.round("score", 9))


SYNONYMS = {"ring": ("loop", "band"), "red": ("scarlet",), "bolt": ("screw", "pin")}


@query("rnk_07_expanded_query", "SELECT p_partkey, p_name || CASE WHEN p_name LIKE '%ring%' THEN ' OR loop OR band' ELSE '' END || CASE WHEN p_name LIKE '%red%' THEN ' OR scarlet' ELSE '' END || CASE WHEN p_name LIKE '%bolt%' THEN ' OR screw OR pin' ELSE '' END AS q FROM part")
def _(t: Tables):
    return t("part").select("p_partkey", S.expanded_query(F.col("p_name"), SYNONYMS).alias("q"))


FAMILIES = {"metal": ("ring", "bolt", "nut"), "colour": ("red", "blue", "green"), "size": ("small", "large")}


@query("rnk_08_bridge_boost", "SELECT p_partkey, round(p_retailprice * CASE WHEN (CASE WHEN regexp_matches(p_name, 'ring|bolt|nut') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(p_name, 'red|blue|green') THEN 1 ELSE 0 END) + (CASE WHEN regexp_matches(p_name, 'small|large') THEN 1 ELSE 0 END) >= 2 THEN 1.2 ELSE 1 END, 6) AS score FROM part")
def _(t: Tables):
    return t("part").select("p_partkey", F.round(S.bridge_boost(F.col("p_retailprice"), F.col("p_name"), FAMILIES), 6).alias("score"))


_POSTINGS = ", pc AS (SELECT passage_id AS id, concept, max(confidence) AS score FROM passage_concepts GROUP BY 1, 2)"


def _hop_sql(words: list[str], n: int, i: int = 0) -> str:
    """Tables f<i> to r<i>: hits of the words, concepts of the best ten, their best items, and the boosted result."""
    has = " + ".join(f"CASE WHEN bool_or(regexp_matches(concept, '{'|'.join(ws)}')) THEN 1 ELSE 0 END" for ws in FAMILIES.values())
    return f""", f{i} AS (SELECT id, round(sum(score), 4) AS score FROM pc WHERE regexp_matches(concept, '{'|'.join(words)}') GROUP BY id ORDER BY 2 DESC, id LIMIT {2 * n}),
w{i} AS (SELECT concept FROM pc WHERE id IN (SELECT id FROM f{i} ORDER BY score DESC, id LIMIT 10) GROUP BY concept ORDER BY count(*) DESC, concept LIMIT 5),
m{i} AS (SELECT id, score FROM pc WHERE concept IN (FROM w{i}) QUALIFY row_number() OVER (PARTITION BY concept ORDER BY score DESC, id) <= 3),
u{i} AS (SELECT id, score FROM f{i} UNION ALL SELECT id, max(score) FROM m{i} WHERE id NOT IN (SELECT id FROM f{i}) GROUP BY id),
d{i} AS (SELECT id, {has} AS n FROM pc WHERE id IN (SELECT id FROM u{i}) GROUP BY id),
r{i} AS (SELECT id, score * CASE WHEN n >= 2 THEN CAST(1.2 AS DOUBLE) ELSE 1 END AS score FROM u{i} JOIN d{i} USING (id) ORDER BY 2 DESC, id LIMIT {n})"""


def _hop(t: Tables, words: list[str], n: int):
    """Passages by the confidence of their concepts that have some of the words, and one hop from them."""
    postings = t.passage_concepts.groupBy(F.col("passage_id").alias("id"), "concept").agg(F.max("confidence").alias("score"))
    first = postings.filter(F.col("concept").rlike("|".join(words))).groupBy("id").agg(F.round(F.sum("score"), 4).alias("score"))
    return S.multi_hop(first.orderBy(F.desc("score"), "id").limit(2 * n), postings, FAMILIES, n)


@query("rnk_08_multi_hop", _POSTINGS + _hop_sql(["ring", "loop", "band"], 10) + " SELECT id, round(score, 6) AS score FROM r0")
def _(t: Tables):
    """The words are those of the expanded query."""
    return _hop(t, ["ring", *SYNONYMS["ring"]], 10).withColumn("score", F.round("score", 6))


PATTERNS = {"ring": ("bolt",), "red": ("blue", "green"), "large": ("small",)}


@query("rnk_09_oblique_search", _POSTINGS + _hop_sql(["bolt"], 5, 0) + _hop_sql(["blue"], 5, 1) + _hop_sql(["green"], 5, 2) + """, a AS (SELECT 0 AS list, * FROM r0 UNION ALL SELECT 1, * FROM r1 UNION ALL SELECT 2, * FROM r2)
SELECT id, round(arg_min(score, list), 6) AS score FROM a GROUP BY id ORDER BY arg_min(score, list) DESC, id LIMIT 15""")
def _(t: Tables):
    """The problem in words of other fields: at most three searches, merged."""
    queries = S.abstracted("a large red ring", PATTERNS)
    return S.merged_searches([_hop(t, [q], 5) for q in queries], 15).withColumn("score", F.round("score", 6))


@query("rnk_10_bridge_keywords", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'token') OR contains(lower(text), '@')) AND (contains(lower(text), 'license') OR contains(lower(text), 'an'))")
def _(t: Tables):
    return t("documents").filter(S.mentions_both(F.col("text"), "token @", "license an")).select("doc_id")


@query("rnk_11_answer_mode", "SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'metal' WHEN p_name LIKE '%red%' OR p_name LIKE '%blue%' THEN 'colour' ELSE 'metal' END AS mode FROM part")
def _(t: Tables):
    return t("part").select("p_partkey", S.answer_mode(F.col("p_name"), {"metal": ("ring",), "colour": ("red", "blue")}).alias("mode"))


TEMPLATES = {"method": ["We apply {question} to new data and report", "A method for {question} that"], "finding": ["We find that {question}", "The results show {question} in"]}


@query("rnk_11_template_search")
def _(t: Tables):
    model = S.HashingEmbedder(32)
    vectors = materialise(S.embed(t("benchmark"), "item_id", "text", model).select(F.col("item_id").alias("id"), "vector"))
    return S.template_search("how is the text of a license used", TEMPLATES, {"method": ("how", "apply"), "finding": ("what", "why")}, vectors, model, 10)


@query("rnk_12_channel_fusion", """, v AS (SELECT c_custkey AS id, c_acctbal / 10000 AS s FROM customer WHERE c_acctbal > 2000), g AS (SELECT o_custkey AS id, count(*) / 40.0 AS g, count(*) FILTER (WHERE o_orderstatus = 'F') AS r FROM orders WHERE o_totalprice > 250000 GROUP BY 1)
SELECT coalesce(v.id, g.id) AS id, round(0.6 * coalesce(s, 0) + 0.4 * coalesce(g, 0) + CASE WHEN v.id IS NOT NULL AND g.id IS NOT NULL THEN 0.2 ELSE 0 END + 0.05 * coalesce(r, 0), 6) AS score FROM v FULL JOIN g ON v.id = g.id""")
def _(t: Tables):
    v = t("customer").filter("c_acctbal > 2000").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 10000).alias("semantic"))
    g = t("orders").filter("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("id")).agg((F.count("*") / 40.0).alias("graph"), F.count_if(F.col("o_orderstatus") == "F").alias("related"))
    return S.channel_fusion(v, g, "id").withColumn("score", F.round("score", 6))


@query("rnk_13_cross_reference", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'red') AND contains(p_name, 'widget')")
def _(t: Tables):
    return t("part").filter(F.col("p_name").contains("red") & F.col("p_name").contains("widget")).select("p_partkey", "p_name")


@query("rnk_14_golden_hits", """, r AS (SELECT c_nationkey AS query_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, lower(c_mktsegment) AS text FROM customer), h AS (SELECT DISTINCT query_id, w FROM r, (SELECT unnest(['build', 'auto', 'machinery']) AS w) WHERE rank <= 5 AND contains(text, w))
SELECT DISTINCT c_nationkey AS query_id, coalesce((SELECT string_agg(w, ',' ORDER BY w) FROM h WHERE h.query_id = c_nationkey), '') AS hits FROM customer""")
def _(t: Tables):
    r = top_k(t("customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 5, "rank").select(F.col("c_nationkey").alias("query_id"), "rank", F.col("c_mktsegment").alias("text"))
    golden = t("customer").select(F.col("c_nationkey").alias("query_id")).distinct().select("query_id", F.array(*map(F.lit, ("build", "auto", "machinery"))).alias("terms"), F.lit(5).alias("k"))
    return S.golden_hits(r, golden).select("query_id", F.array_join("hits", ",").alias("hits"))
