"""Queries of scores, trends, market series, hypotheses, evidence and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.text import lower_each, text_quality, upper_each
from lodestone.operators import evidence as E
from lodestone.operators import quality as Q
from lodestone.operators import relational as R
from lodestone.operators import scoring as S
from lodestone.operators.search import nearest
from lodestone.plans.registry import Tables, query

_AS_OF = "DATE '2024-02-01'"


def _as_of():
    return F.lit("2024-02-01").cast("date")


# -- scores ---------------------------------------------------------------------------------------------------------


@query("sco_01_popularity", ", th AS (SELECT * FROM (VALUES ('click', 1, 100), ('view', 10, 1000)) v(source, low, high)) SELECT event_id, round(CASE WHEN th.low IS NULL OR coalesce(k, 0) <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, (log10(greatest(k, 1)) - log10(th.low)) / (log10(th.high) - log10(th.low)))) END, 6) AS popularity FROM feed LEFT JOIN th USING (source)")
def _(t: Tables):
    th = t.spark.createDataFrame([("click", 1, 100), ("view", 10, 1000)], "source string, low int, high int")
    return S.popularity(t.feed, th, "k").select("event_id", F.round("popularity", 6).alias("popularity"))


@query("sco_02_freshness", f"SELECT event_id, round(CASE WHEN event_id % 10 = 0 THEN 0.5 WHEN date_diff('day', CAST(ts AS DATE), {_AS_OF}) <= 0 THEN 1.0 ELSE pow(2, -date_diff('day', CAST(ts AS DATE), {_AS_OF}) / 30.0) END, 6) AS freshness FROM feed")
def _(t: Tables):
    d = F.when(F.col("event_id") % 10 != 0, F.to_date("ts"))
    return t.feed.select("event_id", F.round(S.freshness(d, _as_of(), 30.0), 6).alias("freshness"))


@query("sco_03_bridge", "SELECT passage_id, CAST(CASE WHEN count(DISTINCT field) >= 4 THEN 1.0 WHEN count(DISTINCT field) = 3 THEN 0.6 WHEN count(DISTINCT field) = 2 THEN 0.2 ELSE 0.0 END AS DOUBLE) AS bridge FROM passage_concepts GROUP BY passage_id")
def _(t: Tables):
    return t.passage_concepts.groupBy("passage_id").agg(S.bridge_score(F.count_distinct("field")).cast("double").alias("bridge"))


@query("sco_04_gap_fill", """, n AS (SELECT concept, count(*) // 60 AS n FROM passage_concepts GROUP BY concept), i AS (SELECT DISTINCT passage_id, concept FROM passage_concepts WHERE version = 'A') SELECT passage_id, round(avg(CASE WHEN n = 0 THEN 1.0 WHEN n < 5 THEN 0.8 WHEN n < 20 THEN 0.4 ELSE 0.1 END), 6) AS gap FROM i JOIN n USING (concept) GROUP BY passage_id""")
def _(t: Tables):
    p = t.passage_concepts
    known = p.groupBy("concept").agg(F.floor(F.count("*") / 60).alias("n"))
    items = p.filter("version = 'A'").groupBy("passage_id").agg(F.collect_set("concept").alias("c"))
    return S.gap_fill(items, "passage_id", "c", known).withColumn("gap", F.round("gap", 6))


@query("sco_05_trust", "SELECT c_custkey, CAST(CASE WHEN lower(c_mktsegment) LIKE '%build%' THEN 0.95 WHEN lower(c_name) = 'customer#000000001' THEN 0.8 ELSE 0.3 END AS DOUBLE) AS trust FROM customer")
def _(t: Tables):
    return t("customer").select("c_custkey", S.trust(F.array("c_name"), ["customer#000000001"], ["build"], F.col("c_mktsegment")).cast("double").alias("trust"))


@query("sco_06_information_gain", """, c AS (SELECT passage_id, list(DISTINCT field) AS f FROM passage_concepts GROUP BY passage_id) SELECT passage_id, round(greatest(0, len(list_intersect(f, ['Brand#1', 'Brand#2'])) / 2 * 0.9, len(list_intersect(f, ['Brand#3', 'Brand#4', 'Brand#5'])) / 3 * 0.6), 6) AS gain FROM c""")
def _(t: Tables):
    c = t.passage_concepts.groupBy("passage_id").agg(F.collect_set("field").alias("f"))
    return c.select("passage_id", F.round(S.information_gain(F.col("f"), [(["Brand#1", "Brand#2"], 0.9), (["Brand#3", "Brand#4", "Brand#5"], 0.6)]), 6).alias("gain"))


@query("sco_07_priority", "SELECT event_id, round(0.15 * k / 100 + 0.10 * 0.5 + 0.25 * 0.6 + 0.15 * 0.4 + 0.15 * 0.3 + 0.20 * (k % 10) / 10, 6) AS priority, k < 30 AND true AS hidden_gem FROM feed")
def _(t: Tables):
    f = t.feed
    p = S.priority({"popularity": F.col("k") / 100, "freshness": F.lit(0.5), "bridge": F.lit(0.6), "gap": F.lit(0.4), "trust": F.lit(0.3), "information": F.col("k") % 10 / 10})
    return f.select("event_id", F.round(p, 6).alias("priority"), S.hidden_gem(F.col("k") / 100, F.lit(0.6), F.col("k") % 10 / 10).alias("hidden_gem"))


@query("sco_08_scored_feed", """, r AS (SELECT *, row_number() OVER (PARTITION BY source, user_id ORDER BY ts, event_id) AS r FROM feed) SELECT source, user_id, event_id, value FROM r WHERE r = 1 ORDER BY value DESC, event_id LIMIT 100""")
def _(t: Tables):
    once = R.keep_max(t.feed.select("source", "user_id", "event_id", "value", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("at")), ["source", "user_id"], F.struct("at", -F.col("event_id")))
    return once.orderBy(F.desc("value"), "event_id").limit(100).select("source", "user_id", "event_id", "value")


@query("sco_09_repository_relevance", "SELECT p_partkey, round((CASE WHEN contains(p_name, 'red') OR contains(p_name, 'blue') THEN 0.3 ELSE 0.0 END) + (CASE WHEN contains(p_name, 'ring') THEN 0.3 ELSE 0.0 END) + (CASE WHEN contains(p_name, 'bolt') OR contains(p_name, 'gear') THEN 0.2 ELSE 0.0 END) + (CASE WHEN p_size > 0 THEN least(0.3, log10(p_size + 1) / 10) ELSE 0.0 END) + (CASE WHEN p_partkey % 3 = 0 THEN 0.1 ELSE 0.0 END) + (CASE p_brand WHEN 'Brand#1' THEN 0.5 WHEN 'Brand#2' THEN 0.3 ELSE 0.0 END), 6) AS score FROM part")
def _(t: Tables):
    language = F.when(F.col("p_partkey") % 3 == 0, "Python").otherwise("R")
    score = S.repository_relevance(F.col("p_name"), F.col("p_size"), language, F.col("p_brand"), [(["red", "blue"], 0.3), (["ring"], 0.3), (["bolt", "gear"], 0.2)], {"Brand#1": 0.5, "Brand#2": 0.3})
    return t("part").select("p_partkey", F.round(score, 6).alias("score"))


@query("sco_10_key_file_priority", r""", d AS (SELECT doc_id, source, len(regexp_extract_all(text, '\n')) + 1 AS lines, len(regexp_extract_all(text, '\n[A-Z]')) AS defs FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(0.3 * least(defs * 100.0 / lines / 10, 1.0) + 0.4 * (CASE WHEN lines BETWEEN 5 AND 40 THEN 1.0 ELSE 0.5 END) + 0.3 * (CASE WHEN contains(source, '1') THEN 1.5 WHEN contains(source, '2') THEN 0.7 ELSE 1.0 END), 6) AS priority FROM d""")
def _(t: Tables):
    return t("documents").filter("text IS NOT NULL").select("doc_id", F.round(S.key_file_priority(F.col("text"), F.col("source"), "\n[A-Z]", (5, 40), "1", "2"), 6).alias("priority"))


@query("sco_11_novelty", """, g AS (SELECT field, concept, count(*) AS n FROM passage_concepts GROUP BY 1, 2) SELECT field, concept, CAST(round(greatest(0.3, least(0.95, CASE n % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 0.2 WHEN 2 THEN 0.3 WHEN 3 THEN 0.4 ELSE 0.35 END + CASE WHEN n = 0 THEN 0.4 WHEN n < 3 THEN 0.3 WHEN n < 10 THEN 0.2 WHEN n < 30 THEN 0.15 ELSE 0.05 END + CASE WHEN n // 4 = 0 THEN 0.2 WHEN n // 4 < 5 THEN 0.15 ELSE 0.1 END)), 6) AS DOUBLE) AS novelty FROM g""")
def _(t: Tables):
    g = t.passage_concepts.groupBy("field", "concept").agg(F.count("*").alias("n"))
    return g.select("field", "concept", F.round(S.novelty(F.col("n") % 5, F.col("n"), F.floor(F.col("n") / 4)), 6).alias("novelty"))


@query("sco_12_hypothesis_rank", "SELECT DISTINCT field, concept, CAST(7.0 + (CASE WHEN contains(field, '#1') THEN 2.0 ELSE 0.0 END) + (CASE WHEN contains(lower(concept), 'red') THEN 1.5 ELSE 0.0 END) + (CASE WHEN contains(lower(concept), 'ring') THEN 1.0 ELSE 0.0 END) AS DOUBLE) AS score FROM passage_concepts")
def _(t: Tables):
    pairs = t.passage_concepts.select("field", "concept").distinct()
    return pairs.withColumn("score", S.hypothesis_rank(F.col("field"), F.col("concept"), {"#1": 2.0}, {"red": 1.5, "ring": 1.0}))


@query("sco_13_velocity_steps", f"SELECT event_id, CAST(CASE WHEN d < 7 THEN 1.0 WHEN d < 30 THEN 0.8 WHEN d < 90 THEN 0.5 WHEN d < 180 THEN 0.2 ELSE 0.0 END AS DOUBLE) AS velocity FROM (SELECT event_id, date_diff('day', CAST(ts AS DATE), {_AS_OF}) AS d FROM feed)")
def _(t: Tables):
    return t.feed.select("event_id", S.velocity_step(F.to_date("ts"), _as_of()).cast("double").alias("velocity"))


# -- trends ---------------------------------------------------------------------------------------------------------


@query("trd_01_gaps", """, h AS (SELECT passage_id, max(confidence) AS s FROM passage_concepts WHERE concept LIKE 'red%' GROUP BY passage_id ORDER BY s DESC, passage_id LIMIT 50), y AS (SELECT count(*) AS papers, count(*) FILTER (WHERE year BETWEEN 1996 AND 1998) AS recent FROM h JOIN passages USING (passage_id)), c AS (SELECT concept, count(*) AS n FROM h JOIN passage_concepts USING (passage_id) GROUP BY concept), tc AS (SELECT string_agg(concept, ',' ORDER BY n DESC, concept) AS top_concepts, bool_or(concept IN ('blue_ring', 'blue_bolt')) AS any_method FROM (SELECT * FROM c ORDER BY n DESC, concept LIMIT 10)), rc AS (SELECT coalesce(string_agg(concept, ',' ORDER BY concept), '') AS rare_concepts FROM (SELECT * FROM c WHERE n = 1 ORDER BY concept LIMIT 10)) SELECT papers, recent, recent < 5 AS recency_gap, top_concepts, rare_concepts, NOT any_method AS method_gap FROM y, tc, rc""")
def _(t: Tables):
    """The papers that a search for the topic gives, 50 at most, and what they leave open."""
    hits = t.passage_concepts.filter("concept LIKE 'red%'").groupBy("passage_id").agg(F.max("confidence").alias("s")).orderBy(F.desc("s"), "passage_id").limit(50)
    hits = t.passages.select("passage_id", "year").join(F.broadcast(hits.select("passage_id")), "passage_id")
    g = S.topic_gaps(hits, t.passage_concepts, "passage_id", "year", "concept", 1998, ["blue_ring", "blue_bolt"])
    return g.select("papers", "recent", "recency_gap", F.array_join("top_concepts", ",").alias("top_concepts"), F.array_join("rare_concepts", ",").alias("rare_concepts"), "method_gap")


_YEARS = ", y AS (SELECT concept, CAST(year(created_at) AS INTEGER) AS year FROM passage_concepts)"


@query("trd_02_trend_radar", _YEARS + " SELECT concept, count(*) FILTER (WHERE year IN (1998, 1997)) AS recent, count(*) FILTER (WHERE year IN (1995, 1994)) AS before, count(*) FILTER (WHERE year IN (1998, 1997)) - count(*) FILTER (WHERE year IN (1995, 1994)) AS velocity, CASE WHEN max(CASE WHEN year >= 1997 THEN 1 END) IS NULL THEN 'gone' WHEN max(CASE WHEN year <= 1995 THEN 1 END) IS NULL THEN 'emerging' ELSE 'established' END AS state FROM y GROUP BY concept")
def _(t: Tables):
    return S.trend_radar(t.passage_concepts.select("concept", F.year("created_at").alias("year")), "concept", "year", 1998)


@query("trd_03_competitor_watch", "SELECT venue, count(*) AS papers, count(*) FILTER (WHERE p.year >= 1998) AS recent, count(*) FILTER (WHERE lower(section) LIKE '%high%') AS overlap FROM passages p JOIN documents_kb USING (doc_id) GROUP BY venue")
def _(t: Tables):
    j = t.passages.join(t.documents_kb.select("doc_id", "venue"), "doc_id")
    return j.groupBy("venue").agg(F.count("*").alias("papers"), F.count_if(F.col("year") >= 1998).alias("recent"), F.count_if(F.lower("section").contains("high")).alias("overlap"))


@query("trd_04_dataset_hunt", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'token|license|mail')")
def _(t: Tables):
    return t("documents").filter(F.lower("text").rlike("token|license|mail")).select("doc_id")


@query("trd_05_collection_health", "SELECT count(*) AS passages, count(*) FILTER (WHERE page_num >= 0) AS citable, round(100.0 * count(*) FILTER (WHERE page_num >= 0) / count(*), 4) AS percent, count(DISTINCT doc_id) AS documents FROM passages")
def _(t: Tables):
    g = t.passages.agg(F.count("*").alias("passages"), F.count_if(F.col("page_num") >= 0).alias("citable"), F.count_distinct("doc_id").alias("documents"))
    return g.withColumn("percent", R.share(F.col("citable"), F.col("passages"), 4))


@query("trd_06_expansion_targets", "SELECT concept, count(DISTINCT doc_id) AS documents FROM passage_concepts JOIN passages USING (passage_id) WHERE confidence = 1.0 AND version = 'A' GROUP BY concept HAVING count(DISTINCT doc_id) < 20")
def _(t: Tables):
    p = t.passage_concepts.filter("confidence = 1.0 AND version = 'A'").select("passage_id", "concept")
    return p.join(t.passages.select("passage_id", "doc_id"), "passage_id").groupBy("concept").agg(F.count_distinct("doc_id").alias("documents")).filter("documents < 20")


_HUNT = "SELECT kind, vec_id AS id, round(s, 3) AS score FROM (SELECT CASE WHEN label < 5 THEN 'paper' ELSE 'code' END AS kind, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)) AS s FROM embeddings) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY s DESC, vec_id) <= CASE WHEN kind = 'paper' THEN 20 ELSE 10 END"


@query("trd_07_deep_hunt", _HUNT)
def _(t: Tables):
    """The 20 papers and the 10 pieces of code that are nearest to a question's vector."""
    e = t("embeddings")
    q = list(e.filter("vec_id = 3").first()["embedding"])
    best = lambda kind, k, cond: nearest(e, "vec_id", "embedding", q, k, cond).select(F.lit(kind).alias("kind"), F.col("vec_id").alias("id"), F.round("score", 3).alias("score"))
    return best("paper", 20, F.col("label") < 5).unionByName(best("code", 10, F.col("label") >= 5))


# -- market ---------------------------------------------------------------------------------------------------------


@query("mkt_01_tone_classes", "SELECT CASE WHEN value >= 15 THEN 'very_positive' WHEN value >= 11.5 THEN 'positive' WHEN value >= 8.5 THEN 'neutral' WHEN value >= 5 THEN 'negative' ELSE 'very_negative' END AS tone, count(*) AS n FROM feed GROUP BY 1")
def _(t: Tables):
    return t.feed.groupBy(S.tone_class(F.col("value") - 10).alias("tone")).agg(F.count("*").alias("n"))


_DAYS = ", d AS (SELECT source, CAST(ts AS DATE) AS day, avg(value) AS v, count(*) AS n FROM feed GROUP BY 1, 2)"


@query("mkt_02_sentiment_trend", _DAYS + """, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day) AS a, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS z FROM d), g AS (SELECT source, avg(v) FILTER (WHERE a <= 3) AS early, avg(v) FILTER (WHERE z <= 3) AS recent FROM r GROUP BY source) SELECT source, round(early, 6) AS early, round(recent, 6) AS recent, CASE WHEN recent - early > 0.5 THEN 'improving' WHEN recent - early < -0.5 THEN 'declining' ELSE 'stable' END AS direction FROM g""")
def _(t: Tables):
    s = S.sentiment_trend(t.feed.withColumn("day", F.to_date("ts")), "source", "day", "value")
    return s.select("source", F.round("early", 6).alias("early"), F.round("recent", 6).alias("recent"), "direction")


@query("mkt_03_volume_velocity", _DAYS + """, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY day DESC) AS z FROM d) SELECT source, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (WHERE z <= 3) AS BIGINT) AS last3, round(sum(n) FILTER (WHERE z <= 3) / avg(n), 6) AS ratio FROM r GROUP BY source""")
def _(t: Tables):
    d = t.feed.groupBy("source", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return S.volume_velocity(d, "source", "day").select("source", "total", "last3", F.round("ratio", 6).alias("ratio"))


@query("mkt_04_compare_entities", ", g AS (SELECT user_id, count(*) AS n FROM feed GROUP BY user_id) SELECT user_id, n, row_number() OVER (ORDER BY n DESC, user_id) AS rank FROM g")
def _(t: Tables):
    g = t.feed.groupBy("user_id").agg(F.count("*").alias("n"))
    return R.ranked(g, [F.desc("n"), F.asc("user_id")]).select("user_id", "n", "rank")


@query("mkt_05_event_mentions", "SELECT source, count(*) AS n, round(sum(value), 4) AS tone, count(*) FILTER (WHERE abs(value) >= 15) AS significant, arg_max(event_id, (value, event_id)) AS highest, arg_min(event_id, (value, event_id)) AS lowest FROM feed GROUP BY source")
def _(t: Tables):
    at = F.struct("value", "event_id")
    return t.feed.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("tone"), F.count_if(F.abs("value") >= 15).alias("significant"), F.max(at)["event_id"].alias("highest"), F.min(at)["event_id"].alias("lowest"))


@query("mkt_06_diversity", "SELECT r_name, count(DISTINCT c_nationkey) AS nations, count(DISTINCT c_mktsegment) AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(t: Tables):
    n = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count_distinct("c_nationkey").alias("nations"), F.count_distinct("c_mktsegment").alias("segments"))


@query("mkt_07_landscape_gaps", _YEARS + " SELECT concept, count(*) AS count, CASE WHEN count(*) FILTER (WHERE year > 1995) < 0.7 * count(*) FILTER (WHERE year <= 1995 AND year > 1992) THEN 'declining' WHEN count(*) FILTER (WHERE year > 1995) > 1.3 * count(*) FILTER (WHERE year <= 1995 AND year > 1992) THEN 'growing' ELSE 'stable' END AS trend, count(*) <= 2 AS rare FROM y GROUP BY concept")
def _(t: Tables):
    return S.landscape_gap(t.passage_concepts.select("concept", F.year("created_at").alias("year")), "concept", "year", 1998).select("concept", "count", "trend", "rare")


@query("mkt_08_jurisdictions", ", c AS (SELECT c_custkey AS a, c_custkey // 2 AS b FROM customer WHERE c_custkey > 0) SELECT x.k AS node, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM (SELECT c_custkey AS k FROM customer) x LEFT JOIN (SELECT a, count(*) AS n FROM c GROUP BY a) o ON o.a = x.k LEFT JOIN (SELECT b, count(*) AS n FROM c GROUP BY b) i ON i.b = x.k")
def _(t: Tables):
    """One pass over both ends of the edges, and one shuffle by node."""
    k = t("customer").select(F.col("c_custkey").alias("node"))
    c = k.filter("node > 0").select("node", F.floor(F.col("node") / 2).alias("b"))
    ends = k.select("node", F.lit(0).alias("o"), F.lit(0).alias("i")).union(c.select("node", F.lit(1), F.lit(0))).union(c.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


@query("mkt_07_assignee_velocity", """, f AS (SELECT field, CAST(year(created_at) AS INTEGER) AS year, concept FROM passage_concepts), g AS (SELECT field, count(*) AS total, count(*) FILTER (WHERE year IN (1998, 1997)) AS recent FROM f GROUP BY field), r AS (SELECT field, concept, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, concept) AS r FROM f GROUP BY field, concept), a AS (SELECT field, string_agg(concept, ',' ORDER BY r) AS areas FROM r WHERE r <= 10 GROUP BY field) SELECT field, total, recent, areas FROM g JOIN a USING (field)""")
def _(t: Tables):
    f = t.passage_concepts.select("field", F.year("created_at").alias("year"), "concept")
    return S.assignee_velocity(f, "field", "year", "concept", 1998).select("field", "total", "recent", F.array_join("areas", ",").alias("areas"))


@query("mkt_08_coverage", "SELECT source, count(*) AS cases, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM documents WHERE contains(lower(text), 'the') GROUP BY source ORDER BY cases DESC, source LIMIT 10")
def _(t: Tables):
    return S.jurisdiction_coverage(t("documents").filter(F.lower("text").contains("the")), "source")


@query("mkt_08_precedents", """, m AS (SELECT doc_id, source, len(regexp_extract_all(lower(text), 'the')) AS score FROM documents WHERE contains(lower(text), 'the')), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS r FROM m) SELECT doc_id, max(score) AS score FROM r WHERE r <= 10 GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20""")
def _(t: Tables):
    m = t("documents").filter(F.lower("text").contains("the")).select("doc_id", "source", F.regexp_count(F.lower("text"), F.lit("the")).alias("score"))
    return S.precedents(m, "doc_id", "source", "score")


@query("mkt_09_presence_flags", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, bool_or(c_nationkey = 3) AS in_three, bool_or(c_acctbal > 9999) AS rich FROM customer GROUP BY c_mktsegment")
def _(t: Tables):
    return t("customer").groupBy("c_mktsegment").agg(F.count_distinct("c_nationkey").alias("nations"), F.bool_or(F.col("c_nationkey") == 3).alias("in_three"), F.bool_or(F.col("c_acctbal") > 9999).alias("rich"))


# -- hypotheses -----------------------------------------------------------------------------------------------------


@query("hyp_01_chain_confidence", ", q AS (SELECT unnest(['ring', 'bolt', 'widget', 'nothing']) AS q), h AS (SELECT q, count(p_partkey) AS n FROM q LEFT JOIN part ON contains(p_name, q) GROUP BY q) SELECT round(avg(least(0.9, least(n, 10) / 10.0)), 6) AS confidence FROM h")
def _(t: Tables):
    q = t.spark.createDataFrame([("ring",), ("bolt",), ("widget",), ("nothing",)], "q string")
    hits = t("part").join(F.broadcast(q), F.col("p_name").contains(F.col("q"))).groupBy("q").agg(F.count("*").alias("n"))
    h = q.join(hits, "q", "left").select(F.least(F.lit(0.9), F.least(F.coalesce("n", F.lit(0)), F.lit(10)) / 10.0).alias("c"))
    return h.agg(F.round(F.avg("c"), 6).alias("confidence"))


@query("hyp_02_support_balance", ", s AS (SELECT source, CASE WHEN contains(lower(text), 'not ') OR contains(lower(text), 'failed') OR contains(lower(text), 'unable') OR contains(lower(text), 'incorrect') OR lang = 'de' AND contains(lower(text), 'not ') THEN 0 ELSE 1 END AS s FROM documents), g AS (SELECT source, sum(s) AS y, sum(1 - s) AS n FROM s GROUP BY source) SELECT source, round(y / (y + n), 6) AS confidence, CASE WHEN y / (y + n) > 0.6 THEN 'supported' WHEN y / (y + n) > 0.4 THEN 'needs_investigation' ELSE 'not_supported' END AS verdict FROM g")
def _(t: Tables):
    b = S.support_balance(F.col("text"))
    g = t("documents").groupBy("source").agg(F.count_if(b > 0).alias("y"), F.count_if(b < 0).alias("n"))
    v = S.verdict(F.col("y"), F.col("n"))
    return g.select("source", F.round(v["confidence"], 6).alias("confidence"), v["verdict"].alias("verdict"))


@query("hyp_03_analogies_by_domain", "SELECT field, arg_max(concept, (confidence, concept)) AS concept, max(confidence) AS confidence FROM passage_concepts WHERE field <> 'Brand#1' GROUP BY field ORDER BY confidence DESC, field LIMIT 8")
def _(t: Tables):
    """The surest concept of each other domain, one a domain."""
    p = t.passage_concepts.filter("field <> 'Brand#1'").select("field", "concept", "confidence")
    return R.keep_max(p, ["field"], F.struct("confidence", "concept")).orderBy(F.desc("confidence"), "field").limit(8)


@query("hyp_04_serendipity", "SELECT concept, count(DISTINCT field) AS fields FROM passage_concepts WHERE confidence >= 0.95 GROUP BY concept HAVING count(DISTINCT field) >= 2 ORDER BY fields DESC, md5(concept) LIMIT 5")
def _(t: Tables):
    """Concepts of several domains, in an order that has nothing to do with their names."""
    g = t.passage_concepts.filter("confidence >= 0.95").groupBy("concept").agg(F.count_distinct("field").alias("fields")).filter("fields >= 2")
    return g.orderBy(F.desc("fields"), F.md5("concept")).limit(5)


# -- evidence -------------------------------------------------------------------------------------------------------

_PASS = ", ps AS (SELECT doc_id AS passage_id, doc_id % 6 - 1 AS page_num, round((doc_id % 100) / 100.0, 2) AS quality, text FROM documents)"


def _passages(t: Tables):
    return t("documents").select(F.col("doc_id").alias("passage_id"), (F.col("doc_id") % 6 - 1).alias("page_num"), F.round(F.col("doc_id") % 100 / 100.0, 2).alias("quality"), "text")


@query("evd_01_candidate_passages", _PASS + """, h AS (SELECT *, (CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(text), 'thing') THEN 1 ELSE 0 END) AS hits FROM ps WHERE page_num >= 0 AND quality >= 0.7), o AS (SELECT *, row_number() OVER (PARTITION BY substr(text, 1, 100) ORDER BY hits DESC, quality DESC, passage_id) AS r FROM h WHERE hits > 0) SELECT passage_id, CAST(hits AS INTEGER) AS hits FROM o WHERE r = 1 ORDER BY hits DESC, quality DESC, passage_id LIMIT 20""")
def _(t: Tables):
    return E.candidate_passages(_passages(t), ["the", "thing"]).select("passage_id", "hits")


@query("evd_02_sentences")
def _(t: Tables):
    return E.sentence_rows(_passages(t))


@query("evd_03_scored_pairs")
def _(t: Tables):
    s = E.sentence_rows(_passages(t).filter("page_num = 0")).withColumn("claim", F.lit("the thing is there"))
    return E.scored(s, E.OverlapScorer())


@query("evd_04_gate", "SELECT passage_id, seq, part_id FROM passage_concepts JOIN passages USING (passage_id) WHERE (seq % 10) / 10.0 <= 0.7 AND confidence >= 0.5 AND page_num >= 0")
def _(t: Tables):
    j = t.passage_concepts.join(t.passages.select("passage_id", "page_num"), "passage_id").withColumn("entailment", F.col("confidence")).withColumn("contradiction", F.col("seq") % 10 / 10.0)
    return E.gated(j).select("passage_id", "seq", "part_id")


@query("evd_05_new_spans", """, k AS (SELECT passage_id, seq, max(confidence) AS c FROM passage_concepts GROUP BY 1, 2), m AS (SELECT count(*) AS m FROM k WHERE c >= 0.7) SELECT passage_id, seq, m + row_number() OVER (ORDER BY passage_id, seq) AS span_id FROM k, m WHERE c < 0.7""")
def _(t: Tables):
    k = t.passage_concepts.groupBy("passage_id", "seq").agg(F.max("confidence").alias("c"))
    stored = R.ranked(k.filter("c >= 0.7").drop("c"), [F.asc("passage_id"), F.asc("seq")], "span_id")
    return E.new_spans(stored, k.drop("c"), ["passage_id", "seq"], "span_id").select("passage_id", "seq", "span_id")


@query("evd_06_citations_of_claims", "SELECT concept AS claim, count(DISTINCT doc_id) AS documents, string_agg(DISTINCT title, '; ' ORDER BY title) AS titles FROM passage_concepts JOIN passages USING (passage_id) JOIN documents_kb USING (doc_id) WHERE confidence = 1.0 AND field = 'Brand#1' GROUP BY concept")
def _(t: Tables):
    p = t.passage_concepts.filter("confidence = 1.0 AND field = 'Brand#1'").select("passage_id", F.col("concept").alias("claim"))
    j = p.join(t.passages.select("passage_id", "doc_id"), "passage_id").join(t.documents_kb.select("doc_id", "title"), "doc_id")
    return j.groupBy("claim").agg(F.count_distinct("doc_id").alias("documents"), F.array_join(F.array_sort(F.collect_set("title")), "; ").alias("titles"))


@query("evd_07_answer_status", "SELECT p.passage_id AS claim_id, count(concept) AS n_links, max(confidence) AS best, CASE WHEN count(concept) > 0 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status FROM passages p LEFT JOIN passage_concepts c ON c.passage_id = p.passage_id AND confidence >= 0.9 GROUP BY 1")
def _(t: Tables):
    links = t.passage_concepts.filter("confidence >= 0.9").select(F.col("passage_id").alias("claim_id"), F.col("confidence").alias("entailment"))
    return E.answer_status(t.passages.select(F.col("passage_id").alias("claim_id")), links)


@query("evd_08_grant_grade", "SELECT version, count(*) FILTER (WHERE concept_type = 'economy' AND confidence >= 0.8 AND quality >= 0.5) AS n, CASE WHEN max(confidence) >= 0.8 THEN 'strong' WHEN max(confidence) >= 0.6 THEN 'partial' ELSE 'weak' END AS support FROM passage_concepts JOIN passages USING (passage_id) GROUP BY version")
def _(t: Tables):
    j = t.passage_concepts.join(t.passages.select("passage_id", "quality"), "passage_id")
    kind = F.when(F.col("concept_type") == "economy", "literal").otherwise("inferred")
    return j.groupBy("version").agg(F.count_if(E.grant_grade(kind, F.col("confidence"), F.col("quality"))).alias("n"), E.support_type(F.max("confidence")).alias("support"))


@query("rul_01_tautologies", """, x AS (SELECT passage_id, list(DISTINCT concept) AS o, list(DISTINCT field) AS i FROM passage_concepts GROUP BY passage_id) SELECT passage_id, CASE WHEN passage_id % 2 = 0 THEN 'output_is_input,nothing_new' ELSE '' END AS broken FROM x""")
def _(t: Tables):
    x = t.passage_concepts.groupBy("passage_id").agg(F.collect_set("concept").alias("o"), F.collect_set("field").alias("i"))
    ins = F.when(F.col("passage_id") % 2 == 0, F.col("o")).otherwise(F.col("i"))
    return x.select("passage_id", F.array_join(E.tautologies(ins, F.col("o"), F.array().cast("array<string>")), ",").alias("broken"))


@query("rul_02_answer_score", "SELECT passage_id, CAST(greatest(0, 100 - 10 * (passage_id % 4) - 5 * (passage_id % 7) - 2 * (passage_id % 3) - CASE WHEN page_num >= 0 THEN 0 ELSE 20 END) AS BIGINT) AS score FROM passages")
def _(t: Tables):
    i = F.col("passage_id")
    return t.passages.select("passage_id", E.answer_score(i % 4, i % 7, i % 3, F.col("page_num") >= 0).cast("bigint").alias("score"))


@query("rul_03_citation_audit", ", c AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'd' END AS doi, CASE WHEN doc_id % 5 <> 0 THEN title END AS title, doc_id % 2 = 0 AS verified FROM documents_kb) SELECT CASE WHEN doi IS NULL AND title IS NULL THEN 'unusable' WHEN verified THEN 'verified' WHEN doi IS NULL THEN 'no_doi' ELSE 'unverified' END AS state, count(*) AS n FROM c GROUP BY 1")
def _(t: Tables):
    i = F.col("doc_id")
    c = t.documents_kb.select(i.alias("id"), F.when(i % 3 == 0, "d").alias("doi"), F.when(i % 5 != 0, F.col("title")).alias("title"), (i % 2 == 0).alias("verified"))
    return E.citation_audit(c).drop("ids")


# -- audits ---------------------------------------------------------------------------------------------------------


@query("qa_01_invariants", "SELECT 'repeated_keys' AS \"check\", count(*) - count(DISTINCT (passage_id, concept, version)) AS bad FROM passage_concepts UNION ALL SELECT 'confidence_range', count(*) FILTER (WHERE confidence < 0 OR confidence > 1 OR confidence IS NULL) FROM passage_concepts UNION ALL SELECT 'known_types', count(*) FILTER (WHERE concept_type NOT IN ('economy', 'small', 'standard')) FROM passage_concepts UNION ALL SELECT 'orphans', count(*) FROM passage_concepts WHERE passage_id NOT IN (SELECT passage_id FROM passages)")
def _(t: Tables):
    return Q.invariants(t.passage_concepts, t.passages, ["passage_id", "concept", "version"], ["economy", "small", "standard"]).drop("passed")


@query("qa_04_evidence_coverage", "SELECT count(*) AS rows, count(*) FILTER (WHERE confidence >= 0.6) AS having, round(100.0 * count(*) FILTER (WHERE confidence >= 0.6) / count(*), 4) AS percent FROM passage_concepts")
def _(t: Tables):
    return Q.coverage(t.passage_concepts, F.col("confidence") >= 0.6, 99.0).drop("passed")


@query("qa_06_golden_concepts", ", g AS (SELECT 'a' AS q, ['Brand#1', 'Brand#2'] AS w UNION ALL SELECT 'b', ['Brand#3', 'Brand#4', 'Brand#5']), h AS (SELECT q, passage_id FROM passage_concepts JOIN g ON list_contains(w, field) GROUP BY q, passage_id, len(w) HAVING count(DISTINCT field) = len(w)) SELECT q, count(*) AS hits FROM h GROUP BY q")
def _(t: Tables):
    p, make = t.passage_concepts.select("passage_id", "field"), t.spark.createDataFrame
    one = lambda q, ws: R.having_all(p, "passage_id", "field", make([(w,) for w in ws], "w string")).agg(F.count("*").alias("hits")).select(F.lit(q).alias("q"), "hits")
    return one("a", ["Brand#1", "Brand#2"]).union(one("b", ["Brand#3", "Brand#4", "Brand#5"])).filter("hits > 0")


@query("qa_07_quotes_in_passages", "SELECT count(*) AS n, count(*) FILTER (WHERE contains(lower(text), lower(substr(CASE WHEN doc_id % 10 = 0 THEN 'zzzz' || text ELSE upper(substr(text, 5)) END, 1, 50)))) AS matched FROM documents WHERE length(text) > 60 AND lang = 'en'")
def _(t: Tables):
    d = t("documents").filter((F.length("text") > 60) & (F.col("lang") == "en"))
    # letters keep their number, so the quote is cut before it is capitalised
    quote = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("zzzz"), F.substring("text", 1, 46))).otherwise(upper_each(F.substring("text", 5, 50)))
    return d.agg(F.count("*").alias("n"), F.count_if(lower_each(F.col("text")).contains(lower_each(quote))).alias("matched"))


@query("qa_08_distribution", ", g AS (SELECT passage_id, count(*) AS n FROM passage_concepts GROUP BY passage_id) SELECT CASE WHEN n < 3 THEN 'few' WHEN n < 6 THEN 'some' ELSE 'many' END AS bucket, count(*) AS passages FROM g GROUP BY 1")
def _(t: Tables):
    g = t.passage_concepts.groupBy("passage_id").agg(F.count("*").alias("n"))
    return g.groupBy(R.bucketed(F.col("n"), [(3, "few"), (6, "some")], "many").alias("bucket")).agg(F.count("*").alias("passages"))


@query("qa_09_concept_quality", "SELECT count(*) AS concepts, count(DISTINCT concept) AS names, round(100.0 * count(*) FILTER (WHERE length(concept) <= 2 OR starts_with(concept, 'test_') OR starts_with(concept, '_') OR concept IN ('unknown', 'none', 'other', 'misc', 'n_a')) / count(*), 4) AS junk_percent, round(count(*) / count(DISTINCT passage_id), 4) AS per_passage FROM passage_concepts")
def _(t: Tables):
    return Q.concept_quality(t.passage_concepts)


@query("qa_10_drift", "SELECT 'documents' AS missing_in, (SELECT count(*) FROM (SELECT doc_id FROM labels UNION SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM documents)) AS n UNION ALL SELECT 'labels', (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM labels)) UNION ALL SELECT 'vectors', (SELECT count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels EXCEPT SELECT vec_id FROM embeddings))")
def _(t: Tables):
    return Q.drift({"documents": t("documents").select("doc_id"), "labels": t("labels").select("doc_id"), "vectors": t("embeddings").select(F.col("vec_id").alias("doc_id"))}, "doc_id")


@query("qa_11_linkage", "SELECT round(100.0 * count(p.passage_id) / count(*), 4) AS percent, 100.0 * count(p.passage_id) / count(*) >= 20 AS passed FROM documents_kb d LEFT JOIN (SELECT doc_id, min(passage_id) AS passage_id FROM passages GROUP BY doc_id) p USING (doc_id)")
def _(t: Tables):
    have = t.passages.select("doc_id").distinct().withColumn("p", F.lit(1))
    return Q.coverage(t.documents_kb.select("doc_id").join(have, "doc_id", "left"), F.col("p").isNotNull(), 20.0).select("percent", "passed")


@query("qa_12_topic_coverage", ", k AS (SELECT unnest(['ring', 'bolt', 'zebra']) AS keyword), c AS (SELECT keyword, (SELECT count(*) FROM part WHERE contains(p_name, keyword)) AS titles, (SELECT count(DISTINCT passage_id) FROM passage_concepts WHERE contains(concept, keyword)) AS concepts, (SELECT count(*) FROM supplier WHERE contains(lower(s_name), keyword)) AS code FROM k) SELECT keyword, titles, concepts, CASE WHEN greatest(titles, concepts) = 0 AND code = 0 THEN 'missing' WHEN greatest(titles, concepts) < 5 AND code < 2 THEN 'thin' ELSE 'ok' END AS status FROM c")
def _(t: Tables):
    k = t.spark.createDataFrame([("ring",), ("bolt",), ("zebra",)], "keyword string")
    b = F.broadcast(k)
    titles = t("part").join(b, F.col("p_name").contains(F.col("keyword"))).groupBy("keyword").agg(F.count("*").alias("titles"))
    concepts = t.passage_concepts.select("passage_id", "concept").join(b, F.col("concept").contains(F.col("keyword"))).groupBy("keyword").agg(F.count_distinct("passage_id").alias("concepts"))
    code = t("supplier").join(b, F.lower("s_name").contains(F.col("keyword"))).groupBy("keyword").agg(F.count("*").alias("code"))
    j = k.join(titles, "keyword", "left").join(concepts, "keyword", "left").join(code, "keyword", "left").na.fill(0)
    return j.select("keyword", "titles", "concepts", Q.coverage_status(F.col("titles"), F.col("concepts"), F.col("code")).alias("status"))


@query("qa_13_duplicates", ", h AS (SELECT sha256(text) AS hash, count(*) AS copies, arg_min(doc_id, (CASE WHEN source = 'src1' THEN 0 ELSE 1 END, doc_id)) AS kept FROM documents GROUP BY 1) SELECT hash, copies, kept FROM h WHERE copies > 1")
def _(t: Tables):
    return Q.duplicate_report(t("documents"), "doc_id", "text", F.when(F.col("source") == "src1", 0).otherwise(1))


@query("qa_14_sentinel")
def _(t: Tables):
    q = text_quality(F.col("text"))
    return t("documents").groupBy("source", q["label"].alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(q["score"]), 4).alias("score"))


@query("qa_15_tier_audit", "SELECT n_regionkey AS tier, count(DISTINCT n_nationkey) AS wanted, count(DISTINCT s_nationkey) AS there FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def _(t: Tables):
    s = t("supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(1).alias("s")).distinct()
    return t("nation").join(s, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("tier")).agg(F.count_distinct("n_nationkey").alias("wanted"), F.count("s").alias("there"))


@query("qa_16_vector_sizes", "SELECT len(embedding) AS size, count(*) AS n FROM embeddings GROUP BY 1")
def _(t: Tables):
    return t("embeddings").groupBy(F.size("embedding").cast("bigint").alias("size")).agg(F.count("*").alias("n"))


@query("qa_17_readiness", ", h AS (SELECT p_brand, count(*) FILTER (WHERE p_size > 25) AS n, count(*) AS m FROM part GROUP BY p_brand), s AS (SELECT avg(CASE WHEN n >= 3 THEN 1.0 ELSE 0.0 END) AS share FROM h) SELECT round(share, 6) AS share, CASE WHEN share >= 0.9 THEN 'A' WHEN share >= 0.8 THEN 'B' WHEN share >= 0.7 THEN 'C' ELSE 'F' END AS grade FROM s")
def _(t: Tables):
    h = t("part").groupBy("p_brand").agg(F.count_if(F.col("p_size") > 25).alias("n"))
    s = h.agg(F.avg(F.when(F.col("n") >= 3, 1.0).otherwise(0.0)).alias("share"))
    return s.select(F.round("share", 6).alias("share"), Q.grade(F.col("share")).alias("grade"))


@query("qa_18_latency", """, r AS (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, count(*) AS runs, round(avg(CASE WHEN value < 1 THEN 1.0 ELSE 0.0 END) * 100, 1) AS failure_rate, round(avg(value) * 1000, 1) AS mean_ms, round(max(value) FILTER (WHERE r = floor(n * 0.95)) * 1000, 1) AS p95_ms, round(avg(k) FILTER (WHERE value >= 1), 1) AS mean_concepts, round(count(*) / sum(value) * 60, 1) AS per_minute FROM r GROUP BY event_type""")
def _(t: Tables):
    runs = t("events").select("event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return Q.latency_report(runs, "event_type", "value", F.col("value") < 1, "k")
