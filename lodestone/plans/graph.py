"""Queries of graphs and corpus analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import atlas as A
from lodestone.operators import graph as G
from lodestone.operators.containment import containing
from lodestone.operators.scratch import scratch_dir
from lodestone.plans.registry import Tables, query

#: Papers use methods (fields) and mention concepts.
_REL = ", uses AS (SELECT DISTINCT passage_id AS paper, field AS method FROM passage_concepts), mentions AS (SELECT DISTINCT passage_id AS paper, concept FROM passage_concepts)"


#: The same with concepts told apart by the size of the part, of which many pairs never meet.
_FINE = ", uses AS (SELECT DISTINCT l_orderkey AS paper, p_brand AS method FROM lineitem JOIN part ON l_partkey = p_partkey), mentions AS (SELECT DISTINCT l_orderkey AS paper, p_name || ' ' || p_size AS concept FROM lineitem JOIN part ON l_partkey = p_partkey)"


def fine(t: Tables):
    part = t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("method"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("concept"))
    rows = t("lineitem").select(F.col("l_orderkey").alias("paper"), "l_partkey").join(part, "l_partkey").repartition("paper")
    return rows.select("paper", "method").distinct(), rows.select("paper", "concept").distinct()


def uses(t: Tables):
    return t.passage_concepts.select(F.col("passage_id").alias("paper"), F.col("field").alias("method")).distinct()


def mentions(t: Tables):
    return t.passage_concepts.select(F.col("passage_id").alias("paper"), "concept").distinct()


@query("gr_01_co_occurs", _REL + " SELECT a.concept AS a, b.concept AS b, count(*) AS weight FROM mentions a JOIN mentions b ON a.paper = b.paper AND a.concept < b.concept GROUP BY 1, 2 HAVING count(*) >= 2")
def _(t: Tables):
    return G.co_occurrence(mentions(t), "paper", "concept", 2)


@query("gr_02_counts_and_density", _REL + " SELECT (SELECT count(DISTINCT paper) FROM uses) AS papers, (SELECT count(DISTINCT concept) FROM mentions) AS concepts, (SELECT count(*) FROM mentions) AS edges, round(100.0 * (SELECT count(*) FROM mentions) / ((SELECT count(DISTINCT paper) FROM mentions) * (SELECT count(DISTINCT concept) FROM mentions)), 6) AS density")
def _(t: Tables):
    m = mentions(t).agg(F.count_distinct("paper").alias("papers"), F.count_distinct("concept").alias("concepts"), F.count("*").alias("edges"))
    return m.withColumn("density", F.round(F.try_divide(100.0 * F.col("edges"), F.col("papers") * F.col("concepts")), 6))


@query("gr_03_top_methods", _REL + " SELECT method, count(*) AS papers FROM uses GROUP BY method ORDER BY papers DESC, method LIMIT 10")
def _(t: Tables):
    return uses(t).groupBy("method").agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "method").limit(10)


@query("gr_04_combined_once", _FINE + " SELECT method, concept FROM uses JOIN mentions USING (paper) GROUP BY 1, 2 HAVING count(*) = 1")
def _(t: Tables):
    u, m = fine(t)
    return G.combinations(u, m, "paper", "method", "concept").filter("n = 1").select("method", "concept")


@query("gr_05_never_combined", _FINE + " SELECT m.method, c.concept FROM (SELECT DISTINCT method FROM uses) m, (SELECT DISTINCT concept FROM mentions) c EXCEPT SELECT method, concept FROM uses JOIN mentions USING (paper)")
def _(t: Tables):
    u, m = fine(t)
    return G.never_combined(u, m, "paper", "method", "concept")


@query("gr_06_analogies", _FINE + """, mc AS (SELECT method, concept, count(*) AS n FROM uses JOIN mentions USING (paper) GROUP BY 1, 2), r AS (SELECT a.concept AS c1, b.concept AS c2 FROM mentions a JOIN mentions b ON a.paper = b.paper AND a.concept <> b.concept GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT x.method, c1, c2 FROM mc x JOIN r ON x.concept = c1 WHERE x.n >= 2 AND NOT EXISTS (SELECT 1 FROM mc y WHERE y.method = x.method AND y.concept = c2)""")
def _(t: Tables):
    u, m = fine(t)
    return G.analogies(u, m, "paper", "method", "concept", 2)


@query("gr_07_bridge_papers", _REL + " SELECT paper, count(DISTINCT method) AS methods, count(DISTINCT concept) AS concepts FROM uses JOIN mentions USING (paper) GROUP BY paper HAVING count(DISTINCT method) >= 3 AND count(DISTINCT concept) >= 3")
def _(t: Tables):
    u, m = uses(t).groupBy("paper").agg(F.count("*").alias("methods")), mentions(t).groupBy("paper").agg(F.count("*").alias("concepts"))
    return u.join(m, "paper").filter("methods >= 3 AND concepts >= 3")


@query("gr_08_hub_gaps", _FINE + """, h AS (SELECT method FROM uses GROUP BY method HAVING count(*) >= 5), s AS (SELECT DISTINCT method, concept FROM uses JOIN mentions USING (paper)) SELECT h.method, c.concept FROM h, (SELECT DISTINCT concept FROM mentions) c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.method = h.method AND s.concept = c.concept)""")
def _(t: Tables):
    u, m = fine(t)
    hubs = u.groupBy("method").agg(F.count("*").alias("n")).filter("n >= 5").select("method")
    return G.never_combined(u.join(hubs, "method", "left_semi"), m, "paper", "method", "concept")


@query("gr_09_top_trajectories", _REL + " SELECT a.concept AS a, b.concept AS b, count(*) AS weight FROM mentions a JOIN mentions b ON a.paper = b.paper AND a.concept < b.concept GROUP BY 1, 2 ORDER BY weight DESC, a, b LIMIT 10")
def _(t: Tables):
    return G.co_occurrence(mentions(t), "paper", "concept", 2).orderBy(F.desc("weight"), "a", "b").limit(10)


@query("gr_10_method_co_occurrence", _REL + """, p AS (SELECT a.method AS x, b.method AS y, count(*) AS w FROM uses a JOIN uses b ON a.paper = b.paper AND a.method < b.method GROUP BY 1, 2) SELECT method, CAST(sum(w) AS BIGINT) AS weight, count(*) AS degree FROM (SELECT x AS method, w FROM p UNION ALL SELECT y, w FROM p) GROUP BY method""")
def _(t: Tables):
    p = G.both_ways(G.co_occurrence(uses(t), "paper", "method", 1))
    return p.groupBy(F.col("src").alias("method")).agg(F.sum("weight").alias("weight"), F.count("*").alias("degree"))


#: A sparse graph of customers: each is joined to the one of half its number, and to a neighbour in its nation's chain.
_TREE = ", e AS (SELECT c_custkey AS s, c_custkey // 2 AS d FROM customer WHERE c_custkey > 0), g AS (SELECT s, d FROM e UNION SELECT d, s FROM e)"


def tree(t: Tables):
    e = t("customer").filter("c_custkey > 0").select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 2).alias("dst"))
    return G.both_ways(e, "src", "dst").distinct()


@query("gr_11_shortest_path")
def _(t: Tables):
    return G.shortest_path(tree(t), 37, 51, 12).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"), "length")


@query("gr_12_hops", _TREE + """, h1 AS (SELECT DISTINCT d FROM g WHERE s = 20), h2 AS (SELECT DISTINCT g.d FROM h1 JOIN g ON g.s = h1.d), h3 AS (SELECT DISTINCT g.d FROM h2 JOIN g ON g.s = h2.d), r AS (SELECT 20 AS d, 0 AS dist UNION ALL SELECT d, 1 FROM h1 UNION ALL SELECT d, 2 FROM h2 UNION ALL SELECT d, 3 FROM h3) SELECT CAST(d AS BIGINT) AS node, CAST(min(dist) AS INTEGER) AS dist FROM r GROUP BY d""")
def _(t: Tables):
    start = t.spark.createDataFrame([("x", 20)], "origin string, node long")
    return G.k_hops(tree(t), start, 3).select("node", "dist")


@query("gr_12_bridges")
def _(t: Tables):
    return G.bridges_between(tree(t), [20, 21], [25], 4)


@query("gr_13_neighbourhood", _REL + " SELECT concept AS node, count(*) AS weight FROM mentions WHERE paper IN (SELECT paper FROM mentions WHERE concept = 'red_ring') AND concept <> 'red_ring' GROUP BY concept HAVING count(*) >= 2 ORDER BY weight DESC, node LIMIT 10")
def _(t: Tables):
    return G.neighbourhood(G.both_ways(G.co_occurrence(mentions(t), "paper", "concept", 2)), "red_ring", 10)


@query("gr_14_paths_between_names", _REL + """, e AS (SELECT DISTINCT a.concept AS s, b.concept AS d FROM mentions a JOIN mentions b ON a.paper = b.paper WHERE a.concept <> b.concept), h1 AS (SELECT s, d FROM e WHERE s LIKE 'red_%'), h2 AS (SELECT DISTINCT h1.s, e.d FROM h1 JOIN e ON h1.d = e.s), h3 AS (SELECT DISTINCT h2.s, e.d FROM h2 JOIN e ON h2.d = e.s), r AS (SELECT s, d, 1 AS n FROM h1 UNION ALL SELECT s, d, 2 FROM h2 UNION ALL SELECT s, d, 3 FROM h3) SELECT s AS src, d AS dst, CAST(min(n) AS INTEGER) AS hops FROM r WHERE d LIKE 'blue_%' AND s <> d GROUP BY s, d ORDER BY hops DESC, src, dst LIMIT 5""")
def _(t: Tables):
    """The longest of the shortest paths of one to three steps between names of two kinds."""
    e = G.both_ways(G.co_occurrence(mentions(t), "paper", "concept", 1)).select("src", "dst").distinct()
    start = e.filter(F.col("src").startswith("red_")).select(F.col("src").alias("origin"), F.col("src").alias("node")).distinct()
    found = G.k_hops(e, start, 3).filter(F.col("node").startswith("blue_") & (F.col("origin") != F.col("node")))
    return found.select(F.col("origin").alias("src"), F.col("node").alias("dst"), F.col("dist").alias("hops")).orderBy(F.desc("hops"), "src", "dst").limit(5)


@query("gr_15_random_gaps", _FINE + """, s AS (SELECT DISTINCT method, concept FROM uses JOIN mentions USING (paper)) SELECT m.method, c.concept FROM (SELECT DISTINCT method FROM uses) m, (SELECT DISTINCT concept FROM mentions) c WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.method = m.method AND s.concept = c.concept) ORDER BY md5(m.method || c.concept) LIMIT 5""")
def _(t: Tables):
    u, m = fine(t)
    return G.never_combined(u, m, "paper", "method", "concept").orderBy(F.md5(F.concat("method", "concept"))).limit(5).select("method", "concept")


@query("gr_16_orphan_papers", "SELECT passage_id, section AS keyword FROM passages WHERE passage_id NOT IN (SELECT passage_id FROM passage_concepts) AND section LIKE '%HIGH%'")
def _(t: Tables):
    orphans = t.passages.join(t.passage_concepts.select("passage_id"), "passage_id", "left_anti")
    return orphans.filter(F.col("section").contains("HIGH")).select("passage_id", F.col("section").alias("keyword"))


#: Keywords of the concepts that documents are linked to.
_KEYWORDS = {"thth": "ring", "anth": "ring", "erent": "bolt", "tion": "gear", "wh ti": "nut", "Über": "cog", "ción": "cog"}
_PAIRS = ", ".join(f"('{k}', '{c}')" for k, c in _KEYWORDS.items())
_ORPHANS = f"""
, mentions AS (SELECT DISTINCT doc_id AS src FROM labels WHERE quality = 1), k(keyword, concept) AS (VALUES {_PAIRS}),
orphans AS (SELECT DISTINCT doc_id, lower(left(text, 120)) AS title FROM documents WHERE doc_id NOT IN (SELECT src FROM mentions)),
linked AS (SELECT doc_id AS src, concept AS dst, array_to_string(list_sort(list(DISTINCT lower(keyword))), ' ') AS keywords FROM orphans JOIN k ON contains(title, lower(keyword)) GROUP BY ALL)"""


def _linked(t: Tables):
    """Documents with a good label have an edge; the others are linked twice, and the second time changes nothing."""
    from lodestone.operators.graph import link_orphans
    from lodestone.sources.sinks import VersionedTable

    edges = VersionedTable(t.spark, scratch_dir(t.spark), "src bigint, dst string, type string, keywords array<string>, weight int")
    good = t("labels").filter("quality = 1").select(F.col("doc_id").alias("src"), F.lit("quality").alias("dst"), F.lit("MENTIONS").alias("type"), F.array().cast("array<string>").alias("keywords"), F.lit(0).alias("weight")).distinct()
    edges.insert_ignore(good, ["src", "dst", "type"], "weight")
    words = t.spark.createDataFrame(list(_KEYWORDS.items()), "keyword string, concept string")
    papers = t("documents").select("doc_id", F.left("text", F.lit(120)).alias("title"))
    for _ in range(2):
        left = link_orphans(papers, "doc_id", "title", words, edges)
    return edges, left


@query("gr_16_linked_orphans", _ORPHANS + " SELECT src, dst, keywords FROM linked")
def _(t: Tables):
    return _linked(t)[0].read().filter("dst <> 'quality'").select("src", "dst", F.array_join("keywords", " ").alias("keywords"))


@query("gr_16_remaining_orphans", _ORPHANS + " SELECT DISTINCT doc_id FROM orphans WHERE doc_id NOT IN (SELECT src FROM linked)")
def _(t: Tables):
    return _linked(t)[1]


@query("gr_17_context_of_topic", _REL + " SELECT DISTINCT u.method FROM mentions m JOIN uses u USING (paper) WHERE m.concept = 'red_ring'")
def _(t: Tables):
    return mentions(t).filter("concept = 'red_ring'").join(uses(t), "paper").select("method").distinct()


@query("gr_18_export", _REL + " SELECT 'paper' AS kind, count(DISTINCT paper) AS n FROM mentions UNION ALL SELECT 'concept', count(DISTINCT concept) FROM mentions UNION ALL SELECT 'mentions', count(*) FROM mentions UNION ALL SELECT 'uses', count(*) FROM uses")
def _(t: Tables):
    m, u = mentions(t), uses(t)
    one = lambda k, c, d: d.agg(c.alias("n")).select(F.lit(k).alias("kind"), "n")
    return one("paper", F.count_distinct("paper"), m).union(one("concept", F.count_distinct("concept"), m)).union(one("mentions", F.count("*"), m)).union(one("uses", F.count("*"), u))


@query("gr_19_concept_coverage", "SELECT w AS keyword, count(DISTINCT doc_id) AS documents FROM passage_concepts JOIN passages USING (passage_id), (SELECT unnest(['ring', 'bolt', 'zebra']) AS w) WHERE contains(concept, w) GROUP BY w")
def _(t: Tables):
    k = t.spark.createDataFrame([("ring",), ("bolt",), ("zebra",)], "keyword string")
    named = containing(k, "keyword", t.passage_concepts.select("concept").distinct(), "concept")
    return t.passage_concepts.select("passage_id", "concept").join(named, "concept").join(t.passages.select("passage_id", "doc_id"), "passage_id").groupBy("keyword").agg(F.count_distinct("doc_id").alias("documents"))


@query("gr_20_sql_on_graph_views", _REL + " SELECT method, count(DISTINCT concept) AS concepts FROM uses JOIN mentions USING (paper) GROUP BY method")
def _(t: Tables):
    """Any reading statement over the views of the graph; others are refused."""
    from lodestone.operators.relational import read_only

    uses(t).createOrReplaceTempView("graph_uses")
    mentions(t).createOrReplaceTempView("graph_mentions")
    said = "SELECT method, count(DISTINCT concept) AS concepts FROM graph_uses JOIN graph_mentions USING (paper) GROUP BY method"
    if not read_only(t.spark, said, ["graph_uses", "graph_mentions"]):
        raise PermissionError("only reading statements")
    return t.spark.sql(said)


@query("gr_21_typed_triples", "SELECT passage_id AS src, concept AS dst, concept_type AS type, max(confidence) AS confidence FROM passage_concepts GROUP BY 1, 2, 3")
def _(t: Tables):
    rows = t.passage_concepts.select(F.col("passage_id").alias("src"), F.col("concept").alias("dst"), F.col("concept_type").alias("type"), "confidence")
    return G.merged_edges(rows, "confidence")


@query("gr_22_citation_expansion", _TREE + " SELECT 'cites' AS way, d AS node FROM e WHERE s = 30 UNION ALL SELECT 'cited_by', s FROM e WHERE d = 30")
def _(t: Tables):
    e = t("customer").filter("c_custkey > 0").select(F.col("c_custkey").alias("s"), F.floor(F.col("c_custkey") / 2).alias("d"))
    return e.filter("s = 30").select(F.lit("cites").alias("way"), F.col("d").alias("node")).union(e.filter("d = 30").select(F.lit("cited_by").alias("way"), F.col("s").alias("node")))


# -- atlas ----------------------------------------------------------------------------------------------------------


@query("atl_01_confident_concepts", "SELECT passage_id, seq, concept, confidence FROM passage_concepts WHERE confidence >= 0.7 AND version = 'N'")
def _(t: Tables):
    return A.confident(t.passage_concepts, "N").select("passage_id", "seq", "concept", "confidence")


@query("atl_02_field_labels", """, e AS (SELECT DISTINCT passage_id, concept AS label, 'explicit' AS how FROM passage_concepts WHERE concept_type IN ('economy', 'small')), i AS (SELECT passage_id, arg_max(concept, (confidence, concept)) AS label, 'inferred' AS how FROM passage_concepts WHERE passage_id NOT IN (SELECT passage_id FROM e) GROUP BY passage_id) SELECT * FROM e UNION ALL SELECT * FROM i""")
def _(t: Tables):
    return A.field_labels(t.passage_concepts, ("economy", "small"))


@query("atl_03_passage_summary", "SELECT passage_id, array_to_string(list(concept ORDER BY concept, confidence), ',') AS concepts, array_to_string(list_sort(list(DISTINCT field)), ',') AS fields, round(avg(confidence), 6) AS mean FROM passage_concepts GROUP BY passage_id")
def _(t: Tables):
    return A.passage_summary(t.passage_concepts).select("passage_id", F.array_join("concepts", ",").alias("concepts"), F.array_join("fields", ",").alias("fields"), F.round("mean", 6).alias("mean"))


_PMI = """, f AS (SELECT DISTINCT passage_id, field FROM passage_concepts), top AS (SELECT field, count(*) AS n FROM f GROUP BY field ORDER BY n DESC, field LIMIT 20), d AS (SELECT count(DISTINCT passage_id) + 0.5 * (SELECT count(*) FROM top) AS t FROM f), k AS (SELECT f.* FROM f JOIN top USING (field)),
pr AS (SELECT a.field AS a, b.field AS b, count(*) AS c FROM k a JOIN k b ON a.passage_id = b.passage_id AND a.field < b.field GROUP BY 1, 2 HAVING count(*) >= 5),
o AS (SELECT a AS field_a, b AS field_b, c AS count, x.n AS count_a, y.n AS count_b, ((c + 0.5) / t) / (((x.n + 0.5) / t) * ((y.n + 0.5) / t)) AS lift, (c + 0.5) / t AS p FROM pr JOIN top x ON x.field = a JOIN top y ON y.field = b, d)"""


@query("atl_04_field_co_occurrence", _PMI + " SELECT a AS field_a, b AS field_b, c AS n FROM pr")
def _(t: Tables):
    fields = t.passage_concepts.select("passage_id", "field").distinct()
    top = A.top_fields(fields, 20).select("field")
    return G.co_occurrence(fields.join(F.broadcast(top), "field", "left_semi"), "passage_id", "field", 5).select(F.col("a").alias("field_a"), F.col("b").alias("field_b"), F.col("weight").alias("n"))


@query("atl_05_field_pmi", _PMI + " SELECT field_a, field_b, count, count_a, count_b, round(log2(lift), 6) AS pmi, round(log2(lift) / -log2(p), 6) AS npmi, round(lift, 6) AS lift FROM o")
def _(t: Tables):
    r = lambda c: F.round(c, 6).alias(c)
    return A.field_overlap(t.passage_concepts, 20).select("field_a", "field_b", "count", "count_a", "count_b", r("pmi"), r("npmi"), r("lift"))


_BRIDGE = ", b AS (SELECT field, concept, round(sum(coalesce(nullif(confidence, 0), 0.8)), 6) AS weight, count(*) AS occurrences FROM passage_concepts GROUP BY 1, 2 HAVING sum(coalesce(nullif(confidence, 0), 0.8)) >= 2)"


@query("atl_06_bridge_graph", _BRIDGE + " SELECT * FROM b")
def _(t: Tables):
    return A.bridge_graph(t.passage_concepts).withColumn("weight", F.round("weight", 6))


@query("atl_07_bridge_concepts")
def _(t: Tables):
    return A.bridge_concepts(A.bridge_graph(t.passage_concepts))


_RARE = """, o AS (SELECT passage_id, concept, max(confidence) AS confidence FROM passage_concepts GROUP BY 1, 2), fl AS (SELECT DISTINCT passage_id, field FROM passage_concepts),
pr AS (SELECT a.passage_id, a.concept AS concept_a, b.concept AS concept_b, (a.confidence + b.confidence) / 2 AS c FROM o a JOIN o b ON a.passage_id = b.passage_id AND a.concept < b.concept WHERE (SELECT count(*) FROM fl WHERE fl.passage_id = a.passage_id) > 1),
ct AS (SELECT concept_a, concept_b, count(*) AS n, avg(c) AS m FROM pr GROUP BY 1, 2 HAVING count(*) >= 3),
fp AS (SELECT concept_a, concept_b, count(*) AS fps FROM (SELECT DISTINCT concept_a, concept_b, x.field AS fa, y.field AS fb FROM pr JOIN fl x USING (passage_id) JOIN fl y ON y.passage_id = pr.passage_id AND x.field < y.field) GROUP BY 1, 2 HAVING count(*) >= 2)"""


@query("atl_08_rare_pairs", _RARE + " SELECT concept_a, concept_b, n, round(m * n, 4) AS sum_confidence, fps AS n_field_pairs, round(m * ln(1 + fps) / (1 + ln(n)), 6) AS score FROM ct JOIN fp USING (concept_a, concept_b)")
def _(t: Tables):
    return A.rare_pairs(t.passage_concepts).select("concept_a", "concept_b", F.col("count").alias("n"), F.round(F.col("avg_confidence") * F.col("count"), 4).alias("sum_confidence"), "n_field_pairs", F.round("score", 6).alias("score"))


@query("atl_09_evidence_passages", """, o AS (SELECT concept, passage_id, max(confidence) AS confidence FROM passage_concepts WHERE concept LIKE 'red_%' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY confidence DESC, passage_id) AS r FROM o) SELECT concept, passage_id, confidence FROM r WHERE r <= 3""")
def _(t: Tables):
    wanted = t.passage_concepts.filter(F.col("concept").startswith("red_")).select("concept").distinct()
    return A.evidence_for(t.passage_concepts, wanted).drop("rank")


@query("atl_10_overlap_hypotheses", _PMI + """, ev AS (SELECT DISTINCT x.passage_id, x.field AS fa, y.field AS fb FROM f x JOIN f y ON x.passage_id = y.passage_id AND x.field < y.field), pc AS (SELECT passage_id, max(confidence) AS c FROM passage_concepts GROUP BY 1), g AS (SELECT fa, fb, avg(c) AS m, count(*) AS n FROM ev JOIN pc USING (passage_id) GROUP BY 1, 2)
SELECT field_a, field_b, round(log2(lift) * m * (0.5 + 0.5 * least(1.0, n / 10.0)), 6) AS score FROM o JOIN g ON fa = field_a AND fb = field_b""")
def _(t: Tables):
    p = t.passage_concepts
    overlap = A.field_overlap(p, 20)
    f = p.select("passage_id", "field").distinct()
    sure = p.groupBy("passage_id").agg(F.max("confidence").alias("confidence"))
    ev = f.withColumnRenamed("field", "field_a").join(f.withColumnRenamed("field", "field_b"), "passage_id").filter("field_a < field_b").join(sure, "passage_id")
    return A.overlap_hypotheses(overlap, ev).select("field_a", "field_b", F.round("score", 6).alias("score"))


@query("atl_11_bridge_hypotheses")
def _(t: Tables):
    b = A.bridge_concepts(A.bridge_graph(t.passage_concepts))
    c = t.passage_concepts.groupBy("concept").agg(F.avg("confidence").alias("confidence"))
    return b.join(c, "concept").select("concept", (F.col("betweenness") * 1000 * F.col("confidence") * F.least(F.lit(1.0), F.col("degree") / 4)).alias("score"))


@query("atl_12_rare_hypotheses", _RARE + " SELECT concept_a, concept_b, round(m * ln(1 + fps) / (1 + ln(n)) * m * (1 + least(1.0, n / 10.0)), 6) AS score FROM ct JOIN fp USING (concept_a, concept_b)")
def _(t: Tables):
    r = A.rare_pairs(t.passage_concepts)
    return r.select("concept_a", "concept_b", F.round(F.col("score") * F.col("avg_confidence") * (1 + F.least(F.lit(1.0), F.col("count") / 10)), 6).alias("score"))


@query("atl_13_ranked_hypotheses")
def _(t: Tables):
    r = A.rare_pairs(t.passage_concepts).orderBy(F.desc("score"), "concept_a", "concept_b").limit(300)
    kept = A.greedy_distinct([x.asDict() | {"items": [x["concept_a"], x["concept_b"]]} for x in r.select("concept_a", "concept_b", "score").collect()], "items")
    return t.spark.createDataFrame([(i + 1, h["concept_a"], h["concept_b"], h["score"]) for i, h in enumerate(kept)], "rank int, concept_a string, concept_b string, score double")


@query("atl_14_pmi_matrix", _PMI + ", l AS (SELECT field_a AS f, log2(lift) AS v FROM o UNION ALL SELECT field_b, log2(lift) FROM o) SELECT f AS field, round(sum(abs(v)), 6) AS strength, count(*) AS partners FROM l GROUP BY f")
def _(t: Tables):
    s = A.field_strengths(A.field_overlap(t.passage_concepts, 20))
    return s.select("field", F.round("strength", 6).alias("strength"), "partners")


_SIX = [f"Brand#{i}" for i in (1, 2, 3, 11, 12, 21)]


@query("atl_14_matrix", _PMI + ", l AS (SELECT field_a AS f, field_b AS g, log2(lift) AS v FROM o UNION ALL SELECT field_b, field_a, log2(lift) FROM o) SELECT f AS field, " + ", ".join(f"round(max(CASE WHEN g = '{x}' THEN v END), 6) AS \"{x}\"" for x in _SIX) + " FROM l WHERE f IN (" + ", ".join(f"'{x}'" for x in _SIX) + ") AND g IN (" + ", ".join(f"'{x}'" for x in _SIX) + ") GROUP BY f")
def _(t: Tables):
    m = A.pmi_matrix(A.field_overlap(t.passage_concepts, 20), _SIX)
    return m.select("field", *(F.round(F.col(f"`{x}`"), 6).alias(x) for x in _SIX))


@query("atl_14_clusters")
def _(t: Tables):
    """Fields in five clusters by their overlap, in the order of the tree."""
    return A.field_clusters(A.field_overlap(t.passage_concepts, 20))


@query("atl_15_explorer", _PMI + " SELECT field_a, field_b, count FROM o WHERE count >= 6 AND (field_a < 'Brand#14' OR field_b > 'Brand#8')")
def _(t: Tables):
    return A.field_overlap(t.passage_concepts, 20).filter("count >= 6 AND (field_a < 'Brand#14' OR field_b > 'Brand#8')").select("field_a", "field_b", "count")
