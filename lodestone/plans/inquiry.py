"""Queries of many questions at once: the benchmark's items are the questions, the documents what is searched."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import inquiry as I
from lodestone.operators import scoring as C
from lodestone.operators import search as S
from lodestone.operators import vectors as V
from lodestone.operators.relational import top_k
from lodestone.operators.scratch import materialise, scratch_dir
from lodestone.plans.registry import Tables, query
from lodestone.plans.search import _STOP, _index

#: Words of negation in the languages of the documents, some of them made up as the texts are.
NEGATIONS = ["not", "nicht", "nt", "er", "un", "re"]
#: What stands in other fields for parts of words.
PATTERNS = {"tion": ("thth", "anth"), "ing": ("ithth", "onre"), "bl": ("eda", "reth", "thth")}


def _terms_sql(text: str) -> str:
    return f"list_transform(list_filter(string_split_regex(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND x NOT IN ({_STOP})), lambda x: CASE WHEN length(x) >= 5 THEN regexp_replace(x, '(ingly|edly|ings|ing|ies|ied|ed|es|s|ly)$', '') ELSE x END)"


#: tf, df and st of the documents; then best(q, doc, score, rank) of asked(q, t): each one's documents by BM25.
_POSTINGS = f""", tok AS MATERIALIZED (SELECT doc_id, {_terms_sql('text')} AS t FROM documents), st AS (SELECT count(*) AS docs, avg(len(t)) AS m FROM tok),
tf AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM tok) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
_BEST = """, aw AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(t) AS term FROM asked) GROUP BY ALL),
sc AS (SELECT q, doc_id, round(sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / m))), 9) AS score FROM aw JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
best AS MATERIALIZED (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM sc)"""
#: The five longest distinct terms of each item, as long as they last: two are the source, two the area, one the target.
_SEEDS = f", words AS (SELECT item_id, list_transform(list_sort(list_transform(list_distinct({_terms_sql('text')}), lambda x: {{'l': -length(x), 't': x}})), lambda x: x.t) AS w FROM benchmark), seeds AS (SELECT item_id, array_to_string(w[1:2], ' ') AS source, array_to_string(w[3:4], ' ') AS area, array_to_string(w[5:5], ' ') AS target FROM words)"


def _seeds(t: Tables):
    long = F.array_sort(F.transform(F.array_distinct(S.terms(F.col("text"))), lambda x: F.struct((-F.length(x)).alias("l"), x.alias("t"))))
    words = t("benchmark").select("item_id", F.transform(long, lambda x: x["t"]).alias("w"))
    return words.select("item_id", *(F.array_join(F.slice("w", at, n), " ").alias(name) for name, at, n in (("source", 1, 2), ("area", 3, 2), ("target", 5, 1))))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_LETTERS_SQL = f"list_transform({list(_LETTERS)}, lambda c: CAST(length(lower(text)) - length(replace(lower(text), c, '')) AS DOUBLE))"


def _letters(text):
    """A vector of a text that SQL can say too: how often it has each letter."""
    low = F.lower(text)
    return F.array(*((F.length(low) - F.length(F.replace(low, F.lit(c)))).cast("double") for c in _LETTERS))


@query("rnk_03_batch_hybrid", _POSTINGS + f", asked AS (SELECT item_id AS q, list_slice({_terms_sql('text')}, 1, 12) AS t FROM benchmark)" + _BEST + f""",
qv AS (SELECT item_id AS q, {_LETTERS_SQL} AS qv FROM benchmark), dv AS (SELECT doc_id, {_LETTERS_SQL} AS dv FROM documents), vs AS (SELECT q, doc_id, round(list_cosine_similarity(qv, dv), 9) AS score FROM qv, dv WHERE list_sum(dv) > 0 AND list_sum(qv) > 0),
vec AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM vs QUALIFY rank <= 50),
al AS (SELECT 0 AS list, q, doc_id, rank FROM vec UNION ALL SELECT 1, q, doc_id, rank FROM best WHERE rank <= 50),
fused AS (SELECT q, doc_id, round(sum(1.0 / (60 + rank)), 12) AS score, min(list) AS first_list FROM al GROUP BY ALL), cut AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, first_list, doc_id) <= 50),
rr AS (SELECT q, cut.doc_id, score, list_distinct(list_filter(string_split_regex(lower(b.text), '\\s+'), lambda x: x <> '')) AS qw, list_filter(string_split_regex(lower(substr(d.text, 1, 512)), '\\s+'), lambda x: x <> '') AS dw FROM cut JOIN benchmark b ON b.item_id = q JOIN documents d ON d.doc_id = cut.doc_id),
rs AS (SELECT q, doc_id, score, len(list_filter(qw, lambda x: list_contains(dw, x))) / greatest(1, len(qw)) AS rs FROM rr)
SELECT q AS item_id, doc_id, round(score, 9) AS score, round(rs, 9) AS rerank_score, row_number() OVER (PARTITION BY q ORDER BY rs DESC, score DESC, doc_id) AS rank FROM rs QUALIFY rank <= 10""")
def _(t: Tables):
    """All items at once: nearest vectors and BM25, fused, cut to 50 and reranked."""
    items, docs = t("benchmark"), t("documents")
    asked = items.select("item_id", F.slice(S.terms(F.col("text")), 1, 12).alias("t"))
    lexical = _index(t).search(asked, "item_id", "t", 50, I.DIGITS).select("item_id", F.col("key").alias("doc_id"), "rank")
    vectors = lambda d, key: materialise(d.select(key, _letters(F.col("text")).alias("v")))
    cells = V.CellIndex.build(vectors(docs, "doc_id"), "doc_id", "v", scratch_dir(t.spark))
    near = cells.search(vectors(items, "item_id"), "item_id", "v", 80).withColumn("s", F.round("score", I.DIGITS))
    near = top_k(near.drop("rank"), ["item_id"], [F.desc("s"), F.asc("key")], 50, "rank").select("item_id", F.col("key").alias("doc_id"), "rank")
    fused = I.fused_batch([near, lexical], "item_id", "doc_id", 50)
    best = I.reranked_batch(fused, "item_id", "doc_id", items, "text", docs, "text", S.OverlapReranker(), 10)
    return best.select("item_id", "doc_id", F.round("score", 9).alias("score"), F.round("rerank_score", 9).alias("rerank_score"), F.col("rank").cast("bigint").alias("rank"))


@query("rnk_10_bridge_search", _POSTINGS + _SEEDS + f", two AS (SELECT item_id AS q, {_terms_sql('source')} AS ta, {_terms_sql('area')} AS tb FROM seeds), asked AS (SELECT q, list_concat(ta, tb) AS t FROM two)" + _BEST + """
SELECT q AS item_id, doc_id, round(score, 6) AS score, rank FROM best JOIN two USING (q) JOIN tok USING (doc_id) WHERE rank <= 20 AND list_has_any(t, ta) AND list_has_any(t, tb)""")
def _(t: Tables):
    """Documents that join the first and the next two of each item's longest words."""
    found = I.bridged(_seeds(t), "item_id", "source", "area", _index(t))
    return found.select("item_id", F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


_STEPS_SQL = "CASE nr WHEN 0 THEN source || ' methods applications' WHEN 1 THEN area || ' challenges ' || target || ' problems' WHEN 2 THEN source || ' applied to ' || area ELSE source || ' limitations failures' END"


@query("hyp_01_evidence_chains", _POSTINGS + _SEEDS + f", four AS (SELECT item_id, nr, {{'i': item_id, 'nr': nr}} AS q, {_STEPS_SQL} AS question FROM seeds, (SELECT unnest([0, 1, 2, 3]) AS nr)), asked AS (SELECT q, {_terms_sql('question')} AS t FROM four)" + _BEST + """,
told AS (SELECT q, count(*) AS found, string_agg(doc_id, ',' ORDER BY rank) FILTER (WHERE rank <= 3) AS top FROM best WHERE rank <= 10 GROUP BY q), step AS (SELECT item_id, nr, question, coalesce(found, 0) AS n, CASE WHEN found IS NULL THEN 0.1 ELSE least(0.9, found / 10.0) END AS sure, coalesce(top, '') AS top FROM four LEFT JOIN told USING (q)),
g AS (SELECT item_id, max(n) FILTER (WHERE nr = 2) AS bridges, round(CAST(avg(sure) AS DOUBLE), 3) AS confidence, string_agg(['source_analysis', 'gap_analysis', 'transfer_analysis', 'risk_analysis'][nr + 1] || ':' || n || ':' || top, ' ' ORDER BY nr) AS trace FROM step GROUP BY item_id)
SELECT item_id, bridges, CASE WHEN bridges < 5 THEN 'high' WHEN bridges < 15 THEN 'medium' ELSE 'well-established' END AS feasibility, CASE WHEN bridges < 5 THEN 'high' ELSE 'medium' END AS testability, confidence, trace FROM g""")
def _(t: Tables):
    told = F.transform("steps", lambda x: F.concat_ws(":", x["step"], x["found"].cast("string"), F.array_join(F.transform(x["evidence"], lambda e: e["doc"].cast("string")), ",")))
    return I.chains(_seeds(t), "item_id", _index(t)).select("item_id", "bridges", "feasibility", "testability", "confidence", F.array_join(told, " ").alias("trace"))


_NOES = ", ".join(f"'{w}'" for w in NEGATIONS)


@query("hyp_02_validated_claims", _POSTINGS + f", cl AS (SELECT item_id AS q, list_distinct({_terms_sql('text')}) AS t FROM benchmark), asked AS (SELECT * FROM cl)" + _BEST + f""",
hit AS (SELECT best.*, cl.t AS ct FROM best JOIN cl USING (q) WHERE rank <= 20), ws AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM hit)),
sco AS (SELECT doc_id, list_transform(list_filter(range(1, len(w) + 1), lambda i: i > 1 AND list_has_any(w[greatest(i - 3, 1):i - 1], [{_NOES}])), lambda i: CASE WHEN length(w[i]) >= 5 THEN regexp_replace(w[i], '(ingly|edly|ings|ing|ies|ied|ed|es|s|ly)$', '') ELSE w[i] END) AS no FROM ws),
ev AS (SELECT q, doc_id, rank, score, list_has_any(no, ct) AS against FROM hit JOIN sco USING (doc_id)),
g AS (SELECT q, count(*) AS found, round(sum(CASE WHEN against THEN 0.0 ELSE score END), 6) AS support, round(sum(CASE WHEN against THEN score ELSE 0.0 END), 6) AS contra, coalesce(string_agg(doc_id, ',' ORDER BY rank) FILTER (WHERE against), '') AS against FROM ev GROUP BY q),
v AS (SELECT cl.q AS item_id, coalesce(found, 0) AS found, coalesce(support, 0) AS support, coalesce(contra, 0) AS contra, coalesce(against, '') AS against, CASE WHEN support + contra > 0 THEN support / (support + contra) ELSE 0.5 END AS c FROM cl LEFT JOIN g USING (q))
SELECT item_id, found, support, contra, round(c, 6) AS confidence, CASE WHEN c > 0.6 THEN 'supported' WHEN c > 0.4 THEN 'needs_investigation' ELSE 'potentially_contradicted' END AS status, against, concat_ws(',', CASE WHEN found < 5 THEN 'little_prior_work' END, CASE WHEN contra > support THEN 'more_against_than_for' END) AS gaps FROM v""")
def _(t: Tables):
    """Items as claims: what is found for them, and whether it negates one of their terms within three words."""
    v = I.validated(t("benchmark"), "item_id", "text", _index(t), t("documents"), "doc_id", "text", NEGATIONS)
    against = F.array_join(F.transform(F.filter("evidence", lambda e: e["contradicts"]), lambda e: e["doc"].cast("string")), ",")
    return v.select("item_id", "found", "support", "contra", "confidence", "status", against.alias("against"), F.array_join("gaps", ",").alias("gaps"))


_PARTS_SQL = ", ".join(f"CASE WHEN contains(low, '{w}') THEN {list(ts)} ELSE [] END" for w, ts in PATTERNS.items())


@query("qa_17_search_readiness", _POSTINGS + _SEEDS + f""", ob AS (SELECT item_id, list_concat({_PARTS_SQL}) AS p FROM (SELECT item_id, lower(text) AS low FROM benchmark)), od AS (SELECT item_id, list_filter(p, lambda x, i: list_position(p, x) = i)[1:3] AS p FROM ob),
asks AS (SELECT 'domain' AS kind, item_id, 0 AS part, {_terms_sql('source')} AS ta, [] AS tb FROM seeds UNION ALL SELECT 'bridge', item_id, 0, {_terms_sql('source')}, {_terms_sql('area')} FROM seeds UNION ALL SELECT 'oblique', item_id, i, [p[i]], [] FROM (SELECT item_id, p, unnest(range(1, len(p) + 1)) AS i FROM od)),
aq AS (SELECT {{'k': kind, 'i': item_id, 'p': part}} AS q, * FROM asks), asked AS (SELECT q, list_concat(ta, tb) AS t FROM aq)""" + _BEST + """,
hit AS (SELECT kind, item_id, doc_id FROM best JOIN aq USING (q) JOIN tok USING (doc_id) WHERE rank <= CASE WHEN kind = 'oblique' THEN 5 ELSE 10 END AND (kind <> 'bridge' OR list_has_any(t, ta) AND list_has_any(t, tb))),
n AS (SELECT k.kind, b.item_id, count(DISTINCT doc_id) AS hits FROM benchmark b CROSS JOIN (SELECT unnest(['domain', 'oblique', 'bridge']) AS kind) k LEFT JOIN hit h ON h.kind = k.kind AND h.item_id = b.item_id GROUP BY ALL),
g AS (SELECT kind, count(*) AS questions, count(*) FILTER (WHERE hits >= CASE kind WHEN 'domain' THEN 5 WHEN 'oblique' THEN 3 ELSE 2 END) AS passed FROM n GROUP BY kind)
SELECT kind, questions, passed, round(passed / questions, 6) AS share, CASE WHEN passed / questions >= 0.9 THEN 'A' WHEN passed / questions >= 0.8 THEN 'B' WHEN passed / questions >= 0.7 THEN 'C' ELSE 'F' END AS grade FROM g""")
def _(t: Tables):
    """Each item asked three ways: by its longest words, by what stands for its words elsewhere, and as a bridge."""
    seeds = _seeds(t)
    ask = lambda d, kind, a, b: d.select("item_id", F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    none = F.lit(None).cast("string")
    questions = ask(seeds, "domain", F.col("source"), none).unionByName(ask(seeds, "bridge", F.col("source"), F.col("area"))).unionByName(ask(t("benchmark"), "oblique", F.col("text"), none))
    return I.readiness(I.readiness_hits(questions, "item_id", PATTERNS, _index(t)))


_WORK = ", w AS (SELECT venue, passage_id, p.year, concept FROM passages p JOIN documents_kb USING (doc_id) JOIN passage_concepts USING (passage_id))"


def _work(t: Tables):
    papers = t.passages.select("passage_id", "doc_id", "year").join(t.documents_kb.select("doc_id", "venue"), "doc_id").select("venue", "passage_id", "year")
    return papers, t.passage_concepts.select("passage_id", "concept")


@query("trd_03_velocity_methods", _WORK + """, y AS (SELECT venue, p.year, count(*) AS n FROM passages p JOIN documents_kb USING (doc_id) GROUP BY ALL), v AS (SELECT venue, sum(n)::BIGINT AS papers, string_agg(year || ':' || n, ' ' ORDER BY year) AS velocity FROM y GROUP BY venue),
m AS (SELECT venue, concept, count(*) AS n FROM w GROUP BY venue, concept QUALIFY row_number() OVER (PARTITION BY venue ORDER BY n DESC, concept) <= 10)
SELECT venue, papers, velocity, methods FROM v JOIN (SELECT venue, string_agg(concept, ',' ORDER BY n DESC, concept) AS methods FROM m GROUP BY venue) USING (venue)""")
def _(t: Tables):
    g = C.watched(*_work(t), "venue", "passage_id", "year", "concept")
    velocity = F.array_join(F.transform("velocity", lambda x: F.concat_ws(":", x["year"].cast("string"), x["n"].cast("string"))), " ")
    return g.select("venue", "papers", velocity.alias("velocity"), F.array_join("methods", ",").alias("methods"))


@query("trd_03_topic_overlap", _WORK + ", m AS (SELECT venue, concept, count(*) AS n FROM w GROUP BY ALL) SELECT venue, topic, concept AS method, n AS frequency FROM m JOIN (SELECT unnest(['ring', 'red_', 'Bolt']) AS topic) ON contains(lower(concept), lower(topic))")
def _(t: Tables):
    return C.topic_overlap(*_work(t), "venue", "passage_id", "concept", ["ring", "red_", "Bolt"]).withColumnRenamed("concept", "method")
