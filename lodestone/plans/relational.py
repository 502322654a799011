"""Queries of filters, joins, aggregates, windows, set operations and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import relational as R
from lodestone.operators.containment import containing, either_way
from lodestone.plans.registry import Tables, query

# -- filters --------------------------------------------------------------------------------------------------------


@query("flt_01_year_range", "SELECT passage_id, year FROM passages WHERE year >= 1996 AND year <= 1998")
def _(t: Tables):
    return R.where(t.passages.select("passage_id", "year"), R.year_between("year", 1996, 1998), R.year_between("year", 0, None))


@query("flt_02_concepts_contain_all", """, c AS (SELECT passage_id, string_agg(DISTINCT concept, ',' ORDER BY concept) AS concepts FROM passage_concepts GROUP BY passage_id)
SELECT passage_id, concepts, list_contains(string_split(concepts, ','), 'red_ring') AS exact FROM c WHERE concepts LIKE '%ring%' AND concepts LIKE '%red%'""")
def _(t: Tables):
    c = t.passage_concepts.groupBy("passage_id").agg(F.array_sort(F.collect_set("concept")).alias("c")).withColumn("concepts", F.array_join("c", ","))
    return c.filter(R.contains_all(F.col("concepts"), ["ring", "red"])).select("passage_id", "concepts", R.has_all(F.col("c"), ["red_ring"]).alias("exact"))


@query("flt_03_code_filters", "SELECT chunk_id, name FROM code_chunks JOIN code_files USING (file_id) WHERE contains(repo, '1') AND org = 'Brand#3' AND language = 'python' AND chunk_type = 'economy'")
def _(t: Tables):
    j = t.code_chunks.join(t.code_files, "file_id")
    return R.where(j, F.col("repo").contains("1"), F.col("org") == "Brand#3", F.col("language") == "python", F.col("chunk_type") == "economy", None).select("chunk_id", "name")


@query("flt_04_repo_wildcard", "SELECT file_id, repo FROM code_files WHERE repo LIKE 'repo1%'")
def _(t: Tables):
    return t.code_files.filter(R.wildcard(F.col("repo"), "repo1*")).select("file_id", "repo")


@query("flt_05_arrays_overlap", """, c AS (SELECT passage_id, list(DISTINCT concept) AS c FROM passage_concepts GROUP BY passage_id) SELECT passage_id FROM c WHERE list_has_any(c, ['red_ring', 'blue_bolt'])""")
def _(t: Tables):
    c = t.passage_concepts.groupBy("passage_id").agg(F.collect_set("concept").alias("c"))
    return c.filter(F.arrays_overlap("c", F.array(F.lit("red_ring"), F.lit("blue_bolt")))).select("passage_id")


@query("flt_06_in_array", """, c AS (SELECT passage_id, list(DISTINCT field) AS f FROM passage_concepts GROUP BY passage_id) SELECT passage_id, len(f) AS n FROM c WHERE list_contains(f, 'Brand#7')""")
def _(t: Tables):
    c = t.passage_concepts.groupBy("passage_id").agg(F.collect_set("field").alias("f"))
    return c.filter(F.array_contains("f", "Brand#7")).select("passage_id", F.size("f").cast("bigint").alias("n"))


@query("flt_07_in_lists", "SELECT passage_id, status FROM passages WHERE status IN ('O', 'P') AND section NOT IN ('1-URGENT', '5-LOW')")
def _(t: Tables):
    return t.passages.filter(F.col("status").isin("O", "P") & ~F.col("section").isin("1-URGENT", "5-LOW")).select("passage_id", "status")


@query("flt_08_ilike", "SELECT DISTINCT concept FROM passage_concepts WHERE concept ILIKE '%D_R%'")
def _(t: Tables):
    return t.passage_concepts.filter(R.matches_any(F.col("concept"), ["D_R"])).select("concept").distinct()


@query("flt_09_any_of_ilike", "SELECT doc_id FROM documents WHERE text ILIKE '%token%' OR text ILIKE '%license%'")
def _(t: Tables):
    return t("documents").filter(R.matches_any(F.col("text"), ["token", "license"])).select("doc_id")


@query("flt_10_citable", "SELECT passage_id FROM passages WHERE page_num >= 0 AND quality >= 0.7")
def _(t: Tables):
    return t.passages.filter("page_num >= 0 AND quality >= 0.7").select("passage_id")


@query("flt_11_least_length", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 50")
def _(t: Tables):
    return t("documents").filter(F.length("text") >= 50).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query("flt_12_numeric_titles", "SELECT doc_id FROM documents_kb WHERE regexp_matches(substr(title, 10), '^[0-9]+$')")
def _(t: Tables):
    return t.documents_kb.filter(F.col("title").substr(10, 99).rlike("^[0-9]+$")).select("doc_id")


@query("flt_13_all_terms", "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion') AND contains(lower(text), 'ing')")
def _(t: Tables):
    terms = F.array(F.lit("the"), F.lit("tion"), F.lit("ing"))
    return t("documents").withColumn("low", F.lower("text")).filter(F.forall(terms, lambda x: F.col("low").contains(x))).select("doc_id")


@query("flt_14_junk_concepts", "SELECT p_partkey, p_name IN ('unknown') OR starts_with(substr(p_name, 1, p_partkey % 4), 'test_') OR length(substr(p_name, 1, p_partkey % 4)) <= 2 AS junk FROM part")
def _(t: Tables):
    name = F.expr("substr(p_name, 1, cast(p_partkey % 4 as int))")
    return t("part").select("p_partkey", R.junk_name(name).alias("junk"))


@query("flt_15_read_only_guard")
def _(t: Tables):
    said = ["SELECT 1", "WITH a AS (SELECT 1) SELECT * FROM a", "DROP TABLE x", "INSERT INTO x VALUES (1)", "CREATE TABLE x (a INT)", "DELETE FROM x", "WITH a AS (SELECT 1 AS n) INSERT INTO t SELECT * FROM a", "FROM v INSERT INTO a SELECT * INSERT INTO b SELECT *", "REFRESH TABLE x", "SELECT reflect('java.lang.System', 'exit', '1')", "SELECT (SELECT max(reflect('a', 'b')) FROM t) FROM u", "SELECT a, count(*) FROM t JOIN u USING (a) WHERE a IN (SELECT b FROM v) GROUP BY a HAVING count(*) > 1 ORDER BY a LIMIT 3"]
    return t.spark.createDataFrame([(s, R.read_only(t.spark, s)) for s in said], "statement string, reads boolean")


@query("flt_15_guarded_statements", ", s AS (SELECT n_nationkey AS k, n_nationkey % 5 IN (0, 3) AS reads FROM nation) SELECT k, reads, CASE WHEN reads THEN (SELECT count(*) FROM customer WHERE c_nationkey = k) END AS customers FROM s")
def _(t: Tables):
    """A statement for each nation, of five kinds; those that read what is given are run, in one plan, the others refused."""
    t("customer").createOrReplaceTempView("guarded_customers")
    kinds = [
        "SELECT {k} AS k, count(*) AS customers FROM guarded_customers WHERE c_nationkey = {k}",
        "DROP TABLE guarded_customers_{k}",
        "SELECT {k} AS k, count(*) AS customers FROM csv.`/etc/passwd`",
        "WITH own AS (SELECT * FROM guarded_customers WHERE c_nationkey = {k}) SELECT {k} AS k, count(*) AS customers FROM own",
        "SELECT {k} AS k, (SELECT count(*) FROM parquet.`{k}`) AS customers FROM guarded_customers",
    ]
    said = {r["n_nationkey"]: kinds[r["n_nationkey"] % 5].format(k=r["n_nationkey"]) for r in t("nation").select("n_nationkey").collect()}
    fine = {k: s for k, s in said.items() if R.read_only(t.spark, s, ["guarded_customers"])}
    counts = reduce(lambda a, b: a.union(b), (t.spark.sql(s) for s in fine.values()))
    reads = t.spark.createDataFrame([(k, k in fine) for k in said], "k bigint, reads boolean")
    return reads.join(counts.select(F.col("k").cast("bigint").alias("k"), "customers"), "k", "left")


@query("flt_16_json_projection", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS priority, coalesce(CAST(json_extract_string(props, '$.hidden') AS BOOLEAN), false) AS hidden FROM events")
def _(t: Tables):
    js = lambda p: F.get_json_object("props", p)
    return t("events").select("event_id", F.coalesce(js("$.k").cast("double"), F.lit(0.0)).alias("priority"), F.coalesce(js("$.hidden").cast("boolean"), F.lit(False)).alias("hidden"))


@query("flt_17_json_paths", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) > 50")
def _(t: Tables):
    e = t("events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"))
    return e.filter("k > 50")


@query("flt_18_left_and_cut", "SELECT doc_id, left(text, 20) AS head, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS short FROM documents")
def _(t: Tables):
    return t("documents").select("doc_id", F.left("text", F.lit(20)).alias("head"), F.when(F.length("text") > 40, F.concat(F.substring("text", 1, 40), F.lit("..."))).otherwise(F.col("text")).alias("short"))


@query("flt_19_optional_filters", "SELECT doc_id, title FROM documents_kb WHERE venue = 'BUILDING' AND year >= 2000")
def _(t: Tables):
    given = {"venue": "BUILDING", "year": 2000, "title": None}
    return R.where(t.documents_kb, given["venue"] and F.col("venue") == given["venue"], R.year_between("year", given["year"], None), given["title"] and F.col("title").contains(given["title"])).select("doc_id", "title")


@query("flt_20_first_available", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'pmc/' || doc_id WHEN doc_id % 3 = 1 THEN 'pdf/' || doc_id ELSE 'doi/' || doc_id END AS link FROM documents_kb")
def _(t: Tables):
    n = F.col("doc_id").cast("string")
    pmc = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("pmc/"), n))
    listed = F.array(F.struct(F.lit("html").alias("style"), F.concat(F.lit("html/"), n).alias("url")), F.struct(F.when(F.col("doc_id") % 3 == 1, "pdf").otherwise("x").alias("style"), F.concat(F.lit("pdf/"), n).alias("url")))
    return t.documents_kb.select("doc_id", F.coalesce(pmc, F.get(F.filter(listed, lambda u: u["style"] == "pdf"), 0)["url"], F.concat(F.lit("doi/"), n)).alias("link"))


# -- joins ----------------------------------------------------------------------------------------------------------


@query("jn_01_passages_documents", "SELECT passage_id, title, venue FROM passages JOIN documents_kb USING (doc_id)")
def _(t: Tables):
    return t.passages.select("passage_id", "doc_id").join(t.documents_kb, "doc_id").select("passage_id", "title", "venue")


@query("jn_02_chunks_files", "SELECT chunk_id, repo, path, language FROM code_chunks JOIN code_files USING (file_id)")
def _(t: Tables):
    return t.code_chunks.select("chunk_id", "file_id").join(t.code_files, "file_id").select("chunk_id", "repo", "path", "language")


@query("jn_03_concepts_passages_documents", "SELECT concept, title, count(*) AS n FROM passage_concepts JOIN passages USING (passage_id) JOIN documents_kb USING (doc_id) WHERE confidence >= 0.8 GROUP BY concept, title")
def _(t: Tables):
    return t.passage_concepts.filter("confidence >= 0.8").join(t.passages.select("passage_id", "doc_id"), "passage_id").join(t.documents_kb, "doc_id").groupBy("concept", "title").agg(F.count("*").alias("n"))


@query("jn_04_links_spans_documents", "SELECT passage_id, seq, part_id, title, confidence FROM passage_concepts JOIN passages USING (passage_id) JOIN documents_kb USING (doc_id) WHERE version = 'R' ORDER BY confidence DESC, passage_id, seq, part_id LIMIT 50")
def _(t: Tables):
    j = t.passage_concepts.filter("version = 'R'").join(t.passages, "passage_id").join(t.documents_kb, "doc_id")
    return j.orderBy(F.desc("confidence"), "passage_id", "seq", "part_id").limit(50).select("passage_id", "seq", "part_id", "title", "confidence")


@query("jn_05_concept_documents", "SELECT concept, count(DISTINCT doc_id) AS n FROM passage_concepts JOIN passages USING (passage_id) GROUP BY concept")
def _(t: Tables):
    return t.passage_concepts.select("passage_id", "concept").join(t.passages.select("passage_id", "doc_id"), "passage_id").groupBy("concept").agg(F.count_distinct("doc_id").alias("n"))


@query("jn_06_left_with_default", "SELECT doc_id, title, coalesce(passage_id, -1) AS passage_id FROM documents_kb LEFT JOIN (SELECT doc_id, min(passage_id) AS passage_id FROM passages WHERE status = 'F' GROUP BY doc_id) USING (doc_id)")
def _(t: Tables):
    first = t.passages.filter("status = 'F'").groupBy("doc_id").agg(F.min("passage_id").alias("passage_id"))
    return t.documents_kb.join(first, "doc_id", "left").select("doc_id", "title", F.coalesce("passage_id", F.lit(-1)).alias("passage_id"))


@query("jn_07_condition_in_join", "SELECT p.passage_id, count(concept) AS n FROM passages p LEFT JOIN passage_concepts c ON p.passage_id = c.passage_id AND c.version = 'N' GROUP BY p.passage_id")
def _(t: Tables):
    p, c = t.passages.select("passage_id"), t.passage_concepts.select(F.col("passage_id").alias("pid"), "version", "concept")
    return p.join(c, (p["passage_id"] == c["pid"]) & (c["version"] == "N"), "left").groupBy("passage_id").agg(F.count("concept").alias("n"))


@query("jn_08_left_documents", "SELECT l.doc_id, d.source, l.quality FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id AND d.lang = 'en'")
def _(t: Tables):
    d = t("documents").filter("lang = 'en'").select("doc_id", "source")
    return t("labels").join(d, "doc_id", "left").select("doc_id", "source", "quality")


@query("jn_09_lateral_unnest", """, c AS (SELECT f.file_id, CASE WHEN f.file_id % 5 = 0 THEN [] ELSE list_distinct(list(c.org ORDER BY c.org)) END AS orgs FROM code_files f JOIN code_chunks c USING (file_id) GROUP BY f.file_id)
SELECT file_id, unnest(CASE WHEN len(orgs) = 0 THEN [NULL] ELSE orgs END) AS org FROM c""")
def _(t: Tables):
    c = t.code_chunks.groupBy("file_id").agg(F.collect_set("org").alias("orgs"))
    orgs = F.when(F.col("file_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.col("orgs"))
    return c.select("file_id", F.explode_outer(orgs).alias("org"))


@query("jn_10_semi_correlated", "SELECT DISTINCT passage_id FROM passage_concepts a WHERE concept = 'red_ring' AND EXISTS (SELECT 1 FROM passage_concepts b WHERE b.passage_id = a.passage_id AND b.field = 'Brand#5')")
def _(t: Tables):
    p = t.passage_concepts
    return p.filter("concept = 'red_ring'").select("passage_id").join(p.filter("field = 'Brand#5'").select("passage_id"), "passage_id", "left_semi").distinct()


@query("jn_11_semi_in", "SELECT doc_id, title FROM documents_kb WHERE doc_id IN (SELECT DISTINCT doc_id FROM passages WHERE quality > 0.99)")
def _(t: Tables):
    return t.documents_kb.join(t.passages.filter("quality > 0.99"), "doc_id", "left_semi").select("doc_id", "title")


@query("jn_12_anti_not_exists", "SELECT passage_id FROM passages p WHERE NOT EXISTS (SELECT 1 FROM passage_concepts c WHERE c.passage_id = p.passage_id AND c.version = 'A')")
def _(t: Tables):
    return t.passages.select("passage_id").join(t.passage_concepts.filter("version = 'A'"), "passage_id", "left_anti")


@query("jn_13_anti_orphans", "SELECT count(*) AS orphans FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL")
def _(t: Tables):
    return t("documents").select("doc_id").join(t("labels"), "doc_id", "left_anti").agg(F.count("*").alias("orphans"))


@query("jn_14_self_join_pairs", """, d AS (SELECT DISTINCT passage_id, field FROM passage_concepts) SELECT a.field AS field_a, b.field AS field_b, count(*) AS n FROM d a JOIN d b ON a.passage_id = b.passage_id AND a.field < b.field GROUP BY 1, 2""")
def _(t: Tables):
    d = t.passage_concepts.select("passage_id", "field").distinct()
    a, b = d.withColumnRenamed("field", "field_a"), d.withColumnRenamed("field", "field_b")
    return a.join(b, "passage_id").filter("field_a < field_b").groupBy("field_a", "field_b").agg(F.count("*").alias("n"))


@query("jn_15_summary_left_fields", """, s AS (SELECT passage_id, count(*) AS n FROM passage_concepts GROUP BY passage_id), f AS (SELECT passage_id, count(DISTINCT field) AS fields FROM passage_concepts WHERE confidence >= 0.9 GROUP BY passage_id) SELECT passage_id, n, fields FROM s LEFT JOIN f USING (passage_id)""")
def _(t: Tables):
    p = t.passage_concepts
    return p.groupBy("passage_id").agg(F.count("*").alias("n")).join(p.filter("confidence >= 0.9").groupBy("passage_id").agg(F.count_distinct("field").alias("fields")), "passage_id", "left")


@query("jn_16_scalar_array_agg", "SELECT p.passage_id, (SELECT string_agg(DISTINCT concept, ',' ORDER BY concept) FROM passage_concepts c WHERE c.passage_id = p.passage_id) AS concepts FROM passages p")
def _(t: Tables):
    c = t.passage_concepts.groupBy("passage_id").agg(F.array_join(F.array_sort(F.collect_set("concept")), ",").alias("concepts"))
    return t.passages.select("passage_id").join(c, "passage_id", "left")


@query("jn_17_first_passage", "SELECT doc_id, arg_min(passage_id, (page_num, passage_id)) AS first_passage FROM passages GROUP BY doc_id")
def _(t: Tables):
    return t.passages.groupBy("doc_id").agg(F.min(F.struct("page_num", "passage_id"))["passage_id"].alias("first_passage"))


@query("jn_18_first_five_joined", """, r AS (SELECT doc_id, passage_id, row_number() OVER (PARTITION BY doc_id ORDER BY passage_id) AS r FROM passages) SELECT doc_id, string_agg(CAST(passage_id AS VARCHAR), ' ' ORDER BY passage_id) AS firsts FROM r WHERE r <= 5 GROUP BY doc_id""")
def _(t: Tables):
    return R.top_k(t.passages.select("doc_id", "passage_id"), ["doc_id"], [F.asc("passage_id")], 5).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("passage_id")), lambda x: x.cast("string")), " ").alias("firsts"))


@query("jn_19_lookup_cascade", """, q AS (SELECT passage_id, CASE WHEN passage_id % 2 = 0 THEN 'Customer#' || lpad(CAST(doc_id AS VARCHAR), 9, '0') END AS k1, doc_id AS k2 FROM passages), a AS (SELECT title, min(doc_id) AS v FROM documents_kb WHERE nation < 10 GROUP BY title)
SELECT passage_id, coalesce(a.v, d.doc_id) AS found FROM q LEFT JOIN a ON a.title = q.k1 LEFT JOIN documents_kb d ON d.doc_id = q.k2 AND d.nation >= 20""")
def _(t: Tables):
    q = t.passages.select("passage_id", F.when(F.col("passage_id") % 2 == 0, F.concat(F.lit("Customer#"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))).alias("k1"), F.col("doc_id").alias("k2"))
    d = t.documents_kb
    return R.cascade(q, [("k1", d.filter("nation < 10"), "title", "doc_id"), ("k2", d.filter("nation >= 20"), "doc_id", "doc_id")], "found").select("passage_id", "found")


@query("jn_20_fuzzy_title", "SELECT n_nationkey, min(doc_id) AS doc_id FROM nation JOIN documents_kb ON contains(lower(title), lpad(CAST(n_nationkey AS VARCHAR), 3, '0')) GROUP BY n_nationkey")
def _(t: Tables):
    n = F.broadcast(t("nation").select("n_nationkey", F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("part")))
    d = t.documents_kb.select("doc_id", F.lower("title").alias("low"))
    return d.join(n, d["low"].contains(n["part"])).groupBy("n_nationkey").agg(F.min("doc_id").alias("doc_id"))


@query("jn_21_names_either_way", "SELECT DISTINCT r.r_name, n.n_name FROM region r JOIN nation n ON contains(lower(n.n_name), lower(substr(r.r_name, 1, 1))) OR contains(lower(r.r_name), lower(n.n_name))")
def _(t: Tables):
    r, n = F.broadcast(t("region").select("r_name")), t("nation").select("n_name")
    return n.join(r, F.lower("n_name").contains(F.lower(F.substring("r_name", 1, 1))) | F.lower("r_name").contains(F.lower("n_name"))).select("r_name", "n_name").distinct()


@query("jn_20_title_in_titles", ", n AS (SELECT DISTINCT lower(left(title, 16)) AS part FROM documents_kb UNION SELECT lpad(CAST(s_suppkey AS VARCHAR), 4, '0') FROM supplier) SELECT part, min(doc_id) AS doc_id, count(*) AS titles FROM n JOIN documents_kb ON contains(lower(title), part) GROUP BY part")
def _(t: Tables):
    """The first characters of all titles, and the numbers of all suppliers, in all titles."""
    d = t.documents_kb.select("doc_id", F.lower("title").alias("low"))
    n = d.select(F.substring("low", 1, 16).alias("part")).union(t("supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 4, "0"))).distinct()
    return containing(n, "part", d, "low").groupBy("part").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("titles"))


@query("jn_21_names_in_names", ", a AS (SELECT DISTINCT p_name AS x FROM part), b AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS y FROM part UNION SELECT DISTINCT p_name || ' and more' FROM part WHERE p_size > 25 UNION SELECT DISTINCT left(p_name, 3) FROM part) SELECT x, y FROM a JOIN b ON contains(x, y) OR contains(y, x)")
def _(t: Tables):
    p = t("part")
    a = p.select(F.col("p_name").alias("x")).distinct()
    b = p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("y")).union(p.filter("p_size > 25").select(F.concat("p_name", F.lit(" and more")))).union(p.select(F.substring("p_name", 1, 3))).distinct()
    return either_way(a, "x", b, "y")


@query("jn_22_full_outer_by_title", """, a AS (SELECT doc_id, quality FROM labels WHERE quality = 1), b AS (SELECT doc_id, toxic FROM labels WHERE toxic = 1) SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'both' WHEN a.doc_id IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def _(t: Tables):
    lab = t("labels")
    a, b = lab.filter("quality = 1").select("doc_id", F.lit(1).alias("a")), lab.filter("toxic = 1").select("doc_id", F.lit(1).alias("b"))
    side = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "both").when(F.col("a").isNotNull(), "left").otherwise("right")
    return a.join(b, "doc_id", "full_outer").select("doc_id", side.alias("side"))


@query("jn_23_title_file_cascade", """, e AS (SELECT lower(path) AS k, min(file_id) AS v FROM code_files WHERE file_id % 2 = 0 GROUP BY 1), n AS (SELECT regexp_replace(lower(path), '[^a-z0-9]', '', 'g') AS k, min(file_id) AS v FROM code_files GROUP BY 1)
SELECT s_suppkey, coalesce(e.v, n.v) AS file_id FROM supplier LEFT JOIN e ON e.k = lower(s_name) LEFT JOIN n ON n.k = regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g')""")
def _(t: Tables):
    f = t.code_files
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    own = t("supplier").select("s_suppkey", F.lower("s_name").alias("k1"), plain("s_name").alias("k2"))
    stems = f.filter("file_id % 2 = 0").select(F.lower("path").alias("stem"), "file_id")
    return R.cascade(own, [("k1", stems, "stem", "file_id"), ("k2", f.select(plain("path").alias("flat"), "file_id"), "flat", "file_id")], "found").select("s_suppkey", F.col("found").alias("file_id"))


@query("jn_24_field_fallback", "SELECT e.event_id, coalesce(CASE WHEN e.value > 10 THEN e.event_type END, u.c_mktsegment) AS label, CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k FROM events e LEFT JOIN customer u ON u.c_custkey = e.user_id")
def _(t: Tables):
    e = t("events").select("event_id", "user_id", "value", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.join(t("customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment"), "user_id", "left").select("event_id", F.coalesce(F.when(F.col("value") > 10, F.col("event_type")), "c_mktsegment").alias("label"), "k")


@query("jn_25_prefix_or_hash", "SELECT n_nationkey, min(c_custkey) AS found FROM nation JOIN customer ON starts_with(c_mktsegment, substr('BUILDING', 1, n_nationkey % 8 + 1)) OR starts_with(md5(c_name), substr(md5(n_name), 1, 2)) GROUP BY n_nationkey")
def _(t: Tables):
    """The two sides of the OR are joins by equality, one for each length of prefix, and their union."""
    n = t("nation").select("n_nationkey", F.expr("substr('BUILDING', 1, n_nationkey % 8 + 1)").alias("p"), F.substring(F.md5("n_name"), 1, 2).alias("h"))
    c = t("customer").select("c_custkey", "c_mktsegment", F.substring(F.md5("c_name"), 1, 2).alias("h"))
    segments = c.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("c_custkey"))
    prefixes = segments.select("c_custkey", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(8), F.length("c_mktsegment"))), lambda k: F.substring(F.col("c_mktsegment"), F.lit(1), k))).alias("p"))
    both = n.join(prefixes, "p").select("n_nationkey", "c_custkey").union(n.join(c, "h").select("n_nationkey", "c_custkey"))
    return both.groupBy("n_nationkey").agg(F.min("c_custkey").alias("found"))


# -- aggregates -----------------------------------------------------------------------------------------------------


@query("agg_01_top_counts", "SELECT concept, count(*) AS n FROM passage_concepts GROUP BY concept ORDER BY n DESC, concept LIMIT 20")
def _(t: Tables):
    return t.passage_concepts.groupBy("concept").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "concept").limit(20)


@query("agg_02_count_distinct", "SELECT field, count(DISTINCT concept) AS concepts, count(DISTINCT passage_id) AS passages FROM passage_concepts GROUP BY field")
def _(t: Tables):
    return t.passage_concepts.groupBy("field").agg(F.count_distinct("concept").alias("concepts"), F.count_distinct("passage_id").alias("passages"))


@query("agg_03_filtered_percent", "SELECT field, count(*) AS n, count(*) FILTER (WHERE confidence >= 0.9) AS sure, round(100.0 * count(*) FILTER (WHERE confidence >= 0.9) / nullif(count(*) FILTER (WHERE version = 'N'), 0), 2) AS percent FROM passage_concepts GROUP BY field")
def _(t: Tables):
    return t.passage_concepts.groupBy("field").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.9).alias("sure"), R.share(F.count_if(F.col("confidence") >= 0.9), F.count_if(F.col("version") == "N")).alias("percent"))


@query("agg_04_duplicate_keys", "SELECT count(*) - count(DISTINCT (passage_id, concept, version)) AS duplicates FROM passage_concepts")
def _(t: Tables):
    return t.passage_concepts.agg((F.count("*") - F.count_distinct(F.struct("passage_id", "concept", "version"))).alias("duplicates"))


@query("agg_05_relational_division", "SELECT passage_id FROM passage_concepts WHERE field IN ('Brand#1', 'Brand#2') GROUP BY passage_id HAVING count(DISTINCT field) = 2")
def _(t: Tables):
    return R.having_all(t.passage_concepts, "passage_id", "field", t.spark.createDataFrame([("Brand#1",), ("Brand#2",)], "f string"))


@query("agg_06_having", "SELECT concept_type, concept, count(*) AS n FROM passage_concepts GROUP BY 1, 2 HAVING count(*) > 1 AND count(*) < 500")
def _(t: Tables):
    return t.passage_concepts.groupBy("concept_type", "concept").agg(F.count("*").alias("n")).filter("n > 1 AND n < 500")


@query("agg_07_group_size_percentiles", """, g AS (SELECT passage_id, count(*) AS n FROM passage_concepts GROUP BY passage_id) SELECT min(n) AS least, round(avg(n), 4) AS mean, max(n) AS most, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90 FROM g""")
def _(t: Tables):
    g = t.passage_concepts.groupBy("passage_id").agg(F.count("*").alias("n"))
    return g.agg(F.min("n").alias("least"), F.round(F.avg("n"), 4).alias("mean"), F.max("n").alias("most"), F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.9).alias("p90"))


@query("agg_08_bucket_histogram", "SELECT CASE WHEN confidence < 0.6 THEN 'low' WHEN confidence < 0.8 THEN 'middle' ELSE 'high' END AS bucket, count(*) AS n FROM passage_concepts GROUP BY 1")
def _(t: Tables):
    return t.passage_concepts.groupBy(R.bucketed(F.col("confidence"), [(0.6, "low"), (0.8, "middle")], "high").alias("bucket")).agg(F.count("*").alias("n"))


@query("agg_09_parallel_arrays", "SELECT passage_id, array_to_string(list(concept ORDER BY seq, part_id, concept), ',') AS concepts, array_to_string(list(CAST(part_id AS VARCHAR) ORDER BY seq, part_id, concept), ',') AS parts FROM passage_concepts GROUP BY passage_id")
def _(t: Tables):
    g = t.passage_concepts.groupBy("passage_id").agg(F.array_sort(F.collect_list(F.struct("seq", "part_id", "concept"))).alias("x"))
    return g.select("passage_id", F.array_join(F.col("x")["concept"], ",").alias("concepts"), F.array_join(F.transform(F.col("x")["part_id"], lambda i: i.cast("string")), ",").alias("parts"))


@query("agg_10_distinct_filtered_array", "SELECT field, coalesce(array_to_string(list_sort(list(DISTINCT concept) FILTER (WHERE confidence >= 0.95)), ','), '') AS sure FROM passage_concepts GROUP BY field")
def _(t: Tables):
    return t.passage_concepts.groupBy("field").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("confidence") >= 0.95, F.col("concept")))), ",").alias("sure"))


@query("agg_11_first_of_sorted_set", "SELECT passage_id, array_to_string(list_slice(list_sort(list(DISTINCT concept)), 1, 2), ',') AS firsts FROM passage_concepts GROUP BY passage_id")
def _(t: Tables):
    return t.passage_concepts.groupBy("passage_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("concept")), 1, 2), ",").alias("firsts"))


@query("agg_12_labels_of_group", "SELECT passage_id, round(sum(confidence), 3) AS total, arg_max(concept, (confidence, concept)) AS top, array_to_string(list_sort(list(DISTINCT field)), ',') AS fields FROM passage_concepts GROUP BY passage_id")
def _(t: Tables):
    return t.passage_concepts.groupBy("passage_id").agg(F.round(F.sum("confidence"), 3).alias("total"), F.max_by("concept", F.struct("confidence", "concept")).alias("top"), F.array_join(F.array_sort(F.collect_set("field")), ",").alias("fields"))


@query("agg_13_passage_summary", "SELECT passage_id, count(*) AS n, array_to_string(list(concept || '/' || concept_type ORDER BY concept, concept_type), ',') AS concepts FROM passage_concepts GROUP BY passage_id")
def _(t: Tables):
    g = t.passage_concepts.groupBy("passage_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("concept", "concept_type"))).alias("x"))
    return g.select("passage_id", "n", F.array_join(F.transform("x", lambda s: F.concat_ws("/", s["concept"], s["concept_type"])), ",").alias("concepts"))


@query("agg_14_corpus_statistics", "SELECT count(DISTINCT passage_id) AS passages, count(DISTINCT concept) AS concepts, round(sum(confidence), 3) AS total, median(confidence) AS median, min(confidence) AS least, max(confidence) AS most FROM passage_concepts")
def _(t: Tables):
    return t.passage_concepts.agg(F.count_distinct("passage_id").alias("passages"), F.count_distinct("concept").alias("concepts"), F.round(F.sum("confidence"), 3).alias("total"), F.median("confidence").alias("median"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))


@query("agg_15_concentration", """, g AS (SELECT field, concept, count(*) AS n FROM passage_concepts GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, concept) AS r FROM g) SELECT field, round(sum(CASE WHEN r <= 5 THEN n ELSE 0 END) / sum(n), 6) AS top5 FROM r GROUP BY field""")
def _(t: Tables):
    g = t.passage_concepts.groupBy("field", "concept").agg(F.count("*").alias("n"))
    r = g.withColumn("r", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "concept")))
    return r.groupBy("field").agg(F.round(F.sum(F.when(F.col("r") <= 5, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("top5"))


@query("agg_16_count_split_lists", """, c AS (SELECT passage_id, string_agg(concept, ',' ORDER BY concept) AS l FROM passage_concepts GROUP BY passage_id), u AS (SELECT unnest(string_split(l, ',')) AS concept FROM c) SELECT concept, count(*) AS n FROM u GROUP BY concept""")
def _(t: Tables):
    c = t.passage_concepts.groupBy("passage_id").agg(F.array_join(F.collect_list("concept"), ",").alias("l"))
    return c.select(F.explode(F.split("l", ",")).alias("concept")).groupBy("concept").agg(F.count("*").alias("n"))


@query("agg_17_filled_share", "SELECT round(count(l.toxic) / count(*), 6) AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t: Tables):
    return t("documents").select("doc_id").join(t("labels").select("doc_id", "toxic"), "doc_id", "left").agg(F.round(F.count("toxic") / F.count("*"), 6).alias("labelled"))


@query("agg_18_excerpts_of_document", "SELECT doc_id, count(*) AS n, array_to_string(list(CAST(passage_id AS VARCHAR) || ':' || section ORDER BY passage_id), '|') AS excerpts FROM passages WHERE quality > 0.5 GROUP BY doc_id")
def _(t: Tables):
    g = t.passages.filter("quality > 0.5").groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("passage_id", "section"))).alias("x"))
    return g.select("doc_id", "n", F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["passage_id"].cast("string"), s["section"])), "|").alias("excerpts"))


@query("agg_19_json_array_counts", """, j AS (SELECT to_json(list(concept ORDER BY concept)) AS js FROM passage_concepts GROUP BY passage_id), u AS (SELECT unnest(CAST(js AS VARCHAR[])) AS concept FROM j) SELECT concept, count(*) AS n FROM u GROUP BY concept""")
def _(t: Tables):
    j = t.passage_concepts.groupBy("passage_id").agg(F.to_json(F.collect_list("concept")).alias("js"))
    return j.select(F.explode(F.from_json("js", "array<string>")).alias("concept")).groupBy("concept").agg(F.count("*").alias("n"))


@query("agg_20_max_over_ids", "SELECT p.doc_id, max(confidence) AS best FROM passages p JOIN passage_concepts USING (passage_id) GROUP BY p.doc_id")
def _(t: Tables):
    return t.passages.select("doc_id", "passage_id").join(t.passage_concepts.select("passage_id", "confidence"), "passage_id").groupBy("doc_id").agg(F.max("confidence").alias("best"))


@query("agg_21_repository_summary", "SELECT repo, count(DISTINCT file_id) AS files, count(DISTINCT chunk_id) AS chunks, array_to_string(list_sort(list(DISTINCT language)), ',') AS languages, count(DISTINCT name) AS concepts FROM code_files LEFT JOIN code_chunks USING (file_id) GROUP BY repo")
def _(t: Tables):
    return t.code_files.join(t.code_chunks, "file_id", "left").groupBy("repo").agg(F.count_distinct("file_id").alias("files"), F.count_distinct("chunk_id").alias("chunks"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.count_distinct("name").alias("concepts"))


@query("agg_22_status_pivot", "SELECT section, count(*) FILTER (WHERE status = 'F') AS f, count(*) FILTER (WHERE status = 'O') AS o, count(*) FILTER (WHERE status = 'P') AS p FROM passages GROUP BY section")
def _(t: Tables):
    g = t.passages.groupBy("section").pivot("status", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return g.select("section", *(F.coalesce(s, F.lit(0)).alias(s.lower()) for s in ("F", "O", "P")))


# -- windows --------------------------------------------------------------------------------------------------------


@query("win_01_distinct_on", "SELECT * FROM (SELECT DISTINCT ON (passage_id) passage_id, concept, confidence FROM passage_concepts WHERE concept ILIKE '%ring%' ORDER BY passage_id, confidence DESC, concept) ORDER BY passage_id LIMIT 100")
def _(t: Tables):
    hits = t.passage_concepts.filter(F.col("concept").ilike("%ring%")).select("passage_id", "concept", "confidence")
    return R.distinct_on(hits, ["passage_id"], [F.desc("confidence"), F.asc("concept")], limit=100)


@query("win_02_ranks", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def _(t: Tables):
    return R.ranked(t("customer").select("c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")]).select("c_custkey", "rank")


@query("win_03_keep_first_of_ranked", "SELECT field, passage_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY confidence DESC, passage_id) AS r FROM (SELECT DISTINCT field, passage_id, confidence FROM passage_concepts)) WHERE r = 1")
def _(t: Tables):
    return R.distinct_on(t.passage_concepts.select("field", "passage_id", "confidence").distinct(), ["field"], [F.desc("confidence"), F.asc("passage_id")])


@query("win_04_keep_max_by_title", "SELECT concept, max(confidence) AS confidence, arg_max(passage_id, (confidence, passage_id)) AS passage_id FROM passage_concepts GROUP BY concept")
def _(t: Tables):
    return R.keep_max(t.passage_concepts.select("concept", "confidence", "passage_id"), ["concept"], F.struct("confidence", "passage_id"))


@query("win_05_dedup_by_priority", """, h AS (SELECT doc_id, CASE source WHEN 'src1' THEN 3 WHEN 'src2' THEN 2 ELSE 1 END AS prio, sha256(text) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY prio DESC, doc_id) AS r FROM h) SELECT doc_id, r = 1 AS kept FROM r""")
def _(t: Tables):
    prio = F.when(F.col("source") == "src1", 3).when(F.col("source") == "src2", 2).otherwise(1)
    h = t("documents").select("doc_id", prio.alias("prio"), F.sha2("text", 256).alias("h"))
    best = h.groupBy("h").agg(F.min(F.struct((-F.col("prio")).alias("p"), "doc_id"))["doc_id"].alias("best"))
    return h.join(best, "h").select("doc_id", (F.col("doc_id") == F.col("best")).alias("kept"))


@query("win_06_early_and_recent_mean", """, d AS (SELECT source, CAST(ts AS DATE) AS d, avg(value) AS v FROM feed GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY d) AS a, row_number() OVER (PARTITION BY source ORDER BY d DESC) AS z FROM d) SELECT source, round(avg(v) FILTER (WHERE a <= 3), 6) AS early, round(avg(v) FILTER (WHERE z <= 3), 6) AS recent FROM r GROUP BY source""")
def _(t: Tables):
    d = t.feed.groupBy("source", F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    r = d.withColumn("a", F.row_number().over(Window.partitionBy("source").orderBy("d"))).withColumn("z", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("d"))))
    return r.groupBy("source").agg(F.round(F.avg(F.when(F.col("a") <= 3, F.col("v"))), 6).alias("early"), F.round(F.avg(F.when(F.col("z") <= 3, F.col("v"))), 6).alias("recent"))


@query("win_07_consecutive_dedup", """, l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, event_id, event_type FROM l WHERE event_type IS DISTINCT FROM p""")
def _(t: Tables):
    p = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").select("user_id", "event_id", "event_type", p.alias("p")).filter(~F.col("event_type").eqNullSafe(F.col("p"))).drop("p")


@query("win_08_top_nulls_last", "SELECT d.doc_id, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id) ORDER BY l.toxic DESC NULLS LAST, d.doc_id LIMIT 200")
def _(t: Tables):
    return t("documents").select("doc_id").join(t("labels").select("doc_id", "toxic"), "doc_id", "left").orderBy(F.desc_nulls_last("toxic"), "doc_id").limit(200)


@query("win_09_sample", "SELECT doc_id FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id LIMIT 25")
def _(t: Tables):
    return t("documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":7"))), "doc_id").limit(25)


@query("win_10_stride_sample", """, r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) SELECT doc_id, r AS rank FROM r WHERE r % 10 = 1""")
def _(t: Tables):
    return R.ranked(t("documents").select("doc_id"), [F.asc("doc_id")]).filter("rank % 10 = 1")


@query("win_11_pages", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 30 OFFSET 60")
def _(t: Tables):
    return t("documents").select("doc_id").orderBy("doc_id").offset(60).limit(30)


@query("win_12_greedy_overlap_filter")
def _(t: Tables):
    """The state runs through a ranked report of at most 300 rows, so it is folded on the driver."""
    from lodestone.operators.atlas import greedy_distinct

    top = t("part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(300).select("p_partkey", F.split("p_name", " ").alias("words")).collect()
    kept = greedy_distinct([r.asDict() for r in top], "words", most=20, free=6)
    return t.spark.createDataFrame([(i + 1, h["p_partkey"]) for i, h in enumerate(kept)], "rank int, p_partkey long")


@query("src_06_keyset_page", "SELECT passage_id, status FROM passages WHERE passage_id > 500 ORDER BY passage_id LIMIT 50")
def _(t: Tables):
    return t.passages.filter("passage_id > 500").select("passage_id", "status").orderBy("passage_id").limit(50)


# -- sets -----------------------------------------------------------------------------------------------------------


@query("set_01_union_of_counts", "SELECT 'documents' AS kind, count(*) AS n FROM documents_kb UNION ALL SELECT 'passages', count(*) FROM passages UNION ALL SELECT 'concepts', count(*) FROM passage_concepts")
def _(t: Tables):
    of = lambda n, d: d.agg(F.count("*").alias("n")).select(F.lit(n).alias("kind"), "n")
    return of("documents", t.documents_kb).unionByName(of("passages", t.passages)).unionByName(of("concepts", t.passage_concepts))


@query("set_02_explicit_and_inferred", """, e AS (SELECT DISTINCT passage_id, field AS label, 'explicit' AS how FROM passage_concepts WHERE concept_type = 'economy'), i AS (SELECT passage_id, arg_max(concept, (confidence, concept)) AS label, 'inferred' AS how FROM passage_concepts WHERE passage_id NOT IN (SELECT passage_id FROM e) GROUP BY passage_id) SELECT * FROM e UNION ALL SELECT * FROM i""")
def _(t: Tables):
    p = t.passage_concepts
    e = p.filter("concept_type = 'economy'").select("passage_id", F.col("field").alias("label")).distinct()
    i = p.join(e.select("passage_id"), "passage_id", "left_anti").groupBy("passage_id").agg(F.max_by("concept", F.struct("confidence", "concept")).alias("label"))
    return e.withColumn("how", F.lit("explicit")).unionByName(i.withColumn("how", F.lit("inferred")))


@query("set_03_differences", "(SELECT doc_id, 'unlabelled' AS side FROM documents EXCEPT SELECT doc_id, 'unlabelled' FROM labels) UNION ALL (SELECT doc_id, 'unknown' FROM labels EXCEPT SELECT doc_id, 'unknown' FROM documents)")
def _(t: Tables):
    d, l = t("documents").select("doc_id"), t("labels").select("doc_id")
    return d.subtract(l).withColumn("side", F.lit("unlabelled")).union(l.subtract(d).withColumn("side", F.lit("unknown")))


@query("set_04_emerging_established", """, r AS (SELECT DISTINCT concept FROM passage_concepts WHERE created_at >= TIMESTAMP '2000-01-01' AND confidence >= 0.99), o AS (SELECT DISTINCT concept FROM passage_concepts WHERE created_at < TIMESTAMP '1993-01-01' AND confidence >= 0.99) SELECT concept, CASE WHEN concept IN (SELECT concept FROM o) THEN 'established' ELSE 'emerging' END AS state FROM r""")
def _(t: Tables):
    p = t.passage_concepts.filter("confidence >= 0.99")
    r, o = p.filter("created_at >= '2000-01-01'").select("concept").distinct(), p.filter("created_at < '1993-01-01'").select("concept").distinct()
    return r.subtract(o).withColumn("state", F.lit("emerging")).union(r.intersect(o).withColumn("state", F.lit("established")))


@query("set_05_result_overlap", """, a AS (SELECT c_nationkey AS q, list(c_custkey) AS x FROM customer WHERE c_acctbal > 3000 GROUP BY 1), b AS (SELECT c_nationkey AS q, list(c_custkey) AS y FROM customer WHERE c_acctbal < 6000 GROUP BY 1) SELECT q, round(len(list_intersect(x, y)) / greatest(1, len(y)), 6) AS overlap FROM a JOIN b USING (q)""")
def _(t: Tables):
    c = t("customer").withColumnRenamed("c_nationkey", "q")
    a, b = c.filter("c_acctbal > 3000").groupBy("q").agg(F.collect_set("c_custkey").alias("x")), c.filter("c_acctbal < 6000").groupBy("q").agg(F.collect_set("c_custkey").alias("y"))
    return a.join(b, "q").select("q", F.round(F.size(F.array_intersect("x", "y")) / F.greatest(F.lit(1), F.size("y")), 6).alias("overlap"))


@query("set_06_concepts_of_question", """, c AS (SELECT passage_id, list(DISTINCT concept) AS c FROM passage_concepts GROUP BY passage_id) SELECT passage_id, len(list_intersect(c, ['red_ring', 'blue_bolt', 'small_ring'])) AS n FROM c""")
def _(t: Tables):
    asked = F.array(*map(F.lit, ("red_ring", "blue_bolt", "small_ring")))
    return t.passage_concepts.groupBy("passage_id").agg(F.collect_set("concept").alias("c")).select("passage_id", F.size(F.array_intersect("c", asked)).cast("bigint").alias("n"))


# -- upserts --------------------------------------------------------------------------------------------------------


@query("snk_03_upsert_last_writer", """, r AS (SELECT passage_id, concept, version, confidence, row_number() OVER (PARTITION BY passage_id, concept, version ORDER BY created_at DESC, confidence DESC) AS r FROM passage_concepts) SELECT passage_id, concept, version, confidence FROM r WHERE r = 1""")
def _(t: Tables):
    rows = t.passage_concepts.select("passage_id", "concept", "version", "confidence", F.struct("created_at", "confidence").alias("at"))
    old, new = rows.filter("at.created_at < '1997-01-01'"), rows.filter("at.created_at >= '1997-01-01'")
    return R.upsert_last(old, new, ["passage_id", "concept", "version"], "at").drop("at")


@query("snk_04_upsert_coalesce", """, o AS (SELECT c_custkey AS k, c_name AS a, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS b FROM customer WHERE c_custkey < 100), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'new' END AS a, 'seg' AS b FROM customer WHERE c_custkey >= 50) SELECT coalesce(o.k, n.k) AS k, coalesce(n.a, o.a) AS a, coalesce(n.b, o.b) AS b FROM o FULL JOIN n ON o.k = n.k""")
def _(t: Tables):
    c = t("customer").withColumnRenamed("c_custkey", "k")
    old = c.filter("k < 100").select("k", F.col("c_name").alias("a"), F.when(F.col("k") % 2 == 0, F.col("c_mktsegment")).alias("b"))
    new = c.filter("k >= 50").select("k", F.when(F.col("k") % 3 == 0, F.lit("new")).alias("a"), F.lit("seg").alias("b"))
    return R.upsert_coalesce(old, new, ["k"])


@query("snk_05_upsert_counters", "SELECT event_type AS job, CAST(sum(user_id) AS BIGINT) AS done, count(*) AS updates, arg_max(user_id, (ts, event_id)) AS state FROM events GROUP BY event_type")
def _(t: Tables):
    u = t("events").select(F.col("event_type").alias("job"), F.col("user_id").alias("done"), F.lit(1).cast("bigint").alias("updates"), F.col("user_id").alias("state"), F.struct("ts", "event_id").alias("at"))
    return R.upsert_counters(u, ["job"], ["done", "updates"], "state", "at")


@query("snk_06_insert_ignore", """, o AS (SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey < 80), n AS (SELECT o_custkey AS k, min(o_orderkey) AS f FROM orders GROUP BY 1) SELECT k, v FROM o UNION ALL SELECT k, 'order' || f FROM n WHERE k NOT IN (SELECT k FROM o)""")
def _(t: Tables):
    old = t("customer").filter("c_custkey < 80").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"), F.lit(0).cast("bigint").alias("at"))
    new = t("orders").select(F.col("o_custkey").alias("k"), F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("v"), F.col("o_orderkey").alias("at"))
    return R.insert_ignore(old, new, ["k"], "at").drop("at")


@query("snk_09_delete_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t: Tables):
    return t("documents").select("doc_id").join(t("labels").filter("toxic = 1"), "doc_id", "left_anti").select("doc_id")


@query("snk_12_reverse_sync", """, missing AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) SELECT m.o_orderkey, coalesce(c.c_name, substr(md5(CAST(m.o_custkey AS VARCHAR)), 1, 16)) AS parent FROM missing m LEFT JOIN customer c ON c.c_custkey = m.o_custkey AND c.c_nationkey < 12""")
def _(t: Tables):
    m = t("orders").select("o_orderkey", "o_custkey").join(t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")
    c = t("customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return m.join(c, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.substring(F.md5(F.col("o_custkey").cast("string")), 1, 16)).alias("parent"))
