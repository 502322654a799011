"""Queries of expressions: identities, text, chunks, concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import chunking, concepts, identity, text
from lodestone.plans.registry import Tables, query


@query("id_01_document_uuid", """, keyed AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'doi:10.1000/' || lower(title) WHEN doc_id % 3 = 1 THEN 'pmid:' || doc_id ELSE 'th:' || substr(sha256(trim(regexp_replace(lower(title), '[^\\w\\s]', '', 'g'))), 1, 16) || '|y:' || year || '|a:' || lower(venue) END AS k FROM documents_kb),
hashed AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(k)) AS h FROM keyed)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM hashed""")
def _(t: Tables):
    d = t.documents_kb
    none = F.lit(None).cast("string")
    doi = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10.1000/"), "title")).otherwise(none)
    pmid = F.when(F.col("doc_id") % 3 == 1, F.col("doc_id").cast("string")).otherwise(none)
    return d.select("doc_id", identity.doc_id(doi, pmid, none, F.col("title"), F.col("year"), F.col("venue")).alias("id"))


@query("id_02_normal_title", "SELECT page_id, trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')) AS title FROM pages")
def _(t: Tables):
    return t("pages").select("page_id", identity.normal_title(F.col("url")).alias("title"))


@query("id_03_title_hash", "SELECT doc_id, substr(sha256(regexp_replace(lower(title), '[^a-z0-9_ ]', '', 'g')), 1, 16) AS title_hash FROM documents_kb")
def _(t: Tables):
    return t.documents_kb.select("doc_id", identity.title_hash(F.col("title")).alias("title_hash"))


@query("id_04_passage_uuid", """, hashed AS (SELECT passage_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(doc_id || '|p:' || page_num || '|s:' || passage_id || '|e:' || (passage_id + 100))) AS h FROM passages)
SELECT passage_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM hashed""")
def _(t: Tables):
    return t.passages.select("passage_id", identity.passage_id(F.col("doc_id").cast("string"), F.col("page_num"), F.col("passage_id"), F.col("passage_id") + 100).alias("id"))


@query("id_05_short_hashes", "SELECT doc_id, substr(sha256(text), 1, 32) AS chunk_id, substr(sha256(text), 1, 16) AS file_hash, md5(text) AS cache_key FROM documents")
def _(t: Tables):
    return t("documents").select("doc_id", identity.short_hash(F.col("text")).alias("chunk_id"), identity.short_hash(F.col("text"), 16).alias("file_hash"), F.md5("text").alias("cache_key"))


@query("id_06_paper_key", "SELECT doc_id, md5(regexp_replace(lower(title), '[^a-z0-9]', '', 'g')) AS paper_key FROM documents_kb")
def _(t: Tables):
    return t.documents_kb.select("doc_id", identity.paper_key(F.col("title")).alias("paper_key"))


@query("id_07_identifiers_in_text", "SELECT page_id, CAST(nullif(regexp_extract('seen in ' || (1990 + page_id % 35) || ' at ' || url, '\\b(19[0-9]{2}|20[0-9]{2})\\b', 1), '') AS INTEGER) AS year, nullif(regexp_extract('doi 10.1234/ab' || page_id || ').', '(10\\.[0-9]{4,9}/[a-z0-9]+)', 1), '') AS doi, nullif(regexp_extract('PMID: ' || (1000 + page_id), '(?i)pmid:?\\s*([0-9]{4,9})', 1), '') AS pmid FROM pages")
def _(t: Tables):
    p = t("pages")
    n = F.col("page_id").cast("string")
    seen = F.concat(F.lit("seen in "), (F.lit(1990) + F.col("page_id") % 35).cast("string"), F.lit(" at "), "url")
    return p.select("page_id", identity.year_in(seen).alias("year"), identity.doi_in(F.concat(F.lit("doi 10.1234/ab"), n, F.lit(")."))).alias("doi"), identity.pmid_in(F.concat(F.lit("PMID: "), (1000 + F.col("page_id")).cast("string"))).alias("pmid"))


@query("id_08_repositories_in_text", "SELECT file_id, 'own' || file_id || '/lib,other/x' AS repos, CAST(2 AS INTEGER) AS n FROM code_files")
def _(t: Tables):
    note = F.concat(F.lit("see https://github.com/own"), F.col("file_id").cast("string"), F.lit("/lib.git, github.com/other/x. And github.com/other/x"))
    repos = identity.repos_in(note)
    return t.code_files.select("file_id", F.array_join(repos, ",").alias("repos"), F.size(repos).cast("int").alias("n"))


@query("src_07_hash_shards", "SELECT CAST(('0x' || substr(md5(CAST(passage_id AS VARCHAR)), 1, 8)) AS BIGINT) % 8 AS shard, count(*) AS n FROM passages GROUP BY 1")
def _(t: Tables):
    return t.passages.groupBy(identity.hash_shard(F.md5(F.col("passage_id").cast("string")), 8).cast("bigint").alias("shard")).agg(F.count("*").alias("n"))


@query("str_01_snake_case", "SELECT part_id, any_value(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS snake FROM passage_concepts JOIN part ON part_id = p_partkey GROUP BY part_id")
def _(t: Tables):
    used = t("lineitem").select(F.col("l_partkey").alias("part_id")).distinct()
    return used.join(t("part"), F.col("part_id") == F.col("p_partkey")).select("part_id", text.snake_case(F.concat_ws(" ", "p_name", "p_brand")).alias("snake"))


@query("str_02_soft_repair", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([.!?;:])([a-zA-Z0-9])', '\\1 \\2', 'g'), ',([a-zA-Z0-9])', ', \\1', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))) AS repaired FROM documents")
def _(t: Tables):
    return t("documents").select("doc_id", F.md5(text.soft_repair(F.col("text"))).alias("repaired"))


@query("str_03_match_form", "SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), '[ \\t\\n\\r\\f]+', '', 'g'), '[!-/:-@\\[-`{-~]', '', 'g')) AS matched FROM documents")
def _(t: Tables):
    return t("documents").select("doc_id", F.md5(text.match_form(F.col("text"))).alias("matched"))


@query("str_04_text_quality", """, m AS (SELECT doc_id, text, length(text) AS n, (length(text) - length(regexp_replace(text, '[ \\t\\n\\r\\f]', '', 'g'))) / length(text) AS ws, list_transform(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: length(w)) AS runs, len(regexp_extract_all(text, '[a-z][A-Z]')) / length(text) AS camel FROM documents),
s AS (SELECT *, list_max(runs) AS run, coalesce(list_avg(list_filter(runs, lambda k: k > 0)), 0) AS avg FROM m),
q AS (SELECT *, n < 20 AS short, 1.0 - CASE WHEN ws < 0.10 THEN 0.4 WHEN ws < 0.15 THEN 0.2 ELSE 0.0 END - CASE WHEN run > 100 THEN 0.3 WHEN run > 50 THEN 0.15 ELSE 0.0 END - CASE WHEN camel > 0.10 THEN 0.3 WHEN camel > 0.05 THEN 0.15 ELSE 0.0 END - CASE WHEN avg < 3 OR avg > 12 THEN 0.1 ELSE 0.0 END AS raw FROM s)
SELECT doc_id, CASE WHEN short THEN 0.0 ELSE round(greatest(0.0, least(1.0, CAST(raw AS DOUBLE))), 3) END AS score, CASE WHEN short THEN 'short' WHEN round(greatest(0.0, raw), 3) >= 0.7 THEN 'clean' WHEN ws < 0.10 THEN 'no_space' WHEN camel > 0.05 OR run > 50 THEN 'glued' ELSE 'marginal' END AS label, CAST(CASE WHEN short THEN 0 ELSE run END AS INTEGER) AS max_run FROM q""")
def _(t: Tables):
    q = text.text_quality(F.col("text"))
    return t("documents").select("doc_id", q["score"].alias("score"), q["label"].alias("label"), q["max_run"].alias("max_run"))


@query("str_05_ocr_repair", "SELECT doc_id, replace(replace('e' || 'ﬃ' || 'cient ' || title, 'ﬃ', 'ffi'), 'x', 'x') AS repaired FROM documents_kb")
def _(t: Tables):
    return t.documents_kb.select("doc_id", text.ocr_repaired(F.concat(F.lit("eﬃcient "), "title")).alias("repaired"))


@query("str_06_first_title", """, l AS (SELECT doc_id, list_filter(list_transform(list_slice(string_split(text, chr(10)), 1, 20), lambda s: trim(s)), lambda s: length(s) >= 10 AND length(s) <= 200 AND NOT regexp_matches(s, '^[0-9.\\s]+$') AND NOT regexp_matches(lower(s), '^(abstract|introduction|contents|references|doi|http|www)')) AS x FROM documents) SELECT doc_id, x[1] AS title FROM l""")
def _(t: Tables):
    return t("documents").select("doc_id", text.first_title(F.col("text")).alias("title"))


@query("str_07_authors", "SELECT doc_id, title || ';' || venue AS authors FROM documents_kb")
def _(t: Tables):
    note = F.concat(F.lit("Some Title\nAuthors: "), "title", F.lit(", "), "venue", F.lit("\n"))
    return t.documents_kb.select("doc_id", F.array_join(text.authors_in(note), ";").alias("authors"))


@query("str_08_citations", "SELECT passage_id, '(' || d.title || ' et al., ' || d.year || CASE WHEN page_num >= 1 THEN ', p. ' || page_num ELSE '' END || ')' AS inline, d.title || ', ' || venue || '. (' || d.year || '). ' || d.title || '. ' || venue AS full_form FROM passages p JOIN documents_kb d USING (doc_id)")
def _(t: Tables):
    j = t.passages.select("passage_id", "doc_id", "page_num").join(t.documents_kb, "doc_id")
    who = F.array("title", "venue")
    return j.select("passage_id", text.inline_citation(who, F.col("year"), F.col("page_num")).alias("inline"), text.full_citation(who, F.col("year"), F.col("title"), F.col("venue"), F.lit(None).cast("string")).alias("full_form"))


@query("str_09_permalinks", "SELECT chunk_id, 'https://github.com/' || c.org || '/' || repo || '/blob/HEAD/' || path || '#L' || start_line || '-L' || (start_line + 9) AS link, repo || '/' || path || ':' || start_line AS short_ref FROM code_chunks c JOIN code_files USING (file_id)")
def _(t: Tables):
    j = t.code_chunks.join(t.code_files, "file_id")
    return j.select("chunk_id", text.permalink(F.col("org"), F.col("repo"), F.lit(None).cast("string"), F.col("path"), F.col("start_line"), F.col("start_line") + 9).alias("link"), text.short_ref(F.col("repo"), F.col("path"), F.col("start_line")).alias("short_ref"))


@query("str_10_json_in_chatter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(t: Tables):
    n = F.col("event_id") % 3
    reply = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))).otherwise(F.concat(F.lit("I found "), "props", F.lit(" there.")))
    return t("events").select("event_id", F.try_variant_get(text.json_in(reply), "$.k", "int").alias("k"))


@query("str_11_key_terms", """, w AS (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS w, generate_subscripts(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> ''), 1) AS pos FROM benchmark),
k AS (SELECT item_id, w, count(*) AS n, min(pos) AS first FROM w WHERE length(w) > 3 AND w NOT IN (""" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + """) GROUP BY item_id, w),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, first, w) AS r FROM k)
SELECT b.item_id, coalesce(string_agg(w, ',' ORDER BY r), '') AS terms FROM benchmark b LEFT JOIN r ON b.item_id = r.item_id AND r <= 8 GROUP BY b.item_id""")
def _(t: Tables):
    return t("benchmark").select("item_id", F.array_join(text.key_terms(F.col("text")), ",").alias("terms"))


@query("str_12_tokens_and_cost", "SELECT source, CAST(sum(length(text) // 4) AS BIGINT) AS tokens, round(sum(length(text) // 4) * 0.1 / 1000000 + count(*) * 150 * 0.4 / 1000000, 6) AS cost FROM documents GROUP BY source")
def _(t: Tables):
    n = text.token_estimate(F.col("text"))
    g = t("documents").groupBy("source").agg(F.sum(n).alias("tokens"), F.count("*").alias("docs"))
    return g.select("source", "tokens", F.round(text.extraction_cost(F.col("tokens"), F.col("docs") * 150, 0.1, 0.4), 6).alias("cost"))


@query("str_13_searchable_text", "SELECT doc_id, title || chr(10) || venue || CASE WHEN year % 2 = 0 THEN chr(10) || year ELSE '' END AS searchable, CASE WHEN length(title) > 12 THEN substr(title, 1, 12) || '...' ELSE title END AS short FROM documents_kb")
def _(t: Tables):
    return t.documents_kb.select("doc_id", text.searchable(F.col("title"), F.col("venue"), F.when(F.col("year") % 2 == 0, F.col("year").cast("string")).otherwise("")).alias("searchable"), text.truncated(F.col("title"), 12).alias("short"))


@query("str_14_source_kind", "SELECT conv_id, turn, CASE WHEN regexp_matches(lower(substr(text, 1, 1000)), 'abstract|doi:|arxiv') THEN 'paper' WHEN regexp_matches(lower(substr(text, 1, 1000)), '\\bdef |\\bclass |import |function\\(') THEN 'code' WHEN regexp_matches(lower(substr(text, 1, 1000)), 'chapter [0-9]|exercises') THEN 'textbook' ELSE 'document' END AS kind FROM conversations")
def _(t: Tables):
    return t("conversations").select("conv_id", "turn", text.source_kind(F.col("text")).alias("kind"))


@query("chk_02_context_prefix", """, l AS (SELECT doc_id, source, list_filter(list_slice(string_split_regex(text, '\\. '), 1, 5), lambda s: length(s) > 20)[1] AS lead FROM documents) SELECT doc_id, '[' || source || coalesce(': ' || substr(lead, 1, 200), '') || ']' AS prefix FROM l""")
def _(t: Tables):
    return t("documents").select("doc_id", chunking.context_prefix(F.col("source"), F.col("text")).alias("prefix"))


@query("chk_04_stride_chunks", """, s AS (SELECT doc_id, text, unnest(generate_series(1, greatest(1, length(text)), 1300)) AS s FROM documents), c AS (SELECT doc_id, s, substr(text, s, 1500) AS chunk FROM s WHERE length(substr(text, s, 1500)) > 100), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS n FROM c)
SELECT doc_id, CAST(n AS INTEGER) AS n, md5(chunk) AS chunk FROM r WHERE n < 20""")
def _(t: Tables):
    return t("documents").select("doc_id", F.posexplode(chunking.stride_chunks(F.col("text"))).alias("n", "chunk")).select("doc_id", "n", F.md5("chunk").alias("chunk"))


@query("chk_01_sentence_chunks")
def _(t: Tables):
    return chunking.sentence_chunks(t("documents"), "doc_id", "text")


@query("chk_03_page_chunks")
def _(t: Tables):
    return chunking.page_chunks(t("documents"), "doc_id", "text")


@query("chk_05_python_chunks")
def _(t: Tables):
    src = F.concat(F.lit('"""Module."""\nimport os\n\nclass C'), F.col("file_id").cast("string"), F.lit(':\n    def m(self, a=1) -> int:\n        """Doc."""\n        return a\n\ndef f(x):\n    return x\n'))
    return chunking.python_chunks(t.code_files.select("file_id", src.alias("source")), "file_id", "source")


@query("chk_06_markdown_sections", """, m AS (SELECT conv_id, string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn) AS md FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, list_filter(list_transform(string_split(md, chr(10) || '## '), lambda s: trim(s, ' ')), lambda s: length(s) >= 50) AS x FROM m)
SELECT conv_id, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS n, length(unnest(x)) AS n_chars FROM p""")
def _(t: Tables):
    turns = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    md = F.array_join(F.transform("t", lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n"), x["text"])), "\n")
    return turns.select("conv_id", F.posexplode(chunking.markdown_sections(md)).alias("n", "s")).select("conv_id", "n", F.length("s").cast("bigint").alias("n_chars"))


@query("chk_07_skeleton", "SELECT file_id, 'import os' || chr(10) || 'class C' || file_id || ':' || chr(10) || '    def m(self):' AS skeleton FROM code_files")
def _(t: Tables):
    src = F.concat(F.lit("import os\n\nclass C"), F.col("file_id").cast("string"), F.lit(":\n    x = 1\n    def m(self):\n        return 1\n"))
    return t.code_files.select("file_id", chunking.skeleton(src).alias("skeleton"))


PATTERNS = {"metal": "bolt|ring|nut", "colour": "red|blue|green", "size": "small|large|big"}
KEYWORDS = {"metalwork": ("bolt", "ring"), "toys": ("widget", "gadget")}


@query("con_01_regex_concepts", "SELECT p_partkey, concat_ws(',', CASE WHEN regexp_matches(p_name, 'bolt|ring|nut') THEN 'metal' END, CASE WHEN regexp_matches(p_name, 'red|blue|green') THEN 'colour' END, CASE WHEN regexp_matches(p_name, 'small|large|big') THEN 'size' END) AS concepts FROM part")
def _(t: Tables):
    return t("part").select("p_partkey", F.array_join(concepts.tag_by_regex(F.col("p_name"), PATTERNS), ",").alias("concepts"))


@query("con_02_keyword_concepts", "SELECT p_partkey, concat_ws(',', CASE WHEN p_name LIKE '%bolt%' OR p_name LIKE '%ring%' THEN 'metalwork' END, CASE WHEN p_name LIKE '%widget%' OR p_name LIKE '%gadget%' THEN 'toys' END) AS concepts FROM part")
def _(t: Tables):
    return t("part").select("p_partkey", F.array_join(concepts.tag_by_keyword(F.col("p_name"), KEYWORDS), ",").alias("concepts"))


@query("con_03_known_concepts", "SELECT p_partkey, 'red_widget' AS term FROM part WHERE p_name IN ('red widget') UNION ALL SELECT p_partkey, 'ring' FROM part WHERE p_name LIKE '% ring'")
def _(t: Tables):
    terms = t.spark.createDataFrame([("red_widget",), ("ring",)], "term string")
    return concepts.tag_by_join(t("part"), "p_partkey", "p_name", terms)


@query("con_04_extracted_concepts", "SELECT p_partkey, concept, concept_type, round(0.7, 2)::DOUBLE AS confidence, CAST(CASE WHEN p_name LIKE '%ring%' OR p_name LIKE '%bolt%' THEN 0 ELSE 1 END AS INTEGER) AS model FROM part, (SELECT unnest([{'concept': 'ring', 'concept_type': 'metal'}, {'concept': 'bolt', 'concept_type': 'metal'}, {'concept': 'red', 'concept_type': 'colour'}], recursive := true)) WHERE contains(p_name, concept) AND (concept_type = 'metal' OR NOT (p_name LIKE '%ring%' OR p_name LIKE '%bolt%'))")
def _(t: Tables):
    cascade = [concepts.KeywordExtractor({"ring": "metal", "bolt": "metal"}), concepts.KeywordExtractor({"red": "colour"})]
    return concepts.extract_concepts(t("part"), "p_partkey", "p_name", cascade)


@query("con_05_extraction_route", """, m AS (SELECT doc_id, length(text) AS n, (length(text) - length(regexp_replace(text, '[ \\t\\n\\r\\f]', '', 'g'))) / length(text) AS ws, list_transform(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda w: length(w)) AS runs, len(regexp_extract_all(text, '[a-z][A-Z]')) / length(text) AS camel FROM documents),
s AS (SELECT *, list_max(runs) AS run, coalesce(list_avg(list_filter(runs, lambda k: k > 0)), 0) AS avg FROM m),
q AS (SELECT *, CASE WHEN n < 20 THEN 0 ELSE 1.0 - CASE WHEN ws < 0.10 THEN 0.4 WHEN ws < 0.15 THEN 0.2 ELSE 0.0 END - CASE WHEN run > 100 THEN 0.3 WHEN run > 50 THEN 0.15 ELSE 0.0 END - CASE WHEN camel > 0.10 THEN 0.3 WHEN camel > 0.05 THEN 0.15 ELSE 0.0 END - CASE WHEN avg < 3 OR avg > 12 THEN 0.1 ELSE 0.0 END END AS score FROM s)
SELECT doc_id, CASE WHEN score < 0.5 OR (n >= 20 AND score < 0.7 AND (ws < 0.10 OR camel > 0.05 OR run > 50)) THEN 'canonical' ELSE 'full' END AS route FROM q""")
def _(t: Tables):
    return t("documents").select("doc_id", concepts.extraction_route(F.col("text")).alias("route"))


@query("con_06_evidence_class", "SELECT passage_id, seq, part_id, CASE WHEN passage_id % 3 = 0 THEN 'literal' WHEN passage_id % 3 = 1 THEN 'normalized' WHEN confidence >= 0.9 THEN 'inferred' END AS support FROM passage_concepts")
def _(t: Tables):
    p = t.passage_concepts
    said = F.replace("concept", F.lit("_"), F.lit(" "))
    kind = F.col("passage_id") % 3
    surface = F.when(kind == 2, "zzz").otherwise(said)
    context = F.when(kind == 1, F.concat(F.lit("The "), F.upper(said), F.lit("!"))).otherwise(F.concat(F.lit("the "), said))
    raw = F.concat(F.lit("We saw the "), said, F.lit(" there."))
    return p.select("passage_id", "seq", "part_id", concepts.evidence_class(surface, context, raw, F.col("confidence")).alias("support"))


@query("con_07_evidence_struct", "SELECT doc_id, CAST(instr(lower(text), lower(substr(text, 11, 50))) - 1 AS INTEGER) AS start FROM documents")
def _(t: Tables):
    e = concepts.evidence_struct(F.lit("x"), F.substring("text", 11, 80), F.col("text"), F.lit(0.9), F.lit(""))
    return t("documents").select("doc_id", e["support"][0]["start"].alias("start"))


@query("con_08_valid_concepts", "SELECT part_id, any_value(concept) AS name, any_value(CASE WHEN concept_type = 'economy' THEN 'method' ELSE 'entity' END) AS type FROM passage_concepts GROUP BY part_id")
def _(t: Tables):
    p = t.passage_concepts.select("part_id", "concept", "concept_type").distinct()
    kind = F.when(F.col("concept_type") == "economy", "Method").otherwise(F.col("concept_type"))
    recs = F.array(F.struct(F.replace("concept", F.lit("_"), F.lit(" ")).alias("name"), kind.alias("type"), F.lit(1.7).alias("confidence")), F.struct(F.lit("?").alias("name"), kind.alias("type"), F.lit(0.1).alias("confidence")))
    v = concepts.valid_concepts(recs)
    return p.select("part_id", F.inline(v)).select("part_id", "name", "type")
