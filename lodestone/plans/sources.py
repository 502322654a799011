"""Queries of sources, sinks and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lodestone.operators.scratch import scratch_dir
from lodestone.plans.registry import Tables, query
from lodestone.sources import paged, pages, readers, sinks
from lodestone.streaming import feeds, late
from lodestone.streaming import status as machine
from lodestone.streaming.status import rocks


@query("src_01_relational_scan", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0")
def _(t: Tables):
    t("customer").createOrReplaceTempView("scan_customer")
    return t.spark.sql("SELECT c_custkey, c_name FROM scan_customer WHERE c_acctbal < 0")


@query("src_02_parquet_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def _(t: Tables):
    return readers.table(t.spark, f"{t.sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"], F.col("l_quantity") > 45)


@query("src_03_csv_scan", "SELECT n_nationkey, n_name FROM nation")
def _(t: Tables):
    path = scratch_dir(t.spark)
    t("nation").write.csv(path, header=True)
    return readers.csv(t.spark, path, "n_nationkey int, n_name string, n_regionkey int").select("n_nationkey", "n_name")


@query("src_04_json_golden", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS query, n_regionkey AS min_relevant_rank FROM nation")
def _(t: Tables):
    path = scratch_dir(t.spark)
    rows = t("nation").select(F.to_json(F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("query"), F.array("n_name").alias("expected_terms"), F.col("n_regionkey").alias("min_relevant_rank"))).alias("j"))
    rows.agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).write.text(path)
    return readers.golden(t.spark, path).select("id", "query", "min_relevant_rank")


@query("src_05_vector_scan", "SELECT vec_id, label FROM embeddings WHERE label = 3")
def _(t: Tables):
    path = scratch_dir(t.spark)
    sinks.vector_collection(t("embeddings"), path, "label")
    return t.spark.read.parquet(path).filter("collection = 3").select("vec_id", "label")


@query("src_08_repository", "SELECT repo, 'python' AS language, count(*) AS functions FROM code_files GROUP BY repo")
def _(t: Tables):
    """One module for each repository, and files that the walk leaves out."""
    path = scratch_dir(t.spark)
    line = F.concat(F.lit("def f"), F.col("file_id").cast("string"), F.lit("():  # a function of this file, with all that belongs to it"))
    t.code_files.select("repo", line.alias("value")).repartition("repo").write.partitionBy("repo").text(path)
    fs, root = sinks.file_system(t.spark, path)
    for folder in fs.listStatus(root):
        for f in fs.listStatus(folder.getPath()) if folder.isDirectory() else []:
            fs.rename(f.getPath(), f.getPath().getParent().suffix(f"/{f.getPath().getName()[:10]}.py"))
    t.code_files.select("path").limit(5).write.text(f"{path}/node_modules")
    found = readers.repository(t.spark, path)
    return found.groupBy(F.regexp_extract("path", "repo=([^/]+)", 1).alias("repo"), "language").agg(F.sum(F.regexp_count("text", F.lit("def f"))).alias("functions"))


@query("src_09_key_files", "SELECT path, CAST(CASE WHEN path LIKE '%5' THEN 1 ELSE 2 END AS INTEGER) AS priority FROM code_files WHERE path LIKE '%5' OR path LIKE '%7' ORDER BY priority, path LIMIT 5")
def _(t: Tables):
    return readers.key_files(t.code_files, "path", [("5$", 1), ("7$", 2)], 5)


@query("src_10_page_passages", ", p AS (SELECT conv_id, turn + 1 AS page, count(*) OVER (PARTITION BY conv_id) AS pages, text FROM conversations) SELECT conv_id, page, CASE WHEN page = 1 OR contains(lower(substr(text, 1, 200)), 'abstract') THEN 'abstract' WHEN contains(lower(substr(text, 1, 200)), 'method') THEN 'methods' WHEN contains(lower(substr(text, 1, 200)), 'result') THEN 'results' WHEN contains(lower(substr(text, 1, 200)), 'discussion') THEN 'discussion' WHEN contains(lower(substr(text, 1, 200)), 'references') OR page > 0.9 * pages THEN 'references' ELSE 'body' END AS section FROM p")
def _(t: Tables):
    c = t("conversations")
    n = c.groupBy("conv_id").agg(F.count("*").alias("pages"))
    return c.join(n, "conv_id").select("conv_id", (F.col("turn") + 1).alias("page"), readers.page_sections(F.col("text"), F.col("turn") + 1, F.col("pages")).alias("section"))


_PAGED = """, p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page, count(*) OVER (PARTITION BY conv_id) AS pages, coalesce(text, '') AS text, CASE WHEN conv_id % 7 = 1 THEN 'recovered' WHEN conv_id % 3 = 0 THEN 'text_utf-16' ELSE 'text_utf-8' END AS reader FROM conversations),
s AS (SELECT *, CASE WHEN page = 1 OR contains(lower(substr(text, 1, 200)), 'abstract') THEN 'abstract' WHEN regexp_matches(lower(text), 'methods|materials|experimental') THEN 'methods' WHEN regexp_matches(lower(text), 'results|findings') THEN 'results' WHEN regexp_matches(lower(text), 'discussion|conclusion') THEN 'discussion' WHEN regexp_matches(lower(text), 'references|bibliography') OR page > 0.9 * pages THEN 'references' ELSE 'body' END AS section FROM p)
"""


def _paged(t: Tables):
    """Each conversation as a file, a turn a page: most as UTF-8, some as UTF-16, some broken by a byte at their begin."""
    turns = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    text = F.array_join("t.text", "\f")
    utf8 = F.encode(text, "UTF-8")
    content = F.when(F.col("conv_id") % 7 == 1, F.concat(F.unhex(F.lit("FF")), utf8)).when(F.col("conv_id") % 3 == 0, F.encode(text, "UTF-16")).otherwise(utf8)
    return pages.with_sections(pages.read_pages(turns.select("conv_id", content.alias("content")), "conv_id", "content"))


@query("src_10_page_cascade", _PAGED + "SELECT conv_id, page, pages, reader, section, CAST(CASE WHEN section = 'discussion' THEN 0.8 WHEN section = 'body' THEN 0.7 WHEN section = 'references' THEN 0.3 ELSE 1.0 END AS DOUBLE) AS quality, length(text) + CASE WHEN reader = 'recovered' AND page = 1 THEN 1 ELSE 0 END AS n_chars FROM s")
def _(t: Tables):
    return _paged(t).select("conv_id", "page", "pages", "reader", "section", "quality", F.length("text").alias("n_chars"))


@query("src_10_cited_passages")
def _(t: Tables):
    return pages.page_passages(_paged(t), "conv_id")


@query("src_11_notebooks", "SELECT conv_id, CAST(rn - 1 AS INTEGER) AS n, CASE WHEN role = 'user' THEN 'markdown' ELSE 'code' END AS kind, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE trim(text) <> ''")
def _(t: Tables):
    cell = F.struct(F.when(F.col("role") == "user", "markdown").otherwise("code").alias("cell_type"), F.array("text").alias("source"))
    books = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cell.alias("c")))).alias("t"))
    books = books.select("conv_id", F.to_json(F.struct(F.col("t")["c"].alias("cells"))).alias("book"))
    return readers.notebook_cells(books, "conv_id", "book").select("conv_id", "n", "kind", F.length("source").cast("bigint").alias("n_chars"))


@query("src_12_subtitles", ", l AS (SELECT user_id, event_id, event_type AS line, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, count(*) AS lines FROM l WHERE line IS DISTINCT FROM b GROUP BY user_id")
def _(t: Tables):
    g = t("events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))
    cue = lambda s: F.concat(F.lit("00:01.000 --> 00:02.000\n<c>"), s["event_type"], F.lit("</c>\n"))
    files = g.select("user_id", F.concat(F.lit("WEBVTT\nKind: captions\n\n"), F.array_join(F.transform("x", cue), "\n")).alias("vtt"))
    return readers.subtitle_lines(files, "user_id", "vtt").groupBy("user_id").agg(F.count("*").alias("lines"))


@query("src_13_recorded_feeds")
def _(t: Tables):
    t.spark.dataSource.register(readers.RecordedFeed)
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>1</id><title>A  b</title><summary>s</summary><author><name>N. M</name></author><published>2024-01-02</published><link href="u"/></entry></feed>'
    body = json.dumps({"results": [{"id": "w1", "title": "T", "publication_date": "2024-01-01", "doi": "10.1/x", "cited_by_count": 3, "authorships": [{"author": {"display_name": "N"}}]}]})
    said = "\n".join(json.dumps(x) for x in ({"source": "preprint", "kind": "atom", "body": atom}, {"source": "index", "kind": "works", "body": body}))
    return t.spark.read.format("recorded_feed").option("responses", said).load()


_PAGE = 250


@query("src_13_paged_stream", f"SELECT 'w' || event_id AS external_id, event_type AS title, CAST(CAST(ts AS DATE) AS VARCHAR) AS published, CAST(user_id AS VARCHAR) AS user_id, row_number() OVER (ORDER BY event_id) - 1 - (row_number() OVER (ORDER BY event_id) - 1) % {_PAGE} AS first_of_page FROM events")
def _(t: Tables):
    """The events as recorded responses of a paged interface, read as a stream in two runs: the second brings what pages came
    meanwhile, and nothing twice."""
    from lodestone.operators.relational import ranked

    t.spark.dataSource.register(paged.PagedFeed)
    path, out, ck = scratch_dir(t.spark), scratch_dir(t.spark), scratch_dir(t.spark)
    e = ranked(t("events"), [F.asc("event_id")], "r").withColumn("first", F.col("r") - 1 - (F.col("r") - 1) % _PAGE)
    fields = {"id": F.concat(F.lit("w"), F.col("event_id").cast("string")), "title": F.col("event_type"), "publication_date": F.date_format("ts", "yyyy-MM-dd"), "user_id": F.col("user_id"), "first": F.col("first")}
    page = (F.col("first") / _PAGE).cast("bigint")
    half = e.agg(F.max(page)).first()[0] // 2
    items = t.spark.readStream.format("paged_feed").option("path", path).option("kind", "works").load()
    for part in (e.filter(page <= half), e.filter(page > half)):
        paged.write_pages(part, page, fields, path)
        items.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    got = t.spark.read.schema(readers.ITEM_SCHEMA).parquet(out)
    return got.select("external_id", "title", "published", F.col("meta")["user_id"].alias("user_id"), F.col("meta")["first"].cast("bigint").alias("first_of_page"))


@query("src_14_optional_metadata", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#7' AND p_size >= 10")
def _(t: Tables):
    from lodestone.operators.relational import where

    given = {"p_brand": "Brand#7", "p_type": None}
    return where(t("part"), *(F.col(k) == v if v is not None else None for k, v in given.items()), F.col("p_size") >= 10).select("p_partkey", "p_name")


@query("snk_01_formats", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def _(t: Tables):
    path, kind = scratch_dir(t.spark), "r_regionkey int, r_name string"
    sinks.write_all(t("region"), path)
    r = t.spark.read.schema(kind)
    return r.parquet(f"{path}/parquet").union(r.csv(f"{path}/csv", header=True)).union(r.json(f"{path}/json"))


@query("snk_02_training_lines", "SELECT '{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\"}' AS value FROM documents")
def _(t: Tables):
    return sinks.training_lines(t("documents"), ["doc_id", "lang"])


@query("snk_02_question_pairs", ", g AS (SELECT concept, list_slice(list_sort(list(DISTINCT section)), 1, 3) AS x FROM passage_concepts JOIN passages USING (passage_id) GROUP BY concept) SELECT 'Where is ' || replace(concept, '_', ' ') || ' discussed?' AS question, array_to_string(x, '; ') AS answer FROM g")
def _(t: Tables):
    return sinks.question_pairs(t.passage_concepts.select("passage_id", "concept").join(t.passages.select("passage_id", F.col("section").alias("title")), "passage_id"))


@query("snk_07_graph_merge", "SELECT passage_id AS src, concept AS dst, max(confidence) AS confidence FROM passage_concepts GROUP BY 1, 2")
def _(t: Tables):
    from lodestone.operators.graph import merged_edges

    rows = t.passage_concepts.select(F.col("passage_id").alias("src"), F.col("concept").alias("dst"), F.lit("MENTIONS").alias("type"), "confidence")
    return merged_edges(rows, "confidence").drop("type")


@query("snk_08_versioned_upsert", "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'second' ELSE 'first' END AS v FROM customer WHERE c_custkey % 5 <> 0")
def _(t: Tables):
    c = t("customer").select(F.col("c_custkey").alias("k"))
    store = sinks.VersionedTable(t.spark, scratch_dir(t.spark), "k bigint, v string, at int")
    store.upsert(c.select("k", F.lit("first").alias("v"), F.lit(1).alias("at")), ["k"], "at")
    store.upsert(c.filter("k % 2 = 0").select("k", F.lit("second").alias("v"), F.lit(2).alias("at")), ["k"], "at")
    store.delete(c.filter("k % 5 = 0"), ["k"])
    return store.read().drop("at")


@query("snk_10_graph_dump", "SELECT 'nodes' AS part, count(*) AS n FROM nation UNION ALL SELECT 'edges', count(*) FROM nation WHERE n_regionkey < 3")
def _(t: Tables):
    path = scratch_dir(t.spark)
    sinks.graph_dump(t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), t("nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")), path)
    n = lambda p: t.spark.read.text(f"{path}/{p}").agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n")
    return n("nodes").union(n("edges"))


@query("snk_11_report")
def _(t: Tables):
    g = t.passage_concepts.groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field").limit(10)
    return t.spark.createDataFrame([(sinks.markdown_table(g, "Fields"),)], "report string")


# -- streams --------------------------------------------------------------------------------------------------------


def _stream(t: Tables):
    """The events as a stream of files. Event time needs a zone; results have none again."""
    return t.spark.readStream.schema(t("events").schema).option("maxFilesPerTrigger", 1).parquet(f"{t.sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def _landed(t: Tables, df, name: str, mode: str):
    """Runs a stream over all that is there, and reads what it wrote."""
    path, ck = scratch_dir(t.spark), scratch_dir(t.spark)
    if mode == "complete":
        q = df.writeStream.foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(path)).outputMode("complete").option("checkpointLocation", ck).trigger(availableNow=True).start()
    else:
        q = df.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(path)


@query("stm_01_ingest_once", "SELECT source, user_id, min(event_id) AS event_id FROM feed GROUP BY source, user_id")
def _(t: Tables):
    items = _stream(t).select(F.col("event_type").alias("source"), "user_id", "event_id", "ts")
    store = sinks.VersionedTable(t.spark, scratch_dir(t.spark), "source string, user_id bigint, event_id bigint, ts timestamp")
    feeds.ingest(items, store, ["source", "user_id"], "event_id", scratch_dir(t.spark)).awaitTermination()
    return store.read().drop("ts")


@query("stm_02_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, source, count(*) AS n FROM feed GROUP BY 1, 2")
def _(t: Tables):
    w = feeds.volume_and_tone(_stream(t).withColumnRenamed("event_type", "source"), "ts", "value", "1 day", by=["source"])
    return _landed(t, w, "windows", "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "source", "n")


@query("stm_02_sliding_windows", ", w AS (SELECT unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start, value FROM feed) SELECT start, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY start")
def _(t: Tables):
    w = feeds.volume_and_tone(_stream(t), "ts", "value", "24 hours", "12 hours")
    return _landed(t, w, "sliding", "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round(F.col("mean") * F.col("n"), 4).alias("total"))


@query("stm_03_sessions", """, l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM feed), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def _(t: Tables):
    return _landed(t, feeds.sessions(_stream(t), "ts", "user_id", "6 hours"), "sessions", "complete").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("stm_04_late_rows", "SELECT date_trunc('hour', ts + CASE WHEN user_id % 2 = 1 THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END) AS hour, count(*) AS n, count(*) FILTER (WHERE user_id % 2 = 1) AS late FROM feed GROUP BY 1")
def _(t: Tables):
    """Half of the rows arrive three hours late; the report counts what a watermark of one hour would drop."""
    e = t("events").withColumn("arrived", F.when(F.col("user_id") % 2 == 1, F.col("ts") + F.expr("INTERVAL 3 HOURS")).otherwise(F.col("ts")))
    return feeds.counted_late(e, "ts", "arrived", F.expr("INTERVAL 1 HOUR")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


_LATE = ", e AS (SELECT event_id, ts, day(ts) <= 20 AND event_id % 9 <> 0 AS early FROM events), w AS (SELECT max(epoch_us(ts)) // 1000 * 1000 - 86400000000 AS w FROM e WHERE early), f AS (SELECT event_id, ts, NOT early AND epoch_us(ts) <= w AS late FROM e, w)"


def _twice(t: Tables):
    """Two deliveries: the second has later days, and every ninth row of the earlier ones. What came out of the stream, what
    was dropped by the watermark of a day, as the progress counts it."""
    path, out, ck = scratch_dir(t.spark), scratch_dir(t.spark), scratch_dir(t.spark)
    e = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), ((F.dayofmonth("ts") <= 20) & (F.col("event_id") % 9 != 0)).alias("early"))
    dropped, shape = 0, "event_id bigint, ts timestamp"
    for early in (True, False):
        e.filter(F.col("early") == early).select("event_id", "ts").write.mode("append").parquet(path)
        dropped += late.run_once(t.spark.readStream.schema(shape).parquet(path), ["event_id"], "ts", "1 day", out, ck)
    kept = t.spark.read.schema(shape).parquet(out)
    return kept, late.set_aside(t.spark.read.schema(shape).parquet(path), kept, ["event_id"], dropped)


@query("stm_04_kept_rows", _LATE + " SELECT event_id, ts FROM f WHERE NOT late")
def _(t: Tables):
    return _twice(t)[0].withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stm_04_dropped_rows", _LATE + " SELECT event_id, ts FROM f WHERE late")
def _(t: Tables):
    return _twice(t)[1].withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("stm_05_incremental_extraction", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'visit' ELSE 'other' END AS concept FROM events")
def _(t: Tables):
    out, ck = scratch_dir(t.spark), scratch_dir(t.spark)
    extract = lambda d: d.select("event_id", F.when(F.col("event_type").isin("click", "view"), "visit").otherwise("other").alias("concept"))
    for _ in range(2):  # the second run finds nothing new
        feeds.extract_new(_stream(t), extract, out, ck).awaitTermination()
    return t.spark.read.schema("event_id bigint, concept string").parquet(out)


# -- status of items ------------------------------------------------------------------------------------------------

#: Actions on items for the types of events; four items a user.
_ACTIONS = {"view": "discover", "click": "fetched", "signup": "paywalled", "error": "failed", "purchase": "resolved"}
#: The log in three deliveries: of the last day of each, every seventh event comes with the next one, and every fifth again.
_LOG = f"""
, acts AS (SELECT user_id * 4 + event_id % 4 AS item, event_id, ts, epoch_us(ts) // 1000 AS ms, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ACTIONS.items())} END AS action, least(2, (day(ts) - 1) // 10) AS d, (day(ts) - 1) % 10 = 9 AS last FROM events),
log AS (SELECT *, least(2, d + CASE WHEN last AND event_id % 7 = 0 THEN 1 ELSE 0 END) AS batch FROM acts UNION ALL SELECT *, least(2, d + 1) AS batch FROM acts WHERE last AND event_id % 5 = 0 AND d < 2)"""


def _log(t: Tables):
    action = F.element_at(F.create_map(*(F.lit(x) for kv in _ACTIONS.items() for x in kv)), F.col("event_type"))
    day = F.dayofmonth("ts") - 1
    e = t("events").select((F.col("user_id") * 4 + F.col("event_id") % 4).alias("item"), "event_id", F.col("ts").cast("timestamp").alias("ts"), action.alias("action"), F.least(F.lit(2), F.floor(day / 10)).cast("int").alias("d"), (day % 10 == 9).alias("last"))
    batch = F.least(F.lit(2), F.col("d") + F.when(F.col("last") & (F.col("event_id") % 7 == 0), 1).otherwise(0))
    again = e.filter("last AND event_id % 5 = 0 AND d < 2").withColumn("batch", F.col("d") + 1)
    return e.withColumn("batch", batch).unionByName(again).drop("d", "last")


def _deliveries(t: Tables, log):
    """A stream that brings the rows of batch 0, 1, ... one after the other."""
    path = scratch_dir(t.spark)
    for b in range(3):
        log.filter(F.col("batch") == b).drop("batch").coalesce(1).write.mode("append").parquet(path)
    return t.spark.readStream.schema(log.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(path)


def _next_status(status: str, action: str) -> str:
    cases = " ".join(f"WHEN {status} IS NULL AND {action} = '{a}' THEN '{to}'" if s is None else f"WHEN {status} = '{s}' AND {action} = '{a}' THEN '{to}'" for (s, a), to in machine.TRANSITIONS.items())
    return f"CASE {cases} END"


_DAY = 86_400_000
_REPLAY = _LOG + f""", seq AS (SELECT item, event_id, ms, action, row_number() OVER (PARTITION BY item ORDER BY batch, ms, event_id) AS n FROM log),
steps AS (
  SELECT item, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS ms, NULL::VARCHAR AS action, NULL::VARCHAR AS before, NULL::VARCHAR AS after, NULL::VARCHAR AS verdict, NULL::BIGINT AS deadline, NULL::BIGINT AS last_at, NULL::BIGINT AS last_id, NULL::BIGINT AS lapsed FROM (SELECT DISTINCT item FROM seq)
  UNION ALL
  SELECT item, n, event_id, ms, action, cur, coalesce(nxt, cur), CASE WHEN stale THEN CASE WHEN event_id = last_id THEN 'repeated' ELSE 'late' END WHEN nxt IS NOT NULL THEN 'applied' WHEN cur IS NOT NULL AND action = 'discover' THEN 'duplicate' ELSE 'illegal' END,
    CASE WHEN nxt = 'needs_user' THEN ms + {5 * _DAY} WHEN nxt IS NOT NULL OR lapse THEN NULL ELSE deadline END, CASE WHEN stale THEN last_at ELSE ms END, CASE WHEN stale THEN last_id ELSE event_id END, CASE WHEN lapse THEN deadline END
  FROM (SELECT *, CASE WHEN NOT stale THEN {_next_status("cur", "action")} END AS nxt
    FROM (SELECT *, CASE WHEN lapse THEN 'failed' ELSE after END AS cur
      FROM (SELECT *, NOT stale AND deadline IS NOT NULL AND ms >= deadline AS lapse
        FROM (SELECT l.item, l.n, l.event_id, l.ms, l.action, s.after, s.deadline, s.last_at, s.last_id, s.last_at IS NOT NULL AND (l.ms < s.last_at OR (l.ms = s.last_at AND l.event_id <= s.last_id)) AS stale FROM steps s JOIN seq l ON l.item = s.item AND l.n = s.n + 1))))
),
ends AS (SELECT item, after, deadline FROM steps QUALIFY row_number() OVER (PARTITION BY item ORDER BY n DESC) = 1),
told AS (
  SELECT item, event_id, ms, action, before, after, verdict FROM steps WHERE n > 0
  UNION ALL SELECT item, NULL, lapsed, NULL, 'needs_user', 'failed', 'expired' FROM steps WHERE lapsed IS NOT NULL
  UNION ALL SELECT item, NULL, deadline, NULL, after, 'failed', 'expired' FROM ends WHERE deadline <= (SELECT max(ms) FROM log) - {2 * _DAY})"""


def _told(t: Tables):
    with rocks(t.spark):
        rows = machine.statuses(_deliveries(t, _log(t)), "item", "event_id", "ts", "action", 5 * _DAY, "2 days")
        return _landed(t, rows, "statuses", "append")


@query("sco_08_status_machine", _REPLAY + " SELECT item, event_id, ms, action, before, after, verdict FROM told", recursive=True)
def _(t: Tables):
    """Every event and expiry of the feed's items, with what it did."""
    return _told(t)


@query("sco_08_tickets", _REPLAY + """, o AS (SELECT item, ms FROM told WHERE verdict = 'applied' AND after = 'needs_user'), c AS (SELECT item, ms, after FROM told WHERE before = 'needs_user' AND after <> 'needs_user')
SELECT o.item, o.ms AS opened, min(c.ms) AS closed, arg_min(c.after, c.ms) AS outcome FROM o LEFT JOIN c ON c.item = o.item AND c.ms > o.ms GROUP BY o.item, o.ms""", recursive=True)
def _(t: Tables):
    return machine.tickets(_told(t))
