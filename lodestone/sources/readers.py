"""Readers: tables, files of code, notebooks, subtitles, golden files, and feeds of items.

Files are read by Spark, so any path that it knows works. Feeds come through the Python data source interface, from
files of recorded responses; parsing is apart from fetching, and there is no network here.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Extensions of source files by language.
LANGUAGES = {"py": "python", "sql": "sql", "r": "r", "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rs": "rust", "c": "c", "cpp": "cpp", "md": "markdown", "sh": "shell", "ipynb": "notebook"}
SKIPPED = r"(^|/)(\.git|node_modules|__pycache__|build|dist|vendor|\.venv|site-packages)(/|$)"


def table(spark: SparkSession, path: str, columns: list[str] | None = None, condition: Column | None = None) -> DataFrame:
    """Parquet; the columns and the condition reach the scan."""
    df = spark.read.parquet(path)
    df = df if condition is None else df.filter(condition)
    return df.select(*columns) if columns else df


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def golden(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of queries: id, query, expected_terms, min_relevant_rank."""
    return spark.read.schema("id string, query string, expected_terms array<string>, min_relevant_rank int").json(path, multiLine=True)


def repository(spark: SparkSession, root: str, most_bytes: int = 500_000, least_chars: int = 50) -> DataFrame:
    """path, language, size, text of the source files below a folder, without generated and vendored ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    language = F.coalesce(*(F.when(ext == e, n) for e, n in LANGUAGES.items()))
    kept = files.filter((F.col("length") <= most_bytes) & ~F.col("path").rlike(SKIPPED) & ~F.col("path").rlike(r"(\.min\.|_pb2\.|\.generated\.|\.lock$)"))
    out = kept.select("path", language.alias("language"), F.col("length").alias("size"), F.col("content").cast("string").alias("text"))
    return out.filter(F.col("language").isNotNull() & (F.length(F.trim("text")) >= least_chars))


def key_files(files: DataFrame, path: str, patterns: list[tuple[str, int]], k: int) -> DataFrame:
    """The k files that match the best pattern (the smallest number), each path once."""
    best = F.array_min(F.array_compact(F.array(*(F.when(F.col(path).rlike(p), n) for p, n in patterns))))
    return files.withColumn("priority", best).filter(F.col("priority").isNotNull()).groupBy(path).agg(F.min("priority").alias("priority")).orderBy("priority", path).limit(k)


def notebook_cells(books: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, kind, source of the code and markdown cells that are not blank."""
    shape = "cells array<struct<cell_type:string,source:variant>>"
    cells = books.select(key, F.posexplode(F.from_json(F.col(text), shape)["cells"]).alias("n", "c"))
    lines = F.try_variant_get("c.source", "$", "array<string>")
    source = F.coalesce(F.array_join(lines, ""), F.try_variant_get("c.source", "$", "string"))
    out = cells.select(key, "n", F.col("c.cell_type").alias("kind"), source.alias("source"))
    return out.filter(F.col("kind").isin("code", "markdown") & (F.trim("source") != ""))


def subtitle_lines(files: DataFrame, key: str, text: str) -> DataFrame:
    """key, n, line of WebVTT text: no headers, times, numbers or tags, and no line that repeats the one before it."""
    lines = files.select(key, F.posexplode(F.split(text, "\r?\n")).alias("n", "raw"))
    line = F.trim(F.regexp_replace("raw", "<[^>]*>", ""))
    said = lines.select(key, "n", line.alias("line")).filter((F.col("line") != "") & ~F.col("line").rlike(r"^(WEBVTT|NOTE|Kind:|Language:|[0-9]+$)|-->"))
    before = F.lag("line").over(Window.partitionBy(key).orderBy("n"))
    return said.withColumn("b", before).filter(~F.col("line").eqNullSafe(F.col("b"))).drop("b")


ITEM_SCHEMA = "source string, external_id string, title string, abstract string, authors array<string>, published string, url string, doi string, meta map<string,string>"


def atom_items(source: str, body: str) -> list[tuple]:
    """Items of an Atom feed."""
    ns = {"a": "http://www.w3.org/2005/Atom"}
    out = []
    for e in ET.fromstring(body).findall("a:entry", ns):
        get = lambda tag, e=e: " ".join((e.findtext(f"a:{tag}", "", ns) or "").split()) or None
        out.append((source, get("id"), get("title"), get("summary"), [" ".join(a.text.split()) for a in e.findall("a:author/a:name", ns) if a.text], get("published"), next((x.get("href") for x in e.findall("a:link", ns)), None), None, {}))
    return out


#: For each kind of recorded REST response: where its items are, and the paths of their fields.
REST_FIELDS = {
    "works": {"items": "results", "external_id": "id", "title": "title", "published": "publication_date", "url": "doi", "doi": "doi", "authors": "authorships[].author.display_name"},
    "preprints": {"items": "collection", "external_id": "doi", "title": "title", "abstract": "abstract", "published": "date", "doi": "doi", "authors": "authors;"},
    "papers": {"items": "data", "external_id": "paperId", "title": "title", "abstract": "abstract", "published": "publicationDate", "url": "url", "authors": "authors[].name"},
    "repositories": {"items": "items", "external_id": "full_name", "title": "name", "abstract": "description", "published": "pushed_at", "url": "html_url", "authors": "owner.login"},
    "articles": {"items": "articles", "external_id": "url", "title": "title", "published": "seendate", "url": "url"},
}


def _at(item: dict, path: str):
    if path.endswith(";"):
        return [a.strip() for a in str(item.get(path[:-1]) or "").split(";") if a.strip()]
    values = [item]
    for step in path.split("."):
        many, step = step.endswith("[]"), step.removesuffix("[]")
        values = [v.get(step) for v in values if isinstance(v, dict)]
        if many:
            values = [x for v in values if isinstance(v, list) for x in v]
    values = [v for v in values if v is not None]
    return values if "[]" in path else (values[0] if values else None)


def rest_items(source: str, kind: str, body: str) -> list[tuple]:
    """Items of a recorded REST response; what is not named goes to meta if it is a number or a text."""
    fields = REST_FIELDS[kind]
    out = []
    for item in json.loads(body).get(fields["items"]) or []:
        get = lambda f, item=item: _at(item, fields[f]) if f in fields else None
        text = lambda f, get=get: None if get(f) is None else str(get(f))
        authors = get("authors")
        meta = {k: str(v) for k, v in item.items() if isinstance(v, (int, float, str)) and k not in ("title", "abstract")}
        out.append((source, text("external_id"), text("title"), text("abstract"), [authors] if isinstance(authors, str) else list(authors or []), text("published"), text("url"), text("doi"), meta))
    return out


class RecordedFeed(DataSource):
    """format("recorded_feed"): items of responses given as JSON lines of source, kind and body in option "responses".

    kind is "atom" or a key of REST_FIELDS. Each response is a partition."""

    @classmethod
    def name(cls) -> str:
        return "recorded_feed"

    def schema(self) -> str:
        return ITEM_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _FeedReader([json.loads(x) for x in self.options["responses"].splitlines() if x.strip()])


class _FeedReader(DataSourceReader):
    def __init__(self, responses: list[dict]):
        self.responses = responses

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(self.responses))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        r = self.responses[partition.value]
        yield from atom_items(r["source"], r["body"]) if r["kind"] == "atom" else rest_items(r["source"], r["kind"], r["body"])


def page_sections(text: Column, page: Column, pages: Column) -> Column:
    """The section of a page by its head, and the last tenth of a document as references."""
    head = F.lower(F.substring(text, 1, 200))
    return F.when((page == 1) | head.contains("abstract"), "abstract").when(head.contains("method"), "methods").when(head.contains("result"), "results").when(head.contains("discussion"), "discussion").when(head.contains("references") | (page > 0.9 * pages), "references").otherwise("body")


def section_quality(section: Column) -> Column:
    return F.when(section.isin("abstract", "methods", "results"), 1.0).when(section == "discussion", 0.8).when(section == "body", 0.7).when(section == "references", 0.3).otherwise(0.5)
