"""Documents of pages: readers tried in turn for each file, sections of pages, and passages with offsets on their page.

A reader of some format is a small class; those here read text with page breaks. One for PDF or for scanned pages has the
same shape and goes before or after them. Files are read and cut in tasks, one at a time.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.chunking import page_spans
from lodestone.functions.identity import passage_id
from lodestone.sources.readers import section_quality

#: Words of which one, anywhere on a page, names its section; the first that fits counts.
SECTION_WORDS = (("methods", ("methods", "materials", "experimental")), ("results", ("results", "findings")), ("discussion", ("discussion", "conclusion")), ("references", ("references", "bibliography")))


class PageReader(Protocol):
    name: str

    def pages(self, content: bytes) -> list[str]:
        """The text of each page; raises for what it can't read."""


class TextPages:
    """Text in one encoding, pages apart by form feeds. UTF-16 must have its mark, without which any bytes would do."""

    def __init__(self, encoding: str = "utf-8"):
        self.name, self.encoding = f"text_{encoding}", encoding

    def pages(self, content: bytes) -> list[str]:
        if self.encoding == "utf-16" and content[:2] not in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
            raise ValueError("no byte order mark")
        return content.decode(self.encoding).split("\f")


class RecoveredPages:
    """The last resort: what can be read as UTF-8, and a mark for what can't."""

    name = "recovered"

    def pages(self, content: bytes) -> list[str]:
        return content.decode("utf-8", "replace").split("\f")


DEFAULT = (TextPages("utf-8"), TextPages("utf-16"), RecoveredPages())


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_pages(files: DataFrame, key: str, content: str, readers: tuple[PageReader, ...] = DEFAULT) -> DataFrame:
    """key, page (from 1), pages, text, reader, failed: each file by the first reader that neither raises nor finds only blank
    pages; failed says what the readers before it said. A file that none can read, or a null one, is one row without page,
    text and reader, so no file is lost silently. Repeated keys are files of their own."""

    def rows(k, body) -> pd.DataFrame:
        failed = []
        if body is None:
            failed.append("no content")
        else:
            for r in readers:
                try:
                    got = r.pages(bytes(body))
                except Exception as e:  # a reader may raise anything for a broken file; the next one is tried
                    failed.append(f"{r.name}: {type(e).__name__}")
                    continue
                if any(p.strip() for p in got):
                    return pd.DataFrame({key: k, "page": range(1, len(got) + 1), "pages": len(got), "text": got, "reader": r.name, "failed": [list(failed)] * len(got)})
                failed.append(f"{r.name}: blank")
        return pd.DataFrame({key: [k], "page": [None], "pages": [0], "text": [None], "reader": [None], "failed": [failed]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, body in zip(pdf[key], pdf[content]):
                yield rows(k, body)

    kind = dict(files.dtypes)[key]
    return files.select(key, content).mapInPandas(run, f"{key} {kind}, page int, pages int, text string, reader string, failed array<string>")


def page_section(text: Column, page: Column, pages: Column) -> Column:
    """abstract for a first page or one that begins with that word (200 characters), else by SECTION_WORDS, else references
    for the last tenth of a document, else body."""
    low = F.lower(text)
    out = F.when((page == 1) | F.substring(low, 1, 200).contains("abstract"), "abstract")
    for section, words in SECTION_WORDS:
        out = out.when(low.rlike("|".join(words)), section)
    return out.when(page > 0.9 * pages, "references").otherwise("body")


def with_sections(pages: DataFrame) -> DataFrame:
    """Pages that were read, with section and the quality that goes with it."""
    read = pages.filter("page IS NOT NULL").withColumn("section", page_section(F.col("text"), F.col("page"), F.col("pages")))
    return read.withColumn("quality", section_quality(F.col("section")))


def page_passages(pages: DataFrame, key: str, size: int = 1000, overlap: int = 100) -> DataFrame:
    """passage_id, key, page, span_start, span_end, section, quality, reader, text: the passages of with_sections(). Offsets are
    of the page, in characters from 0, and the id is made of them, so a second reading gives the same. Blank pieces go."""
    kept = {n: t for n, t in dict(pages.dtypes).items() if n in (key, "page", "section", "quality", "reader")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                spans = page_spans(row["text"], size, overlap)
                if spans:
                    yield pd.DataFrame({**{n: row[n] for n in kept}, "span_start": [a for a, _ in spans], "span_end": [b for _, b in spans], "text": [row["text"][a:b] for a, b in spans]})

    shape = ", ".join(f"{n} {t}" for n, t in kept.items()) + ", span_start int, span_end int, text string"
    cut = pages.select(*kept, "text").mapInPandas(run, shape)
    return cut.select(passage_id(F.col(key).cast("string"), F.col("page"), F.col("span_start"), F.col("span_end")).alias("passage_id"), key, "page", "span_start", "span_end", "section", "quality", "reader", "text")
