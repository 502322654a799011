"""Concept taggers and evidence classes as column expressions.

Vocabularies are parameters: a mapping of a concept to its pattern or keywords. Larger ones belong in a DataFrame and
a join; `tag_by_join` does that.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import match_form, text_quality


def tag_by_regex(text: Column, patterns: dict[str, str]) -> Column:
    """The concepts whose patterns occur, in the order of the mapping."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(c)) for c, p in patterns.items())))


def tag_by_keyword(text: Column, keywords: dict[str, tuple[str, ...]]) -> Column:
    """The concepts of which some keyword occurs as part of the lower-cased text."""
    low = F.lower(text)

    def any_of(words: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        return hit

    return F.array_compact(F.array(*(F.when(any_of(ws), F.lit(c)) for c, ws in keywords.items())))


def variants(term: Column) -> Column:
    """The term as it is, with blanks and with hyphens for underscores."""
    return F.array_distinct(F.array(term, F.replace(term, F.lit("_"), F.lit(" ")), F.replace(term, F.lit("_"), F.lit("-"))))


def mentions(text: Column, term: Column) -> Column:
    return F.exists(variants(F.lower(term)), lambda v: F.lower(text).contains(v))


def tag_by_join(texts: DataFrame, key: str, text: str, vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """key, term for each term that occurs in a spelling variant, as whole words: the words of a text, and runs of up
    to as many as the longest term has, are joined with the vocabulary by equality, not by comparing all pairs."""
    terms = vocabulary.select(F.col(term).alias("term"), F.regexp_replace(F.lower(term), "[_-]+", " ").alias("words")).distinct()
    most = terms.agg(F.max(F.size(F.split("words", " ")))).first()[0] or 1
    w = F.split(F.trim(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", " ")), " ")
    each = texts.select(F.col(key).alias("key"), w.alias("w"))
    grams = F.array_distinct(F.flatten(F.array(*(_runs(F.col("w"), n) for n in range(1, most + 1)))))
    return each.select("key", F.explode(grams).alias("words")).join(terms, "words").select(F.col("key").alias(key), "term").distinct()


def _runs(words: Column, n: int) -> Column:
    """All runs of n words, joined by blanks."""
    if n == 1:
        return words
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def evidence_class(surface: Column, context: Column, raw: Column, confidence: Column) -> Column:
    """literal, normalized, inferred, or null to drop: the surface stands in its context and both in the text, as they
    are or in match form; failing that a confidence of 0.9 is enough for inferred."""
    there = (F.coalesce(surface, F.lit("")) != "") & (F.coalesce(context, F.lit("")) != "")
    s, c, r = match_form(surface), match_form(context), match_form(raw)
    literal = there & raw.contains(surface) & raw.contains(context) & context.contains(surface)
    normal = there & r.contains(s) & r.contains(c) & c.contains(s)
    return F.when(literal, "literal").when(normal, "normalized").when(confidence >= 0.9, "inferred")


def evidence_struct(surface: Column, quote: Column, text: Column, confidence: Column, notes: Column) -> Column:
    """The stored evidence: the quote with its offset, found by its first fifty characters, -1 if it is not there."""
    at = F.instr(F.lower(text), F.lower(F.substring(quote, 1, 50))) - 1
    support = F.array(F.struct(quote.alias("quote"), at.alias("start"), F.when(at >= 0, at + F.length(quote)).otherwise(-1).alias("end")))
    return F.struct(surface.alias("surface"), support.alias("support"), quote.alias("context"), F.substring(text, 1, 500).alias("source_text"), F.struct(confidence.alias("confidence"), notes.alias("notes")).alias("quality"))


def extraction_route(text: Column) -> Column:
    """canonical for texts too poor for quotes, else full."""
    q = text_quality(text)
    return F.when((q["score"] < 0.5) | q["label"].isin("no_space", "glued"), "canonical").otherwise("full")


def valid_concepts(records: Column, kinds: tuple[str, ...] = ("method", "problem", "domain", "field", "dataset", "entity", "metric", "theory")) -> Column:
    """records: array of struct(name, type, confidence). Names in snake case, unknown types as entity, confidence
    clamped to 0..1 (0.5 if missing); records without a name of two characters go."""
    from lodestone.functions.text import snake_case

    fixed = F.transform(records, lambda r: F.struct(snake_case(r["name"]).alias("name"), F.when(F.lower(r["type"]).isin(*kinds), F.lower(r["type"])).otherwise("entity").alias("type"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(r["confidence"], F.lit(0.5)))).alias("confidence")))
    return F.filter(fixed, lambda r: F.length(r["name"]) >= 2)


class ConceptExtractor(Protocol):
    """A model that reads a text and names (concept, type, confidence) triples."""

    def extract(self, texts: list[str]) -> list[list[tuple[str, str, float]]]: ...


class KeywordExtractor:
    """The default: keywords by type; confidence grows with the number of mentions, up to 0.95."""

    def __init__(self, vocabulary: dict[str, str]):
        self.vocabulary = vocabulary

    def extract(self, texts: list[str]) -> list[list[tuple[str, str, float]]]:
        out = []
        for t in texts:
            low = (t or "").lower()
            found = [(w, kind, low.count(w.replace("_", " "))) for w, kind in self.vocabulary.items()]
            out.append([(w, kind, round(min(0.95, 0.6 + 0.1 * n), 2)) for w, kind, n in found if n])
        return out


def extract_concepts(df: DataFrame, key: str, text: str, cascade: list[ConceptExtractor]) -> DataFrame:
    """key, concept, concept_type, confidence, model: a text goes to the next model only if those before found nothing.
    model is its place in the cascade."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            left, rows = list(zip(pdf[key], pdf[text])), []
            for i, model in enumerate(cascade):
                got = model.extract([t for _, t in left])
                rows += [(k, *c, i) for (k, _), cs in zip(left, got) for c in cs]
                left = [x for x, cs in zip(left, got) if not cs]
                if not left:
                    break
            yield pd.DataFrame(rows, columns=["key", "concept", "concept_type", "confidence", "model"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInPandas(run, f"key {kind}, concept string, concept_type string, confidence double, model int").withColumnRenamed("key", key)
