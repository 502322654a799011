"""From claims to cited evidence, and the rules that answers are held to."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.chunking import sentences
from lodestone.operators.relational import distinct_on, ranked


class NliScorer(Protocol):
    def scores(self, claims: list[str], sentences: list[str]) -> list[tuple[float, float]]:
        """Entailment and contradiction of each pair."""


class OverlapScorer:
    """Entailment is the share of the claim's words that a sentence has; a negation turns it into contradiction."""

    def scores(self, claims: list[str], sentences: list[str]) -> list[tuple[float, float]]:
        out = []
        for c, s in zip(claims, sentences):
            a, b = set(c.lower().split()), set(s.lower().split())
            share = len(a & b) / max(1, len(a))
            out.append((0.0, share) if ("not" in b) != ("not" in a) else (share, 0.0))
        return out


def candidate_passages(passages: DataFrame, words: list[str], least_quality: float = 0.7, k: int = 20) -> DataFrame:
    """Citable passages with some of the words, once for each first hundred characters, the best first."""
    low = F.lower("text")
    hits = sum((low.contains(w.lower()).cast("int") for w in words), F.lit(0))
    found = passages.filter((F.col("page_num") >= 0) & (F.col("quality") >= least_quality)).withColumn("hits", hits).filter("hits > 0")
    once = distinct_on(found.withColumn("head", F.substring("text", 1, 100)), ["head"], [F.desc("hits"), F.desc("quality"), F.asc("passage_id")])
    return once.drop("head").orderBy(F.desc("hits"), F.desc("quality"), "passage_id").limit(k)


def sentence_rows(passages: DataFrame, key: str = "passage_id", text: str = "text") -> DataFrame:
    """key, sentence_idx, span_start, span_end, sentence; offsets count characters of the passage from 0."""
    s = passages.select(key, F.posexplode(sentences(F.col(text))).alias("sentence_idx", "s"))
    return s.select(key, "sentence_idx", F.col("s.start").alias("span_start"), (F.col("s.start") + F.length("s.text")).alias("span_end"), F.col("s.text").alias("sentence"))


def scored(pairs: DataFrame, model: NliScorer) -> DataFrame:
    """pairs(claim, sentence, ...) with entailment and contradiction; each distinct pair is scored once."""
    once = pairs.select("claim", "sentence").distinct()

    def run(batches):
        for pdf in batches:
            s = model.scores(pdf["claim"].tolist(), pdf["sentence"].tolist())
            yield pd.DataFrame({"claim": pdf["claim"], "sentence": pdf["sentence"], "entailment": [x[0] for x in s], "contradiction": [x[1] for x in s]})

    return pairs.join(once.mapInPandas(run, "claim string, sentence string, entailment double, contradiction double"), ["claim", "sentence"])


def gated(spans: DataFrame) -> DataFrame:
    """Fails closed: no contradiction above 0.7, entailment of 0.5 at least, a page that can be cited."""
    return spans.filter("contradiction <= 0.7 AND entailment >= 0.5 AND page_num >= 0")


def support_type(entailment: Column) -> Column:
    return F.when(entailment >= 0.8, "strong").when(entailment >= 0.6, "partial").otherwise("weak")


def new_spans(stored: DataFrame, found: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Spans that are not stored yet, numbered after the largest stored number, in the order of their keys."""
    fresh = found.join(stored.select(*keys), keys, "left_anti")
    last = stored.agg(F.coalesce(F.max(number), F.lit(0)).alias("__last"))
    return ranked(fresh, [F.asc(k) for k in keys], "__r").join(F.broadcast(last)).withColumn(number, F.col("__last") + F.col("__r")).drop("__last", "__r")


def answer_status(claims: DataFrame, links: DataFrame, key: str = "claim_id") -> DataFrame:
    """Each claim as VERIFIED with its number of links and best entailment, or UNVERIFIED."""
    g = links.groupBy(key).agg(F.count("*").alias("n_links"), F.max("entailment").alias("best"))
    return claims.join(g, key, "left").select(key, F.coalesce("n_links", F.lit(0)).alias("n_links"), "best", F.when(F.col("n_links") > 0, "VERIFIED").otherwise("UNVERIFIED").alias("status"))


def grant_grade(support: Column, confidence: Column, quality: Column) -> Column:
    return (support == "literal") & (confidence >= 0.8) & (quality >= 0.5)


def tautologies(inputs: Column, outputs: Column, derived: Column) -> Column:
    """The rules that a measurement breaks: outputs among inputs, outputs derived from inputs only, nothing new."""
    return F.array_compact(F.array(F.when(F.arrays_overlap(inputs, outputs), "output_is_input"), F.when((F.size(derived) > 0) & (F.size(F.array_except(derived, inputs)) == 0), "derived_from_inputs"), F.when(F.size(F.array_except(outputs, inputs)) == 0, "nothing_new")))


def answer_score(critical: Column, warnings: Column, infos: Column, cited: Column) -> Column:
    """100 less 10, 5 and 2 for each finding, and 20 if nothing is cited; from 0."""
    return F.greatest(F.lit(0), 100 - 10 * critical - 5 * warnings - 2 * infos - F.when(cited, 0).otherwise(20))


def citation_audit(citations: DataFrame) -> DataFrame:
    """citations(id, doi, title, verified) -> state, n, ids."""
    state = F.when(F.col("doi").isNull() & F.col("title").isNull(), "unusable").when(F.col("verified"), "verified").when(F.col("doi").isNull(), "no_doi").otherwise("unverified")
    return citations.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
