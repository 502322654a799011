"""Many questions at once, in one plan over a stored text index: fused and reranked retrieval, evidence chains, claims held
against what is found for them, bridges between two concepts, and readiness by real searches.

Questions are rows, so a batch of any size is a few joins over the postings of its terms. Texts are read only where a result
needs them, of the documents that were found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.quality import grade
from lodestone.operators.relational import top_k
from lodestone.operators.search import Reranker, stem, terms
from lodestone.operators.text_index import TextIndex

#: Digits of scores by which results are put in order, so that the order of a sum doesn't decide between equals.
DIGITS = 9


# -- retrieval ------------------------------------------------------------------------------------------------------


def fused_batch(lists: list[DataFrame], qkey: str, key: str, n: int, k: int = 60) -> DataFrame:
    """qkey, key, score, first_list, rank: the n best of each question by the sum over ranked lists (qkey, key, rank) of
    1 / (k + rank). Ties go by the first list that had an item, then by key. A question without any hit has no row."""
    parts = [d.select(qkey, key, (1.0 / (k + F.col("rank"))).alias("part"), F.lit(i).alias("list")) for i, d in enumerate(lists)]
    fused = reduce(lambda a, b: a.unionByName(b), parts).groupBy(qkey, key).agg(F.round(F.sum("part"), 12).alias("score"), F.min("list").alias("first_list"))
    return top_k(fused, [qkey], [F.desc("score"), F.asc("first_list"), F.asc(key)], n, "rank")


def reranked_batch(found: DataFrame, qkey: str, key: str, questions: DataFrame, question: str, texts: DataFrame, text: str, model: Reranker, n: int, chars: int = 512) -> DataFrame:
    """qkey, key, score, rerank_score, rank: the n best of each question of found(qkey, key, score) by the model, then by
    score, then by key. texts(key, text) is read for the keys that were found; the model sees its first `chars` characters,
    which is its input size, and a null text as an empty one."""
    kinds = dict(found.dtypes)
    rows = texts.select(key, F.substring(F.coalesce(text, F.lit("")), 1, chars).alias("__t")).join(found.select(qkey, key, "score"), key)
    rows = rows.join(questions.select(qkey, F.coalesce(question, F.lit("")).alias("__q")), qkey)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = pd.Series(0.0, index=pdf.index)
            for asked, own in pdf.groupby("__q", sort=False):
                s.loc[own.index] = model.scores(asked, own["__t"].tolist())
            yield pdf[[qkey, key, "score"]].assign(rerank_score=s)

    judged = rows.select(qkey, key, "score", "__q", "__t").mapInPandas(run, f"{qkey} {kinds[qkey]}, {key} {kinds[key]}, score double, rerank_score double")
    return top_k(judged, [qkey], [F.desc("rerank_score"), F.desc("score"), F.asc(key)], n, "rank")


def bridged(pairs: DataFrame, qkey: str, a: str, b: str, index: TextIndex, k: int = 20) -> DataFrame:
    """qkey, key, score, rank: of the k best documents for the words of both concepts (columns a and b), those with a term of
    each. Read from postings. A concept without terms is bridged with nothing."""
    asked = pairs.select(qkey, terms(F.coalesce(a, F.lit(""))).alias("ta"), terms(F.coalesce(b, F.lit(""))).alias("tb"))
    found = index.search(asked.select(qkey, F.concat("ta", "tb").alias("t")), qkey, "t", k, DIGITS)
    return _with_both(found, asked, qkey, index)


def _with_both(found: DataFrame, asked: DataFrame, qkey: str, index: TextIndex) -> DataFrame:
    """The rows of found(qkey, key) whose document has a term of ta and one of tb of asked(qkey, ta, tb)."""
    sides = asked.select(qkey, F.posexplode(F.array("ta", "tb")).alias("side", "t")).select(qkey, "side", F.explode(F.array_distinct("t")).alias("term"))
    has = found.select(qkey, "key").join(sides, qkey).join(index.postings_of(sides.select("term")).select("term", "key"), ["term", "key"])
    both = has.groupBy(qkey, "key").agg(F.count_distinct("side").alias("n")).filter("n = 2").select(qkey, "key")
    return found.join(both, [qkey, "key"], "left_semi")


# -- evidence chains ------------------------------------------------------------------------------------------------

#: The four searches of a chain, and what each asks for.
STEPS = (
    ("source_analysis", "{source} methods applications"),
    ("gap_analysis", "{area} challenges {target} problems"),
    ("transfer_analysis", "{source} applied to {area}"),
    ("risk_analysis", "{source} limitations failures"),
)


def _filled(template: str) -> Column:
    out = F.lit(template)
    for name in ("source", "area", "target"):
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(name, F.lit("")))
    return out


def chains(seeds: DataFrame, key: str, index: TextIndex, k: int = 10, shown: int = 3) -> DataFrame:
    """A hypothesis for each row of seeds(key, source, area, target): that the methods of source improve target in area, with the
    four searches that speak for it.

    key, steps (step, question, found, confidence and the `shown` best documents with their scores), bridges (hits of the
    third search), feasibility, testability and confidence, the mean of the steps'. A step's confidence is a tenth for each
    hit, 0.9 at most, and 0.1 without any. Null words are empty; seeds that repeat a key are one question each by key and
    words, so keys should be unique."""
    step = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(name).alias("step"), _filled(t).alias("question")) for i, (name, t) in enumerate(STEPS)))
    asked = seeds.select(key, F.explode(step).alias("s")).select(F.struct(F.col(key).alias("key"), F.col("s.at").alias("at")).alias("q"), "s.step", "s.question")
    hits = index.search(asked.select("q", terms(F.col("question")).alias("t")), "q", "t", k, DIGITS)
    told = hits.groupBy("q").agg(F.count("*").alias("found"), F.array_sort(F.collect_list(F.struct("rank", F.col("key").alias("doc"), "score"))).alias("best"))  # at most k
    every = asked.join(told, "q", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    sure = F.when(F.col("found") > 0, F.least(F.lit(0.9), F.col("found") / 10.0)).otherwise(0.1)
    best = F.coalesce(F.slice("best", 1, shown), F.array().cast(told.schema["best"].dataType))
    entry = F.struct(F.col("q.at").alias("at"), "step", "question", "found", sure.alias("confidence"), best.alias("evidence"))
    chain = every.groupBy(F.col("q.key").alias(key)).agg(F.array_sort(F.collect_list(entry)).alias("steps"))  # four each
    bridges = F.element_at("steps", 3)["found"]
    mean = F.aggregate("steps", F.lit(0.0), lambda s, x: s + x["confidence"]) / len(STEPS)
    feasible = F.when(F.col("bridges") < 5, "high").when(F.col("bridges") < 15, "medium").otherwise("well-established")
    out = chain.select(key, F.transform("steps", lambda x: x.dropFields("at")).alias("steps"), bridges.alias("bridges"), F.round(mean, 3).alias("confidence"))
    return out.select(key, "steps", "bridges", feasible.alias("feasibility"), F.when(F.col("bridges") < 5, "high").otherwise("medium").alias("testability"), "confidence")


# -- claims ---------------------------------------------------------------------------------------------------------


def negated_terms(texts: DataFrame, key: str, text: str, negations: list[str], reach: int | None) -> DataFrame:
    """key, negated: the distinct terms of each text that stand at most `reach` words after a word of negations, or, with
    reach None, all its terms if it has such a word anywhere. Every word counts as a place, those that a search leaves out too.
    A null text has none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    cut = texts.select(key, F.explode(F.array(words)).alias("w"))  # a row of its own, so that lambdas don't cut the text again
    if reach is None:
        near = F.when(F.exists("w", lambda x: x.isin(*negations)), F.col("w")).otherwise(F.array().cast("array<string>"))
    else:
        noes = F.array_compact(F.transform("w", lambda x, i: F.when(x.isin(*negations), i)))
        places = F.array_distinct(F.flatten(F.transform(noes, lambda i: F.sequence(i + 1, i + reach))))
        near = F.array_compact(F.transform(places, lambda i: F.get("w", i)))
    return cut.select(key, F.array_distinct(F.transform(F.array_distinct(near), lambda x: stem(x))).alias("negated"))


def validated(claims: DataFrame, key: str, claim: str, index: TextIndex, texts: DataFrame, doc: str, text: str, negations: list[str], reach: int | None = 3, k: int = 20) -> DataFrame:
    """Each claim held against the k best documents for its terms. A document contradicts a claim if it negates one of its
    terms, as negated_terms() says; with reach None, if it has a word of negation anywhere.

    key, found, support and contra (sums of scores), confidence (support's share, 0.5 if nothing is found), status (supported
    above 0.6, needs_investigation above 0.4, else potentially_contradicted), evidence (rank, doc, score, contradicts) and gaps.
    A document is cut into words once, however many claims find it. A null claim finds nothing."""
    asked = claims.select(key, F.array_distinct(terms(F.coalesce(claim, F.lit("")))).alias("__t"))
    hits = index.search(asked, key, "__t", k, DIGITS)
    wanted = hits.select(F.col("key").alias("__d")).distinct()
    told = negated_terms(texts.join(wanted, F.col(doc) == F.col("__d"), "left_semi"), doc, text, negations, reach).withColumnRenamed(doc, "key")
    each = hits.join(told, "key", "left").join(asked, key).withColumn("contradicts", F.coalesce(F.arrays_overlap("negated", "__t"), F.lit(False)))
    part = lambda c: F.round(F.sum(F.when(c, F.col("score")).otherwise(0.0)), 6)
    found = each.groupBy(key).agg(
        F.count("*").alias("found"), part(~F.col("contradicts")).alias("support"), part(F.col("contradicts")).alias("contra"),
        F.array_sort(F.collect_list(F.struct("rank", F.col("key").alias("doc"), "score", "contradicts"))).alias("evidence"))  # at most k
    out = asked.select(key).join(found, key, "left").fillna({"found": 0, "support": 0.0, "contra": 0.0})
    out = out.withColumn("confidence", F.coalesce(F.try_divide("support", F.col("support") + F.col("contra")), F.lit(0.5)))
    status = F.when(F.col("confidence") > 0.6, "supported").when(F.col("confidence") > 0.4, "needs_investigation").otherwise("potentially_contradicted")
    gaps = F.array_compact(F.array(F.when(F.col("found") < 5, "little_prior_work"), F.when(F.col("contra") > F.col("support"), "more_against_than_for")))
    evidence = F.coalesce("evidence", F.array().cast(found.schema["evidence"].dataType))
    return out.select(key, "found", "support", "contra", F.round("confidence", 6).alias("confidence"), status.alias("status"), evidence.alias("evidence"), gaps.alias("gaps"))


# -- readiness ------------------------------------------------------------------------------------------------------

#: The hits that a question of each kind needs.
LEAST = {"domain": 5, "oblique": 3, "bridge": 2}


def oblique_terms(problem: Column, patterns: dict[str, tuple[str, ...]], most: int = 3) -> Column:
    """The first `most` terms that stand, in other fields, for the words of a problem, in the patterns' order."""
    low = F.lower(problem)
    some = [F.when(low.contains(word), F.array(*map(F.lit, ts))).otherwise(F.array().cast("array<string>")) for word, ts in patterns.items()]
    return F.slice(F.array_distinct(F.concat(*some)), 1, most)


def readiness_hits(questions: DataFrame, key: str, patterns: dict[str, tuple[str, ...]], index: TextIndex, n: int = 10, each: int = 5) -> DataFrame:
    """kind, key, hits: the searches of a readiness check, all in one plan. questions(key, kind, a, b): a domain question asks
    for the terms of a (n documents at most); an oblique one for what stands in other fields for words of a, one search
    for each, `each` documents at most, of which the distinct ones count; a bridge for documents among the n best that have
    a term of a and one of b. Questions of other kinds, and those of no kind, are left."""
    a, b = (terms(F.coalesce(c, F.lit(""))) for c in ("a", "b"))
    whole = questions.filter("kind IN ('domain', 'bridge')").select("kind", F.col(key).alias("key"), F.lit(0).alias("part"), a.alias("ta"), F.when(F.col("kind") == "bridge", b).otherwise(F.array().cast("array<string>")).alias("tb"))
    parts = questions.filter("kind = 'oblique'").select("kind", F.col(key).alias("key"), F.posexplode(oblique_terms(F.coalesce("a", F.lit("")), patterns)).alias("part", "w"))
    parts = parts.select("kind", "key", "part", terms(F.col("w")).alias("ta"), F.array().cast("array<string>").alias("tb"))
    asked = whole.unionByName(parts).select(F.struct("kind", "key", "part").alias("q"), "ta", "tb")
    found = index.search(asked.select("q", F.concat("ta", "tb").alias("t")), "q", "t", max(n, each), DIGITS)
    plain = found.filter(F.col("rank") <= F.when(F.col("q.kind") == "oblique", each).otherwise(n))
    both = _with_both(plain.filter("q.kind = 'bridge'"), asked.filter("q.kind = 'bridge'"), "q", index)
    hits = plain.filter("q.kind <> 'bridge'").unionByName(both.select(*plain.columns))
    counted = hits.groupBy("q.kind", F.col("q.key").alias(key)).agg(F.count_distinct(F.col("key")).alias("hits"))
    known = questions.filter(F.col("kind").isin(*LEAST)).select("kind", key).distinct()
    return known.join(counted, ["kind", key], "left").select("kind", key, F.coalesce("hits", F.lit(0)).alias("hits"))


def readiness(hits: DataFrame) -> DataFrame:
    """kind, questions, passed, share, grade (A from 0.9, B from 0.8, C from 0.7, else F) of readiness_hits()."""
    enough = reduce(lambda c, k: c.when(F.col("kind") == k, F.col("hits") >= LEAST[k]), LEAST, F)
    g = hits.groupBy("kind").agg(F.count("*").alias("questions"), F.count_if(enough).alias("passed"))
    g = g.withColumn("share", F.col("passed") / F.col("questions"))
    return g.select("kind", "questions", "passed", F.round("share", 6).alias("share"), grade(F.col("share")).alias("grade"))
