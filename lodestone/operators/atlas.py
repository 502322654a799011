"""Corpus analytics: field labels, field overlap by mutual information, bridges, rare pairs and hypotheses.

Input is the table of a corpus's passage concepts: passage_id, concept, concept_type, field, confidence.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.graph import betweenness, co_occurrence
from lodestone.operators.scratch import materialise

#: Fields whose pairs are kept as bits: 2,016 pairs in 32 numbers.
BIT_FIELDS = 64


def confident(concepts: DataFrame, version: str | None, least: float = 0.7) -> DataFrame:
    out = concepts.filter(F.col("confidence") >= least)
    return out if version is None else out.filter(F.col("version") == version)


def field_labels(concepts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """passage_id, label, how: the names of concepts of these kinds, else the surest concept of the passage."""
    named = concepts.filter(F.col("concept_type").isin(*kinds)).select("passage_id", F.col("concept").alias("label")).distinct()
    rest = concepts.join(named.select("passage_id").distinct(), "passage_id", "left_anti")
    guessed = rest.groupBy("passage_id").agg(F.max_by("concept", F.struct("confidence", "concept")).alias("label"))
    return named.withColumn("how", F.lit("explicit")).unionByName(guessed.withColumn("how", F.lit("inferred")))


def passage_summary(concepts: DataFrame) -> DataFrame:
    """passage_id, concepts, confidences (in the order of name), fields, mean confidence."""
    g = concepts.groupBy("passage_id").agg(F.array_sort(F.collect_list(F.struct("concept", "confidence"))).alias("x"), F.array_sort(F.collect_set("field")).alias("fields"), F.avg("confidence").alias("mean"))
    return g.select("passage_id", F.col("x")["concept"].alias("concepts"), F.col("x")["confidence"].alias("confidences"), "fields", "mean")


def top_fields(fields: DataFrame, n: int) -> DataFrame:
    """field, n of the most frequent fields; fields has a row for each passage and field."""
    return fields.groupBy("field").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "field").limit(n)


def field_overlap(concepts: DataFrame, n_fields: int = 50, least: int = 5, smooth: float = 0.5) -> DataFrame:
    """Pointwise mutual information of fields on the same passage, smoothed, with what it comes from.

    The total is the number of passages plus smooth for each of the top fields."""
    fields = concepts.select("passage_id", "field").distinct()
    top = top_fields(fields, n_fields)
    total = fields.agg(F.count_distinct("passage_id").alias("passages")).crossJoin(top.agg(F.count("*").alias("k"))).select((F.col("passages") + smooth * F.col("k")).alias("total"))
    pairs = co_occurrence(fields.join(F.broadcast(top.select("field")), "field", "left_semi"), "passage_id", "field", least)
    a, b = top.select(F.col("field").alias("a"), F.col("n").alias("count_a")), top.select(F.col("field").alias("b"), F.col("n").alias("count_b"))
    j = pairs.join(F.broadcast(a), "a").join(F.broadcast(b), "b").join(F.broadcast(total))
    p = lambda c: (F.col(c) + smooth) / F.col("total")
    lift = p("weight") / (p("count_a") * p("count_b"))
    pmi = F.log2(lift)
    npmi = F.when((p("weight") > 0) & (p("weight") < 1), pmi / -F.log2(p("weight"))).otherwise(0.0)
    return j.select(F.col("a").alias("field_a"), F.col("b").alias("field_b"), F.col("weight").alias("count"), "count_a", "count_b", pmi.alias("pmi"), npmi.alias("npmi"), lift.alias("lift"))


def bridge_graph(concepts: DataFrame, least: float = 2.0, missing: float = 0.8) -> DataFrame:
    """field, concept, weight: summed confidences (a missing or zero one counts as `missing`), of weight >= least."""
    sure = F.coalesce(F.nullif(F.col("confidence"), F.lit(0.0)), F.lit(missing))
    return concepts.groupBy("field", "concept").agg(F.sum(sure).alias("weight"), F.count("*").alias("occurrences")).filter(F.col("weight") >= least)


def bridge_concepts(graph: DataFrame, pivots: int = 500, least_degree: int = 2) -> DataFrame:
    """Concepts by betweenness in the two-sided graph of fields and concepts."""
    side = lambda s, c: F.concat(F.lit(s), c)
    edges = graph.select(side("f:", F.col("field")).alias("src"), side("c:", F.col("concept")).alias("dst"))
    b = betweenness(edges, pivots).filter(F.col("node").startswith("c:")).select(F.expr("substr(node, 3)").alias("concept"), "betweenness")
    d = graph.groupBy("concept").agg(F.count("*").alias("degree"), F.array_sort(F.collect_set("field")).alias("fields"), F.sum("occurrences").alias("occurrences")).filter(F.col("degree") >= least_degree)
    return d.join(b, "concept")


def rare_pairs(concepts: DataFrame, least: int = 3, least_field_pairs: int = 2) -> DataFrame:
    """Pairs of concepts that few passages, but several pairs of fields, have: score is mean confidence times
    ln(1 + field pairs) / (1 + ln count). Only passages of two fields and two concepts count."""
    known = materialise(concepts.select("concept", "field").distinct())
    # numbers in the order of names, so pairs and counts need no strings
    numbers = lambda c: materialise(known.select(c).filter(F.col(c).isNotNull()).distinct().orderBy(c).select(c, F.monotonically_increasing_id().alias("i")))
    names, at_hand = numbers("concept"), concepts.repartition("passage_id")
    one = at_hand.select("passage_id", "concept", "confidence").join(names, "concept").groupBy("passage_id", "i").agg(F.max("confidence").alias("confidence"))
    g = one.groupBy("passage_id").agg(F.array_sort(F.collect_list(F.struct("i", "confidence"))).alias("x")).filter("size(x) > 1")
    fields = [r["field"] for r in known.select("field").filter("field IS NOT NULL").distinct().orderBy("field").limit(BIT_FIELDS + 1).collect()]
    few = len(fields) <= BIT_FIELDS
    by_field = known.sparkSession.createDataFrame(list(zip(fields, range(len(fields)))), "field string, i bigint") if few else numbers("field")
    f = at_hand.select("passage_id", "field").join(by_field, "field", "left").groupBy("passage_id")
    f = f.agg(F.array_sort(F.collect_set("i")).alias("fields"), F.max(F.col("i").isNull().cast("int")).alias("unnamed")).filter("size(fields) + unnamed > 1")
    if few:  # pairs of fields are bits of a few numbers, so a pair of concepts is one row of a passage
        f = f.withColumn("met", F.expr("flatten(transform(fields, (y, at) -> transform(slice(fields, 1, at), x -> cast(y * (y - 1) / 2 + x AS int))))"))
        bits = [f"w{k}" for k in range(-(-len(fields) * (len(fields) - 1) // 2 // 63))]
        carried = [F.expr(f"aggregate(filter(met, c -> c div 63 = {k}), 0L, (w, c) -> w | shiftleft(1L, c % 63))").alias(w) for k, w in enumerate(bits)]
    else:
        met = F.flatten(F.transform("fields", lambda fa, at: F.transform(F.slice("fields", at + 2, F.size("fields")), lambda fb: F.struct(fa.alias("fa"), fb.alias("fb")))))
        itself = F.array(F.struct(F.lit(None).cast("bigint").alias("fa"), F.lit(None).cast("bigint").alias("fb")))  # counts the passage
        bits, carried = ["met"], [F.concat(itself, met).alias("met")]
    s = g.join(f, "passage_id").select("x", *carried)
    each = s.select(*bits, F.posexplode("x").alias("at", "p"), "x").select(*bits, "p", F.explode(F.slice("x", F.col("at") + 2, F.size("x"))).alias("q"))
    pairs = each.select(F.col("p.i").alias("a"), F.col("q.i").alias("b"), ((F.col("p.confidence") + F.col("q.confidence")) / 2).alias("c"), *bits)
    if few:
        j = pairs.groupBy("a", "b").agg(F.count("*").alias("count"), F.avg("c").alias("avg_confidence"), *(F.bit_or(w).alias(w) for w in bits))
        j = j.withColumn("n_field_pairs", sum((F.bit_count(w).cast("bigint") for w in bits), F.lit(0).cast("bigint")))
    else:
        t = pairs.select("a", "b", "c", F.explode("met").alias("m")).groupBy("a", "b", F.col("m.fa").alias("fa"), F.col("m.fb").alias("fb")).agg(F.count("*").alias("n"), F.avg("c").alias("c"))
        own = lambda c: F.max(F.when(F.col("fa").isNull(), F.col(c)))
        j = t.groupBy("a", "b").agg(own("n").alias("count"), own("c").alias("avg_confidence"), F.count("fa").alias("n_field_pairs"))
    j = j.filter((F.col("count") >= least) & (F.col("n_field_pairs") >= least_field_pairs))
    j = j.join(names.select(F.col("concept").alias("concept_a"), F.col("i").alias("a")), "a").join(names.select(F.col("concept").alias("concept_b"), F.col("i").alias("b")), "b")
    j = j.select("concept_a", "concept_b", "count", "avg_confidence", "n_field_pairs")
    return j.withColumn("score", F.col("avg_confidence") * F.log1p("n_field_pairs") / (1 + F.log(F.col("count"))))


def evidence_for(concepts: DataFrame, wanted: DataFrame, k: int = 3) -> DataFrame:
    """wanted(concept) -> concept, passage_id, confidence, rank: the surest passages of each, in one join."""
    one = concepts.join(wanted.select("concept").distinct(), "concept").groupBy("concept", "passage_id").agg(F.max("confidence").alias("confidence"))
    r = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("confidence"), "passage_id"))
    return one.withColumn("rank", r).filter(F.col("rank") <= k)


def overlap_hypotheses(overlap: DataFrame, evidence: DataFrame, most: int = 10) -> DataFrame:
    """evidence(field_a, field_b, confidence, found): score pmi * confidence * (0.5 + 0.5 * coverage of `most`)."""
    e = evidence.groupBy("field_a", "field_b").agg(F.avg("confidence").alias("confidence"), F.count("*").alias("found"))
    cover = F.least(F.lit(1.0), F.col("found") / most)
    return overlap.join(e, ["field_a", "field_b"]).withColumn("score", F.col("pmi") * F.col("confidence") * (0.5 + 0.5 * cover))


def greedy_distinct(ranked: list[dict], items: str, most: int = 20, free: int = 6, overlap: float = 0.5) -> list[dict]:
    """Takes hypotheses in rank order; after the first `free` of them, those of whose items more than `overlap` are in
    earlier ones are passed over. The state runs through the list, which is a top-k report of a few hundred rows."""
    out: list[dict] = []
    seen: set = set()
    for h in ranked:
        own = set(h[items])
        if len(out) >= free and own and len(own & seen) / len(own) > overlap:
            continue
        out.append(h)
        seen |= own
        if len(out) == most:
            break
    return out


def field_strengths(overlap: DataFrame) -> DataFrame:
    """field, strength, partners: the summed absolute PMI of a field with its partners."""
    both = overlap.select(F.col("field_a").alias("field"), "pmi").union(overlap.select("field_b", "pmi"))
    return both.groupBy("field").agg(F.sum(F.abs("pmi")).alias("strength"), F.count("*").alias("partners"))


def pmi_matrix(overlap: DataFrame, fields: list[str]) -> DataFrame:
    """field and a column for each of these fields: their PMI, null where a pair is not known or a field is itself."""
    one = overlap.filter(F.col("field_a").isin(*fields) & F.col("field_b").isin(*fields)).select("field_a", "field_b", "pmi")
    both = one.union(one.select("field_b", "field_a", "pmi"))
    return both.withColumnRenamed("field_a", "field").groupBy("field").pivot("field_b", fields).agg(F.first("pmi"))


def field_clusters(overlap: DataFrame, k: int = 5, top: int = 25) -> DataFrame:
    """field, cluster, place: the `top` strongest fields, in k clusters, in the order of the tree's leaves.

    Distances are the greatest PMI (1 if none is positive) less a pair's, 0 for pairs that are not known; clusters are joined
    by Ward's rule. The matrix has top times top numbers, whatever the corpus, so it is clustered on the driver."""
    spark = overlap.sparkSession
    names = [r["field"] for r in field_strengths(overlap).orderBy(F.desc(F.round("strength", 9)), "field").limit(top).collect()]
    at, m = {f: i for i, f in enumerate(names)}, np.zeros((len(names), len(names)))
    for r in overlap.filter(F.col("field_a").isin(*names) & F.col("field_b").isin(*names)).select("field_a", "field_b", "pmi").collect():
        m[at[r["field_a"]], at[r["field_b"]]] = m[at[r["field_b"]], at[r["field_a"]]] = r["pmi"]
    most = m.max(initial=0.0)
    d = (most if most > 0 else 1.0) - m
    np.fill_diagonal(d, 0)
    own, order = cut_tree(ward_merges(d), len(names), k)
    rows = [(f, int(own[i]), order.index(i) + 1) for i, f in enumerate(names)]
    return spark.createDataFrame(rows, "field string, cluster int, place int")


def ward_merges(d: np.ndarray) -> list[tuple[float, int, int]]:
    """height, a, b of the joins, where a and b are members of what is joined: by chains of nearest neighbours, which find
    the joins of the greedy order in time n squared. Ties go to the smaller number."""
    n = len(d)
    d2, size, live = d.astype(float) ** 2, np.ones(n), np.ones(n, bool)
    np.fill_diagonal(d2, np.inf)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    while live.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(live)[0]))
        a = chain[-1]
        near = np.where(live, d2[a], np.inf)
        b = int(near.argmin())
        if len(chain) > 1 and near[chain[-2]] <= near[b]:
            b = chain[-2]
        if len(chain) < 2 or b != chain[-2]:
            chain.append(b)
            continue
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        merges.append((float(np.sqrt(max(d2[a, b], 0.0))), a, b))
        total = size[a] + size[b] + size
        new = ((size[a] + size) * d2[a] + (size[b] + size) * d2[b] - size * d2[a, b]) / total
        d2[a], d2[:, a] = new, new
        d2[a, a], size[a], live[b] = np.inf, size[a] + size[b], False
    return sorted(merges, key=lambda x: x[0])


def cut_tree(merges: list[tuple[float, int, int]], n: int, k: int) -> tuple[list[int], list[int]]:
    """The cluster of each member, numbered from 1 by first members, with k clusters; and the members in the tree's order."""
    root = list(range(n))
    leaves = {i: [i] for i in range(n)}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    own = list(range(n))
    for done, (_, a, b) in enumerate(merges):
        if n - done == k:
            own = [find(i) for i in range(n)]
        a, b = sorted((find(a), find(b)))
        root[b] = a
        leaves[a] = leaves[a] + leaves.pop(b)
    if n - len(merges) >= k:
        own = [find(i) for i in range(n)]
    names: dict[int, int] = {}
    return [names.setdefault(x, len(names) + 1) for x in own], [i for r in sorted(leaves) for i in leaves[r]]
