"""Graphs as DataFrames: co-occurrence, gaps, analogies, paths and betweenness.

A graph is a table of edges, mostly (paper, name) pairs of one relation; two relations of a paper are two tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.containment import containing
from lodestone.operators.scratch import materialise

#: Edges that may be sent to every task, as two arrays of integers: 80 MB.
BROADCAST_EDGES = 5_000_000


def _dealt_pairs(d: DataFrame, crowds: DataFrame) -> DataFrame:
    """a < b of each group of d(g, i, w), one of them with w, where crowds(g, blocks) has the large groups. Their items are
    dealt into blocks by a hash, and each two blocks meet in one bin, so no task gets an unbounded group."""
    dealt = d.join(crowds, "g", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bins = dealt.groupBy("g", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).agg(F.array_sort(F.collect_list(F.struct("i", "w", "own"))).alias("s"))
    first = bins.filter("size(s) > 1").select("x", "y", F.posexplode("s").alias("at", "p"), "s")
    later = F.slice("s", F.col("at") + 2, F.size("s"))
    meets = F.when(F.col("x") == F.col("y"), later).otherwise(F.filter(later, lambda q: q["own"] != F.col("p")["own"]))
    meets = F.when(F.col("p.w"), meets).otherwise(F.filter(meets, lambda q: q["w"]))
    return first.select(F.col("p.i").alias("a"), F.explode(meets).alias("q")).select("a", F.col("q.i").alias("b"))


def co_occurrence(pairs: DataFrame, group: str, item: str, least: int = 2, block: int = 1024, but: DataFrame | None = None) -> DataFrame:
    """a < b, weight: the number of groups that have both items. Each pair is counted within its group's rows before
    anything is shuffled by pair. Groups are sets in one row each, unless one has more than `block` items; then groups are
    dealt into blocks. Null groups and items are in no pair. but(item): pairs of two of these are left out."""
    d = pairs.select(F.col(group).alias("g"), F.col(item).alias("i")).filter("g IS NOT NULL AND i IS NOT NULL").distinct()
    if but is None:
        d = d.withColumn("w", F.lit(True))
    else:
        known = but.select(F.col(item).alias("i"), F.lit(False).alias("w")).distinct()
        d = d.join(known, "i", "left").withColumn("w", F.coalesce("w", F.lit(True)))
        d = d.join(d.filter("w").select("g").distinct(), "g", "left_semi")
    crowds = d.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("g", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    if crowds.isEmpty():
        one = "i" if but is None else F.struct("i", "w")
        sets = d.groupBy("g").agg(F.array_sort(F.collect_set(one)).alias("s")).filter("size(s) > 1")
        each = sets.select(F.posexplode("s").alias("at", "a"), F.slice("s", F.col("at") + 2, F.size("s")).alias("later"))
        if but is None:
            each = each.select("a", F.explode("later").alias("b"))
        else:
            meets = F.when(F.col("a.w"), F.col("later")).otherwise(F.filter("later", lambda q: q["w"]))
            each = each.select(F.col("a.i").alias("a"), F.explode(meets["i"]).alias("b"))
    else:
        each = _dealt_pairs(d, crowds)
    return each.groupBy("a", "b").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)


def both_ways(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """src, dst in either direction, with what else the edges have."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), *rest).unionByName(edges.select(F.col(dst).alias("src"), F.col(src).alias("dst"), *rest))


def merged_edges(rows: DataFrame, by: str) -> DataFrame:
    """src, dst, type once each, with the attributes of the row that has the largest `by`."""
    rest = [c for c in rows.columns if c not in ("src", "dst", "type")]
    return rows.groupBy("src", "dst", "type").agg(F.max_by(F.struct(*rest), by).alias("x")).select("src", "dst", "type", "x.*")


def never_combined(left: DataFrame, right: DataFrame, paper: str, a: str, b: str) -> DataFrame:
    """Pairs of vocabulary entries that no paper has both of. The product is one of vocabularies, not of papers."""
    seen = left.select(paper, a).join(right.select(paper, b), paper).select(a, b).distinct()
    return left.select(a).distinct().crossJoin(right.select(b).distinct()).join(seen, [a, b], "left_anti")


def combinations(left: DataFrame, right: DataFrame, paper: str, a: str, b: str) -> DataFrame:
    """a, b, the number of papers that have both."""
    return left.select(paper, a).distinct().join(right.select(paper, b).distinct(), paper).groupBy(a, b).agg(F.count("*").alias("n"))


def analogies(left: DataFrame, right: DataFrame, paper: str, a: str, b: str, least: int = 2) -> DataFrame:
    """a, c1, c2: values of a that least papers combine with c1 and none with c2, where least papers have c1 and c2.

    What every value of a was combined with is no c2, so of papers' pairs only those with another one are made."""
    mc = materialise(combinations(left, right, paper, a, b))
    n = mc.select(a).distinct().count()  # a null is a value that is combined with nothing
    full = mc.groupBy(b).agg(F.count(a).alias("n")).filter(F.col("n") == n).select(b)
    r = both_ways(co_occurrence(right, paper, b, least, but=full)).select(F.col("src").alias("c1"), F.col("dst").alias("c2"))
    r = r.join(full.select(F.col(b).alias("c2")), "c2", "left_anti")
    j = mc.filter(F.col("n") >= least).select(a, F.col(b).alias("c1")).join(r, "c1")
    return j.join(mc.select(a, F.col(b).alias("c2")), [a, "c2"], "left_anti").select(a, "c1", "c2")


def k_hops(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """start(origin, node) -> origin, node, dist: the nodes within so many hops, with their least distance.

    A frontier of (origin, node) pairs is joined with the edges and freed of what was reached before; each is written
    to the shared folder."""
    e = materialise(edges.select("src", "dst").distinct())
    reached = start.select("origin", "node", F.lit(0).alias("dist")).distinct()
    frontier = reached
    for d in range(1, hops + 1):
        step = frontier.join(e, frontier["node"] == e["src"]).select("origin", F.col("dst").alias("node")).distinct()
        frontier = materialise(step.join(reached, ["origin", "node"], "left_anti").select("origin", "node", F.lit(d).alias("dist")))
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


def shortest_path(edges: DataFrame, src, dst, hops: int) -> DataFrame:
    """path, length of the shortest path, the first in the order of its nodes, of at most so many hops; no row if there
    is none. Each node keeps one path, so the frontier is never larger than the graph."""
    kind = dict(edges.dtypes)["src"]
    spark = edges.sparkSession
    e = materialise(edges.select("src", "dst").distinct())
    seen = spark.range(1).select(F.lit(src).cast(kind).alias("node"), F.array(F.lit(src).cast(kind)).alias("path"))
    frontier = seen
    for _ in range(hops):
        step = frontier.join(e, frontier["node"] == e["src"]).select(F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        frontier = materialise(step.groupBy("node").agg(F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter(F.col("node") == F.lit(dst).cast(kind)).select("path", (F.size("path") - 1).alias("length"))


def bridges_between(edges: DataFrame, left: list, right: list, hops: int = 3) -> DataFrame:
    """Nodes within so many hops of some node of either list: node, left_dist, right_dist, score: 1 / their sum."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]

    def around(names: list, out: str) -> DataFrame:
        start = spark.createDataFrame([(out, x) for x in names], f"origin string, node {kind}")
        return k_hops(edges, start, hops).filter("dist > 0").groupBy("node").agg(F.min("dist").alias(out))

    both = around(left, "left_dist").join(around(right, "right_dist"), "node").filter(~F.col("node").isin(*left, *right))
    return both.withColumn("score", 1.0 / (F.col("left_dist") + F.col("right_dist")))


def neighbourhood(edges: DataFrame, node, k: int) -> DataFrame:
    """The k heaviest neighbours of a node: node, weight."""
    return edges.filter(F.col("src") == node).groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("weight")).orderBy(F.desc("weight"), "node").limit(k)


# -- betweenness ----------------------------------------------------------------------------------------------------


def _brandes(n: int, start: np.ndarray, to: np.ndarray, pivots: list[int]) -> np.ndarray:
    """The sum over pivots of their dependencies on every node; adjacency in compressed rows. Level by level, with a
    level's edges at once."""
    total = np.zeros(n)
    for p in pivots:
        dist, sigma = np.full(n, -1, np.int64), np.zeros(n)
        dist[p], sigma[p] = 0, 1.0
        level, levels = np.array([p]), []
        while len(level):
            size = start[level + 1] - start[level]
            u = np.repeat(level, size)
            v = to[np.repeat(start[level], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            new = np.unique(v[dist[v] < 0])
            dist[new] = dist[level[0]] + 1
            down = dist[v] == dist[level[0]] + 1
            np.add.at(sigma, v[down], sigma[u[down]])
            levels.append((u[down], v[down]))
            level = new
        delta = np.zeros(n)
        for u, v in levels[::-1]:
            np.add.at(delta, u, sigma[u] / sigma[v] * (1 + delta[v]))
        delta[p] = 0
        total += delta
    return total


def betweenness(edges: DataFrame, pivots: int = 500) -> DataFrame:
    """node, betweenness in the undirected graph of edges (src, dst), normalised by (n - 1)(n - 2) and, when pivots are
    fewer than nodes, scaled by n / pivots. Pivots are the nodes with the smallest hashes, so a run is repeatable; with
    up to `pivots` nodes the result is exact.

    Up to BROADCAST_EDGES edges go to every task, and tasks share the pivots; larger graphs are walked in DataFrames,
    all pivots at once, level by level."""
    both = both_ways(edges.select("src", "dst"), "src", "dst").filter("src <> dst").distinct()
    nodes = both.select(F.col("src").alias("node")).distinct()
    if both.count() > BROADCAST_EDGES:
        return _betweenness_frames(both, nodes, pivots)
    got = both.orderBy("src", "dst").toPandas()
    names, codes = np.unique(got["src"].to_numpy(), return_inverse=True)
    n = len(names)
    if not n:
        return nodes.withColumn("betweenness", F.lit(0.0))
    to = np.searchsorted(names, got["dst"].to_numpy())
    start = np.append(0, np.cumsum(np.bincount(codes, minlength=n)))
    picked = [r["node"] for r in nodes.orderBy(F.xxhash64("node"), "node").limit(pivots).collect()]
    own = np.searchsorted(names, np.array(picked, dtype=names.dtype)).tolist()
    spark = edges.sparkSession
    sent = spark.sparkContext.broadcast((n, start, to, own))
    scale = (n / len(own)) / ((n - 1) * (n - 2)) if n > 2 else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, start, to, own = sent.value
        for pdf in batches:
            s = _brandes(n, start, to, [own[i] for i in pdf["id"]])
            at = np.flatnonzero(s)
            yield pd.DataFrame({"at": at, "s": s[at]})

    parts = max(1, min(len(own), spark.sparkContext.defaultParallelism))
    sums = spark.range(0, len(own), 1, parts).mapInPandas(run, "at bigint, s double").groupBy("at").agg(F.sum("s").alias("s"))
    table = spark.createDataFrame(pd.DataFrame({"at": np.arange(n), "node": names}))
    return table.join(sums, "at", "left").select("node", (F.coalesce("s", F.lit(0.0)) * scale).alias("betweenness"))


def _betweenness_frames(both: DataFrame, nodes: DataFrame, pivots: int) -> DataFrame:
    """Walks until no pivot reaches a new node; as edges go both ways, a neighbour is new unless it is in the last two levels."""
    both = materialise(both)
    n = nodes.count()
    k = min(n, pivots)
    start = nodes.orderBy(F.xxhash64("node"), "node").limit(k).select(F.col("node").alias("pivot"), "node", F.lit(1.0).alias("sigma"))
    levels = [start]
    while True:
        seen = reduce(DataFrame.unionByName, (x.select("pivot", "node") for x in levels[-2:]))
        step = levels[-1].join(both, levels[-1]["node"] == both["src"]).groupBy("pivot", F.col("dst").alias("node")).agg(F.sum("sigma").alias("sigma"))
        new = materialise(step.join(seen, ["pivot", "node"], "left_anti"))
        if new.isEmpty():
            break
        levels.append(new)
    delta = levels[-1].select("pivot", "node", "sigma", F.lit(0.0).alias("delta"))
    done = [delta]
    for upper in levels[-2::-1]:
        low = delta.select("pivot", F.col("node").alias("v"), F.col("sigma").alias("sv"), F.col("delta").alias("dv"))
        up = both.join(upper, both["src"] == upper["node"]).select("pivot", "node", "sigma", F.col("dst").alias("v"))
        given = up.join(low, ["pivot", "v"]).groupBy("pivot", "node").agg(F.sum(F.col("sigma") / F.col("sv") * (1 + F.col("dv"))).alias("d"))
        delta = materialise(upper.join(given, ["pivot", "node"], "left").select("pivot", "node", "sigma", F.coalesce("d", F.lit(0.0)).alias("delta")))
        done.append(delta)
    total = done[0]
    for d in done[1:]:
        total = total.unionByName(d)
    sums = total.filter("pivot <> node").groupBy("node").agg(F.sum("delta").alias("s"))
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return nodes.join(sums, "node", "left").select("node", (F.coalesce("s", F.lit(0.0)) * scale).alias("betweenness"))


def link_orphans(papers: DataFrame, paper: str, title: str, keywords: DataFrame, edges, kind: str = "MENTIONS") -> DataFrame:
    """Links papers that have no edge of this kind to the concepts whose keywords are in their titles, and writes the edges
    into the versioned table `edges` (src, dst, type, keywords, weight), whose others stay. keywords: keyword, concept; case is
    ignored. An edge has the keywords that led to it as its provenance, and as weight how many they are. What is linked is no
    orphan any more, so a further run over the same papers changes nothing. The papers that are still orphans."""
    known = edges.read().filter(F.col("type") == kind).select(F.col("src").alias(paper)).distinct()
    orphans = papers.select(paper, F.lower(title).alias("__title")).join(known, paper, "left_anti")
    words = keywords.select(F.lower("keyword").alias("__word"), "concept").distinct()
    found = containing(words, "__word", orphans, "__title").groupBy(F.col(paper).alias("src"), F.col("concept").alias("dst"))
    rows = found.agg(F.array_sort(F.collect_set("__word")).alias("keywords")).select("src", "dst", F.lit(kind).alias("type"), "keywords", F.size("keywords").alias("weight"))
    rows = materialise(rows)  # orphans are read from the table that is written
    edges.insert_ignore(rows, ["src", "dst", "type"], "weight")
    return orphans.join(rows.select(F.col("src").alias(paper)).distinct(), paper, "left_anti").select(paper).distinct()
