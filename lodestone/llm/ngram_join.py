"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Documents whose sets of k-word shingles are equal form a class, found by a group-by on a fingerprint of the set.
Every class has a MinHash signature of `longest` hashes in each of `trees` trees: a path from the root of that tree's
prefix trie. Tries are not linked structures: a node is the run of equal prefixes in the sorted (tree, prefix) rows.

A prefix is shortened from `longest` hashes on while fewer would still leave its node at most `crowd` classes, but
not below the depth at which pairs at the threshold meet in some of `trees` trees with the target recall
(`forest_depth`). So most prefixes end at that depth, and those in crowded parts of a trie, where many texts share
passages without being alike, stay longer. What that costs in recall is bounded for each class by its longest prefix
(two classes that agree so far in a tree meet there, wherever the prefix ends), and the classes that fall short of the
target get further trees, until they reach it; at the full length a node is kept whatever its size. Pairs that meet are verified exactly, on their whole shingle sets, words compared as bytes.

Within a bin (`pair_bins`: at most two blocks of members) common shingles are counted with one matrix product over
patterns of shingles that the same members have. Pairs are counted where they are, in the first tree in which they
meet, and leave the task only as a member's number of links and as one edge to the root of its part.

Rows with a null doc_id can have no links and have a null class. A null or wordless text has no shingles and links
with nothing. A text of fewer than k words, but some, is one shingle. Rows that repeat a doc_id are one document in
class ids, and each counts as a row in n_links. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import bin_slots, grouped_map, label_groups, materialise, pair_bins
from lodestone.llm._text import U64, cut_words, distinct_runs, mix, run_hashes, shingle_sets, slices, utf8, words
from lodestone.llm.components import components

#: Rows of a broadcast side: at most this many longs, about 100 MB as Spark's hashed relation.
BROADCAST_ROWS = 1_000_000


def forest_depth(threshold: float, trees: int, longest: int, recall: float) -> int:
    """The longest prefix with which a pair at the threshold meets in some tree with probability >= recall."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 2**64, n, dtype=U64), r.integers(0, 2**64, n, dtype=U64) | U64(1)


#: Bits of a signature's hashes below the least depth, of which one long holds four.
PIECE = 16


def signatures(sets: list[np.ndarray], first: int, trees: int, depth: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set (rows) and tree (columns, from number `first` on): the label of its prefix of `depth` hashes, and
    the next hashes up to `longest`, PIECE bits of each, the first one lowest. A row of an empty set is 0."""
    out, more = np.zeros((len(sets), trees), dtype=np.int64), np.zeros((len(sets), trees), dtype=np.int64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out, more
    x = np.concatenate([sets[i] for i in full])
    begin = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
    xor, mul = _seeds((first + trees) * longest)
    for t in range(trees):
        label, rest = np.full(len(full), first + t + 1, dtype=U64), np.zeros(len(full), dtype=U64)
        for d in range(longest):
            k = (first + t) * longest + d
            least = mix(np.minimum.reduceat((x ^ xor[k]) * mul[k], begin))
            if d < depth:
                label = mix(label * U64(31) + least)
            else:
                rest |= (least & U64((1 << PIECE) - 1)) << U64(PIECE * (d - depth))
        out[full, t] = np.where(label == 0, U64(1), label).view(np.int64)
        more[full, t] = rest.view(np.int64)
    return out, more


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=U64), mix(s ^ U64(0xA5A5A5A55A5A5A5A)).sum(dtype=U64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _signed(docs: DataFrame, k: int, trees: int, depth: int, longest: int | None = None, first: int = 0) -> DataFrame:
    """docs: doc_id and text. n_sh, the fingerprint, and for each tree label l and, if there is a longest, pieces m."""
    deep = longest or depth
    names = [f"l{t}" for t in range(trees)] + ([f"m{t}" for t in range(trees)] if longest else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*words(*utf8(part.column(1))), k)
                labels, more = signatures(sets, first, trees, depth, deep)
                prints = [fingerprint(s) for s in sets]
                cols = [labels[:, t] for t in range(trees)] + ([more[:, t] for t in range(trees)] if longest else [])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), *(pa.array(c) for c in cols)],
                    names=["doc_id", "n_sh", "fp0", "fp1", *names],
                )

    return docs.mapInArrow(run, "doc_id bigint, n_sh bigint, fp0 bigint, fp1 bigint, " + ", ".join(f"{c} bigint" for c in names))


def shortened(classes: DataFrame, groups: DataFrame, crowd: int, depth: int, longest: int) -> DataFrame | None:
    """cid, tab, lab, depth of the prefixes that stay longer than `depth`, since their node there holds more than `crowd`
    classes; None if there is no such node. classes: cid, labels and more; groups: of their labels.

    Walked from the shortest prefix on, which ends at the same nodes as shortening from the longest does."""
    crowded = materialise(groups.filter(F.col("m") > crowd).select("tab", "lab"))
    if not (n := crowded.count()):
        return None
    here = classes.select("cid", F.posexplode(F.arrays_zip("labels", "more")).alias("tab", "x")).select("cid", "tab", F.col("x.labels").alias("lab"), F.col("x.more").alias("more"))
    out = None
    for d in range(depth + 1, longest + 1):
        here = here.join(F.broadcast(crowded) if n <= BROADCAST_ROWS else crowded, ["tab", "lab"])
        piece = F.shiftrightunsigned("more", PIECE * (d - 1 - depth)).bitwiseAND((1 << PIECE) - 1)
        here = materialise(here.select("cid", "tab", F.xxhash64("lab", piece).alias("lab"), "more"))
        if d < longest:
            crowded = materialise(here.groupBy("tab", "lab").agg(F.count("*").alias("m")).filter(F.col("m") > crowd).select("tab", "lab"))
            n = crowded.count()
            done = here.join(F.broadcast(crowded) if n <= BROADCAST_ROWS else crowded, ["tab", "lab"], "left_anti")
        else:
            n, done = 0, here
        done = done.select("cid", "tab", "lab", F.lit(d).alias("depth"))
        out = done if out is None else out.unionByName(done)
        if not n:
            break
    return materialise(out)


def grown(classes: DataFrame, groups: DataFrame, sign, crowd: int, threshold: float, trees: int, depth: int, longest: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """The classes with the labels of the nodes at which their prefixes end, in as many trees as each class needs, and the
    groups of these labels. sign(cids, first): cid, labels and more of further trees, from number `first` on."""
    first, labels, todo = 0, None, classes.select("cid", "labels", "more")
    while True:
        here = label_groups(todo, "cid", "labels") if first else groups
        longer = shortened(todo, here, crowd, depth, longest)
        if longer is None and labels is None:
            return classes.drop("more"), groups
        if longer is not None:
            ends = longer.groupBy("cid").agg(F.map_from_entries(F.collect_list(F.struct("tab", F.struct("lab", "depth")))).alias("ends"))  # at most one for each tree
            todo = todo.join(ends, "cid", "left")
        else:
            todo = todo.withColumn("ends", F.lit(None).cast("map<int,struct<lab:bigint,depth:int>>"))
        at = lambda i: F.try_element_at("ends", i)
        ended = F.transform("labels", lambda x, i: F.coalesce(at(i)["lab"], x))
        deepest = F.array_max(F.transform("labels", lambda x, i: F.coalesce(at(i)["depth"], F.lit(depth))))
        part = todo.select("cid", ended.alias("own"), deepest.alias("deep"))
        if labels is None:
            labels = part.withColumnRenamed("own", "labels")
        else:
            none = F.array_repeat(F.lit(0).cast("bigint"), trees)
            labels = labels.join(part.withColumnRenamed("deep", "again"), "cid", "left").select("cid", F.concat("labels", F.coalesce("own", none)).alias("labels"), F.greatest("deep", "again").alias("deep"))
        labels = materialise(labels)
        short = labels.filter(F.pow(1 - F.pow(F.lit(threshold), F.col("deep")), F.lit(first + trees)) > 1 - recall).select("cid")
        if short.isEmpty():
            out = materialise(classes.drop("labels", "more").join(labels.select("cid", "labels"), "cid"))
            return out, materialise(label_groups(out, "cid", "labels"))
        first += trees
        todo = materialise(sign(short, first))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """The size of the common part of every two sets, exactly: shingles of the same members are one column."""
    m = len(sets)
    x, who = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(x, kind="stable")
    x, who = x[order], who[order]
    begin = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    n = np.diff(np.append(begin, len(x)))
    shared = n > 1
    if not shared.any():
        return np.zeros((m, m), np.int64)
    marks = mix(np.arange(1, m + 1, dtype=U64))
    pattern = mix(np.add.reduceat(marks[who], begin)) ^ n.astype(U64)
    _, at, weight = np.unique(pattern[shared], return_index=True, return_counts=True)
    begin, n = begin[shared][at], n[shared][at]
    out = np.zeros((m, m), np.float64)
    step = max(1, (1 << 22) // m)
    for a in range(0, len(begin), step):
        b = min(len(begin), a + step)
        cols = np.repeat(np.arange(b - a), n[a:b])
        idx = np.repeat(begin[a:b], n[a:b]) + np.arange(n[a:b].sum()) - np.repeat(np.cumsum(n[a:b]) - n[a:b], n[a:b])
        has = np.zeros((m, b - a), np.float32)
        has[who[idx], cols] = 1
        out += (has * weight[a:b].astype(np.float32)) @ has.T
    return np.rint(out).astype(np.int64)


def count_links(linked: np.ndarray, mult: np.ndarray, key: np.ndarray) -> pd.DataFrame:
    """Links of each member (copies count), and its root: the smallest key of its part of the bin."""
    m = len(key)
    root = np.arange(m)
    while True:  # smallest index over neighbours, with pointer jumping
        new = np.where(linked, root[None, :], m).min(axis=1, initial=m)
        new = np.minimum(new, root)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return pd.DataFrame({"cid": key, "links": linked @ mult, "root": key[root]})


def _exact_sets(texts: pd.Series, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """shingle_sets(), and the same with words that have one hash but other bytes told apart."""
    body, begin, length, bounds = cut_words(*utf8(pa.array(texts, pa.string())))
    h = run_hashes(body, begin, length)
    sets = shingle_sets(h, bounds, k)
    if len(h):
        distinct, _, back = distinct_runs(body, begin, length)
        if len(np.unique(distinct)) < len(distinct):
            return sets, shingle_sets(mix(h ^ mix(back.astype(U64))), bounds, k)
    return sets, sets


def _verify(k: int, num: int, den: int):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("cid", kind="stable")
        plain, sets = _exact_sets(g["text"], k)
        prints = [fingerprint(s) for s in plain]
        fits = np.array([p == (a, b) for p, a, b in zip(prints, g["fp0"], g["fp1"])], dtype=bool)
        keep = list(_first(g["cid"].to_numpy(), fits))
        g, sets = g.iloc[keep], [sets[i] for i in keep]
        if len(g) < 2:
            return pd.DataFrame({"cid": [], "links": [], "root": []}).astype("int64")
        size = np.array([len(s) for s in sets], dtype=np.int64)
        both = common_counts(sets)
        linked = both * (num + den) >= num * (size[:, None] + size[None, :])
        labels, t, blk = np.stack(g["labels"].to_numpy()), int(g["tab"].iloc[0]), g["blk"].to_numpy()
        for earlier in range(t):
            linked &= (labels[:, earlier][:, None] != labels[:, earlier][None, :]) | (labels[:, earlier] == 0)[None, :]
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        if i != j:
            linked &= blk[:, None] != blk[None, :]
        np.fill_diagonal(linked, False)
        out = count_links(linked, g["mult"].to_numpy(), g["cid"].to_numpy())
        return out[out["links"] > 0]

    return run


def _first(cid: np.ndarray, fits: np.ndarray) -> Iterator[int]:
    seen = set()
    for i, (c, ok) in enumerate(zip(cid.tolist(), fits.tolist())):
        if ok and c not in seen:
            seen.add(c)
            yield i


def ngram_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, threshold: tuple[int, int] = (4, 5), trees: int = 16, longest: int = 8, recall: float = 0.9995, block: int = 512, crowd: int = 8192) -> DataFrame:
    """doc_id, class_id (smallest doc_id reachable by links), n_links (other rows linked directly), kept.

    threshold is an exact fraction; pairs with Jaccard similarity >= it are links. recall: of a pair just at the
    threshold, in the forest; pairs above it are surer, and equal sets are certain.
    """
    num, den = threshold
    depth = forest_depth(num / den, trees, longest, recall)
    if longest - depth > 64 // PIECE:
        raise ValueError("the longest prefix is too long for the least one")
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    array = lambda c: F.array(*(F.col(f"{c}{t}") for t in range(trees)))
    signed = materialise(_signed(docs, k, trees, depth, longest))
    named = signed.filter("n_sh > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("fp0", "fp1", "n_sh").agg(F.min("doc_id").alias("rep"), F.count("*").alias("mult"), *(F.first(f"{c}{t}").alias(f"{c}{t}") for c in "lm" for t in range(trees)))
    cid = F.xxhash64("fp0", "fp1", "n_sh")
    classes = materialise(classes.select(cid.alias("cid"), "fp0", "fp1", "n_sh", "rep", "mult", array("l").alias("labels"), array("m").alias("more")))

    def sign(cids: DataFrame, first: int) -> DataFrame:
        """Repeated doc_ids may have other texts: those are of other classes."""
        rows = docs.join(classes.join(cids, "cid", "left_semi").select("rep").distinct(), F.col("doc_id") == F.col("rep"), "left_semi")
        own = _signed(rows, k, trees, depth, longest, first).select(cid.alias("cid"), array("l").alias("labels"), array("m").alias("more"))
        return own.join(cids, "cid", "left_semi").dropDuplicates(["cid"])

    groups = materialise(label_groups(classes, "cid", "labels"))
    classes, groups = grown(classes, groups, sign, crowd, num / den, trees, depth, longest, recall)
    members = materialise(pair_bins(classes.select("cid", "labels"), "cid", "labels", block, groups))
    wanted = materialise(classes.join(members.select("cid").distinct(), "cid", "left_semi"))
    few = wanted.select("rep").distinct()
    if few.count() <= BROADCAST_ROWS:
        few = F.broadcast(few)
    texts = docs.join(few, docs["doc_id"] == few["rep"], "left_semi").select(F.col("doc_id").alias("rep"), "text")
    full = wanted.join(texts, "rep").select("cid", "fp0", "fp1", "mult", "labels", "text")
    binned = members.join(full, "cid").select("tab", "lab", "i", "j", "slot", "blk", "cid", "fp0", "fp1", "mult", "labels", "text")
    found = materialise(grouped_map(binned, ["tab", "lab", "i", "j"], _verify(k, num, den), "cid bigint, links bigint, root bigint", bin_slots(members)))
    reps = classes.select("cid", "rep")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    edges = found.filter("cid <> root").select("cid", "root").distinct().join(reps.select("cid", F.col("rep").alias("u")), "cid").join(reps.select(F.col("cid").alias("root"), F.col("rep").alias("v")), "root").select("u", "v")
    again = named.groupBy("doc_id").agg(F.count_distinct("fp0", "fp1").alias("n")).filter("n > 1").select("doc_id")
    edges = edges.union(named.join(again, "doc_id").select("fp0", "fp1", "n_sh", F.col("doc_id").alias("u")).join(classes.select("fp0", "fp1", "n_sh", F.col("rep").alias("v")), ["fp0", "fp1", "n_sh"]).select("u", "v"))
    part = components(edges)
    of_class = classes.join(links, "cid", "left").join(part, classes["rep"] == part["node"], "left").select("fp0", "fp1", "n_sh", F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    of_class = materialise(of_class)
    out = signed.select("doc_id", "fp0", "fp1", "n_sh").join(of_class, ["fp0", "fp1", "n_sh"], "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.coalesce("n_links", F.lit(0))).cast("bigint").alias("n_links"), (F.col("doc_id").isNull() | (class_id == F.col("doc_id"))).alias("kept"))
