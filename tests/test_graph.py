import random
from collections import Counter

import numpy as np
import pytest

from lodestone.operators import atlas, graph
from lodestone.sources.sinks import VersionedTable


def test_betweenness_walks_to_any_depth(spark, monkeypatch):
    """A chain longer than 64 levels, on the path for graphs that are not broadcast."""
    monkeypatch.setattr(graph, "BROADCAST_EDGES", 0)
    monkeypatch.setattr(graph, "materialise", lambda df: df.coalesce(1).localCheckpoint())  # files take longer than the walk
    n = 68
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long").coalesce(1)
    got = {r.node: r.betweenness for r in graph.betweenness(edges).collect()}
    assert got == pytest.approx({i: 2 * i * (n - 1 - i) / ((n - 1) * (n - 2)) for i in range(n)})


def greedy_ward(d, k):
    """Joins the two nearest clusters again and again, all pairs looked at each time."""
    d2 = {(i, j): d[i][j] ** 2 for i in range(len(d)) for j in range(i)}
    size = {i: 1 for i in range(len(d))}
    parts = {i: {i} for i in range(len(d))}
    get = lambda i, j: d2[max(i, j), min(i, j)]
    while len(parts) > k:
        a, b = min(((i, j) for i in parts for j in parts if i < j), key=lambda x: get(*x))
        for w in parts:
            if w not in (a, b):
                n = size[a] + size[b] + size[w]
                d2[max(a, w), min(a, w)] = ((size[a] + size[w]) * get(a, w) + (size[b] + size[w]) * get(b, w) - size[w] * get(a, b)) / n
        parts[a] |= parts.pop(b)
        size[a] += size[b]
    return {frozenset(x) for x in parts.values()}


def test_clusters_equal_the_greedy_order():
    r = np.random.default_rng(2)
    for n in (1, 2, 5, 12, 25):
        m = r.random((n, n)) * 3
        d = np.triu(m, 1) + np.triu(m, 1).T
        for k in (1, 2, 5):
            own, order = atlas.cut_tree(atlas.ward_merges(d), n, k)
            got = {frozenset(i for i in range(n) if own[i] == c) for c in set(own)}
            assert got == greedy_ward(d, k) and sorted(order) == list(range(n))
            assert all(max(p) - min(p) + 1 == len(p) for c in got if (p := [order.index(i) for i in c]))  # neighbours in the tree


def test_field_clusters(spark):
    rows = [(f"{g}{i}", f"{g}{j}", 2.0 + 0.01 * i) for g in "xyz" for i in range(4) for j in range(i + 1, 4)] + [("x0", "y0", -1.0), ("y1", "z1", 0.1)]
    overlap = spark.createDataFrame(rows, "field_a string, field_b string, pmi double")
    got = {}
    for r in atlas.field_clusters(overlap, k=3).collect():
        got.setdefault(r.cluster, set()).add(r.field)
    assert sorted(map(sorted, got.values())) == [[f"{g}{i}" for i in range(4)] for g in "xyz"]
    assert atlas.field_clusters(overlap.limit(0)).count() == 0


def test_orphans_are_linked_once(spark, tmp_path):
    edges = VersionedTable(spark, str(tmp_path / "edges"), "src int, dst string, type string, keywords array<string>, weight int")
    edges.insert_ignore(spark.createDataFrame([(1, "cell", "MENTIONS", [], 9), (2, "cell", "CITES", [], 9)], edges.schema), ["src", "dst", "type"], "weight")
    papers = spark.createDataFrame([(1, "Deep learning"), (2, "DEEP Learning of cells"), (3, "single-cell attention"), (4, "none"), (5, None), (3, "attention")], "id int, title string")
    words = spark.createDataFrame([("deep learning", "deep"), ("Cell", "cell"), ("cells", "cell"), ("attention", "attention"), (None, "x"), ("", "y")], "keyword string, concept string")
    for _ in range(2):
        left = graph.link_orphans(papers, "id", "title", words, edges)
        assert sorted(r.id for r in left.collect()) == [4, 5]
        got = sorted((r.src, r.dst, r.type, r.keywords) for r in edges.read().collect())
        assert got == [(1, "cell", "MENTIONS", []), (2, "cell", "CITES", []), (2, "cell", "MENTIONS", ["cell", "cells"]), (2, "deep", "MENTIONS", ["deep learning"]), (3, "attention", "MENTIONS", ["attention"]), (3, "cell", "MENTIONS", ["cell"])]


def test_pairs_of_a_hot_group_are_dealt_into_blocks(spark):
    import random
    from collections import Counter
    from itertools import combinations

    r = random.Random(4)
    rows = [(0, f"i{k}") for k in range(60)] + [(g, f"i{r.randrange(60)}") for g in range(1, 30) for _ in range(r.choice([1, 2, 12]))] + [(0, "i3"), (None, "i1"), (3, None)]
    d = spark.createDataFrame(rows, "g long, i string")
    sets = {}
    for g, i in rows:
        if g is not None and i is not None:
            sets.setdefault(g, set()).add(i)
    want = Counter(p for s in sets.values() for p in combinations(sorted(s), 2))
    for block in (7, 1024):
        got = {(x.a, x.b): x.weight for x in graph.co_occurrence(d, "g", "i", 1, block).collect()}
        assert got == dict(want)
    assert graph.co_occurrence(d.limit(0), "g", "i").count() == 0



def test_analogies_by_gaps(spark):
    """Analogies equal those of all pairs, also in dealt groups; a value that all others are combined with makes no pairs."""
    r = random.Random(4)
    uses = [(p, f"m{r.randrange(4)}") for p in range(60) for _ in range(2)] + [(None, "m0"), (3, None)]
    mentions = [(p, f"c{min(r.randrange(12), r.randrange(12))}") for p in range(60) for _ in range(4)] + [(4, None), (60, "c77"), (61, "c77"), (60, "c0"), (61, "c0")]
    for known in (uses[:-1], uses):
        u, m = {x for x in known if x[0] is not None}, {x for x in mentions if x[1] is not None}
        both = Counter((method, c) for p, method in u for q, c in m if p == q)
        pairs = Counter((c, d) for p, c in m for q, d in m if p == q and c != d)
        want = {(method, c, d) for (method, c), n in both.items() if n >= 2 for (x, d), k in pairs.items() if x == c and k >= 2 and (method is None or (method, d) not in both)}
        got = graph.analogies(spark.createDataFrame(known, "paper int, method string"), spark.createDataFrame(mentions, "paper int, concept string"), "paper", "method", "concept")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want
    pairs = spark.createDataFrame([(p, i) for p in range(3) for i in range(9) if (p + i) % 4], "g int, i int")
    but = spark.createDataFrame([(i,) for i in range(6)], "i int")
    want = sorted(tuple(x) for x in graph.co_occurrence(pairs, "g", "i", 1).filter("a > 5 OR b > 5").collect())
    for block in (1024, 2):
        assert sorted(tuple(x) for x in graph.co_occurrence(pairs, "g", "i", 1, block, but).collect()) == want and want


def test_rare_pairs_by_bits_and_by_rows(spark, monkeypatch):
    """Both ways equal plain counting; a missing field counts as one of a passage's fields, a missing concept is in no pair."""
    r = random.Random(6)
    rows = [(p, r.choice(["é", "b", "c", "d", None]), r.choice([*(f"f{k}" for k in range(14)), None]), r.choice([0.25, 0.5, 0.75])) for p in range(40) for _ in range(4)]
    rows += [(90 + k, c, f, 0.5) for k in range(3) for c, f in (("y", "f0"), ("z", None))] + [(93, "y", "f1", 0.5), (93, "z", "f2", 0.5), (94, "y", "f1", 0.5), (94, "z", "f3", 0.5)]
    seen, met = {}, {}
    for p in {x[0] for x in rows}:
        own, sure = {x[2] for x in rows if x[0] == p}, {}
        for _, c, _, v in (x for x in rows if x[0] == p and x[1] is not None):
            sure[c] = max(v, sure.get(c, 0))
        if len(own) > 1:
            for a, b in ((a, b) for a in sure for b in sure if a.encode() < b.encode()):
                seen.setdefault((a, b), []).append((sure[a] + sure[b]) / 2)
                met.setdefault((a, b), set()).update((x, y) for x in own - {None} for y in own - {None} if x < y)
    want = sorted((a, b, len(v), sum(v) / len(v), len(met[a, b])) for (a, b), v in seen.items() if len(v) >= 3 and len(met[a, b]) >= 2)
    df = spark.createDataFrame(rows, "passage_id int, concept string, field string, confidence double")
    for most in (64, 13):
        monkeypatch.setattr(atlas, "BIT_FIELDS", most)
        got = sorted(tuple(x)[:5] for x in atlas.rare_pairs(df).collect())
        assert got == want and any(x[:3] == ("y", "z", 5) for x in want)
