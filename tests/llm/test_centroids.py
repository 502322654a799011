import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from lodestone.llm import centroids
from lodestone.llm.centroids import Centroids, centroid_clusters, roots


def brute(rows, k, dim, rounds=10, seed=3):
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest()))[:k]
    at = [list(v) for _, v in first]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((dist(v, c), j) for j, c in enumerate(at))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(at)):
            if mine := [v for (_, v), o in zip(kept, own) if o == j]:
                at[j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept]
    long = lambda v: v if v is not None and v < 1 << 63 else None
    total = lambda ds: None if any(d >= 1 << 63 for d in ds) else long(sum(ds))
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, j, long(d), total([e for _, e, o in last if o == j]), total([e for _, e, _ in last]), sha[j]) for i, d, j in last), key=str)


def result(df, **more):
    return sorted((tuple(r) for r in centroid_clusters(df, **more).collect()), key=str)


@pytest.mark.parametrize("spread", [0.0, 0.3, 3.0])
def test_against_brute_force(spark, spread):
    r = np.random.default_rng(int(spread * 10))
    rows = [(i, (spread * r.standard_normal(4)[i % 4] + r.standard_normal(6)).tolist()) for i in range(300)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    report = []
    assert result(df, k=8, dim=6, report=report) == brute(rows, 8, 6)
    assert len(report) == 11 and report[-1] < 300 * 8  # bounds leave distances out


def test_ties_repeats_and_what_is_left_out(spark):
    rows = [(i, [float(i % 3), float(i % 2)]) for i in range(40)] + [(5, [9.0, 9.0]), (5, [9.0, 9.0]), (None, [1.0, 1.0])]
    rows += [(100, None), (101, [1.0]), (102, [1.0, None]), (103, [math.nan, 1.0]), (104, [math.inf, 1.0]), (105, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert result(df, k=5, dim=2) == brute(rows, 5, 2)
    few = df.filter("vec_id IN (1, 2, 100)")
    assert result(few, k=5, dim=2) == brute([(1, [1.0, 1.0]), (2, [2.0, 0.0])], 5, 2)
    assert result(df.limit(0), k=5, dim=2) == []


def test_integers_of_any_size(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.standard_normal(3).tolist()) for i in range(60)] + [(60, [1e300, 0.0, -1e300]), (61, [3e9, 1.5, 0.1]), (62, [3e9, 1.0, 0.2]), (63, [1e15, 0.0, 0.0]), (64, [1.7e308, 1.7e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = result(df, k=4, dim=3)
    assert got == brute(rows, 4, 3)
    assert any(x[2] is None for x in got) or all(x[2] == 0 for x in got if x[0] >= 60)


def test_bounds_hold_while_centroids_move():
    r = np.random.default_rng(8)
    x = r.integers(-500, 500, (200, 5))
    own, upper, lower, before = np.zeros(200, np.int32), np.full(200, np.inf), np.zeros((200, 6)), None
    now = r.integers(-500, 500, (6, 5)).tolist()
    for _ in range(12):
        c = Centroids(now, before)
        own, upper, lower, _ = c.assign(x, own, upper, lower)
        d2 = ((x[:, None, :] - np.array(now)[None]) ** 2).sum(axis=2)
        assert (own == d2.argmin(axis=1)).all()
        assert (upper >= np.sqrt(d2[np.arange(200), own])).all() and (lower <= np.sqrt(d2)).all()
        before, now = now, (np.array(now) + r.integers(-40, 40, (6, 5))).tolist()


def test_roots_are_on_their_sides():
    big = np.array([0, 1, 2, 3, (1 << 60) - 1, 1 << 60, 10**18 + 1])
    for kind in (np.int64, object):
        lo, hi = roots(big.astype(kind), False), roots(big.astype(kind), True)
        for v, a, b in zip(big.tolist(), lo.tolist(), hi.tolist()):
            assert Fraction(a) ** 2 <= v <= Fraction(b) ** 2
    assert roots(np.array([10**900], object), True)[0] == np.inf and roots(np.array([10**900], object), False)[0] < np.inf
    assert centroids.NARROW**2 * 4 * 64 < 1 << 62
