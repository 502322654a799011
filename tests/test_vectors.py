import numpy as np
import pytest

from lodestone.operators.vectors import CellIndex, meeting_chance, near_pairs, representatives, tables_needed


def rows_of(seed, n=120, dim=12):
    r = np.random.default_rng(seed)
    rows = [(i, r.standard_normal(dim).tolist()) for i in range(n)]
    for g in range(25):
        base = np.array(rows[g][1])
        rows += [(len(rows) + k, (base + 0.01 * (g + 1) * r.standard_normal(dim)).tolist()) for k in range(6)]
    odd = [(-1, None), (-2, []), (-3, [0.0] * dim), (-4, [float("nan")] * dim), (-5, [None] + [1.0] * (dim - 1)), (-6, [float("inf")] * dim)]
    return rows, rows + [(9000, rows[3][1]), (9001, rows[3][1])] + odd


def frame(spark, rows, name="v"):
    return spark.createDataFrame(rows, f"id long, {name} array<double>").repartition(3)


def unit(v):
    return np.array(v) / np.linalg.norm(v)


@pytest.mark.parametrize("block", [5, 1024])
def test_near_pairs_against_all_pairs(spark, block):
    own, rows = rows_of(1)
    want = {(a, b) for a, x in own for b, y in own if a < b and unit(x) @ unit(y) >= 0.99}
    got = [(x.a, x.b) for x in near_pairs(frame(spark, rows), "id", "v", 0.99, recall=0.9999, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(want) > 100
    assert len(got) >= 0.999 * len(want)  # recall, measured


def test_copies_are_members(spark):
    _, rows = rows_of(2)
    got = {x.id: x.rep for x in representatives(frame(spark, rows), "id", "v").collect()}
    assert got[9000] == got[9001] == got[3] == 3 and got[4] == 4 and min(got) == 0
    assert near_pairs(frame(spark, rows).limit(0), "id", "v").count() == 0


def test_chances():
    r = np.random.default_rng(0)
    d = r.standard_normal(200_000)  # the projected difference of points at distance 1
    for w in (1.0, 4.0):
        assert abs(np.maximum(0, 1 - np.abs(d) / w).mean() - meeting_chance(w)) < 0.01
    assert tables_needed(4.0, 8, 0.999) > tables_needed(4.0, 8, 0.9) >= 1


@pytest.mark.parametrize("cells,probe,k", [(None, 2, 5), (7, 1, 3), (1, 4, 400)])
def test_cell_index_is_exact(spark, tmp_path, cells, probe, k):
    own, rows = rows_of(4)
    own = own + [(9000, own[3][1]), (9001, own[3][1])]
    index = CellIndex.build(frame(spark, rows), "id", "v", str(tmp_path / "index"), cells=cells)
    asked = [(i, v) for i, v in own[::9]] + [(7777, None), (7778, [0.0] * 12)]
    got = {}
    for x in index.search(frame(spark, asked, "qv").withColumnRenamed("id", "qid"), "qid", "qv", k, probe).collect():
        got.setdefault(x.qid, []).append((x.rank, x.key, round(x.score, 9)))
    assert set(got) == {i for i, _ in own[::9]}
    for i, v in own[::9]:
        best = sorted((-round(float(unit(v) @ unit(u)), 9), j) for j, u in own)[:k]
        assert [(s, j) for s, j in best] == [(-s, j) for _, j, s in sorted(got[i])] or [round(-s, 6) for s, _ in best] == [round(s, 6) for *_, s in sorted(got[i])]
    if cells is None:
        assert index.read[0] < index.read[1]  # cells are left out


def test_empty_index(spark, tmp_path):
    _, rows = rows_of(5)
    index = CellIndex.build(frame(spark, rows).limit(0), "id", "v", str(tmp_path / "index"))
    assert index.search(frame(spark, rows).withColumnRenamed("id", "q"), "q", "v", 3).count() == 0


def test_search_meets_bounded_slots(spark, tmp_path, monkeypatch):
    """Blocks of queries meet slots of rows, no row for each pair; a cell of many copies is dealt into parts."""
    from lodestone.operators import vectors

    assert vectors._slots([5, 20_000, 3, 4]) == ([0, 1, 2, 2], [1, 3, 1])
    monkeypatch.setattr(vectors, "SLOT", 40)
    own, rows = rows_of(6)
    own = own + [(i, own[3][1]) for i in (9000, 9001, *range(10_000, 10_300))]
    index = CellIndex.build(frame(spark, rows + own[-300:]), "id", "v", str(tmp_path / "index"), cells=9)
    found = index.search(frame(spark, own[:100], "qv").withColumnRenamed("id", "qid"), "qid", "qv", 6, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    got = {}
    for x in found.collect():
        got.setdefault(x.qid, []).append((x["rank"], x.key))
    for i, v in own[:100]:
        best = sorted((-round(float(unit(v) @ unit(u)), 12), j) for j, u in own)[:6]
        assert [j for _, j in sorted(got[i])] == [j for _, j in best]
