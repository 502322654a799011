import numpy as np

from lodestone.llm.embedding_dedup import embedding_near_dedup


def brute(rows):
    ok = {i for i, (_, v) in enumerate(rows) if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    link = {i: {j for j in ok if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95} if i in ok else set() for i in range(len(rows))}
    out = {}
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[d] = (len(link[i]), min(rows[x][0] for x in seen), min(rows[x][0] for x in seen) == d)
    return out


def test_against_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(16).tolist()) for i in range(150)]
    for g in range(6):
        c = r.standard_normal(16)
        rows += [(len(rows) + k, (c + 0.09 * g * r.standard_normal(16)).tolist()) for k in range(30)]
    n = len(rows)
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] + [1.0] * 15), (n + 3, [None] + [1.0] * 15), (n + 4, []), (n + 5, [1.0, 2.0]), (n + 6, [2.0, 4.0]), (n + 7, rows[0][1]), (n + 8, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, cid int")
    for block in (16, 1024):
        got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_near_dedup(df, block=block).collect()}
        assert got == brute(rows)


def test_nulls_repeats_empty(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, embedding_near_dedup(df).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)], key=str)
    assert embedding_near_dedup(df.limit(0)).count() == 0
