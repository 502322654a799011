import random

from lodestone.operators.containment import containing, either_way


def test_against_all_pairs(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abÄ日 ") for _ in range(r.choice([1, 2, 3, 5, 9])))
    left = [(i, x) for i, x in enumerate([word() for _ in range(60)] + [None, "", "ab", "ab"])]
    right = [(i, x) for i, x in enumerate([word() + word() for _ in range(60)] + [None, "", "xxabxx", "a" * 5000 + "b"])]
    a, b = spark.createDataFrame(left, "i int, x string"), spark.createDataFrame(right, "j int, y string")
    want = {(i, j) for i, x in left for j, y in right if x and y is not None and x in y}
    df = containing(a, "x", b, "y")
    assert sorted((r.i, r.j) for r in df.collect()) == sorted(want) and len(want) > 50
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    both = want | {(i, j) for i, x in left for j, y in right if y and x is not None and y in x}
    assert {(r.i, r.j) for r in either_way(a, "x", b, "y", q=2).collect()} == both
    assert containing(a.limit(0), "x", b, "y").count() == 0 and containing(a, "x", b.limit(0), "y").count() == 0
