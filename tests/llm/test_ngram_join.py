import random
import re

from lodestone.llm.ngram_join import common_counts, forest_depth, ngram_join


def shingles(text, k=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    link = [[i != j and bool(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(len(rows))] for i in range(len(rows))]
    out = {}
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for j, on in enumerate(link[x]):
                if on and j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[d] = (min(rows[x][0] for x in seen), sum(link[i]))
    return out


def corpus(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "straße", "x1"]
    rows = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([3, 7, 40, 120])))) for i in range(60)]
    base = [r.choice(vocab) for _ in range(100)]
    for i in range(60, 110):  # a dense group of near copies, larger than a block in the test
        w = base[:]
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, ", ".join(w)))
    rows += [(110, rows[5][1].upper()), (111, rows[5][1]), (112, ""), (113, "..."), (114, "..."), (115, "a b"), (116, "A, b!"), (117, None), (118, "w " * 3000), (119, "w " * 4000)]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, cid string, fp0 int")
    want = brute(rows)
    for block in (8, 512):
        got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join(df, block=block).collect()}
        assert got == want
    assert max(n for _, n in want.values()) > 20


def test_crowded_nodes_get_longer_prefixes_and_more_trees(spark):
    rows = corpus(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for crowd in (3, 20):
        assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_join(df, block=8, crowd=crowd).collect()} == want


def test_recall_and_near_copies_below_the_threshold(spark):
    """Every pair at the threshold or above is found, and the copies below it are told apart from lost ones."""
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    rows, below = [], 0
    for i in range(150):
        w = [r.choice(vocab) for _ in range(120)]
        v = w[:]
        for _ in range(r.choice([1, 2, 3, 4])):
            v[r.randrange(len(v))] = r.choice(vocab)
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        a, b = shingles(rows[-2][1]), shingles(rows[-1][1])
        below += 5 * len(a & b) < 4 * len(a | b)
    got = {x.doc_id: x.n_links for x in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 20 < below < 130 and sum(got.values()) == 2 * (150 - below)


def test_words_of_one_polynomial_hash(spark):
    t = lambda n, a, b: "".join((a, b)[bin(i).count("1") & 1] for i in range(n))
    df = spark.createDataFrame([(i, x) for n in (1024, 2048, 4096) for i, x in ((n, t(n, "a", "b")), (n + 1, t(n, "b", "a")))], "doc_id long, text string")
    assert all(x.n_links == 0 and x.kept for x in ngram_join(df).collect())


def test_nulls_repeats_empty(spark):
    t = " ".join(f"q{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t + " z"), (3, None), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join(df).collect()), key=str)
    assert got == sorted([(None, None, 0, True), (1, 1, 2, True), (1, 1, 2, True), (2, 1, 2, False), (3, 3, 0, True), (None, None, 0, True)], key=str)
    assert ngram_join(df.limit(0)).count() == 0


def test_depth_and_counts():
    import numpy as np

    assert forest_depth(0.8, 16, 8, 0.9995) == 4 and forest_depth(0.8, 1, 8, 0.9) == 1
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 40).astype(np.uint64)) for _ in range(9)]
    got = common_counts(sets)
    assert all(got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist())) for i in range(9) for j in range(9) if i != j)
