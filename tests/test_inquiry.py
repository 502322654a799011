import math
import random
import re
from collections import Counter, defaultdict

import pytest

from lodestone.operators import inquiry as I
from lodestone.operators import scoring as C
from lodestone.operators import search as S
from lodestone.operators.text_index import TextIndex

WORDS = "alpha beta gamma delta theta iota kappa lambda omega sigma tau upsilon phi chi psi rho".split()
NOES = ["not", "failed"]


def texts(n=150, seed=5):
    r = random.Random(seed)
    pool = [*WORDS, "not", "failed", "the", "of", "to"]
    return [(i, " ".join(r.choice(pool) for _ in range(r.choice([3, 8, 20])))) for i in range(n)]


TEXTS = [*texts(), (150, None), (151, ""), (152, "the of"), (153, "not"), (154, "Alpha beta. Alpha, beta!"), (155, "Alpha beta. Alpha, beta!")]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    df = spark.createDataFrame(TEXTS, "id long, body string")
    index = TextIndex(spark, str(tmp_path_factory.mktemp("index")), blocks=8, buckets=4)
    index.add(df.filter("id % 2 = 0"), "id", "body")
    index.add(df, "id", "body")
    return df, index


def words(text):
    return [w for w in re.split(r"[^a-z0-9]+", (text or "").lower()) if w]


def terms(text):
    cut = [w for w in words(text) if w not in S.STOP_WORDS]
    return [re.sub("(ingly|edly|ings|ing|ies|ied|ed|es|s|ly)$", "", w) if len(w) >= 5 else w for w in cut]


def best(asked, k):
    """[(doc, score)] by BM25 of the terms."""
    docs = {i: terms(t) for i, t in TEXTS}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for ts in docs.values() for w in set(ts))
    out = []
    for i, ts in docs.items():
        tf = Counter(ts)
        part = [m * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ts) / mean)) for w, m in Counter(asked).items() if tf[w]]
        if part:
            out.append((i, round(sum(part), 9)))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:k]


def test_bridges_have_a_term_of_each(spark, made):
    _, index = made
    pairs = [(1, "alpha beta", "gamma"), (2, "omega", "omega psi"), (3, "nowhere", "alpha"), (4, None, "alpha"), (5, "rho", ""), (6, "tau chi phi", "iota kappa")]
    got = defaultdict(list)
    for r in I.bridged(spark.createDataFrame(pairs, "q long, a string, b string"), "q", "a", "b", index, 15).orderBy("q", "rank").collect():
        got[r.q].append((r.key, round(r.score, 6)))
    docs = {i: set(terms(t)) for i, t in TEXTS}
    for q, a, b in pairs:
        want = [(d, round(s, 6)) for d, s in best(terms(a) + terms(b), 15) if docs[d] & set(terms(a)) and docs[d] & set(terms(b))]
        assert got[q] == want
    assert got[1] and got[2] and got[6] and not got[3]


def test_chains(spark, made):
    _, index = made
    seeds = [(1, "alpha", "beta gamma", "delta"), (2, "nowhere", "never", "none"), (3, None, None, None)]
    got = {r.seed: r for r in I.chains(spark.createDataFrame(seeds, "seed long, source string, area string, target string"), "seed", index).collect()}
    for seed, source, area, target in seeds:
        source, area, target = (x or "" for x in (source, area, target))
        questions = [f"{source} methods applications", f"{area} challenges {target} problems", f"{source} applied to {area}", f"{source} limitations failures"]
        hits = [best(terms(q), 10) for q in questions]
        sure = [min(0.9, len(h) / 10) if h else 0.1 for h in hits]
        r = got[seed]
        assert [(x.step, x.question, x.found) for x in r.steps] == [(s, q, len(h)) for (s, _), q, h in zip(I.STEPS, questions, hits)]
        assert [[e.doc for e in x.evidence] for x in r.steps] == [[d for d, _ in h[:3]] for h in hits]
        assert r.confidence == pytest.approx(sum(sure) / 4, abs=6e-4) and r.bridges == len(hits[2])
        assert r.feasibility == ("high" if r.bridges < 5 else "medium") and r.testability == r.feasibility
    assert got[1].bridges == 10 and got[2].confidence == 0.1


@pytest.mark.parametrize("reach", [1, 3, None])
def test_claims_are_held_against_what_they_find(spark, made, reach):
    df, index = made
    claims = [(1, "alpha beta"), (2, "omega psi rho sigma"), (3, "nowhere"), (4, None), (5, "kappa failed kappa")]
    got = {r.c: r for r in I.validated(spark.createDataFrame(claims, "c long, claim string"), "c", "claim", index, df, "id", "body", NOES, reach).collect()}
    text = dict(TEXTS)
    some = False
    for c, claim in claims:
        asked = list(dict.fromkeys(terms(claim)))
        want = []
        for d, s in best(asked, 20):
            w = words(text[d])
            noes = [i for i, x in enumerate(w) if x in NOES]
            if reach is None:
                against = bool(noes)
            else:
                against = any(terms(x) and terms(x)[0] in asked for i in noes for x in w[i + 1 : i + 1 + reach])
            want.append((d, against, s))
        r = got[c]
        assert [(e.doc, e.contradicts) for e in r.evidence] == [x[:2] for x in want]
        y, n = sum(s for _, a, s in want if not a), sum(s for _, a, s in want if a)
        assert r.found == len(want) and r.support == pytest.approx(y, abs=1e-5) and r.contra == pytest.approx(n, abs=1e-5)
        share = y / (y + n) if y + n else 0.5
        assert r.confidence == pytest.approx(share, abs=1e-5)
        assert r.status == ("supported" if share > 0.6 else "needs_investigation" if share > 0.4 else "potentially_contradicted")
        assert r.gaps == [g for g, is_ in (("little_prior_work", len(want) < 5), ("more_against_than_for", n > y)) if is_]
        some |= len({a for _, a, _ in want}) == 2
    assert some and got[3].status == "needs_investigation" and got[4].found == 0


def test_readiness_by_real_searches(spark, made):
    _, index = made
    patterns = {"predict": ("alpha", "beta"), "infer": ("gamma", "alpha", "delta")}
    rows = [(1, "domain", "alpha beta", None), (2, "domain", "nowhere", None), (3, "oblique", "Predict and infer", None), (4, "oblique", "other", None), (5, "bridge", "alpha", "gamma"), (6, "bridge", "alpha", "nowhere"), (7, "other", "alpha", None), (8, "domain", None, None)]
    hits = I.readiness_hits(spark.createDataFrame(rows, "id long, kind string, a string, b string"), "id", patterns, index)
    docs = {i: set(terms(t)) for i, t in TEXTS}
    want = {
        ("domain", 1): 10, ("domain", 2): 0, ("domain", 8): 0, ("oblique", 4): 0, ("bridge", 6): 0,
        ("oblique", 3): len({d for w in ("alpha", "beta", "gamma") for d, _ in best([w], 5)}),
        ("bridge", 5): sum({"alpha", "gamma"} <= docs[d] for d, _ in best(["alpha", "gamma"], 10)),
    }
    assert {(r.kind, r.id): r.hits for r in hits.collect()} == want and want["bridge", 5] >= 2
    got = {r.kind: (r.questions, r.passed, r.grade) for r in I.readiness(hits).collect()}
    assert got == {"domain": (3, 1, "F"), "oblique": (2, 1, "F"), "bridge": (2, 1, "F")}


def test_fusion_and_reranking_of_a_batch(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "q long, d long, rank long")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (3, 12, 1)], "q long, d long, rank long")
    fused = I.fused_batch([a, b], "q", "d", 2)
    got = sorted((r.q, r["rank"], r.d, r.first_list) for r in fused.collect())
    assert got == [(1, 1, 11, 0), (1, 2, 10, 0), (2, 1, 10, 0), (3, 1, 12, 1)]
    docs = spark.createDataFrame([(10, "red ring", 1), (11, "blue", 2), (12, None, 3)], "d long, body string, score int")
    asked = spark.createDataFrame([(1, "red ring"), (2, None), (3, "blue")], "q long, body string")
    best = I.reranked_batch(fused, "q", "d", asked, "body", docs, "body", S.OverlapReranker(), 5)
    assert sorted((r.q, r["rank"], r.d, r.rerank_score) for r in best.collect()) == [(1, 1, 10, 1.0), (1, 2, 11, 0.0), (2, 1, 10, 0.0), (3, 1, 12, 0.0)]


def test_watched_labs(spark):
    papers = spark.createDataFrame([(1, "x", 2001), (2, "x", 2001), (3, "x", None), (4, None, 1999), (5, "y", 2000)], "p long, lab string, year int")
    said = spark.createDataFrame([(1, "ring"), (2, "ring"), (2, "bolt"), (3, "Red_Ring"), (4, "nut"), (9, "ring")], "p long, concept string")
    got = {r.lab: (r.papers, [tuple(v) for v in r.velocity], r.methods) for r in C.watched(papers, said, "lab", "p", "year", "concept", 2).collect()}
    assert got == {"x": (3, [(2001, 2)], ["ring", "Red_Ring"]), None: (1, [(1999, 1)], ["nut"]), "y": (1, [(2000, 1)], [])}
    over = C.topic_overlap(papers, said, "lab", "p", "concept", ["RING", "nut", "no"])
    assert sorted(map(str, (tuple(r) for r in over.collect()))) == ["('x', 'RING', 'Red_Ring', 1)", "('x', 'RING', 'ring', 2)", "(None, 'nut', 'nut', 1)"]
