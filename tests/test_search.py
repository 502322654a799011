import duckdb
import pytest

import lodestone.plans.all as plans
from lodestone.operators import search as S
from lodestone.operators.search import OverlapReranker
from lodestone.plans.search import _CHANNELS


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_rerank_takes_what_a_search_found(spark, sf):
    """The scores of the best 50 of the fused channels, over all documents, against brute force."""
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql = f"WITH one AS (SELECT 1){_CHANNELS} SELECT f.id, any_value(d.text) FROM fused f JOIN documents d ON d.doc_id = f.id GROUP BY f.id ORDER BY round(any_value(f.score), 12) DESC, f.id LIMIT 50"
    want = {i: OverlapReranker().scores("the of and in", [(text or "")[:512]])[0] for i, text in c.sql(sql).fetchall()}
    got = plans.QUERIES["rnk_02_rerank"](spark, sf).collect()
    assert len(got) == len(want) == 50 and {r.doc_id: r.rerank_score for r in got} == want
    assert max(want) >= 50  # not the smallest ids


def test_template_search_is_nearest_of_the_first_answer_that_finds(spark):
    model = S.HashingEmbedder(16)
    texts = ["a method for red rings", "we find blue bolts", "nothing", "a method that", None, "we find that red rings"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    vectors = S.embed(rows, "id", "text", model)
    templates = {"method": ["a method for {question}", "{question} is a method"], "finding": ["we find that {question}"]}
    words = {"method": ("how",), "finding": ("what",)}
    for question, mode in [("how red rings", "method"), ("what red rings", "finding"), ("red rings", "method")]:
        own, want = model.vectors(texts), {}
        for a in model.vectors([x.format(question=question) for x in templates[mode]]):
            near = sorted(((float(v @ a), -i) for i, v in enumerate(own) if v.any()), reverse=True)[:3]
            for score, i in near:
                want.setdefault(-i, score)
        want = sorted(want.items(), key=lambda x: (-round(x[1], 9), x[0]))[:3]
        got = [(r["id"], r["score"]) for r in S.template_search(question, templates, words, vectors, model, 3).collect()]
        assert [round(s, 9) for _, s in got] == [round(s, 9) for _, s in want], question
        assert {i for i, _ in got} <= set(range(6)) - {4}


def test_hybrid_cuts_each_list_and_breaks_ties_by_list(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "id long, score double")
    b = spark.createDataFrame([(4, 5.0), (2, 4.0), (5, 3.0)], "id long, score double")
    got = [(r["id"], r["first_list"]) for r in S.hybrid([a, b], "id", 2).collect()]
    assert got == [(2, 0), (1, 0)]
    assert S.hybrid([a.limit(0), b.limit(0)], "id", 2).count() == 0


def test_multi_hop_keeps_first_scores_and_boosts_bridges(spark):
    postings = spark.createDataFrame([(1, "red ring", 0.5), (2, "ring", 0.9), (3, "red ring", 0.8), (4, "nut", 1.0)], "id long, concept string, score double")
    first = spark.createDataFrame([(1, 0.4)], "id long, score double")
    families = {"metal": ("ring", "nut"), "colour": ("red",)}
    got = [(r["id"], round(r["score"], 6)) for r in S.multi_hop(first, postings, families, 5).collect()]
    assert got == [(3, 0.96), (1, 0.48)]
