import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import search as S
from lodestone.operators.text_index import TextIndex

WORDS = "alpha beta gammas delta running theta iota kappa lambda omega".split()


def texts(seed, n):
    r = random.Random(seed)
    return [(i, " ".join(WORDS[min(int(r.expovariate(0.4)), 9)] for _ in range(r.choice([1, 5, 30, 80])))) for i in range(n)]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rows = [*texts(3, 300), (300, None), (301, ""), (302, "the of")]
    df = spark.createDataFrame(rows, "id long, body string")
    index = TextIndex(spark, str(tmp_path_factory.mktemp("index")), blocks=32, buckets=4)
    assert index.segments() == [] and index.bm25(["alpha"], 3).count() == 0
    assert index.add(df.filter("id % 3 = 0"), "id", "body")
    assert index.add(df, "id", "body")  # those that are known are left
    assert index.add(df, "id", "body") is None and len(index.segments()) == 2
    return df, index


def test_statistics_and_postings(made):
    df, index = made
    n, mean = df.select(F.count("*"), F.avg(F.size(S.terms(F.coalesce("body", F.lit("")))))).first()
    assert index.statistics() == (n, pytest.approx(mean))
    want = sorted((r.id, r.places) for r in df.select("id", F.array_compact(F.transform(S.terms(F.col("body")), lambda x, i: F.when(x == "gamma", i))).alias("places")).filter("size(places) > 0").collect())
    assert sorted((r.key, r.places) for r in index.postings(["gamma"]).collect()) == want and want


@pytest.mark.parametrize("query", [["alpha"], ["omega", "kappa"], ["runn", "theta", "alpha", "alpha"], ["nowhere", "beta"], ["nowhere"]])
def test_bm25_and_best(made, query):
    df, index = made
    want = {r.id: r.score for r in S.bm25(df.fillna(""), "id", "body", query).collect()}
    got = {r.key: r.score for r in index.bm25(query).collect()}
    assert got == pytest.approx(want)
    best = [(r.key, r.score) for r in index.bm25(query, 5).collect()]
    order = sorted(got.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert [s for _, s in best] == pytest.approx([s for _, s in order]) and len({k for k, _ in best}) == len(order)
    if query == ["alpha"]:
        assert index.read[0] < index.read[1]  # blocks are skipped


def test_matches_and_covers(made):
    df, index = made
    query = ["alpha", "delta"]
    t = df.fillna("").select("id", S.terms(F.col("body")).alias("t")).filter(S.has_all_terms(F.col("t"), query))
    assert {r.key for r in index.all_terms(query).collect()} == {r.id for r in t.collect()}
    assert {r.key: r.score for r in index.cover_density(query).collect()} == {r.id: r.s for r in t.select("id", S.cover_density(F.col("t"), query).alias("s")).collect()}


def test_many_queries_in_one_plan(spark, made):
    df, index = made
    queries = [(1, ["alpha"]), (2, ["omega", "kappa", "kappa"]), (3, ["nowhere"]), (4, []), (5, ["beta", "theta"])]
    got = {}
    for r in index.search(spark.createDataFrame(queries, "q int, words array<string>"), "q", "words", 4).collect():
        got.setdefault(r.q, []).append((r["rank"], r.score))
    for q, words in queries:
        want = [r.score for r in index.bm25(words).orderBy(F.desc("score")).limit(4).collect()]
        assert [s for _, s in sorted(got.get(q, []))] == pytest.approx(want)


def test_queries_read_the_folders_of_their_terms(made):
    _, index = made
    files = index.postings(["alpha"]).inputFiles()
    plan = index.postings(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "EqualTo(term,alpha)" in plan and files


def test_texts_are_shuffled_once(spark, tmp_path):
    """Places are gathered where a document is read: what is dealt out is texts and rows of terms, never a row for each
    word. Terms are those of terms(), in other alphabets too; keys that repeat and many tasks change nothing."""
    words = "Straße ὁδός ΟΔΟΣ İstanbul flies flied kindly goings the 漢字 x²y aßed ﬁnes".split()
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(words) for _ in range(600))) for i in range(40)] + [(3, "a repeated key"), (50, None)]
    df = spark.createDataFrame(rows, "id long, body string")
    index = TextIndex(spark, str(tmp_path / "index"), blocks=8, buckets=4, task_bytes=20_000)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("add", "")
    index.add(df, "id", "body")
    jobs = list(tracker.getJobIdsForGroup("add"))
    store = spark.sparkContext._jsc.sc().statusStore()
    written = sum(store.lastStageAttempt(s).shuffleWriteRecords() for j in jobs for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s).numTasks)
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert written < 5_000  # 24,000 words
    once = df.groupBy("id").agg(F.min("body").alias("body"))
    want = once.select(F.col("id").alias("key"), F.posexplode(S.terms(F.coalesce("body", F.lit("")))).alias("p", "term")).groupBy("key", "term").agg(F.sort_array(F.collect_list("p")).alias("places"))
    got = index._read("postings", index.segments())
    assert sorted((x.key, x.term, x.places) for x in got.collect()) == sorted((x.key, x.term, x.places) for x in want.collect())
    assert index.statistics()[0] == 41 == index.docs().count()
