"""Expressions and operators on literal rows."""

import uuid

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import chunking, concepts, identity, text
from lodestone.operators import atlas, evidence, graph, relational, scoring, search


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("name", ["", "doi:10.1/x", "Größe 漢字", "a" * 300])
def test_uuid5(spark, name):
    assert one(spark, identity.uuid5(F.lit(name)), identity.uuid5(F.lit(name), identity.URL))[:] == (str(uuid.uuid5(uuid.NAMESPACE_DNS, name)), str(uuid.uuid5(uuid.NAMESPACE_URL, name)))


def test_document_key(spark):
    n = F.lit(None).cast("string")
    key = lambda *a: one(spark, identity.doc_key(*(F.lit(x).cast("string") if x is not None else n for x in a)))[0]
    assert key(" 10.1/AB ", "1", None, None, None, None) == "doi:10.1/ab"
    assert key("", "12", "2101.1v2", None, None, None) == "pmid:12" and key(None, None, "2101.00001v2", None, None, None) == "arxiv:2101.00001"
    assert key(None, None, None, "A Title!", "2020", None) == key(None, None, None, "a  title", "2020", " ") and key(None, None, None, "t", "2020", "X").endswith("|y:2020|a:x")


def test_repositories(spark):
    assert one(spark, identity.repos_in(F.lit("github.com/a/b.git, https://github.com/c/d. github.com/a/b")))[0] == ["a/b", "c/d"]


def test_repair_and_quality(spark):
    fix = lambda s: one(spark, text.soft_repair(F.lit(s)))[0]
    assert fix("One.Two,three  fourFive") == "One. Two, three four Five" and fix("plain text") == "plain text"
    q = lambda s: one(spark, text.text_quality(F.lit(s)))[0]
    good = q("This is a clean sentence with proper spacing between all of its words.")
    assert (good.label, good.score) == ("clean", 1.0)
    assert q("too short").label == "short" and q("too short").score == 0.0
    assert q("thisisonelongrunofletterswithoutanyblankatall" * 3).label == "no_space"
    assert one(spark, text.match_form(F.lit("A, b-C!")))[0] == "abc"
    assert one(spark, text.snake_case_strict(F.lit("The Graph of Models"), {"graph_models": "graph_model"}))[0] == "graph_model"


def test_json_in_chatter(spark):
    got = lambda s: one(spark, F.try_variant_get(text.json_in(F.lit(s)), "$.a", "int"))[0]
    assert got('{"a": 1}') == 1 and got('Sure:\n```json\n{"a": 2}\n```') == 2 and got('I say {"a": 3} so') == 3 and got("none") is None


def test_evidence_class(spark):
    def kind(surface, context, raw, conf):
        return one(spark, concepts.evidence_class(F.lit(surface), F.lit(context), F.lit(raw), F.lit(conf)))[0]

    raw = "We used a Graph Network here."
    assert kind("Graph Network", "a Graph Network here", raw, 0.5) == "literal"
    assert kind("graph-network", "A graph network, here", raw, 0.5) == "normalized"
    assert kind("other", "thing", raw, 0.95) == "inferred" and kind("other", "thing", raw, 0.5) is None and kind("", "", raw, 0.5) is None


def test_sentences_and_spans(spark):
    t = "First one is here. Second one?  Third thing! No"
    s = one(spark, chunking.sentences(F.lit(t)))[0]
    assert [x.text for x in s] == ["First one is here.", "Second one?", "Third thing!"] and all(t[x.start :].startswith(x.text) for x in s)
    words = " ".join(f"Word{i} is here." for i in range(400))
    for cut in (chunking.sentence_spans(words), chunking.page_spans(words)):
        assert cut[0][0] == 0 and cut[-1][1] == len(words) and all(a < b for a, b in cut)
        assert all(x[1] >= y[0] for x, y in zip(cut, cut[1:]))
    assert chunking.page_spans("   ") == [] and chunking.sentence_spans("tiny") == []


def test_python_chunks(spark):
    src = 'import os\n\nclass A(B):\n    """Doc."""\n    async def m(self, x: int = 1) -> str:\n        return os.sep\n\ndef f(): pass\n'
    df = spark.createDataFrame([(1, src), (2, "not ( python"), (3, None)], "id int, src string")
    got = {(r.kind, r.name): r for r in chunking.python_chunks(df, "id", "src").collect()}
    assert set(got) == {("module", ""), ("class", "A"), ("method", "m"), ("function", "f")}
    assert got["method", "m"].signature == "async def m(self, x: int=1) -> str" and got["method", "m"].class_name == "A" and got["class", "A"].docstring == "Doc."


def test_rank_fusion_does_not_depend_on_order(spark):
    a = spark.createDataFrame([("a", 1), ("b", 2)], "id string, rank int")
    b = spark.createDataFrame([("b", 1), ("c", 2)], "id string, rank int")
    x, y = ({r.id: r.score for r in search.rank_fusion(z, "id").collect()} for z in ([a, b], [b, a]))
    assert x == y and max(x, key=x.get) == "b" and abs(x["a"] - 1 / 61) < 1e-12


def test_cover_density(spark):
    d = lambda words, q: one(spark, search.cover_density(F.array(*map(F.lit, words)), q))[0]
    assert d(["a", "x", "b", "a", "b"], ["a", "b"]) == 0.5 and d(["a", "x"], ["a", "b"]) == 0.0 and d(["x", "a"], ["a"]) == 1.0


def test_upserts_twice_are_once(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 2)], "k int, v string, at int")
    first = relational.upsert_last(old, new, ["k"], "at")
    assert sorted(first.collect()) == sorted(relational.upsert_last(first, new, ["k"], "at").collect()) == [(1, "a", 1), (2, "c", 2), (3, "d", 2)]


def test_ranked_over_partitions(spark):
    df = spark.range(0, 1000, 1, 7).select(((F.col("id") * 37) % 1000).alias("x"))
    assert sorted((r["x"], r["rank"]) for r in relational.ranked(df, [F.desc("x")]).collect()) == [(i, 1000 - i) for i in range(1000)]


def brute_betweenness(edges):
    nodes = sorted({x for e in edges for x in e})
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in nodes}
    out = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, count, order = {s: 0}, {s: 1}, [s]
        for x in order:
            for y in near[x]:
                if y not in dist:
                    dist[y], count[y] = dist[x] + 1, 0
                    order.append(y)
                if dist[y] == dist[x] + 1:
                    count[y] += count[x]
        dep = dict.fromkeys(nodes, 0.0)
        for x in reversed(order):
            for y in near[x]:
                if dist.get(y) == dist[x] + 1:
                    dep[x] += count[x] / count[y] * (1 + dep[y])
        for x in order[1:]:
            out[x] += dep[x]
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2)) for k, v in out.items()}


@pytest.mark.parametrize("most", [5_000_000, 0])
def test_betweenness(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "BROADCAST_EDGES", most)
    r = np.random.default_rng(4)
    edges = sorted({tuple(sorted(map(int, r.choice(14, 2, replace=False)))) for _ in range(20)})
    edges = [(str(a), str(b)) for a, b in edges]
    got = {x.node: x.betweenness for x in graph.betweenness(spark.createDataFrame(edges, "src string, dst string")).collect()}
    want = brute_betweenness(edges)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_paths(spark):
    e = graph.both_ways(spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5)], "a long, b long"))
    assert graph.shortest_path(e, 1, 5, 4).collect()[0][:] == ([1, 2, 3, 5], 3)
    assert graph.shortest_path(e, 1, 9, 4).count() == 0


def test_greedy_distinct():
    h = [{"i": [f"a{k}", "x"]} for k in range(3)] + [{"i": ["a0", "a1"]}, {"i": ["new", "x"]}]
    assert atlas.greedy_distinct(h, "i", most=10, free=3) == [*h[:3], h[4]]


def test_normal_pmi_is_bounded(spark):
    rows = [(i, f"f{j}", f"c{j}", "t", 0.9) for i in range(40) for j in range(3) if (i * 7 + j * 3) % 4]
    got = atlas.field_overlap(spark.createDataFrame(rows, "passage_id int, field string, concept string, concept_type string, confidence double")).collect()
    assert got and all(-1 <= r.npmi <= 1 for r in got)


def test_gate_and_scores(spark):
    rows = spark.createDataFrame([(1, 0.9, 0.1, 1), (2, 0.9, 0.8, 1), (3, 0.4, 0.0, 1), (4, 0.9, 0.1, -1)], "id int, entailment double, contradiction double, page_num int")
    assert [r.id for r in evidence.gated(rows).collect()] == [1]
    assert one(spark, scoring.trust(F.array(F.lit("Known Name")), ["known name"], ["lab"], F.lit("A Lab")))[0] == 0.95


def test_only_reads(spark):
    assert relational.read_only(spark, "SELECT 1") and not relational.read_only(spark, "DROP TABLE x")


def test_read_only_refuses_files(spark):
    ask = lambda s, t=None: relational.read_only(spark, s, t)
    for s in ("SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM parquet.`x`", "SELECT 1 WHERE 1 IN (SELECT a FROM text.`x`)", "WITH c AS (SELECT * FROM json.`x`) SELECT * FROM c", "SELECT * FROM a.b"):
        assert not ask(s) and not ask(s, ["a", "c"])
    assert ask("SELECT * FROM a.b", ["A.b"]) and ask("SELECT * FROM a JOIN b") and not ask("SELECT * FROM a JOIN b", ["a"])
    assert ask("WITH c AS (SELECT * FROM a), d AS (SELECT * FROM c) SELECT * FROM d JOIN a", ["a"])


def test_read_only_walks_the_whole_statement(spark):
    refused = ["WITH a AS (SELECT 1 AS n) INSERT INTO t SELECT * FROM a", "FROM v INSERT INTO a SELECT * INSERT INTO b SELECT *", "REFRESH TABLE x", "SELECT reflect('java.lang.System', 'exit', '1')", "SELECT (SELECT max(java_method('a', 'b')) FROM t) FROM u", "SELECT own.secret(1)", "WITH a AS (SELECT reflect('a', 'b') AS n) SELECT * FROM a", "SET x = 1", "CACHE TABLE t", "SELECT * FROM no_such_function(1)"]
    allowed = ["SELECT a, count(*) AS n FROM t JOIN u USING (a) WHERE a IN (SELECT b FROM v) GROUP BY a HAVING count(*) > 1 ORDER BY n DESC LIMIT 3", "WITH a AS (SELECT 1 AS n) SELECT n FROM a UNION ALL SELECT 2", "SELECT row_number() OVER (PARTITION BY a ORDER BY b) FROM t", "SELECT * FROM range(5)", "SELECT x FROM t LATERAL VIEW explode(xs) e AS x"]
    assert [relational.read_only(spark, s) for s in refused + allowed] == [False] * len(refused) + [True] * len(allowed)


def test_ranked_keeps_all_wide_rows_and_their_ranks(spark, tmp_path):
    """Written ranks of rows that are wider than their sort keys, with many partitions that are coalesced or not."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 48)
        for i, (coalesce, size) in enumerate((("true", "4m"), ("true", "64m"), ("false", "64m"))):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
            df = spark.range(120_000).select(F.xxhash64("id").alias("k"), "id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("wide"))
            relational.ranked(df, [F.desc("k"), F.asc("id")]).write.parquet(f"{tmp_path}/{i}")
            got = spark.read.parquet(f"{tmp_path}/{i}")
            w = Window.orderBy(F.desc("k"), "id")
            bad = got.withColumn("want", F.row_number().over(w)).filter("want <> rank OR wide IS NULL").count()
            assert (got.count(), bad) == (120_000, 0)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from lodestone.operators import scratch

    alone = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://x:1", applicationId="a", getConf=lambda: SimpleNamespace(get=lambda k: None)))
    with pytest.raises(ValueError):
        scratch.scratch_dir(alone)
    assert scratch.materialise(spark.range(3)).count() == 3


def test_quotes_are_found_whatever_their_case(spark, tmp_path):
    """ß has no capital of one letter, and a sigma is folded alike inside a word and at its end."""
    import duckdb

    import lodestone.plans.all as plans

    body = " und so weiter, damit der Text lang genug ist, um hier zu gelten, bis an sein Ende"
    texts = ["Die Straße ist weiß" + body, "Ende ΟΔΟΣ und ﬁn ŉ İ ᾳ" + body, "so ὁδός nicht, und ı auch nicht" + body, "plain text" + body]
    rows = [(i + 1, x, "en") for i, x in enumerate(texts)] + [(10, texts[0], "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    for t in "customer orders lineitem part supplier events".split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in plans.QUERIES["qa_07_quotes_in_passages"](spark, str(tmp_path)).collect()]
    assert got == db.sql(plans.ORACLE["qa_07_quotes_in_passages"]).fetchall() == [(5, 3)]


def test_chunks_are_handed_on_as_they_come(spark):
    """However many texts a batch has, and however long they are, few chunks are held."""
    import pyarrow as pa

    class Kept:
        dtypes = [("id", "bigint")]
        select = withColumnRenamed = lambda self, *a: self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    body = "some words that fill a page " * 40_000
    batch = pa.RecordBatch.from_pydict({"key": [7, None, 9, 10], "text": [body, body, None, "short"]})
    out = list(chunking.page_chunks(Kept(), "id", "text").run(iter([batch])))
    assert len(out) > 2 and max(b.nbytes for b in out) < 2_000_000
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows == [(k, i, a, b, t[a:b]) for k, t in ((7, body), (None, body), (10, "short")) for i, (a, b) in enumerate(chunking.page_spans(t))]
