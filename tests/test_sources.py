"""Readers and writers on small files, and plans that must look as meant."""

import json

from pyspark.sql import functions as F

import lodestone.plans.all as plans
from lodestone.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def explained(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_repository(spark, tmp_path):
    body = "def f():\n    return 'some source text that is long enough to count'\n"
    for p in ("a.py", "b.min.js", "node_modules/c.js", "d.txt", "sub/e.sql"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(body)
    (tmp_path / "short.py").write_text("x = 1")
    got = {r.path.rsplit("/", 1)[-1]: r.language for r in readers.repository(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "python", "e.sql": "sql"}


def test_notebooks_and_subtitles(spark):
    book = json.dumps({"cells": [{"cell_type": "code", "source": ["a = 1\n", "b"]}, {"cell_type": "markdown", "source": "# T"}, {"cell_type": "code", "source": []}, {"cell_type": "raw", "source": "x"}]})
    df = spark.createDataFrame([(1, book), (2, "broken"), (3, None)], "id int, text string")
    assert sorted((r.id, r.n, r.kind, r.source) for r in readers.notebook_cells(df, "id", "text").collect()) == [(1, 0, "code", "a = 1\nb"), (1, 1, "markdown", "# T")]
    vtt = "WEBVTT\nKind: captions\n\n00:01.000 --> 00:02.000\n<c>hello</c>\nhello\n\n2\n00:02.000 --> 00:03.000\nworld\nhello\n"
    got = readers.subtitle_lines(spark.createDataFrame([(1, vtt)], "id int, t string"), "id", "t").orderBy("n").collect()
    assert [r.line for r in got] == ["hello", "world", "hello"]


def test_feeds():
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>7</id><title> A\n b </title><author><name>N</name></author><link href="u"/></entry></feed>'
    assert readers.atom_items("x", atom) == [("x", "7", "A b", None, ["N"], None, "u", None, {})]
    body = json.dumps({"collection": [{"doi": "10.1/a", "title": "T", "date": "2024-01-01", "authors": "A, B; C, D", "version": 2}]})
    s, i, t, _, a, d, _, doi, meta = readers.rest_items("p", "preprints", body)[0]
    assert (s, i, t, a, d, doi, meta["version"]) == ("p", "10.1/a", "T", ["A, B", "C, D"], "2024-01-01", "10.1/a", "2")
    assert readers.rest_items("p", "papers", '{"data": null}') == []


def test_versioned_table(spark, tmp_path):
    t = sinks.VersionedTable(spark, str(tmp_path / "t"), "k int, v string, at int")
    rows = lambda *r: spark.createDataFrame(list(r), t.schema)
    assert t.read().count() == 0
    t.upsert(rows((1, "a", 1), (2, "b", 1)), ["k"], "at")
    t.upsert(rows((2, "c", 2), (2, "old", 0)), ["k"], "at")
    t.insert_ignore(rows((1, "no", 9), (3, "y", 2), (3, "x", 1)), ["k"], "at")
    want = [(1, "a", 1), (2, "c", 2), (3, "x", 1)]
    assert sorted(map(tuple, t.read().collect())) == want
    t.insert_ignore(rows((3, "x", 1)), ["k"], "at")
    t.delete(rows((1, "", 0)), ["k"])
    assert sorted(map(tuple, t.read().collect())) == want[1:]
    (tmp_path / "t" / "v9").mkdir()  # a version that was broken off
    assert sorted(map(tuple, t.read().collect())) == want[1:]


def test_report(spark):
    out = sinks.markdown_table(spark.createDataFrame([(1, "a")], "n int, s string"), "T")
    assert out.startswith("## T") and "| 1 | a |" in out


def test_scan_is_pruned_and_pushed_down(spark):
    said = explained(plans.QUERIES["src_02_parquet_scan"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in said and "GreaterThan(l_quantity,45.0)" in said


def test_no_products_and_partial_top_k(spark):
    for name in ("jn_03_concepts_passages_documents", "jn_10_semi_correlated", "jn_25_prefix_or_hash", "atl_09_evidence_passages", "agg_05_relational_division"):
        said = explained(plans.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in said, name
    assert "WindowGroupLimit" in explained(plans.QUERIES["atl_09_evidence_passages"](spark, SF))
    assert "TakeOrderedAndProject" in explained(plans.QUERIES["agg_01_top_counts"](spark, SF))


def test_aggregates_stay_in_codegen(spark):
    df = plans.QUERIES["jn_14_self_join_pairs"](spark, SF)
    assert "Python" not in explained(df) and df.groupBy().agg(F.sum("n")).first()[0] > 0
