import re
import uuid
from collections import defaultdict

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm.byte_bpe import load_ranks
from lodestone.llm.queries import QUERIES
from lodestone.llm.token_rollup import RollupStore, counted, tokens_of


def rows(df):
    return sorted(map(tuple, df.select("source", "lang", "tokenizer", "n_docs", "n_tokens").collect()), key=str)


def test_store(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "s", "en", 9), (2, None, "s", "en", 9), (3, "d  e", None, "de", 9), (4, "", "s", None, 9)], "doc_id long, text string, source string, lang string, n_tokens int")
    text = F.coalesce("text", F.lit(""))
    by = {"w": F.regexp_count(text, F.lit("[a-z]+")), "q": F.ceil(F.length(text) / 4)}
    store = RollupStore(spark, f"{tmp_path}/{uuid.uuid4().hex}")
    assert rows(store.totals()) == []
    assert store.commit("a", counted(docs, by)) and not store.commit("a", counted(docs, by))
    first = [("s", "en", "w", 2, 3), ("s", "en", "q", 2, 2), (None, "de", "w", 1, 2), (None, "de", "q", 1, 1), ("s", None, "w", 1, 0), ("s", None, "q", 1, 0)]
    assert rows(store.totals()) == sorted(first, key=str)
    assert store.commit("b", counted(docs.filter("doc_id = 3"), by, -1)) and store.commit("none", counted(docs.limit(0), by))
    store.compact()
    want = sorted((r for r in first if r[0]), key=str)
    assert rows(store.totals()) == want and store.batches() == ["a", "b", "none"]
    assert not store.commit("b", counted(docs, by)) and rows(store.totals()) == want
    assert store.commit("c", counted(docs.filter("doc_id = 1"), by))
    store.compact()
    assert ("s", "en", "w", 3, 6) in rows(store.totals())
    with pytest.raises(ValueError):
        store.commit("../x", docs)


def test_concurrent_commits_and_compactions_count_once(spark, tmp_path, monkeypatch):
    """Two jobs that both saw no batch write it once; a batch committed during a compaction counts once."""
    docs = spark.createDataFrame([(1, 5, "s", "en")], "doc_id long, n long, source string, lang string")
    a, b = (RollupStore(spark, f"{tmp_path}/store") for _ in range(2))
    with monkeypatch.context() as m:
        m.setattr(RollupStore, "batches", lambda self: [])
        assert a.commit("x", counted(docs, {"t": F.col("n")})) and not b.commit("x", counted(docs, {"t": F.col("n")}))
    assert rows(a.totals()) == [("s", "en", "t", 1, 5)]
    sums = RollupStore._sums

    def late(self, at, names):
        monkeypatch.setattr(RollupStore, "_sums", sums)
        b.commit("y", counted(docs, {"t": F.col("n")}))
        return sums(self, at, names)

    monkeypatch.setattr(RollupStore, "_sums", late)
    assert a.compact() and a.batches() == ["x", "y"] and rows(a.totals()) == [("s", "en", "t", 2, 10)]
    assert a.compact() and rows(b.totals()) == [("s", "en", "t", 2, 10)]
    spark.read.parquet(f"{a.path}/deltas/x").write.parquet(f"{a.path}/aside/broken")  # a job that ended before its rename
    assert rows(a.totals()) == [("s", "en", "t", 2, 10)]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    byte = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    word = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    least = {}
    for d in docs:
        if d.text is not None:
            least[d.text] = min(least.get(d.text, d.doc_id), d.doc_id)
    total = defaultdict(lambda: [0, 0])
    for d in docs:
        if d.text is None or least[d.text] == d.doc_id:
            text = re.sub("[ \t\n\r]+", " ", d.text).strip(" ") if d.lang == "de" and d.text else d.text or ""
            for v, n in (("byte_bpe_50k", len(byte.encode_ordinary(text))), ("word_bpe_49k", len(word.encode(text, add_special_tokens=False).ids))):
                total[d.source, d.lang, v][0] += 1
                total[d.source, d.lang, v][1] += n
    assert rows(QUERIES["op2_token_counts"](spark, sf)) == sorted(((*k, *v) for k, v in total.items()), key=str)


def test_tokens_of_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "x", 3), (None, "", "x", 3), (1, "two words", "x", 3), (1, "two words", "x", 3)], "doc_id long, text string, ids string, n int")
    got = sorted(map(tuple, tokens_of(df, {"a": "text"}, ["doc_id", "n"]).collect()), key=str)
    assert got == sorted([(1, 3, 0, 0), (None, 3, 0, 0), (1, 3, 2, 2), (1, 3, 2, 2)], key=str)
    assert tokens_of(df.limit(0), {"a": "text"}, ["doc_id"]).count() == 0
