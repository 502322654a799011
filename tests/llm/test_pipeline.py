import hashlib
import random
import re

import corpus_pipeline as cp
import public_tokenizers as P
import tiktoken

from lodestone.llm import pii
from lodestone.llm.byte_bpe import load_ranks
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_langid import WORDS
from tests.llm.test_ngram_join import brute as groups


def corpus():
    r = random.Random(6)
    rows = []
    for i in range(90):
        k = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[k].split()) + r.choice("abcdefgh") for _ in range(r.choice([8, 30, 60]))), k))
    for i in range(90, 110):
        t = rows[r.randrange(60)][1]
        rows.append((i, t if i % 2 else t + " tail", "en"))
    rows += [(200, None, "en"), (201, "", "en"), (202, "12 !!", "de"), (203, "one or two words", None), (204, "mail jo.do@site.example.com or 10.1.2.3 the and of", "en")]
    items = [(1, " ".join(rows[7][1].split()[:12]) + " more words in it"), (2, "nowhere to be found in this corpus at all, not a single word of it"), (3, None)]
    return [(d, t, k, "s", 0) for d, t, k in rows], items


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    sf = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    own = [(d, t) for d, t, *_ in rows if t and re.search("[a-z]", t)]
    assert set(kept["language"]) == {d for d, _ in own} and kept["language"][203].lang in WORDS
    own = [(d, t) for d, t in own if groups(own)[d][0] == d]
    assert set(kept["near_duplicates"]) == {d for d, _ in own}
    bad = {x[0] for x in leaks(own, items) if x[5]}
    assert bad and set(kept["decontaminate"]) == {d for d, _ in own} - bad
    model = pii.train(spark.read.parquet(f"{sf}/decontaminate"))
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for d, t in own:
        if d in bad:
            continue
        clean = pii.redact_text(t, pii.reconcile(t, pii.base_spans(t), model.spans([t])[0]))
        assert kept["personal_data"][d].text == clean and kept["personal_data"][d].n_chars == len(clean)
        ids = lib.encode_ordinary(clean)
        assert kept["tokens"][d][1:] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(clean.encode()).hexdigest())
    assert kept["personal_data"][204].text.startswith("mail [EMAIL] or [IP]")
    assert {r.doc_id for r in cp.run(spark, sf).collect()} == set(kept["tokens"])


def test_language_without_labels(spark):
    """Without a label to learn from, only null texts and those without a letter are rejected."""
    rows = [(1, "some words", None, "s", 10), (2, None, None, "s", 0), (3, "12 !!", None, "s", 5), (4, "é", None, "s", 1), (None, "слово", None, "s", 5), (6, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {tuple(r) for r in cp.language(spark, docs, "").collect()} == {rows[0], rows[3], rows[4]}


def test_no_text_of_a_repeated_doc_id_is_lost(spark):
    """Rows that differ are documents of their own: one of each group of near copies stays, with the smallest doc_id."""
    r = random.Random(11)
    base = [" ".join(f"{c}{r.randrange(10_000)}" for _ in range(40)) for c in "abcdef"]
    a, b, c = base[:3]
    tables = [[(3, a), (5, a + " one"), (5, b), (7, c)]]
    for _ in range(2):
        tables.append([(r.randrange(12), r.choice(base) + r.choice(["", " one", " two", " three four five six seven eight nine ten eleven twelve thirteen"])) for _ in range(40)])
    for rows in tables:
        docs = spark.createDataFrame([(d, x, "en", "s", 1) for d, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
        got = [(x.doc_id, x.text) for x in cp.near_duplicates(spark, docs, "").collect()]
        own = sorted(set(rows))
        part = {i: least for i, (least, _) in groups([(i, x) for i, (_, x) in enumerate(own)]).items()}
        least = {}
        for i, (d, _) in enumerate(own):
            least[part[i]] = min(least.get(part[i], d), d)
        assert len(got) == len(set(got)) == len(least)
        at = {row: i for i, row in enumerate(own)}
        assert sorted((part[at[x]], x[0]) for x in got) == sorted(least.items())


def test_repeats_nulls_empty_clashing_columns_and_long_texts(spark, tmp_path):
    """Other texts of one doc_id stay, equal rows and near copies stay once, whatever other columns there are."""
    t = " ".join(f"q{i}" for i in range(60))
    other = " ".join(f"z{i}" for i in range(60))
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, t), (1, t), (1, t + " tail"), (1, other), (2, t + " more"), (3, long), (4, long + " end"), (None, t), (5, None), (6, "")]
    docs = spark.createDataFrame([(d, x, "en", "s", 1, 7, "k") for d, x in rows], "doc_id long, text string, lang string, source string, n_chars long, cid int, kept string")
    got = sorted(((r.doc_id or 0, r.text or "") for r in cp.near_duplicates(spark, docs, "").collect()), key=str)
    assert got in (sorted([(1, x), (1, other), (3, long), (0, t), (5, ""), (6, "")], key=str) for x in (t, t + " tail"))
    bench = spark.createDataFrame([(1, "zz " * 12)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = docs.limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
    stages = dict(cp.STAGES)
    assert stages["decontaminate"](spark, docs, str(tmp_path)).count() == len(rows)
    assert sorted(str(r.doc_id) for r in stages["tokens"](spark, docs, "").collect()) == sorted(str(d) for d, _ in rows)
    assert stages["language"](spark, docs, "").columns == cp.COLUMNS
