import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm._text import utf8
from lodestone.llm.langid import DIM, FAMILIES, Hierarchy, features, language_id, remainder, train

WORDS = {"en": "the and of to with thing other", "de": "der und die mit nicht eine über", "fr": "le des une pour être où été", "es": "los una para con más niño año"}


def corpus(n=400, seed=1):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS[k].split()) for _ in range(r.choice([2, 20, 60]))), k) for i in range(n) for k in [r.choice(list(WORDS))]]


def test_held_out_accuracy(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, k, "junk", 1.5) for i, t, k in rows], "doc_id long, text string, lang string, x string, score double")
    got = {r.doc_id: r for r in language_id(df).collect()}
    held = [i for i, _, _ in rows if got[i].held_out]
    assert 60 < len(held) < 140
    assert sum(got[i].lang_pred == k for i, _, k in rows if got[i].held_out) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_edges(spark):
    rows = [*corpus(80), (900, None, "en"), (901, "", "en"), (902, "123 !!", "de"), (903, "é", None), (None, "the and of", "en"), (904, "the " * 50000, "en"), (5, "le des une", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by[904].lang_pred == "en" and by[903].lang_pred in WORDS and by[None].held_out
    assert language_id(df.limit(0)).count() == 0
    none = language_id(df.withColumn("lang", df["lang"].substr(50, 1)).withColumn("lang", remainder("doc_id", 4).cast("string").substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') lang"))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def slow_features(text):
    """One text, one byte after the other."""
    x = [c if c >= 128 or 97 <= c < 123 else 32 for c in text.lower().encode()]
    count = Counter()
    for k in (2, 3, 4):
        for i in range(len(x) - k + 1):
            if x[i] == x[i + 1] == 32:
                continue
            code = (x[i] * 257 + x[i + 1]) % 2**32
            for c in x[i + 2 : i + k]:
                code = (code * 0x01000193 + c) % 2**32
            count[code * 0x9E3779B1 % 2**32 >> 20] += 1
    out = np.zeros(DIM)
    for slot, n in count.items():
        out[slot] = (n / sum(count.values())) ** 0.5
    return out


def test_features_and_votes_against_brute_force():
    rows = corpus(120, 5)
    texts = [t.lower() for _, t, _ in rows] + ["", "a", "é", "x y", "  "]
    x = features(*utf8(pa.array(texts)))
    assert all(np.allclose(x[i], slow_features(t), atol=1e-6) for i, t in enumerate(texts))
    lang = np.array([k for _, _, k in rows])
    model = Hierarchy(x[: len(rows)], lang, {**FAMILIES, "es": "germanic"})  # one family has a tie of three to break
    got, score = model.predict(x)
    assert model.langs == [["de", "en", "es"], ["fr"]] and len(model.pairs) == 3
    for i in range(len(x)):
        z = x[i] @ model.w + model.b
        f = int(np.argmax(z[:2]))
        votes = {k: [0, 0.0] for k in model.langs[f]}
        for p, (fam, a, c) in enumerate(model.pairs):
            if fam == f:
                m, ka, kc = z[2 + p], model.langs[f][a], model.langs[f][c]
                votes[ka if m >= 0 else kc][0] += 1
                votes[ka][1] += m
                votes[kc][1] -= m
        best = min(votes, key=lambda k: (-votes[k][0], -votes[k][1], k))
        assert got[i] == best and 0 <= score[i] <= 1


def test_ties_go_to_the_first_name():
    x = np.zeros((4, DIM), np.float32)
    x[:2, 1] = x[2:, 2] = 1
    model = Hierarchy(x, np.array(["en", "en", "de", "de"]), FAMILIES)
    model.w[:], model.b[:] = 0, 0
    assert model.predict(x[:1])[0] == ["de"]


def test_every_language_is_learned(spark):
    r = random.Random(2)
    own = [["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(5)] for _ in range(40 - len(WORDS))]
    rows = [*corpus(200), *((1000 + 20 * i + j, " ".join(r.choice(w) for _ in range(9)), f"x{i:03d}") for i, w in enumerate(own) for j in range(20))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = train(df, max_rows=1200)
    assert len([k for ks in model.langs for k in ks]) == 40 + len({r[2] for r in corpus(200) if r[2]} - set(WORDS))
    got = {r.doc_id: r.lang_pred for r in language_id(df).collect()}
    held = [(d, la) for d, _, la in rows if d >= 1000 and zlib.crc32(str(d).encode()) % 4 == 2]
    assert sum(got[d] == la for d, la in held) > 0.95 * len(held)
    with pytest.raises(ValueError):
        train(df, max_languages=39)
