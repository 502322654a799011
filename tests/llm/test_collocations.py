import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import collocations as col
from lodestone.llm._text import mix
from lodestone.llm.perfect_hash import ByteKeys, NumberKeys, PerfectHash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, top=2000, most=3):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cands = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    cover = Counter()
    for (lang, w), a in cands.items():
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if 1 < j - i < len(w):
                    cover[lang, w[i:j]] = max(cover[lang, w[i:j]], a)
    out = []
    for (lang, w), a in cands.items():
        if 100 * cover[lang, w] >= 50 * a:
            continue
        score, k = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, score, a, " ".join(w), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    result = []
    for lang in sorted({x[0] for x in out}):
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))
        result += [(lang, i + 1, p, a, le, ri, nn, s) for i, (_, s, a, p, le, ri, nn) in enumerate(own[:top])]
    return sorted(result)


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, la, 1) for i, (la, t) in enumerate(rows)], "doc_id long, text string, lang string, slot int").repartition(parts)


def corpus(seed, n=200):
    r = np.random.default_rng(seed)
    words = ["a", "b", "Cé", "dd", "e e", "Ünd", "日本", "x\x00y", "#", "f-f"]
    out = []
    for _ in range(n):
        size = int(r.integers(0, 60))
        text = "".join(words[min(int(r.exponential(2)), 9)] + [" ", " ", " ", "\t ", ". ", ",", "\n", "  "][int(r.integers(0, 8))] for _ in range(size))
        out.append((["en", "de", None, "e n"][int(r.integers(0, 4))], text))
    return out


@pytest.mark.parametrize("block_keys", [2_000_000, 7])
def test_against_brute_force(spark, block_keys):
    rows = corpus(4) + [("en", None), ("de", ""), ("de", " .,\n"), ("en", "a b " * 20_000)] * 2
    got = sorted(map(tuple, col.collocations(table(spark, rows), block_keys=block_keys).collect()))
    assert got == brute(rows) and len(got) > 60


def test_top_least_and_longer_phrases(spark):
    rows = corpus(9, 120)
    got = sorted(map(tuple, col.collocations(table(spark, rows), least=4, top=7, most_words=5).collect()))
    assert got == brute(rows, 4, 7, 5)
    two = sorted(map(tuple, col.collocations(table(spark, rows), least=4, most_words=2).collect()))
    assert two == brute(rows, 4, 2000, 2)


def test_nothing_to_find(spark):
    none = table(spark, [("en", "a b")]).limit(0)
    assert col.collocations(none).collect() == []
    assert col.collocations(table(spark, [("en", "a b"), (None, None)])).collect() == []
    once = table(spark, [("en", "a. " * 30)])
    assert col.collocations(once).collect() == []


def test_tree_of_many_arrays(spark):
    rows = [(p, c, np.arange(col.CHUNK, dtype=np.int64).tobytes()) for p in range(50) for c in (0, 3)]
    df = spark.createDataFrame(rows, "part long, chunk long, body binary")
    got = {r.slot: r.f for r in col.tree_sum(df, fan=4).collect()}
    assert got == {c * col.CHUNK + i: 50 * i for c in (0, 3) for i in range(1, col.CHUNK)}


def test_perfect_hash():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        h = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        p = PerfectHash(h)
        assert sorted(p.slots(h).tolist()) == list(range(len(h)))
        keys = NumberKeys(h.view(np.int64))
        assert (keys.keys[keys.find(h.view(np.int64))] == h.view(np.int64)).all()
        other = np.setdiff1d(r.integers(0, 2**64, 500, dtype=np.uint64), h).view(np.int64)
        assert (keys.find(other) == -1).all()


def test_keys_of_one_hash_are_told_apart():
    words = [b"one", b"two", b"three", b"four", b"two"]
    body = np.frombuffer(b"".join(words), np.uint8)
    length = np.array([len(w) for w in words])
    h = mix(np.array([7, 7, 7, 9, 9], np.uint64))
    group = np.array([0, 0, 0, 0, 1], np.int32)
    begin = np.cumsum(length) - length
    keys = ByteKeys(h, group, body, length)
    assert sorted(keys.find(h, group, body, begin, length).tolist()) == list(range(5))
    assert keys.find(h[::-1].copy(), group, body, begin, length).tolist().count(-1) >= 2
