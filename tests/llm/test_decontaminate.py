import hashlib
import random
import re

import pytest

from lodestone.llm.decontaminate import find_leaks, leak_digest, without_leaks


def toks(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = []
    for d, t in docs:
        w, hit, found = toks(t), set(), set()
        for i, b in items:
            v = toks(b)
            n = min(10, len(v))
            if not n:
                continue
            wins = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
            at = [j for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in wins]
            hit |= {j + k for j in at for k in range(n)}
            if at and i is not None:
                found.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_words", [60, 8_000_000])
def test_against_brute_force(spark, block_words):
    r = random.Random(2)
    vocab = [f"v{i}" for i in range(30)] + ["É", "ñu", "the"]
    text = lambda n: r.choice([" ", ", "]).join(r.choice(vocab) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 9, 10, 11, 25, 60]))) for i in range(25)] + [(30, ""), (31, None), (None, text(30)), (32, "a a a a a a a a a a a a"), (2, text(12))]
    docs = []
    for d in range(80):
        w = toks(text(r.choice([0, 4, 9, 10, 50, 200])))
        for _ in range(r.choice([0, 1, 2])):
            src = toks(r.choice(items)[1])
            a = r.randrange(len(src) + 1)
            at = r.randrange(len(w) + 1)
            w[at:at] = src[a : a + r.choice([9, 10, 11, 40])]
        docs.append((d, " ".join(w).upper() if d % 7 == 0 else "; ".join(w)))
    docs += [(90, None), (91, ""), (92, "a " * 2000), (93, docs[3][1]), (93, docs[3][1]), (None, docs[4][1])]
    dd = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item_id int, items string")
    bb = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, leak_digest(find_leaks(dd, bb, block_words=block_words)).collect()), key=str)
    assert got == brute(docs, items)
    kept = without_leaks(dd, bb, block_words=block_words)
    assert kept.columns == dd.columns and sorted(map(tuple, kept.select("doc_id", "text").collect()), key=str) == sorted(((d, t) for d, t in docs if not brute([(d, t)], items)[0][5]), key=str)


def test_empty(spark):
    dd = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bb = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert leak_digest(find_leaks(dd, bb.limit(0))).first().n_hit == 0
    assert find_leaks(dd.limit(0), bb).count() == 0
    assert leak_digest(find_leaks(dd, bb)).first().n_hit == 3
