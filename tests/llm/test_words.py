"""Words whose hashes meet: the Thue-Morse words, which meet under any polynomial modulo 2**64, and a hash made weak."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from lodestone.llm import _text, _words, decontaminate
from lodestone.llm._text import distinct_runs, run_hashes, utf8
from lodestone.llm.byte_bpe import Codec, encode, load_ranks
from lodestone.llm.decontaminate import find_leaks, leak_digest
from lodestone.llm.rans import Words, digest

BPE = P.path("byte_bpe_50k.tiktoken")
WORD = P.path("word_bpe_49k.json")
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(BPE), special_tokens={})
LIB = Tokenizer.from_file(WORD)


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") & 1] for i in range(n))


PAIRS = [(thue_morse(n, "a", "b"), thue_morse(n, "b", "a")) for n in (1024, 2048, 4096)]


def weak(body, begin, length):
    return np.add.reduceat(body.astype(np.uint64), begin) % np.uint64(5)


@pytest.mark.parametrize("hashes", [run_hashes, weak])
def test_tables_against_the_libraries(monkeypatch, hashes):
    for m in (_text, _words):
        monkeypatch.setattr(m, "run_hashes", hashes)
    r = random.Random(5)
    texts = [w for pair in PAIRS for w in pair] + [" ".join(pair) for pair in PAIRS]
    texts += [" ".join("".join(r.choice("abcé1") for _ in range(r.randrange(1, 7))) for _ in range(200)) for _ in range(3)]
    bpe, word = Codec(BPE, P.PATTERN), Words(WORD)
    for _ in range(2):
        for t in texts:  # one batch each
            assert list(bpe.encode([t])) == [TIK.encode_ordinary(t)]
            assert word.encode(*utf8(pa.array([t])), 2)[1].tolist() == [*LIB.encode(t, add_special_tokens=False).ids, 2]
    assert list(Codec(BPE, P.PATTERN).encode(texts)) == [TIK.encode_ordinary(t) for t in texts]
    ids = Words(WORD).encode(*utf8(pa.array(texts)), 2)[1].tolist()
    assert ids == [i for t in texts for i in (*LIB.encode(t, add_special_tokens=False).ids, 2)]


def test_distinct_runs_of_one_hash(monkeypatch):
    monkeypatch.setattr(_text, "run_hashes", weak)
    body = np.frombuffer(b"abbaabcdab", dtype=np.uint8)
    _, where, back = distinct_runs(body, np.array([0, 2, 4, 6, 8]), np.full(5, 2))
    assert where.tolist() == [0, 1, 3] and back.tolist() == [0, 1, 0, 2, 0]


def test_frames(spark):
    texts = [w for pair in PAIRS for w in pair]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.ids for r in encode(df).collect()} == dict(enumerate(map(TIK.encode_ordinary, texts)))
    assert {r.doc_id: r.n_tokens for r in digest(df).collect()} == {i: len(LIB.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_leaks(spark):
    docs = spark.createDataFrame([(i, x + " and more") for i, (x, _) in enumerate(PAIRS)], "doc_id long, text string")
    items = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(PAIRS)], "item_id long, text string")
    assert all(r.n_hit == 0 for r in leak_digest(find_leaks(docs, items)).collect())


def test_leaks_by_a_weak_hash(monkeypatch):
    from tests.llm.test_decontaminate import toks

    monkeypatch.setattr(decontaminate, "run_hashes", weak)
    r = random.Random(3)
    words = ["ab", "ba", "abc", "cab", "q", "z"]
    items = [" ".join(r.choice(words) for _ in range(n)) for n in (1, 3, 10, 14, 40)]
    docs = [" ".join(r.choice(words) for _ in range(60)) + f" {r.choice(items)} " + " ".join(r.choice(words) for _ in range(30)) for _ in range(25)]
    got = decontaminate.ItemIndex(list(range(5)), pa.array(items), 10, 5).search(decontaminate.Cut(pa.array(docs)))
    found = {(row, s, n): set(it.tolist()) for row, starts, it, n in got for s in starts.tolist()}
    base = np.cumsum([0, *(len(toks(t)) for t in docs)])
    want = set()
    for row, t in enumerate(docs):
        w = toks(t)
        for item in items:
            v = toks(item)
            n = min(10, len(v))
            wins = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)}
            want |= {(row, int(base[row]) + j, n) for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in wins}
    assert set(found) == want
