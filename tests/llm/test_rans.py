import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm._text import utf8
from lodestone.llm._spark import scratch_dir
from lodestone.llm.rans import SCALE_BITS, Shard, digest, encode_shard, read_shards, scaled, words_of, write_shards

PATH = P.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)
OWN = words_of(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=400), st.sampled_from([1, 4, 8]), st.sampled_from([2, 8, 16]))
def test_round_trip(ids, lanes, steps):
    x = np.array(ids, dtype=np.uint32)
    s = Shard(encode_shard([1, None], np.array([len(x), 0]), x, lanes, steps, 2))
    assert s.ids().tolist() == ids and s.doc_ids == [1, None] and s.counts.tolist() == [len(x), 0]


def test_size_checkpoints_checksums():
    r = np.random.default_rng(2)
    x = np.minimum(r.geometric(0.02, 300_000), 40_000).astype(np.uint16)
    data = encode_shard([0], np.array([len(x)]), x, 64, 512, 100)
    p = np.bincount(x) / len(x)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(x) / 8
    s = Shard(data)
    assert (s.ids() == x).all()
    notes = sum(8 * 64 * (1 + len(s._parts(b)[2])) for b in range(len(s.blocks)))
    assert len(data) - notes < 1.02 * entropy + 2000
    for b in range(len(s.blocks) - 1):
        for m in range(5):
            assert (s.from_checkpoint(b, m) == x[b * 64 * 512 + (m + 1) * 100 * 64 : (b + 1) * 64 * 512]).all()
    for a, b in ((0, 1), (5, 5), (64 * 100 - 1, 64 * 512 + 3), (200_000, 300_000)):
        assert (s.between(a, b) == x[a:b]).all()
    broken = bytearray(data)
    broken[-5] ^= 1
    with pytest.raises(ValueError):
        Shard(bytes(broken)).ids()


def test_scaled():
    r = np.random.default_rng(3)
    for n in (1, 5, 40_000):
        f = scaled(r.integers(1, 5 if n > 100 else 10**9, n))
        assert f.sum() == 1 << SCALE_BITS and f.min() >= 1


TEXTS = ["", "Hello, World! it's 12 o'clock.", "a<|endoftext|>b. <|startoftext|>", "x\x1cy \x1d z\u0085q", "ÉTÉ straße İstanbul ΣΑΣ é. 漢字 😀", "### token### 123$$$", "don't. 's 's! A'S", "w." * 500, "a ́b", "AB.,!", "1.2.3", "(x).", "ªb² ½.", "<|ENDOFTEXT|> <|endoftext|>, x<|startoftext|>", "I\u0307.I\u0307 e\u0301, .\u0301"]


def want(t):
    return [*LIB.encode(t, add_special_tokens=False).ids, 2]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAbs't.,!?*$#%& \n\t\x1c é1<|>_-"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_words_as_library(texts):
    n, ids = OWN.encode(*utf8(pa.array(texts, pa.string())), 2)
    assert ids.tolist() == [i for t in texts for i in want(t)] and n.tolist() == [len(want(t)) for t in texts]


def test_frames(spark):
    r = random.Random(1)
    rows = [(i * 3, " ".join(r.choice(["alpha", "Beta,", "gamma.", "x1"]) for _ in range(r.randrange(60)))) for i in range(200)]
    rows += [(1000 + i, t) for i, t in enumerate(TEXTS)] + [(5000, None), (9, "again"), (9, "again"), (None, "null id")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, ids int")
    got = sorted(map(tuple, digest(df).collect()), key=lambda x: x[1])
    start, exp = 0, []
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, np.array(want(x[1] or ""), dtype=OWN.kind).tobytes())):
        x = want(t or "")
        exp.append((d, start, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())))
        start += len(x)
    assert got == exp
    out = scratch_dir(spark)
    write_shards(df, out, part_bytes=2000, shard_ids=700)
    shards = [Shard(r.payload) for r in spark.read.parquet(out).collect()]
    assert len(shards) > 5 and sorted(map(tuple, read_shards(spark, out).select("doc_id", "start", "n_tokens").collect()), key=lambda x: x[1]) == [x[:3] for x in exp]
    for s in shards:
        ids, stop = s.ids(), np.cumsum(s.counts)
        assert all((s.document(i) == ids[b - n : b]).all() for i, (b, n) in enumerate(zip(stop.tolist(), s.counts.tolist())))
    assert digest(df.limit(0)).count() == 0
