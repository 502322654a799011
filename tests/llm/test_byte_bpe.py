import hashlib
import random

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.byte_bpe import MergeReplay, codec, decode, digest, encode, load_ranks, plain_encode

PATH = P.path("byte_bpe_50k.tiktoken")
OWN = codec(PATH, P.PATTERN)
LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})
TEXTS = ["", "Hello world, it's 12345 o'clock", "a" * 5000, "aaaa aaa aa", " \n\n\t  x  ", "naïve Straße ñandú été — 漢字 😀😀 <|endoftext|>", "ABAB" * 300, "!!!???...", "  word", "x" * 3 + "\x00" * 7]


def test_against_library():
    assert list(OWN.encode(TEXTS)) == [LIB.encode_ordinary(t) for t in TEXTS]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab c  \n\n\t.'s1\u00a0\u3000\u2028\x1c\x0b"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_any_text(texts):
    got = list(OWN.encode(texts))
    assert got == [LIB.encode_ordinary(t) for t in texts]
    assert [OWN.decode(x).decode() for x in got] == texts


def test_any_ranks():
    """Tables in which merges make pairs of lower ranks: still as the plain way."""
    r = random.Random(4)
    for _ in range(60):
        made = [bytes(r.choices(b"abc", k=r.choice([2, 2, 3, 4]))) for _ in range(25)]
        ranks = {bytes([b]): i for i, b in enumerate(range(256))}
        for m in dict.fromkeys(made):
            ranks[m] = len(ranks)
        words = [bytes(r.choices(b"abc", k=r.randrange(1, 14))) for _ in range(50)]
        assert MergeReplay(ranks).encode(words) == [tuple(plain_encode(w, ranks)) for w in words]


def test_frames(spark):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 7), (None, None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    want = sorted(((i, len(x := LIB.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows), key=str)
    assert sorted(map(tuple, digest(df).collect()), key=str) == want
    back = decode(encode(df)).collect()
    assert sorted((r.doc_id, bytes(r.data)) for r in back if r.doc_id is not None) == sorted((i, t.encode()) for i, t, _ in rows if i is not None)
    assert digest(df.limit(0)).count() == 0
