import random

from lodestone.llm.toxicity import Model, fold, toxicity


def test_fold():
    assert fold("Ｉdiot! 1D10T, іdіоt") == " idiot idiot idiot " and fold(None) == "  " and fold("a 123 $$$ b") == " a b "
    assert fold("tr@$h 4321") == " trash "
    assert fold("ídiot id\u200biot 𝐢𝐝𝐢𝐨𝐭 𝔦𝔡𝔦𝔬𝔱 i\u00addiot ⓘdiot idio\u0301t") == " idiot" * 7 + " "
    assert fold("각 हिन्दी ﬁn") == " 각 हिन्दी fin "


def test_exceptions_and_stems():
    m = Model(lexicon={" trash ": 4.0, " idio": 3.0})
    a = m.automaton()
    assert m.weigh(fold("the trash can is full"), a) == (0.0, 5)
    assert m.weigh(fold("you idiotic trash"), a) == (7.0, 3)
    assert m.weigh(fold("white trash"), Model().automaton()) == (0.0, 2)


def corpus(n=900, seed=2):
    r = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("gra", "mol", "tep", "sun", "vor") for b in ("li", "ten", "da", "mo", "rix", "su")]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.choice([5, 40, 300]))]
        y = int(r.random() < 0.2)
        for _ in range(r.choice([2, 4]) * y):
            w[r.randrange(len(w))] = r.choice(["idiot", "1d10t", "moron", "zokru" + r.choice(vocab)])
        rows.append((i, " ".join(w), "x"))
        labels.append((i, y, 1))
    return rows, labels


def test_held_out(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([*rows, (None, "idiot", "x"), (5000, None, "x"), (5001, "", "x"), (3, rows[3][1], "x")], "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (7, None, 0), (8, labels[8][1], 0)], "doc_id long, toxic int, text int")
    got = toxicity(docs, lab).collect()
    assert len(got) == len(rows) + 4
    by = {r.doc_id: r for r in got}
    held = [(i, y) for i, y, _ in labels if by[i].held_out]
    hit = sum(by[i].predicted == y for i, y in held) / len(held)
    assert len(held) > 100 and hit >= 0.98
    assert by[5000].score == by[5001].score < 0.5 and by[None].held_out and by[None].predicted == 1
    assert toxicity(docs.limit(0), lab).count() == 0
    assert {r.predicted for r in toxicity(docs, lab.limit(0)).collect()} == {0}


def test_weights_against_brute_force():
    """The automaton against a scan of all entries at all words."""
    r = random.Random(4)
    part = lambda: "".join(r.choice("abc") for _ in range(r.randrange(1, 4)))
    for _ in range(200):
        m = Model(lexicon={f" {part()}" + r.choice(["", " "]): r.choice([1.0, 2.5, 4.0]) for _ in range(12)}, exceptions=tuple(f"{part()} {part()}" for _ in range(3)))
        text = fold(" ".join(part() for _ in range(r.randrange(0, 40))))
        spared = [(a, a + len(fold(e)) - 1) for e in m.exceptions for a in range(len(text)) if text.startswith(fold(e), a)]
        total = 0.0
        for a in range(len(text)):
            hits = [w for k, w in m.lexicon.items() if text.startswith(k, a)]
            if hits and not any(x <= a < y for x, y in spared):
                total += max(hits)
        assert m.weigh(text, m.automaton()) == (total, len(text.split()))


def test_a_very_long_text(spark):
    rows, labels = corpus(400)
    long = "gramoltep " * 300_000 + "idiot " * 100
    docs = spark.createDataFrame([*rows, (9000, long, "x"), (9001, "idiot " * 200_000, "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text int")).collect()}
    assert got[9000].predicted == 0 and got[9001].predicted == 1 and len(got) == len(rows) + 2
