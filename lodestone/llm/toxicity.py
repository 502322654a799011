"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exceptions.

Folding takes compatible forms (mathematical and full-width letters, ligatures) as their letters, drops accents and
invisible characters, lower-cases, maps homoglyphs to Latin letters, reads digits and signs within a word as the letters
they stand for, and makes one space of whatever else is no letter. A homoglyph or digit stands for one letter only. The lexicon holds whole words and word beginnings ("stems"),
each with a weight; in a match of several entries at one word the heaviest counts, and matches inside an exception
phrase don't. The sum of weights per `per_words` words, damped by a logarithm, gives the score by a logistic function.

The lexicon and the logistic function are learned from a bounded sample of labelled rows: about `per_class` of each
class, picked by a hash of the id, less those that share a MinHash value with another (copies would count their words
again and again). An entry's weight is the logarithm of how much likelier toxic documents have it; entries have a
least support and a least weight, and the lexicon's size is bounded by `max_entries`; it is picked from the
50 * `max_entries` words and word beginnings that most of the sample's toxic documents have. A seed lexicon may be given.

Null and empty texts have no words and get the score of a text without matches. Without labelled rows of both classes
only the seed lexicon counts. A null id is held out. Repeated ids are each scored; labels that repeat an id count as
toxic if any does; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._text import slices
from lodestone.llm.langid import remainder
from lodestone.llm.ngram_join import _signed

#: Letters of other scripts that look like Latin ones, and full-width forms.
HOMOGLYPHS = dict(zip("аеорсухіјѕԁһкмтвнпгαενορτυικχβѵԛԝᴀʙᴄᴅᴇɪɴʀ", "aeopcyxijsdhkmtbhnraevoptuikxbvqwabcdeinr")) | {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
#: What digits and signs stand for within a word.
LEET = dict(zip("0134578@$", "oieastbas"))
#: Phrases in which a lexicon entry is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "sore loser", "circus clown", "not an idiot", "not stupid")

_GLYPHS = str.maketrans(HOMOGLYPHS)
_LEET = str.maketrans(LEET)
_MARKED = regex.compile(r"[\p{L}0-9@$]*[0-9@$][\p{L}0-9@$]*")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_HAS_MARK = regex.compile(r"[0-9@$]")
_HAS_LETTER = regex.compile(r"\p{L}")
#: Accents, and what is not seen: format characters and variation selectors.
_UNSEEN = regex.compile(r"[\u0300-\u036f\p{Cf}\ufe00-\ufe0f]+")


def fold(text: str | None) -> str:
    """Words of letters between single spaces, with a space at either end."""
    t = text or ""
    if t.isascii():
        t = t.lower()
    else:
        t = unicodedata.normalize("NFC", _UNSEEN.sub("", unicodedata.normalize("NFKD", t)).lower()).translate(_GLYPHS)
    if _HAS_MARK.search(t):
        t = _MARKED.sub(lambda m: m[0].translate(_LEET) if _HAS_LETTER.search(m[0]) else m[0], t)
    return f" {_OTHER.sub(' ', t).strip()} "


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    slope: float = 1.0
    bias: float = -3.0
    per_words: float = 100.0

    def automaton(self) -> ahocorasick.Automaton | None:
        """Entries begin with a space; whole words also end with one; a weight of None is an exception."""
        a = ahocorasick.Automaton()
        for k, w in self.lexicon.items():
            a.add_word(k, (len(k), w))
        if not len(a):
            return None
        for k in self.exceptions:
            k = fold(k)
            a.add_word(k, (len(k), None))
        a.make_automaton()
        return a

    def weigh(self, folded: str, automaton: ahocorasick.Automaton | None) -> tuple[float, int]:
        """The weights of all matched words, and the number of words."""
        n = folded.count(" ") - 1 if len(folded) > 2 else 0
        if automaton is None:
            return 0.0, n
        found: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        for end, (length, w) in automaton.iter(folded):
            at = end - length + 1
            if w is None:
                spared.append((at, end))
            elif w > found.get(at, 0.0):
                found[at] = w
        if spared:
            found = {at: w for at, w in found.items() if not any(a <= at < e for a, e in spared)}
        return sum(found.values()), n

    def feature(self, weight: float, n: int) -> float:
        return math.log1p(self.per_words * 10 * weight / (n + 50))

    def score(self, weight: float, n: int) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.feature(weight, n) + self.bias))))


def _patterns(folded: str, stems: tuple[int, ...]) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        for k in stems:
            if len(w) >= k:
                out.add(f" {w[:k]}")
    return out


def _support(rows: DataFrame, stems: tuple[int, ...], only: set[str] | None) -> DataFrame:
    """pattern, n: the number of rows that have it; counted within slices before anything is sent."""
    sent = rows.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                count: Counter = Counter()
                for t in part.column(0).to_pylist():
                    own = _patterns(fold(t), stems)
                    count.update(own if sent.value is None else own & sent.value)
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["pattern", "n"])

    return rows.select("text").mapInArrow(run, "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))


def _weighed(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep, weight and n_words of whole texts."""
    types = dict(rows.dtypes)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        automaton = own.automaton()
        for batch in batches:
            for part in slices(batch, "__text", 4 << 20):
                got = [own.weigh(fold(t), automaton) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64()), pa.array([own.score(*g) for g in got], pa.float64())], names=[*keep, "weight", "n_words", "score"])

    return rows.select(*keep, F.col("text").alias("__text")).mapInArrow(run, "".join(f"`{c}` {types[c]}, " for c in keep) + "weight double, n_words bigint, score double")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton steps, with a small ridge."""
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 1e-2 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", seed: dict[str, float] | None = None, per_class: int = 4000, stems: tuple[int, ...] = (4, 5, 6), least_share: float = 0.004, least_weight: float = 2.0, max_entries: int = 3000) -> Model:
    """labels: rows of doc_id and 0/1; the caller leaves out what must not be learned from."""
    seed = {fold(k): w for k, w in (seed or {}).items()}
    y = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return Model(lexicon=seed)
    share = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    limit = {k: min(1 << 30, int((1 << 30) * per_class / n) + 1) for k, n in counts.items()}
    picked = y.filter(((F.col("y") == 1) & (share < limit[1])) | ((F.col("y") == 0) & (share < limit[0])))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL").join(F.broadcast(picked), "doc_id")  # per_class bounds it
    signed = _signed(rows.select("doc_id", "text"), 5, 2, 1).join(F.broadcast(picked), "doc_id")
    alone = signed.groupBy("y", "l0").agg(F.min("doc_id").alias("doc_id"), F.min_by("l1", "doc_id").alias("l1")).groupBy("y", "l1").agg(F.min("doc_id").alias("doc_id"))
    rows = rows.join(F.broadcast(alone.select("doc_id")), "doc_id").persist()
    try:
        size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
        if not size.get(0) or not size.get(1):
            return Model(lexicon=seed)
        least = max(3, math.ceil(least_share * size[1]))
        toxic = {r["pattern"]: r["n"] for r in _support(rows.filter("y = 1"), stems, None).filter(F.col("n") >= least).orderBy(F.desc("n"), "pattern").limit(50 * max_entries).collect()}
        clean = {r["pattern"]: r["n"] for r in _support(rows.filter("y = 0"), stems, set(toxic)).collect()}
        weight = {p: math.log((n + 0.5) / (size[1] + 1)) - math.log((clean.get(p, 0) + 0.5) / (size[0] + 1)) for p, n in toxic.items()}
        best = sorted((p for p, w in weight.items() if w >= least_weight), key=lambda p: (-weight[p] * toxic[p], p))[:max_entries]
        model = Model(lexicon=seed | {p: weight[p] for p in best})
        got = _weighed(rows, model, ["y"]).select("y", "weight", "n_words").orderBy("y", "weight", "n_words").toPandas()
        x = np.array([model.feature(w, n) for w, n in zip(got["weight"], got["n_words"])])
        model.slope, model.bias = _logistic(x, got["y"].to_numpy(dtype=np.float64))
        return model
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, weight, n_words, score."""
    return _weighed(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model, ["doc_id"])


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from labels of rows that are not held out."""
    model = train(docs, labels.filter(remainder("doc_id", 5) != 0), per_class=per_class)
    return score(docs, model).select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
