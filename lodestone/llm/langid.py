"""Language ID: the family first, then one-versus-one linear support vector machines within it.

A text is the square roots of the frequencies of its hashed byte 2-, 3- and 4-grams, after Unicode lower-casing, with
all ASCII that is not a letter as a space; it is counted whole, in vectorised batches. One linear machine per family
tells it from the others; within the best family each pair of languages has a machine, and most votes win (ties: the
larger sum of margins, then the first name). `families` maps language codes to families; codes it does not have
share one family, so that each of them is told from the others by its own machines.

Machines are fitted with a squared hinge loss on a bounded sample: about `per_language` labelled rows of each of the
`max_languages` languages that have most rows (ties: the first names), fewer where that would be more than `max_rows`
together, picked by a hash of their id; only their features reach the driver, 8 KB each, so 100 MB at most.

A null text, or one without any letter, is `und` with score 0. Without labelled rows every text is. With one learned
language every text with a letter is that language. score: the product of a logistic function of the family's and of
the language's margin over the next. A null id is held out. Rows that repeat an id are each returned; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._text import slices, utf8

#: Families of languages by their ISO 639-1 codes.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic",
    "zh": "sinitic", "ja": "japonic", "ko": "koreanic", "ar": "semitic", "he": "semitic", "tr": "turkic",
}
DIM = 4096
#: Rows whose features are held at once: 8 MB of counts.
ROWS = 256
_LETTER = regex.compile(r"\p{L}")
_SPACED = np.arange(256, dtype=np.uint8)
_SPACED[:128] = 32
_SPACED[97:123] = np.arange(97, 123)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of DIM numbers for each text, of length 1 (or 0, if it has fewer than two bytes)."""
    n = len(offsets) - 1
    out = np.zeros((n, DIM), dtype=np.float32)
    if len(data) < 2:
        return out
    x = _SPACED[data].astype(np.uint32)
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    code = x[:-1] * np.uint32(257) + x[1:]
    for k in (2, 3, 4):
        if k > 2:
            if len(code) < 2:
                break
            code = code[:-1] * np.uint32(0x01000193) + x[k - 1 :]
        slot = ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
        inside = row[: len(code)] == row[k - 1 :]
        spaces = (x[: len(code)] == 32) & (x[1 : 1 + len(code)] == 32)
        keep = inside & ~spaces
        out += np.bincount(row[: len(code)][keep] * np.int64(DIM) + slot[keep], minlength=n * DIM).reshape(n, DIM)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1))


def fit_machine(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine (y is 1 or -1), both sides weighing the same: accelerated descent."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb, t = w, b, 1.0
    step = 1 / (4 + l2)
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ vw + vb)) * weight * y
        nw, nb = vw + step * (2 * (slack @ x) - l2 * vw), vb + step * 2 * float(slack.sum())
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


class Hierarchy:
    """families: names; langs: the languages of each; machines in the columns of w and b, families first."""

    def __init__(self, x: np.ndarray, lang: np.ndarray, families: dict[str, str]):
        names = sorted(set(lang.tolist()))
        self.families = sorted({families.get(k, "other") for k in names})
        self.langs = [[k for k in names if families.get(k, "other") == f] for f in self.families]
        of = np.array([families.get(k, "other") for k in lang.tolist()])
        made = []
        if len(self.families) > 1:
            made += [fit_machine(x, np.where(of == f, 1, -1).astype(np.float32)) for f in self.families]
        self.pairs = []
        for i, ks in enumerate(self.langs):
            for a in range(len(ks)):
                for c in range(a + 1, len(ks)):
                    both = (lang == ks[a]) | (lang == ks[c])
                    made.append(fit_machine(x[both], np.where(lang[both] == ks[a], 1, -1).astype(np.float32)))
                    self.pairs.append((i, a, c))
        self.w = np.stack([m[0] for m in made], axis=1) if made else np.zeros((x.shape[1], 0), np.float32)
        self.b = np.array([m[1] for m in made], dtype=np.float64)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        z = (x @ self.w).astype(np.float64) + self.b
        n, nf = len(x), len(self.families) if len(self.families) > 1 else 0
        family, score = np.zeros(n, np.int64), np.ones(n)
        if nf:
            top = np.sort(z[:, :nf], axis=1)
            family, score = z[:, :nf].argmax(axis=1), _logistic(2 * (top[:, -1] - top[:, -2]))
        out = [""] * n
        for i, ks in enumerate(self.langs):
            rows = np.flatnonzero(family == i)
            votes, sums = np.zeros((len(rows), len(ks))), np.zeros((len(rows), len(ks)))
            for k, (f, a, c) in enumerate(self.pairs):
                if f == i:
                    m = z[rows, nf + k]
                    votes[:, a] += m >= 0
                    votes[:, c] += m < 0
                    sums[:, a] += m
                    sums[:, c] -= m
            rank = votes + np.tanh(sums) * 0.4
            best = rank.argmax(axis=1) if len(ks) else np.zeros(0, np.int64)
            if len(ks) > 1 and len(rows):
                score[rows] *= _logistic(4 * sums[np.arange(len(rows)), best] / (len(ks) - 1))
            for r, k in zip(rows.tolist(), best.tolist()):
                out[r] = ks[k]
        return out, score


def _logistic(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def remainder(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod).cast("int")


def _lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null(""))


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", families: dict[str, str] | None = None, per_language: int = 600, max_languages: int = 128, max_rows: int = 12_000) -> Hierarchy | None:
    """Fits on about per_language rows of each language, fewer where there are fewer; rows with nulls are left. Every language
    is learned. More than max_languages raise: labels that are no languages would each want machines against all others."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(max_languages + 1).collect()}
    if not counts:
        return None
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages in column {lang}")
    per_language = max(1, min(per_language, max_rows // len(counts)))
    picked = F.lit(False)
    share = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20))
    for k, n in counts.items():
        picked = picked | ((F.col("lang") == k) & (share < min(1 << 20, int((1 << 20) * per_language / n) + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", max_rows=ROWS):
                x = features(*utf8(_lowered(part.column(0)))).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    got = rows.filter(picked).select("text", "lang").mapInArrow(run, "lang string, x binary").orderBy("lang", "x").toPandas()
    if not len(got):
        return None
    x = np.frombuffer(b"".join(got["x"]), dtype=np.float16).reshape(len(got), DIM).astype(np.float32)
    return Hierarchy(x, got["lang"].to_numpy(), FAMILIES if families is None else families)


def predict(docs: DataFrame, model: Hierarchy | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (default: all but the text), lang_pred and score."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    read = text if text in keep else "__text"
    types = dict(docs.dtypes)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in slices(batch, read, max_rows=ROWS):
                col = part.column(part.schema.get_field_index(read))
                known = np.array([t is not None and _LETTER.search(t) is not None for t in col.to_pylist()], dtype=bool)
                lang, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if own is not None and known.any():
                    rows = np.flatnonzero(known)
                    names, s = own.predict(features(*utf8(_lowered(col)))[rows])
                    score[rows] = s
                    for r, k in zip(rows.tolist(), names):
                        lang[r] = k
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    wanted = docs.select(*keep) if read == text else docs.select(*keep, F.col(text).alias("__text"))
    return wanted.mapInArrow(run, "".join(f"`{c}` {types[c]}, " for c in keep) + "lang_pred string, score double")


def language_id(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 600) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the rows that are not held out."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = train(docs.filter(remainder("doc_id", 4) != 2), per_language=per_language)
    out = predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score")
