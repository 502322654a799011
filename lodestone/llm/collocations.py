"""Phrase collocation mining: exact counts of frequent phrases by a minimal perfect hash, cut scores, the best by language.

Candidates come level by level and are safe: a phrase can be frequent only if its first and its last words without one
are. Each level's candidates (words, then two words, then three) get a minimal perfect hash, whose stored keys verify each
hit. Mappers look phrases up, count hits by slot with bincount and give one array a task; arrays are added up as a tree,
by chunks of slots. What a phrase's cuts need is read from the sums by slot: a key is the pair of slots of the two
shorter phrases that overlap in it.

The hash is broadcast, so a level with more than `block_keys` candidates is cut into blocks, each with a pass of its own
over the slots of the level before. Texts are cut twice: once to find candidate words, once to turn them into slots, which
are written (4 bytes a word). Everything is per language; a null language is `und`.

A text is lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``. Phrases lie
within a piece and overlap. A null text is empty; a text of any length is cut whole; rows that repeat each count; ties go by
`a` and then by the phrase's bytes; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._spark import grouped_arrays, materialise
from lodestone.llm._text import U64, distinct_runs, mix, run_hashes, slices, tidy, utf8
from lodestone.llm.perfect_hash import ByteKeys, NumberKeys

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = np.zeros(256, bool)
_BREAK[[*map(ord, ".,;:!?"), 10, 11, 12, 13]] = True
_WORD = ~_BREAK
_WORD[[9, 32]] = False
#: Slots in a chunk of an array of counts, and arrays that one task adds up.
CHUNK, FAN = 1 << 16, 32


def cut_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words, where each begins and how long it is, whether it begins a piece, and its row."""
    low = _LOWER[data]
    mask = _WORD[low]
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = mask[inner]
    starts = np.flatnonzero(first)
    kept, begin = low[mask], np.flatnonzero(first[mask])
    row = np.searchsorted(offsets, starts, side="right") - 1
    breaks = np.cumsum(_BREAK[low], dtype=np.int32)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (breaks[1:] != breaks[:-1]) | (row[1:] != row[:-1])
    return kept, begin, np.diff(np.append(begin, len(kept))), new, row


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Rows of one language, at most 1 MB of text at a time."""
    langs = pc.unique(batch.column(0)).to_pylist()
    for lang in langs:
        own = batch if len(langs) == 1 else batch.filter(pc.equal(batch.column(0), lang))
        for part in slices(own, "text"):
            yield lang, part


def _word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n: of all words, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, part in _by_lang(batch):
                body, begin, length, _, _ = cut_pieces(*utf8(part.column(1)))
                if not len(begin):
                    continue
                _, where, back = distinct_runs(body, begin, length)
                raw, at, n = body.tobytes(), begin[where].tolist(), length[where].tolist()
                words = pa.array([raw[a : a + m] for a, m in zip(at, n)], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), words, pa.array(np.bincount(back))], names=["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _chunks(counts: np.ndarray, base: int, names: list[str]) -> pa.RecordBatch:
    """An array of counts as rows of their own: part (the task), chunk and body."""
    at = [c for c in range(0, len(counts), CHUNK) if counts[c : c + CHUNK].any()]
    own = {"part": pa.array([TaskContext.get().partitionId()] * len(at), pa.int64()), "chunk": pa.array([(base + c) // CHUNK for c in at], pa.int64()), "body": pa.array([counts[c : c + CHUNK].tobytes() for c in at], pa.binary())}
    none = {"lang": pa.string(), "text": pa.string()}
    return pa.RecordBatch.from_arrays([own[n] if n in own else pa.nulls(len(at), none.get(n, pa.binary())) for n in names], names=names)


def tree_sum(parts: DataFrame, fan: int = FAN) -> DataFrame:
    """slot and f: the sum of the tasks' arrays. Each round adds up to `fan` arrays of a chunk; chunks are apart."""

    def add(g: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        whole = np.zeros(CHUNK, np.int64)
        for b in g["body"]:
            x = np.frombuffer(b, np.int64)
            whole[: len(x)] += x
        return {"part": g["part"][:1], "chunk": g["chunk"][:1], "body": np.array([whole.tobytes()], object)}

    parts = parts.filter("body IS NOT NULL").select("part", "chunk", "body")
    most = parts.agg(F.max("part")).first()[0] or 0
    while True:
        parts = grouped_arrays(parts.withColumn("part", F.expr(f"part div {fan}")), ["chunk", "part"], add, "part bigint, chunk bigint, body binary")
        if (most := most // fan) == 0:
            break
        parts = materialise(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = np.frombuffer(b, np.int64)
                at = np.flatnonzero(f)
                yield pa.RecordBatch.from_arrays([pa.array(at + chunk * CHUNK), pa.array(f[at])], names=["slot", "f"])

    return materialise(parts.select("chunk", "body").mapInArrow(run, "slot bigint, f bigint"))


def _blocks(cands: DataFrame, key: list[str], block_keys: int) -> Iterator[tuple[DataFrame, int, bool]]:
    """Blocks of candidates, of about block_keys each, the number of their first slot, and whether there are more."""
    n = cands.count()
    blocks, base = max(1, -(-n // block_keys)), 0
    if n + blocks * CHUNK >= 1 << 31:
        raise ValueError("more than 2^31 candidates of one level: ask for more occurrences")
    for b in range(blocks):
        own = cands if blocks == 1 else cands.filter(F.pmod(F.xxhash64(*key), F.lit(blocks)) == b)
        yield own, base, b + 1 < blocks
        base += -(-(n if blocks == 1 else own.count()) // CHUNK) * CHUNK


class WordKeys:
    """The slots of words by language."""

    def __init__(self, cands: DataFrame):
        got = cands.select("lang", "word").toArrow()
        lang, word = (pa.concat_arrays(got.column(c).chunks) if len(got) else pa.array([], pa.string()) for c in ("lang", "word"))
        self.number = {x: i for i, x in enumerate(sorted(pc.unique(lang).to_pylist()))}
        group = np.array([self.number[x] for x in lang.to_pylist()], np.int32)
        body, cut = utf8(word)
        self.keys = ByteKeys(self._mixed(run_hashes(body, cut[:-1], np.diff(cut)), group), group, body, np.diff(cut))
        self.n = self.keys.n

    @staticmethod
    def _mixed(h: np.ndarray, group: np.ndarray) -> np.ndarray:
        return mix(h ^ mix(group.astype(U64) + U64(1)))

    def find(self, lang: np.ndarray, h: np.ndarray, body: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """lang: the number of each word's language."""
        return self.keys.find(self._mixed(h, lang), lang, body, begin, length)

    def rows(self, batch: pa.RecordBatch) -> np.ndarray:
        """The slots of rows of lang and word, all of which are keys."""
        body, cut = utf8(batch.column(1))
        length = np.diff(cut)
        group = np.array([self.number[x] for x in batch.column(0).to_pylist()], np.int32)
        return self.find(group, run_hashes(body, cut[:-1], length), body, cut[:-1], length)

    def slots(self, batch: pa.RecordBatch, counts: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Rows, the slots of their words, -1 for another word and before each piece, and how many each row has."""
        for lang, part in _by_lang(batch):
            body, begin, length, new, row = cut_pieces(*utf8(part.column(1)))
            ids = np.full(len(begin), -1, np.int64)
            if len(begin) and lang in self.number:
                h, where, back = distinct_runs(body, begin, length)
                slot = self.find(np.full(len(h), self.number[lang], np.int32), h, body, begin[where], length[where])
                counts[slot[slot >= 0]] += np.bincount(back, minlength=len(slot))[slot >= 0]
                ids = slot[back]
            out = np.full(len(ids) + int(new.sum()), -1, np.int64)
            out[np.arange(len(ids)) + np.cumsum(new)] = ids
            yield part, out, np.bincount(row, minlength=part.num_rows) + np.bincount(row[new], minlength=part.num_rows)


class PairKeys:
    """The slots of pairs of slots that stand together."""

    def __init__(self, cands: DataFrame):
        self.keys = NumberKeys(cands.select("key").toArrow().column(0).to_numpy())
        self.n = len(self.keys.keys)

    def rows(self, batch: pa.RecordBatch) -> np.ndarray:
        return self.keys.find(batch.column(0).to_numpy(zero_copy_only=False))

    def slots(self, batch: pa.RecordBatch, counts: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Rows, the slots of their pairs, at the place of the first, and how many each row has."""
        ids, cut = _ids(batch.column(0))
        out = np.full(len(ids), -1, np.int32)
        for a in range(0, len(ids), 1 << 18):
            at, key = _pairs(ids[a : a + (1 << 18) + 1])
            slot = self.keys.find(key)
            at, slot = at[slot >= 0] + a, slot[slot >= 0]
            counts += np.bincount(slot, minlength=len(counts))
            out[at] = slot
        yield batch, out, np.diff(cut)


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all rows, and where each row's begin."""
    cut = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[cut[0] : cut[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data.view(np.int32), (cut - cut[0]) // 4


def _column(ids: np.ndarray, per_row: np.ndarray) -> pa.Array:
    cut = np.append(0, np.cumsum(per_row * 4)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(per_row), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(ids, np.int32))])


def _pairs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two slots stand together, and their key. A row begins with -1, so none goes over its end."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return at, (ids[at].astype(np.int64) << 32) | ids[at + 1]


def _frequent_pairs(slots: DataFrame, least: int) -> DataFrame:
    """key: the pairs of slots that stand together at least so often. Pairs of one task are added up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _ = _ids(batch.column(0))
            for a in range(0, len(ids), 1 << 20):
                _, key = _pairs(ids[a : a + (1 << 20) + 1])
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])
            tidy()

    return slots.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("key")


def _look_up(rows: DataFrame, sent: Broadcast, base: int, more: bool, wanted: bool) -> DataFrame:
    """The rows with their slots so far (ids), and the counts of this block's slots. more: blocks follow, so sources are
    kept; wanted: slots are."""
    source = [c for c in rows.columns if c != "ids"]
    types = dict(rows.dtypes)
    names = [*(source if more else []), "ids", "part", "chunk", "body"]
    place = rows.columns.index("ids") if "ids" in rows.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(sent.value.n, np.int64)
        for batch in batches:
            for part, ids, per_row in sent.value.slots(batch, counts):
                if wanted or more:
                    ids[ids >= 0] += base
                    if place is not None:
                        ids = np.where(ids >= 0, ids, _ids(part.column(place))[0])
                    n = part.num_rows
                    kept = [part.column(i) for i in range(len(source))] if more else []
                    yield pa.RecordBatch.from_arrays([*kept, _column(ids, per_row), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=names)
            tidy()
        yield _chunks(counts, base, names)

    return rows.mapInArrow(run, ", ".join(f"{c} {types.get(c) or {'ids': 'binary', 'body': 'binary'}.get(c, 'bigint')}" for c in names))


def _level(rows: DataFrame, cands: DataFrame, make: Callable[[DataFrame], WordKeys | PairKeys], wanted: bool, block_keys: int) -> tuple[DataFrame, DataFrame]:
    """The rows' slots (ids), and the candidates with slot and f, the number of their occurrences. Each block of
    candidates is a pass; its hash is made on the driver and broadcast."""
    counts = named = None
    source = list(rows.columns)
    for own, base, more in _blocks(cands, cands.columns, block_keys):
        sent = rows.sparkSession.sparkContext.broadcast(make(own))
        out = materialise(_look_up(rows, sent, base, more, wanted))
        part, here = out.filter("body IS NOT NULL").select("part", "chunk", "body"), materialise(_slotted(own, sent, base))
        sent.destroy()  # workers live on: they would keep the keys of every level
        counts, named = (part, here) if counts is None else (counts.unionByName(part), named.unionByName(here))
        rows = out.filter("ids IS NOT NULL").select(*(source if more else []), "ids")
    return rows, materialise(named.join(tree_sum(counts), "slot"))


def _slotted(cands: DataFrame, sent: Broadcast, base: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.rows(batch) + base)], names=[*batch.schema.names, "slot"])

    return cands.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in cands.dtypes) + ", slot bigint")


def phrases(docs: DataFrame, lang: str = "lang", text: str = "text", most_words: int = 3, least: int = 10, block_keys: int = 2_000_000) -> tuple[DataFrame, list[DataFrame]]:
    """lang and n, and for each length from 2 on: slot, lang, words, a, pre and suf, the occurrences of the phrase's first
    and last 1, 2, ... words, and inner, the slots of the two phrases in it that are a word shorter."""
    docs = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    every = materialise(_word_counts(docs))
    totals = every.groupBy("lang").agg(F.sum("n").alias("n"))
    cands = every.filter(F.col("n") >= least).select("lang", "word")
    slots, known = _level(docs, cands, WordKeys, most_words > 1, block_keys)
    none = F.array().cast("array<bigint>")
    shorter = known.select("slot", "lang", F.array("word").alias("words"), F.col("f").alias("a"), none.alias("pre"), none.alias("suf"))
    out = []
    for n in range(2, most_words + 1):
        cands = materialise(_frequent_pairs(slots, least))
        slots, known = _level(slots.select(F.col("ids").alias("prev")), cands, PairKeys, n < most_words, block_keys)
        first, last = (shorter.select(*(F.col(c).alias(f"{x}_{c}") for c in shorter.columns)) for x in "pq")
        pair = known.select("slot", F.col("f").alias("a"), F.shiftright("key", 32).alias("p"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("q"))
        both = pair.join(first, pair["p"] == first["p_slot"]).join(last, pair["q"] == last["q_slot"])
        longer = both.select("slot", F.col("p_lang").alias("lang"), F.concat("p_words", F.array(F.element_at("q_words", -1))).alias("words"), "a", F.concat("p_pre", F.array("p_a")).alias("pre"), F.concat("q_suf", F.array("q_a")).alias("suf"), F.array("p", "q").alias("inner"))
        out.append(materialise(longer.filter(F.col("a") >= least)))
        shorter = out[-1].drop("inner")
    return totals, out


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", most_words: int = 3, least: int = 10, share: int = 50, top: int = 2000, block_keys: int = 2_000_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language. Those that are in a longer candidate
    with at least `share` percent of their occurrences are dropped."""
    totals, found = phrases(docs, lang, text, most_words, least, block_keys)
    kept = None
    for own, longer in zip(found, [*found[1:], None]):
        if longer is not None:
            cover = longer.select(F.explode("inner").alias("slot"), F.col("a").alias("f")).groupBy("slot").agg(F.max("f").alias("f"))
            own = own.join(cover, "slot", "left").filter(F.col("f").isNull() | (100 * F.col("f") < share * F.col("a")))
        own = own.select("lang", "words", "a", "pre", "suf")
        kept = own if kept is None else kept.unionByName(own)
    wide = lambda c: f"cast({c} as decimal(38,0))"
    score = f"({wide('a')} * a * 1000000) div ({wide('element_at(pre, k)')} * element_at(suf, size(suf) + 1 - k))"
    cuts = F.expr(f"array_min(transform(sequence(1, size(pre)), k -> named_struct('score', {score}, 'k', k, 'l', element_at(pre, k), 'r', element_at(suf, size(suf) + 1 - k))))")
    scored = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", cuts.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
