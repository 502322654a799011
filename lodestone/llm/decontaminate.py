"""Benchmark decontamination by winnowing.

A fingerprint is the least hash among `w` consecutive k-grams of words, the rightmost one on ties, with k + w - 1 =
`window`. So whatever text holds it, a shared span of `window` words has a fingerprint at the same place in both, and
every such span is found. Item fingerprints that meet a document's are extended: each start from which a window
would cover the fingerprint is compared with the windows of the items, by hash and then byte by byte. Items of fewer words than the window, but
some, are one window of their own length and are looked up by that length.

Items are taken in blocks of at most `block_words` words, which bounds what is broadcast: each block of items is a
stated query set against all documents, in one pass that shuffles nothing, and passes are then added up by document
(there is one pass, and nothing to add up, while the benchmark fits in a block).

A null or wordless text has no words and is never contaminated; a null or wordless item is in no document. A null
item_id is not reported but its windows are hit. Repeated item_ids are one item; repeated documents are each reported.
Empty tables: no documents, or no hits. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import materialise
from lodestone.llm._text import cut_words, expand, grams, run_hashes, same_runs, slices, utf8

#: The index of the block that a Python worker has last worked with, by a key of the pass.
_BUILT: dict[str, ItemIndex] = {}


def winnow(g: np.ndarray, row: np.ndarray, w: int) -> np.ndarray:
    """Marks the selected k-grams. row: of each k-gram, the row it lies in, or -1 if it crosses rows."""
    n = len(g)
    chosen = np.zeros(n, dtype=bool)
    if n < w:
        return chosen
    m = n - w + 1
    best, at = g[:m].copy(), np.arange(m)
    for j in range(1, w):
        less = g[j : j + m] <= best
        best[less], at[less] = g[j : j + m][less], (np.arange(m) + j)[less]
    inside = (row[:m] >= 0) & (row[:m] == row[w - 1 : w - 1 + m])
    chosen[at[inside]] = True
    return chosen


def gram_rows(bounds: np.ndarray, k: int) -> np.ndarray:
    """For every k-gram of the words the row that holds it whole, else -1."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    n = len(row) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    return np.where(row[:n] == row[k - 1 : k - 1 + n], row[:n], -1)


class Cut:
    """Texts cut to words: their bytes one after the other, where each begins (one more entry at the end), their hashes
    and where each text's words begin."""

    def __init__(self, column: pa.Array):
        self.body, begin, length, self.bounds = cut_words(*utf8(column))
        self.edge = np.append(begin, len(self.body))
        self.h = run_hashes(self.body, begin, length)
        self.lengths = length


def _same(a: Cut, i: np.ndarray, b: Cut, j: np.ndarray, n: int) -> np.ndarray:
    """Whether the n words from i of a are those from j of b."""
    out = (a.lengths[i[:, None] + np.arange(n)] == b.lengths[j[:, None] + np.arange(n)]).all(axis=1)
    k = np.flatnonzero(out)
    out[k] = same_runs(a.body, a.edge[i[k]], a.edge[i[k] + n] - a.edge[i[k]], b.body, b.edge[j[k]], b.edge[j[k] + n] - b.edge[j[k]])
    return out


class ItemIndex:
    """Fingerprints of a block of items, and by length its distinct windows: their hashes in order, a place at which
    each stands, and the items that have it."""

    def __init__(self, ids: list, column: pa.Array, window: int, k: int):
        self.window, self.k, self.w = window, k, window - k + 1
        self.cut = own = Cut(column)
        length = np.diff(own.bounds)
        g = grams(own.h, k)
        self.prints = np.unique(g[winnow(g, gram_rows(own.bounds, k), self.w)]) if len(g) else g
        self.ids = ["" if i is None else str(i) for i in ids]
        self.named = np.array([i is not None for i in ids], dtype=bool)
        self.windows = {}
        of = gram_rows(own.bounds, window)
        if (at := np.flatnonzero(of >= 0)).size:
            self._enter(window, at, of[at])
        for n in np.unique(length[(length > 0) & (length < window)]).tolist():
            items = np.flatnonzero(length == n)
            self._enter(n, own.bounds[items], items)

    def _enter(self, n: int, at: np.ndarray, item: np.ndarray) -> None:
        x = np.concatenate([grams(self.cut.h[a : a + n], n) for a in at.tolist()]) if n < self.window else grams(self.cut.h, n)[at]
        order = np.lexsort((at, x))
        x, at, item = x[order], at[order], item[order]
        first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        lead = at[np.repeat(first, np.diff(np.append(first, len(x))))]
        number = np.cumsum(np.append(True, x[1:] != x[:-1])) - 1
        if not _same(self.cut, at, self.cut, lead, n).all():  # other words of one hash: told apart by bytes
            edge, raw, seen = self.cut.edge, self.cut.body.tobytes(), {}
            words = [(tuple(np.diff(edge[a : a + n + 1]).tolist()), raw[edge[a] : edge[a + n]]) for a in at.tolist()]
            number = np.array([seen.setdefault((int(h), w), len(seen)) for h, w in zip(x, words)])
            order = np.argsort(number, kind="stable")
            x, at, item, number = x[order], at[order], item[order], number[order]
            by = np.argsort(x, kind="stable")
            x, at, item, number = x[by], at[by], item[by], number[by]
            number = np.cumsum(np.append(True, number[1:] != number[:-1])) - 1
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        self.windows[n] = (x[first], at[first], item, np.append(first, len(x)))

    def search(self, docs: Cut) -> list[tuple[int, np.ndarray, np.ndarray, int]]:
        """(row, sorted starts, items, length) for every row and window length with hits."""
        out, h, bounds = [], docs.h, docs.bounds
        for n, (x, place, item, edge) in self.windows.items():
            row = gram_rows(bounds, n)
            if not len(row):
                continue
            if n == self.window:
                g = grams(h, self.k)
                fp = np.flatnonzero(winnow(g, gram_rows(bounds, self.k), self.w))
                fp = fp[_in(g[fp], self.prints)]
                starts = np.unique((fp[:, None] - np.arange(self.w)[None, :]).ravel())
                starts = starts[(starts >= 0) & (starts < len(row))]
            else:
                starts = np.arange(len(row))
            starts = starts[row[starts] >= 0]
            if not len(starts):
                continue
            v = grams(h, n)[starts]
            lo, hi = np.searchsorted(x, v, side="left"), np.searchsorted(x, v, side="right")
            which = expand(lo, hi - lo)
            starts = np.repeat(starts, hi - lo)
            ok = np.concatenate([_same(docs, starts[a : a + 50_000], self.cut, place[which[a : a + 50_000]], n) for a in range(0, len(starts), 50_000)] or [np.zeros(0, bool)])
            starts, which = starts[ok], which[ok]
            rows = row[starts]
            cut = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else rows
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)]):
                own = np.unique(which[a:b])
                out.append((int(rows[a]), starts[a:b], np.unique(item[expand(edge[own], edge[own + 1] - edge[own])]), n))
        return out


def _in(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x


def _pass(docs: DataFrame, ids: list, texts: list, window: int, k: int, keep: list[str], text: str = "text", clean: bool = False) -> DataFrame:
    """The columns in keep, n_words, spans (start, end word of hit runs) and items of every document; or, if clean is
    wanted, the columns in keep of those without hits."""
    sent = docs.sparkSession.sparkContext.broadcast((ids, texts))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = ItemIndex(sent.value[0], pa.array(sent.value[1], pa.string()), window, k)
        index = _BUILT[key]
        for batch in batches:
            for part in slices(batch, text):
                own = Cut(part.column(part.schema.get_field_index(text)))
                bounds, n = own.bounds, part.num_rows
                if clean:
                    rows = np.ones(n, dtype=bool)
                    rows[[r for r, *_ in index.search(own)]] = False
                    yield part.filter(pa.array(rows)).select(keep)
                    continue
                starts: list = [[] for _ in range(n)]
                ends: list = [[] for _ in range(n)]
                items: list = [set() for _ in range(n)]
                marks: dict[int, np.ndarray] = {}
                for r, s, it, length in index.search(own):
                    edge = marks.setdefault(r, np.zeros(bounds[r + 1] - bounds[r] + 1, np.int64))
                    np.add.at(edge, s - bounds[r], 1)
                    np.add.at(edge, s - bounds[r] + length, -1)
                    items[r] |= {index.ids[i] for i in it if index.named[i]}
                for r, edge in marks.items():
                    on = np.append(False, np.cumsum(edge) > 0).astype(np.int8)
                    step = np.diff(np.append(on, 0))
                    starts[r], ends[r] = np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()
                kept = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(bounds)), pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=[*keep, "n_words", "starts", "ends", "items"])

    types = dict(docs.dtypes)
    if clean:
        return docs.select(*keep).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep))
    return docs.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", n_words bigint, starts array<bigint>, ends array<bigint>, items array<string>")


def _blocks(items: DataFrame, block_words: int) -> Iterator[tuple[list, list]]:
    """Blocks of items; the rows are streamed from Spark, so one block at a time is held."""
    ids: list = []
    texts: list = []
    size = 0
    total = items.agg(F.coalesce(F.sum(F.length("text") / 2 + 1), F.lit(0.0))).first()[0]
    for row in items.collect() if total <= block_words else items.orderBy("item_id", "text").toLocalIterator():
        n = len(row["text"]) // 2 + 1  # words, at most
        if ids and size + n > block_words:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row["item_id"])
        texts.append(row["text"])
        size += n
    yield ids, texts


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, block_words: int = 8_000_000) -> DataFrame:
    """doc_id, n_words, starts and ends (word positions of the hit runs, end exclusive) and items (sorted strings).

    block_words bounds a broadcast of items to about 100 MB of text.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("text IS NOT NULL")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    blocks = _blocks(items, block_words)
    first = next(blocks)
    rest = next(blocks, None)
    if rest is None:
        return _pass(docs, *first, window, k, ["doc_id"])
    docs = docs.select("doc_id", "text", F.struct(F.xxhash64("text"), F.length("text"), F.crc32(F.col("text").cast("binary"))).alias("of"))
    parts = [materialise(_pass(docs, *first, window, k, ["doc_id", "of"]))]
    while rest is not None:
        parts.append(materialise(_pass(docs, *rest, window, k, ["doc_id", "of"]).filter("size(starts) > 0")))
        rest = next(blocks, None)
    base, more = parts[0], parts[1]
    for p in parts[2:]:
        more = more.union(p)
    merged = more.distinct().groupBy("doc_id", "of").agg(F.flatten(F.collect_list("starts")).alias("s2"), F.flatten(F.collect_list("ends")).alias("e2"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("i2"))
    on = base["doc_id"].eqNullSafe(merged["doc_id"]) & base["of"].eqNullSafe(merged["of"])
    none = F.array().cast("array<bigint>")
    joined = base.join(merged, on, "left").select(base["doc_id"], "n_words", F.concat("starts", F.coalesce("s2", none)).alias("s"), F.concat("ends", F.coalesce("e2", none)).alias("e"), F.array_sort(F.array_union("items", F.coalesce("i2", F.array().cast("array<string>")))).alias("items"))
    runs = F.array_sort(F.arrays_zip("s", "e"))
    united = F.aggregate(runs, F.array().cast("array<struct<s:bigint,e:bigint>>"), lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["e"] >= x["s"]), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["s"].alias("s"), F.greatest(F.element_at(a, -1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(a, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))))
    return joined.withColumn("r", united).select("doc_id", "n_words", F.transform("r", lambda x: x["s"]).alias("starts"), F.transform("r", lambda x: x["e"]).alias("ends"), "items")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, block_words: int = 8_000_000) -> DataFrame:
    """The rows, with all their columns, that have no word of an item's window. With several blocks of items each
    pass takes what the one before has kept."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("text IS NOT NULL")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    for i, block in enumerate(_blocks(items, block_words)):
        rows = materialise(rows) if i else rows
        rows = _pass(rows, *block, window, k, names, names[docs.columns.index(text)], clean=True)
    return rows.toDF(*docs.columns)


def leak_digest(found: DataFrame) -> DataFrame:
    """The contract's columns of find_leaks()."""
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
