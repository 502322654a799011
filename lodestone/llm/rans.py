"""Token ids as a static range asymmetric numeral system (rANS), and their container format.

A shard holds the ids of consecutive documents. One table of frequencies, counted over all its ids and scaled to
2**20, is shared by its blocks. A block is coded alone: `lanes` interleaved states, lane k taking the ids at places
k, k + lanes, ...; the states read and write one stream of 32-bit words. Every `checkpoint` steps the block notes its
states and its place in the stream, so that decoding can begin there as well. Each block has a CRC-32 of its ids.
Coding takes one step for all lanes of all blocks at once.

Layout of a shard, little-endian: magic "LRA1", then lengths and contents of: the index of documents (ids and number
of tokens), the table (symbols and frequencies), and for each block its number of ids, checksum, states, checkpoints
and stream. Index and table are deflated.

In frames, documents are tokenised where they are; their ids, which take a fraction of the text, are sent to ranges of
doc_id, whose bounds come from approximate quantiles, and sorted there; a task writes a shard
row for about `shard_ids` ids, which bounds its memory. Rows are Parquet in the shared folder, so that any executor
can read them. A reader decodes a shard without the others, from all checkpoints of its blocks at once, and one
document from the checkpoint before it.

Null texts are empty and have the end id only. Null ids come first. Rows that repeat an id are each returned, in the
order of their ids. Empty tables give no shards and an empty result; other columns are not read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._spark import scratch_dir
from lodestone.llm._text import slices, utf8
from lodestone.llm._words import WordTable

SCALE_BITS = 20
_LOW = np.uint64(1 << 31)
_SHIFT = np.uint64(63 - SCALE_BITS)
_BITS, _MASK, _WORD = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1), np.uint64(32)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that add up to 2**SCALE_BITS, in proportion to positive counts."""
    total = 1 << SCALE_BITS
    if len(counts) > total:
        raise ValueError("more symbols than the table has places")
    f = np.maximum(1, (counts.astype(np.float64) * (total / counts.sum())).astype(np.int64))
    diff = total - int(f.sum())
    order = np.argsort(-f, kind="stable")
    if diff > 0:
        f[order[0]] += diff
    while diff < 0:  # taken from the largest, which have most to give
        take = np.minimum(f[order] - 1, np.maximum(1, f[order] * -diff // total + 1))
        cum = np.minimum(np.cumsum(take), -diff)
        f[order] -= np.diff(np.append(0, cum))
        diff = total - int(f.sum())
    return f


def _encode_blocks(sym: np.ndarray, freq: np.ndarray, lanes: int, steps: int, checkpoint: int) -> list[bytes]:
    """sym: indices of symbols. Every block has steps * lanes of them, but the last may have fewer."""
    per = lanes * steps
    n_blocks = -(-len(sym) // per)
    start = (np.cumsum(freq) - freq).astype(np.uint64)
    freq = freq.astype(np.uint64)
    grid = np.zeros(n_blocks * per, dtype=np.int64)
    grid[: len(sym)] = sym
    grid = grid.reshape(n_blocks, steps, lanes)
    n_last = len(sym) - (n_blocks - 1) * per
    x = np.full((n_blocks, lanes), _LOW, dtype=np.uint64)
    words: list[list[np.ndarray]] = [[] for _ in range(n_blocks)]
    marks: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n_blocks)]
    size = [0] * n_blocks
    for t in range(steps - 1, -1, -1):
        live = n_blocks if t * lanes < n_last else n_blocks - 1
        if not live:
            continue
        s = grid[:live, t]
        f, c, v = freq[s], start[s], x[:live]
        full = v >= f << _SHIFT
        idle = None
        if live == n_blocks and (t + 1) * lanes > n_last:  # the last block's last step is shorter
            idle = np.arange(lanes) >= n_last - t * lanes
            full[-1] &= ~idle
        out = (v & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for b in range(live):
            if (w := out[b][full[b]]).size:
                words[b].append(w[::-1])
                size[b] += len(w)
        v = np.where(full, v >> _WORD, v)
        q = v // f
        new = (q << _BITS) + (v - q * f) + c
        if idle is not None:
            new[-1] = np.where(idle, x[live - 1], new[-1])
        x[:live] = new
        if t and t % checkpoint == 0:
            for b in range(live):
                marks[b].append((size[b], x[b].copy()))
    done = []
    for b in range(n_blocks):
        n = per if b < n_blocks - 1 else n_last
        stream = np.concatenate(words[b])[::-1] if words[b] else np.zeros(0, np.uint32)
        notes = b"".join(struct.pack("<I", size[b] - at) + st.tobytes() for at, st in marks[b][::-1])
        done.append(struct.pack("<III", n, len(marks[b]), len(stream)) + x[b].tobytes() + notes + stream.astype("<u4").tobytes())
    return done


def encode_shard(doc_ids: list, counts: np.ndarray, ids: np.ndarray, lanes: int = 1024, steps: int = 256, checkpoint: int = 64) -> bytes:
    """counts: ids of each document; ids: all of them in order."""
    n = np.bincount(ids)
    symbols = np.flatnonzero(n)
    freq = scaled(n[symbols]) if len(symbols) else np.zeros(0, np.int64)
    number = np.zeros(len(n), dtype=np.int64)
    number[symbols] = np.arange(len(symbols))
    sym = number[ids]
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    index = zlib.compress(np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + known.tobytes() + counts.astype("<i8").tobytes(), 1)
    table = zlib.compress(symbols.astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    blocks = _encode_blocks(sym, freq, lanes, steps, checkpoint) if len(ids) else []
    out = [b"LRA1", struct.pack("<IIIIQIII", lanes, steps, checkpoint, len(doc_ids), len(ids), len(symbols), len(index), len(table)), index, table, struct.pack("<I", len(blocks))]
    per, raw = lanes * steps, ids.astype("<u4")
    for i, b in enumerate(blocks):
        out += [struct.pack("<II", len(b), zlib.crc32(raw[i * per : (i + 1) * per].tobytes())), b]
    return b"".join(out)


class Shard:
    """A reader of one shard's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != b"LRA1":
            raise ValueError("not a shard")
        self.lanes, self.steps, self.checkpoint, docs, self.n_ids, n_sym, n_index, n_table = struct.unpack_from("<IIIIQIII", data, 4)
        at = 4 + struct.calcsize("<IIIIQIII")
        index = zlib.decompress(data[at : at + n_index])
        known = np.frombuffer(index, np.uint8, docs, 8 * docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(index, "<i8", docs), known)]
        self.counts = np.frombuffer(index, "<i8", docs, 9 * docs)
        at += n_index
        table = np.frombuffer(zlib.decompress(data[at : at + n_table]), "<u4")
        self.symbols, freq = table[:n_sym], table[n_sym:].astype(np.int64)
        self.freq, self.start = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        self.lut = np.repeat(np.arange(n_sym, dtype=np.int32), freq)
        at += n_table
        (n_blocks,) = struct.unpack_from("<I", data, at)
        at += 4
        self.blocks = []
        for _ in range(n_blocks):
            size, crc = struct.unpack_from("<II", data, at)
            self.blocks.append((data[at + 8 : at + 8 + size], crc))
            at += 8 + size

    def _parts(self, block: int) -> tuple[int, np.ndarray, list[tuple[int, np.ndarray]], np.ndarray]:
        data = self.blocks[block][0]
        n, n_marks, n_words = struct.unpack_from("<III", data)
        states = np.frombuffer(data, "<u8", self.lanes, 12)
        at, marks = 12 + 8 * self.lanes, []
        for _ in range(n_marks):
            marks.append((struct.unpack_from("<I", data, at)[0], np.frombuffer(data, "<u8", self.lanes, at + 4)))
            at += 4 + 8 * self.lanes
        return n, states, marks, np.frombuffer(data, "<u4", n_words, at)

    def _decode(self, parts: list[tuple[int, np.ndarray, int, np.ndarray]]) -> list[np.ndarray]:
        """For each (number of ids, states, place in the stream, stream) its ids; all lanes of all at once."""
        x = np.stack([p[1] for p in parts])
        at = [p[2] for p in parts]
        steps = max(-(-p[0] // self.lanes) for p in parts)
        out = np.empty((len(parts), steps, self.lanes), dtype=np.uint32)
        for t in range(steps):
            slot = x & _MASK
            s = self.lut[slot.astype(np.int64)]
            out[:, t] = s
            new = self.freq[s] * (x >> _BITS) + slot - self.start[s]
            low = new < _LOW
            for b, (n, _, _, stream) in enumerate(parts):
                left = n - t * self.lanes
                if left < self.lanes:  # lanes that have ended keep their state
                    ended = np.arange(self.lanes) >= left
                    new[b] = np.where(ended, x[b], new[b])
                    low[b] &= ~ended
                if k := int(np.count_nonzero(low[b])):
                    new[b][low[b]] = (new[b][low[b]] << _WORD) | stream[at[b] : at[b] + k].astype(np.uint64)
                    at[b] += k
            x = new
        return [self.symbols[out[b].ravel()[: p[0]]] for b, p in enumerate(parts)]

    def _segments(self, block: int) -> list[tuple[int, np.ndarray, int, np.ndarray]]:
        """The stretches from the block's begin and its checkpoints to the next one: what _decode() takes."""
        n, states, marks, stream = self._parts(block)
        per = self.checkpoint * self.lanes
        begins = [(0, states), *marks]
        return [(min(per, n - i * per) if i < len(marks) else n - i * per, st, at, stream) for i, (at, st) in enumerate(begins)]

    def ids(self) -> np.ndarray:
        """All ids, from all checkpoints of all blocks at once; raises if a block's checksum differs."""
        parts = [self._segments(b) for b in range(len(self.blocks))]
        got = iter(self._decode([x for p in parts for x in p]) if parts else [])
        out = []
        for (_, crc), p in zip(self.blocks, parts):
            x = np.concatenate([next(got) for _ in p])
            if zlib.crc32(x.astype("<u4").tobytes()) != crc:
                raise ValueError("a block's checksum differs")
            out.append(x)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def between(self, a: int, b: int) -> np.ndarray:
        """The ids at places a to b, from the stretches between checkpoints that hold them; without a checksum."""
        block, out = self.steps * self.lanes, []
        for k in range(a // block, -(-b // block)):
            at = k * block
            own = []
            for s in self._segments(k):
                if at < b and at + s[0] > a:
                    own.append((s, at))
                at += s[0]
            out += [x[max(0, a - at) : b - at] for x, (_, at) in zip(self._decode([s for s, _ in own]), own)] if own else []
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def document(self, i: int) -> np.ndarray:
        """The ids of the document at place i of the index."""
        stop = int(self.counts[: i + 1].sum())
        return self.between(stop - int(self.counts[i]), stop)

    def from_checkpoint(self, block: int, mark: int) -> np.ndarray:
        """The ids of a block from its checkpoint number mark (from 0) on."""
        n, _, marks, stream = self._parts(block)
        at, states = marks[mark]
        return self._decode([(n - (mark + 1) * self.checkpoint * self.lanes, states, at, stream)])[0]


# -- tokenising -----------------------------------------------------------------------------------------------------

# Kinds of bytes: 0 white space, 1 ASCII letters and digits, 2 signs, 3 all others.
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = _KIND[65:91] = _KIND[97:123] = 1
_KIND[[ord(c) for c in ".,;:!?*$#%&"]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


STANDARD = "word_bpe_49k.json"


class Words:
    """Ids of words, each distinct word by the library once.

    White space always parts what the tokenizer sees as words, and so does the step from an ASCII letter or digit to
    one of some signs, or back. So texts are cut there, as arrays of bytes, and looked up in a WordTable; ASCII is
    lower-cased first, as the tokenizer does, but for words with "<", which may name special tokens. That is so for
    the file named STANDARD; for another the library gets whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.kind = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.table = WordTable(self._learn, self.kind)
        self.standard = os.path.basename(path) == STANDARD

    def _learn(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters only have one word end, and go through the library as lines of many."""
        words = [w.decode() for w in raw]
        out: list[np.ndarray | None] = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w.isascii() and w.isalpha()]
        for a in range(0, len(plain), 256):
            own = plain[a : a + 256]
            ids = np.array(self.library.encode(" ".join([words[i] for i in own]), add_special_tokens=False).ids, dtype=self.kind)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(own):
                for i, x in zip(own, np.split(ids, stop[:-1])):
                    out[i] = x
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.library.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, dtype=self.kind)
        return np.array([len(x) for x in out], dtype=np.int64), np.concatenate(out)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """data, offsets: UTF-8 of texts. The number of ids of each text, with the end id, and all ids."""
        docs = len(offsets) - 1
        if not self.standard:
            raw, at = data.tobytes(), offsets.tolist()
            got = [e.ids for e in self.library.encode_batch_fast([raw[a:b].decode() for a, b in zip(at[:-1], at[1:])], add_special_tokens=False)]
            return np.array([len(x) + 1 for x in got], dtype=np.int64), np.array([i for x in got for i in (*x, end)], dtype=self.kind)
        kind = _KIND[data]
        first = kind > 0
        first[1:] &= (kind[:-1] == 0) | ((kind[1:] == 1) & (kind[:-1] == 2)) | ((kind[1:] == 2) & (kind[:-1] == 1))
        begin = offsets[:-1][offsets[:-1] < len(data)]
        first[begin] = kind[begin] > 0
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.ones(docs, np.int64), np.full(docs, end, self.kind)
        low = _LOWER[data]
        angle = np.flatnonzero(data == 60)
        if len(angle):  # words with "<" stay as they are
            for w in np.unique(np.searchsorted(starts, angle, side="right") - 1).tolist():
                a, b = starts[w], starts[w + 1] if w + 1 < len(starts) else len(data)
                low[a:b] = data[a:b]
        inside = kind > 0
        size, ids = self.table.ids(low[inside], np.flatnonzero(first[inside]))
        of = np.append(0, np.cumsum(size))[np.searchsorted(starts, offsets)]
        return np.diff(of) + 1, np.insert(ids, of[1:], self.kind.type(end))


_WORDS: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


# -- frames ---------------------------------------------------------------------------------------------------------


def _bounds(rows: DataFrame, part_bytes: int) -> list[int]:
    """Bounds of ranges of doc_id with about part_bytes of text each, were all rows as long."""
    size, some = rows.agg(F.sum(F.octet_length("text")), F.count("doc_id")).first()
    parts = min(100_000, -(-(size or 0) // part_bytes))
    if parts < 2 or not some:
        return []
    share = [i / parts for i in range(1, parts)]
    return sorted(set(rows.agg(F.percentile_approx("doc_id", share, 10 * parts)).first()[0]))


def write_shards(docs: DataFrame, out: str, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = 2, shard_ids: int = 1 << 22, part_bytes: int = 12 << 20) -> None:
    """Writes rows of part, shard, first (ids of the part before it), n_ids and payload to the folder out."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    bounds = np.array(_bounds(rows, part_bytes), dtype=np.int64)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words_of(path)
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                n, x = own.encode(*utf8(piece.column(1)), end)
                ends = np.append(0, np.cumsum(n)) * x.itemsize
                known = piece.column(0)
                part = np.where(known.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(bounds, known.fill_null(0).to_numpy(), side="left"))
                data = x.tobytes()
                ids = pa.array([data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), known, ids], names=["part", "doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = words_of(path).kind
        part, shard, first = -1, 0, 0
        docs_, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            counts = np.array([len(x) // kind.itemsize for x in ids], dtype=np.int64)
            payload = encode_shard(docs_, counts, np.frombuffer(b"".join(ids), dtype=kind))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())], names=["part", "shard", "first", "n_ids", "payload"])

        for batch in batches:
            for p, d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if docs_ and (p != part or held >= shard_ids):
                    yield flush()
                    shard, first = shard + 1, first + held
                    docs_, ids, held = [], [], 0
                if p != part:
                    part, shard, first = p, 0, 0
                docs_.append(d)
                ids.append(x)
                held += len(x) // kind.itemsize
        if docs_:
            yield flush()

    coded = rows.mapInArrow(tokenise, "part int, doc_id bigint, ids binary")
    ordered = coded.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(run, "part int, shard int, first bigint, n_ids bigint, payload binary").write.parquet(out)


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian 32-bit)."""
    shards = spark.read.parquet(out)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, base, payload in zip(*(batch.column(i) for i in range(3))):
                s = Shard(payload.as_py())
                raw = s.ids().astype("<u4").tobytes()
                stop = np.cumsum(s.counts)
                start = stop - s.counts
                for a in range(0, len(stop), 2000):
                    cut = slice(a, a + 2000)
                    data = [raw[4 * i : 4 * j] for i, j in zip(start[cut].tolist(), stop[cut].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids[cut], pa.int64()), pa.array(start[cut] + first.as_py() + base.as_py()), pa.array(s.counts[cut].astype(np.int64)), pa.array(data, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return shards.join(F.broadcast(parts), "part").select("first", "base", "payload").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    out = scratch_dir(docs.sparkSession)
    write_shards(docs, out, doc_id, text)
    return read_shards(docs.sparkSession, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
