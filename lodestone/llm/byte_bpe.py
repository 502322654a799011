"""Byte-level BPE by corpus-level merge replay, and decoding.

Texts are cut at white space in a way that the pattern cannot see, and each task reduces its texts to their distinct
pieces with their numbers; these are summed over the corpus, so that each distinct piece of the corpus is one row of one
dictionary, and is replayed once. In the replay the bytes of the pieces' distinct words (the matches of the pattern) lie in
one array of tokens with links to the next and previous one.
An inverted index maps each pair's rank to the positions at which the pair stands. Ranks are taken in order; a rank's
merges are applied to all its positions at once, and only the pairs with the touched neighbours are entered anew, as
lists under their own ranks. Texts are then encoded by looking pieces up, all at once, and no text is shuffled.

The dictionary is a table in the shared folder. Encoders hold its most frequent pieces, at most `held` of at most
LONGEST bytes (some 7 MB, 20 at most, which bounds what is broadcast); they replay pieces beyond that themselves, slice by
slice, and keep up to 300,000 of them.

Merging all positions of a rank at once equals merging the lowest-ranked, leftmost pair of a word again and again
unless a merge makes a pair of a lower or equal rank. Words in which that happens are encoded one by one in the plain
way, so ids always are those of the plain way, for any table of ranks.

Null texts are empty, and empty texts have no ids. Texts are never cut. Rows that repeat a doc_id are each returned;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import materialise
from lodestone.llm._text import distinct_runs, expand, slices, tidy, utf8
from lodestone.llm._words import WordTable


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def plain_encode(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One word: the lowest-ranked, leftmost pair is merged until there is none."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


#: Positions of one rank up to which merging them one by one is faster than in arrays.
FEW = 40


class MergeReplay:
    """ranks: every single byte and every merged token, by its bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.top = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.top + b)
                    made.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.made = np.array(keys, dtype=np.int64)[order], np.array(made, dtype=np.int64)[order]
        self.rank_of = dict(zip(keys, made))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or -1."""
        key = left * self.top + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.made[at], -1)

    def encode(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word."""
        count, ids = self.replay(pieces)
        ids, stop = ids.tolist(), np.cumsum(count).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *stop[:-1]], stop)]

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and all ids."""
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        ranks = self.ranks
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        token = self.byte_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        n = len(token)
        end = np.cumsum(size)
        word = np.repeat(np.arange(len(pieces)), size)
        nxt = np.arange(1, n + 1)
        nxt[end[size > 0] - 1] = n
        prv = np.arange(-1, n - 1)
        prv[(end - size)[size > 0]] = -1
        alive = np.ones(n + 1, dtype=bool)
        alive[n] = False
        token = np.append(token, -1)
        odd = np.zeros(len(pieces), dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        single: dict[int, list[int]] = {}  # positions that were entered alone
        todo: list[int] = []
        rank_of, top = self.rank_of.get, self.top

        def merge_few(r: int, places: list[int]) -> None:
            """The merges of a rank at a few positions, one after the other."""
            for p in sorted(set(places)):
                q = int(nxt[p])
                if not alive[p] or q >= n or rank_of(int(token[p]) * top + int(token[q])) != r:
                    continue
                after, before = int(nxt[q]), int(prv[p])
                token[p], alive[q], nxt[p] = r, False, after
                pairs = []
                if after < n:
                    prv[after] = p
                    pairs.append((p, rank_of(r * top + int(token[after]))))
                if before >= 0:
                    pairs.append((before, rank_of(int(token[before]) * top + r)))
                for place, rank in pairs:
                    if rank is None:
                        continue
                    if rank <= r:
                        odd[word[p]] = True
                    if rank in single:
                        single[rank].append(place)
                    else:
                        single[rank] = [place]
                        if rank not in index:
                            heapq.heappush(todo, rank)

        def enter(pos: np.ndarray, rank: np.ndarray) -> None:
            known = rank >= 0
            pos, rank = pos[known], rank[known]
            if not len(pos):
                return
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            cut = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
            for a, b, r in zip(cut.tolist(), [*cut[1:].tolist(), len(rank)], rank[cut].tolist()):
                if r in index:
                    index[r].append(pos[a:b])
                else:
                    index[r] = [pos[a:b]]
                    if r not in single:
                        heapq.heappush(todo, r)

        first = np.flatnonzero(nxt < n)
        enter(first, self._rank(token[first], token[nxt[first]]))
        while todo:
            r = heapq.heappop(todo)
            lists, alone = index.pop(r, []), single.pop(r, [])
            if len(alone) + sum(map(len, lists)) <= FEW:
                merge_few(r, alone + [p for x in lists for p in x.tolist()])
                continue
            if alone:
                lists.append(np.array(alone, dtype=np.int64))
            pos = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            pos = pos[alive[pos]]
            right = nxt[pos]
            ok = right < n
            pos, right = pos[ok], right[ok]
            ok = self._rank(token[pos], token[right]) == r
            pos, right = pos[ok], right[ok]
            if not len(pos):
                continue
            if len(pos) > 1 and (right[:-1] == pos[1:]).any():  # runs of one token: every second position from the left
                linked = np.append(False, right[:-1] == pos[1:])
                begin = np.maximum.accumulate(np.where(linked, 0, np.arange(len(pos))))
                ok = (np.arange(len(pos)) - begin) % 2 == 0
                pos, right = pos[ok], right[ok]
            after = nxt[right]
            if len(pos) > 1 and (beside := after[:-1] == pos[1:]).any():  # a pair that the next merge takes apart again
                between = self._rank(np.full(int(beside.sum()), r), token[after[:-1][beside]])
                odd[word[pos[:-1][beside][(between >= 0) & (between <= r)]]] = True
            token[pos] = r
            alive[right] = False
            nxt[pos] = after
            inner = after < n
            prv[after[inner]] = pos[inner]
            before = prv[pos]
            has = before >= 0
            lefts, rights = before[has], pos[inner]
            new = np.unique(np.concatenate([lefts, rights]))
            rank = self._rank(token[new], token[nxt[new]])
            odd[word[new[(rank >= 0) & (rank <= r)]]] = True
            enter(new, rank)
        stays = np.flatnonzero(alive[:n])
        ids, count = token[stays].astype(np.int32), np.bincount(word[stays], minlength=len(pieces))
        if odd.any():
            parts = np.split(ids, np.cumsum(count)[:-1])
            for i in np.flatnonzero(odd).tolist():
                parts[i] = np.array(plain_encode(pieces[i], ranks), dtype=np.int32)
            ids, count = np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)
        return count, ids


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut so that the pattern matches the pieces as it matches the texts: a word has the one blank
    before it; other white space before a word is matched as all but its last character and that; white space at the
    end is one match. Texts with other white space than ASCII, and control characters that some call so, are only cut
    at single blanks between ASCII characters."""
    blank = _BLANK[data]
    start = np.zeros(len(data), dtype=bool)
    head = np.zeros(len(data), dtype=bool)
    head[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.append(True, blank[:-1]) | head  # before the character is white space, or nothing
    word = ~blank & before
    at = np.flatnonzero(word & ~head)
    tied = data[at - 1] == 32
    start[at[tied] - 1] = True
    start[at[~tied]] = True
    start[at[~tied] - 1] = True  # the last of other white space
    start |= head
    run = blank & ~np.append(False, blank[:-1])
    start |= run
    wide = _wide_blanks(data)
    if len(wide):
        plain = (data > 0x20) & (data < 0x7F)
        safe = head.copy()
        safe[1:-1] |= (data[1:-1] == 32) & plain[:-2] & plain[2:] & ~head[2:]
        rows = np.unique(np.searchsorted(offsets, wide, side="right") - 1)
        for a, b in zip(offsets[rows].tolist(), offsets[rows + 1].tolist()):
            start[a:b] = safe[a:b]
    return np.flatnonzero(start)


def _wide_blanks(data: np.ndarray) -> np.ndarray:
    """The places of the first bytes of white space that is not ASCII, and of the separators 0x1C to 0x1F."""
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)) | (data >= 0x1C) & (data <= 0x1F))
    if not len(lead):
        return lead
    follow = np.append(data, np.zeros(2, np.uint8))
    a, b, c = follow[lead], follow[lead + 1], follow[lead + 2]
    wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (a == 0xE2) & (b == 0x81) & (c == 0x9F) | (a == 0xE3) & (b == 0x80) & (c == 0x80) | (a < 0x20)
    return lead[wide]


def pieces_at(data: np.ndarray, offsets: np.ndarray, pattern: str) -> np.ndarray:
    """Where the pieces begin; a pattern that is not known gets whole texts."""
    return segments(data, offsets) if pattern == public_tokenizers.PATTERN else np.unique(offsets[:-1][np.diff(offsets) > 0])


#: The last table of ranks, by its path.
_REPLAYS: dict[str, MergeReplay] = {}


def replay_of(path: str) -> MergeReplay:
    if path not in _REPLAYS:
        _REPLAYS.clear()
        _REPLAYS[path] = MergeReplay(load_ranks(path))
    return _REPLAYS[path]


class Codec:
    """Texts to ids and back. What is kept between texts is the table of pieces, and small tables of all tokens."""

    def __init__(self, path: str, pattern: str, cache: int = 300_000, start: tuple[np.ndarray, ...] | None = None):
        self.replay, self.pattern, self.split = replay_of(path), pattern, regex.compile(pattern).findall
        self.table = WordTable(self.learn, np.dtype("<i4"), cache, start)
        top = self.replay.top
        raw = [self.replay.bytes_of.get(i, b"") for i in range(top)]
        self.raw_size = np.array([len(b) for b in raw], dtype=np.int64)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        text = [b"%d " % i for i in range(top)]
        self.text_size = np.array([len(b) for b in text], dtype=np.int64)
        self.text_at = np.cumsum(self.text_size) - self.text_size
        self.text = np.frombuffer(b"".join(text), dtype=np.uint8)

    def learn(self, segments_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words of the new segments go through one merge replay. The number of ids of each segment, and all ids."""
        number: dict[str, int] = {}
        of: list[int] = []
        per = np.empty(len(segments_), dtype=np.int64)
        for k, s in enumerate(segments_):
            words = self.split(s.decode())
            per[k] = len(words)
            of += [number.setdefault(w, len(number)) for w in words]
        raw = [w.encode() for w in number]
        one = np.array([self.replay.ranks.get(w, -1) for w in raw], dtype=np.int32)
        todo = np.flatnonzero(one < 0)
        n, ids = self.replay.replay([raw[i] for i in todo.tolist()])
        size, at = np.ones(len(raw), np.int64), np.arange(len(raw)) + len(ids)
        size[todo], at[todo] = n, np.cumsum(n) - n
        ids, which = np.concatenate([ids, one]), np.array(of, dtype=np.int64)
        stop = np.append(0, np.cumsum(size[which]))[np.append(0, np.cumsum(per))]
        return np.diff(stop), ids[expand(at[which], size[which])]

    def encode_batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data, offsets: UTF-8 of texts. The number of ids of each text, and all ids."""
        docs = len(offsets) - 1
        if not len(data):
            return np.zeros(docs, np.int64), np.zeros(0, np.int32)
        cut = pieces_at(data, offsets, self.pattern)
        size, ids = self.table.ids(data, cut)
        of = np.append(0, np.cumsum(size))[np.searchsorted(cut, offsets)]
        return np.diff(of), ids

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        n, ids = self.encode_batch(*utf8(pa.array(list(texts), pa.string())))
        stop = np.cumsum(n).tolist()
        return (ids[a:b].tolist() for a, b in zip([0, *stop[:-1]], stop))

    def decode(self, ids: Iterable[int]) -> bytes:
        x = np.asarray(ids if isinstance(ids, np.ndarray) else list(ids), dtype=np.int64)
        return self.raw[expand(self.raw_at[x], self.raw_size[x])].tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids as decimals joined by one blank."""
        return self.text[expand(self.text_at[ids], self.text_size[ids])][:-1].tobytes()


#: One codec for each worker process, file and dictionary.
_CODECS: dict[tuple, Codec] = {}


def codec(path: str, pattern: str, key: str = "", start: tuple[np.ndarray, ...] | None = None) -> Codec:
    if (path, pattern, key) not in _CODECS:
        _CODECS.clear()
        _CODECS[path, pattern, key] = Codec(path, pattern, start=start)
    return _CODECS[path, pattern, key]


#: The most bytes of a piece that encoders hold from the dictionary.
LONGEST = 48


def dictionary(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, chunk_bytes: int = 1 << 20, most: int = 100_000) -> DataFrame:
    """piece (binary), n (how often the corpus has it) and ids, for every distinct piece, as a written table. A task
    sends a piece once, or once for each `most` distinct ones."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["piece", "n"])

        for batch in batches:
            for part in slices(batch, "text", chunk_bytes):
                data, offsets = utf8(part.column(0))
                cut = pieces_at(data, offsets, pattern) if len(data) else offsets[:0]
                if not len(cut):
                    continue
                length = np.diff(np.append(cut, len(data)))
                _, where, back = distinct_runs(data, cut, length)
                raw = data.tobytes()
                for a, n, k in zip(cut[where].tolist(), length[where].tolist(), np.bincount(back).tolist()):
                    piece = raw[a : a + n]
                    total[piece] = total.get(piece, 0) + k
                if len(total) > most:
                    yield send()
                    total.clear()
        if total:
            yield send()

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = codec(path, pattern), []

        def send() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            n, ids = own.learn(table.column(0).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(ids))
            return pa.Table.from_arrays([table.column(0), table.column(1), lists], names=["piece", "n", "ids"]).combine_chunks().to_batches()[0]

        for batch in batches:
            for part in slices(batch, "piece", 4 * chunk_bytes, most):
                held.append(part)
                if sum(x.num_rows for x in held) >= most or sum(x.nbytes for x in held) >= 8 * chunk_bytes:
                    yield send()
                    held.clear()
                    tidy()
        if held:
            yield send()

    pieces = docs.select(F.col(text).alias("text")).mapInArrow(count, "piece binary, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    return materialise(pieces.mapInArrow(replay, "piece binary, n bigint, ids array<int>"))


def frequent(pieces: DataFrame, held: int) -> tuple[np.ndarray, ...]:
    """The pieces of a dictionary that are found at least so often that there are at most `held` of them: their bytes,
    lengths, numbers of ids and ids."""
    level = F.floor(F.log2("n") * 16)
    own = pieces.filter(F.length("piece") <= LONGEST).select("piece", "ids", level.alias("level"))
    left, least = held, None
    for r in sorted(own.groupBy("level").agg(F.count("*").alias("k")).collect(), key=lambda r: -r["level"]):
        if r["k"] > left:
            break
        left, least = left - r["k"], r["level"]
    rows = own.filter(F.col("level") >= least if least is not None else F.lit(False)).select("piece", "ids").toArrow()
    piece, ids = rows.column("piece").to_pylist(), rows.column("ids")
    flat = ids.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32) if len(piece) else np.zeros(0, np.int32)
    n = pc.list_value_length(ids).to_numpy().astype(np.int64) if len(piece) else np.zeros(0, np.int64)
    return np.frombuffer(b"".join(piece), dtype=np.uint8), np.array([len(x) for x in piece], dtype=np.int64), n, flat


def _mapped(docs: DataFrame, doc_id: str, text: str, path: str, pattern: str, chunk_bytes: int, fields: list, row, held: int) -> DataFrame:
    kind = dict(docs.dtypes)[doc_id]
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(frequent(dictionary(docs, "text", path, pattern, chunk_bytes), held))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, key, sent.value)
        for batch in batches:
            for part in slices(batch, "text", chunk_bytes):
                n, ids = own.encode_batch(*utf8(part.column(1)))
                stop = np.cumsum(n).tolist()
                cols = list(zip(*(row(own, ids[a:b]) for a, b in zip([0, *stop[:-1]], stop))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, (_, _, t) in zip(cols, fields))], names=["doc_id", *(n for n, _, _ in fields)])

    return docs.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {s}" for n, s, _ in fields))


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, chunk_bytes: int = 1 << 20, held: int = 200_000) -> DataFrame:
    """doc_id, ids (array<int>)."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return _mapped(docs, doc_id, text, path, pattern, chunk_bytes, [("ids", "array<int>", pa.list_(pa.int32()))], lambda own, ids: (ids,), held)


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, data (binary: the bytes that the ids stand for); null ids give no bytes."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    kind = dict(encoded.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            data = [own.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {kind}, data binary")


def _digest_row(own: Codec, ids: np.ndarray) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(own.decimal(ids)).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()


def digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN, chunk_bytes: int = 1 << 20, held: int = 200_000) -> DataFrame:
    """Encodes, decodes, and returns doc_id, n_tokens, ids_sha256 and decoded_sha256 from the same ids."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return _mapped(docs, doc_id, text, path, pattern, chunk_bytes, [("n_tokens", "bigint", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())], _digest_row, held)
