"""Token counts as delta-maintained rollups.

A change is a signed row: +1 for a document with its count, -1 to take one back; a revised count is both, the old one
taken back and the new one put in. A batch of changes is summed by source, language and tokenizer version, which is all
that is stored of it: totals are the sums of all batches' deltas, so batches may be committed in any order.

The store is a folder: deltas/<batch>/ has one Parquet table for each batch, and totals/<n>/ the sums of compacted ones
and the names of the batches in them. Either is written aside and then renamed to its name, which commits it: a name
that is there already is never written again. So a batch that is committed twice, or by two jobs at once, counts once, and
a commit that was broken off leaves nothing that counts. (The rename is atomic on HDFS and local disks; on an object store
without renames one job at a time may commit.) A compaction sums the batches that it has listed, no others, and deltas
stay until they are deleted by hand, so readers and writers may go on meanwhile.

Null sources, languages and versions are groups of their own. A null count is 0 tokens; null and empty texts have 0
tokens; documents that repeat are each counted. Groups whose documents and
tokens are all taken back leave the totals. An empty batch is committed, with no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe
from lodestone.llm._text import slices, utf8
from lodestone.llm.rans import words_of

KEYS = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint"


def counted(docs: DataFrame, tokenizers: dict[str, Column], sign: int | Column = 1, source: str = "source", lang: str = "lang") -> DataFrame:
    """Signed changes: a row for each document and tokenizer version. tokenizers: a column of counts by version.
    sign: 1 or -1, or a column with the signed number of documents that a row stands for, each with these counts."""
    counts = F.array(*(F.struct(F.lit(v).alias("tokenizer"), c.cast("bigint").alias("n")) for v, c in tokenizers.items()))
    each = docs.select(F.col(source).alias("source"), F.col(lang).alias("lang"), (F.lit(sign) if isinstance(sign, int) else sign).alias("sign"), F.explode(counts).alias("t"))
    return each.select("source", "lang", "t.tokenizer", "sign", F.col("t.n").alias("n_tokens"))


def deltas(changes: DataFrame) -> DataFrame:
    """Changes (the keys, sign, n_tokens) summed by key, before and after the shuffle."""
    return changes.groupBy(*KEYS).agg(F.sum(F.col("sign").cast("bigint")).alias("n_docs"), F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).cast("bigint").alias("n_tokens"))


class RollupStore:
    """A folder of committed deltas, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _committed(self, kind: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{kind}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def _rename(self, aside: str, name: str) -> bool:
        """Gives a written folder its name; False if the name is taken, and then the folder goes."""
        fs, source = self._fs(aside)
        _, target = self._fs(name)
        fs.mkdirs(target.getParent())
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(source, target, options)
        except Exception:
            if not fs.exists(target):
                raise
            fs.delete(source, True)
            return False
        return True

    def _aside(self) -> str:
        return f"{self.path}/aside/{uuid.uuid4().hex}"

    def batches(self) -> list[str]:
        """The batches whose changes count."""
        return sorted({*self._committed("deltas"), *self._held()[1]})

    def _held(self) -> tuple[str | None, list[str]]:
        """The newest compacted totals, and the batches in them."""
        done = self._committed("totals")
        if not done:
            return None, []
        at = f"{self.path}/totals/{max(done, key=int)}"
        return f"{at}/sums", [r["batch"] for r in self.spark.read.schema("batch string").json(f"{at}/held").collect()]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch; False if it was there already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.=-]*", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if batch in self.batches():
            return False
        aside = self._aside()
        deltas(changes).write.parquet(aside)
        return self._rename(aside, f"{self.path}/deltas/{batch}")

    def _sums(self, at: str | None, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/deltas/{b}" for b in names] + ([at] if at else [])
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 OR n_tokens <> 0")

    def _listed(self) -> tuple[str | None, list[str], list[str]]:
        at, held = self._held()
        return at, held, [b for b in self._committed("deltas") if b not in set(held)]

    def totals(self) -> DataFrame:
        at, _, names = self._listed()
        return self._sums(at, names)

    def compact(self) -> bool:
        """Sums the batches that are there now into one table, which holds their names too; False if another
        compaction came first. Their deltas may be deleted afterwards."""
        done = self._committed("totals")
        at, held, names = self._listed()
        aside = self._aside()
        self._sums(at, names).write.parquet(f"{aside}/sums")
        self.spark.createDataFrame([(b,) for b in sorted({*held, *names})], "batch string").coalesce(1).write.json(f"{aside}/held")
        return self._rename(aside, f"{self.path}/totals/{1 + max(map(int, done), default=0)}")


#: Tokenizer versions by their files.
VERSIONS = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "word_bpe_49k": "word_bpe_49k.json"}


def tokens_of(docs: DataFrame, texts: dict[str, str], keep: list[str]) -> DataFrame:
    """The columns in keep, and the numbers of tokens of whole texts: for each name in texts, which gives the text's
    column, <name>_byte and <name>_word. A null text has none, and is not tokenised."""
    types = dict(docs.dtypes)
    of, path, pattern = public_tokenizers.path, VERSIONS["byte_bpe_50k"], public_tokenizers.PATTERN
    names = [f"{n}_{k}" for n in texts for k in ("byte", "word")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte, word = byte_bpe.codec(of(path), pattern), words_of(of(VERSIONS["word_bpe_49k"]))
        for batch in batches:
            for part in slices(batch, f"__{next(iter(texts))}", 2 << 20):
                counts = []
                for n in texts:
                    data, offsets = utf8(part.column(part.schema.get_field_index(f"__{n}")))
                    counts += [byte.encode_batch(data, offsets)[0], word.encode(data, offsets, 0)[0] - 1]  # without the end id
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(c.astype(np.int64)) for c in counts)], names=[*keep, *names])

    rows = docs.select(*keep, *(F.col(c).alias(f"__{n}") for n, c in texts.items()))
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{n} bigint" for n in names)]))
