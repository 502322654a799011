"""Chunkers: fixed strides and sections as column expressions, and sentence, page and syntax chunkers in Arrow batches.

Chunkers in batches take a key column and a text column and return the key, a number from 0, character offsets where
there are any, and the chunk. Null texts have no chunks; texts are taken whole.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def stride_chunks(text: Column, size: int = 1500, overlap: int = 200, longer_than: int = 100, most: int | None = 20) -> Column:
    """Pieces of `size` characters that begin every size - overlap; `most` is the feature's own limit, None for all."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)), F.lit(size - overlap))
    pieces = F.filter(F.transform(starts, lambda s: F.substring(text, s, F.lit(size))), lambda p: F.length(p) > longer_than)
    return pieces if most is None else F.slice(pieces, 1, most)


def markdown_sections(text: Column, least: int = 50) -> Column:
    return F.filter(F.transform(F.split(text, r"\n## "), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def context_prefix(title: Column, text: Column, most: int = 200) -> Column:
    """[title: first telling sentence] to put before a chunk."""
    lead = F.get(F.filter(F.slice(F.split(text, r"\. "), 1, 5), lambda s: F.length(s) > 20), 0)
    return F.concat(F.lit("["), F.concat_ws(": ", title, F.substring(lead, 1, most)), F.lit("]"))


def sentences(text: Column, least: int = 10) -> Column:
    """Sentences as arrays of struct(start, text): start counts from 0; shorter ones are left out.

    A sentence ends at a mark and the white space after it. Offsets are running sums of the pieces' lengths."""
    pieces = F.split(text, r"(?<=[.!?])(?=\s)")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out"))
    lead = lambda p: F.length(p) - F.length(F.regexp_replace(p, r"^\s+", ""))
    add = lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + lead(p)).alias("start"), F.regexp_replace(p, r"^\s+|\s+$", "").alias("text")))).alias("out"))
    return F.filter(F.aggregate(pieces, zero, add)["out"], lambda s: F.length(s["text"]) >= least)


def sentence_spans(text: str, size: int = 1500, overlap: int = 200, look_back: int = 200, longer_than: int = 50) -> list[tuple[int, int]]:
    """(start, end) in the text, whose white space is collapsed: a chunk ends after the last sentence mark within
    look_back of its size; the kind of mark that is looked for first wins. The next begins overlap before its end."""
    spans, start, n = [], 0, len(text)
    while start < n:
        end = start + size
        if end < n:
            for mark in (". ", ".\n", "? ", "! "):
                at = text.rfind(mark, max(end - look_back, start), end)
                if at >= 0:
                    end = at + 1
                    break
        end = min(end, n)
        a, b = start, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b - a > longer_than:
            spans.append((a, b))
        if end >= n and start + size >= n + overlap:
            break
        start = max(end - overlap, start + 1)
        if end >= n and n - start <= overlap:
            if n - start > longer_than and start > a:
                c = start
                while c < n and text[c].isspace():
                    c += 1
                spans.append((c, n))
            break
    return spans


def page_spans(text: str, size: int = 1000, overlap: int = 100) -> list[tuple[int, int]]:
    """(start, end) on a page: an end backs up to white space, but not below half the size; blank pieces are skipped."""
    spans, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            cut = end
            while cut > start + size // 2 and not text[cut].isspace():
                cut -= 1
            if cut > start + size // 2:
                end = cut
        if text[start:end].strip():
            spans.append((start, end))
            if end >= n:
                break
            start = max(end - overlap, start + 1)
        else:
            start = end
    return spans


#: Characters of chunks that are held before they are handed on.
_HELD = 1 << 20


def _spanned(df: DataFrame, key: str, text: str, cut: Callable[[str], list[tuple[int, int]]], prepare: Callable[[str], str]) -> DataFrame:
    """Texts are taken from a batch one at a time, and chunks handed on as they come: a worker holds one batch of texts."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)

            def send(rows: list[tuple], keys=keys) -> pa.RecordBatch:
                at, *rest = zip(*rows)
                return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(rest, (pa.int32(), pa.int32(), pa.int32(), pa.string())))], names=["key", "n", "start", "end", "chunk"])

            rows, held = [], 0
            for at in range(batch.num_rows):
                t = texts[at].as_py()
                if t is None:
                    continue
                t = prepare(t)
                for i, (a, b) in enumerate(cut(t)):
                    rows.append((at, i, a, b, t[a:b]))
                    held += b - a
                    if held >= _HELD:
                        yield send(rows)
                        rows, held = [], 0
            if rows:
                yield send(rows)
            pa.default_memory_pool().release_unused()

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n int, start int, end int, chunk string").withColumnRenamed("key", key)


def sentence_chunks(df: DataFrame, key: str, text: str, **limits: int) -> DataFrame:
    return _spanned(df, key, text, lambda t: sentence_spans(t, **limits), lambda t: " ".join(t.split()))


def page_chunks(df: DataFrame, key: str, text: str, **limits: int) -> DataFrame:
    return _spanned(df, key, text, lambda t: page_spans(t, **limits), lambda t: t)


@udtf(returnType="kind string, name string, class_name string, start_line int, end_line int, signature string, docstring string, imports array<string>")
class PythonChunks:
    """The module, classes, functions and methods of Python source; nothing for what does not parse."""

    def eval(self, source: str):
        if source is None:
            return
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError):
            return
        imports = sorted({a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names} | {n.module for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module})
        lines = source.count("\n") + 1
        yield "module", "", None, 1, lines, None, ast.get_docstring(tree), imports
        todo = [(n, None) for n in tree.body]
        while todo:
            n, inside = todo.pop(0)
            if isinstance(n, ast.ClassDef):
                bases = ", ".join(ast.unparse(b) for b in n.bases)
                yield "class", n.name, None, n.lineno, n.end_lineno, f"class {n.name}({bases})" if bases else f"class {n.name}", ast.get_docstring(n), imports
                todo += [(m, n.name) for m in n.body]
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                back = f" -> {ast.unparse(n.returns)}" if n.returns else ""
                word = "async def" if isinstance(n, ast.AsyncFunctionDef) else "def"
                yield "method" if inside else "function", n.name, inside, n.lineno, n.end_lineno, f"{word} {n.name}({ast.unparse(n.args)}){back}", ast.get_docstring(n), imports


def python_chunks(df: DataFrame, key: str, source: str) -> DataFrame:
    """key and the columns of PythonChunks, by a lateral join."""
    return df.select(F.col(key).alias("__key"), F.col(source).alias("__source")).lateralJoin(PythonChunks(F.col("__source").outer())).drop("__source").withColumnRenamed("__key", key)


def skeleton(source: Column) -> Column:
    """Imports, decorators, and heads of classes and functions, one below the other."""
    return F.array_join(F.filter(F.split(source, "\n"), lambda s: s.rlike(r"^\s*(import |from \S+ import |@\w|class \w|def \w|async def \w)")), "\n")
