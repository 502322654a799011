from pyspark.sql import functions as F

from lodestone.functions.chunking import page_spans
from lodestone.sources import pages as P

BODY = "Methods of the ring. " * 120


def files():
    return {
        "a": "Abstract\fWe use Materials.\f \flast".encode(),
        "b": "Über Ringe\fFindings are".encode("utf-16"),
        "c": b"\xff" + "ring\fbolt".encode(),
        "d": b"", "e": b" \f\n", "f": None,
        "g": ("one\f" + BODY).encode(),
    }


class Refusing:
    name = "refusing"

    def pages(self, content):
        raise OSError("broken")


def table(spark):
    return spark.createDataFrame(list(files().items()), "file string, content binary").withColumn("page", F.lit("x"))


def test_readers_in_turn(spark):
    got = {(r.file, r.page): (r.pages, r.text, r.reader, r.failed) for r in P.read_pages(table(spark), "file", "content").collect()}
    assert got["a", 2] == (4, "We use Materials.", "text_utf-8", []) and got["a", 3][1] == " "
    assert got["b", 1] == (2, "Über Ringe", "text_utf-16", ["text_utf-8: UnicodeDecodeError"])
    assert got["c", 1] == (2, "�ring", "recovered", ["text_utf-8: UnicodeDecodeError", "text_utf-16: ValueError"])
    assert got["d", None][3] == ["text_utf-8: blank", "text_utf-16: ValueError", "recovered: blank"] and got["e", None][0] == 0
    assert got["f", None] == (0, None, None, ["no content"])
    assert len(got) == 4 + 2 + 2 + 3 + 2
    twice = P.read_pages(table(spark).union(table(spark)), "file", "content", (Refusing(), *P.DEFAULT))
    assert twice.count() == 2 * len(got) and twice.filter("page > 0 AND failed[0] <> 'refusing: OSError'").count() == 0
    assert P.read_pages(table(spark).limit(0), "file", "content").count() == 0


def test_sections(spark):
    rows = [(1, 9, "Results"), (2, 9, "  Abstract of results"), (3, 9, "x" * 300 + " abstract"), (4, 9, "x" * 300 + " Experimental findings"), (5, 9, "the findings"), (6, 9, "in CONCLUSION"), (7, 9, "a bibliography"), (9, 9, "at the end"), (8, 9, "")]
    d = spark.createDataFrame(rows, "page int, pages int, text string")
    got = {r.page: (r.section, r.quality) for r in P.with_sections(d).collect()}
    assert got == {1: ("abstract", 1.0), 2: ("abstract", 1.0), 3: ("body", 0.7), 4: ("methods", 1.0), 5: ("results", 1.0), 6: ("discussion", 0.8), 7: ("references", 0.3), 9: ("references", 0.3), 8: ("body", 0.7)}


def test_passages_are_cited_by_page(spark):
    read = P.with_sections(P.read_pages(table(spark), "file", "content"))
    got = P.page_passages(read, "file").collect()
    texts = {(r.file, r.page): r.text for r in read.collect()}
    assert all(texts[r.file, r.page][r.span_start : r.span_end] == r.text and r.text.strip() for r in got)
    assert [(r.span_start, r.span_end) for r in got if (r.file, r.page) == ("g", 2)] == page_spans(BODY) and len(page_spans(BODY)) > 2
    assert {(r.file, r.page) for r in got} == {k for k, t in texts.items() if t.strip()}
    assert len({r.passage_id for r in got}) == len(got)
    assert sorted(r.passage_id for r in P.page_passages(read, "file").collect()) == sorted(r.passage_id for r in got)


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("one\ftwo")
    (tmp_path / "b.txt").write_bytes("drei\fvier".encode("utf-16"))
    read = P.read_pages(P.page_files(spark, str(tmp_path)), "path", "content")
    assert sorted((r.path.rsplit("/", 1)[1], r.page, r.text) for r in read.collect()) == [("a.txt", 1, "one"), ("a.txt", 2, "two"), ("b.txt", 1, "drei"), ("b.txt", 2, "vier")]
