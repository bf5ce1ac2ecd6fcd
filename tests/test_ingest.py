"""Books unpacked, split, dealt into chapters and kept from finished volumes."""

import io
import zipfile

from weftline.file_queries import _docx, _epub
from weftline.sources import ingest

TEXTS = ["Chapter one", "First & <second>.", "Дождь. Снег.", "Chapter two", "Third\ttab"]
HEADS = [True, False, False, True, False]


def frame(spark, files):
    return spark.createDataFrame([(p, None if c is None else bytearray(c)) for p, c in files.items()], "path string, content binary")


def test_formats_agree(spark):
    markdown = "\n\n".join(f"## {t}" if h else t.replace(" ", "\n") for t, h in zip(TEXTS, HEADS, strict=True)).encode()
    files = {"/x/a.docx": _docx(TEXTS, HEADS), "/x/b.epub": _epub(TEXTS, HEADS), "/x/c.md": markdown, "/x/d.pdf": b"%PDF", "/x/E.DOCX": _docx(TEXTS, HEADS)}
    rows = ingest.book_paragraphs(frame(spark, files)).collect()
    got = {p: [(r.pos, r.heading, " ".join(r.text.split())) for r in sorted(rows, key=lambda r: r.pos) if r.path == p] for p in files}
    want = [(i, h, " ".join(t.split())) for i, (t, h) in enumerate(zip(TEXTS, HEADS, strict=True), 1)]
    assert got == {"/x/a.docx": want, "/x/b.epub": want, "/x/c.md": want, "/x/d.pdf": [], "/x/E.DOCX": want}
    assert ingest.book_paragraphs(frame(spark, files).limit(0)).count() == 0


def test_damaged_books_are_one_row_each(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("word/document.xml", "<w:p>not closed")
    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    files = {"/a.docx": b"no zip", "/b.docx": empty.getvalue(), "/c.docx": out.getvalue(), "/d.epub": empty.getvalue(), "/e.md": b"\xff\xfe", "/f.docx": None, "/g.md": b"fine"}
    got = {r.path: r.fault for r in ingest.book_paragraphs(frame(spark, files)).collect()}
    assert got == {"/a.docx": "BadZipFile", "/b.docx": "KeyError", "/c.docx": "ParseError", "/d.epub": "KeyError", "/e.md": "UnicodeDecodeError", "/f.docx": "BadZipFile", "/g.md": None}


def test_chapters_splits_and_finished_volumes(spark):
    rows = [("a", 1, False, "before", None), ("a", 2, True, "One", None), ("a", 3, False, "p", None), ("a", 4, False, "q", None), ("a", 5, True, "Two", None), ("a", 6, False, "r", None), ("b", None, None, None, "KeyError")]
    d = spark.createDataFrame(rows, "path string, pos int, heading boolean, text string, fault string")
    got = sorted((r.path, r.chapter, r.para_no, r.text) for r in ingest.chapters_by_heading(d).collect())
    assert got == [("a", 0, 1, "before"), ("a", 1, 1, "p"), ("a", 1, 2, "q"), ("a", 2, 1, "r")]
    flat = spark.createDataFrame([("a", i, "x" * 10) for i in range(1, 11)], "path string, pos int, text string")
    pattern = spark.createDataFrame([("a", 1, 300), ("a", 2, 700)], "path string, chapter int, size int")
    dealt = sorted((r.chapter, r.para_no) for r in ingest.chapters_by_size(flat, pattern).collect())
    assert dealt == [(1, i) for i in (1, 2, 3)] + [(2, i) for i in range(1, 8)]
    long_ = spark.createDataFrame([("a", 1, "One. Two! " * 5), ("a", 2, " short one. stays ")], "path string, para_no int, text string")
    texts = [r.text for r in ingest.unglued(long_, ["path"], longest=30).orderBy("para_no").collect()]
    assert texts == ["One.", "Two!"] * 5 + ["short one. stays"]
    volumes = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "volume int, text string")
    assert {r.text for r in ingest.open_volumes(volumes, spark.createDataFrame([(1,)], "volume int")).collect()} == {"y", "z"}
