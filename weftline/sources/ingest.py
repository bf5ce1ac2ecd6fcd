"""Raw books: docx, epub and Markdown files as paragraphs, and their way into aligned blocks.  Own design.

A book is one file, read whole by Spark's binary reader (or from an archive of packed files) and unpacked inside one Arrow
function with the standard library: docx and epub are zipped XML.  Everything after that is DataFrame work: glued paragraphs are
split, chapters are found by their headings or, where a book has none, dealt in proportion to another language's, and sides are
aligned.  PDF needs a library that is not at hand and is not read.

Cases: a file that is no zip, lacks its main part or holds broken XML is one row with ``fault`` and no text; a file of
another kind is left out; null contents are broken; empty paragraphs are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import strip
from weftline.operators.align import band_join, not_frozen

OUT = "path string, pos int, heading boolean, text string, fault string"
# Names of the formats' parts.
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}"
_PACKAGE = "{http://www.idpf.org/2007/opf}"
_HEADS, _BLOCKS = {f"h{i}" for i in range(1, 7)}, {"p", "div", "li", "blockquote", "td"}


def docx_paragraphs(data: bytes) -> Iterator[tuple[bool, str]]:
    """(is a heading, text) of each paragraph in order; tabs and breaks become blanks and line ends."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        root = ElementTree.fromstring(book.read("word/document.xml"))
    for p in root.iter(f"{_WORD}p"):
        style = p.find(f"{_WORD}pPr/{_WORD}pStyle")
        shown = {f"{_WORD}t": lambda e: e.text or "", f"{_WORD}tab": lambda _: "\t", f"{_WORD}br": lambda _: "\n"}
        text = "".join(shown[e.tag](e) for e in p.iter() if e.tag in shown)
        yield (style is not None and style.get(f"{_WORD}val", "").lower().startswith(("heading", "title"))), text


def _html_paragraphs(data: bytes) -> Iterator[tuple[bool, str]]:
    """Innermost block elements of an XHTML page; what no block holds is left out."""
    for e in ElementTree.fromstring(data).iter():
        name = e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""
        if name in _HEADS or (name in _BLOCKS and not any(c.tag.rsplit("}", 1)[-1] in _BLOCKS | _HEADS for c in e.iter() if c is not e and isinstance(c.tag, str))):
            yield name in _HEADS, " ".join("".join(e.itertext()).split())


def epub_paragraphs(data: bytes) -> Iterator[tuple[bool, str]]:
    """(is a heading, text) of each paragraph of the pages in the order of the book's spine."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        place = ElementTree.fromstring(book.read("META-INF/container.xml")).find(f".//{_CONTAINER}rootfile").get("full-path")
        package = ElementTree.fromstring(book.read(place))
        files = {i.get("id"): i.get("href") for i in package.iter(f"{_PACKAGE}item")}
        for ref in package.iter(f"{_PACKAGE}itemref"):
            yield from _html_paragraphs(book.read(posixpath.join(posixpath.dirname(place), files[ref.get("idref")])))


def markdown_paragraphs(data: bytes) -> Iterator[tuple[bool, str]]:
    """Pieces between blank lines, their lines joined; headings are lines that begin with #."""
    for piece in re.split(r"\n\s*\n", data.decode("utf-8").replace("\r\n", "\n")):
        head = piece.strip().startswith("#")
        yield head, (piece.strip().lstrip("#") if head else " ".join(piece.split()))


READERS = {".docx": docx_paragraphs, ".epub": epub_paragraphs, ".md": markdown_paragraphs}


def books(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the books under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def book_paragraphs(files: DataFrame) -> DataFrame:
    """OUT rows of (path, content): every paragraph of every book, ``pos`` from 1; a row with a fault for each book that cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                reader = READERS.get(posixpath.splitext(path or "")[1].lower())
                if reader is None:
                    continue
                try:
                    found = [(h, t.strip()) for h, t in reader(data or b"")]
                    rows = [(i, h, t, None) for i, (h, t) in enumerate(((h, t) for h, t in found if t), 1)]
                except (zipfile.BadZipFile, KeyError, AttributeError, ElementTree.ParseError, UnicodeDecodeError, OSError) as error:
                    rows = [(None, None, None, type(error).__name__)]
                kinds = (pa.int32(), pa.bool_(), pa.string(), pa.string())
                columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows), pa.string()), *columns], ["path", "pos", "heading", "text", "fault"])

    return files.select("path", "content").mapInArrow(run, OUT)


def chapters_by_heading(paragraphs: DataFrame) -> DataFrame:
    """(path, chapter, para_no, text): a heading begins a chapter (from 1) and is no paragraph; text before the first is chapter 0."""
    from pyspark.sql import Window as W

    upto = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = paragraphs.where("fault IS NULL").withColumn("chapter", F.count_if("heading").over(upto).cast("int")).where("NOT heading")
    return d.select("path", "chapter", F.row_number().over(W.partitionBy("path", "chapter").orderBy("pos")).alias("para_no"), "text")


def chapters_by_size(paragraphs: DataFrame, pattern: DataFrame, key: str = "path") -> DataFrame:
    """(key, chapter, para_no, text) of books without headings (key, pos, text): dealt in proportion to the chapters (key, chapter, size) of another language's."""
    from pyspark.sql import Window as W

    own = paragraphs.select(key, F.col("pos").alias("para_no"), F.length("text").alias("size"), "text")
    placed = band_join(own.select(key, "para_no", "size"), pattern.select(key, F.col("chapter").alias("block_no"), "size"), key)
    d = own.join(placed, [key, "para_no"]).withColumnRenamed("block_no", "chapter")
    return d.select(key, "chapter", F.row_number().over(W.partitionBy(key, "chapter").orderBy("para_no")).alias("para_no"), "text")


def unglued(paragraphs: DataFrame, keys: list[str], longest: int = 600, order: str = "para_no") -> DataFrame:
    """keys, para_no, text: paragraphs of more than ``longest`` characters as their sentences; shorter ones as they are."""
    from pyspark.sql import Window as W

    from weftline.functions.text import sentences

    parts = F.when(F.length("text") > longest, sentences(F.col("text"))).otherwise(F.array(strip(F.col("text"))))
    d = paragraphs.select(*keys, F.col(order).alias("_o"), F.posexplode(parts).alias("_i", "text")).where("text <> ''")
    return d.select(*keys, F.row_number().over(W.partitionBy(*keys).orderBy("_o", "_i")).alias("para_no"), "text")


def open_volumes(paragraphs: DataFrame, registry: DataFrame, volume: str = "volume") -> DataFrame:
    """Paragraphs of volumes that are not finished: a finished volume is not ingested again."""
    return not_frozen(paragraphs, registry, volume, "volume")
