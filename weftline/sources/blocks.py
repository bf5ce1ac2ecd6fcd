"""Block-structured text: block files, merged chapters, titles and paragraphs.

Readers take (doc_id, text); ``chapters`` makes that from files.  Line order is kept by number, never
by row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import collapse_blank_lines, strip

FIELDS = ("JA", "EN", "RU", "ED_RU")
# The markers of block files and merged chapters.
MARK = r"<!--\s*block:\s*(\d+)\s*-->"
SECTION = r"(?m)^##\s*Блок\s+(\d+)\s*$"


def chapters(spark: SparkSession, path: str, glob: str = "v*.md", folder: str | None = None) -> DataFrame:
    """(doc_id, text) of the files under ``path``; the id is the file's name without its suffix.

    With ``folder`` each file is the only one of a folder <folder>=<id>, as Spark's writers leave them.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=folder is not None)
    name = F.regexp_extract("_metadata.file_path", f"/{folder}=([^/]+)/", 1) if folder else F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1)
    return files.select(name.alias("doc_id"), F.col("value").alias("text"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line)."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n")
    return docs.select("doc_id", F.posexplode(F.split(body, "\n", -1)).alias("line_no", "line"))


def has_markers(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce(F.col("text").rlike(rf"(?m)^{MARK}\s*$"), F.lit(False)).alias("marked"))


def titles(docs: DataFrame) -> DataFrame:
    """(doc_id, title): the first line that starts with '# '."""
    found = lines(docs).where(F.col("line").startswith("# "))
    return found.groupBy("doc_id").agg(F.min_by(strip(F.substring("line", 3, 1 << 30)), "line_no").alias("title"))


def blocks(docs: DataFrame, dup: str = "last") -> DataFrame:
    """(doc_id, block_no, entry, para_no, text): the paragraphs of a block file.

    ``dup`` says what a repeated block number means: 'rows' keeps each entry, 'last' keeps the last entry,
    'merge' joins the paragraphs (lines that begin with # are dropped, other comments are text).
    Text before the first marker belongs to no block.
    """
    order = W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = strip(F.col("line"))
    head = rf"^{MARK}$" if dup != "merge" else rf"^{MARK}"
    mark = F.regexp_extract(whole, head, 1).try_cast("int")
    d = lines(docs).withColumn("mark", mark)
    d = d.withColumn("block_no", F.last("mark", ignorenulls=True).over(order)).withColumn("entry", F.count("mark").over(order).cast("int"))
    skip = F.col("line").startswith("#") if dup == "merge" else F.col("line").startswith("# ") | whole.startswith("<!--")
    d = d.withColumn("own", F.col("mark").isNull() & (whole != "") & ~skip).where("block_no IS NOT NULL AND (own OR mark IS NOT NULL)")
    if dup == "last":
        d = d.withColumn("latest", F.max("entry").over(W.partitionBy("doc_id", "block_no"))).where("entry = latest")
    per = W.partitionBy("doc_id", "block_no").orderBy("line_no") if dup == "merge" else W.partitionBy("doc_id", "block_no", "entry").orderBy("line_no")
    return d.where("own").select("doc_id", "block_no", "entry", F.row_number().over(per).alias("para_no"), whole.alias("text"))


def parsed_chapters(docs: DataFrame) -> DataFrame:
    """(doc_id, title, marked, block_no, text): blocks with repeated numbers joined by a blank line."""
    parts = F.split(F.coalesce("text", F.lit("")), MARK, -1)
    nums = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(1))
    first = F.regexp_extract(parts[0], r"(?U)^\s*([^\n]*)", 1)
    title = F.when(first.startswith("#"), strip(F.regexp_replace(first, "^#+", ""))).otherwise("")
    d = docs.select("doc_id", title.alias("title"), (F.size(nums) > 0).alias("marked"), parts.alias("parts"), nums.alias("nums"))
    d = d.select("doc_id", "title", "marked", "parts", F.posexplode_outer("nums").alias("i", "num"))
    content = collapse_blank_lines(F.get("parts", F.col("i") + 1))
    d = d.select("doc_id", "title", "marked", F.col("num").try_cast("int").alias("block_no"), "i", content.alias("text"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "text"))), lambda x: x["text"])
    joined = F.array_join(F.filter(ordered, lambda x: x != ""), "\n\n")
    return d.groupBy("doc_id", "title", "marked", "block_no").agg(F.nullif(joined, F.lit("")).alias("text"))


def merged(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, block_no, ja, en, ru, ed_ru) of merged chapters; the last of repeated fields wins, '' if absent."""
    text = F.coalesce("text", F.lit(""))
    parts = F.slice(F.split(text, SECTION, -1), 2, 1 << 30)
    nums = F.regexp_extract_all(text, F.lit(SECTION), F.lit(1))
    d = docs.select("doc_id", F.posexplode(F.arrays_zip(nums.alias("num"), parts.alias("body"))).alias("ord", "s"))
    def field(name: str) -> Column:
        found = F.regexp_extract_all(F.col("s.body"), F.lit(_field_pattern(name)), F.lit(1))
        return strip(F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("")))

    return d.select("doc_id", "ord", F.col("s.num").cast("int").alias("block_no"), *[field(f).alias(f.lower()) for f in FIELDS])


def _field_pattern(name: str) -> str:
    stop = "|".join(FIELDS)
    return rf"(?ms)^\*\*{name}:\*\*[ \t]*(.*?)(?=^\*\*(?:{stop}):\*\*|^##\s|\z)"


def paragraphs(docs: DataFrame, border: str = r"\n\s*\n", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, para_no, text): stripped pieces between blank lines (or another border), empty ones dropped.

    ``keep`` names columns to carry along, which spares a join back to the documents.
    """
    pieces = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), border, -1), strip), lambda x: x != "")
    return docs.select("doc_id", *keep, F.posexplode(pieces).alias("p", "text")).select("doc_id", *keep, (F.col("p") + 1).alias("para_no"), "text")


def record_paragraphs(docs: DataFrame) -> DataFrame:
    """Paragraphs without those that start with a block marker; text attached to the marker goes too."""
    kept = paragraphs(docs).where(~F.col("text").startswith("<!-- block:"))
    return kept.withColumn("para_no", F.row_number().over(W.partitionBy("doc_id").orderBy("para_no")))


def split_blocks(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """(doc_id, block_no, para_no, text) of block files too large for a row: ``blocks`` of mode 'last' without reading a file whole.

    Spark's text reader cuts files at the marker's opening, so one file is read by many tasks and a row is one block.  A
    document is a folder <folder>=<id> of files in the order of their names (as ``write_ordered`` leaves them); the place of a
    block is its file, the start of its split and its number in there.  Only what is no marker on a line of its own (few
    rows) has to be told to which block it belongs, by a window over places and numbers alone.  Markers are those that the
    writers write, <!-- block: N -->.
    """
    rows = spark.read.text(path, lineSep="<!-- block:", recursiveFileLookup=True, pathGlobFilter="part-*")
    doc = F.regexp_extract("_metadata.file_path", f"/{folder}=([^/]+)/", 1).alias("doc_id")
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n")).alias("place")
    d = rows.select(doc, place, F.regexp_replace("value", "\r\n?", "\n").alias("body"))
    d = d.withColumn("head", F.regexp_extract("body", r"^\s*(\d+)\s*-->[ \t]*(?:\n|\z)", 1).try_cast("int")).withColumn("ends", F.col("body").rlike(r"(?:^|\n)[ \t]*\z"))
    order = W.partitionBy("doc_id").orderBy("place")
    at = d.select("doc_id", "place", "head", F.coalesce(F.lag("ends").over(order), F.lit(True)).alias("free"))
    own = F.when(F.col("free"), F.col("head"))
    at = at.select("doc_id", "place", F.last(own, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("carried"), F.max(F.when(own.isNotNull(), F.col("place"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("entry"), own.isNull().alias("loose"))
    loose = at.where("loose").select(F.col("doc_id").alias("_doc"), F.col("place").alias("_place"), "carried", "entry", "loose")
    d = d.join(loose, (F.col("doc_id") == F.col("_doc")) & (F.col("place") == F.col("_place")), "left").drop("_doc", "_place")
    block = F.when(F.col("loose"), F.col("carried")).otherwise(F.col("head"))
    text = F.when(F.col("loose"), F.concat(F.lit("<!-- block:"), "body")).otherwise(F.regexp_replace("body", r"^\s*\d+\s*-->[ \t]*(?:\n|\z)", ""))
    d = d.select("doc_id", block.alias("block_no"), F.coalesce("entry", "place").alias("entry"), "place", F.split(text, "\n", -1).alias("ls")).where("block_no IS NOT NULL")
    per = d.groupBy("doc_id", "block_no").agg(F.max("entry").alias("latest"), F.array_sort(F.collect_list(F.struct("entry", "place", "ls"))).alias("rs"))
    whole = F.array_join(F.flatten(F.transform(F.filter("rs", lambda r: r["entry"] == F.col("latest")), lambda r: F.array(F.array_join(r["ls"], "\n")))), "")
    kept = F.filter(F.transform(F.split(whole, "\n", -1), strip), lambda x: (x != "") & ~x.startswith("# ") & ~x.startswith("<!--"))
    return per.select("doc_id", "block_no", F.posexplode(kept).alias("p", "text")).select("doc_id", "block_no", (F.col("p") + 1).alias("para_no"), "text")
