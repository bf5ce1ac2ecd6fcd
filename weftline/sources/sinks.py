"""Rendering and writing: merged chapters, reports, appended and replaced blocks.

Tables are never edited in place: a change is a new version (``versions``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import EMPTY

FIELDS = ("ja", "en", "ru", "ed_ru")


def _in_order(column: Column, *order: str) -> Column:
    listed = F.sort_array(F.collect_list(F.struct(*order, column.alias("_x"))))
    return F.transform(listed, lambda s: s["_x"])


def merged_text(view: DataFrame) -> DataFrame:
    """(doc_id, text): merged chapters as text, a dash for a missing field."""
    shown = lambda f: F.concat(F.lit(f"**{f.upper()}:** "), F.coalesce(F.nullif(f, F.lit("")), F.lit(EMPTY)))
    section = F.concat_ws("\n\n", F.format_string("## Блок %d", "block_no"), *[shown(f) for f in FIELDS])
    return view.groupBy("doc_id").agg(F.array_join(_in_order(section, "block_no"), "\n\n").alias("text"))


def report_text(findings: DataFrame, title: str) -> DataFrame:
    """(doc_id, text): counts by kind, then one section per finding, by block, kind and emission order."""
    kinds = findings.groupBy("doc_id", "kind").count().groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(": ", "kind", "count"))), "; ").alias("head"))
    section = F.concat_ws("\n", F.format_string("### %d — %s", "block_no", "kind"), F.col("detail"))
    body = findings.groupBy("doc_id").agg(F.array_join(_in_order(section, "block_no", "kind", "emit_ord"), "\n\n").alias("body"))
    return body.join(kinds, "doc_id").select("doc_id", F.concat_ws("\n\n", F.lit(f"# {title}"), "head", "body").alias("text"))


def inventory_text(hits: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, text): the inventory of ``stem_hits``: every canon that occurs, in glossary order, with its occurrences, blocks, forms (the most frequent first, then
    the first seen) and first context.
    """
    place, canon = F.struct("block_no", "para_no"), (*keys, "line_no", "canon")
    forms = hits.groupBy(*canon, "form").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "first", "form", "n")))
    forms = forms.groupBy(*canon).agg(F.array_join(F.transform(listed, lambda x: F.concat(x["form"], F.lit(" ×"), x["n"].cast("string"))), ", ").alias("forms"))
    whole = hits.groupBy(*canon).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("block_no")), ", ").alias("blocks"), F.min_by("context", F.struct(place, "form")).alias("context"))
    section = F.concat(F.lit("## "), "canon", F.lit(": "), F.col("n").cast("string"), F.lit("\nblocks "), "blocks", F.lit("\n"), "forms", F.lit("\n> "), "context")
    return whole.join(forms, list(canon)).groupBy(*keys).agg(F.array_join(_in_order(section, "line_no"), "\n\n").alias("text"))


def merge_text(matched: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, text): how many findings both auditors have and each alone, then the findings by block and status (columns status, block, problem, source)."""
    names = ("BOTH_FOUND", "ONLY_A", "ONLY_B")
    counts = F.concat_ws("; ", *[F.concat(F.lit(f"{n}: "), F.count_if(F.col("status") == n).cast("string")) for n in names], F.concat(F.lit("total: "), F.count("*").cast("string")))
    section = F.concat_ws("\n", F.concat_ws(" ", F.lit("###"), F.col("block").cast("string"), F.col("status")), F.col("problem"), F.col("source"))
    return matched.groupBy(*keys).agg(F.concat(counts, F.lit("\n\n"), F.array_join(_in_order(section, "block", "status", "problem", "source"), "\n\n")).alias("text"))


def appended(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """``blocks`` and the new (doc_id, block_no, text); fails if a number exists already or comes twice."""
    keys = ["doc_id", "block_no"]
    clash = new.join(blocks.select(*keys), keys, "left_semi").select(*keys).unionByName(new.groupBy(*keys).count().where("count > 1").select(*keys))
    bad = clash.agg(F.count("*").alias("n"))
    checked = new.crossJoin(F.broadcast(bad)).where(F.when(F.col("n") > 0, F.raise_error(F.lit("block exists already")).cast("boolean")).otherwise(F.lit(True)))
    return blocks.select(*keys, "text").unionByName(checked.select(*keys, "text"))


def replaced(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """The next version of ``blocks`` with the texts of ``new`` where it has the block."""
    right = new.select("doc_id", "block_no", F.col("text").alias("_new"))
    return blocks.join(right, ["doc_id", "block_no"], "left").withColumn("text", F.coalesce("_new", "text")).drop("_new")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def pair_text(pairs: DataFrame, left: str = "JA", right: str = "OUTPUT", doc: str = "doc_id", block: str = "block_no") -> DataFrame:
    """(doc, text): a file of aligned pairs (doc, block, left, right), each block between its marker and an end line."""
    side = lambda label, c: F.concat_ws("\n", F.lit(f"===== {label} ====="), F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", F.lit(f"(no text: {label})")).otherwise(F.col(c)))
    section = F.concat_ws("\n\n", F.format_string("<!-- block: %d -->", block), side(left, "left"), side(right, "right"), F.format_string("===== END %d =====", block))
    return pairs.groupBy(doc).agg(F.concat(F.array_join(_in_order(section, block), "\n\n"), F.lit("\n")).alias("text"))


# The order of a volume's parts; chapters come by number after the preface.
PARTS = ("preface", "chapter", "epilogue", "afterword", "other", "credits")


def _placed(chapters: DataFrame) -> DataFrame:
    """(volume, place, number, doc_id, text) of the chapters that belong to a volume."""
    part = F.regexp_extract("doc_id", r"^v\d{1,3}-(.*)$", 1)
    number = F.regexp_extract(part, r"^ch0*(\d+)", 1).try_cast("int")
    name = F.when(number.isNotNull(), "chapter").when(part.isin(*[p for p in PARTS if p != "chapter"]), part).otherwise("other")
    place = F.array_position(F.array(*[F.lit(p) for p in PARTS]), name)
    return chapters.select(F.regexp_extract("doc_id", r"^v(\d{1,3})-", 1).try_cast("int").alias("volume"), place.alias("place"), F.coalesce(number, F.lit(0)).alias("number"), "doc_id", "text").where("volume IS NOT NULL")


def volume_text(chapters: DataFrame, rule: str = "\n\n---\n\n") -> DataFrame:
    """(volume, n_parts, text) of (doc_id, text): a volume's preface, chapters by number, epilogue, afterword, other parts, credits.

    ``doc_id`` is v<volume>-ch<number> or v<volume>-<part>; files without a volume are left out, and missing
    parts too.
    """
    d = _placed(chapters)
    return d.groupBy("volume").agg(F.count("*").alias("n_parts"), F.array_join(_in_order(F.col("text"), "place", "number", "doc_id"), rule).alias("text"))


def gate_text(checked: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): the gate's checks as a list and whether all hold."""
    row = F.concat(F.when(F.col("ok"), "- [x] ").otherwise("- [ ] "), F.col("check"))
    closed, total = F.count_if("ok"), F.count("*")
    head = F.concat(closed.cast("string"), F.lit("/"), total.cast("string"), F.when(closed == total, " ready").otherwise(" not ready"))
    return checked.groupBy(key).agg(F.concat(F.array_join(_in_order(row, "check_no"), "\n"), F.lit("\n\n"), head).alias("text"))


def write_ordered(pieces: DataFrame, path: str, volume: str, order: list[str], bytes_per_file: int = 128 << 20) -> DataFrame:
    """Write column ``text`` of the pieces of each volume in order, as text files; returns their index.

    A volume is a folder <volume>=<value> whose files, read by name, are the volume: pieces are dealt to files by ranges of
    (volume, order), sorted inside each, so no task holds more than a file however long a volume is.  Index:
    (volume, file_no from 1, path, bytes, offset of the file's first byte in the volume).
    """
    spark = pieces.sparkSession
    size = pieces.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    ranges = pieces.repartitionByRange(max(1, -(-size // bytes_per_file)), volume, *order)
    ranges.sortWithinPartitions(volume, *order).select(volume, "text").write.partitionBy(volume).text(path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", F.col("length").alias("bytes"))
    files = files.withColumn(volume, F.regexp_extract("path", f"/{volume}=([^/]+)/", 1))
    by = W.partitionBy(volume).orderBy("path")
    before = F.coalesce(F.sum("bytes").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return files.select(volume, F.row_number().over(by).alias("file_no"), "path", "bytes", before.alias("offset"))


def volume_pieces(chapters: DataFrame, rule: str = "---") -> DataFrame:
    """(volume, place, number, doc_id, key, piece, text) of (doc_id, text): the lines of a volume's parts, a rule before each part but the first.

    The parts and their order are those of ``volume_text``, which makes one cell of a volume (parts of one id are ordered by ``key``, the
    digest of their text, here); the pieces, ordered by all other columns, go to ``write_ordered``.
    """
    d = _placed(chapters).withColumn("key", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    part = F.struct("place", "number", "doc_id", "key")
    first = d.groupBy("volume").agg(F.min(part).alias("first"))
    d = d.join(first, "volume").withColumn("cut", F.when(part == F.col("first"), F.lit("")).otherwise(F.lit(f"\n{rule}\n\n")))
    lines = F.split(F.concat("cut", F.coalesce("text", F.lit(""))), "\n", -1)
    return d.select("volume", "place", "number", "doc_id", "key", F.posexplode(lines).alias("piece", "text"))
