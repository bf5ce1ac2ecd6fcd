"""Markdown tables: glossaries and registries of finished volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import fold, strip
from weftline.sources.blocks import lines

# Common words of the glossary's English column that are no names.
NAME_STOP = (
    "ancient magic magical order holy water spirit spirits knights knight academy church sword swords saint spell spells "
    "flame lily rose cross wand wands people guard guards crown royal lady lord ball book cold door duke east fire five gate "
    "king land line love mage miss oath ring room ruby twin void wind your zero dirt mann jean sun sile skua wynn"
).split()


def spread(df: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """``df`` over all cores if it is one file of ``limit`` bytes or less, else as it is.

    A small Parquet file has one row group, which one task reads, however many cores there are.  Larger
    inputs have many row groups and are never shuffled here.  The size is the file's metadata.
    """
    files = df.inputFiles()
    if len(files) != 1:
        return df
    spark = df.sparkSession
    size = spark.read.format("binaryFile").load(files[0]).select("length").first()[0]
    return df.repartition(spark.sparkContext.defaultParallelism) if size <= limit else df


def keyed(df: DataFrame, *keys: str, rows_per_task: int = 500_000) -> DataFrame:
    """``df`` dealt by keys to as many tasks as it has shares of ``rows_per_task`` rows; as it is if that is one.

    What follows by these keys (aggregates, windows, joins) then holds a share in a task, whatever the session's number of
    partitions is, and no task of the scan aggregates a whole split.  For tables and staged tables, whose count is metadata.
    """
    n = -(-df.count() // rows_per_task)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys) if n > 1 else df


def rows(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, cells) of the lines that begin with a bar; the outer bars bound no cell."""
    d = lines(docs).where(F.col("line").startswith("|"))
    bare = F.regexp_replace(F.col("line"), r"^\|+|\|+\s*$", "")
    return d.select("doc_id", "line_no", F.transform(F.split(bare, r"\|", -1), strip).alias("cells"))


def glossary_names(docs: DataFrame, stop: list[str] = NAME_STOP) -> DataFrame:
    """(doc_id, line_no, en_forms, ru_base, ru): capitalised English words and the first four letters of the Russian form."""
    d = rows(docs).where(F.size("cells") >= 3).select("doc_id", "line_no", F.get("cells", F.lit(1)).alias("en"), F.get("cells", F.lit(2)).alias("ru"))
    d = d.where(~F.col("en").startswith("---") & ~F.col("ru").startswith("---"))
    forms = F.transform(F.regexp_extract_all("en", F.lit(r"\b[A-Z][A-Za-z'\-]{3,}"), F.lit(0)), F.lower)
    forms = F.array_distinct(F.filter(forms, lambda w: ~w.isin(stop)))
    base = F.left(fold(F.regexp_extract("ru", "[А-Яа-яЁё]+", 0)), F.lit(4))
    return d.select("doc_id", "line_no", forms.alias("en_forms"), base.alias("ru_base"), "ru").where((F.size("en_forms") > 0) & (F.length("ru_base") == 4))


def glossary_stems(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, stem, canon): a stem is the first word less its last two letters, four letters at least; first wins in a glossary."""
    d = rows(docs).where(F.size("cells") >= 3).select("doc_id", "line_no", F.get("cells", F.lit(2)).alias("ru"))
    d = d.where(~F.col("ru").startswith("---") & ~F.col("ru").startswith("—") & (F.col("ru") != ""))
    canon = strip(F.translate("ru", "*«»", ""))
    first = F.regexp_extract(canon, "[А-Яа-яЁё]+", 0)
    stem = F.left(F.lower(first), F.greatest(F.lit(4), F.length(first) - 2))
    d = d.select("doc_id", "line_no", stem.alias("stem"), canon.alias("canon"), first.alias("first")).where(F.length("first") >= 4)
    turn = F.row_number().over(W.partitionBy("doc_id", "stem").orderBy("line_no"))
    return d.withColumn("turn", turn).where("turn = 1").select("doc_id", "line_no", "stem", "canon")


def glossary_entries(docs: DataFrame) -> DataFrame:
    """(doc_id, key, ja, en, ru) of glossaries with a header row."""
    d = rows(docs).where(F.size("cells") >= 3)
    head = W.partitionBy("doc_id").orderBy("line_no")
    d = d.withColumn("n", F.row_number().over(head)).where((F.col("n") > 1) & ~F.get("cells", F.lit(0)).rlike("^:?-{3,}") & (F.get("cells", F.lit(0)) != ""))
    return d.select("doc_id", F.concat(F.lit("g:"), F.get("cells", F.lit(0))).alias("key"), F.get("cells", F.lit(0)).alias("ja"), F.get("cells", F.lit(1)).alias("en"), F.get("cells", F.lit(2)).alias("ru"))


def frozen_volumes(docs: DataFrame, status: str | None = None) -> DataFrame:
    """(volume): numbers in the first cell; with ``status``, of rows whose second cell begins with it in any case."""
    d = rows(docs).select(F.get("cells", F.lit(0)).try_cast("int").alias("volume"), F.get("cells", F.lit(1)).alias("status"))
    if status:
        d = d.where(F.lower("status").startswith(status.lower()))
    return d.where("volume IS NOT NULL").select("volume").distinct()
