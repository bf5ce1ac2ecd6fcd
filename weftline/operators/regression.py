"""Checks of a regression corpus: texts that must contain, lines referred to by number, partitions of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contained(cases: DataFrame, texts: DataFrame, key: str, part: str, text: str = "text") -> DataFrame:
    """``cases`` with ok: whether ``part`` stands in the text of the same ``key`` (an equi-join; a case without a text fails)."""
    held = texts.select(key, F.col(text).alias("_text"))
    return cases.join(held, key, "left").withColumn("ok", F.coalesce(F.contains(F.col("_text"), F.col(part)), F.lit(False))).drop("_text")


def line_refs(cases: DataFrame, lines: DataFrame, key: str = "doc_id", ref: str = "ref", part: str = "part") -> DataFrame:
    """``cases`` with ok: whether line n of the document (``ref`` is L<n>, from 1) contains ``part`` without outer blanks.

    ``lines`` has key, line_no (from 0), line.
    """
    number = F.regexp_extract(F.col(ref), r"^L(\d+)", 1).try_cast("int") - 1
    held = lines.select(key, F.col("line_no").alias("_n"), F.col("line").alias("_line"))
    d = cases.withColumn("_n", number).join(held, [key, "_n"], "left")
    return d.withColumn("ok", F.coalesce(F.contains(F.col("_line"), F.trim(F.col(part))), F.lit(False))).drop("_n", "_line")


def unknown_ids(cases: DataFrame, key: str, ids: str, known: DataFrame, id_: str) -> DataFrame:
    """(key, id): ids listed by a case that the corpus lacks."""
    return cases.select(key, F.explode(ids).alias(id_)).join(known.select(id_), id_, "left_anti").select(key, id_)


def partition_errors(all_: DataFrame, one: DataFrame, other: DataFrame, id_: str) -> DataFrame:
    """(id, problem): ids in both parts, in neither, or in a part but not among all; one aggregate over the union."""
    tag = lambda df, n: df.select(id_).distinct().withColumn("_tag", F.lit(n))
    per = tag(all_, 1).unionByName(tag(one, 2)).unionByName(tag(other, 4)).groupBy(id_).agg(F.sum("_tag").alias("t"))
    problem = F.when(F.col("t").isin(6, 7), "in-both").when(F.col("t") == 1, "in-neither").when(F.col("t").isin(2, 4), "unknown")
    return per.withColumn("problem", problem).where("problem IS NOT NULL").select(id_, "problem")
