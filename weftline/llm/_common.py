"""Helpers shared by the training-data operators: staged tables, session settings, SQL fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.staging import clear_staged, new_path, shared_dir, staged, unused
from weftline.sources.tables import spread

__all__ = ["clear_staged", "new_path", "partitions", "shared_dir", "staged", "table", "unused", "word_array", "word_count"]

#: The contract's white space, as a Java character class body.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus; a small single file is spread over the cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def word_array(text: Column) -> Column:
    """The words of a text in order; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{BLANK}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
