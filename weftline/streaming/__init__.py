"""Structured Streaming over the same expressions (an extension: the batch engine has no stream)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.plans.rules import Rule, findings


def windowed_findings(rows: DataFrame, keys: Sequence[str], rules: Sequence[Rule], time: str, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Findings per window and kind of a batch or stream; rows later than ``late`` are dropped by the watermark."""
    found = findings(rows.withWatermark(time, late), [*keys, time], rules)
    return found.groupBy(F.window(time, width).alias("window"), "kind").agg(F.count("*").alias("n"))
