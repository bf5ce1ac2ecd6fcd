"""Term consistency: inventory, competing variants in near blocks, keywords in context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import around, escaped, matches


def inventory(hits: DataFrame, keys: list[str]) -> DataFrame:
    """keys, form, n, first_ord: how often each form occurs, with the order of first sight to break ties."""
    return hits.groupBy(*keys, "form").agg(F.count("*").alias("n"), F.min("ord").alias("first_ord"))


def variant_candidates(paragraphs: DataFrame, variants: list[str], gap: int = 1) -> DataFrame:
    """(doc_id, variant_a, block_a, variant_b, block_b, n): pairs of different variants in near blocks.

    Blocks are near when their positions differ by ``gap`` at most.  Variants are ordered as listed; every
    pair of occurrences counts, which is the product of the two blocks' counts, so no occurrence pairs
    are made.
    """
    per = paragraphs.groupBy("doc_id", "block_no").agg(*[F.sum(F.regexp_count("text", F.lit("(?iu)" + escaped(v)))).alias(f"v{i}") for i, v in enumerate(variants)])
    per = per.withColumn("pos", F.dense_rank().over(W.partitionBy("doc_id").orderBy("block_no")) - 1)
    stack = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(v).alias("v"), F.col(f"v{i}").alias("n")) for i, v in enumerate(variants)]), lambda s: s["n"] > 0)
    hits = per.select("doc_id", "block_no", "pos", F.inline(stack))
    a = hits.select("doc_id", F.col("i").alias("ia"), F.col("v").alias("variant_a"), F.col("block_no").alias("block_a"), F.col("pos").alias("pa"), F.col("n").alias("na"))
    b = hits.select("doc_id", F.col("i").alias("ib"), F.col("v").alias("variant_b"), F.col("block_no").alias("block_b"), F.col("pos").alias("pb"), F.col("n").alias("nb"))
    # The near positions are few: an equi-join on the position a hit may meet.
    a = a.withColumn("pb", F.explode(F.sequence(F.col("pa") - gap, F.col("pa") + gap)))
    joined = a.join(b, ["doc_id", "pb"]).where("ia < ib")
    return joined.select("doc_id", "variant_a", "block_a", "variant_b", "block_b", (F.col("na") * F.col("nb")).alias("n"))


def keyword_contexts(paragraphs: DataFrame, keyword: str, left: int = 20, right: int = 40, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, para_no, start, hit, context) of every occurrence of a literal, in any case."""
    m = matches(F.col("text"), "(?iu)" + escaped(keyword))
    d = paragraphs.select("doc_id", *keep, "para_no", "text", F.explode(m).alias("m"))
    return d.select("doc_id", *keep, "para_no", F.col("m.start").alias("start"), F.col("m.hit").alias("hit"), around(F.col("text"), F.col("m.start"), F.col("m.end"), left, right).alias("context"))


def top_k(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first k rows of each group; Spark's group limit keeps k rows per task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
