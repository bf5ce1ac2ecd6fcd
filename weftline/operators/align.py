"""Alignment: the wide view of a chapter, two-sided pairs, and the proportional band join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import EMPTY


def merged_view(sides: DataFrame, langs: list[str], keys: tuple[str, ...] = ("doc_id", "block_no"), fill: str | None = EMPTY) -> DataFrame:
    """A full outer join of all languages on the block: one pivot, one shuffle.

    ``sides`` has the keys, lang, entry, text; of repeated blocks the last entry wins.
    """
    view = sides.groupBy(*keys).pivot("lang", langs).agg(F.max_by("text", "entry"))
    return view if fill is None else view.fillna(fill, langs)


def pair_blocks(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, left, right: a full outer join of two sides' (keys, text)."""
    a, b = left.select(*keys, F.col("text").alias("left")), right.select(*keys, F.col("text").alias("right"))
    return a.join(b, keys, "full_outer")


def side_notes(pairs: DataFrame, doc: str, block: str) -> DataFrame:
    """(doc, n_pairs, only_left, only_right): the block numbers without a partner, in order."""
    lone = lambda here, there: F.array_join(F.array_sort(F.collect_list(F.when(F.col(there).isNull() & F.col(here).isNotNull(), F.col(block)))), ",")
    return pairs.groupBy(doc).agg(F.count("*").alias("n_pairs"), lone("left", "right").alias("only_left"), lone("right", "left").alias("only_right"))


def missing_blocks(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``wanted`` that ``present`` lacks.

    A merge join: the sizes that Spark would broadcast by do not see how many blocks a row is exploded into.
    """
    return wanted.select(*keys).join(present.select(*keys).hint("merge"), keys, "left_anti")


def not_frozen(rows: DataFrame, registry: DataFrame, key: str, frozen: str | None = None) -> DataFrame:
    """Rows whose key the registry (column ``frozen``, or the key's name) lacks; a row without a key stays."""
    return rows.join(registry.select(F.col(frozen or key).alias(key)).distinct(), key, "left_anti")


def band_join(paras: DataFrame, blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, para_no, block_no): paragraphs dealt to blocks in proportion to the blocks' sizes.

    ``paras`` has doc, para_no, size; ``blocks`` has doc, block_no, size, or no doc where all documents share them.  A paragraph goes to the first block whose
    cumulative share exceeds the text before the paragraph; the last block takes the rest.  Shares are
    compared as whole numbers.  A document's limits travel as one array (its blocks are few), so the band
    join is an equi-join on the document, or a join with one row where all documents share the blocks, and no range join is
    needed; the limit is found by halving.
    """
    run = W.partitionBy(doc).orderBy("para_no").rowsBetween(W.unboundedPreceding, -1)
    p = paras.select(doc, "para_no", F.coalesce(F.sum("size").over(run), F.lit(0)).alias("before"), F.sum("size").over(W.partitionBy(doc)).alias("total"))
    own = [doc] if doc in blocks.columns else []
    upto = W.partitionBy(*own).orderBy("block_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    b = blocks.select(*own, "block_no", F.sum("size").over(upto).alias("acc"), F.sum("size").over(W.partitionBy(*own)).alias("whole"))
    b = b.withColumn("whole", F.when(F.col("whole") == 0, 1).otherwise(F.col("whole")))
    per = b.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("block_no", "acc", "whole"))).alias("limits")).where(F.size("limits") > 0)
    joined = p.join(per, doc) if own else p.crossJoin(per)  # Spark broadcasts the one row if it is small enough
    halves = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])
    beyond = lambda at: F.col("before") * F.get("limits", at)["whole"] >= F.col("total") * F.get("limits", at)["acc"]
    passed = F.aggregate(F.filter(halves, lambda h: h <= F.size("limits")), F.lit(0), lambda n, h: F.when((n + h <= F.size("limits")) & beyond(n + h - 1), n + h).otherwise(n))
    place = F.coalesce(F.get("limits", passed)["block_no"], F.element_at("limits", -1)["block_no"])
    return joined.select(doc, "para_no", place.alias("block_no"))
