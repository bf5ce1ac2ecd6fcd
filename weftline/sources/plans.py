"""Replacement plans: JSON lists of edits, validated as a whole before any of them is applied.

A plan is [[old, new], ..], [{old, new, count, allow_empty}, ..] or {"replacements": ..}.  All faults of all plans
are rows of one table, so a bad item hides neither the next item nor the next plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.edits import edits_hold, patched
from weftline.functions.text import corrupt

# Faults of a plan and of an item, in the order in which they are looked for.
PLAN_FAULTS = ("corrupt-encoding", "not-json", "not-a-list")
ITEM_FAULTS = ("unknown-item", "old-empty", "new-not-a-string", "no-change", "new-empty", "bad-count")


def items(plans: DataFrame, json: str = "json", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """keep, item_no (from 1; null for a plan without readable items), old, new, count, fault (null if there is none).

    Of several faults the first counts.  An empty list is a plan without edits and has no rows.
    """
    text = F.coalesce(F.col(json), F.lit(""))
    d = plans.select(*keep, text.alias("_t"), F.try_parse_json(text).alias("_v"))
    listed = F.expr("coalesce(try_variant_get(_v, '$.replacements', 'array<variant>'), try_variant_get(_v, '$', 'array<variant>'))")
    d = d.withColumn("_items", listed)
    fault = F.when(corrupt(F.col("_t")), PLAN_FAULTS[0]).when(F.col("_v").isNull(), PLAN_FAULTS[1]).when(F.col("_items").isNull(), PLAN_FAULTS[2])
    d = d.withColumn("_fault", fault)
    none = F.lit(None).cast("string")
    whole = d.where("_fault IS NOT NULL").select(*keep, F.lit(None).cast("int").alias("item_no"), none.alias("old"), none.alias("new"), F.lit(None).cast("long").alias("count"), F.col("_fault").alias("fault"))

    d = d.where("_fault IS NULL").select(*keep, F.posexplode("_items").alias("_i", "_x"))
    d = d.withColumn("_kind", F.coalesce(F.expr("schema_of_variant(_x)"), F.lit(""))).withColumn("_pair", F.expr("try_variant_get(_x, '$', 'array<variant>')"))
    is_pair, is_object = F.coalesce(F.size("_pair") == 2, F.lit(False)), F.col("_kind").startswith("OBJECT")
    side = lambda at, name: F.when(is_pair, F.expr(f"try_variant_get(_x, '$[{at}]', 'variant')")).when(is_object, F.expr(f"try_variant_get(_x, '$.{name}', 'variant')"))
    d = d.withColumn("_old", side(0, "old")).withColumn("_new", side(1, "new")).withColumn("_count", F.when(is_object, F.expr("try_variant_get(_x, '$.count', 'variant')")))
    kind = lambda c: F.coalesce(F.expr(f"schema_of_variant({c})"), F.lit("VOID"))
    string = lambda c: F.when(kind(c) == "STRING", F.expr(f"try_variant_get({c}, '$', 'string')"))
    d = d.withColumn("old", string("_old")).withColumn("new", string("_new")).withColumn("count", F.when(kind("_count") == "BIGINT", F.expr("try_variant_get(_count, '$', 'bigint')")))
    empty_allowed = F.coalesce(F.when(is_object, F.expr("try_variant_get(_x, '$.allow_empty', 'boolean')")), F.lit(False))
    found = (
        F.when(~is_pair & ~is_object, ITEM_FAULTS[0]).when(F.coalesce(F.regexp_replace("old", r"(?U)\s+", ""), F.lit("")) == "", ITEM_FAULTS[1]).when(F.col("new").isNull(), ITEM_FAULTS[2])
        .when(F.col("old") == F.col("new"), ITEM_FAULTS[3]).when((F.col("new") == "") & ~empty_allowed, ITEM_FAULTS[4])
        .when((kind("_count") != "VOID") & (F.col("count").isNull() | (F.col("count") < 0)), ITEM_FAULTS[5])
    )
    return whole.unionByName(d.select(*keep, (F.col("_i") + 1).alias("item_no"), "old", "new", "count", found.alias("fault")))


def faults(found: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    return found.where("fault IS NOT NULL").select(*keep, "item_no", "fault")


def good_plans(found: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """keep, plan: array<struct<old, new, count>> in order, of the plans without any fault."""
    per = found.groupBy(*keep).agg(F.count("fault").alias("n"), F.array_sort(F.collect_list(F.struct("item_no", "old", "new", "count"))).alias("p")).where("n = 0")
    return per.select(*keep, F.transform("p", lambda x: F.struct(x["old"].alias("old"), x["new"].alias("new"), x["count"].cast("int").alias("count"))).alias("plan"))


def applied(blocks: DataFrame, plans: DataFrame, on: list[str]) -> DataFrame:
    """on, text, done: blocks that have a plan, after it; ``done`` is null, or why the plan was not applied (the text is then as before).

    An edit must find its old text, as often as its count says, in what the edits before it left.  Afterwards the old texts must be
    gone and the new ones there.
    """
    d = blocks.join(plans, on).withColumn("_r", patched(F.col("text"), F.col("plan")))
    missing = F.exists(F.sequence(F.lit(0), F.size("plan") - 1), lambda i: F.get(F.col("_r.counts"), i) == 0)
    why = F.when(F.size("plan") == 0, F.lit(None).cast("string")).when(~F.col("_r.ok"), F.when(missing, "not-found").otherwise("count-differs"))
    why = why.when(corrupt(F.col("_r.text")), "corrupt-text").when(~edits_hold(F.col("_r.text"), F.col("plan")), "old-text-left")
    return d.withColumn("done", why).select(*on, F.when(F.col("done").isNull(), F.col("_r.text")).otherwise(F.col("text")).alias("text"), "done")
