"""Quality rules with cross-document line frequency (DataFrame functions only).

Every line is normalised (lower case, white space collapsed, digits folded to 0) and hashed.  A line
is boilerplate on a host when the number of the host's documents that hold it passes
``max(min_docs, max_ratio * documents of the host)``: the share decides, and ``min_docs`` only asks for a third
document, so the rule acts alike on small and large hosts.  Boilerplate lines are taken out, and a document
that keeps too few words is rejected.

Plan: one scan explodes each document's distinct line hashes and counts them per (host, hash) with
map-side aggregation, so a line that a third of all documents share costs one partial row per task.
The boilerplate of a host is one array (at most 1/max_ratio * lines per document entries), matched
inside the row in the second scan: no text is shuffled while the arrays fit ``broadcast_entries``.

Cases: null or empty text has no words and fails the base rules; a null host is a host of its own;
each row counts as one document, so repeated rows count as often as they occur; an empty table gives
an empty result; columns other than the id, text and host are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._common import BLANK, WORD, staged, word_array


@dataclass(frozen=True)
class LineRules:
    min_docs: int = 2
    max_ratio: float = 0.02
    min_left_words: int = 10
    min_left_ratio: float = 0.5
    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    broadcast_entries: int = 2_000_000
    hot_hosts: int = 1_000


def line_key(line: Column) -> Column:
    collapsed = F.trim(F.regexp_replace(line, f"[{BLANK}]+", " "))
    return F.xxhash64(F.regexp_replace(F.lower(collapsed), "[0-9]", "0"))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{BLANK}]"))


def frequent_lines(docs: DataFrame, text: str, host: str, rules: LineRules) -> DataFrame:
    """(host, docs, boiler): per host its documents and the hashes of lines in too many of them."""
    source = docs.select(F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = source.select("host", F.explode(F.array_distinct(F.transform(lines_with_words(F.col("text")), line_key))).alias("key"))
    counted = keys.groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") > rules.min_docs)
    hosts = source.groupBy("host").agg(F.count("*").alias("docs"))
    over = counted.join(hosts, counted["host"].eqNullSafe(hosts["host"])).where(F.col("n") > F.col("docs") * rules.max_ratio)
    return over.groupBy(counted["host"].alias("host")).agg(F.first("docs").alias("docs"), F.collect_list("key").alias("boiler"))


def with_boilerplate(d: DataFrame, boiler: DataFrame, rules: LineRules) -> DataFrame:
    """``d`` with the array of its ``_host``, null where the host has none."""
    entries = lambda df: df.agg(F.coalesce(F.sum(F.size("boiler")), F.lit(0))).first()[0]
    same, side = F.col("_host").eqNullSafe(F.col("_bhost")), boiler.select(F.col("host").alias("_bhost"), "boiler")
    if entries(boiler) <= rules.broadcast_entries:
        return d.join(F.broadcast(side), same, "left")
    names = staged(boiler.orderBy(F.desc("docs"), "host").limit(rules.hot_hosts).select(F.col("host").alias("_bhost")), "hot-hosts")
    hot = side.join(F.broadcast(names.withColumnRenamed("_bhost", "_h")), F.col("_bhost").eqNullSafe(F.col("_h")), "left_semi")
    if entries(hot) > rules.broadcast_entries:
        return d.join(side, same, "left")
    rest = d.join(F.broadcast(names), same, "left_anti").join(side, same, "left")
    return d.join(F.broadcast(hot), same).unionByName(rest)


def repeated_words(docs: DataFrame, width: int) -> DataFrame:
    """Adds n_repeat_words: words covered by ``width``-word windows that occur twice or more in their text.

    Windows are hashed from word hashes; only a text with a repeated hash is sorted to find its
    places, so the common case is one hash set per row.
    """
    d = docs.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    window = F.transform(
        F.sequence(F.lit(0), F.size("_h") - width),
        lambda i: F.xxhash64(*[F.get(F.col("_h"), i + j) for j in range(width)]),
    )
    d = d.withColumn("_w", F.when(F.size("_h") >= width, window))
    again = F.size(F.array_distinct("_w")) < F.size("_w")
    d = d.withColumn("_s", F.when(again, F.sort_array(F.transform("_w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    twin = F.filter("_s", lambda e, i: (F.get(F.col("_s"), i - 1)["x"] == e["x"]) | (F.get(F.col("_s"), i + 1)["x"] == e["x"]))
    d = d.withColumn("_p", F.sort_array(F.transform(twin, lambda e: e["i"])))
    step = F.transform("_p", lambda x, j: F.least(F.lit(width), F.coalesce(F.get(F.col("_p"), j + 1) - x, F.lit(width))))
    total = F.aggregate(step, F.lit(0), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("_h", "_w", "_s", "_p")


def apply_line_rules(docs: DataFrame, text: str = "text", doc: str = "doc_id", host: str = "source", rules: LineRules = LineRules()) -> DataFrame:
    """One row per input row: the id, base counts, n_removed_lines, n_left_words, base_failed, kept."""
    boiler = staged(frequent_lines(docs, text, host, rules), "boilerplate")
    d = docs.select(F.col(doc).alias("doc_id"), F.col(host).alias("_host"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    d = with_boilerplate(d, boiler, rules)
    d = d.withColumn("_words", word_array(F.col("_text"))).withColumn("_lines", lines_with_words(F.col("_text")))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    d = d.withColumn("word_chars", F.length(F.regexp_replace("_text", f"[{BLANK}]+", "")).cast("long"))
    d = d.withColumn("n_symbols", F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    hit = F.when(F.size("boiler") > 0, F.array_intersect("boiler", F.transform("_lines", line_key)))
    d = d.withColumn("_hit", hit)
    gone = F.filter("_lines", lambda x: F.array_contains(F.col("_hit"), line_key(x)))
    d = d.withColumn("_gone", F.when(F.size("_hit") > 0, gone))
    d = repeated_words(d, rules.window)
    lost = F.aggregate("_gone", F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(WORD)))
    d = d.withColumn("n_removed_lines", F.coalesce(F.when(F.size("_gone") > 0, F.size("_gone")), F.lit(0)).cast("long"))
    d = d.withColumn("n_left_words", F.col("n_words") - F.coalesce(lost, F.lit(0)))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    d = d.withColumn("base_failed", failed)
    enough = (F.col("n_left_words") >= rules.min_left_words) & (F.col("n_left_words") >= rules.min_left_ratio * F.col("n_words"))
    out = F.struct(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & enough).alias("kept"), "n_removed_lines", "n_left_words",
    )
    # A generator bars Catalyst from pushing a later filter on these columns below the projections above,
    # which would put whole arrays into the windows' lambda and evaluate them once per window.
    return d.select(F.inline(F.array(out)))
