"""Evidence of a chapter: listed runs, the two phases of an analysis, their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators.findings import ACTION, FIDELITY, STATUS, action_of, candidate_ids, carried, fidelity_of, gap_filled, status_of

SOURCES = "struct<a:array<string>,b:array<string>,c:array<string>,precheck:boolean>"
RESULT = ("chapter", "block", "candidate_id", "sources", "source", "current", "fidelity", "status", "reason", "suggestion", "action")


def runs_listed(runs: DataFrame, chapter: str = "chapter", kind: str = "kind", run: str = "run") -> DataFrame:
    """chapter, kind, runs: the run names of each chapter and kind, each once, in order."""
    return runs.groupBy(chapter, kind).agg(F.sort_array(F.collect_set(run)).alias("runs"))


def phase_one(findings: DataFrame) -> DataFrame:
    """The blind record (chapter, phase, scope, results): findings by block with the blocks without one filled in.

    ``findings`` has chapter, block, finding, confidence.
    """
    filled = gap_filled(findings, "chapter")
    each = F.struct("block", "finding", "confidence")
    return filled.groupBy("chapter").agg(F.lit(1).alias("phase"), F.lit("blind").alias("scope"), F.sort_array(F.collect_list(each)).alias("results"))


def _sources(c: Column | None, precheck: bool) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(none.alias("a"), none.alias("b"), (F.array(c) if c is not None else none).alias("c"), F.lit(precheck).alias("precheck")).cast(SOURCES)


def phase_two(prior: DataFrame, new: DataFrame, precheck: DataFrame, order: list[str]) -> DataFrame:
    """The results of the second phase: prior decisions as they are, new findings classified and numbered within their
    chapter, precheck candidates as reviewed false positives.

    ``prior`` has the columns of RESULT; ``new`` chapter, run, block, source, current, reason, suggestion, severity, confidence;
    ``precheck`` chapter, block, source, current, reason; both have the columns of ``order``.
    """
    status = status_of(F.col("severity"), F.col("confidence"))
    c = candidate_ids(new, "chapter", "", order).withColumn("status", status)
    c = c.select(
        "chapter", "block", F.concat_ws("-", F.lit("C"), "run", F.format_string("%02d", "block"), "candidate_id").alias("candidate_id"), _sources(F.col("run"), False).alias("sources"), "source", "current",
        fidelity_of(F.col("status")).alias("fidelity"), "status", "reason", "suggestion", action_of(F.col("status")).alias("action"),
    )
    false = F.lit("FALSE_POSITIVE")
    p = candidate_ids(precheck, "chapter", "", order).select(
        "chapter", "block", F.concat_ws("-", F.lit("PC"), F.col("block").cast("string"), "candidate_id").alias("candidate_id"), _sources(None, True).alias("sources"), "source", "current",
        F.lit("MISSING").alias("fidelity"), false.alias("status"), "reason", F.lit("").alias("suggestion"), action_of(false).alias("action"),
    )
    return carried(prior.select(*RESULT), c, p)


def analysis(results: DataFrame, runs: DataFrame) -> DataFrame:
    """One record a chapter: its inputs by kind (map of runs) and its results in order of block, then candidate."""
    inputs = runs_listed(runs).groupBy("chapter").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "runs")))).alias("inputs"))
    listed = results.groupBy("chapter").agg(F.sort_array(F.collect_list(F.struct(*RESULT[1:]))).alias("results"))
    return listed.join(inputs, "chapter", "left")


def analysis_report(results: DataFrame) -> DataFrame:
    """(chapter, text): counts of statuses and actions, then a table of the results; bars in cells are escaped."""
    counts = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x), "")
    tally = lambda by: results.groupBy("chapter", by).count().groupBy("chapter").agg(counts(F.concat(F.lit("- "), F.col(by), F.lit(": "), F.col("count"), F.lit("\n"))).alias(by))
    cell = lambda c: F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in ("block", "candidate_id", "status", "action", "reason")]), F.lit(" |"))
    body = results.groupBy("chapter").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "candidate_id", row.alias("r")))), lambda s: s["r"]), "\n").alias("body"))
    text = F.concat(F.lit("# "), F.col("chapter").cast("string"), F.lit("\n\n"), F.col("status"), F.col("action"), F.lit("\n"), F.col("body"))
    return body.join(tally("status"), "chapter").join(tally("action"), "chapter").select("chapter", text.alias("text"))


def violations(results: DataFrame) -> DataFrame:
    """(chapter, candidate_id, problem): what a validator rejects - a missing field, an unknown value of an enumeration, an action
    that does not follow from the status, an analysis that fixes, a block below 1, a candidate id that is there twice.
    """
    from pyspark.sql import Window as W

    twice = F.count("*").over(W.partitionBy("chapter", "candidate_id")) > 1
    known = lambda c, values: ~F.coalesce(F.col(c).isin(list(values)), F.lit(False))
    problems = F.array(
        F.when(F.col("candidate_id").isNull() | (F.col("candidate_id") == ""), "no-candidate-id"), F.when(F.coalesce(F.col("block") < 1, F.lit(True)), "bad-block"),
        F.when(known("fidelity", FIDELITY), "unknown-fidelity"), F.when(known("status", STATUS), "unknown-status"), F.when(known("action", ACTION), "unknown-action"),
        F.when(F.col("action") == "FIXED", "analysis-fixes"), F.when((F.col("status") == "FALSE_POSITIVE") != (F.col("action") == "PRESERVED"), "action-against-status"), F.when(F.col("_twice"), "candidate-id-twice"),
    )
    return results.withColumn("_twice", twice).select("chapter", "candidate_id", F.explode(F.array_compact(problems)).alias("problem"))
