"""Reconciling findings: one-to-one matching, first and latest runs, carried decisions, gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import without_space

# Enumerations of the evidence.
FIDELITY = ("MEANING_SHIFT", "COMPONENT_LOSS", "ADDITION", "MISSING", "RUSSIAN_ERROR", "FORMAT")
STATUS = ("CONFIRMED_ERROR", "DISPUTED", "FALSE_POSITIVE")
ACTION = ("REPORT_ONLY", "PRESERVED", "FIXED")
OMISSION = ("ja_span", "missing_content", "ru_before", "not_compression_reason", "omission_scope", "omission_kind")


def matched(a: DataFrame, b: DataFrame, order: list[str], within: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """(within, block, problem, source, status): findings of two auditors matched one to one, ``within`` a chapter.

    The key is the block, the problem in lower case and the source without white space; the nth finding of a
    key in one meets the nth in the other, so counts are those of multisets.  A null block never matches
    and is dropped.
    """

    key = [*within, "block", "problem", "source"]

    def numbered(df: DataFrame, side: str) -> DataFrame:
        keyed = df.where("block IS NOT NULL").select(*within, "block", F.lower(F.coalesce("problem", F.lit(""))).alias("problem"), without_space(F.coalesce("source", F.lit(""))).alias("source"), *order)
        turn = F.row_number().over(W.partitionBy(*key).orderBy(*order))
        return keyed.select(*key, turn.alias("turn"), F.lit(True).alias(side))

    both = numbered(a, "in_a").join(numbered(b, "in_b"), [*key, "turn"], "full_outer")
    status = F.when(F.col("in_a") & F.col("in_b"), "BOTH_FOUND").when(F.col("in_a"), "ONLY_A").otherwise("ONLY_B")
    return both.select(*key, status.alias("status"))


def first_of(findings: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order`` (a fixed choice, unlike dropDuplicates)."""
    turn = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return findings.withColumn("_turn", turn).where("_turn = 1").drop("_turn")


def latest(runs: DataFrame, key: list[str], by: str | list[str], keep: Column | None = None) -> DataFrame:
    """One row per key: the run with the greatest name, or the youngest file, after a filter."""
    rows = runs if keep is None else runs.where(keep)
    order = F.struct(*([by] if isinstance(by, str) else by))
    rest = [c for c in runs.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*")


def gap_filled(findings: DataFrame, doc: str, fill: str = "NONE", confidence: str = "HIGH", empty_max: int = 1) -> DataFrame:
    """(doc, block, finding, confidence): blocks 1 to the greatest, those without a finding filled in.

    ``findings`` has doc, block, finding, confidence; a document with a null block alone counts to ``empty_max``.
    """
    top = findings.groupBy(doc).agg(F.coalesce(F.max("block"), F.lit(empty_max)).alias("top"))
    every = top.select(doc, F.explode(F.sequence(F.lit(1), F.greatest("top", F.lit(1)))).alias("block"))
    own = findings.where("block IS NOT NULL")
    holes = every.join(own.select(doc, "block"), [doc, "block"], "left_anti")
    return own.select(doc, "block", "finding", "confidence").unionByName(holes.select(doc, "block", F.lit(fill).alias("finding"), F.lit(confidence).alias("confidence")))


def status_of(severity: Column, confidence: Column) -> Column:
    return F.when((severity == "ERROR") & (confidence == "HIGH"), "CONFIRMED_ERROR").otherwise("DISPUTED")


def fidelity_of(status: Column, policy: str = "confirmed") -> Column:
    """'confirmed': a shift of meaning where confirmed, else a loss; 'loss': always a loss."""
    if policy == "loss":
        return F.lit("COMPONENT_LOSS")
    return F.when(status == "CONFIRMED_ERROR", "MEANING_SHIFT").otherwise("COMPONENT_LOSS")


def action_of(status: Column) -> Column:
    return F.when(status == "FALSE_POSITIVE", "PRESERVED").otherwise("REPORT_ONLY")


def clamped(action: Column) -> Column:
    """An analysis reports; it does not fix."""
    return F.when(action == "FIXED", "REPORT_ONLY").otherwise(action)


def carried(prior: DataFrame, new: DataFrame, candidates: DataFrame) -> DataFrame:
    """Decisions carried forward with new findings and precheck candidates, as a bag: nothing is merged."""
    return prior.unionByName(new, allowMissingColumns=True).unionByName(candidates, allowMissingColumns=True)


def candidate_ids(findings: DataFrame, doc: str, prefix: str, order: list[str]) -> DataFrame:
    """candidate_id: the prefix and a two-digit number within the document."""
    turn = F.row_number().over(W.partitionBy(doc).orderBy(*order))
    return findings.withColumn("candidate_id", F.format_string(f"{prefix}%02d", turn))


def with_source(sources: Column, run: Column) -> Column:
    """The run ids with one appended when the list has some and lacks it."""
    return F.when((F.size(sources) > 0) & ~F.array_contains(sources, run), F.array_append(sources, run)).otherwise(sources)


def normalised(finding: Column, known: tuple[str, ...], default: str) -> Column:
    """A finding struct with a known issue type and, unless all are given, without its omission fields."""
    issue = F.when(F.upper(finding["issue_type"]).isin(*known), F.upper(finding["issue_type"])).otherwise(default)
    whole = finding[OMISSION[0]].isNotNull()
    for f in OMISSION[1:]:
        whole = whole & finding[f].isNotNull()
    out = finding.withField("issue_type", issue)
    for f in OMISSION:
        out = out.withField(f, F.when(whole, finding[f]))
    return out


def counted(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def same_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows by which two tables of counts differ; empty when they agree."""
    return left.exceptAll(right).unionByName(right.exceptAll(left))
