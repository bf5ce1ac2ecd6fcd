"""The chapter gate: twelve checks on evidence, and whether all hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.sources.blocks import MARK

OPEN_MARK = "<!-- ??? -->"
SCANS = ("grammar", "style", "format", "alignment", "address")
CHECKS = (
    "output", "blocks", "scans", "precheck", "runs", "phase1", "phase2", "audit", "final-read", "summary-lines", "open-decisions", "markers",
)


def fresh(report: Column, output: Column) -> Column:
    """A report is there and not older than the text."""
    return F.coalesce(report >= output, F.lit(False))


def checks(evidence: DataFrame) -> DataFrame:
    """(doc_id, check_no, check, ok) from one row per chapter.

    Columns: output_at, text, audit_at, audit_text, precheck_at (null: absent), ja_blocks and ru_blocks
    (arrays), scan_at (map of scan to time), runs_a, runs_b, phase1, phase2 (counts).  Without an output
    the checks that read it fail.
    """
    has = F.col("output_at").isNotNull()
    text, audit = F.coalesce("text", F.lit("")), F.coalesce("audit_text", F.lit(""))
    scans = F.lit(True)
    for s in SCANS:
        scans = scans & fresh(F.try_element_at("scan_at", F.lit(s)), F.col("output_at"))
    lines_ = F.lit(True)
    for name in ("GRAMMAR", "STYLE", "FORMAT"):
        lines_ = lines_ & audit.rlike(rf"(?U)\b{name}\b")
    covered = (F.size("ja_blocks") > 0) & (F.size(F.array_except("ja_blocks", "ru_blocks")) == 0)
    ok = (
        has, has & covered, has & scans, F.col("precheck_at").isNotNull(), (F.col("runs_a") > 0) & (F.col("runs_b") > 0), F.col("phase1") > 0,
        F.col("phase2") > 0, fresh(F.col("audit_at"), F.col("output_at")), audit.rlike(r"(?mU)^#{2,4}[^\n]*\bFINAL READ\b"), lines_,
        has & ~text.contains(OPEN_MARK), has & ~text.rlike(r"(?m)^[ \t]*#{3,}[ \t]*$"),
    )
    listed = F.array(*[F.struct(F.lit(i + 1).alias("check_no"), F.lit(n).alias("check"), F.coalesce(o, F.lit(False)).alias("ok")) for i, (n, o) in enumerate(zip(CHECKS, ok, strict=True))])
    return evidence.select("doc_id", F.inline(listed))


def evidence_of(files: DataFrame) -> DataFrame:
    """What ``checks`` reads, one row a chapter, from (path, modified, text) of all files of a project.

    output/<chapter>.md, ja/<chapter>.md, audit/<chapter>.md (the volume padded to two digits or not; the padded one wins),
    prefilter/<chapter>-<scan>.md and sma/<chapter>/<precheck, a, b, c, analysis>/<run>.json, wherever the folders lie.  Other files count
    for nothing.  Chapters are told by any of their files.
    """
    path, none = F.col("path"), F.lit(None).cast("string")
    part = lambda pattern, n: F.nullif(F.regexp_extract(path, pattern, n), F.lit(""))
    page = r"/(output|ja|audit)/v0*(\d+)-([^/]+)\.md$"
    scan = rf"/prefilter/(v\d+-[^/]+)-({'|'.join(SCANS)})\.md$"
    run = r"/sma/([^/]+)/(precheck|a|b|c|analysis)/([^/]+)\.json$"
    chapter = F.coalesce(F.concat(F.lit("v"), part(page, 2), F.lit("-"), part(page, 3)), part(scan, 1), part(run, 1))
    role = F.coalesce(part(page, 1), F.when(part(scan, 1).isNotNull(), "scan"), part(run, 2))
    blind = (F.col("role") == "analysis") & part(run, 3).endswith(".phase1")
    d = files.select(chapter.alias("doc_id"), role.alias("role"), part(scan, 2).alias("scan"), path.rlike(r"/audit/v\d\d+-").alias("padded"), path.alias("path"), "modified", "text").where("doc_id IS NOT NULL")
    at = lambda r: F.max(F.when(F.col("role") == r, F.col("modified")))
    body = lambda r: F.max(F.when(F.col("role") == r, F.coalesce("text", F.lit(""))))
    audit = F.max_by(F.struct("modified", F.coalesce("text", F.lit("")).alias("text")), F.when(F.col("role") == "audit", F.col("padded")))
    scans = F.map_from_entries(F.collect_list(F.when(F.col("role") == "scan", F.struct("scan", "modified"))))
    per = d.groupBy("doc_id").agg(
        at("output").alias("output_at"), body("output").alias("text"), body("ja").alias("ja"), audit.alias("audit"), at("precheck").alias("precheck_at"), scans.alias("scan_at"),
        F.count_if(F.col("role") == "a").alias("runs_a"), F.count_if(F.col("role") == "b").alias("runs_b"), F.count_if(blind).alias("phase1"), F.count_if((F.col("role") == "analysis") & ~blind).alias("phase2"),
    )
    numbers = lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(?m)^[ \t]*{MARK}[ \t]*$"), F.lit(1)), lambda n: n.try_cast("int"))
    return per.select("doc_id", "output_at", "text", F.col("audit.modified").alias("audit_at"), F.coalesce("audit.text", none).alias("audit_text"), "precheck_at", numbers(F.col("ja")).alias("ja_blocks"),
                      numbers(F.col("text")).alias("ru_blocks"), "scan_at", "runs_a", "runs_b", "phase1", "phase2")


def as_of(events: DataFrame, states: DataFrame, keys: list[str], at: str, state: str) -> DataFrame:
    """``events`` with column ``state``: the last of ``states`` (keys, at, state) at or before each event, null if none.

    A union and a running last value: one shuffle on the keys, no join and no pairs.  Of states of one time the greatest counts.
    """
    tagged = states.select(*keys, at, F.lit(0).alias("_turn"), F.col(state).alias("_state"), F.lit(None).cast(events.select(F.struct("*")).schema[0].dataType).alias("_event"))
    asked = events.select(*keys, at, F.lit(1).alias("_turn"), F.lit(None).cast(states.schema[state].dataType).alias("_state"), F.struct("*").alias("_event"))
    upto = W.partitionBy(*keys).orderBy(at, "_turn", "_state").rowsBetween(W.unboundedPreceding, W.currentRow)
    return tagged.unionByName(asked).withColumn(state, F.last("_state", ignorenulls=True).over(upto)).where("_turn = 1").select("_event.*", state)


def verdicts(checked: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, closed, total, ready)."""
    return checked.groupBy(key).agg(F.count_if("ok").alias("closed"), F.count("*").alias("total"), F.every("ok").alias("ready"))


def strictly_sorted(rows: DataFrame, doc: str, order: str, value: str) -> DataFrame:
    """(doc, n, unique, sorted): whether values are unique and rise in the given order."""
    before = F.lag(value).over(W.partitionBy(doc).orderBy(order))
    d = rows.select(doc, value, (before.isNull() | (before < F.col(value))).alias("up"))
    return d.groupBy(doc).agg(F.count("*").alias("n"), (F.count("*") == F.count_distinct(value)).alias("unique"), F.every("up").alias("sorted"))
