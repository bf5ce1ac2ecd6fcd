"""A ledger of tasks and the runs it led to: task, subtask, last attempt, run id, run file.

Ledgers and runs are JSON of a fixed schema.  A file that does not parse is a row of the quarantine, with its text, and
stops nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.staging import staged
from weftline.sources.tables import keyed

LEDGER = "tasks array<struct<id:string,subtasks:array<struct<id:string,kind:string,attempts:array<struct<prompt:string>>>>>>"
BROKEN = "_broken"
# How a prompt of each kind names its run.
RUN_OF = {"sma-c": r'"audit_run_id": "([^"]+)"', "analyzer-phase1": r"Запуск фазы: (\S+)\.", "analyzer": r"Запуск анализа: (\S+)\."}


def quarantined(spark: SparkSession, path: str, schema: str, glob: str = "*.json", whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good, broken): rows of the schema with their file, and (path, text) of what did not parse.

    ``whole``: a file is one document of many lines; else each line is one, so many fit a file.
    """
    found = spark.read.schema(f"{schema}, {BROKEN} string").option("multiLine", whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN)
    rows = found.json(path, pathGlobFilter=glob, recursiveFileLookup=True).withColumn("path", F.col("_metadata.file_path"))
    rows = staged(rows, "quarantined")  # parsed once; Spark does not answer for broken rows alone otherwise
    good = rows.where(F.col(BROKEN).isNull()).drop(BROKEN)
    return good, rows.where(F.col(BROKEN).isNotNull()).select("path", F.col(BROKEN).alias("text"))


def run_of(prompt: Column, kind: Column) -> Column:
    """The run that a prompt of a kind names; null if it names none."""
    out = F.lit(None).cast("string")
    for name, pattern in RUN_OF.items():
        out = F.when(kind == name, F.nullif(F.regexp_extract(prompt, pattern, 1), F.lit(""))).otherwise(out)
    return out


def last_attempts(ledgers: DataFrame, *keep: str) -> DataFrame:
    """keep, task, subtask, kind, attempts (their number), run: the last attempt of each subtask."""
    d = ledgers.select(*keep, F.explode("tasks").alias("t"))
    d = d.select(*keep, F.col("t.id").alias("task"), F.explode("t.subtasks").alias("s"))
    prompt = F.try_element_at("s.attempts", F.lit(-1))["prompt"]
    return d.select(*keep, "task", F.col("s.id").alias("subtask"), F.col("s.kind").alias("kind"), F.coalesce(F.size("s.attempts"), F.lit(0)).alias("attempts"), run_of(prompt, F.col("s.kind")).alias("run"))


def chained(attempts: DataFrame, runs: DataFrame) -> DataFrame:
    """attempts with n_findings of their run and a problem: no-attempt, no-run-id, no-run-file, or null.

    ``runs`` has audit_run_id and findings; a run that several files hold counts all their findings.
    """
    sizes = runs.select(F.col("audit_run_id").alias("run"), F.coalesce(F.size("findings"), F.lit(0)).alias("n"))
    per = keyed(sizes, "run").groupBy("run").agg(F.sum("n").alias("n_findings"))
    d = attempts.join(per.hint("merge"), "run", "left")
    problem = F.when(F.col("attempts") <= 0, "no-attempt").when(F.col("run").isNull(), "no-run-id").when(F.col("n_findings").isNull(), "no-run-file")
    return d.withColumn("problem", problem)
