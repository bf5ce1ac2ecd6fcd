"""Tables in versions: a change is staged, read back, verified and only then made current; the version before stays.

A versioned table is a folder of two: ``data`` has a Parquet folder for each version, ``manifest`` a line of JSON for each
version that passed.  The current version is the highest in the manifest.  Making one current is the commit of one small file, which
Spark's committer moves into place by a rename; before that nobody sees the version, and a failure at any point leaves
the former one current (its staged folder is dead weight that no reader opens).  Two writers that start from the same
version both get its successor's number; the smaller id counts, and the other is told so.

Everything runs through Spark's readers and writers, so the folder may be in any store it can reach.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, id string, parent long, n_rows long, digest long"


class Rejected(Exception):
    """A version that failed its checks; ``problems`` says which, and by how many rows."""

    def __init__(self, problems: dict[str, int]):
        self.problems = problems
        super().__init__("; ".join(f"{name}: {n}" for name, n in sorted(problems.items())))


@dataclass(frozen=True)
class Version:
    number: int
    id: str


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """All published versions, one row each."""
    try:
        found = spark.read.schema(MANIFEST).json(f"{root}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    return found.where("version IS NOT NULL").groupBy("version").agg(F.min_by(F.struct("id", "parent", "n_rows", "digest"), "id").alias("m")).select("version", "m.*")


def current(spark: SparkSession, root: str) -> Version | None:
    last = manifest(spark, root).orderBy(F.desc("version")).limit(1).collect()
    return Version(last[0].version, last[0].id) if last else None


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the current one unless given."""
    rows = manifest(spark, root)
    found = (rows.orderBy(F.desc("version")).limit(1) if version is None else rows.where(F.col("version") == version)).collect()
    if not found:
        raise LookupError(f"no version {'' if version is None else version} in {root}")
    return spark.read.parquet(f"{root}/data/{found[0].id}")


def _figures(df: DataFrame) -> list[Column]:
    """The number of rows and a sum over their hashes: what was written must be what is read."""
    return [F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 31))), F.lit(0)).alias("digest")]


def publish(table: DataFrame, root: str, checks: dict[str, Column], unique: tuple[str, ...] = ()) -> Version:
    """Stage ``table`` as the next version, read it back, and make it current if all holds; else raise ``Rejected``.

    ``checks`` must be true for every row (null counts as false); the columns ``unique`` must tell all rows apart.
    """
    spark = table.sparkSession
    before = current(spark, root)
    version = Version(before.number + 1 if before else 1, uuid.uuid4().hex)
    path, seen = f"{root}/data/{version.id}", Observation()
    table.observe(seen, *_figures(table)).write.parquet(path)
    again = spark.read.schema(table.schema).parquet(path)
    failing = [F.count_if(~F.coalesce(check, F.lit(False))).alias(f"c{i}") for i, check in enumerate(checks.values())]
    got = again.agg(*_figures(again), *failing).first()
    problems = {name: got[f"c{i}"] for i, name in enumerate(checks) if got[f"c{i}"]}
    written = seen.get
    if (got.n, got.digest) != (written["n"], written["digest"]):
        problems["rows read are not the rows written"] = abs(got.n - written["n"])
    if unique and (twice := again.groupBy(*unique).count().where("count > 1").count()):
        problems["keys that come twice"] = twice
    if problems:
        raise Rejected(problems)
    row = [(version.number, version.id, before.number if before else None, got.n, got.digest)]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifest")
    if (after := manifest(spark, root).where(F.col("version") == version.number).first()).id != version.id:
        raise Rejected({f"version {version.number} was published by another writer ({after.id})": 1})
    return version
