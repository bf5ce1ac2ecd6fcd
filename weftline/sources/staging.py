"""Tables and files that a job writes for its own later steps, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Only a session on one machine may go without; it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def staging_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/weftline/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs its running tasks, not the stages before the table.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``df`` and column ``name``: a row's place from 1 among the rows of its key, in order; for keys with more rows than a task should sort.

    Rows are sorted in ranges of (key, order); only the ranges' sizes meet by key.
    """
    at = F.shiftright("_id", 33).alias("_at")
    ranges = staged(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_id", F.monotonically_increasing_id()), "ranges")
    sizes = ranges.groupBy(key, at).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(key).alias("_key"), F.col("_at"), (before - F.col("_first") + 1).alias("_offset"))
    d = ranges.select("*", at).join(F.broadcast(offsets.withColumnRenamed("_at", "_of")), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_at") == F.col("_of")))
    return d.select(*df.columns, (F.col("_id") + F.col("_offset")).alias(name))


def clear_staged(spark: SparkSession) -> None:
    """Remove what this application staged; results that still read it must have been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(staging_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
