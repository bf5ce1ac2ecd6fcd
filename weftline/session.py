"""A session with the settings the operators assume; sizes are left to the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def session(name: str = "weftline", master: str | None = None, **more: str) -> SparkSession:
    """``more`` uses double underscores for dots: spark__sql__shuffle__partitions="2000"."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS)
    for k, v in more.items():
        builder = builder.config(k.replace("__", "."), v)
    return (builder.master(master) if master else builder).getOrCreate()
