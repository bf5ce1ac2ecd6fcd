"""Round 4: two versions are compared with one exchange of their texts, by document."""

from pyspark.sql import functions as F

from weftline.operators.style import drift_aligned


def frame(spark, texts):
    return spark.createDataFrame([(d, i, t) for d, ts in texts.items() for i, t in enumerate(ts, 1)], "doc_id string, para_no int, text string")


def test_texts_are_exchanged_once(spark):
    lines = spark.range(6000).select((F.col("id") % 60).alias("doc_id"), F.floor(F.col("id") / 60).cast("int").alias("para_no"), F.concat_ws(" ", *[F.sha2(F.concat_ws("-", "id", F.lit(k)), 512) for k in range(8)]).alias("text"))
    lines = lines.localCheckpoint()
    size = lines.agg(F.sum(F.octet_length("text"))).first()[0]
    new = lines.withColumn("text", F.when(F.col("para_no") % 4 == 0, F.concat(F.lit("no "), F.col("text"))).otherwise(F.col("text")))
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup("drift_texts", "")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so small a table would be broadcast
    try:
        assert drift_aligned(lines, new).count() == 1500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    tracker = spark.sparkContext.statusTracker()
    stages = [k for job in tracker.getJobIdsForGroup("drift_texts") for k in tracker.getJobInfo(job).stageIds]
    written = sum(store.lastStageAttempt(k).shuffleWriteBytes() for k in set(stages))
    assert 2 * size < written < 3 * size  # both versions once, hashes and numbers


def test_moves_formats_and_missing_texts(spark):
    old = frame(spark, {"a": ["One two three", "Four five six", "Seven eight nine", "Ten, eleven"], "b": ["x y z", "x y z", None, "end here"], "c": ["—", "same"]})
    new = frame(spark, {"a": ["Seven eight nine", "One two three", "Four five six", "Ten - eleven"], "b": ["end here", "x y z", None], "c": ["same", "…"]})
    got = {(r.doc_id, r.old_no, r.new_no, r.kind, r.strength) for r in drift_aligned(old, new).collect()}
    assert got == {
        ("a", 3, None, "paragraph-moved", "INFO"), ("a", None, 1, "paragraph-moved", "INFO"), ("a", 4, 4, "format", "INFO"),
        ("b", 1, None, "paragraph-moved", "INFO"), ("b", 2, None, "paragraph-moved", "INFO"), ("b", None, 2, "paragraph-moved", "INFO"),
        ("c", 1, None, "paragraph-lost", "STRONG"), ("c", None, 2, "paragraph-added", "STRONG"),
    }
