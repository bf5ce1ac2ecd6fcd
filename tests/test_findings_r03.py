"""Cases of the third round's findings: queries against their SQL on small tables that failed before."""

import unicodedata
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrameWriter, Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weftline.functions import text
from weftline.llm import kneser_ney
from weftline.llm._blocks import blocks
from weftline.operators import dp_align, segment, versions
from weftline.sources import runs
from weftline.sources.staging import placed
from weftline.sources.tables import keyed


def agrees(spark, tmp_path, name, **tables):
    """Rows of a query on given tables, which must be those of its SQL."""
    con = duckdb.connect()
    for t, df in tables.items():
        path = str(tmp_path / f"{t}.parquet")
        df.write.parquet(path)
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
    return want


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")


def test_upper_case_letter_by_letter(spark):
    """as DuckDB's upper, on the letters before Unicode 16 (Spark's tables are newer)."""
    points = spark.createDataFrame(pa.table({"c": [chr(i) for i in range(1, 0x20000) if unicodedata.category(chr(i)) not in ("Cs", "Cn") and chr(i) not in "ƛɤ"]}))
    pdf = points.select("c", text.upper_letters(F.col("c")).alias("up")).toArrow()
    assert duckdb.sql("SELECT count(*) FROM pdf WHERE upper(c) <> up").fetchall() == [(0,)]
    assert len(pdf) > 50_000


def test_plans_of_words_with_sharp_s(spark, tmp_path):
    """F2."""
    rows = [(i, t, "user", s) for i in range(4) for t, s in enumerate(["Erüß und Erüß", "Straße ﬁx", "ﬁx", "ΐα ᾳ", "plain"])]
    assert len(agrees(spark, tmp_path, "plan_publish", conversations=turns(spark, rows))) == 20


BEYOND = [(i, t, "user", f"text {i} {t}\nline") for i in (4, 12, 999, 9999, 10003, 10004, 10039, 12342, 12345, 100043, 123456) for t in (0, 1)]


def test_volumes_beyond_four_digits(spark, tmp_path):
    """chapters of five digits keep their whole number."""
    assert len(agrees(spark, tmp_path, "volume_files", conversations=turns(spark, BEYOND))) == 4


def test_lines_of_volumes_beyond_four_digits(spark, tmp_path):
    """F4."""
    assert len(agrees(spark, tmp_path, "volume_sink", conversations=turns(spark, BEYOND))) > 40


def test_slices_grow_with_the_text(spark):
    """not with the session's partitions alone."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x "), 500).alias("text"))
    few, many = blocks(docs).slices, blocks(docs, slice_bytes=20_000).slices
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions")) and many == 20
    assert blocks(docs.limit(0)).slices == few


def test_a_common_context_in_pieces():
    """bigrams merged in pieces of any size are those merged at once."""
    rng = np.random.default_rng(5)
    rows, want, follow = [], Counter(), {}
    for k in range(7):
        own = {(int(v) ** 3, int(t) << 50): int(rng.integers(0, 3)) for v, t in zip(rng.integers(1, 4, 60), rng.integers(0, 60, 60), strict=True)}
        v, t, c = (np.array([x[i] for x in sorted((*b, n) for b, n in own.items())], np.uint64) for i in range(3))
        rows.append(kneser_ney._bigram_message(0, k, v, t, c.astype(np.uint32)))
        want.update(own)
        follow[k] = list(zip(v.tolist(), t.tolist(), strict=True))
    asked = kneser_ney.Asked(rows)
    for most in (1, 7, 50, 10_000):
        got, found, sizes = Counter(), {k: [] for k in follow}, []
        for i, j, v, t, c, answered in asked.pieces(most):
            got.update({(int(asked.contexts[i:j][x]), int(y)): int(n) for x, y, n in zip(v, t, c, strict=True)})
            sizes.append(len(v))
            for k, lo, hi, at in answered:
                assert lo == len(found[k]) and hi == lo + len(at)
                found[k] += c[at].tolist()
        assert dict(got) == dict(want) and sum(sizes) == len(want)
        assert all(found[k] == [want[b] for b in follow[k]] for k in follow)
        assert most > 100 or max(sizes) < 40


def test_places_in_a_key_beyond_a_range(spark):
    """numbers of rows that are sorted in ranges, as one window gives them."""
    d = spark.range(3000).select(F.when(F.col("id") % 7 == 0, None).otherwise(F.when(F.col("id") % 3 == 0, "b").otherwise("a")).alias("k"), (F.col("id") * 7919 % 3001).alias("x"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = placed(d, "k", ["x"], "place")
        want = d.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("x")))
        assert sorted(map(repr, got.select("k", "x", "place").collect())) == sorted(map(repr, want.collect()))
        assert all(w not in got._jdf.queryExecution().executedPlan().toString() for w in ("row_number", "lead("))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_chunks_are_not_looked_up_by_document(spark):
    """the paragraphs after a chunk come to it by its key; no window holds a document's paragraphs."""
    paras = spark.range(1, 5001).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("para_no"), F.repeat(F.lit("x"), (F.col("id") * 37 % 240).cast("int")).alias("text"))
    whole, cut = segment.segmented(paras, chunk=1 << 14), segment.segmented(paras, chunk=256)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))
    assert "Window" not in cut._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in whole._jdf.queryExecution().optimizedPlan().toString()


def test_rows_dealt_by_key(spark):
    """the number of tasks follows the rows, not the session."""
    d = spark.range(10_000).select((F.col("id") % 900).alias("k"), "id")
    assert keyed(d, "k", rows_per_task=500).rdd.getNumPartitions() == 20
    per = keyed(d, "k", rows_per_task=500).select("k", F.spark_partition_id().alias("p")).distinct()
    assert per.count() == 900 and keyed(d, "k") is d


def test_missing_blocks_broadcast_nothing(spark, tmp_path):
    """orders are small files whose blocks are many rows."""
    spark.range(40).select(F.col("id").alias("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(90).select((F.col("id") % 45).alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"), F.lit("A").alias("l_returnflag")).write.parquet(str(tmp_path / "lineitem.parquet"))
    df = entry.queries()["missing_blocks_anti"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, df.select("doc_id", "block_no", "side").collect())) == sorted(con.execute(f"SELECT doc_id, block_no, side FROM ({entry.oracle_sql()['missing_blocks_anti']})").fetchall())
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_gaps_of_one_pair_are_not_groups(spark):
    """Gaps and documents go to Python as rows of batches; pairs on either side of the limit are as the program has them."""
    old = [(d, 1, "a b c d e f g h i j") for d in range(5)]
    new = [(0, 1, "a b c x y z u"), (1, 1, "a b c v w x y z u o p q"), (2, 1, "a b c k l m n o p q"), (3, 1, "a b c d e f g h i k"), (4, 2, "k l m")]
    frames = [spark.createDataFrame(x, "doc_id long, para_no int, text string") for x in (old, new)]
    df = versions.aligned(*frames)
    got = sorted((r.doc_id, r.old_no is not None and r.new_no is not None) for r in df.collect())
    params = dp_align.AlignParams(anchor_weight=dp_align.UNIT, length_weight=0, both=-300_000, skip=0, single=True)
    want = sorted((x[0], s[0] < s[1] and s[2] < s[3]) for x, y in zip(old, new, strict=True) for s in dp_align.align([(1, set(x[2].split()))], [(1, set(y[2].split()))], params))
    assert got == want and {p for _, p in got} == {True, False}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "MapInArrow" in plan


def test_packed_runs_and_chapters(spark, tmp_path, monkeypatch):
    """files of a run or a chapter are rows of an archive; a broken one has no rows."""
    files = spark.createDataFrame([("/a.json", '{"audit_run_id": "r1", "chapter": "c", "findings": [{"block": 3, "problem": "p"}, {"block": 4}]}'), ("/b.json", '{"aud'), ("/c.json", "")], "path string, text string")
    got = runs.findings_of(files.withColumn("modified", F.timestamp_seconds(F.lit(0)))).select("path", "audit_run_id", "pos", "block", "problem").collect()
    assert sorted(map(tuple, got)) == [("/a.json", "r1", 0, 3, "p"), ("/a.json", "r1", 1, 4, None)]
    parts = []
    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda self, *columns: parts.append(columns) or self)
    rows = [(i, t, "user", f"text {t}") for i in range(9) for t in range(i % 4 + 1)]
    assert len(agrees(spark, tmp_path, "chapter_evidence", conversations=turns(spark, rows))) == 9
    assert not parts
