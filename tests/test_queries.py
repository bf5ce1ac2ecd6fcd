"""Every query with SQL agrees with it on the smallest tables; all others give rows."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from weftline import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_equals_sql(spark, name):
    df = core.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*columns).collect())
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute("SET timezone = 'UTC'")
    found = con.execute(core.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_benchmark_is_banded(spark):
    """Against brute force over all items."""
    lines = {}
    for r in core.doc_lines(spark, SF).collect():
        lines.setdefault(r.doc_id, []).append((r.para_no, len(r.text)))
    items = sorted((r.item_id, len(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    whole, want = sum(n for _, n in items), []
    for doc, paras in lines.items():
        before, total = 0, sum(n for _, n in paras)
        for para, n in sorted(paras):
            acc, block = 0, items[-1][0]
            for item, size in items:
                acc += size
                if before * whole < total * acc:
                    block = item
                    break
            want.append((doc, para, block))
            before += n
    got = [tuple(r) for r in core.QUERIES["proportional_band_join"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and max(b for _, _, b in got) > 5
