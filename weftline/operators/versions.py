"""Two versions of a document, paragraph by paragraph.  Own design.

Paragraphs whose letters are unique in both versions of a document are its fixed points, as far as their order agrees: the
longest increasing run of them (patience sorting), so a moved paragraph gives way to those that stay.  What is left
lies in gaps between fixed points and is aligned gap by gap with a dynamic program over shared words, one paragraph of
each side in a step; a pair that shares less than ``alike`` of its words is a loss and an addition.  So an inserted
paragraph is one addition and moves nothing else, and numbers of paragraphs mean nothing.

Texts are shuffled once, by document; fixed points are found before that from hashes and numbers, and the paragraphs of gaps
go on to Python, with their texts, from the same task.  The longest run is found
in one row a document (two numbers a paragraph), the programs in one row a gap; many rows go to Python in one batch.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.dp_align import UNIT, AlignParams, align


def longest_run(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest sequence of pairs that rises on both sides; the numbers of a side are distinct."""
    tops: list[int] = []  # the least last right number of a run of each length
    place, before = [], []
    pairs = sorted(pairs)
    for i, (_, right) in enumerate(pairs):
        k = bisect_left(tops, right)
        if k == len(tops):
            tops.append(right)
            place.append(i)
        else:
            tops[k], place[k] = right, i
        before.append(place[k - 1] if k else -1)
    out, i = [], place[-1] if place else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def letters(c: Column) -> Column:
    """128 bits of a text's letters and digits in lower case; null for a text that has none."""
    bare = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return F.when(bare != "", F.unhex(F.md5(bare.cast("binary"))))


def fixed_points(old: DataFrame, new: DataFrame, doc: str) -> DataFrame:
    """(doc, old_no, new_no, other) from (doc, no, text) of both versions; ``other``: the texts differ, if not in their letters.

    Both versions meet in one aggregate by hash, which carries no text.
    """
    none = F.lit(None)
    side = lambda df, at: df.select(doc, letters(F.col("text")).alias("hash"), *[(c if k == at else none.cast(t)).alias(f"{n}{k}") for k in (0, 1) for n, c, t in (("no", F.col("no"), "int"), ("is", F.xxhash64("text"), "long"))])
    each = side(old, 0).unionByName(side(new, 1)).where("hash IS NOT NULL").groupBy(doc, "hash")
    both = each.agg(*[F.count(f"no{k}").alias(f"n{k}") for k in (0, 1)], *[F.min(c).alias(c) for c in ("no0", "no1", "is0", "is1")]).where("n0 = 1 AND n1 = 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for own in b["pairs"].to_pylist():
                other = {x["no0"]: x["other"] for x in own}
                found.append([(*p, other[p[0]]) for p in longest_run([(x["no0"], x["no1"]) for x in own])])
            yield _rows(doc, b[doc], found, [("old_no", pa.int32()), ("new_no", pa.int32()), ("other", pa.bool_())])

    kind = old.schema[doc].dataType.simpleString()
    listed = both.groupBy(doc).agg(F.collect_list(F.struct("no0", "no1", (F.col("is0") != F.col("is1")).alias("other"))).alias("pairs"))
    return listed.mapInArrow(run, f"`{doc}` {kind}, old_no int, new_no int, other boolean")


def _rows(doc: str, docs: pa.Array, found: list[list[tuple]], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """What is found for each document or gap of a batch as rows."""
    at = pa.array([i for i, own in enumerate(found) for _ in own], pa.int32())
    parts = [pa.array([x[k] for own in found for x in own], t) for k, (_, t) in enumerate(columns)]
    return pa.RecordBatch.from_arrays([docs.take(at), *parts], [doc, *(n for n, _ in columns)])


def compared(old: DataFrame, new: DataFrame, doc: str = "doc_id", number: str = "para_no", text: str = "text", alike: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """The fixed points (``fixed_points``), and what lies between them: (doc, old_no, new_no, old, new, in_new, in_old).

    Every paragraph of either version is in one of them once, null where the other has no counterpart; ``in_new`` says whether the letters of
    the old paragraph are anywhere in the new version of the document, ``in_old`` the reverse.  Numbers order the paragraphs of a version and are distinct in it.
    """
    a, b = (df.select(doc, F.col(number).cast("int").alias("no"), F.col(text).cast("string").alias("text")) for df in (old, new))
    fixed = fixed_points(a, b, doc)
    one = lambda k, c: F.struct(F.lit(k).alias("side"), F.col(c).alias("no"))
    marks = fixed.select(doc, F.inline(F.array(one(0, "old_no"), one(1, "new_no"))))
    marks = marks.select(doc, "side", "no", F.lit(None).cast("string").alias("text"), F.lit(1).alias("mark"))
    for k, df in enumerate((a, b)):
        marks = marks.unionByName(df.select(doc, F.lit(k).alias("side"), "no", "text", F.lit(None).cast("int").alias("mark")))

    # One exchange by document; a fixed paragraph comes right after its mark, and all that follows keeps the documents together.
    order = W.partitionBy(doc, "side").orderBy("no", F.col("mark").asc_nulls_last())
    gap = F.count("mark").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    d = marks.repartition(doc).select("*", gap.alias("gap"), F.lag(F.when(F.col("mark").isNotNull(), F.col("no"))).over(order).alias("marked"))
    d = d.where("mark IS NULL AND NOT marked <=> no").select(doc, "gap", "side", "no", "text", letters(F.col("text")).alias("hash"))
    # Equal letters on the other side lie in a gap too: were that paragraph fixed, this one would be its counterpart.
    there = W.partitionBy(doc, "hash")
    elsewhere = F.when(F.col("hash").isNotNull(), F.min("side").over(there) != F.max("side").over(there))
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != ""))
    d = d.select(doc, "gap", "side", "no", "text", F.coalesce(elsewhere, F.lit(False)).alias("elsewhere"), words.alias("words"))

    params = AlignParams(anchor_weight=UNIT, length_weight=0, both=-int(alike * UNIT), skip=0, single=True)

    def steps(x: list[dict], y: list[dict]) -> list[tuple]:
        """Pairs of rows of both sides of a gap, None where one has no counterpart."""
        if not x or not y:
            return [(p, None) for p in x] + [(None, p) for p in y]
        sizes = [[(1, set(p["words"])) for p in side] for side in (x, y)]
        if len(x) == len(y) == 1:  # the program's answer for one pair; a tie is left to it
            one, two = sizes[0][0][1], sizes[1][0][1]
            if gain := UNIT * len(one & two) // max(1, len(one | two)) + params.both:
                return [(x[0], y[0])] if gain > 0 else [(x[0], None), (None, y[0])]
        at = lambda ps, i, j: ps[i] if j > i else None
        return [(at(x, s[0], s[1]), at(y, s[2], s[3])) for s in align(*sizes, params)]

    def of(p: dict | None, name: str) -> object:
        return p[name] if p else None

    columns = [("old_no", pa.int32()), ("new_no", pa.int32()), ("old", pa.string()), ("new", pa.string()), ("in_new", pa.bool_()), ("in_old", pa.bool_())]

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for own in b["rows"].to_pylist():
                sides = (sorted((r for r in own if r["side"] == k), key=lambda r: r["no"]) for k in (0, 1))
                found.append([(of(x, "no"), of(y, "no"), of(x, "text"), of(y, "text"), of(x, "elsewhere"), of(y, "elsewhere")) for x, y in steps(*sides)])
            yield _rows(doc, b[doc], found, columns)

    kind = old.schema[doc].dataType.simpleString()
    listed = d.groupBy(doc, "gap").agg(F.collect_list(F.struct("side", "no", "words", "text", "elsewhere")).alias("rows"))
    return fixed, listed.select(doc, "rows").mapInArrow(gaps, f"`{doc}` {kind}, old_no int, new_no int, old string, new string, in_new boolean, in_old boolean")


def aligned(old: DataFrame, new: DataFrame, doc: str = "doc_id", number: str = "para_no", text: str = "text", alike: float = 0.3) -> DataFrame:
    """(doc, old_no, new_no): every paragraph of either version once, null where the other has no counterpart (``compared``)."""
    fixed, rest = compared(old, new, doc, number, text, alike)
    return fixed.select(doc, "old_no", "new_no").unionByName(rest.select(doc, "old_no", "new_no"))
