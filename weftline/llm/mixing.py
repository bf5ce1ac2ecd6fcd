"""Mixing overlapping sources to target weights by min-cost flow.

The same text may come from several sources.  Documents are aggregated by the membership pattern of
their text (the set of sources that hold it), token capacity is routed from patterns to source quotas
at least repetition cost, and documents are drawn in seeded order within each (pattern, source) cell.

Flow network: source node -> pattern (capacity in steps: the first pass over the pattern's distinct
tokens is free, every further pass costs more, so cost is convex) -> (pattern, source) cell (at most
``max_repeats`` times the tokens of its rows) -> quota.  Cost depends on the pattern's step alone, so
adding the steps in order of cost and augmenting to a maximum flow after each is the successive
shortest path method and ends at a flow of least cost.  The network has one node per pattern and source.
Up to about ``max_patterns`` patterns are one network, solved in one task.  More are dealt by hash to several
networks: each gets of every source's quota the share of the source's tokens that it holds (which its cells can
always carry), so every pattern is routed with its overlap and its repetition cost, quotas are met to the word,
no task holds more than one network, and the cost is the least for that split.  Targets and quotas are
windows over the table of sources; nothing about patterns or sources reaches the driver but their number.

A cell takes every row ``flow // tokens`` times and the rest in seeded order; the last row is taken in
part, so each source meets its quota to the word.  The running sums are two-level (hash buckets, then
rows of one bucket), so a cell with a third of all rows is no single task.

Cases: null text has size 0 and takes 0 (texts of size 0 are in no pattern); a null source is the last source; ties and repeated rows are
interchangeable (``attached`` numbers the rows that are equal in id, source and text in one task); very long texts only count words; an empty table gives an empty result; extra columns are ignored (``attached`` keeps them, but
for those named like the columns it adds).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm._common import staged, unused, word_count


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (1, 2, 3)
    max_repeats: int = 3
    seed: int = 10
    buckets: int = 1024
    max_patterns: int = 20_000
    broadcast_rows: int = 200_000  # tables of sources and cells up to so many rows are broadcast


def targets(sizes: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """source, k, source_size, target of (source, size): shares of the total by weight, none over
    ``max_repeats`` times its size, the excess reshared by weight until none is above.

    Sources fill up in the order of ``max_repeats * size / weight``; a source is full when the level of the
    others, with all before it full, lies above it.
    """
    place = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in params.weights]), (F.col("k") % len(params.weights) + 1).cast("int"))
    d = sizes.withColumn("k", (F.row_number().over(place) - 1).cast("int")).withColumn("w", weight)
    d = d.withColumn("most", F.lit(params.max_repeats) * F.col("size")).withColumn("full", F.col("most") / F.col("w"))
    order, every = W.orderBy("full", "k"), W.partitionBy()
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("size").over(every) - F.coalesce(F.sum("most").over(upto), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    d = d.withColumn("level", left / rest).withColumn("is_full", F.col("full") < F.col("level"))
    level = F.min_by(F.when(~F.col("is_full"), F.col("level")), F.when(~F.col("is_full"), F.struct("full", "k"))).over(every)
    target = F.when(F.col("is_full"), F.col("most").cast("double")).otherwise(F.col("w") * level)
    return d.select("source", "k", F.col("size").alias("source_size"), target.alias("target"))


class Flow:
    """Maximum flow by blocking flows in layered networks; capacities may grow between calls."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def edge(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def augment(self, s: int, t: int) -> int:
        total = 0
        while True:
            layer = {s: 0}
            queue = deque([s])
            while queue:
                a = queue.popleft()
                for e in self.out[a]:
                    if self.room[e] and self.to[e] not in layer:
                        layer[self.to[e]] = layer[a] + 1
                        queue.append(self.to[e])
            if t not in layer:
                return total
            at = [0] * len(self.out)
            path: list[int] = []
            a = s
            while True:
                if a == t:
                    got = min(self.room[e] for e in path)
                    total += got
                    for e in path:
                        self.room[e] -= got
                        self.room[e ^ 1] += got
                    cut = next(i for i, e in enumerate(path) if not self.room[e])
                    a = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while at[a] < len(self.out[a]):
                    e = self.out[a][at[a]]
                    if self.room[e] and layer.get(self.to[e]) == layer[a] + 1:
                        break
                    at[a] += 1
                else:
                    if a == s:
                        break
                    layer[a] = -1
                    a = self.to[path.pop() ^ 1]
                    continue
                path.append(e)
                a = self.to[e]


def steps(distinct: int, most: int) -> list[int]:
    """Sizes of the cost steps of a pattern: one pass each at first, then twice as many each time."""
    found, passes = [], 1
    while most > 0 and distinct > 0:
        found.append(min(most, distinct * passes))
        most -= found[-1]
        passes = passes if len(found) < 3 else passes * 2
    return found


def route(cells: Sequence[tuple[int | str, int, int]], distinct: dict[int | str, int], quota: Sequence[int], max_repeats: int) -> dict[tuple[int | str, int], int]:
    """Tokens for each (pattern, source) of ``cells`` = (pattern, source, tokens of its rows)."""
    names = sorted({p for p, _, _ in cells})
    number = {p: i for i, p in enumerate(names)}
    s, t = len(names) + len(quota), len(names) + len(quota) + 1
    net, most = Flow(t + 1), dict.fromkeys(names, 0)
    edges = {}
    for p, k, tokens in sorted(cells):
        most[p] += max_repeats * tokens
        edges[p, k] = net.edge(number[p], len(names) + k, max_repeats * tokens)
    for k, q in enumerate(quota):
        net.edge(len(names) + k, t, q)
    inflow = {p: net.edge(s, number[p], 0) for p in names}
    plan = {p: steps(distinct[p], most[p]) for p in names}
    for level in range(max(map(len, plan.values()), default=0)):
        for p in names:
            if level < len(plan[p]):
                net.room[inflow[p]] += plan[p][level]
        net.augment(s, t)
    return {cell: net.room[e ^ 1] for cell, e in edges.items()}


def _routed(table: pa.Table, max_repeats: int) -> pa.Table:
    """pattern, k, passes, rest of the cells of one network."""
    cells = list(zip(table["pattern"].to_pylist(), table["k"].to_pylist(), table["tokens"].to_pylist(), strict=True))
    distinct = dict(zip(table["pattern"].to_pylist(), table["distinct"].to_pylist(), strict=True))
    quota = dict(zip(table["k"].to_pylist(), table["quota"].to_pylist(), strict=True))
    number = {k: i for i, k in enumerate(sorted(quota))}
    flow = route([(p, number[k], n) for p, k, n in cells], distinct, [quota[k] for k in sorted(quota)], max_repeats)
    out = [(p, k, *(divmod(flow[p, number[k]], n) if n else (0, 0))) for p, k, n in cells]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["pattern", "k", "passes", "rest"])


def planned(cells: DataFrame, known: DataFrame, params: MixParams) -> DataFrame:
    """pattern, k, passes, rest for (pattern, k, tokens, distinct)."""
    nets = max(1, -(-cells.select("pattern").distinct().count() // params.max_patterns))
    d = cells.withColumn("net", F.pmod(F.xxhash64("pattern"), F.lit(nets)).cast("int"))
    held = d.groupBy("net", "k").agg(F.sum("tokens").alias("held")).join(known.select("k", "source_size", F.round("target").cast("long").alias("q")), "k")
    order = W.partitionBy("k").orderBy("net")
    share = lambda upto: F.floor(F.col("q").cast("decimal(38,0)") * upto / F.greatest("source_size", F.lit(1)))
    held = held.withColumn("upto", F.sum("held").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    held = held.select("net", "k", (share(F.col("upto")) - share(F.col("upto") - F.col("held"))).cast("long").alias("quota"))
    repeats = params.max_repeats
    return d.join(held, ["net", "k"]).groupBy("net").applyInArrow(lambda t: _routed(t, repeats), "pattern long, k int, passes long, rest long")


def mix(docs: DataFrame, text: str = "text", doc: str = "doc_id", source: str = "source", params: MixParams = MixParams(), name: str = "mix") -> DataFrame:
    """doc_id, size, source, source_size, target, taken, content for every row of ``docs``."""
    rows = docs.select(
        F.col(doc).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("content"),
    )
    rows = staged(rows, f"{name}-rows")
    known = staged(targets(rows.groupBy("source").agg(F.sum("size").alias("size")), params), f"{name}-sources")
    small = lambda df: F.broadcast(df) if df.count() <= params.broadcast_rows else df
    rows = rows.join(small(known.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    # Texts without words, which every source may hold, have nothing to give and no part in patterns.
    empty, rows = rows.where("size = 0"), rows.where("size > 0")
    # Contents held by several sources; all others are members of their own source.  A pattern is the hash of its sources.
    shared = rows.groupBy("content").agg(F.sort_array(F.collect_set("k")).alias("ks")).where(F.size("ks") > 1)
    shared = staged(shared.select("content", F.xxhash64("ks").alias("pattern")), f"{name}-shared")
    joined = rows.join(shared, "content", "left")
    joined = joined.withColumn("pattern", F.coalesce("pattern", F.xxhash64(F.array("k"))))
    once = joined.groupBy("pattern", "content").agg(F.max("size").alias("size")).groupBy("pattern").agg(F.sum("size").alias("distinct"))
    cells = joined.groupBy("pattern", "k").agg(F.sum("size").alias("tokens")).join(once, "pattern")
    plan = small(staged(planned(staged(cells, f"{name}-cells"), known, params), f"{name}-plan"))

    joined = joined.join(plan, ["pattern", "k"])
    joined = joined.withColumn("ord", F.xxhash64(F.lit(params.seed), "content", "doc_id"))
    joined = joined.withColumn("bucket", F.pmod(F.shiftrightunsigned("ord", 20), F.lit(params.buckets)).cast("int"))
    sums = joined.groupBy("pattern", "k", "bucket").agg(F.sum("size").alias("n"))
    before = W.partitionBy("pattern", "k").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("pattern", "k", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("pattern", "k", "bucket").orderBy("ord", "content", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    out = joined.join(sums, ["pattern", "k", "bucket"])
    ahead = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - ahead))
    out = out.select("doc_id", "size", "source", "source_size", "target", (F.col("passes") * F.col("size") + part).cast("long").alias("taken"), "content")
    return out.unionByName(empty.select("doc_id", "size", "source", "source_size", "target", F.lit(0).cast("long").alias("taken"), "content"))


def attached(docs: DataFrame, taken: DataFrame, text: str = "text", doc: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``taken`` (rows of ``mix`` with taken > 0) draws, with size, source_size, target, taken.

    Equal rows are interchangeable and are matched one to one.
    """
    added = ("size", "source_size", "target", "taken")
    key_, turn = unused(docs, "_key", "_turn")
    key = lambda d, s, c: F.md5(F.to_json(F.struct(d.alias("d"), s.alias("s"), c.alias("c"))).cast("binary"))
    content = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    left = docs.withColumn(key_, key(F.col(doc), F.col(source), content))
    left = left.withColumn(turn, F.row_number().over(W.partitionBy(key_).orderBy(F.lit(0))))
    right = taken.select(key(F.col("doc_id"), F.col("source"), F.col("content")).alias(key_), *added)
    right = right.withColumn(turn, F.row_number().over(W.partitionBy(key_).orderBy(F.desc("taken"))))
    names = [c for c in docs.columns if c.lower() not in added]
    return left.select(*names, key_, turn).join(right, [key_, turn]).select(*names, *added)
