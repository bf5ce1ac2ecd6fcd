"""Hard-negative mining by inner product, with an orthogonal rotation that ends most products early.

Every anchor is held against every row, in blocks; what is saved is arithmetic.  A principal component analysis of all
rows gives an orthogonal matrix, which keeps inner products and moves most of their size into the leading
components.  A block's products of the leading components are one small matrix product.  The rest of a product is at
most the product of both vectors' residual norms (Cauchy-Schwarz), so a pair whose partial product plus that bound stays under the
anchor's threshold is discarded, then again after more components, and only survivors get their integer
product, which alone decides.  Thresholds rise while an anchor's best rows are found.

The bound holds in floating point.  Rotation and partial product are off by at most ``slack`` times both
norms (the distance of the matrix from orthogonality, measured, plus the rounding of sums of d terms).  It is added
under the root of each residual norm, where by Cauchy-Schwarz it counts in full.

Two passes: an anchor's nearest rows of its label (positives), then for each of them the highest rows of other
labels inside the band of its score.  Work is dealt to cells (a group of anchors, a group of rows), each bounded in
values, so no task grows with the table and no label, however frequent, is one task.  A cell returns at most
``positives`` (``negatives``) rows for each anchor (and positive); a window over them decides.  The driver sees the
matrix and three figures.

Cases: rows with a null id, label or vector, or with a null or non-finite component take no part, nor do vectors whose
squared length is 2**62 or more, as their scores would not fit 64 bits; shorter vectors are filled with zeros; an
empty vector scores 0 with all.  Rows are told apart by place, not by id: a repeated row is another row, a repeated anchor has
its results twice; equal scores are ordered by the smaller id.  Tables without anchors, positives or other labels give
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm._common import partitions, staged

LEAST, MOST = -(1 << 62), (1 << 63) - 1
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
PACKED = "row long, id long, label long, anchor boolean, v binary"
FOUND = "anchor_row long, k int, score long, id long"
_NONE = pa.schema([("anchor_row", pa.int64()), ("k", pa.int32()), ("score", pa.int64()), ("id", pa.int64())]).empty_table()


@dataclass(frozen=True)
class MiningParams:
    """A negative's score lies between low and high percent of its positive's."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    cell_values: int = 1 << 23  # vector components of a cell's rows; a quarter of it for its anchors
    cell_rows: int = 4096  # rows for which a cell of its own is worth while
    levels: tuple[float, ...] = (0.25, 0.5)  # shares of the components after which pairs are discarded


def scaled_vectors(embeddings: DataFrame, id_: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(id, label, anchor, v): whole-numbered vectors floor(256 * x); every seventh id has the next of ten labels, every 50th is an anchor."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    d = embeddings.select(F.col(id_).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    d = d.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", real))
    whole = lambda x: F.when(F.abs(x) < 2.0**44, F.floor(256 * x).cast("double")).otherwise(256 * x)
    changed = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return d.select("id", changed.alias("label"), (F.col("id") % 50 == 0).alias("anchor"), F.transform("v", whole).alias("v"))


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """An orthogonal matrix (component by principal component) of two vectors or more; the identity where figures overflow."""
    filled = F.concat("v", F.array_repeat(F.lit(0.0), d - F.size("v")))
    found = PCA(k=d, inputCol="x", outputCol="y").fit(vectors.select(array_to_vector(filled).alias("x"))).pc.toArray()
    return np.linalg.qr(found)[0] if np.isfinite(found).all() else np.eye(d)


def packed(vectors: DataFrame) -> DataFrame:
    """PACKED rows: whole numbers of two bytes, or of four where one needs them."""
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), "id", "label", "anchor", "v")
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.where(length < 2.0**62)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.array(x, np.float64) for x in b["v"].to_pylist()]
            out = [x.astype("<i2").tobytes() + b"\0" if not x.size or np.abs(x).max() < 1 << 15 else x.astype("<i4").tobytes() for x in v]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("row", "id", "label", "anchor")), pa.array(out, pa.binary())], ["row", "id", "label", "anchor", "v"])

    return rows.mapInArrow(run, PACKED)


class Block:
    """The rows of a cell by label: whole numbers, rotated components and norms of what follows each level."""

    def __init__(self, table: pa.Table, q: np.ndarray, levels: tuple[int, ...], slack: float):
        table = table.sort_by([("label", "ascending"), ("row", "ascending")])
        self.row, self.id, self.label = (table[c].to_numpy() for c in ("row", "id", "label"))
        self.x = np.zeros((len(table), len(q)), np.int32)
        for i, v in enumerate(table["v"].to_pylist()):  # an odd length marks numbers of two bytes
            own = np.frombuffer(v, "<i2", len(v) // 2) if len(v) % 2 else np.frombuffer(v, "<i4")
            self.x[i, : len(own)] = own
        self.y = self.x.astype(np.float64) @ q
        squares = (self.y**2).sum(1)
        self.norm = np.sqrt(squares)
        self.rest = [np.sqrt((self.y[:, k:] ** 2).sum(1) + slack * squares) for k in levels]


class Best:
    """The ``k`` highest scores of each of ``n`` queries, the smaller id first among equal ones."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), LEAST, np.int64), np.full((n, k), MOST, np.int64)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, at: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        own = np.unique(at)
        at = np.concatenate([np.repeat(own, self.k), at])
        score, id_ = np.concatenate([self.score[own].ravel(), score]), np.concatenate([self.id[own].ravel(), id_])
        order = np.lexsort((id_, -score, at))
        at, score, id_ = at[order], score[order], id_[order]
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
        kept = rank < self.k
        self.score[at[kept], rank[kept]], self.id[at[kept], rank[kept]] = score[kept], id_[kept]


def steps(n: int, first: int = 256, most: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of growing size, so that thresholds exist before the large ones."""
    at, size = 0, first
    while at < n:
        yield at, min(n, at + size)
        at, size = at + size, min(most, size * 4)


def integer_products(a: Block, i: np.ndarray, b: Block, j: np.ndarray, piece: int = 1 << 16) -> np.ndarray:
    """Exact products of pairs of rows, at most ``piece`` pairs at a time."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), piece):
        s = slice(at, at + piece)
        out[s] = np.einsum("ij,ij->i", a.x[i[s]].astype(np.int64), b.x[j[s]].astype(np.int64))
    return out


def survivors(a: Block, i0: int, i1: int, b: Block, j0: int, j1: int, levels: tuple[int, ...], low: np.ndarray, high: np.ndarray | None, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of both ranges that may score from ``low`` to ``high`` of their anchor."""
    k = levels[0]
    part = a.y[i0:i1, :k] @ b.y[j0:j1, :k].T
    bound = np.multiply.outer(a.rest[0][i0:i1], b.rest[0][j0:j1])
    keep = allowed & (part + bound >= low[:, None])
    if high is not None:
        keep &= part - bound <= high[:, None]
    i, j = np.nonzero(keep)
    part = part[i, j]
    for level, (k0, k1) in enumerate(zip(levels[:-1], levels[1:], strict=True), 1):
        out = []
        for at in range(0, len(i), 1 << 16):
            s = slice(at, at + (1 << 16))
            p = part[s] + np.einsum("ij,ij->i", a.y[i0 + i[s], k0:k1], b.y[j0 + j[s], k0:k1])
            bound = a.rest[level][i0 + i[s]] * b.rest[level][j0 + j[s]]
            ok = p + bound >= low[i[s]]
            if high is not None:
                ok &= p - bound <= high[i[s]]
            out.append((np.flatnonzero(ok) + at, p[ok]))
        at = np.concatenate([x[0] for x in out]) if out else np.zeros(0, np.int64)
        part = np.concatenate([x[1] for x in out]) if out else part
        i, j = i[at], j[at]
    return i0 + i, j0 + j


def nearest(a: Block, b: Block, levels: tuple[int, ...], k: int, chunk: int = 256) -> Best:
    """The ``k`` best other rows of each anchor's label."""
    best = Best(len(a.row), k)
    for i0 in range(0, len(a.row), chunk):
        i1 = min(len(a.row), i0 + chunk)
        from_, to = np.searchsorted(b.label, a.label[i0], "left"), np.searchsorted(b.label, a.label[i1 - 1], "right")
        for lo, hi in steps(to - from_):
            j0, j1 = from_ + lo, from_ + hi
            allowed = (a.label[i0:i1, None] == b.label[None, j0:j1]) & (a.row[i0:i1, None] != b.row[None, j0:j1])
            i, j = survivors(a, i0, i1, b, j0, j1, levels, best.least()[i0:i1], None, allowed)
            score = integer_products(a, i, b, j)
            ok = score >= best.least()[i]
            if ok.any():
                best.add(i[ok], score[ok], b.id[j[ok]])
    return best


def highest_below(a: Block, wanted: list[np.ndarray], b: Block, levels: tuple[int, ...], k: int, low: int, high: int, chunk: int = 256) -> tuple[np.ndarray, np.ndarray, Best]:
    """(anchor, number) of each positive, and the ``k`` best rows of other labels in its band; ``wanted`` are the positives' scores by anchor."""
    count = np.array([len(w) for w in wanted], np.int64)
    first = np.cumsum(count) - count
    anchor, score = np.repeat(np.arange(len(wanted)), count), np.concatenate([*wanted, np.zeros(0, np.int64)]).astype(object)
    least = np.array([-((-low * s) // 100) for s in score], np.int64)
    most = np.array([high * s // 100 for s in score], np.int64)
    best = Best(len(anchor), k)
    top = np.full(len(wanted), LEAST, np.int64)
    np.maximum.at(top, anchor, np.where(least <= most, most, LEAST))
    for i0 in range(0, len(a.row), chunk):
        i1 = min(len(a.row), i0 + chunk)
        own = slice(first[i0], first[i1 - 1] + count[i1 - 1])
        for j0, j1 in steps(len(b.row)):
            floor = np.full(i1 - i0, MOST, np.int64)
            np.minimum.at(floor, anchor[own] - i0, np.where(least[own] <= most[own], np.maximum(least[own], best.least()[own]), MOST))
            allowed = (a.label[i0:i1, None] != b.label[None, j0:j1]) & (count[i0:i1] > 0)[:, None]
            i, j = survivors(a, i0, i1, b, j0, j1, levels, floor, top[i0:i1], allowed)
            s = integer_products(a, i, b, j)
            for n in range(int(count[i0:i1].max(initial=0))):
                has = count[i] > n
                q = first[i[has]] + n
                ok = (s[has] >= np.maximum(least[q], best.least()[q])) & (s[has] <= most[q])
                if ok.any():
                    best.add(q[ok], s[has][ok], b.id[j[has][ok]])
    return anchor, np.arange(len(anchor)) - first[anchor], best


def hard_negatives(vectors: DataFrame, params: MiningParams = MiningParams()) -> DataFrame:
    """RESULT rows of (id, label, anchor, v array<double> of whole numbers)."""
    spark = vectors.sparkSession
    vectors = staged(vectors, "negatives-vectors")
    rows = staged(packed(vectors), "negatives-packed")
    n, m, d = vectors.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("v"))).first()
    d = max(1, d or 0)
    q = rotation(vectors, d) if n > 1 else np.eye(d)
    slack = float(np.linalg.norm(q.T @ q - np.eye(d))) + 16 * d**1.5 * 2.0**-53
    levels = tuple(sorted({max(1, int(d * s)) for s in params.levels}))

    groups = max(1, -(-m * d * 4 // params.cell_values))
    shares = max(1, -(-n * d // params.cell_values), min(-(-partitions(spark) // groups), -(-n // params.cell_rows)))
    dealt = lambda salt, parts: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    cell = (F.col("_g") * shares + F.col("_s")).alias("cell")
    by_cell = lambda rows: rows.repartition(groups * shares, "cell")  # noqa: E731  # by number: small cells take long, so they are not joined
    held = by_cell(rows.select("*", dealt(1, shares).alias("_s"), every(groups).alias("_g")).select(cell, "row", "id", "label", "v"))

    def asked(anchors: DataFrame) -> DataFrame:
        spread = anchors.select("*", dealt(2, groups).alias("_g"), every(shares).alias("_s"))
        return by_cell(spread.select(cell, *anchors.columns))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _NONE
        a, b = Block(left, q, levels, slack), Block(right, q, levels, slack)
        best = nearest(a, b, levels, params.positives)
        i, k = np.nonzero(best.score > LEAST)
        return pa.table({"anchor_row": a.row[i], "k": k.astype(np.int32), "score": best.score[i, k], "id": best.id[i, k]})

    anchors = staged(rows.where("anchor").select("row", "id", "label", "v"), "negatives-anchors")
    found = asked(anchors).groupBy("cell").cogroup(held.groupBy("cell")).applyInArrow(near, FOUND)
    order = W.partitionBy("anchor_row").orderBy(F.desc("score"), "id")
    found = found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= params.positives)
    per = found.groupBy("anchor_row").agg(F.array_sort(F.collect_list(F.struct("k", "score", "id"))).alias("wanted"))  # ``positives`` at most
    per = staged(anchors.join(per, anchors["row"] == per["anchor_row"]).drop("anchor_row"), "negatives-positives")

    def mined(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _NONE
        left = left.sort_by([("label", "ascending"), ("row", "ascending")])
        wanted = [np.array([w["score"] for w in ws], np.int64) for ws in left["wanted"].to_pylist()]
        a, b = Block(left, q, levels, slack), Block(right, q, levels, slack)
        anchor, number, best = highest_below(a, wanted, b, levels, params.negatives, params.low, params.high)
        i, k = np.nonzero(best.score > LEAST)
        return pa.table({"anchor_row": a.row[anchor[i]], "k": (number[i] + 1).astype(np.int32), "score": best.score[i, k], "id": best.id[i, k]})

    out = asked(per).groupBy("cell").cogroup(held.groupBy("cell")).applyInArrow(mined, FOUND)
    order = W.partitionBy("anchor_row", "k").orderBy(F.desc("score"), "id")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.negatives)
    positives = per.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"), F.inline("wanted"))
    positives = positives.withColumnsRenamed({"id": "positive_id", "score": "positive_score"})
    out = out.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(positives, ["anchor_row", "k"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
