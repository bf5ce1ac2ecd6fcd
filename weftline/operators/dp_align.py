"""Alignment of two languages' paragraphs by dynamic programming on anchors and lengths.  Own design.

A step takes 0 to 2 paragraphs of either side.  Its gain is the share of common anchors (numbers, glossary keys) plus
the likeness of lengths after scaling by the chapter's ratio; skipping a paragraph costs.  All gains are whole millionths, so
sums are exact and ties are real ties, which the order of STEPS settles.

The program is sequential within a chapter, so a chapter is one group of an Arrow function (sizes and anchors only, no
texts).  Inside it the table is filled row by row, in numpy: all steps but a skip on the right come from earlier rows, and that
one has a constant price, so a row is a running maximum.  Only a band around the diagonal is filled.  Space is linear: of the
scores only every r-th pair of rows is kept, and the steps of one stretch of r rows at a time are made again while the
path is followed backwards.

The band is widened, twofold each time, until the best path leaves no border of it and the next wider band
gives the same total.  ``exact`` fills the whole table instead (still in linear space).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OUT = "doc_id string, pair_no int, left_from int, left_to int, right_from int, right_to int, gain long"
#: Paragraphs taken from the left and from the right by one step.
STEPS = ((1, 1), (1, 2), (2, 1), (2, 2), (1, 0), (0, 1))
UNIT = 1_000_000
_LOW = -(1 << 60)


@dataclass(frozen=True)
class AlignParams:
    """Gains in millionths."""

    anchor_weight: int = 2 * UNIT
    length_weight: int = UNIT
    both: int = 0  # for a step that takes paragraphs of both sides
    skip: int = -600_000
    merge: int = -150_000  # for a step that takes two paragraphs of a side
    band: int = 64  # paragraphs beside the diagonal, to begin with
    exact: bool = False
    single: bool = False  # one paragraph of each side at most in a step


class Side:
    """Paragraphs of a text: sizes and anchors, of single ones and of each with the one before it.

    ``keys`` holds (anchor, paragraph) as one sorted number, anchor * (n + 1) + paragraph; anchors are numbered by ``names``.
    """

    def __init__(self, paras: list[tuple[int, set]], names: dict):
        self.n = len(paras)
        one, own = np.array([size for size, _ in paras], np.int64), [a for _, a in paras]
        two = [own[i] | own[i - 1] if i else set() for i in range(self.n)]
        self.size = (one, np.concatenate([[0], one[1:] + one[:-1]]) if self.n else one)
        self.count = tuple(np.array([len(a) for a in x], np.int64) for x in (own, two))
        self.place = tuple(np.repeat(np.arange(self.n), c) for c in self.count)
        self.anchor = tuple(np.array([names.setdefault(a, len(names)) for s in x for a in s], np.int64) for x in (own, two))
        self.first = tuple(np.concatenate([[0], np.cumsum(c)]) for c in self.count)
        self.keys = tuple(np.sort(a * (self.n + 1) + p) for a, p in zip(self.anchor, self.place, strict=True))
        self.total = int(one.sum())


class Chapter:
    """The table of one chapter; ``rows`` makes rows of a band from the two rows before them."""

    def __init__(self, left: list[tuple[int, set]], right: list[tuple[int, set]], params: AlignParams):
        names: dict = {}
        self.left, self.right, self.params = Side(left, names), Side(right, names), params
        self.scale = (float(self.right.total), float(max(1, self.left.total)))

    def columns(self, i: int, band: int) -> tuple[int, int]:
        """First and last column of row ``i``, the latter exclusive."""
        n, m = self.left.n, self.right.n
        middle = i * m // n if n else 0
        return max(0, middle - band), (min(m, middle + band) if n else m) + 1

    def _common(self, a: int, b: int, i0: int, i1: int, lo: int, hi: int) -> np.ndarray:
        """How many anchors each left paragraph from ``i0`` to ``i1`` shares with each right one from ``lo`` to ``hi``."""
        own = slice(*self.left.first[a - 1][[i0, i1]])
        row, base, keys = self.left.place[a - 1][own] - i0, self.left.anchor[a - 1][own] * (self.right.n + 1), self.right.keys[b - 1]
        start, stop = np.searchsorted(keys, base + lo), np.searchsorted(keys, base + hi)
        n = stop - start
        at = np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)
        cell = np.repeat(row * (hi - lo) - base - lo, n) + keys[at]
        return np.bincount(cell, minlength=(i1 - i0) * (hi - lo)).reshape(i1 - i0, hi - lo)

    def gains(self, a: int, b: int, i0: int, i1: int, lo: int, hi: int) -> np.ndarray:
        """Of the steps that end at left paragraphs from ``i0`` to ``i1`` and right ones from ``lo`` to ``hi``."""
        p, left, right = self.params, self.left, self.right
        common = self._common(a, b, i0, i1, lo, hi)
        union = left.count[a - 1][i0:i1, None] + right.count[b - 1][None, lo:hi] - common
        n, m = left.size[a - 1][i0:i1, None] * self.scale[0], right.size[b - 1][None, lo:hi] * self.scale[1]
        most = np.maximum(n, m)
        alike = np.where(most > 0, np.floor(UNIT * (np.minimum(n, m) / np.maximum(most, 1.0))), UNIT).astype(np.int64)
        return p.anchor_weight * common // np.maximum(union, 1) + p.length_weight * alike // UNIT + p.both + p.merge * (a + b - 2)

    def rows(self, i0: int, i1: int, band: int, one: tuple[int, np.ndarray], two: tuple[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first column, scores, steps) of the rows from ``i0`` to ``i1``; ``one`` and ``two`` are the last two rows before, each (first column, scores)."""
        part = max(1, min(32, (1 << 20) // (2 * band + 1)))
        for start in range(i0, i1, part):
            end = min(i1, start + part)
            left = max(0, self.columns(start, band)[0] - 1)
            right = self.columns(end - 1, band)[1] - 1
            above = max(1, start)  # row i ends at left paragraph i - 1
            gains = [self.gains(a, b, above - 1, end - 1, left, right) for a, b in STEPS[: 1 if self.params.single else 4]] if end > above and right > left else []
            for i in range(start, end):
                lo, score, step = self._row(i, band, one, two, [g[i - above] for g in gains] if i else [], left)
                yield lo, score, step
                two, one = one, (lo, score)

    def _row(self, i: int, band: int, one: tuple[int, np.ndarray], two: tuple[int, np.ndarray], gains: list[np.ndarray], left: int) -> tuple[int, np.ndarray, np.ndarray]:
        lo, hi = self.columns(i, band)
        ways = np.full((len(STEPS) - 1, hi - lo), _LOW, np.int64)
        if i == 0:
            ways[0, 0] = 0
        for k, (a, b) in enumerate(STEPS[:-1]):
            if i < a or (b and k >= len(gains)):
                continue
            first, score = one if a == 1 else two
            from_, to = max(lo, first + b, b), min(hi, first + b + len(score))
            if to > from_:
                got = score[from_ - b - first : to - b - first]
                ways[k, from_ - lo : to - lo] = got + (gains[k][from_ - 1 - left : to - 1 - left] if b else self.params.skip)
        step = ways.argmax(0).astype(np.int8)
        best = ways.max(0)
        price = self.params.skip * np.arange(hi - lo, dtype=np.int64)
        along = np.maximum.accumulate(best - price) + price
        step[along > best] = len(STEPS) - 1
        return lo, along, step

    def total(self, band: int, every: int = 0) -> tuple[int, dict[int, tuple]]:
        """The best total inside a band, and the two rows before each ``every``-th row."""
        two = one = (0, np.zeros(0, np.int64))
        kept = {0: (one, two)}
        for i, (lo, score, _) in enumerate(self.rows(0, self.left.n + 1, band, one, two), 1):
            two, one = one, (lo, score)
            if every and i % every == 0:
                kept[i] = (one, two)
        return int(one[1][self.right.n - one[0]]), kept

    def path(self, band: int) -> tuple[int, list[tuple[int, int, int, int]], bool]:
        """(total, steps, whether the path meets a border that the table does not have)."""
        n, m = self.left.n, self.right.n
        total, kept = self.total(band, stretch := max(16, int(n**0.5)))
        met, out, i, j = False, [], n, m
        for first in sorted(kept, reverse=True):
            steps = [(lo, step) for lo, _, step in self.rows(first, min(n + 1, first + stretch), band, *kept[first])]
            while i >= first and (i or j):
                lo, step = steps[i - first]
                met |= (j == lo and lo > 0) or (j == lo + len(step) - 1 and j < m)
                a, b = STEPS[step[j - lo]]
                out.append((i - a, i, j - b, j))
                i, j = i - a, j - b
        return total, out[::-1], met

    def gain(self, step: tuple[int, int, int, int]) -> int:
        i0, i1, j0, j1 = step
        return self.params.skip if i0 == i1 or j0 == j1 else int(self.gains(i1 - i0, j1 - j0, i1 - 1, i1, j1 - 1, j1)[0, 0])


def align(left: list[tuple[int, set]], right: list[tuple[int, set]], params: AlignParams = AlignParams()) -> list[tuple[int, int, int, int, int]]:
    """(left from, left to, right from, right to, gain) of each step of the best way; ends exclusive.  Paragraphs are (size, anchors)."""
    chapter = Chapter(left, right, params)
    n, m = len(left), len(right)
    whole = n + m
    band = whole if params.exact else min(whole, max(params.band, -(-m // max(1, n)) + 2))
    total, found, met = chapter.path(band)
    while band < max(n, m) and (met or chapter.total(2 * band)[0] > total):
        band *= 2
        total, found, met = chapter.path(band)
    return [(*step, chapter.gain(step)) for step in found]


def dp_aligned(paragraphs: DataFrame, left: str, right: str, params: AlignParams = AlignParams()) -> DataFrame:
    """OUT for (doc_id string, lang, para_no int, size int, anchors array<string>); paragraph numbers are those given.

    Every paragraph is in exactly one step.  A chapter without one side gives steps that skip all of the other.
    """

    def one(table: pa.Table) -> pa.Table:
        sides: dict[str, list] = {left: [], right: []}
        for lang, no, size, anchors in zip(*(table[c].to_pylist() for c in ("lang", "para_no", "size", "anchors")), strict=True):
            if lang in sides:
                sides[lang].append((no, size or 0, set(anchors or ())))
        a, b = (sorted(sides[s], key=lambda p: p[0]) for s in (left, right))
        rows = align([p[1:] for p in a], [p[1:] for p in b], params)
        doc = table["doc_id"][0].as_py()
        at = lambda ps, i, j: (ps[i][0], ps[j - 1][0]) if j > i else (None, None)
        out = [(doc, k + 1, *at(a, x, y), *at(b, u, v), g) for k, (x, y, u, v, g) in enumerate(rows)]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        names = ("doc_id", "pair_no", "left_from", "left_to", "right_from", "right_to", "gain")
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=list(names))

    return paragraphs.select("doc_id", "lang", "para_no", "size", "anchors").groupBy("doc_id").applyInArrow(one, OUT)


def attached(steps: DataFrame) -> DataFrame:
    """(doc_id, block_no, left_from, left_to, right_from, right_to): the steps of ``dp_aligned`` as blocks.

    A step that skips a paragraph goes to the block before it, at a chapter's start to the first one, so every block
    has both sides unless the chapter lacks one.
    """
    upto = W.partitionBy("doc_id").orderBy("pair_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = (F.col("left_from").isNotNull() & F.col("right_from").isNotNull()).cast("int")
    d = steps.withColumn("block_no", F.greatest(F.sum(both).over(upto), F.lit(1)).cast("int"))
    return d.groupBy("doc_id", "block_no").agg(F.min("left_from").alias("left_from"), F.max("left_to").alias("left_to"), F.min("right_from").alias("right_from"), F.max("right_to").alias("right_to"))
