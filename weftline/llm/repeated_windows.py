"""Removal of repeated word windows with a count-min prefilter.

Every window of ``width`` words that also starts earlier (a smaller id, or the same document further
left) is a repeat; each word a repeat covers goes.

Round 1: a count-min sketch of ``depth`` rows.  Its width follows the corpus (``cells`` for each window a partition
may hold) and is cut into slices, each a fixed number of counters that saturate at two.  A block's partial
sketch is sent as the cells it touches, by row; a slice merges the partial sketches of all blocks into its
counters by saturating addition.  The estimate of a window is its smallest counter, which is never below the
count, so a window estimated once is unique and is dropped from further work; the others that are unique
are (windows / width) ** depth of all, under one in a hundred.
Round 2: each block sends one 96-bit key per window estimated repeated; the slice groups the keys of
all blocks exactly and answers which block has the first occurrence.  Within its block a window's
first place is known locally, so no positions are sent.
The texts are shuffled once; what is sent is about four bytes per window for the sketch and about ten
per repeated window.  Nothing is collected or broadcast.

Cases: null or empty text has no words; texts shorter than the window keep all words; rows with equal
ids are one document, so a window at the same place of both is not earlier than itself and both rows
keep it; null ids sort last; rows of one id, and all rows without one, share a block, which is one task; a
very long text is whole in its block; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm import _blocks as B
from weftline.llm._tokens import Batch, Words, hash_ranges, mix, window_hashes, words

KEYS, CHOSEN = 100, 101  # kinds of messages; the rows of the sketch count from 0
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


@dataclass(frozen=True)
class Sketch:
    """A count-min sketch over 64-bit keys: ``depth`` rows of 2**bits saturating counters, in equal slices."""

    bits: int
    slices: int
    depth: int = 2

    @classmethod
    def of(cls, slices: int, cells: int = 1 << 25, depth: int = 2) -> Sketch:
        """``cells`` counters a slice and row or up to twice as many: 12 to 24 a window where a partition holds 2.8 million windows."""
        return cls(min(60, (cells * slices - 1).bit_length()), slices, depth)

    @property
    def width(self) -> int:
        """Counters of one row in one slice."""
        return -(-(1 << self.bits) // self.slices)

    def cells(self, keys: np.ndarray, row: int) -> np.ndarray:
        h = keys if row == 0 else mix(keys + np.uint64(row * 0x9E3779B97F4A7C15 % 2**64))
        return h >> np.uint64(64 - self.bits)

    def parts(self, cells: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(slice, from, to) of sorted cells."""
        return B.parts(B.cuts(cells, self.bits, self.slices), len(cells))


class Counters:
    """The merged counters of one slice and row: they saturate at two, so merging in any order agrees."""

    def __init__(self, sketch: Sketch, slice_: int):
        self.low = np.uint64(slice_ * sketch.width)
        self.count = np.zeros(sketch.width, np.uint8)

    def add(self, cells: np.ndarray, twice: np.ndarray) -> None:
        """A partial sketch: distinct cells, and whether each counts two or more there."""
        at = cells - self.low
        self.count[at] = np.minimum(self.count[at] + np.uint8(1) + twice, 2)

    def repeated(self, cells: np.ndarray) -> np.ndarray:
        return self.count[cells - self.low] > 1


class Windows:
    """The windows of a block in document order, with two independent hashes."""

    def __init__(self, table: pa.Table, batch: Batch, width: int):
        self.w: Words = words(batch)
        h = hash_ranges(batch.data, self.w.start, self.w.end)
        self.at, self.key = window_hashes(h, self.w.first, width)
        _, second = window_hashes(h ^ (h >> np.uint64(29)), self.w.first, width)
        self.check = second.astype(np.uint32)
        # Rows of one id are one document: a window's place is (id, start in its row).
        ids = table["doc_id"].to_pylist()
        first = np.array([i and ids[i] == ids[i - 1] for i in range(len(ids))], bool)
        self.same = bool(first.any())
        if self.same:
            row = np.searchsorted(self.w.first, self.at, "right") - 1
            self.place = np.cumsum(~first)[row] << np.int64(40) | (self.at - self.w.first[row])
        else:
            self.place = self.at

    def cells(self, sketch: Sketch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a row of the sketch: distinct cells in order, cell number of each window, whether a cell holds two windows of this block."""
        cell, inverse, count = np.unique(sketch.cells(self.key, row), return_inverse=True, return_counts=True)
        return cell, inverse, count > 1

    def groups(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the chosen windows: their order by key, where each distinct key begins in it, whether each is its key's first place."""
        order = chosen[np.lexsort((self.place[chosen], self.check[chosen], self.key[chosen]))]
        key, check, place = self.key[order], self.check[order], self.place[order]
        new = np.ones(len(order), bool)
        new[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        begin = np.flatnonzero(new)
        lead = np.repeat(place[begin], np.diff(np.append(begin, len(order))))
        return order, begin, place == lead


def _number(table: pa.Table) -> int:
    return table["block"][0].as_py()


def repeated_windows(docs: DataFrame, width: int = 20, text: str = "text", doc: str = "doc_id", fan: int = B.FAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every input row."""
    layout = B.blocks(docs, text, doc, fan=fan)
    base, slices, to_slices, to_blocks = layout.rows, layout.slices, layout.to_slices, layout.to_blocks
    counting = Sketch.of(slices)

    def sketch(table: pa.Table) -> pa.Table:
        block = _number(table)
        w = Windows(*B.opened(table), width)
        out = []
        for row in range(counting.depth):
            cell, _, twice = w.cells(counting, row)
            out += [(s, block, row, hi - lo, B.pack(cell[lo:hi]), B.bits(twice[lo:hi])) for s, lo, hi in counting.parts(cell) if hi > lo]
        return to_slices.send(out, block)

    def merge(table: pa.Table) -> pa.Table:
        rows, out = B.read(table), []
        own = rows[0][0]
        for row in range(counting.depth):
            mine = [r for r in rows if r[2] == row]
            counters = Counters(counting, own)
            for r in mine:
                counters.add(B.unpack(r[4]), B.unbits(r[5], r[3]))
            out += [(own, r[1], row, r[3], B.bits(counters.repeated(B.unpack(r[4]))), None) for r in mine]
        return to_blocks.send(out, own)

    def estimated(w: Windows, replies: list[tuple]) -> np.ndarray:
        """The windows all of whose counters passed one."""
        again = np.ones(len(w.key), bool)
        for row in range(counting.depth if len(w.key) else 0):
            _, inverse, _ = w.cells(counting, row)
            again &= np.concatenate([B.unbits(r[4], r[3]) for r in replies if r[2] == row])[inverse]
        return np.flatnonzero(again)

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return B.messages([])
        block = _number(left)
        w = Windows(*B.opened(left), width)
        chosen = estimated(w, B.read(right))
        order, begin, _ = w.groups(chosen)
        key, check = w.key[order[begin]], w.check[order[begin]]
        out = [(s, block, KEYS, hi - lo, B.pack(key[lo:hi]), check[lo:hi].tobytes()) for s, lo, hi in B.parts(B.cuts(key, 64, slices), len(key)) if hi > lo]
        mask = np.zeros(len(w.key), bool)
        mask[chosen] = True
        out.append((-1 - block, block, CHOSEN, len(mask), B.bits(mask), None))  # what was chosen, for the last round
        return to_slices.send(out, block)

    def firsts(table: pa.Table) -> pa.Table:
        rows = B.read(table)
        if rows[0][2] == CHOSEN:
            return to_blocks.send(rows, rows[0][0])
        keys = [B.unpack(r[4]) for r in rows]
        key, check = np.concatenate(keys), np.concatenate([np.frombuffer(r[5], np.uint32) for r in rows])
        order = np.lexsort((check, key))  # stable, and the rows come by block: the first of equals is the earliest block
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
        first = np.empty(len(order), bool)
        first[order] = new
        out, at = [], 0
        for r, k in zip(rows, keys, strict=True):
            out.append((r[0], r[1], KEYS, len(k), B.bits(first[at : at + len(k)]), None))
            at += len(k)
        return to_blocks.send(out, rows[0][0])

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        table, batch = B.opened(left)
        out: dict[str, list] = {"doc_id": table["doc_id"].to_pylist(), "n_words": [], "n_removed": [], "kept_sha256": []}
        if len(table):
            w = Windows(table, batch, width)
            rows = B.read(right)
            mask = next((r for r in rows if r[2] == CHOSEN), None)
            chosen = np.flatnonzero(B.unbits(mask[4], mask[3])) if mask else np.zeros(0, np.int64)
            order, begin, lead = w.groups(chosen)
            replies = [B.unbits(r[4], r[3]) for r in rows if r[2] == KEYS]
            own = np.repeat(np.concatenate(replies), np.diff(np.append(begin, len(order)))) if replies else np.zeros(0, bool)
            repeat = w.at[order[~(own & lead)]]
            cover = np.zeros(len(w.w.start) + 1, np.int64)
            np.add.at(cover, repeat, 1)
            np.subtract.at(cover, repeat + width, 1)
            gone = np.cumsum(cover[:-1]) > 0
            data = batch.data.tobytes()
            start, end, first = w.w.start.tolist(), w.w.end.tolist(), w.w.first.tolist()
            for i in range(len(table)):
                lo, hi = first[i], first[i + 1]
                keep = (lo + np.flatnonzero(~gone[lo:hi])).tolist()
                out["n_words"].append(hi - lo)
                out["n_removed"].append(hi - lo - len(keep))
                out["kept_sha256"].append(hashlib.sha256(b" ".join([data[start[k] : end[k]] for k in keep])).hexdigest())
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))

    sketched = to_slices.delivered(base.groupBy("block").applyInArrow(B.lean(sketch), B.MESSAGE))
    merged = to_blocks.delivered(sketched.groupBy("slice").applyInArrow(B.lean(merge), B.MESSAGE))
    chosen = to_slices.delivered(base.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(B.lean(candidates), B.MESSAGE))
    first = to_blocks.delivered(chosen.groupBy("slice").applyInArrow(B.lean(firsts), B.MESSAGE))
    return base.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(B.lean(removed), OUT)
