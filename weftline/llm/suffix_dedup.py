"""Substring deduplication of bytes with external suffix arrays.

Every byte covered by a ``length``-byte string that also starts earlier (a smaller id, or the same document
further left) is removed; strings never cross documents and are judged on the input.

Sharding.  A suffix array of the corpus is built in shards that never part two equal strings: the
anchor of a string is the k-gram of the smallest hash inside it, so equal strings have equal anchors, and
the shard is a range of anchor hashes.  Neighbouring strings mostly share their anchor; such a run of
starts with the text it spans is a *context* (about 1.7 lengths for every 40 starts).

Round 1 sends each slice the distinct (anchor, context hash) pairs of each block, with hashes of the bytes
next to the anchor.  A context that an earlier block has is a repeat as a whole (this collapses exact
copies before any text moves); of different contexts, only those that agree with another on a side of
the anchor can share a string.
Round 2 sends the texts of the remaining contexts, each from the first block that has it.  The slice
writes them to a file as they arrive, sorts all their suffixes by external induced sorting (``induced_sort``),
walks through the order once, cutting it where neighbours share fewer than ``length`` bytes, and marks all but the
earliest start of each group.  Text, order, prefixes, groups and marks are files of the task beyond a share of
``memory``, so a shard may be far larger than memory; an anchor next to many different texts (a common passage's
edge) keeps all its contexts in one shard, which then takes one task its time, not its memory.

Cases: null or empty text has no bytes; rows with equal ids are one document, so a string at the
same place of both is not earlier than itself; null ids sort last; rows of one id, and all rows without
one, share a block, which is one task; a very long text is whole in its block, so it needs memory in proportion
to its length; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftline.llm import _blocks as B
from weftline.llm._tokens import Batch, mix
from weftline.llm.induced_sort import Space, scratch, sorted_suffixes

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
PAIRS, ANSWER, CHOSEN, TEXTS, MARKS = range(5)


@dataclass(frozen=True)
class SuffixParams:
    length: int = 100  # 250 at most
    gram: int = 20  # 8 to 24, and at most a third of the length
    memory: int = 192 << 20  # of one sort
    shards: int = 3  # suffix arrays for each slice


def sliding_argmin(key: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest of each ``width`` neighbours by the upper 32 bits, leftmost of equals; fewer than 2**32 keys."""
    n = len(key)
    rows = -(-n // width)
    padded = np.full(rows * width, np.uint64(2**64 - 1))
    padded[:n] = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Contexts:
    """The contexts of a block: runs of starts with one anchor, in document order."""

    def __init__(self, table: pa.Table, batch: Batch, params: SuffixParams, bits: int):
        self.data, self.offsets, self.length = batch.data, batch.offsets, params.length
        found, at, n = [], 0, len(self.offsets) - 1
        while at < n:  # whole texts, a few hundred kilobytes at a time: the working arrays stay in cache
            to = max(at + 1, int(np.searchsorted(self.offsets, self.offsets[at] + (256 << 10), "right")) - 1)
            found.append(self._runs(at, to, params))
            at = to
        kinds = (np.int64, np.int64, np.uint64, np.uint64, np.uint32, np.uint32)
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, k) for k in kinds]
        self.begin, self.end, anchor, self.context, self.left, self.right = (x.astype(k, copy=False) for x, k in zip(parts, kinds, strict=True))
        self.anchor = anchor >> np.uint64(64 - bits)
        row = np.searchsorted(self.offsets, self.begin, "right") - 1
        ids = table["doc_id"].to_pylist()
        document = np.cumsum([0, *(a != b for a, b in zip(ids[:-1], ids[1:], strict=True))]) if ids else np.zeros(0, np.int64)
        self.place = (document[row] << np.int64(40)) | (self.begin - self.offsets[row]) if len(row) else np.zeros(0, np.int64)
        # Distinct (anchor, context) by anchor; of equals the first place stands for all.
        self.order = np.lexsort((self.place, self.context, self.anchor))
        a, c = self.anchor[self.order], self.context[self.order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        self.head = self.order[new]
        self.entry = np.empty(len(a), np.int64)
        self.entry[self.order] = np.cumsum(new) - 1
        self.lead = self.place == self.place[self.head][self.entry]

    def _runs(self, lo: int, hi: int, params: SuffixParams) -> tuple[np.ndarray, ...]:
        """Of some texts: first and last start of each run, anchor key, context hash, side hashes.

        Hashes of byte ranges are sums over their k-grams, plain and weighted by place, so two running sums
        give any range.  A side hash covers the bytes next to the anchor, half of a window's other bytes
        rounded up: equal windows have that much on one side of the anchor, so their contexts agree on a
        side; 0 where the context ends before.
        """
        base, stop = int(self.offsets[lo]), int(self.offsets[hi])
        n, k, length = stop - base, params.gram, params.length
        none = tuple(np.zeros(0, x) for x in (np.int64, np.int64, np.uint64, np.uint64, np.uint32, np.uint32))
        if n < length:
            return none
        data = self.data[base : stop + 8]
        wide = np.ndarray((n + 1,), "<u8", data, strides=(1,)).copy()
        m = n - k + 1
        h = mix(wide[:m] * _A ^ (wide[8 : m + 8] * _B >> np.uint64(7)) ^ wide[k - 8 : m + k - 8] * _C)
        anchor = sliding_argmin(h, length - k + 1)
        ok = np.ones(n - length + 1, bool)
        border = self.offsets[lo + 1 : hi] - base
        fence = np.zeros(n + 2, np.int32)  # starts from border - length + 1 to border - 1 cross a border
        np.add.at(fence, np.maximum(border - length + 1, 0), 1)
        np.subtract.at(fence, border, 1)
        ok &= np.cumsum(fence[: n - length + 1]) == 0
        p = np.flatnonzero(ok)
        if not len(p):
            return none
        a = anchor[p]
        new = np.ones(len(p), bool)
        new[1:] = a[1:] != a[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(p)) - 1
        begin, end, at = p[first], p[last], a[first]
        plain, placed = np.zeros(m + 1, np.uint64), np.zeros(m + 1, np.uint64)
        np.cumsum(h, out=plain[1:])
        np.cumsum(h * np.arange(m, dtype=np.uint64), out=placed[1:])

        def ranged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """Hash of the bytes from x to y (k or more)."""
            s, e = np.minimum(x, m), np.clip(y - k + 1, 0, m)
            total = plain[e] - plain[s]
            return mix(total ^ mix(placed[e] - placed[s] - total * s.astype(np.uint64) + (y - x).astype(np.uint64)))

        half = -(-(length - k) // 2)
        left = ranged(np.maximum(at - half, 0), at).astype(np.uint32) | np.uint32(1)
        right = ranged(at + k, at + k + half).astype(np.uint32) | np.uint32(1)
        left[at - half < begin] = 0
        right[at + k + half > end + length] = 0
        # The smallest of many hashes is small: mixed again, so that slices of the key space are even.
        return begin + base, end + base, mix(h[at] + _B), ranged(begin, end + length), left, right


class Shard:
    """The contexts of a shard in the order of their arrival, on disk: texts back to back, and of each its block, place and number of starts."""

    def __init__(self, space: Space, length: int):
        self.space, self.length, self.n, self.n_starts = space, length, 0, 0
        self.paths = {k: space.path() for k in ("text", "block", "place", "starts")}
        self.files = {k: p.open("wb") for k, p in self.paths.items()}

    def add(self, block: int, head: bytes, text: bytes) -> tuple[int, int]:
        """Where the starts of a message begin, and their number."""
        place, starts = np.frombuffer(head, np.int64).reshape(2, -1)
        for k, x in (("text", text), ("block", np.full(len(place), block, np.int32)), ("place", place), ("starts", starts)):
            self.files[k].write(x if k == "text" else np.ascontiguousarray(x).tobytes())
        at, own = self.n_starts, int(starts.sum())
        self.n, self.n_starts = self.n + len(place), self.n_starts + own
        return at, own

    def close(self) -> tuple[np.ndarray, ...]:
        for f in self.files.values():
            f.close()
        kinds = {"text": np.uint8, "block": np.int32, "place": np.int64, "starts": np.int64}
        out = tuple(np.memmap(p, kinds[k], "r") if p.stat().st_size else np.zeros(0, kinds[k]) for k, p in self.paths.items())
        for p in self.paths.values():
            p.unlink()
        return out


def group_repeats(shard: Shard) -> np.ndarray:
    """For every window start of a shard's contexts, in their order: whether its window has an earlier equal."""
    text, blocks, places, starts = shard.close()
    space, length, n = shard.space, shard.length, shard.n
    borders, first_start = space.array(n + 1, np.int64), space.array(n + 1, np.int64)
    for lo, hi in space.blocks(n):
        borders[lo + 1 : hi + 1] = borders[lo] + np.cumsum(starts[lo:hi] + length)
        first_start[lo + 1 : hi + 1] = first_start[lo] + np.cumsum(starts[lo:hi])
    t = space.text(int(borders[-1]) + 1, np.uint8)
    per = max(1, space.block // (2 * length))  # contexts of one step
    for lo in range(0, n, per):
        hi = min(n, lo + per)
        a, e = int(borders[lo]), int(borders[hi])
        part = np.ones(e - a, np.uint8)
        inside = np.ones(e - a, bool)
        inside[borders[lo + 1 : hi + 1] - 1 - a] = False
        part[inside] = text[a - lo : e - hi] + np.uint8(2)  # UTF-8 has no byte over 0xF4
        t[a:e] = part
    array, lcp = sorted_suffixes(t, length, space)
    out = space.array(int(first_start[-1]), bool)
    total = int(borders[-1])

    def members(lo: int, hi: int) -> tuple[np.ndarray, ...]:
        """Of a piece of the order, what starts a window: run, block, place, number of the start."""
        at = array[lo:hi].astype(np.int64)
        run = np.cumsum(lcp[lo:hi] < length)
        own = np.searchsorted(borders, at, "right") - 1
        own[own == n] = 0
        offset = at - borders[own]
        good = (at < total) & (offset < starts[own])
        own, offset = own[good], offset[good]
        return run[good], blocks[own], places[own] + offset, first_start[own] + offset

    lo, size = 0, len(array)
    while lo < size:
        hi = min(size, lo + space.block)
        cut = np.flatnonzero(lcp[lo + 1 : hi] < length) if hi < size and lcp[hi] >= length else None
        if cut is None or len(cut):
            hi = hi if cut is None else lo + 1 + int(cut[-1])
            r, b, p, k = members(lo, hi)
            order = np.lexsort((p, b, r))
            r, b, p, k = r[order], b[order], p[order], k[order]
            new = np.ones(len(r), bool)
            new[1:] = r[1:] != r[:-1]
            head = np.flatnonzero(new)
            each = np.diff(np.append(head, len(r)))
            out[k] = (b != np.repeat(b[head], each)) | (p != np.repeat(p[head], each))
        else:  # one run that is larger than a step: its earliest member first, then its marks
            while hi < size and lcp[hi] >= length:
                more = np.flatnonzero(lcp[hi : hi + space.block] < length)
                hi = hi + int(more[0]) if len(more) else min(size, hi + space.block)
            pieces = [(a, min(hi, a + space.block)) for a in range(lo, hi, space.block)]
            least = min((int(b[i]), int(p[i])) for a, e in pieces for _, b, p, _ in [members(a, e)] if len(b) for i in [np.lexsort((p, b))[0]])
            for a, e in pieces:
                _, b, p, k = members(a, e)
                out[k] = (b != least[0]) | (p != least[1])
        lo = hi
    return out


def repeated_substrings(docs: DataFrame, text: str = "text", doc: str = "doc_id", params: SuffixParams = SuffixParams(), fan: int = B.FAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every input row."""
    layout = B.blocks(docs, text, doc, per_partition=3, fan=fan)
    base, n, to_slices, to_blocks = layout.rows, layout.slices, layout.to_slices, layout.to_blocks
    to_shards = B.Route(0, n * params.shards, fan)
    bits = min(64, 34 + n.bit_length())

    def pairs(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        c = Contexts(*B.opened(table), params, bits)
        anchor, context = c.anchor[c.head], c.context[c.head]
        edges = B.cuts(anchor, bits, n)
        left, right = c.left[c.head], c.right[c.head]
        side = lambda lo, hi: B.joined(context[lo:hi].tobytes(), left[lo:hi].tobytes(), right[lo:hi].tobytes())
        return to_slices.send([(s, block, PAIRS, hi - lo, B.pack(anchor[lo:hi]), side(lo, hi)) for s, lo, hi in B.parts(edges, len(anchor)) if hi > lo], block)

    def compare(table: pa.Table) -> pa.Table:
        rows = B.read(table)
        parts = [(B.unpack(r[4]), *(np.frombuffer(x, k) for x, k in zip(B.apart(r[5]), (np.uint64, np.uint32, np.uint32), strict=True))) for r in rows]
        anchor, context, left, right = (np.concatenate([x[k] for x in parts]) for k in range(4))
        order = np.lexsort((context, anchor))  # stable, and rows come by block
        a, c = anchor[order], context[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        first, text_too = np.zeros(len(a), bool), np.zeros(len(a), bool)
        first[order] = new
        each = order[new]  # one entry for each distinct context
        for side in (left, right):
            known = each[side[each] > 0]
            known = known[np.lexsort((side[known], anchor[known]))]
            same = (anchor[known][1:] == anchor[known][:-1]) & (side[known][1:] == side[known][:-1])
            text_too[known[1:][same]] = True
            text_too[known[:-1][same]] = True
        out, at = [], 0
        for r, (x, *_) in zip(rows, parts, strict=True):
            out.append((r[0], r[1], ANSWER, len(x), B.bits(text_too[at : at + len(x)]), B.bits(first[at : at + len(x)])))
            at += len(x)
        return to_blocks.send(out, rows[0][0])

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return B.messages([])
        block = left["block"][0].as_py()
        c = Contexts(*B.opened(left), params, bits)
        rows = B.read(right)
        wanted, first = (np.concatenate([B.unbits(r[k], r[3]) for r in rows] or [np.zeros(0, bool)]) for k in (4, 5))
        # For the last round: the runs that repeat as a whole, and the runs that the sort decides.
        size = c.end - c.begin + 1
        whole = ~c.lead | ~first[c.entry]
        part = c.lead & wanted[c.entry]
        answer = np.zeros(len(wanted), np.int64)
        answer[wanted] = np.cumsum(size[c.head[wanted]]) - size[c.head[wanted]]
        runs = B.joined(B.pack(c.begin[part]), B.pack_counts(size[part]), answer[c.entry[part]].astype(np.uint32).tobytes())
        out = [(-1 - block, block, CHOSEN, int(whole.sum()), B.joined(B.pack(c.begin[whole]), B.pack_counts(size[whole])), runs)]
        own = c.head[wanted]
        for s, lo, hi in B.parts(B.cuts(c.anchor[own], bits, n * params.shards), len(own)):
            if hi > lo:
                mine = own[lo:hi]
                raw = b"".join([c.data[a:e].tobytes() for a, e in zip(c.begin[mine].tolist(), (c.end[mine] + params.length).tolist(), strict=True)])
                head = c.place[mine].tobytes() + (c.end[mine] - c.begin[mine] + 1).astype(np.int64).tobytes()
                out.append((s, block, TEXTS, hi - lo, head, raw))
        return to_shards.send(out, block)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, space = scratch(params.memory)
        shard, parts = Shard(space, params.length), []
        own = None
        with folder:
            for batch in batches:
                for r in B.each(batch):
                    if r[2] == CHOSEN:
                        yield from to_blocks.send([r], r[0]).to_batches()
                    else:
                        own = r[0]
                        parts.append((r[1], *shard.add(r[1], r[4], r[5])))
            if own is not None:
                later = group_repeats(shard)
                out = [(own, block, MARKS, size, B.bits(later[at : at + size]), None) for block, at, size in parts]
                yield from to_blocks.send(out, own).to_batches()
        B.trim()

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        table, batch = B.opened(left)
        out: dict[str, list] = {"doc_id": table["doc_id"].to_pylist(), "n_bytes": np.diff(batch.offsets).tolist(), "n_removed": [], "n_spans": [], "kept_sha256": []}
        if len(table):
            rows = B.read(right)
            chosen = next((r for r in rows if r[2] == CHOSEN), None)
            marks = np.concatenate([B.unbits(r[4], r[3]) for r in rows if r[2] == MARKS] or [np.zeros(0, bool)])
            state = np.zeros(batch.size + 1, np.int32)
            if chosen:
                begin, size = (f(x).astype(np.int64) for f, x in zip((B.unpack, B.unpack_counts), B.apart(chosen[4]), strict=True))
                np.add.at(state, begin, 1)
                np.subtract.at(state, begin + size - 1 + params.length, 1)
                runs = B.apart(chosen[5])
                begin, size = B.unpack(runs[0]).astype(np.int64), B.unpack_counts(runs[1]).astype(np.int64)
                answer = np.frombuffer(runs[2], np.uint32).astype(np.int64)
                each = np.repeat(np.arange(len(begin)), size)
                step = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
                start = (begin[each] + step)[marks[answer[each] + step]] if len(each) else each
                np.add.at(state, start, 1)
                np.subtract.at(state, start + params.length, 1)
            gone = np.cumsum(state[:-1]) > 0
            edge = batch.offsets.tolist()
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                mask = gone[lo:hi]
                cut = int(np.count_nonzero(mask))
                out["n_removed"].append(cut)
                out["n_spans"].append(int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(mask[0]) if cut else 0)
                kept = batch.data[lo:hi][~mask] if cut else batch.data[lo:hi]
                out["kept_sha256"].append(hashlib.sha256(kept.tobytes()).hexdigest())
        return pa.table(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    sent = to_slices.delivered(base.groupBy("block").applyInArrow(B.lean(pairs), B.MESSAGE))
    compared = to_blocks.delivered(sent.groupBy("slice").applyInArrow(B.lean(compare), B.MESSAGE))
    asked = to_shards.delivered(base.groupBy("block").cogroup(compared.groupBy("block")).applyInArrow(B.lean(contexts), B.MESSAGE))
    marked = to_blocks.delivered(asked.groupBy("slice").applyInArrow(sort, B.MESSAGE))
    return base.groupBy("block").cogroup(marked.groupBy("block")).applyInArrow(B.lean(removed), OUT)
