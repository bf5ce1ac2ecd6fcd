"""External induced suffix sorting with common prefixes.

A suffix array by induction: the leftmost S-type suffixes are sorted first (by inducing their
substrings, naming them and recursing on the names), then all L-type suffixes are induced from them in
ascending order and all S-type suffixes from those in descending order.  Both passes run on a
monotone priority queue of tuples (symbol, place, common prefix with the tuple before it in its
bucket).  The queue works in bulk: it hands out the longest run of smallest tuples that cannot induce
a tuple before one of their own number, so a step is a few array operations.

What grows with the text lives on disk once it passes a share of the memory: the text itself, suffix types, places
of the leftmost S-type suffixes, names, the outputs of both passes and the result are memory-mapped files
(``Space``; their pages are the system's to drop), and the queue moves ranges of keys to files (``BulkQueue``).  A range too
large to load is dealt to a queue of its own with finer ranges; one key's tuples are read in pieces, as they
are in order already.  All loops go block by block, so the memory a sort holds is set by ``memory``, not by the
text.  A string of names of at most ``short`` symbols ends the recursion.

An induced suffix is its symbol and then its inducer, so its common prefix with the one induced
before it into the same bucket is one more than the least common prefix among the inducers between.
Those minima are carried along per symbol.  Where the L and S parts of a bucket meet, and for
the sorted leftmost S-type suffixes, prefixes are compared directly, up to the cap.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np

from weftline.llm._tokens import hash_ranges


class Space:
    """Arrays of one sort: in memory where small, else memory-mapped files without a name, which go with the array."""

    def __init__(self, folder: str | None, memory: int):
        self.folder, self.memory, self.files = folder, memory, 0
        self.block = max(1 << 12, min(1 << 20, memory // 64))  # elements of one step of a loop

    def path(self) -> Path:
        self.files += 1
        return Path(self.folder, f"part-{self.files}")

    def array(self, n: int, kind: type) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if self.folder is None or size * 16 <= self.memory or not n:
            return np.zeros(n, kind)
        path = self.path()
        out = np.memmap(path, kind, "w+", shape=n)
        os.unlink(path)
        return out

    def text(self, n: int, kind: type) -> np.ndarray:
        """An array with eight zero bytes behind it, as hashing needs."""
        return self.array(n * np.dtype(kind).itemsize + 8, np.uint8)[:-8].view(kind)

    def blocks(self, n: int) -> Iterator[tuple[int, int]]:
        for lo in range(0, n, self.block):
            yield lo, min(n, lo + self.block)


def padded_bytes(t: np.ndarray) -> np.ndarray:
    """The bytes of a ``Space.text`` with those behind it."""
    whole = t
    while isinstance(whole.base, np.ndarray):
        whole = whole.base
    return whole.view(np.uint8)


class BulkQueue:
    """Priority queue of (key, place, prefix) in order of key, then arrival; keys pushed are never below those taken.

    Keys from ``low`` to ``high`` are cut into ranges; all but the one being read are held as arrays in order of
    arrival and moved to files when they pass ``memory`` bytes.
    """

    def __init__(self, low: int, high: int, space: Space, memory: int, kind: type, ranges: int = 256):
        self.low, self.high, self.space, self.memory, self.kind = low, high, space, memory, kind
        self.width = -(-(high - low) // ranges)
        self.held: list[list] = [[] for _ in range(-(-(high - low) // self.width))]
        self.files: list[list | None] = [None] * len(self.held)
        self.record = np.dtype([("k", kind), ("p", kind), ("x", np.uint8)])
        self.now, self.at, self.bytes = -1, 0, 0
        self.own = np.zeros(len(self.held), np.int64)  # bytes in memory by range
        self.most = max(1 << 12, memory // 64)  # tuples that are loaded at once
        self.inner: BulkQueue | None = None
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_pending = 0
        self.key, self.place, self.prefix = self._none()

    def _none(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(0, self.kind), np.zeros(0, self.kind), np.zeros(0, np.uint8)

    def push(self, key: np.ndarray, place: np.ndarray, prefix: np.ndarray) -> None:
        if not len(key):
            return
        if self.now >= 0 and (self.inner or self.width > 1):  # what belongs to the range being read
            here = key < self.low + (self.now + 1) * self.width
            if here.any():
                item = (key[here], place[here], prefix[here])
                if self.inner:
                    self.inner.push(*item)
                else:
                    left = [(self.key[self.at :], self.place[self.at :], self.prefix[self.at :])] if self.at < len(self.key) else []
                    self._sort([*left, item])
                key, place, prefix = key[~here], place[~here], prefix[~here]
                if not len(key):
                    return
        self.pending.append((key, place, prefix))
        self.n_pending += len(key)
        if self.n_pending >= self.most:
            self._deal()

    def _deal(self) -> None:
        """What was pushed since the last time goes to its ranges, in order of arrival."""
        if not self.pending:
            return
        key, place, prefix = (np.concatenate(c) for c in zip(*self.pending, strict=True)) if len(self.pending) > 1 else self.pending[0]
        self.pending, self.n_pending = [], 0
        group = (key - self.low) // self.width
        if len(key) > 1 and (group[1:] < group[:-1]).any():
            order = np.argsort(group, kind="stable")
            group, key, place, prefix = group[order], key[order], place[order], prefix[order]
        edge = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            g = int(group[lo])
            self.held[g].append((key[lo:hi].copy(), place[lo:hi].copy(), prefix[lo:hi].copy()))
            self.bytes += self._size(hi - lo)
            self.own[g] += self._size(hi - lo)
        if self.bytes > self.memory and self.space.folder:
            self._spill()

    def _size(self, n: int) -> int:
        return (2 * np.dtype(self.kind).itemsize + 1) * n

    def _spill(self) -> None:
        """Move the largest ranges to their files until half the memory is free again."""
        for g in np.argsort(-self.own, kind="stable").tolist():
            if self.bytes <= self.memory // 2:
                break
            n = sum(len(x[0]) for x in self.held[g])
            records = np.empty(n, self.record)
            for name, column in zip("kpx", zip(*self.held[g], strict=True), strict=True):
                np.concatenate(column, out=records[name])
            file = self.files[g] = self.files[g] or [self.space.path(), 0, 0]
            with file[0].open("ab") as f:
                records.tofile(f)
            file[1] += n
            self._forget(g, n)
            self.held[g] = []

    def _forget(self, g: int, n: int) -> None:
        self.bytes -= self._size(n)
        self.own[g] -= self._size(n)

    def _waiting(self, g: int) -> int:
        """Tuples of a range that are not loaded."""
        return sum(len(x[0]) for x in self.held[g]) + (self.files[g][1] - self.files[g][2] if self.files[g] else 0)

    def _next(self, g: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The next tuples of a range in order of arrival: its file (path, number, taken) comes before what is in memory."""
        file = self.files[g]
        if file:
            m = min(most, file[1] - file[2])
            records = np.fromfile(file[0], self.record, m, offset=file[2] * self.record.itemsize)
            file[2] += m
            if file[2] == file[1]:
                file[0].unlink()
                self.files[g] = None
            return tuple(records[x].copy() for x in "kpx")
        taken = n = 0
        while taken < len(self.held[g]) and n < most:
            n += len(self.held[g][taken][0])
            taken += 1
        own, self.held[g] = self.held[g][:taken], self.held[g][taken:]
        self._forget(g, n)
        return tuple(np.concatenate(c) for c in zip(*own, strict=True))

    def _sort(self, items: list) -> None:
        key, place, prefix = (np.concatenate(c) for c in zip(*items, strict=True)) if len(items) > 1 else items[0]
        order = np.argsort(key, kind="stable")
        self.key, self.place, self.prefix, self.at = key[order], place[order], prefix[order], 0

    def _open(self) -> None:
        """Load the next range, or more of the current one, or hand it to a queue with finer ranges."""
        n = self._waiting(self.now)
        if not n:
            return
        if self.width == 1:  # one key: in order already
            self.key, self.place, self.prefix = self._next(self.now, self.most)
            self.at = 0
        elif n > self.most and self.space.folder:
            low = self.low + self.now * self.width
            inner = BulkQueue(low, min(self.high, low + self.width), self.space, self.memory // 2, self.kind, min(256, max(2, 4 * n // self.most)))
            while self._waiting(self.now):
                inner.push(*self._next(self.now, self.most))
            self.inner = inner
        else:
            pieces = []
            while self._waiting(self.now):
                pieces.append(self._next(self.now, n))
            self._sort(pieces)

    def peek(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        while True:
            if self.inner:
                found = self.inner.peek(most)
                if len(found[0]):
                    return found
                self.inner = None
                self.key, self.place, self.prefix = self._none()
                self.at = 0
            if self.at < len(self.key):
                to = self.at + most
                return self.key[self.at : to], self.place[self.at : to], self.prefix[self.at : to]
            self._deal()
            if self.now >= 0 and self._waiting(self.now):
                self._open()
            elif self.now + 1 < len(self.held):
                self.now += 1
                self._open()
            else:
                return self._none()

    def take(self, n: int) -> None:
        if self.inner:
            self.inner.take(n)
        else:
            self.at += n


def _integer(n: int) -> type:
    """The integer type for places and keys of a text of n symbols."""
    return np.int32 if n < 1 << 29 else np.int64


def suffix_types(t: np.ndarray, space: Space) -> np.ndarray:
    """True for S-type suffixes; the last symbol is the smallest and S-type."""
    n = len(t)
    small = space.array(n, bool)
    small[-1] = True
    for lo in range((n - 2) // space.block * space.block, -1, -space.block) if n > 1 else ():
        hi = min(n - 1, lo + space.block)
        part = t[lo : hi + 1]
        m = len(part)
        other = np.full(m, m, np.int64)  # next place with another symbol
        np.copyto(other[:-1], np.arange(1, m), where=part[:-1] != part[1:])
        np.minimum.accumulate(other[::-1], out=other[::-1])
        rises = part[np.minimum(other, m - 1)] > part
        small[lo:hi] = np.where(other < m, rises, small[hi])[:-1]
    return small


def leads(small: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether places are leftmost S-type."""
    return small[at] & (at > 0) & ~small[np.maximum(at - 1, 0)]


def direct_prefix(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix lengths of suffix pairs, at most ``cap``."""
    out = np.zeros(len(a), np.int64)
    todo = np.arange(len(a))
    if t.dtype == np.uint8 and len(t) >= 16:
        wide = np.ndarray((len(t) - 7,), "<u8", t, strides=(1,))
        for k in range(0, cap, 8):
            x, y = a[todo] + k, b[todo] + k
            fits = np.maximum(x, y) < len(wide)
            same = np.zeros(len(todo), bool)
            same[fits] = wide[x[fits]] == wide[y[fits]]
            out[todo[same]] = k + 8
            rest = todo[~same]
            for j in range(8):  # the step where they part
                x, y = a[rest] + k + j, b[rest] + k + j
                ok = np.maximum(x, y) < len(t)
                ok[ok] = t[x[ok]] == t[y[ok]]
                rest = rest[ok]
                out[rest] = k + j + 1
            todo = todo[same]
            if not len(todo):
                break
        return np.minimum(out, cap)
    for k in range(cap):
        x, y = a[todo] + k, b[todo] + k
        ok = np.maximum(x, y) < len(t)
        ok[ok] = t[x[ok]] == t[y[ok]]
        todo = todo[ok]
        out[todo] = k + 1
        if not len(todo):
            break
    return out


def _range_minima(v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(v[lo:hi]) for each pair; 255 where empty."""
    out = np.full(len(lo), 255, np.uint8)
    size = hi - lo
    level, table = 0, v
    top = int(size.max(initial=0))
    while (1 << level) <= top:
        mine = (size >> level) == 1
        if mine.any():
            out[mine] = np.minimum(table[lo[mine]], table[hi[mine] - (1 << level)])
        if len(table) > (1 << level):
            table = np.minimum(table[: -(1 << level)], table[1 << level :])
        level += 1
    return out


Tuples = Iterator[tuple[np.ndarray, np.ndarray]]


def _pass(t: np.ndarray, small: np.ndarray, falling: bool, seeds: Tuples, top: int, cap: int | None, space: Space) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Induce one type of suffixes from sorted seeds (places, prefixes) of the other: L-type in ascending order, S-type in
    ``falling`` order.

    Yields places, whether induced, and common prefix with the place before, in processing order.
    """
    kind = _integer(max(len(t), 2 * top + 2))
    none = np.iinfo(kind).max
    queue = BulkQueue(0, 2 * top + 2, space, max(1, space.memory // 4), kind)
    symbols = (lambda at: top - t[at].astype(kind)) if falling else lambda at: t[at].astype(kind)
    for place, prefix in seeds:
        queue.push(2 * symbols(place) + kind(1), place.astype(kind), prefix)
    del seeds
    since = np.full(top + 1 if cap is not None else 0, 255, np.uint8)
    last_key, last_place = -1, 0
    most, limit = 1 << 12, min(1 << 17, max(1 << 12, space.memory // 256))
    while True:
        key, place, prefix = queue.peek(most)
        if not len(key):
            break
        before = np.maximum(place - 1, 0)
        goes = (place > 0) & (small[before] == falling)
        target = symbols(before)
        new = np.where(goes, 2 * target, none)
        late = np.flatnonzero(key > np.minimum.accumulate(new))
        m = int(late[0]) if len(late) else len(key)
        queue.take(m)
        most = min(limit, max(1 << 12, 2 * m)) if m < len(key) else min(limit, 2 * most)
        key, place, prefix, goes, target, new = (x[:m] for x in (key, place, prefix, goes, target, new))
        carried = prefix
        if cap is not None:
            prior = np.concatenate([[last_key], key[:-1]])
            prior_place = np.concatenate([[last_place], place[:-1]])
            common = np.where(key == prior, prefix, 0).astype(np.uint8)
            seam = np.flatnonzero((key != prior) & (key >> 1 == prior >> 1))
            if len(seam):
                common[seam] = direct_prefix(t, place[seam], prior_place[seam], cap)
            carried = common
        last_key, last_place = int(key[-1]), int(place[-1])
        own = (key & 1) == 0
        i = np.flatnonzero(goes)
        lcp = np.zeros(len(i), np.uint8)
        if cap is not None:
            order = np.argsort(target[i], kind="stable")
            j, g = i[order], target[i][order]
            first = np.ones(len(j), bool)
            first[1:] = g[1:] != g[:-1]
            lo = np.zeros(len(j), np.int64)
            lo[1:] = j[:-1] + 1
            lo[first] = 0
            least = _range_minima(carried, lo, j + 1)
            least[first] = np.minimum(least[first], since[g[first]])
            lcp[order] = np.minimum(least.astype(np.int64) + 1, cap)
            since = np.minimum(since, carried.min())
            if len(j):
                final = np.ones(len(j), bool)
                final[:-1] = first[1:]
                since[g[final]] = _range_minima(carried, j[final] + 1, np.full(int(final.sum()), m))
        queue.push(new[i], place[i] - 1, lcp)
        yield place, own, carried


def _induced(t: np.ndarray, small: np.ndarray, n_large: int, seeds: Tuples, top: int, cap: int | None, space: Space) -> Tuples:
    """All suffixes but the last one from the sorted leftmost S-type ones, in falling order: places, and prefixes with the one before (the larger)."""
    kind = _integer(len(t))
    large, prefix, at = space.array(n_large, kind), space.array(n_large, np.uint8), 0
    for place, own, common in _pass(t, small, False, seeds, top, cap, space):
        m = int(np.count_nonzero(own))
        large[at : at + m], prefix[at : at + m] = place[own], common[own]
        at += m

    def down() -> Tuples:
        """L-type places in falling order; a place's prefix is with the larger one: that one's prefix with what is before it."""
        for hi in range(n_large, 0, -space.block):
            lo = max(0, hi - space.block)
            with_larger = np.zeros(hi - lo, np.uint8)
            upto = min(n_large, hi + 1)
            with_larger[: upto - lo - 1] = prefix[lo + 1 : upto]
            yield large[lo:hi][::-1], with_larger[::-1]

    for place, _, common in _pass(t, small, True, down(), top, cap, space):
        yield place, common


def _doubled(t: np.ndarray) -> np.ndarray:
    """Suffix order of a short string by rank doubling: the end of the recursion."""
    n = len(t)
    rank, step = t.astype(np.int64), 1
    while True:
        ahead = np.zeros(n, np.int64)
        if step < n:
            ahead[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + ahead
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if int(rank[order[-1]]) == n - 1:
            return order
        step *= 2


def _lead_order(t: np.ndarray, small: np.ndarray, lead: np.ndarray, n_large: int, top: int, space: Space, short: int) -> np.ndarray:
    """The order of the leftmost S-type suffixes as numbers into ``lead``."""
    kind, n = _integer(len(t)), len(lead)
    seeds = ((lead[lo:hi], np.zeros(hi - lo, np.uint8)) for lo, hi in space.blocks(n))
    ordered, at = space.array(n, kind), n  # by the substrings up to the next leftmost S-type place
    for place, _ in _induced(t, small, n_large, seeds, top, None, space):
        mine = place[leads(small, place)]
        ordered[at - len(mine) : at] = mine[::-1]
        at -= len(mine)
    ordered[0] = len(t) - 1  # the last symbol is one of them and the smallest
    names, raw, size = space.text(n, kind), padded_bytes(t), t.itemsize
    name, last = 0, None
    for lo, hi in space.blocks(n):
        place = ordered[lo:hi].astype(np.int64)
        rank = np.searchsorted(lead, ordered[lo:hi])  # of one type: another would be converted as a whole
        stop = np.where(rank + 1 < n, lead[np.minimum(rank + 1, n - 1)], len(t) - 1).astype(np.int64) + 1
        h = [hash_ranges(raw, place * size, stop * size, seed) for seed in (1, 2)]
        new = np.ones(hi - lo, bool)
        new[1:] = (h[0][1:] != h[0][:-1]) | (h[1][1:] != h[1][:-1])
        new[0] = last is not None and last != (int(h[0][0]), int(h[1][0]))
        last = int(h[0][-1]), int(h[1][-1])
        number = name + np.cumsum(new)
        names[rank] = number
        name = int(number[-1])
    del ordered
    if name + 1 == n:
        order = space.array(n, kind)
        for lo, hi in space.blocks(n):
            order[names[lo:hi]] = np.arange(lo, hi, dtype=kind)
        return order
    if n <= short:
        return _doubled(names)
    return _sorted(names, None, space, short)[0]


def _sorted(t: np.ndarray, cap: int | None, space: Space, short: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefixes) of a ``Space.text`` that ends with its only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.uint8)
    small = suffix_types(t, space)
    top = n_large = n_lead = 0
    for lo, hi in space.blocks(n):
        top, n_large = max(top, int(t[lo:hi].max())), n_large + int(np.count_nonzero(~small[lo:hi]))
        n_lead += int(np.count_nonzero(leads(small, np.arange(lo, hi))))
    kind = _integer(n)
    lead, at = space.array(n_lead, kind), 0
    for lo, hi in space.blocks(n):
        mine = lo + np.flatnonzero(leads(small, np.arange(lo, hi)))
        lead[at : at + len(mine)] = mine
        at += len(mine)
    order = _lead_order(t, small, lead, n_large, top, space, short)

    def seeds() -> Tuples:
        for lo, hi in space.blocks(n_lead):
            place = lead[order[max(0, lo - 1) : hi]]
            prefix = np.zeros(hi - lo, np.uint8)
            if cap is not None and len(place) > 1:
                prefix[-(len(place) - 1) :] = direct_prefix(t, place[1:], place[:-1], cap)
            yield place[-(hi - lo) :], prefix

    array, lcp, at = space.array(n, kind), space.array(n if cap is not None else 0, np.uint8), n
    array[0] = n - 1
    for place, common in _induced(t, small, n_large, seeds(), top, cap, space):
        m = len(place)
        array[at - m : at] = place[::-1]
        if cap is not None:  # a suffix's prefix is with the larger one behind it in the array
            skip = 1 if at == n else 0
            lcp[at - m + 1 : at + 1 - skip] = common[::-1][: m - skip]
        at -= m
    if cap is not None:
        lcp[: min(2, n)] = 0
    return array, lcp


def suffix_array(t: np.ndarray, cap: int | None = None, memory: int = 256 << 20, folder: str | None = None, short: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefixes up to ``cap``) of a text that ends with its only 0.

    ``cap`` is at most 250; None sorts without prefixes.  A string of names of up to ``short`` symbols is
    sorted in memory, a longer one by recursion.  With a ``folder`` all that grows with the text is kept there.
    """
    space = Space(folder, memory)
    held = space.text(len(t), t.dtype)
    for lo, hi in space.blocks(len(t)):
        held[lo:hi] = t[lo:hi]
    return _sorted(held, cap, space, short)


def sorted_suffixes(t: np.ndarray, cap: int, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """``suffix_array`` of a text made by ``space.text``; the recursion's end is bound by the space's memory."""
    return _sorted(t, cap, space, max(1 << 12, min(1 << 19, space.memory // 64)))


def scratch(memory: int) -> tuple[tempfile.TemporaryDirectory, Space]:
    """A temporary folder of this task and a space in it."""
    folder = tempfile.TemporaryDirectory(prefix="weftline-sa-")
    return folder, Space(folder.name, memory)
