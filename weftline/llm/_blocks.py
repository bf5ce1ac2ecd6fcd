"""Blocks and slices: whole-corpus grouping of packed keys without a row per key.

A *block* is a contiguous range of document ids; its texts meet in one task.  A *slice* is a share of
a key space (windows, anchors, n-grams).  Each block sends each slice one packed array of its own
distinct keys, sorted; the slice merges the arrays of all blocks and answers each block in the order
of its keys, so answers need no keys and a key shared by a third of all documents costs a slice one
entry per block.  Since blocks are ranges, "occurs earlier" between blocks is a smaller block number.

What a sender has for a group is one compressed bundle.  Every hop writes all messages to disk once more, so they go directly
as long as a block has ``MESSAGE_BYTES`` of text for each group.  Beyond, blocks times slices would grow with the square of
the input.  So a ``Route`` to more than ``fan`` groups
goes in hops: a sender packs what it has into at most ``fan`` bundles, one for each range of groups; ``fan``
senders' bundles for one range meet and are packed again for its parts, until a range is one group.  Every
hop moves at most ``fan`` rows for each sender, so rows grow with the input (times the number of hops).
Nothing is sent where there is nothing to say; what every group must know is added up on the way.

The texts are shuffled once, by block; a block's tasks read that shuffle again (Spark reuses the
exchange) and put the rows in the same order each time, so positions agree between rounds.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._common import partitions
from weftline.llm._tokens import Batch, texts

LAST = (1 << 63) - 1
MESSAGE = "slice int, block int, kind int, n long, a binary, b binary"
_ARROW = pa.schema([("slice", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


BUNDLE, TOTAL = -1, -2  # kinds: several messages as one; figures for every group, added up on the way
FAN = 256
COARSE = 4096
SLICE_BYTES = 24 << 20  # of text for each slice at most, on the average
MESSAGE_BYTES = 1 << 10  # of a block's text for each group at least, on the average, where messages go directly


@dataclass(frozen=True)
class Layout:
    """The blocked texts (block, doc_id, text), the number of slices, and the ways to slices and to blocks."""

    rows: DataFrame
    slices: int
    to_slices: Route
    to_blocks: Route


def blocks(docs: DataFrame, text: str = "text", doc: str = "doc_id", per_partition: int = 2, fan: int = FAN, slices: int = 0, slice_bytes: int = SLICE_BYTES) -> Layout:
    """Documents in blocks of about equally many rows; ``slices`` is the number of shuffle partitions unless given, more if
    the texts have over ``slice_bytes`` for each: what a task holds follows neither the input nor a session's settings.

    A null id sorts after all others.  Rows of one id always share a block.  Quantiles are taken for COARSE
    borders at most; beyond, each range between two of them is cut evenly by id.  ``fan`` is raised to what blocks of this size can send directly.
    """
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(docs.sparkSession), -(-size // slice_bytes))
    key = F.coalesce(F.col("doc_id"), F.lit(LAST)).cast("double").alias("_key")
    total = n * per_partition
    coarse = min(total, COARSE)
    known = rows.select(F.col("doc_id").cast("double").alias("_key"))  # null ids have no part in the quantiles
    least, *found, most = known.stat.approxQuantile("_key", [i / coarse for i in range(coarse + 1)], 0.1 / coarse) or [0.0, 0.0]
    cuts = sorted(set(found))
    cut = Bucketizer(splits=[-float("inf"), *cuts, float("inf")] if cuts else [-float("inf"), 0.0, float("inf")], inputCol="_key", outputCol="_block")
    rows = cut.transform(rows.select("doc_id", "text", key))
    each = -(-total // coarse)
    block = F.col("_block").cast("int")
    if each > 1 and cuts:
        edges = F.array(*[F.lit(c) for c in [least, *cuts, most]])
        low, high = F.get(edges, block), F.get(edges, block + 1)
        inside = F.when(high > low, F.floor((F.col("_key") - low) / (high - low) * each)).otherwise(0)
        block = block * each + F.greatest(F.lit(0), F.least(inside, F.lit(each - 1))).cast("int")
    rows = rows.select(block.cast("int").alias("block"), "doc_id", "text")
    n = slices or n
    fan = max(fan, size // total // MESSAGE_BYTES)
    return Layout(rows, n, Route(0, n, fan), Route(1, (len(cuts) + 1 if cuts else 2) * each, fan))


def opened(table: pa.Table) -> tuple[pa.Table, Batch]:
    """A block's rows in their fixed order (id, then text; null ids last), and their bytes."""
    table = table.select(["doc_id", "text"])
    if len(table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return table, texts(table["text"])


def lean(function: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``function`` of one or two groups, giving freed memory back to the system after each call.

    A worker serves many groups of changing size; what its allocators keep would add up beside the
    executor's heap.
    """

    def one(table: pa.Table) -> pa.Table:
        out = function(table)
        trim()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = function(left, right)
        trim()
        return out

    return two if len(inspect.signature(function).parameters) == 2 else one


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        return


def messages(rows: Iterable[tuple]) -> pa.Table:
    rows = list(rows)
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def _bundle(rows: list[tuple]) -> bytes:
    head = np.array([(*r[:4], *(-1 if x is None else len(x) for x in r[4:6])) for r in rows], np.int64)
    data = b"".join([np.int64(len(rows)).tobytes(), head.tobytes(), *[x for r in rows for x in r[4:6] if x is not None]])
    return np.int64(len(data)).tobytes() + pa.compress(data, "zstd", asbytes=True)


def _opened(data: bytes) -> Iterator[tuple]:
    data = pa.decompress(memoryview(data)[8:], int(np.frombuffer(data, np.int64, 1)[0]), "zstd", asbytes=True)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    at = 8 + 48 * n
    for row in np.frombuffer(data, np.int64, 6 * n, 8).reshape(n, 6).tolist():
        parts = []
        for size in row[4:]:
            parts.append(None if size < 0 else data[at : at + size])
            at += max(0, size)
        yield (*row[:4], *parts)


def each(table: pa.Table | pa.RecordBatch) -> Iterator[tuple]:
    """Messages as they come, bundles opened."""
    for i in range(len(table)):
        r = tuple(table[f.name][i].as_py() for f in _ARROW)
        yield from _opened(r[4]) if r[2] == BUNDLE else [r]


def read(table: pa.Table) -> list[tuple]:
    """A group's messages by block, then slice, kind; bundles opened."""
    return sorted(each(table), key=lambda r: (r[1], r[0], r[2]))


def totals(rows: list[tuple]) -> np.ndarray | None:
    """The sum of the figures that all senders addressed to every group."""
    found = [np.frombuffer(r[4], np.int64) for r in rows if r[2] == TOTAL]
    return np.sum(found, 0) if found else None


@dataclass(frozen=True)
class Route:
    """The way to ``total`` groups, numbered by field ``by`` of the messages (0: slice, 1: block).

    A message to a negative slice is for a group of its own and goes there directly.
    """

    by: int
    total: int
    fan: int = FAN

    def width(self) -> int:
        """Groups in one range of the first hop."""
        width = 1
        while width * self.fan < self.total:
            width *= self.fan
        return width

    def send(self, rows: Iterable[tuple], sender: int, figures: np.ndarray | None = None) -> pa.Table:
        """A sender's messages; ``figures`` go to every group."""
        return messages(self._packed(list(rows), figures, 0, self.total, self.width(), sender))

    def _packed(self, rows: list[tuple], figures: np.ndarray | None, low: int, high: int, width: int, sender: int) -> Iterator[tuple]:
        """Messages to groups ``low`` to ``high`` as bundles for ranges of ``width`` groups."""
        ranges: dict[int, list[tuple]] = {}
        for r in rows:
            if r[self.by] < 0:
                yield r
            else:
                ranges.setdefault(r[self.by] // width, []).append(r)
        for g in range(low // width, -(-min(high, self.total) // width)) if figures is not None else ():
            at = (g * width, sender) if self.by == 0 else (sender, g * width)
            ranges.setdefault(g, []).append((*at, TOTAL, 0, figures.astype(np.int64).tobytes(), None))
        for g, own in sorted(ranges.items()):
            at = (g, sender) if self.by == 0 else (sender, g)
            yield (*at, BUNDLE, len(own), _bundle(own), None)

    def _again(self, table: pa.Table, width: int) -> pa.Table:
        """What ``fan`` senders have for one range of ``width * fan`` groups, packed for ranges of ``width``."""
        key, other = ("slice", "block") if self.by == 0 else ("block", "slice")
        g, sender = table[key][0].as_py(), table[other][0].as_py() // self.fan
        if g < 0:
            return table.select(_ARROW.names)
        rows = read(table)
        low = g * width * self.fan
        return messages(self._packed([r for r in rows if r[2] != TOTAL], totals(rows), low, low + width * self.fan, width, sender))

    def delivered(self, df: DataFrame) -> DataFrame:
        """``df`` (MESSAGE rows of ``send``) after all hops, ready to be grouped by slice or block."""
        key, other = ("slice", "block") if self.by == 0 else ("block", "slice")
        width = self.width()
        while width > 1:
            width //= self.fan
            df = df.groupBy(key, F.floor(F.col(other) / self.fan).alias("_sender")).applyInArrow(lean(self._hop(width)), MESSAGE)
        return df

    def _hop(self, width: int) -> Callable[[pa.Table], pa.Table]:
        return lambda table: self._again(table, width)


def _lows(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _pack(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each value, and the rest of the few that are larger, by place."""
    shift = np.uint64(8 * width)
    high = np.flatnonzero(values >> shift).astype(np.uint32) if width < 8 else np.zeros(0, np.uint32)
    head = np.array([width, len(values), len(high)], np.int64)
    return b"".join((head.tobytes(), (values[high] >> shift).tobytes() if len(high) else b"", high.tobytes(), _lows(values, width)))


def pack(keys: np.ndarray) -> bytes:
    """Sorted unsigned keys as differences in as many bytes as nearly all of them need."""
    if not len(keys):
        return b""
    gap = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    width = 1
    while width < 8 and np.count_nonzero(gap >> np.uint64(8 * width)) * 12 > len(gap):
        width += 1
    return _pack(gap, width)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts in one byte each, the few larger ones apart."""
    return _pack(counts.astype(np.uint64), 1) if len(counts) else b""


def unpack_counts(data: bytes | None) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    width, n, m = np.frombuffer(data, np.int64, 3).tolist()
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(data, np.uint8, n * width, 24 + 12 * m).reshape(n, width)
    values = wide.view("<u8").ravel()
    if m:
        values[np.frombuffer(data, np.uint32, m, 24 + 8 * m)] += np.frombuffer(data, np.uint64, m, 24) << np.uint64(8 * width)
    return values


def unpack(data: bytes | None) -> np.ndarray:
    return np.cumsum(unpack_counts(data), dtype=np.uint64)


def joined(*arrays: bytes) -> bytes:
    """Several byte strings as one; ``apart`` is the inverse."""
    return np.array([len(arrays), *map(len, arrays)], np.int64).tobytes() + b"".join(arrays)


def apart(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    sizes = np.frombuffer(data, np.int64, n, 8).tolist()
    at, out = 8 + 8 * n, []
    for size in sizes:
        out.append(data[at : at + size])
        at += size
    return out


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes | None, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data or b"", np.uint8), count=n).astype(bool)


def cuts(sorted_keys: np.ndarray, shift: int, n: int) -> np.ndarray:
    """Borders of the n slices in sorted keys of ``shift`` + some bits: slice i is keys // ceil(2**bits / n)."""
    step = -(-(1 << shift) // n)
    return np.searchsorted(sorted_keys, np.array([min(i * step, (1 << shift) - 1) for i in range(1, n)], np.uint64)) if n > 1 else np.zeros(0, np.int64)


def parts(borders: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    edge = [0, *borders.tolist(), size]
    for i in range(len(edge) - 1):
        yield i, edge[i], edge[i + 1]
