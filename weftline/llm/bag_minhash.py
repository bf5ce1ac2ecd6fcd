"""Near-duplicates of word multisets: BagMinHash signatures, banding, exact verification.

A document is the multiset of its five-word windows.  The weight axis is cut at powers of two; on each
interval (2**(j-1), 2**j] every window has its own Poisson process whose rate is the interval's width.
Each point of a process has a time, a register and a level; it counts for a document when its level
lies below the window's count there.  A register keeps its earliest time, so two registers are equal
with the probability of the weighted Jaccard similarity.  A process is followed only while its next
point can still change a register, so a document costs a few points per window, not windows times
registers.

Equal texts are one class from the start (a map-side aggregate by text digest).  Classes that share
a band bucket are candidates, but no bucket emits its pairs:

Round 1 compares every member of a bucket with the bucket's leader, the class that meets the most
others in its buckets (in a group of edited copies, the one that was edited least).
Round 2 takes the buckets whose other members are still in different components.  Buckets that overlap form a
cluster; a cluster of ``block_bytes`` at most is one unit, in a larger one every bucket is a unit of its own.
Units are cut into blocks of ``block_bytes`` and all classes of two blocks are compared by a matrix product
inside the task, which returns one link per pair of components at most.
So every pair that shares a bucket is verified or already connected, the rows that move grow with members
times blocks, and a task holds two blocks.

Verification is exact: multisets of 64-bit window hashes, weighted Jaccard of ``threshold`` or more.

Cases: a text of one to four words is one window; texts without words are equal to one another; a
null text is empty; repeated rows are copies; a null id sorts last, so it represents a class only if all
its ids are null; of equal ids the text of the smallest digest represents; a very long text is one bag, of its
task; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm._common import staged, unused
from weftline.llm._components import components
from weftline.llm._tokens import Batch, hash_ranges, mix, slices, texts, window_hashes, words

_STEP = np.uint64(0xD1342543DE82EF95)


@dataclass(frozen=True)
class NearParams:
    width: int = 5
    threshold: float = 0.8
    rows: int = 5
    bands: int = 26
    block_bytes: int = 8 << 20
    broadcast_rows: int = 100_000  # large clusters up to so many are broadcast
    row_bytes: int = 2048  # counted for a class besides its bag: a block has 4,096 classes at most

    @property
    def registers(self) -> int:
        return self.rows * self.bands


def multisets(batch: Batch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, window hash, count) of every distinct window, by text, then hash."""
    w = words(batch)
    h = hash_ranges(batch.data, w.start, w.end)
    at, key = window_hashes(h, w.first, width)
    row = np.searchsorted(w.first, at, "right") - 1
    short = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < width))
    if len(short):  # one window of all words
        whole = [_fold(h[w.first[i] : w.first[i + 1]]) for i in short.tolist()]
        row, key = np.concatenate([row, short]), np.concatenate([key, np.array(whole, np.uint64)])
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    begin = np.flatnonzero(new)
    return row[begin], key[begin], np.diff(np.append(begin, len(row)))


def _fold(h: np.ndarray) -> np.uint64:
    acc = np.full(1, len(h), np.uint64)
    for x in h:
        acc = mix(acc * _STEP + x)
    return acc[0]


def signatures(row: np.ndarray, key: np.ndarray, count: np.ndarray, n: int, registers: int) -> np.ndarray:
    """(n, registers) earliest times; a text without windows keeps infinity."""
    # One process per window and level interval: interval 0 is (0, 1], interval j is (2**(j-1), 2**j].
    seeds, rates, covers, owners = [], [], [], []
    j, left = 0, np.arange(len(key))
    while len(left):
        low, high = (0 if j == 0 else 1 << (j - 1)), 1 << j
        seeds.append(mix(key[left] ^ np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)))
        rates.append(np.full(len(left), float(high - low)))
        covers.append(np.minimum(1.0, (count[left] - low) / (high - low)))
        owners.append(row[left])
        left = left[count[left] > high]
        j += 1
    if not seeds:
        return np.full((n, registers), np.inf)
    seed, rate, cover, owner = (np.concatenate(x) for x in (seeds, rates, covers, owners))
    best = np.full(n * registers, np.inf)
    time = np.zeros(len(seed))
    step = 0
    while len(seed):
        step += 1
        r = mix(seed + np.uint64(step * 0x9E3779B97F4A7C15 % 2**64))
        time = time - np.log((r >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate
        s = mix(r ^ _STEP)
        register = ((s >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        counts = (s & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < cover
        np.minimum.at(best, (owner * registers + register)[counts], time[counts])
        latest = best.reshape(n, registers).max(1)
        go = time < latest[owner]
        seed, rate, cover, owner, time = seed[go], rate[go], cover[go], owner[go], time[go]
    return best.reshape(n, registers)


def band_keys(best: np.ndarray, bands: int) -> np.ndarray:
    """(n, bands) bucket keys; texts without windows get the same key in each band."""
    n = len(best)
    bits = best.view(np.uint64).reshape(n, bands, -1)
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for k in range(bits.shape[2]):
        acc = mix(acc * _STEP + bits[:, :, k])
    return acc.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two (sorted hashes, counts)."""
    i = np.minimum(np.searchsorted(b[0], a[0]), max(len(b[0]) - 1, 0))
    hit = b[0][i] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    common = int(np.minimum(a[1][hit], b[1][i[hit]]).sum()) if hit.any() else 0
    whole = int(a[1].sum()) + int(b[1].sum()) - common
    return common / whole if whole else 1.0


def _load(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.uint32, n, 8 * n)


def _block_links(table: pa.Table, threshold: float) -> pa.Table:
    """Links between components among the classes of two blocks (or of one with itself).

    Windows count as units (window, 1st), (window, 2nd) ...; the sum of the smaller counts is then the
    product of 0/1 rows, taken over units that two classes or more hold.
    """
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    own = np.array(table["own"].to_pylist())
    keys, comps = table["key"].to_pylist(), table["comp"].to_pylist()
    bags = [_load(x) for x in table["bag"].to_pylist()]
    total = np.array([int(c.sum()) for _, c in bags])
    doc = np.repeat(np.arange(len(bags)), total)
    unit = [np.repeat(h, c) + (np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)).astype(np.uint64) * _STEP for h, c in bags]
    unit = np.concatenate(unit) if unit else np.zeros(0, np.uint64)
    _, column, times = np.unique(unit, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    doc, column = doc[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    common = np.zeros((len(left), len(right)), np.float32)
    place_l, place_r = np.full(len(bags), -1), np.full(len(bags), -1)
    place_l[left], place_r[right] = np.arange(len(left)), np.arange(len(right))
    wide = 2048
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, [lo, lo + wide])
        x, y = np.zeros((len(left), wide), np.float32), np.zeros((len(right), wide), np.float32)
        d, c = doc[a:b], column[a:b] - lo
        x[place_l[d[place_l[d] >= 0]], c[place_l[d] >= 0]] = 1
        y[place_r[d[place_r[d] >= 0]], c[place_r[d] >= 0]] = 1
        common += x @ y.T
    whole = total[left][:, None] + total[right][None] - common
    code = np.unique(comps, return_inverse=True)[1]
    ok = np.argwhere((common >= threshold * np.maximum(whole, 1) - 1e-6) & (code[left][:, None] != code[right][None]))
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    out = []
    for p, q in ok.tolist():
        a, b = int(left[p]), int(right[q])
        if (x := root(comps[a])) != (y := root(comps[b])) and similarity(bags[a], bags[b]) >= threshold:
            parent[x] = y
            out.append((max(keys[a], keys[b]), min(keys[a], keys[b])))
    return pa.table({"a": pa.array([o[0] for o in out], pa.string()), "b": pa.array([o[1] for o in out], pa.string())})


def near_duplicates(docs: DataFrame, text: str = "text", doc: str = "doc_id", params: NearParams = NearParams(), name: str = "near") -> DataFrame:
    """doc_id, key (text digest), class_id, class_key, class_size for every row.

    class_id and class_key are the smallest id of the class and its text's digest: the row that stays.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.md5(body.cast("binary")).alias("key"), body.alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column("text")):
                row, key, count = multisets(texts(b.column("text").slice(lo, hi - lo)), params.width)
                keys = band_keys(signatures(row, key, count, hi - lo, params.registers), params.bands)
                size = np.bincount(row, count, hi - lo).astype(np.int64)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, params.bands), pa.int32()), pa.array(keys.ravel()))
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(size), listed], names=["doc_id", "key", "size", "bands"])

    signed = staged(rows.mapInArrow(sign, "doc_id long, key string, size long, bands array<bigint>"), f"{name}-signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    classes = signed.groupBy("key").agg(first, F.count("*").alias("n"), F.min("size").alias("size"), F.first("bands").alias("bands"))
    classes = staged(classes, f"{name}-classes")

    # Buckets of two classes or more.
    spread = classes.select("key", "size", F.explode("bands").alias("bucket"))
    full = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = staged(spread.join(full, "bucket"), f"{name}-members")
    wanted = members.select("key").distinct().join(classes.select("key", F.col("first.doc_id").alias("_id")), "key")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column("text")):
                row, key, count = multisets(texts(b.column("text").slice(lo, hi - lo)), params.width)
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                packed = [key[x:y].tobytes() + count[x:y].astype(np.uint32).tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("key").slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["key", "bag"])

    picked = rows.join(wanted.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("key", "text")
    bags = staged(picked.mapInArrow(load, "key string, bag binary").groupBy("key").agg(F.min("bag").alias("bag")), f"{name}-bags")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column("bag_a"), b.column("bag_b")
            ok = [similarity(_load(left[i].as_py()), _load(right[i].as_py())) >= params.threshold for i in range(len(b))]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (bags.select(F.col("key").alias(x), F.col("bag").alias(f"bag_{x}")) for x in ("a", "b"))
        return staged(pairs.join(a, "a").join(b, "b").mapInArrow(verify, "a string, b string, ok boolean"), f"{name}-tried")

    # Round 1: each member against the leader of its bucket.
    weight = F.sum("n").over(W.partitionBy("key"))  # one window row per band of a class
    ranked = members.withColumn("central", weight)
    leaders = ranked.groupBy("bucket").agg(F.min_by(F.struct("key", "size"), F.struct(-F.col("central"), F.col("key"))).alias("l"))
    leaders = leaders.select("bucket", F.col("l.key").alias("key2"), F.col("l.size").alias("size2"))
    alike = F.least("size", "size2") >= params.threshold * F.greatest("size", "size2")
    pairs = members.join(leaders, "bucket").where((F.col("key") != F.col("key2")) & alike)
    links = verified(pairs.select(F.greatest("key", "key2").alias("a"), F.least("key", "key2").alias("b")).distinct()).where("ok").select("a", "b")
    comp = components(links, f"{name}-stars")

    # Round 2: what the leaders leave apart, block by block.
    rest = members.join(leaders, "bucket").where(F.col("key") != F.col("key2")).select("key", "bucket")
    known = rest.join(comp.withColumnRenamed("a", "key"), "key", "left").select("key", "bucket", F.coalesce("b", "key").alias("comp"))
    open_ = known.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("key").alias("b")).where("x <> y").select("bucket", "b")
    apart = staged(known.join(open_, "bucket"), f"{name}-apart")
    chain = components(apart.select(F.col("key").alias("a"), "b"), f"{name}-clusters").withColumnRenamed("a", "key").withColumnRenamed("b", "cluster")
    load_ = F.octet_length("bag") + params.row_bytes
    chained = apart.select("key", "comp", "bucket").join(chain, "key", "left").join(bags.select("key", load_.alias("bytes")), "key")
    chained = staged(chained.withColumn("cluster", F.coalesce("cluster", "key")), f"{name}-chained")
    # Clusters over a block: their bytes bound their number, so they are known to every task and no cluster is dealt to one.
    large = chained.select("cluster", "key", "bytes").distinct().groupBy("cluster").agg(F.sum("bytes").alias("all")).where(F.col("all") > params.block_bytes)
    large = staged(large.select("cluster", F.lit(True).alias("large")), f"{name}-large")
    side = F.broadcast(large) if large.count() <= params.broadcast_rows else large
    unit = F.when(F.col("large"), F.col("bucket").cast("string")).otherwise(F.col("cluster")).alias("unit")
    placed = staged(chained.join(side, "cluster", "left").select(unit, "key", "comp", "bytes").distinct(), f"{name}-placed")
    room = placed.groupBy("unit").agg(F.ceil(F.sum("bytes") / params.block_bytes).cast("int").alias("blocks"))
    rows_ = placed.join(room, "unit").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).join(bags, "key")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = rows_.select("unit", "key", "comp", "bag", "own", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    more = dealt.groupBy("unit", "i", "j").applyInArrow(lambda t: _block_links(t, params.threshold), "a string, b string")
    more = staged(more, f"{name}-more")
    if more.limit(1).count():  # the stars found so far stand for their links
        comp = components(comp.unionByName(more), f"{name}-final")

    total = classes.join(comp.withColumnRenamed("a", "key"), "key", "left").select("key", "first", "n", F.coalesce("b", "key").alias("comp"))
    heads = total.groupBy("comp").agg(F.min(F.struct("first.none", "first.doc_id", "key")).alias("head"), F.sum("n").alias("class_size"))
    placed = total.join(heads, "comp").select("key", F.col("head.doc_id").alias("class_id"), F.col("head.key").alias("class_key"), "class_size")
    return signed.select("doc_id", "key").join(placed, "key").select("doc_id", "key", "class_id", "class_key", "class_size")


def kept(docs: DataFrame, params: NearParams = NearParams(), name: str = "near") -> DataFrame:
    """The documents with one row of each class: that of the smallest id.  All columns stay."""
    id_, key, n = unused(docs, "_d", "_k", "_n")
    found = near_duplicates(docs, params=params, name=name)
    heads = found.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("key") == F.col("class_key")))
    heads = staged(heads.groupBy(F.col("doc_id").alias(id_), F.col("key").alias(key)).agg(F.count("*").alias(n)), f"{name}-heads")
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    rows = docs.join(heads, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (digest == F.col(key)))
    if heads.where(F.col(n) > 1).limit(1).count():  # repeated rows of a class's head
        rows = rows.where(F.col(n) == 1).unionByName(rows.where(F.col(n) > 1).dropDuplicates([id_, key]))
    return rows.select(*docs.columns)
