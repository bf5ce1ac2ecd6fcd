"""Greedy segmentation of paragraphs into blocks.

A block closes when it reaches its limits, so the state resets and no running sum expresses it.  Short documents are folded
in one row; long ones in chunks that are folded for every place where a block may enter them, so no row and no group
holds the paragraphs of a long document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.sources.staging import staged

# Limits of a block.
MAX_PARAS, MAX_CHARS = 16, 1600
JA_OPEN, JA_CLOSE, TERMINALS = "「『", "」』", "。！？!?…"


def is_speech(c: Column) -> Column:
    return c.rlike(rf"(?U)^\s*[{JA_OPEN}]")


def closes_speech(c: Column) -> Column:
    return c.rlike(rf"(?U)[{JA_CLOSE}][\s{TERMINALS}]*$")


def ends_terminal(c: Column) -> Column:
    """Ends a sentence or speech; blank text does."""
    return c.rlike(rf"(?U)^\s*$|[{TERMINALS}{JA_CLOSE}]\s*$")


def soft_boundary(before: Column, after: Column) -> Column:
    """Whether two neighbours may share a block: both have text.

    The finer conditions (open sentence, dialogue, attribution, short narration) all lead to the same
    answer, so the narration length has no effect.
    """
    return (F.coalesce(before, F.lit("")) != "") & (F.coalesce(after, F.lit("")) != "")


def block_numbers(sizes: Column, soft: Column, max_paras: int = MAX_PARAS, max_chars: int = MAX_CHARS) -> Column:
    """array<int>: the block number of each paragraph from lengths and soft borders (soft[i]: i and i + 1)."""
    zero = F.lit(0)
    start = F.struct(F.array().cast("array<int>").alias("out"), zero.alias("no"), zero.alias("n"), zero.alias("chars"))

    def step(a: Column, x: Column) -> Column:
        n, chars = a["n"] + 1, a["chars"] + x["size"]
        close = ~F.coalesce(x["soft"], F.lit(True)) | (n >= max_paras) | (chars >= max_chars)
        return F.struct(
            F.concat(a["out"], F.array(a["no"])).alias("out"), (a["no"] + close.cast("int")).alias("no"),
            F.when(close, zero).otherwise(n).alias("n"), F.when(close, zero).otherwise(chars).alias("chars"),
        )

    return F.aggregate(F.arrays_zip(sizes.alias("size"), soft.alias("soft")), start, step, lambda a: a["out"])


def segmented(paras: DataFrame, max_paras: int = MAX_PARAS, max_chars: int = MAX_CHARS, chunk: int = 4096) -> DataFrame:
    """(doc_id, para_no, block_no) for paragraphs (doc_id, para_no, text); ``para_no`` counts a document's paragraphs from 1.

    A document is cut into chunks of ``chunk`` paragraphs, one row each.  A document of one chunk is folded in its row.  In a longer one a
    block that begins in one chunk ends at most ``max_paras`` paragraphs into the next, so a chunk is a function of the place where its first
    own block may begin: from each of ``max_paras`` places to a place in the next chunk and a number of blocks.  The chunks'
    functions, not their paragraphs, meet by document, and each chunk then numbers its own paragraphs.
    """
    size = max(chunk, 16 * max_paras)
    at = F.floor((F.col("para_no") - 1) / size).cast("int")
    # The first paragraphs of a chunk also go to the chunk before, so no chunk has to be looked up by its neighbour.
    again = (at > 0) & ((F.col("para_no") - 1) % size < max_paras)
    sent = paras.select("doc_id", F.explode(F.when(again, F.array(at, at - 1)).otherwise(F.array(at))).alias("chunk"), F.struct("para_no", F.coalesce(F.length("text"), F.lit(0)).alias("size")).alias("x"))
    listed = sent.groupBy("doc_id", "chunk").agg(F.sort_array(F.collect_list("x")).alias("p"))
    last = (F.col("chunk") + 1) * size
    ahead = F.transform(F.filter("p", lambda x: x["para_no"] > last), lambda x: x["size"])
    listed = listed.select("doc_id", "chunk", ahead.alias("ahead"), F.filter("p", lambda x: x["para_no"] <= last).alias("p"))
    sizes = F.transform("p", lambda x: x["size"])
    listed = listed.withColumn("later", (F.col("chunk") > 0) | (F.size("ahead") > 0))
    soft = F.transform(F.col("p"), lambda x, i: F.coalesce((x["size"] > 0) & (F.get(F.col("p"), i + 1)["size"] > 0), F.lit(True)))
    places = F.arrays_zip(F.transform("p", lambda x: x["para_no"].cast("int")).alias("para_no"), block_numbers(sizes, soft, max_paras, max_chars).alias("block_no"))
    out = listed.where("NOT later").select("doc_id", F.inline(places))
    long_ = staged(listed.where("later").select("doc_id", "chunk", F.transform("p", lambda x: x["para_no"].cast("int")).alias("no"), sizes.alias("sizes"), "ahead"), "segment-chunks")
    return out.unionByName(_long(long_, max_paras, max_chars))


def following(sizes: np.ndarray, n: int, max_paras: int, max_chars: int) -> np.ndarray:
    """For each of the first ``n`` paragraphs the one after a block that begins there; ``sizes`` goes on beyond them."""
    i, upto = np.arange(n), np.cumsum(sizes)
    by_chars = np.searchsorted(upto, upto[:n] - sizes[:n] + max_chars, "left") + 1
    hard = np.append(np.flatnonzero((sizes[:-1] == 0) | (sizes[1:] == 0)), len(sizes))
    by_border = hard[np.searchsorted(hard, i, "left")] + 1
    return np.minimum.reduce([i + max_paras, by_chars, by_border, np.full(n, len(sizes))])


def _long(chunks: DataFrame, max_paras: int, max_chars: int) -> DataFrame:
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            exits, counts = [], []
            for own, ahead in zip(b["sizes"].to_pylist(), b["ahead"].to_pylist(), strict=True):
                n = len(own)
                to = following(np.array(own + ahead, np.int64), n, max_paras, max_chars).tolist()
                leave, begun = list(range(-n, max_paras)), [0] * (n + max_paras)  # a place beyond the chunk is left as it is
                for i in range(n - 1, -1, -1):
                    leave[i], begun[i] = leave[to[i]], begun[to[i]] + 1
                exits.append(leave[:max_paras])
                counts.append(begun[:max_paras])
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["chunk"], pa.array(exits, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], ["doc_id", "chunk", "exits", "counts"])

    def followed(table: pa.Table) -> pa.Table:
        """Where each chunk of a document is entered, and how many blocks began before it."""
        table = table.sort_by("chunk")
        entry, begun, entries, before = 0, 0, [], []
        for exits, counts in zip(table["exits"].to_pylist(), table["counts"].to_pylist(), strict=True):
            entries.append(entry)
            before.append(begun)
            entry, begun = exits[entry], begun + counts[entry]
        return pa.table([table["doc_id"], table["chunk"], pa.array(entries, pa.int32()), pa.array(before, pa.int32())], names=["doc_id", "chunk", "entry", "before"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(len(b)):
                own = b["sizes"][r].as_py()
                n = len(own)
                to = following(np.array(own + b["ahead"][r].as_py(), np.int64), n, max_paras, max_chars).tolist()
                begins, i = np.zeros(n, np.int32), b["entry"][r].as_py()
                while i < n:
                    begins[i] = 1
                    i = to[i]
                no = pa.array(np.cumsum(begins, dtype=np.int32) + np.int32(b["before"][r].as_py() - 1))
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array([r] * n, pa.int32())), b["no"][r].values, no], ["doc_id", "para_no", "block_no"])

    made = chunks.select("doc_id", "chunk", "sizes", "ahead").mapInArrow(functions, f"doc_id {kind}, chunk int, exits array<int>, counts array<int>")
    entered = made.groupBy("doc_id").applyInArrow(followed, f"doc_id {kind}, chunk int, entry int, before int")
    whole = chunks.join(entered.withColumnsRenamed({"doc_id": "_doc", "chunk": "_chunk"}), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("chunk") == F.col("_chunk"))).drop("_doc", "_chunk")
    return whole.mapInArrow(numbered, f"doc_id {kind}, para_no int, block_no int")
