"""Source divergence audit: how far the word use of each source lies from the others of its language.

The divergence of two groups is the sum over all kept terms of f = floor((p - q)**2 / (p + q)), where p and q are the
scaled, smoothed shares of a term in either group.  Most terms occur in few groups, so the sum is never taken over
the vocabulary.  A pair (A, B) starts from its baseline, V times f of the two shares of a term with
count zero.  The inverted index (a term's postings are the groups that use it) emits only what differs from
that, in two parts that add up exactly:

* one side: each term of A adds f(p_A, zero_B) - f(zero_A, zero_B).  Terms of equal count add the same, so A's postings are
  first grouped by count;
* both sides: a term that A and B share adds f(p_A, p_B) - f(p_A, zero_B) - f(zero_A, p_B) + f(zero_A, zero_B).

The terms in which a source exceeds its language are ranked by a window over its postings.

Scale: tokens are counted where they are read, in slices of texts, so the shuffles carry distinct
(lang, source, term) rows.  The postings of a term in more than ``hot`` sources are dealt to several slots: a posting
on the left goes to one slot, on the right to all, so no task holds more than ``hot`` left postings of a term against all its
right ones.  The pairs of a language's sources are the result itself; they are dealt to slots in the same way.  No
table is broadcast by hint, and nothing goes to the driver.

Arithmetic is in whole numbers: counts and shares in 64 bits, the products of a share in decimals where they could exceed
64 bits.

Cases: null text, lang and source count as ''; a text without terms still makes its group occur; a language without
kept terms has only pairs of value 0; repeated rows count each; equal values are ranked by the item's
UTF-8 bytes; an empty table gives an empty result; other columns are ignored, whatever their names.  A very long text
is a slice of its own and needs memory in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm._blocks import trim
from weftline.llm._common import partitions, staged
from weftline.llm._tokens import LOWER, Batch, slices, texts

#: Bytes of terms: letters and all that is not ASCII.
IS_TERM = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
COUNTS = "lang string, source string, term string, n long, df long"
SCALE = 1_000_000_000
RESULT = "lang string, source string, part string, item string, value long, rank int"


def quotient(a: Column, b: Column) -> Column:
    """The whole part of a / b for whole numbers that are not negative."""
    return F.call_function("div", a, b)


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exact for any counts of 60 bits; null without terms."""
    above, below = (count + 2).cast("long"), F.nullif((total + 2 * terms).cast("long"), F.lit(0))
    wide = quotient(F.lit(SCALE).cast("decimal(10,0)") * above.cast("decimal(19,0)"), below.cast("decimal(19,0)"))
    return 1 + F.when(above < 1 << 33, quotient(F.lit(SCALE).cast("long") * above, below)).otherwise(wide)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)); shares are at most SCALE + 1, so the square fits 64 bits."""
    return quotient((p - q) * (p - q), p + q)


def _found(batch: Batch) -> tuple[pa.StringArray, np.ndarray]:
    """All terms of a batch of texts in order, lower-cased, and the text of each."""
    data = LOWER[batch.data[: batch.size]]
    inside = IS_TERM[data]
    edge = np.zeros(batch.size + 1, bool)  # a text's border ends a term
    edge[batch.offsets] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return terms, np.searchsorted(batch.offsets, start, "right") - 1


def _counts(part: pa.RecordBatch) -> pa.RecordBatch:
    """COUNTS rows of some texts."""
    terms, row = _found(texts(part["text"]))
    coded, lang, source = terms.dictionary_encode(), part["lang"].dictionary_encode(), part["source"].dictionary_encode()
    codes = lambda x: x.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_terms, n_sources = max(1, len(coded.dictionary)), max(1, len(source.dictionary))
    held, n = np.unique(row * n_terms + codes(coded), return_counts=True)  # a term once for each text that holds it
    group = (codes(lang) * n_sources + codes(source))[held // n_terms]
    key, at = np.unique(group * n_terms + held % n_terms, return_inverse=True)
    total = np.bincount(at, n, len(key)).astype(np.int64)
    columns = [lang.dictionary.take(pa.array(key // n_terms // n_sources)), source.dictionary.take(pa.array(key // n_terms % n_sources)), coded.dictionary.take(pa.array(key % n_terms))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(total), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64))], ["lang", "source", "term", "n", "df"])


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, df): occurrences in each group and the rows that hold the term.

    Terms are found on the bytes (all bytes from 0x80 on belong to terms, so byte and code point borders agree) and
    counted by slices of 2 MB before they are sent; a slice's memory is given back.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(plain(text).alias("text"), plain(lang).alias("lang"), plain(source).alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch["text"], 2 << 20):
                yield _counts(batch.slice(lo, hi - lo))
                trim()

    return rows.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def inverted_index(docs: DataFrame, min_docs: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged tables of a corpus.

    postings: (lang, source, term, n, spread, of_lang, p, zero, q): a kept term of a group, its occurrences, the number of
    groups that use it, its occurrences in the language, the group's share of it and of an absent term, the language's share.
    groups: (lang, source, total, terms, zero), all that occur.  pairs: (lang, a, b, zero_a, zero_b, terms), a < b.
    """
    of_term = W.partitionBy("lang", "term")
    kept = term_counts(docs, text, lang, source).select("*", F.sum("df").over(of_term).alias("held"), F.sum("n").over(of_term).alias("of_lang"), F.count("*").over(of_term).alias("spread"))
    kept = staged(kept.where(F.col("held") >= min_docs).drop("df", "held"), "divergence-kept")

    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    occurring = docs.select(plain(lang).alias("lang"), plain(source).alias("source")).distinct()
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # A term's postings agree on of_lang, so each adds its part of one.
    per_lang = kept.groupBy("lang", "term").agg(F.first("of_lang").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("terms"))
    groups = occurring.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").fillna(0, ["total", "lang_total", "terms"])
    groups = staged(groups.withColumn("zero", share(F.lit(0), F.col("total"), F.col("terms"))), "divergence-groups")

    postings = kept.join(groups, ["lang", "source"])
    postings = postings.withColumns({"p": share(F.col("n"), F.col("total"), F.col("terms")), "q": share(F.col("of_lang"), F.col("lang_total"), F.col("terms"))})
    postings = staged(postings.drop("total", "terms", "lang_total"), "divergence-postings")

    slots = partitions(docs.sparkSession)
    left = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("zero_a"), "terms", F.pmod(F.xxhash64("source"), F.lit(slots)).cast("int").alias("slot"))
    right = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    pairs = left.join(right, ["lang", "slot"]).where("a < b").drop("slot")
    return postings, groups, pairs


def shared_corrections(postings: DataFrame, hot: int = 1024) -> DataFrame:
    """(lang, a, b, value): what the terms that both sources use add beyond both one-sided corrections."""
    slots = F.floor((F.col("spread") - 1) / hot).cast("int") + 1
    cut = postings.select("lang", "term", "source", "p", "zero", slots.alias("slots"))
    left = cut.select("lang", "term", F.pmod(F.xxhash64("source"), F.col("slots")).cast("int").alias("slot"), F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("zero").alias("z_a"))
    right = cut.select("lang", "term", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("zero").alias("z_b"))
    both = left.join(right, ["lang", "term", "slot"]).where("a < b")
    c = F.col
    fix = gap(c("p_a"), c("p_b")) - gap(c("p_a"), c("z_b")) - gap(c("z_a"), c("p_b")) + gap(c("z_a"), c("z_b"))
    return both.select("lang", "a", "b", fix.alias("value")).where("value <> 0").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def lone_corrections(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value), a and b in either order: what a's terms add against b's zero share.

    Equal counts of a, and equal zero shares of partners, are met once.
    """
    counted = postings.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("m"))
    zeros = groups.select("lang", F.col("zero").alias("other")).distinct()
    each = counted.join(zeros, "lang").select("lang", "source", "other", (F.col("m") * (gap(F.col("p"), F.col("other")) - gap(F.col("zero"), F.col("other")))).alias("v"))
    sums = each.where("v <> 0").groupBy("lang", "source", "other").agg(F.sum("v").alias("value"))
    return sums.withColumnRenamed("source", "a")


def pair_values(postings: DataFrame, groups: DataFrame, pairs: DataFrame, hot: int = 1024) -> DataFrame:
    """(lang, a, b, value), a < b: the divergence of every two sources of a language."""
    lone = staged(lone_corrections(postings, groups), "divergence-lone")
    side = lambda mine, name: lone.select("lang", F.col("a").alias(mine), F.col("other").alias(f"zero_{'b' if mine == 'a' else 'a'}"), F.col("value").alias(name))
    base = F.when(F.col("terms") > 0, F.col("terms") * gap(F.col("zero_a"), F.col("zero_b"))).otherwise(0)
    out = pairs.join(side("a", "of_a"), ["lang", "a", "zero_b"], "left").join(side("b", "of_b"), ["lang", "b", "zero_a"], "left")
    out = out.select("lang", "a", "b", (base + F.coalesce("of_a", F.lit(0)) + F.coalesce("of_b", F.lit(0))).alias("start"))
    out = out.join(shared_corrections(postings, hot), ["lang", "a", "b"], "left")
    return out.select("lang", "a", "b", (F.col("start") + F.coalesce("value", F.lit(0))).cast("long").alias("value"))


def ranked_terms(postings: DataFrame, top: int = 10) -> DataFrame:
    """(lang, source, item, value, rank): the terms in which a source exceeds its language most."""
    d = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source", hot: int = 1024) -> DataFrame:
    """RESULT rows: part ``pair`` ranks all other sources of a source's language, part ``term`` its ``top`` terms."""
    postings, groups, pairs = inverted_index(docs, min_docs, text, lang, source)
    one = pair_values(postings, groups, pairs, hot)
    both = one.select("lang", F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))), "value")
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    both = both.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    out = both.unionByName(ranked_terms(postings, top).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
