"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A logistic model scores each sentence, noisy-or combines them
(``P = 1 - prod(1 - p_s)``), and the model is trained on document labels alone by the gradient of the
noisy-or likelihood, so it learns which sentences carry a label.  Features are the words and their
four and five byte prefixes, lower-cased, hashed to 32 bits; labels, language, source and id are not.

The learner is fitted on the driver from a bounded sample: about ``max_train_docs`` labelled documents
drawn by the hash of their id; in hash order, each is taken whose text still fits ``max_train_chars`` bytes in all
(a text that does not fit is passed over, the next ones are not).  Lengths are known before any text moves.  Tasks count
each feature's documents, and the driver receives the selected features and the places where they stand, no others.  Scoring is one narrow pass over all whole texts with
the selected weights (at most ``max_features``) in the task closure; nothing is shuffled.

Cases: null and empty texts are one empty sentence and get the model's base score; a null id counts as
the id ''; rows without a usable label are not learned from; several labels of one id count as toxic
if one is; without both classes among the labels every score is 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm._common import staged
from weftline.llm._tokens import LOWER, Batch, Words, hash_ranges, slices, texts, words

PUNCT = np.zeros(256, bool)
PUNCT[list(b".,;:!?\"'()[]{}<>*#$%&|-_/=+~`^\\@")] = True
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True


@dataclass(frozen=True)
class ToxicityParams:
    max_train_docs: int = 6_000
    max_train_chars: int = 24_000_000
    max_features: int = 2_048
    min_df: int = 4
    steps: int = 300
    l2: float = 1e-5
    threshold: float = 0.7
    sentence_threshold: float = 0.5


def remainder(doc: Column, m: int) -> Column:
    return F.crc32(F.coalesce(doc.cast("string"), F.lit("")).cast("binary")) % m


def sentences(batch: Batch, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each sentence, sentence number where each text starts, plus the total).

    A sentence ends with a word that ends in a full stop, ! or ?, at a line's end and at the text's end.
    """
    n = len(w.start)
    ends = np.zeros(n, bool)
    if n:
        line = np.concatenate([[0], np.cumsum(batch.data[: batch.size] == 0x0A)])
        ends = STOP[batch.data[w.end - 1]]
        ends[:-1] |= line[w.start[1:]] != line[w.end[:-1]]
        last = w.first[1:] - 1
        ends[last[last >= 0]] = True
        ends[-1] = True
    begin = np.ones(n, bool)
    begin[1:] = ends[:-1]
    first = np.flatnonzero(begin)
    return first, np.searchsorted(first, w.first)


def features(batch: Batch, w: Words) -> np.ndarray:
    """(words, 3) 32-bit features; those of a word without letters hash its empty core."""
    data = batch.data
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):
        end -= (end > start) & PUNCT[data[end - 1]]
        start += (start < end) & PUNCT[data[start]]
    out = np.empty((len(start), 3), np.uint32)
    for k, size in enumerate((0, 4, 5)):
        to = end if not size else np.minimum(end, start + size)
        out[:, k] = hash_ranges(data, start, to, seed=size) >> np.uint64(32)
    return out


@dataclass
class Model:
    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def word_logits(self, f: np.ndarray) -> np.ndarray:
        """Sum of the weights of each word's features; a bit table spares most of the searches."""
        if not len(self.keys):
            return np.zeros(len(f))
        seen = np.zeros(1 << 16, bool)
        seen[self.keys & 0xFFFF] = True
        total = np.zeros(len(f))
        for k in range(f.shape[1]):
            at = np.flatnonzero(seen[f[:, k] & 0xFFFF])
            i = np.minimum(np.searchsorted(self.keys, f[at, k]), len(self.keys) - 1)
            total[at] += np.where(self.keys[i] == f[at, k], self.weights[i], 0.0)
        return total


def sentence_scores(model: Model, batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """(probability of each sentence, its first word, sentence number at each text's start, words)."""
    low = Batch(LOWER[batch.data], batch.offsets)
    w = words(low)
    first, bag = sentences(batch, w)
    logit = np.add.reduceat(model.word_logits(features(low, w)), first) if len(first) else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(logit + model.bias, -40, 40))), first, bag, w


def noisy_or(p: np.ndarray, bag: np.ndarray, base: float) -> np.ndarray:
    cum = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-12)))])
    score = -np.expm1(cum[bag[1:]] - cum[bag[:-1]])
    return np.clip(np.where(bag[1:] == bag[:-1], base, score), 0.0, 1.0) + 0.0  # no negative zero


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, Words]]:
    """(rows, features of their words, first word of each sentence, sentence number at each text's start, words)."""
    for b in batches:
        for lo, hi in slices(b.column("text")):
            batch = texts(b.column("text").slice(lo, hi - lo))
            low = Batch(LOWER[batch.data], batch.offsets)
            w = words(low)
            yield b.slice(lo, hi - lo), features(low, w), *sentences(batch, w), w


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features with the number of documents that hold them, and of toxic ones."""
    for part, f, _, _, w in _sampled(batches):
        own = [np.unique(f[w.first[i] : w.first[i + 1]]) for i in range(len(part))]
        key, at = np.unique(np.concatenate(own), return_inverse=True)
        toxic = np.repeat(part.column("toxic").to_numpy(zero_copy_only=False), [len(x) for x in own])
        n, pos = np.bincount(at, minlength=len(key)), np.bincount(at, toxic, len(key)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(n), pa.array(pos)], names=["feature", "n", "pos"])


def _hits(key: np.ndarray):
    """A function from rows to where their words' features are among ``key``: sentence (from 0) and place in ``key`` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, f, first, bag, w in _sampled(batches):
            sent = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(w.start))))
            i = np.minimum(np.searchsorted(key, f), len(key) - 1)
            hit = key[i] == f
            rows = []
            for k in range(len(part)):
                own = slice(w.first[k], w.first[k + 1])
                at = np.broadcast_to((sent[own] - bag[k])[:, None], f[own].shape)[hit[own]]
                rows.append((at.astype(np.int32).tobytes(), i[own][hit[own]].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [part.column("ord"), part.column("toxic"), pa.array(np.diff(bag).astype(np.int64)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                names=["ord", "toxic", "n", "sentences", "places"],
            )

    return run


def fitting(sizes: list[tuple[int, int]], budget: int) -> tuple[list[int], list[int]]:
    """The orders taken and passed over, of (order, bytes): in order, each that still fits."""
    taken, over = [], []
    for ord_, size in sorted(sizes):
        if size <= budget:
            budget -= size
            taken.append(ord_)
        else:
            over.append(ord_)
    return taken, over


def fit(labelled: DataFrame, params: ToxicityParams = ToxicityParams()) -> Model:
    """Train from (doc_id, text, toxic); toxic is 0 or 1."""
    none = Model(np.zeros(0, np.uint32), np.zeros(0), -40.0)
    picked = staged(labelled.select("text", "toxic", F.xxhash64(F.lit(8), "doc_id").alias("ord")), "toxicity-sample")
    known = picked.select("ord", "toxic", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).collect()
    taken, over = fitting([(r["ord"], r["n"]) for r in known], params.max_train_chars)
    if over:
        picked, kept = picked.where(F.col("ord").isin(taken)), set(taken)
        known = [r for r in known if r["ord"] in kept]
    n_docs, n_toxic = len(known), sum(r["toxic"] for r in known)
    if n_toxic in (0, n_docs):
        return none
    rate = n_toxic / n_docs

    # Document frequencies by class, then the features that tell the classes apart best.
    df = picked.mapInArrow(_frequencies, "feature long, n long, pos long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    gap = F.abs(F.col("pos") - F.lit(rate) * F.col("n")) / F.sqrt(F.lit(rate * (1 - rate)) * F.col("n"))
    best = df.select("feature", F.when(F.col("n") < params.min_df, F.lit(0.0)).otherwise(gap).alias("gap")).orderBy(F.desc("gap"), "feature").limit(params.max_features)
    key = np.sort(best.select("feature").toArrow()["feature"].to_numpy()).astype(np.uint32)

    # Only where the selected features stand comes here.
    table = picked.mapInArrow(_hits(key), "ord long, toxic int, n long, sentences binary, places binary").toArrow()
    keep = np.argsort(table["ord"].to_numpy(), kind="stable")
    y = table["toxic"].to_numpy()[keep].astype(bool)
    bag = np.concatenate([[0], np.cumsum(table["n"].to_numpy()[keep])])
    own, places = ([np.frombuffer(x, np.int32) for x in table[c].take(pa.array(keep)).to_pylist()] for c in ("sentences", "places"))
    row, col = np.concatenate([x + b for x, b in zip(own, bag[:-1], strict=True)]), np.concatenate(places)
    del table, own, places
    n, w = int(bag[-1]), np.zeros(len(key))
    b = float(np.log(rate / (1 - rate)) - np.log(max(1.0, n / len(y))))
    m, v = np.zeros(len(key) + 1), np.zeros(len(key) + 1)
    owner = np.repeat(np.arange(len(y)), np.diff(bag))
    for step in range(1, params.steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], n) + b, -40, 40)))
        whole = noisy_or(p, bag, 0.0)
        g = np.where(y[owner], -p * ((1 - whole) / np.maximum(whole, 1e-9))[owner], p) / len(y)
        grad = np.append(np.bincount(col, g[row], len(key)) + params.l2 * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Model(key, w, b)


def score(docs: DataFrame, model: Model, text: str = "text", doc: str = "doc_id", params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id, score, n_sentences, offending: the spans (code points, start:end, comma-joined) of sentences at or over the threshold."""
    limit = params.sentence_threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column("text")):
                batch = texts(b.column("text").slice(lo, hi - lo))
                p, first, bag, w = sentence_scores(model, batch)
                total = noisy_or(p, bag, 1 / (1 + np.exp(-max(model.bias, -40.0))))
                spans = [""] * (hi - lo)
                last = np.append(first[1:], len(w.start)) - 1
                for i in np.unique(np.searchsorted(bag, np.flatnonzero(p >= limit), "right") - 1):
                    base = batch.offsets[i]
                    chars = np.concatenate([[0], np.cumsum((batch.data[base : batch.offsets[i + 1]] & 0xC0) != 0x80)])
                    bad = bag[i] + np.flatnonzero(p[bag[i] : bag[i + 1]] >= limit)
                    spans[i] = ",".join(f"{chars[w.start[first[s]] - base]}:{chars[w.end[last[s]] - base]}" for s in bad)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(total), pa.array(np.diff(bag), pa.int64()), pa.array(spans, pa.string())],
                    names=["doc_id", "score", "n_sentences", "offending"],
                )

    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double, n_sentences long, offending string")


def filtered(docs: DataFrame, model: Model, text: str = "text", params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The rows of ``docs`` whose score stays under the threshold, with all their columns, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in slices(b.column(text)):
                part = b.slice(lo, hi - lo)
                p, _, bag, _ = sentence_scores(model, texts(part.column(text)))
                total = noisy_or(p, bag, 1 / (1 + np.exp(-max(model.bias, -40.0))))
                yield part.filter(pa.array(total < params.threshold))

    return docs.mapInArrow(run, docs.schema)  # the columns are those of the input, whatever their names


def training_rows(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """(doc_id, text, toxic): about ``max_train_docs`` labelled documents outside the held-out fold.

    The fold is crc32 of the id modulo 3 not being 1.  Ids are drawn by a threshold on their hash, so
    the drawn labels have a proven bound and are the side that is broadcast; an id that occurs in
    several rows gives one row.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    total = known.count()
    part = min(1.0, params.max_train_docs / max(total, 1))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1 << 30)) < int(part * (1 << 30)) + 1)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))


def toxicity(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, offending for every row of ``docs``."""
    model = fit(training_rows(docs, labels, params), params)
    out = score(docs, model, params=params)
    return out.select(
        "doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
        (F.col("score") >= params.threshold).cast("int").alias("predicted"), "n_sentences", "offending",
    )
