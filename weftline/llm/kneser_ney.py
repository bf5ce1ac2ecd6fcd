"""Interpolated modified Kneser-Ney language model (bigrams over words), counted and queried in slices.

    p(w | v) = max(c(v w) - D(c), 0) / c(v .) + g(v) * p(w)
    p(w)     = max(N(. w) - D'(N), 0) / N(. .) + g' / (V + 1)

N(. w) is the number of distinct words before w, D and D' are the three modified discounts of each
order, and the last term is the unknown word's share.  A document is its words, then one end token; the
first token's context is a start mark, which is never predicted.

Counting: each block (a range of documents) sends the slices its distinct bigrams with their training
counts, sorted by context hash, so all followers of a context meet in one slice.  A slice merges
them in pieces, answers each block's bigrams in their order, and passes the number of distinct contexts of each word on to the
word's slice, which answers the blocks' words by binary search in sorted hash arrays that its worker memory-maps.  No worker holds more than its slice, nothing goes to the driver, and a
common bigram costs a slice one entry per block.  Texts are shuffled once.

``train_model`` keeps what the slices have merged (sorted hash arrays with counts) as a table;
``score_with`` scores any documents by such a table, which joins the questions of their blocks in each slice as one
more sender.  Keys of contexts and followers have 56 bits, those of words 64.

Cases: a null or empty text is one end token; the rows of the held-out fold are scored, not counted; a
null id has the text ''; rows of one id, and all rows without one, share a block, which is one task; a very
long text is whole in its block; repeated rows count as often as they occur; without training rows every
token is unknown; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import _blocks as B
from weftline.llm._tokens import LOWER, Batch, hash_ranges, words

START, END = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
_LOW, BITS = np.uint64(8), 56
PIECE = 1 << 21  # entries of a slice that are merged at once
MODEL = -1  # the sender of what a stored model holds
BIGRAMS, ANSWER, CONTEXTS, WORDS, WORD_ANSWER = range(5)
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def short(keys: np.ndarray) -> bytes:
    """56-bit keys in seven bytes each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def unshort(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return out.view("<u8").ravel()


class Tokens:
    """A block's token stream: word hashes with the end tokens, contexts, and what of it is training."""

    def __init__(self, table: pa.Table, batch: Batch, fold: Callable[[int | None], bool]):
        low = Batch(LOWER[batch.data], batch.offsets)
        w = words(low)
        h = hash_ranges(low.data, w.start, w.end)
        self.token = np.insert(h, w.first[1:], END)
        self.first = w.first + np.arange(len(w.first))
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[self.first[:-1]] = START
        self.held = np.array([fold(i) for i in table["doc_id"].to_pylist()], bool)
        self.train = np.repeat(~self.held, np.diff(self.first))

    def vocabulary(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct tokens, number of each token, training counts)."""
        key, at = np.unique(self.token, return_inverse=True)
        return key, at, np.bincount(at, self.train, len(key)).astype(np.uint64)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(contexts, tokens, number of each token's bigram, training counts), by short context, then token."""
        v, t = self.context >> _LOW, self.token >> _LOW
        order = np.lexsort((t, v))
        v, t = v[order], t[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
        at = np.empty(len(v), np.int64)
        at[order] = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        return v[begin], t[begin], at, np.bincount(at, self.train, len(begin)).astype(np.uint32)


def runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(sorted_)))


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more from the numbers of keys seen 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(d, 0.05 * k), 0.95 * k) for k, d in zip((1, 2, 3), raw, strict=True))])


def histogram(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].astype(np.int64)


class Mapped:
    """Sorted hash arrays on disk, memory-mapped for binary search; the files go with the object."""

    def __init__(self, keys: np.ndarray, **values: np.ndarray):
        self._dir = tempfile.TemporaryDirectory(prefix="weftline-lm-")
        self.arrays = {}
        for name, array in {"keys": keys, **values}.items():
            path = Path(self._dir.name, f"{name}.npy")
            np.save(path, array)
            self.arrays[name] = np.load(path, mmap_mode="r") if array.size else array

    def find(self, wanted: np.ndarray, *names: str) -> list[np.ndarray]:
        """Values of the wanted keys; 0 where a key is absent."""
        keys = self.arrays["keys"]
        if not len(keys):
            return [np.zeros(len(wanted), self.arrays[n].dtype) for n in names]
        i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[i] == wanted
        return [np.where(hit, self.arrays[n][i], 0).astype(self.arrays[n].dtype) for n in names]

    def close(self) -> None:
        self.arrays.clear()
        self._dir.cleanup()


def _bigrams(r: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct contexts, run lengths, tokens, counts) of a message."""
    (v, length), (t, c) = B.apart(r[4]), B.apart(r[5])
    return B.unpack(v), B.unpack_counts(length).astype(np.int64), unshort(t), B.unpack_counts(c)


def _bigram_message(slice_: int, sender: int, v: np.ndarray, t: np.ndarray, c: np.ndarray) -> tuple:
    begin, length = runs(v)
    return (slice_, sender, BIGRAMS, len(v), B.joined(B.pack(v[begin]), B.pack_counts(length)), B.joined(short(t), B.pack_counts(c)))


def _counted(base: DataFrame, n: int, to_slices: B.Route, fold: Callable[[int | None], bool]) -> DataFrame:
    """The blocks' distinct bigrams and words with their training counts, at the slices."""

    def count(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        tokens = Tokens(*B.opened(table), fold)
        v, t, _, c = tokens.bigrams()
        out = [_bigram_message(s, block, v[lo:hi], t[lo:hi], c[lo:hi]) for s, lo, hi in B.parts(B.cuts(v, BITS, n), len(v)) if hi > lo]
        key, _, c = tokens.vocabulary()
        out += [(s, block, WORDS, hi - lo, B.pack(key[lo:hi]), B.pack_counts(c[lo:hi])) for s, lo, hi in B.parts(B.cuts(key >> _LOW, BITS, n), len(key)) if hi > lo]
        return to_slices.send(out, block)

    return to_slices.delivered(base.groupBy("block").applyInArrow(B.lean(count), B.MESSAGE))


def _merged_bigrams(asked: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct training bigrams (context, token, count) of a slice, in order."""
    if not asked:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    v = np.concatenate([np.repeat(x[0], x[1]) for x in asked])
    t, c = (np.concatenate([x[k] for x in asked]) for k in (2, 3))
    own = c > 0
    v, t, c = v[own], t[own], c[own]
    order = np.lexsort((t, v))
    v, t, c = v[order], t[order], c[order].astype(np.uint64)
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    begin = np.flatnonzero(new)
    return v[begin], t[begin], np.add.reduceat(c, begin) if len(begin) else np.zeros(0, np.uint64)


def _merged_words(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct words, counts) of a slice's messages of words or of contexts of words."""
    key, at = np.unique(np.concatenate([B.unpack(r[4]) for r in rows] or [np.zeros(0, np.uint64)]), return_inverse=True)
    c = np.zeros(len(key), np.uint64)
    np.add.at(c, at, np.concatenate([B.unpack_counts(r[5]) for r in rows] or [np.zeros(0, np.uint64)]))
    return key, c


class Asked:
    """The bigrams of a slice's messages, merged in pieces of about ``PIECE`` entries; what is held of them all is 11 bytes an entry.

    A piece is a range of contexts; the entries of a context that has more are pieces by ranges of their tokens, so a
    context that is in every block costs no more memory at once than others.
    """

    def __init__(self, rows: list[tuple]):
        self.context, self.length, self.token, self.count = [], [], [], []
        for r in rows:
            (v, length), (t, c) = B.apart(r[4]), B.apart(r[5])
            self.context.append(B.unpack(v))
            self.length.append(B.unpack_counts(length).astype(np.int64))
            self.token.append(t)
            self.count.append(B.unpack_counts(c).astype(np.uint32))
        self.begin = [np.append(0, np.cumsum(n)) for n in self.length]
        self.contexts, at = np.unique(np.concatenate([*self.context, np.zeros(0, np.uint64)]), return_inverse=True)
        self.entries = np.bincount(at, np.concatenate([*self.length, np.zeros(0, np.int64)]), len(self.contexts)).astype(np.int64)

    def _tokens(self, k: int, low: int, high: int) -> np.ndarray:
        return unshort(self.token[k][7 * low : 7 * high])

    def _ranges(self, most: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """(first context, context after the last, entries of each message) of each piece."""
        upto = np.cumsum(self.entries)
        i = 0
        while i < len(upto):
            before = upto[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(upto, before + most, "right")))
            own = []
            for cv, begin in zip(self.context, self.begin, strict=True):
                lo, hi = np.searchsorted(cv, self.contexts[i]), np.searchsorted(cv, self.contexts[j - 1], "right")
                own.append((int(begin[lo]), int(begin[hi])))
            n = -(-int(upto[j - 1] - before) // most)
            if n > 1:  # one context; its tokens are in order in each message
                edges = np.array([((1 << BITS) * k) // n for k in range(1, n)], np.uint64)
                cuts = [[lo, *(lo + np.searchsorted(self._tokens(k, lo, hi), edges)).tolist(), hi] for k, (lo, hi) in enumerate(own)]
                yield from ((i, j, [(c[k], c[k + 1]) for c in cuts]) for k in range(n))
            else:
                yield i, j, own
            i = j

    def pieces(self, most: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int, np.ndarray]]]]:
        """First context, context after the last, (context's number in the piece, token, count) of the distinct bigrams, and for each message its number, its range
        of entries and the bigrams they are.
        """
        for i, j, own in self._ranges(most or PIECE):
            own = [(k, lo, hi) for k, (lo, hi) in enumerate(own) if hi > lo]
            if not own:
                continue
            heads = []
            for k, lo, hi in own:
                a, b = np.searchsorted(self.begin[k], lo, "right") - 1, np.searchsorted(self.begin[k], hi)
                size = np.minimum(self.begin[k][a + 1 : b + 1], hi) - np.maximum(self.begin[k][a:b], lo)
                heads.append(np.repeat(np.searchsorted(self.contexts[i:j], self.context[k][a:b]), size))
            v, t = np.concatenate(heads), np.concatenate([self._tokens(*x) for x in own])
            order = np.lexsort((t, v))
            v, t = v[order], t[order]
            new = np.ones(len(v), bool)
            new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
            at = np.empty(len(v), np.int64)
            at[order] = np.cumsum(new) - 1
            total = np.bincount(at, np.concatenate([self.count[k][lo:hi] for k, lo, hi in own])).astype(np.uint64)
            edge = np.append(0, np.cumsum([hi - lo for _, lo, hi in own]))
            yield i, j, v[new], t[new], total, [(*x, at[edge[n] : edge[n + 1]]) for n, x in enumerate(own)]


def train_model(docs: DataFrame, text: str = "text", doc: str = "doc_id", fold: Callable[[int | None], bool] = held_out, fan: int = B.FAN) -> DataFrame:
    """The model of the documents outside the held-out fold, one row for each slice and kind: write it as Parquet to keep it."""
    layout = B.blocks(docs, text, doc, fan=fan)

    def merge(table: pa.Table) -> pa.Table:
        rows = B.read(table)
        own = rows[0][0]
        key, c = _merged_words([r for r in rows if r[2] == WORDS])
        bigrams = _bigram_message(own, MODEL, *_merged_bigrams([_bigrams(r) for r in rows if r[2] == BIGRAMS]))
        return B.messages([bigrams, (own, MODEL, WORDS, int((c > 0).sum()), B.pack(key[c > 0]), B.pack_counts(c[c > 0]))])

    counted = _counted(layout.rows, layout.slices, layout.to_slices, fold)
    return counted.groupBy("slice").applyInArrow(B.lean(merge), B.MESSAGE).withColumn("slices", F.lit(layout.slices))


def score_with(model: DataFrame, docs: DataFrame, text: str = "text", doc: str = "doc_id", fan: int = B.FAN) -> DataFrame:
    """``model_scores`` of documents by a model from ``train_model``; all count as held out."""
    first = model.select("slices").limit(1).collect()
    layout = B.blocks(docs, text, doc, fan=fan, slices=first[0][0] if first else 0)
    none = lambda _: True
    asked = _counted(layout.rows, layout.slices, layout.to_slices, none)
    return _scored(layout, asked.unionByName(model.drop("slices")), none)


def model_scores(docs: DataFrame, text: str = "text", doc: str = "doc_id", fold: Callable[[int | None], bool] = held_out, fan: int = B.FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for every row."""
    layout = B.blocks(docs, text, doc, fan=fan)
    return _scored(layout, _counted(layout.rows, layout.slices, layout.to_slices, fold), fold)


def _scored(layout: B.Layout, counted: DataFrame, fold: Callable[[int | None], bool]) -> DataFrame:
    """Scores of the blocks' documents by the counts at the slices."""
    base, n, to_slices, to_blocks = layout.rows, layout.slices, layout.to_slices, layout.to_blocks

    def answers(table: pa.Table) -> pa.Table:
        rows = [r for r in B.read(table) if r[2] == BIGRAMS]
        asked = Asked(rows)
        stats = np.zeros((len(asked.contexts), 4), np.uint64)  # tokens after the context; followers seen once, twice, more often
        found = [np.zeros(len(c), np.uint32) for c in asked.count]
        seen = np.zeros(4, np.int64)
        for i, j, v, _, c, answered in asked.pieces():
            for k, chosen in enumerate((c, c == 1, c == 2, c > 2)):
                stats[i:j, k] += np.bincount(v, chosen, j - i).astype(np.uint64)
            seen += histogram(c)
            for k, lo, hi, at in answered:
                found[k][lo:hi] = c[at]
        out = []
        for k, r in enumerate(rows):
            if r[1] != MODEL:
                stat = stats[np.searchsorted(asked.contexts, asked.context[k])]
                out.append((r[0], r[1], ANSWER, r[3], B.pack_counts(found[k]), B.joined(*map(B.pack_counts, stat.T))))
        return to_blocks.send(out, table["slice"][0].as_py(), np.concatenate([seen, np.zeros(8, np.int64)]))

    def continuations(table: pa.Table) -> pa.Table:
        asked = Asked([r for r in B.read(table) if r[2] == BIGRAMS])
        key, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, _, _, t, c, _ in asked.pieces():
            key, at = np.unique(np.concatenate([key, t[c > 0]]), return_inverse=True)
            times = np.bincount(at, np.append(times, np.ones(len(at) - len(times), np.int64)), len(key)).astype(np.int64)
        own = table["slice"][0].as_py()
        return to_slices.send([(s, own, CONTEXTS, hi - lo, B.pack(key[lo:hi]), B.pack_counts(times[lo:hi])) for s, lo, hi in B.parts(B.cuts(key, BITS, n), len(key)) if hi > lo], own)

    def word_answers(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [r for r in B.read(left) if r[2] == WORDS]
        if not rows:
            return B.messages([])
        key, c = _merged_words(rows)
        before, times = _merged_words(B.read(right))
        unigrams, prior = Mapped(key, count=c), Mapped(before, times=times)
        figures = np.concatenate([np.zeros(4, np.int64), [int(c.sum()), int((c > 0).sum()), int(times.sum()), len(times)], histogram(times)])
        out = []
        for r in rows:
            if r[1] != MODEL:
                k = B.unpack(r[4])
                out.append((r[0], r[1], WORD_ANSWER, r[3], B.pack_counts(unigrams.find(k, "count")[0]), B.pack_counts(prior.find(k >> _LOW, "times")[0])))
        unigrams.close()
        prior.close()
        return to_blocks.send(out, rows[0][0], figures)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        table, batch = B.opened(left)
        empty = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])
        if not len(table):
            return empty.empty_table()
        tokens = Tokens(table, batch, fold)
        rows = B.read(right)
        pair, word = ([r for r in rows if r[2] == k] for k in (ANSWER, WORD_ANSWER))
        figures = B.totals(rows)
        total, distinct, cont_total = (int(x) for x in figures[4:7])
        cont_of = np.append(figures[8:10], figures[7] - figures[8] - figures[9])
        low, high = discounts(figures[8:12]), discounts(figures[:4])

        _, at, _ = tokens.vocabulary()
        c = np.concatenate([B.unpack_counts(r[4]) for r in word]).astype(np.float64)
        cont = np.concatenate([B.unpack_counts(r[5]) for r in word])
        unknown = 1.0 / (distinct + 1)
        if cont_total:
            rest = float((low[1:] * cont_of).sum()) / cont_total
            p1 = np.maximum(cont - low[np.minimum(cont, 3).astype(np.int64)], 0) / cont_total + rest * unknown
        else:
            p1 = np.full(len(c), unknown)

        v, _, pair_at, _ = tokens.bigrams()
        found = np.concatenate([B.unpack_counts(r[4]) for r in pair]).astype(np.float64)
        stat = np.concatenate([np.stack([B.unpack_counts(y) for y in B.apart(r[5])]) for r in pair], 1).astype(np.float64)
        _, length = runs(v)
        stat = np.repeat(stat, length, 1)
        seen = np.maximum(stat[0], 1)
        gamma = np.where(stat[0] > 0, (high[1:, None] * stat[1:]).sum(0) / seen, 1.0)
        first = np.where(stat[0] > 0, np.maximum(found - high[np.minimum(found, 3).astype(np.int64)], 0) / seen, 0.0)
        logp = np.log10(first[pair_at] + gamma[pair_at] * p1[at])
        plain = np.log10((c + 1) / (total + (distinct + 1)))[at]
        sums = [np.add.reduceat(x, tokens.first[:-1]) for x in (logp, plain, (c > 0)[at].astype(np.int64))]
        size = np.diff(tokens.first)
        return pa.table([table["doc_id"].combine_chunks(), pa.array(tokens.held), pa.array(size), pa.array(sums[2]), pa.array(np.full(len(size), total)), pa.array(sums[1]), pa.array(sums[0]), pa.array(10 ** (-sums[0] / size))], schema=empty)

    by_slice = counted.groupBy("slice")
    pairs = by_slice.applyInArrow(B.lean(answers), B.MESSAGE)
    hops = to_slices.delivered(by_slice.applyInArrow(B.lean(continuations), B.MESSAGE))
    word_rows = by_slice.cogroup(hops.groupBy("slice")).applyInArrow(B.lean(word_answers), B.MESSAGE)
    answered = to_blocks.delivered(pairs.unionByName(word_rows))
    return base.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(B.lean(scored), OUT)
