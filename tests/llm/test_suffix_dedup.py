"""Repeated substrings and word windows against dictionaries of all strings."""

import hashlib
import re

import numpy as np

from weftline.llm.repeated_windows import repeated_windows
from weftline.llm.suffix_dedup import SuffixParams, repeated_substrings, sliding_argmin


def place(d):
    return (d is None, d or 0)


def rows_of(rng, n=60):
    letters = list("abcd é\n")
    base = ["".join(rng.choice(letters, 400)) for _ in range(6)]
    rows = []
    for i in range(n):
        b = base[int(rng.integers(0, 6))]
        a = int(rng.integers(0, 300))
        rows.append((int(rng.integers(0, 10**6)), "".join(rng.choice(letters, rng.integers(0, 90))) + b[a : a + int(rng.integers(0, 250))] + "".join(rng.choice(letters, rng.integers(0, 60)))))
    rows += [(None, rows[3][1]), (5, None), (6, ""), (7, "x" * 700), (8, "xy" * 300), (9, base[0] + base[0]), (11, base[1]), (11, base[1]), (11, base[1][50:])]
    return rows


def brute_bytes(rows, length):
    first = {}
    data = [(place(d), (t or "").encode()) for d, t in rows]
    for d, t in data:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            first[s] = min(first.get(s, (d, p)), (d, p))
    out = []
    for (d, t), (doc, _) in zip(data, rows, strict=True):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < (d, p):
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((str(doc), len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_bytes_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = rows_of(rng)
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, block int")
    for memory in (1 << 28, 1000):
        got = repeated_substrings(docs, params=SuffixParams(memory=memory)).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_bytes(rows, 100)
    assert repeated_substrings(docs.limit(0)).count() == 0


def test_argmin():
    rng = np.random.default_rng(12)
    for _ in range(50):
        key = rng.integers(0, 6, int(rng.integers(5, 60))).astype(np.uint64) << np.uint64(32)
        assert sliding_argmin(key, 5).tolist() == [i + int(np.argmin(key[i : i + 5])) for i in range(len(key) - 4)]


def test_words_equal_brute_force(spark):
    rng = np.random.default_rng(13)
    vocab = list("abcdefgh")
    base = [rng.choice(vocab, 120).tolist() for _ in range(5)]
    rows = []
    for _ in range(80):
        b = base[int(rng.integers(0, 5))]
        a = int(rng.integers(0, 90))
        rows.append((int(rng.integers(0, 10**6)), "  ".join([*rng.choice(vocab, rng.integers(0, 9)), *b[a : a + int(rng.integers(0, 60))]])))
    rows += [(None, rows[0][1]), (1, None), (2, "\t\n"), (3, "w " * 90), (4, "x y " * 30), (5, rows[1][1]), (5, rows[1][1]), (5, rows[1][1] + " z " * 30)]
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    first = {}
    for (d, _), w in zip(rows, words, strict=True):
        for p in range(len(w) - 19):
            first[tuple(w[p : p + 20])] = min(first.get(tuple(w[p : p + 20]), (place(d), p)), (place(d), p))
    want = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = np.zeros(len(w), bool)
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] < (place(d), p):
                gone[p : p + 20] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((str(d), len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, slice int")
    got = repeated_windows(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert repeated_windows(docs.limit(0)).count() == 0
