"""BagMinHash against the weighted Jaccard similarity, and classes against brute force."""

from collections import Counter

import numpy as np
import pyarrow as pa

from weftline.llm import bag_minhash as bm
from weftline.llm._tokens import texts


def bag(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_registers_agree_with_the_similarity_without_bias():
    rng = np.random.default_rng(3)
    n, keys = 2, rng.integers(0, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    got = []
    for t in range(30):
        k = np.sort(bm.mix(keys + np.uint64(t)))
        best = bm.signatures(np.repeat([0, 1], 60), np.tile(k, 2), np.concatenate([a, b]), n, 256)
        got.append((best[0] == best[1]).mean())
    assert abs(np.mean(got) - want) < 0.02


def test_multisets_equal_counters():
    rng = np.random.default_rng(4)
    rows = [None, "", "a b", "x\x0by z w v u"] + [" ".join(rng.choice(list("abc"), rng.integers(0, 40))) for _ in range(50)]
    row, _, count = bm.multisets(texts(pa.array(rows)), 5)
    for i, t in enumerate(rows):
        assert sorted(count[row == i].tolist()) == sorted(bag(t).values())


def test_blocks_link_each_pair_of_components_once():
    rng = np.random.default_rng(6)
    base = np.sort(rng.integers(0, 2**63, 100).astype(np.uint64))
    bags = [base, np.sort(np.append(base[5:], rng.integers(0, 2**63, 5).astype(np.uint64))), np.sort(rng.integers(0, 2**63, 100).astype(np.uint64)), base[:95]]
    pack = lambda h: h.tobytes() + np.ones(len(h), np.uint32).tobytes()
    rows = {"key": list("abcd"), "comp": list("abca"), "bag": [pack(h) for h in bags], "own": [0, 1, 0, 1], "i": [0] * 4, "j": [1] * 4}
    assert bm._block_links(pa.table(rows), 0.8).to_pylist() == [{"a": "b", "b": "a"}]


def test_classes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    rows = [(None, ""), (1, ""), (2, None), (3, "short text"), (4, "short text"), (4, "short text")]
    at = 10
    for _ in range(12):
        base = rng.choice(vocab, 120).tolist()
        for _ in range(int(rng.integers(1, 7))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(0, 120))] = "edit%d" % rng.integers(0, 10**6)
            rows.append((at, " ".join(copy)))
            at += 1
    for _ in range(4):  # chains: far ends are apart, so a leader cannot link them all
        text = rng.choice(vocab, 120).tolist()
        for step in range(9):
            rows.append((at, " ".join(text)))
            at += 1
            for k in range(2):
                text[12 * step + 6 * k + 3] = f"step{step}{k}"
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, key string")
    got = bm.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= 0.8:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    want = sorted((str(d), min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g)
    assert sorted((str(r.doc_id), r.class_id, r.class_size) for r in got) == want
    kept = bm.kept(docs).collect()
    assert len(kept) == len(groups) and kept[0].__fields__ == ["doc_id", "text", "key"]
    assert bm.near_duplicates(docs.limit(0)).count() == 0


def crowded_pair():
    """(base, edited, rows): two alike texts that share one band and no key of two, in a bucket led by a class unlike both."""
    rng = np.random.default_rng(11)
    params = bm.NearParams()

    def edit(words, places):
        out = list(words)
        for p in places:
            out[p] = "edit%d" % rng.integers(0, 10**9)
        return out

    def bands(rows):
        row, key, count = bm.multisets(texts(pa.array([" ".join(r) for r in rows])), 5)
        return bm.band_keys(bm.signatures(row, key, count, len(rows), params.registers), params.bands)

    while True:
        a = ["w%d" % x for x in rng.integers(0, 10**6, 200)]
        b = edit(a, [20, 60, 100, 140])
        ka, kb = bands([a, b])
        shared = np.flatnonzero(ka == kb)
        if len(shared) != 1:
            continue
        band = int(shared[0])
        others = [edit(a, [10, 30, 50, 70, 90, 110, 130, 150]) for _ in range(60)]
        c = next((o for o, k in zip(others, bands(others), strict=True) if k[band] == ka[band]), None)
        if c is None:
            continue
        near = [edit(c, [170 + 3 * i]) for i in range(8)]
        rows = [" ".join(r) for r in (a, b, c, *near)]
        keys = bands([a, b, c, *near])
        met = (keys[:, None] == keys[None]).sum(1)  # classes in each bucket of each row
        met = np.where(met > 1, met, 0).sum(1)
        low = max(jaccard(bag(x), bag(y)) for x in rows[:2] for y in rows[2:])
        if low < 0.8 <= jaccard(bag(rows[0]), bag(rows[1])) and met[2] > max(met[:2]):
            return rows


def test_a_pair_with_one_band_under_a_third_class_is_found(spark):
    rows = crowded_pair()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    # Blocks of one unit, and so small that every bucket is a unit of many blocks.
    for params in (bm.NearParams(), bm.NearParams(block_bytes=9000)):
        got = {r.doc_id: r.class_id for r in bm.near_duplicates(docs, params=params).collect()}
        assert got == {0: 0, 1: 0} | dict.fromkeys(range(2, len(rows)), 2)


def test_kept_keeps_clashing_columns_and_empty_tables(spark):
    rows = [(1, "a b c d e f", "x", 1, 2, 3), (2, "a b c d e f", "y", 1, 2, 3), (2, "a b c d e f", "z", 1, 2, 3), (None, None, "w", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, _d int, _k int, _n int")
    got = bm.kept(docs)
    assert got.columns == docs.columns and {(r.doc_id, r.key) for r in got.collect()} == {(1, "x"), (None, "w")}
    assert bm.kept(docs.limit(0)).count() == 0


def test_components_of_stars_and_chains(spark, monkeypatch):
    from weftline.llm import _components as co

    edges = [(f"c{i % 3}", f"n{i:03d}") for i in range(90)] + [(f"x{i:02d}", f"x{i + 1:02d}") for i in range(30)] + [("c1", "x30"), ("y", "y")]
    parent = {}

    def find(a):
        while parent.get(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {n: find(n) for e in edges for n in e if find(n) != n}
    d = spark.createDataFrame(edges, "a string, b string")
    for hot in (1000, 8):  # with and without broadcast centres
        monkeypatch.setattr(co, "HOT", hot)
        assert {r.a: r.b for r in co.components(d, "test-stars").collect()} == want
