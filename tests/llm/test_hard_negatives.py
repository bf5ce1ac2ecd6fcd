"""Hard negatives against all products, and the bound that ends them early."""

import math
import random

import numpy as np
import pyarrow as pa

from weftline.llm.hard_negatives import RESULT, Best, Block, MiningParams, hard_negatives, nearest, scaled_vectors, survivors

SCHEMA = "vec_id long, embedding array<float>, label int, anchor int, id int, v int"


def brute(rows):
    """All anchors against all rows, in Python integers."""
    own = []
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        own.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in x]))
    out = []
    for i, (a, la, x) in enumerate(own):
        if a % 50:
            continue
        score = sorted((-sum(p * q for p, q in zip(x, y, strict=False)), b, lb) for j, (b, lb, y) in enumerate(own) if j != i)
        for s, p, _ in [t for t in score if t[2] == la][:5]:
            near = [t for t in score if t[2] != la and 50 * -s <= 100 * -t[0] <= 95 * -s][:3]
            out += [(a, p, k, b, -s, -t) for k, (t, b, _) in enumerate(near, 1)]
    return sorted(out)


def vectors(rng, n, d=8):
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(10)]
    out = []
    for i in range(n):
        c = rng.randrange(10)
        x = [y + rng.gauss(0, 0.6) for y in centres[c]]
        size = math.sqrt(sum(y * y for y in x))
        out.append((i, [y / size for y in x], c))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, x, y, 1, 2, 3) for i, x, y in rows], SCHEMA)


def test_equals_all_products(spark):
    rows = vectors(random.Random(1), 700)
    got = sorted(map(tuple, hard_negatives(scaled_vectors(frame(spark, rows))).collect()))
    assert got == brute(rows) and len(got) > 50


def test_many_small_cells_agree(spark):
    rows = vectors(random.Random(2), 400)
    found = hard_negatives(scaled_vectors(frame(spark, rows)), MiningParams(cell_values=128, cell_rows=1, levels=(0.1, 0.4, 0.7)))
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_cases(spark):
    rng = random.Random(3)
    rows = vectors(rng, 120, 4)
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 1), (250, [0.1, None, 0.2, 0.3], 1), (300, [nan, 0.1, 0.1, 0.1], 1), (350, [inf, 0.1, 0.1, 0.1], 1), (None, [0.5] * 4, 1), (400, [0.5] * 4, None)]
    rows += [(500, [], 3), (501, [0.9], 3), (-50, [0.5, 0.5, 0.1], 3), (502, [-0.9, 0.2, 0.1, 0.1], 3), (550, [300.0, 200.0, -100.0, 0.5], 2)]
    rows += [rows[0], rows[0], rows[50], *rows[7:12]]  # repeated rows and a repeated anchor
    got = hard_negatives(scaled_vectors(frame(spark, rows)))
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert got.schema.simpleString() == f"struct<{','.join(':'.join(f.split()).replace('long', 'bigint') for f in RESULT.split(', '))}>"


def test_empty_and_alone(spark):
    for rows in ([], [(0, [0.5, 0.5], 1)], [(0, [0.5, 0.5], 1), (1, [0.5, 0.4], 2)], [(7, [0.5, 0.5], 1), (1, [0.5, 0.4], 1)]):
        assert hard_negatives(scaled_vectors(frame(spark, rows))).collect() == []
    huge = [(0, [1e30, 1.0], 1), (1, [0.5, 0.5], 1), (2, [0.4, 0.4], 2)]
    assert hard_negatives(scaled_vectors(frame(spark, huge))).collect() == []


def block(x, labels, q, levels, slack):
    v = [np.array(r, "<i2").tobytes() + b"\0" for r in x]
    n = len(x)
    return Block(pa.table({"row": np.arange(n), "id": np.arange(n), "label": labels, "v": pa.array(v, pa.binary())}), q, levels, slack)


def test_bound_discards_and_loses_nothing():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(600, 32)) * (120 * 0.8 ** np.arange(32))).astype(np.int64)
    q = np.linalg.qr(np.linalg.eigh(x.T @ x)[1][:, ::-1])[0]
    levels, slack = (8, 16), 1e-12
    a = block(x, np.zeros(600, np.int64), q, levels, slack)
    exact = x @ x.T
    low = np.sort(exact, 1)[:, -6]
    i, j = survivors(a, 0, 600, a, 0, 600, levels, low, None, np.ones((600, 600), bool))
    assert {(p, q) for p, q in zip(*np.nonzero(exact >= low[:, None]), strict=True)} <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert len(i) < 0.1 * exact.size
    best = nearest(a, a, levels, 5)
    np.fill_diagonal(exact, -(1 << 40))
    assert (best.score == -np.sort(-exact, 1)[:, :5]).all()


def test_best_prefers_the_smaller_id():
    best = Best(2, 2)
    best.add(np.array([0, 0, 0, 1]), np.array([5, 5, 5, 1]), np.array([9, 3, 4, 7]))
    best.add(np.array([0]), np.array([5]), np.array([1]))
    assert best.id[0].tolist() == [1, 3] and best.score[1, 0] == 1
