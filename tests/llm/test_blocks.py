"""Routes with hops: every message arrives once, figures are added up, and message rows grow with the input."""

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import _blocks as B
from weftline.llm.kneser_ney import model_scores
from weftline.llm.repeated_windows import Counters, Sketch, repeated_windows
from weftline.llm.suffix_dedup import repeated_substrings


def carried(route, sent):
    """The messages at each group after the hops, and the rows that each step moved."""
    key, other = ("slice", "block") if route.by == 0 else ("block", "slice")
    moved, width = [sum(map(len, sent))], route.width()
    tables = sent
    while width > 1:
        width //= route.fan
        groups = {}
        for t in tables:
            for r in zip(*[t[f].to_pylist() for f in B._ARROW.names], strict=True):
                groups.setdefault((r[route.by], r[1 - route.by] // route.fan), []).append(r)
        tables = [route._again(B.messages(g), width) for g in groups.values()]
        moved.append(sum(map(len, tables)))
    out = {}
    for t in tables:
        for i in range(len(t)):
            out.setdefault(t[key][i].as_py(), []).append(t.slice(i, 1))
    return {k: B.read(pa.concat_tables(v)) for k, v in out.items()}, moved


@pytest.mark.parametrize("by, senders, total, fan", [(0, 5, 3, 4), (0, 30, 17, 4), (1, 70, 64, 4), (0, 40, 65, 4), (1, 9, 300, 3), (0, 20, 1, 2)])
def test_every_message_arrives_once(by, senders, total, fan):
    rng = np.random.default_rng(by + total)
    route, sent, want = B.Route(by, total, fan), [], {}
    for s in range(senders):
        rows = []
        for g in range(total):
            if rng.random() < 0.7:
                at = (g, s) if by == 0 else (s, g)
                rows.append((*at, 3, int(rng.integers(0, 9)), rng.bytes(3), None if g % 2 else b""))
                want.setdefault(g, []).append(rows[-1])
        if by == 0:
            rows.append((-1 - s, s, 9, 0, b"own", None))
            want.setdefault(-1 - s, []).append(rows[-1])
        sent.append(route.send(rows, s, np.array([s, 1])))
    got, _ = carried(route, sent)
    for g in range(total):
        assert B.totals(got[g]).tolist() == [sum(range(senders)), senders]
    got = {g: [r for r in rows if r[2] != B.TOTAL] for g, rows in got.items()}
    assert {g: sorted(r) for g, r in got.items() if r} == {g: sorted(r) for g, r in want.items()}


def test_rows_grow_with_the_input():
    moved = []
    for n in (256, 1024):  # four times the groups, four times the senders
        route = B.Route(0, n, 16)
        sent = [route.send([(g, s, 1, 0, b"x", None) for g in range(n)], s) for s in range(n)]
        moved.append(sum(carried(route, sent)[1]))
    assert moved[1] <= 4 * moved[0] * 1.6 and moved[1] < 1024 * 1024 / 5


def test_operators_agree_over_hops(spark):
    rng = np.random.default_rng(4)
    base = " ".join(rng.choice(list("abcdefghijkl"), 300))
    rows = [(int(rng.integers(0, 500)), " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 60))) + " " + base[int(rng.integers(0, 200)) :]) for _ in range(60)] + [(None, base), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for f in (repeated_windows, repeated_substrings, model_scores):
        flat = lambda d: sorted(str(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in d.collect())
        assert flat(f(docs)) == flat(f(docs, fan=2)), f.__name__


def test_blocks_beyond_the_coarse_borders(spark, monkeypatch):
    monkeypatch.setattr(B, "COARSE", 3)
    docs = spark.range(1000).selectExpr("id AS doc_id", "'x' AS text").unionByName(spark.createDataFrame([(None, "y")], "doc_id long, text string"))
    layout = B.blocks(docs)
    found = sorted((b, d if d is not None else 10**9) for b, d, _ in layout.rows.collect())
    assert [d for _, d in found] == sorted(d for _, d in found)  # blocks are ranges of ids
    assert 6 <= len({b for b, _ in found}) <= layout.to_blocks.total and max(b for b, _ in found) < layout.to_blocks.total


def test_count_min_never_underestimates():
    rng = np.random.default_rng(5)
    sketch = Sketch.of(3, cells=64)
    blocks = [rng.integers(0, 2**63, 50).astype(np.uint64) for _ in range(6)]
    blocks[3][:20] = blocks[1][:20]
    flags = [np.ones(len(b), bool) for b in blocks]
    for row in range(sketch.depth):
        counters = [Counters(sketch, s) for s in range(3)]
        parts = []
        for b in blocks:
            cell, inverse, count = np.unique(sketch.cells(b, row), return_inverse=True, return_counts=True)
            parts.append((cell, inverse))
            for s, lo, hi in sketch.parts(cell):
                counters[s].add(cell[lo:hi], (count > 1)[lo:hi])
        for f, (cell, inverse) in zip(flags, parts, strict=True):
            f &= np.concatenate([counters[s].repeated(cell[lo:hi]) for s, lo, hi in sketch.parts(cell)])[inverse]
    values, counts = np.unique(np.concatenate(blocks), return_counts=True)
    repeated = set(values[counts > 1].tolist())
    for b, f in zip(blocks, flags, strict=True):
        assert all(f[i] for i in range(len(b)) if int(b[i]) in repeated)
