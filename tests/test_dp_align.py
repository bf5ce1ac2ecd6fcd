"""Alignment by dynamic programming against the whole table, its space, and its blocks."""

import os
import random
import subprocess
import sys
from fractions import Fraction
from pathlib import Path

from weftline.operators.dp_align import STEPS, UNIT, AlignParams, Chapter, align, attached, dp_aligned


def plain(left, right, p=AlignParams()):
    """Best total over all ways, cell by cell, in whole numbers."""
    n, m = len(left), len(right)
    scale = sum(s for s, _ in right), max(1, sum(s for s, _ in left))

    def gain(a, b):
        if not a or not b:
            return p.skip
        x, y = sum(s for s, _ in a) * scale[0], sum(s for s, _ in b) * scale[1]
        s, t = set().union(*(k for _, k in a)), set().union(*(k for _, k in b))
        alike = int(Fraction(UNIT * min(x, y), max(x, y))) if max(x, y) else UNIT
        return (p.anchor_weight * len(s & t) // len(s | t) if s | t else 0) + alike + p.merge * (len(a) + len(b) - 2)

    best = {(0, 0): 0}
    for i in range(n + 1):
        for j in range(m + 1):
            ways = [best[i - a, j - b] + gain(left[i - a : i], right[j - b : j]) for a, b in STEPS if i >= a and j >= b]
            if ways:
                best[i, j] = max(ways)
    return best[n, m]


def texts(rng, n, cut=0.1):
    left, right = [], []
    for i in range(n):
        size, keys = rng.randint(5, 400), {f"k{rng.randrange(n)}" for _ in range(rng.randrange(3))}
        left.append((size, keys))
        turn = rng.random()
        if turn < cut:
            continue
        part = (max(1, int(size * rng.uniform(0.8, 1.4))), set(list(keys)[: rng.randint(0, 2)]))
        right += [(part[0] // 2, part[1]), (part[0] - part[0] // 2, set())] if turn < 3 * cut else [part]
    return left, right


def covered(steps, n, m):
    ends = [(0, 0), *[(s[1], s[3]) for s in steps]]
    assert [(s[0], s[2]) for s in steps] == ends[:-1] and ends[-1] == (n, m)


def test_equals_the_whole_table():
    rng = random.Random(1)
    for _ in range(60):
        left, right = texts(rng, rng.randint(0, 25), rng.choice([0.05, 0.3]))
        steps = align(left, right)
        covered(steps, len(left), len(right))
        assert abs(sum(s[4] for s in steps) - plain(left, right)) <= len(steps)  # a quotient of doubles may fall short of a whole millionth
        assert steps == align(left, right, AlignParams(exact=True))


def test_a_narrow_band_is_widened():
    """A third of the left is missing on the right, far from the diagonal."""
    rng = random.Random(2)
    left = [(rng.randint(50, 300), {f"k{i}"}) for i in range(600)]
    right = left[:100] + left[300:]
    chapter = Chapter(left, right, AlignParams())
    assert chapter.path(16)[2]  # the path runs into the band's border
    steps = align(left, right, AlignParams(band=16))
    assert steps == align(left, right, AlignParams(exact=True))
    assert sum(s[0] == s[1] - 1 and s[2] == s[3] for s in steps) == 200


def test_fifty_thousand_paragraphs_in_linear_space():
    """In a process of its own, whose peak is measured; only its imports and inputs come before."""
    program = """
import random, resource, sys
from tests.test_dp_align import covered, texts
from weftline.operators.dp_align import AlignParams, align
left, right = texts(random.Random(3), 50_000, 0.02)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
steps = align(left, right, AlignParams(band=128))
covered(steps, len(left), len(right))
assert sum(s[1] - s[0] == 1 and s[3] > s[2] for s in steps) > 0.7 * len(steps)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    root = Path(__file__).resolve().parent.parent
    out = subprocess.run([sys.executable, "-c", program], capture_output=True, text=True, check=True, cwd=root, env=os.environ | {"PYTHONPATH": str(root)})
    assert int(out.stdout) < 200_000  # KB


def test_sides_missing_and_blocks(spark):
    rows = [("a", "x", i, 10, ["k1"] if i == 2 else []) for i in range(1, 4)] + [("a", "y", 5, 10, ["k1"]), ("b", "x", 1, 5, None), ("c", "y", 1, None, []), ("d", "z", 1, 1, [])]
    d = spark.createDataFrame(rows, "doc_id string, lang string, para_no int, size int, anchors array<string>")
    got = dp_aligned(d, "x", "y")
    steps = sorted(map(tuple, got.select("doc_id", "pair_no", "left_from", "left_to", "right_from", "right_to").collect()))
    assert steps[-2:] == [("b", 1, 1, 1, None, None), ("c", 1, None, None, 1, 1)]
    blocks = sorted(map(tuple, attached(got).collect()))
    assert blocks == [("a", 1, 1, 3, 5, 5), ("b", 1, 1, 1, None, None), ("c", 1, None, None, 1, 1)]
