"""Versions aligned as sequences: against the longest run and against edits whose truth is known."""

import random
from itertools import combinations

from weftline.operators.style import drift_aligned
from weftline.operators.versions import aligned, longest_run


def test_longest_run_equals_all_subsets():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(0, 8)
        pairs = list(zip(rng.sample(range(20), n), rng.sample(range(20), n), strict=True))
        got = longest_run(pairs)
        rising = lambda s: all(a[0] < b[0] and a[1] < b[1] for a, b in zip(s, s[1:], strict=False))
        most = max(k for k in range(n + 1) for s in combinations(sorted(pairs), k) if rising(s))
        assert rising(got) and len(got) == most and set(got) <= set(pairs)


def frame(spark, texts):
    return spark.createDataFrame([(d, i, t) for d, ts in texts.items() for i, t in enumerate(ts, 1)], "doc_id string, para_no int, text string")


def test_an_insertion_moves_nothing_else(spark):
    lines = [f"Line number {i} about thing {i * 7}" for i in range(1, 40)]
    same = ["same again"] * 6
    old = {"a": lines, "b": same + ["end"], "c": ["one two three four", "x"], "d": [], "e": ["gone one", "gone two"], "f": lines[:4], "g": ["", "—", "a b"]}
    new = {
        "a": lines[:9] + ["brand new words here"] + lines[9:], "b": same[:3] + ["no same again"] + same[4:] + ["end"], "c": ["one two three five", "y"], "d": ["added"], "e": [],
        "f": [lines[3], *lines[:3]], "g": ["—", "", "a b"],
    }
    got = {}
    for r in aligned(frame(spark, old), frame(spark, new)).collect():
        got.setdefault(r.doc_id, set()).add((r.old_no, r.new_no))
    assert got["a"] == {(i, i + (i > 9)) for i in range(1, 40)} | {(None, 10)}
    assert got["b"] == {(i, i) for i in range(1, 8)}  # six equal lines, the fourth reworded
    assert got["c"] == {(1, 1), (2, None), (None, 2)}
    assert got["d"] == {(None, 1)} and got["e"] == {(1, None), (2, None)}
    assert got["f"] == {(1, 2), (2, 3), (3, 4), (4, None), (None, 1)}
    assert {x for x, _ in got["g"]} - {None} == {1, 2, 3} and {y for _, y in got["g"]} - {None} == {1, 2, 3} and (3, 3) in got["g"]
    kinds = {(r.doc_id, r.old_no, r.new_no, r.kind) for r in drift_aligned(frame(spark, old), frame(spark, new)).collect()}
    assert {k for k in kinds if k[0] == "a"} == {("a", None, 10, "paragraph-added")}
    assert {k for k in kinds if k[0] == "f"} == {("f", 4, None, "paragraph-moved"), ("f", None, 1, "paragraph-moved")}
    empty = frame(spark, {"a": lines}).limit(0)
    assert aligned(empty, empty).count() == 0


def test_random_edits_lose_no_paragraph(spark):
    rng = random.Random(3)
    old, new = {}, {}
    for d in range(30):
        ts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 25))]
        old[str(d)] = ts
        new[str(d)] = [t if rng.random() < 0.8 else t + " new" for t in ts if rng.random() < 0.9]
    rows = aligned(frame(spark, old), frame(spark, new)).collect()
    for d in old:
        own = [(r.old_no, r.new_no) for r in rows if r.doc_id == d]
        assert sorted(x for x, _ in own if x) == list(range(1, len(old[d]) + 1)) and sorted(y for _, y in own if y) == list(range(1, len(new[d]) + 1))
        both = sorted(p for p in own if None not in p)
        assert both == sorted(both, key=lambda p: p[1])
