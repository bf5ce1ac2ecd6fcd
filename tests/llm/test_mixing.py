"""Mixing: quotas met, limits kept, least repetition, reruns agree."""

import itertools
import random

import pytest

from weftline.llm.mixing import MixParams, attached, mix, route, steps, targets


def fill(sizes, weights, max_repeats):
    """Shares by rounds: what is over its limit stays there, the rest is shared again."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > max_repeats * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / whole
            break
        for i in over:
            target[i] = float(max_repeats * sizes[i])
            open_.discard(i)
        left -= sum(target[i] for i in over)
    return target


def test_fill():
    assert fill([100, 100, 100], [1, 2, 3], 3) == pytest.approx([50, 100, 150])
    assert fill([10, 300, 10], [1, 2, 3], 3) == pytest.approx([30, 260, 30])
    assert fill([0, 0], [1, 2], 3) == [0, 0] and fill([], [], 3) == []


def test_targets_equal_the_rounds(spark):
    rng = random.Random(7)
    for n in (1, 2, 5, 9, 40):
        sizes = [rng.choice([0, 1, 5, 10, 300, 10_000]) for _ in range(n)]
        d = spark.createDataFrame([(f"s{i:02d}" if i < n - 1 else None, x) for i, x in enumerate(sizes)], "source string, size long")
        got = [r.target for r in targets(d).orderBy("k").collect()]
        assert got == pytest.approx(fill(sizes, [1 + i % 3 for i in range(n)], 3))


def cost_of(tokens, distinct, most):
    total, level, passes = 0, 0, 0
    for size in steps(distinct, most):
        total += min(tokens, size) * passes
        tokens -= min(tokens, size)
        level += 1
        passes = level if level < 3 else passes * 2
    return total


def test_route_costs_least():
    rng = random.Random(5)
    for _ in range(60):
        cells = [(p, int(k), rng.randint(1, 3)) for p in ("0", "0,1", "1") for k in p.split(",")]
        distinct = {p: rng.randint(1, max(t for q, _, t in cells if q == p)) for p in ("0", "0,1", "1")}
        most = {p: 3 * sum(t for q, _, t in cells if q == p) for p in distinct}
        quota = [rng.randint(0, 3 * sum(t for _, k, t in cells if k == s)) for s in (0, 1)]
        got = route(cells, distinct, quota, 3)
        assert [sum(v for (_, k), v in got.items() if k == s) for s in (0, 1)] == quota
        assert all(0 <= got[p, k] <= 3 * t for p, k, t in cells)
        cost = lambda f: sum(cost_of(sum(v for (p, _), v in f.items() if p == q), distinct[q], most[q]) for q in distinct)
        best = min(
            cost({("0", 0): quota[0] - x, ("0,1", 0): x, ("0,1", 1): y, ("1", 1): quota[1] - y})
            for x, y in itertools.product(range(quota[0] + 1), range(quota[1] + 1))
            if all(0 <= v <= 3 * t for (_, _, t), v in zip(cells, (quota[0] - x, x, y, quota[1] - y), strict=True))
        )
        assert cost(got) == best


@pytest.mark.parametrize("patterns", [20_000, 2])
def test_mix(spark, patterns):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)) + f" t{i}", f"s{i % 4}") for i in range(300)]
    rows += [(1000 + i, rows[i][1], f"s{(i + 1) % 4}") for i in range(60)]
    rows += [(2000, None, "s0"), (2001, "", None), (2002, "only one here", None), (None, "x y", "s1"), (5, rows[5][1], "s1"), (5, rows[5][1], "s1")]
    docs = spark.createDataFrame([(d, t, s, 0) for d, t, s in rows], "doc_id long, text string, source string, taken int")
    params = MixParams(max_patterns=patterns, broadcast_rows=0 if patterns == 2 else 100)
    got = mix(docs, params=params).collect()
    assert len(got) == len(rows)
    total = sum(len((t or "").split()) for _, t, _ in rows)
    taken, target, size = {}, {}, {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source], size[r.source] = r.target, r.source_size
    names = ["s0", "s1", "s2", "s3", None]
    assert [target[s] for s in names] == pytest.approx(fill([size[s] for s in names], [1, 2, 3, 1, 2], 3))
    assert sum(target.values()) == pytest.approx(total)
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    flat = lambda rs: sorted((str(r.doc_id), r.size, str(r.source), r.taken) for r in rs)
    assert flat(got) == flat(mix(docs.repartition(5), params=params).collect())
    drawn = attached(docs.drop("taken"), mix(docs, params=params).where("taken > 0")).collect()
    assert flat(drawn) == flat([r for r in got if r.taken]) and all(len((r.text or "").split()) == r.size for r in drawn)
    assert mix(docs.limit(0)).count() == 0


def test_attached_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "k1", 7, 9), (1, "a b c", "s", "k2", 8, 9), (2, None, "s", "k3", 9, 9)], "doc_id long, text string, source string, _key string, _turn int, taken int")
    got = attached(docs, mix(docs).where("taken > 0"))
    assert got.columns == ["doc_id", "text", "source", "_key", "_turn", "size", "source_size", "target", "taken"]
    assert {(r._key, r._turn, r.size) for r in got.collect()} <= {("k1", 7, 3), ("k2", 8, 3)} and sum(r.taken for r in got.collect()) == 6
    assert attached(docs.limit(0), mix(docs.limit(0)).where("taken > 0")).count() == 0


def test_many_patterns_are_all_routed(spark):
    """Every pattern keeps its overlap when they are dealt to many networks: shared texts are read less often."""
    rows = [(10 * i + j, f"t{i} " + "w " * (i % 7), f"s{j}") for i in range(300) for j in range(5) if (i >> j) & 1 or j == i % 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for patterns in (1, 4, 1000):
        got = mix(docs, params=MixParams(max_patterns=patterns)).collect()
        taken, target = {}, {}
        for r in got:
            taken[r.source] = taken.get(r.source, 0) + r.taken
            target[r.source] = r.target
            assert 0 <= r.taken <= 3 * r.size
        assert all(abs(taken[s] - target[s]) <= 1 for s in target)


def test_empty_texts_of_many_sources_make_no_pattern(spark):
    """They belong to every source, so their pattern would be the list of all sources on each of their rows."""
    rows = [(i, None if i % 2 else " ", f"s{i}") for i in range(400)] + [(1000 + i, "some words here", f"s{i % 3}") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    assert len(got) == 409 and sum(r.taken for r in got) == 27 and all(r.taken == 0 for r in got if r.size == 0)
