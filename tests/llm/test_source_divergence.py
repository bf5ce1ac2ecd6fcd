"""Source divergence against a sum over every term, and how little the index emits."""

import re
from collections import Counter, defaultdict

import pytest

from weftline.llm.source_divergence import SCALE, inverted_index, shared_corrections, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, p int, q int, term int, slot int"


def brute(rows, min_docs=10, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        terms = TERM.findall((text or "").translate(lower))
        held[lang or ""].update(set(terms))
        counts[lang or "", source or ""].update(terms)
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= min_docs]
        share = lambda c, kept=kept: {t: 1 + SCALE * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in sources}
        every = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            f = lambda a, b: (a - b) ** 2 // (a + b)
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], every[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > every[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(1, *r, 1, 2, 3, 4) for r in rows], SCHEMA)


def sample():
    rows = []
    for i in range(240):
        words = [f"w{chr(97 + (i * j) % 23)}{chr(97 + j % 5)}" for j in range(i % 17)] + ["Common", "été"[: i % 3 + 1]] * (i % 4)
        rows.append((" ".join(words), ("en", "de", None, "")[i % 4], (None, "", "a", "b", "c", "Ä", "z")[i % 7]))
    return rows + [("only once here", "fr", "x"), (None, "fr", "y"), ("", "en", "silent"), ("Common", "en", "a"), ("x" * 200_000 + " Common", "en", "a")]


def test_equals_the_sum_over_every_term(spark):
    rows = sample()
    got = source_divergence(frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.parametrize("hot", [1, 2])
def test_hot_terms_in_slots(spark, hot):
    rows = sample()
    assert sorted(map(tuple, source_divergence(frame(spark, rows), min_docs=3, top=2, hot=hot).collect())) == brute(rows, 3, 2)


def test_nothing_kept_and_empty(spark):
    rows = [("a b", "en", "x"), ("c", "en", "y"), ("d", "de", "x")]
    assert sorted(map(tuple, source_divergence(frame(spark, rows)).collect())) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]
    assert source_divergence(frame(spark, [])).collect() == []


def test_large_counts_stay_exact(spark):
    """Products beyond 64 bits take the decimal way."""
    from pyspark.sql import functions as F

    from weftline.llm.source_divergence import share

    cases = [(10**16, 10**17, 5), (2**59, 2**59, 1), (0, 10**18, 10), (2**33, 2**34 + 7, 3), (7, 9, 0), (0, 0, 0)]
    d = spark.createDataFrame(cases, "c long, n long, v long").select("*", share(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    assert [r.p for r in d.collect()] == [1 + SCALE * (c + 2) // (n + 2 * v) if n + 2 * v else None for c, n, v in cases]


def test_only_corrections_are_emitted(spark):
    """Terms that one source alone uses emit nothing for any pair of sources."""
    rows = [(f"own{chr(97 + i)} shared", "en", f"s{i % 20}") for i in range(20) for _ in range(10)]
    postings, _, pairs = inverted_index(frame(spark, rows))
    assert postings.count() == 40 and pairs.count() == 190
    assert shared_corrections(postings).count() <= 190
    assert sorted(map(tuple, source_divergence(frame(spark, rows)).collect())) == brute(rows)
