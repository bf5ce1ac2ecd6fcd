"""The sliced model against a plain dictionary implementation."""

import math
import re
from collections import Counter, defaultdict

import numpy as np

from weftline.llm.kneser_ney import discounts, held_out, model_scores, score_with, short, train_model, unshort


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(rows):
    docs = [(d, [w for w in re.split(r"[\x20\x09-\x0D]+", lower(t)) if w] + ["</s>"]) for d, t in rows]
    train = [t for d, t in docs if not held_out(d)]
    uni, bi = Counter(w for t in train for w in t), Counter()
    for t in train:
        bi.update(zip(["<s>", *t[:-1]], t, strict=True))
    total, distinct = sum(uni.values()), len(uni)
    cont, follow = Counter(w for _, w in bi), defaultdict(list)
    for (v, _), c in bi.items():
        follow[v].append(c)
    of = lambda c: discounts(np.array([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]))
    low, high = of(cont), of(bi)
    cut = lambda d, c: d[min(c, 3)]
    ct = sum(cont.values())

    def p1(w):
        rest = sum(cut(low, c) for c in cont.values()) / ct if ct else 1
        return (max(cont[w] - cut(low, cont[w]), 0) / ct if ct else 0) + rest / (distinct + 1)

    def p2(v, w):
        if not follow[v]:
            return p1(w)
        n = sum(follow[v])
        return max(bi[v, w] - cut(high, bi[v, w]), 0) / n + sum(cut(high, c) for c in follow[v]) / n * p1(w)

    out = []
    for d, t in docs:
        s = sum(math.log10(p2(v, w)) for v, w in zip(["<s>", *t[:-1]], t, strict=True))
        b = sum(math.log10((uni[w] + 1) / (total + distinct + 1)) for w in t)
        out.append((str(d), held_out(d), len(t), sum(uni[w] > 0 for w in t), total, round(b, 6), round(s, 6)))
    vocab = [*uni, "never seen"]
    assert not uni or abs(sum(p2("a", w) for w in vocab) - 1) < 1e-9
    return sorted(out)


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double")
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in model_scores(docs).collect()]
    assert sorted(got) == brute(rows)


def test_scores_equal_the_plain_model(spark):
    rng = np.random.default_rng(7)
    vocab = ["a", "B", "c", "the", "The", "é", "x" * 30, "d", "e"]
    rows = [(i, " ".join(rng.choice(vocab + [f"r{i}"], rng.integers(0, 25)))) for i in range(120)]
    check(spark, rows + [(None, "a c"), (500, None), (501, ""), (3, rows[3][1]), (3, rows[3][1])])


def test_a_stored_model_scores_as_the_one_in_place(spark, tmp_path):
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(list("abcdefgh"), rng.integers(0, 25)))) for i in range(90)] + [(None, None)], "doc_id long, text string")
    train_model(docs).write.parquet(f"{tmp_path}/model")
    model = spark.read.parquet(f"{tmp_path}/model")
    flat = lambda d: sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9), round(r.score, 9), round(r.perplexity, 9)) for r in d.collect())
    assert flat(score_with(model, docs)) == flat(model_scores(docs))
    some = docs.where("doc_id % 3 = 0")
    assert flat(score_with(model, some)) == [r for r in flat(model_scores(docs)) if r[0] != "None" and int(r[0]) % 3 == 0]
    assert score_with(model, docs.limit(0)).count() == 0


def test_without_training_rows_and_empty(spark):
    only = [(i, "a b") for i in range(60) if held_out(i)]
    check(spark, only)
    assert model_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_keys():
    k = np.random.default_rng(1).integers(0, 2**56, 100).astype(np.uint64)
    assert (unshort(short(k)) == k).all()
