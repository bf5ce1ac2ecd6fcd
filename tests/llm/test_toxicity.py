"""Noisy-or learning on bags: held-out accuracy, located sentences, odd inputs."""

import random

import numpy as np
import pyarrow as pa

from weftline.llm import toxicity as tx
from weftline.llm._tokens import texts, words


def corpus(n=900):
    rng = random.Random(4)
    letters = "etaoinshrdlu"
    vocab = ["".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        sents = [" ".join(rng.choices(vocab, k=rng.randint(4, 12))) + "." for _ in range(rng.randint(1, 25))]
        bad = rng.random() < 0.3
        if bad:
            k = rng.randrange(len(sents))
            sents[k] = f"{rng.choice(vocab)} {rng.choice(['Idioten', 'idiotic', 'moron'])} {rng.choice(vocab)} {rng.choice(['scum', 'scummy'])}!"
        docs.append((i, " ".join(sents), "x"))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_sentences_cover_all_words():
    batch = texts(pa.array(["a b. c d! e\nf g", "", None, "x", "no end\n\nhere ."]))
    w = words(batch)
    first, bag = tx.sentences(batch, w)
    assert first.tolist() == [0, 2, 4, 5, 7, 8, 10] and bag.tolist() == [0, 4, 4, 4, 5, 7]


def test_held_out_accuracy_and_places(spark):
    docs, labels = corpus()
    odd = [(10001, None, "x"), (10002, "", "x"), (None, "plain words here.", "x"), (3, docs[3][1], "x")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(10001, 1, None), (None, 1, 1), (4, 1, labels[4][2])], "doc_id long, quality int, toxic int")
    got = tx.toxicity(d, lab).collect()
    assert len(got) == len(docs) + len(odd)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    body = {i: t for i, t, _ in docs}
    spans = [(r.doc_id, *map(int, s.split(":"))) for r in held if r.predicted for s in r.offending.split(",") if s]
    right = [any(w in body[i][a:b].lower() for w in ("idiot", "moron", "scum")) for i, a, b in spans]
    assert len(spans) > 40 and np.mean(right) > 0.95
    assert all(r.score < 0.7 for r in got if r.doc_id in (10001, 10002, None))
    again = tx.toxicity(d, lab).collect()
    assert sorted((str(r.doc_id), r.score) for r in got) == sorted((str(r.doc_id), r.score) for r in again)


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.score, r.predicted) for r in tx.toxicity(d, none).collect()] == [(0.0, 0)] or tx.toxicity(d, none).first().score < 1e-9
    assert tx.toxicity(d.limit(0), none).count() == 0


def test_a_long_text_does_not_displace_the_others():
    assert tx.fitting([(3, 10), (1, 500), (2, 40), (4, 60), (5, 1)], 100) == ([2, 3, 5], [1, 4])
    assert tx.fitting([], 5) == ([], [])


def test_training_passes_over_texts_that_do_not_fit(spark):
    docs, labels = corpus(300)
    size = sum(len(t) for _, t, _ in docs)
    huge = [(-i, "calm words here. " * (size // 8), "x") for i in range(1, 4)]
    d = spark.createDataFrame(docs + huge, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(-i, 1, 0) for i in range(1, 4)], "doc_id long, quality int, toxic int")
    got = tx.toxicity(d, lab, tx.ToxicityParams(max_train_chars=size)).collect()
    truth = {i: t for i, _, t in labels}
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth]) > 0.95


def test_scores_equal_a_plain_noisy_or(spark):
    """The scorer against sentences, features and noisy-or written out one by one."""
    docs, labels = corpus(200)
    d = spark.createDataFrame(docs + [(-1, "A b! C", "x"), (-2, "", "x")], "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = tx.fit(tx.training_rows(d, lab))
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    punct = b".,;:!?\"'()[]{}<>*#$%&|-_/=+~`^\\@"

    def plain(text):
        keep = 1.0
        sentence, found = [], []
        for line in (text or "").lower().encode().split(b"\n"):
            for w in line.split():
                sentence.append(w)
                if w[-1:] in b".!?":
                    found.append(sentence)
                    sentence = []
            if sentence:
                found.append(sentence)
            sentence = []
        for s in found or [[]]:
            z = model.bias
            for w in s:
                core = w.strip(punct)
                for k, n in enumerate((None, 4, 5)):
                    data = np.frombuffer(core[:n] + b"\0" * 8, np.uint8)
                    h = tx.hash_ranges(data, np.array([0]), np.array([len(core[:n])]), seed=(0, 4, 5)[k])
                    z += weight.get(int(h[0] >> np.uint64(32)), 0.0)
            keep *= 1 - 1 / (1 + np.exp(-z))
        return 1 - keep

    got = {r.doc_id: r.score for r in tx.score(d, model).collect()}
    for i, t, _ in [*docs[:60], (-1, "A b! C", "x"), (-2, "", "x")]:
        assert abs(got[i] - plain(t)) < 1e-9, t


def test_filtering_keeps_clashing_columns_and_empty_tables(spark):
    docs, labels = corpus(200)
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score string, _d int")
    model = tx.fit(tx.training_rows(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    kept = tx.filtered(d, model)
    assert kept.columns == d.columns and 100 < kept.count() < 200 and tx.filtered(d.limit(0), model).count() == 0
