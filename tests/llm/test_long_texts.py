"""Texts of over a megabyte through the operators that hold documents in blocks or bags."""

import random

import pytest

from weftline.llm.bag_minhash import near_duplicates
from weftline.llm.decontaminate import leaks
from weftline.llm.kneser_ney import model_scores
from weftline.llm.mixing import mix
from weftline.llm.repeated_windows import repeated_windows
from weftline.llm.suffix_dedup import repeated_substrings

RNG = random.Random(9)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(3, 9))) for _ in range(60_000)]
LONG = " ".join(RNG.choice(WORDS) for _ in range(180_000))
ITEM = "which of these nine rivers runs past the old stone mill before it meets the northern sea at last"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "a"), (2, LONG, "b"), (3, LONG[:600_000] + " " + ITEM + " " + LONG[600_000:], "a"), (4, "a short text of seven words only", "b"), (None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_substrings(docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeated_substrings(docs).collect()}
    n = len(LONG)
    assert n > 1 << 20 and got[1] == (n, 0) and got[2] == (n, n) and got[4][1] == 0
    assert n <= got[3][1] < got[3][0] and got[3][0] - got[3][1] <= len(ITEM) + 2


def test_windows(docs):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in repeated_windows(docs).collect()}
    assert got[1] == (180_000, 0) and got[2] == (180_000, 180_000) and got[4] == (7, 0) and got[None] == (0, 0)
    assert got[3][0] - got[3][1] in range(len(ITEM.split()) - 1, len(ITEM.split()) + 3)


def test_language_model(docs):
    got = {r.doc_id: r.n_tokens for r in model_scores(docs).collect()}
    assert got == {1: 180_001, 2: 180_001, 3: len(LONG[:600_000].split()) + len(ITEM.split()) + len(LONG[600_000:].split()) + 1, 4: 8, None: 1}


def test_near_duplicates(docs):
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, None: None}


def test_leaks(spark, docs):
    items = spark.createDataFrame([(7, ITEM), (8, "an item that no document of this table holds anywhere in it")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(docs, items).collect()} == {(3, 7)}


def test_mixture(docs):
    got = {r.doc_id: (r.size, r.taken) for r in mix(docs).collect()}
    assert got[1][0] == 180_000 and got[None] == (0, 0) and all(0 <= t <= 3 * n for n, t in got.values())
