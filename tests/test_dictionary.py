"""Dictionary terms against plain searches, in both ways, and the joins built on them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.operators import glossary
from weftline.operators.dictionary import LETTERS, STEM, SUBSTRING, WHOLE, Bounds, first_hits

TERMS = ["silvana", "Сильвана", "ab", "b", "abab", "x.y", "12", "森の", "mon roi", "ёж", "q\\Ey", "İstanbul", "a"]
TEXTS = [
    "7Silvana, silvana", "Silvanas Silvana", None, "", "ababab ab", "😀 сильвана Ёж x.y xzy", "森の森の", "MON ROI!", "q\\Ey 12ab12", "İİ istanbul İSTANBUL a", "девочка-Сильвана", "сильвана7 _ab ab_",
]


def plain(text, term, bounds):
    low = lambda s: s.replace("İ", "i").lower() if bounds.fold else s
    python = {LETTERS: LETTERS, STEM.before: r"\w", "": ""}
    before, after = python[bounds.before], python[bounds.after]
    m = re.search((f"(?<![{before}])" if before else "") + re.escape(low(term)) + (f"(?![{after}])" if after else ""), low(text or ""))
    return (low(term), m.start(), m.end()) if m else None


@pytest.mark.parametrize("bounds", [WHOLE, STEM, SUBSTRING, Bounds(before=LETTERS)])
@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_equals_a_search_for_each_term(spark, bounds, limit):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abAB ёЁ-7_x.") for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, [i]) for i, t in enumerate(texts)] + [(0, TEXTS[0], [0])], "n int, text string, more array<int>")
    terms = spark.createDataFrame([(t,) for t in TERMS + TERMS[:2] + ["", None]], "term string")
    got = sorted((r.n, r.term, r.start, r.end) for r in first_hits(rows, terms, "text", bounds, ("n", "more"), limit).collect())
    own = {(t.replace("İ", "i").lower() if bounds.fold else t) for t in TERMS}
    want = [(i, *hit) for i, t in [*enumerate(texts), (0, TEXTS[0])] for term in own if (hit := plain(t, term, bounds))]
    assert got == sorted(want)
    assert first_hits(rows, terms.limit(0), "text", bounds, ("n",), limit).count() == 0 and first_hits(rows.limit(0), terms, "text", bounds, ("n",), limit).count() == 0


def test_names_after_an_apostrophe(spark):
    rows = spark.createDataFrame([("d", 1, "d'Artagnan came", "д'Артаньян пришёл"), ("d", 2, "x", "А-рта и д’арт")], "doc_id string, block_no int, source string, target string")
    names = spark.createDataFrame([("арта", ["artagnan"], "Артаньян")], "ru_base string, en_forms array<string>, ru string")
    got = {(r.block_no, r.ru) for r in glossary.names_in_target(rows, names).collect()}
    assert got == {(1, "Артаньян"), (2, "Артаньян")}  # hyphens count for nothing, an apostrophe ends a token
    found = glossary.joined_names(rows.withColumn("source", F.lit("Artagnan came")), names).where("block_no = 1").first()
    assert (found.lost, found.extra) == ([], [])


def test_stems_after_a_hyphen(spark):
    p = spark.createDataFrame([("d", 1, 1, "Это девочка-Сильвана, Сильване."), ("d", 1, 2, "несильвана, 7сильвана, «сильвана-маг»")], "doc_id string, block_no int, para_no int, text string")
    stems = spark.createDataFrame([(1, "сильва", "Сильвана")], "line_no int, stem string, canon string")
    got = {r.para_no: (r.form, r.context) for r in glossary.stem_hits(p, stems).collect()}
    assert got == {1: ("Сильвана", "Это девочка-Сильвана, Сильване."), 2: ("сильвана-маг", "львана, 7сильвана, «сильвана-маг»")}


def test_anchors_beside_digits(spark):
    rows = spark.createDataFrame([("d", 1, "森で", "7Silvana7 or [+]", "Сильвана2")], "doc_id string, block_no int, ja string, en string, ru string")
    entries = spark.createDataFrame([("g:a", "森", "silvana", "сильвана"), ("g:b", "で", "[+]", "ильва")], "key string, ja string, en string, ru string")
    got = lambda lang: {r.anchor for r in glossary.anchors(rows, entries, lang, lang).collect() if r.anchor[0] == "g"}
    assert (got("ja"), got("en"), got("ru")) == ({"g:a", "g:b"}, {"g:a", "g:b"}, {"g:a"})
