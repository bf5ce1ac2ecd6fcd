"""anchors of all languages come from one pass over the rows, as those of each language alone did."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.align_queries import dictionary_anchors
from weftline.functions.numbers import JA_NUMERAL, ja_value, number_anchors, without_zeros
from weftline.operators import glossary
from weftline.prose_queries import number_and_term_anchors

ROWS = "doc_id string, block_no int, ja string, en string, ru string"
ENTRIES = "key string, ja string, en string, ru string"


@pytest.mark.parametrize(("query", "name"), [(dictionary_anchors, "documents.parquet"), (number_and_term_anchors, "customer.parquet")])
def test_rows_are_read_and_written_to_python_once(spark, query, name):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(name) == 1 and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_languages_together_as_alone(spark, limit):
    rng = random.Random(7)
    words = {"ja": ["森の", "夜", "三百", "7"], "en": ["the", "Mon roi", "a", "12", "[+]", "1,000", "İb"], "ru": ["ёж", "Ёж и", "№ 5", "a"]}
    text = lambda lang: None if rng.random() < 0.1 else "".join(rng.choice([*words[lang], " ", ", ", "x"]) for _ in range(rng.randint(0, 9)))
    rows = [(rng.choice("de"), rng.randint(1, 20), *(text(lang) for lang in words)) for _ in range(120)] + [(None, 1, "夜", "the", "ёж"), ("d", None, "夜", "A", "x")]
    entries = [("k1", "森の", "the", "ёж"), ("k2", "夜", "the", "ёж и"), ("k1", "三", "MON ROI", ""), ("k1", "夜", "THE", None), ("k3", "", "[+]", "x"), (None, None, "ib", None), ("k4", "z", "a", "a")]
    letters = glossary.WHOLE.before
    want = set()
    for doc, block, *texts in rows:
        for lang, t in zip(words, texts, strict=True):
            low = lambda s: s.replace("İ", "i").lower()
            for key, *terms in entries:
                term, t = terms[list(words).index(lang)], t or ""
                if term and (term in t if lang == "ja" else re.search(f"(?<![{letters}])" + re.escape(low(term)) + f"(?![{letters}])", low(t))):
                    want.add((lang, doc, block, key))
            want |= {(lang, doc, block, "\0" + (re.sub(r"[,.\s]", "", m).lstrip("0") or "0")) for m in re.findall(r"[0-9][0-9,. ]*[0-9]|[0-9]", t)}
            want |= {(lang, doc, block, "\0" + n) for m in re.findall(JA_NUMERAL, t) if lang == "ja" for n in [{"三百": "300"}.get(m)] if n}
    data, table = spark.createDataFrame(rows, ROWS), spark.createDataFrame(entries, ENTRIES)
    got = [tuple(r) for r in glossary.anchors_by_language(data, table, {lang: lang for lang in words}, limit).select("lang", "doc_id", "block_no", "anchor").collect()]
    known = {w for w in got if not (w[0] == "ja" and (w[3] or "").startswith("\0") and w not in want)}  # numerals that met (三百三百)
    assert len(got) == len(set(got)) and known == want
    alone = {(lang, *r) for lang in words for r in glossary.anchors(data, table, lang, lang).select("doc_id", "block_no", "anchor").collect()}
    assert alone == set(got)


def test_an_empty_glossary_leaves_the_numbers(spark):
    rows = spark.createDataFrame([("d", 1, "夜3", "12 the", None)], ROWS)
    got = glossary.anchors_by_language(rows, spark.createDataFrame([], ENTRIES), {"ja": "ja", "en": "en", "ru": "ru"}).collect()
    assert {(r.lang, r.anchor) for r in got} == {("ja", "\0003"[:1] + "3"), ("en", "\0" + "12")}


@pytest.mark.parametrize("lang", ["ja", "en"])
def test_numbers_as_two_searches_find_them(spark, lang):
    rng = random.Random(8)
    d = spark.createDataFrame([("".join(rng.choices("0127,. \n\u00a0a〇一二九十百千万億人", k=rng.randint(0, 12))),) for _ in range(1_500)] + [("",), (None,), ("٣",)], "x string")
    c = F.coalesce("x", F.lit(""))
    old = F.transform(F.regexp_extract_all(c, F.lit(r"\d[\d,.\s]*\d|\d"), F.lit(0)), lambda m: without_zeros(F.regexp_replace(m, r"[,.\s]", "")))
    if lang == "ja":
        own = F.transform(F.regexp_extract_all(c, F.lit(JA_NUMERAL), F.lit(0)), lambda m: ja_value(m).cast("string"))
        old = F.concat(old, F.filter(own, lambda v: v.isNotNull()))
    old = F.array_distinct(F.transform(old, lambda v: F.concat(F.lit("\x00"), v)))
    assert [tuple(r) for r in d.select("x", number_anchors(F.col("x"), lang)).collect()] == [tuple(r) for r in d.select("x", old).collect()]
