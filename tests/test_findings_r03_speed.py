"""Cheaper forms of the same functions give the same values, and none does the work the findings are about."""

import random

from pyspark.sql import functions as F

from weftline.functions import numbers, text
from weftline.operators.style import style_scan
from weftline.plans.grammar_rules import grammar_scan
from weftline.prose_queries import numeral


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_strip_looks_at_the_ends_only(spark):
    rng = random.Random(1)
    blanks = "\t\n\x0b\x0c\r\x1c \x85\xa0 ᠎ ​    　﻿"
    rows = ["".join(rng.choices(blanks + "ab—", k=rng.randint(0, 9))) for _ in range(600)] + ["", None]
    assert values(spark, text.strip(F.col("x")), rows) == values(spark, F.regexp_replace("x", r"(?U)^\s++|(?<!\s)\s++$", ""), rows)
    assert "regexp_replace" not in plan(spark.range(1).select(text.strip(F.col("id").cast("string"))))


def test_blank_lines_as_before(spark):
    rng = random.Random(2)
    rows = ["".join(rng.choices("a\n \t\xa0\r", k=rng.randint(0, 12))) for _ in range(600)]
    bare = F.regexp_replace("x", r"(?mU)(?<![^\S\n])[^\S\n]+$", "")
    old = F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    assert values(spark, text.collapse_blank_lines(F.col("x")), rows) == values(spark, old, rows)


def test_numerals_of_any_form_as_the_fold_reads_them(spark):
    rng = random.Random(3)
    rows = ["".join(rng.choices("〇一二九十百千万億", k=rng.randint(0, 6))) for _ in range(1_500)] + ["", None, "3", "a一", "二e", "一\n", "千百十一億千百十一万千百十一"]
    assert values(spark, numbers.ja_value(F.col("x")), rows) == values(spark, numbers._folded_value(F.col("x")), rows)
    n = [rng.randrange(10 ** rng.randint(1, 12)) for _ in range(500)] + [0, 1, 10, 10_000, 100_000_000, 10**12 - 1]
    assert values(spark, numbers.ja_value(numeral(F.col("x"))), n, "x long") == [v or None for v in n]
    assert values(spark, numeral(F.col("x")), [0, 10, 10_000, 310_020_405, None], "x long") == ["", "十", "一万", "三億千二万四百五", ""]


def test_sentences_are_cut_only_where_a_check_needs_them(spark):
    d = spark.createDataFrame([(1, 1, "He was taken by the man. Fine.", "Он потерялся. Да. Он был сломан 3 раза."), (1, 2, "No.", "Мы были. Они устали 12")], "doc_id int, block_no int, en string, ed_ru string")
    found = {(r.block_no, r.kind): r.source for r in grammar_scan(d).collect()}
    assert found == {(1, "voice"): "He was taken by the man.", (1, "passive-ru"): "He was taken by the man.", (1, "numbers"): ""}
    assert " AS ss#" not in plan(grammar_scan(d)) and " AS ts#" not in plan(grammar_scan(d))


def test_style_sorts_long_words_without_a_comparator(spark):
    words = "слово словарь слово словно абв абв абв словарь очень очень мир".split()
    d = spark.createDataFrame([(1, 1, " ".join(words)), (1, 2, "слово " * 5_000), (1, 3, "")], "doc_id int, para_no int, text string")
    found = {(r.para_no, r.kind, r.word, r.n) for r in style_scan(d).collect()}
    assert found == {
        (1, "REPETITION", "слово", 2), (1, "REPETITION", "словарь", 2), (1, "REPETITION", "очень", 2), (1, "REDUNDANCY", "очень", 2),
        (1, "ROOT_REPETITION", "словарь … словно", 3), (2, "REPETITION", "слово", 5_000),
    }
    assert "array_sort" not in plan(style_scan(d))
