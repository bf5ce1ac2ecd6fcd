"""Scalar functions against small tables and plain Python."""

import random
import re

from pyspark.sql import functions as F

from weftline.functions import edits, numbers, text


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(column).collect()]


def test_text(spark):
    x = F.col("x")
    assert values(spark, text.clean(x), [None, " a <!-- b\nc --> d "]) == ["", "a   d"]
    assert values(spark, text.missing(x), [None, "", "—", "a"]) == [True, True, True, False]
    assert values(spark, text.sentences(x), ["Раз. Два?!  Три", "..."]) == [["Раз.", "Два?!", "Три"], []]
    assert values(spark, text.before_apostrophe(x), ["Anna's", "Anna’s", "Anna"]) == ["Anna"] * 3
    assert values(spark, text.fold(x), ["Ёлка"]) == ["елка"]
    assert values(spark, text.collapse_blank_lines(x), ["\n\na  \n\n\n\nb\n \nc\n"]) == ["a\n\nb\n\nc"]
    assert values(spark, text.one_line(x, 5), ["a\nb", "abcdefg"]) == ["a b", "abcde…"]
    assert values(spark, text.slug(x), ["6-ch03", "v06-ch03", "v16-x", "other"]) == ["v6-ch03", "v6-ch03", "v16-x", "other"]
    assert values(spark, text.volume(x), ["v12-ch01.md", "x"]) == [12, None]
    assert values(spark, text.run_id(x), ["run 20260101-101010-ab12 now", "none"]) == ["20260101-101010-ab12", None]
    assert values(spark, text.corrupt(x), ["a�", "a"]) == [True, False]
    assert values(spark, text.table_cell(x), ["a|b\nc"]) == ["a\\|b c"]
    assert values(spark, text.replaced_all(x, {"a": "b", "b": "c"}), ["ab"]) == ["cc"]
    assert [[(m.start, m.end, m.hit) for m in ms] for ms in values(spark, text.matches(x, "[0-9]+"), ["é12 3", ""])] == [[(1, 3, "12"), (4, 5, "3")], []]


def test_matches_of_any_number_equal_the_patterns(spark):
    """Match ranges around the borders of the pieces they are summed in."""
    rng = random.Random(3)
    rows = [None, "", "no digit", "7"] + ["".join(rng.choice("é ") + "x" * rng.randrange(3) + str(rng.randrange(2000)) for _ in range(n)) for n in (31, 32, 33, 64, 65, 1023, 1024, 1025, 1090)]
    got = values(spark, text.matches(F.col("x"), "[0-9]+"), rows)
    assert got[0] is None
    assert [[(m.start, m.end, m.hit) for m in ms] for ms in got[1:]] == [[(*m.span(), m[0]) for m in re.finditer("[0-9]+", r)] for r in rows[1:]]


def test_many_matches_of_one_text(spark):
    many = F.repeat(F.lit("ab 12 "), F.lit(100_000))
    last = spark.range(1).select(text.matches(many, "[0-9]+").alias("m")).select(F.size("m").alias("n"), F.element_at("m", -1).alias("m")).first()
    assert (last.n, last.m.start, last.m.end) == (100_000, 599_997, 599_999)


def test_numbers(spark):
    x = F.col("x")
    assert [sorted(v) for v in values(spark, numbers.numbers(x), ["10,000 and 9 000, 007 and 7", "1 000 000", "4111 1111", "9" * 30])] == [
        ["10000", "7", "9000"], ["1000000"], ["1111", "4111"], ["9" * 30],
    ]
    pairs = [("three 3", "три груши"), ("3", "груши"), ("5000", "пять тысяч"), ("200", "двести, сотня"), ("2000000", "два миллиона"), ("12", "было 12"), ("12", "двенадцать")]
    d = spark.createDataFrame(pairs, "s string, t string")
    assert [r[0] for r in d.select(numbers.unconfirmed(F.col("s"), F.col("t"))).collect()] == [[], ["3"], [], [], [], [], ["12"]]
    assert values(spark, numbers.ja_value(x), ["一万二千", "十", "〇", "百二十三", "二億三千万五", ""]) == [12000, 10, None, 123, 230000005, None]
    assert [sorted(v) for v in values(spark, numbers.number_anchors(x, "ja"), ["一万円と5,000", None])] == [["\x0010000", "\x005000"], []]


def test_patches(spark):
    plan = F.array(F.struct(F.lit("a").alias("old"), F.lit("bb").alias("new"), F.lit(2).alias("count")), F.struct(F.lit("bb").alias("old"), F.lit("").alias("new"), F.lit(None).cast("int").alias("count")))
    got = values(spark, edits.patched(F.col("x"), plan), ["a-a-b", "a", "zz"])
    assert [(r.text, r.counts, r.ok) for r in got] == [("--b", [2, 2], True), ("", [1, 1], False), ("zz", [0, 0], False)]


def test_guarded_names(spark):
    got = values(spark, edits.names_replaced(F.col("x"), {"анна": "ганна", "анной": "ганной"}), ["анна с анной\nанна или ганна\nжанна", "x"])
    assert [(r.text, r.n) for r in got] == [("ганна с ганной\nанна или ганна\nжанна", 2), ("x", 0)]
