"""Numbers in text.  Values stay digit strings without leading zeros, so no length overflows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import fold, let

# Roots of the Russian numerals 1 to 10.
NUMERAL_ROOTS = {
    1: ("один", "одн", "перв"),
    2: ("два", "две", "двух", "втор"),
    3: ("три", "трёх", "трех", "трет"),
    4: ("четыр", "четвёрт", "четверт"),
    5: ("пят", "пяти"),
    6: ("шест",),
    7: ("сем", "седьм"),
    8: ("восем", "восьм"),
    9: ("девят",),
    10: ("десят",),
}
# Words that stand for round numbers, by the zeros they need.
ROUND_WORDS = {3: ("тысяч",), 2: ("сот", "сто"), 6: ("миллион",)}
# Japanese digits and multipliers.
JA_DIGITS = "〇一二三四五六七八九"
JA_SMALL = {"十": 10, "百": 100, "千": 1000}
JA_LARGE = {"万": 10_000, "億": 100_000_000}
JA_MARKS = "0123456789abcde"  # how the digits, 十, 百, 千, 万 and 億 are written for the usual form
_SECTION = "(?:[0-9]?c)?(?:[0-9]?b)?(?:[0-9]?a)?[0-9]?"
JA_USUAL = rf"^(?:{_SECTION}e)?(?:{_SECTION}d)?{_SECTION}\z"
JA_NUMERAL = "[" + JA_DIGITS + "".join(JA_SMALL) + "".join(JA_LARGE) + "]+"
NUMBER = r"\d(?:[\d,.\s]*\d)?"
JA_LIKELY = "[0-9〇一-百]"  # digits and the range of the numerals, which tells most texts without one


def ungrouped(c: Column) -> Column:
    """10,000 and 9 000 as 10000 and 9000."""
    return F.regexp_replace(c, "(?<=\\d)[,\u00a0 ](?=\\d{3}\\b)", "")


def without_zeros(c: Column) -> Column:
    return F.regexp_replace(c, r"^0+(?=\d)", "")


def numbers(c: Column) -> Column:
    """Distinct numbers of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(ungrouped(c), F.lit(r"\d+"), F.lit(0)), without_zeros))


def confirmed(number: Column, text: Column) -> Column:
    """Whether a text holds the number: as digits, as a numeral's root, or as a round number's word."""
    low = fold(text)
    found = F.array_contains(numbers(text), number)
    for n, roots in NUMERAL_ROOTS.items():
        found = found | ((number == str(n)) & low.rlike("|".join(roots)))
    for zeros, names in ROUND_WORDS.items():
        found = found | ((F.length(number) > 1) & number.endswith("0" * zeros) & low.rlike("|".join(names)))
    return found


def unconfirmed(source: Column, target: Column) -> Column:
    """The source's numbers that the target does not confirm."""
    return F.filter(numbers(source), lambda n: ~confirmed(n, target))


def ja_value(c: Column) -> Column:
    """A Japanese numeral as a number; null for none or zero.

    A multiplier without a digit counts once.  Numerals of the usual form (multipliers fall, one digit at each) become
    decimal digits by patterns; any other text is one fold over its characters.
    """
    usual = F.translate(c, JA_DIGITS + "".join(JA_SMALL) + "".join(JA_LARGE) + JA_MARKS, JA_MARKS)
    return let(usual, lambda t: F.when(t.rlike(JA_USUAL), let(_decimal(t), _usual_value)).otherwise(_folded_value(c)))


def _decimal(t: Column) -> Column:
    """Sections of a usual numeral as decimal digits, before the marks e (億) and d (万)."""
    ones = F.regexp_replace(t, "(?<![1-9])0?([abc])", "1$1")
    for mark, after, none in (("c", "[0-9]b", "c0b"), ("b", "[0-9]a", "b0a"), ("a", "[0-9]", "a0")):
        ones = F.regexp_replace(ones, f"{mark}(?!{after})", none)
    return F.translate(ones, "abc", "")


def _usual_value(v: Column) -> Column:
    number = lambda x: F.concat(F.lit("0"), x).cast("long")
    part = lambda x, mark, unit: F.when(x.contains(mark), F.greatest(number(F.substring_index(x, mark, 1)), F.lit(1)) * unit).otherwise(F.lit(0).cast("long"))
    rest = F.substring_index(v, "e", -1)
    return F.nullif(part(v, "e", JA_LARGE["億"]) + part(rest, "d", JA_LARGE["万"]) + number(F.substring_index(rest, "d", -1)), F.lit(0).cast("long"))


def _folded_value(c: Column) -> Column:
    zero = F.lit(0).cast("long")
    state = F.struct(zero.alias("total"), zero.alias("section"), zero.alias("num"))

    digits = F.create_map(*[F.lit(x) for i, d in enumerate(JA_DIGITS) for x in (d, i)])
    small = F.create_map(*[F.lit(x) for k, v in JA_SMALL.items() for x in (k, v)])
    large = F.create_map(*[F.lit(x) for k, v in JA_LARGE.items() for x in (k, v)])

    def fold_in(a: Column, ch: Column) -> Column:
        total, section, num = a["total"], a["section"], a["num"]
        one = lambda v: F.when(v == 0, F.lit(1).cast("long")).otherwise(v)
        d, s, w = F.try_element_at(digits, ch), F.try_element_at(small, ch), F.try_element_at(large, ch)
        return F.struct(
            F.when(w.isNotNull(), total + one(section + num) * w).otherwise(total).alias("total"),
            F.when(w.isNotNull(), zero).when(s.isNotNull(), section + one(num) * s).otherwise(section).alias("section"),
            F.when(d.isNotNull(), d.cast("long")).when(s.isNotNull() | w.isNotNull(), zero).otherwise(num).alias("num"),
        )

    value = F.aggregate(F.split(c, ""), state, fold_in, lambda a: a["total"] + a["section"] + a["num"])
    return F.nullif(value, zero)


def number_anchors(c: Column, lang: str) -> Column:
    """Language-free marks of the numbers in a text: NUL and the value."""
    ja, text = lang == "ja", F.coalesce(c, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(f"{NUMBER}|{JA_NUMERAL}" if ja else NUMBER), F.lit(0))

    def values(found: Column) -> Column:
        digits = F.filter(found, lambda m: m.rlike(r"^\d")) if ja else found
        own = F.transform(digits, lambda m: without_zeros(F.regexp_replace(m, r"[,.\s]", "")))
        if not ja:
            return own
        numerals = F.transform(F.filter(found, lambda m: ~m.rlike(r"^\d")), lambda m: ja_value(m).cast("string"))
        return F.concat(own, F.filter(numerals, lambda v: v.isNotNull()))

    known = F.when(text.rlike(JA_LIKELY), runs).otherwise(F.array().cast("array<string>")) if ja else runs
    return F.array_distinct(F.transform(let(known, values), lambda v: F.concat(F.lit("\x00"), v)))
