"""Text functions.  Regexes carry (?U) so that letters, blanks and borders follow Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "—"  # how a missing field is printed
MATCH = "struct<start:int,end:int,hit:string>"


# Fixed value: Unicode white space.
SPACES = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end (``trim`` alone only knows the blank).

    Only the ends are looked at; a regex would try every place of the text.
    """
    return F.trim(c, F.lit(SPACES))


def clean(c: Column) -> Column:
    """HTML comments become a blank, then strip; null is empty."""
    whole = F.coalesce(c, F.lit(""))
    return strip(F.when(whole.contains("<!--"), F.regexp_replace(whole, r"(?s)<!--.*?-->", " ")).otherwise(whole))


def missing(c: Column) -> Column:
    return c.isNull() | c.isin("", EMPTY)


def sentences(c: Column) -> Column:
    """Runs up to sentence-final marks, stripped, empty ones dropped."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"[^.!?…]+[.!?…]*"), F.lit(0)), strip), lambda s: s != "")


def words(c: Column, letters: str = r"\p{L}") -> Column:
    """Tokens of two characters or more: a letter, then letters, apostrophes or hyphens."""
    return F.regexp_extract_all(c, F.lit(f"[{letters}][{letters}'’\\-]+"), F.lit(0))


def before_apostrophe(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^'’]*", 0)


def fold(c: Column) -> Column:
    """Lower case, with the Cyrillic io as ie."""
    return F.replace(F.lower(c), F.lit("ё"), F.lit("е"))


# Letters whose upper case is several characters by the full mapping, but one by the simple one.
_ONE_UPPER = {"ß": "ẞ", **{chr(b + i): chr(b + i + 8) for b in (0x1F80, 0x1F90, 0x1FA0) for i in range(8)}, "ᾳ": "ᾼ", "ῃ": "ῌ", "ῳ": "ῼ"}


def upper_letters(c: Column) -> Column:
    """Upper case letter by letter: a letter becomes one letter, or stays (``upper`` makes SS of ß)."""
    known = F.translate(c, "".join(_ONE_UPPER), "".join(_ONE_UPPER.values()))
    one = lambda x: F.when(F.length(F.upper(x)) == 1, F.upper(x)).otherwise(x)
    return F.array_join(F.transform(F.split(known, ""), one), "")


def without_space(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"(?U)\s+", "")


def collapse_blank_lines(c: Column) -> Column:
    """Lines right-stripped, runs of blank lines as one, none at the ends."""
    bare = F.regexp_replace(c, r"(?mU)[^\S\n](?<![^\S\n]{2})[^\S\n]*$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def one_line(c: Column, limit: int = 160) -> Column:
    flat = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("…"))).otherwise(flat)


def table_cell(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def corrupt(c: Column) -> Column:
    """Replacement characters or NUL: a sign of a broken encoding."""
    return c.contains("\ufffd") | c.contains("\x00")


def slug(c: Column) -> Column:
    """6-ch03 and v06-ch03 become v6-ch03."""
    n = F.regexp_extract(c, r"^v?0*(\d+)-(.+)$", 1)
    return F.when(n != "", F.concat(F.lit("v"), n, F.lit("-"), F.regexp_extract(c, r"^v?0*(\d+)-(.+)$", 2))).otherwise(c)


def volume(c: Column) -> Column:
    return F.regexp_extract(c, r"v(\d{1,3})-", 1).try_cast("int")


def run_id(c: Column) -> Column:
    """The run id in a prompt: date, time and four hex digits; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"\b(\d{8}-\d{6}-[0-9a-f]{4})\b", 1), F.lit(""))


def required_run_id(c: Column) -> Column:
    """``run_id``, an error where there is none."""
    return F.coalesce(run_id(c), F.raise_error(F.concat(F.lit("no run id in: "), F.left(F.coalesce(c, F.lit("")), F.lit(80)))).cast("string"))


def has_dialogue(c: Column, marks: str = "「」『』") -> Column:
    """Whether a text has one of the marks of speech (characters)."""
    return F.coalesce(c.rlike("[" + "".join(escaped(m) for m in marks) + "]"), F.lit(False))


def first_of_list(items: Column, most: int = 10) -> Column:
    """A list for a report: its first items, and how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(more > 0, F.format_string(" (+%d)", more)).otherwise(""))


def replaced_all(c: Column, pairs: dict[str, str]) -> Column:
    """Literal replacements one after another."""
    for old, new in pairs.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside it the value is a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def runs(items: Column) -> Column:
    """array<struct<value, at, n>>: the runs of equal neighbours of an array, where each begins (from 0) and how long it is."""
    heads = lambda s: F.filter(F.transform(s, lambda x, i: F.struct(x.alias("value"), i.alias("at"))), lambda e: (e["at"] == 0) | (F.get(s, e["at"] - 1) != e["value"]))
    size = lambda x, e, j: F.coalesce(F.get(x["h"], j + 1)["at"], F.size(x["s"])) - e["at"]
    sized = lambda x: F.transform(x["h"], lambda e, j: F.struct(e["value"].alias("value"), e["at"].alias("at"), size(x, e, j).alias("n")))
    return let(items, lambda s: let(F.struct(s.alias("s"), heads(s).alias("h")), sized))


def matches(c: Column, pattern: str) -> Column:
    """array<MATCH>: all matches of a regex with their code point ranges, from the pieces between them.

    Running sums over pieces of about the square root of the number of matches: appending to an array copies it, so one
    sum over all n matches would copy n * n pointers; this copies n to the power of 1.5.  Null text gives null.
    """
    hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.slice(F.split(c, pattern, -1), 1, F.size(hits)), F.length)
    span = lambda x: x["gap"] + F.length(x["hit"])
    none = F.array().cast(f"array<{MATCH}>")

    def step(acc: Column, m: Column) -> Column:
        begin, end = acc["at"] + m["gap"], acc["at"] + span(m)
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), m["hit"].alias("hit")))
        return F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out"))

    def piece_start(acc: Column, piece: Column) -> Column:
        after = F.aggregate(piece, acc["at"], lambda at, m: at + span(m))
        return F.struct(after.alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def ranges(pieces: Column) -> Column:
        starts = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), piece_start, lambda acc: acc["out"])
        return F.flatten(F.zip_with(pieces, starts, lambda piece, at: F.aggregate(piece, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    def cut(found: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(found))).cast("int"), F.lit(32))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), width), lambda i: F.slice(found, i, width))

    return let(let(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), cut), ranges)


def around(c: Column, start: Column, end: Column, left: int, right: int) -> Column:
    """The text from ``left`` characters before a match to ``right`` after it."""
    lo = F.greatest(start - left, F.lit(0))
    return F.substring(c, lo + 1, end + right - lo)


def has_word(c: Column, choices: str) -> Column:
    """Whether one of the alternatives occurs as a whole word, in any case."""
    return c.rlike(rf"(?iuU)\b(?:{choices})\b")


def escaped(s: str) -> str:
    """A literal for a Java regex."""
    return "".join("\\" + ch if ch in r"\.[]{}()*+?^$|-/" else ch for ch in s)
