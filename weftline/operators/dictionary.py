"""Terms of a dictionary in texts, by one automaton for all of them.

``first_hits`` finds where each term first stands in each text.  All terms make one Aho-Corasick automaton, so a text is
walked once however many terms there are; what may stand beside a hit (no letter, no word character) is looked at
hit by hit.  The dictionary reaches the workers as a whole, which its measured size must allow (``limit`` bytes, an
aggregate over the table of terms).  Beyond, texts meet the terms by an equi-join on the first three characters, and each
pair that is left is verified: no table is broadcast and no task holds the dictionary.  Both ways give the same rows.

Terms and texts are compared as they are or in lower case, character by character (the dotted capital I, whose lower case has
two characters, counts as i), so places are those of the text as it came.

Cases: null and empty texts and terms have no hits; equal terms (in lower case, if so compared) are one; a hit that is
shut out by its neighbours does not hide a later one; rows are told apart by place, so repeated rows each have their
hits; an empty dictionary or table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from weftline.sources.staging import staged

#: Letters that bound a term of the glossary (fixed value).
LETTERS = "A-Za-zА-Яа-яЁё"
WORD = r"\p{L}\p{N}_"


@dataclass(frozen=True)
class Bounds:
    """Character classes that may not stand right before or right after a hit, in Java's notation; '' allows all."""

    fold: bool = True
    before: str = ""
    after: str = ""


SUBSTRING = Bounds(fold=False)
WHOLE = Bounds(before=LETTERS, after=LETTERS)
STEM = Bounds(before=WORD)


def lowered(c: Column) -> Column:
    return F.lower(F.translate(c, "İ", "i"))


class _Shut(dict):
    """Whether a character is of a class; each is tried once."""

    def __init__(self, chars: str):
        import regex

        self.found = regex.compile(f"[{chars}]") if chars else None

    def __missing__(self, ch: str) -> bool:
        self[ch] = hit = bool(self.found and self.found.match(ch))
        return hit


@lru_cache(maxsize=4)
def _walker(terms: tuple[str, ...], bounds: Bounds):
    """A function from a text to (term number, start) of each term's first hit."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        automaton.add_word(term, i)
    automaton.make_automaton()
    before, after, sizes = _Shut(bounds.before), _Shut(bounds.after), [len(t) for t in terms]

    def walk(text: str) -> dict[int, int]:
        found: dict[int, int] = {}
        low = text.replace("İ", "i").lower() if bounds.fold else text
        last = len(low) - 1
        for end, i in automaton.iter(low):
            if i not in found:
                start = end + 1 - sizes[i]
                if not (start and before[low[start - 1]]) and not (end < last and after[low[end + 1]]):
                    found[i] = start
        return found

    return walk


def _out(rows: DataFrame, keep: tuple[str, ...]) -> StructType:
    return StructType([*(rows.schema[c] for c in keep), StructField("term", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])


def _walked(rows: DataFrame, terms: tuple[str, ...], text: str, bounds: Bounds, keep: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _walker(terms, bounds) if terms else lambda _: {}
        for batch in batches:
            row, term, start = [], [], []
            for r, t in enumerate(batch[0].to_pylist()):
                for i, at in walk(t).items() if t else ():
                    row.append(r)
                    term.append(i)
                    start.append(at)
            at = pa.array(row, pa.int32())
            names = [terms[i] for i in term]
            ends = [s + len(n) for s, n in zip(start, names, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c + 1].take(at) for c in range(len(keep))), pa.array(names, pa.string()), pa.array(start, pa.int32()), pa.array(ends, pa.int32())], [*keep, "term", "start", "end"])

    return rows.select(F.col(text).cast("string").alias("_t"), *keep).mapInArrow(run, _out(rows, keep))


def _joined(rows: DataFrame, terms: DataFrame, text: str, bounds: Bounds, keep: tuple[str, ...]) -> DataFrame:
    own = rows.select(F.monotonically_increasing_id().alias("_row"), F.col(text).cast("string").alias("_t"), *keep).where("length(_t) > 0")
    own = staged(own.withColumn("_low", lowered(F.col("_t")) if bounds.fold else F.col("_t")), "dictionary-texts")
    heads = terms.select("term", F.left("term", F.lit(3)).alias("head"))
    gram = lambda n: F.transform(F.sequence(F.lit(1), F.length("_low")), lambda i: F.substring(F.col("_low"), i, F.lit(n)))
    grams = own.select("_row", F.explode(F.array_distinct(F.concat(*[gram(n) for n in (1, 2, 3)]))).alias("head"))
    pairs = grams.join(heads, "head").select("_row", "term").distinct()
    edge = lambda chars, sign: F.lit(f"(?<{sign}[{chars}])" if sign == "!" else f"(?![{chars}])") if chars else F.lit("")
    pattern = F.concat(edge(bounds.before, "!"), F.lit(r"\Q"), F.replace("term", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"), edge(bounds.after, ""))
    ahead = F.call_function("regexp_extract", F.col("_low"), F.concat(F.lit("(?s)^(.*?)"), pattern), F.lit(1))  # regexp_instr does not count code points
    at = (F.length(ahead) if bounds.before or bounds.after else F.instr(F.col("_low"), F.col("term")) - 1).cast("int")
    found = own.join(pairs, "_row").where(F.regexp("_low", pattern)).withColumn("start", at)
    return found.select(*keep, "term", "start", (F.col("start") + F.length("term")).alias("end"))


def size_of(terms: DataFrame, *columns: str) -> int:
    """Bytes that a table of terms takes in memory, about."""
    return terms.agg(F.sum(sum((F.octet_length(F.coalesce(c, F.lit(""))) for c in columns), F.lit(64)))).first()[0] or 0


def listed_hits(rows: DataFrame, terms: list[tuple[str, dict[str, list[int]], Bounds]], keep: tuple[str, ...] = (), name: str = "hits") -> DataFrame:
    """keep and array<int> ``name``: the numbers of the terms that stand in a row's texts, one row a row; for dictionaries that the workers may hold.

    ``terms`` lists columns of texts, each with its terms (not empty, in lower case if so compared), the numbers of each term and their
    bounds.  A row and all of its texts go to Python once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [(_walker(tuple(own), bounds) if own else lambda _: {}, list(own.values())) for _, own, bounds in terms]
        for batch in batches:
            found, upto = [], [0]
            for texts in zip(*(batch[c].to_pylist() for c in range(len(walks))), strict=True):
                for (walk, numbers), t in zip(walks, texts, strict=True):
                    for i in walk(t) if t else ():
                        found += numbers[i]
                upto.append(len(found))
            hits = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[len(walks) :], hits], [*keep, name])

    out = StructType([*(rows.schema[c] for c in keep), StructField(name, ArrayType(IntegerType()))])
    return rows.select(*[F.col(text).cast("string").alias(f"_t{n}") for n, (text, _, _) in enumerate(terms)], *keep).mapInArrow(run, out)


def first_hits(rows: DataFrame, terms: DataFrame, text: str = "text", bounds: Bounds = WHOLE, keep: tuple[str, ...] = (), limit: int = 32 << 20) -> DataFrame:
    """keep, term, start, end: each term of the table ``terms`` (column term) where it first stands in each text; places from 0, end exclusive.

    ``term`` is in lower case where texts are compared so.
    """
    own = terms.select((lowered(F.col("term")) if bounds.fold else F.col("term")).alias("term")).where("term <> ''").distinct()
    if size_of(own, "term") > limit:
        return _joined(rows, own, text, bounds, keep)
    return _walked(rows, tuple(sorted(r.term for r in own.collect())), text, bounds, keep)
