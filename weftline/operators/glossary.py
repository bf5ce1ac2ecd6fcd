"""Dictionary joins: names by word, by stem prefix, and anchors.

Names are equi-joins on the word or on the first four letters of a token; stems and anchors are found by one
automaton for the whole glossary (``dictionary``).  A glossary is never scanned per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from weftline.functions.numbers import number_anchors
from weftline.functions.text import before_apostrophe, fold, words
from weftline.operators.dictionary import STEM, SUBSTRING, WHOLE, first_hits, listed_hits, lowered, size_of


def names_in_source(rows: DataFrame, glossary: DataFrame, text: str = "source") -> DataFrame:
    """(doc_id, block_no, ru): names one of whose forms is a word of the text."""
    tokens = F.array_distinct(F.transform(words(F.col(text), "A-Za-z"), lambda w: F.lower(before_apostrophe(w))))
    spread = rows.select("doc_id", "block_no", F.explode(tokens).alias("word"))
    forms = glossary.select(F.explode("en_forms").alias("word"), "ru")
    return spread.join(forms, "word").select("doc_id", "block_no", "ru").distinct()


def names_in_target(rows: DataFrame, glossary: DataFrame, text: str = "target", letters: str = "А-Яа-яЁё") -> DataFrame:
    """(doc_id, block_no, ru): names whose four-letter base begins a token of the text.

    Tokens are two letters or hyphens at least (an apostrophe ends one); hyphens count for nothing in them.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(rf"[{letters}][{letters}\-]+"), F.lit(0))
    tokens = F.transform(found, lambda w: F.left(F.replace(fold(w), F.lit("-"), F.lit("")), F.lit(4)))
    spread = rows.select("doc_id", "block_no", F.explode(F.array_distinct(tokens)).alias("ru_base"))
    return spread.join(glossary.select("ru_base", "ru"), "ru_base").select("doc_id", "block_no", "ru").distinct()


def joined_names(rows: DataFrame, glossary: DataFrame, letters: str = "А-Яа-яЁё") -> DataFrame:
    """``rows`` with lost (named in the source only) and extra (in the target only)."""
    keys = ["doc_id", "block_no"]
    sides = names_in_source(rows, glossary).withColumn("side", F.lit(1)).unionByName(names_in_target(rows, glossary, letters=letters).withColumn("side", F.lit(2)))
    per = sides.groupBy(*keys, "ru").agg(F.sum("side").alias("side")).groupBy(*keys)
    only = lambda n: F.array_sort(F.collect_list(F.when(F.col("side") == n, F.col("ru"))))
    found = per.agg(only(1).alias("lost"), only(2).alias("extra"))
    none = F.array().cast("array<string>")
    return rows.join(found, keys, "left").withColumns({c: F.coalesce(c, none) for c in ("lost", "extra")})


def stem_hits(paragraphs: DataFrame, stems: DataFrame, letters: str = "А-Яа-яЁё", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, block_no, para_no, line_no, stem, canon, form, context): where each stem first begins a word of each paragraph.

    A word begins after anything but a letter, digit or underscore, so a stem after a hyphen counts.  The form goes on over
    letters and hyphens.
    """
    own = ("doc_id", *keep, "block_no", "para_no")
    hits = first_hits(paragraphs, stems.select(F.col("stem").alias("term")), "text", STEM, (*own, "text"))
    hits = hits.join(stems.select("line_no", "stem", "canon", lowered(F.col("stem")).alias("term")), "term")
    tail = F.regexp_extract(F.substring(F.col("text"), F.col("end") + 1, F.lit(1 << 30)), rf"(?iuU)^[{letters}\-]*", 0)
    form = F.concat(F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")), tail)
    hits = hits.withColumn("form", form)
    lo = F.greatest(F.col("start") - 20, F.lit(0))
    context = F.substring(F.col("text"), lo + 1, F.col("start") + F.length("form") + 40 - lo)
    return hits.select(*own, "line_no", "stem", "canon", "form", context.alias("context"))


def anchors(rows: DataFrame, entries: DataFrame, text: str, lang: str) -> DataFrame:
    """(doc_id, block_no, anchor): glossary keys and numbers of a text.

    Japanese terms stand anywhere; others, in any case, between characters that are no letters (digits may touch them).
    """
    return anchors_by_language(rows, entries, {lang: text}).drop("lang")


def anchors_by_language(rows: DataFrame, entries: DataFrame, texts: dict[str, str], limit: int = 32 << 20) -> DataFrame:
    """(lang, doc_id, block_no, anchor): ``anchors`` of texts in several languages; ``texts`` names the column of each language.

    A row is read once, whatever the number of languages: its texts meet the automata together, and its numbers and the places of its keys
    are shuffled as one row, so rows that share a block are told apart from repeats by lists, not anchor by anchor.  Keys are looked up
    after that, from a table of no more than ``limit`` bytes.  Larger glossaries are joined language by language.
    """
    bounds = {lang: SUBSTRING if lang == "ja" else WHOLE for lang in texts}
    own = rows.select("doc_id", "block_no", *[F.coalesce(F.col(text), F.lit("")).alias(f"t_{lang}") for lang, text in texts.items()])
    entry = lambda lang, anchor, no: F.struct(F.lit(lang).cast("string").alias("lang"), F.lit(anchor).cast("string").alias("anchor"), F.lit(no).cast("int").alias("no"))
    numbers = lambda lang: F.transform(number_anchors(F.col(f"t_{lang}"), lang), lambda v: entry(lang, v, None))
    marks = F.concat(*[numbers(lang) for lang in texts])
    named = {lang: entries.where(F.col(lang) != "").select(F.lit(lang).alias("lang"), "key", (lowered(F.col(lang)) if bounds[lang].fold else F.col(lang)).alias("term")) for lang in texts}
    table = reduce(DataFrame.unionByName, named.values())
    if size_of(table, "key", "term") > limit:
        hits = [first_hits(own, t, f"t_{lang}", bounds[lang], ("doc_id", "block_no"), limit).join(t, "term").select("lang", "doc_id", "block_no", F.col("key").alias("anchor")) for lang, t in named.items()]
        return reduce(DataFrame.unionByName, hits, own.select("doc_id", "block_no", F.inline(marks)).select("lang", "doc_id", "block_no", "anchor")).distinct()
    known = table.distinct().collect()
    places = {at: no for no, at in enumerate(sorted({(r.lang, r.key) for r in known}, key=str))}
    numbers_of: dict[str, dict[str, list[int]]] = {lang: {} for lang in texts}
    for r in known:
        numbers_of[r.lang].setdefault(r.term, []).append(places[r.lang, r.key])
    keys = rows.sparkSession.createDataFrame([(no, *at) for at, no in places.items()], StructType([StructField("no", IntegerType()), StructField("of", StringType()), entries.schema["key"]]))
    found = listed_hits(own.withColumn("marks", marks), [(f"t_{lang}", numbers_of[lang], bounds[lang]) for lang in texts], ("doc_id", "block_no", "marks"))
    merged = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    blocks = found.groupBy("doc_id", "block_no").agg(merged("marks").alias("marks"), merged("hits").alias("hits"))
    each = blocks.select("doc_id", "block_no", F.inline(F.concat("marks", F.transform("hits", lambda no: entry(None, None, no)))))
    each = each.join(F.broadcast(keys), "no", "left")
    return each.select(F.coalesce("lang", "of").alias("lang"), "doc_id", "block_no", F.coalesce("anchor", "key").alias("anchor"))
