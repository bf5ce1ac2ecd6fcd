"""Forms of address: a title and the word after it, with the first sentence that holds both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import clean, missing, sentences
from weftline.plans.grammar_rules import first

# The titles looked for; case is ignored for the name's letter too.
TITLES = ("мисс", "мистер", "господин", "госпожа", "госпож")
NAME = "[А-ЯЁ][а-яё]+"


def address_scan(view: DataFrame, source: str = "en", target: str = "ed_ru", titles: tuple[str, ...] = TITLES, name: str = NAME) -> DataFrame:
    """doc_id, block_no, cand_no, kind, prefix, name, target, source for every match in a sentence."""
    pattern = rf"(?iuU)\b({'|'.join(titles)})\s+({name})"
    d = view.select("doc_id", "block_no", clean(F.col(source)).alias("source"), clean(F.col(target)).alias("target")).where(~missing(F.col("target")))
    pairs = F.arrays_zip(F.regexp_extract_all("target", F.lit(pattern), F.lit(1)).alias("p"), F.regexp_extract_all("target", F.lit(pattern), F.lit(2)).alias("n"))
    # Sentences are split below the generator, once per block instead of once per candidate.
    d = d.select("doc_id", "block_no", "source", "target", pairs.alias("pairs")).where(F.size("pairs") > 0)
    d = d.select("doc_id", "block_no", sentences(F.col("source")).alias("ss"), sentences(F.col("target")).alias("ts"), "pairs")
    d = d.withColumn("low", F.transform("ts", F.lower)).select("doc_id", "block_no", "ss", "ts", "low", F.posexplode("pairs").alias("cand_no", "m"))
    d = d.select("*", F.lower("m.p").alias("prefix"), F.col("m.n").alias("name"))
    held = F.get(F.filter("ts", lambda s, i: F.contains(s, F.col("name")) & F.contains(F.get("low", i), F.col("prefix"))), F.lit(0))
    shown = F.coalesce(first(F.col("ss"), lambda s: F.contains(s, F.col("name"))), F.lit(""))
    d = d.select("doc_id", "block_no", "cand_no", F.lit("address").alias("kind"), "prefix", "name", held.alias("target"), shown.alias("source"))
    return d.where(F.col("target").isNotNull())
