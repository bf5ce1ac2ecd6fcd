"""Own designs of scanners known by their reports only: style, version drift, omission signals."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.numbers import numbers
from weftline.functions.text import escaped, has_word, missing, runs
from weftline.operators.versions import compared


def repetition(paragraphs: DataFrame, near: int = 2, least: int = 3, length: int = 5, letters: str = r"\p{L}") -> DataFrame:
    """(doc_id, word, para_no, n, n_near): words that occur ``least`` times within ``near`` paragraphs of one that holds them."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(f"[{letters}]{{{length},}}"), F.lit(0))
    per = paragraphs.select("doc_id", "para_no", F.explode(found).alias("word")).groupBy("doc_id", "word", "para_no").agg(F.count("*").alias("n"))
    around = W.partitionBy("doc_id", "word").orderBy("para_no").rangeBetween(-near, near)
    return per.withColumn("n_near", F.sum("n").over(around)).where(F.col("n_near") >= least)


def drift(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind, strength: how two versions of a paragraph differ; equal ones give no row."""
    a, b = old.select(*keys, F.col("text").alias("old")), new.select(*keys, F.col("text").alias("new"))
    d = a.join(b, keys, "full_outer")
    numbers_ = lambda c: F.array_sort(numbers(F.col(c)))
    letters = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    kind = (
        F.when(F.col("old").isNull(), "paragraph-added").when(F.col("new").isNull(), "paragraph-lost")
        .when(numbers_("old") != numbers_("new"), "numbers").when(letters("old") != letters("new"), "wording").when(F.col("old") != F.col("new"), "format")
    )
    strength = F.when(F.col("kind").isin("wording"), "WEAK").when(F.col("kind") == "format", "INFO").otherwise("STRONG")
    return d.withColumn("kind", kind).where("kind IS NOT NULL").select(*keys, "kind").withColumn("strength", strength)


def unexplained(found: DataFrame, explained: DataFrame, keys: list[str]) -> DataFrame:
    return found.join(explained.select(*keys), keys, "left_anti")


def omission_signals(view: DataFrame, source: str, target: str, end: str = r"[.!?…»\"]\s*$") -> DataFrame:
    """(doc_id, block_no, signal): an open end, an empty target, numbers of the source that the target lacks."""
    lost = F.size(F.array_except(numbers(F.coalesce(source, F.lit(""))), numbers(F.coalesce(target, F.lit("")))))
    gone = missing(F.col(target))
    found = F.array(F.when(~gone & ~F.col(target).rlike(end), "S1-open-end"), F.when(gone, "S2-empty"), F.when(~gone & (lost > 0), "S3-number"))
    return view.select("doc_id", "block_no", F.explode(F.array_compact(found)).alias("signal"))


STYLE_KINDS = ("REPETITION", "ROOT_REPETITION", "TAUTOLOGY", "COLLOCATION", "MONOTONY", "REDUNDANCY", "NOMINALIZATION", "OTHER")


@dataclass(frozen=True)
class StylePack:
    """Words and patterns of a language; patterns are matched on the paragraph in lower case."""

    letters: str = r"\p{L}"
    length: int = 5  # of words that count as repeated
    root: int = 4  # letters that two words of one root share
    stop: tuple[str, ...] = ()
    tautology: str = r"(?U)\b(?:вернулся назад|спустился вниз|поднялся вверх)\b"
    collocation: str = r"(?U)\b(?:играть значение|иметь роль)\b"
    intensifiers: tuple[str, ...] = ("полностью", "совершенно", "абсолютно", "очень")
    nominal: str = r"(?:ание|ение|ость|ство)$"
    nominal_least: int = 3
    epithets: tuple[str, ...] = ("огромн",)  # roots, against the other roots of their group
    group: tuple[str, ...] = ("огромн", "громадн", "гигантск", "исполинск")
    monotony_least: int = 4
    monotony_share: float = 0.8
    other: str = r"(?U)\b(?:типа|как бы)\b"


def style_scan(paragraphs: DataFrame, pack: StylePack = StylePack()) -> DataFrame:
    """doc_id, para_no, kind, word, n of (doc_id, para_no, text).

    REPETITION: a word twice or more in a paragraph.  ROOT_REPETITION: two different words with one root, shown as the first
    two in order of the alphabet, n the number of such words.  REDUNDANCY: an intensifier twice.  NOMINALIZATION: many verbal nouns.
    TAUTOLOGY, COLLOCATION, OTHER: patterns, n their matches.  MONOTONY (per document, at the first paragraph): one root makes up
    most of a group of epithets.  All but the last are one narrow pass: a paragraph's long words are sorted inside its row, and
    equal words and equal roots are neighbours.  Only epithets are shuffled, by document and root.
    """
    d = paragraphs.select("doc_id", "para_no", F.lower("text").alias("text"))
    found_all = lambda pattern: F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    begins = lambda heads: rf"(?={'|'.join(escaped(h) for h in heads)})(?<![{pack.letters}])[{pack.letters}]+"
    long_ = F.sort_array(found_all(f"[{pack.letters}]{{{pack.length},}}"))
    long_ = F.filter(long_, lambda w: ~w.isin(list(pack.stop))) if pack.stop else long_
    nominal = F.filter(found_all(f"[{pack.letters}]+"), lambda w: w.rlike(pack.nominal))
    strong = F.filter(found_all(begins(pack.intensifiers)), lambda w: w.isin(list(pack.intensifiers))) if pack.intensifiers else F.array().cast("array<string>")
    # Sorted words in one text: those whose next neighbour is equal or has the same root; few are, so the runs are short.
    joined = lambda words: F.array_join(words, "\x01")
    again = r"(?<![^\x01])([^\x01]++)(?=\x01\1(?![^\x01]))"
    alike = rf"(?<![^\x01])(([^\x01]{{{pack.root}}})[^\x01]*+)(?=\x01(\2[^\x01]*+))"
    d = d.select("*", long_.alias("long"), nominal.alias("nominal"), runs(F.sort_array(strong)).alias("strong"))
    d = d.select("*", runs(F.regexp_extract_all(joined(F.col("long")), F.lit(again), F.lit(1))).alias("repeated"), joined(F.array_distinct("long")).alias("distinct"))
    pairs = F.arrays_zip(F.regexp_extract_all("distinct", F.lit(alike), F.lit(1)).alias("one"), F.regexp_extract_all("distinct", F.lit(alike), F.lit(3)).alias("two"))
    d = d.select("*", pairs.alias("pairs")).select("*", runs(F.transform("pairs", lambda e: F.left(e["one"], F.lit(pack.root)))).alias("roots"))
    one = lambda kind, word, n: F.struct(F.lit(kind).alias("kind"), word.alias("word"), n.cast("long").alias("n"))
    pair = lambda r: F.get(F.col("pairs"), r["at"])
    found = [
        F.transform("repeated", lambda e: one("REPETITION", e["value"], e["n"] + 1)),
        F.transform("roots", lambda r: one("ROOT_REPETITION", F.concat(pair(r)["one"], F.lit(" … "), pair(r)["two"]), r["n"] + 1)),
        F.transform(F.filter("strong", lambda e: e["n"] >= 2), lambda e: one("REDUNDANCY", e["value"], e["n"])),
        F.array_compact(F.array(F.when(F.size("nominal") >= pack.nominal_least, one("NOMINALIZATION", F.array_min("nominal"), F.size("nominal"))))),
    ]
    for kind, pattern in (("TAUTOLOGY", pack.tautology), ("COLLOCATION", pack.collocation), ("OTHER", pack.other)):
        found.append(F.array_compact(F.array(F.when(F.col("text").rlike(pattern), one(kind, F.regexp_extract("text", pattern, 0), F.regexp_count("text", F.lit(pattern)))))))
    each = d.select("doc_id", "para_no", F.inline(F.concat(*found)))

    def root_of(word):
        of = F.lit(None).cast("string")
        for root in pack.group:
            of = F.coalesce(of, F.when(word.startswith(root), F.lit(root)))
        return of

    uses = d.select("doc_id", "para_no", F.explode(found_all(begins(pack.group))).alias("word")).select("doc_id", "para_no", root_of(F.col("word")).alias("root"))
    by_root = uses.where("root IS NOT NULL").groupBy("doc_id", "root").agg(F.count("*").alias("n"), F.min("para_no").alias("para_no"))
    total = F.sum("n").over(W.partitionBy("doc_id"))
    dull = by_root.withColumn("total", total).where(F.col("root").isin(list(pack.epithets)) & (F.col("n") >= pack.monotony_least) & (F.col("n") >= pack.monotony_share * F.col("total")))
    return each.unionByName(dull.select("doc_id", "para_no", F.lit("MONOTONY").alias("kind"), F.col("root").alias("word"), F.col("n").cast("long").alias("n")))


@dataclass(frozen=True)
class DriftPack:
    """Marks of meaning: whole words in any case, and how a name looks."""

    negation: str = "не|ни|нет|без|никогда|ничего|никто"
    persons: dict[str, str] = field(default_factory=lambda: {"1s": "я|меня|мне|мной", "1p": "мы|нас|нам|нами", "2": "ты|тебя|тебе|вы|вас|вам|вами", "3": "он|она|они|его|её|их|им"})
    name: str = r"[А-ЯЁ][а-яё]{3,}"


def _letters(c):
    """128 bits of a text's letters and digits in lower case; null for a text that has none."""
    bare = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    return F.when(bare != "", F.md5(bare.cast("binary"))).when(c.isNotNull(), "")


def drift_kinds(old: DataFrame, new: DataFrame, keys: list[str], pack: DriftPack = DriftPack()) -> DataFrame:
    """keys, kind, strength: every way in which two versions of a paragraph differ in meaning, else how they differ at all.

    Paragraphs meet by ``keys`` (document first), which both versions must share; ``drift_aligned`` finds the pairs itself.
    paragraph-lost, paragraph-added, paragraph-moved (the other version has it elsewhere in the document), numbers, negation,
    persons and names are STRONG but for moves (INFO); rewording without any of them is WEAK, format alone INFO.
    Moves are found by a join on (document, hash of the letters), so a paragraph is compared with its equals only.
    """
    a, b = (df.select(*keys, F.col("text").alias(n)) for df, n in ((old, "old"), (new, "new")))
    return _kinds(_with_moves(a.join(b, keys, "full_outer"), old, new, keys[0]), keys, pack)


def drift_aligned(old: DataFrame, new: DataFrame, doc: str = "doc_id", pack: DriftPack = DriftPack(), alike: float = 0.3) -> DataFrame:
    """doc, old_no, new_no, kind, strength of two versions whose paragraphs are aligned as sequences (``versions.compared``)."""
    fixed, rest = compared(old, new, doc, alike=alike)
    keys = [doc, "old_no", "new_no"]
    same = fixed.where("other").select(*keys, F.lit("format").alias("kind"), F.lit("INFO").alias("strength"))
    return _kinds(rest, keys, pack).unionByName(same)


def _with_moves(d: DataFrame, old_rows: DataFrame, new_rows: DataFrame, doc: str) -> DataFrame:
    """``d`` and in_new, in_old: whether the letters of a side's paragraph are anywhere in the other version of the document."""
    d = d.withColumn("lo", _letters(F.col("old"))).withColumn("ln", _letters(F.col("new")))
    pool = lambda df, c: df.select(F.col(doc).alias("_doc"), _letters(F.col("text")).alias("_hash")).where("_hash <> ''").distinct().withColumn(c, F.lit(True))
    for rows, c, own in ((new_rows, "in_new", "lo"), (old_rows, "in_old", "ln")):
        d = d.join(pool(rows, c), (F.col(doc) == F.col("_doc")) & (F.col(own) == F.col("_hash")), "left").drop("_doc", "_hash")
    return d


def _kinds(d: DataFrame, keys: list[str], pack: DriftPack) -> DataFrame:
    """keys, kind, strength of pairs (keys, old, new, in_new, in_old); a side that lacks the paragraph is null."""
    names = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(pack.name), F.lit(0))))
    d = d.withColumn("lo", _letters(F.col("old"))).withColumn("ln", _letters(F.col("new")))
    d = d.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("in_new", "in_old")})
    o, n = F.col("old"), F.col("new")
    both = o.isNotNull() & n.isNotNull() & (F.col("lo") != F.col("ln"))
    person = F.lit(False)
    for p in pack.persons.values():
        person = person | (has_word(o, p) != has_word(n, p))
    gone, came = o.isNotNull() & n.isNull(), o.isNull() & n.isNotNull()
    strong = {
        "paragraph-lost": gone & ~F.col("in_new"), "paragraph-added": came & ~F.col("in_old"),
        "numbers": both & (F.array_sort(numbers(o)) != F.array_sort(numbers(n))), "negation": both & (has_word(o, pack.negation) != has_word(n, pack.negation)),
        "persons": both & person, "names": both & (names(o) != names(n)),
    }
    moved = (gone & F.col("in_new")) | (came & F.col("in_old"))
    any_ = reduce(lambda x, y: x | y, (F.coalesce(c, F.lit(False)) for c in strong.values()))
    kinds = [(k, "STRONG", c) for k, c in strong.items()] + [("paragraph-moved", "INFO", moved), ("wording", "WEAK", both & ~any_), ("format", "INFO", o.isNotNull() & n.isNotNull() & ~both & (o != n))]
    listed = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("kind"), F.lit(s).alias("strength"))) for k, s, c in kinds]))
    return d.select(*keys, F.inline(listed))
