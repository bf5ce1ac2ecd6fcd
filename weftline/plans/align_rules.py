"""Alignment checks of a source and a target text: candidates, never verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.numbers import unconfirmed
from weftline.functions.text import clean, has_word, missing
from weftline.operators.glossary import joined_names
from weftline.plans.rules import Rule, findings


@dataclass(frozen=True)
class LanguagePack:
    """What the checks look for in each language; regexes without borders."""

    source_speech: str
    target_speech: str
    mark: str
    source_negation: str
    target_negation: str
    source_we: str
    target_we: str
    target_you: str


# English against Russian.
EN_RU = LanguagePack(
    source_speech='"',
    target_speech="[—«]",
    mark="[?]",
    source_negation="not|no|never|none|nothing|without|n't|nor",
    target_negation="не|ни|нет|без|никогда|ничего|никто",
    source_we="we|us|our|ours",
    target_we="мы|нам|нас|нами|наш|наша|наше|наши",
    target_you="ты|тебе|тебя|тобой|твой|твоя|твои|вы|вам|вас|вами|ваш|ваша|ваше|ваши",
)


def align_rules(source: Column, target: Column, pack: LanguagePack = EN_RU, names: bool = False) -> list[Rule]:
    """Speech, marks, negation, pronouns and numbers; with ``names`` also columns lost and extra (arrays)."""
    gone = missing(target)
    have = ~gone
    empty = F.lit("")

    def rule(kind: str, when: Column, detail: Column, weight: str = "weak") -> Rule:
        return Rule(kind, weight, have & when, detail, source, target)

    nums = unconfirmed(source, target)
    rules = [
        Rule("no-translation", "info", gone, F.lit("target is empty"), empty, empty),
        rule("speech", source.rlike(pack.source_speech) != target.rlike(pack.target_speech), F.lit("speech on one side only")),
        rule("marks", source.rlike(pack.mark) != target.rlike(pack.mark), F.lit("mark on one side only")),
        rule("negation", has_word(source, pack.source_negation) != has_word(target, pack.target_negation), F.lit("negation on one side only")),
        rule("pronouns", has_word(source, pack.source_we) & has_word(target, pack.target_you) & ~has_word(target, pack.target_we), F.lit("first person plural became second person")),
        rule("numbers", F.size(nums) > 0, F.array_join(F.transform(F.array_sort(F.transform(nums, lambda n: F.struct(F.length(n).alias("l"), n.alias("n")))), lambda s: s["n"]), ", ")),
    ]
    if names:
        rules += [
            rule("names", F.size("lost") > 0, F.array_join(F.array_sort("lost"), ", ")),
            rule("names", F.size("extra") > 0, F.array_join(F.array_sort("extra"), ", "), "info"),
        ]
    return rules


def align_check(view: DataFrame, glossary: DataFrame | None = None, source: str = "en", target: str = "ed_ru", pack: LanguagePack = EN_RU, only: list[str] | None = None) -> DataFrame:
    """Findings of a merged view (doc_id, block_no, texts); ``glossary`` has en_forms, ru_base, ru."""
    d = view.select("doc_id", "block_no", clean(F.col(source)).alias("source"), clean(F.col(target)).alias("target"))
    if glossary is not None:
        d = joined_names(d, glossary)
    return findings(d, ["doc_id", "block_no"], align_rules(F.col("source"), F.col("target"), pack, glossary is not None), only)
