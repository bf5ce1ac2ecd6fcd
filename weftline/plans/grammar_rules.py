"""Grammar checks: voice, possessors, passives, agreement, digits.  One candidate per block and kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import clean, missing, sentences
from weftline.plans.rules import Rule, findings

# Words and endings of the checks.
REFLEXIVE_STOP = "здесь ось авось небось вкось подкось накось вся весь вася люся муся ася тося веся разумеется кажется казалось полагается признаться".split()
REFLEXIVE_ENDINGS = (
    "ться тся лся лась лось лись ешься ется ются ится ишься имся итесь ятся йтесь йся усь юсь ёмся емся етесь улся улась "
    "улось улись аюсь аешься ается аемся аетесь аются еся ись"
).split()
IRREGULAR = (
    "known taken stolen given made seen told thrown beaten broken brought caught held left lost paid put sent shown spent torn "
    "written eaten driven sold struck worn kept found fed felt dealt built hung shot hit cut read run swept drawn forgotten hidden chosen"
).split()
AGREEMENT_STOP = "вдали издали коли ежели дотоли доли ноши уши боли воли пули земли крови голуби дубли рубли кули тесни".split()
EN_PASSIVE = r"(?iU)\b(?:was|were|is|are|am|been|being|be|got|gets)\s+(?:\w+\s+){0,2}?(?:\w+ed|" + "|".join(IRREGULAR) + r")\b"
EN_AGENT = r"(?iU)\bby\s+(?:the|his|her|their|its|a|an)\b"
EN_POSSESSOR = r"(?iU)\b\w+'s\s+\w+\s+(?:was|were)\b"
REFLEXIVE = r"(?iuU)\b([а-яё]{5,}(?:ся|сь))\b"
RU_PASSIVE = r"(?iuU)\b(?:был|была|было|были)\s+([а-яё]{4,}(?:(?:ан|ян|ен|ён)(?:а|о|ы)|(?:ан|ян|ен|ён|ат|ит|ут)))\b"
PRONOUN_VERB = r"(?iuU)\b(он|она|оно|я|ты)\s+([а-яё]{3,}(?:ли|лись))\b"
NOUN_VERB = r"(?iuU)\b([а-яё]{3,}(?:ние|тие|енье|ство))\b([^.!?…:;]{0,60}?)\b([а-яё]{2,}(?:ли|ши))\b"
GUARD = r"(?iuU)(?:\b(?:все|они|мы|вы|гости|люди|ребята|девушки|мальчики|друзья|и|а|но|или)\s*[—-]?\s*|не\s*[—-]?\s*|[а-яё]{2,}[иы]\s*[—-]?\s*)$"
LONE_DIGIT = r"(?<![\d,.\-–—])(?<!\d\s)\d(?![\d,.\-–—%]|\s*%|\s*\d)"
# Letters that a match of the longer patterns cannot lack, in both cases.
_BYL, _SYA, _LI = "[бБ][ыЫ][лЛ]", "[сСᲃ][яЯьЬ]", "[лЛшШ][иИ]"
KINDS = ("voice", "possessive", "passive-ru", "agreement", "numbers")


def first(items: Column, keep) -> Column:
    """The first element that satisfies a predicate, or null."""
    return F.get(F.filter(items, keep), F.lit(0))


def reflexives(s: Column) -> Column:
    """Reflexive verbs of a sentence."""
    found = F.regexp_extract_all(s, F.lit(REFLEXIVE), F.lit(1))
    return F.filter(found, lambda w: F.lower(w).rlike(f"(?:{'|'.join(REFLEXIVE_ENDINGS)})$") & ~F.lower(w).isin(REFLEXIVE_STOP))


def disagreement(s: Column) -> Column:
    """The words of a number disagreement in a sentence, '' if none: a pronoun's first, else a noun's."""
    group = lambda p, i: F.regexp_extract(s, p, i)
    verb, noun_verb, gap = group(PRONOUN_VERB, 2), group(NOUN_VERB, 3), group(NOUN_VERB, 2)
    by_pronoun = (verb != "") & ~F.lower(verb).isin(AGREEMENT_STOP)
    by_noun = (noun_verb != "") & ~F.lower(noun_verb).isin(AGREEMENT_STOP) & (F.regexp_count(gap, F.lit(",")) % 2 == 0) & ~gap.rlike(GUARD)
    return F.when(by_pronoun, F.concat_ws(" ", group(PRONOUN_VERB, 1), verb)).when(by_noun, F.concat_ws(" … ", group(NOUN_VERB, 1), noun_verb)).otherwise("")


def grammar_scan(view: DataFrame, source: str = "en", target: str = "ed_ru", only: tuple[str, ...] | list[str] = KINDS) -> DataFrame:
    """Findings of a merged view; blocks that miss a side are skipped."""
    only = tuple(only)
    unknown = sorted(set(only) - set(KINDS))
    if unknown:
        raise ValueError(f"unknown checks: {', '.join(unknown)}")
    d = view.select("doc_id", "block_no", clean(F.col(source)).alias("source"), clean(F.col(target)).alias("target"))
    d = d.where(~missing(F.col("source")) & ~missing(F.col("target")))
    # A sentence's match is one of the whole text, so sentences are only cut where the text has what a check needs.
    source_, target_ = F.col("source"), F.col("target")
    d = d.select("*", (source_.contains("'") & source_.rlike(EN_POSSESSOR)).alias("possessor"), (target_.rlike(_BYL) & target_.rlike(RU_PASSIVE)).alias("has_passive_ru"))
    voiced = target_.rlike(_SYA) & (F.col("possessor") | source_.rlike(EN_AGENT)) & source_.rlike(EN_PASSIVE)
    reflexive = F.when(voiced, first(sentences(target_), lambda s: s.rlike(_SYA) & (F.size(reflexives(s)) > 0)))
    agreement = F.when(target_.rlike(_LI), first(sentences(target_), lambda s: s.rlike(_LI) & (disagreement(s) != "")))
    digit = F.when(target_.rlike("[0-9]"), first(sentences(target_), lambda s: s.rlike(LONE_DIGIT)))
    d = d.select("*", reflexive.alias("reflexive"), agreement.alias("agreement"), digit.alias("digit"))
    shown_ = F.coalesce(first(sentences(source_), lambda s: s.rlike(EN_PASSIVE)), source_)
    voiced = F.col("reflexive").isNotNull()
    by_voice = voiced & F.lit("voice" in only)
    hit = reflexives(F.col("reflexive"))[0]
    # A possessor with a reflexive verb is shown by its sentence, else by the block; once per block.
    rules = [
        Rule("voice", "weak", by_voice & ~F.col("possessor"), hit, shown_, F.col("reflexive")),
        Rule("possessive", "weak", F.col("possessor"), F.when(by_voice, hit).otherwise(F.regexp_extract("source", EN_POSSESSOR, 0)), shown_, F.when(by_voice, F.col("reflexive")).otherwise(target_)),
        Rule("passive-ru", "weak", F.col("has_passive_ru"), F.regexp_extract("target", RU_PASSIVE, 1), shown_, F.coalesce(first(sentences(target_), lambda s: s.rlike(RU_PASSIVE)), target_)),
        Rule("agreement", "weak", F.col("agreement").isNotNull(), disagreement(F.col("agreement")), shown_, F.col("agreement")),
        Rule("numbers", "weak", F.col("digit").isNotNull(), F.regexp_extract("digit", LONE_DIGIT, 0), F.lit(""), F.col("digit")),
    ]
    return findings(d, ["doc_id", "block_no"], rules, only)
