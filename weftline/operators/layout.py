"""Layout of edited text, line by line: eleven kinds of candidates.  Own design; only reports of such a scan exist.

What counts as speech, thought, a title or a misspelt name is a pack.  A document's lines meet in one window for
the lines next to a marker; everything else is one narrow pass of rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import strip
from weftline.plans.rules import Rule, findings

KINDS = ("lowercase", "title", "typo", "namespell", "attribution", "blockgap", "vocative", "thoughtinline", "quotespeech", "thought", "paragraph")


@dataclass(frozen=True)
class LayoutPack:
    """Patterns of a language; each is looked for in a stripped line."""

    marker: str = r"^<!--.*-->$"
    speech: str = "^—"
    lowercase: str = r"^[а-яё]|[.!?] [а-яё]"
    title: str = r"\bваш[еи]? (?:величеств|высочеств|превосходительств)"
    typo: str = r"(?iu)([бвгджзкпрфхцчшщ])\1\1|шш|жж|чч|гг"
    names: dict[str, str] = field(default_factory=dict)  # misspelt: right
    attribution: str = r"[.!?,…] — (?:Сказал|Спросил|Ответил|Крикнул|Подумал)"
    vocative: str = r"(?:^|[.!?—] )(?:да|нет|эй|послушай) [А-ЯЁ][а-яё]+[.!?]"
    italic: str = "_[^_]+_"
    opens_quote: str = "«“\""
    closes_clause: str = "—:!?»"
    quoted: str = "^«[^»]*»[.!?…]*$"
    thought: str = r"«[^»]*»,? (?:— )?(?:подумал|решил|мелькнуло)"
    glued: str = r"[.!?…»] — [А-ЯЁ][^—]*[.!?…] — [А-ЯЁ]"


def layout_scan(lines: DataFrame, pack: LayoutPack = LayoutPack(), only: list[str] | None = None) -> DataFrame:
    """doc_id, line_no, emit_ord, kind, weight, detail, source, target of (doc_id, line_no, line); detail is the hit."""
    order = W.partitionBy("doc_id").orderBy("line_no")
    d = lines.select("doc_id", "line_no", strip(F.coalesce("line", F.lit(""))).alias("line"))
    # A neighbour is text that touches a marker: neither blank nor beyond the document nor a marker itself.
    touches = lambda c: F.coalesce(c, F.lit("")) != ""
    d = d.select("*", F.lag("line").over(order).alias("before"), F.lead("line").over(order).alias("after"))
    line = F.col("line")
    marker = line.rlike(pack.marker)
    text = ~marker & (line != "")
    first = F.regexp_extract(line, pack.italic, 0)
    lead = strip(F.split_part(line, first, F.lit(1)))
    inline = (first != "") & (lead != "") & ~F.substring(first, 2, 1).isin(*pack.opens_quote) & ~F.right(lead, F.lit(1)).isin(*pack.closes_clause)
    wrong = F.lit(None).cast("string")
    for bad, good in pack.names.items():
        wrong = F.coalesce(wrong, F.when(line.contains(bad), F.lit(f"{bad} -> {good}")))
    none, hit = F.lit(""), lambda p: F.regexp_extract(line, p, 0)

    def rule(kind: str, when, detail) -> Rule:
        return Rule(kind, "weak", when, detail, none, line)

    rules = [
        rule("lowercase", text & line.rlike(pack.lowercase), hit(pack.lowercase)),
        rule("title", text & line.rlike(pack.speech) & line.rlike(pack.title), hit(pack.title)),
        rule("typo", text & line.rlike(pack.typo), hit(pack.typo)),
        rule("namespell", text & wrong.isNotNull(), wrong),
        rule("attribution", text & line.rlike(pack.attribution), hit(pack.attribution)),
        rule("blockgap", marker & (touches(F.col("before")) | touches(F.col("after"))), F.when(touches(F.col("before")), "before").otherwise("after")),
        rule("vocative", text & line.rlike(pack.vocative), hit(pack.vocative)),
        rule("thoughtinline", text & inline, first),
        rule("quotespeech", text & line.rlike(pack.quoted), hit(pack.quoted)),
        rule("thought", text & line.rlike(pack.thought), hit(pack.thought)),
        rule("paragraph", text & line.rlike(pack.glued), hit(pack.glued)),
    ]
    return findings(d, ["doc_id", "line_no"], rules, only)
