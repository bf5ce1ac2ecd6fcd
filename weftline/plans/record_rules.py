"""Dialogue records: a sentence that ends inside a line, a dash and a capital, unless speech is attributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import around, matches

BORDER = r"[.!?…»][ \t]+—[ \t]+[А-ЯЁA-Z][а-яёa-z\-]+"
# Verbs and participles of speech and gesture, matched as prefixes in any case.
ATTRIBUTION = (
    "сказал сказала проговорил проговорила пробормотал пробормотала промолвил произнёс произнесла спросил спросила ответил ответила "
    "воскликнул воскликнула крикнул крикнула вскричал шепнул прошептал отозвался отозвалась добавил добавила продолжил продолжила "
    "заметил заметила повторил повторила возразил возразила усмехнулся усмехнулась улыбнулся улыбнулась вздохнул вздохнула кивнул "
    "кивнула подумал подумала буркнул буркнула рявкнул гаркнул протянул протянула пропел фыркнул хмыкнул расхохотался расхохоталась "
    "опечалился опечалилась рванулся рванулась развёл развела достал достала побледнел побледнела стиснул стиснула стукнул стукнула "
    "покачал покачала замер замерла встал встала сел села уселся уселась придвинулся придвинулась отвернулся отвернулась обернулся "
    "обернулась посмотрел посмотрела взглянул взглянула уставился уставилась помрачнел помрачнела ухмыльнулся ухмыльнулась заулыбался "
    "заулыбалась охнул охнула вздрогнул вздрогнула спустился спустилась поднялся поднялась опустился опустилась взял взяла вспомнив "
    "сказав услышав улыбнувшись усмехнувшись глядя обернувшись кивнув вздохнув помолчав подумав сжав подняв опустив распахнув приподняв заглянув"
).split()


def record_scan(paragraphs: DataFrame, border: str = BORDER, attribution: list[str] = ATTRIBUTION, lead: str = r"^[^\s]+[ \t]+—[ \t]+") -> DataFrame:
    """doc_id, para_no, line_no, start, fragment of each border that no word of speech follows within four words.

    ``lead`` is the part of a border before the word, whose own letters count as the first of the four.
    """
    d = paragraphs.where(~F.col("text").startswith("#"))
    d = d.select("doc_id", "para_no", F.posexplode(F.split("text", "\n", -1)).alias("l", "line"))
    d = d.select("doc_id", "para_no", (F.col("l") + 1).alias("line_no"), "line", F.explode(matches(F.col("line"), border)).alias("m"))
    skip = F.length(F.regexp_extract("m.hit", lead, 0))
    tail = F.slice(F.regexp_extract_all(F.substring(F.col("line"), F.col("m.start") + skip + 1, F.lit(1 << 30)), F.lit(r"\p{L}[\p{L}'’\-]*"), F.lit(0)), 1, 4)
    spoken = F.exists(tail, lambda w: F.lower(w).rlike(f"^(?:{'|'.join(attribution)})"))
    return d.where(~spoken).select("doc_id", "para_no", "line_no", F.col("m.start").alias("start"), around(F.col("line"), F.col("m.start"), F.col("m.end"), 45, 20).alias("fragment"))


