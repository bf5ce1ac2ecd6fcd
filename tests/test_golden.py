"""Literal Russian, English and Japanese cases of the rules, readers and the gate."""

from pyspark.sql import functions as F

from weftline.functions.numbers import ja_value
from weftline.operators import findings, gate
from weftline.plans.address_rules import address_scan
from weftline.plans.align_rules import align_check
from weftline.plans.grammar_rules import grammar_scan
from weftline.plans.record_rules import record_scan
from weftline.sources.blocks import blocks, merged, parsed_chapters
from weftline.sources.sinks import merged_text
from weftline.sources.tables import frozen_volumes, glossary_entries, glossary_names, glossary_stems

NUMERALS = [("一万二千", 12000), ("十", 10), ("〇", None), ("二十三", 23), ("三百五", 305), ("一億二千万", 120000000), ("千", 1000), ("", None), ("七万", 70000)]
GOLDEN = [
    (1, "She was tired.", "Она устали.", "agreement"),
    (2, "The long wait wore her out.", "долгое ожидание вконец измотали её", "agreement"),
    (3, "The long wait wore her out.", "долгое ожидание вконец измотало её", ""),
    (4, "The rest went home.", "Сидение, а потом, все ушли.", ""),
    (5, "The purse was taken by the boy.", "Кошелёк у мальчика потерялся.", "voice"),
    (6, "Anna's purse was stolen.", "Анна лишилась кошелька.", "possessive"),
    (7, "He opened the gate.", "Замок был сломан.", "passive-ru"),
    (8, "She ate three pears.", "Она съела 3 груши.", "numbers"),
    (9, "She ate ten of 120 pears.", "Она съела десять из 120 груш.", ""),
    (10, "They sang.", "—", ""),
]
BLOCK_FILE = "# Начало\nдо меток\n<!-- block: 2 -->\nпервый\n\n<!-- заметка -->\nвторой\n<!-- block: 1 -->\nтретий\n<!-- block: 2 -->\nчетвёртый"
MERGED_FILE = "## Блок 1\n\n**JA:** 春\n\n**EN:** spring\n\n**RU:** весна\n\n**ED_RU:** —\n\n## Блок 2\n\n**EN:** old\n\n**EN:** rain\nfalls\n"
TABLE = "| JA | EN | RU | note |\n|---|---|---|---|\n| 森 | Silvana Order | Сильвана | n |\n| 川 | Rivera | **Ривера** | |\n| 海 | sea | Море | |\n| 森2 | Silvan | Сильванец | |"
ALIGN = [
    (1, "", None, "no-translation"), (2, '"Run," he said.', "Беги, сказал он.", "speech"), (3, "Why?", "Потому.", "marks"), (4, "She was not there.", "Она там была.", "negation"),
    (5, "They saw us.", "Они видели вас.", "pronouns"), (6, "He had 40 ships.", "У него были корабли.", "numbers"), (7, "He had 7 ships.", "У него семь кораблей.", ""),
    (8, "Silvana left.", "Ушла Ривера.", "names names"), (9, "Silvana left.", "Сильваны нет.", "negation"),
]
CHAPTERS = {"whole": {}, "stale": {"scan": "2025-01-01"}, "open": {"text": "<!-- ??? -->"}, "short": {"ru": [1]}, "empty": {"output": None}}


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_numerals(spark):
    d = spark.createDataFrame([(s,) for s, _ in NUMERALS], "numeral string")
    assert {r.numeral: r.value for r in d.select("numeral", ja_value(F.col("numeral")).alias("value")).collect()} == dict(NUMERALS)


def test_grammar(spark):
    d = spark.createDataFrame([("g", n, e, r) for n, e, r, _ in GOLDEN], "doc_id string, block_no int, en string, ed_ru string")
    assert rows(grammar_scan(d), "block_no", "kind") == [(n, k) for n, _, _, ks in GOLDEN for k in ks.split()]


def test_repeated_blocks(spark):
    docs = spark.createDataFrame([("v1-ch01", BLOCK_FILE)], "doc_id string, text string")
    got = {mode: rows(blocks(docs, mode), "block_no", "para_no", "text") for mode in ("last", "rows", "merge")}
    assert got == {
        "last": [(1, 1, "третий"), (2, 1, "четвёртый")], "rows": [(1, 1, "третий"), (2, 1, "первый"), (2, 1, "четвёртый"), (2, 2, "второй")],
        "merge": [(1, 1, "третий"), (2, 1, "первый"), (2, 2, "<!-- заметка -->"), (2, 3, "второй"), (2, 4, "четвёртый")],
    }


def test_merged_chapter_written_and_read(spark):
    view = merged(spark.createDataFrame([("v1-ch01", MERGED_FILE)], "doc_id string, text string"))
    assert rows(merged(merged_text(view)), "block_no", "ja", "en", "ru", "ed_ru") == [(1, "春", "spring", "весна", "—"), (2, "—", "rain\nfalls", "—", "—")]


def test_parsed_chapters(spark):
    docs = spark.createDataFrame([(1, "# Зима\n<!-- block: 1 -->\nраз\n<!-- block: 2 -->\nдва\n<!-- block: 1 -->\nтри"), (2, "без меток")], "doc_id int, text string")
    got = {(r.doc_id, r.title, r.marked, r.block_no, r.text) for r in parsed_chapters(docs).collect()}
    assert got == {(1, "Зима", True, 1, "раз\n\nтри"), (1, "Зима", True, 2, "два"), (2, "", False, None, None)}


def test_glossary_and_registry(spark):
    docs = spark.createDataFrame([("dictionary", TABLE)], "doc_id string, text string")
    assert {(r.ru, tuple(r.en_forms)) for r in glossary_names(docs).collect()} == {("Сильвана", ("silvana",)), ("**Ривера**", ("rivera",)), ("Сильванец", ("silvan",))}
    assert {(r.canon, r.stem) for r in glossary_stems(docs).collect()} >= {("Сильвана", "сильва"), ("Ривера", "риве"), ("Море", "море")}
    assert {(r.ru, r.key) for r in glossary_entries(docs).collect()} == {("Сильвана", "g:森"), ("**Ривера**", "g:川"), ("Море", "g:海"), ("Сильванец", "g:森2")}
    registry = spark.createDataFrame([("completed", "| том | статус |\n|---|---|\n| 1 | завершён |\n| 2 | в работе |")], "doc_id string, text string")
    assert rows(frozen_volumes(registry), "volume") == [(1,), (2,)] and rows(frozen_volumes(registry, "завершён"), "volume") == [(1,)]


def test_alignment_rules(spark):
    view = spark.createDataFrame([("g", n, e, r) for n, e, r, _ in ALIGN], "doc_id string, block_no int, en string, ed_ru string")
    names = spark.createDataFrame([(["silvana"], "силь", "Сильвана"), (["rivera"], "риве", "Ривера")], "en_forms array<string>, ru_base string, ru string")
    assert rows(align_check(view, names), "block_no", "kind") == sorted((n, k) for n, _, _, ks in ALIGN for k in ks.split())


def test_addresses_and_records(spark):
    found = [("g", 1, "Rain. Miss Орлова nodded.", "Дождь. Мисс Орлова кивнула."), ("g", 2, "The rector came.", "Пришёл господин ректор."), ("g", 3, "x", "Пришла мадам Орлова.")]
    view = spark.createDataFrame(found, "doc_id string, block_no int, en string, ed_ru string")
    assert rows(address_scan(view), "block_no", "prefix", "name", "source") == [(1, "мисс", "Орлова", "Miss Орлова nodded."), (2, "господин", "ректор", "")]
    lines = [("g", 1, "Да. — Иди сюда"), ("g", 2, "Да. — Сказала она тихо"), ("g", 3, "строка\nКонец! — Начало"), ("g", 4, "# Глава. — Слово")]
    assert rows(record_scan(spark.createDataFrame(lines, "doc_id string, para_no int, text string")), "para_no", "line_no", "fragment") == [(1, 1, "Да. — Иди сюда"), (3, 2, "Конец! — Начало")]


def test_gate_on_broken_evidence(spark):
    found = []
    for name, change in CHAPTERS.items():
        scans = {s: change.get("scan", "2026-01-03") if s == "style" else "2026-01-03" for s in gate.SCANS}
        found.append((name, change.get("output", "2026-01-02"), change.get("text", "текст"), "2026-01-03", "## FINAL READ\nGRAMMAR STYLE FORMAT", "2026-01-01", [1, 2], change.get("ru", [1, 2]), scans, 1, 1, 1, 1))
    d = spark.createDataFrame(found, "doc_id string, output_at string, text string, audit_at string, audit_text string, precheck_at string, ja_blocks array<int>, ru_blocks array<int>, scan_at map<string,string>, runs_a int, runs_b int, phase1 int, phase2 int")
    assert rows(gate.verdicts(gate.checks(d)), "doc_id", "closed", "ready") == [("empty", 6, False), ("open", 11, False), ("short", 11, False), ("stale", 11, False), ("whole", 12, True)]


def test_provenance(spark):
    d = spark.createDataFrame([("a", "FIXED", ["r1"], "r2"), ("b", "PRESERVED", ["r1"], "r1"), ("c", "REPORT_ONLY", [], "r2")], "id string, action string, sources array<string>, run string")
    got = d.select("id", findings.clamped(F.col("action")).alias("action"), F.array_join(findings.with_source(F.col("sources"), F.col("run")), ",").alias("sources"))
    assert rows(got, "id", "action", "sources") == [("a", "REPORT_ONLY", "r1,r2"), ("b", "PRESERVED", "r1"), ("c", "REPORT_ONLY", "")]
