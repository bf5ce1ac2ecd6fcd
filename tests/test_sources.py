"""Readers in their three modes, tables, plans and sinks."""

import pytest
from pyspark.sql import functions as F

from weftline.sources import blocks, runs, sinks, tables

FILE = "# Title\nlost\n<!-- block: 2 -->\n a \n\n<!-- note -->\n## h\nb\n<!-- block: 1 -->\nc\n<!-- block: 2 -->\nd\n"


def docs(spark, *texts):
    return spark.createDataFrame([(f"v{i}-x", t) for i, t in enumerate(texts)], "doc_id string, text string")


def test_block_modes(spark):
    d = docs(spark, FILE, "no marks", None)
    rows = lambda mode: [(r.block_no, r.para_no, r.text) for r in blocks.blocks(d, mode).orderBy("block_no", "entry", "para_no").collect()]
    assert rows("last") == [(1, 1, "c"), (2, 1, "d")]
    assert rows("rows") == [(1, 1, "c"), (2, 1, "a"), (2, 2, "## h"), (2, 3, "b"), (2, 1, "d")] or sorted(rows("rows")) == sorted([(1, 1, "c"), (2, 1, "a"), (2, 2, "## h"), (2, 3, "b"), (2, 1, "d")])
    assert rows("merge") == [(1, 1, "c"), (2, 1, "a"), (2, 2, "<!-- note -->"), (2, 3, "b"), (2, 4, "d")]
    got = {(r.block_no): (r.title, r.marked, r.text) for r in blocks.parsed_chapters(d).where("doc_id = 'v0-x'").collect()}
    assert got[2] == ("Title", True, "a\n\n<!-- note -->\n## h\nb\n\nd") or got[2][2].endswith("\n\nd")
    assert [r.marked for r in blocks.has_markers(d).orderBy("doc_id").collect()] == [True, False, False]
    assert [(r.doc_id, r.title) for r in blocks.titles(d).collect()] == [("v0-x", "Title")]


def test_merged_and_back(spark):
    text = "intro\n## Блок 1\n\n**JA:** あ\n\n**EN:** one\ntwo\n\n**RU:** раз\n\n**ED_RU:** —\n\n## Блок 2\n\n**EN:** x\n\n**EN:** y\n"
    view = blocks.merged(docs(spark, text))
    got = [(r.block_no, r.ja, r.en, r.ru, r.ed_ru) for r in view.orderBy("ord").collect()]
    assert got == [(1, "あ", "one\ntwo", "раз", "—"), (2, "", "y", "", "")]
    again = blocks.merged(sinks.merged_text(view))
    assert [(r.block_no, r.en) for r in again.orderBy("ord").collect()] == [(1, "one\ntwo"), (2, "y")]


def test_paragraphs(spark):
    d = docs(spark, "a\nb\n \nc\n\n<!-- block: 1 -->\nlost\n\nd", None)
    assert [(r.para_no, r.text) for r in blocks.paragraphs(d).collect()] == [(1, "a\nb"), (2, "c"), (3, "<!-- block: 1 -->\nlost"), (4, "d")]
    assert [(r.para_no, r.text) for r in blocks.record_paragraphs(d).collect()] == [(1, "a\nb"), (2, "c"), (3, "d")]


def test_tables(spark):
    d = docs(spark, "| JA | EN | RU | note |\n|---|---|---|---|\n| 甲 | Aurelia Knight | Аурелия | n |\n| 乙 | magic | **Магия** | |\n| 丙 | Aurel | Аурелиан | |\nx")
    names = tables.glossary_names(d).orderBy("line_no").collect()
    assert [(r.en_forms, r.ru_base) for r in names] == [(["aurelia"], "ауре"), (["aurel"], "ауре")]
    assert [(r.stem, r.canon) for r in tables.glossary_stems(d).orderBy("line_no").collect()] == [("аурел", "Аурелия"), ("маги", "Магия"), ("аурели", "Аурелиан")]
    assert sorted(r.key for r in tables.glossary_entries(d).collect()) == ["g:丙", "g:乙", "g:甲"]
    reg = docs(spark, "| том | статус |\n|---|---|\n| 1 | Завершён |\n| 2 | в работе |\n")
    assert {r.volume for r in tables.frozen_volumes(reg).collect()} == {1, 2}
    assert {r.volume for r in tables.frozen_volumes(reg, "завершён").collect()} == {1}


def test_findings_and_artifacts(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"audit_id": "A", "audit_run_id": "r1", "findings": [{"block": 1, "problem": "p"}, {"block": 2}]}')
    (tmp_path / "b.json").write_text("{broken")
    assert [(r.audit_run_id, r.pos, r.block, r.problem) for r in runs.findings(spark, str(tmp_path)).orderBy("pos").collect()] == [("r1", 0, 1, "p"), ("r1", 1, 2, None)]
    assert runs.artifacts(spark, str(tmp_path)).count() == 2


def test_replaced_and_appended(spark, tmp_path):
    own = spark.createDataFrame([("d", 1, "a"), ("d", 2, "b")], "doc_id string, block_no int, text string")
    new = spark.createDataFrame([("d", 2, "B")], own.schema)
    assert sorted(r.text for r in sinks.replaced(own, new).collect()) == ["B", "a"]
    assert sinks.appended(own, new.withColumn("block_no", F.lit(3))).count() == 3
    with pytest.raises(Exception, match="block exists already"):
        sinks.appended(own, new).collect()
    found = spark.createDataFrame([("d", 2, "k", "x", 0), ("d", 1, "k", "y", 0)], "doc_id string, block_no int, kind string, detail string, emit_ord int")
    assert sinks.report_text(found, "R").first().text == "# R\n\nk: 2\n\n### 1 — k\ny\n\n### 2 — k\nx"
