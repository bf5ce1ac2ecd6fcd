"""Scanners of own design, analysis phases, alignment and renderers on rows whose right result is known."""

import pytest

from weftline.operators import evidence, regression, style
from weftline.operators.dp_align import dp_aligned
from weftline.operators.layout import KINDS, LayoutPack, layout_scan
from weftline.sources import sinks
from weftline.sources.blocks import lines

LAYOUT = [
    ("lowercase", "он ушёл."), ("title", "— Проходите, ваше величество."), ("typo", "Он сказал свеччка так."), ("namespell", "Мельн поднял меч."), ("attribution", "— Да, — Сказал он."),
    ("vocative", "— Эй. эй Орлов!"), ("thoughtinline", "Он замер на месте _Вот так встреча_"), ("quotespeech", "«Пойдём отсюда»."), ("thought", "«Пожалуй, пора», подумал он."), ("paragraph", "Он встал. — Пора идти. — Куда же."),
]
CLEAN = ["Он ушёл.", "— Проходите, Ваше Величество.", "Мирон поднял меч.", "— Да, — сказал он.", "_Вот так встреча_", "Книга _«Белая Чайка»_ лежала.", "", "Она шла: _Пора_"]


@pytest.mark.parametrize("kind, line", LAYOUT)
def test_layout_kinds(spark, kind, line):
    d = spark.createDataFrame([("a", 1, line)] + [("b", i, x) for i, x in enumerate(CLEAN)], "doc_id string, line_no int, line string")
    found = layout_scan(d, LayoutPack(names={"Мельн": "Мирон"})).select("doc_id", "kind").collect()
    assert kind in {r.kind for r in found if r.doc_id == "a"} and not [r for r in found if r.doc_id == "b"], found


def test_layout_gaps_and_selection(spark):
    text = "Он.\n<!-- block: 1 -->\n\nОна.\n\n<!-- block: 2 -->\n\n<!-- block: 3 -->\nОно."
    d = lines(spark.createDataFrame([("a", text)], "doc_id string, text string"))
    assert [(r.line_no, r.detail) for r in layout_scan(d, only=["blockgap"]).orderBy("line_no").collect()] == [(1, "before"), (7, "after")]
    with pytest.raises(ValueError):
        layout_scan(d, only=["nothing"])
    assert len(KINDS) == 11 and layout_scan(d.limit(0)).count() == 0


def test_style_kinds(spark):
    rows = [
        (1, "Мельница стояла там, где прежде мельница была иной."), (2, "Чистая вода и чистота."), (3, "Он вернулся назад."), (4, "Это будет играть значение."), (5, "Полностью, да, полностью."),
        (6, "Создание, внимание и спасение."), (7, "огромный дом, огромная башня"), (8, "огромное небо огромные горы, гигантский вал"), (9, "типа того"), (10, "Ничего такого нет."),
    ]
    d = spark.createDataFrame([("a", n, t) for n, t in rows], "doc_id string, para_no int, text string")
    got = {(r.para_no, r.kind): (r.word, r.n) for r in style.style_scan(d).collect()}
    assert got[1, "REPETITION"] == ("мельница", 2) and got[2, "ROOT_REPETITION"] == ("чистая … чистота", 2) and got[3, "TAUTOLOGY"][1] == 1 and got[4, "COLLOCATION"][1] == 1
    assert got[5, "REDUNDANCY"] == ("полностью", 2) and got[6, "NOMINALIZATION"][1] == 3 and got[7, "MONOTONY"] == ("огромн", 4) and got[9, "OTHER"] == ("типа", 1)
    assert not [k for k in got if k[0] == 10] and style.style_scan(d.limit(0)).count() == 0


def test_drift_kinds(spark):
    old = [(1, "Ей было 5 лет."), (2, "Он пришёл."), (3, "Пойдём с вами."), (4, "Это Марианна."), (5, "Совсем уйдёт."), (6, "Старое место."), (7, "Прежний оборот речи."), (8, "Мысль"), (9, "Равны.")]
    new = [(1, "Ей было 6 лет."), (2, "Он не пришёл."), (3, "Пойдём с нами."), (4, "Это Светлана."), (20, "Старое место."), (7, "Другой оборот речи."), (8, "_Мысль_"), (9, "Равны."), (10, "Новое.")]
    a, b = (spark.createDataFrame([("d", n, t) for n, t in x], "doc_id string, para_no int, text string") for x in (old, new))
    got = {(r.para_no, r.kind, r.strength) for r in style.drift_kinds(a, b, ["doc_id", "para_no"]).collect()}
    assert {(1, "numbers", "STRONG"), (2, "negation", "STRONG"), (3, "persons", "STRONG"), (4, "names", "STRONG"), (5, "paragraph-lost", "STRONG"), (6, "paragraph-moved", "INFO"), (20, "paragraph-moved", "INFO"),
            (8, "format", "INFO"), (10, "paragraph-added", "STRONG")} <= got
    assert not [x for x in got if x[0] == 9] and {k for n, k, _ in got if n == 7} <= {"wording", "names"}


def test_alignment_of_chapters(spark):
    rows = [("a", "ja", n, 10 * n, [f"g{n}"]) for n in range(1, 6)] + [("a", "ru", 10 * n, 20 * n, [f"g{n}"]) for n in (1, 2, 4, 5)] + [("b", "ru", 1, 5, None)]
    d = spark.createDataFrame(rows, "doc_id string, lang string, para_no int, size int, anchors array<string>")
    got = {(r.doc_id, r.left_from, r.left_to, r.right_from, r.right_to) for r in dp_aligned(d, "ja", "ru").collect()}
    assert {("a", 1, 1, 10, 10), ("a", 5, 5, 50, 50), ("b", None, None, 1, 1)} <= got
    assert dp_aligned(d.limit(0), "ja", "ru").count() == 0


def test_analysis_record_and_report(spark):
    schema = f"chapter string, block int, candidate_id string, sources {evidence.SOURCES}, source string, current string, fidelity string, status string, reason string, suggestion string, action string"
    prior = spark.createDataFrame([("c", 1, "P-1", ([], [], [], False), "s", "t", "FORMAT", "DISPUTED", "a|b", "", "REPORT_ONLY")], schema)
    new = spark.createDataFrame([("c", "r9", 2, "s", "t", "why", "", "ERROR", "HIGH", 1)], "chapter string, run string, block int, source string, current string, reason string, suggestion string, severity string, confidence string, pos int")
    pre = spark.createDataFrame([("c", 3, "s", "t", "tail", 1)], "chapter string, block int, source string, current string, reason string, pos int")
    results = evidence.phase_two(prior, new, pre, ["pos"])
    got = {r.candidate_id: (r.fidelity, r.status, r.action, r.sources.c, r.sources.precheck) for r in results.collect()}
    assert got == {"P-1": ("FORMAT", "DISPUTED", "REPORT_ONLY", [], False), "C-r9-02-01": ("MEANING_SHIFT", "CONFIRMED_ERROR", "REPORT_ONLY", ["r9"], False), "PC-3-01": ("MISSING", "FALSE_POSITIVE", "PRESERVED", [], True)}
    assert evidence.violations(results).count() == 0
    runs = spark.createDataFrame([("c", "a", "r2"), ("c", "a", "r1"), ("c", "c", "r9")], "chapter string, kind string, run string")
    record = evidence.analysis(results, runs).first()
    assert record.inputs == {"a": ["r1", "r2"], "c": ["r9"]} and [r.block for r in record.results] == [1, 2, 3]
    text = evidence.analysis_report(results).first().text
    assert "- CONFIRMED_ERROR: 1\n" in text and "- REPORT_ONLY: 2\n" in text and "| 1 | P-1 | DISPUTED | REPORT_ONLY | a\\|b |" in text


def test_unknown_ids_and_partition(spark):
    cases = spark.createDataFrame([("x", [1, 5]), ("y", [])], "case string, hunks array<int>")
    known = spark.createDataFrame([(1,), (2,)], "id int")
    assert [tuple(r) for r in regression.unknown_ids(cases, "case", "hunks", known, "id").collect()] == [("x", 5)]
    part = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id int")
    assert {tuple(r) for r in regression.partition_errors(part(1, 2, 3), part(1, 3), part(3, 9), "id").collect()} == {(2, "in-neither"), (3, "in-both"), (9, "unknown")}
    assert regression.partition_errors(part(1, 2), part(1), part(2), "id").count() == 0


def test_renderers(spark, tmp_path):
    checked = spark.createDataFrame([("a", 1, "output", True), ("a", 2, "blocks", False)], "doc_id string, check_no int, check string, ok boolean")
    assert sinks.gate_text(checked).first().text == "- [x] output\n- [ ] blocks\n\n1/2 not ready"
    parts = spark.createDataFrame([("v2-ch10", "ten"), ("v2-ch2", "two"), ("v2-credits", "thanks"), ("v2-preface", "hello"), ("v2-epilogue", "end"), ("v2-notes", "n"), ("loose", "x")], "doc_id string, text string")
    row = sinks.volume_text(parts, " ").first()
    assert (row.volume, row.n_parts, row.text) == (2, 6, "hello two ten end n thanks")
    pairs = spark.createDataFrame([("a", 1, "x", None)], "doc_id string, block_no int, left string, right string")
    assert "(no text: OUTPUT)" in sinks.pair_text(pairs).first().text
    sinks.write_json(parts.where("doc_id = 'loose'"), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").first().asDict() == {"doc_id": "loose", "text": "x"}


def test_edits_hold_and_list_limits(spark):
    from pyspark.sql import functions as F

    from weftline.functions.edits import edits_hold
    from weftline.functions.text import first_of_list, has_dialogue, required_run_id
    from weftline.operators.align import not_frozen

    plan = F.array(*[F.struct(F.lit(o).alias("old"), F.lit(n).alias("new")) for o, n in (("cat", "cats"), ("dog", ""))])
    d = spark.createDataFrame([("two cats",), ("a cat",), ("cats dog",)], "t string")
    assert [r[0] for r in d.select(edits_hold(F.col("t"), plan)).collect()] == [True, False, False]
    assert spark.range(1).select(first_of_list(F.array(*map(F.lit, "abcdefghijkl")))).first()[0] == "a, b, c, d, e, f, g, h, i, j (+2)"
    assert [r[0] for r in spark.createDataFrame([("「a」",), ("a",), (None,)], "t string").select(has_dialogue(F.col("t"))).collect()] == [True, False, False]
    run = lambda t: spark.createDataFrame([(t,)], "t string").select(required_run_id(F.col("t")).alias("r")).collect()
    assert run("run 20260101-010203-ab12 x")[0].r == "20260101-010203-ab12"
    with pytest.raises(Exception, match="no run id in: none"):
        run("none")
    rows = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert sorted(str(r.v) for r in not_frozen(rows, spark.createDataFrame([(2,)], "volume int"), "v", "volume").collect()) == ["1", "None"]
