"""Operators against plain Python, with the properties they must keep."""

import random
from collections import Counter

from pyspark.sql import functions as F

from weftline.operators import align, findings, gate, glossary, segment, style, terms


def test_segmentation(spark):
    rng = random.Random(1)
    docs = {f"d{i}": [rng.choice([5, 80, 400, 1700]) for _ in range(rng.randint(1, 60))] for i in range(20)} | {"own": [900, 800, 100, 1600, 5]}

    docs |= {"long": [rng.choice([0, 3, 90, 200, 1600]) for _ in range(1500)], "even": [1] * 1024, "none": [0] * 600}

    def brute(sizes):
        out, no, n, chars = [], 0, 0, 0
        for i, s in enumerate(sizes):
            out.append(no)
            n, chars = n + 1, chars + s
            if n >= 16 or chars >= 1600 or (i + 1 < len(sizes) and not (s and sizes[i + 1])):
                no, n, chars = no + 1, 0, 0
        return out

    assert brute(docs["own"]) == [0, 0, 1, 1, 2]
    paras = spark.createDataFrame([(d, i + 1, "x" * s) for d, ss in docs.items() for i, s in enumerate(ss)], "doc_id string, para_no int, text string")
    for chunk in (1, 4096):  # in chunks of 256 paragraphs (16 blocks), and in one row
        got = {}
        for r in segment.segmented(paras, chunk=chunk).collect():
            got.setdefault(r.doc_id, {})[r.para_no] = r.block_no
        assert {d: [p[i + 1] for i in range(len(p))] for d, p in got.items()} == {d: brute(s) for d, s in docs.items()}


def test_segmentation_of_a_million_paragraphs(spark):
    """One document; no row holds more than a chunk of it."""
    paras = spark.range(1, 1_000_001).select(F.lit("d").alias("doc_id"), F.col("id").cast("int").alias("para_no"), F.repeat(F.lit("x"), (F.col("id") * 7919 % 180).cast("int")).alias("text"))
    got = segment.segmented(paras).agg(F.count("*").alias("n"), F.countDistinct("para_no").alias("d"), F.max("block_no").alias("last")).first()
    no, n, chars = 0, 0, 0
    sizes = [i * 7919 % 180 for i in range(1, 1_000_001)]
    for i, s in enumerate(sizes[:-1]):
        n, chars = n + 1, chars + s
        if n >= 16 or chars >= 1600 or not (s and sizes[i + 1]):
            no, n, chars = no + 1, 0, 0
    assert (got.n, got.d, got.last) == (1_000_000, 1_000_000, no)


def test_speech_marks(spark):
    d = spark.createDataFrame([("「はい」。",), ("　「いや",), ("本文",), ("",)], "x string")
    x = F.col("x")
    got = [tuple(r) for r in d.select(segment.is_speech(x), segment.closes_speech(x), segment.ends_terminal(x), segment.soft_boundary(x, F.lit("a"))).collect()]
    assert got == [(True, True, True, True), (True, False, False, True), (False, False, False, True), (False, False, True, False)]


def test_band_join_loses_no_paragraph(spark):
    rng = random.Random(2)
    cases = {"own": ([10] * 4, [30, 10])} | {f"d{i}": ([rng.randint(0, 30) for _ in range(rng.randint(1, 25))], [rng.randint(0, 20) for _ in range(rng.randint(1, 6))]) for i in range(25)}

    def brute(paras, sizes):
        out, acc, total, whole = [], 0, sum(paras), sum(sizes) or 1
        for p in paras:
            out.append(next((i for i in range(len(sizes)) if acc * whole < total * sum(sizes[: i + 1])), len(sizes) - 1))
            acc += p
        return out

    assert brute(*cases["own"]) == [0, 0, 0, 1]
    p = spark.createDataFrame([(d, i, s) for d, (ps, _) in cases.items() for i, s in enumerate(ps)], "doc_id string, para_no int, size long")
    b = spark.createDataFrame([(d, i, s) for d, (_, bs) in cases.items() for i, s in enumerate(bs)], "doc_id string, block_no int, size long")
    got = {}
    for r in align.band_join(p, b).collect():
        got.setdefault(r.doc_id, {})[r.para_no] = r.block_no
    assert {d: [v[i] for i in range(len(v))] for d, v in got.items()} == {d: brute(*c) for d, c in cases.items()}


def test_merged_view_and_pairs(spark):
    s = spark.createDataFrame([("d", 1, "en", 1, "a"), ("d", 1, "en", 2, "b"), ("d", 2, "ru", 1, "c")], "doc_id string, block_no int, lang string, entry int, text string")
    assert sorted(tuple(r) for r in align.merged_view(s, ["en", "ru"]).collect()) == [("d", 1, "b", "—"), ("d", 2, "—", "c")]
    pairs = align.pair_blocks(s.where("lang = 'en' AND entry = 1"), s.where("lang = 'ru'"), ["doc_id", "block_no"])
    assert [tuple(r) for r in align.side_notes(pairs, "doc_id", "block_no").collect()] == [("d", 2, "1", "2")]


def test_matching_counts(spark):
    rng = random.Random(3)
    make = lambda n: [(rng.choice([1, 2, None]), rng.choice(["P", "p", "q"]), rng.choice(["a b", "ab", "c"]), i) for i in range(n)]
    a, b = make(60), make(45)
    schema = "block int, problem string, source string, ord int"
    got = Counter(r.status for r in findings.matched(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["ord"]).collect())
    key = lambda rows: Counter((x, p.lower(), s.replace(" ", "")) for x, p, s, _ in rows if x is not None)
    ka, kb = key(a), key(b)
    assert got == Counter(BOTH_FOUND=sum((ka & kb).values()), ONLY_A=sum((ka - kb).values()), ONLY_B=sum((kb - ka).values()))


def test_gaps_and_runs(spark):
    f = spark.createDataFrame([("d", 2, "X", "LOW"), ("d", 4, "Y", "LOW"), ("e", None, None, None)], "doc string, block int, finding string, confidence string")
    got = sorted((r.doc, r.block, r.finding) for r in findings.gap_filled(f, "doc").collect())
    assert got == [("d", 1, "NONE"), ("d", 2, "X"), ("d", 3, "NONE"), ("d", 4, "Y"), ("e", 1, "NONE")]
    runs = spark.createDataFrame([("c", "r1", 9), ("c", "r3", 1), ("c", "r2", 5), ("c", "r9-phase1", 7)], "chapter string, run string, mtime int")
    keep = ~F.col("run").contains("phase1")
    assert findings.latest(runs, ["chapter"], "run", keep).first().run == "r3"
    assert findings.latest(runs, ["chapter"], "mtime", keep).first().run == "r1"
    assert findings.first_of(runs, ["chapter"], ["mtime"]).first().run == "r3"
    assert [r.candidate_id for r in findings.candidate_ids(runs, "chapter", "C", ["run"]).orderBy("run").collect()] == ["C01", "C02", "C03", "C04"]


def test_decisions(spark):
    d = spark.createDataFrame([("ERROR", "HIGH"), ("ERROR", "LOW"), ("x", "HIGH")], "s string, c string")
    status = findings.status_of(F.col("s"), F.col("c"))
    got = [tuple(r) for r in d.select(status, findings.fidelity_of(status), findings.fidelity_of(status, "loss"), findings.action_of(status)).collect()]
    assert got[0] == ("CONFIRMED_ERROR", "MEANING_SHIFT", "COMPONENT_LOSS", "REPORT_ONLY") and got[1][:2] == ("DISPUTED", "COMPONENT_LOSS")
    one = spark.createDataFrame([("FIXED", ["r1"], "r2"), ("PRESERVED", [], "r2"), ("x", ["r2"], "r2")], "a string, src array<string>, run string")
    assert [tuple(r) for r in one.select(findings.clamped(F.col("a")), findings.with_source(F.col("src"), F.col("run"))).collect()] == [("REPORT_ONLY", ["r1", "r2"]), ("PRESERVED", []), ("x", ["r2"])]
    f = F.struct(F.lit("odd").alias("issue_type"), *[F.lit("v").alias(x) for x in findings.OMISSION[:-1]], F.lit(None).cast("string").alias(findings.OMISSION[-1]))
    r = one.limit(1).select(findings.normalised(f, ("GRAMMAR",), "OTHER").alias("f")).first().f
    assert r.issue_type == "OTHER" and r.ja_span is None
    assert findings.same_counts(findings.counted(one, "a"), findings.counted(one, "a")).count() == 0


def test_terms(spark):
    p = spark.createDataFrame([("d", 1, 1, "Аурелия и Аурелию"), ("d", 2, 2, "маг Аурелии"), ("d", 9, 3, "Брун, брун"), ("d", 10, 4, "магия")], "doc_id string, block_no int, para_no int, text string")
    stems = spark.createDataFrame([(1, "аурел", "Аурелия"), (2, "маги", "Магия")], "line_no int, stem string, canon string")
    got = sorted((r.block_no, r.canon, r.form) for r in glossary.stem_hits(p, stems).collect())
    assert got == [(1, "Аурелия", "Аурелия"), (2, "Аурелия", "Аурелии"), (10, "Магия", "магия")]
    pairs = lambda gap: sorted((r.variant_a, r.block_a, r.variant_b, r.block_b, r.n) for r in terms.variant_candidates(p, ["аурели", "брун"], gap).collect())
    # Positions count the blocks that are there: block 9 is next to block 2.
    assert pairs(1) == [("аурели", 2, "брун", 9, 2)] and pairs(2) == [("аурели", 1, "брун", 9, 4), ("аурели", 2, "брун", 9, 2)]
    assert terms.variant_candidates(p, ["аурели"], 3).count() == 0
    hits = terms.keyword_contexts(p, "аурели", 2, 3)
    assert [r.context for r in terms.top_k(hits, ["doc_id"], ["para_no", "start"], 2).orderBy("rank").collect()] == ["Аурелия и", "и Аурелию"]


def test_anchors(spark):
    rows = spark.createDataFrame([("d", 1, "Аурелия взяла 10,000 монет", "アウレリアは一万")], "doc_id string, block_no int, ru string, ja string")
    entries = spark.createDataFrame([("g:アウレリア", "アウレリア", "Aurelia", "аурелия"), ("g:x", "x", "x", "рели")], "key string, ja string, en string, ru string")
    got = lambda lang: {r.anchor for r in glossary.anchors(rows, entries, lang, lang).collect()}
    assert got("ru") == got("ja") == {"g:アウレリア", "\x0010000"}


def test_gate(spark):
    from datetime import datetime as t

    full = {
        "doc_id": "ok", "output_at": t(2026, 1, 2), "text": "a", "audit_at": t(2026, 1, 3), "audit_text": "## FINAL READ\nGRAMMAR STYLE FORMAT", "precheck_at": t(2026, 1, 1),
        "ja_blocks": [1, 2], "ru_blocks": [2, 1], "scan_at": dict.fromkeys(gate.SCANS, t(2026, 1, 3)), "runs_a": 1, "runs_b": 1, "phase1": 1, "phase2": 1,
    }
    broken = {
        "output": {"output_at": None}, "blocks": {"ru_blocks": [1]}, "scans": {"scan_at": {**full["scan_at"], "style": t(2025, 1, 1)}}, "precheck": {"precheck_at": None}, "runs": {"runs_b": 0},
        "phase1": {"phase1": 0}, "phase2": {"phase2": 0}, "audit": {"audit_at": t(2025, 1, 1)}, "final-read": {"audit_text": "GRAMMAR STYLE FORMAT"}, "summary-lines": {"audit_text": "## FINAL READ\nGRAMMAR"},
        "open-decisions": {"text": "<!-- ??? -->"}, "markers": {"text": "a\n###\nb"},
    }
    rows = [full] + [{**full, **change, "doc_id": name} for name, change in broken.items()]
    schema = "doc_id string, output_at timestamp, text string, audit_at timestamp, audit_text string, precheck_at timestamp, ja_blocks array<int>, ru_blocks array<int>, scan_at map<string,timestamp>, runs_a int, runs_b int, phase1 int, phase2 int"
    checked = gate.checks(spark.createDataFrame(rows, schema)).cache()
    failed = {}
    for r in checked.where("NOT ok").collect():
        failed.setdefault(r.doc_id, set()).add(r.check)
    assert {d: f for d, f in failed.items() if d != "output"} == {d: {d} for d in broken if d != "output"}
    assert "output" in failed["output"] and {r.doc_id for r in gate.verdicts(checked).where("ready").collect()} == {"ok"}


def test_style(spark):
    p = spark.createDataFrame([("d", i, "magic word") for i in (1, 2, 3, 9)], "doc_id string, para_no int, text string")
    assert {(r.word, r.para_no) for r in style.repetition(p, near=1).collect()} == {("magic", 2)}
    found = style.drift(p, p.where("para_no < 9").withColumn("text", F.when(F.col("para_no") == 1, "Magic, word").otherwise("magic 5")), ["doc_id", "para_no"])
    got = {(r.para_no, r.kind) for r in found.collect()}
    assert got == {(1, "format"), (2, "numbers"), (3, "numbers"), (9, "paragraph-lost")}
    assert style.unexplained(found, p.where("para_no = 9"), ["doc_id", "para_no"]).count() == 3
    view = spark.createDataFrame([("d", 1, "5", "no end"), ("d", 2, "a", None), ("d", 3, "a", "Done.")], "doc_id string, block_no int, s string, t string")
    assert {(r.block_no, r.signal) for r in style.omission_signals(view, "s", "t").collect()} == {(1, "S1-open-end"), (1, "S3-number"), (2, "S2-empty")}


def test_stream(spark, tmp_path):
    from weftline.plans.rules import Rule
    from weftline.streaming import windowed_findings

    spark.sql("SELECT timestamp'2026-01-01 00:00:01' AS ts, 'a1' AS text UNION ALL SELECT timestamp'2026-01-01 00:00:02', 'b'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string").parquet(str(tmp_path / "in"))
    none = F.lit("")
    out = windowed_findings(stream, ["text"], [Rule("digit", "weak", F.col("text").rlike("[0-9]"), none, none, none)], "ts")
    q = out.writeStream.outputMode("complete").format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.kind, r.n) for r in spark.sql("SELECT kind, n FROM found").collect()] == [("digit", 1)]
