"""Plans validated as a whole, versions published or rejected, ledgers with broken files."""

import os
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline.functions.text import collapse_blank_lines, strip
from weftline.operators import gate
from weftline.sources import ledger, plans, sinks, versions
from weftline.sources.blocks import blocks as blocks_reader
from weftline.sources.blocks import split_blocks
from weftline.sources.runs import RUN, project_files

PLANS = {
    "pairs": '[["a", "b"], ["c", "d"]]', "objects": '[{"old": "a", "new": "", "count": 2, "allow_empty": true}]', "wrapped": '{"replacements": [["c", "d"]]}', "none": "[]",
    "cut": '[["a"', "number": "3", "wrong": '{"replace": []}', "string": '"[]"', "mojibake": '[["a�", "b"]]', "null": None,
    "many": '[["", "b"], ["a", "a"], ["a"], ["a", 1], {"old": 5, "new": "x"}, {"old": "a", "new": ""}, {"old": "a", "new": "b", "count": -1}, {"old": "a", "new": "b", "count": "2"}, {"old": " ", "new": "b"}, null, {"old": "a", "new": "b", "count": null}]',
}


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "path string, json string")


def test_every_fault_of_every_plan(spark):
    found = plans.items(frame(spark, PLANS)).persist()
    got = {(r.path, r.item_no, r.fault) for r in plans.faults(found).collect()}
    many = ["old-empty", "no-change", "unknown-item", "new-not-a-string", "old-empty", "new-empty", "bad-count", "bad-count", "old-empty", "unknown-item"]
    assert got == {("cut", None, "not-json"), ("null", None, "not-json"), ("number", None, "not-a-list"), ("wrong", None, "not-a-list"), ("string", None, "not-a-list"), ("mojibake", None, "corrupt-encoding")} | {
        ("many", i, f) for i, f in enumerate(many, 1)
    }
    good = {r.path: [(s.old, s.new, s["count"]) for s in r.plan] for r in plans.good_plans(found).collect()}
    assert good == {"pairs": [("a", "b", None), ("c", "d", None)], "objects": [("a", "", 2)], "wrapped": [("c", "d", None)]}
    assert plans.items(frame(spark, PLANS).limit(0)).count() == 0


def test_plans_are_applied_whole_or_not_at_all(spark):
    texts = {1: "a a c", 2: "a c", 3: "no such", 4: "ab", 5: "x"}
    sheets = {1: '[{"old": "a", "new": "", "count": 2, "allow_empty": true}, ["c", "d"]]', 2: '[["c", "d"], {"old": "a", "new": "b", "count": 2}]', 3: '[["a", "b"]]', 4: '[["b", "ba"], ["a", "b"], ["bb", "a"]]'}
    blocks = spark.createDataFrame(list(texts.items()), "block_no int, text string")
    found = plans.good_plans(plans.items(spark.createDataFrame(list(sheets.items()), "block_no int, json string"), keep=("block_no",)), ("block_no",))
    got = {r.block_no: (r.text, r.done) for r in plans.applied(blocks, found, ["block_no"]).collect()}
    assert got == {1: ("  d", None), 2: ("a c", "count-differs"), 3: ("no such", "not-found"), 4: ("ab", "old-text-left")}


def test_versions_are_published_or_rejected(spark, tmp_path):
    root = str(tmp_path / "table")
    d = spark.createDataFrame([(1, "a"), (2, "b")], "block_no int, text string")
    checks = {"empty text": F.col("text") != ""}
    assert versions.current(spark, root) is None
    with pytest.raises(LookupError):
        versions.read(spark, root)
    assert versions.publish(d, root, checks, ("block_no",)).number == 1
    for bad, problems in ((d.withColumn("text", F.lit("")), {"empty text": 2}), (d.union(d), {"keys that come twice": 2}), (d.withColumn("text", F.lit(None).cast("string")), {"empty text": 2})):
        with pytest.raises(versions.Rejected) as caught:
            versions.publish(bad, root, checks, ("block_no",))
        assert caught.value.problems == problems
    assert versions.current(spark, root).number == 1 and sorted(map(tuple, versions.read(spark, root).collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):  # a write that fails half way publishes nothing
        versions.publish(d.withColumn("text", (F.lit(1) / (F.col("block_no") - 2)).cast("string")), root, checks)
    assert versions.publish(d.where("block_no = 1"), root, checks).number == 2
    assert versions.read(spark, root).count() == 1 and versions.read(spark, root, 1).count() == 2
    assert versions.publish(d.limit(0), root, checks, ("block_no",)).number == 3 and versions.read(spark, root).count() == 0


def test_two_writers_of_one_version(spark, tmp_path):
    root = str(tmp_path / "table")
    d = spark.createDataFrame([(1, "a")], "block_no int, text string")
    versions.publish(d, root, {})
    rows = [(2, "0" * 32, 1, 1, 0), (2, "f" * 32, 1, 1, 0)]  # both started from the first version
    spark.createDataFrame(rows, versions.MANIFEST).write.mode("append").json(f"{root}/manifest")
    assert versions.current(spark, root).id == "0" * 32


def test_broken_files_are_kept_apart(spark, tmp_path):
    whole = '{"tasks": [\n {"id": "t", "subtasks": [\n  {"id": "s", "kind": "sma-c", "attempts": [{"prompt": "x"}, {"prompt": "use \\"audit_run_id\\": \\"r1\\" now"}]},\n  {"id": "u", "kind": "analyzer", "attempts": []},\n'
    whole += '  {"id": "v", "kind": "analyzer-phase1", "attempts": [{"prompt": "Запуск фазы: r2.x. Ещё"}]}, {"id": "w", "kind": "odd", "attempts": [{"prompt": "r9"}]}, {"id": "y", "kind": "sma-c"}]}]}'
    (tmp_path / "a.json").write_text(whole)
    (tmp_path / "b.json").write_text(whole[:-9])
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.json").write_text('{"tasks": 7}')
    (tmp_path / "runs.txt").write_text('{"audit_run_id": "r1", "findings": [{"block": 1}, {"block": 2}]}\n{"audit_run_id": "r1", "findings": [{"block": 3}]}\nnonsense\n')
    good, broken = ledger.quarantined(spark, str(tmp_path), ledger.LEDGER)
    assert {r.path.rsplit("/", 1)[1] for r in broken.collect()} >= {"b.json", "d.json"} and good.count() == 1
    runs, lost = ledger.quarantined(spark, str(tmp_path), RUN, "*.txt", whole=False)
    assert [r.text for r in lost.collect()] == ["nonsense"]
    got = {r.subtask: (r.attempts, r.run, r.n_findings, r.problem) for r in ledger.chained(ledger.last_attempts(good), runs).collect()}
    assert got == {
        "s": (2, "r1", 3, None), "u": (0, None, None, "no-attempt"), "v": (1, "r2.x", None, "no-run-file"), "w": (1, None, None, "no-run-id"), "y": (0, None, None, "no-attempt"),
    }


def test_gate_from_a_tree_of_files(spark, tmp_path):
    """A complete chapter, then one file changed at a time; times are set on the files."""

    def tree(name, change=lambda p, touch: None):
        root = tmp_path / name / "project"

        def touch(path, text="x", at=100):
            file = root / path
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(text)
            os.utime(file, (1_700_000_000 + at, 1_700_000_000 + at))

        blocks_ = "# T\n\n<!-- block: 1 -->\n\na\n\n<!-- block: 2 -->\n\nb\n\n### head"
        touch("output/v3-ch10.md", blocks_)
        touch("ja/v3-ch10.md", blocks_, 1)
        for scan in gate.SCANS:
            touch(f"prefilter/v3-ch10-{scan}.md", at=100)
        for path in ("precheck/omission-precheck", "a/r1", "b/r1", "analysis/r1.phase1", "analysis/r1"):
            touch(f"sma/v3-ch10/{path}.json", "{}", 5)
        touch("audit/v03-ch10.md", "## FINAL READ\nGRAMMAR\nSTYLE\nFORMAT", 200)
        touch("audit/v3-ch10.md", "an older report", 300)
        touch("notes/readme.md")
        change(root, touch)
        checked = gate.checks(gate.evidence_of(project_files(spark, str(root))))
        return {r.check for r in checked.where("NOT ok").collect()}

    without = lambda p: lambda root, touch: (root / p).unlink()
    assert tree("whole") == set()
    assert tree("stale", lambda _, touch: touch("prefilter/v3-ch10-style.md", at=99)) == {"scans"} and tree("noscan", without("prefilter/v3-ch10-address.md")) == {"scans"}
    assert tree("short", lambda _, touch: touch("output/v3-ch10.md", "<!-- block: 2 -->\nb")) == {"blocks"} and tree("noja", without("ja/v3-ch10.md")) == {"blocks"}
    assert tree("runs", without("sma/v3-ch10/b/r1.json")) == {"runs"} and tree("one", without("sma/v3-ch10/analysis/r1.phase1.json")) == {"phase1"} and tree("two", without("sma/v3-ch10/analysis/r1.json")) == {"phase2"}
    assert tree("pre", without("sma/v3-ch10/precheck/omission-precheck.json")) == {"precheck"}
    assert tree("audit", lambda _, touch: touch("audit/v03-ch10.md", "## FINAL READ\nGRAMMAR STYLE FORMAT", 50)) == {"audit"}
    assert tree("plain", without("audit/v03-ch10.md")) == {"final-read", "summary-lines"}  # the report without the padding is read then
    assert tree("open", lambda _, touch: touch("output/v3-ch10.md", "<!-- block: 1 -->\n<!-- ??? -->\n<!-- block: 2 -->\n  ####  \n")) == {"open-decisions", "markers"}
    assert tree("none", without("output/v3-ch10.md")) == {"output", "blocks", "scans", "audit", "open-decisions", "markers"}


def test_runs_as_of_outputs(spark):
    states = spark.createDataFrame([("a", 1, "v1"), ("a", 5, "v2"), ("a", 5, "v3"), ("b", 3, "w")], "doc string, at int, seen string")
    events = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 4, 3), ("a", 5, 4), ("a", 5, 4), ("c", 9, 5), (None, 1, 6)], "doc string, at int, n int")
    got = sorted((r.n, r.seen) for r in gate.as_of(events, states, ["doc"], "at", "seen").collect())
    assert got == [(1, None), (2, "v1"), (3, "v1"), (4, "v3"), (4, "v3"), (5, None), (6, None)]


def test_large_block_files_are_read_in_splits(spark, tmp_path):
    rng = random.Random(4)
    docs = {}
    for d in ("1", "2"):
        text = "# Title\n\nbefore\n"
        for n in range(1, 400):
            text += f"<!-- block: {n if n % 50 else n - 1} -->\n\n" + "\n\n".join(rng.choice(["para", "é" * 40, "# no text", "<!-- note -->", "see <!-- block: 9 --> here", "<!-- block: x -->", "line\r"]) for _ in range(rng.randint(0, 4))) + "\n\n"
        docs[d] = text
        folder = tmp_path / "files" / f"volume={d}"
        folder.mkdir(parents=True)
        cut = text.index("<!-- block: 201 -->")
        (folder / "part-00000.txt").write_bytes(text[:cut].encode())
        (folder / "part-00001.txt").write_bytes(text[cut:].encode())
    whole = blocks_reader(spark.createDataFrame(list(docs.items()), "doc_id string, text string"), "last").select("doc_id", "block_no", "para_no", "text")
    want = sorted(map(tuple, whole.collect()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("2000", old):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = split_blocks(spark, str(tmp_path / "files"), "volume")
            assert sorted(map(tuple, found.collect())) == want
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_volume_in_ranges(spark, tmp_path):
    rows = [("v1-ch02", "two\nlines"), ("v1-ch01", "one"), ("v1-preface", "pre\n"), ("v2-ch01", "x" * 50), ("v1-credits", ""), ("no-volume", "y"), ("v1-ch10", "ten"), ("v1-notes", "n")]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    index = sinks.write_ordered(sinks.volume_pieces(d), str(tmp_path / "book"), "volume", ["place", "number", "doc_id", "key", "piece"], bytes_per_file=20).collect()
    want = {str(r.volume): r.text for r in sinks.volume_text(d).collect()}
    for v, text in want.items():
        files = sorted((r for r in index if r.volume == v), key=lambda r: r.file_no)
        held = [Path(r.path.removeprefix("file:")).read_bytes() for r in files]
        assert b"".join(held).decode() == text + "\n"
        assert [r.offset for r in files] == [sum(map(len, held[:i])) for i in range(len(held))] and [r.bytes for r in files] == list(map(len, held))
    assert len(index) > 3
    assert sinks.write_ordered(sinks.volume_pieces(d.limit(0)), str(tmp_path / "none"), "volume", ["piece"]).count() == 0


def test_blanks_inside_a_text_are_stripped_in_linear_time(spark):
    inner = " \t" * 500_000
    d = spark.createDataFrame([("  a" + inner + "b \n",), (" \n",), ("",), (None,), ("x",)], "t string")
    began = time.time()
    got = [r[0] for r in d.select(strip(F.col("t"))).collect()]
    assert got == ["a" + inner + "b", "", "", None, "x"]
    assert d.select(collapse_blank_lines(F.col("t"))).first()[0] == "  a" + inner + "b"
    assert time.time() - began < 20
