"""Plans, versions, ledgers and reports on the driver tables, through files the queries write; each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.edits import occurrences
from weftline.functions.text import corrupt, upper_letters
from weftline.operators import gate
from weftline.queries import query, table
from weftline.scan_queries import _PART
from weftline.sources import ingest, ledger, plans, sinks, versions
from weftline.sources.blocks import split_blocks
from weftline.sources.runs import RUN, archive
from weftline.sources.staging import new_path, staged


def turn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, block_no, text): every turn of the conversations as a block."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_no"), F.coalesce("text", F.lit("")).alias("text"))


def turn_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, block_no, json): a plan for every turn, of eight kinds, written and read as lines of JSON."""
    w = F.regexp_extract("text", r"\p{L}+", 0)
    d = turn_blocks(spark, sf_dir).withColumn("w", w).withColumn("n", occurrences(F.col("text"), F.col("w"))).withColumn("up", F.concat(upper_letters(F.col("w")), F.lit("x")))
    pair = lambda a, b: F.array(a, b)
    entry = lambda n: F.to_json(F.array(F.struct(F.col("w").alias("old"), F.col("up").alias("new"), n.alias("count"))))
    kinds: list[Column] = [
        F.to_json(F.array(pair(F.col("w"), F.col("up")))), entry(F.col("n")), entry(F.col("n") + 1), F.to_json(F.array(pair(F.concat(F.lit("zqx"), "w"), F.col("up")))),
        F.concat(F.lit('[["'), "w"), F.to_json(F.array(pair(F.col("w"), F.col("up")), pair(F.lit(""), F.lit("b")))), F.concat(F.lit('[{"old": "'), "w", F.lit('", "new": ""}, 3]')),
        F.concat(F.lit('{"replacements": [["'), "w", F.lit('", "'), "w", F.lit('"]]}')),
    ]
    which, json = F.pmod(F.col("doc_id") + F.col("block_no"), F.lit(8)), F.lit(None).cast("string")
    for i, k in enumerate(kinds):
        json = F.when(which == i, k).otherwise(json)
    path = new_path(spark, "plans")
    d.select("doc_id", "block_no", json.alias("json")).write.json(path)
    return spark.read.schema("doc_id long, block_no int, json string").json(path)


_TURN_PLANS = r"""
t AS (SELECT conv_id AS doc_id, turn AS block_no, coalesce(text, '') AS text, regexp_extract(coalesce(text, ''), '\p{L}+') AS w, (conv_id + turn) % 8 AS k FROM conversations),
p AS (SELECT *, upper(w) || 'x' AS up, CASE WHEN w = '' THEN 0 ELSE (length(text) - length(replace(text, w, ''))) // length(w) END AS n FROM t)
"""


@query(f"""WITH {_TURN_PLANS},
f AS (SELECT doc_id, block_no, NULL::INT AS item_no, 'not-json' AS fault FROM p WHERE k = 4
  UNION ALL SELECT doc_id, block_no, 1, CASE WHEN w = '' THEN 'old-empty' WHEN k = 6 THEN 'new-empty' WHEN k = 7 THEN 'no-change' END FROM p WHERE k <> 4 AND k <> 3 AND (w = '' OR k IN (6, 7))
  UNION ALL SELECT doc_id, block_no, 2, CASE k WHEN 5 THEN 'old-empty' ELSE 'unknown-item' END FROM p WHERE k IN (5, 6))
SELECT * FROM f""")
def plan_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All faults of all plans, by plan and item."""
    return plans.faults(plans.items(turn_plans(spark, sf_dir), keep=("doc_id", "block_no")), ("doc_id", "block_no"))


@query(f"""WITH {_TURN_PLANS},
a AS (SELECT doc_id, block_no, text, w, up, n, k, CASE WHEN k = 3 THEN 'not-found' WHEN k = 2 THEN 'count-differs' WHEN contains(replace(text, w, up), w) AND NOT contains(up, w) THEN 'old-text-left' END AS done,
  k < 4 AND (w <> '' OR k = 3) AS planned FROM p)
SELECT doc_id, block_no, md5(CASE WHEN planned AND done IS NULL THEN replace(text, w, up) ELSE text END) AS digest, CASE WHEN planned THEN done END AS done, 2::BIGINT AS version FROM a""")
def plan_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns as a versioned table: the first version, one with blocks that come twice and broken texts (rejected), one with all good plans applied."""
    root, keys = new_path(spark, "published"), ["doc_id", "block_no"]
    checks = {"broken encoding": ~corrupt(F.col("text")), "no number": F.col("block_no") >= 0}
    versions.publish(turn_blocks(spark, sf_dir), root, checks, tuple(keys))
    first = versions.read(spark, root)
    bad = first.unionByName(first.where("block_no = 0").withColumn("text", F.concat("text", F.lit("�"))))
    try:
        versions.publish(bad, root, checks, tuple(keys))
    except versions.Rejected as rejected:
        if set(rejected.problems) != {"broken encoding", "keys that come twice"}:
            raise
    good = plans.good_plans(plans.items(turn_plans(spark, sf_dir), keep=tuple(keys)), tuple(keys))
    outcome = plans.applied(first, good, keys)
    versions.publish(sinks.replaced(first, outcome.where("done IS NULL").select(*keys, "text")), root, checks, tuple(keys))
    now = versions.current(spark, root)
    d = versions.read(spark, root).join(outcome.select(*keys, "done"), keys, "left")
    return d.select(*keys, F.md5(F.col("text").cast("binary")).alias("digest"), "done", F.lit(now.number).cast("long").alias("version"))


def event_ledgers(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Folders of ledgers (a file of many lines for each twenty users, every eighth cut short) and of runs (a line each, every 97th cut short)."""
    d = table(spark, sf_dir, "events").withColumn("run", F.concat(F.lit("R-"), "event_id"))
    kind = F.when(F.col("event_type") == "click", "sma-c").when(F.col("event_type") == "view", "analyzer-phase1").when(F.col("event_type") == "error", "other").otherwise("analyzer")
    prompt = F.when(kind == "sma-c", F.concat(F.lit('Write {"audit_run_id": "'), "run", F.lit('"}.'))).when(kind == "analyzer-phase1", F.concat(F.lit("Запуск фазы: "), "run", F.lit(". Далее.")))
    prompt = prompt.when(kind == "analyzer", F.concat(F.lit("Запуск анализа: "), "run", F.lit("."))).otherwise(F.concat(F.lit("See "), "run"))
    attempts = d.groupBy("user_id", "event_type", kind.alias("kind")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", prompt.alias("prompt")))).alias("a"))
    sub = F.struct(F.col("event_type").alias("id"), "kind", F.transform("a", lambda x: F.struct(x["prompt"].alias("prompt"))).alias("attempts"))
    tasks = attempts.groupBy("user_id").agg(F.collect_list(sub).alias("subtasks"))
    number = F.floor(F.col("user_id") / 20)
    whole = tasks.groupBy(number.alias("ledger")).agg(F.collect_list(F.struct(F.col("user_id").cast("string").alias("id"), "subtasks")).alias("tasks"))
    text = F.to_json(F.struct("tasks"), {"pretty": "true"})
    text = F.when(F.col("ledger") % 8 == 3, F.left(text, F.length(text) - 5)).otherwise(text)
    ledgers, runs = new_path(spark, "ledgers"), new_path(spark, "runs")
    whole.select("ledger", text.alias("value")).repartition(spark.sparkContext.defaultParallelism, "ledger").write.partitionBy("ledger").text(ledgers)
    found = F.transform(F.slice(F.sequence(F.lit(1), F.lit(4)), 1, (F.col("event_id") % 4).cast("int")), lambda i: F.struct(i.alias("block"), F.col("event_type").alias("problem")))
    line = F.to_json(F.struct(F.col("run").alias("audit_run_id"), F.col("user_id").cast("string").alias("chapter"), found.alias("findings")))
    line = F.when(F.col("event_id") % 97 == 0, F.left(line, F.length(line) - 3)).otherwise(line)
    d.where("event_id % 5 <> 0").select(line.alias("value")).write.text(runs)
    return ledgers, runs


_LEDGER_SQL = """
a AS (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS last, count(*) AS n FROM events GROUP BY ALL),
k AS (SELECT *, user_id // 20 AS ledger, CASE event_type WHEN 'click' THEN 'sma-c' WHEN 'view' THEN 'analyzer-phase1' WHEN 'error' THEN 'other' ELSE 'analyzer' END AS kind FROM a)
"""


@query(f"""WITH {_LEDGER_SQL},
r AS (SELECT ledger, user_id::VARCHAR AS task, event_type AS subtask, kind, n::INT AS attempts, CASE WHEN kind <> 'other' THEN 'R-' || last END AS run, CASE WHEN kind <> 'other' AND last % 5 <> 0 AND last % 97 <> 0 THEN (last % 4)::BIGINT END AS n_findings FROM k WHERE ledger % 8 <> 3)
SELECT ledger, task, subtask, kind, attempts, run, n_findings, CASE WHEN run IS NULL THEN 'no-run-id' WHEN n_findings IS NULL THEN 'no-run-file' END AS problem FROM r
UNION ALL SELECT DISTINCT ledger, NULL, NULL, NULL, NULL, NULL, NULL, 'broken-ledger' FROM k WHERE ledger % 8 = 3
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'broken-run' FROM events WHERE event_id % 5 <> 0 AND event_id % 97 = 0""")
def ledger_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every subtask of the ledgers with the findings of the run its last attempt names, and every ledger and run that does not parse."""
    at, runs_at = event_ledgers(spark, sf_dir)
    ledgers, broken = ledger.quarantined(spark, at, ledger.LEDGER, "part-*")
    runs, lost = ledger.quarantined(spark, runs_at, RUN, "part-*", whole=False)
    number = F.regexp_extract("path", "ledger=([^/]+)/", 1).cast("long")
    columns = ["ledger", "task", "subtask", "kind", "attempts", "run", "n_findings", "problem"]
    chain = ledger.chained(ledger.last_attempts(ledgers.select("tasks", number.alias("ledger")), "ledger"), runs).select(*columns)
    bad = broken.select(number.alias("ledger"), F.lit("broken-ledger").alias("problem")).unionByName(lost.select(F.lit(None).cast("long").alias("ledger"), F.lit("broken-run").alias("problem")))
    return chain.unionByName(bad, allowMissingColumns=True)


def chapter_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a project of which every conversation is a chapter, packed; what each lacks follows from its number."""
    c = F.col("conv_id").cast("long")
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set("turn")).alias("turns")).withColumn("stem", F.format_string("v%d-ch%d", c % 7 + 1, c))
    start = F.timestamp_seconds(F.lit(1767225600) + c * 3600)
    minute = lambda n: start + F.make_dt_interval(mins=n)
    marked = lambda ts: F.array_join(F.transform(ts, lambda n: F.format_string("<!-- block: %d -->\n\ntext", n)), "\n\n")
    kept = F.filter("turns", lambda n: (n != 1) | (c % 3 != 0))
    body = F.concat(marked(kept), F.when(c % 12 == 0, "\n<!-- ??? -->").otherwise(""), F.when(c % 14 == 0, "\n\n###\n").otherwise("\n\n### heading\n"))
    notes = F.concat(F.when(c % 6 != 0, "## FINAL READ\n").otherwise("## NOTES\n"), F.when(c % 8 != 0, "GRAMMAR STYLE FORMAT").otherwise("GRAMMAR STYLE FORMATS"))
    padded = F.format_string("v%02d-ch%d", c % 7 + 1, c)
    name = F.when(c % 2 == 0, padded).otherwise(F.col("stem"))
    file = lambda ok, path, at, text: F.when(ok, F.array(F.struct(path.alias("path"), at.alias("modified"), text.alias("text")))).otherwise(F.array())
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i")) for i, k in enumerate(gate.SCANS)])
    scans = F.transform(F.filter(kinds, lambda s: (c + s["i"]) % 13 != 0), lambda s: F.struct(F.concat(F.lit("/p/prefilter/"), "stem", F.lit("-"), s["k"], F.lit(".md")).alias("path"), F.when((c + s["i"]) % 9 == 0, minute(F.lit(5))).otherwise(minute(F.lit(10))).alias("modified"), F.lit("r").alias("text")))
    runs = lambda folder, n, tail: F.transform(F.slice(F.sequence(F.lit(1), F.lit(4)), 1, n.cast("int")), lambda i: F.struct(F.concat(F.lit("/p/sma/"), "stem", F.lit(f"/{folder}/r"), i.cast("string"), F.lit(f"{tail}.json")).alias("path"), minute(i).alias("modified"), F.lit("{}").alias("text")))
    files = F.concat(
        file(c % 7 != 0, F.concat(F.lit("/p/output/"), "stem", F.lit(".md")), minute(F.lit(10)), body), file(c % 17 != 0, F.concat(F.lit("/p/ja/"), "stem", F.lit(".md")), minute(F.lit(0)), marked(F.col("turns"))), scans,
        file(c % 5 != 0, F.concat(F.lit("/p/sma/"), "stem", F.lit("/precheck/omission-precheck.json")), minute(F.lit(1)), F.lit("{}")), runs("a", c % 4, ""), runs("b", (c + 1) % 4, ""), runs("c", F.lit(1), ""),
        runs("analysis", c % 3, ".phase1"), runs("analysis", (c + 1) % 3, ""), file(c % 11 != 0, F.concat(F.lit("/p/audit/"), name, F.lit(".md")), minute(F.when(c % 4 < 2, 11).otherwise(9)), notes),
        file((c % 10 == 0) & (c % 11 != 0), F.concat(F.lit("/p/audit/"), "stem", F.lit(".md")), minute(F.lit(50)), F.lit("old")),
    )
    path = new_path(spark, "project")
    d.select(F.inline(files)).write.parquet(path)
    return archive(spark, path)


@query("""WITH c AS (SELECT conv_id AS c, list(DISTINCT turn) AS turns FROM conversations GROUP BY conv_id),
k AS (SELECT c, 'v' || (c % 7 + 1) || '-ch' || c AS doc_id, c % 7 <> 0 AS o, c % 17 <> 0 AND NOT (c % 3 = 0 AND list_contains(turns, 1)) AS covered,
  len(list_filter(range(0, 5), lambda i: (c + i) % 13 = 0 OR (c + i) % 9 = 0)) = 0 AS scans FROM c),
x AS (SELECT doc_id, unnest([o, o AND covered, o AND scans, c % 5 <> 0, c % 4 > 0 AND (c + 1) % 4 > 0, c % 3 > 0, (c + 1) % 3 > 0, o AND c % 11 <> 0 AND c % 4 < 2, c % 11 <> 0 AND c % 6 <> 0, c % 11 <> 0 AND c % 8 <> 0, o AND c % 12 <> 0, o AND c % 14 <> 0]) AS ok,
  unnest(range(1, 13))::INT AS check_no FROM k)
SELECT * FROM x""")
def gate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All twelve checks of every chapter, from its files."""
    return gate.checks(gate.evidence_of(chapter_archive(spark, sf_dir))).select("doc_id", "check_no", "ok")


@query("""WITH o AS (SELECT user_id, ts, max(event_id) AS seen FROM events WHERE event_type = 'purchase' GROUP BY ALL), r AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'purchase'),
l AS (SELECT user_id, max(ts) AS last FROM o GROUP BY user_id)
SELECT r.user_id, r.event_id, o.seen, coalesce(o.ts < l.last, true) AS stale FROM r ASOF LEFT JOIN o ON r.user_id = o.user_id AND r.ts >= o.ts LEFT JOIN l ON l.user_id = r.user_id""")
def runs_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which version of a text each run saw, and whether a later one is there: purchases as versions, other events as runs."""
    d = table(spark, sf_dir, "events")
    states = d.where("event_type = 'purchase'").select("user_id", "ts", F.struct("ts", "event_id").alias("seen"))
    found = gate.as_of(d.where("event_type <> 'purchase'").select("user_id", "ts", "event_id"), states, ["user_id"], "ts", "seen")
    last = states.groupBy("user_id").agg(F.max("ts").alias("last"))
    d = found.join(last, "user_id", "left")
    return d.select("user_id", "event_id", F.col("seen.event_id").alias("seen"), F.coalesce(F.col("seen.ts") < F.col("last"), F.lit(True)).alias("stale"))


@query(r"""WITH t AS (SELECT (conv_id % 7 + 1)::VARCHAR AS doc_id, (conv_id * 100 + turn)::INT AS block_no, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM conversations),
l AS (SELECT doc_id, block_no, unnest(range(1, len(ls) + 1)) AS i, ls FROM t), x AS (SELECT doc_id, block_no, i, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS text FROM l)
SELECT doc_id, block_no, (row_number() OVER (PARTITION BY doc_id, block_no ORDER BY i))::INT AS para_no, text FROM x WHERE text <> '' AND NOT starts_with(text, '# ') AND NOT starts_with(text, '<!--')""")
def volume_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns as the blocks of seven volumes, written in ranges and read again block by block; no row holds a volume on either way."""
    d = table(spark, sf_dir, "conversations").withColumn("block_no", (F.col("conv_id") * 100 + F.col("turn")).cast("int"))
    text = F.concat(F.format_string("<!-- block: %d -->\n\n", "block_no"), F.coalesce("text", F.lit("")), F.lit("\n"))
    path = new_path(spark, "volumes")
    sinks.write_ordered(d.select((F.col("conv_id") % 7 + 1).cast("int").alias("volume"), "block_no", text.alias("text")), path, "volume", ["block_no"], bytes_per_file=1 << 20)
    return split_blocks(spark, path, "volume")


@query(rf"""WITH c AS (SELECT conv_id, 'v' || (conv_id % 4 + 1) || '-' || {_PART} AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
p AS (SELECT (conv_id % 4 + 1)::INT AS volume, doc_id, text, CASE conv_id % 9 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 6 WHEN 3 THEN 5 ELSE 2 END AS place, CASE WHEN conv_id % 9 > 3 THEN conv_id ELSE 0 END AS number FROM c),
w AS (SELECT volume, string_split(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place, number, doc_id, md5(text)), chr(10)) AS ls FROM p GROUP BY volume)
SELECT volume, unnest(range(1, len(ls) + 1))::INT AS line_no, md5(unnest(ls)) AS digest FROM w""")
def volume_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole volumes in the order of a book, written in ranges of lines with an index, and their lines as the files give them."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n").alias("text"))
    m = F.col("conv_id") % 9
    part = F.when(m == 0, "preface").when(m == 1, "epilogue").when(m == 2, "credits").when(m == 3, F.concat(F.lit("notes-"), "conv_id")).otherwise(F.format_string("ch%04d", "conv_id"))
    d = c.select(F.concat(F.lit("v"), (F.col("conv_id") % 4 + 1).cast("string"), F.lit("-"), part).alias("doc_id"), "text")
    path = new_path(spark, "book")
    index = sinks.write_ordered(sinks.volume_pieces(d), path, "volume", ["place", "number", "doc_id", "key", "piece"], bytes_per_file=256 << 10)
    lines = spark.read.text(path, lineSep="\n", recursiveFileLookup=True, pathGlobFilter="part-*").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), "value")
    d = lines.join(index.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "volume", "offset"), (F.regexp_extract("path", "([^/]+)$", 1) == F.col("file")) & (F.regexp_extract("path", "/volume=([^/]+)/", 1) == F.col("volume")))
    place = F.row_number().over(W.partitionBy("volume").orderBy("offset", "start", "n"))
    return d.select(F.col("volume").cast("int").alias("volume"), place.alias("line_no"), F.md5(F.col("value").cast("binary")).alias("digest"))


@query("""WITH c AS (SELECT conv_id AS c, list(DISTINCT turn) AS turns FROM conversations GROUP BY conv_id),
k AS (SELECT c, 'v' || (c % 7 + 1) || '-ch' || c AS doc_id, c % 7 <> 0 AS o, c % 17 <> 0 AND NOT (c % 3 = 0 AND list_contains(turns, 1)) AS covered, len(list_filter(range(0, 5), lambda i: (c + i) % 13 = 0 OR (c + i) % 9 = 0)) = 0 AS scans FROM c),
x AS (SELECT doc_id, list_sum([o, o AND covered, o AND scans, c % 5 <> 0, c % 4 > 0 AND (c + 1) % 4 > 0, c % 3 > 0, (c + 1) % 3 > 0, o AND c % 11 <> 0 AND c % 4 < 2, c % 11 <> 0 AND c % 6 <> 0, c % 11 <> 0 AND c % 8 <> 0, o AND c % 12 <> 0, o AND c % 14 <> 0]::INT[])::BIGINT AS closed FROM k)
SELECT doc_id, closed, closed = 12 AS ready FROM x""")
def gate_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many checks each chapter's files close, and whether it is ready."""
    return gate.verdicts(gate.checks(gate.evidence_of(chapter_archive(spark, sf_dir)))).select("doc_id", "closed", "ready")


def _docx(lines: list[str], heads: list[bool]) -> bytes:
    """The least docx that holds some paragraphs."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    style = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    body = "".join(f'<w:p>{style if h else ""}<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for t, h in zip(lines, heads, strict=True))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def _epub(lines: list[str], heads: list[bool]) -> bytes:
    """The least epub that holds some paragraphs, a page for each heading."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    pages: list[str] = [""]
    for t, h in zip(lines, heads, strict=True):
        if h:
            pages.append("")
        pages[-1] += f"<h1>{escape(t)}</h1>" if h else f"<p>{escape(t[:3])}<b>{escape(t[3:])}</b></p>"
    items = "".join(f'<item id="p{i}" href="text/p{i}.xhtml"/>' for i in range(len(pages)))
    spine = "".join(f'<itemref idref="p{i}"/>' for i in range(len(pages)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
        book.writestr("OEBPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{spine}</spine></package>')
        for i, page in enumerate(pages):
            book.writestr(f"OEBPS/text/p{i}.xhtml", f'<html xmlns="http://www.w3.org/1999/xhtml"><body><div>{page}</div></body></html>')
    return out.getvalue()


@query(r"""WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM c),
p AS (SELECT conv_id, turn, i, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM l),
k AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS no FROM p WHERE text <> ''),
n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS chapter FROM (SELECT DISTINCT conv_id, turn FROM c))
SELECT conv_id % 3 AS kind, conv_id, chapter, no::INT AS para_no, md5(text) AS digest, NULL AS fault FROM k JOIN n USING (conv_id, turn) WHERE conv_id % 10 <> 7
UNION ALL SELECT conv_id % 3, conv_id, NULL, NULL, NULL, CASE conv_id % 3 WHEN 2 THEN 'UnicodeDecodeError' ELSE 'BadZipFile' END FROM conversations WHERE conv_id % 10 = 7 GROUP BY conv_id""")
def book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a book (docx, epub or Markdown, a chapter for each turn), packed, and its paragraphs as they are unpacked; every tenth is damaged."""
    from collections.abc import Iterator

    import pandas as pd

    lines = F.transform(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\S\n]+", " "), "\n"), F.trim)
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.filter(lines, lambda x: x != "").alias("ls"))
    d = d.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "ls"))).alias("turns"))

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conv, own in zip(pdf["conv_id"], pdf["turns"], strict=True):
                texts = [x for t in own for x in (f"Turn {t['turn']}", *t["ls"])]
                heads = [i == 0 for t in own for i in range(1 + len(t["ls"]))]
                if conv % 3 == 2:
                    data = "\n\n".join(f"# {t}" if h else t for t, h in zip(texts, heads, strict=True)).encode()
                else:
                    data = (_docx if conv % 3 == 0 else _epub)(texts, heads)
                damaged = b"\xff" + data[: len(data) // 2] if conv % 10 == 7 else data
                out.append((f"/books/{conv}{('.docx', '.epub', '.md')[conv % 3]}", damaged))
            yield pd.DataFrame(out, columns=["path", "content"])

    path = new_path(spark, "books")
    d.mapInPandas(bound, "path string, content binary").write.parquet(path)
    found = staged(ingest.book_paragraphs(spark.read.schema("path string, content binary").parquet(path)), "book-paragraphs")
    conv = F.regexp_extract("path", r"/(\d+)\.", 1).cast("long").alias("conv_id")
    good = ingest.chapters_by_heading(found).select(conv, "chapter", "para_no", F.md5(F.col("text").cast("binary")).alias("digest"), F.lit(None).cast("string").alias("fault"))
    bad = found.where("fault IS NOT NULL").select(conv, F.lit(None).cast("int").alias("chapter"), F.lit(None).cast("int").alias("para_no"), F.lit(None).cast("string").alias("digest"), "fault")
    return good.unionByName(bad).select((F.col("conv_id") % 3).alias("kind"), "*")
