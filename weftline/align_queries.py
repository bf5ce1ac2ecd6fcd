"""Alignment, dictionaries, versions and long documents on the driver tables, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import upper_letters
from weftline.operators import dp_align, glossary, segment, style
from weftline.queries import HAS_WORD, LINES, doc_lines, query, table
from weftline.scan_queries import TABLE_DRIFT
from weftline.sources.blocks import paragraphs
from weftline.sources.staging import placed


def two_sides(spark: SparkSession, sf_dir: str, letters: int = 8) -> DataFrame:
    """(doc_id, lang, para_no, size, anchors): the lines of a conversation's users and assistants, anchored by their long words."""
    d = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')")
    d = paragraphs(d.select(F.col("conv_id").cast("string").alias("doc_id"), "role", "turn", "text"), "\n", ("role", "turn"))
    place = F.row_number().over(dp_align.W.partitionBy("doc_id", "role").orderBy("turn", "para_no"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(rf"\p{{L}}{{{letters},}}"), F.lit(0)))
    return d.select("doc_id", F.col("role").alias("lang"), place.alias("para_no"), F.length("text").alias("size"), words.alias("anchors"))


_SIDES = r"""
c0 AS (SELECT conv_id::VARCHAR AS doc_id, role, turn, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10)) AS ls FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL),
c1 AS (SELECT doc_id, role, turn, i, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS text FROM c0),
p AS (SELECT doc_id, role, row_number() OVER (PARTITION BY doc_id, role ORDER BY turn, i) AS no, length(text) AS size, list_distinct(regexp_extract_all(lower(text), '\p{L}{8,}')) AS anchors FROM c1 WHERE text <> ''),
a AS (SELECT doc_id, no, size, anchors FROM p WHERE role = 'user'), b AS (SELECT doc_id, no, size, anchors FROM p WHERE role = 'assistant'),
dims AS (SELECT d.doc_id, coalesce(any_value(n), 0) AS n, coalesce(any_value(m), 0) AS m, coalesce(any_value(tl), 0) AS tl, coalesce(any_value(tr), 0) AS tr FROM (SELECT DISTINCT doc_id FROM p) d
  LEFT JOIN (SELECT doc_id, max(no) AS n, sum(size) AS tl FROM a GROUP BY doc_id) x ON x.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, max(no) AS m, sum(size) AS tr FROM b GROUP BY doc_id) y ON y.doc_id = d.doc_id GROUP BY d.doc_id),
ua AS (SELECT doc_id, no, 1 AS w, size, anchors FROM a UNION ALL SELECT x.doc_id, x.no, 2, x.size + y.size, list_distinct(list_concat(x.anchors, y.anchors)) FROM a x JOIN a y ON y.doc_id = x.doc_id AND y.no = x.no - 1),
ub AS (SELECT doc_id, no, 1 AS w, size, anchors FROM b UNION ALL SELECT x.doc_id, x.no, 2, x.size + y.size, list_distinct(list_concat(x.anchors, y.anchors)) FROM b x JOIN b y ON y.doc_id = x.doc_id AND y.no = x.no - 1),
met AS (SELECT ua.doc_id, ua.no AS i, ub.no AS j, ua.w AS da, ub.w AS db, ua.size * tr AS x, ub.size * greatest(1, tl) AS y, len(list_intersect(ua.anchors, ub.anchors)) AS both_, len(ua.anchors) + len(ub.anchors) AS sum_
  FROM ua JOIN ub ON ua.doc_id = ub.doc_id JOIN dims ON dims.doc_id = ua.doc_id),
g AS MATERIALIZED (
  SELECT doc_id, i, j, da, db, 2 * (da - 1) + db - 1 AS k, (2000000 * both_) // greatest(1, sum_ - both_) + CASE WHEN greatest(x, y) > 0 THEN floor(1000000 * (least(x, y)::DOUBLE / greatest(x, y)::DOUBLE)) ELSE 1000000 END::BIGINT - 150000 * (da + db - 2) AS gain FROM met
  UNION ALL SELECT doc_id, i, j, 1, 0, 4, -600000 FROM dims, unnest(range(1, n + 1)) r(i), unnest(range(0, m + 1)) s(j)
  UNION ALL SELECT doc_id, i, j, 0, 1, 5, -600000 FROM dims, unnest(range(0, n + 1)) r(i), unnest(range(1, m + 1)) s(j)),
best(doc_id, i, j, total, way) USING KEY (doc_id, i, j) AS (
  SELECT doc_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM dims
  UNION
  SELECT g.doc_id, g.i, g.j, max(o.total + g.gain)::BIGINT, arg_max(list_append(o.way, g.k::BIGINT), (o.total + g.gain) * 8 - g.k)
  FROM (SELECT DISTINCT doc_id, i + j + 1 AS t FROM best) now JOIN g ON g.doc_id = now.doc_id AND g.i + g.j = now.t
  JOIN recurring.best o ON o.doc_id = g.doc_id AND o.i = g.i - g.da AND o.j = g.j - g.db GROUP BY g.doc_id, g.i, g.j),
w AS (SELECT best.doc_id, unnest(range(1, len(way) + 1)) AS no, unnest(way) AS k FROM best JOIN dims ON dims.doc_id = best.doc_id AND i = n AND j = m),
s AS (SELECT doc_id, no, k, CASE k WHEN 5 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS da, CASE k WHEN 4 THEN 0 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS db FROM w),
t AS (SELECT doc_id, no, da, db, sum(da) OVER o AS i, sum(db) OVER o AS j FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY no)),
steps AS (SELECT t.doc_id, no::INT AS pair_no, CASE WHEN t.da > 0 THEN t.i - t.da + 1 END::INT AS left_from, CASE WHEN t.da > 0 THEN t.i END::INT AS left_to, CASE WHEN t.db > 0 THEN t.j - t.db + 1 END::INT AS right_from,
  CASE WHEN t.db > 0 THEN t.j END::INT AS right_to, gain FROM t JOIN g ON g.doc_id = t.doc_id AND g.i = t.i AND g.j = t.j AND g.da = t.da AND g.db = t.db)
"""


@query(f"WITH RECURSIVE {_SIDES} SELECT * FROM steps")
def dp_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of users and assistants of each conversation, aligned; the SQL tries every cell of every table."""
    return dp_align.dp_aligned(two_sides(spark, sf_dir), "user", "assistant")


@query(f"""WITH RECURSIVE {_SIDES},
n AS (SELECT *, greatest(1, sum(CASE WHEN left_from IS NOT NULL AND right_from IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pair_no))::INT AS block_no FROM steps)
SELECT doc_id, block_no, min(left_from) AS left_from, max(left_to) AS left_to, min(right_from) AS right_from, max(right_to) AS right_to FROM n GROUP BY doc_id, block_no""")
def dp_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as blocks: what only one side has goes to its neighbour."""
    return dp_align.attached(dp_alignment(spark, sf_dir))


#: Letters of the tables' prose as Cyrillic and as kana, one for one.
_LATIN, _CYRILLIC, _KANA = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшэыз", "あいうえおかきくけこさしすせそたちつてとなにぬねのは"


def three_languages(text: str = "text") -> dict[str, Column]:
    """A text as ja (kana without blanks), en (as it is) and ru (Cyrillic, capitals kept)."""
    ru = F.translate(F.col(text), _LATIN.upper() + _LATIN, _CYRILLIC.upper() + _CYRILLIC)
    return {"ja": F.translate(F.lower(F.replace(F.col(text), F.lit(" "), F.lit(""))), _LATIN, _KANA), "en": F.col(text), "ru": ru}


def benchmark_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, ja, en, ru): of each benchmark item five characters, its second word in capitals, and its third and fourth."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: w != "")
    d = table(spark, sf_dir, "benchmark").select("item_id", *[c.alias(n) for n, c in three_languages().items()], words.alias("w")).where("size(w) > 3")
    ru = F.translate(F.concat_ws(" ", F.get("w", F.lit(2)), F.get("w", F.lit(3))), _LATIN, _CYRILLIC)
    return d.select(F.format_string("g:%d", "item_id").alias("key"), F.substring("ja", 8, 5).alias("ja"), upper_letters(F.get("w", F.lit(1))).alias("en"), ru.alias("ru"))


_THREE = f"""translate(lower(replace({{0}}, ' ', '')), '{_LATIN}', '{_KANA}') AS ja, {{0}} AS en, translate(translate({{0}}, '{_LATIN.upper()}', '{_CYRILLIC.upper()}'), '{_LATIN}', '{_CYRILLIC}') AS ru"""
_EDGED = "regexp_matches(' ' || lower({0}) || ' ', '[^a-zа-яё]' || regexp_escape(lower({1})) || '[^a-zа-яё]')"


@query(rf"""WITH {LINES},
b AS (SELECT item_id, {_THREE.format('text')}, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: x <> '') AS w FROM benchmark),
g AS (SELECT 'g:' || item_id AS key, substring(ja, 8, 5) AS ja, upper(w[2]) AS en, translate(w[3] || ' ' || w[4], '{_LATIN}', '{_CYRILLIC}') AS ru FROM b WHERE len(w) > 3),
t AS (SELECT doc_id, para_no AS block_no, {_THREE.format('text')} FROM lines),
n AS (SELECT doc_id, block_no, ltrim(regexp_replace(unnest(regexp_extract_all(en, '\d[\d,.\s]*\d|\d')), '[,.\s]', '', 'g'), '0') AS v FROM t),
m AS (SELECT doc_id, block_no, CASE WHEN v = '' THEN '0' ELSE v END AS anchor FROM n)
SELECT DISTINCT lang, doc_id, block_no, anchor FROM (
  SELECT 'ja' AS lang, doc_id, block_no, key AS anchor FROM t, g WHERE g.ja <> '' AND contains(t.ja, g.ja)
  UNION ALL SELECT 'en', doc_id, block_no, key FROM t, g WHERE contains(lower(t.en), lower(g.en)) AND {_EDGED.format('t.en', 'g.en')}
  UNION ALL SELECT 'ru', doc_id, block_no, key FROM t, g WHERE contains(lower(t.ru), g.ru) AND {_EDGED.format('t.ru', 'g.ru')}
  UNION ALL SELECT unnest(['ja', 'en', 'ru']), doc_id, block_no, anchor FROM m)""")
def dictionary_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of every line in three scripts: terms of a glossary from the benchmark, and numbers."""
    d = doc_lines(spark, sf_dir).select("doc_id", F.col("para_no").alias("block_no"), *[c.alias(n) for n, c in three_languages().items()])
    entries = benchmark_glossary(spark, sf_dir)
    found = glossary.anchors_by_language(d, entries, {lang: lang for lang in ("ja", "en", "ru")})
    return found.select("lang", "doc_id", "block_no", F.replace("anchor", F.lit("\x00"), F.lit("")).alias("anchor"))


_ADDED = "Zqx wvk jyyp"


def next_version(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every line of the documents, and a version with a line more after one of the first five, numbers anew, and every fourth line negated."""
    old = doc_lines(spark, sf_dir)
    after = (F.col("doc_id") % 5).cast("int")
    text = F.when(F.col("para_no") % 4 == 0, F.concat(F.lit("no "), F.col("text"))).otherwise(F.col("text"))
    new = old.select("doc_id", (F.col("para_no") + F.when(F.col("para_no") > after, 1).otherwise(0)).alias("para_no"), text.alias("text"))
    size = old.groupBy("doc_id").agg(F.max("para_no").alias("n"))
    more = size.select("doc_id", (F.least(after, F.col("n")) + 1).cast("int").alias("para_no"), F.lit(_ADDED).alias("text"))
    return old, new.unionByName(more)


_VERSIONS = rf"""
o AS (SELECT doc_id, para_no AS old_no, para_no + (para_no > doc_id % 5)::INT AS new_no, text, para_no % 4 = 0 AS changed FROM lines),
k AS (
  SELECT doc_id, NULL::INT AS old_no, (least(doc_id % 5, max(para_no)) + 1)::INT AS new_no, 'paragraph-added' AS kind, 'STRONG' AS strength FROM lines GROUP BY doc_id
  UNION ALL SELECT doc_id, old_no, new_no, CASE WHEN {HAS_WORD.format('text', 'no|not|never|nicht|ne|pas|sin')} THEN 'wording' ELSE 'negation' END, CASE WHEN {HAS_WORD.format('text', 'no|not|never|nicht|ne|pas|sin')} THEN 'WEAK' ELSE 'STRONG' END
  FROM o WHERE changed)
"""


@query(f"WITH {LINES}, {_VERSIONS} SELECT * FROM k")
def drift_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One addition a document, whatever follows it, and the lines that are negated; the SQL knows what was done to each line."""
    old, new = next_version(spark, sf_dir)
    return style.drift_aligned(old, new, pack=TABLE_DRIFT)


@query(f"""WITH {LINES}, {_VERSIONS} SELECT k.* FROM k WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = k.doc_id AND l.quality = 1 AND k.kind = 'negation')""")
def drift_unexplained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same less what is explained: negations of documents that are labelled good."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("negation").alias("kind")).distinct()
    return style.unexplained(drift_versions(spark, sf_dir), good, ["doc_id", "kind"])


def long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, para_no, text): three documents, each of all order lines with one return flag; texts as long as their figures say, some empty."""
    d = table(spark, sf_dir, "lineitem")
    d = placed(d.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "place")
    size = (F.col("l_partkey") * 37 + F.col("l_suppkey") * 11 + F.col("l_quantity").cast("long")) % 240
    return d.select(F.col("l_returnflag").alias("doc_id"), F.col("place").cast("int").alias("para_no"), F.repeat(F.lit("x"), F.when(size < 2, 0).otherwise(size).cast("int")).alias("text"))


@query("""WITH RECURSIVE
x AS MATERIALIZED (SELECT l_returnflag AS doc_id, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, (l_partkey * 37 + l_suppkey * 11 + l_quantity::BIGINT) % 240 AS n FROM lineitem),
s AS MATERIALIZED (SELECT doc_id, i, CASE WHEN n < 2 THEN 0 ELSE n END AS n, sum(CASE WHEN n < 2 THEN 0 ELSE n END) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM x),
b AS (SELECT doc_id, i, n, upto, n = 0 OR lead(n, 1, 1) OVER (PARTITION BY doc_id ORDER BY i) = 0 AS hard FROM s),
j AS MATERIALIZED (SELECT a.doc_id, a.i, min(b.i) + 1 AS nxt FROM s a JOIN (SELECT *, unnest(range(0, 16)) AS k FROM b) b ON b.doc_id = a.doc_id AND b.i - b.k = a.i WHERE b.k = 15 OR b.hard OR b.upto - a.upto + a.n >= 1600 GROUP BY ALL),
seg(doc_id, i, no) AS (SELECT DISTINCT doc_id, 1::BIGINT, 0 FROM x UNION ALL SELECT seg.doc_id, j.nxt, seg.no + 1 FROM seg JOIN j ON j.doc_id = seg.doc_id AND j.i = seg.i)
SELECT x.doc_id, x.i::INT AS para_no, seg.no AS block_no FROM x ASOF JOIN seg ON x.doc_id = seg.doc_id AND x.i >= seg.i""")
def long_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents that no row holds."""
    return segment.segmented(long_documents(spark, sf_dir))
