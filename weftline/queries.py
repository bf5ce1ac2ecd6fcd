"""The engine's operators on the driver tables, each with its DuckDB counterpart where SQL has one.

Texts of the tables hold few of the marks the checks look for, so a query chooses a language pack that
fits them; the literal Russian and English rules run on derived texts in ``prose_queries``.
DuckDB's regexes have no look-around and ASCII word borders: its patterns consume a non-letter instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.edits import names_replaced, patched
from weftline.functions.numbers import ja_value, unconfirmed
from weftline.functions.text import clean, has_dialogue, sentences, strip
from weftline.operators import align, findings, gate, glossary, segment, style, terms
from weftline.plans.address_rules import address_scan
from weftline.plans.align_rules import LanguagePack, align_check
from weftline.plans.grammar_rules import first, grammar_scan
from weftline.plans.record_rules import record_scan
from weftline.plans.rules import counts
from weftline.sources.blocks import paragraphs
from weftline.sources.tables import keyed, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "conversations") else df


def doc_lines(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Every line of a document with text is a paragraph."""
    return paragraphs(table(spark, sf_dir, "documents"), "\n", keep)


#: The same in SQL: (doc_id, para_no, text).
LINES = r"""
l0 AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10)) AS ls FROM documents),
l1 AS (SELECT doc_id, i, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS text FROM l0),
lines AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::INT AS para_no, text FROM l1 WHERE text <> '')
"""
#: Sentences of a text expression in SQL.
SENTENCES = r"list_filter(list_transform(regexp_extract_all({0}, '[^.!?…]+[.!?…]*'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
#: Whether an expression has one of some words, as whole words in any case.
HAS_WORD = r"regexp_matches({0}, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{1})(?:[^\p{{L}}\p{{N}}_]|$)')"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, block_no, en, ed_ru): each user turn with the assistant turn after it, null if none."""
    later = W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, -1)
    d = table(spark, sf_dir, "conversations")
    d = d.withColumn("ed_ru", F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(later))
    return d.where("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_no"), F.col("text").alias("en"), "ed_ru")


TURNS = r"""
turns AS (SELECT u.conv_id AS doc_id, u.turn AS block_no, regexp_replace(u.text, '^\s+|\s+$', '', 'g') AS s,
  (SELECT regexp_replace(arg_min(a.text, a.turn), '^\s+|\s+$', '', 'g') FROM conversations a WHERE a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn > u.turn) AS t
  FROM conversations u WHERE role = 'user')
"""
#: A pack whose marks and words occur in the generated conversations.
TABLE_PACK = LanguagePack(
    source_speech=",", target_speech=",", mark="\n", source_negation="no|not|never|nicht|ne|pas|sin", target_negation="no|not|never|nicht|ne|pas|sin",
    source_we="is|est|ist|las", target_you="for|pour|für|por", target_we="was|und|que",
)
_NEG, _WE, _YOU, _OWN = "no|not|never|nicht|ne|pas|sin", "is|est|ist|las", "for|pour|für|por", "was|und|que"


@query(f"WITH {LINES} SELECT doc_id, para_no, length(text)::INT AS n_chars, md5(text) AS digest FROM lines")
def paragraph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_lines(spark, sf_dir).select("doc_id", "para_no", F.length("text").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"WITH s AS (SELECT lang, unnest({SENTENCES.format('text')}) AS s FROM documents) SELECT lang, count(*) AS n_sentences, sum(length(s))::BIGINT AS n_chars, max(length(s))::INT AS longest FROM s GROUP BY lang")
def sentence_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", F.explode(sentences(F.col("text"))).alias("s"))
    return d.groupBy("lang").agg(F.count("*").alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"), F.max(F.length("s")).alias("longest"))


@query(r"SELECT page_id, length(t)::INT AS n_chars, md5(t) AS digest FROM (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages)")
def clean_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pages").select("page_id", clean(F.col("html")).alias("t"))
    return d.select("page_id", F.length("t").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


@query(f"""WITH RECURSIVE {LINES},
seg(doc_id, para_no, block_no, n, chars) AS (
  SELECT doc_id, para_no, 0, 1, length(text) FROM lines WHERE para_no = 1
  UNION ALL
  SELECT l.doc_id, l.para_no, CASE WHEN s.n >= 16 OR s.chars >= 1600 THEN s.block_no + 1 ELSE s.block_no END,
    CASE WHEN s.n >= 16 OR s.chars >= 1600 THEN 1 ELSE s.n + 1 END, CASE WHEN s.n >= 16 OR s.chars >= 1600 THEN length(l.text) ELSE s.chars + length(l.text) END
  FROM seg s JOIN lines l ON l.doc_id = s.doc_id AND l.para_no = s.para_no + 1)
SELECT doc_id, para_no, block_no FROM seg""")
def block_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segmented(doc_lines(spark, sf_dir))


@query("""SELECT conv_id AS doc_id, (turn // 2)::BIGINT AS block_no, coalesce(arg_max(text, turn) FILTER (role = 'system'), '—') AS system,
coalesce(arg_max(text, turn) FILTER (role = 'user'), '—') AS "user", coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '—') AS assistant FROM conversations GROUP BY ALL""")
def merged_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations")
    sides = d.select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).alias("block_no"), F.col("role").alias("lang"), F.col("turn").alias("entry"), "text")
    return align.merged_view(sides, ["system", "user", "assistant"])


_RULES_SQL = f"""WITH {TURNS},
f AS (SELECT doc_id, block_no, s, coalesce(t, '') AS t FROM turns),
k AS (
  SELECT doc_id, block_no, 'no-translation' AS kind, 'info' AS weight FROM f WHERE t IN ('', '—')
  UNION ALL SELECT doc_id, block_no, 'speech', 'weak' FROM f WHERE t NOT IN ('', '—') AND contains(s, ',') <> contains(t, ',')
  UNION ALL SELECT doc_id, block_no, 'marks', 'weak' FROM f WHERE t NOT IN ('', '—') AND contains(s, chr(10)) <> contains(t, chr(10))
  UNION ALL SELECT doc_id, block_no, 'negation', 'weak' FROM f WHERE t NOT IN ('', '—') AND {HAS_WORD.format('s', _NEG)} <> {HAS_WORD.format('t', _NEG)}
  UNION ALL SELECT doc_id, block_no, 'pronouns', 'weak' FROM f WHERE t NOT IN ('', '—') AND {HAS_WORD.format('s', _WE)} AND {HAS_WORD.format('t', _YOU)} AND NOT {HAS_WORD.format('t', _OWN)})
"""


@query(_RULES_SQL + "SELECT doc_id, block_no, kind, weight FROM k WHERE kind <> 'pronouns'")
def align_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_check(turns(spark, sf_dir), pack=TABLE_PACK, only=["no-translation", "speech", "marks", "negation"]).select("doc_id", "block_no", "kind", "weight")


@query(_RULES_SQL + "SELECT doc_id, block_no, kind, weight FROM k WHERE kind = 'pronouns'")
def pronoun_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_check(turns(spark, sf_dir), pack=TABLE_PACK, only=["pronouns"]).select("doc_id", "block_no", "kind", "weight")


@query(_RULES_SQL + "SELECT kind, weight, count(*) AS n, count(DISTINCT doc_id) AS docs FROM k GROUP BY ALL")
def signal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_check(turns(spark, sf_dir), pack=TABLE_PACK)
    return found.groupBy("kind", "weight").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


_NUMBERS_SQL = r"list_distinct(list_transform(regexp_extract_all(regexp_replace(regexp_replace({0}, '(\d)[,\x{{00a0}} ](\d\d\d)\b', '\1\2', 'g'), '(\d)[,\x{{00a0}} ](\d\d\d)\b', '\1\2', 'g'), '[0-9]+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END))"


@query(f"""WITH {LINES},
p AS (SELECT doc_id, para_no, text, lead(text, 1, '') OVER (PARTITION BY doc_id ORDER BY para_no) AS nxt FROM lines),
n AS (SELECT doc_id, para_no, nxt, unnest({_NUMBERS_SQL.format('text')}) AS num, {_NUMBERS_SQL.format('nxt')} AS nums FROM p)
SELECT doc_id, para_no, string_agg(num, ',' ORDER BY length(num), num) AS missing FROM n WHERE NOT list_contains(nums, num) GROUP BY ALL""")
def number_anchor_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a line that the next line does not confirm."""
    after = F.lead("text", 1, "").over(W.partitionBy("doc_id").orderBy("para_no"))
    lost = unconfirmed(F.col("text"), F.col("next"))
    d = doc_lines(spark, sf_dir).withColumn("next", after).select("doc_id", "para_no", lost.alias("lost")).where(F.size("lost") > 0)
    ordered = F.transform(F.array_sort(F.transform("lost", lambda n: F.struct(F.length(n).alias("l"), n.alias("n")))), lambda s: s["n"])
    return d.select("doc_id", "para_no", F.array_join(ordered, ",").alias("missing"))


_GLOSSARY = [("avec", ["avec"]), ("from", ["from", "with"]), ("nich", ["nicht", "eine"]), ("para", ["para", "como"]), ("dans", ["dans", "pour"]), ("thth", ["that"])]
_GLOSSARY_SQL = ", ".join(f"('{b}', [{', '.join(repr(f) for f in fs)}])" for b, fs in _GLOSSARY)


@query(f"""WITH {TURNS}, g(base, forms) AS (VALUES {_GLOSSARY_SQL}),
w AS (SELECT doc_id, block_no, list_transform(regexp_extract_all(s, '[A-Za-z][A-Za-z''’\\-]+'), lambda x: lower(regexp_extract(x, '^[^''’]*'))) AS sw,
  list_transform(regexp_extract_all(coalesce(t, ''), '[\\p{{L}}][\\p{{L}}\\-]+'), lambda x: left(replace(lower(x), '-', ''), 4)) AS tw FROM turns),
j AS (SELECT doc_id, block_no, base, list_has_any(sw, forms) AS a, list_contains(tw, base) AS b FROM w, g)
SELECT doc_id, block_no, coalesce(string_agg(base, ',' ORDER BY base) FILTER (a AND NOT b), '') AS lost, coalesce(string_agg(base, ',' ORDER BY base) FILTER (b AND NOT a), '') AS extra
FROM j GROUP BY ALL""")
def glossary_names_lost_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(b, fs, b) for b, fs in _GLOSSARY], "ru_base string, en_forms array<string>, ru string")
    d = turns(spark, sf_dir).select("doc_id", "block_no", clean(F.col("en")).alias("source"), clean(F.col("ed_ru")).alias("target"))
    d = glossary.joined_names(d, names, letters=r"\p{L}")
    return d.select("doc_id", "block_no", F.array_join("lost", ",").alias("lost"), F.array_join("extra", ",").alias("extra"))


_FIRST = {"digit": r"[0-9]", "capitals": r"[A-Z]{4,}", "exclaimed": r"!$"}


@query(" UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, regexp_extract(s, '{p}') AS word, s AS sentence FROM (SELECT doc_id, list_filter({SENTENCES.format('text')}, lambda x: regexp_matches(x, '{p}'))[1] AS s FROM documents) WHERE s IS NOT NULL"
    for k, p in _FIRST.items()
))
def first_match_per_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", sentences(F.col("text")).alias("ss"))
    found = [_first_struct(k, p) for k, p in _FIRST.items()]
    d = d.select("doc_id", F.inline(F.array(*found))).where("sentence IS NOT NULL")
    return d.select("doc_id", "kind", "word", "sentence")


def _first_struct(kind: str, pattern: str) -> Column:
    held = first(F.col("ss"), lambda s: s.rlike(pattern))
    return F.struct(F.lit(kind).alias("kind"), F.regexp_extract(held, pattern, 0).alias("word"), held.alias("sentence"))


_TITLES = ("from", "para", "avec", "nicht")


@query(f"""WITH d AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM documents),
m AS (SELECT doc_id, {SENTENCES.format('text')} AS ss,
  unnest(regexp_extract_all(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({'|'.join(_TITLES)})\\s+(\\p{{L}}+)', 1)) AS p, unnest(regexp_extract_all(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({'|'.join(_TITLES)})\\s+(\\p{{L}}+)', 2)) AS name,
  generate_subscripts(regexp_extract_all(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({'|'.join(_TITLES)})\\s+(\\p{{L}}+)', 1), 1) - 1 AS cand_no FROM d)
SELECT doc_id, cand_no::INT AS cand_no, lower(p) AS prefix, name, s AS sentence FROM (SELECT *, list_filter(ss, lambda x: contains(lower(x), lower(p)) AND contains(x, name))[1] AS s FROM m) WHERE s IS NOT NULL""")
def address_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("block_no"), F.lit("").alias("en"), F.col("text").alias("ed_ru"))
    return address_scan(view, titles=_TITLES, name=r"\p{L}+").select("doc_id", "cand_no", "prefix", "name", F.col("target").alias("sentence"))


@query(f"""WITH {LINES},
b AS (SELECT doc_id, para_no, text AS line, regexp_extract_all(text, '[.!?…] [A-Z][a-z]+') AS hits, regexp_split_to_array(text, '[.!?…] [A-Z][a-z]+') AS gaps FROM lines WHERE NOT starts_with(text, '#')),
x AS (SELECT doc_id, para_no, line, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM b),
y AS (SELECT doc_id, para_no, line, hits[i] AS hit, (coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0))::INT AS start FROM x),
z AS (SELECT *, list_transform(regexp_extract_all(substring(line, start + 3), '\\p{{L}}[\\p{{L}}''’\\-]*')[1:4], lambda w: lower(w)) AS tail FROM y)
SELECT doc_id, para_no, start, substring(line, greatest(start - 45, 0) + 1, start + length(hit) + 20 - greatest(start - 45, 0)) AS fragment
FROM z WHERE NOT list_bool_or(list_transform(tail, lambda w: starts_with(w, 'th') OR starts_with(w, 'es') OR starts_with(w, 'de')))""")
def dialogue_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence ends inside a line whose next four words hold none of some prefixes."""
    found = record_scan(doc_lines(spark, sf_dir), border=r"[.!?…] [A-Z][a-z]+", attribution=["th", "es", "de"], lead=r"^[^\s]+ ")
    return found.select("doc_id", "para_no", "start", "fragment")


_STEMS = [("tion", "tion-"), ("ment", "ment-"), ("nich", "nicht"), ("vere", "verein"), ("therwh", "therwh-")]
_STEM_SQL = " UNION ALL ".join(f"SELECT '{s}' AS stem, '{c}' AS canon" for s, c in _STEMS)


@query(f"""WITH {LINES}, st AS ({_STEM_SQL}),
h AS (SELECT lang, doc_id, para_no, stem, canon, regexp_extract(lines.text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(' || stem || '[\\p{{L}}\\-]*)', 1) AS form FROM lines JOIN documents USING (doc_id), st WHERE contains(lower(lines.text), stem))
SELECT lang, stem, canon, lower(form) AS form, count(*) AS n, min(doc_id * 100000 + para_no) AS first_ord FROM h WHERE form <> '' GROUP BY ALL""")
def term_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(_STEMS)], "line_no int, stem string, canon string")
    hits = glossary.stem_hits(doc_lines(spark, sf_dir, "lang").withColumn("block_no", F.lit(1)), stems, letters=r"\p{L}", keep=("lang",))
    hits = hits.withColumn("ord", F.col("doc_id") * 100000 + F.col("para_no")).withColumn("form", F.lower("form"))
    return terms.inventory(hits, ["lang", "stem", "canon"])


_VARIANTS = ["avec", "dans", "from", "with"]


@query(f"""WITH {LINES},
c AS (SELECT doc_id, para_no, para_no - 1 AS pos, text FROM lines),
h AS ({' UNION ALL '.join(f"SELECT doc_id, para_no, pos, {i} AS i, '{v}' AS v, len(regexp_extract_all(lower(text), '{v}')) AS n FROM c" for i, v in enumerate(_VARIANTS))}),
k AS (SELECT * FROM h WHERE n > 0)
SELECT a.doc_id, a.v AS variant_a, a.para_no AS block_a, b.v AS variant_b, b.para_no AS block_b, a.n * b.n AS n FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.i < b.i AND abs(a.pos - b.pos) <= 1""")
def variant_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.variant_candidates(doc_lines(spark, sf_dir).withColumn("block_no", F.col("para_no")), _VARIANTS)


@query(f"""WITH {LINES},
g AS (SELECT doc_id, para_no, text, string_split(lower(text), 'tionble') AS gaps FROM lines WHERE contains(lower(text), 'tionble')),
x0 AS (SELECT doc_id, para_no, text, gaps, unnest(range(1, len(gaps))) AS i FROM g),
x AS (SELECT doc_id, para_no, text, (list_sum(list_transform(gaps[1:i], lambda z: length(z))) + 7 * (i - 1))::INT AS start FROM x0),
r AS (SELECT source, doc_id, para_no, text, start, row_number() OVER (PARTITION BY source ORDER BY doc_id, para_no, start) AS rank FROM x JOIN documents USING (doc_id))
""".replace("JOIN documents USING (doc_id)", "JOIN (SELECT doc_id, source FROM documents) USING (doc_id)") + """
SELECT source, rank::INT AS rank, doc_id, para_no, start::INT AS start, substring(text, greatest(start - 20, 0) + 1, start + 7 + 40 - greatest(start - 20, 0)) AS context FROM r WHERE rank <= 2""")
def kwic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two places of each source with a keyword, in context."""
    hits = terms.keyword_contexts(doc_lines(spark, sf_dir, "source"), "tionble", keep=("source",))
    return terms.top_k(hits, ["source"], ["doc_id", "para_no", "start"], 2).select("source", "rank", "doc_id", "para_no", "start", "context")


def order_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted blocks of an order: 1 to 1 + its key modulo 5."""
    d = table(spark, sf_dir, "orders")
    blocks = F.explode(F.sequence(F.lit(1), (F.col("o_orderkey") % 5 + 1).cast("int")))
    return d.select(F.col("o_orderkey").alias("doc_id"), blocks.alias("block_no")).withColumn("text", F.lit("order"))


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    d = d.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("block_no"), F.col("l_returnflag").alias("text"))
    return keyed(d, "doc_id", "block_no").dropDuplicates(["doc_id", "block_no"])


_SIDES = """l AS (SELECT o_orderkey AS doc_id, unnest(range(1, (o_orderkey % 5)::INT + 2))::INT AS block_no FROM orders),
r AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS block_no FROM lineitem)"""


@query(f"""WITH {_SIDES}
SELECT doc_id, count(*) AS n_pairs, coalesce(string_agg(block_no, ',' ORDER BY block_no) FILTER (b IS NULL), '') AS only_left, coalesce(string_agg(block_no, ',' ORDER BY block_no) FILTER (a IS NULL), '') AS only_right
FROM (SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, coalesce(l.block_no, r.block_no) AS block_no, l.doc_id AS a, r.doc_id AS b FROM l FULL JOIN r ON l.doc_id = r.doc_id AND l.block_no = r.block_no) GROUP BY doc_id""")
def pair_blocks_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = align.pair_blocks(order_blocks(spark, sf_dir), line_blocks(spark, sf_dir), ["doc_id", "block_no"])
    return align.side_notes(pairs, "doc_id", "block_no")


@query(f"""WITH {LINES},
p AS (SELECT doc_id, para_no, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(length(text)) OVER (PARTITION BY doc_id) AS total FROM lines),
b AS (SELECT item_id AS block_no, sum(length(text)) OVER (ORDER BY item_id) AS acc, sum(length(text)) OVER () AS whole FROM benchmark)
SELECT doc_id, para_no, coalesce(min(block_no) FILTER (before * whole < total * acc), max(block_no))::BIGINT AS block_no FROM p, b GROUP BY doc_id, para_no""")
def proportional_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document dealt to all benchmark items in proportion to their sizes."""
    paras = doc_lines(spark, sf_dir).withColumn("size", F.length("text").cast("long"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("block_no"), F.length("text").cast("long").alias("size"))
    return align.band_join(paras, items)


@query(f"""WITH {_SIDES}
SELECT *, 'missing' AS side FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT *, 'unknown' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)""")
def missing_blocks_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, a, b = ["doc_id", "block_no"], order_blocks(spark, sf_dir), line_blocks(spark, sf_dir)
    return align.missing_blocks(a, b, keys).withColumn("side", F.lit("missing")).unionByName(align.missing_blocks(b, a, keys).withColumn("side", F.lit("unknown")))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def frozen_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    frozen = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return align.not_frozen(table(spark, sf_dir, "documents"), frozen, "doc_id").select("doc_id", "lang", "n_chars")


@query(f"""WITH {LINES},
a AS (SELECT doc_id AS block, 'digits' AS problem, regexp_replace(lower(text), '\\s+', '', 'g') AS source FROM lines WHERE regexp_matches(text, '[0-9]')),
b AS (SELECT doc_id AS block, 'digits' AS problem, regexp_replace(lower(text), '\\s+', '', 'g') AS source FROM lines WHERE regexp_matches(text, '[0-9][0-9][0-9][0-9]|@')),
an AS (SELECT *, row_number() OVER (PARTITION BY block, problem, source) AS n FROM a), bn AS (SELECT *, row_number() OVER (PARTITION BY block, problem, source) AS n FROM b)
SELECT CASE WHEN an.block IS NULL THEN 'ONLY_B' WHEN bn.block IS NULL THEN 'ONLY_A' ELSE 'BOTH_FOUND' END AS status, count(*) AS n
FROM an FULL JOIN bn ON an.block = bn.block AND an.problem = bn.problem AND an.source = bn.source AND an.n = bn.n GROUP BY ALL""")
def merge_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two auditors of the lines, matched one to one and counted."""
    found = doc_lines(spark, sf_dir).select(F.col("doc_id").alias("block"), F.col("text").alias("source"), "para_no")
    a = found.where(F.col("source").rlike("[0-9]")).withColumn("problem", F.lit("Digits"))
    b = found.where(F.col("source").rlike("[0-9]{4}|@")).withColumn("problem", F.lit("DIGITS"))
    return findings.counted(findings.matched(a, b, ["para_no"]), "status")


@query("SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def distinct_findings_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.first_of(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "ts", "value")


@query("""SELECT user_id, arg_max(event_id, row(ts, event_id)) AS by_time, max(event_id) AS by_name, arg_max(event_type, row(ts, event_id)) AS kind FROM events WHERE event_type <> 'view' GROUP BY user_id""")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The youngest run and the last by name; the two rules differ."""
    d = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    keep = F.col("event_type") != "view"
    young = findings.latest(d, ["user_id"], ["ts", "event_id"], keep).select("user_id", F.col("event_id").alias("by_time"), F.col("event_type").alias("kind"))
    named = findings.latest(d, ["user_id"], "event_id", keep).select("user_id", F.col("event_id").alias("by_name"))
    return young.join(named, "user_id")


_EVIDENCE_SQL = """p AS (SELECT user_id, event_id, 'FALSE_POSITIVE' AS status, 'prior' AS part FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1),
c AS (SELECT user_id, event_id, CASE WHEN value > 50 AND event_type = 'purchase' THEN 'CONFIRMED_ERROR' ELSE 'DISPUTED' END AS status, 'new' AS part FROM events),
k AS (SELECT user_id, event_id, 'FALSE_POSITIVE' AS status, 'precheck' AS part FROM events WHERE event_type = 'error'),
u AS (SELECT * FROM p UNION ALL SELECT * FROM c UNION ALL SELECT * FROM k),
d AS (SELECT *, CASE WHEN status = 'FALSE_POSITIVE' THEN 'PRESERVED' ELSE 'REPORT_ONLY' END AS action, CASE WHEN status = 'CONFIRMED_ERROR' THEN 'MEANING_SHIFT' ELSE 'COMPONENT_LOSS' END AS fidelity FROM u)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    prior = findings.first_of(events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", F.lit("FALSE_POSITIVE").alias("status"), F.lit("prior").alias("part"))
    severity = F.when(F.col("value") > 50, "ERROR").otherwise("WARNING")
    new = events.select("user_id", "event_id", findings.status_of(severity, F.when(F.col("event_type") == "purchase", "HIGH").otherwise("LOW")).alias("status"), F.lit("new").alias("part"))
    precheck = events.where("event_type = 'error'").select("user_id", "event_id", F.lit("FALSE_POSITIVE").alias("status"), F.lit("precheck").alias("part"))
    both = findings.carried(prior, new, precheck)
    return both.withColumn("action", findings.clamped(findings.action_of(F.col("status")))).withColumn("fidelity", findings.fidelity_of(F.col("status")))


@query(f"WITH {_EVIDENCE_SQL} SELECT user_id, event_id, part, status, action, fidelity FROM d")
def carry_forward_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select("user_id", "event_id", "part", "status", "action", "fidelity")


@query(f"WITH {_EVIDENCE_SQL} SELECT status, action, count(*) AS n FROM d GROUP BY ROLLUP (status, action)")
def status_action_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).rollup("status", "action").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS block FROM lineitem WHERE l_returnflag = 'R'),
e AS (SELECT doc_id, unnest(range(1, max(block) + 1))::INT AS block FROM f GROUP BY doc_id)
SELECT e.doc_id, e.block, CASE WHEN f.block IS NULL THEN 'NONE' ELSE 'R' END AS finding, CASE WHEN f.block IS NULL THEN 'HIGH' ELSE 'LOW' END AS confidence FROM e LEFT JOIN f ON e.doc_id = f.doc_id AND e.block = f.block""")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    found = found.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("block"), F.lit("R").alias("finding"), F.lit("LOW").alias("confidence")).distinct()
    return findings.gap_filled(found, "doc_id")


@query("""WITH o AS (SELECT o_orderkey, o_orderdate, o_totalprice FROM orders), l AS (SELECT l_orderkey, count(*) AS n, min(l_shipdate) AS first_ship, max(l_linenumber) AS top FROM lineitem GROUP BY l_orderkey),
j AS (SELECT o_orderkey AS doc_id, l.n IS NOT NULL AS c1, coalesce(first_ship >= o_orderdate, false) AS c2, coalesce(top <= n, false) AS c3, coalesce(n >= o_orderkey % 5 + 1, false) AS c4 FROM o LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT doc_id, (c1::INT + c2::INT + c3::INT + c4::INT)::BIGINT AS closed, 4::BIGINT AS total, c1 AND c2 AND c3 AND c4 AS ready FROM j""")
def freshness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four checks of an order's evidence: lines exist, are not older than it, number no gap, cover it."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n"), F.min("l_shipdate").alias("first_ship"), F.max("l_linenumber").alias("top"))
    d = orders.join(per, "doc_id", "left")
    ok = [F.col("n").isNotNull(), gate.fresh(F.col("first_ship"), F.col("o_orderdate")), F.col("top") <= F.col("n"), F.col("n") >= F.col("doc_id") % 5 + 1]
    listed = F.array(*[F.struct(F.lit(i).alias("check_no"), F.coalesce(c, F.lit(False)).alias("ok")) for i, c in enumerate(ok)])
    return gate.verdicts(d.select("doc_id", F.inline(listed)))


@query("""SELECT l_orderkey AS doc_id, count(*) AS n, count(*) = count(DISTINCT l_partkey) AS "unique", bool_and(up) AS sorted FROM
(SELECT *, coalesce(lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) < l_partkey, true) AS up FROM lineitem) GROUP BY l_orderkey""")
def order_uniqueness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey").alias("ord"), "l_partkey")
    return gate.strictly_sorted(keyed(d, "doc_id"), "doc_id", "ord", "l_partkey")


_FORMS = {"that": "thet", "thatnd": "thetnd", "avec": "evec"}


@query(r"""WITH l AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10)) AS ls FROM documents),
x AS (SELECT doc_id, i, ls[i] AS line, regexp_matches(ls[i], 'thetnd|evec|thet') AS held FROM l),
y AS (SELECT doc_id, i, held, line, CASE WHEN held THEN line ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line,
  '(^|\P{L})thatnd(\P{L}|$)', '\1thetnd\2', 'g'), '(^|\P{L})thatnd(\P{L}|$)', '\1thetnd\2', 'g'), '(^|\P{L})avec(\P{L}|$)', '\1evec\2', 'g'), '(^|\P{L})avec(\P{L}|$)', '\1evec\2', 'g'), '(^|\P{L})that(\P{L}|$)', '\1thet\2', 'g'), '(^|\P{L})that(\P{L}|$)', '\1thet\2', 'g') END AS new FROM x),
z AS (SELECT doc_id, i, new, CASE WHEN held THEN 0 ELSE len(list_filter(regexp_extract_all(line, '\p{L}+'), lambda w: w IN ('that', 'thatnd', 'avec'))) END AS n FROM y)
SELECT doc_id, sum(n)::BIGINT AS n, md5(string_agg(new, chr(10) ORDER BY i)) AS digest FROM z GROUP BY doc_id HAVING sum(n) > 0""")
def guarded_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", names_replaced(F.col("text"), _FORMS).alias("r")).where("r.n > 0")
    return d.select("doc_id", F.col("r.n").cast("long").alias("n"), F.md5(F.col("r.text").cast("binary")).alias("digest"))


_PLAN = [("tion", "TION", None), ("TIONble", "Tionble", 1), ("the", "THE", None)]


@query("""WITH a AS (SELECT doc_id, text, replace(text, 'tion', 'TION') AS t1 FROM documents), b AS (SELECT *, replace(t1, 'TIONble', 'Tionble') AS t2 FROM a), c AS (SELECT *, replace(t2, 'the', 'THE') AS t3,
  ((length(text) - length(replace(text, 'tion', ''))) // 4) AS n1, ((length(t1) - length(replace(t1, 'TIONble', ''))) // 7) AS n2, ((length(t2) - length(replace(t2, 'the', ''))) // 3) AS n3 FROM b)
SELECT doc_id, n1 || ',' || n2 || ',' || n3 AS counts, n1 > 0 AND n2 = 1 AND n3 > 0 AS ok, md5(t3) AS digest FROM c""")
def ordered_patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = F.array(*[F.struct(F.lit(o).alias("old"), F.lit(n).alias("new"), F.lit(c).cast("int").alias("count")) for o, n, c in _PLAN])
    d = table(spark, sf_dir, "documents").select("doc_id", patched(F.col("text"), plan).alias("r"))
    return d.select("doc_id", F.array_join("r.counts", ",").alias("counts"), F.col("r.ok").alias("ok"), F.md5(F.col("r.text").cast("binary")).alias("digest"))


@query(f"""WITH {LINES},
w AS (SELECT doc_id, para_no, unnest(regexp_extract_all(lower(text), '\\p{{L}}{{5,}}')) AS word FROM lines), c AS (SELECT doc_id, word, para_no, count(*) AS n FROM w GROUP BY ALL)
SELECT * FROM (SELECT *, (sum(n) OVER (PARTITION BY doc_id, word ORDER BY para_no RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))::BIGINT AS n_near FROM c) WHERE n_near >= 3""")
def repetition_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.repetition(doc_lines(spark, sf_dir))


@query(f"""WITH {LINES},
o AS (SELECT doc_id, para_no, text FROM lines), n AS (SELECT doc_id, para_no, CASE WHEN para_no % 5 = 0 THEN text || ' 7' WHEN para_no % 7 = 0 THEN '- ' || text || '!' WHEN para_no % 3 = 0 THEN replace(text, 'th', 'd') ELSE text END AS text FROM lines WHERE para_no % 11 <> 0),
j AS (SELECT o.doc_id, o.para_no, o.text AS a, n.text AS b FROM o LEFT JOIN n USING (doc_id, para_no)),
k AS (SELECT doc_id, para_no, CASE WHEN b IS NULL THEN 'paragraph-lost' WHEN list_sort({_NUMBERS_SQL.format('a')}) <> list_sort({_NUMBERS_SQL.format('b')}) THEN 'numbers'
  WHEN regexp_replace(lower(a), '[^\\p{{L}}\\p{{N}}]+', '', 'g') <> regexp_replace(lower(b), '[^\\p{{L}}\\p{{N}}]+', '', 'g') THEN 'wording' WHEN a <> b THEN 'format' END AS kind FROM j)
SELECT doc_id, para_no, kind, CASE kind WHEN 'wording' THEN 'WEAK' WHEN 'format' THEN 'INFO' ELSE 'STRONG' END AS strength FROM k WHERE kind IS NOT NULL""")
def version_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line against a second version that loses, renumbers, marks or rewords some."""
    old, p = doc_lines(spark, sf_dir), F.col("para_no")
    text = F.when(p % 5 == 0, F.concat("text", F.lit(" 7"))).when(p % 7 == 0, F.concat(F.lit("- "), F.col("text"), F.lit("!"))).when(p % 3 == 0, F.replace("text", F.lit("th"), F.lit("d"))).otherwise(F.col("text"))
    return style.drift(old, old.where(p % 11 != 0).withColumn("text", text), ["doc_id", "para_no"])


@query(f"""WITH {TURNS}, f AS (SELECT doc_id, block_no, s, coalesce(t, '') AS t FROM turns)
SELECT doc_id, block_no, 'S1-open-end' AS signal FROM f WHERE t NOT IN ('', '—') AND NOT regexp_matches(t, '[.!?…»"]\\s*$')
UNION ALL SELECT doc_id, block_no, 'S2-empty' FROM f WHERE t IN ('', '—')
UNION ALL SELECT doc_id, block_no, 'S3-number' FROM f WHERE t NOT IN ('', '—') AND len(list_filter({_NUMBERS_SQL.format('s')}, lambda x: NOT list_contains({_NUMBERS_SQL.format('t')}, x))) > 0""")
def omission_precheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = turns(spark, sf_dir).select("doc_id", "block_no", strip(F.col("en")).alias("en"), strip(F.col("ed_ru")).alias("ed"))
    return style.omission_signals(view, "en", "ed")


@query(f"""WITH {LINES},
s AS (SELECT lang, unnest({SENTENCES.format('lines.text')}) AS s FROM lines JOIN (SELECT doc_id, lang FROM documents) USING (doc_id))
SELECT lang, kind, weight, count(*) AS n FROM (SELECT lang, 'digit' AS kind, 'weak' AS weight FROM s WHERE regexp_matches(s, '[0-9]') UNION ALL SELECT lang, 'negation', 'info' FROM s WHERE {HAS_WORD.format('s', _NEG)}) GROUP BY ALL""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, sentences and two rules over all documents, counted by language."""
    from weftline.functions.text import has_word
    from weftline.plans.rules import Rule
    from weftline.plans.rules import findings as evaluate

    d = paragraphs(table(spark, sf_dir, "documents"), "\n", ("lang",)).select("lang", F.explode(sentences(F.col("text"))).alias("s"))
    s, none = F.col("s"), F.lit("")
    return counts(evaluate(d, ["lang"], [Rule("digit", "weak", s.rlike("[0-9]"), none, none, none), Rule("negation", "info", has_word(s, _NEG), none, none, none)]), ["lang"])


@query(r"SELECT conv_id AS doc_id, count(*) AS turns, count(*) FILTER (regexp_matches(text, '[,\n]')) AS marked FROM conversations GROUP BY conv_id HAVING count(*) FILTER (regexp_matches(text, '[,\n]')) > 0")
def dialogue_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with a marked turn (the marks of speech are a parameter of the filter)."""
    d = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("turns"), F.count_if(has_dialogue(F.col("text"), ",\n")).alias("marked"))
    return d.where("marked > 0")


@query("""SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS translated, count(*) FILTER (toxic = 1) AS flagged, bool_and(quality = 1) AS closed FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def evidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts and an all-true gate per group."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("translated"), F.count_if(F.col("toxic") == 1).alias("flagged"), F.every(F.col("quality") == 1).alias("closed"))


@query(f"""WITH {LINES}, c AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id), j AS (SELECT doc_id, quality, toxic FROM labels)
SELECT doc_id FROM ((SELECT doc_id FROM c WHERE n >= 5 INTERSECT SELECT doc_id FROM j WHERE quality = 1) EXCEPT SELECT doc_id FROM j WHERE toxic = 1)""")
def slug_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations on ids: long enough and good, but not toxic."""
    long_ = doc_lines(spark, sf_dir).groupBy("doc_id").count().where("count >= 5").select("doc_id")
    labels = table(spark, sf_dir, "labels")
    return long_.intersect(labels.where("quality = 1").select("doc_id")).exceptAll(labels.where("toxic = 1").select("doc_id"))


import weftline.scan_queries  # noqa: E402, F401  registers its queries
import weftline.align_queries  # noqa: E402, F401  registers its queries
import weftline.file_queries  # noqa: E402, F401  registers its queries
import weftline.prose_queries  # noqa: E402, F401  registers its queries
