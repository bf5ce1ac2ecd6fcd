"""The literal rules, readers and functions on texts derived from the driver tables, each with its DuckDB counterpart.

The generated prose has few of the words and marks that the literal Russian, English and Japanese rules look for, so some of its
frequent words are replaced by them: which rows hold what follows from the tables, and the SQL reads the same derived
texts with patterns of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.numbers import ja_value
from weftline.functions.text import collapse_blank_lines, corrupt, first_of_list, fold, one_line, replaced_all, slug, strip, table_cell, volume
from weftline.operators import findings, gate, glossary, segment
from weftline.plans.address_rules import address_scan
from weftline.plans.align_rules import EN_RU, align_check
from weftline.plans.grammar_rules import IRREGULAR, grammar_scan
from weftline.plans.record_rules import record_scan
from weftline.queries import _STEM_SQL, _STEMS, HAS_WORD, LINES, SENTENCES, TURNS, doc_lines, query, table, turns
from weftline.scan_queries import _CHAPTER, chapter_texts
from weftline.sources import blocks as block_files
from weftline.sources import sinks
from weftline.sources.staging import new_path
from weftline.sources.tables import NAME_STOP, frozen_volumes, glossary_entries, glossary_names, glossary_stems


def swapped(c: Column, pairs: dict[str, str]) -> Column:
    """Words between blanks replaced one after another."""
    return replaced_all(F.concat(F.lit(" "), c, F.lit(" ")), {f" {a} ": f" {b} " for a, b in pairs.items()})


def _swapped_sql(text: str, pairs: dict[str, str]) -> str:
    out = f"(' ' || {text} || ' ')"
    for a, b in pairs.items():
        out = f"replace({out}, ' {a} ', ' {b.replace(chr(39), chr(39) * 2)} ')"
    return out


# Numbers.

_DIGITS = "〇一二三四五六七八九"


def numeral(n: Column) -> Column:
    """A whole number below 10**12 as a Japanese numeral; a one before ten, hundred and thousand is not written."""
    figures = F.lpad(n.cast("long").cast("string"), 12, "0")
    marked = F.regexp_replace(figures, "^" + "([0-9])" * 12 + "$", "$1c$2b$3a$4e$5c$6b$7a$8d$9c$10b$11a$12")
    bare = F.regexp_replace(F.regexp_replace(marked, "0c0b0a0[ed]|0[cba]?", ""), "1([cba])", "$1")
    return F.coalesce(F.translate(bare, "123456789abcde", _DIGITS[1:] + "十百千万億"), F.lit(""))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 50 <> 0 THEN (l_orderkey * 20011 + l_partkey * l_linenumber)::BIGINT END AS value FROM lineitem")
def ja_numeral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number of every order line as a Japanese numeral, and its value; some are written as zero, which has none."""
    n = F.col("l_orderkey") * 20011 + F.col("l_partkey") * F.col("l_linenumber")
    text = F.when(F.col("l_partkey") % 50 != 0, numeral(n)).otherwise("〇")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", ja_value(text).alias("value"))


_LATIN, _CYRILLIC, _KANA = "abcdefghijklmnopqrstuvwxyz", "абцдефгхийклмнопярстувшэыз", "あいうえおかきくけこさしすせそたちつてとなにぬねのは"


@query(f"""WITH g AS (SELECT n_nationkey, n_name, lower(n_name) AS name, translate(lower(n_name), '{_LATIN} ', '{_KANA}') AS ja, translate(lower(n_name), '{_LATIN}', '{_CYRILLIC}') AS ru, regexp_extract(n_name, '[0-9]+') AS k FROM nation),
c AS (SELECT c_custkey, name || '7' AS en, ja, ru, k, (c_custkey * 7919 + 11)::VARCHAR AS n FROM customer JOIN g ON n_nationkey = c_nationkey)
SELECT 'ja' AS lang, c_custkey, 'g:' || g.n_name AS anchor FROM c, g WHERE contains(c.ja, g.ja) UNION SELECT 'en', c_custkey, 'g:' || n_name FROM c, g WHERE contains(c.en, g.name) UNION SELECT 'ru', c_custkey, 'g:' || n_name FROM c, g WHERE contains(c.ru, g.ru)
UNION SELECT unnest(['ja', 'en', 'ru']), c_custkey, n FROM c UNION SELECT 'en', c_custkey, (k || '7')::BIGINT::VARCHAR FROM c UNION SELECT unnest(['ja', 'ru']), c_custkey, k::BIGINT::VARCHAR FROM c""")
def number_and_term_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's nation and number in three languages, written as each writes them, and their language-free anchors."""
    n, name = F.col("c_custkey") * 7919 + 11, F.lower("n_name")
    cyrillic = F.translate(name, _LATIN, _CYRILLIC)
    nations = table(spark, sf_dir, "nation")
    d = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    d = d.select(
        F.col("c_custkey").alias("doc_id"), F.lit(1).alias("block_no"), F.concat(F.translate(name, _LATIN + " ", _KANA), F.lit("で"), numeral(n)).alias("ja"),
        F.concat(F.lit("From "), F.initcap("n_name"), F.lit("7: "), F.format_number(n, 0), F.lit(" paid")).alias("en"), F.concat(F.lit("Из №"), cyrillic, F.lit(": "), F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))).alias("ru"),
    )
    entries = nations.select(F.concat(F.lit("g:"), "n_name").alias("key"), F.translate(name, _LATIN + " ", _KANA).alias("ja"), name.alias("en"), cyrillic.alias("ru"))
    found = glossary.anchors_by_language(d, entries, {lang: lang for lang in ("ja", "en", "ru")})
    return found.select("lang", F.col("doc_id").alias("c_custkey"), F.replace("anchor", F.lit("\x00"), F.lit("")).alias("anchor"))


# Text functions.

@query(rf"""WITH t AS (SELECT doc_id, translate(text, 'E', 'Ё') AS up, translate(text, 'zj', '|' || chr(65533)) AS odd, replace(text, '. ', '  ' || chr(10) || chr(10) || ' ' || chr(10) || chr(10)) AS gaps,
  translate(text, ',.', '」。') AS said, text, list_filter(regexp_extract_all(text, '\p{{L}}+'), lambda w: length(w) > 5) AS ws FROM documents WHERE text IS NOT NULL)
SELECT doc_id, md5(replace(lower(up), 'ё', 'е')) AS folded, md5(replace(replace(odd, '|', '\|'), chr(10), ' ')) AS cell, contains(odd, chr(65533)) AS broken,
  md5(regexp_replace(regexp_replace(regexp_replace(gaps, '(?m)[^\S\n]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g')) AS collapsed,
  md5(CASE WHEN length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 160 THEN left(trim(regexp_replace(text, '\s+', ' ', 'g')), 160) || '…' ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END) AS line,
  md5(coalesce(array_to_string(ws[1:10], ', '), '') || CASE WHEN len(ws) > 10 THEN ' (+' || (len(ws) - 10) || ')' ELSE '' END) AS listed,
  regexp_matches(said, '[」』][\s。！？!?…]*$') AS closes, regexp_matches(said, '^\s*$|[。！？!?…」』]\s*$') AS ends, md5(replace(replace(text, 'tion', 'сия'), 'сия', 'ция')) AS cleaned,
  'v' || doc_id || '-ch' || doc_id AS slug, CASE WHEN doc_id < 1000 THEN doc_id::INT END AS volume FROM t""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions on every whole text: folding, table cells, broken encodings, blank lines, one line, lists, marks of speech, clean-up, slugs."""
    t, id_ = F.col("text"), F.col("doc_id").cast("string")
    odd, said = replaced_all(t, {"z": "|", "j": "�"}), replaced_all(t, {",": "」", ".": "。"})
    gaps = F.replace(t, F.lit(". "), F.lit("  \n\n \n\n"))
    digest = lambda c: F.md5(c.cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"\p{L}{6,}"), F.lit(0))
    raw = F.concat(F.when(F.col("doc_id") % 2 == 0, "v0").otherwise(""), id_, F.lit("-ch"), id_)
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select(
        "doc_id", digest(fold(F.replace(t, F.lit("E"), F.lit("Ё")))).alias("folded"), digest(table_cell(odd)).alias("cell"), corrupt(odd).alias("broken"), digest(collapse_blank_lines(gaps)).alias("collapsed"),
        digest(one_line(t)).alias("line"), digest(first_of_list(words)).alias("listed"), segment.closes_speech(said).alias("closes"), segment.ends_terminal(said).alias("ends"),
        digest(replaced_all(t, {"tion": "сия", "сия": "ция"})).alias("cleaned"), slug(raw).alias("slug"), volume(slug(raw)).alias("volume"),
    )


# Readers.


@query(rf"""WITH c AS (SELECT {_CHAPTER} AS doc_id, turn::INT AS block_no, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM conversations),
p AS (SELECT doc_id, block_no, i, regexp_replace(line, '^\s+|\s+$', '', 'g') AS text FROM c), f AS (SELECT doc_id, block_no, i, text FROM p WHERE text <> ''),
a AS (SELECT DISTINCT {_CHAPTER} AS doc_id, turn::INT AS block_no FROM conversations WHERE turn % 4 = 0),
m AS (SELECT 'merge' AS mode, 0 AS e, doc_id, block_no, i, text FROM f UNION ALL SELECT 'merge', 0, doc_id, block_no, 1000000, 'again ' || block_no FROM a
  UNION ALL SELECT 'rows', 0, doc_id, block_no, i, text FROM f UNION ALL SELECT 'rows', 1, doc_id, block_no, 1, 'again ' || block_no FROM a
  UNION ALL SELECT 'last', 0, doc_id, block_no, i, text FROM f WHERE block_no % 4 <> 0 UNION ALL SELECT 'last', 0, doc_id, block_no, 1, 'again ' || block_no FROM a)
SELECT mode, doc_id, block_no, (row_number() OVER (PARTITION BY mode, e, doc_id, block_no ORDER BY i))::INT AS para_no, text FROM m""")
def block_reader_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three meanings of a repeated block number, on every conversation."""
    docs = chapter_texts(spark, sf_dir)
    found = [block_files.blocks(docs, mode).select(F.lit(mode).alias("mode"), "doc_id", "block_no", "para_no", "text") for mode in ("last", "rows", "merge")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(r"""WITH v AS (SELECT conv_id AS doc_id, (turn // 2)::INT AS block_no, arg_max(text, turn) FILTER (role = 'system') AS ja, arg_max(text, turn) FILTER (role = 'user') AS en, arg_max(text, turn) FILTER (role = 'assistant') AS ru FROM conversations GROUP BY ALL),
s AS (SELECT doc_id, block_no, regexp_replace(coalesce(ja, ''), '^\s+|\s+$', '', 'g') AS ja, regexp_replace(coalesce(en, ''), '^\s+|\s+$', '', 'g') AS en, regexp_replace(coalesce(ru, ''), '^\s+|\s+$', '', 'g') AS ru FROM v)
SELECT doc_id::VARCHAR AS doc_id, block_no, coalesce(nullif(ja, ''), '—') AS ja, coalesce(nullif(en, ''), '—') AS en, coalesce(nullif(ru, ''), '—') AS ru, '—' AS ed_ru FROM s""")
def merged_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a merged chapter, written out and read again; a missing field comes back as the dash it was printed as."""
    d = table(spark, sf_dir, "conversations")
    side = lambda role: F.max_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    view = d.groupBy(F.col("conv_id").cast("string").alias("doc_id"), F.floor(F.col("turn") / 2).cast("int").alias("block_no")).agg(side("system").alias("ja"), side("user").alias("en"), side("assistant").alias("ru"))
    view = view.withColumn("ed_ru", F.lit(None).cast("string"))
    return block_files.merged(sinks.merged_text(view)).select("doc_id", "block_no", "ja", "en", "ru", "ed_ru")


@query(rf"""WITH t AS (SELECT {_CHAPTER} AS doc_id, conv_id, turn::INT AS block_no, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?m)[^\S\n]+$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') AS text FROM conversations)
SELECT doc_id, 'Chapter ' || conv_id AS title, true AS marked, block_no, nullif(concat_ws(chr(10) || chr(10), nullif(text, ''), CASE WHEN block_no % 4 = 0 THEN 'again ' || block_no END), '') AS text FROM t""")
def chapter_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, marks and the texts of all blocks; repeated blocks are joined by a blank line."""
    return block_files.parsed_chapters(chapter_texts(spark, sf_dir)).where("block_no IS NOT NULL")


@query("""SELECT 'all' AS rule, o_orderkey::INT AS volume FROM orders GROUP BY ALL UNION ALL SELECT 'done', o_orderkey::INT FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL""")
def frozen_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's orders as a registry of volumes, read with and without a status."""
    status = F.when(F.col("o_orderstatus") == "F", "Завершён").otherwise("в работе")
    row = F.format_string("| %d | %s | |", "o_orderkey", status)
    docs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.concat(F.lit("# Registry\n\n| том | статус |\n|---|---|\n"), F.array_join(F.collect_list(row), "\n")).alias("text"))
    return frozen_volumes(docs).select(F.lit("all").alias("rule"), "volume").unionByName(frozen_volumes(docs, "завершён").select(F.lit("done").alias("rule"), "volume"))


@query(rf"""WITH {LINES}, w AS (SELECT doc_id, para_no, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM lines),
c AS (SELECT doc_id, para_no, w[1] AS ja, w[2] AS en, translate(w[3], '{_LATIN}', '{_CYRILLIC}') AS ru FROM w WHERE len(w) >= 3),
s AS (SELECT doc_id, ru, left(ru, greatest(4, length(ru) - 2)) AS stem, row_number() OVER (PARTITION BY doc_id, left(ru, greatest(4, length(ru) - 2)) ORDER BY para_no) AS turn FROM c WHERE length(ru) >= 4)
SELECT 'entry' AS use, doc_id, ru, 'g:' || ja AS value FROM c UNION ALL SELECT 'stem', doc_id, ru, stem FROM s WHERE turn = 1
UNION ALL SELECT 'name', doc_id, ru, en FROM c WHERE length(ru) >= 4 AND length(en) >= 4 AND en NOT IN ({', '.join(repr(w) for w in NAME_STOP)})""")
def glossary_readers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a glossary of its own, a row for each line of three words: read for names, for stems (first wins) and for anchors."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    d = doc_lines(spark, sf_dir).select("doc_id", "para_no", words.alias("w")).where("size(w) > 2")
    row = F.concat(F.lit("| "), F.get("w", F.lit(0)), F.lit(" | "), F.initcap(F.get("w", F.lit(1))), F.lit(" | "), F.translate(F.get("w", F.lit(2)), _LATIN, _CYRILLIC), F.lit(" | |"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("para_no", row.alias("r")))), lambda x: x["r"])
    docs = d.groupBy("doc_id").agg(F.concat(F.lit("| JA | EN | — | note |\n|---|---|---|---|\n"), F.array_join(rows, "\n")).alias("text"))
    names = glossary_names(docs).select(F.lit("name").alias("use"), "doc_id", "ru", F.array_join("en_forms", ",").alias("value"))
    stems = glossary_stems(docs).select(F.lit("stem").alias("use"), "doc_id", F.col("canon").alias("ru"), F.col("stem").alias("value"))
    return names.unionByName(stems).unionByName(glossary_entries(docs).select(F.lit("entry").alias("use"), "doc_id", "ru", F.col("key").alias("value")))


# Rules.

#: Words of the tables as words and marks of the literal rules; the base text keeps no digits, percent signs or quotes.
_EN = {"de": "not", "la": "us", "der": '"so"', "el": "right?", "que": "12"}
_RU = {"de": "не", "la": "вам", "le": "мы", "der": "— да", "el": "так?", "die": "двенадцать", "en": "12", "las": "нас"}
_BASE = "regexp_replace({0}, '[0-9%\"]', '', 'g')"


@query(rf"""WITH {TURNS}, b AS (SELECT doc_id, block_no, {_swapped_sql(_BASE.format("s"), _EN)} AS s, CASE WHEN t IS NULL OR t = '' THEN '' ELSE {_swapped_sql(_BASE.format("t"), _RU)} END AS t FROM turns),
n AS (SELECT doc_id, block_no, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM b),
k AS (
  SELECT doc_id, block_no, 'no-translation' AS kind FROM n WHERE t IN ('', '—')
  UNION ALL SELECT doc_id, block_no, 'speech' FROM n WHERE t NOT IN ('', '—') AND contains(s, '"') <> regexp_matches(t, '[—«]')
  UNION ALL SELECT doc_id, block_no, 'marks' FROM n WHERE t NOT IN ('', '—') AND contains(s, '?') <> contains(t, '?')
  UNION ALL SELECT doc_id, block_no, 'negation' FROM n WHERE t NOT IN ('', '—') AND {HAS_WORD.format('s', EN_RU.source_negation.replace("n't|", ""))} <> {HAS_WORD.format('t', EN_RU.target_negation)}
  UNION ALL SELECT doc_id, block_no, 'pronouns' FROM n WHERE t NOT IN ('', '—') AND {HAS_WORD.format('s', EN_RU.source_we)} AND {HAS_WORD.format('t', EN_RU.target_you)} AND NOT {HAS_WORD.format('t', EN_RU.target_we)}
  UNION ALL SELECT doc_id, block_no, 'numbers' FROM n WHERE t NOT IN ('', '—') AND contains(s, '12') AND NOT contains(t, '12'))
SELECT doc_id, block_no, kind FROM k""")
def align_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal English and Russian alignment rules on every pair of turns, some of whose words are words of the rules."""
    base = lambda c: F.regexp_replace(c, '[0-9%"]', "")
    d = turns(spark, sf_dir).select("doc_id", "block_no", strip(F.col("en")).alias("s"), strip(F.col("ed_ru")).alias("t"))
    target = F.when(F.coalesce("t", F.lit("")) == "", "").otherwise(swapped(base(F.col("t")), _RU))
    return align_check(d.select("doc_id", "block_no", swapped(base(F.col("s")), _EN).alias("en"), target.alias("ed_ru"))).select("doc_id", "block_no", "kind")


_VOICE = {"la": "was taken by the", "le": "Anna's hat was"}
_PARTS = {"de": "потерялся", "que": "был сломан", "le": "она устали", "et": "3", "der": "разумеется"}
_W = r"[\p{L}\p{N}_]"
_PASSIVE_SQL = rf"regexp_matches(s, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:was|were|is|are|am|been|being|be|got|gets)\s+(?:{_W}+\s+){{0,2}}(?:{_W}+ed|{'|'.join(IRREGULAR)})(?:$|[^\p{{L}}\p{{N}}_])')"


@query(rf"""WITH {LINES}, b AS (SELECT doc_id, para_no AS block_no, {_swapped_sql(_BASE.format("text"), _VOICE)} AS s, {_swapped_sql(_BASE.format("text"), _PARTS)} AS t FROM lines),
f AS (SELECT doc_id, block_no, {_PASSIVE_SQL} AS passive, regexp_matches(s, '(?i)(?:^|[^\p{{L}}\p{{N}}_])by\s+(?:the|his|her|their|its|a|an)(?:$|[^\p{{L}}\p{{N}}_])') AS agent,
  regexp_matches(s, '(?i){_W}''s\s+{_W}+\s+(?:was|were)(?:$|[^\p{{L}}\p{{N}}_])') AS owner, contains(t, 'потерялся') AS refl, contains(t, 'был сломан') AS passive_ru, contains(t, 'она устали') AS agree, contains(t, ' 3 ') AS digit FROM b)
SELECT doc_id, block_no, 'voice' AS kind FROM f WHERE passive AND agent AND refl AND NOT owner UNION ALL SELECT doc_id, block_no, 'possessive' FROM f WHERE owner
UNION ALL SELECT doc_id, block_no, 'passive-ru' FROM f WHERE passive_ru UNION ALL SELECT doc_id, block_no, 'agreement' FROM f WHERE agree UNION ALL SELECT doc_id, block_no, 'numbers' FROM f WHERE digit""")
def grammar_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal grammar rules on every whole line, some of whose words are phrases of the rules."""
    base = F.regexp_replace("text", '[0-9%"]', "")
    d = doc_lines(spark, sf_dir).select("doc_id", F.col("para_no").alias("block_no"), swapped(base, _VOICE).alias("en"), swapped(base, _PARTS).alias("ed_ru"))
    return grammar_scan(d).select("doc_id", "block_no", "kind")


@query(rf"""WITH {LINES}, b AS (SELECT doc_id, para_no AS block_no, {_swapped_sql(_BASE.format("text"), _VOICE)} AS s, {_swapped_sql(_BASE.format("text"), _PARTS)} AS t FROM lines),
r AS (SELECT doc_id, block_no, regexp_matches(t, ' 3 ') AS digit, list_filter({SENTENCES.format("t")}, lambda x: contains(x, 'был сломан'))[1] AS broken FROM b)
SELECT doc_id, 'passive-ru' AS kind, count(*) AS n, min(md5(broken)) AS least FROM r WHERE broken IS NOT NULL GROUP BY doc_id UNION ALL SELECT doc_id, 'numbers', count(*), NULL FROM r WHERE digit GROUP BY doc_id""")
def scanner_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the grammar checks alone, counted by document, with the sentences they show."""
    base = F.regexp_replace("text", '[0-9%"]', "")
    d = doc_lines(spark, sf_dir).select("doc_id", F.col("para_no").alias("block_no"), swapped(base, _VOICE).alias("en"), swapped(base, _PARTS).alias("ed_ru"))
    found = grammar_scan(d, only=("passive-ru", "numbers"))
    least = F.min(F.when(F.col("kind") == "passive-ru", F.md5(F.col("target").cast("binary"))))
    return found.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), least.alias("least"))


_ADDRESS = {"de": "мисс", "la": "господин"}
_ADDRESSED = r"(?i)(?:^|[^\p{L}\p{N}_])(мисс|господин)\s+([а-яё][а-яё]+)"


@query(rf"""WITH {LINES}, b AS (SELECT doc_id, para_no AS block_no, text AS s, translate({_swapped_sql("text", _ADDRESS)}, '{_LATIN}', '{_CYRILLIC}') AS t FROM lines),
n AS (SELECT doc_id, block_no, translate(s, '{_LATIN}', '{_CYRILLIC}') AS s, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM b),
m AS (SELECT doc_id, block_no, {SENTENCES.format("s")} AS ss, {SENTENCES.format("t")} AS ts, unnest(regexp_extract_all(t, '{_ADDRESSED}', 1)) AS p, unnest(regexp_extract_all(t, '{_ADDRESSED}', 2)) AS name, generate_subscripts(regexp_extract_all(t, '{_ADDRESSED}', 1), 1) - 1 AS cand_no FROM n)
SELECT doc_id, block_no, cand_no::INT AS cand_no, lower(p) AS prefix, name, coalesce(list_filter(ss, lambda x: contains(x, name))[1], '') AS source FROM m WHERE len(list_filter(ts, lambda x: contains(lower(x), lower(p)) AND contains(x, name))) > 0""")
def address_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal titles in every line; the source is shown by the first sentence with the name as the target spells it."""
    cyrillic = lambda c: F.translate(c, _LATIN, _CYRILLIC)
    d = doc_lines(spark, sf_dir).select("doc_id", F.col("para_no").alias("block_no"), cyrillic(F.col("text")).alias("en"), cyrillic(swapped(F.col("text"), _ADDRESS)).alias("ed_ru"))
    return address_scan(d).select("doc_id", "block_no", "cand_no", "prefix", "name", "source")


_SPOKEN = {"de": "сказал", "la": "усмехнулась"}


@query(rf"""WITH {LINES}, b AS (SELECT doc_id, para_no, regexp_replace(replace({_swapped_sql("text", _SPOKEN)}, '. ', '. — '), '^\s+|\s+$', '', 'g') AS line FROM lines),
x AS (SELECT doc_id, para_no, line, regexp_extract_all(line, '[.!?…»][ \t]+—[ \t]+[А-ЯЁA-Z][а-яёa-z\-]+') AS hits, regexp_split_to_array(line, '[.!?…»][ \t]+—[ \t]+[А-ЯЁA-Z][а-яёa-z\-]+') AS gaps FROM b WHERE NOT starts_with(line, '#')),
y AS (SELECT doc_id, para_no, line, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM x),
z AS (SELECT doc_id, para_no, line, hits[i] AS hit, (coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0))::INT AS start FROM y),
w AS (SELECT *, list_transform(regexp_extract_all(substring(line, start + length(regexp_extract(hit, '^[^\s]+[ \t]+—[ \t]+')) + 1), '\p{{L}}[\p{{L}}''’\-]*')[1:4], lambda v: lower(v)) AS tail FROM z)
SELECT doc_id, para_no, 1 AS line_no, start FROM w WHERE NOT list_bool_or(list_transform(tail, lambda v: starts_with(v, 'сказал') OR starts_with(v, 'усмехнулась')))""")
def record_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal borders of records in every line with dashes after its sentences, unless one of the literal verbs follows."""
    text = strip(F.replace(swapped(F.col("text"), _SPOKEN), F.lit(". "), F.lit(". — ")))
    return record_scan(doc_lines(spark, sf_dir).withColumn("text", text)).select("doc_id", "para_no", "line_no", "start")


# Evidence and reports.


@query("""WITH r AS (SELECT user_id, event_type, list(event_id ORDER BY ts, event_id) AS ids, arg_max(event_id, (ts, event_id)) AS last, max(value) AS v FROM events GROUP BY ALL)
SELECT user_id, event_type, CASE WHEN v > 90 THEN 'REPORT_ONLY' ELSE 'PRESERVED' END AS action,
  CASE WHEN len(ids) = 1 THEN '' ELSE array_to_string(list_transform(ids[1:len(ids) - 1], lambda x: 'r' || (x % 5)), ',') || CASE WHEN list_contains(list_transform(ids[1:len(ids) - 1], lambda x: x % 5), last % 5) THEN '' ELSE ',r' || (last % 5) END END AS sources FROM r""")
def provenance_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's last run joins the sources of each type that are there and lack it; a fix is reported, not applied."""
    d = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("e"), F.max("value").alias("v"))
    runs = F.transform("e", lambda x: F.concat(F.lit("r"), x["event_id"] % 5))
    d = d.select("user_id", "event_type", F.when(F.col("v") > 90, "FIXED").otherwise("PRESERVED").alias("action"), F.slice(runs, 1, F.size("e") - 1).alias("sources"), F.element_at(runs, -1).alias("run"))
    return d.select("user_id", "event_type", findings.clamped(F.col("action")).alias("action"), F.array_join(findings.with_source(F.col("sources"), F.col("run")), ",").alias("sources"))


@query(f"""WITH {LINES}, f AS (SELECT doc_id, para_no AS block_no, CASE WHEN regexp_matches(text, '[0-9]') THEN 'digit' ELSE 'mark' END AS kind, left(text, 40) AS detail FROM lines WHERE regexp_matches(text, '[0-9!]')),
h AS (SELECT doc_id, string_agg(kind || ': ' || n, '; ' ORDER BY kind) AS head FROM (SELECT doc_id, kind, count(*) AS n FROM f GROUP BY ALL) GROUP BY doc_id),
b AS (SELECT doc_id, string_agg('### ' || block_no || ' — ' || kind || chr(10) || detail, chr(10) || chr(10) ORDER BY block_no, kind) AS body FROM f GROUP BY doc_id)
SELECT doc_id, md5('# Report' || chr(10) || chr(10) || head || chr(10) || chr(10) || body) AS digest FROM h JOIN b USING (doc_id)""")
def finding_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for every document with findings: counts by kind, then the findings by block and kind."""
    d = doc_lines(spark, sf_dir).where(F.col("text").rlike("[0-9!]"))
    d = d.select("doc_id", F.col("para_no").alias("block_no"), F.when(F.col("text").rlike("[0-9]"), "digit").otherwise("mark").alias("kind"), F.left("text", F.lit(40)).alias("detail"), F.lit(0).alias("emit_ord"))
    return sinks.report_text(d, "Report").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(rf"""WITH t AS (SELECT {_CHAPTER} AS doc_id, conv_id, turn, regexp_split_to_array(coalesce(text, ''), '\n\s*\n') AS ps FROM conversations),
p AS (SELECT doc_id, turn AS a, generate_subscripts(ps, 1) AS b, regexp_replace(unnest(ps), '^\s+|\s+$', '', 'g') AS text FROM t UNION ALL SELECT DISTINCT doc_id, -2, 1, '# Chapter ' || conv_id FROM t UNION ALL SELECT DISTINCT doc_id, -1, 1, 'before any block' FROM t)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a, b))::INT AS para_no, text FROM p WHERE text <> ''""")
def record_paragraph_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of every chapter but those that begin with a block marker, with whatever is attached to it."""
    return block_files.record_paragraphs(chapter_texts(spark, sf_dir)).select("doc_id", "para_no", "text")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), w AS (SELECT * FROM c WHERE user_id % 7 = 0 AND event_type = 'click')
SELECT user_id, event_type, n FROM w UNION ALL SELECT user_id, event_type, n + 1 FROM w""")
def summary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every user's events against a summary kept as JSON, some of whose counts are wrong."""
    counts = findings.counted(table(spark, sf_dir, "events"), "user_id", "event_type")
    wrong = (F.col("user_id") % 7 == 0) & (F.col("event_type") == "click")
    path = new_path(spark, "summary")
    sinks.write_json(counts.withColumn("n", F.col("n") + F.when(wrong, 1).otherwise(0)), path)
    return findings.same_counts(counts, spark.read.schema("user_id long, event_type string, n long").json(path))


@query("""SELECT event_id, CASE WHEN event_type IN ('click', 'error') THEN upper(event_type) ELSE 'OTHER' END AS issue_type, CASE WHEN event_id % 3 <> 0 THEN 'e' || event_id END AS omitted, user_id::VARCHAR AS chapter FROM events""")
def normal_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a finding with a known issue type; its omission fields stay only if all are given."""
    last = findings.OMISSION[-1]
    fields = [F.when((F.col("event_id") % 3 != 0) | F.lit(f != last), F.concat(F.lit("e"), "event_id")).alias(f) for f in findings.OMISSION]
    finding = F.struct(F.col("event_type").alias("issue_type"), F.col("user_id").cast("string").alias("chapter"), *fields)
    d = table(spark, sf_dir, "events").select("event_id", findings.normalised(finding, ("CLICK", "ERROR"), "OTHER").alias("f"))
    return d.select("event_id", "f.issue_type", F.col(f"f.{findings.OMISSION[0]}").alias("omitted"), "f.chapter")


@query(rf"""WITH {LINES}, st AS ({_STEM_SQL}), o AS (SELECT *, row_number() OVER (ORDER BY list_position([{', '.join(repr(c) for _, c in _STEMS)}], canon)) - 1 AS no FROM st),
g AS (SELECT doc_id, para_no, no, canon, text, regexp_extract(text, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(' || stem || '[\p{{L}}\-]*)', 1) AS form, regexp_extract(text, '(?is)^(.*?(?:^|[^\p{{L}}\p{{N}}_]))' || stem, 1) AS ahead FROM lines, o WHERE contains(lower(text), stem)),
h AS (SELECT doc_id, para_no, no, canon, form, substring(text, greatest(length(ahead) - 20, 0) + 1, length(ahead) + length(form) + 40 - greatest(length(ahead) - 20, 0)) AS context FROM g WHERE form <> ''),
f AS (SELECT doc_id, no, canon, form, count(*) AS n, min(para_no) AS first FROM h GROUP BY ALL), l AS (SELECT doc_id, no, string_agg(form || ' ×' || n, ', ' ORDER BY n DESC, first, form) AS forms FROM f GROUP BY ALL),
w AS (SELECT doc_id, no, canon, count(*) AS n, string_agg(para_no::VARCHAR, ', ' ORDER BY para_no) AS blocks, arg_min(context, para_no) AS context FROM h GROUP BY ALL)
SELECT doc_id, md5(string_agg('## ' || canon || ': ' || n || chr(10) || 'blocks ' || blocks || chr(10) || forms || chr(10) || '> ' || context, chr(10) || chr(10) ORDER BY no)) AS digest FROM w JOIN l USING (doc_id, no) GROUP BY doc_id""")
def inventory_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for every document with words of some stems: occurrences, places, forms and the first context of each."""
    stems = spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(_STEMS)], "line_no int, stem string, canon string")
    hits = glossary.stem_hits(doc_lines(spark, sf_dir).withColumn("block_no", F.col("para_no")), stems, letters=r"\p{L}")
    return sinks.inventory_text(hits).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""WITH a AS (SELECT user_id, (event_id % 9 + 1)::INT AS block, event_type AS problem, 'v' || floor(value / 20)::INT AS source, row_number() OVER (PARTITION BY user_id, event_id % 9, event_type, floor(value / 20) ORDER BY event_id) AS n FROM events WHERE event_id % 2 = 0),
b AS (SELECT user_id, (event_id % 9 + 1)::INT AS block, event_type AS problem, 'v' || floor(value / 20)::INT AS source, row_number() OVER (PARTITION BY user_id, event_id % 9, event_type, floor(value / 20) ORDER BY event_id) AS n FROM events WHERE event_id % 2 = 1),
m AS (SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.block, b.block) AS block, coalesce(a.problem, b.problem) AS problem, coalesce(a.source, b.source) AS source, CASE WHEN b.n IS NULL THEN 'ONLY_A' WHEN a.n IS NULL THEN 'ONLY_B' ELSE 'BOTH_FOUND' END AS status
  FROM a FULL JOIN b ON a.user_id = b.user_id AND a.block = b.block AND a.problem = b.problem AND a.source = b.source AND a.n = b.n)
SELECT user_id, md5('BOTH_FOUND: ' || count(*) FILTER (status = 'BOTH_FOUND') || '; ONLY_A: ' || count(*) FILTER (status = 'ONLY_A') || '; ONLY_B: ' || count(*) FILTER (status = 'ONLY_B') || '; total: ' || count(*) || chr(10) || chr(10)
  || string_agg('### ' || block || ' ' || status || chr(10) || problem || chr(10) || source, chr(10) || chr(10) ORDER BY block, status, problem, source)) AS digest FROM m GROUP BY user_id""")
def merge_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even and odd events of every user as the findings of two auditors, matched one to one and reported."""
    d = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 9 + 1).cast("int").alias("block"), F.col("event_type").alias("problem"), F.concat(F.lit("v"), F.floor(F.col("value") / 20).cast("int").cast("string")).alias("source"))
    side = lambda odd: d.where(F.col("event_id") % 2 == odd)
    return sinks.merge_text(findings.matched(side(0), side(1), ["event_id"], ["user_id"]), ("user_id",)).select("user_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""SELECT conv_id AS doc_id, turn AS block_no, coalesce(text, '') AS text FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'appended to ' || conv_id FROM conversations GROUP BY conv_id""")
def appended_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block more at the end of every conversation; a number that is there already would be an error."""
    d = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_no"), F.coalesce("text", F.lit("")).alias("text"))
    new = d.groupBy("doc_id").agg((F.max("block_no") + 1).alias("block_no")).withColumn("text", F.concat(F.lit("appended to "), F.col("doc_id").cast("string")))
    return sinks.appended(d, new)
