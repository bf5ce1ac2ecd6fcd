"""Queries of the training-data operators and, where SQL can express one, its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm._common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.pii import digest, personal_data

    return digest(personal_data(table(spark, sf_dir, "documents")))


def op2_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.credentials import digest, secret_spans

    return digest(secret_spans(table(spark, sf_dir, "documents")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.suffix_dedup import repeated_substrings

    return repeated_substrings(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.repeated_windows import repeated_windows

    return repeated_windows(table(spark, sf_dir, "documents"))


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.line_rules import apply_line_rules

    return apply_line_rules(table(spark, sf_dir, "documents"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.kneser_ney import model_scores

    return model_scores(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.bag_minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.source_divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.llm.hard_negatives import hard_negatives, scaled_vectors

    return hard_negatives(scaled_vectors(table(spark, sf_dir, "embeddings")))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from weftline.llm.byte_bpe import decoded, digest, encoded, read_codec

    codec = read_codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return digest(decoded(encoded(table(spark, sf_dir, "documents"), codec), codec))


# Parts of the queries above that SQL can express, through the same operators.


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the digest of the base rules of op1."""
    return op1_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the digest of the base rules of op2."""
    return op2_credentials(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def exact_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 finds at distance 0."""
    return op4_decontaminate(spark, sf_dir).where("distance = 0").select("doc_id", "item_id")


def language_model_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base score of op7, rounded."""
    return op7_kneser_ney(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def toxicity_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds of op8."""
    return op8_toxicity(spark, sf_dir).select("doc_id", "held_out")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets of op10, rounded, and whether a document keeps its limit."""
    d = op10_mixing(spark, sf_dir)
    return d.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("taken") <= 3 * F.col("size")).alias("within"))


def mixing_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source's words of op10 meet its target within one word."""
    d = op10_mixing(spark, sf_dir).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    return d.select("source", (F.abs(F.col("taken") - F.col("target")) <= 1).alias("met"))


def byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of what op13 decodes, which is that of the text."""
    return op13_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_credentials": op2_credentials,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_repeated_windows": op5_repeated_windows,
    "op6_line_rules": op6_line_rules,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_toxicity": op8_toxicity,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_mixing": op10_mixing,
    "op11_source_divergence": op11_source_divergence,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_byte_bpe": op13_byte_bpe,
    "pii_base_spans": pii_base_spans,
    "secret_base_spans": secret_base_spans,
    "exact_leaks": exact_leaks,
    "language_model_base": language_model_base,
    "toxicity_folds": toxicity_folds,
    "mixing_targets": mixing_targets,
    "mixing_sums": mixing_sums,
    "byte_bpe_round_trip": byte_bpe_round_trip,
}

#: Lines, words and windows are compared themselves here, not their hashes.
OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, unnest(range(1, greatest(len(words) - 3, 1))) AS p, words FROM w),
g2 AS (SELECT r, p, list_aggregate(words[p:p + 4], 'string_agg', ' ') AS s FROM g),
g3 AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS c FROM g2) WHERE c > 1),
rep AS (SELECT r, sum(least(5, coalesce(nxt - p, 5))) AS n FROM (SELECT r, p, lead(p) OVER (PARTITION BY r ORDER BY p) AS nxt FROM g3) GROUP BY r),
l AS (SELECT r, unnest(lines) AS line FROM w),
k AS (SELECT r, line, regexp_replace(lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))), '[0-9]', '0', 'g') AS norm FROM l),
hosts AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
f AS (SELECT d.source, norm, count(DISTINCT r) AS n FROM k JOIN d USING (r) GROUP BY ALL),
freq AS (SELECT f.source, norm FROM f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE n > 2 AND n > docs * 0.02),
gone AS (SELECT k.r, count(*) AS n_lines, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS n_words
         FROM k JOIN d USING (r) JOIN freq ON freq.source IS NOT DISTINCT FROM d.source AND freq.norm = k.norm GROUP BY k.r),
m AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n_lines, 0)::BIGINT AS n_removed_lines,
      (len(words) - coalesce(gone.n_words, 0))::BIGINT AS n_left_words
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)) AND n_left_words >= 10 AND n_left_words >= 0.5 * n_words AS kept,
       n_removed_lines, n_left_words FROM m
"""

#: Strings of 100 bytes as hex digits, compared by their 128-bit MD5, in overlapping pieces of 1,099 bytes.
OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT r, doc_id, h, length(h) // 2 AS n_bytes FROM d),
c AS (SELECT r, doc_id, c, h[2000 * c + 1:2000 * c + 2198] AS chunk FROM (SELECT r, doc_id, h, unnest(range(0, n_bytes // 1000 + 1)) AS c FROM n)),
w AS (SELECT r, doc_id, 1000 * c + unnest(range(0, greatest(length(chunk) // 2 - 99, 0))) AS p,
      unnest(list_transform(range(0, greatest(length(chunk) // 2 - 99, 0)), lambda i: md5_number(chunk[2 * i + 1:2 * i + 200]))) AS s FROM c),
f AS (SELECT r, p, row(doc_id, p) > min(row(doc_id, p)) OVER (PARTITION BY s) AS again FROM w),
m AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM f WHERE again),
k AS (SELECT r, p, sum(CASE WHEN before IS NULL OR p > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS span FROM m),
s AS (SELECT r, span, min(p) AS a, max(p) + 100 AS e FROM k GROUP BY r, span),
t AS (SELECT r, count(*) AS n_spans, sum(e - a)::BIGINT AS n_removed, list(a ORDER BY a) AS starts, list(e ORDER BY a) AS ends FROM s GROUP BY r),
x AS (SELECT n.r, doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      CASE WHEN n_spans IS NULL THEN h ELSE list_aggregate(list_transform(range(0, n_spans + 1), lambda i: h[2 * coalesce(ends[i], 0) + 1:2 * coalesce(starts[i + 1], n_bytes)]), 'string_agg', '') END AS kept
      FROM n LEFT JOIN t ON n.r = t.r)
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM x
"""

#: Windows are compared as word sequences; rows of one id are one document.
OP5_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id,
      list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT r, doc_id, unnest(range(1, greatest(len(words) - 18, 1))) AS p, words FROM w),
s AS (SELECT r, doc_id, p, list_aggregate(words[p:p + 19], 'string_agg', ' ') AS s FROM g),
f AS (SELECT r, p, row(doc_id, p) > min(row(doc_id, p)) OVER (PARTITION BY s) AS again FROM s),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 20)) AS k FROM f WHERE again),
k AS (SELECT r, unnest(range(1, len(words) + 1)) AS k, unnest(words) AS word FROM w),
kept AS (SELECT k.r, string_agg(word, ' ' ORDER BY k.k) AS t, count(*) AS n FROM k ANTI JOIN gone USING (r, k) GROUP BY k.r)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

def _spans_sql(kinds: dict[str, tuple[str, str]], order: str) -> str:
    """Counts by kind and the digest of base spans; a kind has a pattern and a check of a match m, places come from the gaps."""
    found = " UNION ALL ".join(
        f"SELECT r, '{k}' AS kind, {i} AS rank, regexp_extract_all(text, '{p}') AS hits, regexp_split_to_array(text, '{p}') AS gaps FROM d" for i, (k, (p, _)) in enumerate(kinds.items())
    )
    ok = " ".join(f"WHEN '{k}' THEN {c}" for k, (_, c) in kinds.items())
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in kinds)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
h AS (SELECT * FROM ({found}) WHERE len(hits) > 0), u AS (SELECT r, kind, rank, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM h),
s AS (SELECT r, kind, rank, hits[i] AS m, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a FROM u),
t AS (SELECT r, kind, rank, a::BIGINT AS a, (a + length(m))::BIGINT AS e FROM s WHERE CASE kind {ok} END),
g AS (SELECT r, {counts}, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY {order}) AS listed FROM t GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in kinds)}, sha256(coalesce(listed, '')) AS base_sha256 FROM d LEFT JOIN g USING (r)"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(0, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN reverse({_DIGITS})[i + 1]::INT ELSE (2 * reverse({_DIGITS})[i + 1]::INT) // 10 + (2 * reverse({_DIGITS})[i + 1]::INT) % 10 END)) % 10 = 0"
PII_SQL = _spans_sql({
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "list_max(list_transform(string_split(m, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE coalesce(try_cast(x AS INT), 999) END)) <= 255"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 8 AND 15"),
}, "rank, a")
_ASSIGN = r"(?:(?i:password|passwd|secret|token|api_?key))[\"'']?\x20*[:=]\x20*[\"'']?"
SECRET_SQL = _spans_sql({
    "assign": (_ASSIGN + r"[A-Za-z0-9+/_.=-]+", f"length(regexp_extract(m, '^{_ASSIGN}([A-Za-z0-9+/_.=-]+)', 1)) >= 8"),
    "access": (r"AKIA[A-Z0-9]+", "length(m) >= 16"), "hex": (r"[0-9a-f]+", "length(m) >= 32"),
}, "a, rank")

_FOLD = "regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]', ' ', 'g')"
LEAKS_SQL = f"""WITH b AS (SELECT item_id, {_FOLD.format('text')} AS t FROM benchmark WHERE length(text) > 0), d AS (SELECT doc_id, {_FOLD.format('text')} AS t FROM documents)
SELECT DISTINCT doc_id, item_id FROM d JOIN b ON contains(d.t, b.t)"""

#: CRC-32 of an id's digits: a table made by its rule, then one look-up a digit.
_CRC = """crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT) AS v FROM range(256) r(i))),
ids AS (SELECT DISTINCT doc_id, string_split(coalesce(doc_id::VARCHAR, ''), '') AS cs FROM documents),
fold AS (SELECT doc_id, xor(list_reduce(list_transform(cs, lambda x: ascii(x)::BIGINT), lambda c, b: xor(tab[(xor(c, b) % 256) + 1], c // 256), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM ids, crc)"""
FOLDS_SQL = f"WITH {_CRC} SELECT d.doc_id, crc % 3 = 1 AS held_out FROM documents d JOIN fold f ON d.doc_id IS NOT DISTINCT FROM f.doc_id"
MODEL_SQL = rf"""WITH {_CRC},
d AS (SELECT row_number() OVER () AS r, d.doc_id, crc % 7 = 2 AS held, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents d JOIN fold f ON d.doc_id IS NOT DISTINCT FROM f.doc_id),
t AS (SELECT r, held, unnest(list_append(ws, ' ')) AS w FROM d), c AS (SELECT w, count(*) AS c FROM t WHERE NOT held GROUP BY w), n AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c),
s AS (SELECT r, count(*) AS n_tokens, count(c.c) AS n_known, sum(log10((coalesce(c.c, 0) + 1) / (n.n + (n.v + 1))::DOUBLE)) AS base FROM t LEFT JOIN c USING (w), n GROUP BY r)
SELECT doc_id, held AS held_out, n_tokens, n_known, n.n AS train_tokens, round(base, 4) AS base_score FROM d JOIN s USING (r), n"""

_TARGETS = r"""d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source), s1 AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS w FROM s0),
s2 AS (SELECT *, 3 * source_size / w AS f, row_number() OVER (ORDER BY 3 * source_size / w, source) AS k FROM s1),
s3 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s AS (SELECT source, source_size, CASE WHEN f < level THEN 3 * source_size ELSE w * (SELECT arg_min(level, k) FROM s3 WHERE f >= level) END AS target FROM s3)"""
TARGETS_SQL = f"WITH {_TARGETS} SELECT doc_id, size, source_size, round(target, 3) AS target, true AS within FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source"
SUMS_SQL = "SELECT source, true AS met FROM documents GROUP BY source"

#: Bags of five-word windows, all pairs that share one, and classes by spreading the smallest row number.
NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
k AS MATERIALIZED (SELECT min(r) AS c, count(*) AS n, min(doc_id) AS first, ws FROM d GROUP BY ws),
g AS (SELECT c, ws, unnest(range(1, greatest(len(ws) - 3, CASE WHEN len(ws) > 0 THEN 2 ELSE 1 END))) AS p FROM k),
b AS MATERIALIZED (SELECT c, list_aggregate(ws[p:p + 4], 'string_agg', ' ') AS s, count(*) AS m FROM g GROUP BY ALL), z AS MATERIALIZED (SELECT c, sum(m) AS z FROM b GROUP BY c),
o AS (SELECT x.c AS a, y.c AS b, sum(least(x.m, y.m)) AS common FROM b x JOIN b y ON x.s = y.s AND x.c < y.c GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o JOIN z za ON za.c = a JOIN z zb ON zb.c = b WHERE common >= 0.8 * (za.z + zb.z - common)),
both_ AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(c, root) AS (SELECT c, c FROM k UNION SELECT x.b, reach.root FROM reach JOIN both_ x ON x.a = reach.c WHERE x.b > reach.root),
comp AS (SELECT c, min(root) AS root FROM reach GROUP BY c), cls AS (SELECT root, min(first) AS class_id, sum(n)::BIGINT AS class_size FROM comp JOIN k USING (c) GROUP BY root)
SELECT d.doc_id, class_id, class_size FROM d JOIN k ON k.ws = d.ws JOIN comp USING (c) JOIN cls USING (root)
"""

#: Every pair of groups over every kept term, in wide integers.
DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS of_lang FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS v, sum(of_lang) AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
x AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (g.total + 2 * v))::BIGINT AS p,
      (1 + (1000000000::HUGEINT * (of_lang + 2)) // (v.total + 2 * v))::BIGINT AS q
      FROM g JOIN v USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
       FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM x WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""

#: All rows against all anchors; products of whole numbers are exact in doubles of this size.
NEGATIVES_SQL = r"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS MATERIALIZED (SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.r <> b.r),
pos AS (SELECT r, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id) AS k FROM s WHERE same QUALIFY k <= 5),
neg AS (SELECT p.r, p.k, p.anchor_id, positive_id, positive_score, s.other_id AS negative_id, s.score AS negative_score,
        (row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.other_id))::INT AS rank
        FROM pos p JOIN s ON s.r = p.r AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3
"""
ROUND_TRIP_SQL = "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents"

ORACLE: dict[str, str] = {
    "op3_suffix_dedup": OP3_SQL, "op5_repeated_windows": OP5_SQL, "op6_line_rules": OP6_SQL, "op9_near_duplicates": NEAR_SQL, "pii_base_spans": PII_SQL, "secret_base_spans": SECRET_SQL,
    "exact_leaks": LEAKS_SQL, "language_model_base": MODEL_SQL, "toxicity_folds": FOLDS_SQL, "mixing_targets": TARGETS_SQL, "mixing_sums": SUMS_SQL,
    "op11_source_divergence": DIVERGENCE_SQL, "op12_hard_negatives": NEGATIVES_SQL, "byte_bpe_round_trip": ROUND_TRIP_SQL,
}
