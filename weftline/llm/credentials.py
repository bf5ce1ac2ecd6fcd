"""Secret scan with multipart credential linking (DataFrame functions only).

Strong secrets (assignments, access ids, long hex) stand on their own.  Weak parts - short or encoded
values that alone mean nothing - are reported only when complementary parts co-occur in a scope: an
interval join links each weak secret to access identifiers and endpoints of the same document.  Two parts
share a scope when at most ``scope_chars`` lie between them, or at most ``block_chars`` inside one section of a
configuration (from its [heading], a line of at most 80 characters in brackets,
to the next one or to a blank line; a longer bracketed line is text).  A secret is reported with an
identifier or an endpoint in scope; identifiers and endpoints are reported when a secret, strong or weak, links
to them.

The interval join is a sweep: all parts of a document are ordered by start, and running maxima and
minima (each over a frame that grows from its window's beginning) give each part its nearest partner on either
side, so a document with many parts costs n log n rows and never all pairs.  Only parts are shuffled,
never texts.  Positions come from the pieces between matches (``split`` and ``regexp_extract_all`` walk
the same matches), in code points, summed in chunks (``running``), so a text with many matches stays near
linear.

Cases: a null text is empty and has no spans; documents with equal ids and equal texts each get
their row (their parts coincide and are linked once); a null id is an id of its own; an empty table
gives an empty result; columns other than id and text are ignored, and ``redacted`` keeps them whatever their
names.  No pattern repeats a group that could be entered again, so a text of any length is matched in bounded stack.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm._common import staged, unused

ASSIGN = r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
#: A cheap test whether a kind can occur at all, so most texts skip the split.
HINT = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{32}"}
SPAN = "struct<start:int,rank:int,end:int,kind:string>"
RANK = {kind: i for i, kind in enumerate(BASE)}


@dataclass(frozen=True)
class Parts:
    """Weak parts by role; group 1 of each pattern is the reported value."""

    scope_chars: int = 400
    block_chars: int = 2000
    section: str = r"(?m)^[\x20\t]*\[[^\[\]\n]{1,80}\][\x20\t\r]*$"
    blank: str = r"\n(?=[\x20\t\r]*\n)"
    secret: dict[str, str] = field(default_factory=lambda: {
        "weak_secret": r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])([A-Za-z0-9+/]{40})(?![A-Za-z0-9+/=])",
        "weak_key": r"(?<![A-Za-z_])(?i:secret_?access_?key|client_?secret|private_?key|pwd|pass|auth|credential)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{4,})",
    })
    identifier: dict[str, str] = field(default_factory=lambda: {
        "weak_id": r"(?<![A-Za-z_])(?i:access_?key_?id|client_?id|user(?:name)?|login|account)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.@-]{3,})",
    })
    endpoint: dict[str, str] = field(default_factory=lambda: {
        "weak_url": r"((?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|s3)://[^\x20\x09-\x0D\"'<>]{4,})",
        "weak_host": r"(?<![A-Za-z_])(?i:host(?:name)?|endpoint|server|url)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)",
    })


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside it the value is a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join: Callable[[Column, Column], Column], chunk_bits: int = 6) -> Column:
    """For each element the ``join`` (a sum or a maximum, from 0) of all elements before it.

    Chunks are joined first, then the chunks before each, then the rest inside it: with n elements
    n * 64 + (n / 64)**2 steps at most.
    """
    size = F.lit(1 << chunk_bits)
    whole = lambda x, at, n: F.aggregate(F.slice(x, at, n), F.lit(0), join)

    def chunks(x: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(x), chunk_bits)), lambda c: whole(x, c * size + 1, size))
        return let(F.struct(x.alias("x"), each.alias("c")), before)

    def before(s: Column) -> Column:
        ahead = F.transform(s["c"], lambda _, i: whole(s["c"], F.lit(1), i))
        return let(F.struct(s["x"].alias("x"), ahead.alias("b")), inside)

    def inside(s: Column) -> Column:
        at = lambda i: F.shiftright(i, chunk_bits)
        return F.transform(s["x"], lambda _, i: join(F.get(s["b"], at(i)), whole(s["x"], at(i) * size + 1, i - at(i) * size)))

    return let(values, chunks)


def spans(text: Column, pattern: str, kind: str, hint: str | None = None, group: int = 0, least: tuple[int, int] = (0, 0)) -> Column:
    """array<SPAN> of the pattern's matches, leftmost and non-overlapping.

    ``least`` is (group, characters): matches whose group is shorter are dropped, without a retry.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def sizes(s: Column) -> Column:
        gap = F.transform(F.slice(s["pieces"], 1, F.size(s["hit"])), F.length)
        return let(F.struct(s["hit"].alias("hit"), gap.alias("gap")), placed)

    def placed(s: Column) -> Column:
        at = running(F.zip_with(s["gap"], s["hit"], lambda g, h: g + F.length(h)), lambda a, b: a + b)
        return let(F.struct(s["hit"].alias("hit"), s["gap"].alias("gap"), at.alias("at")), made)

    def made(s: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            begin = F.get(s["at"], i) + F.get(s["gap"], i)
            value = F.regexp_extract(hit, pattern, group) if group else hit
            inner = begin + (F.length(hit) - F.length(value) if group else F.lit(0))
            span = F.struct(inner.alias("start"), F.lit(RANK.get(kind, len(RANK))).alias("rank"), (inner + F.length(value)).alias("end"), F.lit(kind).alias("kind"))
            return F.when(F.length(F.regexp_extract(hit, pattern, least[0])) >= least[1], span)

        return F.array_compact(F.transform(s["hit"], one)).cast(f"array<{SPAN}>")

    all_ = let(F.struct(pieces.alias("pieces"), found.alias("hit")), sizes)
    return F.when(text.rlike(hint or pattern), all_).otherwise(F.array().cast(f"array<{SPAN}>"))


def part_spans(docs: DataFrame, text: str, doc: str, parts: Parts) -> DataFrame:
    """One row per input row: its key, the spans found in its text by role, and the borders of its blocks.

    Borders are looked for only where a weak part could be linked.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(F.col(doc).alias("doc_id"), body.alias("_t"))
    none = F.array().cast(f"array<{SPAN}>")

    def role(patterns: dict[str, str]) -> Column:
        return F.concat(*[spans(F.col("_t"), p, kind, group=1) for kind, p in patterns.items()]) if patterns else none

    d = d.select(
        "doc_id", F.xxhash64("_t").alias("key"), F.length("_t").alias("n_chars"), "_t",
        spans(F.col("_t"), BASE["assign"], "assign", HINT["assign"], least=(1, 8)).alias("assign"),
        spans(F.col("_t"), BASE["access"], "access", HINT["access"]).alias("access"),
        spans(F.col("_t"), BASE["hex"], "hex", HINT["hex"]).alias("hex"),
        role(parts.secret).alias("secret"), role(parts.identifier).alias("identifier"), role(parts.endpoint).alias("endpoint"),
    )
    # Sections alone make blocks: without one there is nothing to look for.
    border = F.concat(spans(F.col("_t"), parts.section, "section"), spans(F.col("_t"), parts.blank, "blank"))
    return d.withColumn("border", F.when(linkable() & F.col("_t").rlike(parts.section), border).otherwise(none)).drop("_t")


def linkable() -> Column:
    """Whether a document has a weak part, and parts of both sides."""
    both = (F.size("assign") + F.size("hex") + F.size("secret") > 0) & (F.size("access") + F.size("identifier") + F.size("endpoint") > 0)
    return both & (F.size("secret") + F.size("identifier") + F.size("endpoint") > 0)


def linked(found: DataFrame, parts: Parts) -> DataFrame:
    """(doc_id, key, n_chars, added): the weak spans of each document that have a complement in scope.

    A weak part inside a strong one adds nothing and links to nothing.
    """
    tag = lambda column, name, weak: F.transform(column, lambda s: F.struct(s.alias("span"), F.lit(name).alias("role"), F.lit(weak).alias("weak")))
    pieces = F.concat(
        tag(F.concat("assign", "hex"), "secret", False), tag("secret", "secret", True), tag("border", "border", False),
        tag("access", "other", False), tag(F.concat("identifier", "endpoint"), "other", True),
    )
    keys = ["doc_id", "key", "n_chars"]
    rows = found.where(linkable()).select(*keys, pieces.alias("p")).distinct()
    rows = rows.select(*keys, F.explode("p").alias("p"))
    rows = rows.select(*keys, "p.span", "p.role", "p.weak").withColumn("start", F.col("span.start")).withColumn("end", F.col("span.end"))
    order = [F.col(c) for c in ("start", "end", "span.rank", "span.kind")]  # a total order: a kind's spans do not overlap

    def sides(*by: str) -> tuple[Column, Column]:
        """What comes before a part and what comes after it, both as frames from a window's beginning."""
        part = W.partitionBy(*by)
        return tuple(part.orderBy(*o).rowsBetween(W.unboundedPreceding, -1) for o in (order, [c.desc() for c in order]))

    before, after = sides(*keys)
    strong = ~F.col("weak") & (F.col("role") != "border")
    rows = rows.withColumn("reach", F.max(F.when(strong, F.col("end"))).over(before)).withColumn("next", F.min(F.when(strong, F.col("start"))).over(after))
    border = F.when(F.col("role") == "border", F.col("span.kind"))
    rows = rows.withColumn("block", F.count(border).over(before)).withColumn("opened", F.last(border, ignorenulls=True).over(before) == "section")
    inside = F.col("weak") & (F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False)))
    rows = rows.where(~inside & (F.col("role") != "border")).drop("reach", "next")
    near = F.lit(False)
    for (before, after), limit, held in ((sides(*keys), parts.scope_chars, F.lit(True)), (sides(*keys, "block"), parts.block_chars, F.col("opened"))):
        for mine in ("secret", "other"):
            other = lambda c, mine=mine: F.when(F.col("role") != mine, F.col(c))
            close = (F.col("start") - F.max(other("end")).over(before) <= limit) | (F.min(other("start")).over(after) - F.col("end") <= limit)
            near = near | ((F.col("role") == mine) & F.coalesce(close & held, F.lit(False)))
    return rows.withColumn("near", near).where("near AND weak").groupBy(*keys).agg(F.collect_list("span").alias("added"))


def secret_spans(docs: DataFrame, text: str = "text", doc: str = "doc_id", parts: Parts = Parts()) -> DataFrame:
    """One row per input row: doc_id, key and n_chars of its text, assign, access, hex, added (arrays of spans)."""
    found = staged(part_spans(docs, text, doc, parts), "secret-parts")
    extra = linked(found, parts).select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), F.col("n_chars").alias("_n"), "added")
    same = found["doc_id"].eqNullSafe(extra["_d"]) & (found["key"] == extra["_k"]) & (found["n_chars"] == extra["_n"])
    out = found.join(extra, same, "left").drop("_d", "_k", "_n", "secret", "identifier", "endpoint", "border")
    return out.withColumn("added", F.coalesce("added", F.array().cast(f"array<{SPAN}>")))


def span_list(spans_: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return F.array_join(F.transform(F.sort_array(spans_), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.concat(base, "added")).alias("spans"), F.size("added").cast("long").alias("n_linked"),
    )


def masked(text: Column, hits: Column, mark: str, size: int = 1000) -> Column:
    """``text`` with each run of overlapping spans (sorted by start) as one mark.

    The text is cut into chunks once and every kept piece is taken from the chunks it touches, so the work is
    linear in the text however many spans it has.
    """
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))

    def piece(s: Column, a: Column, e: Column) -> Column:
        first = F.floor(a / size).cast("int")
        held = F.array_join(F.slice(s["chunks"], first + 1, F.floor(e / size).cast("int") - first + 1), "")
        return F.substring(held, a - first * size + 1, e - a)

    def gathered(s: Column) -> Column:
        at = running(F.transform(s["hits"], lambda h: h["end"]), lambda a, b: F.greatest(a, b))
        return let(F.struct(s["hits"].alias("hits"), s["chunks"].alias("chunks"), at.alias("at")), joined)

    def joined(s: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            from_ = F.get(s["at"], i)
            return F.when(h["start"] >= from_, F.concat(piece(s, from_, h["start"]), F.lit(mark))).otherwise("")

        last = F.array_max(F.transform(s["hits"], lambda h: h["end"]))
        rest = piece(s, last, F.length(text))
        return F.concat(F.array_join(F.transform(s["hits"], one), ""), rest)

    return let(F.struct(hits.alias("hits"), chunks.alias("chunks")), gathered)


def redacted(docs: DataFrame, text: str = "text", doc: str = "doc_id", parts: Parts = Parts(), mark: str = "[SECRET]") -> DataFrame:
    """The documents with every reported span of their text replaced by ``mark``; all columns stay.

    Overlapping spans become one mark.  Only documents with spans are joined back, by id and text
    hash, so the texts are shuffled once at most; where few documents hold secrets the size check of
    Spark's join planning broadcasts them instead.
    """
    id_, key, size, hits_ = unused(docs, "_d", "_k", "_n", "_hits")
    hits = secret_spans(docs, text, doc, parts).select("doc_id", "key", "n_chars", F.sort_array(F.concat("assign", "access", "hex", "added")).alias("hits"))
    hits = hits.where(F.size("hits") > 0).distinct().select(F.col("doc_id").alias(id_), F.col("key").alias(key), F.col("n_chars").alias(size), F.col("hits").alias(hits_))
    hits = staged(hits, "secret-hits")
    body = F.coalesce(F.col(text), F.lit(""))
    same = F.col(doc).eqNullSafe(F.col(id_)) & (F.xxhash64(body) == F.col(key)) & (F.length(body) == F.col(size))
    out = docs.join(hits, same, "left")
    clean = F.when(F.col(hits_).isNull(), F.col(text)).otherwise(masked(F.col(text), F.col(hits_), mark))
    return out.select(*[clean.alias(c) if c == text else F.col(c) for c in docs.columns])
