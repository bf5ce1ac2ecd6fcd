"""Personal data by weak supervision.

Base rules find e-mail addresses, IPv4 addresses, payment cards and phone numbers.  On top of them a
wider candidate generator proposes spans the base rules miss (obfuscated addresses, numbers glued to
other numbers, IPv6, domestic phone formats), and six labelers vote on every candidate, base spans
included: shape, checksum, gazetteer, supporting context, opposing context, boundary.  Votes are
aggregated over the whole corpus by vote pattern; expectation-maximisation estimates how often each
labeler votes each way on true and false spans.  Its posteriors are the targets of a logistic span
classifier whose inputs are the votes and, hashed, the span's own shape and the words and characters around
it, so it learns contexts that no labeler lists.  Candidates the classifier accepts are added unless they
overlap a span already found; base spans stay.

Only vote patterns (at most 4 kinds * 3**6 votes * 4 length classes = 11,664 counts, whatever the corpus) and
a sample of at most ``train_spans`` candidates, the first by a hash of document and place, reach the
driver.  The scan is narrow, its small result is staged once, nothing else is shuffled.

Cases: null and empty texts have no spans; every input row gives one row, repeated or not, with its id
as it is (null too); an empty table gives an empty result; extra columns are ignored; of overlapping candidates
of equal probability the first kind as listed, then the earlier stays.  All scans are
linear in the text's length but for sorting its candidates: runs are matched possessively, addresses are grown from
their @, overlaps are looked up in sorted lists.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._common import staged

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("shape", "checksum", "gazetteer", "context", "counter", "boundary")
ABSTAIN, YES, NO = 0, 1, 2
FEATURES, CELLS = 16, 2048  # hashed inputs of a candidate, and the cells they are hashed to

TRIGGER = r"[0-9@]|[\[({]at[\])}]"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

MORE = {
    "email": re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\s?(?:@|\[at\]|\(at\)|\{at\})\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\[dot\]|\(dot\)|\{dot\})\s?[A-Za-z0-9-]{2,63}){1,4}"),
    "ip": re.compile(r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9]{1,3}\.){3}[0-9]{1,3})(?![\w:]|\.[0-9])"),
    "card": re.compile(r"(?<![\w.-])(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}|[0-9]{13,19})(?![\w-]|\.[0-9])"),
    "phone": re.compile(r"(?<![\w.-])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-]|\.[0-9])"),
}

#: Generic top-level domains (any two letters name a country), issuer prefixes, address
#: blocks that no host has, and the zones and two-digit country codes of the international numbering plan (the
#: other codes have three digits).
TLD = frozenset("com org net edu gov mil int info biz name pro coop museum aero jobs mobi travel post cat tel asia dev app xyz online site shop club cloud store tech blog page email".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|64[4-9]|65|35|30|36|38|62")
UNASSIGNED = re.compile(r"(?:0|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|255\.255\.")
COUNTRY = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|50[0-9]|59[0-9]|6[789][0-9]|8[058][0-9]|9[679][0-9]")
CONTEXT = {
    "email": re.compile(r"mail|contact|write|reach|kontakt|correo|courriel|address|adresse", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|login|client|connect|ping", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|payment|karte|carte|tarjeta|cvv", re.I),
    "phone": re.compile(r"phone|call|tel\b|tel\.|mobile|cell|fax|contact|anruf|appel|llam", re.I),
}
COUNTER = re.compile(r"version|\bv[0-9.]*$|isbn|issn|doi|page|fig(?:ure|\.)|section|chapter|order|invoice|serial|sku|build|release|hash|sha|md5|example", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        hit = DOMAIN.match(text, at) if start < at else None
        last = hit.end() if hit else at + 1
        if hit:
            found.append((start, last))
        at = text.find("@", last)
    return found


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """By kind, the spans of the base rules; a match that fails its check is dropped without a retry."""
    return [
        emails(text),
        [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))],
        [m.span() for m in CARD.finditer(text) if 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d)],
        [m.span() for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15],
    ]


def votes(text: str, kind: int, start: int, end: int) -> int:
    """The labelers' votes and the length class of a span as one code."""
    name, s = KINDS[kind], text[start:end]
    d = only_digits(s)
    before, after = text[max(0, start - 48) : start], text[end : end + 24]
    if name == "email":
        clean = re.sub(r"\s|[\[({](?:at|dot)[\])}]", lambda m: {"a": "@", "d": "."}.get(m[0][1:2], ""), s)
        tail = clean.rpartition(".")[2].lower()
        shape = YES if DOMAIN.search(s) else NO if " " in s and "@" in s and "[" not in s else ABSTAIN
        check = YES if clean.count("@") == 1 and ".." not in clean and not clean.startswith(".") else NO
        lists = YES if tail in TLD or re.fullmatch("[a-z]{2}", tail) else NO
    elif name == "ip":
        four = s.split(".")
        shape = YES if len(four) == 4 else YES if s.count(":") == 7 else NO
        check = YES if ":" in s or all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in four) else NO
        lists = NO if UNASSIGNED.match(s) else YES if ":" not in s else ABSTAIN
    elif name == "card":
        shape = YES if len(d) == 16 or re.fullmatch(r"3[47].*", d) and len(d) == 15 else NO if len(d) < 13 else ABSTAIN
        check = YES if luhn(d) else NO
        lists = YES if ISSUERS.match(d) else NO
    else:
        shape = YES if s[0] == "+" or "(" in s else ABSTAIN
        check = YES if 10 <= len(d) <= 13 else ABSTAIN if 7 <= len(d) <= 15 else NO
        national = d[-10:] if len(d) >= 10 else d
        lists = YES if (COUNTRY.match(d) if s[0] == "+" else national[0] not in "01") else NO
    near = CONTEXT[name].search(before)
    against = COUNTER.search(before[-16:])
    edge = text[max(0, start - 1) : start].isalnum() or after[:1].isalnum()
    marks = (shape, check, lists, YES if near else ABSTAIN, NO if against else ABSTAIN, NO if edge else YES)
    code = kind
    for v in marks:
        code = code * 3 + v
    return code * 4 + min(3, (end - start) // 10)


WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")


def shape(s: str) -> str:
    """Letters as a, digits as 9, other characters as they are, runs of one kind as one."""
    kinds = re.sub(r"\s", " ", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", s)))
    return re.sub(r"(.)\1+", r"\1", kinds)


def inputs(text: str, kind: int, start: int, end: int) -> bytes:
    """FEATURES hashed cells of a span: its shape and size, and what stands around it."""
    s = text[start:end]
    d = only_digits(s)
    before, after = WORD.findall(text[max(0, start - 48) : start].lower())[-4:], WORD.findall(text[end : end + 24].lower())[:2]
    found = [
        f"shape {shape(s)[:24]}", f"head {shape(s[:4])}", f"tail {shape(s[-4:])}", f"size {min(40, len(s))}", f"digits {min(20, len(d))}", f"first {d[:2]}",
        f"marks {len(set(s) - set(d))}", f"left {text[max(0, start - 1) : start]!r}", f"right {text[end : end + 1]!r}",
        *(f"before {w}" for w in dict.fromkeys(before)), *(f"after {w}" for w in after), f"next to {(before or [''])[-1]}",
    ]
    cells = [zlib.crc32(f"{KINDS[kind]} {x}".encode()) % CELLS for x in found]
    return np.array(cells + [CELLS] * (FEATURES - len(cells)), np.uint16).tobytes()


def candidates(text: str, base: list[list[tuple[int, int]]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, code) of spans that overlap no base span."""
    taken = sorted(s for kind in base for s in kind)
    starts, ends, reach = [a for a, _ in taken], [], 0
    for _, e in taken:
        reach = max(reach, e)
        ends.append(reach)
    found = []
    for kind, name in enumerate(KINDS):
        for m in MORE[name].finditer(text):
            i = bisect_left(starts, m.end())
            if i == 0 or ends[i - 1] <= m.start():
                found.append((kind, *m.span(), votes(text, kind, *m.span())))
    return found


@dataclass
class LabelModel:
    """Vote rates of each labeler on true and false spans, and the share of true spans by kind."""

    rates: np.ndarray  # [truth, labeler, vote]
    prior: np.ndarray  # [kind]

    def posterior(self, kind: np.ndarray, vote: np.ndarray) -> np.ndarray:
        log = np.log(self.rates)
        each = np.stack([sum(log[y, j, vote[:, j]] for j in range(vote.shape[1])) for y in (0, 1)], 1)
        gap = each[:, 1] - each[:, 0] + np.log(self.prior[kind]) - np.log1p(-self.prior[kind])
        return 1 / (1 + np.exp(-np.clip(gap, -50, 50)))


def decode(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    length, rest = codes % 4, codes // 4
    vote = np.empty((len(codes), len(LABELERS)), np.int64)
    for j in range(len(LABELERS) - 1, -1, -1):
        vote[:, j], rest = rest % 3, rest // 3
    return rest, vote, length


def expectation_maximisation(codes: np.ndarray, counts: np.ndarray, rounds: int = 60, weight: float = 20.0) -> LabelModel:
    """Reliabilities by EM over vote patterns; a Dirichlet prior of ``weight`` votes keeps the classes' meaning."""
    kind, vote, _ = decode(codes)
    anchor = np.array([[0.4, 0.15, 0.45], [0.3, 0.65, 0.05]])[:, None, :].repeat(len(LABELERS), 1)
    model = LabelModel(anchor.copy(), np.full(len(KINDS), 0.5))
    for _ in range(rounds):
        p = model.posterior(kind, vote)
        new = anchor * weight
        for y, share in enumerate((counts * (1 - p), counts * p)):
            for j in range(len(LABELERS)):
                new[y, j] += np.bincount(vote[:, j], share, 3)
        true, all_ = np.bincount(kind, counts * p, len(KINDS)), np.bincount(kind, counts, len(KINDS))
        model = LabelModel(new / new.sum(2, keepdims=True), (true + 5) / (all_ + 10))
    return model


def design(codes: np.ndarray) -> np.ndarray:
    """The dense inputs: kind, votes and length class."""
    kind, vote, length = decode(codes)
    eye = np.eye(3)
    return np.concatenate([np.eye(len(KINDS))[kind], *(eye[vote[:, j]][:, 1:] for j in range(len(LABELERS))), np.eye(4)[length][:, 1:]], 1)


@dataclass
class SpanClassifier:
    """Logistic weights of the votes and of the hashed cells (the last cell is padding)."""

    votes: np.ndarray
    cells: np.ndarray

    def probability(self, codes: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(codes) @ self.votes + self.cells[cells].sum(1), -30, 30)))


def span_classifier(codes: np.ndarray, cells: np.ndarray, target: np.ndarray, steps: int = 400, l2: float = 1e-4) -> SpanClassifier:
    """Fitted to the EM posteriors by gradient steps with momentum and scaling."""
    x, n = design(codes), len(codes)
    model = SpanClassifier(np.zeros(x.shape[1]), np.zeros(CELLS + 1))
    w = np.zeros(x.shape[1] + CELLS + 1)
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, steps + 1):
        model.votes, model.cells = w[: x.shape[1]], w[x.shape[1] :]
        gap = (model.probability(codes, cells) - target) / n
        grad = np.concatenate([x.T @ gap, np.bincount(cells.ravel(), np.repeat(gap, FEATURES), CELLS + 1)]) + l2 * w
        grad[-1] = 0
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return SpanClassifier(w[: x.shape[1]], w[x.shape[1] :])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one, raw = pa.list_(pa.int64()), pa.list_(pa.binary())
    for b in batches:
        text = pc.fill_null(b.column("text"), "")
        hit = pc.match_substring_regex(text, TRIGGER).to_numpy(zero_copy_only=False)
        base, codes, extra, cells = ([[] for _ in range(len(text))] for _ in range(4))
        for i in np.flatnonzero(hit).tolist():
            s = text[i].as_py()
            spans = base_spans(s)
            base[i] = [x for k, found in enumerate(spans) for a, e in found for x in (k, a, e)]
            codes[i] = [votes(s, k, a, e) for k, found in enumerate(spans) for a, e in found]
            more = candidates(s, spans)
            extra[i] = [x for c in more for x in c[:3]]
            codes[i] += [c[3] for c in more]
            cells[i] = [inputs(s, k, a, e) for k, found in enumerate(spans) for a, e in found] + [inputs(s, *c[:3]) for c in more]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(base, one), pa.array(extra, one), pa.array(codes, one), pa.array(cells, raw)], names=["doc_id", "base", "extra", "codes", "cells"]
        )


def train(found: DataFrame, train_spans: int) -> tuple[LabelModel, SpanClassifier] | None:
    """The label model of all candidates of a scanned corpus, and the span classifier of a sample of them."""
    rows = found.select(F.explode("codes").alias("code")).groupBy("code").count().collect()
    if not rows:
        return None
    codes, counts = np.array([r["code"] for r in rows]), np.array([r["count"] for r in rows], float)
    order = np.argsort(codes)
    model = expectation_maximisation(codes[order], counts[order])
    each = found.select("doc_id", F.posexplode(F.arrays_zip("codes", "cells")).alias("at", "c")).select(F.xxhash64(F.lit(1), "doc_id", "at", "c.cells").alias("ord"), "c.*")
    # A share of about twice the sample first: each task then hands over few rows, however many there are.
    share = int(min(1.0, 2 * train_spans / counts.sum()) * (1 << 30)) + 1
    drawn = each.where(F.pmod("ord", F.lit(1 << 30)) < share).orderBy("ord", "codes", "cells").limit(train_spans).collect()
    drawn = sorted((r["ord"], r["codes"], bytes(r["cells"])) for r in drawn)
    codes = np.array([r[1] for r in drawn])
    kind, vote, _ = decode(codes)
    return model, span_classifier(codes, _cells([r[2] for r in drawn]), model.posterior(kind, vote))


def _cells(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.uint16).reshape(-1, FEATURES)


def accepted(spans: np.ndarray, p: np.ndarray, threshold: float) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the candidates at or over the threshold, the likelier first, none overlapping another."""
    taken: list[tuple[int, int]] = []
    out = []
    for i in sorted(np.flatnonzero(p >= threshold).tolist(), key=lambda i: (-p[i], *spans[i].tolist())):
        k, a, e = spans[i].tolist()
        at = bisect_left(taken, (a, e))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or e <= taken[at][0]):
            insort(taken, (a, e))
            out.append((k, a, e))
    return out


def personal_data(docs: DataFrame, text: str = "text", doc: str = "doc_id", threshold: float = 0.9, train_spans: int = 16_384) -> DataFrame:
    """doc_id, spans as array<struct<kind, start, end, base>> by kind as listed, then start."""
    id_type = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = staged(rows.mapInArrow(_scan, f"doc_id {id_type}, base array<bigint>, extra array<bigint>, codes array<bigint>, cells array<binary>"), "pii-scan")
    trained = train(found, train_spans)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for b in batches:
            out = []
            columns = (b.column(c).to_pylist() for c in ("base", "extra", "codes", "cells"))
            for base, extra, codes, cells in zip(*columns, strict=True):
                spans = [(*base[i : i + 3], True) for i in range(0, len(base), 3)]
                if extra and trained:
                    own = len(base) // 3
                    p = trained[1].probability(np.array(codes[own:]), _cells(cells[own:]))
                    spans += [(*s, False) for s in accepted(np.array(extra).reshape(-1, 3), p, threshold)]
                out.append([{"kind": KINDS[k], "start": a, "end": e, "base": own} for k, a, e, own in sorted(spans)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, kind_t)], names=["doc_id", "spans"])

    return found.mapInArrow(decide, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))
    count = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *count, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), added)
