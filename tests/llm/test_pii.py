"""Personal data against the contract's patterns run as they are written."""

import hashlib
import random
import re
import time

import numpy as np

from weftline.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        [m.span() for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        [m.span() for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15],
    ]


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(1)
    alphabet = list("ab1249.@-+ ()%é_") + ["4111 1111 1111 1111", "+1 (269) 555-3296", "10.0.0.1", "x@y.com"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        assert pii.base_spans(text) == brute(text), text


def test_query(spark):
    glued = "tel +1 (269) 555-3296 4524132264652876 end"
    rows = [(i, f"é mail a{i}@mail.example.com or call +1 (26{i % 10}) 555-1234 ip 10.1.2.{i} card 4111111111111111 x", "s") for i in range(60)]
    rows += [(100, glued, "s"), (101, None, "s"), (102, "", "s"), (None, "none", "s"), (100, glued, "s"), (103, "9" * 50000 + "@" * 5000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.digest(pii.personal_data(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for d, t, _ in rows:
        want = [f"{pii.KINDS[k]}:{a}:{b}" for k, found in enumerate(brute(t or "")) for a, b in found]
        assert by[d].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, by[d].spans.split(",")))
    assert by[100].n_phone == 0 and "phone:4:21" in by[100].spans and "card:22:38" in by[100].spans
    assert pii.digest(pii.personal_data(docs.limit(0))).count() == 0


def test_expectation_maximisation_finds_the_bad_labeler():
    rng = np.random.default_rng(2)
    truth = rng.random(6000) < 0.6
    right = np.array([0.95, 0.9, 0.9, 0.85, 0.9, 0.5])
    vote = np.where(rng.random((6000, 6)) < right, truth[:, None], ~truth[:, None])
    code = np.zeros(6000, np.int64)
    for j in range(6):
        code = code * 3 + np.where(vote[:, j], pii.YES, pii.NO)
    codes, counts = np.unique(code * 4, return_counts=True)
    model = pii.expectation_maximisation(codes, counts.astype(float))
    kind, votes, _ = pii.decode(codes)
    p = dict(zip(codes.tolist(), model.posterior(kind, votes), strict=True))
    assert np.mean([(p[c * 4] > 0.5) == t for c, t in zip(code.tolist(), truth, strict=True)]) > 0.95
    assert model.rates[1, 0, pii.YES] > 0.85 and abs(model.rates[1, 5, pii.YES] - 0.5) < 0.1


def planted(n=1500, seed=3):
    """(rows, true spans that no base rule finds, decoys) with known places."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 8)))
    digits = lambda k: "".join(rng.choices("23456789", k=k))
    rows, true, decoys = [], set(), set()
    for i in range(n):
        text = f"{word()} {word()} "
        kind = rng.randrange(8)
        if kind == 0:
            lead, span, bag = "please contact ", f"{word()}[at]{word()}[dot]com", true
        elif kind == 1:
            lead, span, bag = f"{rng.choice(['call', 'phone', 'mobile'])} ", f"({digits(3)}) {digits(3)}-{digits(4)}", true
        elif kind == 2:
            lead, span, bag = "host ", ":".join("".join(rng.choices("0123456789abcdef", k=4)) for _ in range(8)), true
        elif kind == 3:
            lead, span, bag = "order ", f"0{digits(2)}-{digits(3)}-{digits(4)}", decoys
        elif kind == 4:
            lead, span, bag = "serial ", "9" + digits(14), decoys
        else:
            lead, span, bag = f"mail {word()}@{word()}.com or +1 (269) 555-3296 from ", f"10.0.{rng.randrange(256)}.{rng.randrange(256)}", set()
        text += lead
        bag.add((i, len(text), len(text) + len(span)))
        rows.append((i, text + span + f" {word()} {word()}."))
    return rows, true, decoys


def test_added_spans_hold_out(spark):
    """Precision and recall of the added spans against planted ones."""
    rows, true, decoys = planted()
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {(r.doc_id, s.start, s.end) for r in got for s in r.spans if not s.base}
    recall, precision = len(added & true) / len(true), len(added & true) / max(1, len(added))
    print(f"recall {recall:.3f} precision {precision:.3f} decoys taken {len(added & decoys)} of {len(decoys)}")
    assert recall > 0.9 and precision > 0.95


def test_contexts_move_the_classifier():
    """Of two candidates with equal votes the one in the context of the true ones is likelier."""
    yes, no = ("reach us via {} today", "ledger row {} entered")
    votes = pii.votes("x 555 123 4567 y", 3, 2, 14)
    cells, target = [], []
    for i in range(400):
        text = (yes if i % 2 else no).format(f"{200 + i} 123 4567")
        start = text.index("123") - 4
        cells.append(pii.inputs(text, 3, start, start + 12))
        target.append(0.99 if i % 2 else 0.01)
    model = pii.span_classifier(np.full(400, votes), pii._cells(cells), np.array(target))
    both = [pii.inputs(t.format("799 123 4567"), 3, t.index("{"), t.index("{") + 12) for t in (yes, no)]
    p = model.probability(np.full(2, votes), pii._cells(both))
    assert p[0] > 0.9 and p[1] < 0.1


def test_many_candidates_stay_linear(spark):
    text = " ".join(f"call (2{i % 90 + 10}) 555-{i % 9000 + 1000} or a{i}@mail.example.com" for i in range(30_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = pii.digest(pii.personal_data(docs)).first()
    assert got.n_email == 30_000 and time.time() - began < 40
