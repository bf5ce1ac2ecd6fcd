"""Decontamination: exact distances, recall of planted edits, clean documents left alone."""

import random

from weftline.llm import decontaminate as dc


def distance_to_any_stretch(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_best_match_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        item = bytes(rng.choices(b"abc", k=rng.randint(1, 20)))
        text = bytes(rng.choices(b"abc", k=rng.randint(0, 40)))
        d, end = dc.best_match(item, text)
        assert d == distance_to_any_stretch(item, text)
        assert d == min(dc.best_match(item, text[a:end])[0] for a in range(end + 1))


def test_planted_edits_and_clean_documents(spark):
    rng = random.Random(2)
    letters = "etaoinshrdlu"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(30)) for i in range(40)] + [(100, None), (101, ""), (102, "Tiny"), (103, prose(400))]
    docs, want = [], set()
    for i, t in items[:40]:
        for edits in (0, 1, 2):
            w = t.split()
            for _ in range(edits):
                w[rng.randrange(len(w))] = word()
            doc = len(docs)
            docs.append((doc, f"{prose(80)}\n{' '.join(w).upper()} {prose(50)}", i))
            if distance_to_any_stretch(t.encode(), docs[-1][1].lower().replace("\n", " ").encode()) <= dc.allowed(len(t), 0.1):
                want.add((doc, i))
    docs += [(900, None, 0), (901, "", 0), (902, prose(300), 0), (903, prose(5) + " tiny " + prose(5), 0), (904, items[-1][1], 0), (904, items[-1][1], 0)]
    docs.append((None, items[0][1], 0))
    got = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"))
    rows = got.collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert found - want == {(903, 102), (904, 103), (None, 0)}
    assert len(found & want) >= 0.97 * len(want)
    exact = {(r.doc_id, r.item_id): r for r in rows}
    text = docs[0][1].lower().replace("\n", " ")
    assert exact[0, 0].distance == 0 and text[exact[0, 0].start : exact[0, 0].end] == items[0][1]
    assert sum(r.doc_id == 904 for r in rows) == 2
    kept = dc.clean(spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == {d for d, _, _ in docs} - {d for d, _ in found}
    assert got.sparkSession.createDataFrame([], "doc_id long, text string").count() == 0


def test_blocks_of_items_and_empty_tables(spark):
    items = spark.createDataFrame([(i, f"question {i} about the {i * i} things that nobody asks {i}") for i in range(20)], "item_id long, text string")
    docs = items.selectExpr("item_id AS doc_id", "concat('before it ', text, ' after') AS text")
    small = dc.LeakParams(block_bytes=200)
    got = {(r.doc_id, r.item_id) for r in dc.leaks(docs, items, params=small).collect() if r.distance == 0}
    assert got == {(i, i) for i in range(20)}
    assert dc.leaks(docs.limit(0), items).count() == 0 and dc.leaks(docs, items.limit(0)).count() == 0


def test_long_items_match_as_a_whole(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(n))
    dot, long_ = prose(400)[:1024] + ".", prose(800)[:3000]
    half = long_[:1500] + prose(400)[:1500]
    edited = list(long_)
    for at in range(40, 2960, 40):
        edited[at] = "#"
    docs = [(0, "Some other text. " + prose(100)), (1, "x " + dot), (2, long_ + prose(20)), (3, half), (4, prose(50) + "".join(edited)), (5, long_[:1024])]
    items = spark.createDataFrame([(0, dot), (1, long_)], "item_id long, text string")
    rows = dc.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in rows) == [(1, 0, 0), (2, 1, 0), (4, 1, distance_to_any_stretch(long_, docs[4][1]))]
    assert next(r.start for r in rows if r.doc_id == 1) == 2


def test_items_of_all_lengths_alone_and_mixed(spark):
    """Exact copies of items around the piece and window sizes are found whatever other items the table holds."""
    rng = random.Random(8)
    prose = lambda n: "".join(" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(n)))[:n]
    items = [(i, prose(n).strip().ljust(n, "z")) for i, n in enumerate((5, 7, 8, 15, 16, 200, 1024, 1028, 1025, 2051))]
    docs = [(i, f"{prose(60)} {t} {prose(60)}", "x") for i, t in items] + [(90, items[7][1][-4:], "x"), (91, prose(900), "x"), (92, items[9][1][:1024], "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, _d string")
    want = {(r[0], i) for r in docs for i, t in items if t in r[1]}
    assert {(i, i) for i, _ in items} <= want
    every = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.leaks(d, every).collect()} == want
    for i, _ in items[::3]:
        alone = every.where(every.item_id == i)
        assert {(r.doc_id, r.item_id) for r in dc.leaks(d, alone).collect()} == {x for x in want if x[1] == i}
    kept = dc.clean(d, every)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in docs} - {x for x, _ in want}
    assert dc.clean(d.limit(0), every).count() == 0
