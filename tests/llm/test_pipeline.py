"""The pipeline on a small corpus whose right result is known, stage by stage."""

import random

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline as cp  # noqa: E402


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(3)
    letters = "etaoinshrdlu"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(2, 9)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(10)) for _ in range(n // 10))
    items = [(i, prose(30)) for i in range(5)]
    rows, labels, truth = [], [], {"toxic": set(), "copy": set(), "leak": set(), "secret": set()}
    for i in range(400):
        text, d = prose(60), 1000 + i
        if i % 8 == 0:
            text += f". {word()} zzidiot {word()} zzmoron {word()}."
            truth["toxic"].add(d)
        elif i % 20 == 1:
            text += " " + items[i % 5][1] + " " + word()
            truth["leak"].add(d)
        elif i % 20 == 2:
            text += " password=abcdef123456 end"
            truth["secret"].add(d)
        labels.append((d, 1, int(d in truth["toxic"])))
        rows.append((d, text, "en", f"s{i % 3}"))
    for k, (d, text, lang, source) in enumerate([r for r in rows if r[0] not in truth["toxic"] | truth["leak"]][:40]):
        rows.append((5000 + k, text + (" one more" if k % 2 else ""), lang, "s0"))
        truth["copy"].add(5000 + k)
    rows += [(9000, None, None, None), (9001, "", "en", "s1")]
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, truth


def test_stages(spark, corpus):
    path, rows, truth = corpus
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixture"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    ids = {r[0] for r in rows}
    for name, stage in cp.STAGES:
        docs = cp.staged(stage(spark, docs, path), f"test-{name}")
        left = {r.doc_id: r for r in docs.collect()}
        if name == "toxicity":
            ids -= truth["toxic"]
        elif name == "near_duplicates":
            ids -= truth["copy"] | {9001}  # two empty texts are copies; the smaller id stays
        elif name == "decontamination":
            ids -= truth["leak"]
        if name != "mixture":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert set(left) == ids, name
        if name == "secrets":
            assert {d for d, r in left.items() if "[SECRET]" in (r.text or "")} == truth["secret"]
            assert all(r.text is None or r.n_chars == len(r.text) for r in left.values())
            size = {}
            for r in left.values():
                size[r.source] = size.get(r.source, 0) + len((r.text or "").split())
    total, weight = sum(size.values()), {"s0": 1, "s1": 2, "s2": 3, None: 1}
    taken = {}
    for r in left.values():
        assert r.taken <= 3 * r.size and r.size == len(r.text.split())
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert sum(taken.values()) == pytest.approx(total, abs=3) and set(left) <= ids
    for s in ("s0", "s1", "s2"):
        assert taken[s] == pytest.approx(total * weight[s] / 6, abs=total * 0.02)


def test_run_is_the_stages_and_repeats(spark, corpus):
    path, _, _ = corpus
    once = sorted((r.doc_id, r.taken) for r in cp.run(spark, path).collect())
    assert once and once == sorted((r.doc_id, r.taken) for r in cp.run(spark, path).collect())


def test_empty_tables_and_more_columns(spark, tmp_path):
    """Every stage gives an empty table for one, and keeps columns named like those it uses inside."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, _d int, _k int, _n int, hits string, _key string, _turn int"
    docs = spark.createDataFrame([(i, f"some text of {i} {'abcdefgh'[i]} words", "en", "s", 20, 1, 2, 3, "h", "k", 4) for i in range(8)], kinds)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns and {r.hits for r in out.collect()} == {"h"}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
