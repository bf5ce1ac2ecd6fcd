"""Rule packs on own rows, and how rules are chosen."""

import pytest

from weftline.plans.address_rules import address_scan
from weftline.plans.align_rules import align_check
from weftline.plans.grammar_rules import grammar_scan
from weftline.plans.record_rules import record_scan
from tests.test_golden import GOLDEN


def view(spark, *pairs):
    return spark.createDataFrame([("d", i, e, r) for i, (e, r) in enumerate(pairs)], "doc_id string, block_no int, en string, ed_ru string")


def kinds(df, n):
    found = {}
    for r in df.collect():
        found.setdefault(r.block_no, set()).add(r.kind)
    return [found.get(i, set()) for i in range(n)]


def test_grammar(spark):
    rows = view(spark, *[(e, r) for _, e, r, _ in GOLDEN])
    assert kinds(grammar_scan(rows), len(GOLDEN)) == [set(k.split()) for *_, k in GOLDEN]
    assert kinds(grammar_scan(rows, only=["numbers"]), len(GOLDEN))[7] == {"numbers"}
    # Without the voice check a possessor is still reported, by its block.
    got = grammar_scan(view(spark, ("Anna's purse was stolen.", "Анна лишилась кошелька.")), only=["possessive"]).first()
    assert got.detail == "Anna's purse was" and got.target == "Анна лишилась кошелька."
    with pytest.raises(ValueError, match="unknown checks: nope"):
        grammar_scan(rows, only=["nope"])


def test_align(spark):
    pairs = [
        ("", None), ('"Go," she said.', "Иди, сказала она."), ("Where?", "Где."), ("He did not go.", "Он ушёл."), ("We love you.", "Вас любят."),
        ("It cost 3 coins.", "Это стоило дорого."), ("It cost 3 coins.", "Это стоило три монеты."), ("I don't know.", "Я знаю."), ("Fine.", "Хорошо."),
    ]
    assert kinds(align_check(view(spark, *pairs)), len(pairs)) == [{"no-translation"}, {"speech"}, {"marks"}, {"negation"}, {"pronouns"}, {"numbers"}, set(), set(), set()]
    names = spark.createDataFrame([(["aurelia"], "ауре", "Аурелия"), (["bruno"], "брун", "Бруно")], "en_forms array<string>, ru_base string, ru string")
    got = align_check(view(spark, ("Aurelia's hat.", "Шляпа Бруно."), ("Bruno and Aurelia.", "Бруно с Аурелией.")), names, only=["names"]).collect()
    assert sorted((r.block_no, r.weight, r.detail) for r in got) == [(0, "info", "Бруно"), (0, "weak", "Аурелия")]


def test_address(spark):
    rows = view(spark, ("Miss Rowan came.", "Ветер. Мисс Роуэн пришла."), ("x", "мистер вчера ушёл"), ("x", "Мадам Роуэн пришла."), ("x", "—"))
    got = address_scan(rows).collect()
    assert sorted((r.block_no, r.prefix, r.name) for r in got) == [(0, "мисс", "Роуэн"), (1, "мистер", "вчера")]
    assert next(r for r in got if r.block_no == 0).target == "Мисс Роуэн пришла."


def test_records(spark):
    rows = spark.createDataFrame([("d", 1, "— Иду. — Стой там."), ("d", 2, "— Иду. — Тихо сказала она."), ("d", 3, "# Глава. — Слово"), ("d", 4, "нет границы")], "doc_id string, para_no int, text string")
    assert [(r.para_no, r.line_no, r.fragment) for r in record_scan(rows).collect()] == [(1, 1, "— Иду. — Стой там.")]
