"""Line rules against plain Python, with limits small enough to act."""

import random
import re
from collections import Counter

from weftline.llm.line_rules import LineRules, apply_line_rules, frequent_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def norm(line):
    return re.sub("[0-9]", "0", re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ").lower())


def brute(rows, rules):
    docs = Counter(s for _, _, s in rows)
    held = Counter()
    for _, t, s in rows:
        held.update({(s, norm(x)) for x in (t or "").split("\n") if WORD.search(x)})
    out = []
    for d, t, s in rows:
        t = t or ""
        words, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        twice = {w for w, c in Counter(windows).items() if c > 1}
        repeat = len({i + j for i, w in enumerate(windows) if w in twice for j in range(5)})
        gone = [x for x in lines if held[s, norm(x)] > rules.min_docs and held[s, norm(x)] > rules.max_ratio * docs[s]]
        left = len(words) - sum(len(WORD.findall(x)) for x in gone)
        failed = len(words) < 10 or 100 * repeat > 20 * len(words)
        kept = not failed and left >= rules.min_left_words and left >= rules.min_left_ratio * len(words)
        out.append((str(d), len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), repeat, failed, kept, len(gone), left))
    return sorted(out)


def test_equals_plain_rules(spark):
    rng = random.Random(1)
    vocab = ["a", "b", "Bé", "c#d", "9", "x<y"]
    boiler = ["License 2024 all rights are reserved here", "share  this PAGE now"]
    rows = []
    for i in range(150):
        lines = [" ".join(rng.choices(vocab, k=rng.randint(0, 14))) for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.6:
            lines.insert(rng.randint(0, len(lines)), rng.choice(boiler).replace("2024", str(rng.randint(1000, 9999))))
        rows.append((i, "\n".join(lines), rng.choice(["h1", "h1", "h2", None])))
    rows += [(None, None, "h1"), (5, "", None), (5, rows[5][1], "h1"), (6, "\x0b\t \x1c", "h2"), (7, ("w1 w2 w3 w4 w5 w6 " * 3000) + "end", "h2")]
    docs = spark.createDataFrame([(d, t, s, 1) for d, t, s in rows], "doc_id long, text string, source string, n_words int")
    found = [len(r.boiler) for r in frequent_lines(docs, "text", "source", LineRules(min_docs=5, max_ratio=0.05)).collect()]
    assert len(found) > 1
    few = {"min_docs": 5, "max_ratio": 0.05, "broadcast_entries": sum(found) - 1}  # all arrays do not fit, those of one host do
    for rules in (LineRules(min_docs=5, max_ratio=0.05), LineRules(min_docs=5, max_ratio=0.05, broadcast_entries=0), LineRules(**few, hot_hosts=1), LineRules(**few, hot_hosts=9)):
        got = apply_line_rules(docs, rules=rules).collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in got) == brute(rows, rules)
    assert any(r.n_removed_lines for r in got) and any(not r.base_failed and not r.kept for r in got)
    assert apply_line_rules(docs.limit(0)).count() == 0


def test_a_filter_on_the_result_stays_above_the_windows(spark):
    """Pushed below, the filter would hash a text's words once per window."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(6000)), "h") for i in range(8)], "doc_id long, text string, source string")
    kept = apply_line_rules(docs, rules=LineRules(min_docs=50)).where("kept AND n_repeat_words = 0")  # the lines agree but for their digits
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")
    assert kept.count() == 8


def test_the_share_decides_on_small_hosts(spark):
    """On a host of ten documents a line of three is boilerplate, one of two is not."""
    own = lambda i: "\n".join(f"{'abcdefghij'[i]}{c} own words of this document only here {c}" for c in "klmn")
    rows = [(i, own(i) + ("\nshared by three of them" if i < 3 else "\nshared by two" if i < 5 else ""), "h") for i in range(10)]
    got = {r.doc_id: r.n_removed_lines for r in apply_line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: int(i < 3) for i in range(10)}
