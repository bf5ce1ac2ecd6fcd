"""Edits of text as expressions: ordered patches and guarded name replacement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import escaped


def occurrences(c: Column, old: Column) -> Column:
    """Non-overlapping literal occurrences; 0 for an empty search text."""
    cut = F.length(c) - F.length(F.replace(c, old, F.lit("")))
    return F.when(F.length(old) > 0, (cut / F.length(old)).cast("int")).otherwise(F.lit(0))


def patched(c: Column, plan: Column) -> Column:
    """Apply array<struct<old, new, count>> in order, each to what the ones before left.

    Returns struct<text, counts, ok>: the text, how often each old text was found, and whether each
    count is the expected one (null: once or more).
    """
    start = F.struct(c.alias("text"), F.array().cast("array<int>").alias("counts"), F.lit(True).alias("ok"))

    def step(a: Column, p: Column) -> Column:
        n = occurrences(a["text"], p["old"])
        fine = F.when(p["count"].isNull(), n > 0).otherwise(n == p["count"])
        return F.struct(
            F.replace(a["text"], p["old"], p["new"]).alias("text"), F.concat(a["counts"], F.array(n)).alias("counts"), (a["ok"] & fine).alias("ok"),
        )

    return F.aggregate(plan, start, step)


def names_replaced(c: Column, forms: dict[str, str], letters: str = r"\p{L}") -> Column:
    """struct<text, n>: whole forms replaced line by line; a line that holds a new form already is left.

    Longer forms are tried first, so a form is never cut short by one that begins it.
    """
    ordered = sorted(forms, key=lambda f: (-len(f), f))
    new = "|".join(escaped(f) for f in sorted(set(forms.values()), key=lambda f: (-len(f), f)))
    pattern = f"(?<![{letters}])(?:{'|'.join(map(escaped, ordered))})(?![{letters}])"

    def line(x: Column) -> Column:
        out = x
        # One pass per form, longest first; borders keep the passes apart.
        for old in ordered:
            out = F.regexp_replace(out, f"(?<![{letters}]){escaped(old)}(?![{letters}])", forms[old].replace("\\", "\\\\").replace("$", "\\$"))
        return F.when(x.rlike(new), x).otherwise(out)

    count = lambda x: F.when(x.rlike(new), F.lit(0)).otherwise(F.regexp_count(x, F.lit(pattern)))
    lines = F.split(c, "\n", -1)
    return F.struct(F.array_join(F.transform(lines, line), "\n").alias("text"), F.aggregate(F.transform(lines, count), F.lit(0), lambda a, x: a + x).alias("n"))


def edits_hold(c: Column, plan: Column) -> Column:
    """Whether a text shows that array<struct<old, new, ..>> was applied: no old text is left, but for those inside a new one,
    and every new text that is not empty is there.
    """
    gone = lambda p: (occurrences(c, p["old"]) == 0) | F.exists(plan, lambda q: F.contains(q["new"], p["old"]))
    return F.forall(plan, lambda p: gone(p) & ((p["new"] == "") | F.contains(c, p["new"])))
