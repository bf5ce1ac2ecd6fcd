"""Rules as data: each is a predicate and a payload, all evaluated in one projection.

The chosen rules become one array of nullable structs, nulls are dropped and the rest inlined, so a
scan costs one narrow pass however many rules it has, and rules left out are never computed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    weight: str
    when: Column
    detail: Column
    source: Column
    target: Column


def chosen(rules: Sequence[Rule], only: Sequence[str] | None) -> list[Rule]:
    """The rules of the named kinds; an unknown name is an error."""
    if only is None:
        return list(rules)
    unknown = sorted(set(only) - {r.kind for r in rules})
    if unknown:
        raise ValueError(f"unknown checks: {', '.join(unknown)}")
    return [r for r in rules if r.kind in only]


def findings(df: DataFrame, keys: Sequence[str], rules: Sequence[Rule], only: Sequence[str] | None = None) -> DataFrame:
    """keys, emit_ord, kind, weight, detail, source, target: one row per rule that holds, in rule order."""
    found = [
        F.when(F.coalesce(r.when, F.lit(False)), F.struct(F.lit(i).alias("emit_ord"), F.lit(r.kind).alias("kind"), F.lit(r.weight).alias("weight"), r.detail.alias("detail"), r.source.alias("source"), r.target.alias("target")))
        for i, r in enumerate(chosen(rules, only))
    ]
    if not found:
        return df.select(*keys).limit(0).selectExpr(*keys, "0 emit_ord", "'' kind", "'' weight", "'' detail", "'' source", "'' target")
    return df.select(*keys, F.inline(F.array_compact(F.array(*found))))


def counts(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, kind, weight, n."""
    return found.groupBy(*keys, "kind", "weight").agg(F.count("*").alias("n"))
