"""Data-quality rules: a declarative list gives every violation, and can fail the run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Unique:
    """A value that no other row may have; nulls are no values."""

    value: Column


@dataclass(frozen=True)
class Rule:
    """name, and what must hold. A condition that is null doesn't hold."""

    name: str
    holds: Column | Unique


def unique(c: Column | str) -> Unique:
    """For Rule: no other row has the same value."""
    return Unique(F.col(c) if isinstance(c, str) else c)


def violations(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """(row_id, rule) for each rule that a row breaks; one pass for all rules on rows.

    Uniqueness is counted by value before the shuffle and joined back for values that repeat only, so a value that a
    third of all rows have is no task's alone.
    """
    same = [r for r in rules if isinstance(r.holds, Unique)]
    own = [r for r in rules if not isinstance(r.holds, Unique)]
    flagged = df.select(F.col(key).cast("string").alias("row_id"), *[F.coalesce(r.holds, F.lit(False)).alias(f"r{i}") for i, r in enumerate(own)])
    broken = F.filter(F.array(*[F.when(~F.col(f"r{i}"), F.lit(r.name)) for i, r in enumerate(own)]), lambda x: x.isNotNull()) if own else F.array().cast("array<string>")
    out = flagged.select("row_id", F.explode(broken).alias("rule"))
    for r in same:
        x = df.select(F.col(key).cast("string").alias("row_id"), r.holds.value.alias("value")).where("value is not null")
        twice = x.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
        out = out.unionByName(x.join(twice, "value", "left_semi").select("row_id", F.lit(r.name).alias("rule")))
    return out


def known(df: DataFrame, key: str, column: str, table: DataFrame, other: str, rule: str) -> DataFrame:
    """(row_id, rule) for values that aren't in a table; null values are let through."""
    return df.where(F.col(column).isNotNull()).join(table.select(F.col(other).alias(column)).distinct(), column, "left_anti").select(F.col(key).cast("string").alias("row_id"), F.lit(rule).alias("rule"))


def counts(df: DataFrame, expected: dict[str, tuple[Column, int]]) -> DataFrame:
    """(row_id null, rule) for counts of the whole table that aren't as expected; one aggregate."""
    row = df.agg(*[F.count_if(c).alias(f"c{i}") for i, (c, _) in enumerate(expected.values())])
    broken = F.filter(F.array(*[F.when(F.col(f"c{i}") != n, F.lit(name)) for i, (name, (_, n)) in enumerate(expected.items())]), lambda x: x.isNotNull())
    return row.select(F.lit(None).cast("string").alias("row_id"), F.explode(broken).alias("rule"))


def assert_clean(found: DataFrame, what: str) -> None:
    bad = found.limit(5).collect()
    if bad:
        raise ValueError(f"{what}: " + "; ".join(f"{r['row_id']}: {r['rule']}" for r in bad))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule, in order, that a row fails; null if none."""
    out = None
    for name, ok in rules:
        bad = ~F.coalesce(ok, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out
