"""Catalogue work: joins with defaults, overrides, resumption, retention and equality of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def looked_up(df: DataFrame, table: DataFrame, on: str, must: str) -> DataFrame:
    """Left join that fails, naming some keys, when a key has no row; must: a column that is never null in table."""
    out = df.join(table, on, "left")
    missing = [r[0] for r in out.where(F.col(must).isNull()).select(on).distinct().limit(5).collect()]
    if missing:
        raise LookupError(f"no row for {on} {missing}")
    return out


def with_defaults(df: DataFrame, table: DataFrame, on: str, defaults: dict[str, object]) -> DataFrame:
    """Left join; columns of rows without a match, or null ones, take their defaults."""
    out = df.join(table.select(on, *defaults), on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def overridden(base: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Columns of overrides replace those of base where they aren't null."""
    cols = [c for c in overrides.columns if c != key and c in base.columns]
    o = overrides.select(key, *[F.col(c).alias(f"_{c}") for c in cols])
    return base.join(o, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in cols else c for c in base.columns])


def pending(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows not done yet, for resuming after a checkpoint."""
    return source.join(done.select(key).distinct(), key, "left_anti")


def retained(parents: DataFrame, children: DataFrame, key: str, expires: str, now) -> tuple[DataFrame, DataFrame]:
    """Parents that haven't expired, and the children of those."""
    kept = parents.where(F.col(expires) > now)
    return kept, children.join(kept.select(key), key, "left_semi")


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, column) where two tables differ, nulls equal to nulls."""
    o = old.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    both = new.select(key, *columns).join(o, key)
    diff = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return both.select(key, F.explode(diff).alias("column"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def two_tier(df: DataFrame, table: DataFrame, exact: str, canonical: str, value: str, pos: str) -> DataFrame:
    """Value by exact key (the last row wins), else by canonical key (the first row wins)."""
    e = table.where(F.col(exact).isNotNull()).groupBy(exact).agg(F.max_by(value, pos).alias("_e"))
    c = table.where(F.col(canonical).isNotNull()).groupBy(canonical).agg(F.min_by(value, pos).alias("_c"))
    return df.join(e, exact, "left").join(c, canonical, "left").withColumn(value, F.coalesce("_e", "_c")).drop("_e", "_c")


def page(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    """One page of an ordered table, by a top-k of all rows up to its end; numbers past the end give the last page."""
    total = df.count()
    number = max(0, min(number, (max(total, 1) - 1) // size))
    return df.orderBy(*order).offset(number * size).limit(size)
