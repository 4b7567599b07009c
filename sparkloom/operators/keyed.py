"""Keyed tables without a store that updates in place: last writes, deletions, next numbers, trailing counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: str, columns: list[str], count: str | None = None) -> DataFrame:
    """The last written row of each key, by a partial maximum; with ``count`` the number of writes too. Ties go to the greatest values."""
    rest = [c for c in columns if c != order]
    out = df.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("r"), *([F.count("*").alias(count)] if count else []))
    return out.select(*keys, *(F.col(f"r.{c}").alias(c) for c in columns), *([count] if count else []))


def without(df: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """A cascading deletion: the rows whose key isn't deleted. Rows with a null key stay."""
    return df.join(deleted, keys, "left_anti")


def next_numbers(df: DataFrame, key: str, number: str) -> DataFrame:
    return df.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_no"))


def trailing_counts(df: DataFrame, key: str, at: str, seconds: int, block: int = 86_400) -> DataFrame:
    """``n``: how many rows of the same key lie in the ``seconds`` up to each row, itself and rows of the same instant included.

    Windows are over (key, block of time), so that a busy key is many groups; rows at a block's end are lent to the next block.
    Rows without a time are left out.
    """
    t = df.where(F.col(at).isNotNull()).withColumn("_us", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_own", F.expr(f"_us div {block * 1_000_000}"))
    lent = F.expr(f"(_us + {seconds * 1_000_000}) div {block * 1_000_000}")
    both = t.withColumn("_block", F.explode(F.sequence("_own", lent)))
    w = Window.partitionBy(key, "_block").orderBy("_us").rangeBetween(-seconds * 1_000_000, 0)
    return both.withColumn("n", F.count("*").over(w)).where("_block = _own").drop("_us", "_own", "_block")
