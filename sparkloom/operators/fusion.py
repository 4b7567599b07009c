"""Fusion and reordering of ranked lists (query_id, id, rank from 0, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def reciprocal_rank(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, id, score): the sum of 1 / (k + rank + 1) over all lists."""
    together = reduce(DataFrame.unionByName, [x.select("query_id", "id", "rank") for x in lists])
    return together.groupBy("query_id", "id").agg(F.sum(1.0 / (F.lit(k + 1.0) + F.col("rank"))).alias("score"))


def best_per_key(ranked: DataFrame, key: str, order: str = "rank") -> DataFrame:
    """The best-ranked row of each query and key: near-duplicates collapse. A partial minimum, no sort."""
    first = ranked.groupBy("query_id", key).agg(F.min(F.struct(order, "id")).alias("m")).select("query_id", F.col("m.id").alias("id"))
    return ranked.join(first, ["query_id", "id"], "left_semi")


def capped(ranked: DataFrame, is_class: str, cap: int, n: int) -> DataFrame:
    """The best ``n`` of each query with at most ``cap`` rows for which ``is_class`` holds."""
    so_far = F.sum(F.when(F.expr(is_class), 1).otherwise(0)).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    kept = ranked.withColumn("so_far", so_far).where(f"not ({is_class}) or so_far <= {cap}").drop("so_far")
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def within_budget(ranked: DataFrame, length: str, budget: int) -> DataFrame:
    """Rows in rank order while their summed length keeps within the budget; the first always stays."""
    w = Window.partitionBy("query_id").orderBy("rank")
    held = ranked.withColumn("held", F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("k", F.row_number().over(w))
    first_over = F.min(F.when((F.col("held") > budget) & (F.col("k") > 1), F.col("k"))).over(Window.partitionBy("query_id"))
    return held.withColumn("stop", first_over).where("stop is null or k < stop").drop("stop", "k")
