"""Matching rows in order: first in, first out; ranked candidates; runs; moved rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fifo_match(before: DataFrame, after: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """The n-th row of a key before with the n-th of that key after; either side may be missing.

    Gives keys, ``n``, ``before_idx`` and ``after_idx``.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(idx))
    left = before.select(*keys, n.alias("n"), F.col(idx).alias("before_idx"))
    right = after.select(*keys, n.alias("n"), F.col(idx).alias("after_idx"))
    return left.join(right, [*keys, "n"], "full")


def moved(matched: DataFrame, group: list[str]) -> DataFrame:
    """Matched rows that come later than one they came before of: their old place is under the
    greatest old place so far."""
    w = Window.partitionBy(*group).orderBy("after_idx").rowsBetween(Window.unboundedPreceding, -1)
    pairs = matched.where("before_idx is not null and after_idx is not null")
    return pairs.withColumn("top", F.max("before_idx").over(w)).where("before_idx < top").drop("top")


def first_match(candidates: DataFrame, keys: list[str], rank: list[Column], value: str) -> DataFrame:
    """The value of the best rank, as an aggregate with partial sums."""
    return candidates.groupBy(*keys).agg(F.min_by(value, F.struct(*rank)).alias(value))


def first_step(candidates: DataFrame, keys: list[str], step: str) -> DataFrame:
    """All candidates of the first step that has any."""
    best = candidates.groupBy(*keys).agg(F.min(step).alias("best_step"))
    return candidates.join(best, keys).where(F.col(step) == F.col("best_step")).drop("best_step")


def runs(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Runs of adjacent integers: (keys, start, length)."""
    w = Window.partitionBy(*keys).orderBy(at)
    gap = F.when(F.col(at) - F.lag(at).over(w) <= 1, 0).otherwise(1)
    marked = rows.select(*keys, at).distinct().withColumn("gap", gap).withColumn("run", F.sum("gap").over(w))
    return marked.groupBy(*keys, "run").agg(F.min(at).cast("long").alias("start"), F.count("*").alias("length")).drop("run")


def fill_sections(lines: DataFrame, keys: list[str], order: str, header: Column) -> DataFrame:
    """Each line with the last header at or before it (null before the first)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("section", F.last(header, ignorenulls=True).over(w))
