"""Half-open intervals: predicates, interval joins, nearest neighbours of gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains(start: Column, end: Column, point: Column) -> Column:
    return (point >= start) & (point < end)


def intersects(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Overlap; a range of no width overlaps the span that holds its point."""
    return F.when(low == high, contains(start, end, low)).otherwise((low < end) & (high > start))


def holds_within(start: Column, end: Column, low: Column, high: Column, outer_start: Column, outer_end: Column) -> Column:
    """Whether the span holds the range, clipped to the outer span."""
    low, high = F.greatest(low, outer_start), F.least(high, outer_end)
    return (start <= low) & (high <= end)


def interval_join(spans: DataFrame, ranges: DataFrame, keys: list[str], bin_size: int | None = None) -> DataFrame:
    """Spans (keys, start, end) with the ranges (keys, low, high) that they meet.

    With an equality key the range test is a residual of a hash join. Where one key holds very
    many spans, ``bin_size`` spreads both sides over bins of that width, so that a key's rows
    are dealt out; a pair meets once, in the first bin that both reach.
    """
    test = intersects(F.col("start"), F.col("end"), F.col("low"), F.col("high"))
    if bin_size is None:
        return spans.join(ranges, keys).where(test)
    over = lambda a, b: F.sequence(F.floor(a / bin_size), F.floor(F.greatest(a, b - 1) / bin_size))
    left = spans.withColumn("bin", F.explode(over(F.col("start"), F.col("end"))))
    right = ranges.withColumn("bin", F.explode(over(F.col("low"), F.col("high"))))
    first = F.col("bin") == F.greatest(F.floor(F.col("start") / bin_size), F.floor(F.col("low") / bin_size))
    return left.join(right, [*keys, "bin"]).where(test & first).drop("bin")


def closed_overlap(start: Column, end: Column, low: Column, length: Column) -> Column:
    """Lines first to last, both included, against a run of lines; a deletion counts as one line."""
    last = low + F.greatest(length, F.lit(1)) - 1
    return (low <= end) & (last >= start)


def neighbours(rows: DataFrame, keys: list[str], order: list[str], is_gap: Column, value: str) -> DataFrame:
    """For each gap row the nearest other row's value before and after it, by windows."""
    other = F.when(~is_gap, F.col(value))
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.last(other, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(other, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("before", before).withColumn("after", after).where(is_gap)
