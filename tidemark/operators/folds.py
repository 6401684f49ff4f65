"""Folds over chains of declarations and over repeated reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest(chain: DataFrame, keys: list[str], depth: str, value: str) -> DataFrame:
    """The non-null value of the least depth (``depth`` 0 is nearest); null if there is none."""
    return chain.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.col(depth))).alias(value))


def accumulated(chain: DataFrame, keys: list[str], depth: str, value: str, sep: str = ",") -> DataFrame:
    """All non-null values, nearest first."""
    got = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(depth, value))))
    return chain.groupBy(*keys).agg(F.array_join(F.transform(got, lambda x: x[value].cast("string")), sep).alias(value))


def loudest(reports: DataFrame, keys: list[str], priority: Column, order: Column, value: str) -> DataFrame:
    """The value of the highest priority, the latest among equals."""
    return reports.groupBy(*keys).agg(F.max_by(value, F.struct(priority, order)).alias(value))


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest first, the root being the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.reverse(F.sequence(F.lit(0), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
