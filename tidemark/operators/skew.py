"""Joins whose frequent keys are spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is frequent if it has more than this share of all rows: such keys are at most as many
#: as one over it, whatever the data, and may be broadcast.
SHARE, LEAST = 1 / 1000, 100


def join_frequent(rows: DataFrame, table: DataFrame, keys: list[str], total: int, count: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row a key.

    ``table[count]`` says how many of the ``total`` rows have the key. What is frequent meets its
    rows where they are; the rest is joined as usual, with at most a thousandth of the rows for a key.
    """
    often = max(LEAST, int(total * SHARE))
    hot, few = F.broadcast(table.where(F.col(count) > often)), table.where(F.col(count) <= often)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(few, keys))
