"""A source tree on disk as a table of files."""

from __future__ import annotations

import os
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every file below ``root``, paths relative to it; what belongs to the
    version control is left out."""
    home = os.path.abspath(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{home}")
    plain = F.udf(unquote) if "%" in home else None
    path = F.regexp_replace("path", r"^file:/+", "/")
    path = plain(path) if plain else path
    out = files.select(F.substring(path, len(home.rstrip("/")) + 2, 1 << 20).alias("path"), "content")
    return out.where(~F.col("path").rlike(r"^\.git(/|$)"))
