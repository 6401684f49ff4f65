"""The operators as stages of a corpus pipeline: documents in, documents out.

Each stage takes (spark, docs, sf_dir). ``docs`` are all rows that the stage before kept.
Stages that drop rows decide by a row key of their own: rows of a null or repeated id stand
and fall each for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import toxicity
from tidemark.llm.common import cut, known_id, table, without
from tidemark.llm.decontaminate import contaminated
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mixture
from tidemark.llm.near_dup import near_components

#: The row key of a stage's input.
ROW = "__tidemark_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key for each row, written so that every reading has the same keys."""
    return cut(docs.withColumn(ROW, F.monotonically_increasing_id()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 and more go; labels are learnt as op6 does."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts, ``n_chars`` follows; every document stays."""
    out = dedup_lines(docs)
    if "n_chars" in out.columns:
        kind = out.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) one row of the smallest id stays."""
    docs = _keyed(docs)
    copies = cut(near_components(docs, ROW).where("doc <> component").select("doc", "component"))
    members = copies.unionByName(copies.select(F.col("component").alias("doc"), "component").distinct())
    ids = members.join(docs.select(F.col(ROW).alias("doc"), known_id("doc_id").alias("id")), "doc")
    stay = ids.groupBy("component").agg(F.min(F.struct("id", "doc")).alias("least")).select("least.doc")
    return without(docs, members.join(stay, "doc", "left_anti").select("doc"), ROW).drop(ROW)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window like a benchmark item go."""
    docs = _keyed(docs)
    found = contaminated(docs, table(spark, sf_dir, "benchmark"), ROW)
    return without(docs, found.select(F.col("doc_id").alias("doc")), ROW).drop(ROW)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: the documents' columns, then size, source_size, target, epochs, taken."""
    return mixture(docs)
