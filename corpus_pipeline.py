"""From raw documents to a training mix; every stage is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.llm.common import cut, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line dedup", stages.drop_repeated_lines),
    ("near duplicates", stages.drop_near_duplicates),
    ("decontamination", stages.drop_contaminated),
    ("source mixing", stages.mix_sources),
]

#: Learnt scores and hashed signatures have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
