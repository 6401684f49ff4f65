"""What the training-data operators share: reading tables, row-wise Arrow passes, cut lineage.

Conventions that hold for every operator of this subpackage:

* a null text counts as the empty text, whole texts are always processed;
* operators pick the columns they need and return an identifier plus their own columns, so
  extra input columns (with whatever names) neither clash nor cost anything;
* repeated rows are kept: one input row gives one output row where the result is per document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import cut

__all__ = ["BLANKS", "NULL_ID", "add_columns", "cut", "held_out", "id_back", "keep_rows", "known_id", "map_slices", "table", "without"]

#: Python works on slices of a batch of at most so many rows, so that few texts are unpacked at once.
SLICE = 256
#: What identifies the rows whose id is null; no 63-bit identifier reaches it.
NULL_ID = 2**63 - 1
#: Whitespace of all word and line contracts here: \x20 and \x09-\x0D.
BLANKS = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_slices(df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Run ``work`` over slices of rows: columns as lists in, columns as lists out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text_col: str, keep: Callable[[list], Iterable[bool]]) -> DataFrame:
    """The rows whose texts are kept, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield part.filter(pa.array(list(keep(part.column(text_col).to_pylist())), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def add_columns(df: DataFrame, text: str, work: Callable[[list], dict[str, list]], schema: str) -> DataFrame:
    """All columns as they are, and those that ``work`` makes of a column of texts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    new = _parse_datatype_string(schema)
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out = work(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(out[f.name], f.type) for f in arrow]], names=[*part.schema.names, *arrow.names])

    return df.mapInArrow(run, StructType(df.schema.fields + new.fields))


#: A table of ids is broadcast up to so many rows.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows whose id is not among ``gone`` (one column, doc, made known).

    ``gone`` is counted first: few ids are broadcast; beyond, documents are dealt out by id and
    meet the ids in memory, so that texts are never sorted.
    """
    gone = cut(gone.select(F.col("doc").alias("__tidemark_gone")).distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone.hint("shuffle_hash")
    return docs.join(side, known_id(id_col) == F.col("__tidemark_gone"), "left_anti")


def known_id(column: str) -> Column:
    """The identifier with null made a value that joins and orders after every other."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def id_back(column: Column) -> Column:
    return F.when(column != F.lit(NULL_ID), column)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether labels of this row are kept from learning: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0
