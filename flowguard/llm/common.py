"""Small helpers shared by the operators: column names, Arrow row functions, tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from flowguard.llm.words import slices
from flowguard.session import materialize

__all__ = ["add_struct", "digest_of", "documents", "materialize", "spare", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def spare(df: DataFrame, name: str) -> str:
    """``name``, or the first variation of it that is no column of ``df`` (case does not count)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def add_struct(
    df: DataFrame,
    text: str,
    into: str,
    kind: StructType,
    judge: Callable[[pa.RecordBatch], pa.StructArray],
    slice_bytes: int | None = None,
) -> DataFrame:
    """``df`` with a struct column ``into`` that ``judge`` computes from slices of the rows.

    Every other column passes through as it is. ``into`` must not be a column of ``df``; take ``spare``.
    """
    if into != spare(df, into):
        raise ValueError(f"{into} is a column already")
    at = df.columns.index(text)
    # two columns may bear the same name up to case; the task goes by position
    schema = StructType([*df.schema.fields, StructField(into, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at, slice_bytes):
            yield pa.RecordBatch.from_arrays([*part.columns, judge(part)], [*part.schema.names, into])

    return df.mapInArrow(run, schema)


def digest_of(items: str | F.Column) -> F.Column:
    """SHA-256, in lower-case hex, of strings joined by commas."""
    return F.sha2(F.concat_ws(",", items), 256)
