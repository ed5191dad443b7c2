"""Helpers shared by the training-data operators: tables, scratch space, size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farandole.scratch import shared_dir, stored

__all__ = ["kept_by_text", "BROADCAST_ROWS", "WORD", "crc32_of", "shared_dir", "small", "sliced", "stored", "table", "text_bytes"]

#: A side is broadcast only below this many rows; beyond it the join is left to the planner.
BROADCAST_ROWS = 200_000

#: Ends of a word: ASCII white space, nothing else.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to hold at most that many rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def crc32_of(col: str) -> Column:
    """crc32 of the value's decimal text; null for null."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def text_bytes(col: str = "text") -> Column:
    """Whole text as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b"").cast("binary"))


def sliced(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes: what a task holds as Python objects doesn't
    grow with the number of rows in a batch."""
    for batch in batches:
        rows = max(1, int(most * batch.num_rows / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def kept_by_text(docs: DataFrame, measure: Callable[[list[bytes]], list[pa.Array]], schema: str, condition: str) -> DataFrame:
    """The rows of docs, with its columns, that meet the condition on the columns (schema) that
    measure makes of their whole texts (null: empty). Each text goes to the workers once."""
    n, at = [f"c{k}" for k in range(len(docs.columns))], docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = pc.struct_field(batch.column(0), at).cast(pa.binary())
            made = measure([t or b"" for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc", *names])

    rows = docs.toDF(*n).select(F.struct(*n).alias("doc"))
    names = [part.split()[0] for part in schema.split(", ")]
    kept = rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, {schema}").where(condition)
    return kept.select(*[F.col(f"doc.{a}").alias(b) for a, b in zip(n, docs.columns, strict=True)])
