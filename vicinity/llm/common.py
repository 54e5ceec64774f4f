"""What the operators of this subpackage share: scratch tables, Arrow maps and word rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.functions.scratch import drop_written, written
from vicinity.functions.shipping import ship_package

__all__ = [
    "BATCH_BYTES", "BATCH_ROWS", "WORD", "as_bytes", "as_strings", "bounded_batches", "documents", "drop_written",
    "held_out", "learnable", "map_arrow", "remainder", "written",
]

#: Characters that end a word in most contracts: space, tab, LF, VT, FF, CR. bytes.split() cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"

#: Upper bounds of an Arrow batch; long documents make the bytes count, short ones the rows.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch limits (never raise them), so that long texts stay within a worker's memory.

    Also sends the package to the executors; every use of Python workers comes by here.
    """
    ship_package(spark)
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        now = str(spark.conf.get(key)).removesuffix("b")
        if not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


def map_arrow(df: DataFrame, batch_fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply a function to each Arrow batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch_fn(batch)

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each string; a null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_strings(column: pa.Array) -> list[str]:
    """Each string; a null is empty."""
    return [x or "" for x in column.to_pylist()]


def remainder(doc_id: Column, parts: int = 3) -> Column:
    """crc32 of the id as text, modulo ``parts``; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(-1))


def held_out(doc_id: Column) -> Column:
    """True for the third of ids that is never learned from. A null id is not held out and not learned from."""
    return remainder(doc_id) == 1


def learnable(doc_id: Column) -> Column:
    return remainder(doc_id).isin(0, 2)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
