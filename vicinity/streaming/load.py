"""A generator of requests at a stated rate, and the progress of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Requests a second of the constant load, and seconds of the ramp that leads up to it.
RATE, RAMP = 900, 120


def requests_at(spark: SparkSession, bodies: list[str], rate: int = RATE, ramp: int = 0) -> DataFrame:
    """A stream (qid, body) of so many requests a second, going round the given bodies; ``ramp`` seconds to reach the rate.

    The bodies are literals of the plan, so they should be few.
    """
    source = spark.readStream.format("rate").option("rowsPerSecond", rate)
    if ramp:
        source = source.option("rampUpTime", f"{ramp}s")
    body = F.element_at(F.array(*map(F.lit, bodies)), (F.col("value") % len(bodies) + 1).cast("int"))
    return source.load().select(F.col("value").alias("qid"), body.alias("body"))


def throughput(query) -> list[tuple[int, int, float]]:
    """(batch, rows, rows a second) of the micro-batches that Spark still remembers."""
    return [(p["batchId"], p["numInputRows"], float(p["processedRowsPerSecond"] or 0)) for p in query.recentProgress]
