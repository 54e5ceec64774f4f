"""Scans: reference sets, configuration, labelled requests, request streams, and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.sources.schemas import LABELED, NORMALIZATION, REFERENCE


def read_references(spark: SparkSession, path: str, fraud: str = "fraud") -> DataFrame:
    """(orig_id, vector, label 0/1) of a JSON array, gzipped or not; orig_id is the position in the array.

    A multi-line file is one partition, so ids rise with the position. Write the result before spreading it.
    """
    rows = spark.read.schema(REFERENCE).option("multiLine", True).json(path)
    return rows.select(
        F.monotonically_increasing_id().alias("orig_id"), "vector", (F.col("label") == fraud).cast("int").alias("label")
    )


def read_normalization(spark: SparkSession, path: str) -> dict[str, float]:
    row = spark.read.schema(NORMALIZATION).option("multiLine", True).json(path).first()
    return row.asDict()


def read_mcc_risk(spark: SparkSession, path: str) -> DataFrame:
    """(mcc, risk) from a JSON object of code -> risk."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,double>")).alias("mcc", "risk"))


def read_labeled(spark: SparkSession, path: str) -> DataFrame:
    """(request, expected_approved, expected_fraud_score): a row for each entry; ``request`` is JSON text."""
    rows = spark.read.schema(LABELED).option("multiLine", True).json(path)
    return rows.select(F.explode("entries").alias("e")).select("e.*")


def limited(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order; all rows if n is 0."""
    return df.orderBy(*order).limit(n) if n else df


def request_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of request bodies, a line each, from text files that arrive in a folder."""
    return spark.readStream.text(folder).select(F.col("value").alias("body"))
