"""Command line: ``python -m vicinity build-ivf IN OUT [K] [ROUNDS]`` and ``python -m vicinity check INDEX CONFIG DATA``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vicinity.operators import evaluate, ivf
from vicinity.sources import index_files, readers
from vicinity.streaming import score as scoring


def build(spark: SparkSession, source: str, target: str, k: int, rounds: int) -> None:
    """Builds an index of a reference file. The file is one partition; its rows are written before they are spread."""
    readers.read_references(spark, source).write.mode("overwrite").parquet(f"{target}/references")
    refs = spark.read.parquet(f"{target}/references").repartition(F.col("orig_id"))
    index_files.save_index(ivf.build_ivf(refs, k, rounds), target)


def check(spark: SparkSession, index: str, config: str, data: str, limit: int = 0, tolerance: float = 0.01) -> dict:
    """Scores a labelled set and compares: the confusion matrix, the detection score and the first mismatches."""
    norm = readers.read_normalization(spark, f"{config}/normalization.json")
    risks = readers.read_mcc_risk(spark, f"{config}/mcc_risk.json")
    entries = readers.limited(readers.read_labeled(spark, data), limit, "request")
    entries = entries.withColumn("qid", F.monotonically_increasing_id()).cache()
    scored = scoring.score(entries.select("qid", F.col("request").alias("body")), index_files.load_index(spark, index), norm, risks)
    rows = evaluate.compare(scored, entries, "qid").cache()
    wrong = evaluate.mismatches(rows, F.col("fraud_score"), F.col("expected_fraud_score"), tolerance)
    return {
        **evaluate.report(rows, F.col("approved"), F.col("expected_approved")),
        "score_mismatches": wrong.count(),
        "samples": [r.asDict() for r in evaluate.samples(wrong.select("qid", "fraud_score", "expected_fraud_score"), "qid").collect()],
    }


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="vicinity")
    commands = parser.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build-ivf")
    b.add_argument("source")
    b.add_argument("target")
    b.add_argument("k", nargs="?", type=int, default=ivf.CENTROIDS)
    b.add_argument("rounds", nargs="?", type=int, default=ivf.ROUNDS)
    c = commands.add_parser("check")
    c.add_argument("index")
    c.add_argument("config")
    c.add_argument("data")
    c.add_argument("-limit", type=int, default=0)
    found = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if found.command == "build-ivf":
        build(spark, found.source, found.target, found.k, found.rounds)
    else:
        print(json.dumps(check(spark, found.index, found.config, found.data, found.limit)))


if __name__ == "__main__":
    main()
