"""Scoring requests: in batches and as a stream. Requests are stateless, so each micro-batch is a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.functions.features import parse, vectorize
from vicinity.functions.scalars import quantize
from vicinity.functions.scratch import scratch_scope, written
from vicinity.operators import decide
from vicinity.operators.ivf import IvfIndex
from vicinity.operators.knn import FAST_PROBES, FULL_PROBES, K, two_pass


def score(requests: DataFrame, index: IvfIndex, norm: dict[str, float], risks: DataFrame, k: int = K, fast: int = FAST_PROBES, full: int = FULL_PROBES, compat: bool = False) -> DataFrame:
    """(qid, frauds, approved, fraud_score, response) of requests (qid, body). A body that can't be read is approved."""
    seen = vectorize(parse(requests), norm, risks, compat).select("qid", quantize(F.col("vector"), index.codec, index.dims).alias("codes"))
    seen = written(seen, "requests")  # read once, however often a batch's vectors are searched
    queries = seen.where("codes IS NOT NULL")
    counted = two_pass(index, queries, k, fast, full)
    frauds = F.coalesce("frauds", F.lit(0))
    return seen.select("qid").join(counted, "qid", "left").select(
        "qid", frauds.alias("frauds"), decide.approved(frauds, k).alias("approved"),
        decide.score(frauds, k).alias("fraud_score"), decide.body(frauds, k).alias("response"),
    )


def score_stream(requests: DataFrame, scorer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, once: bool = False):
    """Starts a stream that scores each micro-batch of requests and writes it to ``sink`` as Parquet, a folder a batch.

    The index must be loaded before (``ivf.warm_up``). A batch that runs again overwrites its own folder; its scratch
    tables go when it is written.
    """

    def run(batch: DataFrame, number: int) -> None:
        with scratch_scope(batch.sparkSession):
            scorer(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
