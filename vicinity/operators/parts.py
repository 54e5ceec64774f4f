"""Parts of an index's buckets: neighbours that a search meets together, with the box that holds each part.

Buckets of short vectors are cut at medians of their longest sides into parts of about ``PART`` rows. Where they are cut is
taken from a sample; every row goes to a part, and boxes are measured over all rows. So the sample bears on speed only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.functions.scratch import written
from vicinity.functions.shipping import ship_package

#: Rows of a part, rows of a part in the sample that tells where to cut, and rows of the whole sample.
PART, SEEN, SAMPLE = 2048, 32, 1 << 20
#: Parts of an index, beyond which they get more rows, and rows of a part beyond which there are more parts after all.
PARTS, LARGE = 16384, 65536


@dataclass
class Cuts:
    """A tree for each bucket. A node sends codes of ``side`` up to ``at`` left, others right; a leaf has side -1 and its part's number."""

    root: np.ndarray
    side: np.ndarray
    at: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def of(self, bucket: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The part of each row, by its bucket and codes."""
        node = self.root[bucket]
        while True:
            inner = np.flatnonzero(self.side[node] >= 0)
            if not len(inner):
                return self.left[node]
            here = node[inner]
            node[inner] = np.where(x[inner, self.side[here]] <= self.at[here], self.left[here], self.right[here])


def cut(sample: dict[int, np.ndarray], counts: np.ndarray) -> tuple[Cuts, np.ndarray]:
    """Trees over a sample of each bucket's codes, for so many rows of each; and the bucket of each part."""
    side, at, left, right, owner, root = [], [], [], [], [], []
    rows = min(max(PART, -(-int(np.sum(counts)) // PARTS)), LARGE)

    def node() -> int:
        for column in (side, at, left, right):
            column.append(-1)
        return len(side) - 1

    for bucket, count in enumerate(counts):
        root.append(node())
        todo = [(root[-1], sample.get(bucket, np.zeros((0, 1))), -(-int(count) // rows))]
        while todo:
            here, x, parts = todo.pop()
            reach = x.max(axis=0) - x.min(axis=0) if parts > 1 and len(x) else np.zeros(1)
            if not reach.max():
                left[here] = len(owner)
                owner.append(bucket)
                continue
            d = int(np.argmax(reach))
            values = x[:, d]
            middle = np.partition(values, len(values) // 2)[len(values) // 2]
            middle = middle if middle < values.max() else values[values < middle].max()
            low = values <= middle
            share = min(max(round(parts * low.mean()), 1), parts - 1)
            side[here], at[here], left[here], right[here] = d, middle, node(), node()
            todo += [(left[here], x[low], share), (right[here], x[~low], parts - share)]
    return Cuts(np.array(root), np.array(side), np.array(at, np.float64), np.array(left), np.array(right)), np.array(owner, np.int64)


def into_parts(rows: DataFrame, k: int, dims: int) -> tuple[DataFrame, Cuts, np.ndarray]:
    """``rows`` (bucket, orig_id, label, codes) of an index with their part, written as ``cell``; the cuts, and each part's bucket."""
    spark = rows.sparkSession
    ship_package(spark)
    counts = np.zeros(k, np.int64)
    for r in rows.groupBy("bucket").count().collect():
        counts[r["bucket"]] = r["count"]
    every = max(1, PART // SEEN, -(-int(counts.sum()) // SAMPLE))
    seen = rows.where(F.pmod(F.xxhash64("orig_id"), F.lit(every)) == 0).select("bucket", "codes").toArrow().combine_chunks()
    x, of = seen["codes"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, dims), seen["bucket"].to_numpy()
    by = np.argsort(of, kind="stable")
    some, starts = np.unique(of[by], return_index=True)
    cuts, owner = cut(dict(zip(some.tolist(), np.split(x[by], starts[1:]))), counts)
    shared = spark.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
                part = shared.value.of(batch.column(0).to_numpy(), codes).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(part)], ["orig_id", "label", "codes", "cell"])

    parted = rows.select("bucket", "orig_id", "label", "codes").mapInArrow(run, "orig_id long, label int, codes array<int>, cell long")
    return written(parted, "parts"), cuts, owner
