"""Inverted-file index: Lloyd's k-means, bucket layout and radii.

Centroids may live on the driver, within ``CENTROID_BYTES``; vectors never do. An assignment pass is a map over the
vectors; an update adds partial sums of each task. Nothing carries lineage from round to round but the centroids
themselves. An index's rows are written once and read by every search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinity.functions.scalars import FLAT, l2sq, quantize
from vicinity.functions.scratch import drop_written, written
from vicinity.functions.shipping import ship_package, small_methods
from vicinity.operators.boxes import groups
from vicinity.operators.cells import CELL, MATRIX, chunk_of
from vicinity.operators.parts import Cuts, into_parts

CENTROIDS, ROUNDS, RESEED = 2048, 3, 7919
#: Bytes of the centroid table that is sent to every task; more buckets than fit are an error.
CENTROID_BYTES = 256 << 20
#: A cell's number is its bucket's, shifted by so many bits, and that of a chunk of the bucket.
CHUNK_BITS = 24


@dataclass
class Parts:
    """rows: (orig_id, label, codes, cell), the cell being the part; by part its bucket, its rows and the box of their codes."""

    rows: DataFrame
    cuts: Cuts
    owner: np.ndarray
    n: np.ndarray
    low: np.ndarray
    high: np.ndarray


@dataclass
class IvfIndex:
    """rows: (bucket, orig_id, label, codes), and cell if dealt out by it; centroids: (bucket, centroid, codes, radius_sq, radius, n).

    ``tasks``: into how many parts the rows are dealt out by cell, if they are.
    """

    rows: DataFrame
    centroids: DataFrame
    k: int
    dims: int
    codec: str
    tasks: int | None = None
    _table: tuple | None = field(default=None, repr=False)
    _boxes: tuple | None = field(default=None, repr=False)
    _few: dict[int, DataFrame] = field(default_factory=dict, repr=False)
    _parts: dict[int, Parts] = field(default_factory=dict, repr=False)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, radius, chunks) of the centroids by bucket: k rows, as bounded as the centroids themselves."""
        if self._table is None:
            rows = sorted(self.centroids.select("bucket", "codes", "radius", "n").collect())
            codes = np.array([r.codes for r in rows], np.float64).reshape(len(rows), self.dims)
            chunks = np.maximum(1, -(-np.array([r.n for r in rows], np.int64) // CELL))
            self._table = codes, np.array([r.radius for r in rows], np.float64), chunks
        return self._table

    def boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, low, high) by bucket: its rows and the box of their codes, of no volume and at infinity if it has none.

        The rows are read once, for vectors of up to FLAT dims; a box of more is not measured, and holds everything.
        """
        if self._boxes is None:
            n, flat = np.zeros(self.k, np.int64), self.dims <= FLAT
            low, high = (np.full((self.k, self.dims if flat else 0), np.inf) for _ in range(2))
            for r in (bucket_boxes(self.rows, self.k, self.dims) if flat else self.centroids.select("bucket", "n")).collect():
                n[r.bucket] = r.n
                if flat:
                    low[r.bucket], high[r.bucket] = r.low, r.high
            self._boxes = n, low, high
        return self._boxes

    def parts(self, k: int) -> Parts | None:
        """The rows in parts of neighbours, of which some are left out as in ``cells``; None if vectors are long or dealt out by cell."""
        if self.dims > FLAT or "cell" in self.rows.columns:
            return None
        if k not in self._parts:
            few = written(few_equal(self.rows, k), "few")
            rows, cuts, owner = into_parts(few, self.k, self.dims)
            drop_written(few)
            n, (low, high) = np.zeros(len(owner), np.int64), (np.full((len(owner), self.dims), np.inf) for _ in range(2))
            for r in bucket_boxes(rows.withColumnRenamed("cell", "bucket"), len(owner), self.dims).collect():
                n[r.bucket], low[r.bucket], high[r.bucket] = r.n, r.low, r.high
            self._parts[k] = Parts(rows, cuts, owner, n, low, high)
        return self._parts[k]

    def cells(self, k: int | None = None) -> DataFrame:
        """The rows with their cells: a bucket of more than CELL rows is several.

        ``k`` allows that rows are left out which can't be among the k nearest, as k equal ones of smaller ids are before
        them. Short vectors that aren't dealt out yet are thinned so, once.
        """
        if "cell" in self.rows.columns:
            return self.rows
        rows = self.rows
        if k is not None and self.dims <= FLAT:
            if k not in self._few:
                self._few[k] = written(few_equal(rows, k), "few")
            rows = self._few[k]
        chunks = F.greatest(F.lit(1), F.ceil(F.col("n") / CELL)).cast("long")
        sizes = self.centroids.select("bucket", chunks.alias("chunks"))
        cell = F.shiftleft(F.col("bucket").cast("long"), CHUNK_BITS) + chunk_of(F.col("orig_id"), F.col("chunks"))
        return rows.join(F.broadcast(sizes), "bucket").select("bucket", "orig_id", "label", "codes", cell.alias("cell"))


def _vectors_at(refs: DataFrame, ids: list[int]) -> dict[int, list[float]]:
    wanted = refs.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], "orig_id long")
    found = refs.select(F.col("orig_id").cast("long"), "vector").join(F.broadcast(wanted), "orig_id")  # as many as centroids
    return {r.orig_id: r.vector for r in found.collect()}


def initial_centroids(refs: DataFrame, k: int, n: int | None = None) -> np.ndarray:
    """Rows at evenly spaced positions, (i * n) div k. ``orig_id`` must be the position, from 0."""
    n = refs.count() if n is None else n
    ids = [i * n // k for i in range(k)]
    found = _vectors_at(refs, ids)
    centroids = np.array([found[i] for i in ids], np.float32)
    if centroids.nbytes * 2 > CENTROID_BYTES:
        raise ValueError(f"{k} centroids exceed {CENTROID_BYTES} bytes")
    return centroids


def positions(rows: DataFrame, order: str, name: str = "orig_id") -> DataFrame:
    """``rows`` with their position in the order of a column, from 0, without gathering them in one task.

    Rows are written, so that they are made once, and ranges of the column dealt out and written; a range's position is
    the number of rows in the ranges before it.
    """
    once = written(rows, "rows")
    ranged = written(once.repartitionByRange(order).withColumn("__range", F.spark_partition_id()), "ranges")
    drop_written(once)
    before, sizes = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1), ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # a row a task
    place = F.row_number().over(Window.partitionBy("__range").orderBy(order)) - 1 + F.col("__start")
    return ranged.join(F.broadcast(starts), "__range").withColumn(name, place.cast("long")).drop("__range", "__start")


def _assigner(spark, centroids: np.ndarray):
    shared = spark.sparkContext.broadcast(centroids.astype(np.float64))

    def nearest(x: np.ndarray) -> np.ndarray:
        c = shared.value
        norms, step = (c * c).sum(1)[None, :], max(1, MATRIX // len(c))
        # the first, so the smallest bucket, of equals
        return np.concatenate([np.argmin(norms - 2 * (x[i : i + step] @ c.T), axis=1) for i in range(0, len(x), step)])

    return nearest


def assign(refs: DataFrame, centroids: np.ndarray, codes: bool = False) -> DataFrame:
    """``refs`` (orig_id, vector, label) with the bucket of the nearest centroid; ``codes`` in place of the vector, if wanted."""
    ship_package(refs.sparkSession)
    nearest = _assigner(refs.sparkSession, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3 if codes else 1), batch.column(2), pa.array(nearest(x).astype(np.int32))], ["orig_id", last, "label", "bucket"])

    last = "codes" if codes else "vector"
    rows = refs.select(F.col("orig_id").cast("long"), F.col("vector").cast("array<float>"), F.col("label").cast("int"), *(["codes"] if codes else []))
    return rows.mapInArrow(run, f"orig_id long, {'codes array<int>' if codes else 'vector array<float>'}, label int, bucket int")


def bucket_sums(refs: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(bucket, n, sums array<double>): added up in each task first, so that at most tasks x buckets rows are shuffled."""
    ship_package(refs.sparkSession)
    nearest, (k, dims) = _assigner(refs.sparkSession, centroids), centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims))
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
                near = nearest(x)
                count += np.bincount(near, minlength=k)
                for d in range(dims):
                    sums[:, d] += np.bincount(near, x[:, d], k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), pa.array(list(sums[some]), pa.list_(pa.float64()))], ["bucket", "n", "sums"])

    parts = refs.select(F.col("vector").cast("array<float>")).mapInArrow(run, "bucket int, n long, sums array<double>")
    total = F.array(*[F.sum(F.get("sums", F.lit(d))) for d in range(dims)])
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"), total.alias("sums"))


def bucket_boxes(rows: DataFrame, k: int, dims: int) -> DataFrame:
    """(bucket, n, low, high array<int>): the least and greatest codes of each bucket that has rows, first in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, low, high = np.zeros(k, np.int64), np.full((k, dims), np.iinfo(np.int32).max), np.full((k, dims), np.iinfo(np.int32).min)
        for batch in batches:
            if batch.num_rows:
                bucket = batch.column(0).to_numpy().astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                some, starts = np.unique(bucket[order], return_index=True)
                x = batch.column(1).flatten().to_numpy().reshape(-1, dims)[order]
                count += np.bincount(bucket, minlength=k)
                low[some] = np.minimum(low[some], np.minimum.reduceat(x, starts))
                high[some] = np.maximum(high[some], np.maximum.reduceat(x, starts))
        some = np.flatnonzero(count)
        ends = [pa.array(list(side[some].astype(np.int32)), pa.list_(pa.int32())) for side in (low, high)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some]), *ends], ["bucket", "n", "low", "high"])

    parts = rows.select("bucket", "codes").mapInArrow(run, "bucket int, n long, low array<int>, high array<int>")
    ends = [F.array(*[side(F.get(name, F.lit(d))) for d in range(dims)]).alias(name) for name, side in (("low", F.min), ("high", F.max))]
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"), *ends)


def few_equal(rows: DataFrame, k: int) -> DataFrame:
    """(bucket, orig_id, label, codes) without what k rows of its bucket equal that are at hand and have smaller ids.

    Rows stay where they are. Those of an index stand by bucket, so most of what is equal is at hand.
    """

    def thin(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        by = np.argsort(table["orig_id"].to_numpy(), kind="stable")
        x = np.c_[table["bucket"].to_numpy(), table["codes"].combine_chunks().flatten().to_numpy().reshape(len(by), -1)][by]
        order, group = groups(x)
        return table.take(np.sort(by[order[np.arange(len(order)) - np.searchsorted(group, group) < k]])).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CELL:
                yield from thin(held)
                held = []
        if sum(b.num_rows for b in held):
            yield from thin(held)

    ship_package(rows.sparkSession)
    return rows.select("bucket", "orig_id", "label", "codes").mapInArrow(run, "bucket int, orig_id long, label int, codes array<int>")


def lloyd(refs: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after so many full-batch rounds. An empty bucket is reseeded from row (i * 7919) mod n.

    No more buckets than rows; more than ``CENTROID_BYTES`` hold are an error.
    """
    n = refs.count()
    k = min(k, n)
    centroids = initial_centroids(refs, k, n)
    for _ in range(rounds):
        fresh = centroids.copy()
        full = set()
        for r in bucket_sums(refs, centroids).collect():
            fresh[r.bucket] = (np.array(r.sums) / r.n).astype(np.float32)
            full.add(r.bucket)
        if empty := [i for i in range(k) if i not in full]:
            seeds = {i: i * RESEED % n for i in empty}
            found = _vectors_at(refs, list(seeds.values()))
            for i, at in seeds.items():
                fresh[i] = found[at]
        centroids = fresh
    return centroids


def index_from(refs: DataFrame, centroids: np.ndarray, codec: str = "i16") -> IvfIndex:
    """Assigns and quantizes all rows and measures each bucket's size and radius, in the space of the codes.

    The rows are written in bucket order, once, for all that follows. ``refs`` may have their ``codes``, of the same codec.
    """
    spark = refs.sparkSession
    small_methods(spark)
    k, dims = centroids.shape
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "bucket int, centroid array<float>")
    table = table.withColumn("codes", quantize(F.col("centroid"), codec, dims))
    coded = "codes" in refs.columns
    codes = F.col("codes") if coded else quantize(F.col("vector"), codec, dims)
    rows = assign(refs, centroids, coded).select("bucket", "orig_id", "label", codes.alias("codes"))
    assigned = written(rows, "assigned")  # once: ranges are found by a pass of their own
    rows = written(in_order(assigned), "index")
    drop_written(assigned)
    gap = l2sq(F.col("codes"), F.col("c"), dims)
    reach = rows.join(F.broadcast(table.select("bucket", F.col("codes").alias("c"))), "bucket").groupBy("bucket").agg(
        F.max(gap).alias("radius_sq"), F.count("*").alias("n")
    )
    table = table.join(reach, "bucket", "left").select(
        "bucket", "centroid", "codes", F.coalesce("radius_sq", F.lit(0)).alias("radius_sq"),
        F.sqrt(F.coalesce("radius_sq", F.lit(0)).cast("double")).alias("radius"), F.coalesce("n", F.lit(0)).alias("n"),
    )
    return IvfIndex(rows, written(table.coalesce(1), "centroids"), k, dims, codec)


def build_ivf(refs: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, codec: str = "i16") -> IvfIndex:
    return index_from(refs, lloyd(refs, k, rounds), codec)


def drop(index: IvfIndex) -> None:
    """Removes the scratch tables of a built index (not of a loaded one)."""
    drop_written(index.rows, index.centroids, *index._few.values(), *(p.rows for p in index._parts.values()))
    index._few.clear()
    index._parts.clear()


def layout(index: IvfIndex) -> DataFrame:
    """(bucket, n, start): sizes and running starts of the buckets; a window over the centroid table."""
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return index.centroids.select("bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def in_order(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    args: tuple[int | str | Column, ...] = ("bucket", "orig_id") if tasks is None else (tasks, "bucket", "orig_id")
    return rows.repartitionByRange(*args).sortWithinPartitions("bucket", "orig_id")


def placed(index: IvfIndex, tasks: int | None = None) -> DataFrame:
    """Rows in bucket order, and by orig_id within: what is written as the index.

    Ranges of (bucket, orig_id) are dealt out, so that a large bucket is spread over several tasks.
    """
    return in_order(index.rows, tasks)


def warm_up(index: IvfIndex) -> IvfIndex:
    """Loads the index into the executors' memory, dealt out by cell as searches need it, for a stream of searches."""
    tasks = index.tasks or int(index.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, centroids = index.cells().repartition(tasks, "cell").sortWithinPartitions("cell").cache(), index.centroids.cache()
    rows.count()
    warm = IvfIndex(rows, centroids, index.k, index.dims, index.codec, tasks)
    warm.table()
    return warm


def cool_down(index: IvfIndex) -> None:
    """Frees what ``warm_up`` holds."""
    index.rows.unpersist()
    index.centroids.unpersist()
