"""Index storage: Parquet tables, and binary files for interchange.

The binary layouts (fixed values): an inverted-file index is magic "RKNN", then version, n, k, dims and 12 reserved
bytes; float32 centroids; k + 1 uint32 offsets; in version 2 a float32 radius a bucket; n uint8 labels; n uint32 ids;
n x dims int16 codes. A metric tree is the uint32 0x56505431, the size and 8 reserved bytes; then uint32 points,
float32 thresholds, int32 left and right children. Everything is little-endian; an index file may be gzipped.
"""

from __future__ import annotations

import gzip
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinity.functions.scratch import delete
from vicinity.functions.shipping import ship_package
from vicinity.operators.ivf import IvfIndex
from vicinity.operators.vptree import VpTree

MAGIC, TREE_MAGIC, HEADER = b"RKNN", 0x56505431, 32
#: Bytes of an index that goes into one file, by way of one machine's memory.
INTERCHANGE = 1 << 30


ROWS = "bucket INT, orig_id LONG, label INT, codes ARRAY<INT>, cell LONG"


def save_index(index: IvfIndex, folder: str, tasks: int | None = None) -> None:
    """Rows and the centroid table, as Parquet. Rows are bucketed by cell, so that searches needn't shuffle them."""
    spark = index.rows.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, name = index.cells().select("bucket", "orig_id", "label", "codes", "cell"), f"vicinity_{uuid.uuid4().hex}"
    delete(spark, f"{folder}/rows")
    dealt = rows.repartition(tasks, "cell").sortWithinPartitions("cell", "orig_id")
    dealt.write.bucketBy(tasks, "cell").sortBy("cell").option("path", f"{folder}/rows").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the catalog's entry only: the files are in a stated place
    meta = {"k": index.k, "dims": index.dims, "codec": index.codec, "tasks": tasks}
    table = index.centroids.withColumns({n: F.lit(v) for n, v in meta.items()})
    table.coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")


def load_index(spark: SparkSession, folder: str, codec: str | None = None) -> IvfIndex:
    """An index from ``save_index``; a codec other than the one asked for is an error."""
    table = spark.read.parquet(f"{folder}/centroids")
    meta = table.select("k", "dims", "codec", "tasks").first()
    if meta is None:
        raise ValueError("the index has no centroids")
    if codec and codec != meta["codec"]:
        raise ValueError(f"the index holds {meta['codec']} codes, not {codec}")
    name, place = f"vicinity_{uuid.uuid4().hex}", f"{folder}/rows".replace("'", "\\'")
    # Parquet files don't say that they are bucketed: the catalog is told, for as long as it takes to read from it
    spark.sql(f"CREATE TABLE {name} ({ROWS}) USING parquet CLUSTERED BY (cell) SORTED BY (cell) INTO {meta['tasks']} BUCKETS LOCATION '{place}'")
    rows = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return IvfIndex(rows, table.drop("k", "dims", "codec", "tasks"), meta["k"], meta["dims"], meta["codec"], meta["tasks"])


class IvfArrays(NamedTuple):
    centroids: np.ndarray
    offsets: np.ndarray
    radius: np.ndarray | None
    labels: np.ndarray
    ids: np.ndarray
    codes: np.ndarray


def encode_index(arrays: IvfArrays, version: int = 2, zipped: bool = True) -> bytes:
    n, (k, dims) = len(arrays.ids), arrays.centroids.shape
    parts = [struct.pack("<4s4I12x", MAGIC, version, n, k, dims), arrays.centroids.astype("<f4").tobytes(), arrays.offsets.astype("<u4").tobytes()]
    if version >= 2:
        parts.append(arrays.radius.astype("<f4").tobytes())
    parts += [arrays.labels.astype("u1").tobytes(), arrays.ids.astype("<u4").tobytes(), arrays.codes.astype("<i2").tobytes()]
    data = b"".join(parts)
    return gzip.compress(data) if zipped else data


def decode_index(data: bytes, dims: int | None = None) -> IvfArrays:
    """Checks the magic, version, dims and total length. Version 1 has no radius."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if len(data) < HEADER or data[:4] != MAGIC:
        raise ValueError("not an index file")
    version, n, k, d = struct.unpack_from("<4I", data, 4)
    if version not in (1, 2):
        raise ValueError(f"unknown version {version}")
    if dims is not None and d != dims:
        raise ValueError(f"{d} dims, not {dims}")
    sizes = [("<f4", k * d), ("<u4", k + 1), *([("<f4", k)] if version == 2 else []), ("u1", n), ("<u4", n), ("<i2", n * d)]
    found, at = [], HEADER
    for kind, count in sizes:
        if at + count * np.dtype(kind).itemsize > len(data):
            raise ValueError("the index file is cut short")
        found.append(np.frombuffer(data, kind, count, at))
        at += found[-1].nbytes
    if at != len(data):
        raise ValueError("the index file is too long")
    if version == 1:
        found.insert(2, None)
    if found[1][-1] != n:
        raise ValueError("the offsets don't end at the number of rows")
    return IvfArrays(found[0].reshape(k, d), *found[1:5], found[5].reshape(n, d))


def arrays_of(index: IvfIndex) -> IvfArrays:
    """An index's arrays, for interchange of one that fits a single machine: more than INTERCHANGE bytes are an error."""
    table = index.centroids.orderBy("bucket").toPandas()
    if table["n"].sum() * (2 * index.dims + 5) > INTERCHANGE:
        raise ValueError("the index is too large for one file: save_index writes it as a table")
    rows = index.rows.orderBy("bucket", "orig_id").toPandas()
    offsets = np.r_[0, np.cumsum(table["n"].to_numpy())]
    codes = np.array(rows["codes"].tolist()).reshape(len(rows), index.dims)
    return IvfArrays(np.array(table["centroid"].tolist()), offsets, table["radius"].to_numpy(), rows["label"].to_numpy(), rows["orig_id"].to_numpy(), codes)


def write_index_file(index: IvfIndex, folder: str, version: int = 2) -> None:
    """The index as one binary file in a folder, by the session's file system."""
    context = index.rows.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/index.bin")
    out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(encode_index(arrays_of(index), version)))
    finally:
        out.close()


def read_index_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, centroids) of binary index files, decoded by the tasks that read them; a file is one task."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("content")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (c for b in batches for c in b.column(0)):
            a = decode_index(content.as_buffer().to_pybytes())
            bucket = np.repeat(np.arange(len(a.centroids), dtype=np.int32), np.diff(a.offsets.astype(np.int64)))
            for i in range(0, len(a.ids), 10_000):
                part = slice(i, i + 10_000)
                codes = pa.FixedSizeListArray.from_arrays(pa.array(a.codes[part].astype(np.int32).ravel()), a.codes.shape[1]).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[part]), pa.array(a.ids[part].astype(np.int64)), pa.array(a.labels[part].astype(np.int32)), codes],
                    ["bucket", "orig_id", "label", "codes"],
                )

    def centroids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for content in (c for b in batches for c in b.column(0)):
            a = decode_index(content.as_buffer().to_pybytes())
            k, dims = a.centroids.shape
            radius = pa.nulls(k, pa.float64()) if a.radius is None else pa.array(a.radius.astype(np.float64))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(a.centroids.ravel()), dims).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(k, dtype=np.int32)), flat, radius, pa.array(np.diff(a.offsets.astype(np.int64)))],
                ["bucket", "centroid", "radius", "n"],
            )

    return (
        files.mapInArrow(rows, "bucket int, orig_id long, label int, codes array<int>"),
        files.mapInArrow(centroids, "bucket int, centroid array<float>, radius double, n long"),
    )


def encode_tree(tree: VpTree) -> bytes:
    """A tree with a node for each row (built with leaf = 1)."""
    if tree.leaf:
        raise ValueError("a tree with leaves of several rows has no binary form")
    head = struct.pack("<4I", TREE_MAGIC, tree.size, 0, 0)
    return head + b"".join(a.astype(t).tobytes() for a, t in ((tree.point, "<u4"), (tree.threshold, "<f4"), (tree.left, "<i4"), (tree.right, "<i4")))


def decode_tree(data: bytes) -> VpTree:
    magic, size = struct.unpack_from("<2I", data)
    if magic != TREE_MAGIC or len(data) != 16 + 16 * size:
        raise ValueError("not a tree file")
    point, threshold, left, right = (np.frombuffer(data, t, size, 16 + 4 * size * i) for i, t in enumerate(("<u4", "<f4", "<i4", "<i4")))
    return VpTree(point.astype(np.int64), point.astype(np.int64), threshold.astype(np.float64), left, right, {}, slack=1e-7)


def save_vectors(codes: DataFrame, path: str) -> None:
    """Quantized vectors and labels as a Parquet table."""
    codes.select("orig_id", "codes", "label").write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(orig_id, codes, label) from ``save_vectors``."""
    return spark.read.schema("orig_id long, codes array<int>, label int").parquet(path)
