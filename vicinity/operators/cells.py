"""The search kernel: queries meet the references of their cells, in a co-group.

A cell holds at most about ``CELL`` references, so that a task's memory is bounded; a bucket or a table with more of them
is cut into several cells by a hash of the id. A query is sent to each cell that it looks at. Cells meet about ``BLOCK``
queries at a time; beyond that, a cell's references are repeated once a block. Nothing passes through the driver.
Short vectors are compared by blocks of neighbours (``boxes``), others by matrix products.

References that were dealt out by cell before (an index that was saved, or warmed up) are read in place: only the queries
are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.functions.scalars import FLAT
from vicinity.functions.shipping import ship_package
from vicinity.operators.boxes import boxed
from vicinity.operators.topk import smallest, top_k

#: References of a cell, queries that a cell meets at once, and distances that are held at once.
CELL, BLOCK, MATRIX = 65536, 65536, 1 << 21
#: References up to which a cell is scanned whole.
PLAIN = 512
FOUND = "qid long, orig_id long, label int, dist long"
LISTED = "qid long, codes array<int>, cell long, tag int, hits array<struct<dist:bigint,orig_id:bigint,label:int>>"

Found = tuple[np.ndarray, np.ndarray, np.ndarray]
#: (reference codes, ids, k) -> a search of (query codes, ids to leave out or None[, greatest distances]) -> rows of (query, reference, distance).
Maker = Callable[[np.ndarray, np.ndarray, int], Callable[..., Found]]


def matrix(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def squared_distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """|q|^2 + |r|^2 - 2 q r; exact for integer codes, as every term is below 2^53."""
    return (q * q).sum(1)[:, None] + (r * r).sum(1)[None, :] - 2 * (q @ r.T)


def scan(refs: np.ndarray, ids: np.ndarray, k: int):
    """A search that compares the queries with all references, by matrix products."""

    def search(queries: np.ndarray, skip: np.ndarray | None, within: np.ndarray | None = None) -> Found:
        step, found = max(1, MATRIX // len(refs)), []
        for i in range(0, len(queries), step):
            d = squared_distances(queries[i : i + step], refs)
            if within is not None:
                d[d > within[i : i + step, None]] = np.inf
            if skip is not None:
                own = np.flatnonzero(np.isin(ids, skip[i : i + step]))
                d[:, own] = np.where(skip[i : i + step, None] == ids[own], np.inf, d[:, own])
            row, column = smallest(d, ids, k)
            found.append((row + i, column, d[row, column]))
        return tuple(map(np.concatenate, zip(*found)))

    return search


def pruned(refs: np.ndarray, ids: np.ndarray, k: int):
    """A search by blocks of neighbours where boxes tell much: many references, of few dims."""
    return (boxed if refs.shape[1] <= FLAT and len(refs) > PLAIN else scan)(refs, ids, k)


def chunk_of(key: Column, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(key), chunks)


def nearest(refs: DataFrame, queries: DataFrame, total: int, k: int, skip_self: bool = False, maker: Maker = pruned, tasks: int | None = None, listed: bool = False) -> DataFrame:
    """(qid, orig_id, label, dist): the k best of each cell that a query looks at.

    ``listed``: (qid, codes, cell, tag, hits) instead, a row for a query and a cell in which it finds any, with its hits in order;
    queries have a column ``tag`` (int).

    ``refs``: (cell long, orig_id, label, codes); ``queries``: (cell long, qid, codes), a row for each cell, of ``total``
    queries; a column ``within`` (double) leaves out what is farther. ``skip_self`` leaves out the reference with the
    query's id. ``tasks``: into how many parts the references are dealt out by cell, if they are.
    """
    ship_package(refs.sparkSession)
    refs = refs.select("cell", "orig_id", F.col("label").cast("int"), "codes")
    # names of its own: a co-group loses columns that both sides have from one table
    bounded = "within" in queries.columns
    queries = queries.select(F.col("cell").alias("at"), F.col("qid").alias("asked"), F.col("codes").alias("sought"), *([F.col("within").alias("most")] if bounded else []), *(["tag"] if listed else []))
    by, at = ["cell"], ["at"]
    # a row for each cell that is asked too much, of which there are as many as the index has at most
    hot = [] if total <= BLOCK else queries.groupBy("at").count().where(F.col("count") > BLOCK).collect()
    if hot:
        blocks = refs.sparkSession.createDataFrame([(r["at"], -(-r["count"] // BLOCK)) for r in hot], "hot long, blocks long")
        several = F.coalesce("blocks", F.lit(1).cast("long"))
        queries = queries.join(F.broadcast(blocks), F.col("at") == F.col("hot"), "left").withColumn("part", chunk_of(F.col("asked"), several)).drop("hot", "blocks")
        refs = refs.join(F.broadcast(blocks), F.col("cell") == F.col("hot"), "left")
        refs = refs.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), several - 1))).drop("hot", "blocks")
        by, at = ["cell", "block"], ["at", "part"]

    hit = pa.struct([("dist", pa.int64()), ("orig_id", pa.int64()), ("label", pa.int32())])
    if listed:
        nothing = pa.schema([("qid", pa.int64()), ("codes", pa.list_(pa.int32())), ("cell", pa.int64()), ("tag", pa.int32()), ("hits", pa.list_(hit))]).empty_table()
    else:
        nothing = pa.schema([("qid", pa.int64()), ("orig_id", pa.int64()), ("label", pa.int32()), ("dist", pa.int64())]).empty_table()

    def meet(refs: pa.Table, queries: pa.Table) -> pa.Table:
        if not refs.num_rows or not queries.num_rows:
            return nothing
        ids, labels, asked = refs["orig_id"].to_numpy(), refs["label"].to_numpy(), queries["asked"].to_numpy()
        limits = [queries["most"].to_numpy()] if bounded else []
        row, column, d = maker(matrix(refs["codes"]), ids, k)(matrix(queries["sought"]), asked if skip_self else None, *limits)
        hits = {"dist": pa.array(d.astype(np.int64)), "orig_id": pa.array(ids[column]), "label": pa.array(labels[column].astype(np.int32))}
        if not listed:
            return pa.table({"qid": asked[row], **{name: hits[name] for name in ("orig_id", "label", "dist")}})
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
        some = row[starts]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)].astype(np.int32)), pa.StructArray.from_arrays(list(hits.values()), list(hits)))
        return pa.table({"qid": asked[some], "codes": queries["sought"].take(pa.array(some)), "cell": np.full(len(some), refs["cell"][0].as_py()), "tag": queries["tag"].take(pa.array(some)), "hits": lists})

    # dealt out by number, so that few bytes of much work aren't put together in one task
    queries = queries.repartition(tasks or int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), *at)
    return refs.groupBy(*by).cogroup(queries.groupBy(*at)).applyInArrow(meet, LISTED if listed else FOUND)


def all_pairs(refs: DataFrame, queries: DataFrame, k: int, skip_self: bool = False, maker: Maker = pruned, cell: int = CELL) -> DataFrame:
    """(qid, rank, orig_id, label, dist): each query's k nearest of all references, which are cut into cells by a hash."""
    n, tasks = refs.count(), int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(-(-n // cell), min(tasks, -(-n // 512)), 1)
    dealt = refs.withColumn("cell", chunk_of(F.col("orig_id"), F.lit(chunks).cast("long")))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))
    found = nearest(dealt, queries.select("qid", "codes", every.alias("cell")), queries.count(), k, skip_self, maker)
    return top_k(found, "qid", k, "dist", "orig_id")
