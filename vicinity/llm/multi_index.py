"""Approximate nearest neighbours with an inverted multi-index (Babenko and Lempitsky, 2012).

The two halves of a vector are quantised separately, by K centroids each, so that K * K cells are told apart. A query
walks the centroid pairs by rising summed distance with a heap (the multi-sequence algorithm) until the cells hold a
share of all rows; those rows are ranked by the exact inner product of the original vectors. The distance of a half to a
centroid is the negative inner product, as nearness is the inner product.

The share is not guessed: a bounded sample of the queries is compared with all rows by brute force, and the share is the
smallest at which they would find ``RECALL`` of their true neighbours. On vectors without structure it is large.

Every row is indexed. The centroids are fitted on a bounded sample. Rows of neighbouring cells are put into blocks of
bounded size (a cell with too many rows is several blocks), and a query is sent to the blocks that hold a cell it
reaches: an equi-join on the block, in which each block keeps its k best of each query. Blocks that no query reaches are
not compared. Only the centroids, the cells' counts and the few calibrating queries are broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinity.llm.common import bounded_batches, written

#: Rows at most that the centroids are fitted on, rounds of k-means, rows aimed at in a cell, centroids of a half at most.
FIT_ROWS, ROUNDS, PER_CELL, CENTROIDS = 20_000, 12, 40, 256
#: Queries that set the share, and the recall that they must reach.
CALIBRATE, RECALL = 256, 0.96
#: Bytes at most of the rows that the centroids are fitted on, of a block's rows, and of the queries that it meets at once.
FIT_BYTES, BLOCK_BYTES, ASKED_BYTES = 32 << 20, 8 << 20, 16 << 20
#: Distances that a task holds at once, and pairs that a walk takes from its heap one by one.
MATRIX, STEPS = 1 << 21, 2000
K = 20


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>): rows with an id and a vector of finite components that are not all 0."""
    e = F.col("embedding").cast("array<double>")
    fine = (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long"), e.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))
    )


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows; a centroid without rows stays where it is."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        count = np.bincount(near, minlength=k)
        for j in np.flatnonzero(count):
            centres[j] = x[near == j].mean(axis=0)
    return centres


class Index:
    """Centroids of both halves and the number of rows in each cell."""

    def __init__(self, sample: np.ndarray, rows: int):
        self.rows, self.dims = rows, sample.shape[1]
        self.half = max(1, self.dims // 2)
        k = int(min(CENTROIDS, len(sample), max(2, (rows / PER_CELL) ** 0.5)))
        self.left = _kmeans(sample[:, : self.half], k)
        self.right = _kmeans(sample[:, self.half :], k) if self.dims > 1 else np.zeros((1, 0))
        self.counts = np.zeros((len(self.left), len(self.right)), np.int64)
        self.first, self.chunks = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def lay_out(self) -> None:
        """Gives each cell its first block and the number of its blocks; small cells share a block with the ones before."""
        room, counts = max(1, BLOCK_BYTES // (8 * self.dims)), self.counts.ravel()
        self.chunks = np.maximum(1, -(-counts // room))
        self.first, block, held = np.zeros(len(counts), np.int64), 0, 0
        for c, n in enumerate(counts.tolist()):
            if held and held + n > room:
                block, held = block + 1, 0
            self.first[c] = block
            if n > room:
                block, held = block + int(self.chunks[c]), 0
            else:
                held += n

    def blocks(self, cells: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """The blocks of rows in these cells; ``spread`` deals the rows of a large cell out."""
        return self.first[cells] + spread % self.chunks[cells]

    def within(self, left: np.ndarray, right: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Whether each query's walk reaches each cell that has rows: a matrix of queries x cells."""
        near = left[:, :, None] + right[:, None, :] <= _far(reach)[:, None, None]
        return near.reshape(len(left), -1) & (self.counts.ravel() > 0)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = x[:, : self.half], x[:, self.half :]
        near = [np.argmin((c**2).sum(1) - 2 * h @ c.T, axis=1) for h, c in ((a, self.left), (b, self.right))]
        return near[0] * len(self.right) + near[1]

    def halves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of the queries' halves to the centroids."""
        return -q[:, : self.half] @ self.left.T, -q[:, self.half :] @ self.right.T

    def walk(self, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(summed distance, left, right) of the centroid pairs, nearest first: the multi-sequence algorithm."""
        a, b = np.argsort(left, kind="stable").tolist(), np.argsort(right, kind="stable").tolist()
        x, y = left[a].tolist(), right[b].tolist()
        heap, reached = [(x[0] + y[0], 0, 0)], [0] * len(a)
        while heap:
            d, i, j = heapq.heappop(heap)
            yield d, a[i], b[j]
            reached[i] = j + 1
            # (i, j) opens its two neighbours once the pairs before them in their rows have been passed
            if i + 1 < len(a) and reached[i + 1] == j:
                heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
            if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))

    def reach(self, left: np.ndarray, right: np.ndarray, wanted: float) -> float:
        """Summed distance at which the walk has passed ``wanted`` rows.

        After ``STEPS`` pairs the rest is sorted at once: the same order and the same distance, in less time.
        """
        seen, d = 0, float("inf")
        for step, (d, i, j) in enumerate(self.walk(left, right)):
            seen += int(self.counts[i, j])
            if seen >= wanted:
                return d
            if step >= STEPS:
                sums = (left[:, None] + right[None, :]).ravel()
                order = np.argsort(sums, kind="stable")
                at = np.searchsorted(np.cumsum(self.counts.ravel()[order]), wanted)
                return float(sums[order[min(int(at), len(order) - 1)]])
        return d


class Best:
    """The k best rows of each query so far, by exact score and then by id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.found = np.zeros((0, 2), np.int64)  # query's place, vec_id
        self.scores = np.zeros(0)
        self.least = np.full(len(ids), -np.inf)

    def add(self, vec_ids: np.ndarray, x: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: queries x rows from a matrix product, -inf where a query doesn't look; used to choose only."""
        own = np.flatnonzero(np.isin(vec_ids, self.ids))
        scores[np.ix_(np.arange(len(self.ids)), own)] = np.where(self.ids[:, None] == vec_ids[own], -np.inf, scores[:, own])
        floor = self.least
        if scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k])
        slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)))
        q, v = np.nonzero((scores >= (floor - slack)[:, None]) & (scores > -np.inf))
        exact = np.concatenate([
            (self.queries[q[i : i + 65536]] * x[v[i : i + 65536]]).sum(axis=1) for i in range(0, len(q), 65536)
        ] or [np.zeros(0)])
        found = np.concatenate([self.found, np.stack([q, vec_ids[v]], axis=1)])
        both = np.concatenate([self.scores, exact])
        order = np.lexsort((found[:, 1], -both, found[:, 0]))
        found, both = found[order], both[order]
        place = np.arange(len(found)) - np.searchsorted(found[:, 0], found[:, 0])
        keep = place < self.k
        self.found, self.scores = found[keep], both[keep]
        last = place[keep] == self.k - 1
        self.least[self.found[last, 0]] = self.scores[last]


def _far(reach: np.ndarray) -> np.ndarray:
    """A reach with room for the rounding of matrix products of other shapes."""
    return reach + 1e-9 * (1 + np.abs(reach))


def _spare_copies(vec_ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows that can matter: of equal vectors, k rows of each of the k + 1 smallest ids, as a query leaves out one id."""
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort((vec_ids, same))
    ids, same = vec_ids[order], same[order]
    fresh = np.r_[True, same[1:] != same[:-1]]
    other = fresh | np.r_[True, ids[1:] != ids[:-1]]
    number = np.cumsum(other)  # of the (vector, id) pair
    place = np.arange(len(order)) - np.flatnonzero(other)[number - 1]
    rank = number - number[fresh][np.cumsum(fresh) - 1]
    return np.sort(order[(place < k) & (rank <= k)])


def _compared(rows: DataFrame, index: Index, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score, cell): each task's k best rows for a few queries, of all rows, read in place."""
    dims = index.dims
    few = rows.sparkSession.sparkContext.broadcast((ids, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = few.value
        best, cell_of = Best(ids, queries, k), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vec_ids, cells, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), dims)
            keep = _spare_copies(vec_ids, x, k)
            vec_ids, cells, x = vec_ids[keep], cells[keep], x[keep]
            best.add(vec_ids, x, queries @ x.T)
            cell_of |= zip(vec_ids.tolist(), cells.tolist())
            if len(cell_of) > 100_000:
                cell_of = {v: cell_of[v] for v in np.unique(best.found[:, 1]).tolist()}
        found = best.found
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[found[:, 0]]), pa.array(found[:, 1]), pa.array(best.scores), pa.array([cell_of[v] for v in found[:, 1].tolist()], pa.int64())],
            ["query_id", "vec_id", "score", "cell"],
        )

    return rows.select("vec_id", "cell", "embedding").mapInArrow(run, "query_id long, vec_id long, score double, cell long")


def _met(rows: DataFrame, asked: DataFrame, index: Index, most: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block for the queries that reach it.

    ``rows``: (vec_id, cell, block, embedding); ``asked``: (at, query_id, reach, sought), a row for each block; ``most``:
    how many queries reach one block. More than ASKED_BYTES hold meet copies of the block.
    """
    shared, dims = rows.sparkSession.sparkContext.broadcast(index), index.dims
    room, by, at = max(1, ASKED_BYTES // (8 * dims)), ["block"], ["at"]
    rows = rows.select("block", "vec_id", "cell", "embedding")
    if most > room:
        parts = F.lit(-(-most // room)).cast("long")
        asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), parts))
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        by, at = ["block", "copy"], ["at", "part"]

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found, width = [], len(shared.value.right)
        if rows.num_rows and asked.num_rows:
            vec_ids, cells, x = rows["vec_id"].to_numpy(), rows["cell"].to_numpy(), _matrix(rows["embedding"].combine_chunks(), dims)
            keep = _spare_copies(vec_ids, x, k)
            vec_ids, cells, x = vec_ids[keep], cells[keep], x[keep]
            ids, reach, queries = asked["query_id"].to_numpy(), asked["reach"].to_numpy(), _matrix(asked["sought"].combine_chunks(), dims)
            step = max(1, MATRIX // len(x))
            for i in range(0, len(ids), step):
                part = queries[i : i + step]
                left, right = shared.value.halves(part)
                scores = part @ x.T
                scores[left[:, cells // width] + right[:, cells % width] > _far(reach[i : i + step])[:, None]] = -np.inf
                best = Best(ids[i : i + step], part, k)
                best.add(vec_ids, x, scores)
                found.append((best.ids[best.found[:, 0]], best.found[:, 1], best.scores))
        columns = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns)))

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.repartition(tasks, *at)  # dealt out by number: few bytes may be much work
    return rows.groupBy(*by).cogroup(asked.groupBy(*at)).applyInArrow(meet, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build(vectors: DataFrame) -> tuple[DataFrame, Index | None]:
    """The index: all usable rows as (vec_id, cell, spread, embedding), written once, and the centroids."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.col("count").desc(), "dims").first()
    if sizes is None:
        return rows.withColumn("cell", F.lit(0).cast("long")), None
    dims, total = sizes["dims"], sizes["count"]
    rows = rows.where(F.size("embedding") == dims)
    # in a stated order, so that the centroids don't depend on how the table is split
    most = max(2, min(FIT_ROWS, FIT_BYTES // (8 * dims)))
    by = F.xxhash64("vec_id", "embedding", F.lit("multi-index"))
    u = F.shiftrightunsigned(by, 11) / F.lit(float(1 << 53))
    sample = rows.where(u < F.lit(2.0 * most / total)).select(by.alias("by"), "embedding").orderBy("by", "embedding").limit(most)
    taught = _matrix(sample.select("embedding").toArrow()["embedding"].combine_chunks(), dims)
    index = Index(taught, total)
    shared = spark.sparkContext.broadcast(index)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            if batch.num_rows:
                cells = shared.value.cells(_matrix(batch.column(1), dims)).astype(np.int64)
                spread = pa.array(np.arange(at, at + batch.num_rows))  # running numbers deal equal rows out, too
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells), spread, batch.column(1)], ["vec_id", "cell", "spread", "embedding"])

    table = written(rows.mapInArrow(place, "vec_id long, cell long, spread long, embedding array<double>"), "multi-index")
    for r in table.groupBy("cell").count().collect():  # at most CENTROIDS squared rows
        index.counts[divmod(r.cell, len(index.right))] = r["count"]
    index.lay_out()
    return table, index


def _share(table: DataFrame, index: Index, queries: DataFrame, k: int) -> float:
    """The share of all rows to walk, from a bounded sample of the queries and brute force."""
    some = queries.orderBy(F.xxhash64("vec_id", F.lit("calibrate")), "vec_id").limit(CALIBRATE).collect()
    ids, vectors = np.array([r.vec_id for r in some], np.int64), np.array([r.embedding for r in some], np.float64)
    left, right = index.halves(vectors)
    place = {q: i for i, q in enumerate(ids.tolist())}
    needed = []
    cells: dict[int, list[int]] = {}
    for r in _ranked(_compared(table, index, ids, vectors, k), k).collect():
        cells.setdefault(place[r.query_id], []).append(r.cell)
    for q, wanted in cells.items():
        seen, left_over, at = 0, set(wanted), {}
        for _, i, j in index.walk(left[q], right[q]):
            seen += int(index.counts[i, j])
            cell = i * len(index.right) + j
            if cell in left_over:
                at[cell] = seen
                left_over.discard(cell)
                if not left_over:
                    break
        needed += [at[c] for c in wanted]
    return float(np.quantile(needed, RECALL, method="higher")) / index.rows if needed else 1.0


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, nearest first, ties to the smaller vec_id.

    ``queries`` has the columns of ``vectors`` (vec_id, embedding). Vectors that are null, all 0, or hold a null or
    non-finite component take no part, nor do rows without an id or of another length than the most frequent one. A
    query isn't its own neighbour, nor is a row with its id; a repeated query counts once, a repeated row as often as it
    stands there. Fewer rows than k give all of them; an empty table gives no row. Other columns are not read.
    """
    spark = vectors.sparkSession
    table, index = build(vectors)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if index is None:
        return empty
    asked = usable(queries).where(F.size("embedding") == index.dims).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = written(asked, "queries")
    total = asked.count()
    if not total:
        return empty
    wanted = _share(table, index, asked, k) * index.rows
    shared = spark.sparkContext.broadcast(index)

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        step = max(1, MATRIX // index.counts.size)
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                left, right = index.halves(_matrix(part.column(1), index.dims))
                reach = np.array([index.reach(a, b, wanted) for a, b in zip(left, right)])
                row, cell = np.nonzero(index.within(left, right, reach))
                # a query's blocks: those of its cells, each once
                chunk = index.chunks[cell]
                row, cell = np.repeat(row, chunk), np.repeat(cell, chunk)
                block = index.first[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(chunk) - chunk, chunk)
                row, block = np.unique(np.stack([row, block]), axis=1)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block), part.column(0).take(at), pa.array(reach[row]), part.column(1).take(at)], ["at", "query_id", "reach", "sought"]
                )

    aimed = asked.repartition(F.xxhash64("vec_id")).mapInArrow(aim, "at long, query_id long, reach double, sought array<double>")
    aimed = written(aimed, "aimed")
    most = aimed.groupBy("at").count().agg(F.max("count")).first()[0]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                block = shared.value.blocks(batch.column(1).to_numpy(), batch.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(block), batch.column(3)], ["vec_id", "cell", "block", "embedding"])

    rows = table.select("vec_id", "cell", "spread", "embedding").mapInArrow(put, "vec_id long, cell long, block long, embedding array<double>")
    ranked = _ranked(_met(rows, aimed, index, most, k), k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op9_nearest(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))
