"""Near copies of texts: links of texts whose five-word shingle sets have a Jaccard similarity of ``SIMILAR`` or more.

SimHash: fingerprints of the shingles within 4 bits are linked by complete keys (``simhash.links``), and a group of them
is a bucket of candidates, in which every similar pair is linked. Texts at similarity 0.8 differ by more bits:

More candidates: a text has ``BANDS`` keys, each of ``ROWS`` MinHash values of its shingles, and two texts that share a key
meet. A pair at similarity 0.8 shares one with a probability of 0.998, a pair at 0.9 practically always; at that
similarity 64-bit SimHash fingerprints differ by about 10 bits, for which no complete set of keys is practical.

Within a bucket, texts stand in the order of their SimHash fingerprints of the same shingles, and each is verified against
the ``WINDOW`` texts before it whose fingerprints are within ``RADIUS`` bits, by the Jaccard similarity of their shingles.
That links most near copies, with some n pairs for a group of n. Buckets in which texts of several groups remain are then
settled inside the tasks that hold them, by a prefix filter: two texts at similarity 0.8 share one of the rarest fifth of
the shingles of each, so a passage that many texts share makes no candidates. Only links that join groups are returned.
No pair that could change a group is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import as_bytes, bounded_batches, drop_written, map_arrow, written
from vicinity.llm.components import components
from vicinity.llm import simhash
from vicinity.llm.simhash import NO_ID, one_of_each

#: Words of a shingle and the similarity of a near copy: the rule for stages without a contract.
SHINGLE, SIMILAR = 5, 0.8
#: Keys of a text and MinHash values of a key; bits that differ at most in a candidate pair.
BANDS, ROWS, RADIUS = 12, 4, 22
#: Texts before it that a text is verified against at first, and texts of a chunk of a large bucket.
WINDOW, CELL = 4, 2048
#: Shingles at most that a chunk is aimed at.
CELL_SHINGLES = 1 << 18
#: Shingles handled at once.
BLOCK = 1 << 14

_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(1 << 62, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes) -> set[tuple[bytes, ...]]:
    """The text's distinct shingles of lower-cased words; fewer than five words make one, and no word none."""
    words = text.lower().split()
    return set(zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else {tuple(words)} - {()}


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity of the shingle sets; 1 of two texts without a word."""
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def sketch(text: bytes) -> tuple[int, np.ndarray]:
    """(fingerprint, keys) of a text; those of all texts without a word are equal."""
    words = text.lower().split()
    size = min(SHINGLE, len(words))
    total = len(words) - size + 1 if words else 0
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[i:] for i in range(size)))), repeat(42))
    ones, least = np.zeros(64, np.int64), np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for start in range(0, total, BLOCK):
        some = np.fromiter(hashes, np.uint64, min(BLOCK, total - start))
        ones += np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        for i in range(0, len(some), 512):
            part = some[i : i + 512, None] * _FACTORS + _OFFSETS
            np.minimum(least, part.min(axis=0), out=least)
    keys = [xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.astype("<u8").reshape(BANDS, ROWS))]
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0]), np.array(keys, np.uint64)


def hashed(text: bytes) -> np.ndarray:
    """The distinct shingles as ascending 64-bit hashes; one of its own for a text without a word."""
    words = text.lower().split()
    size = min(SHINGLE, len(words))
    parts = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64)) if size else np.zeros(1, np.uint64)


def neighbours(buckets: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of texts and those up to WINDOW places before them in a bucket, within RADIUS bits.

    ``buckets`` are numbered in order, so that equal ones stand together.
    """
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for gap in range(1, WINDOW + 1):
        near = (buckets[gap:] == buckets[:-gap]) & (np.bitwise_count(fps[gap:] ^ fps[:-gap]) <= RADIUS)
        right.append(np.flatnonzero(near))
        left.append(right[-1] + gap)
    return np.concatenate(left), np.concatenate(right)


def joining(roots: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) of similar texts of different groups that join these groups; ``sets`` are ascending hashes, not empty.

    Against every text before it a text has candidates: those that share one of the rarest of its shingles, of which it
    needs n - ceil(0.8 n) + 1, counted among these texts. Candidates of the same group by now are passed over.
    """
    lengths = np.array([len(x) for x in sets], np.int64)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(sets)), lengths)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((token, count[token], owner))
    needed = lengths - np.ceil(SIMILAR * lengths - 1e-9).astype(np.int64) + 1
    prefix = order[np.arange(len(order)) - starts[owner] < needed[owner]]
    prefix = prefix[count[token[prefix]] > 1]
    by = np.argsort(token[prefix], kind="stable")  # owners rise within a shingle
    held, tokens = owner[prefix][by], token[prefix][by]
    mine = np.searchsorted(owner[prefix], np.arange(len(sets) + 1))
    first, last = (np.searchsorted(tokens, token[prefix], side) for side in ("left", "right"))
    parent = {int(r): int(r) for r in roots}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    group = np.array([find(int(r)) for r in roots])
    out, inside = [], np.zeros(len(count), bool)
    for i in range(len(sets)):
        found = [held[lo:hi] for lo, hi in zip(first[mine[i] : mine[i + 1]].tolist(), last[mine[i] : mine[i + 1]].tolist())]
        some = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        some = some[some < i]
        some = some[(group[some] != group[i]) & (np.minimum(lengths[some], lengths[i]) >= SIMILAR * np.maximum(lengths[some], lengths[i]) - 1e-9)]
        if not len(some):
            continue
        inside[token[starts[i] : starts[i] + lengths[i]]] = True
        for j in some.tolist():
            if group[j] == group[i]:
                continue
            both = int(np.count_nonzero(inside[token[starts[j] : starts[j] + lengths[j]]]))
            if both >= SIMILAR * (lengths[i] + lengths[j] - both):
                out.append((i, j))
                a, b = sorted((find(int(group[i])), find(int(group[j]))))
                parent[b] = a
                group[group == b] = a
        inside[token[starts[i] : starts[i] + lengths[i]]] = False
    return out


def sketched(texts: DataFrame) -> DataFrame:
    """(node, fp, n, keys) of each distinct node, written; ``n`` is about its number of shingles."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(t, *sketch(t)) for t in as_bytes(batch.column(1))]
        fps = np.array([f for _, f, _ in found], np.uint64).view(np.int64)
        sizes = pa.array([1 + t.count(b" ") for t, _, _ in found], pa.int64())
        keys = pa.array([k.view(np.int64) for _, _, k in found], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), sizes, keys], ["node", "fp", "n", "keys"])

    rows = map_arrow(texts.select("node", "text"), each, "node long, fp long, n long, keys array<long>")
    return written(rows.dropDuplicates(["node"]), "sketches")


def simhash_keyed(sketches: DataFrame) -> DataFrame:
    """``sketches`` with one key more, written: that of the group of fingerprints within ``simhash.RADIUS`` bits."""
    fps = written(sketches.select("fp").distinct(), "near-fps")
    groups = components(simhash.links(fps)).select(F.col("u").alias("fp"), F.col("root").alias("group"))
    key = F.xxhash64(F.coalesce("group", "fp"), F.lit("simhash"))
    keyed = sketches.join(groups, "fp", "left").select("node", "fp", "n", F.concat(F.array(key), F.col("keys")).alias("keys"))
    keyed = written(keyed, "sketches")
    drop_written(fps, sketches)
    return keyed


def candidates(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Distinct pairs (u, v), u < v, of nodes to verify at first.

    ``rows``: (key, fp, node); ``sizes``: (key, count) of buckets above WINDOW + 1 texts. One of more than CELL is dealt
    out in chunks.
    """
    large = sizes.where(F.col("count") > CELL).select("key", F.ceil(F.col("count") / CELL).alias("chunks"))
    chunk = F.coalesce(F.pmod(F.xxhash64("node"), F.col("chunks")), F.lit(0)).alias("cell")
    placed = rows.join(large, "key", "left").select("key", chunk, "fp", "node")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(tasks, "key", "cell").sortWithinPartitions("key", "cell", "fp", "node")

    def flush(table: np.ndarray) -> pa.RecordBatch:
        bucket = np.cumsum(np.r_[0, np.any(table[1:, :2] != table[:-1, :2], axis=1)])
        i, j = neighbours(bucket, table[:, 2].copy().view(np.uint64))
        a, b = table[i, 3], table[j, 3]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)
        for batch in batches:
            if batch.num_rows:
                table = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)])
                yield flush(table)
                held = table[-WINDOW:]  # pairs among these come twice
        yield flush(held[:0])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs whose texts are similar, written."""
    # written, so that the joins can split a text with very many partners
    pairs = written(pairs, "near-pairs")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    few = written(texts.select("node", "text").join(ends, "node", "left_semi").dropDuplicates(["node"]), "near-texts")
    both = pairs.join(few.withColumnsRenamed({"node": "u", "text": "a"}), "u").join(few.withColumnsRenamed({"node": "v", "text": "b"}), "v")
    bounded_batches(texts.sparkSession)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(a, b) >= SIMILAR for a, b in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    found = written(both.select("u", "v", "a", "b").mapInArrow(verify, "u long, v long"), "near-links")
    drop_written(pairs, few)
    return found


def settled(texts: DataFrame, rows: DataFrame, sizes: DataFrame, stars: DataFrame) -> DataFrame:
    """(u, v) of near copies that join the groups which are left in the same buckets, written.

    Of a bucket's texts those of its largest group needn't meet each other. The others are cut into chunks; a task holds
    one of them with a chunk of that group, or two of them.
    """
    left = rows.join(sizes.select("key"), "key").join(stars.withColumnRenamed("u", "node"), "node", "left")
    left = left.select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    per = left.groupBy("key", "root").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    top = F.max_by(F.struct("root", "count", "n"), F.struct("count", "root"))
    # those of one group are done
    mixed = per.groupBy("key").agg(top.alias("top"), F.sum("count").alias("count"), F.sum("n").alias("n")).where(F.col("count") > F.col("top.count"))
    chunks = lambda count, n: F.greatest(F.ceil(count / CELL), F.ceil(n / CELL_SHINGLES), F.lit(1)).cast("long")
    mixed = written(
        mixed.select(
            "key", F.col("top.root").alias("top"), chunks(F.col("top.count"), F.col("top.n")).alias("most"),
            chunks(F.col("count") - F.col("top.count"), F.col("n") - F.col("top.n")).alias("others"),
        ),
        "near-mixed",
    )
    if mixed.isEmpty():
        drop_written(mixed)
        return written(stars.select("u", F.col("root").alias("v")).limit(0), "near-links")
    left = left.join(mixed, "key")
    zero, width = F.lit(0).cast("long"), F.col("most") + F.col("others")
    mine = F.pmod(F.xxhash64("node"), F.when(F.col("root") == F.col("top"), F.col("most")).otherwise(F.col("others")))
    left = left.withColumn("mine", mine)
    upto = lambda n: F.sequence(zero, n - 1)
    of_top = F.transform(upto(F.col("others")), lambda i: i * width + F.col("others") + F.col("mine"))
    with_top = F.transform(upto(F.col("most")), lambda j: F.col("mine") * width + F.col("others") + j)
    pairs = F.transform(
        F.filter(upto(F.col("others")), lambda i: i != F.col("mine")), lambda i: F.least(i, F.col("mine")) * width + F.greatest(i, F.col("mine"))
    )
    cells = F.when(F.col("root") == F.col("top"), of_top).otherwise(F.concat(with_top, pairs))
    placed = written(left.select("node", "key", "root", F.explode(cells).alias("cell")), "near-places")
    bounded_batches(texts.sparkSession)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([hashed(t).view(np.int64) for t in as_bytes(batch.column(1))], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), found], ["node", "shingles"])

    few = texts.select("node", "text").join(placed.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    sets = written(few.mapInArrow(lambda batches: map(each, batches), "node long, shingles array<long>"), "near-sets")
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.join(sets, "node").repartition(tasks, "key", "cell").sortWithinPartitions("key", "cell", "node")

    def meet(held: list[tuple]) -> pa.RecordBatch:
        nodes, roots = np.array([h[2] for h in held], np.int64), np.array([h[3] for h in held], np.int64)
        found = joining(roots, [h[4] for h in held]) if len(held) > 1 else []
        a, b = (nodes[np.array([f[x] for f in found], np.int64)] for x in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            plain = [c.to_pylist() for c in batch.columns[:4]]
            for row in zip(*plain, batch.column(4)):
                if held and held[-1][:2] != row[:2]:
                    yield meet(held)
                    held = []
                held.append((*row[:4], row[4].values.to_numpy().view(np.uint64)))
        yield meet(held)

    found = written(dealt.select("key", "cell", "node", "root", "shingles").mapInArrow(run, "u long, v long").distinct(), "near-links")
    drop_written(mixed, placed, sets)
    return found


def linked(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, stars): (u, v) of near copies that span every group, and (u, root) of the groups.

    ``texts`` has nodes, each with one text, and may repeat them; a null text is empty.
    """
    sketches = simhash_keyed(sketched(texts))
    rows = sketches.select(F.explode("keys").alias("key"), "fp", "n", "node")
    sizes = written(rows.groupBy("key").count().where(F.col("count") > WINDOW + 1), "near-buckets")
    found = verified(texts, candidates(rows, sizes))
    stars = written(components(found), "near-stars")
    more = settled(texts, rows, sizes, stars)
    if not more.isEmpty():
        stars = written(components(stars.withColumnRenamed("root", "v").union(more)), "near-stars")
    drop_written(sketches, sizes)
    return found.union(more), stars


def links(texts: DataFrame) -> DataFrame:
    """(u, v) of near copies, as ``linked``."""
    return linked(texts)[0]


def rooted(texts: DataFrame) -> DataFrame:
    """(node, root) of every distinct node: near copies, and what near copies link, have one root."""
    stars = linked(texts)[1].withColumnRenamed("u", "node")
    return texts.select("node").distinct().join(stars, "node", "left").withColumn("root", F.coalesce("root", "node"))


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: the smallest doc_id (nulls last), then the smallest text hash.

    Texts without a word are one group. Keeps all columns. Where rows repeat in both, one stays.
    """
    node = F.xxhash64("text").alias("node")
    least = docs.select(node, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id")).groupBy("node").agg(F.min("id").alias("id"))
    roots = written(rooted(docs.select(node, "text")), "near-roots")
    places = least.join(roots, "node").select("root", F.struct("id", F.col("node").alias("hash")).alias("place"))
    return one_of_each(docs, places.groupBy("root").agg(F.min("place").alias("place")))
