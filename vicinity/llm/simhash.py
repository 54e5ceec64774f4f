"""SimHash near-duplicate groups by bit-sliced comparison.

A document's fingerprint takes, for each of 64 bits, the majority of its 4-word shingles' XXH64 values (seed 42).
Fingerprints within ``RADIUS`` bits are linked, and components of links are the groups.

Candidates: the 64 bits are cut into 6 runs, or 7 or 8 for very many documents. Two fingerprints that differ in at most
RADIUS = 4 bits agree on at least 2 of 6 runs (3 of 7, 4 of 8), so they meet under a key: no link is lost. Within a
bucket the fingerprints are compared in vertical form: plane k holds bit k of 64 candidates in a word, differences are
counted by carry-save adders over whole words, and a word whose 64 candidates have all passed the radius is abandoned.
Only distinct fingerprints are compared, and each bucket gives a spanning forest, never all pairs. A bucket above
``CELL`` fingerprints is cut into chunks that meet pairwise in cells of bounded size, so no task holds an unbounded one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import as_bytes, documents, map_arrow, written
from vicinity.llm.components import components

RADIUS, SHINGLE, SEED, CELL, BUCKET = 4, 4, 42, 32768, 64
#: Stands for a null doc_id in a key; with the text's hash beside it, a real id of this value does no harm.
NO_ID = (1 << 63) - 1
#: Planes after which words are looked at for abandonment.
CHECKPOINTS = (16, 24, 32, 40, 48)
#: (query, word) comparisons and fingerprints handled at once.
LANES, GROUP = 8192, 65536


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of UTF-8 text; 0 if it has no word. Fewer than 4 words make one shingle."""
    words = text.lower().split()
    if not words:
        return 0
    n, totals, count = 1 << 16, np.zeros(64, np.int64), 0
    if len(words) < SHINGLE:
        shingles, total = iter([b" ".join(words)]), 1
    else:
        shingles, total = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))), len(words) - SHINGLE + 1
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    while count < total:
        some = np.fromiter(hashes, np.uint64, min(n, total - count))
        count += len(some)
        bits = np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for i in range(0, len(bits), 255 * 64):
            part = bits[i : i + 255 * 64]
            whole = len(part) // 255 * 255
            if whole:
                totals += part[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            totals += part[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(totals * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, text_hash long) of every row of ``docs``; a null text counts as empty."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t) for t in as_bytes(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), batch.column(2)], ["doc_id", "fp", "text_hash"])

    return map_arrow(
        docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")), each, "doc_id long, fp long, text_hash long"
    )


def _planes(fps: np.ndarray) -> np.ndarray:
    """Vertical form: [k, w] has bit k of fingerprints 64 w to 64 w + 63."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


class _Counter:
    """Carry-save counters of differing bits, one bit plane a binary digit; ``over`` keeps what has left the range."""

    def __init__(self, size: int, radius: int):
        self.radius = radius
        self.digits = [np.zeros(size, np.uint64) for _ in range(max(2, radius.bit_length()))]
        self.over = np.zeros(size, np.uint64)

    def add_two(self, a: np.ndarray, b: np.ndarray) -> None:
        ones = self.digits[0]
        half = a ^ b
        carry = (a & b) | (half & ones)
        self.digits[0] = half ^ ones
        for i in range(1, len(self.digits)):
            digit = self.digits[i]
            self.digits[i] = digit ^ carry
            carry = carry & digit
        self.over |= carry

    def within(self) -> np.ndarray:
        """Lanes whose count is at most the radius."""
        above, equal = self.over.copy(), ~self.over
        for i in range(len(self.digits) - 1, -1, -1):
            if self.radius >> i & 1:
                equal &= self.digits[i]
            else:
                above |= equal & self.digits[i]
                equal &= ~self.digits[i]
        return ~above

    def keep(self, mask: np.ndarray) -> None:
        self.digits = [d[mask] for d in self.digits]
        self.over = self.over[mask]


def _compare(planes: np.ndarray, fps: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of linked fingerprints with j > i, of query rows against 64-lane words."""
    counter, values = _Counter(len(query), radius), fps[query]
    for k in range(0, 64, 2):
        if k in CHECKPOINTS:
            alive = counter.within() != 0
            if alive.mean() < 0.7:
                counter.keep(alive)
                query, word, values = query[alive], word[alive], values[alive]
        low = np.uint64(0) - ((values >> np.uint64(k)) & np.uint64(1))
        high = np.uint64(0) - ((values >> np.uint64(k + 1)) & np.uint64(1))
        counter.add_two(planes[k][word] ^ low, planes[k + 1][word] ^ high)
    hits = counter.within()
    some = np.flatnonzero(hits)
    lanes = np.unpackbits(hits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(lanes)
    i, j = query[some[at]], word[some[at]] * 64 + lane
    true = (j > i) & (j < len(fps))
    return i[true], j[true]


def spanning_links(buckets: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) links that span the components within buckets; rows of a bucket stand together.

    Lanes of a neighbouring bucket that share a word are compared along; a link found so is a true link too.
    """
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
    ends = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n]))
    rows = np.arange(n)
    first, words = rows // 64, (ends - 1) // 64 - rows // 64 + 1
    words[rows == ends - 1] = 0
    unique, label_of = np.unique(fps, return_inverse=True)
    label, planes, at = np.arange(len(unique)), _planes(fps), 0
    upto = np.cumsum(words)
    while at < n:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LANES, "right")))
        span = words[at:stop]
        query = np.repeat(rows[at:stop], span)
        word = np.repeat(first[at:stop], span) + np.arange(len(query)) - np.repeat(np.cumsum(span) - span, span)
        for cut in range(0, len(query), 4 * LANES):
            i, j = _compare(planes, fps, query[cut : cut + 4 * LANES], word[cut : cut + 4 * LANES], radius)
            a, b = label_of[i], label_of[j]
            while len(a):
                la, lb = label[a], label[b]
                apart = la != lb
                if not apart.any():
                    break
                a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
                np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
                while (deeper := label[label]).tobytes() != label.tobytes():
                    label = deeper
        at = stop
    moved = np.flatnonzero(label != np.arange(len(label)))
    return unique[moved], unique[label[moved]]


def blocks_for(count: int) -> int:
    """Runs that the bits are cut into: the fewest, from 6 on, whose keys leave ``BUCKET`` random fingerprints in a bucket.

    A pair within RADIUS bits agrees on blocks - RADIUS runs at least, for any number of blocks, so the choice decides
    about the work only: 15 keys of 21 bits each for 6 blocks, 35 of 27 for 7, 70 of 32 for 8.
    """
    blocks = 6
    while blocks < 8 and count > BUCKET << 64 * (blocks - RADIUS) // blocks:
        blocks += 1
    return blocks


def _cells(fps: DataFrame, cell: int, blocks: int) -> DataFrame:
    """(key, cell, fp): each distinct fingerprint under its keys; large buckets cut into pairs of chunks.

    A key is a choice of runs and their bits.
    """
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    width = -(-64 // blocks)
    runs = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])]
    keys = []
    for t, chosen in enumerate(combinations(runs, blocks - RADIUS)):
        key = F.lit(t).cast("long")
        for run in chosen:
            key = F.shiftleft(key, width).bitwiseOR(run)
        keys.append(key)
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = rows.groupBy("key").count().where(F.col("count") > cell).select("key", F.ceil(F.col("count") / cell).alias("chunks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    out = rows.join(large, "key", "left").select("key", "fp", "chunks", other.alias("other"))
    pair = F.least(mine, F.col("other")) * F.col("chunks") + F.greatest(mine, F.col("other"))
    return out.select("key", F.coalesce(pair, F.lit(0)).alias("cell"), "fp")


def links(fps: DataFrame, radius: int = RADIUS, cell: int = CELL, blocks: int | None = None) -> DataFrame:
    """Links (u, v) that span each component of fingerprints within ``radius`` bits (at most RADIUS).

    ``fps`` has distinct fingerprints; ``blocks`` follows from their number unless given.
    """
    if radius > RADIUS:
        raise ValueError(f"the candidate keys are complete up to {RADIUS} bits")
    placed = _cells(fps.select("fp"), cell, blocks_for(fps.count()) if blocks is None else blocks)
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(tasks, "key", "cell").sortWithinPartitions("key", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(table: np.ndarray) -> pa.RecordBatch:
            bucket = np.cumsum(np.r_[0, np.any(table[1:, :2] != table[:-1, :2], axis=1)])
            u, v = spanning_links(bucket, table[:, 2].copy().view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
            if sum(map(len, held)) >= GROUP:
                table = np.concatenate(held)
                last = np.flatnonzero(np.any(table[:, :2] != table[-1, :2], axis=1))
                cut = last[-1] + 1 if len(last) else 0  # the last bucket may go on
                if cut:
                    yield flush(table[:cut])
                held = [table[cut:]]
        if held and sum(map(len, held)):
            yield flush(np.concatenate(held))

    return dealt.mapInArrow(run, "u long, v long")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id, root, text_hash) for every row of ``docs``; ``root`` is a fingerprint of the group.

    Nulls: a null or empty text has fingerprint 0 and links like any other; a null doc_id gets the smallest id of
    its group, null if the group has none. Repeated rows each return a row. An empty table returns none. Other
    columns of ``docs`` are not read.
    """
    rows = written(fingerprints(docs), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    stars = components(links(nodes)).withColumnRenamed("u", "fp")
    rooted = nodes.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "text_hash"
    )


def dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: the smallest doc_id (nulls last), then the smallest text hash.

    Keeps all columns. Where rows repeat in both, one stays.
    """
    place = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.col("text_hash").alias("hash"))
    return one_of_each(docs, groups(docs).groupBy("root").agg(F.min(place).alias("place")))


def one_of_each(docs: DataFrame, best: DataFrame) -> DataFrame:
    """The rows of ``docs`` at the places (id, hash) of ``best``; of rows that repeat in both, one."""
    best = best.select(F.col("place.id").alias("__id"), F.col("place.hash").alias("__hash"))
    keyed = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__hash", F.xxhash64("text"))
    # both steps have the same keys, so that texts are shuffled once
    return keyed.join(best, ["__id", "__hash"], "left_semi").dropDuplicates(["__id", "__hash"]).select(*docs.columns)


def op1_simhash_groups(spark, sf_dir):
    return groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")
