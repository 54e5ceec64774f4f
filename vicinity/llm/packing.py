"""Vector bin packing of examples into fixed-length sequences.

A bin (sequence) has three capacities: tokens, segments and loss-bearing tokens. The dot-product heuristic puts into the
open bin the waiting example that fits in all three and whose demand has the largest dot product with what the bin has
left, both in units of the capacities. Examples that wait with the same demand are one class, so that the choice is a
product over classes.

If examples may be cut, one that fits nowhere whole is cut to fill the bin, and a bin that stays short (at the segment
limit, or at a task's end) is cut into power-of-two sequences, which need no padding. Each task packs the rows it reads, in a window of bounded bytes:
nothing is shuffled or gathered, and a task that runs again packs the same rows again by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import as_bytes, bounded_batches, documents, written
from vicinity.llm.tokens import ChunkEncoder, default_path

TOKENS, SEGMENTS, END_ID = 4096, 1024, 2
#: Turns that a conversation may have, in one task, before it is cut into blocks of so many.
TURNS = 4096
#: Waiting examples of a task: rows and bytes at which bins are filled.
WINDOW_ROWS, WINDOW_BYTES = 512, 8 << 20
#: Sequence ids: the task's number times this plus the sequence's own.
PER_TASK = 1 << 40


@dataclass
class Item:
    """A run of an example's ids: tokens from ``start`` on; ``loss`` of them bear loss, the last ones."""

    owner: tuple
    start: int
    length: int
    loss: int
    ids: bytes

    def cut(self, n: int) -> tuple[Item, Item]:
        """The first ``n`` tokens and the rest."""
        head_loss = max(0, self.loss - (self.length - n))
        return (
            Item(self.owner, self.start, n, head_loss, self.ids[: 4 * n]),
            Item(self.owner, self.start + n, self.length - n, self.loss - head_loss, self.ids[4 * n :]),
        )


@dataclass
class Packer:
    """Packs items as they come; ``emit`` gets the owner, item, sequence number and offset of each placed run."""

    tokens: int = TOKENS
    segments: int = SEGMENTS
    loss: int = TOKENS
    cut: bool = True
    rows: int = WINDOW_ROWS
    bytes: int = WINDOW_BYTES
    placed: list = field(default_factory=list)
    sequence: int = 0

    def __post_init__(self):
        self.classes: dict[tuple[int, int], list[Item]] = {}
        self.waiting = self.held = 0

    def _wait(self, item: Item) -> None:
        self.classes.setdefault((item.length, item.loss), []).append(item)
        self.waiting, self.held = self.waiting + 1, self.held + len(item.ids)

    def add(self, item: Item) -> None:
        """Full-length runs of a long example become sequences at once; the rest waits for the others."""
        while item.length > self.tokens or item.loss > self.loss:
            if not self.cut:
                raise ValueError("an example exceeds a capacity and may not be cut")
            n = min(self.tokens, item.length)
            if item.loss > self.loss:
                n = min(n, item.length - item.loss + self.loss)
            head, item = item.cut(n)
            self._wait(head) if n < self.tokens else self._close([head])
        self._wait(item)
        if self.waiting >= self.rows or self.held >= self.bytes:
            self._fill(self.rows // 2, self.bytes // 2)

    def _close(self, items: list[Item]) -> None:
        offset = 0
        for item in items:
            self.placed.append((item, self.sequence, offset))
            offset += item.length
        self.sequence += 1

    def _take(self, key: tuple[int, int]) -> Item:
        items = self.classes[key]
        item = items.pop()
        if not items:
            del self.classes[key]
        self.waiting, self.held = self.waiting - 1, self.held - len(item.ids)
        return item

    def _fill(self, rows: int, size: int) -> None:
        """Fill bins until no more than ``rows`` items and ``size`` bytes wait, or less than a bin's tokens."""
        while self.waiting and (self.waiting > rows or self.held > size):
            total = sum(length * len(x) for (length, _), x in self.classes.items())
            if total < self.tokens and rows:
                return
            self._close_bin(self._bin())

    def _bin(self) -> list[Item]:
        left = np.array([self.tokens, self.segments, self.loss], np.float64)
        scale, out = 1 / left, []
        keys = np.array(list(self.classes), np.float64)
        counts = np.array([len(x) for x in self.classes.values()])
        demand = np.stack([keys[:, 0], np.ones(len(keys)), keys[:, 1]], axis=1)
        scaled = demand * scale
        while left[0] > 0 and left[1] > 0:
            fits = (counts > 0) & (demand <= left).all(axis=1)
            if not fits.any():
                break
            score = np.where(fits, scaled @ (left * scale), -1)
            best = int(np.lexsort((keys[:, 1], keys[:, 0], score))[-1])
            out.append(self._take((int(keys[best, 0]), int(keys[best, 1]))))
            left -= demand[best]
            counts[best] -= 1
        gap, room = int(left[0]), int(left[2])
        if self.cut and gap and left[1] >= 1 and counts.any():
            # the longest waiting item is cut: its rest is the least likely to be a crumb
            longest = max((k for k, n in zip(map(tuple, keys.astype(int).tolist()), counts) if n), default=None)
            item = self._take(longest)
            head, rest = item.cut(min(gap, item.length - 1))
            if head.loss <= room:
                out.append(head)
                self._wait(rest)
            else:
                self._wait(item)
        return out

    def _close_bin(self, items: list[Item]) -> None:
        """A bin that is short becomes power-of-two sequences, if cuts are allowed: those need no padding."""
        total = sum(i.length for i in items)
        if total == self.tokens or not self.cut:
            self._close(items)
            return
        for n in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
            part, need = [], n
            while need:
                item = items.pop(0)
                if item.length > need:
                    item, rest = item.cut(need)
                    items.insert(0, rest)
                part.append(item)
                need -= item.length
            self._close(part)

    def finish(self) -> None:
        """Place all that waits."""
        while self.waiting:
            self._close_bin(self._bin())


def pack_tokens(docs: DataFrame, path: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS) -> DataFrame:
    """Pack the token ids of every row of ``docs`` (doc_id, text) into sequences of at most ``tokens``.

    All tokens of a plain document bear loss. Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed
    each; an empty table returns no row. Texts of any length are cut, never shortened. Other columns are not read.
    """
    path = path or default_path()
    bounded_batches(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = ChunkEncoder.of(path), Packer(tokens, segments, tokens)
        first = TaskContext.get().partitionId() * PER_TASK

        def placed() -> pa.RecordBatch:
            rows = [
                (i.owner[0], i.start, i.length, zlib.crc32(i.ids), i.owner[1], first + sequence, offset)
                for i, sequence, offset in packer.placed
            ]
            packer.placed.clear()
            columns = list(zip(*rows)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                ids = encoder.encode(text) + end
                packer.add(Item((doc_id, len(ids) // 4), 0, len(ids) // 4, len(ids) // 4, ids))
            yield placed()
        packer.finish()
        yield placed()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = ", ".join(f"{n} long" for n in names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


@dataclass
class Turn:
    """A run of a turn's ids."""

    conv: int | None
    turn: int | None
    start: int
    length: int
    loss: int


def examples(turns: Iterator[tuple], tokens: int, loss: int) -> Iterator[list[Turn]]:
    """The examples of rows (conv, turn, bears loss, number of ids): a conversation's turns, which stand together.

    A conversation that exceeds a capacity is cut between turns, a turn that does so by itself within.
    """
    held: list[Turn] = []
    size = bearing = 0
    for conv, turn, bears, n in turns:
        most, at = min(tokens, loss) if bears else tokens, 0
        while at < n:
            run = Turn(conv, turn, at, min(most, n - at), min(most, n - at) if bears else 0)
            if held and (held[-1].conv != conv or size + run.length > tokens or bearing + run.loss > loss):
                yield held
                held, size, bearing = [], 0, 0
            held.append(run)
            size, bearing, at = size + run.length, bearing + run.loss, at + run.length
    if held:
        yield held


def pack_conversations(turns: DataFrame, path: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = TOKENS // 2) -> DataFrame:
    """Pack instruction examples (conv_id, turn, role, text): a conversation is one example, and stays in one sequence.

    Only assistant turns bear loss. A conversation is cut, between turns, only if it exceeds a capacity by itself; one of
    more than TURNS turns is dealt out in blocks. Returns (conv_id, turn, start, length, loss_tokens, sequence_id, offset).
    Nulls: a null text is the end id alone, a null role bears no loss, a null conv_id is a conversation, a null turn comes
    first; equal turns stand in the order of role and text. An empty table returns no row. Other columns are not read.
    """
    path = path or default_path()
    bounded_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    # a conversation with so many turns can't be one example; its blocks, or their copies, may be in several tasks
    long = written(rows.groupBy("conv").count().where(F.col("count") > TURNS).select(F.col("conv").alias("c")), "long-conversations")
    block = F.when(F.col("many"), F.floor(F.col("turn") / TURNS))
    salt = F.when(F.col("many"), F.pmod(F.xxhash64("role", "text"), F.lit(64)))
    dealt = rows.join(long.withColumn("many", F.lit(True)), F.col("conv").eqNullSafe(F.col("c")), "left").select("conv", "turn", "role", "text", block.alias("block"), F.when(F.col("turn").isNull(), salt).alias("salt"))
    tasks = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(tasks, "conv", "block", "salt").sortWithinPartitions("conv", "block", "salt", "turn", "role", "text")
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = ChunkEncoder.of(path), Packer(tokens, segments, loss, cut=False)
        first = TaskContext.get().partitionId() * PER_TASK

        def placed() -> pa.RecordBatch:
            rows = []
            for item, sequence, at in packer.placed:
                for t in item.owner:
                    rows.append((t.conv, t.turn, t.start, t.length, t.loss, first + sequence, at))
                    at += t.length
            packer.placed.clear()
            columns = list(zip(*rows)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        def read() -> Iterator[tuple]:
            for batch in batches:
                conv, turn, role = (batch.column(i).to_pylist() for i in range(3))
                for c, t, r, text in zip(conv, turn, role, as_bytes(batch.column(3))):
                    yield c, t, r == "assistant", (len(encoder.encode(text)) + len(end)) // 4

        for example in examples(read(), tokens, loss):
            packer.add(Item(tuple(example), 0, sum(t.length for t in example), sum(t.loss for t in example), b""))
            if len(packer.placed) >= WINDOW_ROWS:
                yield placed()
        packer.finish()
        yield placed()

    names = ["conv_id", "turn", "start", "length", "loss_tokens", "sequence_id", "offset"]
    schema = ", ".join(f"{n} long" for n in names)
    return dealt.select("conv", "turn", "role", "text").mapInArrow(run, schema)


def pack_conversation_table(spark, sf_dir):
    """All conversations as instruction examples: the case in which the three capacities differ."""
    return pack_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_pack_tokens(spark, sf_dir):
    return pack_tokens(documents(spark, sf_dir))
