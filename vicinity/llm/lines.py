"""Line dedup by pairwise alignment of overlapping documents.

Documents are ordered by (doc_id, text hash). Lines with ``BLOCK_WORDS`` words or more, and runs of consecutive lines that
just reach so many words, forward or backward from any line, are anchors; lines without a word are passed over. Each line
of a repeated block of so many words, whatever the length of its lines, lies in an anchor of the block.

Overlapping documents are found through rare anchors, which stand in 2 to ``RARE`` documents: each later document is
linked to the first holder of its rare anchors. A linked pair is aligned with patience diff over the places of these
anchors in both: those that are unique in both and in the same order (a longest increasing run) are matched, matches are
extended to equal neighbours, and the gaps are aligned in the same way. The lines of matched anchors are deleted from the
later document.

A more common anchor needs no partner to be chosen: it is an aligned block by itself, and is deleted from all documents but
the first that holds it. So an anchor in n documents gives n - 1 rows in either case, and only the places of shared
anchors are shuffled, never a document's other lines. A deleted line stays in an earlier document.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import as_bytes, bounded_batches, documents, map_arrow, written

#: Words that a line or a run of lines must have to be an anchor.
BLOCK_WORDS = 5
#: Documents at most that a rare anchor stands in.
RARE = 64


def _increasing(values: list[int]) -> list[int]:
    """Positions of a longest increasing run, by patience sorting."""
    tops: list[int] = []
    top_at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile:
            before[i] = top_at[pile - 1]
        if pile == len(tops):
            tops.append(v)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = v, i
    out, i = [], top_at[-1] if top_at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched positions (i, j) of equal items, ascending in both."""
    matched, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        i0, i1, j0, j1 = gaps.pop()
        while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
            matched.append((i0, j0))
            i0, j0 = i0 + 1, j0 + 1
        while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
            i1, j1 = i1 - 1, j1 - 1
            matched.append((i1, j1))
        if i0 >= i1 or j0 >= j1:
            continue
        in_a, in_b = Counter(a[i0:i1]), Counter(b[j0:j1])
        place = {x: i for i, x in enumerate(a[i0:i1], i0) if in_a[x] == 1 and in_b.get(x) == 1}
        pairs = [(place[x], j) for j, x in enumerate(b[j0:j1], j0) if x in place]
        if not pairs:
            continue
        kept = [pairs[k] for k in _increasing([i for i, _ in pairs])]
        matched += kept
        at_i, at_j = i0, j0
        for i, j in [*kept, (i1, j1)]:
            gaps.append((at_i, i, at_j, j))
            at_i, at_j = i + 1, j + 1
    return sorted(matched)


def anchors(lines: np.ndarray, words: np.ndarray, least: int = BLOCK_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, number of lines, hash) of the shortest runs of lines, from or up to each line, with ``least`` words.

    ``lines`` are the hashes of the lines that have a word. A line that has so many words is such a run. Of a block of so
    many words each line lies in a run inside the block. Runs come in the order of their places.
    """
    upto = np.cumsum(words, dtype=np.int64)
    before, at = upto - words, np.arange(len(words))
    last = np.searchsorted(upto, before + least)
    first = np.searchsorted(before, upto - least, "right") - 1
    runs = np.unique(np.r_[np.c_[at, last][last < len(at)], np.c_[first, at][first >= 0]], axis=0)
    start, size = runs[:, 0], runs[:, 1] - runs[:, 0] + 1
    hashes = lines[start].astype(np.int64)
    for i in np.flatnonzero(size > 1).tolist():
        part = lines[start[i] : start[i] + size[i]]
        hashes[i] = np.uint64(xxhash.xxh64_intdigest(part.tobytes(), int(size[i]))).view(np.int64)
    return start, size, hashes


def aligned(earlier: list[tuple[int, int]], later: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The anchors (place, hash) of ``later`` that patience diff matches with those of ``earlier``."""
    earlier, later = sorted(earlier), sorted(later)
    return [later[j] for _, j in patience([h for _, h in earlier], [h for _, h in later])]


LINES = "id long, hash long, doc_id long, words array<int>, anchors array<struct<h: long, n: int, at: array<int>>>"


def line_table(docs: DataFrame, least: int = BLOCK_WORDS) -> DataFrame:
    """(id, hash, doc_id, words, anchors) of each row: the words of its lines, and the places of each of its anchors.

    An anchor's places are numbers of lines that have a word, from 0. A null text has one empty line. Lines are compared
    by their words: blanks at the ends don't matter, and runs of blanks are one.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, ends, places = [], [0], [0]
        flat: list[list[np.ndarray]] = [[], [], []]
        for text in as_bytes(batch.column(3)):
            split = [line.split() for line in text.split(b"\n")]
            counts.append(np.fromiter(map(len, split), np.int32, len(split)))
            lines = np.array([xxhash.xxh64_intdigest(b" ".join(x)) for x in split if x], np.uint64).view(np.int64)
            start, size, hashes = anchors(lines, counts[-1][counts[-1] > 0], least)
            order = np.argsort(hashes, kind="stable")
            fresh = np.flatnonzero(np.diff(hashes[order], prepend=hashes[order][:1] - 1)) if len(order) else order
            flat[0].append(hashes[order][fresh])
            flat[1].append(size[order][fresh])
            flat[2].append(start[order])
            places += (places[-1] + np.r_[fresh[1:], len(order)][: len(fresh)]).tolist()
            ends.append(ends[-1] + len(fresh))
        h, n, at = map(np.concatenate, flat)
        at = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(at.astype(np.int32)))
        found = pa.StructArray.from_arrays([pa.array(h), pa.array(n.astype(np.int32)), at], ["h", "n", "at"])
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(counts, pa.list_(pa.int32())), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)],
            ["id", "hash", "doc_id", "words", "anchors"],
        )

    return map_arrow(docs.select(*_key(docs), F.col("doc_id").cast("long").alias("doc_id"), "text"), each, LINES)


def _key(docs: DataFrame) -> list:
    """A document's place in the order; documents without an id come last."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("hash")]


def shared(table: DataFrame, rare: int = RARE) -> DataFrame:
    """(a_id, a_hash, id, hash, h, n, at, a_at): each repeated anchor of a later document, with its first holder.

    Of an anchor in more than ``rare`` rows the holder is null: nothing is aligned.
    """
    held = table.select("id", "hash", F.explode("anchors").alias("a")).select("id", "hash", "a.h", "a.n", "a.at")
    first = held.groupBy("h").agg(
        F.min(F.struct("id", "hash", "at")).alias("first"), F.max(F.struct("id", "hash")).alias("last"), F.count("*").alias("docs")
    ).where((F.col("first.id") != F.col("last.id")) | (F.col("first.hash") != F.col("last.hash")))
    few = F.col("docs") <= rare
    # written: joined with a table of its own, an anchor that stands in very many documents is split over tasks
    first = written(
        first.select(
            "h", F.col("first.id").alias("f_id"), F.col("first.hash").alias("f_hash"), few.alias("few"), F.when(few, F.col("first.at")).alias("a_at")
        ),
        "first-holders",
    )
    later = held.join(first, "h").where((F.col("f_id") != F.col("id")) | (F.col("f_hash") != F.col("hash")))
    return later.select(F.when(F.col("few"), F.col("f_id")).alias("a_id"), F.when(F.col("few"), F.col("f_hash")).alias("a_hash"), "id", "hash", "h", "n", "at", "a_at")


def removals(table: DataFrame, rare: int = RARE) -> DataFrame:
    """(id, hash, gone array<int>, partners): the lines to delete from each document that loses some.

    Lines are numbers of those that have a word, from 0; ``partners`` is how many documents it was aligned with.
    """
    pairs = shared(table, rare).groupBy("a_id", "a_hash", "id", "hash").agg(F.collect_list(F.struct("h", "n", "at", "a_at")).alias("found"))
    bounded_batches(table.sparkSession)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, partner = [], []
            for rows in batch.column(2).to_pylist():
                size = {r["h"]: r["n"] for r in rows}
                direct = {(p, r["h"]) for r in rows if r["a_at"] is None for p in r["at"]}
                later = {(p, r["h"]) for r in rows if r["a_at"] is not None for p in r["at"]}
                earlier = {(p, r["h"]) for r in rows if r["a_at"] is not None for p in r["a_at"]}
                matched = aligned(list(earlier), list(later)) if later else []
                out.append(sorted({i for p, h in (*direct, *matched) for i in range(p, p + size[h])}))
                partner.append(int(bool(matched)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32())), pa.array(partner, pa.int32())], ["id", "hash", "gone", "partner"]
            )

    rows = pairs.select("id", "hash", "found").mapInArrow(align, "id long, hash long, gone array<int>, partner int")
    return rows.where(F.size("gone") > 0).groupBy("id", "hash").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"), F.sum("partner").cast("int").alias("partners")
    )


def line_numbers(words: list[int], gone: list[int]) -> list[int]:
    """Numbers, among all lines, of lines that have a word, and of the lines without one between two neighbours."""
    some = [i for i, n in enumerate(words) if n]
    out: list[int] = []
    for before, g in zip([-2, *gone], gone):
        out += range(some[before] + 1, some[g]) if g == before + 1 else ()
        out.append(some[g])
    return out


def dedup(docs: DataFrame, least: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with the repeated blocks deleted from their texts; documents of which nothing is left go.

    Keeps all columns; ``n_chars``, if there is one, follows the text. Rows that lose no line stay as they are: null and
    empty texts, texts with a null id (they come last in the order), and repeated rows (equal in id and text, which
    are one document) each stay. An empty table stays empty.
    """
    table = written(line_table(docs, least), "lines")
    gone = written(removals(table), "removals")
    marked = docs.withColumn("__id", _key(docs)[0]).withColumn("__hash", _key(docs)[1])
    joined = marked.join(gone.select(F.col("id").alias("__id"), F.col("hash").alias("__hash"), F.col("gone").alias("__gone")), ["__id", "__hash"], "left")
    names = docs.columns
    at = names.index("text")
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            if any(removed):
                texts = [without(t, r) for t, r in zip(texts, removed)]
                stays = pa.array([not r or bool(t.strip()) for t, r in zip(texts, removed)], pa.bool_())
                columns = [pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(len(names))]
                if "n_chars" in names:
                    i = names.index("n_chars")
                    counts = [n if not r else len(t) for n, t, r in zip(batch.column(i).to_pylist(), texts, removed)]
                    columns[i] = pa.array(counts, batch.schema.field(i).type)
                yield pa.RecordBatch.from_arrays(columns, names).filter(stays)
            else:
                yield pa.RecordBatch.from_arrays(batch.columns[: len(names)], names)

    return joined.select(*names, "__gone").mapInArrow(cut, docs.schema)


def without(text: str | None, gone: list[int] | None) -> str | None:
    """The text without these of its lines that have a word, and without the lines between neighbours."""
    if not gone:
        return text
    split = text.split("\n")
    # words are cut at the same characters as in the table
    drop = set(line_numbers([len(x.encode().split()) for x in split], gone))
    return "\n".join(line for i, line in enumerate(split) if i not in drop)


def op3_line_dedup(spark, sf_dir):
    """Per document: its lines and words, those deleted, the deleted line numbers and the partners it was aligned with."""
    table = written(line_table(documents(spark, sf_dir)), "lines")
    rows = table.select("id", "hash", "doc_id", "words").join(removals(table), ["id", "hash"], "left")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, gone = (batch.column(i).to_pylist() for i in (1, 2))
        removed = [line_numbers(w, g or []) for w, g in zip(words, gone)]
        columns = [
            list(map(len, words)), list(map(sum, words)), list(map(len, removed)),
            [sum(w[i] for i in r) for w, r in zip(words, removed)], [",".join(map(str, r)) for r in removed],
        ]
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *map(pa.array, columns, kinds), batch.column(3)],
            ["doc_id", "n_lines", "n_words", "n_removed", "words_removed", "removed", "partners"],
        )

    rows = rows.select("doc_id", "words", "gone", F.coalesce("partners", F.lit(0)).alias("partners"))
    return map_arrow(rows, each, "doc_id long, n_lines long, n_words long, n_removed long, words_removed long, removed string, partners int")
