"""Language identification by rank-order n-gram profiles (Cavnar and Trenkle, 1994).

A text's 1- to 3-grams of letters, with a blank at word edges, are ranked by frequency; the ``GRAMS`` most frequent ones
are its profile. A language's profile comes the same way from the texts of that language. A text's distance to a
language is the mean, over the text's profile, of how far out of place each n-gram stands; one that the language's
profile lacks counts as ``GRAMS`` places. The nearest language is predicted.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinity.llm.common import as_strings, bounded_batches, documents, held_out, learnable, map_arrow, written

GRAMS = 400
#: About so many rows of each language are learned from, chosen by a hash of the id.
LEARN_ROWS = 2000
#: Characters of a text that are counted at once.
BLOCK = 1 << 20
NO_LANGUAGE = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> number of the letter from 1 on, or 0; a number has 18 bits at most."""
    is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(is_letter, np.cumsum(is_letter), 0).astype(np.int32)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, ascending, and their counts; empty if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _letters()[points]
    blank = codes == 0
    codes = codes[~(blank & np.r_[True, blank[:-1]])]  # runs of other characters are one blank; none in front
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.r_[0, codes, 0] if codes[-1] else np.r_[0, codes]
    found = []
    for i in range(0, len(codes), BLOCK):
        c = codes[i : i + BLOCK + 2].astype(np.int64)
        one = c[: min(BLOCK, len(c))]
        two = c[: BLOCK + 1]
        a, b = two[:-1], two[1:]
        x, y, z = c[:-2], c[1:-1], c[2:]
        grams = np.concatenate(
            [one[one > 0], (1 << 54) | (a << 18) | b, ((2 << 54) | (x << 36) | (y << 18) | z)[y > 0]]
        )
        found.append(np.unique(grams, return_counts=True))
    if len(found) == 1:
        return found[0]
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)


def profile(text: str, size: int = GRAMS) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by the n-gram's number."""
    keys, counts = gram_counts(text)
    return keys[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """The languages' ranks in one table: ``ranks[l, i]`` is the place of n-gram ``keys[i]`` in language l, or -1."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = GRAMS):
        self.size = size
        self.languages = sorted({lang for lang, _, _ in rows})
        self.keys = np.array(sorted({gram for _, gram, _ in rows}), np.int64)
        self.ranks = np.full((len(self.languages), len(self.keys)), -1, np.int64)
        place = {lang: i for i, lang in enumerate(self.languages)}
        for lang, gram, rank in rows:
            self.ranks[place[lang], np.searchsorted(self.keys, gram)] = rank

    def distances(self, text: str) -> np.ndarray | None:
        """Mean out-of-place distance to each language as a share of the largest, or None for a text without letters."""
        grams = profile(text, self.size)
        if not len(grams) or not self.languages:
            return None
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        ranks = np.where(self.keys[at] == grams, self.ranks[:, at], -1)
        apart = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(grams))), self.size))
        return apart.mean(axis=1) / self.size

    def predict(self, text: str) -> tuple[str, float]:
        """The nearest language (the first in code point order of several) and a score.

        The score is how much nearer it is than the next language, as a share; with one language, 1 less the distance.
        """
        d = self.distances(text)
        if d is None:
            return NO_LANGUAGE, 0.0
        best = int(np.argmin(d))
        if len(d) == 1:
            return self.languages[best], float(1 - d[best])
        second = float(np.partition(d, 1)[1])
        return self.languages[best], float((second - d[best]) / second) if second > 0 else 0.0


def learn(docs: DataFrame, rows_per_language: int = LEARN_ROWS, size: int = GRAMS) -> Profiles:
    """Profiles from (text, lang) of the rows that may be learned from: ids whose crc32 modulo 3 is 0 or 2.

    About ``rows_per_language`` rows of each language are read, those whose hashed id is smallest. Null texts, langs and
    ids teach nothing.
    """
    rows = docs.select("doc_id", "lang", "text").where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = rows.groupBy("lang").agg((F.lit(float(rows_per_language)) / F.count("*")).alias("share"))
    share = written(share.withColumnRenamed("lang", "l"), "language-shares")
    u = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), 11) / F.lit(float(1 << 53))
    sample = rows.join(share, (F.col("lang") == F.col("l")) & (u < F.col("share"))).select("lang", "text")
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), as_strings(batch.column(1))):
                per.setdefault(lang, []).append(gram_counts(text))
            for lang, found in per.items():
                keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                sums = np.bincount(at, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(sums)], ["lang", "gram", "n"])

    sums = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = sums.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < size)
    return Profiles([(r.lang, r.gram, r["rank"]) for r in top.select("lang", "gram", "rank").collect()], size)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``, from its whole text alone.

    ``und`` and 0 if the text is null, empty or without a letter, or nothing was learned. Null ids stay, repeated rows
    each return a row, an empty table none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = shared.value
        found = [model.predict(t) for t in as_strings(batch.column(1))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
            ["doc_id", "lang_pred", "score"],
        )

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), each, "doc_id long, lang_pred string, score double")


def identified(docs: DataFrame, wanted: list[str] | None = None, least: float = 0.0) -> DataFrame:
    """``docs`` with the predicted language as ``lang``; rows go in which none is found.

    So do those whose language isn't one of the ``wanted`` ones, if these are given, or whose score is below ``least``.
    Keeps the other columns; a table without ``lang`` can't be learned from.
    """
    profiles = docs.sparkSession.sparkContext.broadcast(learn(docs))
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.value.predict(t) for t in as_strings(batch.column(at))]
            fine = [x != NO_LANGUAGE and s >= least and (wanted is None or x in wanted) for x, s in found]
            columns = [pa.array([x for x, _ in found], c.type) if i == lang else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(fine, pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)


def op8_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = predict(docs, learn(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
