"""Toxicity scores of deobfuscated text.

Noisy-channel restoration: a suspect piece of text (letters mixed with digits or symbols, a letter three times or more,
single letters in a row) is read as a lattice of what its characters may stand for: themselves, the letters that
look-alikes replace, a word boundary, or nothing (separators, repeated letters). Viterbi decoding finds the most probable
path under a character trigram language model, counted over all documents.

The restored words are scored with a lexicon learned from labelled documents: words and word beginnings that stand in
toxic documents significantly more often. A document's score is the naive-Bayes odds of the base rate, its strongest
word and, at half weight, its other ones.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinity.llm import near
from vicinity.llm.common import as_strings, documents, held_out, learnable, map_arrow, written

#: Symbols of the language model: 0 a word's edge, 1 to 26 the letters a to z, 27 any other letter.
SYMBOLS = 28
#: About so many labelled documents are learned from at most, chosen by a hash of the id.
LEARN_ROWS = 20_000
#: Word beginnings that count as features beside the whole word; toxic documents that a feature must stand in.
BEGINNINGS, SUPPORT = (4, 5, 6), 3
#: Share of the documents with a feature, and one more, that must be toxic: of a word, of a beginning.
PURITY, BEGIN_PURITY = 0.75, 0.97
#: Share of the toxic documents that a feature must stand in.
COVER = 0.01
#: Chance, over all candidates, that a feature of the lexicon stands in it by accident.
ACCIDENT = 0.5
#: Chunks that a worker remembers, and their characters at most: longer ones are restored each time they come.
MEMORY, LONGEST = 700_000, 64

#: Letters that a look-alike may stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l",
}
#: Look-alikes that are often mere punctuation around a word.
MARKS = "!(|+¡"
OUTER = " \t\n\x0b\x0c\r.,;:!?\"'()[]{}<>*%&#$@|+-_~^=/\\`"
#: Log probabilities of the channel. A look-alike between letters is seldom noise or a break; other symbols often are.
SAME, LOOKS, DROPPED, REPEATED, EDGE, NOISE, BREAK = map(math.log, (0.95, 0.4, 0.3, 0.35, 0.1, 1e-6, 0.003))

OUTER_MARKS = "".join(c for c in OUTER if c not in LOOKALIKE or c in MARKS)
_TRIPLE = re.compile(r"(.)\1\1")
#: One character of a spelling, letter or look-alike; such characters apart.
_ONE = r"(?:[^\W\d_]|[" + re.escape("".join(LOOKALIKE)) + "])"
_SPACED = re.compile(rf"(?<![^\W_]){_ONE}(?:[\s.*_-]+{_ONE}){{3,}}(?!{_ONE})")
_PAIR, _SOME = re.compile(r"[^\W_]{2}"), re.compile(_ONE)


@functools.cache
def _symbol_table() -> np.ndarray:
    table = np.where(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000), 27, 0)
    table[97:123] = np.arange(1, 27)
    return table.astype(np.int32)


def symbol(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27


def trigrams(text: str) -> np.ndarray:
    """Counts of symbol trigrams of the lower-cased text; what stands before a word's edge doesn't matter to the next word."""
    counts = np.zeros(SYMBOLS**3, np.int64)
    codes = _symbol_table()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    for i in range(0, len(codes), 1 << 20):
        part = np.r_[codes[i - 2 : i] if i else [0, 0], codes[i : i + (1 << 20)]]
        if i + (1 << 20) >= len(codes):
            part = np.r_[part, 0]
        a, b, c = part[:-2], part[1:-1], part[2:]
        inside = (b > 0) | (c > 0)
        a = np.where(b == 0, 0, a)
        counts += np.bincount(((a * SYMBOLS + b) * SYMBOLS + c)[inside], minlength=SYMBOLS**3)
    return counts


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) as [a, b, c], interpolated with P(c | b) and a uniform share; counted over all of ``docs``."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = sum((trigrams(t) for t in as_strings(batch.column(0))), np.zeros(SYMBOLS**3, np.int64))
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["gram", "n"])

    sums = map_arrow(docs.select("text"), count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**3)
    for r in sums.collect():  # at most SYMBOLS cubed rows
        counts[r.gram] = r.n
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two = three.sum(axis=0)
    p2 = (two + 0.5) / (two + 0.5).sum(axis=1, keepdims=True)
    total = three.sum(axis=2, keepdims=True)
    return np.log((three + 20 * p2[None]) / (total + 20))


class Restorer:
    """Viterbi decoding of suspect pieces under a language model."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def _options(self, piece: str, i: int) -> list[tuple[str, float]]:
        o = piece[i]
        if o.isalpha():
            again = i > 0 and piece[i - 1] == o and (o * 3 in piece[max(0, i - 2) : i + 3])
            return [(o, SAME), ("", REPEATED)] if again else [(o, SAME)]
        looks = LOOKALIKE.get(o, "")
        return [("", NOISE if looks else DROPPED), (" ", BREAK if looks else EDGE), *((x, LOOKS) for x in looks)]

    def decode(self, piece: str) -> str:
        """The most probable restored text of a lower-cased piece; of equal ones the first in order of options."""
        model = self.model
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i in range(len(piece)):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            options = self._options(piece, i)
            for (a, b), (score, path) in states.items():
                for out, cost in options:
                    if out == "":
                        key, value, way = (a, b), score + cost, path
                    elif out == " ":
                        if b == 0:
                            continue
                        key, value, way = (0, 0), score + cost + model[a][b][0], (" ", path)
                    else:
                        s = symbol(out)
                        key, value, way = (b, s), score + cost + model[a][b][s], (out, path)
                    if key not in after or value > after[key][0]:
                        after[key] = value, way
            states = after
        _, path = max(((score + (model[a][b][0] if b else 0), path) for (a, b), (score, path) in states.items()), key=lambda x: x[0])
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))

    def words(self, chunk: str) -> list[str]:
        """The words that a lower-cased chunk without blanks may be read as: as it stands, and restored if suspect."""
        core = chunk.strip(OUTER)
        if not any(map(str.isalpha, core)):
            if sum(c in LOOKALIKE for c in chunk) < 3:
                return []
            return [w for piece in dict.fromkeys((chunk, chunk.strip(OUTER_MARKS))) for w in self.decode(piece).split()]
        plain = [core] if core.isalpha() else re.findall(r"[^\W\d_]+", core)
        return [*plain, *(w for piece in self._pieces(chunk, core) for w in self.decode(piece).split())]

    def _pieces(self, chunk: str, core: str) -> list[str]:
        """What to restore: the core with the look-alikes around it, without those that may be punctuation, and with none."""
        begin = chunk.find(core)
        end = begin + len(core)
        first = next((i for i in range(begin) if chunk[i] in LOOKALIKE), begin)
        last = next((i for i in range(len(chunk), end, -1) if chunk[i - 1] in LOOKALIKE), end)
        inner_first = next((i for i in range(first, begin) if chunk[i] in LOOKALIKE and chunk[i] not in MARKS), begin)
        inner_last = next((i for i in range(last, end, -1) if chunk[i - 1] in LOOKALIKE and chunk[i - 1] not in MARKS), end)
        pieces = dict.fromkeys(chunk[i:j] for i in (first, inner_first, begin) for j in (last, inner_last, end))
        return [p for p in pieces if not p.isalpha() or _TRIPLE.search(p)]

    def spaced(self, text: str) -> set[str]:
        """Words spelled with single letters or look-alikes apart: all runs of 4 to 12 letters inside the restored spelling."""
        out = set()
        for match in _SPACED.finditer(text):
            joined = re.sub(r"[\s.*_-]+", "", match.group())
            for word in {joined, *self.decode(joined).split(), *self.decode(match.group()).split()}:
                out |= {word[i : i + n] for n in range(4, 13) for i in range(len(word) - n + 1)}
        return out


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


class Scorer:
    """Finds the lexicon's words in texts. ``lexicon``: feature -> log odds."""

    def __init__(self, restorer: Restorer, lexicon: dict[str, float], base: float):
        self.restorer, self.lexicon, self.base = restorer, lexicon, base
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[str, float]] = {}
        #: Chunks that may belong to a word spelled apart.
        self.single: set[str] = set()

    def __getstate__(self):
        return self.restorer, self.lexicon, self.base

    def __setstate__(self, state):
        self.__init__(*state)

    def _hit(self, word: str) -> float:
        return max((self.lexicon.get(f, 0.0) for f in features(word)), default=0.0)

    def _best(self, chunk: str) -> tuple[float, str]:
        return max(((self._hit(w), w) for w in self.restorer.words(chunk)), default=(0.0, ""))

    @staticmethod
    def _apart(chunk: str) -> bool:
        """Whether the chunk may belong to a word spelled apart."""
        return not _PAIR.search(chunk) and _SOME.search(chunk) is not None

    def _meet(self, chunks: set[str]) -> None:
        if len(self.seen) > MEMORY:
            self.seen, self.hits, self.single = set(), {}, set()
        for chunk in chunks:
            best = self._best(chunk)
            if best[0] > 0:
                self.hits[chunk] = best[1], best[0]
            if self._apart(chunk):
                self.single.add(chunk)
        self.seen |= chunks

    def score(self, text: str) -> float:
        low = text.lower()
        chunks = set(low.split())
        found, apart = {}, False
        if new := chunks - self.seen:
            for chunk in [c for c in new if len(c) > LONGEST]:
                chunks.discard(chunk)
                best = self._best(chunk)
                if best[0] > 0:
                    found[best[1]] = best[0]
                apart = apart or self._apart(chunk)
            self._meet(new & chunks)
            if not chunks <= self.seen:
                self._meet(chunks)
        found.update(self.hits[c] for c in self.hits.keys() & chunks)
        if apart or not self.single.isdisjoint(chunks):
            for word in self.restorer.spaced(low):
                if (w := self.lexicon.get(word, 0.0)) > 0:
                    found[word] = w
        if not found:
            return self.base
        weights = sorted(found.values(), reverse=True)
        odds = math.log(self.base / (1 - self.base)) + weights[0] + 0.5 * sum(weights[1:])
        return 1 / (1 + math.exp(-min(odds, 30)))


def document_features(text: str, restorer: Restorer, known: dict[str, list[str]]) -> set[str]:
    out: set[str] = set()
    for chunk in set(text.lower().split()):
        if (found := known.get(chunk)) is None:
            found = [f for w in restorer.words(chunk) for f in features(w)]
            if len(chunk) <= LONGEST:
                if len(known) > MEMORY // 4:
                    known.clear()
                known[chunk] = found
        out.update(found)
    return out


def learn(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> Scorer:
    """The language model over all of ``docs`` and the lexicon from (doc_id, toxic) labels.

    Only ids whose crc32 modulo 3 is 0 or 2 teach; about ``rows`` of them at most, those whose hashed id is smallest.
    Null ids, labels and texts teach nothing; without both kinds of labels the lexicon is empty and every score is the
    base rate.
    """
    restorer = Restorer(language_model(docs))
    shared = docs.sparkSession.sparkContext.broadcast(restorer)
    labels = labels.where(F.col("toxic").isNotNull() & learnable(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("toxicity")), 11) / F.lit(float(1 << 53))
    chosen = written(labels.where(u < F.lit(rows / max(1, labels.count()))), "toxic-labels")
    taught = docs.select("text", F.xxhash64("text").alias("node"), "doc_id").where(F.col("text").isNotNull()).join(chosen, "doc_id")
    # copies would make chance words of one text look like evidence: of near copies with the same label one stays
    taught = written(taught.groupBy("toxic", "node").agg(F.min("text").alias("text")), "taught")
    roots = near.rooted(taught.groupBy("node").agg(F.min("text").alias("text")))
    least = taught.select("toxic", "node").join(roots, "node").groupBy("toxic", "root").agg(F.min("node").alias("node"))
    taught = written(taught.join(least.select("toxic", "node"), ["toxic", "node"], "left_semi").select("toxic", "text"), "taught-once")
    totals = dict(taught.groupBy("toxic").count().collect())
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    base = (n_toxic + 0.5) / (n_toxic + n_clean + 1) if n_toxic + n_clean else 0.1
    if not n_toxic or not n_clean:
        return Scorer(restorer, {}, base)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        known: dict[str, list[str]] = {}
        seen: dict[str, list[int]] = {}
        for toxic, text in zip(batch.column(0).to_pylist(), as_strings(batch.column(1))):
            for f in document_features(text, shared.value, known):
                seen.setdefault(f, [0, 0])[toxic == 1] += 1
        return pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array([x[1] for x in seen.values()], pa.int64()), pa.array([x[0] for x in seen.values()], pa.int64())],
            ["feature", "toxic", "clean"],
        )

    sums = map_arrow(taught, count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # bounded by the sample: each of its toxic documents' features, of those that stand in SUPPORT of them
    counts = written(sums.where(F.col("toxic") >= SUPPORT), "toxic-features")
    size = counts.count()
    t, c, share = F.col("toxic"), F.col("clean"), n_toxic / (n_toxic + n_clean)
    rate = t / (t + c)
    gain = 2 * (t * F.log(rate / share) + F.when(c > 0, c * F.log((1 - rate) / (1 - share))).otherwise(0.0))
    odds = F.log((t + 0.5) / (n_toxic + 1)) - F.log((c + 0.5) / (n_clean + 1))
    pure = F.when(F.col("feature").endswith("*"), BEGIN_PURITY).otherwise(PURITY)
    strong = counts.withColumn("odds", odds).where(
        (gain > 2 * math.log(max(2, size) / ACCIDENT)) & (t >= pure * (t + c + 1)) & (t >= COVER * n_toxic)
    )
    return Scorer(restorer, {r.feature: float(r.odds) for r in strong.select("feature", "odds").collect()}, base)


def scores(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score) for every row of ``docs``, from its whole text alone.

    A null or empty text has the base rate of toxic labels. Null ids and repeated rows stay; an empty table returns no
    row; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.score(t) for t in as_strings(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), each, "doc_id long, score double")


def op4_toxicity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    found = scores(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
