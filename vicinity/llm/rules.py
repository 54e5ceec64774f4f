"""Learned quality rules: a decision list over interpretable statistics of a text.

Sequential covering (in the manner of RIPPER): a rule for the rarer class, bad documents, is grown on part of the
labelled rows, one threshold condition at a time by FOIL's information gain; it is pruned on the rest by dropping its
last conditions while (p - n) / (p + n) does not fall; the rows that it covers are taken away and the next rule is
learned, until a rule is no longer right more often than ``PRECISION`` on the rows set aside. The list is emitted as
one ordered Spark expression: CASE WHEN rule THEN false ... ELSE true END.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import as_strings, documents, map_arrow, written

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 3
#: About so many labelled rows are learned from at most, chosen by a hash of the id.
LEARN_ROWS = 20_000
#: A rule needs so many bad rows to grow from, so many conditions at most, and this precision on rows set aside.
COVER, CONDITIONS, RULES, PRECISION, CUTS = 8, 4, 16, 0.9, 64

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_chars_text", "n_lines", "n_upper", "n_digits", "n_punct", "n_distinct", "n_short_lines", "max_word_run"]


def repeat_words(words: list[str]) -> int:
    """Words inside ``WINDOW``-word windows that stand twice or more in the text, the first ones included."""
    if len(words) <= WINDOW:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    key, size = ids[:-2], len(number)
    if size < 2_000_000:
        key = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        for part in (ids[1:-1], ids[2:]):
            key = np.unique(key * size + part, return_inverse=True)[1]
    _, at, n = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(n[at] > 1)
    covered = np.zeros(len(words), bool)
    for k in range(WINDOW):
        covered[starts + k] = True
    return int(covered.sum())


def statistics(text: str) -> tuple[int, ...]:
    """COUNTS, then MORE, of one text."""
    # bytes.split() cuts at the contract's six blanks only; str.split() at others too
    words = [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]
    word_chars = len(text) - sum(map(text.count, SPACES))
    lines = text.split("\n")
    full = [line for line in lines if line.strip(SPACES)]
    runs = best = 0
    last = None
    for w in words:
        runs = runs + 1 if w == last else 1
        best, last = max(best, runs), w
    upper = sum(map(str.isupper, words))
    return (
        len(words), word_chars, sum(map(text.count, SYMBOLS)), len(full) - len(set(full)), repeat_words(words),
        len(text), len(full), upper, sum(map(text.count, "0123456789")), sum(map(text.count, ".,;:!?")),
        len(set(words)), sum(len(line) < 30 for line in full), best,
    )


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS, MORE) for every row of ``docs``; a null or empty text has 0 everywhere.

    Null ids and repeated rows stay as they are; other columns are not read.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([statistics(t) for t in as_strings(batch.column(1))], np.int64).T
        return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], ["doc_id", *COUNTS, *MORE])

    schema = ", ".join(f"{n} long" for n in ["doc_id", *COUNTS, *MORE])
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), each, schema)


def features() -> dict[str, Column]:
    """Named ratios of the counts, as Spark columns; no divisor is 0."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_chars_text"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / lines,
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / words,
        "digit_share": F.col("n_digits") / chars,
        "punct_per_word": F.col("n_punct") / words,
        "distinct_share": F.col("n_distinct") / words,
        "words_per_line": F.col("n_words") / lines,
        "short_line_share": F.col("n_short_lines") / lines,
        "longest_run": F.col("max_word_run").cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        x = table[self.feature]
        return x > self.threshold if self.above else x <= self.threshold

    def column(self, named: dict[str, Column]) -> Column:
        x = named[self.feature]
        return x > F.lit(self.threshold) if self.above else x <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, table: dict[str, np.ndarray]) -> np.ndarray:
    size = len(next(iter(table.values())))
    out = np.ones(size, bool)
    for condition in rule:
        out &= condition.holds(table)
    return out


def _grow(table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Conditions by rising information gain until only bad rows are covered, or none helps."""
    rule: list[Condition] = []
    inside = np.ones(len(bad), bool)
    while len(rule) < CONDITIONS and inside.any() and not bad[inside].all():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
        for name, x in table.items():
            order = np.argsort(x[inside], kind="stable")
            values, hits = x[inside][order], bad[inside][order]
            ends = np.flatnonzero(np.diff(values) > 0)
            if len(ends) > CUTS:
                ends = ends[np.linspace(0, len(ends) - 1, CUTS).astype(int)]
            below = np.cumsum(hits)
            for above in (False, True):
                p = (p0 - below[ends]) if above else below[ends]
                size = (len(values) - ends - 1) if above else ends + 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p >= COVER, p * (np.log2(p / size) - base), -1)
                if len(gain) and gain.max() > best[0] + 1e-9:
                    i = int(gain.argmax())
                    best = float(gain[i]), Condition(name, above, float((values[ends[i]] + values[ends[i] + 1]) / 2))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(table)
    return tuple(rule)


def _prune(rule: Rule, table: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    def worth(r: Rule) -> float:
        inside = covers(r, table)
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    best = rule
    for cut in range(len(rule) - 1, 0, -1):
        if worth(rule[:cut]) >= worth(best):
            best = rule[:cut]
    return best


def learn_list(table: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Ordered rules for bad rows. ``table``: a vector for each feature. Empty if there are too few bad or good rows."""
    rules: list[Rule] = []
    aside = np.arange(len(bad)) % 3 == 0
    left = np.ones(len(bad), bool)
    while len(rules) < RULES:
        grow, prune = left & ~aside, left & aside
        if bad[grow].sum() < COVER or not (~bad[grow]).any():
            break
        rule = _grow({k: v[grow] for k, v in table.items()}, bad[grow])
        if not rule:
            break
        rule = _prune(rule, {k: v[prune] for k, v in table.items()}, bad[prune])
        inside = covers(rule, table)
        p, n = (inside & prune & bad).sum(), (inside & prune & ~bad).sum()
        if p == 0 or p / (p + n) < PRECISION:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def as_column(rules: list[Rule], otherwise: Column) -> Column:
    """CASE WHEN rule THEN false ... ELSE otherwise END."""
    named, out = features(), None
    for rule in rules:
        test = rule[0].column(named)
        for condition in rule[1:]:
            test = test & condition.column(named)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return otherwise if out is None else out.otherwise(otherwise)


def learn(stats: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> list[Rule]:
    """The decision list from (doc_id, quality) labels and their rows of statistics.

    About ``rows`` labelled rows at most are taken, those whose hashed id is smallest. Null ids and labels teach
    nothing; a document with several labels or texts teaches each, a repeated one once.
    """
    labels = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    share = rows / max(1, labels.count())
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("rules")), 11) / F.lit(float(1 << 53))
    chosen = labels.where(u < F.lit(float(share)))
    taught = stats.join(chosen, "doc_id").select((F.col("quality") == 0).alias("bad"), "doc_id", *(c.alias(n) for n, c in features().items()))
    # repeated rows of a document teach once, so that what is gathered is bounded by the labels
    seen = taught.distinct().toPandas().sort_values(["doc_id", *features()], kind="stable")
    return learn_list({n: seen[n].to_numpy(np.float64) for n in features()}, seen["bad"].to_numpy(bool)) if len(seen) else []


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept) for every row of ``docs``.

    A text with fewer than 50 words, or more than half of whose words lie in repeated windows, fails the base; a null or
    empty one does so. An empty table returns no row; with no labels, the base alone decides.
    """
    stats = written(measured(docs), "statistics")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = as_column(learn(stats, labels), F.lit(True))
    return stats.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & kept).alias("kept"))


def op7_quality_rules(spark, sf_dir):
    return verdicts(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
