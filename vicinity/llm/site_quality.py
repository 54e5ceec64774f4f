"""Quality of documents by hierarchical empirical Bayes over sites.

Evidence of a document: the probability of high quality that a logistic classifier reads from its text's statistics.
Evidence of its host and of the path on it: the mean over their other documents (labels where there are any, else the
classifier), shrunk toward the level above: a path toward its host, a host toward the global mean. How much is shrunk is
itself estimated from the data, by the method of moments: the variance of documents within a site over the variance
between sites, of paths around their host and of hosts around the mean. Grouped sums per path, then per host, then over
all carry everything; no site is gathered. A document is left out of its own sites' sums, so that it isn't counted twice.

A document's posterior log odds are its own plus what its path's shrunk odds differ from the global ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinity.llm.common import as_strings, documents, map_arrow, written

#: About so many labelled documents that the classifier is fitted on at most, chosen by a hash of the id; its ridge.
LEARN_ROWS, RIDGE = 20_000, 1.0
#: Pseudo-counts of documents that shrinkage is held between: a rate is never wholly its level's, nor wholly its site's.
LEAST, MOST = 2.0, 1000.0
#: Documents at or above this posterior are kept, and weight of the site's evidence.
KEEP, SITE_WEIGHT = 0.5, 0.5
NAMES = ["log_words", "mean_word", "symbols", "upper", "digits", "punctuation", "distinct", "long_run", "pipes", "repeats"]


def evidence(text: str) -> list[float]:
    """Bounded statistics of one text, in the order of NAMES."""
    words = text.split()
    n = max(1, len(words))
    run = best = 0
    last = None
    for w in words:
        run = run + 1 if w == last else 1
        best, last = max(best, run), w
    pairs = len(words) - 1 - len(set(zip(words, words[1:]))) if len(words) > 1 else 0
    return [
        float(np.log1p(len(words))),
        min(20.0, len(text) / n),
        min(3.0, sum(map(text.count, "#*$%&<>")) / n),
        sum(map(str.isupper, words)) / n,
        min(1.0, sum(map(text.count, "0123456789")) / n),
        min(3.0, sum(map(text.count, ".,;:!?")) / n),
        len(set(words)) / n,
        min(1.0, best / 10),
        min(1.0, text.count("|") / n),
        pairs / n,
    ]


def measured(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, x array<double>) of every row of ``docs``."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = pa.array([evidence(t) for t in as_strings(batch.column(3))], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.columns[:3], found], ["doc_id", "host", "path", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), "text")
    return map_arrow(rows, each, "doc_id long, host string, path string, x array<double>")


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights) of a ridge logistic regression by Newton's method; the last weight is the intercept."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, penalty = np.zeros(z.shape[1]), RIDGE * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _odds(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def url_site(url: Column) -> tuple[Column, Column]:
    """(host, path) of a web address: the host without "www.", and the first part of the path; null if it has none."""
    url = F.trim(url)
    url = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    part = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), "^/*([^/]+)", 1)
    return host, F.when(host.isNotNull() & (part != ""), part)


def _strength(within: float, spread: float, free: float, room: float) -> float:
    """Pseudo-count of a prior over sites' rates, by moments: the variance within sites over that between them.

    ``spread``: the squared deviations of the sites' rates from the level above, weighted by size; ``free``: its degrees
    of freedom, and ``room`` what it would be for a unit variance between sites.
    """
    between = (spread - within * free) / room if room > 0 else 0.0
    return float(min(MOST, max(LEAST, within / between))) if between > 0 else MOST


def strengths(paths: DataFrame) -> tuple[float, float, float, float]:
    """(documents, sum, host strength, path strength) from (host, path, n, s, q): sums of the evidence and its squares."""
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.count("*").alias("k"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    )
    own = F.col("s") * F.col("s") / F.col("n")
    r = hosts.agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("k").alias("paths"), F.count("*").alias("hosts"),
        F.sum(own).alias("own"), F.sum("between").alias("between"), F.sum(F.col("n") * F.col("n")).alias("hh"),
        F.sum(F.col("nn") / F.col("n")).alias("pp"),
    ).first()
    if not r["n"]:
        return 0.0, 0.0, MOST, MOST
    in_path = max(0.0, r["q"] - r["between"]) / max(1.0, r["n"] - r["paths"])
    in_host = max(0.0, r["q"] - r["own"]) / max(1.0, r["n"] - r["hosts"])
    a = _strength(in_host, r["own"] - r["s"] ** 2 / r["n"], r["hosts"] - 1, r["n"] - r["hh"] / r["n"])
    b = _strength(in_path, r["between"] - r["own"], r["paths"] - r["hosts"], r["n"] - r["pp"])
    return r["n"], r["s"], a, b


def posteriors(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """(doc_id, host, path, own, host_rate, path_rate, posterior, kept) for every row of ``docs``.

    ``host`` and ``path`` are columns of ``docs`` (for web pages those of ``url_site``): its source and, within it, its
    language, unless given. The rates of a document's host and path are those of their other documents; on a path, or a
    host, of its own it has the rate of the level above. ``labels`` has (doc_id, quality 0/1); null ids and labels teach nothing, several labels of an id count as their mean. A null host
    or path is a site of its own. A null or empty text has the evidence of one without words. Without labels of both
    kinds, own is 0.5 everywhere. Repeated rows stay; an empty table returns no row.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = written(measured(docs, host, path), "evidence")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("quality"))
    known = written(known, "quality-labels")
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("site-quality")), 11) / F.lit(float(1 << 53))
    chosen = known.where(u < F.lit(LEARN_ROWS / max(1, known.count())))
    # a row for each label, however often its document repeats
    taught = rows.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.min("quality").alias("quality")).orderBy("doc_id").toPandas()
    y = (taught["quality"].to_numpy(np.float64) >= 0.5).astype(float)
    if len(y) and 0 < y.sum() < len(y):
        mean, scale, w = fit(np.array(taught["x"].tolist()), y)
        terms = [(F.get("x", F.lit(i)) - float(mean[i])) / float(scale[i]) * float(w[i]) for i in range(len(NAMES))]
        line = sum(terms, F.lit(float(w[-1])))
        own = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), line))))
    else:
        own = F.lit(0.5)
    scored = rows.select("doc_id", "host", "path", own.alias("own")).join(known, "doc_id", "left")
    scored = written(scored.withColumn("seen", F.coalesce("quality", "own")), "scored")
    # sums per path first; hosts and the whole add those up
    seen = F.col("seen")
    paths = written(
        scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum(seen).alias("s"), F.sum(seen * seen).alias("q")), "paths"
    )
    total, all_seen, a, b = strengths(paths)
    overall = all_seen / total if total else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s")).withColumnRenamed("host", "h0")
    sites = paths.join(hosts, F.col("host").eqNullSafe(F.col("h0"))).select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "s", "host_n", "host_s")
    joined = scored.join(written(sites, "sites"), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    # the document itself is left out of its sites; sums that are 0 but for rounding stay in range
    host_rate = (F.col("host_s") - seen + a * overall) / (F.col("host_n") - 1 + a)
    joined = joined.withColumn("host_rate", host_rate).withColumn("path_rate", (F.col("s") - seen + b * F.col("host_rate")) / (F.col("n") - 1 + b))
    odds = _odds(F.col("own")) + SITE_WEIGHT * (_odds(F.col("path_rate")) - _odds(F.lit(float(overall))))
    posterior = 1 / (1 + F.exp(-odds))
    return joined.select(
        "doc_id", "host", "path", "own", "host_rate", "path_rate", posterior.alias("posterior"), (posterior >= KEEP).alias("kept")
    )


def op10_site_quality(spark, sf_dir):
    return posteriors(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
