"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Sources in code point order (null last) weigh 3, 1, 2, repeating, and share ``SHARE`` times all words. A target stops
at ``MOST`` times its source's words; the excess is shared again by weight (water filling). A source takes its documents
in complete epochs first; the rest of its target goes to the documents with the smallest exponential keys -ln(u) / w,
where u is a hash of the document in (0, 1) and w its quality weight, as far as their prefix sums fit the rest. What a
document too long for the end of the budget leaves open goes, by the same rule, to the next ones that fit it, in
``ROUNDS`` rounds; documents are never cut.

Keys are cut into ordered buckets, ``OCTAVE`` for each power of two: as keys of weight w are exponential draws divided
by w, weights only shift them, and no bucket holds more than about 1 / OCTAVE of a source's documents, whatever the
weights. Documents without a weight come last, in buckets of their tie-breaking hash. Sums per source and bucket
(aggregated before they are shuffled) show in which bucket a source's budget ends, and only that bucket's documents are
sorted: a source that holds most rows is never sorted, nor gathered, as a whole.

Hashes are parts of an MD5 sum, so that plain SQL can repeat the draw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinity.llm.common import WORD, documents, written

WEIGHTS, SHARE, MOST, ROUNDS = (3, 1, 2), 1.5, 2, 3
#: Buckets for each power of two of the keys; the number of the first bucket of rows without a weight, which is above all others.
OCTAVE, WEIGHTLESS = 4096, 1 << 20


def words(text: Column) -> Column:
    """Number of words; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Default quality weight: 1 for 50 words or more of 3 to 12 characters on average, 0.5 if one fails, 0.25 if both do."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.when(size >= 50, 1.0).otherwise(0.5) * F.when(mean.between(3, 12), 1.0).otherwise(0.5)


def _digest() -> Column:
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.md5(F.concat(part(F.col("doc_id").cast("string")), F.lit("|"), part(F.col("source")), F.lit("|"), F.md5(part(F.col("text")))))


def _digits(digest: Column, start: int, count: int) -> Column:
    """Hexadecimal digits as a number."""
    return F.conv(F.substring(digest, start, count), 16, 10).cast("long")


def _key(u: Column, weight: Column) -> Column:
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def _bucket(key: Column, tie: Column) -> Column:
    """The bucket's number, which never falls as (key, tie) rises."""
    return F.when(key < float("inf"), F.floor(F.log2(key) * OCTAVE)).otherwise(WEIGHTLESS + F.shiftright(tie, 48)).cast("int")


def _running(rows: DataFrame, order: list[str], *names: str) -> DataFrame:
    """Adds, for each of the columns, its sum over all rows before a row (``before_x``) and over all rows (``all_x``).

    Ranges of the order are dealt out and written; a range starts from the sums of the ranges before it, which are a row
    a task. So no task sorts all rows.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    per = ranged.groupBy("__range").agg(*[F.sum(n).alias(n) for n in names])
    past, every = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    none = F.lit(0).cast("double")
    starts = per.select(
        F.col("__range").alias("__r"),
        *[F.coalesce(F.sum(n).over(past), none).alias(f"__start_{n}") for n in names],
        *[F.sum(n).over(every).cast("double").alias(f"all_{n}") for n in names],
    )
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(starts), F.col("__range") == F.col("__r"))
    sums = {f"before_{n}": F.col(f"__start_{n}") + F.coalesce(F.sum(n).over(inside), none) for n in names}
    return joined.withColumns(sums).drop("__range", "__r", *[f"__start_{n}" for n in names])


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows of (source, size): one row a source.

    Closed-form water filling: by rising capacity per weight, a source is full if the level that the sources from it on
    would share reaches its capacity. Sources may be many: no task sees them all.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # a null comes last: by its flag, then by code point
    per = per.withColumns({"none": F.col("source").isNull().cast("int"), "name": F.coalesce("source", F.lit("")), "one": F.lit(1)})
    per = _running(per, ["none", "name"], "one")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("before_one") % len(WEIGHTS) + 1).cast("int"))
    per = per.select(
        "source", "source_size", F.col("before_one").alias("place"), weight.cast("double").alias("weight"),
        F.col("source_size").cast("double").alias("words"), (F.col("source_size") * F.lit(float(most))).alias("cap"),
    )
    per = _running(per.withColumn("full_at", F.col("cap") / F.col("weight")), ["full_at", "place"], "cap", "weight", "words")
    left = F.col("all_words") * F.lit(float(share)) - F.col("before_cap")
    per = written(per.withColumn("level", left / (F.col("all_weight") - F.col("before_weight"))), "levels")
    # the first source that isn't full sets the level; from it on, levels fall
    level = per.where(F.col("level") * F.col("weight") < F.col("cap")).agg(F.max("level")).first()[0]
    target = F.col("cap") if level is None else F.least(F.col("cap"), F.col("weight") * F.lit(float(level)))
    return per.select("source", "source_size", target.alias("target"))


def _round(rows: DataFrame, r: int) -> DataFrame:
    """One row a source: where round ``r`` of the fractional epoch ends, and the budget that it leaves.

    ``rows`` are the sized rows with their source's goals. A round takes the prefix, in key order, of the documents that
    are not taken yet and fit the budget, as far as the budget goes.
    """
    rest = F.col(f"rest{r}")
    rows = rows.where(~_taken(r) & (F.col("size") <= rest))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.first(rest).alias("rest"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("size").over(run))
    over = F.col("upto") > F.col("rest")
    ends = sums.groupBy("source").agg(
        F.coalesce(F.min(F.when(over, F.col("bucket"))), F.lit(2 * WEIGHTLESS)).alias("end"),
        F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("before"),
    )
    ends = ends.select(F.col("source").alias("s"), "end", "before")
    edge = rows.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("end")))
    # rows that agree in key and hash are repeated ones, taken together: added up before they are shuffled
    edge = edge.groupBy("source", "key", "tie").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first(rest).alias(f"rest{r}"))
    order = Window.partitionBy("source").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("upto", F.col("before") + F.sum("size").over(order)).where(F.col("upto") <= rest)
    last = edge.groupBy("source").agg(F.max(F.struct("key", "tie")).alias("last"), F.max("upto").alias("upto"))
    return ends.join(last, F.col("s").eqNullSafe(F.col("source")), "left").select(
        "s", F.col("end").alias(f"end{r}"), F.col("last").alias(f"last{r}"), F.coalesce("upto", "before").alias("used")
    )


def _taken(rounds: int) -> Column:
    """Whether the first ``rounds`` rounds take a row that carries its source's goals."""
    taken = F.lit(False)
    for r in range(rounds):
        inside = (F.col("bucket") < F.col(f"end{r}")) | (
            (F.col("bucket") == F.col(f"end{r}")) & (F.struct("key", "tie") <= F.col(f"last{r}"))
        )
        fits = (F.col("size") <= F.col(f"rest{r}")) & (F.col(f"rest{r}") > 0)
        taken = taken | (fits & F.coalesce(inside, F.lit(False)))
    return taken


def _with_goals(rows: DataFrame, goals: DataFrame) -> DataFrame:
    return rows.join(goals, F.col("source").eqNullSafe(F.col("goal_source")))


def _cutoffs(sized: DataFrame, share: float, most: float) -> DataFrame:
    """One row a source: its target, complete epochs and each round's end. Written, so that Spark knows its size."""
    goals = targets(sized.groupBy("source").agg(F.sum("size").alias("size")), share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goals = goals.withColumn("epochs", epochs).withColumn("rest0", F.col("target") - F.col("epochs") * F.col("source_size"))
    goals = written(goals.withColumnRenamed("source", "goal_source"), "goals")
    for r in range(ROUNDS):
        ends = _round(_with_goals(sized, goals), r)
        goals = goals.join(ends, F.col("goal_source").eqNullSafe(F.col("s")), "left").drop("s")
        rest = F.col(f"rest{r}") - F.coalesce(F.col("used"), F.lit(0))
        goals = written(goals.withColumn(f"rest{r + 1}", rest).drop("used"), "goals")
    return goals


def _named(weight: Column | None) -> list[Column]:
    return [] if weight is None else [weight.alias("__weight")]


def _keyed(rows: DataFrame, weight: Column | None) -> DataFrame:
    rows = rows.withColumns({"size": words(F.col("text")), "__digest": _digest()})
    u = (_digits(F.col("__digest"), 1, 13) + F.lit(0.5)) / F.lit(float(1 << 52))
    weight = quality(F.col("text"), F.col("size")) if weight is None else F.col("__weight")
    rows = rows.withColumns({"key": _key(u, weight), "tie": _digits(F.col("__digest"), 14, 15)})
    return rows.withColumn("bucket", _bucket(F.col("key"), F.col("tie")))


def _sized(docs: DataFrame, weight: Column | None) -> DataFrame:
    rows = _keyed(docs.select("doc_id", "text", "source", *_named(weight)), weight)
    return rows.select("doc_id", "source", "size", "key", "tie", "bucket")


def _goals(docs: DataFrame, weight: Column | None, share: float, most: float) -> tuple[DataFrame, DataFrame]:
    sized = written(_sized(docs, weight), "sized")
    return sized, _cutoffs(sized, share, most)


def _with_copies(rows: DataFrame, goals: DataFrame) -> DataFrame:
    return _with_goals(rows, goals).withColumn("copies", (F.col("epochs") + _taken(ROUNDS).cast("int")).cast("int"))


def assignments(docs: DataFrame, weight: Column | None = None, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, tie, size, source_size, target, copies) for every row of ``docs``.

    ``weight``: the documents' quality weights (a column of ``docs``; 0 or null: taken last). A null source is a source
    of its own, a null or empty text has size 0 and is taken in complete epochs or, if there is one, in the fraction.
    Rows that agree in doc_id, text and source are taken or left together. ``most`` may be fractional; reruns agree.
    An empty table returns no row. Other columns are not read.
    """
    sized, goals = _goals(docs, weight, share, most)
    return _with_copies(sized, goals).select("doc_id", "source", "tie", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weight: Column | None = None, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` as often as the mix takes each row: rows of 0 copies go, others repeat. Keeps the columns of ``docs``.

    A task returns its documents once, then those that are taken again, so that copies don't stand side by side.
    """
    _, goals = _goals(docs, weight, share, most)
    rows = _keyed(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("__row"), *_named(weight)), weight)
    copied = _with_copies(rows.select("source", "size", "key", "tie", "bucket", "__row"), goals)
    copied = copied.where("copies > 0").select("__row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy"))
    return copied.sortWithinPartitions("__copy").select("__row.*")


def oracle_sql() -> str:
    """The whole draw in DuckDB SQL, over all rows of ``documents``, by plain windows."""
    text, word = "coalesce(text, '')", r"[^\x20\x09-\x0D]+"
    parts = [f"""docs AS (SELECT doc_id, source, text, len(regexp_extract_all({text}, '{word}')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || md5({text})) AS h FROM documents),
keyed AS (SELECT row_number() OVER () AS n, doc_id, source, size, CAST('0x' || substr(h, 14, 15) AS BIGINT) AS tie,
    -ln((CAST('0x' || substr(h, 1, 13) AS BIGINT) + 0.5::DOUBLE) / {1 << 52}::DOUBLE) / ((CASE WHEN size >= 50 THEN 1.0::DOUBLE ELSE 0.5 END)
    * (CASE WHEN length(text) / greatest(size, 1) BETWEEN 3 AND 12 THEN 1.0::DOUBLE ELSE 0.5 END)) AS key FROM docs),
per AS (SELECT source, sum(size) AS source_size, list_extract({list(WEIGHTS)}, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS place FROM keyed GROUP BY source),
full_ AS (SELECT *, source_size * {float(MOST)}::DOUBLE AS cap, sum(source_size) OVER () * {SHARE}::DOUBLE AS budget FROM per),
levels AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM full_),
goals AS (SELECT source, source_size, least(cap, coalesce(w * (SELECT max(level) FROM levels WHERE level * w < cap), cap)) AS target FROM levels),
r0 AS (SELECT k.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs,
    g.target - (CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END) * g.source_size AS rest, 0 AS taken
    FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source)"""]
    for r in range(ROUNDS):
        parts.append(f"""s{r} AS (SELECT n, size, rest, sum(size) OVER (PARTITION BY source ORDER BY key, tie RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM r{r} WHERE taken = 0 AND size <= rest AND rest > 0),
t{r} AS (SELECT n, size FROM s{r} WHERE upto <= rest),
u{r} AS (SELECT source, sum(t.size) AS used FROM r{r} JOIN t{r} t USING (n) GROUP BY source),
r{r + 1} AS (SELECT r.* REPLACE (r.rest - coalesce(u.used, 0) AS rest, CASE WHEN t.n IS NULL THEN r.taken ELSE 1 END AS taken)
    FROM r{r} r LEFT JOIN t{r} t ON t.n = r.n LEFT JOIN u{r} u ON u.source IS NOT DISTINCT FROM r.source)""")
    return f"""WITH {", ".join(parts)} SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
    CAST((epochs + taken) * size AS BIGINT) AS taken FROM r{ROUNDS}"""


def op2_mix_sources(spark, sf_dir):
    rows = assignments(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
