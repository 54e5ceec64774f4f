"""Card transactions derived from the events table, as JSON request bodies, and the same in SQL.

The constants are synthetic: the originals are not public.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NORM = {
    "max_amount": 500.0, "max_installments": 12.0, "amount_vs_avg_ratio": 10.0, "max_minutes": 1440.0, "max_km": 1000.0,
    "max_tx_count_24h": 20.0, "max_merchant_avg_amount": 500.0,
}
#: Event type -> category code; the code of "signup" has no risk, so that it gets the default.
MCC = {"click": "5411", "view": "5812", "purchase": "5999", "error": "0742", "signup": "4829"}
RISK = {"5411": 0.15, "5812": 0.3, "5999": 0.5, "0742": 0.8}


def risks(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{mcc}', {risk}D)" for mcc, risk in RISK.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(mcc, risk)")  # of known size, so that Spark broadcasts it


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each event: what its payload is made of. Windows are partitioned by user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    base = events.select(
        "event_id", "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("sec"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    user = Window.partitionBy("user_id").orderBy("sec", "event_id")
    past = user.rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("user_id", "k").orderBy("sec", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.select(
        "*",
        F.coalesce(F.sum("cents").over(past), F.lit(0)).alias("prior_sum"),
        F.count("cents").over(past).alias("prior_n"),
        F.count("*").over(Window.partitionBy("user_id").orderBy("sec").rangeBetween(-86400, 0)).alias("tx_24h"),
        F.lag("sec").over(user).alias("last_sec"),
        F.lag("k").over(user).alias("last_k"),
        (F.count("*").over(same) > 0).alias("known"),
    )
    merchants = base.groupBy("k").agg((F.sum("cents") / F.count("cents") / 100).alias("merchant_avg"))
    return rows.join(merchants, "k")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, body, event_type): every 97th body is cut short, and so can't be read."""
    t = transactions(spark, sf_dir)
    iso = lambda sec: F.date_format(F.timestamp_seconds(sec), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    merchant = F.concat(F.lit("MERC-"), F.col("k").cast("string"))
    mcc = F.element_at(F.create_map(*[F.lit(x) for pair in MCC.items() for x in pair]), F.col("event_type"))
    average = F.when(F.col("prior_n") == 0, F.lit(0.0)).otherwise(F.col("prior_sum") / F.greatest("prior_n", F.lit(1)) / 100)
    last = F.when(
        F.col("last_sec").isNotNull(),
        F.struct(iso(F.col("last_sec")).alias("timestamp"), (F.abs(F.col("k") - F.col("last_k")) * F.lit(10.0)).alias("km_from_current")),
    )
    payload = F.struct(
        F.col("event_id").cast("string").alias("id"),
        F.struct((F.col("cents") / 100).alias("amount"), (1 + F.col("k") % 12).alias("installments"), iso(F.col("sec")).alias("requested_at")).alias("transaction"),
        F.struct(average.alias("avg_amount"), F.col("tx_24h").alias("tx_count_24h"), F.when(F.col("known"), F.array(F.lit("MERC-X"), merchant)).otherwise(F.array(F.lit("MERC-X"))).alias("known_merchants")).alias("customer"),
        F.struct(merchant.alias("id"), mcc.alias("mcc"), F.col("merchant_avg").alias("avg_amount")).alias("merchant"),
        F.struct(F.col("event_type").isin("view", "click").alias("is_online"), (F.col("event_type") == "purchase").alias("card_present"), (F.col("k") * 37 % 1000).cast("double").alias("km_from_home")).alias("terminal"),
        last.alias("last_transaction"),
    )
    text = F.to_json(payload, {"ignoreNullFields": "false"})
    cut = F.when(F.col("event_id") % 97 == 0, F.substring(text, 1, 120)).otherwise(text)
    return t.select(F.col("event_id").alias("qid"), cut.alias("body"), "event_type", "cents", "known")


#: The transactions as a DuckDB common table expression "tx".
SQL = """
base AS (SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k,
    CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(round(value * 100) AS BIGINT) AS cents FROM events),
rows_ AS (SELECT *,
    coalesce(sum(cents) OVER past, 0) AS prior_sum, count(cents) OVER past AS prior_n,
    count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS tx_24h,
    lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS last_sec,
    lag(k) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS last_k,
    count(*) OVER (PARTITION BY user_id, k ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS known
    FROM base WINDOW past AS (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
merchants AS (SELECT k, sum(cents) / count(cents) / 100 AS merchant_avg FROM base GROUP BY k),
tx AS (SELECT * FROM rows_ JOIN merchants USING (k))
"""


def clamp_sql(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN 0 WHEN {x} > 1 THEN 1 ELSE {x} END"


#: SQL of each dim as a double; the -1 of a missing last transaction included.
DIMS_SQL = [
    clamp_sql("(cents / 100) / 500"),
    clamp_sql("(1 + k % 12) / 12"),
    f"CASE WHEN prior_n = 0 OR prior_sum = 0 THEN CASE WHEN cents > 0 THEN 1.0 ELSE 'nan'::DOUBLE END ELSE {clamp_sql('(cents / 100) / (prior_sum / prior_n / 100) / 10')} END",
    "((sec // 3600) % 24) / 23",
    "((sec // 86400 + 3) % 7) / 6",
    f"CASE WHEN last_sec IS NULL THEN -1 ELSE {clamp_sql('((sec - last_sec) / 60) / 1440')} END",
    f"CASE WHEN last_sec IS NULL THEN -1 ELSE {clamp_sql('(abs(k - last_k) * 10.0::DOUBLE) / 1000')} END",
    clamp_sql("(k * 37 % 1000) / 1000"),
    clamp_sql("tx_24h / 20"),
    "CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END",
    "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END",
    "CASE WHEN known THEN 0 ELSE 1 END",
    "CASE event_type WHEN 'click' THEN 0.15 WHEN 'view' THEN 0.3 WHEN 'purchase' THEN 0.5 WHEN 'error' THEN 0.8 ELSE 0.5 END",
    clamp_sql("merchant_avg / 500"),
]
