"""Row types of the engine, as Spark DDL."""

PAYLOAD = """
id STRING,
transaction STRUCT<amount: DOUBLE, installments: DOUBLE, requested_at: STRING>,
customer STRUCT<avg_amount: DOUBLE, tx_count_24h: DOUBLE, known_merchants: ARRAY<STRING>>,
merchant STRUCT<id: STRING, mcc: STRING, avg_amount: DOUBLE>,
terminal STRUCT<is_online: BOOLEAN, card_present: BOOLEAN, km_from_home: DOUBLE>,
last_transaction STRUCT<timestamp: STRING, km_from_current: DOUBLE>
"""

REFERENCE = "vector ARRAY<FLOAT>, label STRING"

NORMALIZATION = (
    "max_amount DOUBLE, max_installments DOUBLE, amount_vs_avg_ratio DOUBLE, max_minutes DOUBLE, max_km DOUBLE, "
    "max_tx_count_24h DOUBLE, max_merchant_avg_amount DOUBLE"
)

#: ``request`` keeps the payload as JSON text, which is parsed with PAYLOAD like any other request.
LABELED = """
references_checksum_sha256 STRING,
entries ARRAY<STRUCT<request: STRING, expected_approved: BOOLEAN, expected_fraud_score: DOUBLE>>
"""
