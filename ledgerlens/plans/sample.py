"""Transfers derived from the ``events`` table, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types of labelled patterns.
PATTERN_TYPES = ("FAN-OUT", "FAN-IN", "CYCLE", "GATHER-SCATTER", "SCATTER-GATHER", "BIPARTITE", "STACK", "RANDOM")
FORMATS = {"click": "ACH", "view": "Cheque", "purchase": "Credit Card", "signup": "Wire", "error": "Cash"}
CURRENCIES = ("US Dollar", "Euro", "UK Pound", "Yen", "Rupee")


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic transfers with ties, self-transfers, labels and scores."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = events.agg((F.max("user_id") + 1).alias("n"))
    e = F.col("event_id")
    third = e % 3 == 0
    currency = F.element_at(F.array(*[F.lit(c) for c in CURRENCIES]), (e % 5 + 1).cast("int"))
    label = F.when(e % 37 == 0, 1).otherwise(0)
    kind = F.element_at(F.array(*[F.lit(p) for p in PATTERN_TYPES]), (F.floor(e / 2) % 8 + 1).cast("int"))
    return events.join(F.broadcast(users)).select(
        e.alias("txn_id"),
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("timestamp"),
        F.col("user_id").cast("string").alias("from_account_key"),
        ((e * 7919) % F.col("n")).cast("string").alias("to_account_key"),
        F.when(third, (e % 1000 + 9000).cast("double")).otherwise(F.col("value") * 150).alias("amount_paid"),
        F.when(third, F.lit("US Dollar")).otherwise(currency).alias("payment_currency"),
        F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])[F.col("event_type")].alias("payment_format"),
        label.alias("is_laundering"),
        F.when((label == 1) & (e % 2 == 0), kind).alias("pattern_type"),
        (((e * 104729) % 1000).cast("double") / 1000 * 0.7 + label * 0.3).alias("score"),
    )


def _case(column: str, pairs) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in pairs) + " END"


#: The same rows in DuckDB, for the queries' SQL; ends with an open WITH list.
TRANSFERS_SQL = f"""WITH users AS (SELECT max(user_id) + 1 AS n FROM events),
txns AS (
  SELECT event_id AS txn_id, CAST(date_trunc('minute', ts) AS TIMESTAMP) AS "timestamp",
    CAST(user_id AS VARCHAR) AS from_account_key, CAST((event_id * 7919) % n AS VARCHAR) AS to_account_key,
    CASE WHEN event_id % 3 = 0 THEN CAST(9000 + event_id % 1000 AS DOUBLE) ELSE value * 150 END AS amount_paid,
    CASE WHEN event_id % 3 = 0 THEN 'US Dollar' ELSE {_case("event_id % 5", enumerate(CURRENCIES))} END AS payment_currency,
    {_case("event_type", FORMATS.items())} AS payment_format,
    CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END AS is_laundering,
    CASE WHEN event_id % 37 = 0 AND event_id % 2 = 0 THEN {_case("(event_id // 2) % 8", enumerate(PATTERN_TYPES))} END AS pattern_type,
    CAST((event_id * 104729) % 1000 AS DOUBLE) / 1000 * 0.7 + CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END * 0.3 AS score
  FROM events, users
)"""
