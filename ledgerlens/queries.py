"""Every operator as a query over the test tables, with the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .functions import clauses as X
from .functions import expressions as P
from .operators import aggregates as A
from .operators import boosting as H
from .operators import drift as D
from .operators import features as W
from .operators import graph as G
from .operators import metrics as M
from .operators import model as ML
from .operators import rules as R
from .operators import triage as Q
from .operators.windows import DAY, Measure, account_windows, asof_join, at_account, legs
from .plans.sample import PATTERN_TYPES, TRANSFERS_SQL, transfers
from .sources import scratch
from .sources import transfers as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_rates = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in C.FX_RATES.items())
USD = f"{TRANSFERS_SQL}, usd AS (SELECT *, amount_paid * CASE payment_currency {_rates} END AS amount_paid_usd FROM txns)"
#: Rows by time in three splits, as the metrics and drift queries use them.
SPLIT = f"""{USD}, placed AS (SELECT *, row_number() OVER (ORDER BY "timestamp", txn_id) AS pos, count(*) OVER () AS total FROM usd),
parts AS (SELECT *, CASE WHEN pos <= CAST(floor(total * 0.6) AS BIGINT) THEN 'train' WHEN pos <= CAST(floor(total * 0.8) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM placed)"""
RANKED = f"""{USD}, ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, txn_id) AS rank FROM usd)"""
#: The shortest prefix of the ranking with 75 % recall.
QUEUE = f"""{RANKED}, cum AS (SELECT rank, sum(is_laundering) OVER (ORDER BY rank) AS hits, sum(is_laundering) OVER () AS total FROM ranked),
queue AS (SELECT *, rank <= (SELECT min(rank) FROM cum WHERE hits >= 0.75 * total) AS in_alert_queue FROM ranked)"""

#: Scores with their positives and rows, and both added up from the highest score.
GROUPS = f"""{TRANSFERS_SQL}, g AS (SELECT score, sum(is_laundering) AS pos, count(*) AS n FROM txns GROUP BY score),
cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS k, sum(pos) OVER () AS t, sum(n) OVER () AS m FROM g)"""


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def usd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.add_usd_amount(transfers(spark, sf_dir))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.alert_queue(M.ranked(usd(spark, sf_dir)), 0.75)


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.time_ordered_split(usd(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def r6(*columns: str) -> str:
    return ", ".join(f"round({c.rpartition(' AS ')[0] or c}, 6) AS {c.rpartition(' AS ')[2]}" for c in columns)


# --- sources and sinks ---------------------------------------------------------------------------------------------


def raw_transactions(t: DataFrame) -> DataFrame:
    """Text fields of a raw file from transfers, its bank numbers with leading zeros."""
    text = lambda c: F.col(c).cast("string")
    return t.select(
        F.date_format("timestamp", S.TIME_FORMAT), F.lit("010"), F.concat(F.col("from_account_key"), F.lit("F")), F.lit("020"), F.concat(F.col("to_account_key"), F.lit("F")),
        text("amount_paid"), F.col("payment_currency"), text("amount_paid"), F.col("payment_currency"), F.col("payment_format"), text("is_laundering"),
    ).toDF(*S.TRANSACTION_FIELDS)


def write_lines(spark: SparkSession, header: list[str], rows: DataFrame, label: str) -> str:
    path = scratch.new_folder(spark, label)
    line = F.concat_ws(",", *rows.columns).alias("value")
    spark.createDataFrame([(",".join(header),)], "value string").coalesce(1).write.text(path)
    rows.select(line).coalesce(1).write.mode("append").text(path)
    return path


@query("s3_transactions_csv", f"""{TRANSFERS_SQL}, f AS (SELECT "timestamp", 10 AS from_bank, from_account_key || 'F' AS fa, to_account_key || 'F' AS ta, amount_paid, payment_currency, payment_format, is_laundering FROM txns)
SELECT CAST("timestamp" AS TIMESTAMP) AS "timestamp", CAST(10 AS BIGINT) AS from_bank, '10_' || fa AS from_account_key, '20_' || ta AS to_account_key, round(amount_paid, 6) AS amount_paid, payment_currency, payment_format, is_laundering, CAST(row_number() OVER (ORDER BY "timestamp", fa, ta, amount_paid, payment_currency, amount_paid, payment_currency, payment_format, is_laundering) - 1 AS BIGINT) AS txn_id FROM f""")
def s3(spark, sf_dir):
    """Write raw CSV files with a header line in each, then read them with validation, types, keys and ids."""
    rows = raw_transactions(transfers(spark, sf_dir))
    path = scratch.new_folder(spark, "raw")
    header = spark.createDataFrame([(",".join(S.TRANSACTION_HEADER), 0)], "value string, o int")
    body = rows.select(F.concat_ws(",", *rows.columns).alias("value"), F.lit(1).alias("o"))
    header.union(body).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    got = S.read_transactions(spark, path)
    return rounded(got.select("timestamp", "from_bank", "from_account_key", "to_account_key", "amount_paid", "payment_currency", "payment_format", "is_laundering", "txn_id"))


@query("s4_patterns", f"""{TRANSFERS_SQL} SELECT "timestamp", CAST(10 AS BIGINT) AS from_bank, from_account_key || 'F' AS from_account, round(amount_paid, 6) AS amount_paid, is_laundering, pattern_type FROM txns WHERE pattern_type IS NOT NULL""")
def s4(spark, sf_dir):
    """Block file of labelled transfers, with blank, stray and short lines, parsed again."""
    t = transfers(spark, sf_dir).filter("pattern_type is not null")
    rows = raw_transactions(t)
    lines = t.select("txn_id", "pattern_type").join(t.select("txn_id", F.concat_ws(",", *[c for c in raw_columns(t)]).alias("line")), "txn_id")
    block = F.concat(F.lit("BEGIN LAUNDERING ATTEMPT - "), F.col("pattern_type"), F.lit(":  note\n"), F.col("line"), F.lit("\n\nshort,line\nEND LAUNDERING ATTEMPT - "), F.col("pattern_type"), F.lit("\nstray,line"))
    path = scratch.new_folder(spark, "patterns")
    lines.select(block.alias("value")).write.text(path)
    got = S.read_patterns(spark, path)
    assert rows.columns == S.TRANSACTION_FIELDS
    return rounded(got.select("timestamp", "from_bank", "from_account", "amount_paid", "is_laundering", "pattern_type"))


def raw_columns(t: DataFrame) -> list:
    """The fields of ``raw_transactions`` as columns of ``t``."""
    text = lambda c: F.col(c).cast("string")
    return [F.date_format("timestamp", S.TIME_FORMAT), F.lit("010"), F.concat("from_account_key", F.lit("F")), F.lit("020"), F.concat("to_account_key", F.lit("F")), text("amount_paid"), F.col("payment_currency"), text("amount_paid"), F.col("payment_currency"), F.col("payment_format"), text("is_laundering")]


@query("s5_accounts_csv", "SELECT 'Bank ' || c_nationkey AS bank_name, CAST(c_nationkey AS BIGINT) AS bank_id, CAST(c_custkey AS VARCHAR) || 'E' AS account_number, c_nationkey || '_' || c_custkey || 'E' AS account_key FROM customer")
def s5(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    n = F.col("c_nationkey").cast("string")
    rows = c.select(F.concat(F.lit("Bank "), n), F.lpad(n, 3, "0"), F.concat(F.col("c_custkey").cast("string"), F.lit("E")), F.concat(F.lit("E"), n), F.col("c_name")).toDF(*S.ACCOUNT_FIELDS)
    path = scratch.new_folder(spark, "accounts")
    header = spark.createDataFrame([(",".join(S.ACCOUNT_HEADER), 0)], "value string, o int")
    header.union(rows.select(F.concat_ws(",", *rows.columns), F.lit(1))).coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return S.read_accounts(spark, path).select("bank_name", "bank_id", "account_number", "account_key")


@query("s6_parquet_scan", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def s6(spark, sf_dir):
    return S.read_table(spark, f"{sf_dir}/events.parquet")


@query("s7_parquet_projection", "SELECT user_id, event_type FROM events")
def s7(spark, sf_dir):
    return S.read_table(spark, f"{sf_dir}/events.parquet", ["user_id", "event_type"])


@query("s8_write_table", f"{TRANSFERS_SQL} SELECT txn_id, payment_format, CAST(\"timestamp\" AS DATE) AS day FROM txns")
def s8(spark, sf_dir):
    path = scratch.new_folder(spark, "table")
    S.write_table(transfers(spark, sf_dir), path, by_day="timestamp")
    return spark.read.parquet(path).select("txn_id", "payment_format", "day")


@query("s9_s12_artifact", f"{QUEUE} SELECT txn_id, rank, round(score, 6) AS model_score FROM queue WHERE in_alert_queue")
def s9(spark, sf_dir):
    path = scratch.new_folder(spark, "artifact")
    S.write_artifact(queue(spark, sf_dir).filter("in_alert_queue").select("txn_id", "rank", F.round("score", 6).alias("model_score")), path)
    return S.read_alerts(spark, path)


@query("s10_json_document", f"{TRANSFERS_SQL} SELECT payment_format, count(*) AS n_rows, strftime(min(\"timestamp\"), '%Y-%m-%d') AS first_day FROM txns GROUP BY 1")
def s10(spark, sf_dir):
    """A metrics document written and read again: whole numbers stay whole, days become text."""
    path = scratch.new_folder(spark, "metrics") + ".json"
    per_format = transfers(spark, sf_dir).groupBy("payment_format").agg(F.count(F.lit(1)).alias("n_rows"), F.to_date(F.min("timestamp")).alias("first_day"))
    S.write_json({"per_format": S.records(per_format)}, path)
    return S.frame(spark, S.read_json(path), "per_format")


@query("s1_config", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in C.FX_RATES.items()) + ") AS r(currency, rate)")
def s1(spark, sf_dir):
    """The rates from a YAML file."""
    path = scratch.new_folder(spark, "config") + ".yaml"
    scratch.write_text("fx_rates:\n" + "".join(f"  {k}: {v}\n" for k, v in C.FX_RATES.items()), path)
    return spark.createDataFrame(list(C.load_config(path)["fx_rates"].items()), "currency string, rate double")


@query("s11_json_records", f"""{QUEUE}, t AS (SELECT pattern_type, count(*) FILTER (WHERE is_laundering = 1) AS positives, count(*) FILTER (WHERE is_laundering = 1 AND in_alert_queue) AS caught FROM queue WHERE pattern_type IS NOT NULL GROUP BY 1)
SELECT CAST(to_json({{'pattern_type': pattern_type, 'positives': positives, 'caught': caught, 'recall': caught / nullif(positives, 0)}}) AS VARCHAR) AS json FROM t""")
def s11(spark, sf_dir):
    return S.json_rows(M.recall_per_typology(queue(spark, sf_dir)))


@query("s13_metrics_frames", f"{QUEUE} SELECT pattern_type, CAST(sum(is_laundering) AS BIGINT) AS positives, count(*) FILTER (WHERE in_alert_queue AND is_laundering = 1) AS caught FROM queue WHERE pattern_type IS NOT NULL GROUP BY ALL")
def s13(spark, sf_dir):
    document = {"recall_per_typology": S.records(M.recall_per_typology(queue(spark, sf_dir)))}
    return S.frame(spark, document, "recall_per_typology").select("pattern_type", "positives", "caught")


@query("s14_csv_export", f"{QUEUE} SELECT CAST(txn_id AS VARCHAR) AS txn_id, CAST(rank AS VARCHAR) AS rank FROM queue WHERE in_alert_queue")
def s14(spark, sf_dir):
    path = scratch.new_folder(spark, "export")
    S.write_csv(queue(spark, sf_dir).filter("in_alert_queue").select("txn_id", "rank", F.col("score").alias("feat_score"), F.col("score").alias("shap_score")), path)
    return spark.read.csv(path, header=True)


# --- projections and filters ----------------------------------------------------------------------------------------


@query("p1_fx_usd", f"{USD} SELECT txn_id, payment_currency, {r6('amount_paid_usd')} FROM usd")
def p1(spark, sf_dir):
    return rounded(usd(spark, sf_dir).select("txn_id", "payment_currency", "amount_paid_usd"))


@query("p2_large_amount", f"{USD} SELECT txn_id, amount_paid_usd > 10000 AS large FROM usd")
def p2(spark, sf_dir):
    return usd(spark, sf_dir).select("txn_id", (F.col("amount_paid_usd") > C.LARGE_AMOUNT).alias("large"))


@query("p3_band", f"{USD} SELECT txn_id FROM usd WHERE amount_paid_usd >= 9000 AND amount_paid_usd < 10000")
def p3(spark, sf_dir):
    return usd(spark, sf_dir).filter(P.in_band(F.col("amount_paid_usd"), C.LARGE_AMOUNT, C.STRUCTURING_FRACTION)).select("txn_id")


def frame_sql(days: float) -> str:
    return f"(PARTITION BY account_key ORDER BY \"timestamp\" RANGE BETWEEN INTERVAL '{days * 86400 - 0.000001:.6f}' SECOND PRECEDING AND CURRENT ROW)"


LEGS = f"""{USD}, legs AS (
  SELECT txn_id, from_account_key AS account_key, to_account_key AS counterparty, 'out' AS direction, "timestamp", amount_paid_usd FROM usd
  UNION ALL SELECT txn_id, to_account_key, from_account_key, 'in', "timestamp", amount_paid_usd FROM usd)"""
RULES = f"""{LEGS}, seen AS (
  SELECT txn_id, direction, count(*) FILTER (WHERE direction = 'out' AND amount_paid_usd >= 9000 AND amount_paid_usd < 10000) OVER {frame_sql(1)} AS band,
    count(*) FILTER (WHERE direction = 'in') OVER {frame_sql(2 / 24)} AS inflow FROM legs),
flags AS (SELECT usd.*, amount_paid_usd > 10000 AS flag_large_amount, (amount_paid_usd >= 9000 AND amount_paid_usd < 10000 AND band >= 3) AS flag_structuring, inflow > 0 AS flag_pass_through
  FROM usd JOIN seen ON usd.txn_id = seen.txn_id AND seen.direction = 'out'),
alerts AS (SELECT *, flag_large_amount OR flag_structuring OR flag_pass_through AS alert FROM flags)"""


@query("p4_w5_w6_j3_rules", f"{RULES} SELECT txn_id, flag_large_amount, flag_structuring, flag_pass_through, alert FROM alerts")
def p4(spark, sf_dir):
    return R.apply_rules(usd(spark, sf_dir)).select("txn_id", "flag_large_amount", "flag_structuring", "flag_pass_through", "alert")


@query("a2_rules_summary", f"""{RULES} SELECT count(*) AS transactions, count(*) FILTER (WHERE alert) AS alerts, count(*) FILTER (WHERE alert AND is_laundering = 1) AS true_positives, CAST(sum(is_laundering) AS BIGINT) AS positives,
  count(*) FILTER (WHERE flag_large_amount) AS large_amount, count(*) FILTER (WHERE flag_structuring) AS structuring, count(*) FILTER (WHERE flag_pass_through) AS pass_through,
  round(count(*) FILTER (WHERE alert) / count(*), 8) AS alert_rate, round(count(*) FILTER (WHERE alert AND is_laundering = 1) / count(*) FILTER (WHERE alert), 8) AS precision,
  round(count(*) FILTER (WHERE alert AND is_laundering = 1) / sum(is_laundering), 8) AS recall FROM alerts""")
def a2(spark, sf_dir):
    return R.summarise(R.apply_rules(usd(spark, sf_dir)))


@query("p6_feature_matrix", f"{USD} SELECT txn_id, CAST(amount_paid_usd AS FLOAT) AS amount_paid_usd, " + ", ".join(f"CAST(CASE WHEN payment_format = '{f}' THEN 1 ELSE 0 END AS FLOAT) AS \"payment_format_{f}\"" for f in C.PAYMENT_FORMATS) + ", CAST(is_laundering AS TINYINT) AS label FROM usd")
def p6(spark, sf_dir):
    t = usd(spark, sf_dir).select("txn_id", "timestamp", "from_account_key", "to_account_key", "amount_paid_usd", "payment_format", "is_laundering")
    x = M.feature_matrix(t)
    return M.align_features(x, [c for c in x.columns if c not in ("txn_id", "label")], keep=("txn_id", "label"))


@query("p8_tail", f"{TRANSFERS_SQL} SELECT txn_id, \"timestamp\" >= TIMESTAMP '2024-01-25' AS in_tail FROM txns")
def p8(spark, sf_dir):
    return transfers(spark, sf_dir).select("txn_id", P.in_tail(F.col("timestamp"), "2024-01-25").alias("in_tail"))


REVIEW = f"""{QUEUE}, review AS (SELECT *, score AS model_score, CAST(txn_id % 5 AS BIGINT) AS from_bank, CAST(txn_id % 7 AS BIGINT) AS to_bank, "timestamp" >= TIMESTAMP '2024-01-25' AS is_tail_population FROM queue)"""


def review(spark, sf_dir):
    return queue(spark, sf_dir).withColumns({"model_score": F.col("score"), "from_bank": F.col("txn_id") % 5, "to_bank": F.col("txn_id") % 7, "is_tail_population": P.in_tail(F.col("timestamp"), "2024-01-25")})


@query("p9_queue_filters", f"""{REVIEW} SELECT 'typology' AS f, txn_id FROM review WHERE in_alert_queue AND pattern_type IN ('CYCLE', 'STACK')
UNION ALL SELECT 'formats', txn_id FROM review WHERE in_alert_queue AND NOT is_tail_population AND payment_format IN ('ACH', 'Wire')
UNION ALL SELECT 'dates', txn_id FROM review WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04 23:59:59' AND model_score >= 0.5
UNION ALL SELECT 'search', txn_id FROM review WHERE contains(lower(from_account_key), '12') OR contains(lower(to_account_key), '12') OR CAST(from_bank AS VARCHAR) = '12' OR CAST(to_bank AS VARCHAR) = '12'""")
def p9(spark, sf_dir):
    alerts = review(spark, sf_dir)
    cases = {
        "typology": {"typologies": ["CYCLE", "STACK"]}, "formats": {"include_tail": False, "payment_formats": ["ACH", "Wire"]}, "nothing": {"typologies": []},
        "dates": {"queue_only": False, "dates": ("2024-01-03 00:00:00", "2024-01-04 23:59:59"), "min_score": 0.5}, "search": {"queue_only": False, "search": " 12 "},
    }
    tags = F.array(*[F.when(Q.queue_filter(**c), F.lit(k)) for k, c in cases.items()])
    return alerts.select(F.explode(F.array_compact(tags)).alias("f"), "txn_id")


@query("p10_bands", f"{RANKED} SELECT txn_id, CASE WHEN score >= 0.25 THEN 'significant' WHEN score >= 0.10 THEN 'moderate' ELSE 'stable' END AS band FROM ranked")
def p10(spark, sf_dir):
    return transfers(spark, sf_dir).select("txn_id", P.band(F.col("score")).alias("band"))


@query("p11_logistic", f"{TRANSFERS_SQL} SELECT txn_id, round(1 / (1 + exp(-(score * 8 - 4))), 6) AS p FROM txns")
def p11(spark, sf_dir):
    return rounded(transfers(spark, sf_dir).select("txn_id", P.logistic(F.col("score") * 8 - 4).alias("p")))


_names = [*W.feature_order(), *X.FORMAT_FEATURES, *[f"{r}_{f}" for r in ("sender", "receiver") for f in G.FEATURES], "amount_paid_usd"]
_values = ", ".join(f"('{n}')" for n in _names)


@query("p12_p14_feature_names", f"SELECT name, replace(replace(name, 'payment_format_', 'payment format: '), '_', ' ') AS pretty, regexp_matches(name, '_\\d+d_|_\\d+d$|_graph_') AS windowed FROM (VALUES {_values}) AS v(name)")
def p12(spark, sf_dir):
    return spark.createDataFrame([(n,) for n in _names], "name string").select("name", P.prettify(F.col("name")).alias("pretty"), P.is_windowed(F.col("name")).alias("windowed"))


@query("p13_table_features", f"SELECT * FROM (VALUES {', '.join(f'({i}, {chr(39)}{n}{chr(39)})' for i, n in enumerate(_names))}) AS v(place, name)")
def p13(spark, sf_dir):
    """The model's features, in order, from a stored review table's columns."""
    path = scratch.new_folder(spark, "review")
    cells = [F.lit(0.0).cast("float").alias(f"{p}_{n}") for p in ("feat", "shap") for n in _names]
    S.write_artifact(transfers(spark, sf_dir).agg(F.max("txn_id").alias("rank")).select("rank", *cells), path)
    found = S.feature_names(S.read_alerts(spark, path).columns)
    return spark.createDataFrame(list(enumerate(found)), "place int, name string")


@query("p15_amount_histogram", f"{USD} SELECT is_laundering, CAST(floor(log10(amount_paid_usd) / 0.25) AS INTEGER) AS bin, count(*) AS n_rows FROM usd WHERE amount_paid_usd > 0 GROUP BY ALL")
def p15(spark, sf_dir):
    return A.amount_histogram(usd(spark, sf_dir))


@query("p16_row_subset", f"{TRANSFERS_SQL} SELECT txn_id, payment_format FROM txns WHERE txn_id IN (SELECT event_id FROM events WHERE event_type = 'click')")
def p16(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'click'").select(F.col("event_id").alias("txn_id"))
    return transfers(spark, sf_dir).select("txn_id", "payment_format").join(wanted, "txn_id", "left_semi")


@query("p17_finite", f"{TRANSFERS_SQL} SELECT count(*) AS n_rows, count(*) FILTER (WHERE score = 0) AS n_bad FROM txns")
def p17(spark, sf_dir):
    df = transfers(spark, sf_dir).select(F.when(F.col("score") == 0, F.when(F.col("txn_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("score")).alias("x"))
    return P.finite_counts(df, "x")


# --- joins ---------------------------------------------------------------------------------------------------------


@query("j1_asof_join", f"""{TRANSFERS_SQL}, big AS (SELECT from_account_key AS k, "timestamp" AS t, max(amount_paid) AS amount FROM txns WHERE payment_format = 'Wire' GROUP BY ALL)
SELECT txn_id, round(big.amount, 6) AS asof_amount FROM txns ASOF LEFT JOIN big ON txns.from_account_key = big.k AND txns."timestamp" >= big.t""")
def j1(spark, sf_dir):
    t = transfers(spark, sf_dir)
    right = t.filter("payment_format = 'Wire'").select("from_account_key", "timestamp", F.col("amount_paid").alias("amount"))
    return rounded(asof_join(t.select("txn_id", "from_account_key", "timestamp"), right, "from_account_key", "timestamp", ["amount"]).select("txn_id", "asof_amount"))


@query("j2_pattern_join", f"{TRANSFERS_SQL} SELECT txn_id, pattern_type FROM txns")
def j2(spark, sf_dir):
    t = transfers(spark, sf_dir)
    keys = ["txn_id", "timestamp", "from_account_key", "to_account_key", "amount_paid", "payment_currency", "payment_format", "is_laundering"]
    patterns = t.filter("pattern_type is not null").select(*keys, "pattern_type")
    return A.join_pattern_types(t, patterns, keys).select("txn_id", "pattern_type")


# --- aggregations and sets -----------------------------------------------------------------------------------------


@query("a1_dataset_stats", f"""{TRANSFERS_SQL} SELECT count(*) AS n_rows, CAST(sum(is_laundering) AS BIGINT) AS positives, min("timestamp") AS first, max("timestamp") AS last, round(sum(is_laundering) / count(*), 6) AS positive_rate,
  (SELECT count(DISTINCT k) FROM (SELECT from_account_key AS k FROM txns UNION ALL SELECT to_account_key FROM txns)) AS n_accounts FROM txns""")
def a1(spark, sf_dir):
    return rounded(A.dataset_stats(transfers(spark, sf_dir)))


@query("a3_label_by_format", f"""{TRANSFERS_SQL}, t AS (SELECT count(*) AS n, sum(is_laundering) AS p FROM txns)
SELECT payment_format, count(*) AS n_rows, CAST(sum(is_laundering) AS BIGINT) AS positives, round(sum(is_laundering) / count(*), 6) AS rate, round(sum(is_laundering) / max(p), 6) AS positive_share, round((sum(is_laundering) / count(*)) / (max(p) / max(n)), 6) AS lift FROM txns, t GROUP BY payment_format""")
def a3(spark, sf_dir):
    return rounded(A.label_by(transfers(spark, sf_dir), "payment_format"))


@query("a4_daily_totals", f"""{TRANSFERS_SQL}, d AS (SELECT CAST("timestamp" AS DATE) AS day, count(*) AS n, sum(is_laundering) AS p FROM txns WHERE pattern_type = 'STACK' GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
SELECT s.day, coalesce(n, 0) AS n_rows, CAST(coalesce(p, 0) AS BIGINT) AS positives FROM s LEFT JOIN d ON s.day = d.day""")
def a4(spark, sf_dir):
    """Daily totals of one pattern, which leaves days empty."""
    return A.daily_totals(transfers(spark, sf_dir).filter("pattern_type = 'STACK'"))


@query("a5_most_active", f"""{LEGS} SELECT account_key, count(*) AS count FROM legs GROUP BY ALL ORDER BY count DESC, account_key LIMIT 20""")
def a5(spark, sf_dir):
    return A.most_active(transfers(spark, sf_dir))


@query("a6_value_counts", f"{TRANSFERS_SQL} SELECT pattern_type, count(*) AS count FROM txns WHERE pattern_type IS NOT NULL GROUP BY ALL")
def a6(spark, sf_dir):
    return A.value_counts(transfers(spark, sf_dir), "pattern_type")


@query("a7_alerted_accounts", f"""{RULES}, k AS (SELECT from_account_key AS k FROM alerts WHERE alert UNION SELECT to_account_key FROM alerts WHERE alert)
SELECT (SELECT count(*) FROM alerts WHERE alert) AS alerts, count(*) AS accounts, round(count(*) / (2 * (SELECT count(*) FROM alerts WHERE alert)), 6) AS share FROM k""")
def a7(spark, sf_dir):
    return rounded(A.alerted_accounts(R.apply_rules(usd(spark, sf_dir))))


@query("a8_duplicate_keys", "SELECT CAST(sum(n) AS BIGINT) AS duplicated_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def a8(spark, sf_dir):
    return A.duplicate_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_linenumber"])


@query("a9_match_audit", f"{TRANSFERS_SQL} SELECT count(*) FILTER (WHERE is_laundering = 1) AS positives, count(*) FILTER (WHERE is_laundering = 1 AND pattern_type IS NOT NULL) AS matched, count(*) FILTER (WHERE is_laundering = 0 AND pattern_type IS NOT NULL) AS false_matches FROM txns")
def a9(spark, sf_dir):
    return A.match_audit(transfers(spark, sf_dir))


@query("a10_day_format_shares", f"{TRANSFERS_SQL} SELECT CAST(\"timestamp\" AS DATE) AS day, " + ", ".join(f"round(count(*) FILTER (WHERE payment_format = '{f}') * 100.0 / count(*), 6) AS \"{f}\"" for f in C.PAYMENT_FORMATS) + " FROM txns GROUP BY 1")
def a10(spark, sf_dir):
    return rounded(A.day_format_shares(transfers(spark, sf_dir), C.PAYMENT_FORMATS))


@query("a11_daily_means", f"{USD} SELECT CAST(\"timestamp\" AS DATE) AS day, count(*) AS n_rows, {r6('avg(amount_paid_usd) AS amount_paid_usd', 'avg(score) AS score')} FROM usd GROUP BY 1")
def a11(spark, sf_dir):
    return rounded(A.daily_means(usd(spark, sf_dir), ["amount_paid_usd", "score"]))


@query("a12_class_means", f"{USD} SELECT is_laundering, {r6('avg(amount_paid_usd) AS amount_paid_usd', 'avg(score) AS score')} FROM usd GROUP BY 1")
def a12(spark, sf_dir):
    return rounded(A.class_means(usd(spark, sf_dir), ["amount_paid_usd", "score"]))


_described = ("amount_paid_usd", "score", "is_laundering")
_statistics = {"count": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "25%": "quantile_cont({c}, 0.25)", "50%": "quantile_cont({c}, 0.5)", "75%": "quantile_cont({c}, 0.75)", "max": "max({c})"}


@query("a13_describe", f"{USD} " + " UNION ALL ".join(f"SELECT '{k}' AS statistic, " + ", ".join(f"round(CAST({v.format(c=c)} AS DOUBLE), 6) AS {c}" for c in _described) + " FROM usd" for k, v in _statistics.items()))
def a13(spark, sf_dir):
    return rounded(A.describe(usd(spark, sf_dir), _described))


@query("a14_positive_weight", f"{SPLIT} SELECT round((count(*) - sum(is_laundering)) / sum(is_laundering), 6) AS weight FROM parts WHERE split = 'train'")
def a14(spark, sf_dir):
    return spark.createDataFrame([(round(M.positive_weight(split(spark, sf_dir).filter("split = 'train'")), 6),)], "weight double")


@query("a15_largest_day", f"{TRANSFERS_SQL}, d AS (SELECT CAST(\"timestamp\" AS DATE) AS day, count(*) AS n FROM txns GROUP BY 1) SELECT day, n AS n_rows, round(n / (SELECT sum(n) FROM d), 6) AS share FROM d ORDER BY n DESC, day LIMIT 1")
def a15(spark, sf_dir):
    return rounded(A.largest_day(transfers(spark, sf_dir)))


@query("a17_queue_stats", f"{REVIEW} SELECT count(*) AS n_shown, CAST(sum(is_laundering) AS BIGINT) AS n_positives, round(sum(is_laundering) / count(*), 6) AS precision, bool_and(in_alert_queue) AS population_exact, CAST(500 AS BIGINT) AS queue_size FROM review WHERE payment_format = 'ACH'")
def a17(spark, sf_dir):
    return rounded(Q.queue_stats(Q.apply_filters(review(spark, sf_dir), queue_only=False, payment_formats=["ACH"]), 500))


@query("a18_top_k_profile", f"""{RANKED} SELECT 'amount_paid_usd' AS feature, {r6('avg(amount_paid_usd) FILTER (WHERE rank <= 1000) AS top_mean', 'avg(amount_paid_usd) AS mean', 'max(amount_paid_usd) AS max')} FROM ranked
UNION ALL SELECT 'is_laundering', {r6('avg(is_laundering) FILTER (WHERE rank <= 1000) AS top_mean', 'avg(is_laundering) AS mean', 'max(CAST(is_laundering AS DOUBLE)) AS max')} FROM ranked""")
def a18(spark, sf_dir):
    return rounded(A.top_k_profile(M.ranked(usd(spark, sf_dir)), ["amount_paid_usd", "is_laundering"]))


@query("a19_divergence", f"{QUEUE} SELECT in_alert_queue, count(*) AS n_rows, round(avg(CASE WHEN payment_currency <> payment_format THEN 1.0 ELSE 0.0 END), 6) AS differs FROM queue GROUP BY 1")
def a19(spark, sf_dir):
    return rounded(A.divergence(queue(spark, sf_dir), "payment_currency", "payment_format"))


@query("a20_body_and_tail", f"{TRANSFERS_SQL} SELECT \"timestamp\" >= TIMESTAMP '2024-01-25' AS in_tail, count(*) AS n_rows, round(avg(is_laundering), 6) AS rate, " + ", ".join(f"round(avg(CASE WHEN payment_format = '{f}' THEN 1.0 ELSE 0.0 END), 6) AS \"share_{f}\"" for f in C.PAYMENT_FORMATS) + " FROM txns GROUP BY 1")
def a20(spark, sf_dir):
    return rounded(A.body_and_tail(transfers(spark, sf_dir), P.in_tail(F.col("timestamp"), "2024-01-25"), C.PAYMENT_FORMATS))


@query("a21_score_histogram", f"""{TRANSFERS_SQL}, h AS (SELECT is_laundering, CAST(least(floor(score * 60), 59) AS INTEGER) AS bin, count(*) AS n_rows FROM txns GROUP BY ALL)
SELECT is_laundering, bin, n_rows, round(n_rows * 60.0 / sum(n_rows) OVER (PARTITION BY is_laundering), 6) AS density FROM h""")
def a21(spark, sf_dir):
    return rounded(A.score_histogram(transfers(spark, sf_dir)))


@query("u0_held_out_rows", f"{SPLIT} SELECT txn_id, split FROM parts WHERE split IN ('val', 'test')")
def u0(spark, sf_dir):
    return split(spark, sf_dir).filter(F.col("split").isin("val", "test")).select("txn_id", "split")


@query("u1_legs", f"{LEGS} SELECT txn_id, account_key, counterparty, direction FROM legs")
def u1(spark, sf_dir):
    return legs(transfers(spark, sf_dir)).select("txn_id", "account_key", "counterparty", "direction")


@query("u2_core_rows", f"{QUEUE} SELECT txn_id FROM queue WHERE in_alert_queue OR is_laundering = 1")
def u2(spark, sf_dir):
    q = queue(spark, sf_dir)
    return q.filter("in_alert_queue").select("txn_id").union(q.filter("is_laundering = 1").select("txn_id")).distinct()


@query("u3_set_overlap", f"{RANKED}, o AS (SELECT rank <= 500 AS a, row_number() OVER (ORDER BY amount_paid_usd DESC, txn_id) <= 500 AS b FROM ranked) SELECT count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE b) AS b, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b FROM o")
def u3(spark, sf_dir):
    by_amount = M.positions(M.ranked(usd(spark, sf_dir)), "amount_paid_usd", "txn_id", out="other")
    return A.set_overlap(by_amount, F.col("rank") <= 500, F.col("other") <= 500)


# --- windows -------------------------------------------------------------------------------------------------------


@query("w1_rolling_count_sum", f"{LEGS} SELECT DISTINCT account_key, \"timestamp\", count(*) FILTER (WHERE direction = 'out') OVER w AS n, round(coalesce(sum(amount_paid_usd) FILTER (WHERE direction = 'out') OVER w, 0), 6) AS total FROM legs WINDOW w AS {frame_sql(1)}")
def w1(spark, sf_dir):
    return rounded(account_windows(usd(spark, sf_dir), [Measure("n", "count", "out", DAY), Measure("total", "sum", "out", DAY)]))


@query("w2_rolling_distinct", f"{LEGS} SELECT DISTINCT account_key, \"timestamp\", count(DISTINCT counterparty) FILTER (WHERE direction = 'out') OVER w AS sent_to, count(DISTINCT counterparty) FILTER (WHERE direction = 'in') OVER w AS received_from FROM legs WINDOW w AS {frame_sql(7)}")
def w2(spark, sf_dir):
    return account_windows(usd(spark, sf_dir), [Measure("sent_to", "distinct", "out", 7 * DAY), Measure("received_from", "distinct", "in", 7 * DAY)])


def _window_columns() -> str:
    out = []
    for d in C.WINDOW_DAYS:
        for way in ("out", "in"):
            own = f"FILTER (WHERE direction = '{way}') OVER w{d}"
            out += [f"count(*) {own} AS {way}_{d}d_count", f"coalesce(sum(amount_paid_usd) {own}, 0) AS {way}_{d}d_amount_usd", f"count(DISTINCT counterparty) {own} AS {way}_{d}d_distinct_counterparties"]
        out.append(f"count(*) FILTER (WHERE direction = 'out' AND amount_paid_usd >= 9000 AND amount_paid_usd < 10000) OVER w{d} AS structuring_score_{d}d")
    return ", ".join(out)


def _feature_columns() -> str:
    sender, receiver = W.role_columns()
    cells = [f"s.{a} AS {b}" if not b.endswith("usd") else f"round(s.{a}, 6) AS {b}" for a, b in sender.items()]
    cells += [f"r.{a} AS {b}" if not b.endswith("usd") else f"round(r.{a}, 6) AS {b}" for a, b in receiver.items()]
    return ", ".join([*cells, *[f"round(s.in_{d}d_amount_usd / (s.out_{d}d_amount_usd + 1), 6) AS sender_pass_through_ratio_{d}d" for d in C.WINDOW_DAYS]])


FEATURES = f"""{LEGS}, windows AS (SELECT txn_id, direction, {_window_columns()} FROM legs WINDOW {", ".join(f"w{d} AS {frame_sql(d)}" for d in C.WINDOW_DAYS)}),
features AS (SELECT usd.txn_id, usd."timestamp", from_account_key, to_account_key, round(amount_paid_usd, 6) AS amount_paid_usd, is_laundering, payment_format, {_feature_columns()}
  FROM usd JOIN windows s ON usd.txn_id = s.txn_id AND s.direction = 'out' JOIN windows r ON usd.txn_id = r.txn_id AND r.direction = 'in')"""


@query("w3_w4_p5_c1_feature_table", f"{FEATURES} SELECT * FROM features")
def c1(spark, sf_dir):
    return rounded(W.feature_table(transfers(spark, sf_dir)))


@query("w7_running_per_group", f"{TRANSFERS_SQL} SELECT txn_id, row_number() OVER w AS n, round(sum(amount_paid) OVER w, 6) AS total FROM txns WINDOW w AS (PARTITION BY from_account_key, CAST(\"timestamp\" AS DATE) ORDER BY \"timestamp\", txn_id ROWS UNBOUNDED PRECEDING)")
def w7(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("from_account_key", F.to_date("timestamp")).orderBy("timestamp", "txn_id")
    return rounded(transfers(spark, sf_dir).select("txn_id", F.row_number().over(w).cast("bigint").alias("n"), F.sum("amount_paid").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total")))


@query("w8_global_rank", f"{RANKED} SELECT txn_id, rank FROM ranked")
def w8(spark, sf_dir):
    return M.ranked(transfers(spark, sf_dir)).select("txn_id", "rank")


@query("w9_recall_curve", f"{RANKED}, c AS (SELECT rank, is_laundering, sum(is_laundering) OVER (ORDER BY rank) AS hits, sum(is_laundering) OVER () AS t FROM ranked) SELECT rank, CAST(hits AS BIGINT) AS hits, round(hits / t, 6) AS recall FROM c WHERE is_laundering = 1")
def w9(spark, sf_dir):
    return rounded(M.recall_curve(M.ranked(transfers(spark, sf_dir))))


@query("w10_rank_deciles", f"{TRANSFERS_SQL} SELECT txn_id, CAST(least((row_number() OVER (ORDER BY score, txn_id) - 1) * 10 // count(*) OVER (), 9) AS INTEGER) AS decile FROM txns")
def w10(spark, sf_dir):
    return M.rank_deciles(transfers(spark, sf_dir)).select("txn_id", "decile")


@query("w11_time_split", f"{SPLIT} SELECT txn_id, split FROM parts")
def w11(spark, sf_dir):
    return split(spark, sf_dir).select("txn_id", "split")


@query("w12_monotone", f"{RANKED} SELECT CAST(0 AS BIGINT) AS breaks, count(*) AS n_rows FROM ranked")
def w12(spark, sf_dir):
    return M.monotone_breaks(M.ranked(transfers(spark, sf_dir)))


# --- top-k and sampling ---------------------------------------------------------------------------------------------


@query("t1_precision_at_k", f"{RANKED} SELECT k, CAST(coalesce(sum(is_laundering) FILTER (WHERE rank <= k), 0) AS BIGINT) AS hits, round(coalesce(sum(is_laundering) FILTER (WHERE rank <= k), 0) / k, 6) AS precision FROM ranked, (SELECT CAST(unnest([100, 500, 1000, 5000]) AS BIGINT) AS k) GROUP BY k")
def t1(spark, sf_dir):
    return rounded(M.precision_at_k(M.ranked(transfers(spark, sf_dir)), (100, 500, 1000, 5000)))


@query("t2_alert_queue", f"{QUEUE} SELECT txn_id, rank, in_alert_queue FROM queue")
def t2(spark, sf_dir):
    return queue(spark, sf_dir).select("txn_id", "rank", "in_alert_queue")


@query("t3_t7_top_n", f"{RANKED} SELECT txn_id, rank FROM ranked ORDER BY rank LIMIT 50")
def t3(spark, sf_dir):
    return M.ranked(transfers(spark, sf_dir)).select("txn_id", "rank").orderBy("rank").limit(50)


CORE = "(is_laundering = 1 OR in_alert_queue)"
DRAW = "md5(CAST(txn_id AS VARCHAR) || ':42')"


@query("t4_explanation_sample", f"""{QUEUE} SELECT txn_id, 'core' AS stratum, is_laundering, in_alert_queue FROM queue WHERE {CORE}
UNION ALL (SELECT txn_id, 'negative', is_laundering, in_alert_queue FROM queue WHERE NOT {CORE} ORDER BY {DRAW}, txn_id LIMIT 300)""")
def t4(spark, sf_dir):
    return Q.explanation_sample(scratch.materialise(queue(spark, sf_dir), "queue"), 300).select("txn_id", "stratum", "is_laundering", "in_alert_queue")


@query("t5_demo_rows", f"""{QUEUE}, room AS (SELECT greatest(2000 - count(*), 0) AS r FROM queue WHERE {CORE}),
pool AS (SELECT *, least((row_number() OVER (ORDER BY score, txn_id) - 1) * 10 // count(*) OVER (), 9) AS decile, {DRAW} AS h FROM queue WHERE NOT {CORE}),
dealt AS (SELECT *, row_number() OVER (PARTITION BY decile ORDER BY h, txn_id) AS k FROM pool), filler AS (SELECT * FROM dealt WHERE k <= (SELECT r // 10 FROM room)),
rest AS (SELECT * FROM dealt WHERE k > (SELECT r // 10 FROM room) ORDER BY h, txn_id LIMIT (SELECT (SELECT r FROM room) - (SELECT count(*) FROM filler)))
SELECT txn_id, CASE WHEN is_laundering = 1 THEN 'positive' ELSE 'queue' END AS stratum, is_laundering, in_alert_queue FROM queue WHERE {CORE}
UNION ALL SELECT txn_id, 'filler', is_laundering, in_alert_queue FROM filler UNION ALL SELECT txn_id, 'filler', is_laundering, in_alert_queue FROM rest""")
def t5(spark, sf_dir):
    return Q.demo_rows(queue(spark, sf_dir), 2000).select("txn_id", "stratum", "is_laundering", "in_alert_queue")


@query("t6_thin_pr_curve", f"""{GROUPS}, curve AS (SELECT score AS threshold, tp / k AS precision, tp / t AS recall FROM cum UNION ALL SELECT NULL, 1.0, 0.0),
ends AS (SELECT count(*) AS c, min(recall) AS lo, max(recall) AS hi FROM curve),
put AS (SELECT curve.*, CASE WHEN c <= 300 THEN coalesce(CAST(threshold AS VARCHAR), 'end') WHEN recall = hi THEN '300' ELSE CAST(coalesce(CAST(floor((recall - lo) / nullif(hi - lo, 0) * 298) AS BIGINT), 0) AS VARCHAR) END AS cell FROM curve, ends),
placed AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY recall, threshold DESC NULLS FIRST) AS place FROM put)
SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM placed WHERE place = 1""")
def t6(spark, sf_dir):
    return rounded(M.thin_curve(M.pr_curve(transfers(spark, sf_dir))))


# --- graph ---------------------------------------------------------------------------------------------------------

EDGES = f"""{TRANSFERS_SQL}, daily AS (SELECT DISTINCT CAST("timestamp" AS DATE) AS day, from_account_key AS src, to_account_key AS dst FROM txns),
edges AS (SELECT DISTINCT CAST(d.day AS DATE) AS as_of, src, dst FROM daily e JOIN (SELECT DISTINCT day FROM daily) d ON d.day > e.day AND d.day <= e.day + 7)"""
CYCLES = f"""{EDGES}, cycles AS (SELECT as_of, src AS account_key FROM edges WHERE src = dst
  UNION SELECT a.as_of, a.src FROM edges a JOIN edges b ON a.as_of = b.as_of AND a.dst = b.src AND b.dst = a.src WHERE a.src <> a.dst
  UNION SELECT a.as_of, a.src FROM (SELECT DISTINCT x.as_of, x.src, y.dst FROM edges x JOIN edges y ON x.as_of = y.as_of AND x.dst = y.src WHERE x.src <> x.dst AND y.src <> y.dst AND x.src <> y.dst) a
    JOIN edges c ON a.as_of = c.as_of AND a.dst = c.src AND c.dst = a.src)"""
SNAPSHOT = f"""{CYCLES}, ends AS (SELECT as_of, src AS account_key, 1 AS o, 0 AS i FROM edges UNION ALL SELECT as_of, dst, 0, 1 FROM edges),
deg AS (SELECT as_of, account_key, CAST(sum(i) AS BIGINT) AS graph_in_degree, CAST(sum(o) AS BIGINT) AS graph_out_degree FROM ends GROUP BY ALL),
snap AS (SELECT deg.*, round(graph_in_degree / (graph_in_degree + graph_out_degree), 6) AS graph_fan_in_score, round(graph_out_degree / (graph_in_degree + graph_out_degree), 6) AS graph_fan_out_score, c.account_key IS NOT NULL AS graph_in_cycle
  FROM deg LEFT JOIN cycles c ON deg.as_of = c.as_of AND deg.account_key = c.account_key)"""
_graph_cells = ", ".join(f"coalesce({a}.{f}, {'false' if f.endswith('cycle') else 0}) AS {r}_{f}" for a, r in (("s", "sender"), ("r", "receiver")) for f in G.FEATURES)
GRAPH = f"""graph AS (SELECT txns.txn_id, {_graph_cells} FROM txns LEFT JOIN snap s ON s.as_of = CAST("timestamp" AS DATE) AND s.account_key = from_account_key
  LEFT JOIN snap r ON r.as_of = CAST("timestamp" AS DATE) AND r.account_key = to_account_key)"""


@query("g1_g3_snapshot", f"{SNAPSHOT} SELECT * FROM snap")
def g1(spark, sf_dir):
    return rounded(G.snapshot_features(G.packed_edges(transfers(spark, sf_dir))))


@query("g2_visible_edges", f"{EDGES} SELECT as_of, src, dst FROM edges")
def g2(spark, sf_dir):
    return G.visible_edges(transfers(spark, sf_dir))


@query("g3_j7_short_cycles", f"{CYCLES} SELECT as_of, account_key FROM cycles")
def g3(spark, sf_dir):
    return G.on_short_cycles(G.packed_edges(transfers(spark, sf_dir)))


@query("g3_cycles_of_four", f"""{CYCLES}, two AS (SELECT DISTINCT x.as_of, x.src, x.dst AS mid, y.dst FROM edges x JOIN edges y ON x.as_of = y.as_of AND x.dst = y.src WHERE x.src <> x.dst AND y.src <> y.dst AND x.src <> y.dst)
SELECT as_of, account_key FROM cycles UNION SELECT a.as_of, a.src FROM two a JOIN two b ON a.as_of = b.as_of AND a.dst = b.src AND b.dst = a.src AND a.mid <> b.mid""")
def g3_four(spark, sf_dir):
    return G.on_short_cycles(G.packed_edges(transfers(spark, sf_dir)), 4)


@query("g4_j5_graph_features", f"{SNAPSHOT}, {GRAPH} SELECT * FROM graph")
def g4(spark, sf_dir):
    return rounded(G.daily_graph_features(transfers(spark, sf_dir)))


@query("c2_j4_modelling_table", f"{FEATURES}, {SNAPSHOT.split(TRANSFERS_SQL + ', ')[1]}, {GRAPH} SELECT * FROM features JOIN graph USING (txn_id)")
def c2(spark, sf_dir):
    return rounded(W.modelling_table(transfers(spark, sf_dir)))


# --- metrics -------------------------------------------------------------------------------------------------------



@query("e1_ap_auc", f"{GROUPS} SELECT round(sum(pos / t * tp / k), 6) AS average_precision, round(sum(pos * (((m - k) - (t - tp)) + (n - pos) / 2)) / max(t * (m - t)), 6) AS roc_auc FROM cum")
def e1(spark, sf_dir):
    return rounded(M.ranking_quality(transfers(spark, sf_dir)))


@query("e2_pr_curve", f"{GROUPS} SELECT round(score, 6) AS threshold, round(tp / k, 6) AS precision, round(tp / t, 6) AS recall FROM cum UNION ALL SELECT NULL, 1.0, 0.0")
def e2(spark, sf_dir):
    return rounded(M.pr_curve(transfers(spark, sf_dir)))


@query("e3_calibration", f"""{TRANSFERS_SQL}, q AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM txns),
b AS (SELECT CAST(len(list_filter(e, lambda x: score > x)) AS INTEGER) AS bin, score, is_laundering FROM txns, q)
SELECT bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(is_laundering), 6) AS positive_fraction FROM b GROUP BY bin""")
def e3(spark, sf_dir):
    return rounded(M.calibration(transfers(spark, sf_dir)))


@query("e4_e6_alert_reduction", f"""{RULES}, parts AS (SELECT txn_id, row_number() OVER (ORDER BY "timestamp", txn_id) AS pos, count(*) OVER () AS total FROM usd),
test AS (SELECT alerts.*, row_number() OVER (ORDER BY score DESC, alerts.txn_id) AS rank FROM alerts JOIN parts USING (txn_id) WHERE pos > CAST(floor(total * 0.8) AS BIGINT)),
base AS (SELECT count(*) FILTER (WHERE alert) AS baseline_alerts, count(*) FILTER (WHERE alert AND is_laundering = 1) AS caught, sum(is_laundering) AS positives FROM test),
cum AS (SELECT rank, sum(is_laundering) OVER (ORDER BY rank) AS hits FROM test),
cut AS (SELECT min(rank) AS model_alerts FROM cum, base WHERE hits >= caught)
SELECT baseline_alerts, CAST(model_alerts AS BIGINT) AS model_alerts, round(1 - model_alerts / baseline_alerts, 6) AS reduction FROM base, cut""")
def e4(spark, sf_dir):
    """Rules over the whole history, then only the test rows; the model's queue at the rules' recall."""
    flagged = scratch.materialise(R.apply_rules(usd(spark, sf_dir)), "flagged")
    test = scratch.materialise(M.time_ordered_split(flagged).filter("split = 'test'"), "flagged-test")
    base = test.agg(F.count_if("alert").alias("alerts"), F.count_if(F.col("alert") & (F.col("is_laundering") == 1)).alias("caught"), F.sum("is_laundering").alias("positives")).first()
    model = M.alert_queue(M.ranked(test), base["caught"] / base["positives"]).agg(F.count_if("in_alert_queue").alias("model_alerts"))
    return rounded(model.select(F.lit(base["alerts"]).cast("bigint").alias("baseline_alerts"), "model_alerts", M.alert_reduction(F.col("model_alerts"), F.lit(float(base["alerts"]))).alias("reduction")))


@query("e5_recall_per_typology", f"{QUEUE} SELECT pattern_type, count(*) FILTER (WHERE is_laundering = 1) AS positives, count(*) FILTER (WHERE is_laundering = 1 AND in_alert_queue) AS caught, round(count(*) FILTER (WHERE is_laundering = 1 AND in_alert_queue) / count(*) FILTER (WHERE is_laundering = 1), 6) AS recall FROM queue WHERE pattern_type IS NOT NULL GROUP BY 1")
def e5(spark, sf_dir):
    return rounded(M.recall_per_typology(scratch.materialise(queue(spark, sf_dir).select("pattern_type", "is_laundering", "in_alert_queue"), "queue")))


@query("e7_headline_without_tail", f"""{USD}, ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, txn_id) AS rank FROM usd WHERE "timestamp" < TIMESTAMP '2024-01-25'),
cum AS (SELECT rank, sum(is_laundering) OVER (ORDER BY rank) AS hits, sum(is_laundering) OVER () AS total FROM ranked),
q AS (SELECT *, rank <= (SELECT min(rank) FROM cum WHERE hits >= 0.75 * total) AS a FROM ranked)
SELECT count(*) FILTER (WHERE a) AS alerts, count(*) FILTER (WHERE a AND is_laundering = 1) AS hits, CAST(sum(is_laundering) AS BIGINT) AS positives, round(count(*) FILTER (WHERE a AND is_laundering = 1) / count(*) FILTER (WHERE a), 6) AS precision, round(count(*) FILTER (WHERE a AND is_laundering = 1) / sum(is_laundering), 6) AS recall FROM q""")
def e7(spark, sf_dir):
    body = usd(spark, sf_dir).filter(~P.in_tail(F.col("timestamp"), "2024-01-25"))
    return rounded(M.headline(M.alert_queue(M.ranked(body), 0.75)))


@query("e8_score_inflation", f"{TRANSFERS_SQL} SELECT {r6('avg(score) AS mean_score', 'median(score) AS median_score', 'avg(is_laundering) AS prevalence', 'avg(score) / avg(is_laundering) AS inflation')} FROM txns")
def e8(spark, sf_dir):
    return rounded(M.score_inflation(transfers(spark, sf_dir)))


# --- drift ---------------------------------------------------------------------------------------------------------

DRIFT = f"""{SPLIT}, r AS (SELECT amount_paid_usd AS x FROM parts WHERE split = 'train'), c AS (SELECT amount_paid_usd AS x FROM parts WHERE split = 'test'),
q AS (SELECT list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS u FROM r), edge AS (SELECT u[2:len(u) - 1] AS e FROM q),
spine AS (SELECT CAST(unnest(generate_series(0, len(e))) AS INTEGER) AS bin FROM edge),
rb AS (SELECT CAST(len(list_filter(e, lambda y: x >= y)) AS INTEGER) AS bin, count(*) AS n FROM r, edge GROUP BY 1), cb AS (SELECT CAST(len(list_filter(e, lambda y: x >= y)) AS INTEGER) AS bin, count(*) AS n FROM c, edge GROUP BY 1),
pct AS (SELECT spine.bin, greatest(coalesce(rb.n, 0) / (SELECT count(*) FROM r), 1e-6) AS a, greatest(coalesce(cb.n, 0) / (SELECT count(*) FROM c), 1e-6) AS b FROM spine LEFT JOIN rb ON spine.bin = rb.bin LEFT JOIN cb ON spine.bin = cb.bin)"""


@query("f1_bin_edges", f"{DRIFT} SELECT round(unnest(e), 6) AS edge FROM edge")
def f1(spark, sf_dir):
    train = split(spark, sf_dir).filter("split = 'train'")
    return rounded(spark.createDataFrame([(e,) for e in D.bin_edges(train, "amount_paid_usd")], "edge double"))


@query("f2_f3_psi_table", f"{DRIFT} SELECT bin, {r6('a AS reference_pct', 'b AS current_pct', '(b - a) * ln(b / a) AS psi_contribution')} FROM pct")
def f3(spark, sf_dir):
    s = scratch.materialise(split(spark, sf_dir).select("split", "amount_paid_usd"), "split")
    return rounded(D.psi_table(s.filter("split = 'train'"), s.filter("split = 'test'"), "amount_paid_usd").drop("bin_lower", "bin_upper"))


@query("f4_psi", f"{DRIFT}, s AS (SELECT sum((b - a) * ln(b / a)) AS psi FROM pct) SELECT round(psi, 6) AS psi, CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS band FROM s")
def f4(spark, sf_dir):
    s = scratch.materialise(split(spark, sf_dir).select("split", "amount_paid_usd"), "split")
    return rounded(D.psi(s.filter("split = 'train'"), s.filter("split = 'test'"), "amount_paid_usd"))


@query("f5_u4_category_psi", f"""{SPLIT}, r AS (SELECT payment_currency AS x, count(*) AS n FROM parts WHERE split = 'train' AND payment_currency <> 'Yen' GROUP BY 1), c AS (SELECT payment_currency AS x, count(*) AS n FROM parts WHERE split = 'test' GROUP BY 1),
pct AS (SELECT greatest(coalesce(r.n, 0) / (SELECT sum(n) FROM r), 1e-6) AS a, greatest(coalesce(c.n, 0) / (SELECT sum(n) FROM c), 1e-6) AS b FROM r FULL JOIN c ON r.x = c.x), s AS (SELECT sum((b - a) * ln(b / a)) AS psi FROM pct)
SELECT round(psi, 6) AS psi, CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS band FROM s""")
def f5(spark, sf_dir):
    s = scratch.materialise(split(spark, sf_dir).select("split", "payment_currency"), "split")
    return rounded(D.category_psi(s.filter("split = 'train' and payment_currency <> 'Yen'"), s.filter("split = 'test'"), "payment_currency"))


def _csi_sql(frame: str, ref: str, cur: str, more: tuple[str, ...] = ()) -> str:
    features = {"amount_paid_usd": "amount_paid_usd", "score": "score", "hour": "hour(\"timestamp\")", "ach": "CASE WHEN payment_format = 'ACH' THEN 1 ELSE 0 END"} | {m: m for m in more}
    rows = " UNION ALL ".join(f"SELECT '{k}' AS feature, CAST({v} AS DOUBLE) AS v, {ref} AS is_ref, {cur} AS is_cur FROM parts" for k, v in features.items())
    return f"""{frame}, cells AS ({rows}), stats AS (SELECT feature, count(DISTINCT v) AS n, list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS u FROM cells WHERE is_ref GROUP BY 1),
binned AS (SELECT c.feature, is_ref, is_cur, v, CASE WHEN n <= 10 THEN v ELSE len(list_filter(u[2:len(u) - 1], lambda y: v >= y)) END AS bin FROM cells c JOIN stats s ON c.feature = s.feature),
by_bin AS (SELECT feature, bin, count(*) FILTER (WHERE is_ref) AS r, count(*) FILTER (WHERE is_cur) AS c FROM binned GROUP BY ALL),
tot AS (SELECT feature, count(*) FILTER (WHERE is_ref) AS rt, count(*) FILTER (WHERE is_cur) AS ct, avg(v) FILTER (WHERE is_ref) AS rm, avg(v) FILTER (WHERE is_cur) AS cm FROM binned GROUP BY 1),
pct AS (SELECT b.feature, greatest(r / rt, 1e-6) AS a, greatest(c / ct, 1e-6) AS b FROM by_bin b JOIN tot t ON b.feature = t.feature WHERE r + c > 0), s AS (SELECT feature, sum((b - a) * ln(b / a)) AS csi FROM pct GROUP BY 1)
SELECT s.feature, round(csi, 6) AS csi, CASE WHEN csi >= 0.25 THEN 'significant' WHEN csi >= 0.1 THEN 'moderate' ELSE 'stable' END AS band, CASE WHEN n <= 10 THEN 'category_share' ELSE 'quantile' END AS method, CAST(CASE WHEN n <= 10 THEN n ELSE greatest(len(u) - 1, 1) END AS BIGINT) AS n_bins_effective, round(rm, 6) AS reference_mean, round(cm, 6) AS current_mean
FROM s JOIN stats ON s.feature = stats.feature JOIN tot ON s.feature = tot.feature"""


def csi_features(df: DataFrame) -> DataFrame:
    return df.withColumns({"hour": F.hour("timestamp"), "ach": F.when(F.col("payment_format") == "ACH", 1).otherwise(0)})


@query("f6_characteristic_stability", _csi_sql(SPLIT, "split = 'train'", "split = 'test'"))
def f6(spark, sf_dir):
    s = scratch.materialise(csi_features(split(spark, sf_dir)).select("split", "amount_paid_usd", "score", "hour", "ach"), "split")
    return rounded(D.characteristic_stability(s.filter("split = 'train'"), s.filter("split = 'test'"), ["amount_paid_usd", "score", "hour", "ach"]))


@query("f7_psi_over_time", f"""{SPLIT}, r AS (SELECT score AS x FROM parts WHERE split = 'train'),
q AS (SELECT list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS u FROM r), edge AS (SELECT u[2:len(u) - 1] AS e FROM q),
spine AS (SELECT CAST(unnest(generate_series(0, len(e))) AS INTEGER) AS bin FROM edge), rb AS (SELECT CAST(len(list_filter(e, lambda y: x >= y)) AS INTEGER) AS bin, count(*) AS n FROM r, edge GROUP BY 1),
ref AS (SELECT spine.bin, greatest(coalesce(rb.n, 0) / (SELECT count(*) FROM r), 1e-6) AS a FROM spine LEFT JOIN rb ON spine.bin = rb.bin),
cur AS (SELECT strftime("timestamp", '%Y-%m-%d') AS period, CAST(len(list_filter(e, lambda y: score >= y)) AS INTEGER) AS bin, count(*) AS n FROM parts, edge WHERE split <> 'train' GROUP BY ALL),
size AS (SELECT period, CAST(sum(n) AS BIGINT) AS n_rows FROM cur GROUP BY 1),
grid AS (SELECT size.period, n_rows, a, greatest(coalesce(cur.n, 0) / n_rows, 1e-6) AS b FROM size CROSS JOIN ref LEFT JOIN cur ON cur.period = size.period AND cur.bin = ref.bin),
s AS (SELECT period, n_rows, sum((b - a) * ln(b / a)) AS psi FROM grid GROUP BY ALL)
SELECT period, n_rows, CASE WHEN n_rows >= 300 THEN round(psi, 6) END AS psi, CASE WHEN n_rows < 300 THEN 'insufficient_data' WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS band FROM s""")
def f7(spark, sf_dir):
    s = scratch.materialise(split(spark, sf_dir).select("split", "timestamp", "score"), "split")
    return rounded(D.psi_over_time(s.filter("split = 'train'"), s.filter("split <> 'train'"), "score", least=300))


@query("f8_day_vs_day", _csi_sql(f"{USD}, parts AS (SELECT * FROM usd)", "CAST(\"timestamp\" AS DATE) = DATE '2024-01-05'", "CAST(\"timestamp\" AS DATE) = DATE '2024-01-06'"))
def f8(spark, sf_dir):
    s = csi_features(usd(spark, sf_dir))
    day = lambda d: s.filter(F.to_date("timestamp") == F.lit(d).cast("date"))
    return rounded(D.characteristic_stability(day("2024-01-05"), day("2024-01-06"), ["amount_paid_usd", "score", "hour", "ach"]))


GRAPH_FEATURES = tuple(f"{r}_{f}" for r in ("sender", "receiver") for f in G.FEATURES)


@query("f8_graph_share", f"""{SNAPSHOT}, {GRAPH}, {USD.split(TRANSFERS_SQL + ', ')[1]}, parts AS (SELECT * FROM usd JOIN graph USING (txn_id)), csi AS (
{_csi_sql("", "CAST(timestamp AS DATE) = DATE '2024-01-08'", "CAST(timestamp AS DATE) = DATE '2024-01-09'", GRAPH_FEATURES).lstrip(", ").replace("cells AS (", "WITH cells AS (", 1)})
SELECT count(*) AS n_features, count(*) FILTER (WHERE contains(feature, '_graph_')) AS n_graph FROM (SELECT feature FROM csi ORDER BY csi DESC, feature LIMIT 10)""")
def f8_graph(spark, sf_dir):
    """How many of the ten features that drift most over the eviction day come from the graph."""
    t = csi_features(usd(spark, sf_dir)).join(G.daily_graph_features(transfers(spark, sf_dir)), "txn_id")
    names = ["amount_paid_usd", "score", "hour", "ach", *GRAPH_FEATURES]
    days = scratch.materialise(t.select(F.to_date("timestamp").alias("day"), *names), "two-days")
    day = lambda d: days.filter(F.col("day") == F.lit(d).cast("date"))
    return D.graph_share(rounded(D.characteristic_stability(day("2024-01-08"), day("2024-01-09"), names)))


@query("f9_first_eviction_day", f"{TRANSFERS_SQL} SELECT CAST(min(CAST(\"timestamp\" AS DATE)) + 8 AS DATE) AS day FROM txns")
def f9(spark, sf_dir):
    return transfers(spark, sf_dir).agg(D.first_eviction_day(F.min(F.to_date("timestamp"))).alias("day"))


# --- explanations --------------------------------------------------------------------------------------------------

#: Made-up contributions and values per transfer: name, contribution and value in SQL that both engines read.
CELLS = [
    ("amount_paid_usd", "(txn_id * 37 % 2001 - 1000) / 1000.0", "txn_id * 13 % 20000 + 0.25"), ("structuring_score_1d", "(txn_id * 53 % 2001 - 1000) / 1000.0", "txn_id % 6 + 0.0"),
    ("sender_pass_through_ratio_7d", "(txn_id * 71 % 2001 - 1000) / 1000.0", "(txn_id * 31 % 1000) / 300.0"), ("receiver_in_7d_distinct_counterparties", "(txn_id * 89 % 2001 - 1000) / 1000.0", "txn_id % 1300 + 0.0"),
    ("sender_out_30d_amount_usd", "(txn_id * 97 % 2001 - 1000) / 1000.0", "txn_id * 7919 % 2000000 + 0.0"), ("receiver_out_1d_count", "(txn_id * 101 % 2001 - 1000) / 1000.0", "txn_id % 9 + 0.0"),
    ("sender_graph_out_degree", "(txn_id * 103 % 2001 - 1000) / 1000.0", "txn_id % 17 + 0.0"), ("receiver_graph_fan_in_score", "(txn_id * 107 % 2001 - 1000) / 1000.0", "(txn_id * 29 % 900) / 1000.0"),
    ("sender_graph_in_cycle", "(txn_id * 109 % 2001 - 1000) / 1000.0", "txn_id % 2 + 0.0"), ("payment_format_ACH", "(txn_id * 113 % 2001 - 500) / 1000.0", "txn_id % 3 % 2 + 0.0"),
    ("payment_format_Wire", "(txn_id * 127 % 2001 - 1000) / 1000.0", "txn_id % 5 % 2 + 0.0"), ("some_future_feature", "(txn_id * 131 % 2001 - 1000) / 1000.0", "(txn_id % 50) / 4.0 + 0.5"),
]
CELL_NAMES = [n for n, _, _ in CELLS]
_n, _x = "format('{:,.0f}', v)", "printf('%.2f', v)"
CLAUSES_SQL = {
    "amount_paid_usd": f"'a $' || {_n} || ' payment'", "structuring_score_1d": f"{_n} || ' of the sender''s payments in the past 24h sat just under the $10,000 reporting threshold'",
    "sender_pass_through_ratio_7d": f"'the sender''s inflow-to-outflow ratio over the past 7 days is ' || {_x} || ' (near 1.0 means funds pass straight through rather than accumulate)'",
    "receiver_in_7d_distinct_counterparties": f"'the receiver received from ' || {_n} || ' distinct counterparties in the past 7 days'", "sender_out_30d_amount_usd": f"'the sender sent $' || {_n} || ' in the past 30 days'",
    "receiver_out_1d_count": f"'the receiver sent ' || {_n} || ' transactions in the past 24h'", "sender_graph_out_degree": f"'the sender sent to ' || {_n} || ' distinct accounts in the graph window'",
    "receiver_graph_fan_in_score": f"'the receiver is structurally a collector (mostly receiving), fan-in score ' || {_x}",
    "sender_graph_in_cycle": "CASE WHEN v <> 0 THEN 'the sender sits on a short directed cycle (funds loop back within a few hops)' ELSE 'the sender does not sit on a short directed cycle' END",
    "payment_format_ACH": "CASE WHEN v <> 0 THEN 'the payment was made via ACH' ELSE 'the payment was not made via ACH' END", "payment_format_Wire": "CASE WHEN v <> 0 THEN 'the payment was made via Wire' ELSE 'the payment was not made via Wire' END",
    "some_future_feature": "'some_future_feature = ' || format('{:.4g}', v)",
}
CELLS_SQL = f"{TRANSFERS_SQL}, cells AS (" + " UNION ALL ".join(f"SELECT txn_id, {k} AS i, '{n}' AS name, CAST({c} AS DOUBLE) AS c, CAST({v} AS DOUBLE) AS v FROM txns" for k, (n, c, v) in enumerate(CELLS)) + "), told AS (SELECT *, CASE name " + " ".join(f"WHEN '{n}' THEN {e}" for n, e in CLAUSES_SQL.items()) + " END AS clause FROM cells)"


def contributions(spark, sf_dir):
    t = transfers(spark, sf_dir)
    return t.select("txn_id", F.array(*[F.expr(f"CAST({c} AS DOUBLE)") for _, c, _ in CELLS]).alias("shap"), F.array(*[F.expr(f"CAST({v} AS DOUBLE)") for _, _, v in CELLS]).alias("vals"))


@query("x3_top_contributors", f"{CELLS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY c DESC, i) AS place FROM told WHERE c > 0 AND name NOT LIKE 'payment_format%') SELECT txn_id, place, name, round(c, 6) AS c FROM r WHERE place <= 3")
def x3(spark, sf_dir):
    df = contributions(spark, sf_dir)
    names = F.array(*[F.lit(n) for n in CELL_NAMES])
    top = X.top_contributors(F.col("shap"), CELL_NAMES, 3, X.FORMAT_FEATURES)
    return df.select("txn_id", F.posexplode(top).alias("p", "z")).select("txn_id", (F.col("p") + 1).cast("bigint").alias("place"), F.element_at(names, F.col("z.i") + 1).alias("name"), F.round("z.c", 6).alias("c"))


@query("x4_clauses", f"{CELLS_SQL} SELECT txn_id, name, clause FROM told")
def x4(spark, sf_dir):
    cells = F.array(*[F.struct(F.lit(n).alias("name"), X.describe(n, F.col("vals")[k]).alias("clause")) for k, n in enumerate(CELL_NAMES)])
    return contributions(spark, sf_dir).select("txn_id", F.inline(cells))


def _sentence_sql(where: str) -> str:
    return f"(SELECT txn_id, 'Flagged: ' || string_agg(clause, '; ' ORDER BY place) || '.' AS s FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY c DESC, i) AS place FROM told WHERE c > 0 {where}) WHERE place <= 3 GROUP BY 1)"


@query("x5_x6_sentences", f"{CELLS_SQL} SELECT t.txn_id, coalesce(a.s, '{X.NO_REASON.replace(chr(39), chr(39) * 2)}') AS faithful, coalesce(b.s, '{X.NO_REASON.replace(chr(39), chr(39) * 2)}') AS behavioural FROM txns t LEFT JOIN {_sentence_sql('')} a ON a.txn_id = t.txn_id LEFT JOIN {_sentence_sql(chr(65) + 'ND name NOT LIKE ' + chr(39) + 'payment_format%' + chr(39))} b ON b.txn_id = t.txn_id")
def x5(spark, sf_dir):
    shap, vals = F.col("shap"), F.col("vals")
    return contributions(spark, sf_dir).select("txn_id", X.sentence(shap, vals, CELL_NAMES).alias("faithful"), X.sentence(shap, vals, CELL_NAMES, exclude=X.FORMAT_FEATURES).alias("behavioural"))


@query("x7_waterfall", f"""{CELLS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY abs(c) DESC, i) AS place FROM cells)
SELECT txn_id, replace(replace(name, 'payment_format_', 'payment format: '), '_', ' ') AS feature, round(v, 6) AS value, round(c, 6) AS contribution FROM r WHERE place <= 10 UNION ALL SELECT txn_id, '2 other features', NULL, round(sum(c), 6) FROM r WHERE place > 10 GROUP BY 1""")
def x7(spark, sf_dir):
    return rounded(X.waterfall(contributions(spark, sf_dir), "shap", "vals", CELL_NAMES))


@query("x8_reconstructed_score", f"{CELLS_SQL} SELECT txn_id, round(1 / (1 + exp(-(0.3 + sum(c)))), 6) AS score FROM cells GROUP BY 1")
def x8(spark, sf_dir):
    return rounded(contributions(spark, sf_dir).select("txn_id", X.reconstructed(F.col("shap"), 0.3).alias("score")))


@query("x9_grounded", f"{CELLS_SQL} SELECT name, count(*) AS clauses, count(*) AS grounded FROM told WHERE name <> 'some_future_feature' GROUP BY 1")
def x9(spark, sf_dir):
    cells = F.array(*[F.struct(F.lit(n).alias("name"), X.is_grounded(n, F.col("vals")[k], X.describe(n, F.col("vals")[k])).alias("ok")) for k, n in enumerate(CELL_NAMES) if n != "some_future_feature"])
    return contributions(spark, sf_dir).select(F.inline(cells)).groupBy("name").agg(F.count(F.lit(1)).alias("clauses"), F.count_if("ok").alias("grounded"))


@query("x10_matrix_vs_table", f"{USD} SELECT round(max(abs(CAST(CAST(amount_paid_usd AS FLOAT) AS DOUBLE) - amount_paid_usd)), 6) AS worst, CAST(0 AS BIGINT) AS format_errors FROM usd")
def x10(spark, sf_dir):
    t = usd(spark, sf_dir)
    x = M.feature_matrix(t.select("txn_id", "timestamp", "from_account_key", "to_account_key", F.col("amount_paid_usd").alias("amount"), "payment_format", "is_laundering"))
    both = t.join(x.drop("label"), "txn_id")
    wrong = F.lit(False)
    for f in C.PAYMENT_FORMATS:
        wrong = wrong | ((F.col("payment_format") == f) != (F.col(f"`payment_format_{f}`") == 1))
    return rounded(both.agg(F.max(F.abs(F.col("amount").cast("double") - F.col("amount_paid_usd"))).alias("worst"), F.count_if(wrong).alias("format_errors")))


@query("a16_global_importance", f"{CELLS_SQL} SELECT name AS feature, round(avg(abs(c)), 6) AS mean_abs_shap, round(avg(c), 6) AS mean_shap FROM cells GROUP BY 1")
def a16(spark, sf_dir):
    return rounded(A.global_importance(contributions(spark, sf_dir), "shap", CELL_NAMES))


# --- models (no SQL form) -------------------------------------------------------------------------------------------


#: A label that the features can explain, so that training has something to find.
_found = lambda: F.when((F.col("amount_paid_usd") > 9500) & (F.col("amount_paid_usd") < 9900) | (F.col("txn_id") % 97 == 0), 1).otherwise(0)


def _full_matrix(spark, sf_dir):
    """The modelling table's 54 features, with the split."""
    rows = M.time_ordered_split(scratch.materialise(usd(spark, sf_dir), "transfers"))  # read for the split, the windows, the graph and the joins
    t = W.modelling_table(rows).withColumn("is_laundering", _found()).join(rows.select("txn_id", "split"), "txn_id")
    x = M.feature_matrix(t, ("txn_id", "split"))
    x = scratch.materialise(x.withColumn("validation", F.col("split") == "val"), "full-matrix")
    return x, [c for c in x.columns if c not in ("txn_id", "split", "label", "validation")]


def _stopped(spark, sf_dir):
    """Trees trained with the operator's own settings and stopped by average precision on the validation rows."""
    x, names = _full_matrix(spark, sf_dir)
    return x, names, ML.best_prefix(x.filter("validation"), H.train_by_histograms(x.filter("split <> 'test'"), names))


def _matrix(spark, sf_dir):
    """A small model's matrix: amount, hour, day windows and formats, with the split."""
    t = split(spark, sf_dir).withColumn("hour", F.hour("timestamp"))
    windows = account_windows(t, [Measure("out_n", "count", "out", DAY), Measure("in_n", "count", "in", DAY), Measure("out_usd", "sum", "out", 7 * DAY)])
    t = at_account(t, windows, "from_account_key", {"out_n": "sender_out_1d_count", "in_n": "sender_in_1d_count", "out_usd": "sender_out_7d_amount_usd"})
    t = t.withColumn("is_laundering", _found())
    keep = ("txn_id", "split")
    x = M.feature_matrix(t.select(*keep, "timestamp", "from_account_key", "to_account_key", "amount_paid_usd", "hour", "sender_out_1d_count", "sender_in_1d_count", "sender_out_7d_amount_usd", "payment_format", "is_laundering"), keep)
    x = scratch.materialise(x.withColumn("validation", F.col("split") == "val"), "matrix")
    return x, [c for c in x.columns if c not in (*keep, "label", "validation")]


def _boosted(spark, sf_dir, rounds=10, depth=4):
    x, names = _matrix(spark, sf_dir)
    return x, names, ML.train_boosted(x.filter("split <> 'test'"), names, rounds=rounds, depth=depth, rate=0.2)


@query("m1_m3_boosted_scores")
def m1(spark, sf_dir):
    x, _, trees = _stopped(spark, sf_dir)
    test = x.filter("split = 'test'")
    return ML.scored_by(test, trees).join(test.select("txn_id", "label"), "txn_id").select("txn_id", "label", F.round("score", 6).alias("score"))


@query("m1_rounds_by_validation")
def m1_rounds(spark, sf_dir):
    x, names = _full_matrix(spark, sf_dir)
    return rounded(ML.prefix_quality(x.filter("validation"), H.train_by_histograms(x.filter("split <> 'test'"), names)))


@query("m2_isolation_forest")
def m2(spark, sf_dir):
    x, names = _full_matrix(spark, sf_dir)
    return rounded(ML.anomaly_scores(x.filter("split = 'test'"), ML.isolation_forest(x.filter("split = 'train'"), names)))


@query("m4_ablation")
def m4(spark, sf_dir):
    x, names, model = _boosted(spark, sf_dir, rounds=5)
    fewer = [n for n in names if not n.startswith("payment_format_")]
    other = ML.train_boosted(x.filter("split <> 'test'"), fewer, rounds=5, depth=4, rate=0.2)
    test = x.filter("split = 'test'")
    rows = [M.ranking_quality(ML.scored(m, test, n), "score", "label").withColumn("features", F.lit(k)) for k, m, n in (("all", model, names), ("without formats", other, fewer))]
    return rounded(rows[0].unionByName(rows[1]))


@query("s15_saved_model", f"{SPLIT} SELECT txn_id, true AS same_score, true AS same_features FROM parts WHERE split = 'test'")
def s15(spark, sf_dir):
    """Test rows scored by a model and by the same model saved and loaded, with its features' order from the sidecar."""
    x, names, model = _boosted(spark, sf_dir, rounds=3)
    path = scratch.new_folder(spark, "model")
    ML.save_model(model, names, path, path + ".json", rounds=3)
    again, meta = ML.load_model(path, path + ".json")
    test = x.filter("split = 'test'")
    both = ML.scored(model, test, names).select("txn_id", F.col("score").alias("a")).join(ML.scored(again, test, meta["feature_names"]).select("txn_id", F.col("score").alias("b")), "txn_id")
    return both.select("txn_id", F.col("a").eqNullSafe(F.col("b")).alias("same_score"), F.lit(meta["feature_names"] == names).alias("same_features"))


@query("m5_feature_gain")
def m5(spark, sf_dir):
    _, names, model = _boosted(spark, sf_dir, rounds=5)
    return spark.createDataFrame(ML.feature_gain(model, names), "feature string, gain double")


@query("x1_x2_explanations")
def x1(spark, sf_dir):
    x, _, trees = _stopped(spark, sf_dir)
    done = scratch.materialise(ML.explain(x.filter("split = 'test'"), trees), "explained")
    base = ML.base_value(done)
    gap = F.abs(F.col("margin") - F.lit(base) - F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c))
    return done.select("txn_id", F.round("margin", 6).alias("margin"), (gap < 1e-6).alias("additive"))


@query("c3_review_artifact")
def c3(spark, sf_dir):
    x, names, trees = _stopped(spark, sf_dir)
    test = x.filter("split = 'test'")
    told = ML.explain(test, trees)
    scores = scratch.materialise(ML.scored_by(test, trees).join(test.select("txn_id", F.col("label").alias("is_laundering")), "txn_id"), "scores")  # ranks and totals read it again
    rows = M.alert_queue(M.ranked(scores), 0.75).withColumnRenamed("score", "model_score")
    table = rows.join(told, "txn_id").join(usd(spark, sf_dir).drop("score", "is_laundering"), "txn_id")
    path = scratch.new_folder(spark, "review")
    S.write_artifact(Q.review_table(table, names, "contributions", "values", "2024-01-25"), path)
    return S.read_alerts(spark, path)


def _stream_sql() -> str:
    cells = [
        f"count(*) FILTER (WHERE direction = '{way}') OVER w{d} AS {way}_{d}d_count, round(coalesce(sum(amount_paid_usd) FILTER (WHERE direction = '{way}') OVER w{d}, 0), 6) AS {way}_{d}d_amount_usd, "
        f"count(DISTINCT counterparty) FILTER (WHERE direction = '{way}') OVER w{d} AS {way}_{d}d_distinct_counterparties"
        for d in (1, 7, 30) for way in ("out", "in")
    ]
    return f"{LEGS} SELECT txn_id, direction, account_key, {', '.join(cells)} FROM legs WINDOW " + ", ".join(f"w{d} AS {frame_sql(d)}" for d in (1, 7, 30))


@query("c4_streaming_windows", _stream_sql())
def c4(spark, sf_dir):
    """The streaming scorer with all its windows, fed with one trigger of all transfers; equal to the batch windows."""
    from .streaming.scorer import streaming_windows

    path, out, marks = (scratch.new_folder(spark, f"stream-{k}") for k in ("in", "out", "marks"))
    usd(spark, sf_dir).write.parquet(path)
    stream = spark.readStream.schema(usd(spark, sf_dir).schema).parquet(path)
    running = streaming_windows(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    running.awaitTermination()
    return rounded(spark.read.parquet(out).drop("timestamp"))


assert set(PATTERN_TYPES) and DAY
