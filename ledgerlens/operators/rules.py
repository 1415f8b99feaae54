"""The rules baseline: large amounts, structuring and pass-through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.expressions import in_band, ratio
from .windows import HOUR, Measure, account_windows, at_account


def apply_rules(txns: DataFrame, large: float = C.LARGE_AMOUNT, fraction: float = C.STRUCTURING_FRACTION, hours: int = C.STRUCTURING_HOURS, least: int = C.STRUCTURING_COUNT, pass_hours: int = C.PASS_THROUGH_HOURS) -> DataFrame:
    """``txns`` (with amount_paid_usd) and flag_large_amount, flag_structuring, flag_pass_through and alert.

    Structuring: a band transfer that is at least the ``least``-th of its
    sender within (t - hours, t]. Pass-through: the sender received anything
    within (t - pass_hours, t], this transfer to itself included.
    """
    usd = F.col("amount_paid_usd")
    banded = in_band(usd, large, fraction)
    seen = account_windows(txns, [Measure("_band", "count", "out", hours * HOUR, banded), Measure("_in", "count", "in", pass_hours * HOUR)])
    joined = at_account(txns, seen, "from_account_key", {"_band": "_band", "_in": "_in"})
    return (
        joined.withColumn("flag_large_amount", usd > large)
        .withColumn("flag_structuring", banded & (F.coalesce("_band", F.lit(0)) >= least))
        .withColumn("flag_pass_through", F.coalesce("_in", F.lit(0)) > 0)
        .withColumn("alert", F.col("flag_large_amount") | F.col("flag_structuring") | F.col("flag_pass_through"))
        .drop("_band", "_in")
    )


def summarise(flagged: DataFrame) -> DataFrame:
    """One row: transfers, alerts, alert_rate, true_positives, precision, recall and the rules' counts."""
    n = lambda c: F.count_if(F.col(c))
    hits = F.count_if(F.col("alert") & (F.col("is_laundering") == 1))
    return flagged.agg(
        F.count(F.lit(1)).alias("transactions"), n("alert").alias("alerts"), hits.alias("true_positives"), F.count_if(F.col("is_laundering") == 1).alias("positives"),
        n("flag_large_amount").alias("large_amount"), n("flag_structuring").alias("structuring"), n("flag_pass_through").alias("pass_through"),
    ).select(
        "transactions", "alerts", "true_positives", "positives", "large_amount", "structuring", "pass_through",
        F.round(ratio(F.col("alerts"), F.col("transactions")), 8).alias("alert_rate"),
        F.round(ratio(F.col("true_positives"), F.col("alerts")), 8).alias("precision"),
        F.round(ratio(F.col("true_positives"), F.col("positives")), 8).alias("recall"),
    )
