"""Summaries and audits over transfers, labels and alert sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import ratio

LABEL = "is_laundering"


def accounts_of(df: DataFrame) -> DataFrame:
    """account_key of every sender and receiver, one row per role."""
    return df.select(F.explode(F.array("from_account_key", "to_account_key")).alias("account_key"))


def dataset_stats(df: DataFrame) -> DataFrame:
    """Rows, positives, rate, first and last time and distinct accounts, as one row."""
    base = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(LABEL).cast("bigint")).alias("positives"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    accounts = accounts_of(df).agg(F.count_distinct("account_key").alias("n_accounts"))
    return base.withColumn("positive_rate", ratio(F.col("positives"), F.col("n_rows"))).join(accounts, how="cross")


def label_by(df: DataFrame, key: str) -> DataFrame:
    """Rows, positives and rate by a column, with its share of all positives and its lift over the prevalence, highest rate first."""
    by = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(LABEL).cast("bigint")).alias("positives"))
    total = by.agg(F.sum("n_rows").alias("_n"), F.sum("positives").alias("_p"))
    rate = F.col("positives") / F.col("n_rows")
    return by.join(F.broadcast(total), how="cross").select(key, "n_rows", "positives", rate.alias("rate"), ratio(F.col("positives"), F.col("_p")).alias("positive_share"), (rate / (F.col("_p") / F.col("_n"))).alias("lift")).orderBy(F.desc("rate"), key)


def daily_totals(df: DataFrame) -> DataFrame:
    """Rows and positives of every calendar day between the first and the last; empty days have 0."""
    days = df.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col(LABEL).cast("bigint")).alias("positives"))
    spine = days.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return spine.join(days, "day", "left").fillna(0, ["n_rows", "positives"])


def most_active(df: DataFrame, n: int = 20) -> DataFrame:
    """The accounts with the most transfers in either role; ties by key."""
    return accounts_of(df).groupBy("account_key").count().orderBy(F.desc("count"), "account_key").limit(n)


def value_counts(df: DataFrame, key: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).count()


def alerted_accounts(df: DataFrame, flag: str = "alert") -> DataFrame:
    """Alerts, the distinct accounts behind them, and these as a share of the most there could be (two per alert)."""
    alerts = df.filter(flag)
    return alerts.agg(F.count(F.lit(1)).alias("alerts")).join(accounts_of(alerts).agg(F.count_distinct("account_key").alias("accounts")), how="cross").withColumn("share", ratio(F.col("accounts"), 2 * F.col("alerts")))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows whose key another row has as well."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("duplicated_rows"))


def join_pattern_types(txns: DataFrame, patterns: DataFrame, keys: list[str]) -> DataFrame:
    """``txns`` with pattern_type by all ``keys``; repeated keys among the patterns raise, and no transfer is lost or doubled."""
    if not patterns.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError("patterns have duplicate join keys")
    return txns.drop("pattern_type").join(patterns.select(*keys, "pattern_type"), keys, "left")


def match_audit(df: DataFrame) -> DataFrame:
    """Positives, positives with a pattern type, and the (impossible) others with one."""
    hit, typed = F.col(LABEL) == 1, F.col("pattern_type").isNotNull()
    return df.agg(F.count_if(hit).alias("positives"), F.count_if(hit & typed).alias("matched"), F.count_if(~hit & typed).alias("false_matches"))


def day_format_shares(df: DataFrame, formats) -> DataFrame:
    """Share in percent of every payment format by day."""
    wide = df.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("payment_format") == f).alias(f) for f in formats])
    return wide.select("day", *[(F.col(f"`{f}`") * 100.0 / F.col("_n")).alias(f) for f in formats])


def daily_means(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n_rows"), *[F.avg(c).alias(c) for c in columns])


def class_means(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(LABEL).agg(*[F.avg(c).alias(c) for c in columns])


def largest_day(df: DataFrame) -> DataFrame:
    """The day with the most rows (the earlier of ties) and its share."""
    days = df.groupBy(F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    order = F.struct("n", -F.unix_date("day"))
    return days.agg(F.max_by("day", order).alias("day"), F.max("n").alias("n_rows"), (F.max("n") / F.sum("n")).alias("share"))


def top_k_profile(df: DataFrame, columns: list[str], k: int = 1000) -> DataFrame:
    """feature, mean of the top k by rank, overall mean and max, from one pass over ranked rows."""
    top = F.col("rank") <= k
    one = df.agg(*[x for c in columns for x in (F.avg(F.when(top, F.col(c))).alias(f"{c}_t"), F.avg(c).alias(f"{c}_m"), F.max(F.col(c).cast("double")).alias(f"{c}_x"))])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_t").alias("top_mean"), F.col(f"{c}_m").alias("mean"), F.col(f"{c}_x").alias("max")) for c in columns])
    return one.select(F.inline(rows))


def divergence(df: DataFrame, a: str, b: str, group: str = "in_alert_queue") -> DataFrame:
    """Share of rows whose two texts differ, by group."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"), F.avg((~F.col(a).eqNullSafe(F.col(b))).cast("double")).alias("differs"))


def body_and_tail(df: DataFrame, tail: Column, formats) -> DataFrame:
    """Rows, rate and format shares before the tail and in it."""
    shares = [F.avg((F.col("payment_format") == f).cast("double")).alias(f"share_{f}") for f in formats]
    return df.groupBy(tail.alias("in_tail")).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(LABEL).cast("double")).alias("rate"), *shares)


def score_histogram(df: DataFrame, bins: int = 60, score: str = "score") -> DataFrame:
    """Rows and density per equal-width bin of scores from 0 to 1, by label; 1 belongs to the last bin."""
    cell = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    by = df.groupBy(LABEL, cell.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))
    total = by.groupBy(LABEL).agg(F.sum("n_rows").alias("_n"))
    return by.join(F.broadcast(total), LABEL).select(LABEL, "bin", "n_rows", (F.col("n_rows") * float(bins) / F.col("_n")).alias("density"))


def amount_histogram(df: DataFrame, width: float = 0.25, amount: str = "amount_paid_usd") -> DataFrame:
    """Rows per bin of log10 of positive amounts, by label."""
    return df.filter(F.col(amount) > 0).groupBy(LABEL, F.floor(F.log10(amount) / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


def set_overlap(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Sizes of two flagged sets, of what they share, and of what only one has."""
    return df.agg(F.count_if(a).alias("a"), F.count_if(b).alias("b"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(b & ~a).alias("only_b"))


def global_importance(df: DataFrame, contributions: str, names: list[str]) -> DataFrame:
    """feature, mean_abs_shap and mean_shap of an array column, largest first; arrays of another length raise."""
    wrong = df.filter(F.size(contributions) != len(names)).limit(1).count()
    if wrong:
        raise ValueError(f"contributions and {len(names)} feature names differ in number")
    table = F.array(*[F.lit(n) for n in names])
    cells = df.select(F.posexplode(contributions).alias("i", "v"))
    by = cells.groupBy("i").agg(F.avg(F.abs("v")).alias("mean_abs_shap"), F.avg("v").alias("mean_shap"))
    return by.select(F.element_at(table, F.col("i") + 1).alias("feature"), "mean_abs_shap", "mean_shap").orderBy(F.desc("mean_abs_shap"), "feature")


def describe(df: DataFrame, columns: tuple) -> DataFrame:
    """statistic and a double per column: count, mean, std (of a sample), min, exact quartiles and max, from one pass."""
    levels = {"min": F.min, "25%": 0.25, "50%": 0.5, "75%": 0.75, "max": F.max, "count": F.count, "mean": F.avg, "std": F.stddev_samp}
    value = lambda how, c: F.percentile(c, F.lit(how)) if isinstance(how, float) else how(c)
    row = df.agg(*[value(how, c).cast("double").alias(f"{k}_{c}") for k, how in levels.items() for c in columns])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("statistic"), *[F.col(f"{k}_{c}").alias(c) for c in columns]) for k in levels])))
