"""Column expressions of the triage task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FX_RATES, PSI_MODERATE, PSI_SIGNIFICANT


def add_usd_amount(df: DataFrame, rates: dict[str, float] | None = None) -> DataFrame:
    """amount_paid_usd = amount_paid times the currency's rate; a currency without a rate raises when the row is read."""
    rates = FX_RATES if rates is None else rates
    rate = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])[F.col("payment_currency")]
    missing = F.raise_error(F.concat(F.lit("No FX rate configured for "), F.coalesce("payment_currency", F.lit("a null currency"))))
    return df.withColumn("amount_paid_usd", F.col("amount_paid") * F.coalesce(rate, missing.cast("double")))


def unknown_currencies(df: DataFrame, rates: dict[str, float] | None = None) -> list[str]:
    """Currencies of the table that have no rate."""
    known = list(FX_RATES if rates is None else rates)
    rows = df.select("payment_currency").distinct().filter(F.col("payment_currency").isNull() | ~F.col("payment_currency").isin(known))
    return sorted(str(r[0]) for r in rows.collect())


def in_band(amount: Column, threshold: float, fraction: float) -> Column:
    """At least the fraction of the threshold and below it."""
    return (amount >= threshold * fraction) & (amount < threshold)


def band(psi: Column, moderate: float = PSI_MODERATE, significant: float = PSI_SIGNIFICANT) -> Column:
    """stable, moderate or significant; lower edges belong to the higher band."""
    return F.when(psi >= significant, "significant").when(psi >= moderate, "moderate").otherwise("stable")


def logistic(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def prettify(name: Column) -> Column:
    """A feature name for display."""
    return F.replace(F.replace(name, F.lit("payment_format_"), F.lit("payment format: ")), F.lit("_"), F.lit(" "))


def is_windowed(name: Column) -> Column:
    """Whether a feature looks back in time, by its name."""
    return name.rlike(r"_\d+d_|_\d+d$|_graph_")


def in_tail(timestamp: Column, start: str) -> Column:
    return timestamp >= F.lit(start).cast("timestamp_ntz")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def reject_non_finite(df: DataFrame, column: str, label: str) -> None:
    """Raise a ValueError if a numeric column has no rows, or nulls, NaN or infinities."""
    c = F.col(column).cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    n, wrong = df.agg(F.count(F.lit(1)), F.count_if(bad)).first()
    if not n:
        raise ValueError(f"{label}: empty, no distribution to compute")
    if wrong:
        raise ValueError(f"{label}: {wrong:,} non-finite values")


def finite_counts(df: DataFrame, column: str) -> DataFrame:
    """The same test as a one-row table: n_rows, n_bad."""
    c = F.col(column).cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_bad"))
