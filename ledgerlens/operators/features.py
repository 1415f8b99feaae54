"""Account features, the structuring score, ratios and the modelling table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.expressions import add_usd_amount, in_band
from ..sources.scratch import materialise
from ..sources.transfers import require_columns
from .graph import daily_graph_features
from .windows import DAY, Measure, account_windows, at_account

REQUIRED = ["timestamp", "from_account_key", "to_account_key", "amount_paid_usd"]
KEYS = ["timestamp", "from_account_key", "to_account_key", "amount_paid_usd", "is_laundering", "payment_format"]


def window_measures(days=C.WINDOW_DAYS, large: float = C.LARGE_AMOUNT, fraction: float = C.STRUCTURING_FRACTION) -> list[Measure]:
    """Counts and sums both ways, distinct counterparties both ways, and the sender's band transfers, per window."""
    banded = in_band(F.col("amount_paid_usd"), large, fraction)
    out = []
    for d in days:
        for way in ("out", "in"):
            out += [Measure(f"{way}_{d}d_count", "count", way, d * DAY), Measure(f"{way}_{d}d_amount_usd", "sum", way, d * DAY), Measure(f"{way}_{d}d_distinct_counterparties", "distinct", way, d * DAY)]
        out.append(Measure(f"structuring_score_{d}d", "count", "out", d * DAY, banded))
    return out


def role_columns(days=C.WINDOW_DAYS) -> tuple[dict[str, str], dict[str, str]]:
    """Window value -> feature name, for the sender and for the receiver."""
    sender, receiver = {}, {}
    for d in days:
        for way in ("out", "in"):
            for stat in ("count", "amount_usd"):
                sender[f"{way}_{d}d_{stat}"] = f"sender_{way}_{d}d_{stat}"
                receiver[f"{way}_{d}d_{stat}"] = f"receiver_{way}_{d}d_{stat}"
        sender[f"out_{d}d_distinct_counterparties"] = f"sender_out_{d}d_distinct_counterparties"
        receiver[f"in_{d}d_distinct_counterparties"] = f"receiver_in_{d}d_distinct_counterparties"
        sender[f"structuring_score_{d}d"] = f"structuring_score_{d}d"
    return sender, receiver


def with_ratios(df: DataFrame, days=C.WINDOW_DAYS, eps: float = 1.0) -> DataFrame:
    """sender_pass_through_ratio_<w>d = inflow / (outflow + eps)."""
    return df.withColumns({f"sender_pass_through_ratio_{d}d": F.col(f"sender_in_{d}d_amount_usd") / (F.col(f"sender_out_{d}d_amount_usd") + eps) for d in days})


def account_features(txns: DataFrame, days=C.WINDOW_DAYS) -> DataFrame:
    """``txns`` with all window features of sender and receiver, structuring scores and ratios; never null."""
    require_columns(txns.columns, REQUIRED, "account_features")
    windows = materialise(account_windows(txns, window_measures(days)), "account-windows")  # read for the sender and for the receiver
    sender, receiver = role_columns(days)
    rows = at_account(at_account(txns, windows, "from_account_key", sender), windows, "to_account_key", receiver)
    return with_ratios(rows.fillna(0, [*sender.values(), *receiver.values()]), days)


def feature_order(days=C.WINDOW_DAYS) -> list[str]:
    """The 36 window features in the order of the modelling table."""
    out = []
    for role, way in (("sender", "out"), ("sender", "in"), ("receiver", "in"), ("receiver", "out")):
        for d in days:
            out += [f"{role}_{way}_{d}d_count", f"{role}_{way}_{d}d_amount_usd"]
    out += [f"{role}_{way}_{d}d_distinct_counterparties" for role, way in (("receiver", "in"), ("sender", "out")) for d in days]
    out += [f"structuring_score_{d}d" for d in days] + [f"sender_pass_through_ratio_{d}d" for d in days]
    return out


def feature_table(txns: DataFrame, days=C.WINDOW_DAYS) -> DataFrame:
    """txn_id, the six key columns and the 36 window features."""
    usd = txns if "amount_paid_usd" in txns.columns else add_usd_amount(txns)
    return account_features(usd, days).select("txn_id", *KEYS, *feature_order(days))


def modelling_table(txns: DataFrame, days=C.WINDOW_DAYS, cycle_length: int = C.CYCLE_LENGTH, lookback: int = C.LOOKBACK_DAYS) -> DataFrame:
    """The feature table and the ten graph features: 52 columns beside txn_id."""
    return feature_table(txns, days).join(daily_graph_features(txns, cycle_length, lookback), "txn_id")
