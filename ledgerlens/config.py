"""Settings: fixed values of the triage task, and a YAML loader."""

from __future__ import annotations

#: Approximate US-dollar rates.
FX_RATES = {
    "US Dollar": 1.0, "Euro": 1.0, "UK Pound": 1.15, "Swiss Franc": 1.04, "Canadian Dollar": 0.74, "Australian Dollar": 0.65, "Yen": 0.0071,
    "Yuan": 0.143, "Rupee": 0.0125, "Shekel": 0.29, "Ruble": 0.0167, "Mexican Peso": 0.05, "Saudi Riyal": 0.267, "Brazil Real": 0.19, "Bitcoin": 19500.0,
}
#: The payment formats of the one-hot columns.
PAYMENT_FORMATS = ("ACH", "Bitcoin", "Cash", "Cheque", "Credit Card", "Reinvestment", "Wire")
#: Days of the rolling windows, and the thresholds of rules, graph, drift and evaluation.
WINDOW_DAYS = (1, 7, 30)
LARGE_AMOUNT = 10_000.0
STRUCTURING_FRACTION = 0.9
STRUCTURING_HOURS = 24
STRUCTURING_COUNT = 3
PASS_THROUGH_HOURS = 2
CYCLE_LENGTH = 3
LOOKBACK_DAYS = 7
PSI_BINS = 10
PSI_EPSILON = 1e-6
PSI_MODERATE, PSI_SIGNIFICANT = 0.10, 0.25
MIN_SLICE = 1000
TRAIN_FRACTION, VAL_FRACTION = 0.6, 0.2


def load_config(path: str) -> dict:
    """A YAML file as nested dicts and lists."""
    import yaml

    from .sources.scratch import read_text

    return yaml.safe_load(read_text(path))
