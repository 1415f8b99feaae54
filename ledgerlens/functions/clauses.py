"""Reason sentences: features and their values in plain words, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PAYMENT_FORMATS

FORMAT_FEATURES = tuple(f"payment_format_{f}" for f in PAYMENT_FORMATS)
#: The sentence for rows without a reason, and how windows are called.
NO_REASON = "Flagged: no individual feature pushed this transaction's score upward (ranking driven by the model's baseline rate)."
WINDOW_NAMES = {"1": "24h", "7": "7 days", "30": "30 days"}
VERBS, PREPOSITIONS = {"out": "sent", "in": "received"}, {"out": "to", "in": "from"}
#: Wording by family of feature names; {n} is a whole number, {usd} dollars, {x} two decimals, {set|unset} by the value.
FAMILIES = [
    (r"amount_paid_usd", "a {usd} payment"),
    (r"structuring_score_(?P<days>\d+)d", "{n} of the sender's payments in the past {window} sat just under the $10,000 reporting threshold"),
    (r"sender_pass_through_ratio_(?P<days>\d+)d", "the sender's inflow-to-outflow ratio over the past {window} is {x} (near 1.0 means funds pass straight through rather than accumulate)"),
    (r"(?P<role>sender|receiver)_(?P<way>in|out)_(?P<days>\d+)d_distinct_counterparties", "the {role} {verb} {prep} {n} distinct counterparties in the past {window}"),
    (r"(?P<role>sender|receiver)_(?P<way>in|out)_(?P<days>\d+)d_amount_usd", "the {role} {verb} {usd} in the past {window}"),
    (r"(?P<role>sender|receiver)_(?P<way>in|out)_(?P<days>\d+)d_count", "the {role} {verb} {n} transactions in the past {window}"),
    (r"(?P<role>sender|receiver)_graph_(?P<way>in|out)_degree", "the {role} {verb} {prep} {n} distinct accounts in the graph window"),
    (r"(?P<role>sender|receiver)_graph_fan_(?P<way>in|out)_score", "the {role} is structurally a {shape}, fan-{way} score {x}"),
    (r"(?P<role>sender|receiver)_graph_in_cycle", "the {role} {sits on a short directed cycle (funds loop back within a few hops)|does not sit on a short directed cycle}"),
    (r"payment_format_(?P<format>.+)", "the payment was {|not }made via {format}"),
]
SHAPES = {"in": "collector (mostly receiving)", "out": "distributor (mostly sending)"}


def describe(name: str, value: Column) -> Column:
    """The clause for one feature and its value column; an unknown feature reads "name = value"."""
    for pattern, wording in FAMILIES:
        if hit := re.fullmatch(pattern, name):
            g = hit.groupdict()
            words = g | {"window": WINDOW_NAMES.get(g.get("days"), f"{g.get('days')} days"), "verb": VERBS.get(g.get("way")), "prep": PREPOSITIONS.get(g.get("way")), "shape": SHAPES.get(g.get("way"))}
            parts: list[Column] = []
            for text in re.split(r"(\{[^{}]*\})", wording):
                inner = text[1:-1] if text.startswith("{") else None
                if inner is None:
                    parts.append(F.lit(text))
                elif "|" in inner:
                    yes, no = inner.split("|")
                    parts.append(F.when(value != 0, yes).otherwise(no))
                elif inner == "n":
                    parts.append(F.format_number(value, 0))
                elif inner == "usd":
                    parts += [F.lit("$"), F.format_number(value, 0)]
                elif inner == "x":
                    parts.append(F.call_function("format_number", value, F.lit("0.00")))
                else:
                    parts.append(F.lit(words[inner]))
            return F.concat(*parts)
    return F.concat(F.lit(f"{name} = "), general(value))


def general(value: Column) -> Column:
    """A number with four significant digits: no trailing zeros, thousands in commas, powers of ten from 10,000 up and below 0.0001."""
    least = F.floor(F.log10(F.abs(value))).cast("int")
    scale = F.pow(F.lit(10.0), F.abs(least - 3))
    digits = F.rint(F.when(least >= 3, value / scale).otherwise(value * scale))  # ties to even
    carry = F.abs(digits) >= 10_000
    size = F.when(value == 0, 0).otherwise(F.when(carry, least + 1).otherwise(least))
    exponent = F.concat(F.when(size < 0, "e-").otherwise("e+"), F.lpad(F.abs(size).cast("string"), 2, "0"))
    mantissa = F.concat(F.call_function("format_number", digits / F.when(carry, 10_000).otherwise(1_000), F.lit("0.###")), exponent)
    plain = F.coalesce(*[F.when(size == k, F.call_function("format_number", value, F.lit("#,##0" + ("." + "#" * (3 - k) if k < 3 else "")))) for k in range(-4, 4)])
    return F.when(value == 0, "0").when((size >= 4) | (size < -4), mantissa).otherwise(plain)


def top_contributors(contributions: Column, names: list[str], n: int = 3, exclude=()) -> Column:
    """Array of (c, i): the ``n`` largest positive contributions with their place in ``names``; ties by place, excluded names left out."""
    allowed = [k for k, name in enumerate(names) if name not in set(exclude)]
    cells = F.transform(contributions, lambda c, i: F.struct((-c).alias("neg"), i.alias("i")))
    keep = F.filter(cells, lambda z: (z["neg"] < 0) & F.array_contains(F.array(*[F.lit(k) for k in allowed]), z["i"]))
    return F.transform(F.slice(F.array_sort(keep), 1, n), lambda z: F.struct((-z["neg"]).alias("c"), z["i"].alias("i")))


def sentence(contributions: Column, values: Column, names: list[str], n: int = 3, exclude=()) -> Column:
    """The reason sentence of a row: arrays of contributions and of raw values, both in the order of ``names``."""


    def clause(place: Column) -> Column:
        """Only the branch of the feature in this place is evaluated."""
        told = None
        for k, name in enumerate(names):
            this = describe(name, values[k].cast("double"))
            told = F.when(place == k, this) if told is None else told.when(place == k, this)
        return told

    places = F.transform(top_contributors(contributions, names, n, exclude), lambda z: z["i"])
    text = lambda p: F.when(F.size(p) == 0, F.lit(NO_REASON)).otherwise(F.concat(F.lit("Flagged: "), F.array_join(F.transform(p, clause), "; "), F.lit(".")))
    return F.transform(F.array(places), text)[0]


def is_grounded(name: str, value: Column, clause: Column) -> Column:
    """Whether a clause states the value: by wording for 0/1 features, else by one of its numbers (to 0.5, ratios to 0.005)."""
    if name.endswith("_graph_in_cycle"):
        return (~clause.contains("does not sit")) == (value != 0)
    if name.startswith("payment_format_"):
        return (~clause.contains("was not made")) == (value != 0)
    close = 0.005 if "ratio" in name else 0.5
    numbers = F.regexp_extract_all(clause, F.lit(r"\d[\d,]*\.?\d*"), F.lit(0))
    return F.exists(numbers, lambda t: F.abs(F.replace(t, F.lit(","), F.lit("")).cast("double") - value) <= close)


def waterfall(df, contributions: str, values: str, names: list[str], n: int = 10, keep=("txn_id",)):
    """Per row: the ``n`` largest contributions by size, the others as one sum, in falling order (feature, value, contribution)."""
    from .expressions import prettify

    table = F.array(*[F.lit(x) for x in names])
    order = F.array_sort(F.transform(contributions, lambda c, i: F.struct((-F.abs(c)).alias("k"), i.alias("i"), c.alias("c"))))
    head = F.transform(F.slice(order, 1, n), lambda z: F.struct(prettify(F.element_at(table, z["i"] + 1)).alias("feature"), F.element_at(F.col(values), z["i"] + 1).cast("double").alias("value"), z["c"].alias("contribution")))
    rest = F.aggregate(F.slice(order, n + 1, max(1, len(names))), F.lit(0.0), lambda a, z: a + z["c"])
    other = F.array(F.struct(F.lit(f"{len(names) - n} other features").alias("feature"), F.lit(None).cast("double").alias("value"), rest.alias("contribution")))
    rows = F.concat(head, other) if len(names) > n else head
    return df.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*").orderBy(*keep, F.desc("contribution"), "feature")


def reconstructed(contributions: Column, base: float) -> Column:
    """The score that contributions and base add up to."""
    return 1 / (1 + F.exp(-(F.lit(base) + F.aggregate(contributions, F.lit(0.0), lambda a, c: a + c))))
