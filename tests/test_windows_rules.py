"""Frames, rules and features on hand-made transfers."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.expressions import add_usd_amount, unknown_currencies
from ledgerlens.operators import features, rules
from ledgerlens.operators.windows import DAY, HOUR, Measure, account_windows, asof_join

START = datetime(2022, 9, 1)
SCHEMA = "txn_id long, timestamp timestamp_ntz, from_account_key string, to_account_key string, amount_paid_usd double, is_laundering int, payment_format string"


def table(spark, rows):
    """Rows of (hours, from, to, amount)."""
    return spark.createDataFrame([(i, START + timedelta(hours=h), a, b, float(v), 0, "ACH") for i, (h, a, b, v) in enumerate(rows)], SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("txn_id").collect()]


def test_count_and_sum_expire_after_a_day(spark):
    f = features.account_features(table(spark, [(0, "A", "B", 100), (6, "A", "B", 200), (12, "A", "B", 300), (48, "A", "B", 400)]))
    assert column(f, "sender_out_1d_count") == [1, 2, 3, 1]
    assert column(f, "sender_out_1d_amount_usd") == [100, 300, 600, 400]


def test_sender_inflow(spark):
    f = features.account_features(table(spark, [(0, "X", "A", 500), (6, "A", "B", 100)]))
    row = f.filter("txn_id = 1").first()
    assert (row["sender_in_1d_count"], row["sender_in_1d_amount_usd"], row["sender_out_1d_count"]) == (1, 500, 1)


def test_distinct_counterparties_and_their_expiry(spark):
    f = features.account_features(table(spark, [(0, "X", "C", 1), (1, "Y", "C", 1), (2, "Z", "C", 1), (50, "X", "C", 1)]))
    assert column(f, "receiver_in_1d_distinct_counterparties") == [1, 2, 3, 1]
    assert column(f, "receiver_in_7d_distinct_counterparties") == [1, 2, 3, 3]


def test_structuring_score_and_ratio(spark):
    f = features.account_features(table(spark, [(0, "A", "B", 9500), (1, "A", "B", 9600), (2, "A", "B", 15000)]))
    assert column(f, "structuring_score_1d") == [1, 2, 2]
    g = features.account_features(table(spark, [(0, "X", "A", 1000), (1, "A", "B", 999)]))
    assert g.filter("txn_id = 1").first()["sender_pass_through_ratio_1d"] == 1.0


def test_later_rows_do_not_change_earlier_ones(spark):
    rows = [(0, "A", "B", 100), (5, "B", "A", 50), (9, "A", "C", 10)]
    before = features.account_features(table(spark, rows)).filter("txn_id < 2").orderBy("txn_id").collect()
    after = features.account_features(table(spark, [*rows[:2], (9, "A", "C", 99999)])).filter("txn_id < 2").orderBy("txn_id").collect()
    assert before == after


def test_modelling_table_has_no_nulls(spark):
    raw = table(spark, [(0, "A", "B", 10), (1, "B", "A", 20)])
    out = features.modelling_table(raw)
    assert len(out.columns) == 53 and out.count() == 2
    assert out.select([F.count_if(F.col(c).isNull()).alias(c) for c in out.columns]).first() == tuple([0] * 53)


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="missing expected columns"):
        features.account_features(spark.range(1))


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(0, 60) * 6, rng.choice("ABC"), rng.choice("ABC"), rng.randrange(1, 50)) for _ in range(80)]
    got = {(r["account_key"], r["timestamp"]): r for r in account_windows(table(spark, rows), [Measure("n", "count", "out", DAY), Measure("s", "sum", "in", 7 * DAY), Measure("d", "distinct", "out", 7 * DAY)]).collect()}
    for key in {(a, h) for h, x, y, _ in rows for a in (x, y)}:
        a, h = key
        row = got[(a, START + timedelta(hours=h))]
        assert row["n"] == sum(1 for t, x, _, _ in rows if x == a and h - 24 < t <= h)
        assert row["s"] == sum(v for t, _, y, v in rows if y == a and h - 168 < t <= h)
        assert row["d"] == len({y for t, x, y, _ in rows if x == a and h - 168 < t <= h})


def test_fx(spark):
    df = spark.createDataFrame([(100.0, "US Dollar"), (50.0, "Euro")], "amount_paid double, payment_currency string")
    assert [r["amount_paid_usd"] for r in add_usd_amount(df, {"US Dollar": 1.0, "Euro": 2.0}).collect()] == [100, 100]
    assert unknown_currencies(df, {"Euro": 2.0}) == ["US Dollar"]
    with pytest.raises(Exception, match="No FX rate configured"):
        add_usd_amount(df, {"Euro": 2.0}).collect()


def flags(spark, rows, name):
    return column(rules.apply_rules(table(spark, rows)), name)


def test_large_amount_is_strict(spark):
    assert flags(spark, [(0, "A", "B", 5000), (1, "C", "D", 15000), (2, "E", "F", 9999.99), (3, "G", "H", 10000.01), (4, "I", "J", 10000)], "flag_large_amount") == [False, True, False, True, False]


def test_structuring(spark):
    assert flags(spark, [(0, "A", "B", 9500), (0.5, "A", "B", 9500), (1, "A", "B", 9500), (0, "C", "D", 9500), (1, "C", "D", 9500)], "flag_structuring") == [False, False, True, False, False]
    assert flags(spark, [(0, "A", "B", 9500), (24, "A", "B", 9500), (48, "A", "B", 9500)], "flag_structuring") == [False] * 3


def test_pass_through(spark):
    got = flags(spark, [(0, "P", "X", 1), (0.5, "X", "Q", 1), (0, "P", "Y", 1), (5, "Y", "Q", 1), (1, "Z", "Q", 1), (2, "S", "S", 1)], "flag_pass_through")
    assert got == [False, True, False, False, False, True]


def test_summary(spark):
    df = table(spark, [(0, "A", "B", 20000), (1, "C", "D", 100)]).withColumn("is_laundering", F.when(F.col("txn_id") == 0, 1).otherwise(0))
    row = rules.summarise(rules.apply_rules(df)).first()
    assert (row["alerts"], row["true_positives"], row["precision"], row["recall"]) == (1, 1, 1.0, 1.0)
    empty = rules.summarise(rules.apply_rules(df.limit(0))).first()
    assert (empty["alerts"], empty["precision"], empty["recall"]) == (0, 0.0, 0.0)


def test_asof_join_over_blocks(spark):
    left = spark.createDataFrame([(i, "k", START + timedelta(days=d)) for i, d in enumerate([0, 1, 40, 41])] + [(9, "none", START)], "id int, k string, t timestamp_ntz")
    right = spark.createDataFrame([("k", START + timedelta(days=1), 1), ("k", START + timedelta(days=1), 2), ("k", START + timedelta(days=41), 3)], "k string, t timestamp_ntz, v int")
    assert [r["asof_v"] for r in asof_join(left, right, "k", "t", ["v"]).orderBy("id").collect()] == [None, 2, 2, 3, None]
    assert HOUR * 24 == DAY


def test_sums_forget_large_amounts_and_busy_accounts(spark):
    """Amounts from a cent to 1e13 in one account: every window equals a sum over decimals to the cent, before, in and after them, over many days."""
    import random
    from datetime import datetime, timedelta
    from decimal import Decimal

    rng = random.Random(6)
    start, rows = datetime(2024, 1, 1), []
    for i in range(400):
        cents = rng.choice([1, 37, 5, 99_999, 10**15]) + rng.randrange(100)
        rows.append((i, start + timedelta(minutes=rng.randrange(20_000)), "A", "BCD"[i % 3], cents / 100))
    txns = spark.createDataFrame(rows, "txn_id long, timestamp timestamp_ntz, from_account_key string, to_account_key string, amount_paid_usd double")
    got = account_windows(txns, [Measure("day", "sum", "out", DAY), Measure("week", "sum", "out", 7 * DAY), Measure("n", "count", "out", 7 * DAY), Measure("who", "distinct", "out", DAY)]).filter("account_key = 'A'").collect()
    assert len(got) == len({r[1] for r in rows})
    for r in got:
        inside = {d: [x for x in rows if r["timestamp"] - timedelta(days=d) < x[1] <= r["timestamp"]] for d in (1, 7)}
        for d, name in ((1, "day"), (7, "week")):
            want = sum(round(Decimal(x[4]), 2) for x in inside[d])
            assert round(Decimal(r[name]), 2) == want or abs(Decimal(r[name]) - want) <= Decimal(abs(r[name])) * Decimal(2) ** -52
        assert r["n"] == len(inside[7]) and r["who"] == len({x[3] for x in inside[1]})
