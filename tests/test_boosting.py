"""Boosting by histograms against a plain computation, and both ways of account windows against each other."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import ordered as O
from ledgerlens.operators import boosting as H
from ledgerlens.operators import metrics as M
from ledgerlens.operators import model as ML
from ledgerlens.operators import windows as W
from ledgerlens.operators.windows import DAY, Measure, account_windows

NAMES = ["a", "b", "c"]


def matrix(spark, n=3000, parts=5):
    x = F.xxhash64("txn_id")
    df = spark.range(n).withColumnRenamed("id", "txn_id").select(
        "txn_id", (F.pmod(x, F.lit(1000)) / 10).cast("float").alias("a"), F.pmod(F.shiftright(x, 20), F.lit(7)).alias("b"), (F.pmod(F.shiftright(x, 40), F.lit(500)) / 500).alias("c"), (F.col("txn_id") % 5 == 4).alias("validation")
    )
    return df.withColumn("label", ((F.col("a") > 70) & (F.col("b") < 3) | (F.col("txn_id") % 50 == 0)).cast("tinyint")).repartition(parts)


def test_a_tree_is_the_best_of_all_cuts(spark):
    df = matrix(spark)
    trees = H.train_by_histograms(df, NAMES, rounds=1, depth=1, share=1.0)
    rows = df.filter("not validation").collect()
    y = np.array([r["label"] for r in rows])
    w = np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0)
    g, h = w * (0.5 - y), w * 0.25

    def gain(left):
        parts = [(g[s].sum(), h[s].sum()) for s in (left, ~left)]
        return sum(a * a / (b + 1) for a, b in parts) - g.sum() ** 2 / (h.sum() + 1)

    tree = trees.nodes[0]
    cut = lambda f, c: np.array([r[NAMES[f]] for r in rows]) <= c
    got = gain(cut(tree["feature"][0], tree["threshold"][0]))
    assert got >= max(gain(cut(1, c)) for c in range(7)) - 1e-6 and got >= 0.99 * max(gain(cut(0, c)) for c in np.arange(0, 100, 0.1))
    left = cut(tree["feature"][0], tree["threshold"][0])
    assert tree["value"][1] == pytest.approx(-g[left].sum() / (h[left].sum() + 1)) and tree["cover"][1] == pytest.approx(h[left].sum())


def test_trees_do_not_depend_on_the_way_or_the_partitions(spark, monkeypatch):
    settings = {"rounds": 23, "depth": 4, "bins": 32}
    whole = H.train_by_histograms(matrix(spark), NAMES, **settings)
    assert len(whole.nodes) == 23 and max(len(t["value"]) for t in whole.nodes) > 15
    monkeypatch.setattr(H, "SHARD", 100)  # many shards a task
    assert H.train_by_histograms(matrix(spark, parts=3), NAMES, **settings) == whole
    monkeypatch.setattr(H, "_grown_in_tasks", lambda *_: pytest.fail("does not fit"))
    monkeypatch.setattr(H, "HELD", 0)
    assert H.train_by_histograms(matrix(spark, parts=2), NAMES, **settings) == whole
    df = matrix(spark)
    quality = {r["rounds"]: r["average_precision"] for r in ML.prefix_quality(df.filter("validation"), whole, 23).collect()}
    assert quality[23] > 0.9


def test_training_takes_few_jobs_however_many_rounds(spark):
    """A job a level was most of a training's time: 600 jobs for 100 rounds."""
    context, df = spark.sparkContext, matrix(spark)
    context.setJobGroup("rounds", "a training")
    try:
        H.train_by_histograms(df, NAMES, rounds=30, depth=4)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("rounds")) < 30


def test_null_and_nan_go_right_as_in_scoring(spark):
    df = matrix(spark).withColumn("c", F.when(F.col("txn_id") % 3 == 0, F.lit(None)).when(F.col("txn_id") % 3 == 1, F.lit(math.nan)).otherwise(F.col("c")))
    df = df.withColumn("label", (F.col("txn_id") % 3 < 2).cast("tinyint"))
    tree = H.train_by_histograms(df, ["c"], rounds=1, depth=1, share=1.0).nodes[0]
    assert tree["feature"][0] == 0 and tree["value"][2] > 0 > tree["value"][1]


def test_cuts_part_rows_evenly(spark, monkeypatch):
    monkeypatch.setattr(H, "SHARD", 700)
    cuts, n = H.quantile_cuts(spark.range(20_000).selectExpr("cast(id as double) x", "cast(id % 3 as float) y", "cast(null as double) z"), ["x", "y", "z"], 64)
    assert n == 20_000 and len(cuts[0]) == 63 and np.abs(cuts[0] - np.arange(1, 64) * 20_000 / 64).max() < 60
    assert cuts[1].tolist() == [0, 1, 2] and len(cuts[2]) == 0


def test_windows_in_memory_equal_the_sweep(spark, monkeypatch):
    rng = random.Random(5)
    who = ["a", "b", "c", "d", "e", None]
    start = dt.datetime(2024, 1, 1)
    rows = [(rng.choice(who), rng.choice(who), start + dt.timedelta(minutes=rng.randrange(0, 60 * 24 * 50, 30)), rng.choice([None, 0.1, 1e15, 12.345, -7.77])) for _ in range(600)]
    rows += [("a", "b", None, 5.0), ("a", "a", dt.datetime(1900, 1, 1), 1.5), ("z", "a", dt.datetime(9000, 1, 1), 2.5)]
    txns = spark.createDataFrame(rows, "from_account_key string, to_account_key string, timestamp timestamp_ntz, amount_paid_usd double")
    band = F.col("amount_paid_usd") > 10
    measures = [Measure(f"{k}_{way}_{d}", k, way, d * DAY, band if k == "count" and d == 7 else None) for k in ("count", "sum", "distinct") for way in ("out", "in") for d in (1, 7, 30)]
    read = lambda: sorted(map(tuple, account_windows(txns, measures).collect()), key=repr)
    monkeypatch.setattr(W, "_swept", lambda *_: pytest.fail("no account is busy"))
    memory = read()
    monkeypatch.setattr(W, "_RUN", 40)  # several runs a task, accounts across them
    assert len(memory) > 600 and read() == memory
    monkeypatch.undo()
    for most in (0, 230):  # all accounts busy, some
        monkeypatch.setattr(W, "BUSY", most)
        assert read() == memory


def test_split_by_two_pairs_equals_positions(spark, monkeypatch):
    rng = random.Random(2)
    start = dt.datetime(2024, 1, 1)
    minutes = [rng.choice([7, 7, rng.randrange(500)]) for _ in range(1000)]
    rows = [(k * 7919 % 1000, start + dt.timedelta(minutes=m) if m % 100 else None) for k, m in enumerate(minutes)]
    txns = spark.createDataFrame(rows, "txn_id long, timestamp timestamp_ntz")
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or start, r[0]))]
    for train, val in ((0.6, 0.2), (0.0, 0.001), (0.3337, 0.6663)):
        got = {r["txn_id"]: r["split"] for r in M.time_ordered_split(txns, train, val).collect()}
        first, second = int(1000 * train), int(1000 * (train + val))
        assert [got[t] for t in want] == ["train"] * first + ["val"] * (second - first) + ["test"] * (1000 - second)
    assert O.pairs_at(txns.selectExpr("coalesce(minute(timestamp), 0) as t", "txn_id"), "t", "txn_id", [0.5], enough=3) == O.pairs_at(txns.selectExpr("coalesce(minute(timestamp), 0) as t", "txn_id"), "t", "txn_id", [0.5])
    same = spark.range(10).selectExpr("id div 5 as txn_id", "timestamp_ntz'2024-01-01' as timestamp")
    assert {r["split"]: r["count"] for r in M.time_ordered_split(same).groupBy("split").count().collect()} == {"train": 6, "val": 2, "test": 2}
