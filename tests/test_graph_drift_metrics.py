"""Graphs, drift and ranking metrics on hand-made inputs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.expressions import band, reject_non_finite
from ledgerlens.functions.ordered import positions, running_totals
from ledgerlens.operators import drift as D
from ledgerlens.operators import graph as G
from ledgerlens.operators import metrics as M

DAY = datetime(2022, 9, 1)


def edges(spark, pairs):
    return spark.createDataFrame([(DAY.date(), a, b) for a, b in pairs], "as_of date, src string, dst string")


def on_cycle(spark, pairs, length=3):
    return {r["account_key"] for r in G.on_short_cycles(edges(spark, pairs), length).collect()}


def test_degrees_and_shares(spark):
    rows = {r["account_key"]: r for r in G.snapshot_features(edges(spark, [("A", "X"), ("A", "Y"), ("A", "Z"), ("W", "C"), ("V", "C")])).collect()}
    assert (rows["A"]["graph_out_degree"], rows["A"]["graph_fan_out_score"]) == (3, 1.0)
    assert (rows["C"]["graph_in_degree"], rows["C"]["graph_fan_in_score"]) == (2, 1.0)


def test_cycles(spark):
    assert on_cycle(spark, [("A", "B"), ("B", "C"), ("C", "A"), ("D", "E")], 4) == {"A", "B", "C"}
    assert on_cycle(spark, [("A", "A"), ("A", "B")]) == {"A"}
    assert on_cycle(spark, [("A", "B"), ("B", "A"), ("B", "C")]) == {"A", "B"}
    ring = [("A", "B"), ("B", "C"), ("C", "D"), ("D", "E"), ("E", "A")]
    assert on_cycle(spark, ring, 3) == set() and on_cycle(spark, ring, 4) == set() and on_cycle(spark, ring, 5) == set("ABCDE")


@pytest.mark.parametrize("length", [2, 3, 4])
def test_cycles_against_brute_force(spark, length):
    rng = random.Random(length)
    pairs = {(rng.choice("ABCDEFGH"), rng.choice("ABCDEFGH")) for _ in range(14)}

    def reach(path):
        if (path[-1], path[0]) in pairs:
            return True
        return len(path) < length and any(reach([*path, n]) for a, n in pairs if a == path[-1] and n not in path)

    assert on_cycle(spark, pairs, length) == {a for a in "ABCDEFGH" if reach([a])}


def transfers(spark, rows):
    return spark.createDataFrame([(i, DAY + timedelta(days=d), a, b) for i, (d, a, b) in enumerate(rows)], "txn_id long, timestamp timestamp_ntz, from_account_key string, to_account_key string")


def test_same_day_edges_do_not_count(spark):
    out = {r["txn_id"]: r for r in G.daily_graph_features(transfers(spark, [(0, "A", "B"), (0, "B", "A"), (1, "A", "C")])).collect()}
    assert out[0]["sender_graph_out_degree"] == 0 and not out[0]["sender_graph_in_cycle"]
    assert out[2]["sender_graph_out_degree"] == 1 and out[2]["sender_graph_in_cycle"]


def test_lookback_is_inclusive(spark):
    rows = transfers(spark, [(0, "A", "B"), (3, "A", "C"), (7, "A", "D"), (8, "A", "E")])
    got = lambda n: {r["txn_id"]: r["sender_graph_out_degree"] for r in G.daily_graph_features(rows, lookback=n).collect()}
    assert got(2)[1] == 0 and got(7)[1] == 1 and got(7)[2] == 2 and got(7)[3] == 2


def values(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "x double")


def test_bin_edges(spark):
    inner = D.bin_edges(values(spark, [0] * 9000 + list(range(1, 1001))), "x")
    assert len(inner) < 9 and inner == sorted(set(inner))
    constant = values(spark, [7.0] * 50)
    assert D.bin_edges(constant, "x") == [] and D.psi(constant, constant, "x").first()["psi"] == 0
    with pytest.raises(ValueError):
        D.bin_edges(constant, "x", 0)


def test_psi_of_emptied_and_outside_bins(spark):
    a = D.psi(values(spark, range(10000)), values(spark, range(1000)), "x").first()
    assert 1 < a["psi"] < 100 and a["band"] == "significant"
    assert D.psi(values(spark, range(1000)), values(spark, range(10000, 11000)), "x").first()["psi"] > 1


def test_category_share_sees_a_vanished_flag(spark):
    ref, cur = values(spark, [1] * 158 + [0] * 842), values(spark, [0] * 1000)
    assert D.psi(ref, cur, "x").first()["psi"] == 0
    assert D.category_psi(ref, cur, "x").first()["psi"] > 1
    assert D.category_psi(values(spark, [0, 1] * 50), values(spark, [0, 1, 2] * 50), "x").first()["psi"] > 0.1
    row = D.characteristic_stability(ref, cur, ["x"]).first()
    assert row["method"] == "category_share" and row["band"] == "significant"


def test_bands_and_bad_values(spark):
    df = values(spark, [0, 0.099, 0.10, 0.24, 0.25, 3])
    assert [r[0] for r in df.orderBy("x").select(band(F.col("x"))).collect()] == ["stable", "stable", "moderate", "moderate", "significant", "significant"]
    with pytest.raises(ValueError, match="non-finite"):
        reject_non_finite(values(spark, [1, float("nan")]), "x", "current")
    with pytest.raises(ValueError, match="empty"):
        reject_non_finite(values(spark, []), "x", "current")
    with pytest.raises(ValueError, match="missing"):
        D.characteristic_stability(df, df.withColumnRenamed("x", "y"), ["x"])


def test_thin_slices_stay(spark):
    rows = [(DAY, float(i)) for i in range(2000)] + [(DAY + timedelta(days=1), float(i)) for i in range(10)]
    cur = spark.createDataFrame(rows, "timestamp timestamp_ntz, x double")
    got = D.psi_over_time(values(spark, range(2000)), cur, "x").collect()
    assert [(r["n_rows"], r["band"]) for r in got] == [(2000, "stable"), (10, "insufficient_data")] and got[1]["psi"] is None


def scored(spark, labels, scores, kinds=None):
    rows = [(i, y, float(s), kinds[i] if kinds else None) for i, (y, s) in enumerate(zip(labels, scores, strict=True))]
    return spark.createDataFrame(rows, "txn_id long, is_laundering int, score double, pattern_type string")


def test_precision_at_k(spark):
    got = M.precision_at_k(M.ranked(scored(spark, [1, 0, 1, 0, 0], [0.9, 0.8, 0.7, 0.6, 0.1])), [3, 1, 10]).collect()
    assert {r["k"]: round(r["precision"], 6) for r in got} == {3: 0.666667, 1: 1.0, 10: 0.2}


def test_alert_queue(spark):
    n = lambda y, t: M.alert_queue(M.ranked(scored(spark, y, [1 - 0.1 * i for i in range(len(y))])), t).filter("in_alert_queue").count()
    assert n([1, 0, 1, 0, 1, 1], 0.75) == 5 and n([1, 0, 0, 1], 0.5) == 1 and n([1, 0, 0, 1], 1.0) == 4
    with pytest.raises(ValueError):
        n([0, 0], 0.5)


def test_recall_per_typology(spark):
    df = scored(spark, [1, 1, 1, 1, 0, 0], [1] * 6, ["FO", "FO", "CY", "CY", "CY", "NONE"]).withColumn("in_alert_queue", F.col("txn_id").isin(0, 2, 3))
    got = [(r["pattern_type"], r["positives"], r["caught"], r["recall"]) for r in M.recall_per_typology(df).collect()]
    assert got == [("CY", 2, 2, 1.0), ("FO", 2, 1, 0.5), ("NONE", 0, 0, None)]


def test_ranking_quality_with_ties(spark):
    rng = random.Random(1)
    y, s = [rng.random() < 0.3 for _ in range(200)], [rng.randrange(12) / 12 for _ in range(200)]
    got = M.ranking_quality(scored(spark, [int(v) for v in y], s)).first()
    pos, neg = [b for a, b in zip(y, s, strict=True) if a], [b for a, b in zip(y, s, strict=True) if not a]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    ap = sum(sum(1 for p in pos if p == t) / len(pos) * sum(1 for p in pos if p >= t) / sum(1 for v in s if v >= t) for t in set(s))
    assert got["roc_auc"] == pytest.approx(auc) and got["average_precision"] == pytest.approx(ap)


def test_positions_with_a_very_common_value(spark):
    df = spark.range(3000).select(F.col("id").alias("txn_id"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(3)).alias("score"))
    df = df.persist()
    got = positions(df, "score", "txn_id").collect()
    want = sorted(df.collect(), key=lambda r: (-r["score"], r["txn_id"]))
    assert [r["txn_id"] for r in sorted(got, key=lambda r: r["rank"])] == [r["txn_id"] for r in want]
    assert sorted(r["rank"] for r in got) == list(range(1, 3001))
    totals = running_totals(df.groupBy("score").agg(F.count(F.lit(1)).alias("n")), "score", ["n"]).collect()
    assert max(r["cum_n"] for r in totals) == 3000 and all(r["cum_n"] == sum(1 for w in want if w["score"] >= r["score"]) for r in totals[:20])


def test_split(spark):
    df = spark.range(1000).select(F.col("id").alias("txn_id"), (F.lit(DAY).cast("timestamp_ntz") + F.make_dt_interval(mins=F.floor(F.col("id") / 7).cast("int"))).alias("timestamp"))
    got = M.time_ordered_split(df)
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 600, "val": 200, "test": 200}
    assert M.check_split(got).count() == 3
    with pytest.raises(ValueError):
        M.check_split(got.withColumn("split", F.when(F.col("split") == "train", "test").otherwise("train")))
    with pytest.raises(ValueError):
        M.positive_weight(got.withColumn("is_laundering", F.lit(0)))


def test_matrix_has_all_formats(spark):
    df = spark.createDataFrame([(1, "ACH", 2.0, 1), (2, "Shells", 3.0, 0)], "txn_id long, payment_format string, amount double, is_laundering int")
    x = M.feature_matrix(df)
    assert [c for c in x.columns if c.startswith("payment_format_")] == [f"payment_format_{f}" for f in ("ACH", "Bitcoin", "Cash", "Cheque", "Credit Card", "Reinvestment", "Wire")]
    assert {t for c, t in x.dtypes if c not in ("txn_id", "label")} == {"float"}
    assert x.filter("txn_id = 2").select(*[f"`{c}`" for c in x.columns if c.startswith("payment_format_")]).first() == tuple([0.0] * 7)
    with pytest.raises(ValueError, match="missing"):
        M.align_features(x, ["nope"])


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5, 6])
def test_short_cycles_like_brute_force(spark, length):
    rng = random.Random(length)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(24)}
    ahead = {a: [y for x, y in edges if x == a] for a in range(14)}

    def back_home(start, at, seen):
        return any(n == start or n not in seen and len(seen) < length and back_home(start, n, seen | {n}) for n in ahead[at])

    want = {a for a in range(14) if back_home(a, a, {a})}
    df = spark.createDataFrame([(1, str(a), str(b)) for a, b in edges], "as_of int, src string, dst string")
    assert {int(r["account_key"]) for r in G.on_short_cycles(df, length).collect()} == want


@pytest.mark.parametrize("length, classes", [(3, 2), (4, 2)])
def test_short_cycles_over_classes_and_days(spark, length, classes):
    """Round trips over several classes, and walks that are seen only on the days of all their edges, across blocks of days."""
    rng = random.Random(length)
    rows = [(d, rng.randrange(30), rng.randrange(30)) for d in (0, 1, 2, 58, 59, 60, 61, 62) for _ in range(9)]
    days = {datetime(1970, 1, 1) + timedelta(days=d): d for d in (0, 1, 2, 58, 59, 60, 61, 62)}
    df = spark.createDataFrame([(i, datetime(1970, 1, 1) + timedelta(days=d), str(a), str(b)) for i, (d, a, b) in enumerate(rows)], "txn_id long, timestamp timestamp_ntz, from_account_key string, to_account_key string")
    seen = {d: {(a, b) for e, a, b in rows if e < d <= e + 2} for d in days.values()}
    assert {(r["as_of"].toordinal() - 719163, int(r["src"]), int(r["dst"])) for r in G.visible_edges(df, 2).collect()} == {(d, a, b) for d in seen for a, b in seen[d]}

    def back_home(pairs, start, at, steps):
        return steps < length and any(y == start or back_home(pairs, start, y, steps + 1) for x, y in pairs if x == at)

    want = {(d, a) for d in seen for a in range(30) if back_home(seen[d], a, a, 0)}
    found = G.on_short_cycles(G.packed_edges(df, 2), length, per_class=20)
    assert {(r["as_of"].toordinal() - 719163, int(r["account_key"])) for r in found.collect()} == want
    assert found.count() == len(want)
    core = G.packed_edges(df, 2).filter("src != dst").selectExpr("block", "cast(src as long) src", "cast(dst as long) dst", "mask")
    by_block = [r["block"] for r in core.select("block").distinct().collect()]
    one, other = set(), set()
    for n in range(2, length + 1):
        one |= {(r["as_of"], r["id"]) for r in G.unpacked(G._closed_in_memory(core, by_block, classes, n)).collect()}
        other |= {(r["as_of"], r["id"]) for r in G.unpacked(G._closed_by_joins(core, {}, n)).collect()}
    assert one == other


def test_closed_walks_in_runs_and_by_class():
    """Runs of a few starts give what one run gives, and a hub's walks are not multiplied."""
    import numpy as np

    rng = np.random.default_rng(3)
    steps = [np.stack([rng.integers(0, 25, 60), rng.integers(0, 25, 60) + 0, rng.integers(1, 16, 60)]) for _ in range(4)]
    for n in (2, 3, 4):
        whole, few = (dict(zip(*(x.tolist() for x in G.closed_walks(steps[:n], most)), strict=True)) for most in (1 << 21, 5))
        assert whole == few
    mids = np.arange(1, 3001)
    out, back, one = np.stack([0 * mids, mids, 0 * mids + 1]), np.stack([mids, 0 * mids + 5000, 0 * mids + 1]), 1
    ids, masks = G.closed_walks([out, back, np.stack([0 * mids + 5000, mids + 6000, 0 * mids + 1]), np.stack([mids + 6000, 0 * mids, 0 * mids + 1])])
    assert len(ids) == 6002 and set(masks.tolist()) == {one}
    assert G.round_trips(2, 3) == [(0, 0, 0), (0, 0, 1), (0, 1, 1), (1, 1, 1)]


def test_graph_share_counts_the_first(spark):
    rows = [("sender_graph_in_degree", 0.5), ("score", 0.4), ("hour", 0.3), ("receiver_graph_in_cycle", 0.2)]
    table = spark.createDataFrame(rows, "feature string, csi double")
    assert tuple(D.graph_share(table, 3).first()) == (3, 1)
    assert tuple(D.graph_share(table).first()) == (4, 2)
    assert tuple(D.graph_share(table.filter("csi > 1")).first()) == (0, 0)
