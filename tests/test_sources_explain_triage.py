"""Readers, sentences, trees, filters and samples."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import clauses as X
from ledgerlens.operators import aggregates as A
from ledgerlens.operators import metrics as M
from ledgerlens.operators import model as ML
from ledgerlens.operators import triage as Q
from ledgerlens.sources import transfers as S

HEADER = ",".join(S.TRANSACTION_HEADER)
LINE = "2022/09/01 00:20,010,8000EBD30,010,8000F5340,100.00,US Dollar,100.00,US Dollar,Cheque,0"


def test_transactions(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text(f"{HEADER}\n{LINE}\n2022/09/01 00:10,3,8000F,4,80010,1.5,Euro,1.5,Euro,ACH,1\n")
    rows = S.read_transactions(spark, str(p)).orderBy("txn_id").collect()
    assert [r["txn_id"] for r in rows] == [0, 1] and rows[1]["from_account_key"] == "10_8000EBD30" and rows[0]["from_account"] == "8000F"
    assert rows[1]["timestamp"] == datetime(2022, 9, 1, 0, 20)
    p.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing expected columns"):
        S.read_transactions(spark, str(p))


def test_accounts(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nB,010,8000,E1,N\n")
    assert S.read_accounts(spark, str(p)).first()["account_key"] == "10_8000"
    p.write_text("Bank Name\nB\n")
    with pytest.raises(ValueError, match="missing expected columns"):
        S.read_accounts(spark, str(p))


def test_patterns_and_join(spark, tmp_path):
    p = tmp_path / "p.txt"
    p.write_text(f"{LINE}\n\nBEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 16-degree Fan-Out\n{LINE[:-1]}1\na,b\n\nEND LAUNDERING ATTEMPT - FAN-OUT\n{LINE}\nBEGIN LAUNDERING ATTEMPT - CYCLE:  4\n{LINE[:-1].replace('8000F5340', '77')}1\nEND LAUNDERING ATTEMPT - CYCLE\n")
    got = S.read_patterns(spark, str(p))
    assert sorted((r["pattern_type"], r["to_account"], r["is_laundering"]) for r in got.collect()) == [("CYCLE", "77", 1), ("FAN-OUT", "8000F5340", 1)]
    keys = S.TRANSACTION_FIELDS
    txns = got.drop("pattern_type").unionByName(got.limit(1).drop("pattern_type").withColumn("is_laundering", F.lit(0)))
    joined = A.join_pattern_types(txns, got, keys)
    assert joined.count() == 3 and joined.filter("pattern_type is null").count() == 1
    with pytest.raises(ValueError, match="duplicate join keys"):
        A.join_pattern_types(txns, got.unionByName(got), keys)


def test_records_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "n long, x double")
    assert S.records(df) == [{"n": 1, "x": None}, {"n": 2, "x": 0.5}]
    assert sorted(r["json"] for r in S.json_rows(df).collect()) == ['{"n":1,"x":null}', '{"n":2,"x":0.5}']
    S.write_json({"a": [{"n": 1}], "when": datetime(2024, 1, 1)}, str(tmp_path / "m.json"))
    assert S.frame(spark, S.read_json(str(tmp_path / "m.json")), "a").first()["n"] == 1
    S.write_json({"name": "Zoë"}, f"file://{tmp_path}/m.json")  # a path with a scheme, an older file in its place
    assert S.read_json(str(tmp_path / "m.json")) == {"name": "Zoë"}


def clause(spark, name, value):
    return spark.range(1).select(X.describe(name, F.lit(float(value)))).first()[0]


def test_clauses(spark):
    assert clause(spark, "amount_paid_usd", 12345.6) == "a $12,346 payment"
    assert clause(spark, "structuring_score_1d", 3) == "3 of the sender's payments in the past 24h sat just under the $10,000 reporting threshold"
    assert clause(spark, "sender_out_7d_distinct_counterparties", 1200) == "the sender sent to 1,200 distinct counterparties in the past 7 days"
    assert clause(spark, "receiver_in_14d_amount_usd", 99.5) == "the receiver received $100 in the past 14 days"
    assert clause(spark, "payment_format_Credit Card", 0) == "the payment was not made via Credit Card"
    assert clause(spark, "sender_graph_in_cycle", 1) == "the sender sits on a short directed cycle (funds loop back within a few hops)"


def test_four_significant_digits_like_python(spark):
    rng = random.Random(3)
    xs = [0.0, 3.5, 1234.0, 9999.4, 12345.0, 0.00012, -2.25, 100.0, 0.1, 123.456] + [rng.uniform(-1, 1) * 10 ** rng.randrange(-6, 9) for _ in range(200)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", X.general(F.col("x")).alias("s")).collect()
    assert [(r["x"], r["s"]) for r in rows] == [(r["x"], f"{r['x']:,.4g}") for r in rows]


def test_sentences(spark):
    names = ["amount_paid_usd", "structuring_score_1d", "payment_format_ACH", "x", "y", "z"]
    df = spark.createDataFrame([([0.4, -0.9, 0.2, 0.0, 0.1, 0.3], [5.0, 1.0, 1.0, 2.0, 3.5, 7.0]), ([-1.0] * 6, [0.0] * 6), ([0.1, 0.0, 0.1, 0.1, 0.1, 0.0], [1.0] * 6)], "c array<double>, v array<double>")
    got = [r["s"] for r in df.select(X.sentence(F.col("c"), F.col("v"), names).alias("s")).collect()]
    assert got == ["Flagged: a $5 payment; z = 7; the payment was made via ACH.", X.NO_REASON, "Flagged: a $1 payment; the payment was made via ACH; x = 1."]
    other = df.select(X.sentence(F.col("c"), F.col("v"), names, exclude=X.FORMAT_FEATURES).alias("s")).first()["s"]
    assert other == "Flagged: a $5 payment; z = 7; y = 3.5."


def small_model(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        a, b, c = rng.random(), rng.random(), rng.randrange(3)
        rows.append((i, a, b, float(c), int(a > 0.6 and b > 0.4 or c == 2 and a > 0.9), i % 5 == 0))
    df = spark.createDataFrame(rows, "txn_id long, a double, b double, c double, label int, validation boolean")
    return df, ML.train_boosted(df, ["a", "b", "c"], rounds=4, depth=3, rate=0.3)


def test_contributions_are_exact_shapley_values(spark):
    from itertools import combinations
    from math import exp, factorial

    import numpy as np

    df, model = small_model(spark)
    trees = ML.trees_of(model, ["a", "b", "c"])
    x = np.array([[r["a"], r["b"], r["c"]] for r in df.limit(12).collect()])
    phi, base = ML.contributions_of(trees, x)
    assert np.allclose(base + phi.sum(1), ML.margins_of(trees, x))

    def expected(row, known):
        def walk(t, at):
            f = t["feature"][at]
            if f < 0:
                return t["value"][at]
            left, right = t["left"][at], t["right"][at]
            if f in known:
                return walk(t, left if row[f] <= t["threshold"][at] else right)
            return (t["cover"][left] * walk(t, left) + t["cover"][right] * walk(t, right)) / t["cover"][at]

        return sum(s * walk(t, 0) for t, s in zip(trees.nodes, trees.scale, strict=True))

    for k, row in enumerate(x):
        for f in range(3):
            others = [o for o in range(3) if o != f]
            want = sum(factorial(len(s)) * factorial(2 - len(s)) / 6 * (expected(row, {*s, f}) - expected(row, set(s))) for n in range(3) for s in combinations(others, n))
            assert phi[k, f] == pytest.approx(want, abs=1e-9)
    scored = ML.scored(model, df.limit(12), ["a", "b", "c"]).collect()
    margins = {r["txn_id"]: r["margin"] for r in ML.explain(df.limit(12), trees).collect()}
    assert all(r["score"] == pytest.approx(1 / (1 + exp(-margins[r["txn_id"]]))) for r in scored)


def test_artifact_is_not_written_by_one_task(spark, tmp_path):
    """One file within the budget; beyond it several, and the table's last step runs in as many tasks as it has partitions."""
    df = spark.range(0, 20_000, 1, 4).select("id", F.rand(1).alias("score"), F.spark_partition_id().alias("task"))
    small, large = str(tmp_path / "small"), str(tmp_path / "large")
    S.write_artifact(df, small)
    assert len(spark.read.parquet(small).inputFiles()) == 1
    with pytest.warns(UserWarning, match="budget"):
        size = S.write_artifact(df, large, budget_mb=0.06)
    assert size > 0.06 and len(spark.read.parquet(large).inputFiles()) > 1
    for path in (small, large):
        got = spark.read.parquet(path)
        assert got.select("task").distinct().count() == 4 and got.select("id").distinct().count() == got.count() == 20_000


def test_contributions_from_patterns_of_leaves():
    """A leaf's contributions are worked out once per pattern of its path, also with repeated features, missing values and nothing but a root."""
    import numpy as np

    rng = np.random.default_rng(5)

    def grown(depth):
        t = {k: [] for k in ("feature", "threshold", "left", "right", "value", "cover")}

        def add(left, cover):
            at = len(t["value"])
            for k in t:
                t[k].append(0)
            t["value"][at], t["cover"][at], t["feature"][at] = float(rng.normal()), cover, -1
            if left:
                share = rng.uniform(0.1, 0.9)
                t["feature"][at], t["threshold"][at] = int(rng.integers(12)), float(rng.random())
                t["left"][at], t["right"][at] = add(left - 1, cover * share), add(left - 1, cover * (1 - share))
            return at

        add(depth, 1.0)
        return t

    trees = ML.Trees([str(i) for i in range(12)], [grown(d) for d in (0, 1, 4, 9)], [0.5, 2.0, 1.0, 0.3])
    x = rng.random((50, 12))
    x[3, 4] = np.nan
    tables, base = ML.leaf_tables(trees)
    assert [len(t) for t in tables] == [0, 2, 16, 512]
    phi, again = ML.contributions_of(trees, x, (tables, base))
    assert again == base and phi.shape == x.shape
    sure = ~np.isnan(x).any(1)
    assert np.allclose(base + phi.sum(1)[sure], ML.margins_of(trees, x)[sure])

    def down(t, row, at=0):
        f = t["feature"][at]
        return t["value"][at] if f < 0 else down(t, row, t["left" if row[f] <= t["threshold"][at] else "right"][at])

    assert np.allclose(ML.margins_of(trees, x), [sum(s * down(t, row) for t, s in zip(trees.nodes, trees.scale, strict=True)) for row in x])


def test_early_stopping_after_the_fact(spark):
    df, model = small_model(spark)
    trees = ML.trees_of(model, ["a", "b", "c"])
    got = {r["rounds"]: r["average_precision"] for r in ML.prefix_quality(df, trees, every=1).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    for n in got:
        part = ML.Trees(trees.names, trees.nodes[:n], trees.scale[:n])
        scores = ML.explain(df, part).select("txn_id", F.round(1 / (1 + F.exp(-F.col("margin"))), 5).alias("score")).join(df, "txn_id")
        assert M.ranking_quality(scores, "score", "label").first()["average_precision"] == pytest.approx(got[n], abs=1e-6)
    best = ML.best_prefix(df, trees, every=1)
    assert got[len(best.nodes)] == max(got.values())


def test_training_runs_all_rounds_and_stops_by_ranking(spark):
    """At a low rate each round gains little; none of them may end the training, and validation rows train nothing."""
    df, _ = small_model(spark)
    names = ["a", "b", "c"]
    model = ML.train_boosted(df, names, rounds=6, depth=2, rate=0.05)
    assert len(model.treeWeights) == 6
    turned = df.withColumn("label", F.when(F.col("validation"), 1 - F.col("label")).otherwise(F.col("label")))
    assert ML.trees_of(ML.train_boosted(turned, names, rounds=6, depth=2, rate=0.05), names) == ML.trees_of(model, names)
    stopped = ML.train_stopped(df, names, every=2, rounds=6, depth=2, rate=0.05)
    got = {r["rounds"]: r["average_precision"] for r in ML.prefix_quality(df.filter("validation"), ML.trees_of(model, names), every=2).collect()}
    assert got[len(stopped.nodes)] == max(got.values())
    both = ML.scored_by(df, ML.trees_of(model, names)).join(ML.scored(model, df, names).select("txn_id", F.col("score").alias("other")), "txn_id")
    assert both.agg(F.max(F.abs(F.col("score") - F.col("other")))).first()[0] < 1e-9


def test_model_round_trip_and_base_value(spark, tmp_path):
    df, model = small_model(spark)
    names = ["a", "b", "c"]
    ML.save_model(model, names, str(tmp_path / "m"), str(tmp_path / "m.json"), note="x")
    again, meta = ML.load_model(str(tmp_path / "m"), str(tmp_path / "m.json"))
    assert meta["feature_names"] == names
    a, b = (sorted((r["txn_id"], r["score"]) for r in ML.scored(m, df, names).collect()) for m in (model, again))
    assert a == b
    told = ML.explain(df, ML.trees_of(model, names))
    assert ML.base_value(told) == pytest.approx(ML.contributions_of(ML.trees_of(model, names), __import__("numpy").zeros((1, 3)))[1])
    with pytest.raises(ValueError, match="add up"):
        ML.base_value(told.withColumn("margin", F.col("margin") * F.col("txn_id")))


def test_isolation_forest_finds_the_outlier(spark):
    rng = random.Random(2)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(300)] + [(300, 30.0, -30.0)]
    df = spark.createDataFrame(rows, "txn_id long, a double, b double")
    got = ML.anomaly_scores(df, ML.isolation_forest(df, ["a", "b"], trees=30)).orderBy(F.desc("anomaly")).first()
    assert got["txn_id"] == 300


def alerts(spark):
    rows = [(i, i % 2 == 0, i > 7, "CYCLE" if i < 3 else None, "ACH" if i % 3 else "Wire", datetime(2024, 1, 1 + i), i / 10, f"1_A{i}", "2_b", i, 99, int(i < 2)) for i in range(10)]
    return spark.createDataFrame(rows, "txn_id long, in_alert_queue boolean, is_tail_population boolean, pattern_type string, payment_format string, timestamp timestamp_ntz, model_score double, from_account_key string, to_account_key string, from_bank long, to_bank long, is_laundering int")


def test_filters(spark):
    ids = lambda **f: sorted(r["txn_id"] for r in Q.apply_filters(alerts(spark), **f).collect())
    assert ids() == [0, 2, 4, 6, 8] and ids(queue_only=False, include_tail=False) == list(range(8))
    assert ids(queue_only=False, typologies=["CYCLE"]) == [0, 1, 2] and ids(typologies=[]) == [] and ids(queue_only=False, typologies=None) == list(range(10))
    assert ids(queue_only=False, dates=("2024-01-02", "2024-01-04")) == [1, 2, 3] and ids(queue_only=False, min_score=0.85) == [9]
    assert ids(queue_only=False, search="a7") == [7] and ids(queue_only=False, search="5") == [5] and ids(queue_only=False, search=" 99 ") == list(range(10)) and ids(queue_only=False, search=".") == []
    s = Q.queue_stats(alerts(spark).filter("in_alert_queue"), 5).first()
    assert (s["n_shown"], s["n_positives"], s["precision"], s["population_exact"]) == (5, 1, 0.2, True)
    none = Q.queue_stats(alerts(spark).filter("false"), 5).first()
    assert (none["n_shown"], none["precision"], none["population_exact"]) == (0, None, False)


def imbalanced(spark):
    df = spark.range(2000).select(F.col("id").alias("txn_id"), (F.col("id") % 50 == 0).cast("int").alias("is_laundering"), (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 10_000).alias("score"))
    return M.alert_queue(M.ranked(df), 0.25)


def test_samples(spark):
    df = imbalanced(spark).persist()
    core = df.filter("in_alert_queue or is_laundering = 1").count()
    got = Q.demo_rows(df, core + 537).collect()
    assert len(got) == core + 537 == len({r["txn_id"] for r in got}) and sum(r["is_laundering"] for r in got) == 40
    assert Q.demo_rows(df, 10).count() == core
    a, b = (sorted(r["txn_id"] for r in Q.explanation_sample(d, 100).collect()) for d in (df, df.repartition(7)))
    assert a == b and len(a) == core + 100


def test_top_k_and_overlap_of_nothing(spark):
    empty = imbalanced(spark).filter("false")
    row = A.set_overlap(empty, F.col("rank") <= 5, F.col("rank") <= 5).first()
    assert tuple(row) == (0, 0, 0, 0, 0)
    with pytest.raises(ValueError):
        A.global_importance(spark.createDataFrame([([1.0],)], "c array<double>"), "c", ["a", "b"])
