"""Splits, ranking metrics, matched-recall alert sets and calibration; ties are handled by score groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config as C
from ..functions.expressions import ratio
from ..functions.ordered import pairs_at, positions, running_totals
from ..sources.scratch import materialise
from .windows import micros


def time_ordered_split(df: DataFrame, train: float = C.TRAIN_FRACTION, val: float = C.VAL_FRACTION, time: str = "timestamp", tie: str = "txn_id") -> DataFrame:
    """``df`` with its split: train, val or test by position in time; equal times may straddle a border."""
    us = F.coalesce(micros(F.col(time)), F.lit(-(1 << 63)))  # rows without a time come first
    ends = pairs_at(df.select(us.alias("_us"), tie), "_us", tie, [train, train + val])
    if ends is not None:
        upto = [F.lit(False) if e is None else (us < e[0]) | (us == e[0]) & (F.col(tie) <= e[1]) for e in ends]
        return df.withColumn("split", F.when(upto[0], "train").when(upto[1], "val").otherwise("test"))
    n = df.count()
    first, second = int(n * train), int(n * (train + val))
    at = positions(df.withColumn("_us", micros(F.col(time))), "_us", tie, descending=False, out="_at").drop("_us")
    return at.withColumn("split", F.when(F.col("_at") <= first, "train").when(F.col("_at") <= second, "val").otherwise("test")).drop("_at")


def check_split(df: DataFrame, time: str = "timestamp") -> DataFrame:
    """Raise a ValueError unless train ends before val and val before test (equal times allowed); returns each split's rows and ends."""
    ends = df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first"), F.max(time).alias("last"))
    got = {r["split"]: r for r in ends.collect()}
    order = [got[s] for s in ("train", "val", "test") if s in got]
    for a, b in zip(order, order[1:], strict=False):
        if a["last"] > b["first"]:
            raise ValueError(f"split {a['split']} ends after {b['split']} begins")
    return ends


def feature_matrix(table: DataFrame, keep: tuple[str, ...] = ("txn_id",)) -> DataFrame:
    """``keep``, all features as floats, one 0/1 column per payment format (others: all 0) and the label."""
    out = {"timestamp", "from_account_key", "to_account_key", "is_laundering", "payment_format", "split", *keep}
    features = [F.col(c).cast("float").alias(c) for c in table.columns if c not in out]
    formats = [F.when(F.col("payment_format") == f, 1.0).otherwise(0.0).cast("float").alias(f"payment_format_{f}") for f in C.PAYMENT_FORMATS]
    return table.select(*keep, *features, *formats, F.col("is_laundering").cast("tinyint").alias("label"))


def align_features(x: DataFrame, names: list[str], keep: tuple[str, ...] = ("txn_id",)) -> DataFrame:
    """The trained features in the trained order; a missing one raises."""
    missing = [n for n in names if n not in x.columns]
    if missing:
        raise ValueError(f"feature matrix is missing columns {missing}")
    return x.select(*keep, *[F.col(f"`{n}`") for n in names])


def positive_weight(df: DataFrame, label: str = "is_laundering") -> float:
    """Negatives per positive of the training rows."""
    pos, n = df.agg(F.sum(F.col(label).cast("bigint")), F.count(F.lit(1))).first()
    if not pos:
        raise ValueError("no positive rows, the class weight is undefined")
    return (n - pos) / pos


def ranked(df: DataFrame, score: str = "score", tie: str = "txn_id") -> DataFrame:
    """``df`` with its rank by score, highest first."""
    return positions(df, score, tie, descending=True, out="rank")


def precision_at_k(df: DataFrame, ks, label: str = "is_laundering") -> DataFrame:
    """k, hits and precision (hits / k, also where fewer rows exist), for ranked rows."""
    ks = list(ks)
    found = df.filter(F.col("rank") <= max(ks)).agg(*[F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col(label).cast("bigint"))), F.lit(0)).alias(str(k)) for k in ks])
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.col(f"`{k}`").alias("hits")) for k in ks])
    return found.select(F.explode(rows).alias("r")).select("r.k", "r.hits", (F.col("r.hits") / F.col("r.k")).alias("precision"))


def alert_queue(df: DataFrame, target: float, label: str = "is_laundering") -> DataFrame:
    """Ranked rows with in_alert_queue: the shortest prefix of the ranking with at least the target recall."""
    positives = materialise(df.filter(F.col(label) == 1).select("rank"), "positive-ranks")  # few rows, read three times
    total = positives.count()
    if not total:
        raise ValueError("no positive rows, recall is undefined")
    # The first rank with recall at or above the target is that of the positive number ceil(target * total).
    hits = positions(positives, "rank", "rank", descending=False, out="hit")
    reached = hits.filter(F.col("hit") / F.lit(total) >= target - 1e-12).agg(F.min("rank").alias("cut"))
    cut = F.when(F.lit(target <= 0), F.lit(1)).otherwise(F.coalesce("cut", F.lit(1 << 62)))
    return df.join(F.broadcast(reached), how="cross").withColumn("in_alert_queue", F.col("rank") <= cut).drop("cut")


def score_groups(df: DataFrame, score: str = "score", label: str = "is_laundering") -> DataFrame:
    """One row per score with its positives and rows, and both counts from the top down to it."""
    groups = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    return running_totals(groups, "score", ["pos", "n"], descending=True)


def ranking_quality(df: DataFrame, score: str = "score", label: str = "is_laundering") -> DataFrame:
    """One row: average_precision (steps, not trapezoids) and roc_auc (half a point for ties)."""
    groups = score_groups(df, score, label)
    total = groups.agg(F.sum("pos").alias("t"), F.sum("n").alias("m"))
    g = groups.join(F.broadcast(total), how="cross")
    ap = F.col("pos") / F.col("t") * F.col("cum_pos") / F.col("cum_n")
    below = (F.col("m") - F.col("cum_n")) - (F.col("t") - F.col("cum_pos"))
    wins = F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2)
    return g.agg(F.sum(ap).alias("average_precision"), (F.sum(wins) / F.first(F.col("t") * (F.col("m") - F.col("t")))).alias("roc_auc"))


def pr_curve(df: DataFrame, score: str = "score", label: str = "is_laundering") -> DataFrame:
    """threshold, precision and recall of every score, and the end point (null, 1, 0)."""
    groups = score_groups(df, score, label)
    total = groups.agg(F.sum("pos").alias("t"))
    curve = groups.join(F.broadcast(total), how="cross").select(F.col("score").alias("threshold"), (F.col("cum_pos") / F.col("cum_n")).alias("precision"), (F.col("cum_pos") / F.col("t")).alias("recall"))
    end = df.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return curve.unionByName(end)


def thin_curve(curve: DataFrame, points: int = 300) -> DataFrame:
    """About ``points`` points of a curve, evenly along recall, with both ends; shorter curves stay as they are."""
    ends = curve.agg(F.count(F.lit(1)).alias("_c"), F.min("recall").alias("_lo"), F.max("recall").alias("_hi"))
    cell = F.floor((F.col("recall") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)) * (points - 2))
    put = curve.join(F.broadcast(ends), how="cross").withColumn("_cell", F.when(F.col("_c") <= points, F.xxhash64("threshold", "recall")).when(F.col("recall") == F.col("_hi"), F.lit(points)).otherwise(F.coalesce(cell, F.lit(0))))
    order = F.struct("recall", -F.coalesce("threshold", F.lit(float("inf"))))
    return put.groupBy("_cell").agg(F.min_by(F.struct("threshold", "precision", "recall"), order).alias("p")).select("p.*")


def recall_curve(df: DataFrame, label: str = "is_laundering") -> DataFrame:
    """Recall at every rank that holds a positive: rank, hits, recall."""
    positives = materialise(df.filter(F.col(label) == 1).select("rank"), "positive-ranks")
    total = positives.agg(F.count(F.lit(1)).alias("t"))
    hits = positions(positives, "rank", "rank", descending=False, out="hits")
    return hits.join(F.broadcast(total), how="cross").select("rank", "hits", (F.col("hits") / F.col("t")).alias("recall"))


def calibration(df: DataFrame, bins: int = 10, score: str = "score", label: str = "is_laundering") -> DataFrame:
    """Mean score and positive share per quantile bin (a, b] of the score; empty bins are left out."""
    edges = df.agg(F.percentile(score, F.array(*[F.lit(k / bins) for k in range(bins + 1)])).alias("q")).first()["q"]
    if not edges:
        return df.select(F.lit(0).alias("bin"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean_score"), F.lit(0.0).alias("positive_fraction")).limit(0)
    inner = edges[1:-1]
    bin_ = sum((F.when(F.col(score) > e, 1).otherwise(0) for e in inner), F.lit(0))
    return df.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("positive_fraction"))


def alert_reduction(model_alerts, baseline_alerts):
    """1 - model / baseline, for numbers or columns."""
    return 1 - model_alerts / baseline_alerts


def recall_per_typology(df: DataFrame, label: str = "is_laundering", flag: str = "in_alert_queue", kind: str = "pattern_type") -> DataFrame:
    """pattern_type, positives, caught and recall, by name; rows without a type are left out, a type without positives has no recall."""
    hit = (F.col(label) == 1)
    return (
        df.filter(F.col(kind).isNotNull()).groupBy(kind)
        .agg(F.count_if(hit).alias("positives"), F.count_if(hit & F.col(flag)).alias("caught"))
        .withColumn("recall", F.try_divide(F.col("caught").cast("double"), F.col("positives").cast("double"))).orderBy(kind)
    )


def score_inflation(df: DataFrame, score: str = "score", label: str = "is_laundering") -> DataFrame:
    """Mean and median score, prevalence, and their ratio."""
    return df.agg(F.avg(score).alias("mean_score"), F.median(score).alias("median_score"), F.avg(F.col(label).cast("double")).alias("prevalence")).withColumn("inflation", F.col("mean_score") / F.col("prevalence"))


def rank_deciles(df: DataFrame, score: str = "score", tie: str = "txn_id", groups: int = 10) -> DataFrame:
    """``df`` with its decile by rank from the lowest score: floor((position - 1) * groups / n), at most groups - 1."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    at = positions(df, score, tie, descending=False, out="_at")
    return at.join(F.broadcast(n), how="cross").withColumn("decile", F.least(F.floor((F.col("_at") - 1) * groups / F.col("_n")), F.lit(groups - 1)).cast("int")).drop("_at", "_n")


def monotone_breaks(df: DataFrame, score: str = "score") -> DataFrame:
    """One row: how many ranked rows score higher than the row before them (0 for a true ranking), by neighbouring ranks."""
    block = F.floor(F.col("rank") / 100_000)
    inside = df.select("rank", score, block.alias("b")).withColumn("last", F.lag(score).over(Window.partitionBy("b").orderBy("rank")))
    edge = df.filter((F.col("rank") + 1) % 100_000 == 0).select((F.col("rank") + 1).alias("rank"), F.col(score).alias("edge"))
    joined = inside.join(edge, "rank", "left")
    return joined.agg(F.count_if(F.col(score) > F.coalesce("last", "edge")).alias("breaks"), F.count(F.lit(1)).alias("n_rows"))


def headline(df: DataFrame, label: str = "is_laundering") -> DataFrame:
    """Alerts, hits, precision and recall of ranked rows with in_alert_queue."""
    hit = F.col(label) == 1
    return df.agg(F.count_if("in_alert_queue").alias("alerts"), F.count_if(F.col("in_alert_queue") & hit).alias("hits"), F.count_if(hit).alias("positives")).withColumns(
        {"precision": ratio(F.col("hits"), F.col("alerts")), "recall": ratio(F.col("hits"), F.col("positives"))}
    )
