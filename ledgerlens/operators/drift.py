"""Drift: population and characteristic stability against a fixed reference.

Bins come from the reference alone. All features of a table, or all days of a
series, are measured in one job: values are unpivoted to (feature, value),
grouped by (feature, bin), and only the bins' counts go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.expressions import band, reject_non_finite


def bin_edges(reference: DataFrame, column: str, bins: int = C.PSI_BINS) -> list[float]:
    """Inner edges: distinct exact quantiles of the reference without the outer two, which are infinite."""
    if bins < 1:
        raise ValueError(f"bins must be at least 1, got {bins}")
    reject_non_finite(reference, column, "reference")
    found = reference.agg(F.percentile(F.col(column).cast("double"), F.array(*[F.lit(k / bins) for k in range(bins + 1)])).alias("q")).first()["q"]
    return sorted(set(found))[1:-1]


def bin_of(value: Column, inner: list[float]) -> Column:
    """Number of the bin [a, b) that holds a value."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in inner), F.lit(0)).cast("int")


def _share(n: Column, total: Column, epsilon: float) -> Column:
    return F.greatest(F.coalesce(n, F.lit(0)) / total, F.lit(epsilon))


def psi_table(reference: DataFrame, current: DataFrame, column: str, bins: int = C.PSI_BINS, epsilon: float = C.PSI_EPSILON) -> DataFrame:
    """bin, bin_lower, bin_upper (null: infinite), reference_pct, current_pct and psi_contribution."""
    inner = bin_edges(reference, column, bins)
    reject_non_finite(current, column, "current")
    value = F.col(column).cast("double")
    side = lambda df, name: df.groupBy(bin_of(value, inner).alias("bin")).agg(F.count(F.lit(1)).alias(name))
    spine = reference.sparkSession.createDataFrame([(i, ([None, *inner])[i], ([*inner, None])[i]) for i in range(len(inner) + 1)], "bin int, bin_lower double, bin_upper double")
    r, c = side(reference, "r"), side(current, "c")
    totals = r.agg(F.sum("r").alias("rt")).join(c.agg(F.sum("c").alias("ct")), how="cross")
    joined = F.broadcast(spine).join(r, "bin", "left").join(c, "bin", "left").join(F.broadcast(totals), how="cross")
    pct = joined.select("bin", "bin_lower", "bin_upper", _share(F.col("r"), F.col("rt"), epsilon).alias("reference_pct"), _share(F.col("c"), F.col("ct"), epsilon).alias("current_pct"))
    return pct.withColumn("psi_contribution", (F.col("current_pct") - F.col("reference_pct")) * F.log(F.col("current_pct") / F.col("reference_pct")))


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = C.PSI_BINS, epsilon: float = C.PSI_EPSILON) -> DataFrame:
    """One row: psi and its band."""
    return psi_table(reference, current, column, bins, epsilon).agg(F.sum("psi_contribution").alias("psi")).withColumn("band", band(F.col("psi")))


def category_psi(reference: DataFrame, current: DataFrame, column: str, epsilon: float = C.PSI_EPSILON) -> DataFrame:
    """One row: psi over the shares of all values that either side has."""
    r, c = (df.groupBy(column).agg(F.count(F.lit(1)).alias(n)) for df, n in ((reference, "r"), (current, "c")))
    totals = r.agg(F.sum("r").alias("rt")).join(c.agg(F.sum("c").alias("ct")), how="cross")
    both = r.join(c, column, "full").join(F.broadcast(totals), how="cross")
    a, b = _share(F.col("r"), F.col("rt"), epsilon), _share(F.col("c"), F.col("ct"), epsilon)
    return both.agg(F.sum((b - a) * F.log(b / a)).alias("psi")).withColumn("band", band(F.col("psi")))


def characteristic_stability(reference: DataFrame, current: DataFrame, features: list[str], bins: int = C.PSI_BINS, epsilon: float = C.PSI_EPSILON, most_categories: int = 10) -> DataFrame:
    """feature, csi, band, method, n_bins_effective, reference_mean and current_mean, most drifted first.

    A feature with at most ``most_categories`` reference values is compared by
    value, all others by quantile bins. A feature that ``current`` lacks raises.
    """
    missing = [f for f in features if f not in current.columns]
    if missing:
        raise ValueError(f"{len(missing)} columns missing from current: {missing[:5]}")
    double = lambda f: F.col(f"`{f}`").cast("double")
    # Two passes over the reference, whatever the number of features: quantiles, and whether more than most_categories values exist.
    levels = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
    stats = reference.agg(*[x for i, f in enumerate(features) for x in (F.percentile(double(f), levels).alias(f"q{i}"), F.approx_count_distinct(double(f), 0.02).alias(f"a{i}"))]).first()
    near = [i for i in range(len(features)) if stats[f"a{i}"] <= 2 * most_categories + 2]
    exact = reference.agg(*[F.count_distinct(double(features[i])).alias(str(i)) for i in near]).first().asDict() if near else {}
    kinds = {f: ("category_share", exact[str(i)]) if exact.get(str(i), most_categories + 1) <= most_categories else ("quantile", max(1, len(set(stats[f"q{i}"])) - 1)) for i, f in enumerate(features)}
    cells = [
        F.struct(F.lit(i).alias("i"), double(f).alias("v"), (double(f) if kinds[f][0] == "category_share" else bin_of(double(f), sorted(set(stats[f"q{i}"]))[1:-1]).cast("double")).alias("bin"))
        for i, f in enumerate(features)
    ]

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(F.array(*cells)).alias("x")).groupBy("x.i", "x.bin").agg(F.count(F.lit(1)).alias(name), F.sum("x.v").alias(f"{name}s"))

    # A row per feature and bin from here on.
    both = counted(reference, "r").join(counted(current, "c"), ["i", "bin"], "full")
    totals = both.groupBy("i").agg(F.sum("r").alias("rt"), F.sum("c").alias("ct"), F.sum("rs").alias("rsum"), F.sum("cs").alias("csum"))
    pct = both.join(totals, "i").withColumns({"a": _share(F.col("r"), F.col("rt"), epsilon), "b": _share(F.col("c"), F.col("ct"), epsilon)})
    csi = pct.groupBy("i").agg(F.sum((F.col("b") - F.col("a")) * F.log(F.col("b") / F.col("a"))).alias("csi"), (F.first("rsum") / F.first("rt")).alias("reference_mean"), (F.first("csum") / F.first("ct")).alias("current_mean"))
    names = reference.sparkSession.createDataFrame([(i, f, *kinds[f]) for i, f in enumerate(features)], "i int, feature string, method string, n_bins_effective bigint")
    return csi.join(F.broadcast(names), "i").select("feature", "csi", band(F.col("csi")).alias("band"), "method", "n_bins_effective", "reference_mean", "current_mean").orderBy(F.desc("csi"), "feature")


def graph_share(stability: DataFrame, top: int = 10) -> DataFrame:
    """Of the ``top`` most drifted features of a characteristic-stability table, how many there are and how many come from the graph."""
    first = stability.orderBy(F.desc("csi"), "feature").limit(top)
    return first.agg(F.count(F.lit(1)).alias("n_features"), F.count_if(F.contains("feature", F.lit("_graph_"))).alias("n_graph"))


def psi_over_time(reference: DataFrame, current: DataFrame, column: str, time: str = "timestamp", period: str = "yyyy-MM-dd", bins: int = C.PSI_BINS, epsilon: float = C.PSI_EPSILON, least: int = C.MIN_SLICE) -> DataFrame:
    """period, n_rows, psi and band of every period against the reference; thin periods stay, with a null psi and the band insufficient_data."""
    inner = bin_edges(reference, column, bins)
    reject_non_finite(current, column, "current")
    value = F.col(column).cast("double")
    spark = reference.sparkSession
    base = reference.groupBy(bin_of(value, inner).alias("bin")).agg(F.count(F.lit(1)).alias("r"))
    total = base.agg(F.sum("r").alias("rt"))
    spine = spark.createDataFrame([(i,) for i in range(len(inner) + 1)], "bin int").join(base, "bin", "left").join(total, how="cross").select("bin", _share(F.col("r"), F.col("rt"), epsilon).alias("a"))
    slices = current.groupBy(F.date_format(time, period).alias("period"), bin_of(value, inner).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    sizes = slices.groupBy("period").agg(F.sum("c").alias("n_rows"))
    grid = sizes.join(F.broadcast(spine), how="cross").join(slices, ["period", "bin"], "left")  # periods times bins
    b = _share(F.col("c"), F.col("n_rows"), epsilon)
    out = grid.groupBy("period", "n_rows").agg(F.sum((b - F.col("a")) * F.log(b / F.col("a"))).alias("psi"))
    thin = F.col("n_rows") < least
    return out.select("period", "n_rows", F.when(~thin, F.col("psi")).alias("psi"), F.when(thin, "insufficient_data").otherwise(band(F.col("psi"))).alias("band")).orderBy("period")


def first_eviction_day(first_day: Column, lookback: int = C.LOOKBACK_DAYS) -> Column:
    """The first day on which a trailing graph forgets edges."""
    return F.date_add(first_day, lookback + 1)
