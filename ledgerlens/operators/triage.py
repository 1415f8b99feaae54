"""The alert queue: filters, counters, samples and the review table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import positions
from ..sources.scratch import materialise
from .metrics import rank_deciles

#: Columns of the review table that people read, in order.
DISPLAY = (
    "txn_id", "rank", "model_score", "in_alert_queue", "timestamp", "from_bank", "from_account_key", "to_bank", "to_account_key", "amount_paid",
    "payment_currency", "amount_paid_usd", "payment_format", "is_laundering", "pattern_type", "is_tail_population", "reason_code_faithful", "reason_code_behavioural",
)


def queue_filter(queue_only: bool = True, include_tail: bool = True, typologies=None, payment_formats=None, dates=None, min_score: float = 0.0, search: str = "") -> Column:
    """Predicate of the queue's filters. None is no constraint, an empty list nothing; dates are inclusive; the search text is taken literally, in accounts in any case or as a whole bank number."""
    keep = [F.lit(True)]
    if queue_only:
        keep.append(F.col("in_alert_queue"))
    if not include_tail:
        keep.append(~F.col("is_tail_population"))
    for column, wanted in (("pattern_type", typologies), ("payment_format", payment_formats)):
        if wanted is not None:
            keep.append(F.coalesce(F.col(column).isin(list(wanted)), F.lit(False)) if wanted else F.lit(False))
    if dates is not None:
        keep.append(F.col("timestamp").between(*[F.lit(d).cast("timestamp_ntz") for d in dates]))
    if min_score > 0:
        keep.append(F.col("model_score") >= min_score)
    if needle := search.strip():
        accounts = [F.lower(c).contains(needle.lower()) for c in ("from_account_key", "to_account_key")]
        banks = [F.col(c).cast("string") == needle for c in ("from_bank", "to_bank")]
        found = F.lit(False)
        for test in accounts + banks:
            found = found | F.coalesce(test, F.lit(False))
        keep.append(found)
    out = keep[0]
    for test in keep[1:]:
        out = out & test
    return out


def apply_filters(alerts: DataFrame, **filters) -> DataFrame:
    return alerts.filter(queue_filter(**filters))


def queue_stats(shown: DataFrame, queue_size: int) -> DataFrame:
    """n_shown, n_positives, precision (null if nothing is shown), population_exact and queue_size."""
    n = F.count(F.lit(1))
    hits = F.coalesce(F.sum(F.col("is_laundering").cast("bigint")), F.lit(0))
    return shown.agg(n.alias("n_shown"), hits.alias("n_positives"), F.try_divide(hits.cast("double"), n.cast("double")).alias("precision"), F.coalesce(F.bool_and("in_alert_queue"), F.lit(False)).alias("population_exact"), F.lit(queue_size).cast("bigint").alias("queue_size"))


def draw(seed: int) -> Column:
    """A transfer's place in a seeded draw, by a digest that any engine has."""
    return F.md5(F.concat(F.col("txn_id").cast("string"), F.lit(f":{seed}")))


def explanation_sample(df: DataFrame, negatives: int, seed: int = 42, label: str = "is_laundering") -> DataFrame:
    """All positives, all alerts and ``negatives`` others by a seeded hash: the same rows every time, whatever the partitions."""
    core = (F.col(label) == 1) | F.col("in_alert_queue")
    drawn = df.filter(~core).withColumn("_h", draw(seed)).orderBy("_h", "txn_id").limit(negatives).drop("_h")
    return df.filter(core).withColumn("stratum", F.lit("core")).unionByName(drawn.withColumn("stratum", F.lit("negative")))


def demo_rows(df: DataFrame, target: int, seed: int = 42, score: str = "score", label: str = "is_laundering") -> DataFrame:
    """Positives and queue whole, then others up to ``target`` rows: equal numbers per score decile, the remainder by hash; never fewer than the first two."""
    df = materialise(df, "ranked-queue")  # read once per stratum
    core = df.filter((F.col(label) == 1) | F.col("in_alert_queue"))
    kept = core.withColumn("stratum", F.when(F.col(label) == 1, "positive").otherwise("queue"))
    pool = df.filter(~((F.col(label) == 1) | F.col("in_alert_queue")))
    room = target - core.count()
    if room <= 0:
        return kept
    dealt = materialise(rank_deciles(pool, score).withColumn("_h", draw(seed)), "deciles")
    quota = room // 10
    groups = [dealt.filter(F.col("decile") == d).orderBy("_h", "txn_id").limit(quota) for d in range(10)]
    filler = groups[0]
    for g in groups[1:]:
        filler = filler.unionByName(g)
    filler = materialise(filler, "filler")
    rest = dealt.join(filler.select("txn_id"), "txn_id", "left_anti").orderBy("_h", "txn_id").limit(room - 10 * quota)
    short = filler.count() - 10 * quota
    if short < 0:
        rest = dealt.join(filler.select("txn_id"), "txn_id", "left_anti").orderBy("_h", "txn_id").limit(room - 10 * quota - short)
    return kept.unionByName(filler.unionByName(rest).drop("decile", "_h").withColumn("stratum", F.lit("filler")))


def review_table(scored: DataFrame, features: list[str], contributions: str, values: str, tail_start: str) -> DataFrame:
    """The review table: display columns, feat_* and shap_* as floats; ranks and scores as they come."""
    from ..functions.clauses import FORMAT_FEATURES, sentence
    from ..functions.expressions import in_tail

    names = list(features)
    told = scored.withColumns(
        {
            "is_tail_population": in_tail(F.col("timestamp"), tail_start),
            "reason_code_faithful": sentence(F.col(contributions), F.col(values), names),
            "reason_code_behavioural": sentence(F.col(contributions), F.col(values), names, exclude=FORMAT_FEATURES),
        }
    )
    for c in DISPLAY:
        if c not in told.columns:
            told = told.withColumn(c, F.lit(None).cast("string"))
    cells = [F.element_at(F.col(a), k + 1).cast("float").alias(f"{p}_{n}") for a, p in ((values, "feat"), (contributions, "shap")) for k, n in enumerate(names)]
    return told.select(*DISPLAY, *cells)


def ranked_queue(df: DataFrame, score: str = "score") -> DataFrame:
    return positions(df, score, "txn_id")
