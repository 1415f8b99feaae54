"""Rolling account features on a stream of legs, equal to the batch windows.

State per account is its legs of the longest window, pruned by event time;
legs may arrive in any order within a trigger, and late ones up to the
watermark are still counted for legs after them. A trigger sorts an account's
legs once; every window of every new leg is then two look-ups in prefix sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.windows import DAY, PARTS, legs, micros

#: A time after all others.
NEVER = np.iinfo(np.int64).max


def streaming_windows(txns: DataFrame, days=(1, 7, 30), lateness: str = "1 hour", amount: str = "amount_paid_usd") -> DataFrame:
    """One row per leg: txn_id, direction, account_key, timestamp and, per window, out and in counts, sums and distinct counterparties over (t - w, t]."""
    rows = legs(txns.withColumn("_event", F.col("timestamp").cast("timestamp")).withWatermark("_event", lateness))
    rows = rows.select("account_key", "txn_id", "direction", "counterparty", "timestamp", "_event", F.col(amount).alias("amount"), micros(F.col("timestamp")).alias("t"))
    stats = [f"{way}_{d}d_{s}" for d in days for way in ("out", "in") for s in ("count", "amount_usd", "distinct_counterparties")]
    kind = lambda s: "double" if s.endswith("usd") else "bigint"
    schema = "account_key string, txn_id bigint, direction string, timestamp timestamp_ntz, " + ", ".join(f"{s} {kind(s)}" for s in stats)
    longest = max(days) * DAY

    def run(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(frames)).sort_values(["t", "txn_id", "direction"])
        old = state.get if state.exists else ([], [], [], [])
        t, way, cp, paid = (np.concatenate([np.array(o, dtype=object), new[c].to_numpy(dtype=object)]) for o, c in zip(old, ("t", "direction", "counterparty", "amount"), strict=True))
        t, paid = t.astype(np.int64), np.array([0.0 if a is None else a for a in paid], np.float64)
        at, out = new["t"].to_numpy(np.int64), {c: new[c] for c in ("txn_id", "direction", "timestamp")}
        for side in ("out", "in"):
            mine = np.flatnonzero(way == side)
            mine = mine[np.argsort(t[mine], kind="stable")]
            moments, units = t[mine], np.floor(paid[mine])
            # Exact prefix sums, as in the batch: units and their parts apart.
            whole, part = (np.concatenate([[0], np.cumsum(x.astype(np.int64))]) for x in (units, np.rint((paid[mine] - units) * PARTS)))
            who = pd.factorize(cp[mine])[0]
            met = np.unique(np.stack([who, moments]), axis=1) if len(mine) else np.empty((2, 0), np.int64)
            following = np.append(np.where(met[0, 1:] == met[0, :-1], met[1, 1:], NEVER), NEVER)[: met.shape[1]]
            hi, begun = np.searchsorted(moments, at, "right"), np.searchsorted(np.sort(met[1]), at, "right")
            for d in days:
                lo = np.searchsorted(moments, at - d * DAY, "right")
                rest = part[hi] - part[lo]
                ended = np.searchsorted(np.sort(np.minimum(following, met[1] + d * DAY)), at, "right")
                out |= {f"{side}_{d}d_count": hi - lo, f"{side}_{d}d_amount_usd": (whole[hi] - whole[lo] + rest // PARTS) + rest % PARTS / PARTS, f"{side}_{d}d_distinct_counterparties": begun - ended}
        mark = state.getCurrentWatermarkMs() * 1000
        keep = t > min(mark, int(t.max())) - longest
        state.update((t[keep].tolist(), way[keep].tolist(), cp[keep].tolist(), paid[keep].tolist()))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, int(t.max()) // 1000 + longest // 1000))
        yield pd.DataFrame({"account_key": key[0], **out}, columns=["account_key", "txn_id", "direction", "timestamp", *stats])

    return rows.groupBy("account_key").applyInPandasWithState(run, schema, "t array<bigint>, way array<string>, cp array<string>, amount array<double>", "append", GroupStateTimeout.EventTimeTimeout)
