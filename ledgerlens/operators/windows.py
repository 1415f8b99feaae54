"""Account windows: counts, sums and distinct counterparties over (t - w, t].

An account of up to ``BUSY`` legs is one piece of a task: its legs lie together
in order of time, and a window is the difference of two running totals. Busier
accounts are swept: all windows of all roles come from one sweep. Transfers are first summed by
account and moment; every sum enters at its time and leaves again w later, a
distinct counterparty enters at a transfer and leaves w later or at the next
transfer with the same counterparty; a running total over each account's
moments is then the window's value. The cost is linear in moments times
windows, however wide the windows are. An account's moments are cut into days,
and days' totals carry on from one to the next, so a very active account is
many tasks.

Amounts are added up as whole numbers, units and hundred-millionths apart: what
enters a window leaves it again without a trace, however large it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: Amounts are added up in units and this many parts of one.
PARTS = 100_000_000
#: Legs up to which an account's windows are worked out in memory.
BUSY = 250_000


def micros(timestamp: Column) -> Column:
    """Microseconds since 1970 of a time without zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, timestamp)


def legs(txns: DataFrame) -> DataFrame:
    """Two rows per transfer: the sender's (direction out) and the receiver's (in)."""
    side = lambda own, other, way: F.struct(F.col(own).alias("account_key"), F.col(other).alias("counterparty"), F.lit(way).alias("direction"))
    both = F.array(side("from_account_key", "to_account_key", "out"), side("to_account_key", "from_account_key", "in"))
    return txns.select("*", F.explode(both).alias("_leg")).select("*", "_leg.account_key", "_leg.counterparty", "_leg.direction").drop("_leg")


@dataclass(frozen=True)
class Measure:
    """A window value: ``kind`` is count, sum or distinct; ``width`` in microseconds; ``only`` picks legs beyond their direction."""

    name: str
    kind: str
    direction: str
    width: int
    only: Column | None = None


def account_windows(txns: DataFrame, measures: list[Measure], amount: str = "amount_paid_usd") -> DataFrame:
    """One row per account and moment at which it sends or receives, with every measure over (t - width, t].

    Returns account_key, timestamp and one column per measure: whole numbers,
    or doubles for sums; 0 where nothing falls into the window.
    """
    rows = legs(txns).withColumn("_t", micros(F.col("timestamp"))).filter("_t is not null")
    busy = rows.groupBy("account_key").count().filter(F.col("count") > BUSY).select(F.col("account_key").alias("_busy"))
    if busy.isEmpty():
        return _in_memory(rows, measures, amount)
    same = F.col("account_key").eqNullSafe(F.col("_busy"))
    return _in_memory(rows.join(busy, same, "left_anti"), measures, amount).unionByName(_swept(rows.join(busy, same, "left_semi"), measures, amount))


def _units(amount: str) -> dict[str, Column]:
    """An amount as whole numbers: its units and its hundred-millionths."""
    value = F.col(amount).cast("double")
    return {"__whole": F.floor(value), "__part": F.round((value - F.floor(value)) * PARTS).cast("bigint")}


def _moment(t: Column) -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=(t / 1_000_000).cast("decimal(18,6)"))


def _in_memory(rows: DataFrame, measures: list[Measure], amount: str) -> DataFrame:
    """``account_windows`` of legs whose accounts each fit into a task: sorted by account and time, whole accounts at a time."""
    cells = {"account_key": F.col("account_key"), "t": F.col("_t"), "out": F.col("direction") == "out"}
    if any(m.kind == "distinct" for m in measures):
        cells["who"] = F.col("counterparty")
    if any(m.kind == "sum" for m in measures):
        cells |= {n: F.coalesce(c, F.lit(0)) for n, c in _units(amount).items()}
    cells |= {f"only{i}": F.coalesce(m.only, F.lit(False)) for i, m in enumerate(measures) if m.only is not None}
    dealt = rows.select(*[c.alias(n) for n, c in cells.items()]).repartition("account_key").sortWithinPartitions("account_key", "t")
    plan = [(m.name, m.kind, m.direction == "out", m.width, f"only{i}" if m.only is not None else None) for i, m in enumerate(measures)]

    def run(batches):
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < _RUN:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            accounts = _codes(whole.column("account_key"))[0]
            last = int((accounts != accounts[-1]).nonzero()[0].max(initial=-1)) + 1
            if last:
                yield from _windows_of(whole.slice(0, last), plan)
            held, size = whole.slice(last).to_batches(), whole.num_rows - last
        if size:
            yield from _windows_of(pa.Table.from_batches(held).combine_chunks(), plan)

    kinds = ", ".join(f"`{m.name}` {'double' if m.kind == 'sum' else 'bigint'}" for m in measures)
    found = dealt.mapInArrow(run, f"account_key {dict(rows.dtypes)['account_key']}, t bigint, {kinds}")
    return found.select("account_key", _moment(F.col("t")).alias("timestamp"), *[F.col(f"`{m.name}`") for m in measures])


#: Legs from which on a task works out those of the accounts it has whole.
_RUN = 200_000


def _codes(column):
    """A number per distinct value (null is one) and those values."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(), coded.dictionary


def _windows_of(legs, plan: list[tuple]):
    """Windows of whole accounts, whose ``legs`` lie together in order of time; a record batch per run of accounts."""
    import numpy as np
    import pyarrow as pa

    account = _codes(legs.column("account_key"))[0]
    account = np.cumsum(np.append(False, account[1:] != account[:-1]))
    t = legs.column("t").to_numpy()
    # Account and time in one number: times count from 1, 0 lies before and span - 1 after all of them.
    start, span = int(t.min()), int(t.max()) - int(t.min()) + 3
    most = max(1, (1 << 62) // span)
    if account[-1] >= most:
        cut = int(np.searchsorted(account, most))
        yield from _windows_of(legs.slice(0, cut), plan)
        yield from _windows_of(legs.slice(cut), plan)
        return
    base, time = account * span, t - start + 1
    place = base + time
    ends = np.flatnonzero(np.append(place[1:] != place[:-1], True))
    now, out = place[ends], legs.column("out").to_numpy()
    since = {w: np.searchsorted(place, base[ends] + np.maximum(time[ends] - w, 0), "right") for w in {p[3] for p in plan}}
    meets, others = {}, _codes(legs.column("who"))[0] if "who" in legs.column_names else None

    def total(values, width):
        so_far = np.concatenate([[0], np.cumsum(values)])
        return so_far[ends + 1] - so_far[since[width]]

    def met(way):
        """Meetings of distinct (account, counterparty, time) and the next one with the same counterparty, or the end."""
        rows = np.flatnonzero(out == way)
        rows = rows[np.lexsort((place[rows], others[rows]))]
        who = others[rows]
        new = np.append(True, (who[1:] != who[:-1]) | (place[rows[1:]] != place[rows[:-1]]))[: len(rows)]
        rows, who = rows[new], who[new]
        follows = np.append((who[1:] == who[:-1]) & (account[rows[1:]] == account[rows[:-1]]), False)[: len(rows)]
        following = np.where(follows, np.append(time[rows[1:]], 0)[: len(rows)], span - 1)
        return base[rows], time[rows], following, np.sort(place[rows])

    columns = []
    for _, kind, way, width, only in plan:
        if kind == "distinct":
            if way not in meets:
                meets[way] = met(way)
            begin, at, following, starts = meets[way]
            gone = np.sort(begin + np.minimum(following, np.minimum(at + width, span - 1)))
            columns.append(np.searchsorted(starts, now, "right") - np.searchsorted(gone, now, "right"))
            continue
        picked = out == way
        if only:
            picked = picked & legs.column(only).to_numpy()
        if kind == "count":
            columns.append(total(picked.astype(np.int64), width))
        else:
            whole, part = (total(np.where(picked, legs.column(n).to_numpy(), 0), width) for n in ("__whole", "__part"))
            columns.append((whole + np.floor(part / PARTS).astype(np.int64)).astype(float) + np.mod(part, PARTS) / PARTS)
    names = legs.column("account_key").combine_chunks().take(pa.array(ends))
    yield pa.RecordBatch.from_arrays([names, pa.array(t[ends]), *[pa.array(c) for c in columns]], names=["account_key", "t", *[p[0] for p in plan]])


def _swept(rows: DataFrame, measures: list[Measure], amount: str) -> DataFrame:
    """``account_windows`` of legs by one sweep over accounts' days, however many legs an account has."""
    pick = lambda m: (F.col("direction") == m.direction) & (m.only if m.only is not None else F.lit(True))
    summed = [m for m in measures if m.kind != "distinct"]
    distinct = [m for m in measures if m.kind == "distinct"]
    # Column -> measure; a sum has its units and its hundred-millionths.
    parts = {n: m for m in summed for n in ((f"{m.name}__whole", f"{m.name}__part") if m.kind == "sum" else (m.name,))}
    parts |= {m.name: m for m in distinct}
    whole = _units(amount)
    values: dict[str, Column] = {}
    for n, m in parts.items():
        if m.kind == "sum":
            values[n] = F.sum(F.when(pick(m), whole[n.removeprefix(m.name)]))
        elif m.kind == "count":
            values[n] = F.count(F.when(pick(m), 1))
    moments = rows.groupBy("account_key", "_t").agg(*[F.coalesce(v, F.lit(0)).alias(n) for n, v in values.items()], F.lit(True).alias("_probe"))
    # Each width leaves at its own time: an array of (time, sign, width) per moment, exploded once.
    widths = sorted({m.width for m in summed})
    times = F.array(F.struct(F.col("_t").alias("t"), F.lit(0).alias("w")), *[F.struct((F.col("_t") + w).alias("t"), F.lit(i + 1).alias("w")) for i, w in enumerate(widths)])
    turn = lambda n, m: F.when(F.col("_x.w") == 0, F.col(n)).when(F.col("_x.w") == widths.index(m.width) + 1, -F.col(n)).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    deltas = moments.withColumn("_x", F.explode(times)).select(
        "account_key", F.col("_x.t").alias("t"), (F.col("_x.w") == 0).alias("probe"),
        *[(zero if m.kind == "distinct" else turn(n, m)).alias(n) for n, m in parts.items()],
    )
    if distinct:
        meets = rows.select("account_key", "direction", "counterparty", "_t").distinct()
        following = F.lead("_t").over(Window.partitionBy("account_key", "direction", "counterparty").orderBy("_t"))
        spans = sorted({m.width for m in distinct})
        ends = [F.least(F.coalesce(following, F.col("_t") + w), F.col("_t") + w) for w in spans]
        times = F.array(F.struct(F.col("_t").alias("t"), F.lit(0).alias("w")), *[F.struct(e.alias("t"), F.lit(i + 1).alias("w")) for i, e in enumerate(ends)])
        sign = lambda m: F.when(F.col("direction") != m.direction, 0).when(F.col("_x.w") == 0, 1).when(F.col("_x.w") == spans.index(m.width) + 1, -1).otherwise(0).cast("bigint").alias(m.name)
        deltas = deltas.unionByName(
            meets.withColumn("_times", times).select("account_key", "direction", F.explode("_times").alias("_x"))
            .select("account_key", F.col("_x.t").alias("t"), F.lit(False).alias("probe"), *[sign(m) if m.kind == "distinct" else zero.alias(n) for n, m in parts.items()])
        )
    # One shuffle by account and day serves the moments, the running totals inside a day and the days' totals.
    dealt = deltas.withColumn("_b", F.floor(F.col("t") / DAY)).repartition("account_key", "_b")
    points = dealt.groupBy("account_key", "_b", "t").agg(F.max("probe").alias("probe"), *[F.sum(n).alias(n) for n in parts])
    so_far = Window.partitionBy("account_key", "_b").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    inside = points.select("account_key", "_b", "t", "probe", *[F.sum(n).over(so_far).alias(n) for n in parts]).filter("probe")
    earlier = Window.partitionBy("account_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    days = dealt.groupBy("account_key", "_b").agg(*[F.sum(n).alias(n) for n in parts])
    carried = days.select(F.col("account_key").alias("_k"), F.col("_b").alias("_d"), *[F.coalesce(F.sum(n).over(earlier), zero).alias(f"_c_{n}") for n in parts])
    totals = inside.join(carried, F.col("account_key").eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_d"))).select("account_key", "t", *[(F.col(n) + F.col(f"_c_{n}")).alias(n) for n in parts])
    units, rest = (lambda m: F.col(f"{m.name}__whole") + F.floor(F.col(f"{m.name}__part") / PARTS)), (lambda m: F.pmod(f"{m.name}__part", F.lit(PARTS)) / PARTS)
    clean = [(units(m).cast("double") + rest(m) if m.kind == "sum" else F.col(m.name)).alias(m.name) for m in measures]
    return totals.select("account_key", _moment(F.col("t")).alias("timestamp"), *clean)


def at_account(txns: DataFrame, windows: DataFrame, key: str, names: dict[str, str], missing=0) -> DataFrame:
    """``txns`` with window values (old name -> new name) of the account in ``key`` at the transfer's time."""
    side = windows.select(F.col("account_key").alias("_k"), F.col("timestamp").alias("_ts"), *[F.col(a).alias(b) for a, b in names.items()])
    joined = txns.join(side, (F.col(key) == F.col("_k")) & (F.col("timestamp") == F.col("_ts")), "left")
    return joined.drop("_k", "_ts")


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], block: int = 7 * DAY) -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row of its key at or before its time (null if none; of ties the largest values).

    Keys are cut into blocks of time: the last row inside the block is found
    by a window over key and block, the rest by each block's last row carried
    over the key's blocks, so a busy key is never one task.
    """
    t, cell = micros(F.col(time)), F.struct(*values)
    mine = left.withColumns({"_t": t, "_b": F.floor(t / block), "_side": F.lit(1), "_v": F.lit(None).cast(right.select(cell.alias("v")).schema["v"].dataType)})
    base = left.columns
    empty = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in base if c not in (key, time)]
    theirs = right.groupBy(key, time).agg(F.max(cell).alias("_v"))
    theirs = theirs.select(key, time, *empty, t.alias("_t"), F.floor(t / block).alias("_b"), F.lit(0).alias("_side"), "_v")
    both = mine.select(*base, "_t", "_b", "_side", "_v").unionByName(theirs)
    near = Window.partitionBy(key, "_b").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_v", F.last("_v", ignorenulls=True).over(near)).filter("_side = 1")
    closing = theirs.groupBy(key, "_b").agg(F.max_by("_v", "_t").alias("_last"))
    blocks = closing.select(key, "_b").union(left.select(key, F.floor(t / block).alias("_b"))).distinct().join(closing, [key, "_b"], "left")
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(key, "_b", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    found = inside.join(carried, [key, "_b"], "left").withColumn("_v", F.coalesce("_v", "_carried"))
    return found.select(*base, *[F.col("_v")[v].alias(f"asof_{v}") for v in values])
