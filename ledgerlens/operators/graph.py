"""As-of account graphs: degrees, fan shares and short directed cycles over the trailing days."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..sources.scratch import materialise
from ..sources.transfers import require_columns

FEATURES = ["graph_in_degree", "graph_out_degree", "graph_fan_in_score", "graph_fan_out_score", "graph_in_cycle"]
#: Days whose edges share a row, a bit each.
BLOCK = 60


def packed_edges(txns: DataFrame, lookback: int = C.LOOKBACK_DAYS) -> DataFrame:
    """The visible edges with their days as bits: one row (block, src, dst, mask) per pair and ``BLOCK`` days, not one per day."""
    require_columns(txns.columns, ["timestamp", "from_account_key", "to_account_key"], "visible_edges")
    day = F.unix_date(F.to_date("timestamp")).cast("long")
    daily = txns.select(day.alias("day"), F.col("from_account_key").alias("src"), F.col("to_account_key").alias("dst")).distinct()
    live = _bits(txns.select(day.alias("day")).filter("day is not null").distinct(), "day").groupBy("block").agg(F.bit_or("mask").alias("live"))
    blocks = F.sequence(F.floor((F.col("day") + 1) / BLOCK), F.floor((F.col("day") + lookback) / BLOCK))
    spread = daily.filter("day is not null").select(F.explode(blocks).alias("block"), "day", "src", "dst")
    low, high = (F.expr(f"cast({e} as int)") for e in (f"greatest(day + 1 - block * {BLOCK}, 0)", f"least(day + {lookback} - block * {BLOCK}, {BLOCK - 1})"))
    rows = spread.withColumns({"_low": low, "_high": high}).withColumn("mask", F.expr("shiftleft(1L, _high + 1) - shiftleft(1L, _low)"))
    seen = rows.join(F.broadcast(live), "block").select("block", "src", "dst", F.col("mask").bitwiseAND(F.col("live")).alias("mask")).filter("mask != 0")
    return seen.groupBy("block", "src", "dst").agg(F.bit_or("mask").alias("mask"))


def _bits(df: DataFrame, day: str) -> DataFrame:
    """``df`` with a day's (or whole number's) block and its bit there."""
    n = F.unix_date(day) if dict(df.dtypes)[day] == "date" else F.col(day)
    return df.withColumn("_n", n.cast("long")).withColumn("block", F.expr(f"(_n - pmod(_n, {BLOCK})) div {BLOCK}")).withColumn("mask", F.expr(f"shiftleft(1L, cast(pmod(_n, {BLOCK}) as int))")).drop("_n")


def unpacked(df: DataFrame, kind: str = "date") -> DataFrame:
    """``df`` with a row per day of its mask: ``as_of`` of the given type instead of block and mask."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(BLOCK - 1)), lambda b: F.call_function("getbit", F.col("mask"), b) == 1)
    rows = df.withColumn("_b", F.explode(bits))
    n = (F.col("block") * BLOCK + F.col("_b")).cast("int")
    as_of = F.date_from_unix_date(n) if kind == "date" else n.cast(kind)
    return rows.select(as_of.alias("as_of"), *[c for c in df.columns if c not in ("block", "mask")])


def visible_edges(txns: DataFrame, lookback: int = C.LOOKBACK_DAYS) -> DataFrame:
    """Distinct (as_of, src, dst): what each day with transfers sees of the ``lookback`` days before it, never of itself."""
    return unpacked(packed_edges(txns, lookback))


def degrees(edges: DataFrame) -> DataFrame:
    """as_of, account_key, in and out degree and their shares; a self-loop counts on both sides. ``edges`` by day or packed."""
    if "mask" in edges.columns:
        return degrees(unpacked(edges))
    ends = F.array(F.struct(F.col("src").alias("account_key"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("account_key"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = edges.select("as_of", F.explode(ends).alias("e")).groupBy("as_of", "e.account_key").agg(F.sum("e.i").alias("graph_in_degree"), F.sum("e.o").alias("graph_out_degree"))
    total = F.col("graph_in_degree") + F.col("graph_out_degree")
    return sums.withColumns({"graph_fan_in_score": F.col("graph_in_degree") / total, "graph_fan_out_score": F.col("graph_out_degree") / total})


def on_short_cycles(edges: DataFrame, length: int = C.CYCLE_LENGTH, per_class: int = 400_000) -> DataFrame:
    """Distinct (as_of, account_key) on a directed cycle of at most ``length`` edges; self-loops are cycles of one.

    ``edges`` has a row per day (as_of, src, dst) or is packed (block, src, dst,
    mask); a walk is seen on the days that all its edges have. Only accounts
    with edges both ways can be on a longer cycle, so all others leave first.
    A closed walk holds, through every account on it, a cycle that is no
    longer, so closed walks are enough; one of n edges meets in the middle.

    Walks of up to four edges are not moved: accounts fall into classes, and
    one task gets the edges between the classes of one round trip (about
    ``per_class`` from each class to each) and walks them in memory. An edge
    is copied classes ** (n - 2) times. Where that is more than the
    walks of two edges, and for longer walks, distinct pairs of walk ends are joined.
    """
    kind = "date" if "mask" in edges.columns else dict(edges.dtypes)["as_of"]
    packed = edges if "mask" in edges.columns else _bits(edges, "as_of").groupBy("block", "src", "dst").agg(F.bit_or("mask").alias("mask"))
    loops = packed.filter("src = dst").select("block", F.col("src").alias("account_key"), "mask")
    if length < 2:
        return unpacked(loops, kind)
    proper = materialise(packed.filter("src != dst"), "proper-edges")
    zero = F.lit(0).cast("long")
    ends = F.array(F.struct(F.col("src").alias("k"), F.col("mask").alias("o"), zero.alias("i"), F.lit(1).alias("n")), F.struct(F.col("dst").alias("k"), zero.alias("o"), F.col("mask").alias("i"), F.lit(0).alias("n")))
    sums = proper.select("block", F.explode(ends).alias("e")).groupBy("block", F.col("e.k").alias("k")).agg(F.bit_or("e.o").alias("o"), F.bit_or("e.i").alias("i"), F.sum("e.n").alias("n_out"), F.sum(1 - F.col("e.n")).alias("n_in"))
    both = sums.select("block", "k", F.col("o").bitwiseAND(F.col("i")).alias("core"), (F.col("n_out") * F.col("n_in")).alias("n_walks")).filter("core != 0")
    nodes = materialise(both.withColumn("id", F.monotonically_increasing_id()), "graph-nodes")
    side = lambda end: nodes.select("block", F.col("k").alias(end), F.col("id").alias(f"{end}_id"), F.col("core").alias(f"{end}_core"))
    seen = F.col("mask").bitwiseAND(F.col("src_core")).bitwiseAND(F.col("dst_core"))
    core = materialise(proper.join(side("src"), ["block", "src"]).join(side("dst"), ["block", "dst"]).select("block", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), seen.alias("mask")).filter("mask != 0"), "graph-core")

    found, walks = None, {}
    for n in range(2, length + 1):
        sizes = {r["block"]: r["count"] for r in core.groupBy("block").count().collect()}
        if not sizes:
            break
        classes = math.ceil(math.sqrt(max(sizes.values()) / per_class))
        if n == 2 or n <= 4 and classes**n <= 100_000 and sum(sizes.values()) * classes ** (n - 2) <= 3 * nodes.agg(F.sum("n_walks")).first()[0]:
            closed = _closed_in_memory(core, sorted(sizes), classes, n)
        else:
            closed = _closed_by_joins(core, walks, n)
        part = closed.groupBy("block", "id").agg(F.bit_or("mask").alias("mask"))
        found = materialise(part if found is None else found.unionByName(part).groupBy("block", "id").agg(F.bit_or("mask").alias("mask")), f"cycles-{n}")
        if n < length:
            slim = _reachable(core, nodes, found, length)
            if slim is not None:
                core, walks = materialise(slim, "graph-core"), {}
    if found is None:
        return unpacked(loops, kind)
    cycles = found.join(nodes, ["block", "id"]).select("block", F.col("k").alias("account_key"), "mask")
    return unpacked(loops.unionByName(cycles).groupBy("block", "account_key").agg(F.bit_or("mask").alias("mask")), kind)


def _reachable(core: DataFrame, nodes: DataFrame, found: DataFrame, length: int) -> DataFrame | None:
    """The edges that accounts not yet found may need for walks of three or four edges; None where at least a tenth is not found, or for longer walks to come."""
    left = nodes.join(found, ["block", "id"], "left").select("block", "id", F.col("core").alias("all"), F.expr("core & ~coalesce(mask, 0L)").alias("open"))
    total, still = left.agg(F.sum(F.bit_count("all")), F.sum(F.bit_count("open"))).first()
    if still and (length > 4 or still * 10 >= total):
        return None
    if not still:
        return core.limit(0)
    left = left.filter("open != 0").select("block", "id", "open")
    touched = [core.join(left.withColumnRenamed("id", here), ["block", here]).select("block", F.col(there).alias("id"), F.col("open").bitwiseAND(F.col("mask")).alias("open")) for here, there in (("src", "dst"), ("dst", "src"))]
    near = materialise(left.unionByName(touched[0]).unionByName(touched[1]).filter("open != 0").groupBy("block", "id").agg(F.bit_or("open").alias("near")), "graph-near")
    side = lambda end: near.select("block", F.col("id").alias(end), F.col("near").alias(f"{end}_near"))
    wide = core.join(side("src"), ["block", "src"], "left").join(side("dst"), ["block", "dst"], "left")
    return wide.select("block", "src", "dst", F.expr("mask & (coalesce(src_near, 0L) | coalesce(dst_near, 0L))").alias("mask")).filter("mask != 0")


def _closed_by_joins(core: DataFrame, walks: dict, n: int) -> DataFrame:
    """(block, id, mask) of accounts on closed walks of ``n`` edges, from distinct pairs of walk ends; ``walks`` keeps them by length."""
    walks.setdefault(1, core)
    ahead, back = n - n // 2, n // 2
    for k in range(2, ahead + 1):
        if k not in walks:
            step = core.select("block", F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("mask").alias("more"))
            grown = walks[k - 1].withColumnRenamed("dst", "mid").join(step, ["block", "mid"]).filter("src != end").select("block", "src", F.col("end").alias("dst"), F.col("mask").bitwiseAND(F.col("more")).alias("mask"))
            walks[k] = materialise(grown.filter("mask != 0").groupBy("block", "src", "dst").agg(F.bit_or("mask").alias("mask")), f"walks-{k}")
    closing = walks[back].select("block", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("mask").alias("more"))
    return walks[ahead].join(closing, ["block", "src", "dst"]).select("block", F.col("src").alias("id"), F.col("mask").bitwiseAND(F.col("more")).alias("mask")).filter("mask != 0")


def round_trips(classes: int, n: int) -> list[tuple]:
    """Every sequence of ``n`` classes, one of those that are rotations of each other."""
    return [t for t in itertools.product(range(classes), repeat=n) if all(t <= t[k:] + t[:k] for k in range(1, n))]


def _closed_in_memory(core: DataFrame, blocks: list, classes: int, n: int) -> DataFrame:
    """(block, id, mask) of accounts on closed walks of ``n`` edges: one task per block and round trip over the classes."""
    trips = round_trips(classes, n)
    place = {b: k * len(trips) for k, b in enumerate(blocks)}
    needs = {}
    for k, trip in enumerate(trips):
        for pair in {(trip[r], trip[(r + 1) % n]) for r in range(n)}:
            needs.setdefault(pair, []).append(k)

    def deal(batches):
        import numpy as np
        import pyarrow as pa

        def sent(held):
            block, *rows = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("block", "src", "dst", "mask"))
            rows = np.stack(rows)
            which = np.stack([block, rows[0] % classes, rows[1] % classes])
            for cell in np.unique(which, axis=1).T.tolist():
                part = rows[:, (which.T == cell).all(1)]
                part = np.ascontiguousarray(part[:, np.lexsort(part[1::-1])])
                part[0] = np.diff(part[0], prepend=0)
                data = pa.compress(part.view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1).tobytes(), "zstd", asbytes=True)
                pair = (cell[1], cell[2])
                for k in needs.get(pair, ()):
                    yield pa.RecordBatch.from_arrays([pa.array([place[cell[0]] + k]), pa.array([pair[0] * classes + pair[1]]), pa.array([part.shape[1]]), pa.array([data])], names=["task", "pair", "n", "data"])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 19:
                yield from sent(held)
                held, size = [], 0
        if size:
            yield from sent(held)

    def walk(batches):
        import numpy as np
        import pyarrow as pa

        tables = {}
        for batch in batches:
            for task, pair, size, data in zip(*(batch.column(c).to_pylist() for c in ("task", "pair", "n", "data")), strict=True):
                part = np.frombuffer(pa.decompress(data, size * 24, "zstd", asbytes=True), np.uint8).reshape(3, 8, size).transpose(0, 2, 1)
                part = part.copy(order="C").view(np.int64).reshape(3, size)
                part[0] = np.cumsum(part[0])
                tables.setdefault(task, {}).setdefault(pair, []).append(part)
        for task, by_pair in tables.items():
            trip = trips[task % len(trips)]
            pairs = [trip[r] * classes + trip[(r + 1) % n] for r in range(n)]
            if all(p in by_pair for p in pairs):
                whole = {p: np.concatenate(by_pair[p], axis=1) for p in set(pairs)}
                ids, masks = closed_walks([whole[p] for p in pairs])
                block = blocks[task // len(trips)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(ids), pa.array(masks)], names=["block", "id", "mask"])

    dealt = core.select("block", "src", "dst", "mask").mapInArrow(deal, "task long, pair long, n long, data binary")
    tasks = len(trips) * len(blocks)
    return dealt.repartitionById(tasks, F.col("task").cast("int")).mapInArrow(walk, "block long, id long, mask long")


def closed_walks(steps: list, most: int = 1 << 21):
    """Accounts and their days on closed walks that take one edge of each of two to four ``steps`` (arrays src, dst, mask).

    From a run of starts at a time, about ``most`` walks each: ahead over the
    first half of the steps, back over the rest, matched by start and meeting point.
    """
    import numpy as np

    n, half = len(steps), len(steps) - len(steps) // 2
    rings = [np.unique(np.concatenate([steps[k][0], steps[k - 1][1]])) for k in range(n)]  # accounts at each place
    marks = [np.zeros(len(r), np.int64) for r in rings]
    local = [(np.searchsorted(rings[k], s), np.searchsorted(rings[(k + 1) % n], d), m) for k, (s, d, m) in enumerate(steps)]

    def index(keys, size):
        order = np.argsort(keys, kind="stable")
        return order, np.searchsorted(keys[order], np.arange(size + 1))

    def grow(first, near, far, mask, lookup):
        """Each edge (first, near, mask) with all (near, far) edges of ``lookup`` that share a day: first, near, far, mask."""
        order, begin = lookup
        many = begin[near + 1] - begin[near]
        of = np.repeat(np.arange(len(near)), many)
        at = order[np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + begin[near][of]]
        both = mask[of] & far[1][at]
        keep = np.flatnonzero(both)
        return first[of[keep]], near[of[keep]], far[0][at[keep]], both[keep]

    # steps by their start (ahead) and, the other way round, by their end (back)
    ahead = [index(local[0][0], len(rings[0])), index(local[1][0], len(rings[1])) if half == 2 else None]
    back = [index(local[-1][1], len(rings[0])), index(local[2][1], len(rings[3])) if n == 4 else None]

    def cost(lookup, other, near, grown):
        order, begin = lookup
        weight = np.diff(other[1])[near[order]] if grown else np.ones(len(order), np.int64)
        total = np.concatenate([[0], np.cumsum(weight)])
        return total[begin[1:]] - total[begin[:-1]]

    per_start = cost(ahead[0], ahead[1], local[0][1], half == 2) + cost(back[0], back[1], local[-1][0], n == 4)
    run = np.cumsum(per_start) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(per_start)]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        a = ahead[0][0][ahead[0][1][low] : ahead[0][1][high]]
        b = back[0][0][back[0][1][low] : back[0][1][high]]
        if not len(a) or not len(b):
            continue
        s, mid, m = local[0][0][a], local[0][1][a], local[0][2][a]
        if half == 2:
            s, mid, end, m = grow(s, mid, local[1][1:], m, ahead[1])
        else:
            end = mid
        t, over, w = local[-1][1][b], local[-1][0][b], local[-1][2][b]
        if n == 4:
            t, over, start, w = grow(t, over, (local[2][0], local[2][2]), w, back[1])
        else:
            start = over
        apart, back_apart = rings[half][end] != rings[0][s], rings[half][start] != rings[0][t]  # a walk home in two is a cycle of two
        s, mid, end, m = s[apart], mid[apart], end[apart], m[apart]
        t, over, start, w = t[back_apart], over[back_apart], start[back_apart], w[back_apart]
        there, home = s * len(rings[half]) + end, t * len(rings[half]) + start
        met = np.intersect1d(there, home)
        if not len(met):
            continue
        i, j = (np.minimum(np.searchsorted(met, k), len(met) - 1) for k in (there, home))
        x, y = np.flatnonzero(met[i] == there), np.flatnonzero(met[j] == home)
        i, j, out, home_on = i[x], j[y], np.zeros(len(met), np.int64), np.zeros(len(met), np.int64)
        np.bitwise_or.at(out, i, m[x])
        np.bitwise_or.at(home_on, j, w[y])
        np.bitwise_or.at(marks[0], met // len(rings[half]), out & home_on)
        np.bitwise_or.at(marks[half], met % len(rings[half]), out & home_on)
        if half == 2:
            np.bitwise_or.at(marks[1], mid[x], m[x] & home_on[i])
        if n == 4:
            np.bitwise_or.at(marks[3], over[y], w[y] & out[j])
    ids, masks = np.concatenate(rings), np.concatenate(marks)
    return ids[masks != 0], masks[masks != 0]


def snapshot_features(edges: DataFrame, length: int = C.CYCLE_LENGTH) -> DataFrame:
    """as_of, account_key and the five graph features of every account that has a visible edge."""
    cycles = on_short_cycles(edges, length).withColumn("graph_in_cycle", F.lit(True))
    return degrees(edges).join(cycles, ["as_of", "account_key"], "left").fillna(False, ["graph_in_cycle"])


def daily_graph_features(txns: DataFrame, length: int = C.CYCLE_LENGTH, lookback: int = C.LOOKBACK_DAYS) -> DataFrame:
    """txn_id and the sender's and the receiver's graph features as of the transfer's day; 0 and false without history."""
    edges = materialise(packed_edges(txns, lookback), "visible-edges")
    found = materialise(snapshot_features(edges, length), "graph-snapshot")
    rows = txns.select("txn_id", F.to_date("timestamp").alias("as_of"), "from_account_key", "to_account_key")
    for role, key in (("sender", "from_account_key"), ("receiver", "to_account_key")):
        side = found.select("as_of", F.col("account_key").alias(key), *[F.col(f).alias(f"{role}_{f}") for f in FEATURES])
        rows = rows.join(side, ["as_of", key], "left").fillna(0, [f"{role}_{f}" for f in FEATURES[:4]]).fillna(False, [f"{role}_graph_in_cycle"])
    return rows.select("txn_id", *[f"{role}_{f}" for role in ("sender", "receiver") for f in FEATURES])
