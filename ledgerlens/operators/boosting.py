"""Boosted trees from histograms, as the reference's library builds them: Newton steps, columns drawn per tree.

Rows are binned once, a byte a feature, and packed into shards. At each level of
a tree every task adds up gradients and second derivatives by node, feature and
bin over its shards, and one place splits the nodes. Where the shards fit into
the tasks' memory, one barrier stage does the whole training; else a level is
one job, with the same trees. Of two siblings only the
one with fewer rows is added up, the other is the parent less it. Gradients are
whole multiples of a small unit, so sums are exact and the trees do not depend
on how the rows are dealt.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialise
from .metrics import positive_weight
from .model import Trees

#: Rows of a shard, and partitions whose histograms the driver adds up itself.
SHARD, FEW = 1 << 16, 32
#: Bytes that a task may hold for a training in one stage.
HELD = 1 << 29
#: Points of a feature's summary, from which its cuts are taken.
POINTS = 4096
#: Rounds after which margins are worked out anew from the stored shards, which cuts lineage.
ANEW = 20


def _numbers(rows: DataFrame, names: list[str]) -> list:
    """The features as numbers without nulls (null: NaN); floats stay floats, which halves what moves."""
    kinds = dict(rows.dtypes)
    return [F.coalesce(c if kinds[n] == "float" else c.cast("double"), F.lit(math.nan).cast("float")).alias(f"x{i}") for i, n in enumerate(names) for c in [F.col(f"`{n}`")]]


def _thinned(values, weights):
    """Sorted distinct values with their rows; beyond ``POINTS``, values at even steps of the rows, each with the rows up to it."""
    import numpy as np

    if (values[1:] < values[:-1]).any():
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    ends = np.flatnonzero(np.append(values[1:] != values[:-1], True)) if len(values) else np.zeros(0, int)
    values, total = values[ends], np.cumsum(weights)[ends]
    if len(values) > POINTS:
        at = np.unique(np.searchsorted(total, np.arange(1, POINTS + 1) * (total[-1] / POINTS)).clip(max=len(total) - 1))
        values, total = values[at], total[at]
    return values, np.diff(total, prepend=0)


def quantile_cuts(rows: DataFrame, names: list[str], bins: int) -> tuple[list, int]:
    """Per feature at most ``bins`` - 1 ascending cuts, values that part its rows evenly (all of them if it has few), and the number of rows.

    Tasks keep summaries of ``POINTS`` values a feature, which are merged two
    by two; every merge may shift a cut by one in ``POINTS`` of the rows.
    """
    import numpy as np

    def merged(a, b):
        return a[0] + b[0], [_thinned(np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]])) for x, y in zip(a[1], b[1], strict=True)]

    def summed(batches):
        import pickle

        import pyarrow as pa

        done, held, size = None, [], 0

        def add():
            nonlocal done
            whole = pa.Table.from_batches(held).combine_chunks()
            parts = []
            for i in range(whole.num_columns):
                x = np.sort(whole.column(i).to_numpy())  # NaN last
                x = x[: len(x) - np.isnan(x).sum()].astype(float)
                parts.append(_thinned(x, np.ones(len(x))))
            done = (size, parts) if done is None else merged(done, (size, parts))

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SHARD:
                add()
                held, size = [], 0
        if size:
            add()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(done)], pa.binary())], names=["summary"])

    import pickle

    found = rows.select(*_numbers(rows, names)).mapInArrow(summed, "summary binary").rdd.map(lambda r: pickle.loads(r[0]))
    n, summaries = found.treeReduce(merged)
    out = []
    for values, weights in summaries:
        if len(values) > bins:
            total = np.cumsum(weights)
            values = np.unique(values[np.searchsorted(total, np.arange(1, bins) * (total[-1] / bins)).clip(max=len(values) - 1)])
        out.append(values[: bins - 1])
    return out, n


def packed_shards(rows: DataFrame, names: list[str], edges: list, label: str, key: str) -> DataFrame:
    """Shards of at most ``SHARD`` rows, stored: codes (feature by feature, a byte a row: edges below the value), labels, hashed keys."""
    picked = rows.select(F.xxhash64(key).alias("k"), F.col(label).cast("byte").alias("y"), *_numbers(rows, names))

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

        def shard():
            whole = pa.Table.from_batches(held).combine_chunks()
            for at in range(0, whole.num_rows, SHARD):
                some = whole.slice(at, SHARD)
                codes = b"".join(np.searchsorted(e, some.column(2 + i).to_numpy()).astype(np.uint8).tobytes() for i, e in enumerate(edges))
                yield codes, some.column(1).to_numpy().astype(np.uint8).tobytes(), some.column(0).to_numpy().tobytes()

        def out(cells):
            nonlocal seq
            for codes, y, k in cells:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([codes], pa.binary()), pa.array([y], pa.binary()), pa.array([k], pa.binary())], names=["part", "seq", "codes", "y", "k"])
                seq += 1

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SHARD:
                yield from out(shard())
                held, size = [], 0
        if size:
            yield from out(shard())

    return materialise(picked.mapInArrow(pack, "part int, seq int, codes binary, y binary, k binary"), "shards")


def _dealt(shards: DataFrame):
    """The shards as an RDD, dealt one by one to as many partitions as tasks can run (more where a task would hold over 32)."""
    spark = shards.sparkSession
    sizes = sorted(shards.groupBy("part").count().collect())
    total = sum(n for _, n in sizes)
    slots = spark.sparkContext.defaultParallelism
    parts = max(1, min(total, slots * math.ceil(total / (slots * 32))))
    starts, at = [], 0
    for p, n in sizes:
        starts.append((p, at))
        at += n
    places = spark.createDataFrame(starts, "part int, start long")
    to = F.pmod(F.col("start") + F.col("seq"), F.lit(parts)).cast("int")
    dealt = shards.join(F.broadcast(places), "part").repartitionById(parts, to).select("codes", "y", "k")
    return materialise(dealt, "dealt-shards") if total > 4 * slots * 32 else dealt


def _routed(codes, tree: dict, rows=None):
    """The node of every row (or of ``rows``): codes at or below a node's cut go left, rows of a leaf stay."""
    import numpy as np

    n = codes.shape[1]
    own = np.arange(n) if rows is None else rows
    at, flat = np.zeros(len(own), np.int64), codes.ravel()
    feature, cut = np.array(tree["feature"]), np.array(tree["cut"])
    leaf = feature < 0
    begin, here = np.maximum(feature, 0) * n, np.arange(len(feature))
    side = np.stack([np.where(leaf, here, tree["right"]), np.where(leaf, here, tree["left"])], 1).ravel()  # a leaf leads to itself
    while not leaf[at].all():
        at = side[2 * at + (flat[begin[at] + own] <= cut[at])]
    return at


def _drawn(keys, seed: int, share: float):
    """Which rows a tree sees, by a hash of key and seed."""
    import numpy as np

    if share >= 1:
        return np.ones(len(keys), bool)
    z = keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) < np.uint64(int(share * (1 << 64)))


@dataclass(frozen=True)
class _Plan:
    """What every task knows of a training."""

    rounds: int
    depth: int
    rate: float
    share: float
    seed: int
    bins: int
    shrink: float
    least: float
    weight: float
    unit: float
    width: int


def _unpacked(row, plan: _Plan):
    import numpy as np

    y = np.frombuffer(row[1], np.uint8)
    return np.frombuffer(row[0], np.uint8).reshape(plan.width, -1), y, np.frombuffer(row[2], np.int64), np.zeros(len(y))


def _advanced(shard, grown: list, plan: _Plan):
    """A shard with its margins after the trees of ``grown``."""
    import numpy as np

    codes, y, keys, margin = shard
    for tree in grown:
        margin = margin + plan.rate * np.array(tree["value"])[_routed(codes, tree)]
    return codes, y, keys, margin


def _drawn_rows(shard, k: int, plan: _Plan):
    """codes, the rows that tree ``k`` sees, their gradients and second derivatives in units."""
    import numpy as np

    codes, y, keys, margin = shard
    rows = np.flatnonzero(_drawn(keys, plan.seed + 1000003 * k, plan.share))
    p, y = 1 / (1 + np.exp(-margin[rows])), y[rows]
    w = np.where(y == 1, plan.weight, 1.0)
    return codes, rows, np.rint(w * (p - y) / plan.unit), np.rint(w * p * (1 - p) / plan.unit)


def _sums(drawn, tree: dict, slot: list, columns: list, plan: _Plan):
    """Gradients and second derivatives by column, slot and bin over a task's shards, and rows of its first shard, for the choice of siblings."""
    import numpy as np

    slot, slots, bins = np.array(slot), max(slot) + 1, plan.bins
    sums, counted = np.zeros((3, len(columns), slots * bins)), False
    for codes, rows, g, h in drawn:
        at = slot[_routed(codes, tree, rows)]
        if (at < 0).any():
            here = np.flatnonzero(at >= 0)
            at, rows, g, h = at[here], rows[here], g[here], h[here]
        base = at * bins
        for i, c in enumerate(columns):
            cell = base + codes[c][rows]
            sums[0, i] += np.bincount(cell, g, slots * bins)
            sums[1, i] += np.bincount(cell, h, slots * bins)
            if not counted:
                sums[2, i] += np.bincount(cell, minlength=slots * bins)
        counted = True
    return sums.reshape(3, len(columns), slots, bins)


def _best_splits(sums, plan: _Plan):
    """Per node of ``sums`` (3, columns, nodes, bins): gain, column and cut of its best split (gain 0: none)."""
    import numpy as np

    g, h = (np.cumsum(s, axis=2) * plan.unit for s in sums[:2])
    gs, hs = g[:, :, -1:], h[:, :, -1:]
    value = lambda a, b: a * a / (b + plan.shrink)
    gain = np.where((h >= plan.least) & (hs - h >= plan.least), value(g, h) + value(gs - g, hs - h) - value(gs, hs), 0.0)
    flat = gain.transpose(1, 0, 2).reshape(gain.shape[1], -1)
    best = flat.argmax(1)
    return flat[np.arange(len(best)), best], best // gain.shape[2], best % gain.shape[2]


def _grown(plan: _Plan, added) -> list[dict]:
    """The trees; ``added(grown, tree, slot, columns)`` sums up over all rows, whose margins are those after ``grown``."""
    import numpy as np

    grown, rng = [], np.random.default_rng(plan.seed)
    for _ in range(plan.rounds):
        columns = sorted(rng.choice(plan.width, max(1, int(plan.share * plan.width)), replace=False).tolist())
        tree = {"feature": [-1], "cut": [0], "left": [0], "right": [0], "value": [0.0], "cover": [0.0]}
        held = {0: added(grown, tree, [0], columns)[:, :, 0]}
        g, h = held[0][:2, 0].sum(1) * plan.unit
        tree["value"][0], tree["cover"][0] = float(-g / (h + plan.shrink)), float(h)
        for d in range(plan.depth):
            level, pairs = sorted(held), []
            best = _best_splits(np.stack([held[v] for v in level], 2), plan)
            for v, gain, i, c in zip(level, *(b.tolist() for b in best), strict=True):
                if gain <= 1e-6:
                    continue
                at = len(tree["value"])
                tree["feature"][v], tree["cut"][v], tree["left"][v], tree["right"][v] = columns[i], c, at, at + 1
                sides = held[v][:, i, : c + 1].sum(1), held[v][:, i, c + 1 :].sum(1)
                for g, h, _ in sides:
                    new = {"feature": -1, "cut": 0, "left": 0, "right": 0, "value": float(-g * plan.unit / (h * plan.unit + plan.shrink)), "cover": float(h * plan.unit)}
                    for x, cell in new.items():
                        tree[x].append(cell)
                pairs.append((v, at, at + 1) if sides[0][2] <= sides[1][2] else (v, at + 1, at))
            if not pairs or d + 1 == plan.depth:
                break
            slot = [-1] * len(tree["value"])
            for s, (_, small, _) in enumerate(pairs):
                slot[small] = s
            sums = added(grown, tree, slot, columns)
            held = {node: cells for s, (v, small, other) in enumerate(pairs) for node, cells in ((small, sums[:, :, s]), (other, held[v] - sums[:, :, s]))}
        grown.append(tree)
    return grown


def _grown_by_jobs(dealt, plan: _Plan) -> list[dict]:
    """The trees with one job a level; margins lie beside the shards, in Spark's blocks."""
    import numpy as np

    state, done = None, -1

    def added(grown, tree, slot, columns):
        nonlocal state, done
        k, before = len(grown), None
        if k != done:
            last, before, done = grown[-1:] if k % ANEW else list(grown), state, k
            state = state.map(lambda s: _advanced(s, last, plan)) if k % ANEW else dealt.map(lambda r: _advanced(_unpacked(r, plan), last, plan))
            state.persist(StorageLevel.MEMORY_AND_DISK)
        found = state.mapPartitions(lambda shards: [_sums((_drawn_rows(s, k, plan) for s in shards), tree, slot, columns, plan)])
        sums = found.treeReduce(np.add) if found.getNumPartitions() > FEW else sum(found.collect())
        if before is not None:
            before.unpersist()
        return sums

    trees = _grown(plan, added)
    if state is not None:
        state.unpersist()
    return trees


class _Net:
    """Tasks of a barrier stage as a binary tree: task r hears from (r - 1) // 2 and adds up what 2 r + 1 and 2 r + 2 send.

    Addresses and a token that every connection must show go through Spark.
    """

    def __init__(self, context, patience: float = 1800.0):
        import json
        import secrets
        import socket

        rank, infos = context.partitionId(), context.getTaskInfos()
        host = infos[rank].address.rsplit(":", 1)[0].strip("[]")
        with socket.create_server((host, 0), backlog=8) as door:
            told = [json.loads(m) for m in context.allGather(json.dumps([host, door.getsockname()[1], secrets.token_hex(32)]))]
            token = told[0][2].encode()
            self.parent, self.children, self.ends = None, [], []
            if rank:
                self.parent = socket.create_connection(tuple(told[(rank - 1) // 2][:2]), 60)
                self._tune(self.parent, patience)
                self.parent.sendall(token)
            door.settimeout(60)
            while len(self.children) < sum(c < len(infos) for c in (2 * rank + 1, 2 * rank + 2)):
                child = door.accept()[0]
                self._tune(child, 60)
                if secrets.compare_digest(self._read(child, len(token)), token):
                    child.settimeout(patience)
                    self.children.append(child)
                else:
                    child.close()

    def _tune(self, link, patience: float) -> None:
        import socket

        link.settimeout(patience)
        link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    def _read(self, link, size: int):
        out, at = bytearray(size), 0
        while at < size:
            got = link.recv_into(memoryview(out)[at:])
            if not got:
                raise ConnectionError("a task of the training has ended")
            at += got
        return out

    def tell(self, message) -> None:
        """To all tasks below."""
        import json

        data = json.dumps(message).encode()
        for c in self.children:
            c.sendall(len(data).to_bytes(8, "big") + data)

    def heard(self):
        """What the task above tells, passed on."""
        import json

        message = json.loads(bytes(self._read(self.parent, int.from_bytes(self._read(self.parent, 8), "big"))))
        self.tell(message)
        return message

    def added(self, sums):
        """``sums`` and those of all tasks below; handed up."""
        import numpy as np

        for c in self.children:
            sums = sums + np.frombuffer(self._read(c, sums.nbytes)).reshape(sums.shape)
        if self.parent:
            self.parent.sendall(np.ascontiguousarray(sums).tobytes())
        return sums

    def close(self) -> None:
        for link in [self.parent, *self.children]:
            if link:
                link.close()


def _grown_in_tasks(dealt, plan: _Plan) -> list[dict]:
    """The trees by one barrier stage: tasks hold their shards and margins and add up among themselves, the first one splits."""

    def work(rows):
        from pyspark import BarrierTaskContext

        shards = [_unpacked(r, plan) for r in rows]
        net = _Net(BarrierTaskContext.get())
        drawn, at = [], -1

        def own(k, last, tree, slot, columns):
            nonlocal shards, drawn, at
            if k != at:
                shards = [_advanced(s, last, plan) for s in shards]
                drawn, at = [_drawn_rows(s, k, plan) for s in shards], k
            return net.added(_sums(drawn, tree, slot, columns, plan))

        def added(grown, tree, slot, columns):
            order = [len(grown), grown[-1:] if slot == [0] else [], tree, slot, columns]
            net.tell(order)
            return own(*order)

        try:
            if net.parent:
                while (order := net.heard()) is not None:
                    own(*order)
                return []
            trees = _grown(plan, added)
            net.tell(None)
            return [trees]
        finally:
            net.close()

    return dealt.barrier().mapPartitions(work).collect()[0]


def _fits(spark, dealt, n: int, width: int) -> bool:
    """Whether all partitions can run at once and each holds at most ``HELD`` bytes (codes, label, key, margin, and what a tree draws)."""
    context = spark.sparkContext
    if context.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return False
    java = context._jsc.sc()
    parts = dealt.getNumPartitions()
    return parts <= java.maxNumConcurrentTasks(java.resourceProfileManager().defaultResourceProfile()) and n * (width + 17 + 24) <= parts * HELD


def train_by_histograms(matrix: DataFrame, names: list[str], rounds: int = 100, depth: int = 6, rate: float = 0.05, share: float = 0.8, seed: int = 42, label: str = "label", weighted: bool = True, key: str = "txn_id", bins: int = 256, shrink: float = 1.0, least: float = 1.0) -> Trees:
    """Trees of all ``rounds`` over all rows of ``matrix`` that are not ``validation``; positives weigh negatives / positives.

    Each tree sees ``share`` of the rows and of the columns, drawn by ``seed``
    and ``key``; cuts are at most ``bins`` - 1 quantiles a feature; ``shrink``
    is added to a node's second derivatives, of which each side of a split has
    ``least`` or more. Null and NaN go right.
    """
    if not 2 <= bins <= 256:
        raise ValueError("bins must be 2 to 256, a byte a feature")
    train = matrix.filter(~F.col("validation"))
    weight = positive_weight(train, label) if weighted else 1.0
    edges, n = quantile_cuts(train, names, bins)
    # 2 ** 51 units hold twice the weights of all rows, so sums and their differences are exact
    unit = 2.0 ** (math.ceil(math.log2(2 * max(1.0, weight) * n + 1)) - 51)
    plan = _Plan(rounds, depth, rate, share, seed, bins, shrink, least, weight, unit, len(names))
    dealt = _dealt(packed_shards(train, names, edges, label, key)).rdd
    grown = None
    if _fits(matrix.sparkSession, dealt, n, len(names)):
        try:
            grown = _grown_in_tasks(dealt, plan)
        except Py4JJavaError as error:  # tasks that cannot reach each other; the same trees by jobs
            warnings.warn(f"training in one stage failed, going on with a job a level: {str(error.java_exception)[:300]}", stacklevel=2)
    if grown is None:
        grown = _grown_by_jobs(dealt, plan)
    nodes = [{"feature": t["feature"], "threshold": [float(edges[f][c]) if f >= 0 else 0.0 for f, c in zip(t["feature"], t["cut"], strict=True)], **{x: t[x] for x in ("left", "right", "value", "cover")}} for t in grown]
    return Trees(list(names), nodes, [rate] * len(nodes))
