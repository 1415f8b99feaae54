"""Models: boosted trees with exact additive explanations, and an isolation forest.

Trees are small and go to every task; rows never leave the executors except
for the isolation forest's samples, at most ``rows_per_tree`` rows per tree.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.transfers import read_json, write_json
from .metrics import positive_weight


@dataclass
class Trees:
    """Regression trees as arrays by node: feature (-1: leaf), threshold, children, value and cover; ``scale`` is each tree's weight in the margin."""

    names: list[str]
    nodes: list[dict]
    scale: list[float]


def _assembled(matrix: DataFrame, names: list[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return matrix.withColumn("features", array_to_vector(F.array(*[F.col(f"`{n}`").cast("double") for n in names])))


def train_boosted(matrix: DataFrame, names: list[str], rounds: int = 100, depth: int = 6, rate: float = 0.05, share: float = 0.8, seed: int = 42, label: str = "label", weighted: bool = True):
    """A GBT classifier of all ``rounds``; ``matrix`` has the features, label and a boolean ``validation``. Positives weigh negatives / positives of the training rows.

    Validation rows are left to ``best_prefix``, which stops by average
    precision: MLlib's own stop ends at the first round that gains less than a
    hundredth of the loss, at a rate of 0.05 often the second.
    """
    from pyspark.ml.classification import GBTClassifier

    train = matrix.filter(~F.col("validation"))
    weight = positive_weight(train, label) if weighted else 1.0
    rows = _assembled(train, names).withColumn("_w", F.when(F.col(label) == 1, F.lit(weight)).otherwise(F.lit(1.0))).withColumn("_y", F.col(label).cast("double"))
    gbt = GBTClassifier(featuresCol="features", labelCol="_y", weightCol="_w", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=share, featureSubsetStrategy=str(share), seed=seed)
    return gbt.fit(rows.select("features", "_y", "_w"))


def train_stopped(matrix: DataFrame, names: list[str], every: int = 10, label: str = "label", **settings) -> Trees:
    """The trees of ``train_boosted`` up to the number of rounds that ranks the validation rows best."""
    model = train_boosted(matrix, names, label=label, **settings)
    return best_prefix(matrix.filter("validation"), trees_of(model, names), every, label)


def scored(model, matrix: DataFrame, names: list[str], out: str = "score") -> DataFrame:
    """``matrix`` with the positive class's probability."""
    from pyspark.ml.functions import vector_to_array

    done = model.transform(_assembled(matrix, names))
    return done.withColumn(out, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def trees_of(model, names: list[str]) -> Trees:
    """The trees of a GBT classifier; the margin (log-odds) is twice its raw sum."""
    nodes, scale = [], []
    for tree, weight in zip(model._java_obj.trees(), model.treeWeights, strict=True):
        t = {"feature": [], "threshold": [], "left": [], "right": [], "value": [], "cover": []}

        def add(node) -> int:
            at = len(t["value"])
            for k in t:
                t[k].append(0)
            t["value"][at], t["cover"][at] = float(node.prediction()), float(node.impurityStats().count())
            inner = node.subtreeDepth() > 0
            t["feature"][at] = int(node.split().featureIndex()) if inner else -1
            if inner:
                t["threshold"][at] = float(node.split().threshold())
                t["left"][at], t["right"][at] = add(node.leftChild()), add(node.rightChild())
            return at

        add(tree.rootNode())
        nodes.append(t)
        scale.append(2.0 * float(weight))
    return Trees(list(names), nodes, scale)


def tree_leaves(tree: dict):
    """Per leaf: its value and, per feature on its path, (lower, upper, share): the interval (lower, upper] that leads there and the share of the cover that does."""
    out = []

    def walk(at: int, path: dict) -> None:
        f = tree["feature"][at]
        if f < 0:
            out.append((tree["value"][at], path))
            return
        for side, child in (("left", tree["left"][at]), ("right", tree["right"][at])):
            low, high, share = path.get(f, (float("-inf"), float("inf"), 1.0))
            cut = tree["threshold"][at]
            low, high = (low, min(high, cut)) if side == "left" else (max(low, cut), high)
            walk(child, path | {f: (low, high, share * tree["cover"][child] / tree["cover"][at])})

    walk(0, {})
    return out


def _shares_by_pattern(shares):
    """Shapley weights of leaves with d features on their paths: (leaf, pattern, feature), bit j of a pattern: the row holds condition j."""
    import numpy as np

    d = shares.shape[1]
    holds = (np.arange(1 << d)[:, None] >> np.arange(d) & 1).astype(float)
    out = np.empty((len(shares), 1 << d, d))
    for k in range(d):
        coefficients = [np.ones((len(shares), 1 << d))]
        for j in range(d):
            if j != k:
                up = [c * shares[:, j, None] for c in coefficients] + [np.zeros((len(shares), 1 << d))]
                for i, c in enumerate(coefficients):
                    up[i + 1] = up[i + 1] + c * holds[:, j]
                coefficients = up
        weight = sum(c * (factorial(i) * factorial(d - i - 1) / factorial(d)) for i, c in enumerate(coefficients))
        out[:, :, k] = (holds[:, k] - shares[:, k, None]) * weight
    return out


def leaf_tables(trees: Trees) -> tuple[list, float]:
    """Per tree its leaves as (conditions (feature, lower, upper), contributions by feature and pattern), and the margin's expected value.

    A row's contributions at a leaf depend only on which of the path's
    conditions it holds, so 2 ** d patterns are worked out once, not every row.
    """
    import numpy as np

    leaves = [(t, value * scale, path) for t, (tree, scale) in enumerate(zip(trees.nodes, trees.scale, strict=True)) for value, path in tree_leaves(tree)]
    base = sum(value * float(np.prod([p[2] for p in path.values()])) for _, value, path in leaves)
    by_tree: list = [[] for _ in trees.nodes]
    for d in sorted({len(path) for _, _, path in leaves} - {0}):
        same = [x for x in leaves if len(x[2]) == d]
        run = max(1, (1 << 20) >> d)
        for at in range(0, len(same), run):
            part = same[at : at + run]
            weights = _shares_by_pattern(np.array([[p[2] for p in path.values()] for _, _, path in part]))
            for (t, value, path), w in zip(part, weights, strict=True):
                by_tree[t].append(([(f, low, high) for f, (low, high, _) in path.items()], np.ascontiguousarray((w * value).T)))
    return by_tree, base


def contributions_of(trees: Trees, x, tables=None):
    """Exact path-dependent Shapley values of every row and feature, and the margin's expected value; ``tables``: ``leaf_tables`` of the trees.

    For a leaf with d features on its path, feature i gains value * (holds_i - share_i)
    times the sum over subsets S of the others of |S|! (d - |S| - 1)! / d! times
    the product of holds_j over S and share_j over the rest; the sum over all
    subsets of a size is a coefficient of the product of (share_j + holds_j t).
    """
    import numpy as np

    by_tree, base = tables or leaf_tables(trees)
    columns = np.ascontiguousarray(x.T)
    phi = np.zeros(columns.shape)
    for leaves in by_tree:
        held: dict = {}
        for conditions, table in leaves:
            kind = np.uint8 if len(conditions) <= 8 else np.int64
            pattern = np.zeros(columns.shape[1], kind)
            for j, (f, low, high) in enumerate(conditions):
                if (f, low, high) not in held:
                    held[f, low, high] = (columns[f] > low) & (columns[f] <= high)
                pattern |= held[f, low, high].astype(kind) << kind(j)
            for (f, _, _), gains in zip(conditions, table, strict=True):
                phi[f] += gains[pattern]
    return phi.T, base


def margins_of(trees: Trees, x):
    """Margin of every row."""
    import numpy as np

    out, n = np.zeros(len(x)), np.arange(len(x)) * x.shape[1]
    cells = np.ascontiguousarray(x).ravel()
    for tree, scale in zip(trees.nodes, trees.scale, strict=True):
        at, feature = np.zeros(len(x), np.int64), np.array(tree["feature"])
        leaf, own = feature < 0, np.arange(len(feature))
        cut, value = np.array(tree["threshold"], float), np.array(tree["value"])
        right, left = (np.where(leaf, own, np.array(tree[side])) for side in ("right", "left"))
        side, feature = np.stack([right, left], 1).ravel(), np.maximum(feature, 0)  # a leaf leads to itself
        while not leaf[at].all():
            at = side[2 * at + (cells[n + feature[at]] <= cut[at])]
        out += scale * value[at]
    return out


def scored_by(matrix: DataFrame, trees: Trees, key: str = "txn_id", out: str = "score") -> DataFrame:
    """``key`` and the positive class's probability by the given trees."""
    return _by_row(matrix, trees, key, out, lambda margin, np: 1 / (1 + np.exp(-margin)))


def _by_row(matrix: DataFrame, trees: Trees, key: str, out: str, answer) -> DataFrame:
    shared = matrix.sparkSession.sparkContext.broadcast(trees)
    rows = matrix.select(key, F.array(*[F.col(f"`{n}`").cast("double") for n in trees.names]).alias("x"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answer(margins_of(shared.value, x), np))], names=[key, out])

    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, {out} double")


def prefix_quality(matrix: DataFrame, trees: Trees, every: int = 10, label: str = "label") -> DataFrame:
    """rounds and average_precision of the first ``every``, 2 * ``every``, .. trees and of all, on the rows of ``matrix``.

    Scores are rounded to five digits, so each task hands on counts of at most
    100,000 scores per prefix, and one window orders them.
    """
    from pyspark.sql.window import Window

    shared = matrix.sparkSession.sparkContext.broadcast(trees)
    rows = matrix.select(F.col(label).cast("int").alias("y"), F.array(*[F.col(f"`{n}`").cast("double") for n in trees.names]).alias("x"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        t = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            y = batch.column(0).to_numpy()
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
            margin = np.zeros(len(x))
            for k, (tree, scale) in enumerate(zip(t.nodes, t.scale, strict=True), 1):
                margin += margins_of(Trees(t.names, [tree], [scale]), x)
                if k % every == 0 or k == len(t.nodes):
                    scores, at = np.unique(np.round(1 / (1 + np.exp(-margin)), 5), return_inverse=True)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(scores)), pa.array(scores), pa.array(np.bincount(at, y).astype(np.int64)), pa.array(np.bincount(at))], names=["rounds", "score", "pos", "n"])

    counts = rows.mapInArrow(run, "rounds bigint, score double, pos bigint, n bigint").groupBy("rounds", "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    down = Window.partitionBy("rounds").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("rounds")
    gain = F.col("pos") / F.sum("pos").over(whole) * F.sum("pos").over(down) / F.sum("n").over(down)
    return counts.select("rounds", gain.alias("g")).groupBy("rounds").agg(F.sum("g").alias("average_precision"))


def best_prefix(matrix: DataFrame, trees: Trees, every: int = 10, label: str = "label") -> Trees:
    """The trees up to the number of rounds with the best average precision on ``matrix`` (the fewer of equals): early stopping after the fact."""
    best = prefix_quality(matrix, trees, every, label).orderBy(F.desc("average_precision"), "rounds").first()
    n = best["rounds"] if best else len(trees.nodes)
    return Trees(trees.names, trees.nodes[:n], trees.scale[:n])


def explain(matrix: DataFrame, trees: Trees, key: str = "txn_id") -> DataFrame:
    """``key``, margin, contributions and values (arrays in the order of the features). Restrict rows first: this is the costly step."""
    shared = matrix.sparkSession.sparkContext.broadcast((trees, leaf_tables(trees)))
    rows = matrix.select(key, F.array(*[F.col(f"`{n}`").cast("double") for n in trees.names]).alias("values"))
    schema = f"{key} {dict(rows.dtypes)[key]}, values array<double>, margin double, contributions array<double>"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            trees, tables = shared.value
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
            phi, _ = contributions_of(trees, x, tables)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(phi).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(margins_of(trees, x)), cells], names=[key, "values", "margin", "contributions"])

    return rows.mapInArrow(run, schema)


def base_value(explained: DataFrame, tolerance: float = 1e-3) -> float:
    """The constant between margins and summed contributions; a ValueError if it is not one."""
    gap = F.col("margin") - F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c)
    low, high, mean = explained.agg(F.min(gap), F.max(gap), F.avg(gap)).first()
    if high - low > tolerance:
        raise ValueError(f"contributions do not add up to the margin: the base value varies by {high - low:.6g} (tolerance {tolerance})")
    return mean


def save_model(model, names: list[str], path: str, metadata_path: str, **metadata) -> None:
    """The model in Spark's format, and a JSON file with the features' order."""
    model.write().overwrite().save(path)
    write_json({**metadata, "feature_names": list(names)}, metadata_path)


def load_model(path: str, metadata_path: str):
    from pyspark.ml.classification import GBTClassificationModel

    return GBTClassificationModel.load(path), read_json(metadata_path)


def feature_gain(model, names: list[str], top: int = 15) -> list[tuple[str, float]]:
    """The model's impurity gains, largest first."""
    gains = zip(names, model.featureImportances.toArray().tolist(), strict=True)
    return sorted(gains, key=lambda x: (-x[1], x[0]))[:top]


def isolation_forest(matrix: DataFrame, names: list[str], trees: int = 100, rows_per_tree: int = 256, seed: int = 42, key: str = "txn_id") -> Trees:
    """Random trees over samples of at most ``rows_per_tree`` rows, drawn by a seeded hash; a leaf's value is its expected path length."""
    import numpy as np

    n = matrix.count()
    wanted = trees * rows_per_tree
    chance = min(1.0, 1.2 * wanted / max(n, 1))
    drawn = matrix.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) < int(chance * (1 << 20)) + 1).select(key, F.array(*[F.col(f"`{c}`").cast("double") for c in names]).alias("x")).orderBy(F.xxhash64(key, F.lit(seed + 1)), key).limit(wanted)
    got = drawn.collect()
    if not got:
        raise ValueError("no rows to build the forest from")
    x = np.array([r["x"] for r in got])
    rng = np.random.default_rng(seed)
    size = min(rows_per_tree, len(x))
    limit = max(1, int(np.ceil(np.log2(max(2, size)))))
    length = lambda m: 2 * (np.log(m - 1) + 0.5772156649) - 2 * (m - 1) / m if m > 2 else float(m == 2)
    nodes = []
    for _ in range(trees):
        t = {"feature": [], "threshold": [], "left": [], "right": [], "value": [], "cover": []}

        def grow(rows, depth) -> int:
            at = len(t["value"])
            for k in t:
                t[k].append(0)
            t["cover"][at], t["feature"][at], t["value"][at] = float(len(rows)), -1, depth + length(len(rows))
            spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) else []
            if depth < limit and len(rows) > 1 and len(spread):
                f = int(rng.choice(spread))
                cut = rng.uniform(rows[:, f].min(), rows[:, f].max())
                go = rows[:, f] <= cut
                t["feature"][at], t["threshold"][at] = f, float(cut)
                t["left"][at], t["right"][at] = grow(rows[go], depth + 1), grow(rows[~go], depth + 1)
            return at

        grow(x[rng.choice(len(x), size, replace=False)], 0)
        nodes.append(t)
    return Trees(list(names), nodes, [1.0 / (trees * max(length(size), 1e-9))] * trees)


def anomaly_scores(matrix: DataFrame, forest: Trees, key: str = "txn_id", out: str = "anomaly") -> DataFrame:
    """``key`` and the anomaly, 2 ** -(mean path length / expected length): higher is stranger."""
    return _by_row(matrix, forest, key, out, lambda depth, np: 2.0**-depth)
