"""Toxicity by a classifier chain over pooled word evidence.

1. Word evidence: for words and their first four to six letters, a cautious
   log-odds of toxic against clean labelled texts (two standard errors below
   the estimate), so that a pattern counts only if enough texts show it.
2. A text is described by its strongest evidence, not its sum over all words,
   so long texts are not worse off than short ones.
3. A chain of logistic models predicts the categories one after the other;
   each later model also gets the earlier categories' log-odds. In training
   these come out of fold, and so does the word evidence.

Only counts and pooled descriptions of a bounded sample of labelled rows reach
the driver; scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, portions, shape

#: Categories in chain order, each by what it means in the labels; the word evidence is that of TARGET.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic != 0", "toxic_low_quality": "toxic != 0 and quality = 0"}
TARGET = "toxic"
FOLDS = 5
#: Evidence of a pattern that counts at all.
LEAST = 1.0
#: A text is toxic from even odds on; a stricter bar lets texts through whose one toxic word is certain.
THRESHOLD = 0.5
PREFIXES = (4, 5, 6)


@dataclass
class ToxicityModel:
    """Evidence by pattern, and one weight vector per category (bias, description, earlier log-odds)."""

    evidence: dict[str, float]
    weights: list
    centre: object
    spread: object
    categories: tuple = tuple(CATEGORIES)

    @property
    def target(self) -> int:
        return self.categories.index(TARGET)


def patterns(word: str) -> list[str]:
    """A word and its beginnings (marked by an asterisk)."""
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)]


def _words(text: str) -> set[str]:
    import re

    return set(re.findall(r"[^\W\d_]+", text.lower()))


def _log_odds(p):
    import numpy as np

    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def describe(text: str, strength: dict):
    """Pooled description of a text; ``strength`` gives each word's evidence (0: none)."""
    import numpy as np

    found = sorted((x for x in map(strength.__getitem__, _words(text)) if x > 0), reverse=True)
    top = (found + [0.0] * 3)[:3]
    n = max(1, len(text))
    signs = sum(map(text.count, "%$#&*")) / n
    return np.array([top[0], top[1], top[2], np.log1p(sum(found[:10])), min(len(found), 20) / 20, signs, np.log(n)])


class Strengths(dict):
    """Evidence of each word, remembered: the most of its patterns."""

    def __init__(self, evidence: dict):
        super().__init__()
        self.evidence = evidence

    def __missing__(self, word):
        if len(self) > 500_000:
            self.clear()
        value = self[word] = max((self.evidence.get(p, 0.0) for p in patterns(word)), default=0.0)
        return value


def _fit(x, y, rounds: int = 30, ridge: float = 1.0):
    """Logistic regression by Newton steps; the first column is the bias and is not shrunk."""
    import numpy as np

    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _probability(x, w):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def blank(categories: tuple = tuple(CATEGORIES)) -> ToxicityModel:
    """A model that has seen no toxic text, or no clean one, and calls nothing anything."""
    import numpy as np

    weights = [np.zeros(8 + k) for k in range(len(categories))]
    for w in weights:
        w[0] = -30.0
    return ToxicityModel({}, weights, np.zeros(7), np.ones(7), categories)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000, categories: dict[str, str] | None = None, strict: bool = True) -> ToxicityModel:
    """Fit the chain on at most about ``max_rows`` labelled rows, chosen by a hash of their id.

    ``categories`` (name -> SQL condition over the labels, in chain order, with
    ``TARGET`` among them) default to ``CATEGORIES`` over the columns toxic and
    quality (1: good). Rows for which a condition is null, or without a text,
    are not used; an id labelled more than once is in a category if any of its
    rows is. Equal texts share a fold, so a copy never vouches for itself. If
    no toxic or no clean row remains, a ValueError says so, or, unless
    ``strict``, the model is ``blank``.
    """
    import numpy as np

    spark = docs.sparkSession
    rules = categories or CATEGORIES
    marks = [F.expr(rule).cast("int").alias(f"y{k}") for k, rule in enumerate(rules.values())]
    target, kinds = f"y{list(rules).index(TARGET)}", len(rules)
    usable = labels.select(F.col(id_col).alias("_id"), *marks).na.drop(subset=[f"y{k}" for k in range(kinds)])
    n = usable.count()
    chance = min(1.0, max_rows / max(n, 1))
    sample = usable.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(chance * (1 << 20))).groupBy("_id").agg(*[F.max(f"y{k}").alias(f"y{k}") for k in range(kinds)])
    # Bounded by max_rows (in expectation), hence the broadcast; the sample's texts are written once and read from there.
    rows = materialise(
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
        .join(F.broadcast(sample), "_id").select("text", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), *[f"y{k}" for k in range(kinds)]),
        "toxicity-sample",
    )
    counts = "pattern string, " + ", ".join(f"n{k} bigint" for k in range(FOLDS))
    sums = [F.sum(f"n{k}").alias(f"n{k}") for k in range(FOLDS)]
    whole = sum((F.col(f"n{k}") for k in range(FOLDS)), F.lit(0))

    def count(among=None):
        """mapInArrow function: texts per fold that hold each pattern, or each of ``among``."""

        def run(batches):
            import pyarrow as pa

            seen: dict = {}

            def flush():
                names = list(seen)
                table = np.array(list(seen.values()), np.int64).reshape(len(names), -1)
                seen.clear()
                return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array(table[:, k]) for k in range(FOLDS)]], names=["pattern", *[f"n{k}" for k in range(FOLDS)]])

            for batch in portions(batches, 0):
                for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = {p for w in _words(text) for p in patterns(w)}
                    for p in found if among is None else found & among.value:
                        seen.setdefault(p, [0] * FOLDS)[fold] += 1
                if len(seen) > 300_000:
                    yield flush()
            if seen:
                yield flush()

        return run

    # Only patterns of at least three toxic texts matter, so only these are counted in the clean ones; the sample bounds them.
    by_fold = lambda found: np.stack([found[f"n{k}"].to_numpy() for k in range(FOLDS)], axis=1)
    toxic_counts = rows.filter(f"{target} = 1").mapInArrow(count(), counts).groupBy("pattern").agg(*sums).filter(whole >= 3).toArrow()
    names = toxic_counts["pattern"].to_pylist()
    among = spark.sparkContext.broadcast(frozenset(names))
    clean_counts = rows.filter(f"{target} = 0").mapInArrow(count(among), counts).groupBy("pattern").agg(*sums).toArrow()
    per_fold = {r["fold"]: (r["toxic"], r["clean"]) for r in rows.groupBy("fold").agg(F.sum(target).alias("toxic"), F.sum(1 - F.col(target)).alias("clean")).collect()}
    t_all, c_all = sum(v[0] for v in per_fold.values()), sum(v[1] for v in per_fold.values())
    if not t_all or not c_all:
        if strict:
            raise ValueError("toxic and clean labelled texts are both needed")
        return blank(tuple(rules))
    place = {pattern: i for i, pattern in enumerate(names)}
    table = np.zeros((len(names), FOLDS, 2))
    table[:, :, 1] = by_fold(toxic_counts)
    table[[place[pattern] for pattern in clean_counts["pattern"].to_pylist()], :, 0] = by_fold(clean_counts)

    def evidence(but: int | None) -> dict[str, float]:
        """Cautious log-odds without the fold ``but``."""
        keep = [k for k in range(FOLDS) if k != but]
        clean, toxic = table[:, keep, 0].sum(1), table[:, keep, 1].sum(1)
        t, c = (sum(per_fold.get(k, (0, 0))[i] for k in keep) for i in (0, 1))
        score = np.log((toxic + 0.5) / (t + 1)) - np.log((clean + 0.5) / (c + 1)) - 2 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 2))
        score[toxic < 3] = 0
        return {names[i]: float(score[i]) for i in np.flatnonzero(score > LEAST)}

    folded = spark.sparkContext.broadcast([evidence(k) for k in range(FOLDS)])

    def pooled(batches):
        import pyarrow as pa

        strengths = [Strengths(e) for e in folded.value]
        for batch in portions(batches, 0):
            d = [describe(text, strengths[fold]) for text, fold in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(d, pa.list_(pa.float64()))], names=["fold", *[f"y{k}" for k in range(kinds)], "d"])

    got = rows.mapInArrow(pooled, "fold int, " + ", ".join(f"y{k} int" for k in range(kinds)) + ", d array<double>").toPandas()
    x = np.stack(got["d"].to_numpy())
    fold = got["fold"].to_numpy()
    centre, spread = x.mean(0), x.std(0) + 1e-9
    x = np.concatenate([np.ones((len(x), 1)), (x - centre) / spread], axis=1)
    weights = []
    for y in [got[f"y{k}"].to_numpy() != 0 for k in range(kinds)]:
        out = np.zeros(len(y))
        for k in range(FOLDS):
            mine = fold == k
            if mine.any():
                out[mine] = _probability(x[mine], _fit(x[~mine], y[~mine].astype(float)) if (~mine).any() else np.zeros(x.shape[1]))
        weights.append(_fit(x, y.astype(float)))
        x = np.concatenate([x, _log_odds(out)[:, None]], axis=1)
    return ToxicityModel(evidence(None), weights, centre, spread, tuple(rules))


def probabilities(texts: list[str], model: ToxicityModel, strength: Strengths) -> list:
    """Probability of each category for each text, along the chain."""
    import numpy as np

    x = np.stack([describe(t, strength) for t in texts]) if texts else np.empty((0, len(model.centre)))
    x = np.concatenate([np.ones((len(x), 1)), (x - model.centre) / model.spread], axis=1)
    out = []
    for w in model.weights:
        out.append(_probability(x, w))
        x = np.concatenate([x, _log_odds(out[-1])[:, None]], axis=1)
    return out


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, p_<category> of each category, toxic (p_toxic at or above ``threshold``) and strongest, the word with the most evidence.

    Nulls: a null or empty text has no evidence and gets the base rates; a
    null id is kept. Repeated rows each give a row. An empty table gives an
    empty result. Texts are read whole. Other columns are left out.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    line = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = shape(line.select("_id", *[F.lit(0.0).alias(f"p_{c}") for c in model.categories], F.lit("").alias("strongest")))

    def run(batches):
        import pyarrow as pa

        m = shared.value
        strength = Strengths(m.evidence)
        for batch in portions(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = probabilities(texts, m, strength)
            top = [max(((strength[w], w) for w in _words(t) if strength[w] > 0), default=(0, None))[1] if p >= threshold else None for t, p in zip(texts, out[m.target], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p) for p in out], pa.array(top, pa.string())], names=schema.names)

    return line.mapInArrow(run, schema).withColumn("toxic", F.col("p_toxic") >= threshold).withColumnRenamed("_id", id_col)


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not toxic, all columns as they are; one pass without a join. Nulls and repeats as in ``score``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        strength = Strengths(m.evidence)
        for batch in portions(batches, at):
            p = probabilities([t or "" for t in batch.column(at).cast(pa.string()).to_pylist()], m, strength)[m.target]
            yield batch.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, shape(docs))
