"""Boosted-tree models for six-month outcomes.

Event probabilities use ``GBTClassifier``. Spark has no quantile loss for boosted trees, so the
outlier-size model is a short boosting loop over ``DecisionTreeRegressor``: each round fits a
tree to the pinball-loss gradient on a random feature subspace (T18, per tree) and sets each
leaf to the tau-quantile of the residuals in it (mergeable approximate percentile per leaf).
Every round is checkpointed to the shared checkpoint folder so the lineage stays short.
"""

from __future__ import annotations

import functools
import random
from concurrent.futures import ThreadPoolExecutor
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.operators import multilogit
from carelens.operators.tune import fold_column
from carelens.session import scratch_path, written

SENTINEL = -1.0e9      # stands in for a missing value; the indicator column says it was missing


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features",
             vectors: Sequence[str] = ()) -> DataFrame:
    """Fill nulls with a sentinel (Spark trees reject NaN) and assemble a vector; ``vectors``
    (sparse ones stay sparse) come after the columns. The missing-value indicator columns built
    with the features carry the information."""
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(SENTINEL))
                             for c in cols})
    return VectorAssembler(inputCols=[*cols, *vectors], outputCol=out).transform(filled)


def event_model(train: DataFrame, label: str, trees: int = 20, depth: int = 4,
                subsample: float = 0.8, subset: str = "sqrt", seed: int = 11,
                features: str = "features") -> GBTClassifier:
    """Boosted trees for an event probability. ``featureSubsetStrategy`` samples features
    per tree node (Spark's form of random subspace for this model)."""
    return GBTClassifier(featuresCol=features, labelCol=label, maxIter=trees, maxDepth=depth,
                         subsamplingRate=subsample, featureSubsetStrategy=subset, seed=seed)


def cost_model(label: str, trees: int = 20, depth: int = 4, subsample: float = 0.8,
               subset: str = "sqrt", seed: int = 11, features: str = "features") -> GBTRegressor:
    """Boosted trees for the expected cost (squared loss), used where a mean is needed, e.g.
    the provider benchmark (T24)."""
    return GBTRegressor(featuresCol=features, labelCol=label, maxIter=trees, maxDepth=depth,
                        subsamplingRate=subsample, featureSubsetStrategy=subset, seed=seed)


def probability(model_output: DataFrame, name: str = "prob") -> DataFrame:
    return model_output.withColumn(name, vector_to_array("probability")[1])


def _parallel_map(fn, items, parallelism: int):
    """Run independent fits; with ``parallelism`` > 1 several Spark jobs run at once (the
    scheduler shares the cluster between them), as ``CrossValidator(parallelism=...)`` does."""
    items = list(items)
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(min(parallelism, len(items))) as pool:
        return list(pool.map(fn, items))


def _union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def repeated_kfold(df: DataFrame, label: str, k: int = 3, repeats: int = 2, trees: int = 20,
                   depth: int = 4, seed: int = 11, key: str = "member_id",
                   features: str = "features", parallelism: int = 1) -> DataFrame:
    """Repeated k-fold. Folds come from a hash of (member, repeat, seed). For every fold,
    ``evaluateEachIteration`` gives the validation loss after each tree; the tree count with the
    lowest mean loss over all folds and repeats is chosen, the out-of-fold members are predicted
    from that many first trees of the fitted ensembles (a shorter fit is a prefix of a longer
    one), and the probabilities are averaged over the repeats. The repeats x k fits are
    independent and run ``parallelism`` at a time. Returns (member, prob, trees)."""
    data = written(df.select(key, label, features), "folds")
    splits = [(r, f) for r in range(repeats) for f in range(k)]

    def split(r, f):
        fd = data.withColumn("_fold", fold_column([key], k, r, seed))
        return fd.filter(F.col("_fold") != f), fd.filter(F.col("_fold") == f)

    def fit_one(rf):
        train, valid = split(*rf)
        m = event_model(train, label, trees, depth, seed=seed + rf[0]).fit(train)
        return m, m.evaluateEachIteration(valid)

    fitted = _parallel_map(fit_one, splits, parallelism)
    losses = [x for _, x in fitted]
    n = min(len(x) for x in losses)
    mean = [sum(x[i] for x in losses) / len(losses) for i in range(n)]
    best = 1 + min(range(n), key=lambda i: (mean[i], i))

    stacked = _union_all([
        prefix_probability(m, split(*rf)[1], best, features).select(key, "prob")
        for (m, _), rf in zip(fitted, splits)])
    return stacked.groupBy(key).agg(F.avg("prob").alias("prob")).withColumn("trees", F.lit(best))


def prefix_probability(model, df: DataFrame, n: int, features: str = "features") -> DataFrame:
    """``df`` with ``prob`` from the first ``n`` trees of a boosted classifier: its margin is the
    weighted sum of the trees' predictions, the probability 1 / (1 + exp(-2 margin))."""
    margin = F.lit(0.0)
    out = df
    for t, (tree, w) in enumerate(zip(model.trees[:n], model.treeWeights[:n])):
        out = tree.setFeaturesCol(features).setPredictionCol(f"_t{t}").transform(out)
        margin = margin + F.lit(float(w)) * F.col(f"_t{t}")
    return out.withColumn("prob", 1 / (1 + F.exp(-2 * margin))).drop(
        *[f"_t{t}" for t in range(n)])


def out_of_fold(df: DataFrame, predict, k: int = 2, seed: int = 17, key: str = "member_id",
                parallelism: int = 1) -> DataFrame:
    """Predictions of every row by a model that did not see it: ``predict(train, rest)`` fits on
    k - 1 hash folds of ``key`` and returns predictions of the rows of the other. The k fits are
    independent and run ``parallelism`` at a time."""
    data = written(df.withColumn("_fold", fold_column([key], k, 0, seed)), "oof")

    def predict_one(f):
        return predict(data.filter(F.col("_fold") != f).drop("_fold"),
                       data.filter(F.col("_fold") == f).drop("_fold"))

    return _union_all(_parallel_map(predict_one, range(k), parallelism))


@dataclass
class QuantileBoost:
    """A fitted quantile-loss boosting model: initial value and (feature subset, tree, leaf
    values) per round."""
    tau: float
    init: float
    rate: float
    rounds: list = field(default_factory=list)

    def _apply(self, df: DataFrame, features: str, current: str) -> DataFrame:
        out = df
        for indices, tree, leaf_values in self.rounds:
            sliced = VectorSlicer(inputCol=features, outputCol="_sub", indices=indices) \
                .transform(out)
            leafed = tree.setLeafCol("_leaf").setPredictionCol("_tp").transform(sliced)
            step = F.lit(0.0)
            for leaf, v in leaf_values.items():
                step = F.when(F.col("_leaf") == leaf, F.lit(v)).otherwise(step)
            out = leafed.withColumn(current, F.col(current) + self.rate * step) \
                .drop("_sub", "_leaf", "_tp")
        return out

    def predict(self, df: DataFrame, features: str = "features", name: str = "prediction"
                ) -> DataFrame:
        return self._apply(df.withColumn(name, F.lit(self.init)), features, name)


def quantile_boost(df: DataFrame, label: str, tau: float = 0.9, trees: int = 10,
                   depth: int = 3, rate: float = 0.5, subspace: float = 0.7, seed: int = 5,
                   features: str = "features", accuracy: int = 10_000) -> QuantileBoost:
    """T17 + T18: gradient boosting with the pinball (quantile) loss."""
    width = len(df.select(features).first()[0])
    init = df.agg(F.percentile_approx(label, tau, accuracy)).first()[0]
    model = QuantileBoost(tau=tau, init=float(init), rate=rate)
    rng = random.Random(seed)
    cur = written(df.select(label, features).withColumn("_f", F.lit(float(init))), "quantile")
    y, f = F.col(label), F.col("_f")
    for t in range(trees):
        size = max(1, int(round(subspace * width)))
        indices = sorted(rng.sample(range(width), size))
        grad = cur.withColumn("_g", F.when(y > f, F.lit(tau)).otherwise(F.lit(tau - 1.0)))
        sliced = VectorSlicer(inputCol=features, outputCol="_sub", indices=indices) \
            .transform(grad)
        tree = DecisionTreeRegressor(featuresCol="_sub", labelCol="_g", maxDepth=depth,
                                     leafCol="_leaf", seed=seed + t).fit(sliced)
        leafed = tree.transform(sliced)
        steps = leafed.groupBy("_leaf").agg(
            F.percentile_approx(y - f, tau, accuracy).alias("_step"))
        leaf_values = {row["_leaf"]: float(row["_step"]) for row in steps.collect()}  # <= 2^depth
        model.rounds.append((indices, tree, leaf_values))
        step = F.lit(0.0)
        for leaf, v in leaf_values.items():
            step = F.when(F.col("_leaf") == leaf, F.lit(v)).otherwise(step)
        cur = written(leafed.select(label, features, (f + rate * step).alias("_f")), "quantile")
    return model


@dataclass
class QuantileForest:
    """Trees whose leaves hold a summary of the labels in them: ``points`` evenly spaced quantiles.
    The distribution of a row is the mixture of its leaves, so any quantile is read from one sorted
    list, and a higher one is never smaller."""
    points: int
    trees: list                     # (feature subset, fitted tree)
    leaves: DataFrame               # (place, summary): place = tree * 2^20 + leaf

    def distribution(self, df: DataFrame, features: str = "features",
                     name: str = "distribution") -> DataFrame:
        """``df`` with the sorted points of every row's mixture."""
        table = self.leaves.select(F.map_from_entries(F.collect_list(
            F.struct("place", "summary"))).alias("m")).scalar()
        out, places = df, []
        for t, (indices, tree) in enumerate(self.trees):
            sliced = VectorSlicer(inputCol=features, outputCol="_sub", indices=indices) \
                .transform(out)
            out = tree.setLeafCol(f"_leaf{t}").setPredictionCol("_tp").transform(sliced).drop(
                "_sub", "_tp")
            places.append((F.col(f"_leaf{t}") + t * LEAVES).cast("long"))
        out = out.withColumn("_table", table)
        points = F.flatten(F.array(*[F.element_at("_table", p) for p in places]))
        return out.withColumn(name, F.sort_array(points)).drop(
            "_table", *[f"_leaf{t}" for t in range(len(self.trees))])

    @staticmethod
    def read(distribution: str, tau: float):
        """The tau-quantile of a ``distribution`` column."""
        at = F.ceil(tau * F.size(distribution)).cast("int")
        return F.element_at(distribution, F.greatest(at, F.lit(1)))


LEAVES = 1 << 20


def quantile_forest(df: DataFrame, label: str, trees: int = 10, depth: int = 4,
                    subspace: float = 0.7, sample: float = 0.7, points: int = 50, seed: int = 5,
                    features: str = "features", key: str = "member_id",
                    accuracy: int = 2_000) -> QuantileForest:
    """T17 + T18 from one ensemble: every tree is fitted on a hash sample of the rows and a random
    subspace of the features; a grouped approximate percentile (partial aggregation) summarises
    the labels of each leaf over all training rows. No quantile has to be chosen before the fit."""
    width = len(df.select(features).first()[0])
    rng = random.Random(seed)
    data = written(df.select(key, label, features), "forest")
    fitted, places = [], data
    for t in range(trees):
        indices = sorted(rng.sample(range(width), max(1, int(round(subspace * width)))))
        slicer = VectorSlicer(inputCol=features, outputCol="_sub", indices=indices)
        draw = F.pmod(F.xxhash64(F.col(key), F.lit(t), F.lit(seed)), F.lit(1_000))
        tree = DecisionTreeRegressor(
            featuresCol="_sub", labelCol=label, maxDepth=depth, leafCol="_leaf", seed=seed + t).fit(
            slicer.transform(data.filter(draw < int(1_000 * sample))))
        fitted.append((indices, tree))
        places = tree.setLeafCol(f"_leaf{t}").setPredictionCol("_tp").transform(
            slicer.transform(places)).drop("_sub", "_tp")
    at = F.array(*[(F.col(f"_leaf{t}") + t * LEAVES).cast("long") for t in range(trees)])
    grid = [(i + 0.5) / points for i in range(points)]
    leaves = written(places.select(label, F.explode(at).alias("place")).groupBy("place").agg(
        F.percentile_approx(label, F.array(*map(F.lit, grid)), F.lit(accuracy)).alias("summary")),
        "leaves")
    return QuantileForest(points, fitted, leaves)


def constant_rate(train: DataFrame, label: str) -> float:
    """The share of positive labels (0 without rows): the prediction where a model has nothing
    to tell apart."""
    rate = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return float(rate or 0.0)


def per_population(df: DataFrame, population: str, label: str, trees: int = 10, depth: int = 3,
                   seed: int = 11, key: str = "member_id", features: str = "features",
                   parallelism: int = 1, folds: int = 2) -> DataFrame:
    """One model per population (the fits are independent distributed jobs, run
    ``parallelism`` at a time), predicting out of fold. Every member gets a row: members without
    a population are one of their own, and where the training part holds a single label value
    the prediction is its rate. Returns (member, population, prob).

    The rows are written in folders by population, so a fit reads its own files only; every
    task writes to all folders, so no task gathers a population."""
    path = scratch_path(df.sparkSession, "populations")
    split = df.select(key, population, label, features).withColumn(
        "_fold", fold_column([key], folds, 0, seed))
    split.write.partitionBy(population).parquet(path)
    data = df.sparkSession.read.schema(split.schema).parquet(path).select(*split.columns)
    labels = data.groupBy(population, "_fold").agg(F.collect_set(label).alias("_labels")).collect()
    found: dict = {}
    for r in labels:
        found.setdefault(r[population], {})[r["_fold"]] = set(r["_labels"])

    def fit_one(vf):
        v, f = vf
        own = data.filter(F.col(population).eqNullSafe(F.lit(v)))
        train, rest = own.filter(F.col("_fold") != f), own.filter(F.col("_fold") == f)
        seen = set().union(*[x for g, x in found[v].items() if g != f])
        if len(seen) < 2:
            return rest.select(key, population, F.lit(constant_rate(train, label)).alias("prob"))
        m = event_model(train, label, trees, depth, seed=seed).fit(train)
        return probability(m.transform(rest)).select(key, population, "prob")

    jobs = [(v, f) for v in found for f in found[v]]
    if not jobs:
        return data.select(key, population, F.lit(0.0).alias("prob"))
    return _union_all(_parallel_map(fit_one, jobs, parallelism))


def per_condition(features_df: DataFrame, labels: DataFrame, conditions: Sequence[tuple],
                  key: str = "member_id", features: str = "features", max_iter: int = 40,
                  folds: int = 2, seed: int = 17) -> DataFrame:
    """A logistic regression per (condition, class) (the conventional comparator), predicting
    out of fold. ``labels`` has (member_id, condition_name, chronic_flag) rows for members newly
    coded; a condition without positives in a training part is predicted at its rate. All
    regressions of all folds share the passes over the members (``multilogit``).
    Returns (member, condition, class, prob) for every member and condition."""
    spark = features_df.sparkSession
    none = features_df.select(key, F.lit("").alias("condition_name"),
                              F.lit("").alias("chronic_flag"), F.lit(0.0).alias("prob")).limit(0)
    if not conditions:
        return none
    listed = spark.createDataFrame([(n, c, i) for i, (n, c) in enumerate(conditions)],
                                   "condition_name string, chronic_flag string, _at int")
    own = labels.join(F.broadcast(listed), ["condition_name", "chronic_flag"]).groupBy(key).agg(
        F.collect_set("_at").alias("y"))
    rows = written(features_df.select(
        key, multilogit.sparse(features).alias("x"),
        F.size(vector_to_array(features)).alias("w")).join(own, key, "left").select(
            key, "x", "w", F.coalesce("y", F.array().cast("array<int>")).alias("y"),
            fold_column([key], folds, 0, seed).alias("fold")), "condition-labels")
    first = rows.select("w").first()       # of the written rows: the features are computed once
    if first is None:
        return none
    names = F.array(*[F.struct(F.lit(n).alias("condition_name"), F.lit(c).alias("chronic_flag"))
                      for n, c in conditions])
    return multilogit.out_of_fold(rows, key, first["w"], len(conditions), folds, max_iter).select(
        key, F.element_at(names, F.col("outcome") + 1).alias("_c"), "prob").select(
        key, "_c.condition_name", "_c.chronic_flag", "prob")
