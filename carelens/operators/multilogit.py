"""Many logistic regressions over the same rows, fitted together.

A regression per outcome and fold would read the features once per iteration of every fit. Here one
pass gives the losses and gradients of all outcomes and folds: a task multiplies its rows with the
matrix of all weights, and its partial sums are added by a grouped sum. The quasi-Newton steps
(limited memory, per outcome) act on vectors of the features' width only. Outcomes go in blocks
whose weights stay below ``WEIGHT_BYTES``, the only thing that is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

WEIGHT_BYTES = 32 << 20
CELLS = 1 << 21                 # cells of the dense block of rows that a task holds at once
MEMORY = 8                      # steps that the curvature of an outcome is estimated from
DECREASE = 1e-4                 # share of the promised decrease that a step must reach


def sparse(features: Column | str) -> Column:
    """The non-zero places of a vector column as array<struct<index int, value double>>."""
    pairs = F.transform(vector_to_array(features),
                        lambda x, i: F.struct(i.alias("index"), x.alias("value")))
    return F.filter(pairs, lambda p: p["value"] != 0)


def _places(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of every element of a list column, and the elements."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), size), lists.flatten()


def _dense(pairs: pa.Array, width: int) -> np.ndarray:
    x = np.zeros((len(pairs), width))
    row, cells = _places(pairs)
    x[row, cells.field("index").to_numpy()] = cells.field("value").to_numpy()
    return x


def _moments(rows: DataFrame, width: int, folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, means, deviations) of every fold's training part, all rows outside the fold."""
    n, total, square = np.zeros(folds), np.zeros((folds, width)), np.zeros((folds, width))
    for r in rows.groupBy("fold").count().collect():
        n[r["fold"]] = r["count"]
    cells = rows.select("fold", F.inline("x")).groupBy("fold", "index").agg(
        F.sum("value").alias("a"), F.sum(F.col("value") * F.col("value")).alias("b"))
    for r in cells.collect():                                   # folds x width rows at most
        total[r["fold"], r["index"]], square[r["fold"], r["index"]] = r["a"], r["b"]
    n, total, square = (v.sum(0) - v for v in (n, total, square))
    size = np.maximum(n, 1)[:, None]
    mean, second = total / size, square / size
    var = second - mean * mean
    return n, mean, np.sqrt(np.where(var > 1e-13 * second, var, 0.0))


def _summed(rows: DataFrame, kernel: Callable, shape: tuple) -> np.ndarray:
    """The sum over all rows of what ``kernel(batch, sums)`` adds to an array of ``shape``."""

    def run(batches):
        sums = np.zeros(shape)
        for batch in batches:
            kernel(batch, sums)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()),
                                          pa.array(sums.ravel()[at], pa.float64())],
                                         ["at", "value"])

    parts = rows.mapInArrow(run, "at long, value double").groupBy("at").agg(
        F.sum("value").alias("value")).toArrow()
    out = np.zeros(int(np.prod(shape)))
    out[parts.column("at").to_numpy()] = parts.column("value").to_numpy()
    return out.reshape(shape)


def minimise(evaluate: Callable, w: np.ndarray, scale: np.ndarray, passes: int,
             tol: float) -> np.ndarray:
    """Limited-memory quasi-Newton for the rows of ``w``, each a problem of its own, in lockstep:
    one ``evaluate`` (losses, gradients) serves all, and a row whose step does not decrease its
    loss tries half of it the next time. ``scale`` is the curvature each row starts from."""
    loss, grad = evaluate(w)
    curve, history = 1.0 / scale, []

    def direction() -> np.ndarray:
        q, kept = grad.copy(), []
        for s, y, rho in reversed(history):
            a = rho * (s * q).sum(1)
            q -= a[:, None] * y
            kept.append(a)
        q *= curve[:, None]
        for (s, y, rho), a in zip(history, reversed(kept)):
            q += (a - rho * (y * q).sum(1))[:, None] * s
        return -q

    step, ahead = np.ones(len(w)), direction()
    for _ in range(passes):
        if (np.abs(grad).max(1) <= tol * scale).all():
            break
        trial = w + step[:, None] * ahead
        at, slope = evaluate(trial)
        good = at <= loss + DECREASE * step * (grad * ahead).sum(1)
        s = np.where(good[:, None], trial - w, 0.0)
        y = np.where(good[:, None], slope - grad, 0.0)
        bend = (s * y).sum(1)
        use = bend > 1e-12 * (s * s).sum(1)
        rho = np.divide(1.0, bend, out=np.zeros_like(bend), where=use)
        curve = np.where(use, np.divide(bend, (y * y).sum(1), out=curve.copy(), where=use), curve)
        history = [*history, (s, y, rho)][-MEMORY:]
        w, grad = w + s, np.where(good[:, None], slope, grad)
        loss = np.where(good, at, loss)
        step = np.where(good, 1.0, step / 2)
        ahead = np.where(good[:, None], direction(), ahead)
    return w


def _fit_block(rows: DataFrame, moments: tuple, lo: int, hi: int, positives: np.ndarray,
               passes: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights (fold, width + 1, outcome) on the features as given, the intercept last, and which
    outcomes have both labels in a fold's training part."""
    n, mean, std = moments
    folds, width = mean.shape
    size, k = np.maximum(n, 1), hi - lo
    rate = positives / size[:, None]
    mixed = (rate > 0) & (rate < 1)
    safe = np.where(mixed, rate, 0.5)
    sc = rows.sparkSession.sparkContext
    unit = np.divide(1.0, std, out=np.zeros_like(std), where=std > 0)

    def given(w: np.ndarray) -> np.ndarray:
        """Weights on standardised features, (fold x outcome, width + 1), as those on given ones."""
        w = w.reshape(folds, k, width + 1).transpose(0, 2, 1)
        own = w[:, :-1] * unit[:, :, None]
        return np.concatenate([own, w[:, -1:] - (own * mean[:, :, None]).sum(1, keepdims=True)], 1)

    def evaluate(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sent = sc.broadcast(given(w))

        def kernel(batch, sums):
            weights = sent.value
            step = max(1, CELLS // (width + k))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = _dense(part.column("x"), width)
                y = np.zeros((len(x), k))
                row, hit = _places(part.column("y"))
                hit = hit.to_numpy()
                own = (hit >= lo) & (hit < hi)
                y[row[own], hit[own] - lo] = 1.0
                fold = part.column("fold").to_numpy()
                for f in range(folds):
                    t = fold != f
                    xf, yf = x[t], y[t]
                    z = xf @ weights[f, :-1] + weights[f, -1]
                    soft = np.logaddexp(0.0, z)
                    miss = np.exp(z - soft) - yf
                    sums[f, :width] += xf.T @ miss
                    sums[f, width] += miss.sum(0)
                    sums[f, width + 1] += (soft - yf * z).sum(0)

        sums = _summed(rows.select("x", "y", "fold"), kernel, (folds, width + 2, k))
        sent.unpersist()
        sums /= size[:, None, None]
        slope = (sums[:, :width] - mean[:, :, None] * sums[:, width:width + 1]) * unit[:, :, None]
        slope = np.concatenate([slope, sums[:, width:width + 1]], 1)
        slope = np.where(mixed[:, None, :], slope, 0.0).transpose(0, 2, 1)
        return sums[:, width + 1].ravel(), slope.reshape(folds * k, width + 1)

    start = np.zeros((folds, k, width + 1))
    start[:, :, -1] = np.log(safe / (1 - safe))
    w = minimise(evaluate, start.reshape(folds * k, width + 1), (safe * (1 - safe)).ravel(),
                 passes, tol)
    return given(w), mixed


def out_of_fold(rows: DataFrame, key: str, width: int, outcomes: int, folds: int,
                passes: int = 40, tol: float = 1e-3) -> DataFrame:
    """(key, outcome int, prob) of every row and outcome. ``rows`` (key, x: pairs as ``sparse``
    gives them, y: array<int> of the outcomes a row has, fold) must be stored, as every pass reads
    it. A row is predicted by the model of the rows outside its fold; an outcome with a single
    label there is predicted at its rate, as are all without any rows (0)."""
    moments = _moments(rows, width, folds)
    hits = np.zeros((folds, outcomes))
    for r in rows.select("fold", F.explode(F.array_distinct("y")).alias("y")).groupBy(
            "fold", "y").count().collect():                     # folds x outcomes rows at most
        hits[r["fold"], r["y"]] = r["count"]
    hits = hits.sum(0) - hits
    block = max(1, WEIGHT_BYTES // (8 * folds * (width + 2)))
    spark, found = rows.sparkSession, []
    for lo in range(0, outcomes, block):
        hi = min(outcomes, lo + block)
        own = hits[:, lo:hi]
        weights, mixed = _fit_block(rows, moments, lo, hi, own, passes, tol)
        rate = own / np.maximum(moments[0], 1)[:, None]
        found.append(_predict(rows, key, lo,
                              spark.sparkContext.broadcast((weights, mixed, rate))))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _predict(rows: DataFrame, key: str, lo: int, sent) -> DataFrame:
    schema = rows.select(key).schema.add("prob", ArrayType(DoubleType()))

    def run(batches):
        weights, mixed, rate = sent.value
        folds, width, k = weights.shape[0], weights.shape[1] - 1, weights.shape[2]
        step = max(1, CELLS // (width + k))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x, fold = _dense(part.column("x"), width), part.column("fold").to_numpy()
                prob = np.zeros((len(x), k))
                for f in range(folds):
                    t = fold == f
                    z = x[t] @ weights[f, :-1] + weights[f, -1]
                    prob[t] = np.where(mixed[f], np.exp(z - np.logaddexp(0.0, z)), rate[f])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(
                        pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(prob.ravel()))],
                    [key, "prob"])

    probs = rows.select(key, "x", "fold").mapInArrow(run, schema)
    return probs.select(key, F.posexplode("prob").alias("outcome", "prob")).withColumn(
        "outcome", F.col("outcome") + lo)
