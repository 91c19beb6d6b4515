"""Regressions fitted together: the same optimum as one fit each, lockstep steps, blocks, rates."""
import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from carelens.operators import boosting, multilogit

N = 600


def planted(spark):
    """Features of unlike scale, one constant, one missing-value sentinel; outcomes of unlike rate,
    the last two with a single label."""
    rng = np.random.default_rng(5)
    x = np.c_[rng.normal(size=N), 1e4 * rng.gamma(2.0, size=N), rng.random(N) < 0.1,
              np.full(N, 3.0), np.where(rng.random(N) < 0.2, boosting.SENTINEL, rng.normal(size=N))]
    logits = np.c_[x[:, 0] * 1.5, x[:, 2] * 3 - 2.5, -1 - x[:, 1] / 3e4 + 0.5 * x[:, 0]]
    hit = rng.random((N, 3)) < 1 / (1 + np.exp(-logits))
    rows = [(i, Vectors.sparse(5, {j: float(v) for j, v in enumerate(x[i]) if v}))
            for i in range(N)]
    feats = spark.createDataFrame(rows, ["member_id", "features"]).repartition(3)
    labels = [(i, f"c{k}", "1") for i in range(N) for k in range(3) if hit[i, k]]
    labels += [(i, "all", "0") for i in range(N)] + [(i, "unlisted", "0") for i in range(9)]
    return feats, spark.createDataFrame(
        labels + labels[:50], "member_id long, condition_name string, chronic_flag string")


LIST = [("c0", "1"), ("c1", "1"), ("c2", "1"), ("all", "0"), ("c0", "0")]


def test_equals_one_regression_each(spark):
    feats, labels = planted(spark)
    got = {(r["member_id"], r["condition_name"], r["chronic_flag"]): r["prob"]
           for r in boosting.per_condition(feats, labels, LIST).collect()}
    assert len(got) == N * len(LIST)
    assert {p for (_, c, _), p in got.items() if c == "all"} == {1.0}
    assert {p for (_, c, f), p in got.items() if (c, f) == ("c0", "0")} == {0.0}
    fold = boosting.fold_column(["member_id"], 2, 0, 17)
    for name in ("c0", "c1", "c2"):
        own = labels.filter(F.col("condition_name") == name).select("member_id").distinct()
        data = feats.join(own.withColumn("y", F.lit(1.0)), "member_id", "left").fillna(
            0.0, ["y"]).withColumn("fold", fold).cache()
        for f in (0, 1):
            m = LogisticRegression(labelCol="y", maxIter=500, tol=1e-10).fit(
                data.filter(F.col("fold") != f))
            want = m.transform(data.filter(F.col("fold") == f)).select(
                "member_id", vector_to_array("probability")[1].alias("p")).collect()
            assert max(abs(r["p"] - got[r["member_id"], name, "1"]) for r in want) < 2e-3


def test_blocks_of_outcomes_and_partitions_change_nothing(spark, monkeypatch):
    feats, labels = planted(spark)

    def run(n):
        return {(r[0], r[1], r[2]): r[3] for r in
                boosting.per_condition(feats.repartition(n), labels, LIST).collect()}

    one = run(1)
    monkeypatch.setattr(multilogit, "WEIGHT_BYTES", 1)
    monkeypatch.setattr(multilogit, "CELLS", 50)
    other = run(5)
    assert one.keys() == other.keys()
    assert max(abs(one[k] - other[k]) for k in one) < 2e-3


def test_no_members_and_no_conditions(spark):
    feats, labels = planted(spark)
    assert boosting.per_condition(feats.limit(0), labels, LIST).collect() == []
    assert boosting.per_condition(feats, labels, []).collect() == []


def test_steps_in_lockstep_find_each_minimum():
    rng = np.random.default_rng(2)
    roots = [rng.normal(size=(6, 6)) for _ in range(4)]
    bowls = np.array([a @ a.T + 0.1 * np.eye(6) for a in roots]) * [[[1]], [[50]], [[0.01]], [[3]]]
    best = rng.normal(size=(4, 6))

    def evaluate(w):
        d = w - best
        slope = np.einsum("kij,kj->ki", bowls, d)
        return 0.5 * (d * slope).sum(1), slope

    w = multilogit.minimise(evaluate, np.zeros((4, 6)), np.array([1.0, 50.0, 0.01, 3.0]), 200,
                            1e-8)
    assert np.abs(w - best).max() < 1e-4
