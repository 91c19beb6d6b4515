"""Results stay whole whatever the sizes: populations, classes, conditions, items, members."""
import random
import threading

import pytest
from pyspark.sql import functions as F

from carelens.constants import POPULAR_TOP
from carelens import session
from carelens.operators import boosting, candidates, cost, factor, multilogit, neighbours
from carelens.plans import catalog, inputs


def frame(spark, n=120):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        pop = [None, "a", "b", "only"][i % 4]
        x = rng.random()
        rows.append((i, pop, 1 if pop == "only" else int(x + rng.random() * 0.3 > 0.6), x))
    df = spark.createDataFrame(rows, "member_id long, pop string, y int, x double")
    return boosting.assemble(df, ["x"])


def test_every_member_of_every_population_gets_a_row(spark):
    got = boosting.per_population(frame(spark), "pop", "y", trees=3, depth=2).collect()
    assert sorted(r["member_id"] for r in got) == list(range(120))
    assert {r["prob"] for r in got if r["pop"] == "only"} == {1.0}
    assert len({r["prob"] for r in got if r["pop"] is None}) > 1


def test_prefix_probability_equals_a_shorter_fit(spark):
    df = frame(spark)
    long = boosting.event_model(df, "y", trees=6, depth=2, seed=3).fit(df)
    short = boosting.event_model(df, "y", trees=3, depth=2, seed=3).fit(df)
    a = {r["member_id"]: r["prob"] for r in
         boosting.prefix_probability(long, df, 3).select("member_id", "prob").collect()}
    b = {r["member_id"]: r["prob"] for r in
         boosting.probability(short.transform(df)).select("member_id", "prob").collect()}
    assert all(abs(a[k] - b[k]) < 1e-9 for k in b)


def test_per_condition_tells_classes_apart(spark):
    labels = spark.createDataFrame([(i, "c", "1" if i % 3 else "0") for i in range(0, 120, 2)],
                                   "member_id long, condition_name string, chronic_flag string")
    got = boosting.per_condition(frame(spark).select("member_id", "features"), labels,
                                 [("c", "0"), ("c", "1"), ("never", "1")]).collect()
    assert len(got) == 3 * 120
    assert {r["prob"] for r in got if r["condition_name"] == "never"} == {0.0}


def test_seventy_classes(spark):
    rows = [(m, f"c{c}", str(c)) for m in range(3) for c in range(70) if (m + c) % 3]
    feats = spark.createDataFrame(rows, "member_id long, condition_name string, "
                                        "chronic_flag string").withColumn(
        "sqrt_adjusted_credibility", F.lit(1.0))
    members = spark.createDataFrame([(m,) for m in range(3)], "member_id long")
    popular = candidates.popular_conditions(feats, 30)
    got = candidates.member_popular(members, feats, popular).collect()
    want = {(m, f"c{c}") for m in range(3) for c in range(70) if not (m + c) % 3}
    assert {(r["member_id"], r["condition_name"]) for r in got} == want


def test_three_thousand_conditions(spark):
    rng = random.Random(5)
    rows = [(m, f"c{rng.randrange(3000):04d}", "1") for m in range(400) for _ in range(12)]
    rows += [(m, f"c{c:04d}", "1") for m, c in enumerate(range(0, 3000, 8))]
    known = spark.createDataFrame(rows, "member_id long, condition_name string, "
                                        "chronic_flag string")
    n = known.select("condition_name").distinct().count()
    assert n > 2000
    for recs in (neighbours.item_based(known, 5), neighbours.user_based(known, 5)):
        top = recs.groupBy("member_id").agg(F.max("pred_rank").alias("r")).collect()
        assert max(r["r"] for r in top) == 5
        assert recs.join(known, ["member_id", "condition_name"], "left_semi").count() == 0


def test_item_blocks_give_the_same_recommendations(spark, monkeypatch):
    rng = random.Random(7)
    ratings = spark.createDataFrame(
        [(u, p, float(rng.random())) for u in range(1, 31) for p in rng.sample(range(1, 41), 8)],
        "user_id int, product_id int, confidence float")
    model = factor.fit(ratings, factor.Params(rank=4, alpha=10.0, reg=0.1, blocks=3), max_iter=3)
    users = spark.createDataFrame([(u, 100 + u) for u in range(1, 31)],
                                  "user_id int, member_id long")
    products = spark.createDataFrame([(p, "condition_name", f"c{p}", str(p % 2))
                                      for p in range(1, 41)],
                                     "product_id int, feature_name string, feature_value string, "
                                     "chronic_flag string")
    members = users.select("member_id", F.lit("M").alias("gender"))
    labels = spark.createDataFrame([(f"c{p}", ["Both", "Male", "Female"][p % 3])
                                    for p in range(1, 41)],
                                   "condition_name string, gender_specific string")
    known = spark.createDataFrame([(101, "c1", "1"), (102, "c2", "0")],
                                  "member_id long, condition_name string, chronic_flag string")

    def run(**kw):
        out = factor.recommend(model, users, products, known, members, labels, 5, **kw)
        return sorted((r["member_id"], r["chronic_flag"] if kw.get("per_class") else "",
                       r["pred_rank"], r["feature_value"]) for r in out.collect())

    for kw in ({}, {"per_class": True}, {"n_candidates": 12}):
        monkeypatch.setattr(factor, "ITEM_BLOCK", 100)
        one = run(**kw)
        monkeypatch.setattr(factor, "ITEM_BLOCK", 9)
        assert run(**kw) == one and one


def test_capture_of_unequal_populations(spark):
    actual = spark.createDataFrame([(i, float(i)) for i in range(10)], "member_id long, y double")
    scored = spark.createDataFrame([(i, float(i)) for i in range(5)], "member_id long, s double")
    got = {r["level"]: (r["n_top"], r["capture"]) for r in
           cost.capture_curves(actual, scored, "y", ["s"], [0.4, 1.0]).collect()}
    assert got == {0.4: (2, 1.0), 1.0: (5, 1.0)}


def test_condition_models_take_the_whole_popular_list(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(boosting, "per_condition",
                        lambda feats, labels, conds, **kw: asked.extend(conds) or feats)
    catalog.QUERIES["condition_models"](spark, "/root/testdata/sf0.001")
    assert len(asked) == len(set(asked)) == 60
    assert {f: sum(x == f for _, x in asked) for _, f in asked} == \
        dict.fromkeys({f for _, f in asked}, POPULAR_TOP)


@pytest.mark.parametrize("name", ["capture_curve_model", "condition_models", "cost_distribution",
                                  "provider_benchmark_model"])
def test_models_join_the_claims_once(spark, monkeypatch, name):
    reads = []

    def scans(df):
        reads.append("l_partkey" in df._jdf.queryExecution().optimizedPlan().toString())

    real = session.written

    def spy(df, label):
        scans(df)
        return real(df, label)

    for module in (catalog, inputs, boosting):
        monkeypatch.setattr(module, "written", spy)
    monkeypatch.setattr(boosting, "out_of_fold", lambda df, predict, **kw: df.select(
        "member_id", F.lit(0.0).alias("pred")))
    monkeypatch.setattr(multilogit, "out_of_fold", lambda rows, key, *a: rows.select(
        key, F.lit(0).alias("outcome"), F.lit(0.5).alias("prob")))
    scans(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert sum(reads) == 1


def test_no_members_no_condition_models(spark):
    feats = boosting.assemble(spark.createDataFrame([], "member_id long, a double"), ["a"])
    labels = spark.createDataFrame([], "member_id long, condition_name string, "
                                       "chronic_flag string")
    assert boosting.per_condition(feats, labels, [("x", "1")]).count() == 0
    assert boosting.per_condition(feats, labels, []).count() == 0


def test_populations_group_known_conditions_once(spark, monkeypatch):
    grouped, shared = [], []
    real, recommend = factor.known_lists, factor.recommend
    monkeypatch.setattr(factor, "known_lists", lambda *a: grouped.append(1) or real(*a))
    monkeypatch.setattr(factor, "recommend", lambda *a, **kw: shared.append(
        "known" in a[3].columns) or recommend(*a, **kw))
    got = catalog.QUERIES["population_calibration"](spark, "/root/testdata/sf0.001").collect()
    populations = {r["eligibility_status"] for r in got}
    assert len(got) == len(shared) == 4 * len(populations) and all(shared)
    assert len(grouped) == len(populations)


def test_known_lists_stand_for_known_rows(spark):
    known = spark.createDataFrame([(1, "a", "0"), (1, "b", "1"), (2, "a", "0"), (2, "a", "1")],
                                  "member_id long, condition_name string, chronic_flag string")
    got = {r[0]: sorted(r[1]) for r in factor.known_lists(known).collect()}
    assert got == {1: ["a", "b"], 2: ["a"]}
    by_class = {r[0]: sorted(r[1]) for r in factor.known_lists(known, True).collect()}
    assert by_class == {1: ["a\u00010", "b\u00011"], 2: ["a\u00010", "a\u00011"]}


@pytest.mark.parametrize("name", ["capture_curve_model", "cost_distribution",
                                  "provider_benchmark_model"])
def test_cost_models_fit_their_folds_side_by_side(spark, monkeypatch, name):
    asked, real = [], boosting._parallel_map
    monkeypatch.setattr(boosting, "_parallel_map", lambda fn, items, n: asked.append(
        (len(list(items)), n)) or real(lambda f: spark.range(1).select(
            F.col("id").alias("member_id"), F.lit(0.0).alias("pred")), items, n))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked == [(2, 2)]


def test_folds_side_by_side_give_the_rows_of_folds_in_turn(spark):
    frame = spark.createDataFrame([(i, float(i % 7)) for i in range(60)], "member_id long, y double")
    both = threading.Barrier(2, timeout=60)

    def mean(train, rest):
        return rest.withColumn("prob", F.lit(train.agg(F.avg("y")).first()[0]))

    def meet(train, rest):
        both.wait()                              # broken unless both folds are being fitted
        return mean(train, rest)

    got = sorted(boosting.out_of_fold(frame, meet, parallelism=2).collect())
    assert got == sorted(boosting.out_of_fold(frame, mean).collect()) and len(got) == 60
