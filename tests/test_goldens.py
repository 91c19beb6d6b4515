"""Hand-made goldens, one per semantic trap (FIXTURES.md section 3)."""

import math

import pytest
from pyspark.sql import functions as F

from carelens.functions.scalar import dot, labelled
from carelens.operators import candidates, casestudy, evaluate, neighbours
from carelens.operators.ids import contiguous_ids


def test_dot_product_figure3(spark):
    patient = [0.8, 0.4, -0.5, 0.6]
    conds = {"Diabetes": [0.2, 0.6, 0.1, -0.2], "Hypertension": [0.3, 0.8, -0.1, 0.2],
             "COPD": [0.1, 0.1, -0.1, 0.5], "Menopause": [-1.0, 0.1, 0.1, -0.1]}
    df = spark.createDataFrame([(k, patient, v) for k, v in conds.items()], "c string, u array<double>, v array<double>")
    got = {r.c: round(r.r, 2) for r in df.select("c", dot("u", "v").alias("r")).collect()}
    assert got == {"Diabetes": 0.23, "Hypertension": 0.73, "COPD": 0.47, "Menopause": -0.87}


PANEL = {1: ["Diabetes", "Hypertension"], 2: ["Diabetes", "Hypertension", "Hyperlipidemia"],
         3: ["Coronary Artery Disease", "Hyperlipidemia", "COPD"], 4: ["Hyperlipidemia", "COPD"]}


def _panel(spark):
    return spark.createDataFrame([(m, c, "1") for m, cs in PANEL.items() for c in cs],
                                 "member_id long, condition_name string, chronic_flag string")


def test_user_based_figures_1_2(spark):
    recs = neighbours.user_based(_panel(spark), 1)
    top = {r.member_id: r.condition_name for r in recs.collect()}
    assert top[1] == "Hyperlipidemia"
    assert top[4] == "Coronary Artery Disease"


def test_nearest_based_figures_1_2(spark):
    recs = neighbours.nearest_based(_panel(spark), least=0.4, neighbours=1, k=1)
    top = {r.member_id: r.condition_name for r in recs.collect()}
    assert top[1] == "Hyperlipidemia"
    assert top[4] == "Coronary Artery Disease"


def test_item_based_panel(spark):
    recs = neighbours.item_based(_panel(spark), 5)
    got = {(r.member_id, r.condition_name) for r in recs.collect()}
    assert (1, "Hyperlipidemia") in got
    assert all(c not in PANEL[m] for m, c in got)


def test_gender_threshold_is_inclusive(spark):
    members = spark.createDataFrame([(i, "M" if i < 19 else "F") for i in range(20)],
                                    "member_id long, gender string")
    feats = spark.createDataFrame([(i, "x", "1", 1.0) for i in range(20)],
                                  "member_id long, condition_name string, chronic_flag string, sqrt_adjusted_credibility double")
    lab = candidates.gender_labels(feats, members).first()
    assert lab.avg_males == pytest.approx(0.95) and lab.gender_specific == "Male"


def test_anti_join_ignores_rows_with_null_credibility(spark):
    resp = spark.createDataFrame([(1, "a", "1"), (2, "a", "1")],
                                 "member_id long, condition_name string, chronic_flag string")
    feats = spark.createDataFrame([(1, "a", "1", None), (2, "a", "1", 1.0)],
                                  "member_id long, condition_name string, chronic_flag string, sqrt_adjusted_credibility double")
    out = candidates.new_only(resp, feats).collect()
    assert [r.member_id for r in out] == [1]      # null credibility is not 'coded'


def test_semi_join_does_not_repeat_rows(spark):
    feats = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "member_id long, condition_name string")
    sel = spark.createDataFrame([(1,), (1,)], "member_id long")
    assert casestudy.extract_for(feats, sel).count() == 2
    assert feats.join(sel, "member_id").count() == 4  # the inner join would fan out


def test_exclusion_two_vs_three_keys(spark):
    recs = spark.createDataFrame([(1, "a", "0")], "member_id long, condition_name string, chronic_flag string")
    feats = spark.createDataFrame([(1, "a", "1", 1.0)],
                                  "member_id long, condition_name string, chronic_flag string, sqrt_adjusted_credibility double")
    assert candidates.drop_known(recs, feats).count() == 0
    assert candidates.drop_known(recs, feats, candidates.KEYS3).count() == 1


def test_unlabelled_conditions_dropped_by_default(spark):
    recs = spark.createDataFrame([(1, "a"), (1, "b")], "member_id long, condition_name string")
    members = spark.createDataFrame([(1, "F")], "member_id long, gender string")
    labels = spark.createDataFrame([("a", "Both")], "condition_name string, gender_specific string")
    assert candidates.gender_filter(recs, members, labels).count() == 1
    assert candidates.gender_filter(recs, members, labels, unlabelled="keep").count() == 2


def test_ties_ordered_by_name(spark):
    feats = spark.createDataFrame([(m, c, "1", 1.0) for m in range(3) for c in ("b", "a", "c")],
                                  "member_id long, condition_name string, chronic_flag string, sqrt_adjusted_credibility double")
    pop = candidates.popular_conditions(feats, 2).orderBy("pred_rank").collect()
    assert [r.condition_name for r in pop] == ["a", "b"]


def test_curve_golden(spark):
    scored = spark.createDataFrame([(1, "c1", "1", 1), (2, "c2", "1", 3), (3, "c3", "1", None),
                                    (4, "c4", "1", None)],
                                   "member_id long, condition_name string, chronic_flag string, pred_rank int")
    rows = evaluate.recall_curve(scored, "popular").orderBy("pred_rank").collect()
    assert [(r.pred_rank, r["count"], r.cumul_pred) for r in rows] == [(1, 1, 0.25), (3, 1, 0.5)]


def test_label_outside_levels_is_null(spark):
    df = spark.createDataFrame([("1",), ("0",), ("x",)], "f string")
    lab, order = labelled("f", [("1", "Chronic"), ("0", "Non-Chronic")])
    got = {r.f: (r.l, r.o) for r in df.select("f", lab.alias("l"), order.alias("o")).collect()}
    assert got == {"1": ("Chronic", 1), "0": ("Non-Chronic", 2), "x": (None, None)}


def test_contiguous_ids_with_nulls_first(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "k string")
    got = [(r.k, r.i) for r in contiguous_ids(df, "k", "i", num_partitions=3).orderBy("i").collect()]
    assert got == [(None, 1), ("a", 2), ("b", 3)]


def test_chosen_members_inline_and_broadcast(spark):
    df = spark.range(20).withColumnRenamed("id", "member_id")
    assert casestudy.chosen(df, [3, 5, 5]).count() == 2
    assert casestudy.chosen(df, list(range(0, 20, 2))).count() == 10


def test_seeded_member_sample_is_repeatable(spark):
    from carelens.operators.explain import sample_members
    um = spark.range(1, 501).select(F.col("id").alias("member_id"), F.col("id").cast("int").alias("user_id"))
    a = [r.member_id for r in sample_members(um, 10, seed=7).collect()]
    b = [r.member_id for r in sample_members(um, 10, seed=7).collect()]
    c = [r.member_id for r in sample_members(um, 10, seed=8).collect()]
    assert a == b and len(set(a)) == 10 and a != c


def test_period_summary_month_grain(spark):
    from carelens.operators import cost
    claims = spark.createDataFrame(
        [(1, "2001-01-05", "IP", True, 10.0, True), (1, "2001-01-20", "OP", False, 5.0, False),
         (1, "2001-02-01", "ER", False, 1.0, True)],
        "member_id long, d string, setting string, avoidable boolean, paid double, in_network boolean"
    ).withColumn("service_date", F.to_date("d"))
    rows = {str(r.period): r for r in cost.period_summary(claims, "month").collect()}
    jan = rows["2001-01-01"]
    assert (jan.paid_total, jan.paid_avoidable, jan.paid_in_network, jan.n_ip, jan.n_op, jan.n_claims) == (15.0, 10.0, 10.0, 1, 1, 2)
    assert rows["2001-02-01"].n_er == 1


def test_duplicate_ratings_merged_with_max(spark):
    from carelens.operators import ids
    feats = spark.createDataFrame(
        [(1, "x", 0.5, "1", "condition_name"), (1, "x", 0.9, "1", "condition_name"),
         (2, "x", 0.3, "1", "condition_name")],
        "member_id long, feature_value string, confidence double, chronic_flag string, feature_name string")
    um = ids.contiguous_ids(feats, "member_id", "user_id")
    pm = ids.contiguous_ids(feats, ["feature_name", "feature_value", "chronic_flag"], "product_id")
    got = sorted((r.user_id, r.product_id, round(r.confidence, 3)) for r in ids.ratings(feats, um, pm).collect())
    assert got == [(1, 1, 0.9), (2, 1, 0.3)]


def test_params_are_validated():
    from carelens.operators.factor import Params
    with pytest.raises(ValueError):
        Params(rank=0)
    with pytest.raises(ValueError):
        Params(alpha=0.0)
