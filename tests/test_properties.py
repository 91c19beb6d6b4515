"""Property checks (hypothesis) and cross-checks between equivalent operator forms."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from carelens.operators import candidates, cost, evaluate, explain, factor
from carelens.operators.ids import contiguous_ids
from carelens.plans import inputs
from carelens.sources.fixtures import Source
from tests.conftest import SF_SMALL

keys = st.lists(st.tuples(st.sampled_from(["a", "b", "c", None]), st.integers(0, 30)),
                min_size=1, max_size=60)


@settings(max_examples=8, deadline=None)
@given(rows=keys, parts=st.integers(1, 7))
def test_contiguous_ids_equal_serial_row_number(spark, rows, parts):
    df = spark.createDataFrame(rows, "s string, n int")
    got = {r.id: (r.s, r.n) for r in contiguous_ids(df, ["s", "n"], "id", parts,
                                                    checkpoint=False).collect()}
    ref = df.distinct().withColumn("id", F.row_number().over(Window.orderBy("s", "n")))
    assert got == {r.id: (r.s, r.n) for r in ref.collect()}


@settings(max_examples=6, deadline=None)
@given(left=st.lists(st.integers(0, 9), max_size=30), right=st.lists(st.integers(0, 9), max_size=30))
def test_anti_plus_semi_is_input(spark, left, right):
    l = spark.createDataFrame([(x, i) for i, x in enumerate(left)], "k int, i int")
    r = spark.createDataFrame([(x,) for x in right], "k int")
    anti = l.join(r, "k", "left_anti").count()
    semi = l.join(r, "k", "left_semi").count()
    assert anti + semi == len(left)


def test_popular_ranks_equal_member_lists(spark):
    src = Source(spark, SF_SMALL)
    feats, pop = inputs.tune_features(src), inputs.popular(src)
    lists = candidates.member_popular(src.members, feats, pop, 15)
    via_join = evaluate.attach_ranks(inputs.new_conditions(src), lists)
    fast = candidates.popular_ranks_for(inputs.new_conditions(src), src.members, feats, pop, 15)
    a = sorted(tuple(r) for r in via_join.select(*candidates.KEYS3, "pred_rank").collect())
    b = sorted(tuple(r) for r in fast.select(*candidates.KEYS3, "pred_rank").collect())
    assert a == b


def test_fused_new_only_equals_anti_join(spark):
    src = Source(spark, SF_SMALL)
    anti = candidates.new_only(inputs.responses(src), inputs.tune_features(src))
    assert sorted(map(tuple, anti.collect())) == sorted(map(tuple,
                                                            inputs.new_conditions(src).collect()))


def test_curve_monotone_and_bounded(spark):
    src = Source(spark, SF_SMALL)
    rows = evaluate.recall_curve(inputs.popular_scored(src), "popular").collect()
    by_flag = {}
    for r in sorted(rows, key=lambda r: (r.chronic_flag, r.pred_rank)):
        by_flag.setdefault(r.chronic_flag, []).append(r.cumul_pred)
    for vals in by_flag.values():
        assert vals == sorted(vals) and vals[-1] <= 1.0 + 1e-9


def test_capture_is_one_at_full_share(spark):
    src = Source(spark, SF_SMALL)
    act = cost.outcomes(cost.member_profile(src.claims, "2001-02-01"), src.members)
    feats = act.select("member_id", (F.col("cost_total") * 0 + F.col("member_id")).alias("s"))
    cur = cost.capture_curves(act, feats, "cost_total", ["s"], [0.5, 1.0]).collect()
    assert {r.level: r.capture for r in cur}[1.0] == 1.0


def test_explanations_sum_to_rating_without_nonnegativity(spark):
    rng = np.random.default_rng(3)
    rows = [(u, p, float(rng.integers(1, 4))) for u in range(1, 41) for p in range(1, 16)
            if rng.random() < 0.3]
    ratings = spark.createDataFrame(rows, "user_id int, product_id int, confidence float")
    params = factor.Params(rank=4, alpha=2.0, reg=0.1)
    model = factor.fit(ratings, params, nonnegative=False, max_iter=10)
    targets = ratings.select("user_id").distinct().withColumn("product_id", F.lit(1))
    c = explain.contributions(model, ratings, targets, params)
    worst = c.agg(F.max(F.abs("residual_a"))).first()[0]
    assert worst < 1e-4


def test_standalone_credibility_equals_fused_history(spark):
    from carelens.operators import features
    src = Source(spark, SF_SMALL)
    alone = features.condition_credibility(src.claims, "2001-06-01")
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple,
                                                             inputs.tune_features(src).collect()))


def test_contiguous_ids_exact_when_aqe_sizes_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        df = spark.range(5000).select((F.col("id") * 7919 % 3001).alias("k"))
        got = {r.id: r.k for r in contiguous_ids(df, "k", "id").collect()}
        keys = sorted({(i * 7919) % 3001 for i in range(5000)})
        assert got == {i + 1: k for i, k in enumerate(keys)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_standalone_responses_equal_fused_history(spark):
    from carelens.operators import features
    src = Source(spark, SF_SMALL)
    alone = features.holdout_responses(src.claims, "2001-06-01")
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, inputs.responses(src).collect()))
