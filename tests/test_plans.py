"""Physical-plan facts the design relies on (pushdown, anti-joins, group limits, no one-task
windows over member data)."""

from pyspark.sql import functions as F

from carelens.operators import candidates, summary
from carelens.operators.ids import contiguous_ids
from carelens.operators.util import rank_top
from carelens.plans import inputs
from carelens.sources.fixtures import Source
from tests.conftest import SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_discharge_scan_pushes_filter_and_prunes(spark):
    src = Source(spark, SF_SMALL)
    p = plan(summary.los_by(src.discharges, ["lob"]))
    assert "PushedFilters: [IsNotNull(l_linestatus), EqualTo(l_linestatus,F)" in p
    scan = [line for line in p.splitlines() if "lineitem" in line and "ReadSchema" in line][0]
    assert "l_extendedprice" not in scan and "l_quantity" in scan


def test_anti_join_is_planned_as_anti(spark):
    src = Source(spark, SF_SMALL)
    df = candidates.new_only(inputs.responses(src), inputs.tune_features(src))
    assert "LeftAnti" in optimized(df)


def test_rank_filter_becomes_group_limit(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("g"), F.col("id").alias("v"))
    out = rank_top(df, ["g"], [F.desc("v")], 3)
    assert "WindowGroupLimit" in plan(out)


def test_contiguous_ids_use_range_partitioning(spark):
    df = spark.range(1000).select((F.col("id") % 97).alias("k"))
    p = plan(contiguous_ids(df, "k", "id", checkpoint=False))
    assert "rangepartitioning" in p.lower()


def test_member_popular_has_no_cartesian_product(spark):
    src = Source(spark, SF_SMALL)
    df = candidates.member_popular(src.members, inputs.tune_features(src), inputs.popular(src))
    p = plan(df)
    assert "Cartesian" not in p and "BroadcastNestedLoopJoin" not in p


def test_ratings_shuffle_feature_table_once(spark):
    from carelens.operators import ids
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        src = Source(spark, SF_SMALL)
        r = ids.ratings(inputs.feature_all(src), inputs.user_map(src), inputs.product_map(src))
        p = plan(r)
        member_exchanges = [l for l in p.splitlines()
                            if "Exchange hashpartitioning(member_id" in l]
        assert len(member_exchanges) == 2      # feature side and user-map side of one join
        assert "HashAggregate(keys=[member_id" in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_lineitem_scan_for_history_and_profile(spark):
    from carelens.operators import cost, features
    src = Source(spark, SF_SMALL)
    for df in (features.condition_history(src.claims_with_gender, "2001-06-01", "2001-08-01",
                                          carry=["gender"]),
               cost.member_profile(src.claims, "2001-02-01")):
        scans = [l for l in plan(df).splitlines() if "FileScan parquet" in l and "lineitem" in l]
        assert len(scans) == 1


def test_gap_operators_scan_claims_once(spark):
    from carelens.operators import gaps
    src = Source(spark, SF_SMALL)
    for df in (gaps.explicit_gaps(src.claims, "2001-06-01"),
               gaps.drug_gaps(src.claims, src.drug_conditions, "2001-06-01")):
        p = plan(df)
        assert len([l for l in p.splitlines() if "FileScan parquet" in l and "lineitem" in l]) == 1
        assert "LeftAnti" not in p
