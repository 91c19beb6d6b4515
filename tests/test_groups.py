"""Grouped order statistics and ids, programme intervals, kept tables, cuts from the data, the
models' feature row and the one-ensemble distribution."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from carelens.operators import boosting, cost, factor, ids
from carelens.session import scratch_path
from carelens.sources import tables
from carelens.sources.fixtures import Source, months_before

from .conftest import SF_SMALL


def test_order_statistic_of_groups_against_sorting(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([None, rng.randint(0, 9) / 4, rng.random()]))
            for g, n in (("a", 1), ("b", 2), ("c", 41), ("d", 1_500), ("e", 300)) for _ in range(n)]
    rows += [("f", 0.5)] * 400 + [("g", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    for q in (0.0, 0.05, 0.5, 1.0):
        got = {r["g"]: r["threshold"]
               for r in factor.grouped_order_statistic(df, ["g"], "v", q).collect()}
        want = {}
        for g in {r[0] for r in rows}:
            own = sorted(v for k, v in rows if k == g and v is not None)
            if own and g is not None:
                want[g] = own[int(q * (len(own) - 1) + 1e-9)]
        got.pop(None, None)
        assert got == want


def test_no_task_holds_a_group_of_ratings(spark):
    df = spark.range(50_000).select(F.lit("one").alias("g"), F.rand(3).alias("v"))
    ranged = df.repartitionByRange(8, "g", "v").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) == 8 and max(r["count"] for r in ranged) < 12_000


def test_suspicious_codings_equal_percent_rank(spark):
    rng = random.Random(4)
    rows = [(m, c, "1", float(rng.randint(0, 30))) for m in range(400) for c in "xyz"
            if rng.random() < 0.6]
    rated = spark.createDataFrame(rows, "member_id long, condition_name string, "
                                        "chronic_flag string, rating double")
    got = {(r["member_id"], r["condition_name"])
           for r in factor.suspicious_codings(rated, 0.1).collect()}
    from pyspark.sql import Window
    w = Window.partitionBy("condition_name").orderBy("rating")
    want = rated.withColumn("p", F.percent_rank().over(w)).filter("p <= 0.1").collect()
    assert got == {(r["member_id"], r["condition_name"]) for r in want}


def test_ids_within_groups(spark):
    rows = [(g, v) for g, vs in (("a", "qwert"), ("b", "we"), (None, "xyz")) for v in vs] * 3
    got = ids.grouped_ids(spark.createDataFrame(rows, "g string, v string").repartition(4), "g",
                          "v", "n").collect()
    assert sorted((r["g"] or "", r["v"], r["n"]) for r in got) == sorted(
        (g or "", v, i) for g, vs in (("a", "qwert"), ("b", "we"), (None, "xyz"))
        for i, v in enumerate(sorted(vs), 1))


def test_programme_intervals_against_days(spark):
    rng = random.Random(6)
    day = dt.date(2020, 1, 1)
    spans = [(m, rng.choice("PQ"), day + dt.timedelta(rng.randint(0, 300)), rng.randint(-3, 60))
             for m in range(12) for _ in range(6)]
    spans = [(m, p, a, a + dt.timedelta(n)) for m, p, a, n in spans]
    facts = [(rng.randint(0, 13), day + dt.timedelta(rng.randint(0, 400)), float(i))
             for i in range(900)]
    merged = cost.merged_intervals(spark.createDataFrame(
        spans, "member_id long, programme string, from_date date, to_date date"))
    days = {}
    for m, p, a, b in spans:
        days.setdefault((m, p), set()).update(a + dt.timedelta(i) for i in range((b - a).days + 1))
    found = {}
    for r in merged.collect():
        own = found.setdefault((r["member_id"], r["programme"]), [])
        own += [r["from_date"] + dt.timedelta(i)
                for i in range((r["to_date"] - r["from_date"]).days + 1)]
    assert {k: len(v) for k, v in found.items()} == {k: len(v) for k, v in days.items() if v}
    assert {k: set(v) for k, v in found.items()} == {k: v for k, v in days.items() if v}
    joined = cost.in_programme(spark.createDataFrame(
        facts, "member_id long, service_date date, paid double"), merged)
    got = sorted((r["member_id"], r["programme"], r["paid"]) for r in joined.collect())
    assert got == sorted((m, p, v) for m, d, v in facts for (k, p), own in days.items()
                         if k == m and d in own)
    plan = joined._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_kept_tables_are_released(spark):
    held = spark.sparkContext._jsc.getPersistentRDDs
    before = held().size()
    df = spark.range(1_000).withColumn("v", F.col("id") % 7)
    with tables.kept(df) as k:
        assert k.groupBy("v").count().count() == 7 and held().size() == before + 1
    assert held().size() == before
    with pytest.raises(ValueError):
        with tables.kept(df) as k:
            k.count()
            raise ValueError
    assert held().size() == before
    with tables.kept(df, reliable=True) as k:
        place = k.inputFiles()[0]
        assert k.count() == 1_000 and held().size() == before
    import os
    assert not os.path.exists(place.removeprefix("file://").removeprefix("file:"))


def test_latest_value_comes_from_the_footers(spark, capfd):
    path = scratch_path(spark, "dated")
    spark.range(500).select(F.expr("date_add(date '2020-01-01', cast(id % 40 as int))")
                            .alias("day")).write.parquet(path)
    assert tables.latest(spark, path, "day") == dt.date(2020, 2, 9)
    spark.conf.set("spark.sql.sources.useV1SourceList", "")
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    try:
        plan = spark.read.parquet(path).agg(F.max("day"))._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.sources.useV1SourceList")
        spark.conf.unset("spark.sql.parquet.aggregatePushdown")
    assert "PushedAggregation: [MAX(day)]" in plan


def test_cuts_follow_the_data(spark):
    src = Source(spark, SF_SMALL)
    assert (src.last_service, src.holdout_cut, src.outcome_cut) == (
        "2001-08-01", "2001-06-01", "2001-02-01")
    assert Source(spark, SF_SMALL, holdout_cut="2000-05-05").holdout_cut == "2000-05-05"
    assert months_before("2001-08-31", 2) == "2001-06-30"
    assert months_before("2000-01-15", 13) == "1998-12-15"


def test_flags_carry_a_planted_effect(spark):
    """The event happens to members with one condition; nothing else tells them apart."""
    rng = random.Random(8)
    claims, label = [], {}
    for m in range(900):
        own = {rng.choice("abcdefgh") for _ in range(3)} | ({"risk"} if m % 4 == 0 else set())
        claims += [(m, c, "1", dt.date(2020, 1, 1)) for c in own]
        label[m] = int(m % 4 == 0 and rng.random() < 0.9 or rng.random() < 0.05)
    flags = cost.condition_flags(spark.createDataFrame(
        claims, "member_id long, condition_name string, chronic_flag string, service_date date"),
        "2020-06-01")
    vocabulary = cost.flag_vocabulary(flags)
    assert "risk:1" in vocabulary and vocabulary == sorted(vocabulary)
    rows = spark.createDataFrame([(m, y, 1.0) for m, y in label.items()],
                                 "member_id long, y int, same double")
    frame = boosting.assemble(cost.flag_vectors(rows.join(flags, "member_id", "left"), vocabulary),
                              ["same"], vectors=["flag_vector"]).select("member_id", "y", "features")
    assert frame.first()["features"].__class__.__name__ == "SparseVector"

    def predict(train, rest):
        m = boosting.event_model(train, "y", trees=8, depth=3, subset="all").fit(train)
        return boosting.probability(m.transform(rest)).select("member_id", "prob")

    got = {r["member_id"]: r["prob"] for r in boosting.out_of_fold(frame, predict).collect()}
    assert len(got) == 900
    assert all((p > 0.5) == (m % 4 == 0) for m, p in got.items())


def test_one_forest_gives_all_quantiles(spark):
    """Labels whose distribution depends on a feature: out-of-fold coverage at three quantiles,
    overall and within the feature's groups."""
    rng = random.Random(9)
    rows = [(m, float(m % 3), rng.random(), rng.gammavariate(2, 1 + 10 * (m % 3)))
            for m in range(3_000)]
    frame = boosting.assemble(spark.createDataFrame(
        rows, "member_id long, g double, noise double, y double"), ["g", "noise"])
    taus = [0.5, 0.75, 0.9]

    def predict(train, rest):
        out = boosting.quantile_forest(train, "y", trees=6, depth=3, subspace=1.0).distribution(rest)
        return out.select("g", "y", *[boosting.QuantileForest.read("distribution", t)
                                      .alias(f"q{t}") for t in taus])

    got = boosting.out_of_fold(frame, predict).collect()
    assert len(got) == 3_000
    assert all(r["q0.5"] <= r["q0.75"] <= r["q0.9"] for r in got)
    for g in (None, 0.0, 1.0, 2.0):
        own = [r for r in got if g is None or r["g"] == g]
        for t in taus:
            assert abs(sum(r["y"] <= r[f"q{t}"] for r in own) / len(own) - t) < 0.05, (g, t)
