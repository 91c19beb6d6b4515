"""Six-month cost and utilization: period features, outcomes, ranking accuracy (T13-T15,
T20-T24).

All member-level aggregates are sums/counts (partial aggregation before the shuffle). Global
rankings use the contiguous-id operator, so no window ever runs in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelens.operators.ids import contiguous_ids

SETTINGS = ["IP", "ER", "OP"]            # fixed service settings
MONEY_DIGITS = 4


def _money(c: Column) -> Column:
    return F.round(c, MONEY_DIGITS)


def _paid_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.col("paid")).otherwise(F.lit(0.0)))


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def with_network(claims: DataFrame, providers: DataFrame) -> DataFrame:
    """Attach the provider's network flag (unknown providers count as out of network)."""
    return claims.join(providers.select("providerid", "in_network"), "providerid", "left") \
        .withColumn("in_network", F.coalesce(F.col("in_network"), F.lit(False)))


def period_summary(claims: DataFrame, grain: str = "quarter") -> DataFrame:
    """One row per (member, period): cost by avoidable / network / setting and visit
    counts by setting (explicit pivot values, so no extra pass to discover them)."""
    period = F.date_trunc(grain, F.col("service_date")).cast("date")
    aggs = [
        _money(F.sum("paid")).alias("paid_total"),
        _money(_paid_if(F.col("avoidable"))).alias("paid_avoidable"),
        _money(_paid_if(F.col("in_network"))).alias("paid_in_network"),
        *[_money(_paid_if(F.col("setting") == s)).alias(f"paid_{s.lower()}") for s in SETTINGS],
        *[_count_if(F.col("setting") == s).alias(f"n_{s.lower()}") for s in SETTINGS],
        F.count(F.lit(1)).alias("n_claims"),
    ]
    return claims.groupBy("member_id", period.alias("period")).agg(*aggs)


def service_types(grouping: DataFrame) -> list[str]:
    """The types of service of the grouping table, in order (a taxonomy: a few dozen values)."""
    rows = grouping.select("service_type").filter("service_type is not null").distinct().collect()
    return sorted(r["service_type"] for r in rows)


def _column_name(*parts: str) -> str:
    return "_".join("".join(c if c.isalnum() else "_" for c in p.lower()) for p in parts)


def period_service_pivot(claims: DataFrame, types: Sequence[str], grain: str = "quarter"
                         ) -> DataFrame:
    """T13 by type of service, wide: one row per (member, period), cost per type. The pivot has
    its values given, so no pass discovers them, and sums are combined before the shuffle."""
    period = F.date_trunc(grain, F.col("service_date")).cast("date")
    wide = (claims.groupBy("member_id", period.alias("period")).pivot("service_type", list(types))
            .agg(_money(F.sum("paid"))))
    return wide.select("member_id", "period", *[
        F.coalesce(F.col(f"`{t}`"), F.lit(0.0)).alias(_column_name("paid", t)) for t in types])


def history_columns(types: Sequence[str]) -> list[str]:
    return [_column_name("prior", net, t) for net in ("in", "out") for t in types]


def history_wide(claims_net: DataFrame, cut: str, types: Sequence[str], months: int = 12
                 ) -> DataFrame:
    """Prior cost of every member by network and type of service, one column each."""
    c = F.to_date(F.lit(cut))
    past = claims_net.filter((F.col("service_date") > F.add_months(c, -months))
                             & (F.col("service_date") <= c))
    place = F.concat_ws("|", F.when(F.col("in_network"), "in").otherwise("out"), "service_type")
    keys = [f"{net}|{t}" for net in ("in", "out") for t in types]
    wide = (past.withColumn("_place", place).groupBy("member_id").pivot("_place", keys)
            .agg(_money(F.sum("paid"))))
    return wide.select("member_id", *[F.coalesce(F.col(f"`{k}`"), F.lit(0.0)).alias(n)
                                      for k, n in zip(keys, history_columns(types))])


def condition_flags(claims: DataFrame, cut: str) -> DataFrame:
    """The conditions coded up to the cut, as one sorted array of condition:class names."""
    return (claims.filter(F.col("service_date") <= F.to_date(F.lit(cut))).groupBy("member_id")
            .agg(F.array_sort(F.collect_set(F.concat_ws(":", "condition_name", "chronic_flag")))
                 .alias("flags")))


def flag_vocabulary(flags: DataFrame) -> list[str]:
    """All flags in name order: the places of the sparse vector (the condition taxonomy)."""
    names = flags.select(F.explode("flags").alias("flag")).distinct().collect()
    return sorted(r["flag"] for r in names)


def flag_vectors(flags: DataFrame, vocabulary: Sequence[str], out: str = "flag_vector"
                 ) -> DataFrame:
    """``flags`` arrays as sparse 0/1 vectors over the vocabulary; null arrays are empty."""
    filled = flags.withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    if not vocabulary:
        return filled.withColumn(out, array_to_vector(F.array().cast("array<double>")))
    model = CountVectorizerModel.from_vocabulary(list(vocabulary), "flags", out)
    return model.setBinary(True).transform(filled)


def merged_intervals(enrolments: DataFrame) -> DataFrame:
    """Enrolments (member_id, programme, from_date, to_date; both ends in) without overlaps:
    intervals of one member and programme that touch or overlap become one."""
    own = Window.partitionBy("member_id", "programme").orderBy("from_date", "to_date")
    before = F.max("to_date").over(own.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("from_date") > F.date_add(before, 1)).cast("int"), F.lit(1))
    island = F.sum("_fresh").over(own)
    return (enrolments.filter("from_date <= to_date").withColumn("_fresh", fresh)
            .withColumn("_island", island)
            .groupBy("member_id", "programme", "_island")
            .agg(F.min("from_date").alias("from_date"), F.max("to_date").alias("to_date"))
            .drop("_island"))


def in_programme(facts: DataFrame, intervals: DataFrame, date: str = "service_date",
                 grain: str = "month") -> DataFrame:
    """Dated facts with every programme interval of the member that holds the date. Intervals are
    laid out by period, so the join is by (member, period), and the dates are compared inside: a
    member with any share of all facts meets few intervals per period, and AQE splits the rest."""
    laid = intervals.withColumn("_period", F.explode(F.sequence(
        F.date_trunc(grain, "from_date").cast("date"), F.date_trunc(grain, "to_date").cast("date"),
        F.expr(f"interval 1 {grain}"))))
    keyed = facts.withColumn("_period", F.date_trunc(grain, F.col(date)).cast("date"))
    return (keyed.join(laid, ["member_id", "_period"])
            .filter(F.col(date).between(F.col("from_date"), F.col("to_date"))).drop("_period"))


def programme_benchmark(claims: DataFrame, intervals: DataFrame, prior: DataFrame, cut: str,
                        months: int = 6) -> DataFrame:
    """T24 per programme: cost in the ``months`` after the cut while enrolled, against the
    members' prior-year cost (prior_cost) per enrolled day. ``intervals`` do not overlap."""
    c = F.to_date(F.lit(cut))
    lo, hi = F.date_add(c, 1), F.add_months(c, months)
    window = intervals.select("member_id", "programme", F.greatest("from_date", lo)
                              .alias("from_date"), F.least("to_date", hi).alias("to_date")) \
        .filter("from_date <= to_date")
    days = (window.groupBy("programme", "member_id")
            .agg(F.sum(F.datediff("to_date", "from_date") + 1).alias("days"))
            .join(prior.select("member_id", "prior_cost"), "member_id", "left")
            .groupBy("programme").agg(
                F.count("*").alias("members"), F.sum("days").alias("days"),
                F.sum(F.coalesce("prior_cost", F.lit(0.0)) / 365 * F.col("days"))
                .alias("predicted")))
    paid = claims.filter((F.col("service_date") > c) & (F.col("service_date") <= hi)).select(
        "member_id", "service_date", "paid")
    actual = in_programme(paid, window).groupBy("programme").agg(F.sum("paid").alias("actual"))
    out = days.join(actual, "programme", "left").withColumns(
        {"actual": _money(F.coalesce("actual", F.lit(0.0))),
         "predicted": F.round("predicted", 2)})
    return out.select("programme", "members", "days", "actual", "predicted", F.when(
        F.col("predicted") != 0, F.round(F.col("actual") / F.col("predicted"), 4)).alias("ratio"))


def member_profile(claims: DataFrame, cut: str, history_months: int = 12,
                   outcome_months: int = 6) -> DataFrame:
    """Everything the cost models need from the claims, in one pass: per member, the conditions
    coded up to the cut (T14), cost and utilization in the ``history_months`` up to the cut
    (T22) and the outcomes in the ``outcome_months`` after it (T15).

    Two-level aggregate: per (member, condition, class) first, so the condition count needs no
    distinct aggregate, then per member. Both levels are sums/maxima, pre-aggregated per task,
    so a member holding a third of all claims is combined before the shuffle. Members without
    claims in a window have nulls here; ``outcomes`` / ``member_features`` zero-fill them."""
    c = F.to_date(F.lit(cut))
    d, setting, avoid, paid = (F.col("service_date"), F.col("setting"), F.col("avoidable"),
                               F.col("paid"))
    past = (d > F.add_months(c, -history_months)) & (d <= c)
    nxt = (d > c) & (d <= F.add_months(c, outcome_months))

    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")

    per_condition = claims.groupBy("member_id", "condition_name", "chronic_flag").agg(
        F.max((d <= c).cast("int")).alias("_coded"),
        F.sum(F.when(past, paid)).alias("_pc"),
        F.sum(F.when(past & avoid, paid).when(past, F.lit(0.0))).alias("_pa"),
        cnt(past & (setting == "IP")).alias("_pi"),
        cnt(past & (setting == "ER")).alias("_pe"),
        cnt(past).alias("_pn"),
        F.max((nxt & (setting == "IP")).cast("int")).alias("_oi"),
        F.max((nxt & (setting == "ER")).cast("int")).alias("_oe"),
        F.sum(F.when(nxt, paid)).alias("_oc"),
        F.sum(F.when(nxt & avoid, paid).when(nxt, F.lit(0.0))).alias("_oa"))
    return per_condition.groupBy("member_id").agg(
        F.sum("_coded").cast("bigint").alias("n_conditions"),
        F.sum(F.when(F.col("chronic_flag") == "1", F.col("_coded")).otherwise(0)).cast("bigint")
         .alias("n_chronic"),
        _money(F.sum("_pc")).alias("prior_cost"),
        _money(F.sum("_pa")).alias("prior_avoidable"),
        F.sum("_pi").alias("prior_ip"), F.sum("_pe").alias("prior_er"),
        F.sum("_pn").alias("prior_claims"),
        F.max("_oi").alias("any_ip"), F.max("_oe").alias("any_er"),
        F.sum("_oc").alias("cost_total"), F.sum("_oa").alias("cost_avoidable"))


def outcomes(profile: DataFrame, members: DataFrame) -> DataFrame:
    """Any inpatient stay, any ER visit, total and avoidable cost after the cut; members
    without claims get zeros (left join from the member table)."""
    return members.select("member_id").join(profile, "member_id", "left").select(
        "member_id",
        F.coalesce("any_ip", F.lit(0)).cast("int").alias("any_ip"),
        F.coalesce("any_er", F.lit(0)).cast("int").alias("any_er"),
        _money(F.coalesce("cost_total", F.lit(0.0))).alias("cost_total"),
        _money(F.coalesce("cost_avoidable", F.lit(0.0))).alias("cost_avoidable"))


def latest_measurements(measurements: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Latest value of each measure per member (``max_by`` on the timestamp), pivoted to
    one column per listed measure."""
    aggs = [F.max_by(F.when(F.col("measure") == m, F.col("value")),
                     F.when(F.col("measure") == m, F.col("ts"))).alias(f"last_{m}")
            for m in measures]
    return measurements.groupBy("member_id").agg(*aggs)


def member_features(members: DataFrame, profile: DataFrame, measurements: DataFrame,
                    measures: Sequence[str]) -> DataFrame:
    """T14 + T20: one feature row per member: demographics, risk score, coded-condition
    counts, 12-month history (from ``member_profile``) and latest measurements. Missing values
    are kept as nulls with an indicator column next to each nullable feature (trees in Spark
    reject NaN vectors; the model input fills a sentinel, see ``boosting.assemble``)."""
    meas = latest_measurements(measurements, measures)
    base = members.select("member_id", "age",
                          F.coalesce((F.col("gender") == "M").cast("int"), F.lit(0)).alias("male"),
                          F.col("gender").isNull().cast("int").alias("gender_missing"),
                          "eligibility_status", "risk_score")
    hist = profile.select("member_id", "n_conditions", "n_chronic", "prior_cost",
                          "prior_avoidable", "prior_ip", "prior_er", "prior_claims")
    out = base.join(hist, "member_id", "left").join(meas, "member_id", "left")
    zero_fill = ["n_conditions", "n_chronic", "prior_ip", "prior_er", "prior_claims"]
    money_fill = ["prior_cost", "prior_avoidable"]
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in zero_fill})
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in money_fill})
    return out.withColumns({f"last_{m}_missing": F.col(f"last_{m}").isNull().cast("int")
                            for m in measures})


def global_rank(df: DataFrame, score: str, key: str = "member_id", name: str = "rank",
                group: str | None = None) -> DataFrame:
    """Exact rank by score descending (nulls last, ties by key; ``key`` must be unique per
    group), per ``group`` if given, without a one-task window: one contiguous-id pass over
    (group, null flag, -score, key), minus the first id of each group."""
    g = [group] if group else []
    keyed = df.select(*g, key, F.col(score).isNull().alias("_null"),
                      (-F.col(score)).alias("_neg"))
    ranked = contiguous_ids(keyed, [*g, "_null", "_neg", key], "_id", unique=True,
                            dtype="bigint")
    if not g:
        return ranked.select(key, F.col("_id").alias(name))
    first = ranked.groupBy(*g).agg(F.min("_id").alias("_first"))      # one row per group
    return ranked.join(F.broadcast(first), g).select(
        *g, key, (F.col("_id") - F.col("_first") + 1).alias(name))


def capture_curves(actual: DataFrame, scored: DataFrame, actual_col: str,
                   score_cols: Sequence[str], levels: Sequence[float], key: str = "member_id"
                   ) -> DataFrame:
    """T21 (+T22): for each ranking in ``score_cols`` and each X in ``levels``, the share of
    the actual top X% that is also in the ranking's top X% (top X% = first ceil(n * X)
    members; ties broken by member key).

    Only members with an actual outcome and a score row take part: the two are joined first and
    ranked after, so ranks and n come from the same members. A member is in both top lists at
    level X iff max(actual rank, score rank) <= n_X, so one aggregate with a conditional count
    per level gives every curve; n is the number of actual ranks."""
    actual_group = "\u0000actual"          # cannot collide with a score column name
    joined = actual.select(key, F.col(actual_col).cast("double").alias(actual_group)).join(
        scored.select(key, *[F.col(c).cast("double").alias(c) for c in score_cols]), key)
    long = joined.unpivot(key, [actual_group, *score_cols], "baseline", "_score")
    ranked = global_rank(long, "_score", key, "_r", group="baseline")   # one pass for all
    ra = ranked.filter(F.col("baseline") == actual_group).select(key, F.col("_r").alias("_ra"))
    rp = ranked.filter(F.col("baseline") != actual_group) \
        .select("baseline", key, F.col("_r").alias("_rp"))
    both = ra.join(rp, key).withColumn("_m", F.greatest("_ra", "_rp"))
    ms = both.withColumn("_n", F.lit(ra.agg(F.count(F.lit(1))).scalar()))
    cols = []
    for x in levels:
        nx = F.ceil(F.col("_n") * F.lit(float(x)))
        cols.append(F.struct(F.lit(float(x)).alias("level"), nx.cast("bigint").alias("n_top"),
                             F.round(F.sum(F.when(F.col("_m") <= nx, 1).otherwise(0)) / nx, 6)
                             .alias("capture")))
    return ms.groupBy("baseline", "_n").agg(F.array(*cols).alias("c")) \
        .select("baseline", F.inline("c"))


def priority_list(scored: DataFrame, score_col: str, k: int = 25, key: str = "member_id"
                  ) -> DataFrame:
    """The ``k`` members with the highest score (a top-k report: per-task top-k, then one
    merge of k rows per task)."""
    return scored.orderBy(F.desc_nulls_last(score_col), key).limit(k)


def attributed_provider(claims: DataFrame) -> DataFrame:
    """Each member's provider: the one with most claims (ties: smallest provider id)."""
    per = claims.groupBy("member_id", "providerid").agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("providerid", F.struct(F.col("n"), -F.col("providerid")))
    return per.groupBy("member_id").agg(best.alias("providerid"))


def provider_benchmark(actual: DataFrame, predicted: DataFrame, attribution: DataFrame,
                       actual_col: str, pred_col: str) -> DataFrame:
    """Actual vs predicted per provider (sum, sum, ratio)."""
    x = attribution.join(actual.select("member_id", actual_col), "member_id") \
        .join(predicted.select("member_id", pred_col), "member_id")
    agg = x.groupBy("providerid").agg(
        F.count(F.lit(1)).alias("members"),
        F.round(F.sum(actual_col), MONEY_DIGITS).alias("actual"),
        F.round(F.sum(pred_col), MONEY_DIGITS + 2).alias("predicted"))
    ratio = F.when(F.col("predicted") != 0, F.round(F.col("actual") / F.col("predicted"), 6))
    return agg.withColumn("ratio", ratio)
