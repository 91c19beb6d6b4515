"""Feature engineering for the recommender."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.functions.scalar import decayed_weight, log_credibility, sqrt_credibility
from carelens.constants import DEMOG_SCALAR

FEATURE_COLUMNS = ["member_id", "feature_value", "confidence", "chronic_flag", "feature_name"]


def group_diagnoses(claim_lines: DataFrame, grouping: DataFrame, code_col: str = "diagnosis"
                    ) -> DataFrame:
    """Diagnosis code -> condition category and chronic class through a grouping table.
    The grouping table is a dimension; AQE broadcasts it when its measured size is small."""
    return claim_lines.join(grouping, code_col, "inner")


def condition_credibility(claims: DataFrame, as_of: str, setting_weights=None,
                          half_life_days=None, digits: int = 6) -> DataFrame:
    """T2 + F7: one row per (member, condition, class) coded on or before ``as_of``.

    credibility = sum over visits of setting weight * 0.5 ** (days before as_of / half-life);
    the table keeps its square root and log1p, rounded to ``digits`` places. The group-by is a
    sum, so it pre-aggregates per task before the shuffle (hot members do not pile up)."""
    cut = F.to_date(F.lit(as_of))
    age = F.datediff(cut, F.col("service_date"))
    weight = decayed_weight("setting", age, "chronic_flag", setting_weights, half_life_days)
    cred = F.sum(weight)
    return (claims.filter(F.col("service_date") <= cut)
            .groupBy("member_id", "condition_name", "chronic_flag")
            .agg(F.round(sqrt_credibility(cred), digits).alias("sqrt_adjusted_credibility"),
                 F.round(log_credibility(cred), digits).alias("log_adjusted_credibility")))


def condition_history(claims: DataFrame, cut: str, as_of: str | None = None,
                      carry: Sequence[str] = (), setting_weights=None, half_life_days=None,
                      digits: int = 6) -> DataFrame:
    """T2 + T4 in one pass: per (member, condition, class) the credibility of visits up to the
    cut (null when there were none) and whether the condition was coded after the cut. With
    ``as_of`` it also holds the credibility of every visit up to ``as_of`` aged from that date
    (the prediction features, ``pred_`` columns).

    Tuning features, hold-out responses, newly coded conditions and prediction features are
    all filters/projections of this one aggregate, which replaces three aggregations and an
    anti-join shuffle. ``carry`` names member attributes (e.g. gender) that are constant per
    member; they ride along as grouping keys so later steps need no join back to members."""
    d = F.col("service_date")

    def weight(ref):
        return decayed_weight("setting", F.datediff(ref, d), "chronic_flag", setting_weights,
                              half_life_days)

    c = F.to_date(F.lit(cut))
    aggs = [F.sum(F.when(d <= c, weight(c))).alias("_cred"),
            F.max((d > c).cast("int")).alias("_later")]
    if as_of is not None:
        a = F.to_date(F.lit(as_of))
        aggs.append(F.sum(F.when(d <= a, weight(a))).alias("_pred"))
    agg = claims.groupBy("member_id", "condition_name", "chronic_flag", *carry).agg(*aggs)
    cols = [
        "member_id", "condition_name", "chronic_flag", *carry,
        F.round(sqrt_credibility("_cred"), digits).alias("sqrt_adjusted_credibility"),
        F.round(log_credibility("_cred"), digits).alias("log_adjusted_credibility"),
        (F.col("_later") == 1).alias("coded_after_cut")]
    if as_of is not None:
        cols += [F.round(sqrt_credibility("_pred"), digits).alias("pred_sqrt_adjusted_credibility"),
                 F.round(log_credibility("_pred"), digits).alias("pred_log_adjusted_credibility")]
    return agg.select(*cols)


def holdout_responses(claims: DataFrame, cut: str) -> DataFrame:
    """T4: conditions coded after the cut (the response window), one row per key."""
    return (claims.filter(F.col("service_date") > F.to_date(F.lit(cut)))
            .select("member_id", "condition_name", "chronic_flag").distinct())


def age_band(age: str = "age", width: int = 10):
    lo = (F.floor(F.col(age) / width) * width).cast("int")
    return F.concat(lo.cast("string"), F.lit("-"), (lo + width - 1).cast("string"))


def demographic_features(members: DataFrame, confidence: float = 1.0) -> DataFrame:
    """Demographics in long form, one row per (member, feature) with a constant confidence:
    ten-year age band, gender and eligibility group. Missing values produce no row."""
    wide = members.select(
        "member_id",
        age_band().alias("age_band"),
        F.col("gender").cast("string").alias("gender"),
        F.col("eligibility_status").cast("string").alias("eligibility_status"),
    )
    long = wide.unpivot("member_id", ["age_band", "gender", "eligibility_status"],
                        "feature_name", "feature_value")
    return (long.filter(F.col("feature_value").isNotNull())
            .withColumn("confidence", F.lit(float(confidence))))


def munge_features(demographics: DataFrame, conditions: DataFrame,
                   scalar: float = DEMOG_SCALAR) -> DataFrame:
    """M1: condition rows (value = condition name, confidence = sqrt credibility) stacked with
    demographic rows (confidence * scalar, class ''), by column name."""
    demog = demographics.select(
        "member_id", "feature_value",
        (F.col("confidence").cast("float") * F.lit(scalar)).alias("confidence"),
        F.lit("").alias("chronic_flag"), "feature_name")
    conds = conditions.select(
        "member_id", F.col("condition_name").alias("feature_value"),
        F.col("sqrt_adjusted_credibility").cast("double").alias("confidence"),
        "chronic_flag", F.lit("condition_name").alias("feature_name"))
    return conds.unionByName(demog).select(*FEATURE_COLUMNS)
