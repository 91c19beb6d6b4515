"""Coding gaps (T11, T12): evidence that a condition should still be coded but is not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.operators.util import small_side


def explicit_gaps(claims: DataFrame, as_of: str, months: int = 12, chronic_only: bool = False
                  ) -> DataFrame:
    """Conditions coded in the prior period (the ``months`` before the recent one) but not
    in the recent period (the last ``months`` before ``as_of``), chronic ones only on request.

    One aggregate over both periods: per (member, condition, class) the last prior-period date
    and whether the condition was coded recently; no second scan and no anti-join shuffle."""
    cut = F.to_date(F.lit(as_of))
    d = F.col("service_date")
    start_recent = F.add_months(cut, -months)
    both = claims.filter((d > F.add_months(cut, -2 * months)) & (d <= cut))
    if chronic_only:
        both = both.filter(F.col("chronic_flag") == "1")
    per = both.groupBy("member_id", "condition_name", "chronic_flag").agg(
        F.max(F.when(d <= start_recent, d)).alias("last_coded"),
        F.max((d > start_recent).cast("int")).alias("_recent"))
    return per.filter(F.col("last_coded").isNotNull() & (F.col("_recent") == 0)).drop("_recent")


def drug_gaps(claims: DataFrame, drug_map: DataFrame, as_of: str, months: int = 12
              ) -> DataFrame:
    """The member received a drug implying a condition in the recent period, and the
    condition was not coded in that period.

    One scan of the recent claims: every claim yields a fact "drug implies condition" and a
    fact "condition coded" (a two-element array, exploded); one grouping per (member,
    condition) keeps the conditions implied but not coded, with the drugs implying them."""
    cut = F.to_date(F.lit(as_of))
    d = F.col("service_date")
    recent = claims.filter((d > F.add_months(cut, -months)) & (d <= cut))
    dm = small_side(drug_map.select("drug", F.col("condition_name").alias("implied")))
    x = recent.select("member_id", "drug", "condition_name").join(dm, "drug", "left")
    facts = x.select("member_id", F.explode(F.array(
        F.struct(F.col("implied").alias("key"), F.col("drug").alias("drug"),
                 F.lit(True).alias("by_drug")),
        F.struct(F.col("condition_name").alias("key"), F.lit(None).cast("string").alias("drug"),
                 F.lit(False).alias("by_drug")))).alias("f")).select("member_id", "f.*")
    per = facts.filter(F.col("key").isNotNull()).groupBy("member_id", "key").agg(
        F.collect_set(F.when(F.col("by_drug"), F.col("drug"))).alias("drugs"),
        F.max((~F.col("by_drug")).cast("int")).alias("coded"))
    return per.filter(F.col("coded") == 0).select(
        "member_id", F.explode("drugs").alias("drug"), F.col("key").alias("condition_name"))
