"""Case-study extracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.operators.util import small_side


def members_with_condition(features: DataFrame, conditions: DataFrame, min_credibility: float = 1.0
                           ) -> DataFrame:
    """P10: members coded with one of ``conditions`` (condition_name[, chronic_flag]) at a
    credibility above ``min_credibility``."""
    keys = [c for c in ("condition_name", "chronic_flag") if c in conditions.columns]
    hit = features.filter(F.col("sqrt_adjusted_credibility") > min_credibility)
    return hit.join(small_side(conditions.select(*keys).distinct()), keys,
                    "left_semi").select("member_id").distinct()


def extract_for(df: DataFrame, members: DataFrame, key: str = "member_id") -> DataFrame:
    """All rows of ``df`` for the selected members. A semi-join never repeats a row, even
    when a member is selected twice (D5)."""
    return df.join(members.select(key), key, "left_semi")


def chosen(df: DataFrame, member_ids: Sequence, key: str = "member_id") -> DataFrame:
    """Rows of hand-picked members: an IN predicate, pushed into the scan."""
    return df.filter(F.col(key).isin(list(member_ids)))
