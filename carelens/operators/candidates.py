"""Candidate generation, filtering and ranking.

Anti-joins are written as ``left_anti`` (Catalyst does not turn "left join + is null" into one).
The popularity baseline never forms the member x condition product with a join: the top list
is a bounded top-k, carried as a scalar subquery (or a small joined table for segments), and
each member's list is derived from it with array expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelens.operators.util import small_side, rank_top
from carelens.constants import GENDER_SHARE, POPULAR_PER_MEMBER, POPULAR_TOP

KEYS3 = ["member_id", "condition_name", "chronic_flag"]


def gender_labels(features: DataFrame, members: DataFrame | None = None,
                  share: float = GENDER_SHARE) -> DataFrame:
    """M7: per condition, share of member-rows that are male / female; 'Male' if the male share
    is at least ``share``, else 'Female' if the female share is, else 'Both'. When the feature
    rows already carry the member's gender, pass ``members=None`` and no join is needed."""
    g = F.col("gender")
    if members is None:
        rows = features.select("member_id", "condition_name", "gender")
    else:
        rows = features.select("member_id", "condition_name").join(
            members.select("member_id", "gender"), "member_id")
    agg = rows.groupBy("condition_name").agg(
        F.avg(F.when(g == "M", 1).otherwise(0)).alias("avg_males"),
        F.avg(F.when(g == "F", 1).otherwise(0)).alias("avg_females"))
    label = (F.when(F.col("avg_males") >= share, "Male")
             .when(F.col("avg_females") >= share, "Female").otherwise("Both"))
    return agg.withColumn("gender_specific", label)


def known_rows(features: DataFrame, value_col: str = "sqrt_adjusted_credibility") -> DataFrame:
    """Rows that count as 'already coded'. A row with a null credibility would be treated as
    unmatched by a left-join-then-null-test (D4); the contract is non-null, enforced here."""
    return features.filter(F.col(value_col).isNotNull())


def new_only(responses: DataFrame, features: DataFrame, keys: Sequence[str] = KEYS3
             ) -> DataFrame:
    """Response rows with no training row on ``keys``."""
    return responses.join(known_rows(features).select(*keys), list(keys), "left_anti")


def popular_conditions(features: DataFrame, k: int = POPULAR_TOP,
                       segment: Sequence[str] = ()) -> DataFrame:
    """W1 (+T8): members per (condition, class[, segment]); top ``k`` per class (and segment)
    by count, ties by condition name."""
    seg = list(segment)
    counts = features.groupBy(*seg, "condition_name", "chronic_flag").count()
    return rank_top(counts, [*seg, "chronic_flag"], [F.desc("count"), F.asc("condition_name")], k)


def _lists_per_class(popular: DataFrame, segment: Sequence[str]) -> DataFrame:
    """One row per (segment, class): the ranked top list as an array (at most k entries)."""
    item = F.struct("pred_rank", "condition_name", "count")
    return popular.groupBy(*segment, "chronic_flag").agg(
        F.sort_array(F.collect_list(item)).alias("items"))


def _known_per_member(features: DataFrame, popular: DataFrame) -> DataFrame:
    """Per member, the popular conditions already coded: array of (class, condition, rank)."""
    top = small_side(popular.select("condition_name", "chronic_flag", "pred_rank").distinct())
    hits = known_rows(features).select(*KEYS3).join(top, ["condition_name", "chronic_flag"])
    return hits.groupBy("member_id").agg(
        F.collect_list(F.struct("chronic_flag", "condition_name", "pred_rank")).alias("known"))


def _drop_known_and_rank(lists: Column, known: Column, k: int) -> Column:
    """For an array of (class, items) lists, drop items the member already has, keep the first
    ``k`` per class and number them 1..k. Returns an array of result structs."""
    def per_class(entry):
        kept = F.filter(entry["items"], lambda x: ~F.exists(
            known, lambda c: (c["chronic_flag"] == entry["chronic_flag"])
            & (c["condition_name"] == x["condition_name"])))
        return F.transform(F.slice(kept, 1, k), lambda x, i: F.struct(
            x["condition_name"].alias("condition_name"),
            entry["chronic_flag"].alias("chronic_flag"),
            x["count"].alias("count"),
            (i + 1).alias("pred_rank")))
    return F.flatten(F.transform(lists, per_class))


def member_popular(members: DataFrame, features: DataFrame, popular: DataFrame,
                   k: int = POPULAR_PER_MEMBER) -> DataFrame:
    """M9: every member gets the popular list of each class minus the conditions already coded
    for them (three keys), re-ranked, first ``k`` per (member, class).

    The global lists are a scalar subquery (k_top entries per class, fewer than the rows each
    single member gets back), so no member x condition join is formed; per member the work is
    array filtering over at most k_top items per class."""
    lists = _lists_per_class(popular, [])                             # one row per class
    all_lists = lists.select(F.collect_list(F.struct("chronic_flag", "items"))).scalar()
    known = _known_per_member(features, popular)
    m = members.select("member_id").join(known, "member_id", "left") \
        .withColumn("_lists", all_lists)
    known_arr = F.coalesce(F.col("known"), F.array().cast(known.schema["known"].dataType))
    recs = m.select("member_id", F.inline(_drop_known_and_rank(F.col("_lists"), known_arr, k)))
    return recs


def segment_columns(members: DataFrame, segment: Sequence[str]) -> DataFrame:
    """Segment keys with nulls replaced by '' so they can be equi-join keys."""
    return members.select("member_id", *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                                         .alias(c) for c in segment])


def member_popular_by_segment(members: DataFrame, features: DataFrame, segment: Sequence[str],
                              k_top: int = POPULAR_TOP, k: int = POPULAR_PER_MEMBER
                              ) -> DataFrame:
    """Popularity within the member's segment (e.g. age band x gender x eligibility).
    Members join their segment's lists by an equi-join on the segment keys; the list table
    has one row per segment and is broadcast when its bytes allow."""
    seg = list(segment)
    segs = segment_columns(members, seg)
    seg_feat = known_rows(features).join(segs, "member_id")
    # bounded (segments x classes x k_top) and read twice: materialized once
    popular = small_side(popular_conditions(seg_feat, k_top, seg), "segments")
    lists = _lists_per_class(popular, seg).groupBy(*seg).agg(
        F.collect_list(F.struct("chronic_flag", "items")).alias("lists"))
    lists = small_side(lists, "segment-lists")
    known = _known_per_member_segment(seg_feat, popular, seg)
    m = segs.join(lists, seg, "inner").join(known, "member_id", "left")
    known_arr = F.coalesce(F.col("known"), F.array().cast(known.schema["known"].dataType))
    return m.select("member_id", *seg, F.inline(_drop_known_and_rank(F.col("lists"), known_arr,
                                                                     k)))


def _known_per_member_segment(seg_feat: DataFrame, popular: DataFrame, seg: list[str]
                              ) -> DataFrame:
    """Per member, the conditions of the member's segment list already coded."""
    top = popular.select(*seg, "condition_name", "chronic_flag", "pred_rank")
    hits = seg_feat.select(*KEYS3, *seg).join(top, [*seg, "condition_name", "chronic_flag"])
    return hits.groupBy("member_id").agg(
        F.collect_list(F.struct("chronic_flag", "condition_name", "pred_rank")).alias("known"))


def popular_ranks_for(pairs: DataFrame, members: DataFrame, features: DataFrame,
                      popular: DataFrame, k: int = POPULAR_PER_MEMBER) -> DataFrame:
    """The rank each (member, condition, class) row would get in ``member_popular`` (null when
    it is not in the member's first ``k``), without building the member lists:
    rank = global rank - number of more popular conditions of the class the member already has.
    Used by the evaluation, where only hold-out rows need a rank."""
    top = small_side(popular.select("condition_name", "chronic_flag",
                                    F.col("pred_rank").alias("_g")))
    known = _known_per_member(features, popular)
    who = members.select("member_id", F.lit(True).alias("_member")).join(known, "member_id",
                                                                          "left")
    x = pairs.join(top, ["condition_name", "chronic_flag"], "left").join(who, "member_id", "left")
    ahead = F.size(F.filter(
        F.coalesce(F.col("known"), F.array()),
        lambda c: (c["chronic_flag"] == F.col("chronic_flag")) & (c["pred_rank"] < F.col("_g"))))
    rank = F.when(F.col("_member") & F.col("_g").isNotNull(), F.col("_g") - ahead)
    out = x.withColumn("pred_rank", F.when(rank <= k, rank).cast("int"))
    return out.drop("_g", "_member", "known")


# ---- recommender candidates (M6, M10, M11) -------------------------------------------
def drop_known(recs: DataFrame, features: DataFrame, exclude_on: Sequence[str] = (
        "member_id", "condition_name")) -> DataFrame:
    """Keep condition products the member does not already have. By default the
    class is ignored (two keys, D8); pass the three keys to exclude per class only."""
    keys = list(exclude_on)
    known = known_rows(features).select(*keys).distinct()
    return recs.join(known, keys, "left_anti")


def gender_filter(recs: DataFrame, members: DataFrame, labels: DataFrame,
                  unlabelled: str = "drop") -> DataFrame:
    """Keep 'Both' conditions and gender-specific ones matching the member's gender.
    Conditions without a label are dropped (reference behaviour) or kept (``'keep'``)."""
    lab = small_side(labels.select("condition_name", "gender_specific"))
    x = recs.join(members.select("member_id", "gender"), "member_id", "left") \
        .join(lab, "condition_name", "left")
    gs, g = F.col("gender_specific"), F.col("gender")
    ok = (gs == "Both") | ((gs == "Male") & (g == "M")) | ((gs == "Female") & (g == "F"))
    if unlabelled == "keep":
        ok = ok | gs.isNull()
    return x.filter(ok)
