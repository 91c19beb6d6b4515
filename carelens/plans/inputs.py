"""Recommender inputs derived from the adapter views, built once per Source."""

from __future__ import annotations

import threading
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.constants import (
    ALS_ALPHA, ALS_RANK, ALS_REG, EVAL_RANKS, EXPORT_RANKS, POPULAR_PER_MEMBER, POPULAR_TOP,
)
from carelens.operators import candidates, evaluate, explain, factor, features, ids
from carelens.session import written
from carelens.sources.fixtures import Source


_LOCK = threading.RLock()


def _memo(src: Source, key: str, build):
    """Build each input once per Source, also when several fits run in threads."""
    with _LOCK:
        cache = src.__dict__.setdefault("_memo", {})
        locks = src.__dict__.setdefault("_memo_locks", {})
        lock = locks.setdefault(key, threading.RLock())
    with lock:
        if key not in cache:
            cache[key] = build()
        return cache[key]


CLAIM_COLS = ["member_id", "gender", "providerid", "condition_name", "chronic_flag", "setting",
              "service_date", "service_type", "avoidable", "paid"]


def claims(src: Source) -> DataFrame:
    """The grouped claims with gender, as written by ``written_claims`` where that was called."""
    return src.__dict__.get("_memo", {}).get("claims", src.claims_with_gender)


def written_claims(src: Source) -> DataFrame:
    """The grouped claims, joined from their tables and written once: for queries with several
    passes over them (profile, flags, history, attribution), called before any of these."""
    return _memo(src, "claims", lambda: written(
        src.claims_with_gender.select(*CLAIM_COLS), "claims"))


def history(src: Source) -> DataFrame:
    """Credibility before the hold-out cut and coding after it, one pass over the claims, written
    once because several recommender steps read columns of it. Queries that need one part only
    use the direct forms (``features.condition_credibility``, ``features.holdout_responses``)."""
    return _memo(src, "history", lambda: written(features.condition_history(
        claims(src), src.holdout_cut, src.last_service, carry=["gender"]),
        "history"))


FEATURE_COLS = ["member_id", "condition_name", "chronic_flag", "sqrt_adjusted_credibility",
                "log_adjusted_credibility"]


def tune_features(src: Source) -> DataFrame:
    return _memo(src, "tune_feat", lambda: history(src).filter(
        F.col("sqrt_adjusted_credibility").isNotNull()).select(*FEATURE_COLS))


def pred_features(src: Source) -> DataFrame:
    """Prediction features: every claim, aged from the last service date (M15 input)."""
    return _memo(src, "pred_feat", lambda: history(src).filter(
        F.col("pred_sqrt_adjusted_credibility").isNotNull()).select(
        "member_id", "condition_name", "chronic_flag",
        F.col("pred_sqrt_adjusted_credibility").alias("sqrt_adjusted_credibility"),
        F.col("pred_log_adjusted_credibility").alias("log_adjusted_credibility")))


def responses(src: Source) -> DataFrame:
    return _memo(src, "resp", lambda: history(src).filter("coded_after_cut")
                 .select("member_id", "condition_name", "chronic_flag"))


def demographics(src: Source) -> DataFrame:
    return _memo(src, "demog", lambda: features.demographic_features(src.members))


def feature_all(src: Source, which: str = "tune") -> DataFrame:
    conds = tune_features(src) if which == "tune" else pred_features(src)
    return _memo(src, f"feat_all_{which}", lambda: features.munge_features(
        demographics(src), conds).filter(F.col("chronic_flag").isNotNull()))


def user_map(src: Source, which: str = "tune") -> DataFrame:
    return _memo(src, f"user_map_{which}",
                 lambda: ids.contiguous_ids(feature_all(src, which), "member_id", "user_id"))


def product_map(src: Source, which: str = "tune") -> DataFrame:
    return _memo(src, f"prod_map_{which}", lambda: ids.contiguous_ids(
        feature_all(src, which), ["feature_name", "feature_value", "chronic_flag"], "product_id"))


def ratings(src: Source, which: str = "tune") -> DataFrame:
    """Ratings, written once: every fit of a parameter grid reads the same rows."""
    return _memo(src, f"ratings_{which}", lambda: written(ids.ratings(
        feature_all(src, which), user_map(src, which), product_map(src, which)), "ratings"))


def gender_labels(src: Source) -> DataFrame:
    return _memo(src, "labels", lambda: written(candidates.gender_labels(history(src).filter(
        F.col("sqrt_adjusted_credibility").isNotNull())), "labels"))


def new_conditions(src: Source) -> DataFrame:
    """M8 as a filter of the fused history: coded after the cut, no credibility before it."""
    return _memo(src, "new", lambda: history(src).filter(
        F.col("coded_after_cut") & F.col("sqrt_adjusted_credibility").isNull())
        .select("member_id", "condition_name", "chronic_flag"))


def popular(src: Source) -> DataFrame:
    """Top 30 per class; tiny, read by several steps, so written once."""
    return _memo(src, "popular", lambda: written(candidates.popular_conditions(
        tune_features(src), POPULAR_TOP), "popular"))


def popular_scored(src: Source) -> DataFrame:
    """Hold-out rows with their popularity rank (first 15 per member and class)."""
    return _memo(src, "pop_scored", lambda: candidates.popular_ranks_for(
        new_conditions(src), src.members, tune_features(src), popular(src),
        POPULAR_PER_MEMBER))


# ---- matrix factorization ------------------------------------------------------------------

DEFAULT_PARAMS = factor.Params(rank=ALS_RANK, alpha=ALS_ALPHA, reg=ALS_REG)


def model(src: Source, which: str = "tune", params: factor.Params = DEFAULT_PARAMS):
    return _memo(src, f"model_{which}_{params}", lambda: factor.fit(
        ratings(src, which), params, materialize=False))


def rec_ranked(src: Source, params: factor.Params = DEFAULT_PARAMS, k: int = EVAL_RANKS
               ) -> DataFrame:
    """Recommender ranks per (member, class) on the tuning data (evaluation shape)."""
    return _memo(src, f"rec_ranked_{params}_{k}", lambda: factor.recommend(
        model(src, "tune", params), user_map(src), product_map(src), tune_features(src),
        src.members, gender_labels(src), k, per_class=True).withColumnRenamed(
            "feature_value", "condition_name"))


def grid_ranked(src: Source, grid: Sequence[factor.Params]) -> dict[factor.Params, DataFrame]:
    """Of every parameter set the recommender ranks of the hold-out rows, written once: the fits
    share their passes over the ratings, and one pass over the members ranks by all of them."""
    def build():
        factors, models = factor.fit_all(ratings(src), grid)
        ranked = written(factor.recommend_all(
            models, factors, user_map(src), product_map(src), tune_features(src), src.members,
            gender_labels(src), EVAL_RANKS, new_conditions(src), per_class=True)
            .withColumnRenamed("feature_value", "condition_name"), "grid-ranked")
        return {p: ranked.filter(F.col("fit") == f) for f, p in enumerate(grid)}
    return _memo(src, f"grid_ranked_{grid}", build)


def rec_scored(src: Source, params: factor.Params = DEFAULT_PARAMS,
               ranked: DataFrame | None = None) -> DataFrame:
    return evaluate.attach_ranks(new_conditions(src), rec_ranked(src, params)
                                 if ranked is None else ranked)


def predictions(src: Source, params: factor.Params = DEFAULT_PARAMS, k: int = EXPORT_RANKS
                ) -> DataFrame:
    """M15 + M12: refit on all data (own id maps), top ``k`` per member for export."""
    return _memo(src, f"preds_{params}_{k}", lambda: factor.recommend(
        model(src, "pred", params), user_map(src, "pred"), product_map(src, "pred"),
        pred_features(src), src.members, gender_labels(src), k, per_class=False))


def explanations(src: Source, params: factor.Params = DEFAULT_PARAMS) -> DataFrame:
    """Contributions behind every member's highest-rated condition."""
    top1 = predictions(src, params).filter(F.col("pred_rank") == 1)
    pm = product_map(src, "pred")
    targets = (top1.join(user_map(src, "pred"), "member_id")
               .join(pm, ["feature_name", "feature_value", "chronic_flag"])
               .select("user_id", "product_id"))
    c = explain.contributions(model(src, "pred", params), ratings(src, "pred"), targets, params,
                              user_map(src, "pred"))
    return explain.named_contributions(c, user_map(src, "pred"), pm)
