"""The registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the supplied tables in full (through the adapter views); none is limited to a
subset of ids or rows. Result columns carry the same names as the SQL oracle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.operators import (
    boosting, candidates, casestudy, cost, evaluate, explain, factor, features, gaps, ids,
    neighbours, summary, tune,
)
from carelens.plans import inputs
from carelens.session import ensure_checkpoint_dir, scratch_path, written
from carelens.sources.fixtures import MEASURES, Source
from carelens.operators.util import rank_top
from carelens.sources.tables import (
    convert_to_parquet, export_explanations, export_predictions, export_small_tables, kept, peek,
    read_delimited, row_count,
)
from carelens.constants import (
    EVAL_RANKS, EXPORT_RANKS, POPULAR_PER_MEMBER, RECALL_K, REFERENCE_EXPORT_CANDIDATES,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        return fn(Source(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


# ---- discharge summaries (S1, S10, S11, A1-A3, J5, J13, O1, O2, F1) --------------------
@query
def discharge_count(src: Source) -> DataFrame:
    """Number of discharges."""
    return row_count(src.discharges)


@query
def discharge_peek(src: Source) -> DataFrame:
    """First ten (lob, los) rows in discharge order."""
    return peek(src.discharges, ["lob", "los"], 10, ["discharge_id", "lob", "los"])


@query
def los_by_lob_sql(src: Source) -> DataFrame:
    """A1: stays and average length of stay per line of business, as SQL on a named view."""
    src.discharges.createOrReplaceTempView("discharge")
    return summary.los_by_sql(src.spark, "discharge", "lob")


@query
def los_by_lob(src: Source) -> DataFrame:
    """A2/A3: the same summary with the DataFrame API and a reusable aggregate list."""
    return summary.los_by(src.discharges, ["lob"])


@query
def los_by_provider(src: Source) -> DataFrame:
    """Left join to providers, grouped by provider name (null group kept)."""
    return summary.los_by_provider(src.discharges, src.providers)


@query
def los_by_provider_top10(src: Source) -> DataFrame:
    """O2: the ten providers with most stays."""
    return summary.top_n(summary.los_by_provider(src.discharges, src.providers), 10,
                         [F.desc("row_cnt"), F.asc_nulls_first("providername")])


# ---- recommender features (T1-T4, M1-M3) -------------------------------------------------


def longs(df: DataFrame) -> DataFrame:
    """Integer columns as bigint, so both engines report the same column types."""
    return df.select(*[F.col(f.name).cast("bigint").alias(f.name)
                       if f.dataType.typeName() in ("integer", "short", "byte") else F.col(f.name)
                       for f in df.schema.fields])


@query
def condition_claims(src: Source) -> DataFrame:
    """Claim lines grouped to condition categories and chronic classes."""
    return src.claims.select(
        "member_id", "providerid", "diagnosis", "condition_name", "chronic_flag", "setting",
        F.date_format("service_date", "yyyy-MM-dd").alias("service_date"), "service_type",
        "drug", "avoidable", "paid")


@query
def condition_credibility(src: Source) -> DataFrame:
    """Decayed, setting-weighted credibility per member and condition (tuning cut); the
    date cut reaches the scan."""
    return features.condition_credibility(src.claims, src.holdout_cut).select(*inputs.FEATURE_COLS)


@query
def demographic_features(src: Source) -> DataFrame:
    """Demographics in long form with constant confidence."""
    return inputs.demographics(src)


@query
def holdout_responses(src: Source) -> DataFrame:
    """T4: conditions coded in the two months after the cut; the date cut reaches the scan."""
    return features.holdout_responses(src.claims, src.holdout_cut)


@query
def feature_all(src: Source) -> DataFrame:
    """M1: condition and demographic features stacked by name."""
    return inputs.feature_all(src)


@query
def user_ids(src: Source) -> DataFrame:
    """M2: members numbered 1..n in key order."""
    return longs(inputs.user_map(src))


@query
def product_ids(src: Source) -> DataFrame:
    """M2: products (feature name, value, class) numbered 1..n in key order."""
    return longs(inputs.product_map(src))


@query
def rating_matrix(src: Source) -> DataFrame:
    """M3: (user, product, confidence) coordinates for the factorization."""
    return longs(inputs.ratings(src))


# ---- popularity baseline and evaluation (M7-M9, M13, M20, T6, T8, W1, W2) -----------------
@query
def gender_labels(src: Source) -> DataFrame:
    """M7: gender-specific condition labels."""
    return inputs.gender_labels(src).select(
        "condition_name", F.round("avg_males", 6).alias("avg_males"),
        F.round("avg_females", 6).alias("avg_females"), "gender_specific")


@query
def new_conditions(src: Source) -> DataFrame:
    """M8: hold-out conditions not coded in the tuning period (three keys)."""
    return inputs.new_conditions(src)


@query
def popular_conditions(src: Source) -> DataFrame:
    """The 30 most frequent conditions per class."""
    return longs(inputs.popular(src))


@query
def member_popular(src: Source) -> DataFrame:
    """M9: per member and class, the popular conditions not yet coded, first 15."""
    return longs(candidates.member_popular(src.members, inputs.tune_features(src),
                                           inputs.popular(src), POPULAR_PER_MEMBER))


@query
def popular_by_segment(src: Source) -> DataFrame:
    """Popularity within the member's age band x gender x eligibility segment."""
    seg = ["age_band", "gender", "eligibility_status"]
    from carelens.operators.features import age_band
    members = src.members.withColumn("age_band", age_band())
    return longs(candidates.member_popular_by_segment(members, inputs.tune_features(src), seg))


@query
def popular_curve(src: Source) -> DataFrame:
    """M13 for the popularity model: hit share and recall@k per class and rank."""
    return longs(evaluate.recall_curve(inputs.popular_scored(src), "popular"))


@query
def popular_recall_at_10(src: Source) -> DataFrame:
    """T6 for the popularity model."""
    return longs(evaluate.recall_at_k(inputs.popular_scored(src), "popular", 10))


@query
def eval_chart(src: Source) -> DataFrame:
    """Chart-ready curve with display labels."""
    return longs(evaluate.chart_table(evaluate.recall_curve(inputs.popular_scored(src),
                                                            "popular")))


# ---- matrix factorization (M4-M6, M10-M17, T5-T7, O4) ---------------------------------------


@query
def als_eval_curve(src: Source) -> DataFrame:
    """Recommender and popularity curves stacked (model output: rows-only check)."""
    rec = evaluate.recall_curve(inputs.rec_scored(src), "recommender")
    pop = evaluate.recall_curve(inputs.popular_scored(src), "popular")
    return longs(rec.unionByName(pop))


@query
def als_recall_at_10(src: Source) -> DataFrame:
    """recall@10 of the recommender next to the popularity model."""
    return longs(evaluate.recall_at_k(inputs.rec_scored(src), "recommender", 10).unionByName(
        evaluate.recall_at_k(inputs.popular_scored(src), "popular", 10)))


@query
def als_predictions(src: Source) -> DataFrame:
    """Final refit on all data, ten filtered recommendations per member."""
    return longs(inputs.predictions(src).select(
        "member_id", "feature_value", "feature_name", "chronic_flag", "rating", "pred_rank"))


def _grid_results(src: Source) -> DataFrame:
    """Recall@10 on the hold-out of every parameter set of the grid."""
    grid = tune.param_grid([10, 50], [40.0, 100.0], [1.0, 7.0])

    ranked = inputs.grid_ranked(src, grid)        # all fits share their passes

    def score(p):
        return inputs.rec_scored(src, p, ranked[p]).agg(
            F.avg(F.when(F.col("pred_rank") <= 10, 1).otherwise(0))).first()[0]

    return tune.run_grid(src.spark, grid, score, parallelism=2)


@query
def structural_misses(src: Source) -> DataFrame:
    """Newly coded conditions per class, and those of them that excluding known conditions by
    name alone makes unreachable, for the member has the name under the other class."""
    known = inputs.tune_features(src).select(
        "member_id", "condition_name", F.lit(1).alias("_held")).distinct()
    return longs(inputs.new_conditions(src).join(known, ["member_id", "condition_name"], "left")
                 .groupBy("chronic_flag").agg(
                     F.count("*").alias("new_conditions"),
                     F.coalesce(F.sum("_held"), F.lit(0)).alias("structural_misses")))


@query
def als_literal_predictions(src: Source) -> DataFrame:
    """M5/P15 in the original order: the top 30 of all products per member, then the filters, then
    ten ranks; members may get fewer."""
    return longs(factor._recommend_from_top_n(
        inputs.model(src, "pred"), inputs.user_map(src, "pred"), inputs.product_map(src, "pred"),
        inputs.pred_features(src), src.members, inputs.gender_labels(src), EXPORT_RANKS, False,
        False, "drop", REFERENCE_EXPORT_CANDIDATES))


# ---- the recommender per population (T25) ------------------------------------------------------
POPULATION = "eligibility_status"


def _population_maps(src: Source) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Features with their member's population, and the id maps numbered within populations; one
    job serves all populations."""
    def build():
        rows = written(inputs.feature_all(src).join(
            src.members.select("member_id", POPULATION), "member_id"), "population-features")
        users = written(ids.grouped_ids(rows, POPULATION, "member_id", "user_id"),
                        "population-users")
        products = written(ids.grouped_ids(
            rows, POPULATION, ["feature_name", "feature_value", "chronic_flag"], "product_id"),
            "population-products")
        return rows, users, products
    return inputs._memo(src, "population_maps", build)


def _population_holdout(src: Source) -> DataFrame:
    return inputs._memo(src, "population_holdout", lambda: written(
        inputs.new_conditions(src).join(src.members.select("member_id", POPULATION), "member_id"),
        "population-holdout"))


@query
def population_ids(src: Source) -> DataFrame:
    """Member ids of the recommender, contiguous within every population."""
    return longs(_population_maps(src)[1])


@query
def population_sizes(src: Source) -> DataFrame:
    """Members, products, ratings and hold-out rows of every population."""
    rows, users, products = _population_maps(src)
    parts = [("users", users), ("products", products), ("ratings", rows),
             ("holdout", _population_holdout(src))]
    every = None
    for name, df in parts:
        own = df.groupBy(POPULATION).agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
        every = own if every is None else every.unionByName(own)
    return longs(every.groupBy(POPULATION).agg(*[
        F.sum(F.when(F.col("part") == name, F.col("n")).otherwise(0)).alias(name)
        for name, _ in parts]))


@query
def population_calibration(src: Source) -> DataFrame:
    """T25 for the recommender: every parameter set scored on each population's own hold-out,
    fitted on its own members, the best set of each flagged."""
    rows, users, products = _population_maps(src)
    holdout, labels = _population_holdout(src), inputs.gender_labels(src)
    grid = tune.param_grid([10], [40.0, 100.0], [1.0, 7.0])
    groups = [r[0] for r in users.select(POPULATION).distinct().orderBy(POPULATION).collect()]

    def own(df, value):
        return df.filter(F.col(POPULATION).eqNullSafe(F.lit(value))).drop(POPULATION)

    def shared(value):
        """Ratings and known conditions of a population, written once for all its fits."""
        known = own(rows, value).filter(F.col("feature_name") == "condition_name").select(
            "member_id", F.col("feature_value").alias("condition_name"), "chronic_flag")
        return (written(ids.ratings(own(rows, value), own(users, value), own(products, value)),
                        "population-ratings"),
                written(factor.known_lists(known), "population-known"))

    held = dict(zip(groups, boosting._parallel_map(shared, groups, 3)))

    def score(job):
        value, params = job
        rated, known = held[value]
        model = factor.fit(rated, params, materialize=False)
        ranked = factor.recommend(
            model, own(users, value), own(products, value), known, src.members, labels,
            EVAL_RANKS, per_class=True).withColumnRenamed("feature_value", "condition_name")
        found = evaluate.attach_ranks(own(holdout, value), ranked).agg(
            F.avg(F.when(F.col("pred_rank") <= RECALL_K, 1).otherwise(0))).first()[0]
        return (value, params.rank, params.alpha, params.reg, float(found or 0.0))

    jobs = [(value, params) for value in groups for params in grid]
    scored = src.spark.createDataFrame(
        boosting._parallel_map(score, jobs, 3),
        f"{POPULATION} string, rank int, alpha double, lambda double, score double")
    first = rank_top(scored, [POPULATION], [F.desc("score"), F.asc("rank"), F.asc("alpha"),
                                            F.asc("lambda")], None, "_place")
    return longs(first.select(POPULATION, "rank", "alpha", "lambda", "score",
                              (F.col("_place") == 1).alias("best")))


@query
def als_tuned_predictions(src: Source) -> DataFrame:
    """M14 -> M15: the grid's winner refitted on all data, ten recommendations per member."""
    best = tune.best_params(_grid_results(src))
    return longs(inputs.predictions(src, best).select(
        "member_id", "feature_value", "feature_name", "chronic_flag", "rating", "pred_rank"))


@query
def als_tuning(src: Source) -> DataFrame:
    """Grid of parameter sets scored by recall@10 on the hold-out; best one flagged."""
    results = _grid_results(src)
    best = tune.best_params(results)
    return longs(results.withColumn("best", (F.col("rank") == best.rank)
                                    & (F.col("alpha") == best.alpha)
                                    & (F.col("lambda") == best.reg)))


@query
def als_explanations(src: Source) -> DataFrame:
    """Feature contributions to each member's top recommendation."""
    return inputs.explanations(src)


@query
def als_sample_explanations(src: Source) -> DataFrame:
    """M17 as published: for a seeded sample of ten members, what every product b contributes to
    every other product a, exported under the hyper-parameters and read back."""
    params, pm = inputs.DEFAULT_PARAMS, inputs.product_map(src, "pred")
    users = inputs.user_map(src, "pred")
    products = pm.select(F.collect_list("product_id")).scalar()     # the condition taxonomy
    targets = explain.sample_members(users, 10).select("user_id",
                                                       F.explode(products).alias("product_id"))
    found = explain.contributions(inputs.model(src, "pred", params), inputs.ratings(src, "pred"),
                                  targets, params, users).filter("product_a <> product_b")
    path = scratch_path(src.spark, "sample-explanations")
    export_explanations(explain.named_contributions(found, users, pm), path, params.rank,
                        params.alpha, params.reg)
    return longs(src.spark.read.parquet(path))


@query
def suspicious_codings(src: Source) -> DataFrame:
    """Coded conditions with a rating in the lowest 5% of their condition."""
    m = inputs.model(src)
    rated = factor.known_ratings(m, inputs.user_map(src), inputs.product_map(src),
                                 inputs.tune_features(src))
    return factor.suspicious_codings(rated)


# ---- sources, case study, gaps (S2, M19, P10, J9, T11, T12) -----------------------------------


@query
def procedure_reference(src: Source) -> DataFrame:
    """A pipe-delimited reference file with a header, read with type inference. The file is
    written from the part table into the shared scratch folder first."""
    path = scratch_path(src.spark, "procref")
    (src.table("part").select(F.col("p_name").alias("PROC_DESC"),
                              F.col("p_type").alias("MR_LINE_DESC"),
                              F.col("p_size").alias("MR_LINE_SIZE"))
     .write.option("sep", "|").option("header", True).csv(path))
    return read_delimited(src.spark, path, sep="|", header=True).select(
        "PROC_DESC", "MR_LINE_DESC", F.col("MR_LINE_SIZE").cast("bigint").alias("MR_LINE_SIZE"))


@query
def case_study_features(src: Source) -> DataFrame:
    """All tuning features of members coded with the most common chronic
    condition at a credibility above 1."""
    feats = inputs.tune_features(src)
    top = inputs.popular(src).filter((F.col("chronic_flag") == "1") & (F.col("pred_rank") == 1))
    chosen = casestudy.members_with_condition(feats, top, 1.0)
    return casestudy.extract_for(feats, chosen)


@query
def case_study_predictions(src: Source) -> DataFrame:
    """Exported recommendations of the case-study members (semi-join, no fan-out)."""
    feats = inputs.tune_features(src)
    top = inputs.popular(src).filter((F.col("chronic_flag") == "1") & (F.col("pred_rank") == 1))
    chosen = casestudy.members_with_condition(feats, top, 1.0)
    return longs(casestudy.extract_for(inputs.predictions(src), chosen))


@query
def explicit_gaps(src: Source) -> DataFrame:
    """Conditions coded in the prior year but not in the last year."""
    g = gaps.explicit_gaps(src.claims, src.holdout_cut, 12)
    return g.withColumn("last_coded", F.date_format("last_coded", "yyyy-MM-dd"))


@query
def drug_gaps(src: Source) -> DataFrame:
    """Drug-implied conditions not coded in the last year."""
    return gaps.drug_gaps(src.claims, src.drug_conditions, src.holdout_cut, 12)


# ---- six-month cost and utilization (T13-T15, T20-T24) --------------------------------------
def _claims_net(src: Source) -> DataFrame:
    return cost.with_network(inputs.claims(src).drop("gender"), src.providers)


def _profile(src: Source) -> DataFrame:
    """Per-member claims profile (conditions, prior year, next six months): one pass over the
    claims."""
    return inputs._memo(src, "profile", lambda: cost.member_profile(
        inputs.claims(src), src.outcome_cut, 12, 6))


def _profiled(src: Source) -> None:
    """Write the profile, for queries in which both features and outcomes read it."""
    profile = _profile(src)
    if "_written_profile" not in src.__dict__:
        src.__dict__["_memo"]["profile"] = written(profile, "profile")
        src.__dict__["_written_profile"] = True


def _model_inputs(src: Source) -> None:
    """Write the claims and the profile: the models' features read the claims three times more.
    Called before anything is built from them, or the unwritten forms would be read again."""
    inputs.written_claims(src)
    _profiled(src)


def _member_features(src: Source) -> DataFrame:
    return inputs._memo(src, "member_features", lambda: cost.member_features(
        src.members, _profile(src), src.measurements, src.measures))


def _outcomes(src: Source) -> DataFrame:
    return inputs._memo(src, "outcomes", lambda: cost.outcomes(_profile(src), src.members))


@query
def period_summary(src: Source) -> DataFrame:
    """Cost and visits per member and quarter by avoidable / network / setting."""
    s = cost.period_summary(_claims_net(src), "quarter")
    return s.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query
def period_summary_month(src: Source) -> DataFrame:
    """T13 at month grain."""
    s = cost.period_summary(_claims_net(src), "month")
    return s.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


@query
def period_service_types(src: Source) -> DataFrame:
    """T13 by type of service: cost and claims per member, quarter and service type."""
    period = F.date_trunc("quarter", "service_date")
    return (src.claims.groupBy("member_id", F.date_format(period, "yyyy-MM-dd").alias("period"),
                               "service_type")
            .agg(F.round(F.sum("paid"), 4).alias("paid_total"),
                 F.count(F.lit(1)).alias("n_claims")))


@query
def period_service_pivot(src: Source) -> DataFrame:
    """T13 by type of service, wide: cost per member and quarter, one column a type."""
    s = cost.period_service_pivot(src.claims, _service_types(src))
    return s.withColumn("period", F.date_format("period", "yyyy-MM-dd"))


def _service_types(src: Source) -> list[str]:
    return inputs._memo(src, "service_types", lambda: cost.service_types(src.diagnosis_grouping))


@query
def member_feature_vector(src: Source) -> DataFrame:
    """The models' feature row as (index, value) pairs of its non-zero places: the columns,
    prior cost by network and type of service, then a flag per condition and class."""
    vector = vector_to_array("features")
    return _model_frame(src).select("member_id", F.posexplode(vector).alias("index", "value")) \
        .filter("value <> 0").select("member_id", F.col("index").cast("bigint").alias("index"),
                                     "value")


@query
def programme_benchmark(src: Source) -> DataFrame:
    """T24 per programme: six-month cost while enrolled vs the prior-year run rate of the enrolled
    days (interval join by member and month)."""
    return longs(cost.programme_benchmark(
        src.claims, cost.merged_intervals(src.enrolments), _member_features(src),
        src.outcome_cut))


@query
def member_history(src: Source) -> DataFrame:
    """Prior-year cost and claims per member by network and type of service, long form."""
    cut = F.to_date(F.lit(src.outcome_cut))
    prior = _claims_net(src).filter((F.col("service_date") > F.add_months(cut, -12))
                                    & (F.col("service_date") <= cut))
    return prior.groupBy("member_id", "in_network", "service_type").agg(
        F.round(F.sum("paid"), 4).alias("prior_cost"), F.count(F.lit(1)).alias("prior_claims"))


@query
def member_condition_flags(src: Source) -> DataFrame:
    """The condition-category flags of every member as one sorted array of (condition,
    class) names, built from the data (joined to text for comparison)."""
    hist = src.claims.filter(F.col("service_date") <= F.to_date(F.lit(src.outcome_cut)))
    flags = hist.groupBy("member_id").agg(F.array_sort(F.collect_set(
        F.concat_ws(":", "condition_name", "chronic_flag"))).alias("flags"))
    return src.members.select("member_id").join(flags, "member_id", "left").select(
        "member_id", F.coalesce(F.size("flags"), F.lit(0)).cast("bigint").alias("n_flags"),
        F.coalesce(F.array_join("flags", "|"), F.lit("")).alias("flags"))


@query
def member_features(src: Source) -> DataFrame:
    """One feature row per member with missing-value indicators."""
    return longs(_member_features(src))


@query
def six_month_outcomes(src: Source) -> DataFrame:
    """Outcomes in the six months after the cut, zero-filled."""
    return longs(_outcomes(src))


BASELINES = ["risk_score", "prior_cost", "prior_avoidable"]        # T22 rankings
LEVELS = [0.01, 0.05, 0.1, 0.2, 0.5, 1.0]                          # top X shares


@query
def capture_curve(src: Source) -> DataFrame:
    """Share of the actual top X% (six-month avoidable cost) found by each baseline."""
    _profiled(src)
    return cost.capture_curves(_outcomes(src), _member_features(src), "cost_avoidable", BASELINES,
                               LEVELS)


@query
def capture_curve_model(src: Source) -> DataFrame:
    """T21 with the boosted model's out-of-fold ranking next to the baselines."""
    _model_inputs(src)
    scored = _member_features(src).select("member_id", *BASELINES).join(
        _expected(src, "cost_avoidable").withColumnRenamed("pred", "model"), "member_id")
    return cost.capture_curves(_outcomes(src), scored, "cost_avoidable", [*BASELINES, "model"],
                               LEVELS)


@query
def priority_list(src: Source) -> DataFrame:
    """The 25 members with the highest prior-year cost."""
    return cost.priority_list(_member_features(src).select("member_id", "prior_cost"),
                              "prior_cost", 25)


@query
def priority_outliers(src: Source) -> DataFrame:
    """The 25 members with the largest predicted outlier size (out-of-fold 90th-percentile
    cost)."""
    return cost.priority_list(_outlier_size(src), "cost_q90", 25)


@query
def provider_benchmark(src: Source) -> DataFrame:
    """Actual six-month cost vs the prior-year run rate, per attributed provider."""
    _profiled(src)
    hist = src.claims.filter(F.col("service_date") <= F.to_date(F.lit(src.outcome_cut)))
    pred = _member_features(src).select("member_id", (F.col("prior_cost") / 2).alias("pred"))
    return cost.provider_benchmark(_outcomes(src), pred, cost.attributed_provider(hist),
                                   "cost_total", "pred")


# ---- neighbour-based filtering (T9, T10) ------------------------------------------------------
@query
def item_based_recs(src: Source) -> DataFrame:
    """Ten uncoded conditions per member by summed cosine similarity to coded ones."""
    return longs(neighbours.item_based(inputs.tune_features(src), 10))


@query
def user_based_recs(src: Source) -> DataFrame:
    """Ten uncoded conditions per member voted by cosine-similar members."""
    return longs(neighbours.user_based(inputs.tune_features(src), 10))


@query
def nearest_member_recs(src: Source) -> DataFrame:
    """T9 with a neighbour cut: ten uncoded conditions per member, voted by its ten nearest members
    of a cosine of at least one half."""
    return longs(neighbours.nearest_based(inputs.tune_features(src), 0.5, 10, 10))


@query
def item_based_filtered(src: Source) -> DataFrame:
    """M10/M11/J8/P8/W3/W4 on a deterministic score: item-based scores of all conditions a member
    lacks, known conditions dropped whatever their class, gender-specific ones kept for that
    gender, ten per member and class."""
    known = inputs.tune_features(src)
    scored = neighbours.item_based(known, None).drop("pred_rank")
    allowed = candidates.gender_filter(candidates.drop_known(scored, known), src.members,
                                       inputs.gender_labels(src))
    ranked = rank_top(allowed.withColumn("_key", F.round("score", 6)),
                      ["member_id", "chronic_flag"], [F.desc("_key"), F.asc("condition_name")],
                      10)
    return longs(ranked.select("member_id", "condition_name", "chronic_flag", "score",
                               "pred_rank"))


@query
def low_ratings(src: Source) -> DataFrame:
    """T5/T7/F8 on given vectors: the supplied embeddings as factors, each vector rated against
    the first vector of its label; the ratings in the lowest 5 % of their label."""
    e = src.table("embeddings").select("vec_id", F.col("label").cast("string").alias("label"),
                                       F.col("embedding").cast("array<double>").alias("v"))
    first = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("u"))
    rated = e.join(first, "label").select(
        "vec_id", F.col("label").alias("condition_name"), F.lit("1").alias("chronic_flag"),
        F.round(factor.dot("u", "v"), 9).alias("rating"))
    return factor.suspicious_codings(rated).select("vec_id", F.col("condition_name").alias("label"),
                                                   F.round("rating", 6).alias("rating"))


# ---- boosted trees (T16-T20, T25, T26) ---------------------------------------------------------

MODEL_COLUMNS = ["age", "male", "gender_missing", "risk_score", "n_conditions", "n_chronic",
                 "prior_cost", "prior_avoidable", "prior_ip", "prior_er", "prior_claims",
                 *[f"last_{m}" for m in MEASURES], *[f"last_{m}_missing" for m in MEASURES]]


def _model_frame(src: Source) -> DataFrame:
    """Member features + six-month outcomes as a model frame with a feature vector, written once
    for the passes of the fits."""
    _model_inputs(src)
    return inputs._memo(src, "model_frame", lambda: written(_assembled(
        src, _member_features(src).join(_outcomes(src), "member_id")), "model-frame"))


def _assembled(src: Source, members: DataFrame) -> DataFrame:
    """``members`` with the whole feature row: their columns, prior cost by network and type
    of service, and condition flags as a sparse vector over the vocabulary of the data."""
    types = _service_types(src)
    wide = cost.history_columns(types)
    flags = written(cost.condition_flags(inputs.claims(src), src.outcome_cut), "condition-flags")
    history = cost.history_wide(_claims_net(src), src.outcome_cut, types)
    rows = members.join(history, "member_id", "left").fillna(0.0, wide).join(
        flags, "member_id", "left")
    vectors = cost.flag_vectors(rows, cost.flag_vocabulary(flags))
    return boosting.assemble(vectors, [*MODEL_COLUMNS, *wide], vectors=["flag_vector"]).drop(
        "flags", "flag_vector")


def _expected(src: Source, label: str) -> DataFrame:
    """Out-of-fold expected cost per member (boosted trees)."""
    def predict(train, rest):
        m = boosting.cost_model(label, trees=20, depth=4).fit(train)
        return m.transform(rest).select("member_id", F.col("prediction").alias("pred"))

    return boosting.out_of_fold(_model_frame(src).select("member_id", label, "features"), predict,
                                parallelism=2)


def _outlier_size(src: Source) -> DataFrame:
    """Out-of-fold 90th percentile of six-month cost per member."""
    def predict(train, rest):
        m = boosting.quantile_boost(train, "cost_total", tau=0.9, trees=8, depth=3)
        return m.predict(rest).select("member_id", "cost_total",
                                      F.col("prediction").alias("cost_q90"))

    return boosting.out_of_fold(_model_frame(src).select("member_id", "cost_total", "features"),
                                predict)


@query
def ip_event_model(src: Source) -> DataFrame:
    """Out-of-fold boosted-tree probability of an inpatient stay in the next six
    months."""
    def predict(train, rest):
        m = boosting.event_model(train, "any_ip", trees=20, depth=4).fit(train)
        return boosting.probability(m.transform(rest)).select("member_id", "any_ip", "prob")

    return boosting.out_of_fold(_model_frame(src).select("member_id", "any_ip", "features"),
                                predict)


@query
def er_repeated_cv(src: Source) -> DataFrame:
    """Repeated 3-fold cross-validation for the ER-visit probability; the tree count with
    the lowest mean fold loss is used and out-of-fold predictions averaged over repeats."""
    return longs(boosting.repeated_kfold(_model_frame(src), "any_er", k=3, repeats=2, trees=15,
                                         depth=3, parallelism=3))


@query
def cost_quantile_model(src: Source) -> DataFrame:
    """90th-percentile six-month cost by quantile-loss boosting on random subspaces,
    out of fold."""
    return _outlier_size(src)


@query
def cost_distribution(src: Source) -> DataFrame:
    """The cost distribution of every member out of fold, from one ensemble whose leaves hold
    quantile summaries; the quantiles are read from it and never cross."""
    taus = [0.5, 0.75, 0.9]

    def predict(train, rest):
        forest = boosting.quantile_forest(train, "cost_total", trees=10, depth=4)
        out = forest.distribution(rest)
        return out.select("member_id", "cost_total",
                          *[forest.read("distribution", t).alias(f"q{int(100 * t)}")
                            for t in taus])

    return boosting.out_of_fold(_model_frame(src).select("member_id", "cost_total", "features"),
                                predict, parallelism=2)


@query
def population_models(src: Source) -> DataFrame:
    """One inpatient-probability model per eligibility population."""
    return boosting.per_population(_model_frame(src), "eligibility_status", "any_ip",
                                   trees=10, depth=3, parallelism=3)


@query
def condition_models(src: Source) -> DataFrame:
    """A logistic regression per (condition, class) of the whole popular list, predicting a
    new coding in the hold-out (the conventional comparator of the recommender), out of fold."""
    inputs.written_claims(src)
    feats = _assembled(src, _member_features(src).fillna(0.0))
    conds = [(r["condition_name"], r["chronic_flag"]) for r in inputs.popular(src)
             .orderBy("chronic_flag", "pred_rank").collect()]
    return boosting.per_condition(feats, inputs.new_conditions(src), conds)


@query
def prediction_features(src: Source) -> DataFrame:
    """M15 input: credibility over every claim, aged from the last service date."""
    return inputs.pred_features(src)


@query
def eval_chart_from_file(src: Source) -> DataFrame:
    """S5/S9 + M20: the evaluation curve saved as Parquet, read back and labelled."""
    path = scratch_path(src.spark, "evaluation")
    evaluate.save_evaluation(evaluate.recall_curve(inputs.popular_scored(src), "popular"), path)
    return longs(evaluate.chart_table(evaluate.load_evaluation(src.spark, path)))


CONVERTED = ["customer", "supplier", "part"]


@query
def bulk_conversion(src: Source) -> DataFrame:
    """S3: every delimited input under a folder converted to Parquet under its own schema, then
    rows, columns and a checksum per input. The inputs are three whole tables, written as text
    into the shared scratch folder first."""
    base = scratch_path(src.spark, "convert")
    for name in CONVERTED:
        (src.table(name).write.option("sep", "|").option("header", True)
         .option("quoteAll", True).csv(f"{base}/in/{name}"))
    out = convert_to_parquet(src.spark, f"{base}/in/*/*.csv", f"{base}/out", "csv",
                             {"sep": "|", "header": True, "inferSchema": True},
                             source_regex=r"/in/([^/]+)/")
    keys = {"customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"),
            "part": ("p_partkey", "p_name")}
    rows = [out[n].agg(F.lit(n).alias("source"), F.count(F.lit(1)).alias("rows"),
                       F.lit(len(out[n].columns)).cast("bigint").alias("columns"),
                       F.sum(F.col(keys[n][0]).cast("bigint")).alias("key_sum"),
                       F.sum(F.length(keys[n][1])).alias("name_chars"))
            for n in CONVERTED if n in out]
    result = rows[0]
    for r in rows[1:]:
        result = result.unionByName(r)
    return result


@query
def provider_benchmark_model(src: Source) -> DataFrame:
    """T24 with a model: actual six-month cost vs out-of-fold boosted-tree expected cost per
    attributed provider."""
    pred = _expected(src, "cost_total")
    hist = inputs.claims(src).filter(F.col("service_date") <= F.to_date(F.lit(src.outcome_cut)))
    return cost.provider_benchmark(_outcomes(src), pred, cost.attributed_provider(hist),
                                   "cost_total", "pred")


# ---- writers, read back (S4, S6, S7, S8, P11) ---------------------------------------------------
@query
def exported_predictions(src: Source) -> DataFrame:
    """Ranked predictions (the item-based ones, which are deterministic) exported and read
    back."""
    path = scratch_path(src.spark, "predictions")
    recs = neighbours.item_based(inputs.tune_features(src), 10)
    export_predictions(recs.select(
        "member_id", F.col("condition_name").alias("feature_value"),
        F.lit("condition_name").alias("feature_name"), "chronic_flag",
        F.col("score").alias("rating"), "pred_rank"), path)
    return longs(src.spark.read.parquet(path))


@query
def exported_explanations(src: Source) -> DataFrame:
    """The model's explanations of every member's best product, exported under the
    hyper-parameters and read back: per explained member the products it rated, and whether the
    contributions with the residual give back the explained rating."""
    path, params = scratch_path(src.spark, "explanations"), inputs.DEFAULT_PARAMS
    export_explanations(inputs.explanations(src), path, params.rank, params.alpha, params.reg)
    rows = src.spark.read.parquet(path)
    gap = F.abs(F.sum("weight") + F.max("residual_a") - F.max("rating_a"))
    return longs(rows.groupBy("member_id", "rank", "alpha", "lambda").agg(
        F.count("*").alias("rated"), (gap <= 1e-6).alias("explained"))).select(
        "member_id", "rank", F.col("alpha").cast("double").alias("alpha"),
        F.col("lambda").cast("double").alias("lambda"), "rated", "explained")


@query
def exported_case_study(src: Source) -> DataFrame:
    """Three tables of hand-picked members (the ten with most claims), their demographics,
    their features and their recommendations (item-based, which are deterministic), exported as
    delimited text each, read back and stacked."""
    path = scratch_path(src.spark, "case-study")
    picked = [r["member_id"] for r in (
        src.claims.groupBy("member_id").agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "member_id").limit(10).collect())]            # ten rows
    known = inputs.tune_features(src)
    tables = {
        "members": inputs.demographics(src).select(
            "member_id", F.col("feature_name").alias("item"), F.col("feature_value").alias("class"),
            F.col("confidence").cast("double").alias("value")),
        "features": known.select(
            "member_id", F.col("condition_name").alias("item"), F.col("chronic_flag").alias("class"),
            F.col("sqrt_adjusted_credibility").cast("double").alias("value")),
        "recommendations": neighbours.item_based(known, 10).select(
            "member_id", F.col("condition_name").alias("item"), F.col("chronic_flag").alias("class"),
            F.col("score").cast("double").alias("value"))}
    export_small_tables({n: casestudy.chosen(t, picked) for n, t in tables.items()}, path)
    out = None
    for name in tables:
        one = read_delimited(src.spark, f"{path}/{name}", sep=",", schema=(
            "member_id bigint, item string, class string, value double")).withColumn(
            "source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query
def persisted_claims(src: Source) -> DataFrame:
    """The claims kept for two aggregates, per setting and per class, and released."""
    with kept(src.claims.select("setting", "chronic_flag", "paid")) as claims:
        def total(col):
            return claims.groupBy(F.lit(col).alias("by"), F.col(col).alias("value")).agg(
                F.count("*").alias("n_claims"), F.round(F.sum("paid"), 2).alias("paid"))

        return written(total("setting").unionByName(total("chronic_flag")), "claim-totals")


# ---- what SQL can say about model outputs -------------------------------------------------------
@query
def event_model_labels(src: Source) -> DataFrame:
    """Every member of the event model's output, its label, and whether the probability is
    one."""
    return longs(QUERIES["ip_event_model"](src.spark, src.base_dir).select(
        "member_id", "any_ip", F.col("prob").between(0.0, 1.0).alias("is_probability")))


@query
def fold_members(src: Source) -> DataFrame:
    """Members with an averaged out-of-fold probability, and those that have one in range."""
    return QUERIES["er_repeated_cv"](src.spark, src.base_dir).agg(
        F.count("*").alias("members"), F.countDistinct("member_id").alias("distinct_members"),
        F.sum(F.col("prob").between(0.0, 1.0).cast("bigint")).alias("in_range"))


@query
def population_model_members(src: Source) -> DataFrame:
    """Members with a probability per population."""
    return QUERIES["population_models"](src.spark, src.base_dir).groupBy(
        "eligibility_status").agg(F.count("prob").alias("members"))


@query
def quantile_model_members(src: Source) -> DataFrame:
    """Members, their outcome, and whether they have a predicted quantile."""
    return QUERIES["cost_quantile_model"](src.spark, src.base_dir).select(
        "member_id", "cost_total", F.col("cost_q90").isNotNull().alias("predicted"))


@query
def benchmark_model_actuals(src: Source) -> DataFrame:
    """T24 with a model: members and actual cost per provider of the model's output."""
    return QUERIES["provider_benchmark_model"](src.spark, src.base_dir).select(
        "providerid", "members", "actual")


@query
def recommendation_rules(src: Source) -> DataFrame:
    """Of the exported recommendations, how many break a rule: ranks that are
    not 1..n, conditions already coded, conditions of the other gender, fewer than ten."""
    recs = written(inputs.predictions(src).withColumnRenamed("feature_value", "condition_name"),
                   "recommendations")
    known = inputs.pred_features(src).select("member_id", "condition_name").distinct()
    allowed = candidates.gender_filter(recs, src.members, inputs.gender_labels(src))
    per = recs.groupBy("member_id").agg(F.count("*").alias("n"), F.max("pred_rank").alias("top"),
                                        F.countDistinct("pred_rank").alias("ranks"))
    counts = per.agg(
        F.count("*").alias("members"),
        F.sum((F.col("n") < 10).cast("bigint")).alias("short_lists"),
        F.sum(((F.col("n") != F.col("top")) | (F.col("n") != F.col("ranks"))).cast("bigint"))
        .alias("broken_ranks"))
    broken = recs.join(known, ["member_id", "condition_name"], "left_semi").agg(
        F.count("*").alias("already_coded"))
    other = recs.join(allowed, ["member_id", "condition_name", "chronic_flag"], "left_anti").agg(
        F.count("*").alias("other_gender"))
    return counts.withColumns({"already_coded": F.lit(broken.scalar()),
                               "other_gender": F.lit(other.scalar())})


@query
def explanation_identity(src: Source) -> DataFrame:
    """Per explained member the products it rated, and the explained ratings that
    contributions plus residual do not give back."""
    rows = QUERIES["als_explanations"](src.spark, src.base_dir)
    per = rows.groupBy("member_id").agg(
        F.count("*").alias("rated"),
        F.abs(F.sum("weight") + F.max("residual_a") - F.max("rating_a")).alias("gap"))
    return per.agg(F.count("*").alias("members"), F.sum("rated").alias("rated_products"),
                   F.sum((F.col("gap") > 1e-6).cast("bigint")).alias("unexplained"))
