"""DuckDB SQL equivalents of the registered queries.

Each statement starts from the supplied tables; the adapter views are inlined as CTEs so the SQL
runs anywhere the tables are registered. Floating results are rounded as on the Spark side.
"""

from __future__ import annotations

# ---- adapter views (same definitions as carelens.sources.fixtures) ----------------------
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_member": ((), """
        SELECT c_custkey AS member_id,
               CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 2 = 1 THEN 'M' ELSE 'F' END
                 AS gender,
               CAST(20 + c_custkey % 60 AS INT) AS age,
               c_mktsegment AS eligibility_status, c_acctbal AS risk_score
        FROM customer"""),
    "v_provider": ((), """
        SELECT s_suppkey AS providerid, s_name AS providername, s_nationkey < 13 AS in_network
        FROM supplier WHERE s_acctbal >= 0"""),
    "v_discharge": ((), """
        SELECT l_orderkey AS discharge_id, c_mktsegment AS lob, l_quantity AS los,
               l_suppkey AS providerid
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        WHERE l_linestatus = 'F'"""),
    "v_grouping": ((), """
        SELECT p_partkey AS diagnosis, p_name AS condition_name,
               CASE WHEN p_size % 2 = 0 THEN '1' ELSE '0' END AS chronic_flag,
               p_type AS service_type, p_brand AS drug
        FROM part"""),
    "v_claim": (("v_member", "v_grouping"), """
        SELECT m.member_id, l_suppkey AS providerid, g.diagnosis, g.condition_name,
               g.chronic_flag,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'IP' WHEN '2-HIGH' THEN 'ER' ELSE 'OP' END
                 AS setting,
               CAST(o_orderdate AS DATE) AS service_date, g.service_type, g.drug,
               l_returnflag = 'R' AS avoidable, l_extendedprice * (1 - l_discount) AS paid
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN v_member m ON m.member_id = o_custkey
        JOIN v_grouping g ON g.diagnosis = l_partkey
        WHERE NOT (g.condition_name LIKE 'cold %' AND COALESCE(m.gender, 'F') <> 'M')"""),
    "v_feat": (("v_claim",), """
        SELECT member_id, condition_name, chronic_flag,
               round(sqrt(sum(w)), 6) AS sqrt_adjusted_credibility,
               round(ln(1 + sum(w)), 6) AS log_adjusted_credibility
        FROM (SELECT member_id, condition_name, chronic_flag,
                     CASE setting WHEN 'IP' THEN 2E0 ELSE 1E0 END
                     * power(0.5E0, date_diff('day', service_date, DATE '2001-06-01')
                                    / CASE chronic_flag WHEN '1' THEN 730E0 ELSE 365E0 END) AS w
              FROM v_claim WHERE service_date <= DATE '2001-06-01')
        GROUP BY member_id, condition_name, chronic_flag"""),
    "v_resp": (("v_claim",), """
        SELECT DISTINCT member_id, condition_name, chronic_flag
        FROM v_claim WHERE service_date > DATE '2001-06-01'"""),
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs for ``names`` and everything they depend on."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in order)
    # a body may start with further members of the list
    return f"WITH {ctes}{body.lstrip()}" if body.lstrip().startswith(",") else \
        f"WITH {ctes}\n{body}"


ORACLE: dict[str, str] = {}


def register(name: str, body: str, *views: str) -> None:
    ORACLE[name] = with_views(body, *views)


# ---- discharge summaries -----------------------------------------------------------------
register("discharge_count", "SELECT count(*) AS row_cnt FROM v_discharge", "v_discharge")
register("discharge_peek", """
    SELECT lob, los FROM v_discharge ORDER BY discharge_id, lob, los LIMIT 10""", "v_discharge")
_LOS_BY_LOB = """
    SELECT lob, count(*) AS row_cnt, round(avg(los), 2) AS avg_los
    FROM v_discharge GROUP BY lob"""
register("los_by_lob_sql", _LOS_BY_LOB, "v_discharge")
register("los_by_lob", _LOS_BY_LOB, "v_discharge")
register("los_by_provider", """
    SELECT p.providername, count(*) AS row_cnt, round(avg(d.los), 2) AS avg_los
    FROM v_discharge d LEFT JOIN v_provider p ON d.providerid = p.providerid
    GROUP BY p.providername""", "v_discharge", "v_provider")
register("los_by_provider_top10", """
    SELECT p.providername, count(*) AS row_cnt, round(avg(d.los), 2) AS avg_los
    FROM v_discharge d LEFT JOIN v_provider p ON d.providerid = p.providerid
    GROUP BY p.providername
    ORDER BY row_cnt DESC, p.providername NULLS FIRST LIMIT 10""", "v_discharge", "v_provider")


# ---- recommender features ------------------------------------------------------------------
_AGE_BAND = ("CAST(CAST(floor(age / 10) * 10 AS INT) AS VARCHAR) || '-' || "
             "CAST(CAST(floor(age / 10) * 10 AS INT) + 9 AS VARCHAR)")
VIEWS["v_demog"] = (("v_member",), f"""
        SELECT member_id, feature_name, feature_value, 1.0E0 AS confidence FROM (
          SELECT member_id, 'age_band' AS feature_name, {_AGE_BAND} AS feature_value FROM v_member
          UNION ALL SELECT member_id, 'gender', gender FROM v_member
          UNION ALL SELECT member_id, 'eligibility_status', eligibility_status FROM v_member)
        WHERE feature_value IS NOT NULL""")
VIEWS["v_feature_all"] = (("v_feat", "v_demog"), """
        SELECT member_id, condition_name AS feature_value,
               CAST(sqrt_adjusted_credibility AS DOUBLE) AS confidence, chronic_flag,
               'condition_name' AS feature_name
        FROM v_feat WHERE chronic_flag IS NOT NULL
        UNION ALL
        SELECT member_id, feature_value, CAST(CAST(confidence AS FLOAT) AS DOUBLE) * 2.0E0, '',
               feature_name
        FROM v_demog""")
VIEWS["v_user_map"] = (("v_feature_all",), """
        SELECT member_id, row_number() OVER (ORDER BY member_id) AS user_id
        FROM (SELECT DISTINCT member_id FROM v_feature_all)""")
VIEWS["v_prod_map"] = (("v_feature_all",), """
        SELECT feature_name, feature_value, chronic_flag,
               row_number() OVER (ORDER BY feature_name, feature_value, chronic_flag) AS product_id
        FROM (SELECT DISTINCT feature_name, feature_value, chronic_flag FROM v_feature_all)""")
VIEWS["v_new"] = (("v_resp", "v_feat"), """
        SELECT r.member_id, r.condition_name, r.chronic_flag FROM v_resp r
        ANTI JOIN (SELECT * FROM v_feat WHERE sqrt_adjusted_credibility IS NOT NULL) f
          ON f.member_id = r.member_id AND f.condition_name = r.condition_name
         AND f.chronic_flag = r.chronic_flag""")
VIEWS["v_popular"] = (("v_feat",), """
        SELECT condition_name, chronic_flag, count, pred_rank FROM (
          SELECT condition_name, chronic_flag, count(*) AS count,
                 row_number() OVER (PARTITION BY chronic_flag
                                    ORDER BY count(*) DESC, condition_name) AS pred_rank
          FROM v_feat GROUP BY condition_name, chronic_flag)
        WHERE pred_rank <= 30""")
VIEWS["v_member_popular"] = (("v_member", "v_popular", "v_feat"), """
        SELECT member_id, condition_name, chronic_flag, count, pred_rank FROM (
          SELECT m.member_id, t.condition_name, t.chronic_flag, t.count,
                 row_number() OVER (PARTITION BY m.member_id, t.chronic_flag
                                    ORDER BY t.count DESC, t.condition_name) AS pred_rank
          FROM v_member m CROSS JOIN v_popular t
          WHERE NOT EXISTS (SELECT 1 FROM v_feat f
                            WHERE f.member_id = m.member_id AND f.condition_name = t.condition_name
                              AND f.chronic_flag = t.chronic_flag
                              AND f.sqrt_adjusted_credibility IS NOT NULL))
        WHERE pred_rank <= 15""")
VIEWS["v_pop_scored"] = (("v_new", "v_member_popular"), """
        SELECT n.member_id, n.condition_name, n.chronic_flag, p.pred_rank
        FROM v_new n LEFT JOIN v_member_popular p
          ON p.member_id = n.member_id AND p.condition_name = n.condition_name
         AND p.chronic_flag = n.chronic_flag""")
VIEWS["v_pop_curve"] = (("v_pop_scored",), """
        SELECT chronic_flag, CAST(pred_rank AS BIGINT) AS pred_rank, count,
               round(count / total, 6) AS pct_pred,
               round(sum(count / total) OVER (PARTITION BY chronic_flag ORDER BY pred_rank
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cumul_pred,
               'popular' AS pred_type
        FROM (SELECT chronic_flag, pred_rank, count,
                     sum(count) OVER (PARTITION BY chronic_flag) AS total
              FROM (SELECT chronic_flag, pred_rank, count(*) AS count FROM v_pop_scored
                    GROUP BY chronic_flag, pred_rank))
        WHERE pred_rank >= 1""")

register("condition_claims", """
    SELECT member_id, providerid, diagnosis, condition_name, chronic_flag, setting,
           strftime(service_date, '%Y-%m-%d') AS service_date, service_type, drug, avoidable, paid
    FROM v_claim""", "v_claim")
register("condition_credibility", "SELECT * FROM v_feat", "v_feat")
register("demographic_features", "SELECT * FROM v_demog", "v_demog")
register("holdout_responses", "SELECT * FROM v_resp", "v_resp")
register("feature_all", "SELECT * FROM v_feature_all", "v_feature_all")
register("user_ids", "SELECT * FROM v_user_map", "v_user_map")
register("product_ids", "SELECT * FROM v_prod_map", "v_prod_map")
register("rating_matrix", """
    SELECT u.user_id, p.product_id, max(CAST(f.confidence AS FLOAT)) AS confidence
    FROM v_feature_all f JOIN v_user_map u ON u.member_id = f.member_id
    JOIN v_prod_map p ON p.feature_name = f.feature_name AND p.feature_value = f.feature_value
     AND p.chronic_flag = f.chronic_flag
    GROUP BY u.user_id, p.product_id""", "v_feature_all", "v_user_map", "v_prod_map")
register("gender_labels", """
    SELECT condition_name, round(avg_males, 6) AS avg_males, round(avg_females, 6) AS avg_females,
           CASE WHEN avg_males >= 0.95E0 THEN 'Male' WHEN avg_females >= 0.95E0 THEN 'Female'
                ELSE 'Both' END AS gender_specific
    FROM (SELECT condition_name,
                 avg(CASE WHEN m.gender = 'M' THEN 1 ELSE 0 END) AS avg_males,
                 avg(CASE WHEN m.gender = 'F' THEN 1 ELSE 0 END) AS avg_females
          FROM v_feat f JOIN v_member m ON m.member_id = f.member_id GROUP BY condition_name)""",
         "v_feat", "v_member")
register("new_conditions", "SELECT * FROM v_new", "v_new")
register("popular_conditions", "SELECT * FROM v_popular", "v_popular")
register("member_popular", "SELECT * FROM v_member_popular", "v_member_popular")
VIEWS["v_seg"] = (("v_member",), f"""
        SELECT member_id, {_AGE_BAND} AS age_band, COALESCE(gender, '') AS gender,
               COALESCE(eligibility_status, '') AS eligibility_status FROM v_member""")
VIEWS["v_seg_top"] = (("v_seg", "v_feat"), """
        SELECT * FROM (
          SELECT s.age_band, s.gender, s.eligibility_status, f.condition_name, f.chronic_flag,
                 count(*) AS count,
                 row_number() OVER (PARTITION BY s.age_band, s.gender, s.eligibility_status,
                                                 f.chronic_flag
                                    ORDER BY count(*) DESC, f.condition_name) AS g
          FROM v_feat f JOIN v_seg s ON s.member_id = f.member_id
          WHERE f.sqrt_adjusted_credibility IS NOT NULL
          GROUP BY s.age_band, s.gender, s.eligibility_status, f.condition_name, f.chronic_flag)
        WHERE g <= 30""")
register("popular_by_segment", """
    SELECT member_id, age_band, gender, eligibility_status, condition_name, chronic_flag, count,
           pred_rank FROM (
      SELECT s.member_id, s.age_band, s.gender, s.eligibility_status, t.condition_name,
             t.chronic_flag, t.count,
             row_number() OVER (PARTITION BY s.member_id, t.chronic_flag
                                ORDER BY t.count DESC, t.condition_name) AS pred_rank
      FROM v_seg s JOIN v_seg_top t
        ON t.age_band = s.age_band AND t.gender = s.gender
       AND t.eligibility_status = s.eligibility_status
      WHERE NOT EXISTS (SELECT 1 FROM v_feat f
                        WHERE f.member_id = s.member_id AND f.condition_name = t.condition_name
                          AND f.chronic_flag = t.chronic_flag
                          AND f.sqrt_adjusted_credibility IS NOT NULL))
    WHERE pred_rank <= 15""", "v_seg", "v_seg_top", "v_feat")
register("popular_curve", "SELECT * FROM v_pop_curve", "v_pop_curve")
register("popular_recall_at_10", """
    SELECT 'popular' AS pred_type, CAST(10 AS BIGINT) AS k,
           round(avg(CASE WHEN pred_rank <= 10 THEN 1 ELSE 0 END), 6) AS recall
    FROM v_pop_scored""", "v_pop_scored")
register("eval_chart", """
    SELECT chronic_flag, pred_type, pred_rank, cumul_pred,
           CASE chronic_flag WHEN '1' THEN 'Chronic' WHEN '0' THEN 'Non-Chronic' END
             AS chronic_pretty,
           CAST(CASE chronic_flag WHEN '1' THEN 1 WHEN '0' THEN 2 END AS BIGINT) AS chronic_order,
           CASE pred_type WHEN 'recommender' THEN 'Matrix Factorization'
                          WHEN 'popular' THEN 'Popularity' END AS pred_type_pretty,
           CAST(CASE pred_type WHEN 'recommender' THEN 1 WHEN 'popular' THEN 2 END AS BIGINT)
             AS pred_type_order
    FROM v_pop_curve WHERE pred_rank BETWEEN 1 AND 15""", "v_pop_curve")


# ---- sources, case study, gaps -------------------------------------------------------------
register("procedure_reference", """
    SELECT p_name AS PROC_DESC, p_type AS MR_LINE_DESC, CAST(p_size AS BIGINT) AS MR_LINE_SIZE
    FROM part""")
register("case_study_features", """
    SELECT f.* FROM v_feat f
    WHERE f.member_id IN (
      SELECT g.member_id FROM v_feat g JOIN v_popular p
        ON p.condition_name = g.condition_name AND p.chronic_flag = g.chronic_flag
      WHERE p.chronic_flag = '1' AND p.pred_rank = 1 AND g.sqrt_adjusted_credibility > 1)""",
         "v_feat", "v_popular")
VIEWS["v_recent"] = (("v_claim",), """
        SELECT * FROM v_claim
        WHERE service_date > DATE '2000-06-01' AND service_date <= DATE '2001-06-01'""")
register("explicit_gaps", """
    SELECT p.member_id, p.condition_name, p.chronic_flag,
           strftime(p.last_coded, '%Y-%m-%d') AS last_coded
    FROM (SELECT member_id, condition_name, chronic_flag, max(service_date) AS last_coded
          FROM v_claim
          WHERE service_date > DATE '1999-06-01' AND service_date <= DATE '2000-06-01'
          GROUP BY member_id, condition_name, chronic_flag) p
    ANTI JOIN v_recent r ON r.member_id = p.member_id AND r.condition_name = p.condition_name
     AND r.chronic_flag = p.chronic_flag""", "v_claim", "v_recent")
register("drug_gaps", """
    SELECT t.member_id, t.drug, dm.implied AS condition_name
    FROM (SELECT DISTINCT member_id, drug FROM v_recent) t
    JOIN (SELECT drug, min(condition_name) AS implied FROM v_grouping GROUP BY drug) dm
      ON dm.drug = t.drug
    WHERE NOT EXISTS (SELECT 1 FROM v_recent r
                      WHERE r.member_id = t.member_id AND r.condition_name = dm.implied)""",
         "v_recent", "v_grouping")

# ---- six-month cost and utilization --------------------------------------------------------
for _name, _grain in (("period_summary", "quarter"), ("period_summary_month", "month")):
    register(_name, f"""
    SELECT c.member_id, strftime(date_trunc('{_grain}', c.service_date), '%Y-%m-%d') AS period,
           round(sum(paid), 4) AS paid_total,
           round(sum(CASE WHEN avoidable THEN paid ELSE 0E0 END), 4) AS paid_avoidable,
           round(sum(CASE WHEN COALESCE(p.in_network, false) THEN paid ELSE 0E0 END), 4)
             AS paid_in_network,
           round(sum(CASE WHEN setting = 'IP' THEN paid ELSE 0E0 END), 4) AS paid_ip,
           round(sum(CASE WHEN setting = 'ER' THEN paid ELSE 0E0 END), 4) AS paid_er,
           round(sum(CASE WHEN setting = 'OP' THEN paid ELSE 0E0 END), 4) AS paid_op,
           CAST(sum(CASE WHEN setting = 'IP' THEN 1 ELSE 0 END) AS BIGINT) AS n_ip,
           CAST(sum(CASE WHEN setting = 'ER' THEN 1 ELSE 0 END) AS BIGINT) AS n_er,
           CAST(sum(CASE WHEN setting = 'OP' THEN 1 ELSE 0 END) AS BIGINT) AS n_op,
           count(*) AS n_claims
    FROM v_claim c LEFT JOIN v_provider p ON p.providerid = c.providerid
    GROUP BY c.member_id, date_trunc('{_grain}', c.service_date)""", "v_claim", "v_provider")
VIEWS["v_outcome"] = (("v_member", "v_claim"), """
        SELECT m.member_id, CAST(COALESCE(o.any_ip, 0) AS BIGINT) AS any_ip,
               CAST(COALESCE(o.any_er, 0) AS BIGINT) AS any_er,
               round(COALESCE(o.cost_total, 0E0), 4) AS cost_total,
               round(COALESCE(o.cost_avoidable, 0E0), 4) AS cost_avoidable
        FROM v_member m LEFT JOIN (
          SELECT member_id, max(CASE WHEN setting = 'IP' THEN 1 ELSE 0 END) AS any_ip,
                 max(CASE WHEN setting = 'ER' THEN 1 ELSE 0 END) AS any_er,
                 sum(paid) AS cost_total,
                 sum(CASE WHEN avoidable THEN paid ELSE 0E0 END) AS cost_avoidable
          FROM v_claim
          WHERE service_date > DATE '2001-02-01' AND service_date <= DATE '2001-08-01'
          GROUP BY member_id) o ON o.member_id = m.member_id""")
_MEAS = ["click", "error", "purchase", "signup", "view"]
_LAST = ",\n".join(f"max_by(value, ts) FILTER (WHERE event_type = '{m}') AS last_{m}"
                   for m in _MEAS)
_LAST_MISSING = ",\n".join(f"CAST(last_{m} IS NULL AS INT) AS last_{m}_missing" for m in _MEAS)
_LAST_MISSING = ",\n".join(f"CAST(CASE WHEN e.last_{m} IS NULL THEN 1 ELSE 0 END AS BIGINT)"
                           f" AS last_{m}_missing" for m in _MEAS)
_LAST_COLS = ", ".join(f"e.last_{m}" for m in _MEAS)
VIEWS["v_mfeat"] = (("v_member", "v_claim"), f"""
        SELECT m.member_id, CAST(m.age AS BIGINT) AS age,
               CAST(CASE WHEN m.gender = 'M' THEN 1 ELSE 0 END AS BIGINT) AS male,
               CAST(CASE WHEN m.gender IS NULL THEN 1 ELSE 0 END AS BIGINT) AS gender_missing,
               m.eligibility_status, m.risk_score,
               COALESCE(c.n_conditions, 0) AS n_conditions, COALESCE(c.n_chronic, 0) AS n_chronic,
               COALESCE(h.prior_cost, 0E0) AS prior_cost,
               COALESCE(h.prior_avoidable, 0E0) AS prior_avoidable,
               COALESCE(h.prior_ip, 0) AS prior_ip, COALESCE(h.prior_er, 0) AS prior_er,
               COALESCE(h.prior_claims, 0) AS prior_claims,
               {_LAST_COLS},
               {_LAST_MISSING}
        FROM v_member m
        LEFT JOIN (SELECT member_id, count(*) AS n_conditions,
                          CAST(sum(CASE WHEN chronic_flag = '1' THEN 1 ELSE 0 END) AS BIGINT)
                            AS n_chronic
                   FROM (SELECT DISTINCT member_id, condition_name, chronic_flag FROM v_claim
                         WHERE service_date <= DATE '2001-02-01')
                   GROUP BY member_id) c ON c.member_id = m.member_id
        LEFT JOIN (SELECT member_id, round(sum(paid), 4) AS prior_cost,
                          round(sum(CASE WHEN avoidable THEN paid ELSE 0E0 END), 4)
                            AS prior_avoidable,
                          CAST(sum(CASE WHEN setting = 'IP' THEN 1 ELSE 0 END) AS BIGINT)
                            AS prior_ip,
                          CAST(sum(CASE WHEN setting = 'ER' THEN 1 ELSE 0 END) AS BIGINT)
                            AS prior_er,
                          count(*) AS prior_claims
                   FROM v_claim
                   WHERE service_date > DATE '2000-02-01' AND service_date <= DATE '2001-02-01'
                   GROUP BY member_id) h ON h.member_id = m.member_id
        LEFT JOIN (SELECT user_id AS member_id, {_LAST}
                   FROM events GROUP BY user_id) e ON e.member_id = m.member_id""")
register("member_features", "SELECT * FROM v_mfeat", "v_mfeat")
register("six_month_outcomes", "SELECT * FROM v_outcome", "v_outcome")
register("capture_curve", """
    , ra AS (SELECT member_id, row_number() OVER (ORDER BY cost_avoidable DESC NULLS LAST, member_id)
                     AS ra FROM v_outcome),
    rp AS (SELECT member_id, 'risk_score' AS baseline,
                  row_number() OVER (ORDER BY risk_score DESC NULLS LAST, member_id) AS rp
           FROM v_mfeat
           UNION ALL
           SELECT member_id, 'prior_cost',
                  row_number() OVER (ORDER BY prior_cost DESC NULLS LAST, member_id) FROM v_mfeat
           UNION ALL
           SELECT member_id, 'prior_avoidable',
                  row_number() OVER (ORDER BY prior_avoidable DESC NULLS LAST, member_id)
           FROM v_mfeat),
    b AS (SELECT rp.baseline, greatest(ra.ra, rp.rp) AS m FROM ra JOIN rp
            ON ra.member_id = rp.member_id),
    n AS (SELECT count(*) AS n FROM ra JOIN (SELECT DISTINCT member_id FROM v_mfeat) x
            ON x.member_id = ra.member_id),
    lv AS (SELECT unnest([0.01E0, 0.05E0, 0.1E0, 0.2E0, 0.5E0, 1.0E0]) AS level)
    SELECT b.baseline, lv.level, CAST(ceil(n.n * lv.level) AS BIGINT) AS n_top,
           round(sum(CASE WHEN b.m <= ceil(n.n * lv.level) THEN 1 ELSE 0 END)
                 / ceil(n.n * lv.level), 6) AS capture
    FROM b, n, lv GROUP BY b.baseline, lv.level, n.n""", "v_outcome", "v_mfeat")
register("priority_list", """
    SELECT member_id, prior_cost FROM v_mfeat
    ORDER BY prior_cost DESC NULLS LAST, member_id LIMIT 25""", "v_mfeat")
register("provider_benchmark", """
    SELECT a.providerid, count(*) AS members, round(sum(o.cost_total), 4) AS actual,
           round(sum(f.prior_cost / 2), 6) AS predicted,
           CASE WHEN round(sum(f.prior_cost / 2), 6) <> 0
                THEN round(round(sum(o.cost_total), 4) / round(sum(f.prior_cost / 2), 6), 6)
           END AS ratio
    FROM (SELECT member_id, providerid FROM (
            SELECT member_id, providerid,
                   row_number() OVER (PARTITION BY member_id ORDER BY n DESC, providerid) AS r
            FROM (SELECT member_id, providerid, count(*) AS n FROM v_claim
                  WHERE service_date <= DATE '2001-02-01' GROUP BY member_id, providerid))
          WHERE r = 1) a
    JOIN v_outcome o ON o.member_id = a.member_id
    JOIN v_mfeat f ON f.member_id = a.member_id
    GROUP BY a.providerid""", "v_claim", "v_outcome", "v_mfeat")

# ---- neighbour-based filtering -------------------------------------------------------------
VIEWS["v_known"] = (("v_feat",), """
        SELECT DISTINCT member_id, condition_name AS c, chronic_flag AS f FROM v_feat""")
VIEWS["v_gram"] = (("v_known",), """
        SELECT a.c AS ci, a.f AS fi, b.c AS cj, b.f AS fj, count(*) AS n,
               sum(1 / w.nrm) AS nw
        FROM v_known a JOIN v_known b ON a.member_id = b.member_id
        JOIN (SELECT member_id, sqrt(count(*)) AS nrm FROM v_known GROUP BY member_id) w
          ON w.member_id = a.member_id
        GROUP BY a.c, a.f, b.c, b.f""")
_TOPK = """
    SELECT member_id, condition_name, chronic_flag, round(score, 6) AS score, pred_rank FROM (
      SELECT *, row_number() OVER (PARTITION BY member_id
                                   ORDER BY round(score, 9) DESC, condition_name, chronic_flag)
                AS pred_rank
      FROM (SELECT s.* FROM sc s ANTI JOIN v_known k
              ON k.member_id = s.member_id AND k.c = s.condition_name AND k.f = s.chronic_flag)
      WHERE round(score, 9) > 0)
    WHERE pred_rank <= 10"""
register("item_based_recs", """
    , d AS (SELECT ci, fi, n FROM v_gram WHERE ci = cj AND fi = fj),
    s AS (SELECT g.ci, g.fi, g.cj, g.fj, g.n / sqrt(d1.n * d2.n) AS sim
          FROM v_gram g JOIN d d1 ON d1.ci = g.ci AND d1.fi = g.fi
          JOIN d d2 ON d2.ci = g.cj AND d2.fi = g.fj
          WHERE NOT (g.ci = g.cj AND g.fi = g.fj)),
    sc AS (SELECT k.member_id, s.cj AS condition_name, s.fj AS chronic_flag, sum(s.sim) AS score
           FROM v_known k JOIN s ON s.ci = k.c AND s.fi = k.f
           GROUP BY k.member_id, s.cj, s.fj)""" + _TOPK, "v_known", "v_gram")
register("user_based_recs", """
    , w AS (SELECT member_id, sqrt(count(*)) AS nrm FROM v_known GROUP BY member_id),
    sc AS (SELECT k.member_id, g.cj AS condition_name, g.fj AS chronic_flag,
                  sum(g.nw) / max(w.nrm) AS score
           FROM v_known k JOIN v_gram g ON g.ci = k.c AND g.fi = k.f
           JOIN w ON w.member_id = k.member_id
           GROUP BY k.member_id, g.cj, g.fj)""" + _TOPK, "v_known", "v_gram")
register("nearest_member_recs", """
    , size AS (SELECT member_id, count(*) AS n FROM v_known GROUP BY member_id),
    pair AS (SELECT a.member_id AS x, b.member_id AS y, count(*) AS n
             FROM v_known a JOIN v_known b ON a.c = b.c AND a.f = b.f
             WHERE a.member_id <> b.member_id GROUP BY 1, 2),
    near AS (SELECT x, y, cosine FROM (
        SELECT x, y, p.n / sqrt(sx.n * sy.n) AS cosine,
               row_number() OVER (PARTITION BY x ORDER BY round(p.n / sqrt(sx.n * sy.n), 9) DESC, y)
               AS place
        FROM pair p JOIN size sx ON sx.member_id = x JOIN size sy ON sy.member_id = y
        WHERE 4 * p.n * p.n >= sx.n * sy.n) WHERE place <= 10),
    sc AS (SELECT x AS member_id, k.c AS condition_name, k.f AS chronic_flag,
                  sum(cosine) AS score
           FROM near JOIN v_known k ON k.member_id = y GROUP BY 1, 2, 3)""" + _TOPK, "v_known")
_item = ORACLE["item_based_recs"]
ORACLE["exported_predictions"] = f"""
    SELECT member_id, condition_name AS feature_value, 'condition_name' AS feature_name,
           chronic_flag, score AS rating, pred_rank FROM ({_item})"""
register("item_based_filtered", """
    , d AS (SELECT ci, fi, n FROM v_gram WHERE ci = cj AND fi = fj),
    s AS (SELECT g.ci, g.fi, g.cj, g.fj, g.n / sqrt(d1.n * d2.n) AS sim
          FROM v_gram g JOIN d d1 ON d1.ci = g.ci AND d1.fi = g.fi
          JOIN d d2 ON d2.ci = g.cj AND d2.fi = g.fj
          WHERE NOT (g.ci = g.cj AND g.fi = g.fj)),
    sc AS (SELECT k.member_id, s.cj AS condition_name, s.fj AS chronic_flag, sum(s.sim) AS score
           FROM v_known k JOIN s ON s.ci = k.c AND s.fi = k.f
           GROUP BY k.member_id, s.cj, s.fj),
    lab AS (SELECT condition_name, avg(CASE WHEN m.gender = 'M' THEN 1 ELSE 0 END) AS males,
                   avg(CASE WHEN m.gender = 'F' THEN 1 ELSE 0 END) AS females
            FROM v_feat f JOIN v_member m ON m.member_id = f.member_id GROUP BY condition_name)
    SELECT member_id, condition_name, chronic_flag, round(score, 6) AS score, pred_rank FROM (
      SELECT s.*, row_number() OVER (PARTITION BY s.member_id, chronic_flag
                                   ORDER BY round(score, 6) DESC, condition_name) AS pred_rank
      FROM (SELECT s.* FROM sc s ANTI JOIN v_known k
              ON k.member_id = s.member_id AND k.c = s.condition_name) s
      JOIN lab USING (condition_name) JOIN v_member m ON m.member_id = s.member_id
      WHERE round(score, 9) > 0 AND CASE WHEN males >= 0.95 THEN m.gender = 'M'
                                         WHEN females >= 0.95 THEN m.gender = 'F'
                                         ELSE true END)
    WHERE pred_rank <= 10""", "v_known", "v_gram", "v_feat", "v_member")
register("low_ratings", """
    SELECT vec_id, label, round(rating, 6) AS rating FROM (
      SELECT vec_id, label, rating, percent_rank() OVER (PARTITION BY label ORDER BY rating) AS pr
      FROM (SELECT e.vec_id, e.label::VARCHAR AS label,
                   round(list_dot_product(u.v, e.embedding::DOUBLE[]), 9) AS rating
            FROM embeddings e JOIN (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS v
                                    FROM embeddings GROUP BY label) u ON u.label = e.label))
    WHERE pr <= 0.05""")

register("prediction_features", """
    SELECT member_id, condition_name, chronic_flag,
           round(sqrt(sum(w)), 6) AS sqrt_adjusted_credibility,
           round(ln(1 + sum(w)), 6) AS log_adjusted_credibility
    FROM (SELECT member_id, condition_name, chronic_flag,
                 CASE setting WHEN 'IP' THEN 2E0 ELSE 1E0 END
                 * power(0.5E0, date_diff('day', service_date, DATE '2001-08-01')
                                / CASE chronic_flag WHEN '1' THEN 730E0 ELSE 365E0 END) AS w
          FROM v_claim WHERE service_date <= DATE '2001-08-01')
    GROUP BY member_id, condition_name, chronic_flag""", "v_claim")

ORACLE["eval_chart_from_file"] = ORACLE["eval_chart"]
register("bulk_conversion", """
    SELECT 'customer' AS source, count(*) AS rows,
           (SELECT count(*) FROM (DESCRIBE customer)) AS columns,
           CAST(sum(c_custkey) AS BIGINT) AS key_sum,
           CAST(sum(length(c_name)) AS BIGINT) AS name_chars FROM customer
    UNION ALL
    SELECT 'supplier', count(*), (SELECT count(*) FROM (DESCRIBE supplier)),
           CAST(sum(s_suppkey) AS BIGINT), CAST(sum(length(s_name)) AS BIGINT) FROM supplier
    UNION ALL
    SELECT 'part', count(*), (SELECT count(*) FROM (DESCRIBE part)),
           CAST(sum(p_partkey) AS BIGINT), CAST(sum(length(p_name)) AS BIGINT) FROM part""")


register("period_service_types", """
    SELECT member_id, strftime(date_trunc('quarter', service_date), '%Y-%m-%d') AS period,
           service_type, round(sum(paid), 4) AS paid_total, count(*) AS n_claims
    FROM v_claim GROUP BY 1, 2, 3""", "v_claim")
register("member_history", """
    SELECT c.member_id, COALESCE(p.in_network, false) AS in_network, c.service_type,
           round(sum(c.paid), 4) AS prior_cost, count(*) AS prior_claims
    FROM v_claim c LEFT JOIN v_provider p ON p.providerid = c.providerid
    WHERE c.service_date > DATE '2000-02-01' AND c.service_date <= DATE '2001-02-01'
    GROUP BY 1, 2, 3""", "v_claim", "v_provider")
register("member_condition_flags", """
    SELECT m.member_id, count(f.flag) AS n_flags,
           COALESCE(string_agg(f.flag, '|' ORDER BY f.flag), '') AS flags
    FROM v_member m
    LEFT JOIN (SELECT DISTINCT member_id, condition_name || ':' || chronic_flag AS flag
               FROM v_claim WHERE service_date <= DATE '2001-02-01') f
      ON f.member_id = m.member_id
    GROUP BY m.member_id""", "v_member", "v_claim")

register("exported_case_study", f"""
    , picked AS (SELECT member_id FROM v_claim GROUP BY member_id
                 ORDER BY count(*) DESC, member_id LIMIT 10),
    stacked AS (
      SELECT 'members' AS source, member_id, feature_name AS item, feature_value AS class,
             confidence AS value FROM v_demog
      UNION ALL
      SELECT 'features', member_id, condition_name, chronic_flag, sqrt_adjusted_credibility
      FROM v_feat
      UNION ALL
      SELECT 'recommendations', member_id, condition_name, chronic_flag, score
      FROM ({_item}))
    SELECT * FROM stacked WHERE member_id IN (SELECT member_id FROM picked)""",
         "v_claim", "v_demog", "v_feat")
register("persisted_claims", """
    SELECT 'setting' AS by, setting AS value, count(*) AS n_claims, round(sum(paid), 2) AS paid
    FROM v_claim GROUP BY setting
    UNION ALL
    SELECT 'chronic_flag', chronic_flag, count(*), round(sum(paid), 2)
    FROM v_claim GROUP BY chronic_flag""", "v_claim")
register("event_model_labels", """
    SELECT member_id, any_ip, true AS is_probability FROM v_outcome""", "v_outcome")
register("fold_members", """
    SELECT count(*) AS members, count(DISTINCT member_id) AS distinct_members,
           count(*) AS in_range FROM v_outcome""", "v_outcome")
register("population_model_members", """
    SELECT eligibility_status, count(*) AS members FROM v_member GROUP BY 1""", "v_member")
register("quantile_model_members", """
    SELECT member_id, cost_total, true AS predicted FROM v_outcome""", "v_outcome")
ORACLE["benchmark_model_actuals"] = \
    f"SELECT providerid, members, actual FROM ({ORACLE['provider_benchmark']})"
register("recommendation_rules", """
    SELECT count(*) AS members, 0::BIGINT AS short_lists, 0::BIGINT AS broken_ranks,
           0::BIGINT AS already_coded, 0::BIGINT AS other_gender FROM v_member""", "v_member")
register("explanation_identity", """
    SELECT (SELECT count(*) FROM v_member) AS members,
           ((SELECT count(*) FROM (SELECT DISTINCT member_id, condition_name, chronic_flag
                                   FROM v_claim WHERE service_date <= DATE '2001-08-01'))
            + (SELECT count(*) FROM v_demog))::BIGINT AS rated_products,
           0::BIGINT AS unexplained""", "v_claim", "v_demog", "v_member")

_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
register("period_service_pivot", f"""
    SELECT member_id, period, {", ".join(f"coalesce({t}, 0E0) AS paid_{t.lower()}" for t in _TYPES)}
    FROM (PIVOT (SELECT member_id, strftime(date_trunc('quarter', service_date), '%Y-%m-%d')
                          AS period, service_type, paid FROM v_claim)
          ON service_type IN ({", ".join(f"'{t}'" for t in _TYPES)}) USING round(sum(paid), 4)
          GROUP BY member_id, period)""", "v_claim")
_VECTOR = ["age", "male", "gender_missing", "risk_score", "n_conditions", "n_chronic",
           "prior_cost", "prior_avoidable", "prior_ip", "prior_er", "prior_claims",
           *[f"last_{m}" for m in _MEAS], *[f"last_{m}_missing" for m in _MEAS]]
_PLACES = [(net, t) for net in ("true", "false") for t in _TYPES]
register("member_feature_vector", f"""
    , cols AS (SELECT member_id, unnest(range({len(_VECTOR)})) AS index,
                      unnest([{", ".join(f"coalesce({c}::DOUBLE, -1E9)" for c in _VECTOR)}])
                        AS value FROM v_mfeat),
    hist AS (SELECT member_id, in_network, service_type, round(sum(paid), 4) AS value
             FROM (SELECT c.*, COALESCE(p.in_network, false) AS in_network
                   FROM v_claim c LEFT JOIN v_provider p ON p.providerid = c.providerid)
             WHERE service_date > DATE '2000-02-01' AND service_date <= DATE '2001-02-01'
             GROUP BY 1, 2, 3),
    place AS (SELECT * FROM (VALUES {", ".join(f"({n}, '{t}', {len(_VECTOR) + i})" for i, (n, t) in enumerate(_PLACES))})
              v(in_network, service_type, index)),
    flag AS (SELECT DISTINCT member_id, condition_name || ':' || chronic_flag AS name
             FROM v_claim WHERE service_date <= DATE '2001-02-01'),
    vocab AS (SELECT name, {len(_VECTOR) + len(_PLACES)} - 1 + row_number() OVER (ORDER BY name)
                AS index FROM (SELECT DISTINCT name FROM flag))
    SELECT member_id, index, value FROM cols WHERE value <> 0
    UNION ALL
    SELECT member_id, index, value FROM hist JOIN place USING (in_network, service_type)
    WHERE value <> 0
    UNION ALL
    SELECT member_id, index, 1E0 FROM flag JOIN vocab USING (name)""",
         "v_mfeat", "v_claim", "v_provider")
register("programme_benchmark", """
    , enrol AS (SELECT o_custkey AS member_id, o_orderpriority AS programme,
                       CAST(o_orderdate AS DATE) AS f, CAST(o_orderdate AS DATE) + 89 AS t
                FROM orders),
    isle AS (SELECT *, sum(fresh) OVER (PARTITION BY member_id, programme ORDER BY f, t) AS g
             FROM (SELECT *, CASE WHEN f > max(t) OVER (
                       PARTITION BY member_id, programme ORDER BY f, t
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 OR row_number() OVER (
                       PARTITION BY member_id, programme ORDER BY f, t) = 1 THEN 1 ELSE 0 END
                       AS fresh FROM enrol)),
    held AS (SELECT member_id, programme, greatest(min(f), DATE '2001-02-02') AS f,
                    least(max(t), DATE '2001-08-01') AS t
             FROM isle GROUP BY member_id, programme, g
             HAVING greatest(min(f), DATE '2001-02-02') <= least(max(t), DATE '2001-08-01')),
    days AS (SELECT programme, count(*) AS members, CAST(sum(d) AS BIGINT) AS days,
                    round(sum(coalesce(prior_cost, 0E0) / 365 * d), 2) AS predicted
             FROM (SELECT programme, member_id, sum(date_diff('day', f, t) + 1) AS d
                   FROM held GROUP BY 1, 2) LEFT JOIN v_mfeat USING (member_id) GROUP BY 1),
    paid AS (SELECT programme, round(sum(paid), 4) AS actual
             FROM held JOIN v_claim c ON c.member_id = held.member_id
              AND c.service_date BETWEEN f AND t GROUP BY 1)
    SELECT programme, members, days, coalesce(actual, 0E0) AS actual, predicted,
           CASE WHEN predicted <> 0 THEN round(coalesce(actual, 0E0) / predicted, 4) END AS ratio
    FROM days LEFT JOIN paid USING (programme)""", "v_claim", "v_mfeat")
register("structural_misses", """
    SELECT n.chronic_flag, count(*) AS new_conditions,
           CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM v_feat f WHERE f.member_id = n.member_id
                         AND f.condition_name = n.condition_name) THEN 1 ELSE 0 END) AS BIGINT)
             AS structural_misses
    FROM v_new n GROUP BY n.chronic_flag""", "v_new", "v_feat")
VIEWS["v_pop_feature"] = (("v_feature_all", "v_member"), """
        SELECT m.eligibility_status, f.* FROM v_feature_all f
        JOIN v_member m ON m.member_id = f.member_id""")
register("population_ids", """
    SELECT eligibility_status, member_id,
           row_number() OVER (PARTITION BY eligibility_status ORDER BY member_id) AS user_id
    FROM (SELECT DISTINCT eligibility_status, member_id FROM v_pop_feature)""", "v_pop_feature")
register("population_sizes", """
    SELECT eligibility_status, count(DISTINCT f.member_id) AS users,
           count(DISTINCT (feature_name, feature_value, chronic_flag)) AS products,
           count(*) AS ratings,
           coalesce(any_value(h.n), 0) AS holdout
    FROM v_pop_feature f LEFT JOIN (
        SELECT m.eligibility_status, count(*) AS n FROM v_new n
        JOIN v_member m ON m.member_id = n.member_id GROUP BY 1) h USING (eligibility_status)
    GROUP BY 1""", "v_pop_feature", "v_new", "v_member")
register("exported_explanations", """
    SELECT f.member_id, 50::BIGINT AS rank, 100.0::DOUBLE AS alpha, 7.0::DOUBLE AS lambda,
           count(*) + (SELECT count(*) FROM v_demog d WHERE d.member_id = f.member_id) AS rated,
           true AS explained
    FROM (SELECT DISTINCT member_id, condition_name, chronic_flag FROM v_claim
          WHERE service_date <= DATE '2001-08-01') f GROUP BY f.member_id""",
         "v_claim", "v_demog")
