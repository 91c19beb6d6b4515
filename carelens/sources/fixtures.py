"""Adapter from the supplied TPC-H-like tables to the domain tables of the library.

The supplied tables have no healthcare content, so each domain table is a fixed relabelling:
customers are members, suppliers are providers, finished line items are discharges, line items
are claim lines whose part is the diagnosis, and events are measurements. The same definitions
exist as SQL in ``carelens.plans.oracle`` so DuckDB can check every query.
"""

from __future__ import annotations

import calendar
import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.sources.tables import latest

# The cut points lie this many months before the last service date of the data.
HOLDOUT_MONTHS = 2              # responses are coded after this cut, tuning features up to it
MEASURES = ("click", "error", "purchase", "signup", "view")
OUTCOME_MONTHS = 6
HISTORY_MONTHS = 12


def months_before(day: str, months: int) -> str:
    """The same day of an earlier month, or its last day."""
    d = dt.date.fromisoformat(day)
    year, month = divmod(d.year * 12 + d.month - 1 - months, 12)
    return dt.date(year, month + 1, min(d.day, calendar.monthrange(year, month + 1)[1])).isoformat()


class Source:
    """Lazy access to ``<base_dir>/<name>.parquet``; every scan stays prunable. The cut dates
    follow from the last service date of the data where they are not given; as literals of the
    plans they reach the scans. The measures that become feature columns are an argument."""

    def __init__(self, spark: SparkSession, base_dir: str, holdout_cut: str | None = None,
                 outcome_cut: str | None = None, last_service: str | None = None,
                 measures: tuple[str, ...] = MEASURES):
        self.spark = spark
        self.base_dir = base_dir.rstrip("/")
        self._given = {"holdout": holdout_cut, "outcome": outcome_cut, "last": last_service}
        self.measures = list(measures)

    @cached_property
    def last_service(self) -> str:
        """The last service date: prediction features are aged from here."""
        if self._given["last"]:
            return self._given["last"]
        found = latest(self.spark, f"{self.base_dir}/orders.parquet", "o_orderdate")
        return (found or dt.date(1970, 1, 1)).strftime("%Y-%m-%d")

    @cached_property
    def holdout_cut(self) -> str:
        return self._given["holdout"] or months_before(self.last_service, HOLDOUT_MONTHS)

    @cached_property
    def outcome_cut(self) -> str:
        """The outcome window starts after this date."""
        return self._given["outcome"] or months_before(self.last_service, OUTCOME_MONTHS)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base_dir}/{name}.parquet")

    # ---- domain views -------------------------------------------------------------------
    @cached_property
    def members(self) -> DataFrame:
        """member_id, gender ('M'/'F'/null), age, eligibility_status, risk_score."""
        c = self.table("customer")
        key = F.col("c_custkey")
        return c.select(
            key.alias("member_id"),
            F.when(key % 10 == 0, F.lit(None).cast("string"))
             .when(key % 2 == 1, F.lit("M")).otherwise(F.lit("F")).alias("gender"),
            (F.lit(20) + key % 60).cast("int").alias("age"),
            F.col("c_mktsegment").alias("eligibility_status"),
            F.col("c_acctbal").alias("risk_score"),
        )

    @cached_property
    def providers(self) -> DataFrame:
        """providerid, providername, in_network. Suppliers with a negative balance are not
        credentialed providers, so some discharges have no provider row."""
        s = self.table("supplier")
        return s.filter(F.col("s_acctbal") >= 0).select(
            F.col("s_suppkey").alias("providerid"),
            F.col("s_name").alias("providername"),
            (F.col("s_nationkey") < 13).alias("in_network"),
        )

    @cached_property
    def discharges(self) -> DataFrame:
        """discharge_id, lob, los, providerid: finished line items of each order."""
        li = self.table("lineitem").filter(F.col("l_linestatus") == "F")
        o = self.table("orders").select("o_orderkey", "o_custkey")
        c = self.table("customer").select("c_custkey", "c_mktsegment")
        oc = o.join(c, o.o_custkey == c.c_custkey)
        return li.join(oc, li.l_orderkey == oc.o_orderkey).select(
            F.col("l_orderkey").alias("discharge_id"),
            F.col("c_mktsegment").alias("lob"),
            F.col("l_quantity").alias("los"),
            F.col("l_suppkey").alias("providerid"),
        )

    @cached_property
    def diagnosis_grouping(self) -> DataFrame:
        """T1 grouping table: diagnosis code -> condition category, chronic class, service
        type and the drug brand associated with it."""
        p = self.table("part")
        return p.select(
            F.col("p_partkey").alias("diagnosis"),
            F.col("p_name").alias("condition_name"),
            F.when(F.col("p_size") % 2 == 0, F.lit("1")).otherwise(F.lit("0"))
             .alias("chronic_flag"),
            F.col("p_type").alias("service_type"),
            F.col("p_brand").alias("drug"),
        )

    @cached_property
    def claim_lines(self) -> DataFrame:
        """Claim lines before grouping: member, provider, diagnosis, setting, date, cost."""
        li = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_extendedprice",
            "l_discount")
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                        "o_orderpriority")
        m = self.members.select("member_id", "gender")
        # orders (a quarter of lineitem) meet members first, so the big fact shuffles once
        om = o.join(m, o.o_custkey == m.member_id)
        prio = F.col("o_orderpriority")
        return li.join(om, li.l_orderkey == om.o_orderkey).select(
            "member_id", "gender",
            F.col("l_suppkey").alias("providerid"),
            F.col("l_partkey").alias("diagnosis"),
            F.when(prio == "1-URGENT", "IP").when(prio == "2-HIGH", "ER").otherwise("OP")
             .alias("setting"),
            F.col("o_orderdate").cast("date").alias("service_date"),
            (F.col("l_returnflag") == "R").alias("avoidable"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"),
        )

    @cached_property
    def claims_with_gender(self) -> DataFrame:
        """Grouped claims (T1 applied) still carrying the member's gender. Conditions named
        'cold ...' occur only for men, so the gender labels are not all 'Both'."""
        from carelens.operators.features import group_diagnoses
        grouped = group_diagnoses(self.claim_lines, self.diagnosis_grouping)
        hidden = F.col("condition_name").startswith("cold ") & \
            (F.coalesce(F.col("gender"), F.lit("F")) != "M")
        return grouped.filter(~hidden)

    @cached_property
    def claims(self) -> DataFrame:
        """Grouped claims: member, provider, diagnosis, condition, class, setting, date, cost."""
        return self.claims_with_gender.drop("gender")

    @cached_property
    def measurements(self) -> DataFrame:
        """member_id, measure, ts, value."""
        e = self.table("events")
        return e.select(F.col("user_id").alias("member_id"), F.col("event_type").alias("measure"),
                        "ts", "value")

    @cached_property
    def enrolments(self) -> DataFrame:
        """member_id, programme, from_date, to_date (both in): an order enrols its customer for
        90 days in the care programme of its priority. Intervals may overlap."""
        day = F.col("o_orderdate").cast("date")
        return self.table("orders").select(
            F.col("o_custkey").alias("member_id"), F.col("o_orderpriority").alias("programme"),
            day.alias("from_date"), F.date_add(day, 89).alias("to_date"))

    @cached_property
    def drug_conditions(self) -> DataFrame:
        """T12 map drug -> condition it implies (first condition name of the brand)."""
        return self.diagnosis_grouping.groupBy("drug").agg(
            F.min("condition_name").alias("condition_name"))
