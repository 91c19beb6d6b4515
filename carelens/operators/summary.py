"""Grouped stay summaries.

Group-bys are planned as partial (map-side) + final hash aggregates, so even a line of
business holding a third of all rows is pre-combined per task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def los_aggregates(value: str = "los") -> list[Column]:
    """A3: the reusable aggregate list: row count and average rounded to two places."""
    return [F.count(F.lit(1)).alias("row_cnt"), F.round(F.avg(value), 2).alias("avg_los")]


def los_by(df: DataFrame, by: Sequence[str | Column], value: str = "los") -> DataFrame:
    """A2: grouped count + rounded average, most frequent first."""
    return df.groupBy(*by).agg(*los_aggregates(value)).orderBy(F.desc("row_cnt"), *by)


def los_by_sql(spark: SparkSession, view: str, by: str = "lob", value: str = "los") -> DataFrame:
    """A1: the same summary written as SQL against a registered view."""
    return spark.sql(f"""
        SELECT {by}, count(*) AS row_cnt, round(avg({value}), 2) AS avg_los
        FROM {view}
        GROUP BY {by}
        ORDER BY row_cnt DESC, {by}
    """)


def los_by_provider(discharges: DataFrame, providers: DataFrame) -> DataFrame:
    """J5 + J13: left join to the provider dimension, then group by its name; discharges whose
    provider is unknown fall into the null group. The provider dimension is joined without a
    hint: AQE turns it into a broadcast only when its measured size is small."""
    joined = discharges.join(providers.select("providerid", "providername"), "providerid", "left")
    return los_by(joined, ["providername"])


def top_n(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """O2: first ``n`` rows of a total order (planned as TakeOrderedAndProject: per-task
    top-n, then a merge of n rows per task)."""
    return df.orderBy(*order).limit(n)
