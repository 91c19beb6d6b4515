"""Small planning helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelens.session import written


def small_side(df: DataFrame, label: str = "dimension") -> DataFrame:
    """The expected small side of a join, written once so that its size in bytes is known: Spark
    sends it to every task when that is below ``spark.sql.autoBroadcastJoinThreshold`` and joins
    by shuffle (which AQE can split) when it is not."""
    return written(df, label)


def rank_top(df: DataFrame, partition: Sequence[str], order: Sequence[Column], k: int | None,
             rank_col: str = "pred_rank") -> DataFrame:
    """``row_number`` per group under a total order, keep ranks <= k. With the filter
    right after the window Spark plans a partial WindowGroupLimit before the shuffle, so each
    task ships at most k rows per group even for a very large group."""
    w = Window.partitionBy(*partition).orderBy(*order)
    out = df.withColumn(rank_col, F.row_number().over(w))
    return out.filter(F.col(rank_col) <= k) if k is not None else out


MAX_CELLS = 4_000_000     # rows x items held at once by a scoring kernel (32 MB of doubles)


def row_chunks(batches, width: int, max_cells: int = MAX_CELLS):
    """Split Arrow batches into row slices so a (rows x width) matrix stays bounded."""
    step = max(1, max_cells // max(width, 1))
    for pdf in batches:
        for lo in range(0, len(pdf), step):
            yield pdf.iloc[lo:lo + step]
