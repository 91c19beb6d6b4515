"""Contiguous integer ids and the ratings table.

``row_number() over (order by keys)`` without a partition puts every key into one task. Here the
distinct keys are range-partitioned and sorted, each task numbers its own rows, and a table with
one row per partition supplies the offsets. The result equals the serial window exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelens.session import written


def contiguous_ids(df: DataFrame, cols: str | Sequence[str], name: str,
                   num_partitions: int | None = None, checkpoint: bool = True,
                   unique: bool = False, dtype: str = "int") -> DataFrame:
    """M2: distinct ``cols`` -> ``name`` numbered 1..n in key order (nulls first).

    The numbered keys are written to the shared checkpoint folder: later joins reuse the same
    ids even if a stage is recomputed after an executor loss. ALS needs 32-bit ids (the default
    ``dtype``, an overflow is an error); ranks over longer tables ask for bigint. ``unique=True`` states that
    the key columns are already distinct (e.g. they contain the member id) and saves the
    distinct shuffle."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    keys = df.select(*cols) if unique else df.select(*cols).distinct()
    # without an explicit count AQE sizes the range partitions (coalescing keeps adjacent
    # ranges together, so the order across partitions is preserved)
    ranged = (keys.repartitionByRange(num_partitions, *cols) if num_partitions
              else keys.repartitionByRange(*cols))
    ranged = (ranged.sortWithinPartitions(*cols)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id()))
    if checkpoint:
        ranged = written(ranged, "ids")
    per_part = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"),
                                           F.min("_pos").alias("_first"))
    # one row per partition: a single-task window over it is bounded by the partition count
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_part", "_first",
                              F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = ranged.join(F.broadcast(offsets), "_part")
    ident = (F.col("_offset") + F.col("_pos") - F.col("_first") + 1).cast(dtype)
    return numbered.select(*cols, ident.alias(name))


def grouped_ids(df: DataFrame, group: str, cols: str | Sequence[str], name: str) -> DataFrame:
    """M2 within groups: distinct (group, cols) numbered 1..n in each group, in key order. One
    contiguous numbering serves all groups; a group's first number is taken off."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    every = contiguous_ids(df, [group, *cols], "_id", dtype="bigint")
    first = written(every.groupBy(group).agg(F.min("_id").alias("_first")), "first-ids")
    same = F.col(group).eqNullSafe(F.col("_group"))
    return every.join(first.withColumnRenamed(group, "_group"), same).select(
        group, *cols, (F.col("_id") - F.col("_first") + 1).cast("int").alias(name))


def ratings(features: DataFrame, user_map: DataFrame, product_map: DataFrame,
            product_keys: Sequence[str] = ("feature_name", "feature_value", "chronic_flag")
            ) -> DataFrame:
    """M3: features -> (user_id, product_id, confidence float).

    The product map (bounded by the condition taxonomy) is a written table, so Spark sends it to
    every task when its bytes allow; the user map joins by shuffle on member_id. Duplicate (user,
    product) pairs would change the fit, so they are merged with ``max``; grouping by
    (member_id, user_id, product_id) right after the join reuses the join's partitioning on
    member_id, so the feature table is shuffled once."""
    keys = list(product_keys)
    pm = product_map.select(*keys, "product_id")
    with_ids = features.join(pm, keys, "inner").join(user_map, "member_id", "inner")
    merged = (with_ids.groupBy("member_id", "user_id", "product_id")
              .agg(F.max(F.col("confidence").cast("float")).alias("confidence")))
    return merged.select("user_id", "product_id", "confidence")
