"""Stays and average length of stay per group over a stream of discharge files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from carelens.operators.summary import los_aggregates


def los_stream(spark: SparkSession, source_dir: str, schema: StructType,
               by: Sequence[str] = ("lob",), value: str = "los",
               max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame with the grouped count and rounded average (A3 expressions).
    The aggregation state holds one row per group, so it stays small whatever the volume."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source_dir).groupBy(*by).agg(*los_aggregates(value))


def start_summary(stream: DataFrame, checkpoint_location: str, output_path: str | None = None,
                  query_name: str | None = None) -> StreamingQuery:
    """Run the summary in complete mode. With ``output_path`` every micro-batch rewrites the
    (small) summary table as Parquet through ``foreachBatch``; without it the result goes to
    an in-memory table named ``query_name`` (tests and notebooks only)."""
    writer = stream.writeStream.outputMode("complete").option("checkpointLocation",
                                                              checkpoint_location)
    if output_path:
        def write(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(output_path)
        return writer.foreachBatch(write).start()
    return writer.format("memory").queryName(query_name or "los_summary").start()
