"""Scans, sources and sinks (inventory S1-S11).

Everything here is a thin, declarative use of ``spark.read`` / ``df.write``: the scan stays a
Parquet relation so Catalyst can prune columns and push filters into it.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.session import scratch_path


def load_table(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """Read a Parquet table and register it under ``view`` (default: the file stem)."""
    df = spark.read.parquet(path)
    name = view or path.rstrip("/").rsplit("/", 1)[-1].split(".", 1)[0]
    df.createOrReplaceTempView(name)
    return df


def load_tables(spark: SparkSession, base_dir: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """S1 for several ``<base_dir>/<name>.parquet`` tables at once."""
    return {n: load_table(spark, f"{base_dir.rstrip('/')}/{n}.parquet", n) for n in names}


def read_delimited(spark: SparkSession, path: str, sep: str = "|", header: bool = True,
                   schema=None, infer_schema: bool = True) -> DataFrame:
    """Delimited text scan. An explicit ``schema`` skips the inference pass (preferred at
    scale: inference reads the data an extra time)."""
    reader = spark.read.option("sep", sep).option("header", header)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", infer_schema).csv(path)


def convert_to_parquet(spark: SparkSession, source_glob: str, out_dir: str, fmt: str = "csv",
                       options: dict | None = None, source_regex: str = r"([^/]+?)(\.[^./]*)?$",
                       parallelism: int = 4) -> dict[str, DataFrame]:
    """S3: convert every input matching ``source_glob`` to Parquet, each under its own schema.

    Files are grouped to inputs by a label taken from the path (group 1 of ``source_regex``; by
    default the file stem); each input is read and written by a job of its own, ``parallelism``
    at a time, to ``out_dir/<label>``. Returns the written tables by label."""
    label = F.regexp_extract("path", source_regex, 1)
    listed = (spark.read.format("binaryFile").load(source_glob).select("path")
              .groupBy(label.alias("label")).agg(F.collect_list("path").alias("paths")).collect())

    def convert(row):
        out = f"{out_dir.rstrip('/')}/{row['label']}"
        (spark.read.format(fmt).options(**(options or {})).load(sorted(row["paths"]))
         .write.mode("overwrite").parquet(out))
        return row["label"], spark.read.parquet(out)

    with ThreadPoolExecutor(parallelism) as pool:
        return dict(pool.map(convert, listed))


def persist_table(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Keep a table that several later jobs reuse (spills to disk rather than recomputing)."""
    return df.persist(level)


@contextmanager
def kept(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK,
         reliable: bool = False):
    """``df`` kept while the block runs, released when it ends, also by an error.
    ``reliable`` writes it to the shared checkpoint folder instead, where a lost executor costs
    nothing; what the block returns must have been computed in it."""
    if reliable:
        path = scratch_path(df.sparkSession, "kept")
        df.write.parquet(path)
        try:
            yield df.sparkSession.read.schema(df.schema).parquet(path)
        finally:
            target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)
        return
    held = persist_table(df, level)
    try:
        yield held
    finally:
        held.unpersist(blocking=True)


def latest(spark: SparkSession, path: str, column: str):
    """The largest value of a column. Read through the Parquet reader that answers aggregates from
    the files' footers (integers and dates; Spark scans the one column of other types)."""
    wanted = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        return spark.read.parquet(path).agg(F.max(column).alias("latest")).first()["latest"]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None,
               mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Write a result table."""
    writer = df.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


PREDICTION_COLUMNS = ["member_id", "feature_value", "feature_name", "chronic_flag", "rating",
                      "pred_rank"]


def export_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Ranked predictions with the fixed column list."""
    save_table(df.select(*PREDICTION_COLUMNS), path, fmt=fmt)


def export_explanations(df: DataFrame, path: str, rank: int, alpha: float, reg: float) -> None:
    """Explanations; the hyper-parameters become partition columns instead of a file name."""
    tagged = df.withColumns({"rank": F.lit(int(rank)), "alpha": F.lit(float(alpha)),
                             "lambda": F.lit(float(reg))})
    save_table(tagged, path, partition_by=["rank", "alpha", "lambda"], mode="append")


def export_small_tables(tables: dict[str, DataFrame], out_dir: str) -> None:
    """Case-study tables as one header CSV each. Only meant for small extracts (a handful of
    members): their rows meet in one task, which writes them; what the extract is taken from is
    read and filtered by as many tasks as it has partitions (``coalesce(1)`` would run those in
    the one task too)."""
    for name, df in tables.items():
        (df.repartition(1).write.mode("overwrite").option("header", True)
           .csv(f"{out_dir.rstrip('/')}/{name}"))


def row_count(df: DataFrame, alias: str = "row_cnt") -> DataFrame:
    """S10 as a one-row table (partial counts per task, one tiny final merge)."""
    return df.agg(F.count(F.lit(1)).alias(alias))


def peek(df: DataFrame, cols: Sequence[str | Column], n: int = 10,
         order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """First ``n`` rows of some columns. An ordering makes the peek repeatable; Spark
    plans it as a per-task top-n plus one merge (TakeOrderedAndProject)."""
    out = df.select(*cols)
    if order_by:
        out = out.orderBy(*order_by)
    return out.limit(n)
