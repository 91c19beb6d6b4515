"""Sources and sinks (S2-S8) on files written to a fresh scratch folder."""

import os
import tempfile

from pyspark.sql import functions as F

from carelens.sources import tables


def test_convert_and_write(spark):
    base = tempfile.mkdtemp(prefix="carelens-src-")
    a = spark.range(5).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b"),
                              F.lit("c").alias("c"))
    a.write.option("header", True).option("sep", "|").csv(os.path.join(base, "in", "alpha"))
    b = spark.range(2).select(F.lit("z").alias("z"), (F.col("id") + 7).alias("a"))
    b.write.option("header", True).option("sep", "|").csv(os.path.join(base, "in", "beta"))
    out = tables.convert_to_parquet(spark, os.path.join(base, "in", "*", "*.csv"),
                                    os.path.join(base, "out"), "csv",
                                    {"header": True, "sep": "|", "inferSchema": True},
                                    source_regex=r"/in/([^/]+)/")
    assert out["alpha"].columns == ["a", "b", "c"] and out["alpha"].count() == 5
    assert sorted(tuple(r) for r in out["beta"].collect()) == [("z", 7), ("z", 8)]


def test_readers_writers(spark):
    base = tempfile.mkdtemp(prefix="carelens-io-")
    df = spark.createDataFrame([(1, "a", 0.5, 1)], "member_id long, feature_value string, rating float, pred_rank int") \
        .withColumns({"feature_name": F.lit("condition_name"), "chronic_flag": F.lit("1")})
    tables.export_predictions(df, os.path.join(base, "preds"))
    assert spark.read.parquet(os.path.join(base, "preds")).columns == tables.PREDICTION_COLUMNS
    tables.export_explanations(df, os.path.join(base, "expl"), 50, 100.0, 7.0)
    back = spark.read.parquet(os.path.join(base, "expl"))
    assert {"rank", "alpha", "lambda"} <= set(back.columns)
    tables.export_small_tables({"t": df}, os.path.join(base, "case"))
    csv = tables.read_delimited(spark, os.path.join(base, "case", "t"), sep=",")
    assert csv.count() == 1
    loaded = tables.load_table(spark, os.path.join(base, "preds"), "preds_view")
    assert spark.sql("SELECT count(*) FROM preds_view").first()[0] == loaded.count() == 1
    assert tables.row_count(loaded).first().row_cnt == 1


def test_persist_table(spark):
    from pyspark import StorageLevel
    df = tables.persist_table(spark.range(10), StorageLevel.MEMORY_AND_DISK)
    assert df.count() == 10 and df.storageLevel.useDisk
    df.unpersist()
