"""Session helpers: a configured SparkSession and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job in the library relies on. AQE coalesces small shuffles and splits skewed
# join partitions at run time; the session time zone is fixed so date arithmetic is stable.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files of DataFrames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(app: str = "carelens", master: str | None = None,
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session. ``master`` and ``shuffle_partitions`` are for local runs;
    on a cluster leave them unset and let the launcher decide."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, taken from ``spark.checkpoint.dir`` when the
    cluster names one. Only a local-mode session without the setting (tests) gets a private
    folder; a cluster session without it is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        try:
            named = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            named = None
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors; "
                               "checkpoints cannot live in a machine-local folder on a cluster")
        named = tempfile.mkdtemp(prefix="carelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


_SCRATCH: dict[str, str] = {}       # application id -> its scratch folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name for an intermediate table, inside one folder of this application under
    the shared checkpoint folder. The application's folder is removed when its driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        base = ensure_checkpoint_dir(spark).rstrip("/")
        folder = f"{base}/scratch-{app}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _SCRATCH[app] = folder
    return f"{_SCRATCH[app]}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the scratch folder and read back: several jobs can read
    it with column pruning, and Spark knows its size in bytes when it plans a join."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
