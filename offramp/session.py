"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the library is tuned for. All of them are ordinary session settings, so a
# cluster's own values (partition counts above all) take precedence where it sets them.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Rows of this library carry whole texts and whole logit vectors, so Arrow batches are
    # bounded by bytes as well as by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g",
                  app: str = "offramp") -> SparkSession:
    """A local session for tests and the bench."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that driver and executors share.

    That is the session's ``spark.checkpoint.dir``, else the checkpoint folder set on the context. A
    session with neither has to set one: a machine's own temporary folder is not shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = chosen.get() if chosen.isDefined() else None
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base.rstrip('/')}/offramp/{name}-{uuid.uuid4().hex}"


def is_small(df: DataFrame) -> bool:
    """True below one default split per core and one file per core, by the optimiser's size
    estimate and the file list (no job is run).

    Such an input may be read by fewer tasks than there are cores: a file with one row group is
    read by one task. A stream is never small.
    """
    if df.isStreaming:
        return False
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return cores > 1 and size < cores * (128 << 20) and len(df.inputFiles()) < cores


def spread_small(df: DataFrame, *keys: str) -> DataFrame:
    """Hash a small input over all cores; return a larger one as it is, without a shuffle."""
    if is_small(df):
        return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys)
    return df
