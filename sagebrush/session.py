"""Session settings and small planning helpers shared by every operator."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Plan-time broadcast bound (bytes). Spark's own runtime threshold (AQE) handles
# everything the estimate cannot prove small.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "sagebrush") -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    On a cluster, pass ``master=None`` and let the launcher decide; the
    shuffle partition count should then be sized to ~128 MB per partition.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST_LIMIT_BYTES))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    spread_locally(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``.  Only a local master, as in tests, may do without: there one
    process sees the fallback folder.  On a cluster a missing setting is an error, as a
    machine's own folder is not seen by the others."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = fallback or os.environ.get("SAGEBRUSH_CHECKPOINT_DIR") or "/tmp/sagebrush-checkpoints"
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def bound_arrow_batches(spark: SparkSession, limit: int = 64 * 1024 * 1024) -> None:
    """Rows that hold blocks of megabytes go to Python a few at a time: batches end at so many bytes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > limit:
        spark.conf.set(key, str(limit))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers where they would not find it: they import it by name, and a
    session started from another folder has it neither installed nor on PYTHONPATH."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    known = [os.path.abspath(x) for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x]
    if here in known or getattr(context, "_sagebrush_shipped", False):
        return
    with tempfile.TemporaryDirectory() as folder:
        archive = shutil.make_archive(os.path.join(folder, "sagebrush"), "zip", here, "sagebrush")
        kept = os.path.join(tempfile.mkdtemp(prefix="sagebrush-package-"), "sagebrush.zip")
        shutil.copyfile(archive, kept)  # the driver serves it for as long as the session lives
    context.addPyFile(kept)
    context._sagebrush_shipped = True


def estimated_bytes(df: DataFrame) -> int:
    """Optimizer size estimate of ``df`` (an upper bound for scans/filters/projections)."""
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    except Exception:  # noqa: BLE001 - estimate unavailable: treat as large
        return 1 << 62
    # py4j returns small Scala BigInts as Python ints, large ones as JVM objects
    return int(size) if isinstance(size, int) else int(size.toString())


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast ``df`` only when its plan estimate proves it small; otherwise
    leave the join to a shuffle (AQE may still switch at runtime on real sizes)."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if estimated_bytes(df) <= limit else df


SPREAD_SETTING = "sagebrush.spread.partitions"


def spread(df: DataFrame) -> DataFrame:
    """Before CPU-heavy per-row work: deal the rows to as many tasks as ``sagebrush.spread.partitions`` says.  It is the
    caller's choice, for inputs whose files give fewer splits than there are cores; unset, as on a cluster, rows
    stay where they were read."""
    n = df.sparkSession.conf.get(SPREAD_SETTING, None)
    return df.repartition(int(n)) if n else df


def spread_locally(spark: SparkSession) -> None:
    """The choice of this library's own local runs: its test files have one row group each."""
    if spark.sparkContext.master.split("[")[0] == "local" and spark.conf.get(SPREAD_SETTING, None) is None:
        spark.conf.set(SPREAD_SETTING, str(spark.sparkContext.defaultParallelism))
