"""Structured Streaming jobs.

Every query writes to a sink with a checkpoint location on shared storage,
so a restarted or retried job resumes from the recorded file offsets and
state instead of re-reading input.  Windowed aggregations run in update
mode under a watermark (bounded state) and ``foreachBatch`` appends the
updated rows tagged with the batch id to a versioned folder; readers take
the newest version per key, which makes the sink idempotent when a batch is
replayed after a failure.
"""

from __future__ import annotations

import tempfile
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sagebrush import config as C


# --- T1 / T2 ----------------------------------------------------------------------------------

def log_stream(spark: SparkSession, src_dir: str, labels: dict[str, str] | None = None,
               max_files_per_trigger: int | None = None, glob: str = "*") -> DataFrame:
    """T1 source (+T2 throttle): follow new files of a folder; the file source records
    which files were read in the query checkpoint, so a restart never re-reads them.
    Intake is capped in files per trigger; ``throttled_log_stream`` caps it in lines."""
    r = spark.readStream.format("text").option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    df = r.load(src_dir).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    for k, v in (labels or {"job": "app-logs", "service": "app"}).items():
        df = df.withColumn(k, F.lit(v))
    return df


def throttled_log_stream(spark: SparkSession, src_dir: str, checkpoint: str, labels: dict[str, str] | None = None,
                         rate: float = C.LOG_RATE_LINES_PER_S, burst: int = C.LOG_BURST_LINES, glob: str = "*",
                         share: dict[str, str] | None = None) -> DataFrame:
    """Lines of a folder's files, at most ``burst`` a micro-batch and ``rate`` a second over time.  The place reached is kept
    beside the query's ``checkpoint``.  ``share`` has the options of one of several streams over the folder."""
    from sagebrush.sources.throttled import ThrottledLines

    spark.dataSource.register(ThrottledLines)
    df = (spark.readStream.format("throttled_lines").option("position", f"{checkpoint.rstrip('/')}-position/offset.json")
          .option("glob", glob).option("linesPerSecond", str(rate)).option("burst", str(burst)).options(**(share or {})).load(src_dir))
    for k, v in (labels or {"job": "app-logs", "service": "app"}).items():
        df = df.withColumn(k, F.lit(v))
    return df


def run_batches_to_versions(df: DataFrame, sink_dir: str, checkpoint: str) -> None:
    """Run a stream batch after batch until its source has no more, one folder a batch, then stop.  Readers see the number of
    its batch in every row, as ``_batch``."""
    q = (df.writeStream.foreachBatch(_folder_writer(sink_dir)).option("checkpointLocation", checkpoint).start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()


_FILE_MANAGER = "spark.sql.streaming.checkpointFileManagerClass"


def _session_of_streams(spark: SparkSession, checkpoint: str) -> SparkSession:
    """A session with the settings of ``spark`` for streams of many small micro-batches.

    Spark writes checkpoint files by the FileContext interface, which on a local disk without Hadoop's native library starts several
    processes for every rename.  There the FileSystem interface, whose rename is the disk's own, writes them; on
    other storage, and where a setting names a way, nothing changes."""
    own = spark.newSession()
    known = own.conf.getAll
    for key, value in spark.conf.getAll.items():
        if known.get(key) != value:     # set since the session began
            own.conf.set(key, value)
    system = spark._jvm.org.apache.hadoop.fs.Path(checkpoint).getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getUri().getScheme() == "file" and spark.conf.get(_FILE_MANAGER, None) is None:
        own.conf.set(_FILE_MANAGER, "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager")
    return own


def run_throttled_to_versions(spark: SparkSession, src_dir: str, sink_dir: str, checkpoint: str, streams: int, **limits) -> None:
    """``streams`` throttled streams over one folder at a time, until it has no more.  They divide the files and share one bucket, so
    rate and burst (``limits``, as of ``throttled_log_stream``) hold for all of them together as for one; only what the engine
    does around a micro-batch runs beside the others'.  Rows carry ``_stream`` and ``_batch``.  A checkpoint goes on with as many streams
    or more."""
    checkpoint = checkpoint.rstrip("/")
    # each has a session: what a registered Python source takes to its tasks is one object a session, which streams at work at a
    # time would change under each other's hands
    sessions = [_session_of_streams(spark, checkpoint) for _ in range(streams)]

    def run(stream: int) -> None:
        share = {"stream": str(stream), "streams": str(streams), "owners": f"{checkpoint}/owners.json", "bucket": f"{folder}/bucket"}
        lines = throttled_log_stream(sessions[stream], src_dir, f"{checkpoint}/{stream}", share=share, **limits)
        run_batches_to_versions(lines, f"{sink_dir}/_stream={stream}", f"{checkpoint}/{stream}")

    with tempfile.TemporaryDirectory(prefix="throttle-") as folder, ThreadPoolExecutor(streams) as pool:
        for done in [pool.submit(run, stream) for stream in range(streams)]:
            done.result()


def run_to_sink(df: DataFrame, sink_dir: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Run a stream over everything available now (availableNow trigger), then stop."""
    q = (df.writeStream.format(fmt).option("path", sink_dir).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()


# --- versioned update sink --------------------------------------------------------------------

def _versioned_writer(sink_dir: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch id, overwritten on replay -> idempotent
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{sink_dir}/batch={batch_id}")
    return write


def _folder_writer(sink_dir: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # the number stands in the folder's name only: as a literal it would make new code to compile of every batch
        batch.write.mode("overwrite").parquet(f"{sink_dir}/_batch={batch_id}")
    return write


def run_update_to_versions(df: DataFrame, sink_dir: str, checkpoint: str) -> None:
    q: StreamingQuery = (df.writeStream.outputMode("update").foreachBatch(_versioned_writer(sink_dir))
                         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def read_latest_versions(spark: SparkSession, sink_dir: str, keys: list[str]) -> DataFrame:
    """Newest row per key over all batch folders (group-by max, combined map-side)."""
    df = spark.read.parquet(sink_dir)
    vals = [c for c in df.columns if c not in keys and c not in ("_batch", "batch")]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col("_batch")).alias("_r"))
    return best.select(*keys, "_r.*")


# --- T3 / T4 ----------------------------------------------------------------------------------

def stream_log_volume(stream: DataFrame, every: str = "1 hour", watermark: str = "10 minutes",
                      ts: str = "ts", labels: tuple[str, ...] = ("stream",), line: str = "line") -> DataFrame:
    """A16 over tumbling windows with a watermark (old windows leave the state)."""
    g = (stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", watermark)
         .groupBy(F.window("_t", every).alias("w"), *labels)
         .agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length(line)).alias("bytes")))
    return g.select(F.unix_seconds(F.col("w.start")).alias("window_start"), *labels, "lines", "bytes")


def stream_metrics(stream: DataFrame, every: str = "10 seconds", watermark: str = "10 minutes",
                   ts: str = "ts", target: str = "target", value: str = "value") -> DataFrame:
    """T4: last and mean value per target and scrape interval."""
    g = (stream.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", watermark)
         .groupBy(F.window("_t", every).alias("w"), target)
         .agg(F.max_by(value, F.struct("_t", value)).alias("last"), F.avg(value).alias("mean"),
              F.count(F.lit(1)).alias("samples")))
    return g.select(F.unix_seconds(F.col("w.start")).alias("window_start"), target, "last", "mean", "samples")


def with_late(kept: DataFrame, whole: DataFrame, keys: list[str], count: str) -> DataFrame:
    """What a stream kept beside the same aggregate over all that was delivered: ``late`` rows came after the watermark had
    passed their window.  A window whose rows were all late stands with count 0; the other values of it are null.
    Both sides are one row per key and window, so this is a join of aggregates."""
    values = [c for c in kept.columns if c not in (*keys, count)]
    both = whole.select(*keys, F.col(count).alias("_all")).join(kept, keys, "left")
    seen = F.coalesce(F.col(count), F.lit(0))
    return both.select(*keys, *values, seen.alias(count), (F.col("_all") - seen).alias("late"))


# --- T5 requests over the limit ------------------------------------------------------------------

def requests_over_limit(requests: DataFrame, key: str, ts: str, rate_per_min: float = C.RATE_API_PER_MIN,
                        burst: int = C.RATE_API_BURST, watermark: str = "10 minutes") -> DataFrame:
    """T5: requests per key and minute, and how many exceed what the limit lets through in it (rate and burst).

    A windowed count under a watermark, the same for tables and streams.  Counts are added up before the shuffle, so a
    key with most of the requests is one row per task and minute; a stream's state is one count per open minute."""
    allowed = int(rate_per_min + burst)
    g = (requests.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", watermark)
         .groupBy(F.window("_t", "1 minute").alias("w"), F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("requests")))
    return g.select("key", F.unix_seconds("w.start").alias("window_start"), "requests",
                    F.greatest(F.col("requests") - allowed, F.lit(0)).cast("long").alias("over"))


# --- T6 / T7 ----------------------------------------------------------------------------------

def stream_upsert(stream: DataFrame, changes_dir: str, checkpoint: str) -> None:
    """Feed documents continuously; every micro-batch is appended to a change log
    folder keyed by batch id (idempotent on replay).  Readers apply S2 over base + log."""
    q = (stream.writeStream.foreachBatch(_versioned_writer(changes_dir))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def compact_changes(spark: SparkSession, changes_dir: str, key: str, ts: str) -> None:
    """Fold the change log to one version per key, so that what readers apply grows with the keys and not with time.

    The newest version (by ``ts``, then batch) of every key is written as the folder of the highest batch that it holds, under a
    new name; only then are the folded batches deleted.  A reader between both steps sees some versions twice, which S2 settles.  Batches
    that arrive meanwhile have higher numbers and stay.  Run it between two runs of the stream."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(changes_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = sorted(x.getPath().toString() for x in fs.listStatus(fs_path(changes_dir)) if x.isDirectory())
    if len(folders) < 2:
        return
    log = spark.read.parquet(*folders)
    values = [c for c in log.columns if c not in (key, "_batch")]
    order = F.struct(F.col(ts), F.col("_batch"))
    newest = log.groupBy(key).agg(F.max_by(F.struct(*values, "_batch"), order).alias("_r")).select(key, "_r.*")
    last = max(int(f.rsplit("batch=", 1)[1]) for f in folders)
    target = f"{changes_dir}/compacted-batch={last}"
    if target.rsplit("/", 1)[1] in {f.rsplit("/", 1)[1] for f in folders}:
        return      # nothing has come since
    newest.write.mode("overwrite").parquet(target)
    for f in folders:
        fs.delete(fs_path(f), True)


def read_changes(spark: SparkSession, changes_dir: str) -> DataFrame:
    """The change log, compacted or not."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(changes_dir).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [x.getPath().toString() for x in fs.listStatus(fs_path(changes_dir)) if x.isDirectory()]
    return spark.read.parquet(*folders).drop("_batch")


def stream_embed(stream: DataFrame, col: str, embedder, out: str = "embedding") -> DataFrame:
    """Vectors computed as documents arrive (mapInPandas works on streaming frames)."""
    from sagebrush.operators.vectors import embed_text

    return embed_text(stream, col, embedder, out)
