"""Checked queries for sinks, feeds and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagebrush.operators.reports import epoch_ms
from sagebrush.plans import catalog_search  # noqa: F401  (S10 reuses the R1 oracle)
from sagebrush.operators.vectors import HashingEmbedder
from sagebrush.plans.catalog_logs import scratch_path, write_log_files
from sagebrush.plans.registry import register, tidy
from sagebrush.sources import writers as WR
from sagebrush.sources.tables import view
from sagebrush.streaming import pipelines as ST


def _stream_copy(spark, df, name: str, n_files: int = 4, max_files: int | None = 1, order_by: str | None = None):
    """Write ``df`` as parquet files and open them as a file stream (schema given).  Each of the ``n_files`` shares
    stands in as many files as there are cores, so that all of them write and read; a micro-batch takes ``max_files`` shares.
    With ``order_by`` the files are time ranges and arrive in one micro-batch, so a
    watermark sees no late rows."""
    folder = scratch_path(spark, name)
    each = spark.sparkContext.defaultParallelism
    (df.repartitionByRange(max(n_files, each), order_by) if order_by else df.repartition(n_files * each)).write.parquet(folder)
    r = spark.readStream.schema(df.schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files * each)
    return r.parquet(folder)


def _changes(spark, sf):
    o = view(spark, sf, "orders")
    return (o.filter(F.col("o_orderstatus") == "O")
            .withColumn("o_totalprice", F.col("o_totalprice") * F.lit(1.1))
            .withColumn("o_orderdate", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")))


_UPSERT_SQL = """SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 1.1e0 ELSE o_totalprice END, 6) AS o_totalprice,
  CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS o_orderdate, o_orderstatus
FROM orders"""


def _upsert_out(df):
    return tidy(df.select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus"))


@register("S2_upsert_latest", sql=_UPSERT_SQL)
def q_upsert(spark, sf):
    return _upsert_out(WR.upsert_latest(view(spark, sf, "orders"), _changes(spark, sf), "o_orderkey", "o_orderdate"))


@register("S2_upsert_bucketed", sql=_UPSERT_SQL)
def q_upsert_bucketed(spark, sf):
    import uuid

    table = f"orders_base_{uuid.uuid4().hex[:12]}"
    WR.write_bucketed(view(spark, sf, "orders"), table, "o_orderkey", 16)
    return _upsert_out(WR.merge_bucketed(spark, table, _changes(spark, sf), "o_orderkey", "o_orderdate", 16))


@register("T6_stream_upsert", sql=_UPSERT_SQL)
def q_stream_upsert(spark, sf):
    """Four ordered deliveries with an older version before and between the newest ones; the log is compacted after the second and
    after the last."""
    changes_dir, ck, feed = scratch_path(spark, "changes"), scratch_path(spark, "ck-upsert"), scratch_path(spark, "feed")
    changes = _changes(spark, sf)
    stale = (changes.withColumn("o_orderdate", F.col("o_orderdate") - F.expr("INTERVAL 12 HOURS"))
             .withColumn("o_totalprice", F.col("o_totalprice") * F.lit(0.5)))
    odd = F.col("o_orderkey") % 2 == 1
    for delivery, rows in enumerate((stale, changes.filter(odd), stale, changes.filter(~odd))):
        rows.write.mode("append").parquet(feed)
        ST.stream_upsert(spark.readStream.schema(changes.schema).parquet(feed), changes_dir, ck)
        if delivery in (1, 3):
            ST.compact_changes(spark, changes_dir, "o_orderkey", "o_orderdate")
    return _upsert_out(WR.upsert_latest(view(spark, sf, "orders"), ST.read_changes(spark, changes_dir), "o_orderkey", "o_orderdate"))


@register("S3_write_docs", sql="SELECT doc_id, app, title, updatedAt FROM files_v", views=["files_v"])
def q_write_docs(spark, sf):
    path = scratch_path(spark, "file-docs")
    WR.write_docs(view(spark, sf, "files_v").select("doc_id", "app", "title", "updatedAt"), path, "app")
    return tidy(WR.read_docs(spark, path).select("doc_id", "app", "title", "updatedAt"))


@register("S3_typed_mail", sql="""SELECT concat('m', CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS "docId", role AS app,
  concat('own-', CAST(turn AS VARCHAR)) AS own_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_chunks,
  CAST(turn AS BIGINT) * 1000 AS "timestamp", concat(role, '@example.org') AS "from", CAST(1 AS BIGINT) AS n_to,
  CAST(length(text) AS BIGINT) AS size, true AS no_vectors FROM conversations""")
def q_typed_mail(spark, sf):
    """Mails with a map, arrays and structs, held to their declared type on writing and read back by it."""
    path = scratch_path(spark, "mail-docs")
    chunks = F.split("text", "\n")
    mails = view(spark, sf, "conversations").select(
        F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("docId"),
        F.create_map(F.lit("me"), F.concat(F.lit("own-"), F.col("turn").cast("string"))).alias("userMap"), chunks.alias("chunks"),
        (F.col("turn").cast("bigint") * 1000).alias("timestamp"), F.col("role").alias("app"),
        F.concat("role", F.lit("@example.org")).alias("from"), F.array(F.lit("all@example.org")).alias("to"),
        F.array(F.struct(F.lit("txt").alias("fileType"), F.length("text").cast("bigint").alias("fileSize"))).alias("attachments"))
    WR.write_docs(mails, path, "app", doc_type="mail")
    back = WR.read_docs(spark, path, doc_type="mail")
    return tidy(back.select("docId", "app", F.col("userMap")["me"].alias("own_id"), F.size("chunks").alias("n_chunks"), "timestamp", "from",
                            F.size("to").alias("n_to"), F.col("attachments")[0]["fileSize"].alias("size"),
                            F.col("chunk_embeddings").isNull().alias("no_vectors")))


@register("S1_feed_files", sql="""SELECT CASE WHEN doc_id % 10 = 6 THEN NULL ELSE concat('f', CAST(doc_id AS VARCHAR)) END AS "docId", app, title,
  CASE doc_id % 10 WHEN 5 THEN NULL ELSE updatedAt END AS "updatedAt",
  CASE doc_id % 10 WHEN 5 THEN 'malformed' WHEN 6 THEN 'no docId' WHEN 7 THEN 'malformed' END AS reason
FROM (SELECT doc_id, CASE WHEN doc_id % 10 IN (5, 6, 7) THEN NULL ELSE app END AS app, CASE WHEN doc_id % 10 IN (5, 6, 7) THEN NULL ELSE title END AS title,
  CASE WHEN doc_id % 10 IN (6, 7) THEN NULL ELSE updatedAt END AS updatedAt FROM files_v)""", views=["files_v"])
def q_feed_files(spark, sf):
    """A feed of JSON lines in which some rows have a wrong type (5), no id (6) or a broken end (7)."""
    path, kind = scratch_path(spark, "file-feed"), F.col("doc_id") % 10
    files = view(spark, sf, "files_v").select(
        "doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("docId"), "app", "title", F.split("body", "\n").alias("chunks"), "updatedAt")
    text = F.to_json(F.struct("docId", "app", "title", "chunks", "updatedAt"))
    ill = F.to_json(F.struct("docId", "app", F.lit("soon").alias("updatedAt")))
    files.select(F.when(kind == 5, ill).when(kind == 6, F.to_json(F.struct("app", "title"))).when(kind == 7, F.concat(
        F.lit('{"docId":"'), "docId", F.lit('","chunks":['))).otherwise(text).alias("value")).write.text(path)
    good, wrong = WR.read_feed(spark, path, "file")
    named = F.regexp_extract("value", r'"docId":"(\w+)"', 1)
    rows = good.select("docId", "app", "title", "updatedAt", F.lit(None).cast("string").alias("reason")).unionByName(
        wrong.select(F.when(named != "", named).alias("docId"), "reason"), allowMissingColumns=True)
    return tidy(rows)


@register("T1_stream_logs", sql="SELECT line, 'app-logs' AS job, 'app' AS service FROM log_lines_v", views=["log_lines_v"])
def q_stream_logs(spark, sf):
    src = write_log_files(spark, sf)
    sink, ck = scratch_path(spark, "log-sink"), scratch_path(spark, "ck-logs")
    ST.run_to_sink(ST.log_stream(spark, src, glob="*.txt"), sink, ck)
    ST.run_to_sink(ST.log_stream(spark, src, glob="*.txt"), sink, ck)     # restart: nothing is read twice
    return tidy(spark.read.parquet(sink).select("line", "job", "service"))


@register("T2_throttled", sql="SELECT line, 'app-logs' AS job, 'app' AS service FROM log_lines_v", views=["log_lines_v"])
def q_throttled(spark, sf):
    src = write_log_files(spark, sf)
    sink, ck = scratch_path(spark, "log-sink"), scratch_path(spark, "ck-throttle")
    ST.run_to_sink(ST.log_stream(spark, src, max_files_per_trigger=1, glob="*.txt"), sink, ck)
    return tidy(spark.read.parquet(sink).select("line", "job", "service"))


# limits of the checked query, far below the fixed ones so that the table comes in several batches
_T2_RATE, _T2_BURST = 20_000, 1_500
_T2_STREAMS = 4  # micro-batches at work at a time; the limits hold for all of them together


@register("T2_throttled_lines", sql="""SELECT line, 'app-logs' AS job, 'app' AS service, true AS within FROM log_lines_v""", views=["log_lines_v"])
def q_throttled_lines(spark, sf):
    """Every line arrives once; ``within`` says whether its micro-batch kept to the burst."""
    src = write_log_files(spark, sf)
    sink, ck = scratch_path(spark, "log-batches"), scratch_path(spark, "ck-lines")
    ST.run_throttled_to_versions(spark, src, sink, ck, _T2_STREAMS, rate=_T2_RATE, burst=_T2_BURST, glob="*.txt")
    rows = spark.read.parquet(sink)
    sizes = rows.groupBy("_stream", "_batch").agg((F.count(F.lit(1)) <= _T2_BURST).alias("within"))
    return tidy(rows.join(F.broadcast(sizes), ["_stream", "_batch"]).select("line", "job", "service", "within"))


_DELIVERY = "least(floor((day(ts) - 1) / 8), 3) + CASE WHEN event_id % 10 = 7 THEN 1 ELSE 0 END"


def _deliver(spark, rows, run) -> None:
    """Five ordered deliveries of about eight days each, every tenth row one delivery too late; ``run`` takes the stream of the feed
    over what has come, so that state and watermark go from run to run."""
    feed = scratch_path(spark, "feed")
    for delivery in range(5):
        rows.filter(F.expr(_DELIVERY) == delivery).drop("event_id").write.mode("append").parquet(feed)
        run(spark.readStream.schema(rows.drop("event_id").schema).parquet(feed))


def _late_sql(rows: str, seconds: int, key: str, kept: str) -> str:
    """Rows count until the watermark, ten minutes behind the newest row of the deliveries before, has passed their window."""
    return f"""SELECT window_start, {key}, {kept}, count(*) FILTER (NOT ok) AS late FROM (
  SELECT x.*, top IS NULL OR window_start + {seconds} > epoch(top) - 600 AS ok FROM (
    SELECT *, CAST(floor(epoch(ts) / {seconds}) * {seconds} AS BIGINT) AS window_start, {_DELIVERY} AS delivery FROM {rows}) x
  JOIN (SELECT delivery, max(max(ts)) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
        FROM (SELECT ts, {_DELIVERY} AS delivery FROM {rows}) GROUP BY delivery) w ON w.delivery = x.delivery) GROUP BY 1, 2"""


@register("T3_log_volume_late", sql=_late_sql("log_lines_v", 3600, "stream", """count(*) FILTER (ok) AS lines,
  CAST(sum(strlen(line)) FILTER (ok) AS BIGINT) AS bytes"""), views=["log_lines_v"])
def q_volume_late(spark, sf):
    rows = view(spark, sf, "log_lines_v").select("event_id", "ts", "stream", "line")
    sink, ck, keys = scratch_path(spark, "volume"), scratch_path(spark, "ck-volume"), ["window_start", "stream"]
    _deliver(spark, rows, lambda stream: ST.run_update_to_versions(ST.stream_log_volume(stream), sink, ck))
    found = ST.with_late(ST.read_latest_versions(spark, sink, keys), ST.stream_log_volume(rows), keys, "lines")
    return tidy(found.select(*keys, "lines", "bytes", "late"))


@register("T4_metrics_late", sql=_late_sql("""(SELECT event_id, ts, value, concat('10.0.0.', CAST(user_id % 4 AS VARCHAR)) AS target FROM events)""",
  10, "target", """round(arg_max(value, ts) FILTER (ok), 6) AS last, round(avg(value) FILTER (ok), 6) AS mean, count(*) FILTER (ok) AS samples"""))
def q_metrics_late(spark, sf):
    rows = view(spark, sf, "events").select("event_id", "ts", "value", F.concat(F.lit("10.0.0."), (F.col("user_id") % 4).cast("string")).alias("target"))
    sink, ck, keys = scratch_path(spark, "metrics"), scratch_path(spark, "ck-metrics"), ["window_start", "target"]
    _deliver(spark, rows, lambda stream: ST.run_update_to_versions(ST.stream_metrics(stream), sink, ck))
    found = ST.with_late(ST.read_latest_versions(spark, sink, keys), ST.stream_metrics(rows), keys, "samples")
    return tidy(found.select(*keys, "last", "mean", "samples", "late"))


@register("T3_stream_log_volume", sql="""SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, stream,
  count(*) AS lines, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM log_lines_v GROUP BY 1, 2""", views=["log_lines_v"])
def q_stream_volume(spark, sf):
    stream = _stream_copy(spark, view(spark, sf, "log_lines_v").select("ts", "stream", "line"), "lines",
                          max_files=None, order_by="ts")
    sink, ck = scratch_path(spark, "volume"), scratch_path(spark, "ck-volume")
    ST.run_update_to_versions(ST.stream_log_volume(stream), sink, ck)
    return tidy(ST.read_latest_versions(spark, sink, ["window_start", "stream"])
                .select("window_start", "stream", "lines", "bytes"))


@register("T4_stream_metrics", sql="""SELECT CAST(floor(epoch(ts) / 10) * 10 AS BIGINT) AS window_start,
  concat('10.0.0.', CAST(user_id % 4 AS VARCHAR)) AS target, round(arg_max(value, ts), 6) AS last, round(avg(value), 6) AS mean,
  count(*) AS samples FROM events GROUP BY 1, 2""")
def q_stream_metrics(spark, sf):
    e = view(spark, sf, "events").select("ts", F.concat(F.lit("10.0.0."), (F.col("user_id") % 4).cast("string"))
                                         .alias("target"), "value")
    sink, ck = scratch_path(spark, "metrics"), scratch_path(spark, "ck-metrics")
    ST.run_update_to_versions(ST.stream_metrics(_stream_copy(spark, e, "samples", max_files=None, order_by="ts")),
                              sink, ck)
    return tidy(ST.read_latest_versions(spark, sink, ["window_start", "target"])
                .select("window_start", "target", "last", "mean", "samples"))


# limit of the checked queries: two requests a minute and one in a burst, keyed by response status
_RL_RATE, _RL_BURST = 2, 1
_RL_SQL = f"""SELECT CAST(status AS VARCHAR) AS key, CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS window_start, count(*) AS requests,
  greatest(count(*) - {_RL_RATE + _RL_BURST}, 0) AS over FROM access_v GROUP BY 1, 2"""


@register("T5_rate_limit", sql=_RL_SQL, views=["access_v"])
def q_rate_limit(spark, sf):
    return tidy(ST.requests_over_limit(view(spark, sf, "access_v"), "status", "ts", _RL_RATE, _RL_BURST))


@register("T5_rate_limit_stream", sql=_RL_SQL, views=["access_v"])
def q_rate_limit_stream(spark, sf):
    stream = _stream_copy(spark, view(spark, sf, "access_v").select("ts", "status"), "requests", max_files=None, order_by="ts")
    sink, ck = scratch_path(spark, "rl"), scratch_path(spark, "ck-rl")
    ST.run_update_to_versions(ST.requests_over_limit(stream, "status", "ts", _RL_RATE, _RL_BURST), sink, ck)
    return tidy(ST.read_latest_versions(spark, sink, ["key", "window_start"]).select("key", "window_start", "requests", "over"))


@register("T7_stream_embed", sql="""WITH t AS (SELECT doc_id AS k, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS tok FROM documents),
c AS (SELECT k, CAST(CAST(('0x' || substr(md5(tok), 1, 8)) AS UBIGINT) % 64 AS BIGINT) AS dim, count(*) * 1e0 AS c FROM t GROUP BY k, dim)
SELECT k AS doc_id, dim, round(c / sqrt(sum(c * c) OVER (PARTITION BY k)), 6) AS value FROM c""")
def q_stream_embed(spark, sf):
    docs = _stream_copy(spark, view(spark, sf, "documents").select("doc_id", "text"), "docs")
    sink, ck = scratch_path(spark, "emb"), scratch_path(spark, "ck-emb")
    ST.run_to_sink(ST.stream_embed(docs, "text", HashingEmbedder(64)).select("doc_id", "embedding"), sink, ck)
    e = spark.read.parquet(sink).select("doc_id", F.posexplode("embedding").alias("dim", "value"))
    return tidy(e.filter(F.col("value") != 0).select("doc_id", F.col("dim").cast("bigint"), "value"))


@register("T8_daily_partitions", sql="""SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events FROM events GROUP BY 1, 2""")
def q_daily(spark, sf):
    path = scratch_path(spark, "events-by-day")
    WR.daily_partitions(view(spark, sf, "events"), path)
    return tidy(spark.read.parquet(path).groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("events")))


def _r1_sql() -> str:
    from sagebrush.plans.registry import ORACLE

    return ORACLE["R1_hybrid_search"]


@register("S10_materialize_hits", sql=_r1_sql())
def q_materialize(spark, sf):
    from sagebrush.plans.catalog_search import _inputs, _params
    from sagebrush.plans.search import hybrid_search

    q, d, v = _inputs(spark, sf)
    hits = hybrid_search(q, d, v, _params(), profile="default_native")
    path = scratch_path(spark, "hits")
    feats = ["vector_score", "combined_nativeRank", "doc_recency", "matched_field_count"]
    WR.materialize_hits(hits.select("query_id", "doc_id", "rank", "reranked", "score", "phase1", *feats), path, feats)
    back = spark.read.parquet(path)
    return tidy(back.select("query_id", "doc_id", "rank", "reranked", "score", "phase1", "match_features.*"))
