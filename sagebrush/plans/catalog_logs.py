"""Checked queries for logs, access logs and metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sagebrush.operators import logs as LG
from sagebrush.plans.registry import register, tidy
from sagebrush.session import ensure_checkpoint_dir
from sagebrush.sources.tables import view


def scratch_path(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_log_files(spark, sf, n_files: int = 4) -> str:
    """log_lines_v written as text files (a few files), returns the folder."""
    out = scratch_path(spark, "app-logs")
    view(spark, sf, "log_lines_v").select("line").repartition(n_files).write.text(out)
    return out


@register("S4_read_log_files", sql="SELECT line, 'app-logs' AS job, 'app' AS service FROM log_lines_v",
          views=["log_lines_v"])
def q_read_logs(spark, sf):
    folder = write_log_files(spark, sf)
    return tidy(LG.read_log_files(spark, f"{folder}/*.txt").select("line", "job", "service"))


@register("S5_read_container_logs", sql="""SELECT line, stream, epoch_us(ts) AS ts_us, substr(md5(stream), 1, 12) AS container_id
FROM log_lines_v""", views=["log_lines_v"])
def q_container_logs(spark, sf):
    out = scratch_path(spark, "containers")
    ll = view(spark, sf, "log_lines_v")
    (ll.select(F.concat("line", F.lit("\n")).alias("log"), "stream",
               F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"),
               F.substring(F.md5("stream"), 1, 12).alias("cid"))
     .write.partitionBy("cid").json(out))
    df = LG.read_container_logs(spark, f"{out}/*/*.json")
    return tidy(df.select("line", "stream", F.unix_micros("ts").alias("ts_us"),
                          F.regexp_replace("container_id", "^cid=", "").alias("container_id")))


@register("S6_read_access_log", sql="""SELECT remote_addr, CAST(floor(epoch(ts)) AS BIGINT) AS ts_s,
  CASE WHEN status = 500 THEN 'POST' ELSE 'GET' END AS method, path, CAST(status AS BIGINT) AS status, body_bytes
FROM access_v""", views=["access_v"])
def q_access_log(spark, sf):
    a = view(spark, sf, "access_v")
    method = F.when(F.col("status") == 500, F.lit("POST")).otherwise(F.lit("GET"))
    lines = a.select(LG.format_access_line("remote_addr", "ts", method, "path", "status", "body_bytes").alias("line"))
    p = LG.read_access_log(lines)
    return tidy(p.select("remote_addr", F.unix_seconds("time_local").alias("ts_s"), "method", "path", "status",
                         "body_bytes"))


@register("S7_read_metric_samples", sql="""SELECT epoch_us(ts) // 1000 AS ts_ms, 'app' AS job,
  concat('10.0.0.', CAST(user_id % 4 AS VARCHAR), ':9100') AS target, concat('app_', event_type, '_value') AS metric,
  round(value, 6) AS value FROM events""")
def q_metrics(spark, sf):
    from sagebrush.operators.reports import epoch_ms

    e = view(spark, sf, "events")
    line = F.format_string('%s{job="%s",instance="%s"} %s %d', F.concat(F.lit("app_"), "event_type", F.lit("_value")),
                           F.lit("app"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 4).cast("string"), F.lit(":9100")),
                           F.col("value").cast("string"), epoch_ms("ts"))
    m = LG.read_metric_samples(e.select(line.alias("line")))
    return tidy(m.select(F.unix_millis("ts").alias("ts_ms"), "job", "target", "metric", "value"))


def _containers(spark, sf):
    c = view(spark, sf, "containers_v")
    return c.select(F.col("name").alias("container_name_raw"), "network_mode", F.col("id").alias("container_id_raw"),
                    "compose_service", F.col("image").alias("docker_image"), F.col("stream").alias("log_stream"))


@register("K20_relabel", sql="""SELECT name AS container_name_raw, nullif(regexp_extract(name, '^/?(.*)$', 1), '') AS container_name,
  CASE WHEN regexp_full_match(coalesce(compose_service, ''), '(.+)') THEN compose_service
       ELSE nullif(regexp_extract(name, '^/?(.*)$', 1), '') END AS service,
  nullif(stream, '') AS stream,
  CASE WHEN regexp_full_match(id, '(.{12}).*') THEN substr(id, 1, 12) END AS container_id,
  CASE WHEN regexp_full_match(coalesce(image, ''), '([^:]+):?.*') THEN nullif(regexp_extract(image, '^([^:]+):?.*$', 1), '') END AS image
FROM containers_v WHERE regexp_full_match(name || ';' || network_mode, '/(app-.*|.*app.*|loki|promtail|grafana|vespa|postgres).*;.*')""",
          views=["containers_v"])
def q_relabel(spark, sf):
    out = LG.relabel(_containers(spark, sf), LG.container_rules("app"))
    return tidy(out.select("container_name_raw", "container_name", "service", "stream", "container_id", "image"))


@register("F12_keep_matching", sql="""SELECT name FROM containers_v
WHERE regexp_full_match(name || ';' || network_mode, '/(app-.*|.*app.*|loki|promtail|grafana|vespa|postgres).*;.*')""",
          views=["containers_v"])
def q_keep(spark, sf):
    keep = LG.container_rules("app")[-1]
    out = LG.keep_matching(_containers(spark, sf), keep.sources, keep.regex)
    return tidy(out.select(F.col("container_name_raw").alias("name")))


_ROUTE_SQL = """CASE WHEN path = '/keycloak' THEN 'keycloak_exact' WHEN path = '/grafana' THEN 'grafana_exact'
  WHEN starts_with(path, '/keycloak/') THEN 'keycloak'
  WHEN regexp_matches(path, '(?i)^/(twirp|validate)') THEN 'twirp'
  WHEN NOT starts_with(path, '/grafana/') AND regexp_matches(path, '(?i)^/.*\\.(css|js|png|jpg|jpeg|gif|ico|svg|woff|woff2|ttf|eot)$') THEN 'static'
  WHEN starts_with(path, '/grafana/') THEN 'grafana' WHEN starts_with(path, '/health') THEN 'health'
  WHEN starts_with(path, '/api/') THEN 'api' WHEN starts_with(path, '/auth') THEN 'auth' WHEN starts_with(path, '/rtc') THEN 'rtc'
  WHEN starts_with(path, '/') THEN 'root' END"""


@register("F13_route_of", sql=f"""SELECT event_id, {_ROUTE_SQL} AS route FROM access_v""", views=["access_v"])
def q_route(spark, sf):
    return tidy(view(spark, sf, "access_v").select("event_id", LG.route_of("path").alias("route")))


@register("F13_route_of_urls", sql=f"""WITH u AS (SELECT page_id, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), ''), '/') AS path FROM pages)
SELECT page_id, path, {_ROUTE_SQL} AS route FROM u""")
def q_route_urls(spark, sf):
    p = view(spark, sf, "pages").select("page_id", F.coalesce(F.expr(
        "nullif(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '')"), F.lit("/")).alias("path"))
    return tidy(p.select("page_id", "path", LG.route_of("path").alias("route")))


@register("A19_route_traffic", sql=f"""WITH r AS (SELECT ts, status, body_bytes, {_ROUTE_SQL} AS route FROM access_v)
SELECT CAST(floor(epoch(ts) / 60) * 60 AS BIGINT) AS window_start, route, count(*) AS requests, sum(body_bytes) AS bytes,
       round(avg(CASE WHEN status >= 500 THEN 1e0 ELSE 0e0 END), 6) AS error_share
FROM r WHERE route NOT IN ('health', 'static') GROUP BY 1, 2""", views=["access_v"])
def q_route_traffic(spark, sf):
    return tidy(LG.route_traffic(view(spark, sf, "access_v")))


@register("A16_log_volume", sql="""SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS window_start, stream,
  count(*) AS lines, CAST(sum(strlen(line)) AS BIGINT) AS bytes FROM log_lines_v GROUP BY 1, 2""", views=["log_lines_v"])
def q_log_volume(spark, sf):
    return tidy(LG.log_volume(view(spark, sf, "log_lines_v")))


@register("A17_log_patterns", sql="""SELECT regexp_replace(regexp_replace(line, '[0-9a-fA-F]{12,}', '<id>', 'g'), '[0-9]+', '<n>', 'g')
  AS pattern, count(*) AS lines FROM log_lines_v GROUP BY 1""", views=["log_lines_v"])
def q_log_patterns(spark, sf):
    return tidy(LG.log_patterns(view(spark, sf, "log_lines_v")))


# lines of a kind per event type, with identifiers, numbers and no figure at all
_MIXED_LINES = """CASE event_type WHEN 'error' THEN concat('request ', md5(CAST(event_id AS STRING)), ' failed with ', CAST(user_id AS STRING))
  WHEN 'click' THEN 'client went away' ELSE concat(event_type, ' by user=', CAST(user_id AS STRING), ' trace=', substr(md5(CAST(event_id AS STRING)), 1, 16)) END"""


@register("A17_log_patterns_mixed", sql=f"""WITH l AS (SELECT {_MIXED_LINES.replace("STRING", "VARCHAR")} AS line FROM events)
SELECT regexp_replace(regexp_replace(line, '[0-9a-fA-F]{{12,}}', '<id>', 'g'), '[0-9]+', '<n>', 'g') AS pattern, count(*) AS lines
FROM l GROUP BY 1""")
def q_log_patterns_mixed(spark, sf):
    return tidy(LG.log_patterns(view(spark, sf, "events").selectExpr(f"{_MIXED_LINES} AS line")))
