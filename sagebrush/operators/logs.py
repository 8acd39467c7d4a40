"""Logs, access logs and metrics.

Readers are plain file sources (text / JSON with an explicit schema), so a
cluster reads them split by file; parsing is regexp_extract per field
(JVM-side, whole-stage codegen); reports are tumbling-window group-bys with
partial aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagebrush import config as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- S4 / S5 --------------------------------------------------------------------------------

def read_log_files(spark: SparkSession, path_glob: str, labels: dict[str, str] | None = None) -> DataFrame:
    """Lines of log files with static labels and the file path."""
    labels = labels or {"job": "app-logs", "service": "app"}
    df = spark.read.text(path_glob).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    for k, v in labels.items():
        df = df.withColumn(k, F.lit(v))
    return df


CONTAINER_LOG_SCHEMA = T.StructType([T.StructField("log", T.StringType()), T.StructField("stream", T.StringType()),
                                     T.StructField("time", T.StringType())])


def read_container_logs(spark: SparkSession, path_glob: str) -> DataFrame:
    """Json-file container logs (log, stream, time) under an explicit schema;
    the container id is the name of the folder holding the file."""
    df = spark.read.schema(CONTAINER_LOG_SCHEMA).option("mode", "PERMISSIVE").json(path_glob)
    path = F.col("_metadata.file_path")
    return df.select(F.regexp_replace("log", "\n$", "").alias("line"), "stream",
                     F.to_timestamp("time").alias("ts"),
                     F.regexp_extract(path, r"/(?:[^/=]+=)?([^/]+)/[^/]+$", 1).alias("container_id"))


# --- S6 -------------------------------------------------------------------------------------

# fixed values: the `main` access log layout
ACCESS_LOG_PATTERN = (r'^(\S+) - (\S+) \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d{3}) (\d+) "([^"]*)" "([^"]*)" "([^"]*)"$')
TIME_LOCAL_FORMAT = "dd/MMM/yyyy:HH:mm:ss Z"


def format_access_line(remote_addr, ts, method, path, status, body_bytes, user="-", referer="-",
                       agent="-", forwarded="-") -> Column:
    """Render rows in the `main` layout (used by tests and demos)."""
    return F.format_string('%s - %s [%s] "%s %s HTTP/1.1" %d %d "%s" "%s" "%s"',
                           _c(remote_addr), F.lit(user), F.date_format(_c(ts).cast("timestamp"), TIME_LOCAL_FORMAT),
                           _c(method), _c(path), _c(status), _c(body_bytes), F.lit(referer), F.lit(agent),
                           F.lit(forwarded))


def read_access_log(lines: DataFrame, col: str = "line") -> DataFrame:
    """Parse the `main` format into columns (unparseable lines give NULL fields)."""
    g = lambda i: F.regexp_extract(col, ACCESS_LOG_PATTERN, i)
    ok = F.col(col).rlike(ACCESS_LOG_PATTERN)
    return lines.select(
        "*",
        F.when(ok, g(1)).alias("remote_addr"), F.when(ok, g(2)).alias("remote_user"),
        F.when(ok, F.to_timestamp(g(3), TIME_LOCAL_FORMAT)).alias("time_local"),
        F.when(ok, g(4)).alias("method"), F.when(ok, g(5)).alias("path"), F.when(ok, g(6)).alias("protocol"),
        F.when(ok, g(7).cast("int")).alias("status"), F.when(ok, g(8).cast("bigint")).alias("body_bytes"),
        F.when(ok, g(9)).alias("referer"), F.when(ok, g(10)).alias("user_agent"),
        F.when(ok, g(11)).alias("forwarded_for"))


# --- S7 -------------------------------------------------------------------------------------

EXPOSITION_PATTERN = r'^([a-zA-Z_:][a-zA-Z0-9_:]*)\{job="([^"]*)",instance="([^"]*)"\} (\S+) (\d+)$'


def read_metric_samples(lines: DataFrame, col: str = "line") -> DataFrame:
    """Exposition lines -> (ts, job, target, metric, value)."""
    g = lambda i: F.regexp_extract(col, EXPOSITION_PATTERN, i)
    return (lines.filter(F.col(col).rlike(EXPOSITION_PATTERN))
            .select(F.timestamp_millis(g(5).cast("bigint")).alias("ts"), g(2).alias("job"), g(3).alias("target"),
                    g(1).alias("metric"), g(4).try_cast("double").alias("value")))


# --- K20 / F12 ------------------------------------------------------------------------------

@dataclass
class Rule:
    """One relabel rule: source labels joined by ';', anchored regex, target label,
    replacement with $1-style groups, and the action (replace or keep)."""
    sources: list[str]
    target: str | None = None
    regex: str = "(.*)"
    replacement: str = "$1"
    action: str = "replace"


# fixed values: the container relabel rules, in order (project prefix is a parameter)
def container_rules(project: str = "app",
                    services: tuple[str, ...] = ("loki", "promtail", "grafana", "vespa", "postgres")) -> list[Rule]:
    keep = "/(" + "|".join([f"{project}-.*", f".*{project}.*", *services]) + ").*;.*"
    return [
        Rule(["container_name_raw"], "container_name", "/?(.*)"),
        Rule(["container_name_raw"], "service", "/?(.*)"),
        Rule(["compose_service"], "service", "(.+)"),
        Rule(["log_stream"], "stream"),
        Rule(["container_id_raw"], "container_id", "(.{12}).*"),
        Rule(["compose_image"], "image"),
        Rule(["docker_image"], "image", "([^:]+):?.*"),
        Rule(["compose_project"], "project"),
        Rule(["container_name_raw", "network_mode"], None, keep, action="keep"),
    ]


def relabel(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """K20 + F12: apply rules in order.  A replace rule whose anchored regex matches the
    ';'-joined sources sets the target to the expanded replacement, or removes the
    label when that is empty; no match leaves the target unchanged.  A keep rule
    drops rows whose joined sources do not match."""
    out = df
    for r in rules:
        present = [s for s in r.sources if s in out.columns]
        src = F.concat_ws(";", *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in present]) if present \
            else F.lit("")
        anchored = f"^(?:{r.regex})$"
        if r.action == "keep":
            out = out.filter(src.rlike(anchored))
            continue
        value = F.regexp_replace(src, anchored, r.replacement)
        new = F.when(src.rlike(anchored), F.when(value == "", F.lit(None).cast("string")).otherwise(value))
        cur = F.col(r.target) if r.target in out.columns else F.lit(None).cast("string")
        out = out.withColumn(r.target, F.when(src.rlike(anchored), new).otherwise(cur))
    return out


def keep_matching(df: DataFrame, cols: list[str], regex: str) -> DataFrame:
    """relabel action keep on its own."""
    return relabel(df, [Rule(cols, None, regex, action="keep")])


# --- F13 / A19 ------------------------------------------------------------------------------

# fixed values: edge locations (modifier, pattern, route name), in file order
LOCATIONS: list[tuple[str, str, str]] = [
    ("", "/rtc", "rtc"),
    ("~*", "^/(twirp|validate)", "twirp"),
    ("=", "/keycloak", "keycloak_exact"),
    ("^~", "/keycloak/", "keycloak"),
    ("", "/", "root"),
    ("", "/api/", "api"),
    ("", "/auth", "auth"),
    ("", "/health", "health"),
    ("~*", "static", "static"),
    ("=", "/grafana", "grafana_exact"),
    ("", "/grafana/", "grafana"),
]
UNLOGGED_ROUTES = ["health", "static"]


def _static(path: Column) -> Column:
    exts = "|".join(C.STATIC_EXTENSIONS)
    return ~path.startswith("/grafana/") & path.rlike(f"(?i)^/.*\\.({exts})$")


def route_of(path) -> Column:
    """location choice: exact match, then the longest prefix if it is `^~`,
    then the first matching regex in file order, then the longest prefix."""
    p = _c(path)
    prefixes = sorted([(pat, name, mod) for mod, pat, name in LOCATIONS if mod in ("", "^~")],
                      key=lambda x: -len(x[0]))
    longest = None
    longest_stop = None
    for pat, name, mod in reversed(prefixes):  # build so that longer prefixes win
        longest = F.when(p.startswith(pat), F.lit(name)) if longest is None else \
            F.when(p.startswith(pat), F.lit(name)).otherwise(longest)
        stop = F.lit(mod == "^~")
        longest_stop = F.when(p.startswith(pat), stop) if longest_stop is None else \
            F.when(p.startswith(pat), stop).otherwise(longest_stop)
    expr = None
    for mod, pat, name in LOCATIONS:
        if mod == "=":
            cond = p == pat
            expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = expr.when(F.coalesce(longest_stop, F.lit(False)), longest)
    for mod, pat, name in LOCATIONS:
        if mod == "~*":
            cond = _static(p) if pat == "static" else p.rlike(f"(?i){pat}")
            expr = expr.when(cond, F.lit(name))
    return expr.otherwise(longest)


def route_traffic(access: DataFrame, every: str = "1 minute", ts: str = "ts", path: str = "path",
                  status: str = "status", body_bytes: str = "body_bytes") -> DataFrame:
    """Requests, bytes and error share per route and interval; unlogged routes dropped."""
    r = access.withColumn("route", route_of(path)).filter(~F.col("route").isin(UNLOGGED_ROUTES))
    g = r.groupBy(F.window(F.col(ts).cast("timestamp"), every).alias("w"), "route").agg(
        F.count(F.lit(1)).alias("requests"), F.sum(body_bytes).alias("bytes"),
        F.avg((F.col(status) >= 500).cast("double")).alias("error_share"))
    return g.select(F.unix_seconds(F.col("w.start")).alias("window_start"), "route", "requests", "bytes", "error_share")


# --- A16 / A17 ------------------------------------------------------------------------------

def log_volume(df: DataFrame, every: str = "1 hour", ts: str = "ts", labels: tuple[str, ...] = ("stream",),
               line: str = "line") -> DataFrame:
    """Lines and bytes per label set and tumbling interval."""
    g = df.groupBy(F.window(F.col(ts).cast("timestamp"), every).alias("w"), *labels).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length(line)).alias("bytes"))
    return g.select(F.unix_seconds(F.col("w.start")).alias("window_start"), *labels, "lines", "bytes")


# fixed values: masks applied before counting line templates
PATTERN_MASKS = [(r"[0-9a-fA-F]{12,}", "<id>"), (r"[0-9]+", "<n>")]


def log_patterns(df: DataFrame, line: str = "line") -> DataFrame:
    """Mask ids and numbers, count each resulting template."""
    c = F.col(line)
    for pat, rep in PATTERN_MASKS:
        c = F.regexp_replace(c, pat, rep)
    return df.groupBy(c.alias("pattern")).agg(F.count(F.lit(1)).alias("lines"))
