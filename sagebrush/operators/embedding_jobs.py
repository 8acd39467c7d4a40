"""Batched embedding requests as a Spark job.

Plan: request bodies -> validate (F8) -> parse (S8) -> posexplode into
(request, pos) rows -> batch id = pos div size (W6) -> one upstream call per
(request, batch) in ``applyInPandas`` (a group is bounded by the batch size,
so no group can grow with the data) with retries (F9/F10/K18) -> the batch
results are merged back by index (A10), width-checked (P7), usage summed (A7)
and timings summarised (A8).  Errors become rows, never exceptions.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagebrush import config as C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- S8 / F8 ----------------------------------------------------------------------------------

def request_error(body, limit_bytes: int = C.PAYLOAD_LIMIT_BYTES) -> Column:
    """F8: why a request body is rejected (NULL when it is valid)."""
    b = _c(body)
    v = F.try_parse_json(F.when(b == "", F.lit("{}")).otherwise(b))  # no body at all is an empty object
    kind = F.schema_of_variant(v)
    inp = F.try_variant_get(v, "$.input", "variant")
    return (F.when(F.octet_length(b) > F.lit(limit_bytes), F.lit(f"Payload exceeds {limit_bytes} bytes"))
            .when(v.isNull(), F.lit("Invalid JSON request body"))
            .when(~kind.startswith("OBJECT"), F.lit("Request body must be a JSON object"))
            .when(inp.isNull(), F.lit("Request body must include input"))
            .when(F.schema_of_variant(inp).startswith("ARRAY") &
                  (F.size(F.try_variant_get(v, "$.input", "array<variant>")) == 0),
                  F.lit("input array must not be empty")))


def valid_requests(df: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """F8: split good and bad requests (bad ones carry ``error``)."""
    with_err = df.withColumn("error", request_error(body))
    return with_err.filter(F.col("error").isNull()).drop("error"), with_err.filter(F.col("error").isNotNull())


def parse_embedding_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """``input`` as an array of strings (a single string becomes a one-element array), and ``model``."""
    v = F.try_parse_json(_c(body))
    as_arr = F.try_variant_get(v, "$.input", "array<string>")
    as_str = F.try_variant_get(v, "$.input", "string")
    single = F.schema_of_variant(F.try_variant_get(v, "$.input", "variant")) == "STRING"
    inputs = F.when(single, F.array(as_str)).otherwise(as_arr)
    return df.withColumn("inputs", inputs).withColumn("model", F.try_variant_get(v, "$.model", "string"))


# --- F9 / F10 / K18 -----------------------------------------------------------------------------

def retryable(status, body) -> Column:
    """retry on listed statuses or overload phrases in the body."""
    text = F.lower(F.coalesce(_c(body).cast("string"), F.lit("")))
    cond = F.coalesce(_c(status).isin(C.RETRY_STATUSES), F.lit(False))
    for phrase in C.RETRY_PHRASES:
        cond = cond | text.contains(phrase)
    return cond


def retryable_error(code, message) -> Column:
    """retry on connection error codes or a message mentioning a timeout."""
    return F.coalesce(_c(code).isin(C.RETRY_ERROR_CODES), F.lit(False)) | F.coalesce(_c(message).rlike("(?i)timeout"), F.lit(False))


def retry_delay_ms(attempt, retry_after=None, jitter_key=None) -> Column:
    """K18 (Column form): see sagebrush.functions.scoring.retry_delay_ms."""
    from sagebrush.functions.scoring import retry_delay_ms as k18

    ra = None if retry_after is None else _c(retry_after).try_cast("double")
    return k18(attempt, ra, jitter_key)


def _retry_delay_py(attempt: int, retry_after: str | None, key: str) -> float:
    if retry_after is not None:
        try:
            ra = float(retry_after)
            if ra == ra and abs(ra) != float("inf"):
                return max(0.0, ra * 1000.0)
        except ValueError:
            pass
    capped = min(C.RETRY_BASE_MS * 2.0 ** attempt, float(C.RETRY_CAP_MS))
    frac = int(hashlib.md5(f"jitter:{key}".encode()).hexdigest()[:8], 16) / 4294967296.0
    return capped + float(int(frac * min(float(C.RETRY_JITTER_CAP_MS), capped)))


def _should_retry_py(status: int | None, body, code: str | None, message: str | None) -> bool:
    if status is not None:
        if status in C.RETRY_STATUSES:
            return True
        text = json.dumps(body if body is not None else "").lower()
        return any(p in text for p in C.RETRY_PHRASES)
    return (code in C.RETRY_ERROR_CODES) or ("timeout" in (message or "").lower())


# --- W6 / W7 -----------------------------------------------------------------------------------

def assign_batches(df: DataFrame, key: str = "request_id", inputs: str = "inputs",
                   size: int = C.EMBED_BATCH_SIZE) -> DataFrame:
    """One row per input with batch id, batch start and index inside the batch."""
    ex = df.select(key, *[c for c in df.columns if c not in (key, inputs)],
                   F.posexplode(inputs).alias("pos", "input"))
    return (ex.withColumn("batch", (F.col("pos") / F.lit(size)).cast("long"))
            .withColumn("start", F.col("batch") * F.lit(size))
            .withColumn("local_index", F.col("pos") % F.lit(size)))


def restore_order(df: DataFrame, key: str = "request_id", index: str = "index") -> DataFrame:
    """Rows in (request, index) order over all partitions; a request with most of the rows spans many."""
    return df.repartitionByRange(key, index).sortWithinPartitions(key, index)


# --- A10 ----------------------------------------------------------------------------------------

def merge_batches(items: DataFrame, key: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """A10: batch results back into one ordered list per request.

    ``items``: (key, batch, start, input_count, resp_pos, item_index, embedding, model), one row per
    returned item (resp_pos = position in the upstream response).  A valid item index (integer in
    [0, input_count)) is used, otherwise the response position.  Returns (rows with the global
    ``index``, per-request summary with first non-null model by batch and a length check)."""
    local = F.when(F.col("item_index").isNotNull() & (F.col("item_index") >= 0) &
                   (F.col("item_index") < F.col("input_count")), F.col("item_index")).otherwise(F.col("resp_pos"))
    rows = items.withColumn("index", F.col("start") + local)
    per_batch = items.groupBy(key, "batch").agg(F.count(F.lit(1)).alias("n"), F.first("input_count").alias("want"),
                                               F.min_by("model", F.when(F.col("model").isNotNull(), F.col("resp_pos")))
                                               .alias("model"))
    summary = per_batch.groupBy(key).agg(
        F.min_by("model", F.when(F.col("model").isNotNull(), F.col("batch"))).alias("model"),
        F.sum("n").alias("items"),
        F.max((F.col("n") != F.col("want")).cast("int")).alias("length_mismatch"))
    return rows, summary


# --- A7 / A8 ------------------------------------------------------------------------------------

_NUMERIC = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def merge_usage(df: DataFrame, key: str, usage_json: str) -> DataFrame:
    """Add up numeric usage values per request and usage key; strings, booleans and
    nested values are ignored (JSON numbers only)."""
    m = df.select(key, F.explode(F.from_json(usage_json, "map<string,variant>")).alias("k", "v"))
    t = F.schema_of_variant("v")
    num = t.isin(*_NUMERIC) | t.startswith("DECIMAL")
    return (m.filter(num).groupBy(key, "k")
            .agg(F.sum(F.variant_get("v", "$", "double")).alias("value")).withColumnRenamed("k", "usage_key"))


def timing_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key, one finite timing -> that value; several -> total, min and max."""
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    g = df.filter(finite).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"),
                                           F.min(v).alias("mn"), F.max(v).alias("mx"))
    one = F.col("n") == 1
    return g.select(key, "n", F.when(one, F.col("total")).alias("upstream_ms"),
                    F.when(~one, F.col("total")).alias("upstream_ms_total"),
                    F.when(~one, F.col("mn")).alias("upstream_ms_min"),
                    F.when(~one, F.col("mx")).alias("upstream_ms_max"))


# --- R12 ----------------------------------------------------------------------------------------

class EmbedderUpstream:
    """Upstream stand-in: calls an embedder object and answers in the OpenAI layout.
    ``fail_first`` makes the first call of chosen batches answer 503 (retry path)."""

    def __init__(self, embedder, fail_first: Callable[[str], bool] | None = None):
        self.embedder = embedder
        self.fail_first = fail_first or (lambda key: False)
        self.calls: dict[str, int] = {}

    def __call__(self, key: str, inputs: list[str], model: str | None):
        n = self.calls.get(key, 0)
        self.calls[key] = n + 1
        if n == 0 and self.fail_first(key):
            return 503, {"error": {"message": "Model overloaded"}}, {}
        vecs = self.embedder.embed(inputs)
        data = [{"object": "embedding", "index": i, "embedding": [float(x) for x in v]} for i, v in enumerate(vecs)]
        usage = {"prompt_tokens": sum(len((s or "").split()) for s in inputs)}
        usage["total_tokens"] = usage["prompt_tokens"]
        return 200, {"object": "list", "data": data, "model": model or getattr(self.embedder, "model", None),
                     "usage": usage}, {}


_BATCH_OUT = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("batch", T.LongType()),
    T.StructField("start", T.LongType()), T.StructField("input_count", T.LongType()),
    T.StructField("status", T.IntegerType()), T.StructField("attempts", T.IntegerType()),
    T.StructField("model", T.StringType()), T.StructField("usage", T.StringType()),
    T.StructField("upstream_ms", T.DoubleType()), T.StructField("error", T.StringType()),
    T.StructField("resp_pos", T.LongType()), T.StructField("item_index", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("http_status", T.IntegerType()),
])


class CallTimeout(Exception):
    """A call that did not answer in time; it is retried like a lost connection."""

    code = "ETIMEDOUT"


def call_within(upstream, timeout_ms: int, *args):
    """The upstream's answer, or ``CallTimeout``.  The call runs in a thread of its own that nobody waits for afterwards."""
    answer: list = []

    def call():
        try:
            answer.append((upstream(*args), None))
        except BaseException as e:  # noqa: BLE001 - handed to the caller
            answer.append((None, e))

    worker = threading.Thread(target=call, daemon=True)
    worker.start()
    worker.join(timeout_ms / 1000.0)
    if not answer:
        raise CallTimeout(f"upstream did not answer within {timeout_ms} ms")
    result, error = answer[0]
    if error is not None:
        raise error
    return result


def _call_batches(upstream, max_retries: int, sleep: Callable[[float], None], timeout_ms: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("local_index")
        rid, b = int(pdf["request_id"].iloc[0]), int(pdf["batch"].iloc[0])
        start, n = int(pdf["start"].iloc[0]), len(pdf)
        model = pdf["model"].iloc[0]
        key = f"{rid}:{b}"
        status, body, attempt, err = None, None, 0, None
        t0 = time.perf_counter()
        while True:
            try:
                status, body, headers = call_within(upstream, timeout_ms, key, pdf["input"].tolist(), model)
                code = msg = None
            except Exception as e:  # noqa: BLE001 - connection errors become rows
                status, body, headers, code, msg = None, None, {}, getattr(e, "code", None), str(e)
            if attempt >= max_retries or not _should_retry_py(status, body, code, msg):
                break
            sleep(_retry_delay_py(attempt, (headers or {}).get("retry-after"), key) / 1000.0)
            attempt += 1
        ms = (time.perf_counter() - t0) * 1000.0
        base = dict(request_id=rid, batch=b, start=start, input_count=n, status=status, attempts=attempt + 1,
                    model=None, usage=None, upstream_ms=ms, error=None, http_status=200)
        data = body.get("data") if isinstance(body, dict) else None
        failed = None                                   # (message, status the caller gets)
        if status is None or not 200 <= status < 300:
            inner = body.get("error") if isinstance(body, dict) else None
            said = inner.get("message") if isinstance(inner, dict) else None
            failed = (said or msg or f"Upstream embedding request failed with {status}", status or 502)
        elif not isinstance(data, list):
            failed = ("Upstream response does not include data array", 502)
        elif len(data) != n:
            failed = ("Upstream response data length does not match batch input length", 502)
        if failed:
            return pd.DataFrame([dict(base, error=failed[0], http_status=failed[1], resp_pos=None, item_index=None,
                                      embedding=None)])
        base.update(model=body.get("model"), usage=json.dumps(body.get("usage") or {}))
        rows = []
        for pos, item in enumerate(data):
            idx = item.get("index")
            rows.append(dict(base, resp_pos=pos, item_index=idx if isinstance(idx, int) else None,
                             embedding=item.get("embedding")))
        return pd.DataFrame(rows)

    return run


def embed_requests(requests: DataFrame, upstream, key: str = "request_id", body: str = "body",
                   batch_size: int = C.EMBED_BATCH_SIZE, max_retries: int = C.MAX_RETRIES,
                   expected_dims: int | None = None, sleep: Callable[[float], None] = time.sleep,
                   in_flight: int = C.UPSTREAM_CONCURRENCY, timeout_ms: int = C.REQUEST_TIMEOUT_MS):
    """Returns (embeddings, request_summary, rejected_requests).

    ``in_flight`` bounds the calls that run at once in the whole job: the batches are dealt over so many partitions, a task makes its
    calls one after the other.  (Speculative copies of a task would add to that: leave speculation off.)  A call that takes longer
    than ``timeout_ms`` counts as a lost connection.

    embeddings: (request_id, index, embedding) by global input position, of the requests that succeed as a whole;
    request_summary: status per request (errors as rows), model, usage, timing, widths."""
    good, bad = valid_requests(requests, body)
    parsed = parse_embedding_requests(good, body).select(F.col(key).cast("long").alias("request_id"), "inputs", "model")
    rows = assign_batches(parsed, "request_id", "inputs", batch_size)
    dealt = rows.repartition(in_flight, "request_id", "batch")      # the group-by keeps this partitioning
    results = dealt.groupBy("request_id", "batch").applyInPandas(_call_batches(upstream, max_retries, sleep, timeout_ms), _BATCH_OUT)
    results = results.checkpoint()       # upstream calls are not repeated if a later stage is retried
    # one failed batch fails its request: an upstream failure first, then a fault of an answer, by batch
    order = F.struct((F.col("status") >= 200) & (F.col("status") < 300), "batch")
    failed = results.filter(F.col("error").isNotNull()).groupBy("request_id").agg(
        F.min_by(F.struct("error", "http_status"), order).alias("f")).select("request_id", "f.error", F.col("f.http_status").alias("failed_status"))
    ok = results.filter(F.col("error").isNull())
    merged, summary = merge_batches(ok)
    # the model that was asked for comes before what the answers name
    asked = parsed.select("request_id", F.col("model").alias("asked"))
    summary = asked.join(summary, "request_id", "left").withColumn("model", F.coalesce("asked", "model")).drop("asked")
    widths = merged.groupBy("request_id").agg(F.sort_array(F.collect_set(F.size("embedding"))).alias("widths"))
    usage = merge_usage(results.filter(F.col("usage").isNotNull()).select("request_id", "batch", "usage")
                        .dropDuplicates(["request_id", "batch"]), "request_id", "usage")
    usage = usage.groupBy("request_id").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("usage_key", "value")))).alias("usage"))
    timing = timing_stats(results.dropDuplicates(["request_id", "batch"]), "request_id", "upstream_ms")
    summ = (summary.join(widths, "request_id", "left").join(failed, "request_id", "left")
            .join(usage, "request_id", "left").join(timing, "request_id", "left"))
    status = F.when(F.col("error").isNotNull(), F.col("failed_status"))
    if expected_dims is not None:
        bad_w = F.exists(F.coalesce(F.col("widths"), F.array()), lambda w: w != expected_dims)
        status = status.when(bad_w, F.lit(502))
    summ = summ.withColumn("http_status", status.otherwise(F.lit(200))).drop("failed_status")
    emb = merged.join(summ.filter("http_status = 200").select("request_id"), "request_id", "left_semi").select(
        "request_id", "index", "embedding")
    return emb, summ, bad
