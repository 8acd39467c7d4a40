"""Checked queries for the embedding-request job."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagebrush.operators import embedding_jobs as EJ
from sagebrush.operators.vectors import HashingEmbedder
from sagebrush.plans.registry import register, tidy
from sagebrush.sources.tables import view

TEST_BATCH = 3


def request_bodies(spark, sf):
    """One JSON body per conversation: even ids send an input array (turn order), odd ids a
    single string; ids ending in 6..9 carry the four invalid shapes."""
    r = view(spark, sf, "requests_v")
    g = r.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("pos", "input"))).alias("items"))
    texts = F.transform("items", lambda x: x["input"])
    rid = F.col("request_id")
    good = F.when(rid % 2 == 0, F.to_json(F.struct(texts.alias("input"), F.lit("m").alias("model")))) \
        .otherwise(F.to_json(F.struct(texts[0].alias("input"), F.lit("m").alias("model"))))
    body = (F.when(rid % 10 == 6, F.lit("{bad")).when(rid % 10 == 7, F.lit("[1,2]"))
            .when(rid % 10 == 8, F.lit('{"model":"m"}')).when(rid % 10 == 9, F.lit('{"input":[],"model":"m"}'))
            .otherwise(good))
    return g.select("request_id", body.alias("body"))


_BODIES_SQL = """bodies AS (SELECT request_id, CASE WHEN request_id % 10 = 6 THEN '{bad' WHEN request_id % 10 = 7 THEN '[1,2]'
     WHEN request_id % 10 = 8 THEN '{"model":"m"}' WHEN request_id % 10 = 9 THEN '{"input":[],"model":"m"}'
     WHEN request_id % 2 = 0 THEN CAST(json_object('input', list(input ORDER BY pos), 'model', 'm') AS VARCHAR)
     ELSE CAST(json_object('input', arg_min(input, pos), 'model', 'm') AS VARCHAR) END AS body
   FROM requests_v GROUP BY request_id),
chk AS (SELECT request_id, body, CASE WHEN NOT json_valid(body) THEN 'Invalid JSON request body'
     WHEN json_type(body) <> 'OBJECT' THEN 'Request body must be a JSON object'
     WHEN NOT json_exists(body, '$.input') THEN 'Request body must include input'
     WHEN json_type(body, '$.input') = 'ARRAY' AND json_array_length(body, '$.input') = 0 THEN 'input array must not be empty'
     END AS error FROM bodies),
parsed AS (SELECT request_id, CASE WHEN json_type(body, '$.input') = 'VARCHAR' THEN [body->>'$.input']
     ELSE CAST(json_extract(body, '$.input') AS VARCHAR[]) END AS inputs FROM chk WHERE error IS NULL),
items AS (SELECT request_id, CAST(generate_subscripts(inputs, 1) - 1 AS BIGINT) AS pos, unnest(inputs) AS input FROM parsed)"""


@register("F8_valid_requests", sql=f"WITH {_BODIES_SQL} SELECT request_id, error FROM chk", views=["requests_v"])
def q_valid(spark, sf):
    b = request_bodies(spark, sf)
    return tidy(b.select("request_id", EJ.request_error("body").alias("error")))


@register("S8_parse_embedding_requests", sql=f"WITH {_BODIES_SQL} SELECT request_id, pos, input FROM items",
          views=["requests_v"])
def q_parse(spark, sf):
    good, _ = EJ.valid_requests(request_bodies(spark, sf))
    p = EJ.parse_embedding_requests(good)
    return tidy(p.select("request_id", F.posexplode("inputs").alias("pos", "input")))


@register("W6_assign_batches", sql=f"""WITH {_BODIES_SQL}
SELECT request_id, pos, pos // {TEST_BATCH} AS batch, (pos // {TEST_BATCH}) * {TEST_BATCH} AS start,
       pos % {TEST_BATCH} AS local_index FROM items""", views=["requests_v"])
def q_batches(spark, sf):
    good, _ = EJ.valid_requests(request_bodies(spark, sf))
    b = EJ.assign_batches(EJ.parse_embedding_requests(good).select("request_id", "inputs"), size=TEST_BATCH)
    return tidy(b.select("request_id", "pos", "batch", "start", "local_index"))


@register("W7_restore_order", sql=f"WITH {_BODIES_SQL} SELECT request_id, pos AS index, input FROM items",
          views=["requests_v"])
def q_restore(spark, sf):
    good, _ = EJ.valid_requests(request_bodies(spark, sf))
    b = EJ.assign_batches(EJ.parse_embedding_requests(good).select("request_id", "inputs"), size=TEST_BATCH)
    b = b.withColumn("index", F.col("start") + F.col("local_index"))
    return tidy(EJ.restore_order(b.select("request_id", "index", "input")))


@register("F9_retryable", sql="""SELECT request_id, batch, local_index,
  status IN (408, 409, 425, 429, 500, 502, 503, 504) OR contains(lower(body), 'model overloaded')
  OR contains(lower(body), 'no permits available') OR contains(lower(body), 'overloaded')
  OR contains(lower(body), 'too many requests') OR contains(lower(body), 'temporarily unavailable') AS retry
FROM responses_v""", views=["responses_v"])
def q_retryable(spark, sf):
    r = view(spark, sf, "responses_v")
    return tidy(r.select("request_id", "batch", "local_index", EJ.retryable("status", "body").alias("retry")))


@register("F10_retryable_error", sql="""SELECT request_id, batch, local_index,
  (CASE WHEN request_id % 3 = 0 THEN 'EPIPE' ELSE error_code END) IN
     ('ECONNRESET', 'ECONNREFUSED', 'EHOSTUNREACH', 'ENETUNREACH', 'ETIMEDOUT', 'ESOCKETTIMEDOUT')
  OR coalesce(regexp_matches(CASE WHEN local_index = 1 THEN 'socket Timeout after 30s' ELSE body END, '(?i)timeout'), false)
  AS retry FROM responses_v""", views=["responses_v"])
def q_retryable_error(spark, sf):
    r = view(spark, sf, "responses_v")
    code = F.when(F.col("request_id") % 3 == 0, F.lit("EPIPE")).otherwise(F.col("error_code"))
    msg = F.when(F.col("local_index") == 1, F.lit("socket Timeout after 30s")).otherwise(F.col("body"))
    return tidy(r.select("request_id", "batch", "local_index", EJ.retryable_error(code, msg).alias("retry")))


@register("K18_retry_delay", sql="""WITH r AS (SELECT request_id, batch, local_index, CAST(batch % 9 AS DOUBLE) AS attempt,
  CASE WHEN request_id % 4 = 0 THEN '2' WHEN request_id % 4 = 1 THEN 'abc' END AS retry_after,
  concat(CAST(request_id AS VARCHAR), ':', CAST(batch AS VARCHAR), ':', CAST(local_index AS VARCHAR)) AS k FROM responses_v),
c AS (SELECT *, least(1000e0 * pow(2e0, attempt), 60000e0) AS capped,
  CAST(('0x' || substr(md5('jitter:' || k), 1, 8)) AS UBIGINT) / 4294967296e0 AS frac FROM r)
SELECT request_id, batch, local_index,
  round(CASE WHEN TRY_CAST(retry_after AS DOUBLE) IS NOT NULL THEN greatest(0e0, TRY_CAST(retry_after AS DOUBLE) * 1000e0)
        ELSE capped + floor(frac * least(1000e0, capped)) END, 6) AS delay_ms FROM c""", views=["responses_v"])
def q_retry_delay(spark, sf):
    r = view(spark, sf, "responses_v")
    ra = F.when(F.col("request_id") % 4 == 0, F.lit("2")).when(F.col("request_id") % 4 == 1, F.lit("abc"))
    key = F.concat_ws(":", F.col("request_id").cast("string"), F.col("batch").cast("string"),
                      F.col("local_index").cast("string"))
    d = EJ.retry_delay_ms((F.col("batch") % 9).cast("double"), ra, key)
    return tidy(r.select("request_id", "batch", "local_index", d.alias("delay_ms")))


def _response_items(spark, sf):
    r = view(spark, sf, "responses_v")
    from pyspark.sql import Window

    w = Window.partitionBy("request_id", "batch")
    r = (r.withColumn("input_count", F.count(F.lit(1)).over(w))
         .withColumn("resp_pos", F.row_number().over(w.orderBy(F.col("local_index").desc())) - 1))
    return r.select("request_id", "batch", (F.col("batch") * 2).alias("start"), "input_count",
                    F.col("resp_pos").cast("long").alias("resp_pos"),
                    F.when(F.col("request_id") % 7 == 3, F.lit(99)).otherwise(F.col("local_index")).cast("long")
                    .alias("item_index"),
                    F.array(F.col("prompt_tokens").cast("double"), F.col("local_index").cast("double")).alias("embedding"),
                    F.when((F.col("batch") == 0) & (F.col("request_id") % 5 == 0), F.lit(None).cast("string"))
                    .otherwise(F.concat(F.lit("m"), (F.col("request_id") % 3).cast("string"))).alias("model"))


_ITEMS_SQL = """items AS (SELECT request_id, batch, batch * 2 AS start, count(*) OVER (PARTITION BY request_id, batch) AS input_count,
  row_number() OVER (PARTITION BY request_id, batch ORDER BY local_index DESC) - 1 AS resp_pos,
  CASE WHEN request_id % 7 = 3 THEN 99 ELSE local_index END AS item_index,
  [CAST(prompt_tokens AS DOUBLE), CAST(local_index AS DOUBLE)] AS embedding,
  CASE WHEN batch = 0 AND request_id % 5 = 0 THEN NULL ELSE concat('m', CAST(request_id % 3 AS VARCHAR)) END AS model
  FROM responses_v)"""


@register("A10_merge_batches", sql=f"""WITH {_ITEMS_SQL},
m AS (SELECT request_id, arg_min(model, batch) FILTER (WHERE model IS NOT NULL) AS model FROM items GROUP BY request_id)
SELECT i.request_id, start + CASE WHEN item_index >= 0 AND item_index < input_count THEN item_index ELSE resp_pos END AS index,
       round(embedding[1], 6) AS emb0, round(embedding[2], 6) AS emb1, m.model
FROM items i JOIN m ON m.request_id = i.request_id""", views=["responses_v"])
def q_merge(spark, sf):
    rows, summary = EJ.merge_batches(_response_items(spark, sf))
    out = rows.drop("model").join(summary.select("request_id", "model"), "request_id")
    return tidy(out.select("request_id", "index", F.col("embedding")[0].alias("emb0"),
                           F.col("embedding")[1].alias("emb1"), "model"))


@register("A7_merge_usage", sql="""WITH u AS (SELECT request_id, concat('{"prompt_tokens":', CAST(prompt_tokens AS VARCHAR),
  ',"total_tokens":', CAST(prompt_tokens + 2 AS VARCHAR), ',"model":"m","cached":"3","ratio":0.5}') AS usage FROM responses_v),
k AS (SELECT request_id, usage, unnest(json_keys(usage)) AS usage_key FROM u)
SELECT request_id, usage_key, round(sum(CAST(json_extract(usage, '$.' || usage_key) AS DOUBLE)), 6) AS value
FROM k WHERE json_type(usage, '$.' || usage_key) IN ('BIGINT', 'UBIGINT', 'DOUBLE') GROUP BY request_id, usage_key""",
          views=["responses_v"])
def q_usage(spark, sf):
    r = view(spark, sf, "responses_v")
    u = r.select("request_id", F.concat(F.lit('{"prompt_tokens":'), F.col("prompt_tokens").cast("string"),
                                        F.lit(',"total_tokens":'), (F.col("prompt_tokens") + 2).cast("string"),
                                        F.lit(',"model":"m","cached":"3","ratio":0.5}')).alias("usage"))
    return tidy(EJ.merge_usage(u, "request_id", "usage"))


@register("A8_timing_stats", sql="""WITH g AS (SELECT user_id, count(*) AS n, sum(value) AS t, min(value) AS mn, max(value) AS mx
  FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) GROUP BY user_id)
SELECT user_id, n, round(CASE WHEN n = 1 THEN t END, 6) AS upstream_ms, round(CASE WHEN n <> 1 THEN t END, 6) AS upstream_ms_total,
       round(CASE WHEN n <> 1 THEN mn END, 6) AS upstream_ms_min, round(CASE WHEN n <> 1 THEN mx END, 6) AS upstream_ms_max FROM g""")
def q_timing(spark, sf):
    return tidy(EJ.timing_stats(view(spark, sf, "events"), "user_id", "value"))


def turn_bodies(spark, sf):
    """One valid JSON body per conversation with all its turns."""
    g = view(spark, sf, "requests_v").groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("pos", "input"))).alias("items"))
    texts = F.transform("items", lambda x: x["input"])
    return g.select("request_id", F.to_json(F.struct(texts.alias("input"), F.lit("m").alias("model"))).alias("body"))


IN_FLIGHT = 8       # calls of the registered job that may run at once


@register("R12_embed_requests", sql="""WITH items AS (
  SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY pos) - 1 AS pos, input FROM requests_v),
tk AS (SELECT request_id, pos, unnest(list_filter(regexp_split_to_array(lower(input), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')) AS t FROM items),
cn AS (SELECT request_id, pos, CAST(('0x' || substr(md5(t), 1, 8)) AS UBIGINT) % 64 AS dim, count(*) AS c FROM tk GROUP BY ALL)
SELECT request_id, pos AS index, CAST(dim AS BIGINT) AS dim,
       round(c / sqrt(sum(c * c) OVER (PARTITION BY request_id, pos)), 6) AS value FROM cn""", views=["requests_v"])
def q_embed_requests(spark, sf):
    emb, _, _ = EJ.embed_requests(turn_bodies(spark, sf), EJ.EmbedderUpstream(HashingEmbedder(64)), batch_size=TEST_BATCH, expected_dims=64,
                                  in_flight=IN_FLIGHT)
    e = emb.select("request_id", "index", F.posexplode("embedding").alias("dim", "value")).filter("value <> 0")
    return tidy(e.select("request_id", "index", "dim", "value"))
