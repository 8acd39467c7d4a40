"""Checked queries for the scalar ranking functions (K1-K13, K15-K17), S1, W2 and A20."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagebrush.functions import scoring as K
from sagebrush.operators.reports import epoch_ms
from sagebrush.operators.windows import top_k
from sagebrush.plans import search as S
from sagebrush.plans.catalog_profiles import N_RR, _file_ctes, _p, _two_out
from sagebrush.plans.registry import register, sql_random_score, tidy
from sagebrush.plans.sqlgen import scale_sql, two_phase_sql
from sagebrush.sources.tables import view
from sagebrush.sources.writers import read_docs

# order dates in epoch ms with the missing-value variants: NULL where id % 10 = 3, future where id % 10 = 4
_ORD_MS_SQL = ("CASE WHEN o_orderkey % 10 = 3 THEN NULL WHEN o_orderkey % 10 = 4 THEN 1706745600000 + 86400000 "
               "ELSE epoch_us(o_orderdate) // 1000 END")


def _orders_ms(spark, sf):
    o = view(spark, sf, "orders")
    ms = (F.when(F.col("o_orderkey") % 10 == 3, F.lit(None).cast("bigint"))
          .when(F.col("o_orderkey") % 10 == 4, F.lit(1706745600000 + 86400000)).otherwise(epoch_ms("o_orderdate")))
    return o.select("o_orderkey", ms.alias("ts"))


@register("K1_scale", sql=f"SELECT event_id, round({scale_sql('value')}, 6) AS scaled FROM events")
def q_scale(spark, sf):
    return tidy(view(spark, sf, "events").select("event_id", K.scale("value").alias("scaled")))


_AGE = "greatest(coalesce(1706745600e0 - ts / 1000e0, 7890000e0) / 31536000e0, 0e0)"


@register("K2_K3_document_age_recency", sql=f"""SELECT o_orderkey, round({_AGE}, 6) AS document_age,
  round(greatest(1e0 / (1e0 + 0.1e0 * sqrt({_AGE})), 0.5e0), 6) AS doc_recency
FROM (SELECT o_orderkey, {_ORD_MS_SQL} AS ts FROM orders)""")
def q_age(spark, sf):
    o = _orders_ms(spark, sf)
    age = K.document_age("ts")
    return tidy(o.select("o_orderkey", age.alias("document_age"), K.doc_recency(age).alias("doc_recency")))


@register("K4_K5_freshness", sql="""SELECT event_id,
  round(exp(-greatest(1706745600e0 - epoch_us(ts) / 1000000e0, 0e0) / 86400e0), 6) AS freshness_score,
  round(greatest(0e0, 1e0 - (1706745600e0 - (epoch_us(ts) // 1000) / 1000e0) / 7776000e0), 6) AS freshness
FROM events""")
def q_fresh(spark, sf):
    e = view(spark, sf, "events").select("event_id", epoch_ms("ts").alias("ms"),
                                         (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("s"))
    return tidy(e.select("event_id", K.freshness_score("s", unit="s").alias("freshness_score"),
                         K.freshness("ms").alias("freshness")))


_DAYS = ("greatest(0e0, CASE WHEN ts IS NULL THEN 7890000e0 / 86400e0 ELSE (1706745600e0 - ts / 1000e0) / 86400e0 END)")


@register("K6_K7_K8_recency_bins", sql=f"""SELECT o_orderkey, round({_DAYS}, 6) AS document_age_days,
  CAST(floor({_DAYS} / 7e0) AS DOUBLE) AS recency_bin_index,
  1000000000e0 - CAST(floor({_DAYS} / 7e0) AS DOUBLE) * 10000e0 AS recency_bin_score
FROM (SELECT o_orderkey, {_ORD_MS_SQL} AS ts FROM orders)""")
def q_bins(spark, sf):
    o = _orders_ms(spark, sf)
    d = K.document_age_days("ts")
    b = K.recency_bin_index(d, 7.0)
    return tidy(o.select("o_orderkey", d.alias("document_age_days"), b.alias("recency_bin_index"),
                         K.recency_bin_score(b).alias("recency_bin_score")))


@register("K9_K16_normalized_random", sql=f"""SELECT doc_id, round(greatest(0e0, least(n_chars / 10e0, 10000e0 - 1e0)), 6) AS nh,
  round({sql_random_score('doc_id', '7')}, 6) AS random_score FROM documents""")
def q_nh(spark, sf):
    d = view(spark, sf, "documents")
    return tidy(d.select("doc_id", K.normalized_hybrid(F.col("n_chars").cast("double")).alias("nh"),
                         K.random_score(F.col("doc_id"), "7").alias("random_score")))


@register("K11_K12_K13_K15_field_combinations", sql=f"""WITH {_file_ctes()},
g AS (SELECT f.*, q.query_id = 2 AS intent FROM f JOIN queries_v q ON q.query_id = f.query_id)
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(5e0 * native_title + 0.2e0 * native_chunks, 6) AS weighted,
  CAST(matched_field_count AS BIGINT) AS matched, round(cnr, 6) AS mean_over_matched,
  round(CASE WHEN intent THEN native_title ELSE cnr END, 6) AS switched, round(0.78e0 * cbm25, 6) AS boosted
FROM g""", views=["queries_v", "files_v", "chunk_vectors_v"])
def q_combos(spark, sf):
    q, d, v = view(spark, sf, "queries_v"), view(spark, sf, "files_v"), view(spark, sf, "chunk_vectors_v")
    c = S.prepare(q, d, v, S.file_spec(), _p(), "p")
    c = S.with_query_columns(c, q.withColumn("intent", F.col("query_id") == 2), ["intent"])
    n = F.col
    return tidy(c.select("query_id", "doc_id",
                         K.weighted([(5.0, n("native_title")), (0.2, n("native_chunks"))]).alias("weighted"),
                         K.matched_field_count([n("matches_title"), n("matches_chunks")]).alias("matched"),
                         K.mean_over_matched([n("native_title"), n("native_chunks")],
                                             [n("matches_title"), n("matches_chunks")]).alias("mean_over_matched"),
                         K.intent_switch(n("intent"), n("native_title"), n("combined_nativeRank")).alias("switched"),
                         K.boost(n("combined_bm25"), 0.78).alias("boosted")))


@register("K17_field_match", sql=f"""WITH {_file_ctes(False)}
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(native_title, 6) AS native_title,
  round(native_chunks, 6) AS native_chunks FROM f""", views=["queries_v", "files_v"])
def q_native(spark, sf):
    q, d = view(spark, sf, "queries_v"), view(spark, sf, "files_v")
    c = S.prepare(q, d, None, S.file_spec(), _p(), None)
    return tidy(c.select("query_id", "doc_id", "native_title", "native_chunks"))


@register("W2_rerank", sql=two_phase_sql(_file_ctes(False), "doc_id", "files_v", None, "cbm25",
                                         f"{scale_sql('cbm25')} + cnr", N_RR), views=["queries_v", "files_v"])
def q_rerank(spark, sf):
    q, d = view(spark, sf, "queries_v"), view(spark, sf, "files_v")
    c = S.prepare(q, d, None, S.file_spec(), _p(), None)
    out = S.two_phase(c, d, S.file_spec(), _p(), F.col("combined_bm25"),
                      K.scale(F.col("combined_bm25")) + F.col("combined_nativeRank"), recency=False)
    return _two_out(out)


@register("A20_normalize_stats", sql=f"""WITH {_file_ctes(False)},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cbm25 DESC, doc_id) AS rk FROM f)
SELECT CAST(query_id AS BIGINT) AS query_id, round(min(cbm25), 6) AS bm25_min, round(max(cbm25), 6) AS bm25_max,
  count(*) AS reranked FROM r WHERE rk <= {N_RR} GROUP BY query_id""", views=["queries_v", "files_v"])
def q_norm_stats(spark, sf):
    q, d = view(spark, sf, "queries_v"), view(spark, sf, "files_v")
    c = top_k(S.prepare(q, d, None, S.file_spec(), _p(), None), "combined_bm25", N_RR)
    return tidy(c.groupBy("query_id").agg(F.min("combined_bm25").alias("bm25_min"),
                                          F.max("combined_bm25").alias("bm25_max"),
                                          F.count(F.lit(1)).alias("reranked")))


DOCUMENTS_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                                 T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                                 T.StructField("n_chars", T.LongType())])


@register("S1_read_docs", sql="SELECT doc_id, lang, source, n_chars, length(text) AS text_chars FROM documents")
def q_read_docs(spark, sf):
    d = read_docs(spark, f"{sf}/documents.parquet", DOCUMENTS_SCHEMA)
    return tidy(d.select("doc_id", "lang", "source", "n_chars", F.length("text").cast("bigint").alias("text_chars")))

