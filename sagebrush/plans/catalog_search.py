"""Checked queries for text, vectors and the search pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagebrush.operators import textindex as TI
from sagebrush.operators import vectors as V
from sagebrush.plans import search as S
from sagebrush.session import broadcast_if_small
from sagebrush.plans.registry import register, sql_closeness, sql_tokens, tidy
from sagebrush.plans.sqlgen import _osum_fix
from sagebrush.plans.sqlgen import vec_block
from sagebrush.sources.tables import view

TEST_K = 20          # vector candidates per query (targetHits)
TEST_N = 50          # rerank depth in tests (so the cut is visible)


def _inputs(spark, sf):
    return view(spark, sf, "queries_v"), view(spark, sf, "files_v"), view(spark, sf, "chunk_vectors_v")


def _params(**kw) -> S.Params:
    return S.Params(target_hits=TEST_K, rerank_count=TEST_N, **kw)


# ---- shared SQL blocks --------------------------------------------------------------

SQL_QT = f"""qt AS (SELECT query_id, token, count(*) OVER (PARTITION BY query_id) AS nq
            FROM (SELECT DISTINCT query_id, unnest({sql_tokens('qtext')}) AS token FROM queries_v))"""
SQL_FT = f"""ft AS (SELECT doc_id, 'title' AS field, {sql_tokens('title')} AS toks FROM files_v
            UNION ALL SELECT doc_id, 'chunks' AS field, {sql_tokens('body')} AS toks FROM files_v)"""
SQL_TEXT = f"""{SQL_QT},
{SQL_FT},
stats AS (SELECT field, count(*) AS N, avg(len(toks)) AS avglen FROM ft GROUP BY field),
ex AS (SELECT doc_id, field, len(toks) AS dl, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM ft),
post AS (SELECT doc_id, field, token, dl, count(*) AS tf, min(pos) AS first_pos FROM ex
         WHERE token IN (SELECT token FROM qt) GROUP BY doc_id, field, token, dl),
dfreq AS (SELECT field, token, count(*) AS n FROM post GROUP BY field, token),
sc AS (SELECT qt.query_id, post.doc_id, post.field,
              osum(ln(1e0 + (s.N - d.n + 0.5e0) / (d.n + 0.5e0)) * post.tf * 2.2e0
                  / (post.tf + 1.2e0 * (0.25e0 + 0.75e0 * post.dl / s.avglen))) AS bm25,
              osum(0.5e0 / (1e0 + post.first_pos / 16e0) + 0.5e0 * least(1e0, ln(1e0 + post.tf) / ln(9e0)))
                  / max(qt.nq) AS native
       FROM post JOIN qt ON qt.token = post.token JOIN dfreq d ON d.field = post.field AND d.token = post.token
       JOIN stats s ON s.field = post.field GROUP BY qt.query_id, post.doc_id, post.field),
wide AS (SELECT query_id, doc_id,
            coalesce(sum(CASE WHEN field = 'title' THEN bm25 END), 0e0) AS bm25_title,
            coalesce(sum(CASE WHEN field = 'title' THEN native END), 0e0) AS native_title,
            coalesce(max(CASE WHEN field = 'title' THEN 1 END), 0) AS matches_title,
            coalesce(sum(CASE WHEN field = 'chunks' THEN bm25 END), 0e0) AS bm25_chunks,
            coalesce(sum(CASE WHEN field = 'chunks' THEN native END), 0e0) AS native_chunks,
            coalesce(max(CASE WHEN field = 'chunks' THEN 1 END), 0) AS matches_chunks
         FROM sc GROUP BY query_id, doc_id)"""
SQL_TEXT = _osum_fix(SQL_TEXT)
SQL_VEC = f"""vall AS (SELECT q.query_id, cv.doc_id, cv.p, {sql_closeness('q.e', 'cv.v')} AS c
                 FROM queries_v q, chunk_vectors_v cv),
vbest AS (SELECT query_id, doc_id, p, c AS closeness FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY c DESC, p) AS r FROM vall) WHERE r = 1),
vec AS (SELECT query_id, doc_id, p, closeness, nn_rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY closeness DESC, doc_id) AS nn_rank FROM vbest)
        WHERE nn_rank <= {TEST_K})"""
SQL_CAND = f"""{SQL_TEXT},
{SQL_VEC},
cand AS (SELECT coalesce(w.query_id, v.query_id) AS query_id, coalesce(w.doc_id, v.doc_id) AS doc_id,
            coalesce(w.bm25_title, 0e0) AS bm25_title, coalesce(w.bm25_chunks, 0e0) AS bm25_chunks,
            coalesce(w.native_title, 0e0) AS native_title, coalesce(w.native_chunks, 0e0) AS native_chunks,
            coalesce(w.matches_title, 0) AS matches_title, coalesce(w.matches_chunks, 0) AS matches_chunks,
            coalesce(v.closeness, 0e0) AS vector_score
         FROM wide w FULL OUTER JOIN vec v ON w.query_id = v.query_id AND w.doc_id = v.doc_id),
f AS (SELECT *, matches_title + matches_chunks AS matched_field_count,
             (native_title + native_chunks) / CASE WHEN matches_title + matches_chunks = 0 THEN 1e0
                                                   ELSE (matches_title + matches_chunks) END AS cnr,
             bm25_title + bm25_chunks AS cbm25
      FROM cand)"""
SQL_RECENCY = ("greatest(1e0 / (1e0 + 0.1e0 * sqrt(greatest(coalesce(1706745600e0 - fv.updatedAt / 1000e0, 7890000e0)"
               " / 31536000e0, 0e0))), 0.5e0)")


def _two_phase_sql(phase1: str, phase2: str) -> str:
    """Oracle of W2 over the candidate block ``f``; phase2 may use ``doc_recency``."""
    return f"""WITH {SQL_CAND},
p1 AS (SELECT *, {phase1} AS phase1 FROM f),
p1r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phase1 DESC, doc_id) AS phase1_rank FROM p1),
p2 AS (SELECT p1r.*, phase1_rank <= {TEST_N} AS reranked,
              CASE WHEN phase1_rank <= {TEST_N} THEN {SQL_RECENCY} END AS doc_recency
       FROM p1r JOIN files_v fv ON fv.doc_id = p1r.doc_id),
p3 AS (SELECT *, CASE WHEN reranked THEN {phase2} END AS phase2 FROM p2),
p4 AS (SELECT *, CASE WHEN reranked THEN phase2 ELSE phase1 END AS score FROM p3)
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id,
       row_number() OVER (PARTITION BY query_id ORDER BY reranked DESC, score DESC, doc_id) AS rank,
       reranked, round(score, 6) AS score, round(phase1, 6) AS phase1, round(vector_score, 6) AS vector_score,
       round(cnr, 6) AS combined_nativeRank, round(doc_recency, 6) AS doc_recency,
       CAST(matched_field_count AS BIGINT) AS matched_field_count
FROM p4"""


def _search_out(df):
    return tidy(df.select("query_id", "doc_id", "rank", "reranked", "score", "phase1", "vector_score",
                          "combined_nativeRank", "doc_recency", "matched_field_count"))


# ---- A1/A2/A3 ----------------------------------------------------------------------------

@register("A1_token_table", sql=f"""WITH {SQL_FT},
ex AS (SELECT doc_id, field, len(toks) AS len, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM ft)
SELECT doc_id, field, token, count(*) AS tf, CAST(min(pos) AS BIGINT) AS first_pos, CAST(len AS BIGINT) AS len
FROM ex GROUP BY doc_id, field, token, len""", views=["files_v"])
def q_token_table(spark, sf):
    files = view(spark, sf, "files_v")
    return tidy(TI.token_table(files, "doc_id", S.file_spec().text_fields)
                .select("doc_id", "field", "token", "tf", "first_pos", "len"))


@register("A2_corpus_stats", sql=f"""WITH {SQL_FT},
ex AS (SELECT doc_id, field, unnest(toks) AS token FROM ft),
dfreq AS (SELECT field, token, count(DISTINCT doc_id) AS n FROM ex GROUP BY field, token),
stats AS (SELECT field, count(*) AS N, avg(len(toks)) AS avglen FROM ft GROUP BY field)
SELECT d.field, d.token, d.n, s.N AS n_docs, round(s.avglen, 6) AS avglen
FROM dfreq d JOIN stats s ON s.field = d.field""", views=["files_v"])
def q_corpus_stats(spark, sf):
    files = view(spark, sf, "files_v")
    spec = S.file_spec()
    post = TI.token_table(files, "doc_id", spec.text_fields)
    stats = TI.corpus_stats(files, "doc_id", spec.text_fields)
    return tidy(TI.doc_freq(post, "doc_id").join(F.broadcast(stats), "field")
                .select("field", "token", F.col("df").alias("n"), "n_docs", "avglen"))


@register("A3_bm25", sql=f"""WITH {SQL_TEXT}
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, field, round(bm25, 6) AS bm25, round(native, 6) AS native
FROM sc""", views=["queries_v", "files_v"])
def q_bm25(spark, sf):
    queries, files, _ = _inputs(spark, sf)
    return tidy(TI.text_features(queries, files, "doc_id", S.file_spec().text_fields)
                .select("query_id", "doc_id", "field", "bm25", "native"))


@register("J2_terms_join", sql=f"""WITH {SQL_QT},
{SQL_FT},
ex AS (SELECT DISTINCT doc_id, field, unnest(toks) AS token FROM ft)
SELECT CAST(qt.query_id AS BIGINT) AS query_id, ex.doc_id, ex.field, ex.token
FROM ex JOIN qt ON qt.token = ex.token""", views=["queries_v", "files_v"])
def q_terms_join(spark, sf):
    queries, files, _ = _inputs(spark, sf)
    qt = TI.query_tokens(queries)
    post = TI.token_table(files, "doc_id", S.file_spec().text_fields, terms=qt.select("token"))
    return tidy(post.join(broadcast_if_small(qt), "token").select("query_id", "doc_id", "field", "token"))


@register("J3_nn_exact", sql=f"""WITH {vec_block('vector_queries_v', 'chunk_vectors_v', 'doc_id', 'p', 20)}
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, CAST(p AS BIGINT) AS p, round(closeness, 6) AS closeness,
       CAST(nn_rank AS BIGINT) AS nn_rank FROM vec""", views=["vector_queries_v", "chunk_vectors_v"])
def q_nn_exact(spark, sf):
    return tidy(V.nn_exact(view(spark, sf, "vector_queries_v"), view(spark, sf, "chunk_vectors_v"), 20, key="doc_id", part="p")
                .select("query_id", "doc_id", "p", "closeness", "nn_rank"))


@register("R1_hybrid_search",
          sql=_two_phase_sql("(0.5e0 * vector_score + 0.5e0 * cnr)",
                             "(0.5e0 * vector_score + 0.5e0 * cnr) * doc_recency"),
          views=["queries_v", "files_v", "chunk_vectors_v"])
def q_hybrid_search(spark, sf):
    queries, files, vecs = _inputs(spark, sf)
    return _search_out(S.hybrid_search(queries, files, vecs, _params(), profile="default_native"))


_VISIBLE = "(SELECT doc_id FROM files_v WHERE app IN ('src1', 'src2', 'src3', 'src5'))"


def _visible_sql(hits: int | None) -> str:
    """R1 among visible documents: candidates of both kinds are visible, statistics are those of the whole table."""
    sql = _two_phase_sql("(0.5e0 * vector_score + 0.5e0 * cnr)", "(0.5e0 * vector_score + 0.5e0 * cnr) * doc_recency")
    sql = sql.replace("FROM queries_v q, chunk_vectors_v cv)", f"FROM queries_v q, chunk_vectors_v cv WHERE cv.doc_id IN {_VISIBLE})")
    sql = sql.replace("FROM wide w FULL OUTER JOIN", f"FROM (SELECT * FROM wide WHERE doc_id IN {_VISIBLE}) w FULL OUTER JOIN")
    return sql if hits is None else f"SELECT * FROM ({sql}) WHERE rank <= {hits}"


def _visible_search(spark, sf, hits=None):
    queries, files, vecs = _inputs(spark, sf)
    p = _params(where=F.col("app").isin("src1", "src2", "src3", "src5"), hits=hits)
    return _search_out(S.hybrid_search(queries, files, vecs, p, profile="default_native"))


@register("R1_visible_search", sql=_visible_sql(None), views=["queries_v", "files_v", "chunk_vectors_v"])
def q_visible_search(spark, sf):
    return _visible_search(spark, sf)


@register("R1_visible_search_hits", sql=_visible_sql(10), views=["queries_v", "files_v", "chunk_vectors_v"])
def q_visible_search_hits(spark, sf):
    return _visible_search(spark, sf, hits=10)


_QALPHA = "(0.2e0 + 0.1e0 * query_id)"


@register("X3_query_parameters", sql=_two_phase_sql(
    f"({_QALPHA} * vector_score + (1e0 - {_QALPHA}) * cnr)", f"({_QALPHA} * vector_score + (1e0 - {_QALPHA}) * cnr) * doc_recency")
    .replace("1e0 + 0.1e0 * sqrt", "1e0 + (0.05e0 * query_id) * sqrt"), views=["queries_v", "files_v", "chunk_vectors_v"])
def q_query_parameters(spark, sf):
    queries, files, vecs = _inputs(spark, sf)
    queries = queries.withColumn("alpha", F.lit(0.2) + F.lit(0.1) * F.col("query_id")).withColumn(
        "recency_decay_rate", F.lit(0.05) * F.col("query_id"))
    return _search_out(S.hybrid_search(queries, files, vecs, _params(), profile="default_native"))


def _index(spark, sf):
    """Build the persisted text index of files_v under the shared checkpoint folder."""
    from sagebrush.plans.catalog_logs import scratch_path

    path = scratch_path(spark, "text-index")
    TI.build_text_index(view(spark, sf, "files_v"), "doc_id", S.file_spec().text_fields, path)
    return path


def _oracle(name):
    from sagebrush.plans.registry import ORACLE

    return ORACLE[name]


@register("A1_A3_bm25_from_index", sql=_oracle("A3_bm25"))
def q_bm25_indexed(spark, sf):
    path = _index(spark, sf)
    queries = view(spark, sf, "queries_v")
    return tidy(TI.text_features_indexed(queries, path, "doc_id").select("query_id", "doc_id", "field", "bm25",
                                                                        "native"))


@register("R1_hybrid_search_indexed", sql=_oracle("R1_hybrid_search"))
def q_hybrid_indexed(spark, sf):
    path = _index(spark, sf)
    queries, files, vecs = _inputs(spark, sf)
    return _search_out(S.hybrid_search(queries, files, vecs, _params(text_index=path), profile="default_native"))
