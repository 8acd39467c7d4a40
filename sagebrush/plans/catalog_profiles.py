"""Checked queries for the rank-profile families and their building blocks
(R2-R11, R13, W1, W3-W5, U1, U2, A4-A6, F5, F6, P4-P7, P10, J4, A9, S10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagebrush.functions.text import tokens
from sagebrush.operators import textindex as TI
from sagebrush.operators import vectors as V
from sagebrush.operators import windows as W
from sagebrush.operators.vector_index import nn_approx
from sagebrush.plans import search as S
from sagebrush.plans.registry import register, sql_random_score, sql_tokens, tidy
from sagebrush.plans.sqlgen import cand_block, scale_sql, text_block, two_phase_sql, vec_block
from sagebrush.sources.tables import view

K_VEC = 20
N_RR = 50
FILE_FIELDS = {"title": "title", "chunks": "body"}


def _p(**kw) -> S.Params:
    return S.Params(target_hits=K_VEC, rerank_count=N_RR, **kw)


def _two_out(df, key="doc_id", extra=()):
    return tidy(df.select("query_id", key, "rank", "reranked", "score", "phase1", "vector_score",
                          "combined_nativeRank", "doc_recency", "matched_field_count", *extra))


def _file_ctes(has_vec=True, qview="queries_v"):
    parts = [text_block(qview, "files_v", "doc_id", FILE_FIELDS)]
    if has_vec:
        parts.append(vec_block(qview, "chunk_vectors_v", "doc_id", "p", K_VEC))
    parts.append(cand_block("doc_id", list(FILE_FIELDS), has_vec))
    return ",\n".join(parts)


def _file_inputs(spark, sf):
    return view(spark, sf, "queries_v"), view(spark, sf, "files_v"), view(spark, sf, "chunk_vectors_v")


FILE_VIEWS = ["queries_v", "files_v", "chunk_vectors_v"]


def one_phase_sql(ctes: str, key: str, score: str, extra: str = "") -> str:
    return f"""WITH {ctes},
s AS (SELECT *, {score} AS score FROM f)
SELECT CAST(query_id AS BIGINT) AS query_id, {key},
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, {key}) AS rank,
       round(score, 6) AS score{extra}
FROM s"""


# ---- file family profiles (R2, R3, R4, W5) -----------------------------------------------

@register("R2_bm25_search", sql=two_phase_sql(_file_ctes(), "doc_id", "files_v", None,
                                              "(0.5e0 * vector_score + 0.5e0 * cbm25)",
                                              f"(0.5e0 * vector_score + 0.5e0 * {scale_sql('cbm25')})", N_RR),
          views=FILE_VIEWS)
def q_bm25_search(spark, sf):
    q, d, v = _file_inputs(spark, sf)
    return _two_out(S.hybrid_search(q, d, v, _p(), profile="default_bm25"))


_TB = "(0.5e0 * vector_score + 0.5e0 * (5e0 * native_title + 0.2e0 * native_chunks))"


@register("R3_title_boosted_search", sql=two_phase_sql(_file_ctes(), "doc_id", "files_v", "updatedAt",
                                                       _TB, f"{_TB} * doc_recency", N_RR), views=FILE_VIEWS)
def q_title_boosted(spark, sf):
    q, d, v = _file_inputs(spark, sf)
    return _two_out(S.hybrid_search(q, d, v, _p(), profile="title_boosted_hybrid"))


@register("R4_ai_search", sql=two_phase_sql(_file_ctes(), "doc_id", "files_v", None,
                                            "(0.5e0 * vector_score + 0.5e0 * cnr)",
                                            "(0.5e0 * vector_score + 0.5e0 * cnr)", N_RR), views=FILE_VIEWS)
def q_ai_search(spark, sf):
    q, d, v = _file_inputs(spark, sf)
    return _two_out(S.hybrid_search(q, d, v, _p(), profile="default_ai"))


@register("W5_random_order", sql=two_phase_sql(_file_ctes(), "doc_id", "files_v", None,
                                               sql_random_score("doc_id"), "phase1", N_RR), views=FILE_VIEWS)
def q_random(spark, sf):
    q, d, v = _file_inputs(spark, sf)
    return _two_out(S.hybrid_search(q, d, v, _p(), profile="default_random"))


# ---- global_sorted (R5 / W4) --------------------------------------------------------------

def _sorted_sql(variant: str) -> str:
    days = ("greatest(0e0, CASE WHEN d.updatedAt IS NULL THEN 7890000e0 / 86400e0 "
            "ELSE (1706745600e0 - d.updatedAt / 1000e0) / 86400e0 END)")
    if variant == "binned_clamped":
        mult, rel = "10000e0", "greatest(0e0, least(rel / 10e0, 10000e0 - 1e0))"
    else:
        mult, rel = "1000000e0", "rel"
    return f"""WITH {_file_ctes()},
g AS (SELECT f.*, {days} AS document_age_days, 0.5e0 * vector_score + 0.5e0 * cnr AS rel
      FROM f JOIN files_v d ON d.doc_id = f.doc_id),
h AS (SELECT *, CAST(floor(document_age_days / 7e0) AS DOUBLE) AS recency_bin_index, {rel} AS relevance_used FROM g),
k AS (SELECT *, 1000000000e0 - recency_bin_index * {mult} AS recency_bin_score FROM h)
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id,
       row_number() OVER (PARTITION BY query_id ORDER BY recency_bin_index, relevance_used DESC, doc_id) AS rank,
       round(document_age_days, 6) AS document_age_days, round(recency_bin_index, 6) AS recency_bin_index,
       round(recency_bin_score, 6) AS recency_bin_score, round(relevance_used, 6) AS relevance_used,
       round(rel, 6) AS hybrid_relevance
FROM k"""


def _sorted_out(df):
    # the packed score (~1e9, one ulp ~1e-7) is compared through its two parts
    return tidy(df.select("query_id", "doc_id", "rank", "document_age_days", "recency_bin_index",
                          "recency_bin_score", "relevance_used", "hybrid_relevance"))


@register("R5_sorted_search", sql=_sorted_sql("binned_clamped"), views=FILE_VIEWS)
def q_sorted(spark, sf):
    q, d, v = _file_inputs(spark, sf)
    return _sorted_out(S.sorted_search(q, d, v, _p(), variant="binned_clamped"))


@register("W4_global_sorted_raw", sql=_sorted_sql("binned_raw"), views=FILE_VIEWS)
def q_sorted_raw(spark, sf):
    q, d, v = _file_inputs(spark, sf)
    return _sorted_out(S.sorted_search(q, d, v, _p(), variant="binned_raw"))


# ---- building blocks -----------------------------------------------------------------------

@register("W1_top_k", sql=f"""WITH {_file_ctes(False)}
SELECT * FROM (SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(cbm25, 6) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY cbm25 DESC, doc_id) AS rank FROM f) WHERE rank <= 10""",
          views=["queries_v", "files_v"])
def q_top_k(spark, sf):
    q, d, _ = _file_inputs(spark, sf)
    c = S.prepare(q, d, None, S.file_spec(), _p(), None)
    return tidy(W.top_k(c, "combined_bm25", 10).select("query_id", "doc_id", F.col("combined_bm25").alias("score"),
                                                          "rank"))


@register("W3_normalize_linear", sql=f"""WITH {_file_ctes(False)},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cbm25 DESC, doc_id) AS rk FROM f),
t AS (SELECT *, min(cbm25) OVER (PARTITION BY query_id) AS mn, max(cbm25) OVER (PARTITION BY query_id) AS mx
      FROM r WHERE rk <= {N_RR})
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(cbm25, 6) AS bm25,
       round(CASE WHEN mx = mn THEN 0e0 ELSE (cbm25 - mn) / (mx - mn) END, 6) AS bm25_norm,
       round(CASE WHEN mx = mn THEN 0e0 ELSE (cbm25 - mn) / (mx - mn) END + {scale_sql('cbm25')}, 6) AS score
FROM t""", views=["queries_v", "files_v"])
def q_normalize(spark, sf):
    q, d, _ = _file_inputs(spark, sf)
    c = S.prepare(q, d, None, S.file_spec(), _p(), None)
    top = W.top_k(c, "combined_bm25", N_RR)
    top = W.normalize_linear(top, "combined_bm25", "bm25_norm")
    from sagebrush.functions.scoring import scale
    return tidy(top.select("query_id", "doc_id", F.col("combined_bm25").alias("bm25"), "bm25_norm",
                           (F.col("bm25_norm") + scale("combined_bm25")).alias("score")))


@register("U2_candidates", sql=f"""WITH {_file_ctes()}
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(cbm25, 6) AS bm25, round(vector_score, 6) AS vector_score
FROM f""", views=FILE_VIEWS)
def q_candidates(spark, sf):
    q, d, v = _file_inputs(spark, sf)
    lex = TI.wide_text_features(TI.text_features(q, d, "doc_id", S.file_spec().text_fields), "doc_id",
                                ["title", "chunks"])
    lex = lex.select("query_id", "doc_id", (F.col("bm25_title") + F.col("bm25_chunks")).alias("bm25"))
    vec = V.nn_exact(q, v, K_VEC, part="p").select("query_id", "doc_id", F.col("closeness").alias("vector_score"))
    return tidy(W.candidates(lex, vec).select("query_id", "doc_id", "bm25", "vector_score"))


@register("F5_match_any", sql=f"""WITH {text_block('queries_v', 'files_v', 'doc_id', FILE_FIELDS)}
SELECT DISTINCT CAST(query_id AS BIGINT) AS query_id, doc_id FROM sc""", views=["queries_v", "files_v"])
def q_match_any(spark, sf):
    q, d, _ = _file_inputs(spark, sf)
    return tidy(TI.match_any(q, d, "doc_id", S.file_spec().text_fields))


@register("F5_match_all", sql=f"""WITH {text_block('queries_v', 'files_v', 'doc_id', FILE_FIELDS)},
hit AS (SELECT DISTINCT post.k AS doc_id, qt.query_id, qt.token, qt.nq FROM post JOIN qt ON qt.token = post.token)
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id FROM hit GROUP BY query_id, doc_id
HAVING count(*) = max(nq)""", views=["queries_v", "files_v"])
def q_match_all(spark, sf):
    q, d, _ = _file_inputs(spark, sf)
    return tidy(TI.match_all(q, d, "doc_id", S.file_spec().text_fields))


@register("A4_chunk_scores", sql=f"""WITH {text_block('queries_v', 'files_v', 'doc_id', FILE_FIELDS)},
el AS (SELECT doc_id, unnest(string_split(body, chr(10))) AS elem,
              generate_subscripts(string_split(body, chr(10)), 1) - 1 AS p FROM files_v),
elt AS (SELECT doc_id, p, {sql_tokens('elem')} AS toks FROM el),
st AS (SELECT avg(len(toks)) AS avglen FROM elt),
nd AS (SELECT count(*) AS nd FROM files_v),
cex AS (SELECT doc_id, p, len(toks) AS dl, unnest(toks) AS token FROM elt),
cpost AS (SELECT doc_id, p, token, dl, count(*) AS tf FROM cex WHERE token IN (SELECT token FROM qt)
          GROUP BY doc_id, p, token, dl),
cdf AS (SELECT token, count(DISTINCT doc_id) AS n FROM cpost GROUP BY token)
SELECT CAST(qt.query_id AS BIGINT) AS query_id, c.doc_id, CAST(c.p AS BIGINT) AS p,
       round(list_reduce(list_prepend(0e0, list_sort(list(ln(1e0 + (nd.nd - d.n + 0.5e0) / (d.n + 0.5e0)) * c.tf * 2.2e0
                 / (c.tf + 1.2e0 * (0.25e0 + 0.75e0 * c.dl / st.avglen))))), lambda a, b: a + b), 6) AS chunk_bm25
FROM cpost c JOIN qt ON qt.token = c.token JOIN cdf d ON d.token = c.token CROSS JOIN st CROSS JOIN nd
GROUP BY qt.query_id, c.doc_id, c.p""", views=["queries_v", "files_v"])
def q_chunk_scores(spark, sf):
    q, d, _ = _file_inputs(spark, sf)
    docs = d.select("doc_id", F.split("body", "\n").alias("chunks"))
    return tidy(TI.chunk_scores(q, docs, "doc_id", "chunks"))


@register("A5_closest_chunk", sql=f"""WITH {vec_block('queries_v', 'chunk_vectors_v', 'doc_id', 'p', None)}
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, CAST(p AS BIGINT) AS p, round(closeness, 6) AS closeness
FROM vec""", views=["queries_v", "chunk_vectors_v"])
def q_closest_chunk(spark, sf):
    q, _, v = _file_inputs(spark, sf)
    return tidy(V.closeness_all(q, v, part="p").select("query_id", "doc_id", "p", "closeness"))


@register("A6_sum_over_vector_fields", sql=f"""WITH {vec_block('queries_v', 'text_vectors_v', 'doc_id', 'p', None, p='t')},
{vec_block('queries_v', 'image_vectors_v', 'doc_id', 'p', None, p='i')}
SELECT CAST(coalesce(t.query_id, i.query_id) AS BIGINT) AS query_id, coalesce(t.doc_id, i.doc_id) AS doc_id,
       round(coalesce(t.closeness, 0e0) + coalesce(i.closeness, 0e0), 6) AS vector_score
FROM tvec t FULL OUTER JOIN ivec i ON t.query_id = i.query_id AND t.doc_id = i.doc_id""",
          views=["queries_v", "text_vectors_v", "image_vectors_v"])
def q_sum_vectors(spark, sf):
    q = view(spark, sf, "queries_v")
    a = V.closeness_all(q, view(spark, sf, "text_vectors_v"), part="p")
    b = V.closeness_all(q, view(spark, sf, "image_vectors_v"), part="p")
    return tidy(V.sum_over_vector_fields(a, b))


# ---- R6 attachment search (file.attachmentRank) ---------------------------------------------

_R6_FIELDS = {"title": "title", "chunks": "body", "image_chunks": "image_chunks"}
_R6_CTES = ",\n".join([
    text_block("queries_v", "files_img_v", "doc_id", _R6_FIELDS),
    vec_block("queries_v", "text_vectors_v", "doc_id", "p", K_VEC, p="t"),
    vec_block("queries_v", "image_vectors_v", "doc_id", "p", K_VEC, p="i"),
    """vec AS (SELECT coalesce(t.query_id, i.query_id) AS query_id, coalesce(t.doc_id, i.doc_id) AS doc_id,
       coalesce(t.closeness, 0e0) + coalesce(i.closeness, 0e0) AS closeness
       FROM tvec t FULL OUTER JOIN ivec i ON t.query_id = i.query_id AND t.doc_id = i.doc_id)""",
    cand_block("doc_id", list(_R6_FIELDS), True)])


@register("R6_attachment_search", sql=two_phase_sql(_R6_CTES, "doc_id", "files_img_v", "updatedAt",
                                                    "(0.5e0 * vector_score + 0.5e0 * cnr)",
                                                    "(0.5e0 * vector_score + 0.5e0 * cnr) * doc_recency", N_RR),
          views=["queries_v", "files_img_v", "text_vectors_v", "image_vectors_v"])
def q_attachment(spark, sf):
    q, d = view(spark, sf, "queries_v"), view(spark, sf, "files_img_v")
    spec = S.DocSpec("doc_id", {"title": tokens("title"), "chunks": tokens("body"),
                                "image_chunks": tokens("image_chunks")}, age_col="updatedAt")
    return _two_out(S.attachment_search(q, d, view(spark, sf, "text_vectors_v"), view(spark, sf, "image_vectors_v"),
                                        spec, _p()))


# ---- R11 chat_attachment default -------------------------------------------------------------

_R11_FIELDS = {"title": "title", "filename": "filename", "chunks": "body"}
_R11_CTES = ",\n".join([text_block("queries_v", "attachments_v", "doc_id", _R11_FIELDS),
                        vec_block("queries_v", "doc_vectors_v", "doc_id", None, K_VEC),
                        cand_block("doc_id", list(_R11_FIELDS), True)])
_SCALED = " + ".join(scale_sql(f"bm25_{f}") for f in _R11_FIELDS)


@register("R11_attachment_default_search", sql=two_phase_sql(
    _R11_CTES, "doc_id", "attachments_v", None, f"(0.5e0 * vector_score + ({_SCALED}))",
    f"(0.5e0 * CASE WHEN vmax = vmin THEN 0e0 ELSE (vector_score - vmin) / (vmax - vmin) END + ({_SCALED}))", N_RR,
    extra=", min(CASE WHEN reranked THEN vector_score END) OVER (PARTITION BY query_id) AS vmin, "
          "max(CASE WHEN reranked THEN vector_score END) OVER (PARTITION BY query_id) AS vmax"),
    views=["queries_v", "attachments_v", "doc_vectors_v"])
def q_attachment_default(spark, sf):
    q, d = view(spark, sf, "queries_v"), view(spark, sf, "attachments_v")
    spec = S.DocSpec("doc_id", {f: tokens(c) for f, c in _R11_FIELDS.items()})
    return _two_out(S.attachment_default_search(q, d, view(spark, sf, "doc_vectors_v"), spec, _p()))


# ---- R10 mail with the intent switch ----------------------------------------------------------

_MAIL_FIELDS = {"subject": "subject", "chunks": "body", "from": "from_addr", "to": "to_addr", "cc": "cc", "bcc": "bcc"}
_MAIL_CTES = ",\n".join([
    text_block("mail_queries_v", "mails_v", "doc_id", _MAIL_FIELDS),
    vec_block("mail_queries_v", "chunk_vectors_v", "doc_id", "p", K_VEC),
    cand_block("doc_id", list(_MAIL_FIELDS), True, p="x"),
    """f AS (SELECT xf.* REPLACE (CASE WHEN q.is_intent_search THEN native_from + native_to + native_cc + native_bcc
                ELSE (native_subject + native_chunks + (0.8e0 * native_from + 0.4e0 * native_to
                      + 0.2e0 * (native_cc + native_bcc)))
                     / CASE WHEN matched_field_count = 0 THEN 1e0 ELSE matched_field_count END END AS cnr)
      FROM xf JOIN mail_queries_v q ON q.query_id = xf.query_id)"""])


@register("R10_mail_people_search", sql=two_phase_sql(_MAIL_CTES, "doc_id", "mails_v", "timestamp",
                                                      "(0.5e0 * vector_score + 0.5e0 * cnr)",
                                                      "(0.5e0 * vector_score + 0.5e0 * cnr) * doc_recency", N_RR),
          views=["mail_queries_v", "mails_v", "chunk_vectors_v"])
def q_mail(spark, sf):
    q, d = view(spark, sf, "mail_queries_v"), view(spark, sf, "mails_v")
    spec = S.DocSpec("doc_id", {f: tokens(c) for f, c in _MAIL_FIELDS.items()}, age_col="timestamp")
    return _two_out(S.mail_search(q, d, view(spark, sf, "chunk_vectors_v"), spec, _p()))


# ---- R8 people, R13 name lookup, R7 autocomplete ------------------------------------------------

_PEOPLE_CTES = ",\n".join([text_block("people_queries_v", "people_v", "c_custkey", {"name": "name", "email": "email"}),
                           cand_block("c_custkey", ["name", "email"], False)])


@register("R8_people_search", sql=two_phase_sql(_PEOPLE_CTES, "c_custkey", "people_v", None, "cnr", "2e0 * cnr", N_RR),
          views=["people_queries_v", "people_v"])
def q_people(spark, sf):
    q, d = view(spark, sf, "people_queries_v"), view(spark, sf, "people_v")
    spec = S.DocSpec("c_custkey", {"name": tokens("name"), "email": tokens("email")})
    return _two_out(S.people_search(q, d, spec, _p(), "default_native"), key="c_custkey")


@register("R8_people_title_boosted", sql=two_phase_sql(_PEOPLE_CTES, "c_custkey", "people_v", None, "cnr",
                                                       "3e0 * cnr", N_RR), views=["people_queries_v", "people_v"])
def q_people_tb(spark, sf):
    q, d = view(spark, sf, "people_queries_v"), view(spark, sf, "people_v")
    spec = S.DocSpec("c_custkey", {"name": tokens("name"), "email": tokens("email")})
    return _two_out(S.people_search(q, d, spec, _p(), "title_boosted_hybrid"), key="c_custkey")


@register("R13_name_lookup", sql=one_phase_sql(",\n".join([
    text_block("supplier_queries_v", "supplier", "s_suppkey", {"name": "s_name"}),
    cand_block("s_suppkey", ["name"], False)]), "s_suppkey", "native_name"), views=["supplier_queries_v"])
def q_name_lookup(spark, sf):
    q, d = view(spark, sf, "supplier_queries_v"), view(spark, sf, "supplier")
    spec = S.DocSpec("s_suppkey", {"name": tokens("s_name")})
    return tidy(S.name_lookup(q, d, spec, _p()).select("query_id", "s_suppkey", "rank", "score"))


@register("R7_autocomplete", sql=one_phase_sql(",\n".join([
    text_block("prefix_queries_v", "part", "p_partkey", {"p_name": "p_name"}, gram=True),
    cand_block("p_partkey", ["p_name"], False)]), "p_partkey", "cbm25"), views=["prefix_queries_v"])
def q_autocomplete(spark, sf):
    q, d = view(spark, sf, "prefix_queries_v"), view(spark, sf, "part")
    return tidy(S.autocomplete(q, d, "p_partkey", ["p_name"], _p()).select("query_id", "p_partkey", "rank", "score"))


@register("F6_match_grams", sql=f"""WITH {text_block('prefix_queries_v', 'part', 'p_partkey', {'p_name': 'p_name'}, gram=True)}
SELECT CAST(query_id AS BIGINT) AS query_id, p_partkey, round(bm25, 6) AS gram_bm25 FROM sc""",
          views=["prefix_queries_v"])
def q_match_grams(spark, sf):
    q, d = view(spark, sf, "prefix_queries_v"), view(spark, sf, "part")
    return tidy(TI.match_grams(q, d, "p_partkey", "p_name"))


_QC_SQL = ("qc AS (SELECT concat(CAST(owner AS VARCHAR), ':', query_text) AS qid, owner, query_text, count(*) AS count, "
           "max((epoch_us(ts) // 1000)) AS timestamp FROM query_log_v GROUP BY owner, query_text)")


@register("R7_query_log_autocomplete", sql=two_phase_sql(",\n".join([
    _QC_SQL, text_block("log_prefix_v", "qc", "qid", {"query_text": "query_text"}, gram=True),
    cand_block("qid", ["query_text"], False, p="x"),
    "f AS (SELECT xf.*, qc.timestamp, qc.count AS cnt FROM xf JOIN qc ON qc.qid = xf.qid)"]),
    "qid", "qc", None, "cbm25",
    "CASE WHEN bmax = bmin THEN 0e0 ELSE (cbm25 - bmin) / (bmax - bmin) END"
    " + (5e0 * greatest(0e0, 1e0 - (1706745600e0 - timestamp / 1000e0) / 7776000e0) + cnt)", N_RR,
    extra=", min(CASE WHEN reranked THEN cbm25 END) OVER (PARTITION BY query_id) AS bmin, "
          "max(CASE WHEN reranked THEN cbm25 END) OVER (PARTITION BY query_id) AS bmax"),
    views=["log_prefix_v", "query_log_v"])
def q_query_log_autocomplete(spark, sf):
    from sagebrush.operators.reports import query_counts

    q = view(spark, sf, "log_prefix_v")
    counts = query_counts(view(spark, sf, "query_log_v"))
    counts = counts.withColumn("qid", F.concat(F.col("owner").cast("string"), F.lit(":"), F.col("query_text")))
    out = S.query_log_autocomplete(q, counts, _p())
    out = out.withColumn("vector_score", F.lit(0.0)).withColumn("combined_nativeRank", S.combined_native(["query_text"]))
    out = out.withColumn("matched_field_count", F.col("matches_query_text"))
    return _two_out(out, key="qid")


# ---- R9 memory search (chat_memory, episodic_memory) ------------------------------------------

def _hash_vec_sql(p: str, view_: str, key: str, col: str, dims: int = 64) -> str:
    return f"""{p}t AS (SELECT {key} AS k, unnest({sql_tokens(col)}) AS tok FROM {view_}),
{p}c AS (SELECT k, CAST(CAST(('0x' || substr(md5(tok), 1, 8)) AS UBIGINT) % {dims} AS BIGINT) AS dim,
           count(*) * 1e0 AS c FROM {p}t GROUP BY k, dim),
{p}v AS (SELECT k, dim, c / sqrt(sum(c * c) OVER (PARTITION BY k)) AS val FROM {p}c)"""


def _memory_sql(mview: str, key: str, text: str, age: str, importance: str | None) -> str:
    imp = f" * m.{importance}" if importance else ""
    return f"""WITH {text_block('queries_v', mview, key, {'text': text})},
{_hash_vec_sql('hq', 'queries_v', 'query_id', 'qtext')},
{_hash_vec_sql('hm', mview, key, text)},
dots AS (SELECT q.k AS query_id, m.k AS {key}, sum(q.val * m.val) AS cos FROM hqv q JOIN hmv m ON m.dim = q.dim
         GROUP BY q.k, m.k),
vall AS (SELECT q.query_id, m.{key}, 1e0 / (1e0 + acos(greatest(-1e0, least(1e0, coalesce(d.cos, 0e0))))) AS c
         FROM queries_v q CROSS JOIN {mview} m LEFT JOIN dots d ON d.query_id = q.query_id AND d.{key} = m.{key}),
vec AS (SELECT query_id, {key}, c AS closeness FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, {key}) AS nn_rank FROM vall)
        WHERE nn_rank <= {K_VEC}),
{cand_block(key, ['text'], True, p='x')},
f AS (SELECT xf.*, greatest(1e0 / (1e0 + 0.1e0 * sqrt(greatest((1706745600e0 - m.{age} / 1000e0) / 31536000e0, 0e0))),
                            0.5e0) AS doc_recency{', m.' + importance if importance else ''}
      FROM xf JOIN {mview} m ON m.{key} = xf.{key}),
s AS (SELECT *, (0.5e0 * vector_score + 0.5e0 * cbm25) * doc_recency{imp.replace('m.', '')} AS score FROM f)
SELECT CAST(query_id AS BIGINT) AS query_id, {key},
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, {key}) AS rank,
       round(score, 6) AS score, round(vector_score, 6) AS vector_score, round(cbm25, 6) AS bm25,
       round(doc_recency, 6) AS doc_recency
FROM s"""


def _memory_spark(spark, sf, mview, key, text, age, importance):
    q = view(spark, sf, "queries_v").select("query_id", "qtext")
    mem = view(spark, sf, mview)
    emb = V.HashingEmbedder(64)
    qv = V.embed_text(q, "qtext", emb, out="e")
    mv = V.embed_text(mem.select(key, text), text, emb, out="v").select(key, "v")
    spec = S.DocSpec(key, {"text": tokens(text)}, age_col=age)
    out = S.memory_search(qv, mem, mv, spec, _p(), importance_col=importance)
    return tidy(out.select("query_id", key, "rank", "score", "vector_score",
                           F.col("combined_bm25").alias("bm25"), "doc_recency"))


@register("R9_memory_search", sql=_memory_sql("memories_v", "mem_id", "text", "createdAt", None),
          views=["queries_v", "memories_v"])
def q_memory(spark, sf):
    return _memory_spark(spark, sf, "memories_v", "mem_id", "text", "createdAt", None)


@register("K14_episodic_memory_search", sql=_memory_sql("episodes_v", "doc_id", "memoryText", "lastUsedAt",
                                                         "importanceScore"), views=["queries_v", "episodes_v"])
def q_episodic(spark, sf):
    return _memory_spark(spark, sf, "episodes_v", "doc_id", "memoryText", "lastUsedAt", "importanceScore")


# ---- U1 search over several types ---------------------------------------------------------------

@register("U1_search_all_types", sql=f"""WITH {text_block('mixed_queries_v', 'part', 'p_partkey', {'name': 'p_name'}, p='pa')},
{text_block('mixed_queries_v', 'customer', 'c_custkey', {'name': 'c_name'}, p='cu')},
{text_block('mixed_queries_v', 'files_v', 'doc_id', {'name': 'title'}, p='fi')},
u AS (SELECT query_id, 'part' AS doc_type, p_partkey AS doc_key, bm25 AS score FROM pasc
      UNION ALL SELECT query_id, 'customer', c_custkey, bm25 FROM cusc
      UNION ALL SELECT query_id, 'file', doc_id, bm25 FROM fisc)
SELECT * FROM (SELECT CAST(query_id AS BIGINT) AS query_id, doc_type, doc_key, round(score, 6) AS score,
       row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_type, doc_key) AS rank FROM u)
WHERE rank <= 10""", views=["mixed_queries_v", "files_v"])
def q_all_types(spark, sf):
    q = view(spark, sf, "mixed_queries_v")
    hits = {}
    for name, df, key, col in [("part", view(spark, sf, "part"), "p_partkey", "p_name"),
                               ("customer", view(spark, sf, "customer"), "c_custkey", "c_name"),
                               ("file", view(spark, sf, "files_v"), "doc_id", "title")]:
        b = TI.bm25(q, df, key, {"name": tokens(col)})
        hits[name] = b.select("query_id", F.col(key).alias("doc_key"), F.col("bm25").alias("score"))
    return tidy(W.search_all_types(hits, "score", 10, key="doc_key")
                .select("query_id", "doc_type", "doc_key", "score", "rank"))


# ---- vectors: embedder, widths, checks, approximate NN, quantization ------------------------------

@register("P4_embed_text", sql=f"""WITH {_hash_vec_sql('h', 'documents', 'doc_id', 'text')}
SELECT k AS doc_id, dim, round(val, 6) AS value FROM hv""")
def q_embed_text(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", "text")
    e = V.embed_text(d, "text", V.HashingEmbedder(64)).select("doc_id", F.posexplode("embedding").alias("dim", "value"))
    return tidy(e.filter(F.col("value") != 0).select("doc_id", F.col("dim").cast("bigint").alias("dim"), "value"))


@register("P4_embed_text_sql_form", sql=f"""WITH {_hash_vec_sql('h', 'documents', 'doc_id', 'text')}
SELECT k AS doc_id, dim, round(val, 6) AS value FROM hv""")
def q_embed_text_sql(spark, sf):
    d = view(spark, sf, "documents")
    return tidy(V.hashing_embed_long(d, "doc_id", "text", 64).select("doc_id", F.col("dim").cast("bigint"), "value"))


@register("P5_embed_chunks", sql=f"""WITH el AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS chunk,
              generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents),
elk AS (SELECT doc_id * 100000 + p AS ck, doc_id, p, chunk FROM el),
{_hash_vec_sql('h', 'elk', 'ck', 'chunk')}
SELECT e.doc_id, CAST(e.p AS BIGINT) AS p, h.dim, round(h.val, 6) AS value FROM hv h JOIN elk e ON e.ck = h.k""")
def q_embed_chunks(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("chunks"))
    e = V.embed_chunks(d, "doc_id", "chunks", V.HashingEmbedder(64))
    e = e.select("doc_id", "p", F.posexplode("v").alias("dim", "value")).filter(F.col("value") != 0)
    return tidy(e.select("doc_id", F.col("p").cast("bigint"), F.col("dim").cast("bigint"), "value"))


@register("A9_embedding_widths", sql="SELECT DISTINCT CAST(len(embedding) AS BIGINT) AS width FROM embeddings")
def q_widths(spark, sf):
    return tidy(V.embedding_widths(view(spark, sf, "embeddings")))


@register("P7_check_dims", sql="""SELECT vec_id, CAST(len(embedding) AS BIGINT) AS width, len(embedding) = 64 AS ok
FROM embeddings""")
def q_check_dims(spark, sf):
    e = view(spark, sf, "embeddings")
    good, bad = V.check_dims(e, "embedding", 64)
    return tidy(good.select("vec_id", F.size("embedding").alias("width"), F.lit(True).alias("ok"))
                .unionByName(bad.select("vec_id", F.size("embedding").alias("width"), F.lit(False).alias("ok"))))


@register("J4_nn_approx")
def q_nn_approx(spark, sf):
    found = nn_approx(view(spark, sf, "vector_queries_v"), view(spark, sf, "doc_vectors_v"), K_VEC)
    return tidy(found.select("query_id", "doc_id", "closeness", "nn_rank"))


@register("P6_quantize_vectors")
def q_quantize(spark, sf):
    e = view(spark, sf, "embeddings")
    qv = V.quantize_vectors(e, "embedding", "v16")
    return tidy(qv.select("vec_id", F.size("v16").alias("width"),
                          F.aggregate(F.zip_with("embedding", "v16", lambda a, b: F.abs(a - b)), F.lit(0.0),
                                      lambda acc, x: F.greatest(acc, x)).alias("max_abs_change")))


# bfloat16 in SQL: seven bits behind the leading one, rounded half to even
_BF16 = """list_transform({v}, lambda x: CASE WHEN x = 0 THEN 0e0 ELSE
    round_even(CAST(x AS DOUBLE) / pow(2e0, floor(log2(abs(CAST(x AS DOUBLE)))) - 7), 0) * pow(2e0, floor(log2(abs(CAST(x AS DOUBLE)))) - 7) END)"""


@register("P6_rank_change", sql=f"""WITH stored AS (SELECT doc_id, {_BF16.format(v="v")} AS v FROM doc_vectors_v),
{vec_block('vector_queries_v', 'doc_vectors_v', 'doc_id', None, K_VEC, p='a')},
{vec_block('vector_queries_v', 'stored', 'doc_id', None, K_VEC, p='b')},
j AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.nn_rank AS ra, b.nn_rank AS rb
      FROM avec a FULL OUTER JOIN bvec b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
inv AS (SELECT x.query_id, count(*) AS inversions FROM j x JOIN j y ON x.query_id = y.query_id AND x.ra < y.ra AND x.rb > y.rb GROUP BY x.query_id)
SELECT j.query_id, count(CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN 1 END) AS kept, count(CASE WHEN rb IS NULL THEN 1 END) AS "left",
       count(CASE WHEN ra IS NOT NULL AND (rb IS NULL OR ra <> rb) THEN 1 END) AS displaced,
       max(abs(coalesce(ra, {K_VEC + 1}) - coalesce(rb, {K_VEC + 1}))) AS largest_shift, coalesce(any_value(inversions), 0) AS inversions
FROM j LEFT JOIN inv ON inv.query_id = j.query_id GROUP BY j.query_id""", views=["vector_queries_v", "doc_vectors_v"])
def q_rank_change(spark, sf):
    q, v = view(spark, sf, "vector_queries_v"), view(spark, sf, "doc_vectors_v")
    stored = V.from_bfloat16(V.to_bfloat16(v, "v", "b2"), "b2", "v")
    return tidy(V.rank_change(V.nn_exact(q, v, K_VEC), V.nn_exact(q, stored, K_VEC), K_VEC))


@register("P10_match_features", sql=two_phase_sql(_file_ctes(), "doc_id", "files_v", "updatedAt",
                                                  "(0.5e0 * vector_score + 0.5e0 * cnr)",
                                                  "(0.5e0 * vector_score + 0.5e0 * cnr) * doc_recency", N_RR),
          views=FILE_VIEWS)
def q_match_features(spark, sf):
    q, d, v = _file_inputs(spark, sf)
    hits = S.hybrid_search(q, d, v, _p(), profile="default_native")
    mf = S.match_features(hits, ["matched_field_count", "vector_score", "combined_nativeRank", "doc_recency"])
    return _two_out(mf.select("query_id", "doc_id", "rank", "reranked", "score", "phase1", "match_features.*"))
