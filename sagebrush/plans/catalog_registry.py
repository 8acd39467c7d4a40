"""Profiles run through the registry, one checked query per distinct formula
not already covered by R1-R13 (file.default_native is re-checked against R1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagebrush.plans import catalog_search  # noqa: F401  (R1 oracle is reused)
from sagebrush.plans.catalog_profiles import (_PEOPLE_CTES, FILE_VIEWS, K_VEC, N_RR, _file_ctes, _p, _sorted_out, _sorted_sql,
                                               _two_out, one_phase_sql)
from sagebrush.plans.profiles import profile_features, rank
from sagebrush.plans.registry import ORACLE, register, tidy
from sagebrush.plans.sqlgen import cand_block, scale_sql, text_block, two_phase_sql, vec_block
from sagebrush.sources.tables import view

_FILE_MAP = {"title": "title", "chunks": "body"}


def _files(spark, sf):
    return view(spark, sf, "queries_v"), view(spark, sf, "files_v"), view(spark, sf, "chunk_vectors_v")


@register("R14_file_default_native", sql=ORACLE["R1_hybrid_search"])
def q_file_native(spark, sf):
    q, d, v = _files(spark, sf)
    return _two_out(rank(q, d, v, "file", "default_native", "doc_id", _FILE_MAP, "updatedAt", _p()))


@register("R14_mail_attachment_default_native", sql=two_phase_sql(
    _file_ctes(), "doc_id", "files_v", "updatedAt", "(0.5e0 * vector_score + 0.5e0 * cnr)",
    "0.8e0 * (0.5e0 * vector_score + 0.5e0 * cnr) * doc_recency", N_RR), views=FILE_VIEWS)
def q_mail_attachment_native(spark, sf):
    q, d, v = _files(spark, sf)
    return _two_out(rank(q, d, v, "mail_attachment", "default_native", "doc_id",
                         {"filename": "title", "chunks": "body"}, "updatedAt", _p()))


_SINGLE_CTES = ",\n".join([text_block("queries_v", "files_v", "doc_id", {"title": "title", "chunks": "body"}),
                           vec_block("queries_v", "doc_vectors_v", "doc_id", None, K_VEC),
                           cand_block("doc_id", ["title", "chunks"], True)])


@register("R14_chat_message_default_ai", sql=two_phase_sql(
    _SINGLE_CTES, "doc_id", "files_v", None, "(0.5e0 * (vector_score * 0.8e0) + 0.5e0 * cnr)",
    "(0.5e0 * vector_score + 0.5e0 * cnr)", N_RR), views=["queries_v", "files_v", "doc_vectors_v"])
def q_chat_message_ai(spark, sf):
    q, d = view(spark, sf, "queries_v"), view(spark, sf, "files_v")
    return _two_out(rank(q, d, view(spark, sf, "doc_vectors_v"), "chat_message", "default_ai", "doc_id",
                         {"text": "body", "name": "title"}, "updatedAt", _p(), part=None))


_EV = "(0.5e0 * vector_score + 0.5e0 * (1e0 * native_title))"


@register("R14_event_title_boosted", sql=two_phase_sql(_file_ctes(), "doc_id", "files_v", None, _EV,
                                                      f"1.2e0 * {_EV}", N_RR), views=FILE_VIEWS)
def q_event_tb(spark, sf):
    q, d, v = _files(spark, sf)
    return _two_out(rank(q, d, v, "event", "title_boosted_hybrid", "doc_id", {"name": "title", "description": "body"},
                         "updatedAt", _p()))


@register("R14_user_default_bm25", sql=two_phase_sql(_PEOPLE_CTES, "c_custkey", "people_v", None, "cnr",
                                                    scale_sql("cbm25"), N_RR), views=["people_queries_v", "people_v"])
def q_user_bm25(spark, sf):
    q, d = view(spark, sf, "people_queries_v"), view(spark, sf, "people_v")
    return _two_out(rank(q, d, None, "user", "default_bm25", "c_custkey", {"name": "name", "email": "email"},
                         None, _p()), key="c_custkey")


@register("R14_ticket_hybrid", sql=one_phase_sql(
    _file_ctes(), "doc_id", "0.5e0 * vector_score + 0.5e0 * (2e0 * bm25_title + 1.5e0 * bm25_chunks)"),
    views=FILE_VIEWS)
def q_ticket_hybrid(spark, sf):
    q, d, v = _files(spark, sf)
    out = rank(q, d, v, "ticket", "hybrid", "doc_id", {"subject": "title", "description": "body"}, "updatedAt", _p())
    return tidy(out.select("query_id", "doc_id", "rank", "score"))


@register("R14_ticket_default_bm25", sql=one_phase_sql(
    _file_ctes(False), "doc_id", "2e0 * bm25_title + 1.5e0 * bm25_chunks"), views=["queries_v", "files_v"])
def q_ticket_bm25(spark, sf):
    q, d, _ = _files(spark, sf)
    out = rank(q, d, None, "ticket", "default_bm25", "doc_id", {"subject": "title", "description": "body"},
               "updatedAt", _p())
    return tidy(out.select("query_id", "doc_id", "rank", "score"))


@register("R14_mail_attachment_autocomplete", sql=one_phase_sql(",\n".join([
    text_block("queries_v", "files_v", "doc_id", {"filename": "title"}),
    cand_block("doc_id", ["filename"], False)]), "doc_id", "cbm25"), views=["queries_v", "files_v"])
def q_plain_autocomplete(spark, sf):
    q, d, _ = _files(spark, sf)
    out = rank(q, d, None, "mail_attachment", "autocomplete", "doc_id", {"filename": "title"}, None, _p())
    return tidy(out.select("query_id", "doc_id", "rank", "score"))


@register("R14_event_default_native", sql=two_phase_sql(
    _file_ctes(), "doc_id", "files_v", "updatedAt", "(0.5e0 * vector_score + 0.5e0 * cnr)",
    "(0.5e0 * vector_score + 0.5e0 * cnr) * doc_recency", N_RR).replace("7890000e0", "7776000e0"), views=FILE_VIEWS)
def q_event_native(spark, sf):
    q, d, v = _files(spark, sf)
    return _two_out(rank(q, d, v, "event", "default_native", "doc_id", {"name": "title", "description": "body"},
                         "updatedAt", _p()))


@register("R14_mail_default_native", sql=ORACLE["R10_mail_people_search"])
def q_mail_native(spark, sf):
    q, d = view(spark, sf, "mail_queries_v"), view(spark, sf, "mails_v")
    fields = {"subject": "subject", "chunks": "body", "from": "from_addr", "to": "to_addr", "cc": "cc", "bcc": "bcc"}
    return _two_out(rank(q, d, view(spark, sf, "chunk_vectors_v"), "mail", "default_native", "doc_id", fields,
                         "timestamp", _p()))


@register("R14_kb_items_default_native", sql=ORACLE["R6_attachment_search"])
def q_kb_native(spark, sf):
    q, d = view(spark, sf, "queries_v"), view(spark, sf, "files_img_v")
    fields = {"fileName": "title", "chunks": "body", "image_chunks": "image_chunks"}
    return _two_out(rank(q, d, view(spark, sf, "text_vectors_v"), "kb_items", "default_native", "doc_id", fields,
                         "updatedAt", _p(), image_vectors=view(spark, sf, "image_vectors_v")))


@register("R14_ticket_bm25_with_resolution", sql=one_phase_sql(",\n".join([
    text_block("queries_v", "files_v", "doc_id", {"title": "title", "chunks": "body", "res": "split_part(body, chr(10), 2)"}),
    cand_block("doc_id", ["title", "chunks", "res"], False)]), "doc_id", "2e0 * bm25_title + 1.5e0 * bm25_chunks + 1e0 * bm25_res"),
    views=["queries_v", "files_v"])
def q_ticket_resolution(spark, sf):
    q, d, _ = _files(spark, sf)
    d = d.selectExpr("*", "split_part(body, chr(10), 2) AS resolution")
    out = rank(q, d, None, "ticket", "default_bm25", "doc_id", {"subject": "title", "description": "body",
                                                               "wholeResolutionSummary": "resolution"}, "updatedAt", _p())
    return tidy(out.select("query_id", "doc_id", "rank", "score"))


# ---- formulas of the chat, user, event and attachment types ------------------------------------------

_FILES = ["queries_v", "files_v", "chunk_vectors_v"]
_SINGLE = ["queries_v", "files_v", "doc_vectors_v"]
_DIVIDED = " / CASE WHEN matches_title + matches_chunks = 0 THEN 1e0 ELSE (matches_title + matches_chunks) END AS cnr"


def _summed(sql: str) -> str:
    """The oracle of a type that adds its fields up instead of dividing by the matched ones."""
    assert _DIVIDED in sql
    return sql.replace(_DIVIDED, " AS cnr")


@register("R14_chat_container_sorted", sql=one_phase_sql(
    _file_ctes(), "doc_id", "(SELECT CAST(d.updatedAt AS DOUBLE) FROM files_v d WHERE d.doc_id = f.doc_id)"), views=_FILES)
def q_chat_container_sorted(spark, sf):
    q, d, v = _files(spark, sf)
    out = rank(q, d.withColumnRenamed("updatedAt", "createdAt"), v, "chat_container", "global_sorted", "doc_id",
               {"name": "title", "topic": "body"}, "createdAt", _p())
    return tidy(out.select("query_id", "doc_id", "rank", "score"))


_CHAT_USER = {"name": "title", "statusText": "body"}
_HYBRID = "(0.5e0 * vector_score + 0.5e0 * cnr)"


@register("R14_chat_user_bm25", sql=_summed(two_phase_sql(_file_ctes(False), "doc_id", "files_v", None, "cbm25", scale_sql("cbm25"), N_RR)),
          views=["queries_v", "files_v"])
def q_chat_user_bm25(spark, sf):
    q, d, _ = _files(spark, sf)
    return _two_out(rank(q, d, None, "chat_user", "default_bm25", "doc_id", _CHAT_USER, "updatedAt", _p()))


_NAME5 = "(0.5e0 * vector_score + 0.5e0 * (5e0 * native_title))"


@register("R14_chat_user_title_boosted", sql=_summed(two_phase_sql(
    _file_ctes(), "doc_id", "files_v", None, _NAME5,
    f"{_NAME5} * (SELECT exp(-greatest(1706745600e0 - d.updatedAt / 1000e0, 0e0) / 86400e0) FROM files_v d WHERE d.doc_id = p2w.doc_id)",
    N_RR)), views=_FILES)
def q_chat_user_boosted(spark, sf):
    q, d, v = _files(spark, sf)
    return _two_out(rank(q, d, v, "chat_user", "title_boosted_hybrid", "doc_id", _CHAT_USER, "updatedAt", _p()))


_DECAYED = "(0.5e0 * (vector_score * 0.8e0) + 0.5e0 * {})"


def _chat_message(spark, sf, profile):
    q, d = view(spark, sf, "queries_v"), view(spark, sf, "files_v")
    return rank(q, d, view(spark, sf, "doc_vectors_v"), "chat_message", profile, "doc_id",
                {"text": "body", "name": "title"}, "updatedAt", _p(), part=None)


@register("R14_chat_message_native", sql=two_phase_sql(
    _SINGLE_CTES, "doc_id", "files_v", None, _HYBRID, _DECAYED.format("cnr"), N_RR), views=_SINGLE)
def q_chat_message_native(spark, sf):
    return _two_out(_chat_message(spark, sf, "default_native"))


@register("R14_chat_message_bm25", sql=two_phase_sql(
    _SINGLE_CTES, "doc_id", "files_v", None, "(0.5e0 * vector_score + 0.5e0 * cbm25)", _DECAYED.format(scale_sql("cbm25")), N_RR),
    views=_SINGLE)
def q_chat_message_bm25(spark, sf):
    return _two_out(_chat_message(spark, sf, "default_bm25"))


@register("R14_chat_message_sorted", sql=_sorted_sql("binned_clamped").replace(_file_ctes(), _SINGLE_CTES)
          .replace("0.5e0 * vector_score + 0.5e0 * cnr AS rel", f"{_DECAYED.format('cnr')} AS rel"), views=_SINGLE)
def q_chat_message_sorted(spark, sf):
    return _sorted_out(_chat_message(spark, sf, "global_sorted"))


_LAST_LOGIN = "(1706745600 - ((c_custkey * 37) % 365) * 86400) * 1000"


@register("R14_user_sorted", sql=f"""WITH {_PEOPLE_CTES},
g AS (SELECT f.*, (1706745600e0 - {_LAST_LOGIN} / 1000e0) / 86400e0 AS document_age_days, 2e0 * cnr AS rel FROM f),
h AS (SELECT *, floor(document_age_days / 7e0) AS recency_bin_index FROM g)
SELECT CAST(query_id AS BIGINT) AS query_id, c_custkey,
       row_number() OVER (PARTITION BY query_id ORDER BY recency_bin_index, rel DESC, c_custkey) AS rank,
       round(document_age_days, 6) AS document_age_days, round(recency_bin_index, 6) AS recency_bin_index,
       round(1000000000e0 - recency_bin_index * 1000000e0, 6) AS recency_bin_score, round(rel, 6) AS hybrid_relevance
FROM h""", views=["people_queries_v", "people_v"])
def q_user_sorted(spark, sf):
    q, d = view(spark, sf, "people_queries_v"), view(spark, sf, "people_v").selectExpr("*", f"{_LAST_LOGIN} AS lastLoggedIn")
    out = rank(q, d, None, "user", "global_sorted", "c_custkey", {"name": "name", "email": "email"}, "lastLoggedIn", _p())
    return tidy(out.select("query_id", "c_custkey", "rank", "document_age_days", "recency_bin_index", "recency_bin_score",
                           "hybrid_relevance"))


_SCALED = f"(0.5e0 * vector_score + 0.5e0 * {scale_sql('cbm25')})"


@register("R14_mail_attachment_bm25", sql=two_phase_sql(
    _file_ctes(), "doc_id", "files_v", None, _SCALED, f"0.78e0 * {_SCALED}", N_RR), views=_FILES)
def q_mail_attachment_bm25(spark, sf):
    q, d, v = _files(spark, sf)
    return _two_out(rank(q, d, v, "mail_attachment", "default_bm25", "doc_id", {"filename": "title", "chunks": "body"},
                         "updatedAt", _p()))


_EVENT_CTES = ",\n".join([
    text_block("queries_v", "files_v", "doc_id", {"title": "title", "chunks": "body", "att": "split_part(body, chr(10), 2)"}),
    vec_block("queries_v", "chunk_vectors_v", "doc_id", "p", K_VEC), cand_block("doc_id", ["title", "chunks", "att"], True)])
# the names of attachments raise the score at a fifth, and are no matched field
_EVENT_CTES = (_EVENT_CTES.replace("matches_title + matches_chunks + matches_att", "matches_title + matches_chunks")
               .replace("native_title + native_chunks + native_att)", "native_title + native_chunks)")
               .replace("END AS cnr", "END + 0.2e0 * native_att AS cnr"))


@register("R14_event_meta_fields", sql=two_phase_sql(_EVENT_CTES, "doc_id", "files_v", "updatedAt", _HYBRID, f"{_HYBRID} * doc_recency", N_RR)
          .replace("7890000e0", "7776000e0"), views=_FILES)
def q_event_meta(spark, sf):
    q, d, v = _files(spark, sf)
    d = d.selectExpr("*", "split_part(body, chr(10), 2) AS attachments")
    return _two_out(rank(q, d, v, "event", "default_native", "doc_id",
                         {"name": "title", "description": "body", "attachmentFilenames": "attachments"}, "updatedAt", _p()))


# ---- P10 by profile -------------------------------------------------------------------------------------

@register("P10_profile_features", sql=f"""SELECT r.query_id, r.doc_id, r.rank, r.matched_field_count, r.vector_score, r."combined_nativeRank",
       r.native_title, r.native_chunks, r.doc_recency, coalesce(c.n, 0) AS scored_chunks, c.best AS best_chunk
FROM ({ORACLE["R1_hybrid_search"].replace("AS matched_field_count" + chr(10) + "FROM p4",
      "AS matched_field_count, round(native_title, 6) AS native_title, round(native_chunks, 6) AS native_chunks FROM p4")}) r
LEFT JOIN (SELECT query_id, doc_id, count(*) AS n, max(chunk_bm25) AS best FROM ({ORACLE["A4_chunk_scores"]}) GROUP BY query_id, doc_id) c
  ON c.query_id = r.query_id AND c.doc_id = r.doc_id""")
def q_profile_features(spark, sf):
    q, d, v = _files(spark, sf)
    d = d.withColumn("lines", F.split("body", "\n"))
    hits = rank(q, d, v, "file", "default_native", "doc_id", _FILE_MAP, "updatedAt", _p())
    out = profile_features(hits, q, d, "file", "default_native", "doc_id", _FILE_MAP, chunks="lines")
    out = out.select("query_id", "doc_id", "rank", "match_features.*")
    scores = F.map_values("chunk_scores")
    return tidy(out.select(*[c for c in out.columns if c != "chunk_scores"], F.coalesce(F.size(scores), F.lit(0)).alias("scored_chunks"),
                           F.array_max(scores).alias("best_chunk")))
