"""Checked queries for filters, joins, permissions, folders and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagebrush.operators import derive as D
from sagebrush.operators import relations as RL
from sagebrush.operators import textindex as TI
from sagebrush.plans import search as S
from sagebrush import schemas as SC
from sagebrush.plans.registry import register, sql_tokens, tidy
from sagebrush.sources.tables import view


def _people_perm(spark, sf):
    c = view(spark, sf, "customer")
    return c.withColumn("permissions", F.array(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")),
                                               F.concat(F.lit("segment:"), F.col("c_mktsegment"))))


_PERM_SQL = ("(SELECT *, [concat('nation:', CAST(c_nationkey AS VARCHAR)), concat('segment:', c_mktsegment)] "
             "AS permissions FROM customer)")


@register("F1_exact", sql="SELECT doc_id, n_chars FROM documents WHERE source = 'src3'")
def q_exact(spark, sf):
    return tidy(RL.exact(view(spark, sf, "documents"), "source", "src3").select("doc_id", "n_chars"))


@register("F2_attr_filter", sql="""SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus = 'F'""")
def q_attr_filter(spark, sf):
    o = RL.attr_filter(view(spark, sf, "orders"), "o_totalprice", 100000, 200000, {"o_orderstatus": "F"})
    return tidy(o.select("o_orderkey", "o_totalprice"))


@register("F3_permitted", sql=f"""SELECT c_custkey FROM {_PERM_SQL} p
WHERE list_has_any(permissions, ['nation:7', 'segment:BUILDING'])""")
def q_permitted(spark, sf):
    return tidy(RL.permitted(_people_perm(spark, sf), "permissions", ["nation:7", "segment:BUILDING"]).select("c_custkey"))


@register("F4_tenant", sql="""SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_name = 'EUROPE'""")
def q_tenant(spark, sf):
    c = RL.import_parent(view(spark, sf, "customer"), view(spark, sf, "nation"), "c_nationkey", "n_nationkey",
                         ["n_name", "n_regionkey"])
    c = RL.import_parent(c, view(spark, sf, "region"), "n_regionkey", "r_regionkey", ["r_name"])
    return tidy(RL.tenant(c, "r_name", "EUROPE").select("c_custkey", "n_name"))


@register("F7_live_only", sql="""SELECT o_orderkey FROM orders
WHERE NOT coalesce(o_orderstatus = 'P', false) AND NOT coalesce(o_orderpriority = '5-LOW', false)""")
def q_live_only(spark, sf):
    o = (view(spark, sf, "orders").withColumn("is_deleted", F.col("o_orderstatus") == "P")
         .withColumn("is_archived", F.col("o_orderpriority") == "5-LOW"))
    return tidy(RL.live_only(o, ["is_deleted", "is_archived"]).select("o_orderkey"))


_CAL_LO, _CAL_HI = 1704844800000, 1705017600000     # 2024-01-10 .. 2024-01-12 UTC, epoch ms


@register("F14_events_between", sql=f"""SELECT event_id, start_ms, end_ms, start_ms % 86400000 = 0 AS is_default_start FROM (
  SELECT event_id, event_type, (epoch_us(ts) // 1000) AS start_ms, (epoch_us(ts) // 1000) + CAST(floor(value * 60000) AS BIGINT) AS end_ms
  FROM events) WHERE start_ms < {_CAL_HI} AND end_ms > {_CAL_LO} AND event_type <> 'error'""")
def q_events_between(spark, sf):
    from sagebrush.operators.reports import epoch_ms

    e = view(spark, sf, "events")
    e = e.select("event_id", "event_type", epoch_ms("ts").alias("start_ms"),
                 (epoch_ms("ts") + F.floor(F.col("value") * 60000).cast("bigint")).alias("end_ms"))
    out = RL.events_between(e, "start_ms", "end_ms", _CAL_LO, _CAL_HI, cancelled=F.col("event_type") == "error")
    return tidy(out.select("event_id", "start_ms", "end_ms", "is_default_start"))


@register("F15_in_folder", sql="SELECT folder_id, parent_id FROM folders_v WHERE parent_id = 'n3'", views=["folders_v"])
def q_in_folder(spark, sf):
    return tidy(RL.in_folder(view(spark, sf, "folders_v"), "parent_id", "n3"))


@register("F16_visible_people", sql="""SELECT c_custkey FROM customer
WHERE coalesce(c_acctbal > 0, false) OR concat('owner', CAST(c_nationkey AS VARCHAR)) = 'owner7'""")
def q_visible_people(spark, sf):
    c = (view(spark, sf, "customer").withColumn("is_global", F.col("c_acctbal") > 0)
         .withColumn("owner", F.concat(F.lit("owner"), F.col("c_nationkey").cast("string"))))
    return tidy(RL.visible_people(c, "is_global", "owner", "owner7").select("c_custkey"))


@register("J1_import_parent", sql="""SELECT c.c_custkey, n.n_name, r.r_name FROM customer c
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""")
def q_import_parent(spark, sf):
    c = RL.import_parent(view(spark, sf, "customer"), view(spark, sf, "nation"), "c_nationkey", "n_nationkey",
                         ["n_name", "n_regionkey"])
    c = RL.import_parent(c, view(spark, sf, "region"), "n_regionkey", "r_regionkey", ["r_name"])
    return tidy(c.select("c_custkey", "n_name", "r_name"))


@register("J6_acl_semi", sql=f"""WITH grants AS (SELECT concat('user', CAST(n_nationkey AS VARCHAR)) AS "user",
       concat('nation:', CAST(n_nationkey AS VARCHAR)) AS principal FROM nation
  UNION ALL SELECT 'auditor', 'segment:' || s FROM (VALUES ('BUILDING'), ('MACHINERY')) t(s)),
p AS {_PERM_SQL},
ex AS (SELECT c_custkey, unnest(list_distinct(permissions)) AS principal FROM p)
SELECT DISTINCT g."user" AS "user", ex.c_custkey FROM ex JOIN grants g ON g.principal = ex.principal""")
def q_acl(spark, sf):
    n = view(spark, sf, "nation")
    g1 = n.select(F.concat(F.lit("user"), F.col("n_nationkey").cast("string")).alias("user"),
                  F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("principal"))
    g2 = spark.createDataFrame([("auditor", "segment:BUILDING"), ("auditor", "segment:MACHINERY")], "user string, principal string")
    return tidy(RL.acl_semi(_people_perm(spark, sf), "c_custkey", "permissions", g1.unionByName(g2)))


@register("J7_imported_filter", sql="""SELECT c.c_custkey FROM customer c
WHERE c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""")
def q_imported_filter(spark, sf):
    out = RL.imported_filter(view(spark, sf, "customer"), view(spark, sf, "nation"), "c_nationkey", "n_nationkey",
                             F.col("n_regionkey") == 2)
    return tidy(out.select("c_custkey"))


@register("J8_folder_tree", sql="""WITH RECURSIVE t(root_id, folder_id, depth) AS (
  SELECT folder_id, folder_id, 0 FROM folders_v WHERE parent_id IS NULL
  UNION ALL SELECT t.root_id, f.folder_id, t.depth + 1 FROM t JOIN folders_v f ON f.parent_id = t.folder_id)
SELECT root_id, folder_id, CAST(depth AS BIGINT) AS depth FROM t""", views=["folders_v"])
def q_folder_tree(spark, sf):
    return tidy(RL.folder_tree(view(spark, sf, "folders_v")))


_RULES = ["example.com", ".example.net", "thther.example.org", "localhost:8080"]


@register("F11_host_in_list", sql="""WITH h AS (SELECT page_id,
  lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
  regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?[^/:?#]+:([0-9]+)', 1) AS port FROM pages)
SELECT page_id FROM h WHERE host = 'example.com' OR ends_with(host, '.example.com') OR ends_with(host, '.example.net')
   OR host = 'thther.example.org' OR ends_with(host, '.thther.example.org') OR host || ':' || port = 'localhost:8080'""")
def q_host_in_list(spark, sf):
    rules = spark.createDataFrame([(r,) for r in _RULES], "rule string")
    return tidy(RL.host_in_list(view(spark, sf, "pages"), "page_id", "url", rules).select("page_id"))


# ---- derived columns ------------------------------------------------------------------------

@register("P1_concat_default", sql="""SELECT c_custkey,
  concat(coalesce(c_name, ''), ' ', coalesce(nullif(c_mktsegment, 'BUILDING'), ''), ' ', coalesce(CAST(c_nationkey AS VARCHAR), '')) AS search_text
FROM customer""")
def q_concat_default(spark, sf):
    c = view(spark, sf, "customer")
    return tidy(c.select("c_custkey", D.concat_default(["c_name", F.expr("nullif(c_mktsegment, 'BUILDING')"),
                                                         "c_nationkey"]).alias("search_text")))


@register("P2_concat_with_array", sql="""SELECT doc_id, length(s) AS n, md5(s) AS h FROM (
  SELECT doc_id, concat(coalesce(lang, ''), ' ', coalesce(source, ''), ' ', array_to_string(string_split(text, chr(10)), ' ')) AS s
  FROM documents)""")
def q_concat_array(spark, sf):
    d = view(spark, sf, "documents")
    s = D.concat_with_array(["lang", "source"], F.split("text", "\n"))
    return tidy(d.select("doc_id", F.length(s).cast("bigint").alias("n"), F.md5(s).alias("h")))


@register("P3_copy_field", sql="SELECT p_partkey, p_name AS p_name_fuzzy FROM part")
def q_copy_field(spark, sf):
    return tidy(D.copy_field(view(spark, sf, "part"), "p_name", "p_name_fuzzy").select("p_partkey", "p_name_fuzzy"))


_FILE_FIELDS = {"title": "title", "app": "app", "entity": "entity", "docId": "doc_id", "chunks": "body"}


@register("P8_summary", sql="SELECT title, app, entity, doc_id AS docId FROM files_v", views=["files_v"])
def q_summary(spark, sf):
    return tidy(SC.summary(view(spark, sf, "files_v"), "file", "autocomplete", _FILE_FIELDS))


@register("P8_summary_mail", sql="SELECT subject, body AS chunks_summary, to_addr AS \"to\", cc, bcc FROM mails_v", views=["mails_v"])
def q_summary_mail(spark, sf):
    return tidy(SC.summary(view(spark, sf, "mails_v"), "mail", "default", {"subject": "subject", "chunks": "body", "to": "to_addr",
                                                                         "cc": "cc", "bcc": "bcc"}))


@register("P8_summary_user", sql="SELECT name, email, c_custkey AS photoLink FROM people_v", views=["people_v"])
def q_summary_user(spark, sf):
    return tidy(SC.summary(view(spark, sf, "people_v"), "user", "autocomplete", {"name": "name", "email": "email", "photoLink": "c_custkey"}))


@register("P8_summary_ticket", sql="SELECT o_orderpriority AS description, o_orderstatus AS \"wholeResolutionSummary\" FROM orders")
def q_summary_ticket(spark, sf):
    return tidy(SC.summary(view(spark, sf, "orders"), "ticket", "default", {"description": "o_orderpriority", "wholeResolutionSummary": "o_orderstatus"}))


@register("F5_fieldset_file_default", sql=f"""WITH qt AS (SELECT query_id, list_distinct({sql_tokens('qtext')}) AS terms FROM queries_v)
SELECT DISTINCT CAST(q.query_id AS BIGINT) AS query_id, d.doc_id FROM files_v d, qt q
WHERE len(list_intersect(list_concat(list_concat({sql_tokens('d.title')}, {sql_tokens('d.body')}), list_concat({sql_tokens('d.app')}, {sql_tokens('d.entity')})), q.terms)) > 0""",
          views=["queries_v", "files_v"])
def q_fieldset(spark, sf):
    return tidy(SC.match_fieldset(view(spark, sf, "queries_v"), view(spark, sf, "files_v"), "doc_id", "file", "default", _FILE_FIELDS))


_HL_SQL = f"""WITH qt AS (SELECT query_id, list_distinct({sql_tokens('qtext')}) AS terms FROM queries_v),
m AS (SELECT DISTINCT q.query_id, d.doc_id, d.text, q.terms FROM documents d, qt q
      WHERE len(list_intersect({sql_tokens('d.text')}, q.terms)) > 0),
r AS (SELECT query_id, doc_id, regexp_extract_all(text, '([\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+)', 1) AS runs, terms FROM m)
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id,
       md5(array_to_string(list_transform(runs, lambda x: CASE WHEN list_contains(terms, lower(x))
           THEN '<b>' || x || '</b>' ELSE x END), '')) AS h,
       CAST(len(list_filter(runs, lambda x: list_contains(terms, lower(x)))) AS BIGINT) AS marks
FROM r"""


@register("P9_highlight", sql=_HL_SQL, views=["queries_v"])
def q_highlight(spark, sf):
    q = view(spark, sf, "queries_v")
    d = view(spark, sf, "documents")
    hits = TI.match_any(q, d, "doc_id", {"text": S.tokens("text")})
    hl = D.highlight(hits.join(d.select("doc_id", "text"), "doc_id"), "text", q)
    return tidy(hl.select("query_id", "doc_id", F.md5("text_highlighted").alias("h"),
                          (F.size(F.split("text_highlighted", "<b>")) - 1).cast("bigint").alias("marks")))


@register("P11_epoch_ms_to_ts", sql="""SELECT event_id, (epoch_us(ts) // 1000) AS ms, (epoch_us(ts) // 1000000) AS s,
  strftime(make_timestamp((epoch_us(ts) // 1000) * 1000), '%Y-%m-%d %H:%M:%S') AS ts_text FROM events""")
def q_epoch(spark, sf):
    from sagebrush.operators.reports import epoch_ms

    e = view(spark, sf, "events").select("event_id", epoch_ms("ts").alias("ms"))
    return tidy(e.select("event_id", "ms", (F.col("ms") / 1000).cast("bigint").alias("s"),
                         F.date_format(D.epoch_ms_to_ts("ms"), "yyyy-MM-dd HH:mm:ss").alias("ts_text")))


@register("P12_chunk_provenance", sql="""WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS chunk,
       generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index FROM documents)
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(length(chunk) AS BIGINT) AS chars,
       CAST(floor(chunk_index / 3) + 1 AS BIGINT) AS page, CASE WHEN chunk_index = 0 THEN 'title' ELSE 'text' END AS label
FROM c""")
def q_chunk_prov(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("chunks"))
    meta = F.transform(F.col("chunks"), lambda x, i: F.struct(
        i.alias("chunk_index"), (F.floor(i / 3) + 1).cast("bigint").alias("page"),
        F.when(i == 0, F.lit("title")).otherwise(F.lit("text")).alias("label")))
    d = d.withColumn("chunks_map", meta)
    out = D.chunk_provenance(d, "doc_id", "chunks", "chunks_map")
    return tidy(out.select("doc_id", "chunk_index", F.length("chunk").alias("chars"), "page", "label"))


def _orders_map(spark, sf):
    o = view(spark, sf, "orders")
    return o.withColumn("userMap", F.create_map(
        F.concat(F.lit("cust"), F.col("o_custkey").cast("string"), F.lit("@example.com")),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")),
        F.lit("shared@example.com"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string"))))


_MAP_SQL = ("(SELECT *, MAP {concat('cust', CAST(o_custkey AS VARCHAR), '@example.com'): concat('o', CAST(o_orderkey AS VARCHAR)),"
            " 'shared@example.com': concat('s', CAST(o_orderkey AS VARCHAR))} AS userMap FROM orders)")


@register("P13_user_doc_id", sql=f"""SELECT o_orderkey, userMap['cust7@example.com'] AS own_id FROM {_MAP_SQL} m""")
def q_user_doc_id(spark, sf):
    o = _orders_map(spark, sf)
    return tidy(o.select("o_orderkey", D.user_doc_id("userMap", "cust7@example.com").alias("own_id")))


@register("P14_map_entries_long", sql=f"""SELECT o_orderkey, unnest(map_keys(userMap)) AS map_key,
       unnest(map_values(userMap)) AS map_value FROM {_MAP_SQL} m""")
def q_map_entries(spark, sf):
    return tidy(D.map_entries_long(_orders_map(spark, sf), "o_orderkey", "userMap"))


@register("P15_flatten_messages", sql="""SELECT l_orderkey AS id,
  string_agg(l_returnflag || ' ' || l_linestatus, '|' ORDER BY l_linenumber, l_returnflag || ' ' || l_linestatus) AS thread_text FROM lineitem GROUP BY l_orderkey""")
def q_flatten(spark, sf):
    li = view(spark, sf, "lineitem")
    th = li.groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(
        "l_linenumber", F.array(F.concat_ws(" ", "l_returnflag", "l_linestatus")).alias("texts")))).alias("threads"))
    return tidy(th.select("id", F.array_join(D.flatten_messages(th, "threads", "texts"), "|").alias("thread_text")))


@register("P15_flatten_thread_texts", sql="SELECT doc_id, replace(replace(text, chr(10), '|'), ' ', '|') AS thread_text FROM documents")
def q_flatten_texts(spark, sf):
    """Threads that stand in the row: a line each, with its words as texts."""
    d = view(spark, sf, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda line: F.struct(
        F.split(line, " ").alias("texts"))).alias("threads"))
    return tidy(d.select("doc_id", F.array_join(D.flatten_messages(d, "threads", "texts"), "|").alias("thread_text")))


@register("P16_content_hash", sql="SELECT doc_id, sha256(text) AS content_hash FROM documents")
def q_hash(spark, sf):
    return tidy(view(spark, sf, "documents").select("doc_id", D.content_hash("text").alias("content_hash")))


@register("P17_redact_url", sql="""SELECT page_id, regexp_replace(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@]*@', '\\1') AS url
FROM pages""")
def q_redact(spark, sf):
    return tidy(view(spark, sf, "pages").select("page_id", D.redact_url("url").alias("url")))


@register("P18_error_excerpt", sql="""SELECT page_id, md5(substr(html, 1, 2000)) AS message_md5,
  'upstream_non_json_response' AS type FROM pages WHERE html IS NOT NULL AND NOT json_valid(html)""")
def q_excerpt(spark, sf):
    p = view(spark, sf, "pages").select("page_id", D.error_excerpt("html").alias("e")).filter(F.col("e").isNotNull())
    return tidy(p.select("page_id", F.md5("e.message").alias("message_md5"), F.col("e.type").alias("type")))


@register("P19_paragraph_chunks", sql="""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM documents),
pcs AS (SELECT doc_id, flatten(list_transform(lines, lambda ln: list_transform(
          range(0, greatest(CAST(ceil(length(ln) / 512) AS BIGINT), 1)), lambda i: substr(ln, i * 512 + 1, 512)))) AS chunks FROM l)
SELECT doc_id, CAST(generate_subscripts(chunks, 1) - 1 AS BIGINT) AS p, CAST(length(unnest(chunks)) AS BIGINT) AS chars FROM pcs""")
def q_paragraph(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", D.paragraph_chunks("text").alias("chunks"))
    return tidy(d.select("doc_id", F.posexplode("chunks").alias("p", "c"))
                .select("doc_id", F.col("p").cast("bigint"), F.length("c").cast("bigint").alias("chars")))


@register("A18_dedup_by_hash", sql="""SELECT sha256(text) AS content_hash, min(doc_id) AS kept_doc_id, count(*) AS copies
FROM documents GROUP BY sha256(text)""")
def q_dedup(spark, sf):
    return tidy(D.dedup_by_hash(view(spark, sf, "documents"), "doc_id", "text"))

