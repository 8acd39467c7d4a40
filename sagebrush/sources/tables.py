"""Input tables and the derived fixture views.

Every view is declared once as SQL text that Spark SQL and DuckDB both run
with equal results (UTC session).  Spark reads the views through temp views
over the parquet files, so Catalyst still prunes columns and pushes filters
into the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# --- fixed values: fixture views ------------------------------------------------
VIEW_SQL: dict[str, str] = {
    "tickets_v": """
SELECT o.o_orderkey AS id, o.o_custkey AS account_id, c.c_nationkey AS department_id, o.o_orderstatus AS status,
       o.o_orderpriority AS priority, o.o_orderdate AS created_ts,
       MIN(l.l_shipdate) AS first_response_ts,
       CASE WHEN o.o_orderstatus = 'F' THEN MAX(l.l_shipdate) END AS closed_ts,
       o.o_orderdate + INTERVAL 60 DAY AS due_ts, MIN(l.l_partkey) % 40 AS product_id, n.n_regionkey AS team_id,
       o.o_orderdate + INTERVAL 30 DAY AS response_due_ts,
       CASE WHEN o.o_orderkey % 3 = 0 THEN MIN(l.l_shipdate) END AS hold_start_ts,
       CASE WHEN o.o_orderkey % 3 = 0 AND o.o_orderkey % 2 = 0 THEN MIN(l.l_shipdate) + INTERVAL 5 DAY END AS hold_end_ts,
       CASE WHEN o.o_orderkey % 5 = 0 THEN o.o_orderdate + INTERVAL 10 DAY END AS escalated_ts,
       CASE WHEN o.o_orderkey % 5 = 0 AND o.o_orderstatus = 'F' THEN MAX(l.l_shipdate) END AS escalated_end_ts
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
JOIN nation n ON n.n_nationkey = c.c_nationkey
GROUP BY o.o_orderkey, o.o_custkey, c.c_nationkey, n.n_regionkey, o.o_orderstatus, o.o_orderpriority, o.o_orderdate""",
    "query_log_v": """
SELECT user_id AS owner, concat(event_type, ' report ', CAST(user_id % 7 AS STRING)) AS query_text, ts, event_id AS id FROM events""",
    "access_v": """
SELECT event_id, ts, concat('10.0.', CAST(user_id % 4 AS STRING), '.', CAST(user_id AS STRING)) AS remote_addr,
       CASE event_type WHEN 'click' THEN '/api/search' WHEN 'view' THEN '/assets/app.js' WHEN 'signup' THEN '/auth'
                       WHEN 'error' THEN '/api/feed' ELSE '/grafana/d/1' END AS path,
       CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, CAST(floor(value) AS BIGINT) AS body_bytes FROM events""",
    "log_lines_v": """
SELECT event_id, ts, event_type AS stream,
       concat('status=', CAST(CASE WHEN event_type = 'error' THEN 502 ELSE 200 END AS STRING), ' inputs=', CAST(user_id AS STRING),
              ' duration_ms=', CAST(CAST(floor(value) AS BIGINT) AS STRING)) AS line FROM events""",
    "containers_v": """
SELECT concat(CASE event_id % 6 WHEN 0 THEN '/app-' WHEN 1 THEN '/loki-' WHEN 2 THEN '/other-' WHEN 3 THEN '/my-app-' WHEN 4 THEN 'app-' ELSE '/busybox-' END, event_type) AS name,
  CASE WHEN event_id % 2 = 0 THEN 'bridge' ELSE 'host' END AS network_mode,
  CASE WHEN event_id % 7 = 0 THEN 'short' ELSE md5(event_type) END AS id,
  CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN '' END AS compose_service,
  CASE WHEN event_id % 5 = 0 THEN event_type ELSE concat('org/', event_type, ':', '3.4.1') END AS image,
  CASE WHEN event_id % 4 = 0 THEN 'stderr' ELSE 'stdout' END AS stream FROM events""",
    # chat messages with their reactions: a third of them has none
    "messages_v": """
SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN NULL ELSE split(concat(role, ',up,', CAST(conv_id % 3 AS STRING)), ',') END AS reactions
FROM conversations""",
    "folders_v": """
SELECT concat('r', CAST(r_regionkey AS STRING)) AS folder_id, CAST(NULL AS STRING) AS parent_id FROM region
UNION ALL SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)) FROM nation
UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), concat('n', CAST(c_nationkey AS STRING)) FROM customer""",
    "requests_v": """
SELECT conv_id AS request_id, turn AS pos, text AS input FROM conversations""",
    "responses_v": """
SELECT conv_id AS request_id, CAST(floor(turn / 2) AS BIGINT) AS batch, turn % 2 AS local_index,
       CASE WHEN conv_id % 10 = 0 THEN 503 WHEN conv_id % 10 = 1 THEN 200 ELSE 200 END AS status,
       CASE WHEN conv_id % 10 = 1 THEN '{"error":{"message":"Model overloaded"}}' ELSE '{"ok":true}' END AS body,
       length(text) AS prompt_tokens, 'ECONNRESET' AS error_code FROM conversations""",
    # documents seen as `file` documents: title = first line, chunks = lines,
    # app = source, entity = lang, updatedAt in epoch ms with NULL and future rows.
    "files_v": """
SELECT doc_id, source AS app, lang AS entity, split_part(text, chr(10), 1) AS title, text AS body,
       CASE WHEN doc_id % 10 = 3 THEN CAST(NULL AS BIGINT)
            WHEN doc_id % 10 = 4 THEN CAST(1706745600 + 2592000 AS BIGINT) * 1000
            ELSE CAST(1706745600 - ((doc_id * 37) % 365) * 86400 - n_chars AS BIGINT) * 1000 END AS updatedAt
FROM documents""",
    # chunk vectors: doc = vec_id div 5, p = vec_id mod 5
    "chunk_vectors_v": """
SELECT CAST(floor(vec_id / 5) AS BIGINT) AS doc_id, CAST(vec_id % 5 AS INT) AS p, embedding AS v FROM embeddings""",
    # the three test queries; their vectors are the embeddings of vec_id 0, 1, 2
    "queries_v": """
SELECT q.query_id, q.qtext, e.embedding AS e FROM (VALUES (1, 'the tion', 0), (2, 'of and', 1), (3, 'zqxjvw', 2))
AS q(query_id, qtext, vec_id) JOIN embeddings e ON e.vec_id = q.vec_id""",
    # a query set that grows with the table: every hundredth embedding
    "vector_queries_v": """
SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0""",
    # mail seen from documents: people fields are the first four words
    "mails_v": """
SELECT doc_id, title AS subject, body, split_part(body, ' ', 1) AS from_addr, split_part(body, ' ', 2) AS to_addr,
       split_part(body, ' ', 3) AS cc, split_part(body, ' ', 4) AS bcc, updatedAt AS timestamp FROM files_v""",
    "mail_queries_v": """
SELECT query_id, qtext, e, query_id = 2 AS is_intent_search FROM queries_v""",
    "files_img_v": """
SELECT doc_id, title, body, split_part(body, chr(10), 2) AS image_chunks, updatedAt FROM files_v""",
    "attachments_v": """
SELECT doc_id, title, concat(app, '_', CAST(doc_id AS STRING), '.txt') AS filename, body FROM files_v""",
    "doc_vectors_v": """
SELECT vec_id AS doc_id, embedding AS v FROM embeddings""",
    "text_vectors_v": """
SELECT CAST(floor(vec_id / 5) AS BIGINT) AS doc_id, CAST(vec_id % 5 AS INT) AS p, embedding AS v FROM embeddings
WHERE vec_id % 2 = 0""",
    "image_vectors_v": """
SELECT CAST(floor(vec_id / 5) AS BIGINT) AS doc_id, CAST(vec_id % 5 AS INT) AS p, embedding AS v FROM embeddings
WHERE vec_id % 2 = 1""",
    "people_v": """
SELECT c_custkey, c_name AS name, concat(lower(replace(c_name, '#', '.')), '@', lower(c_mktsegment), '.example.com') AS email
FROM customer""",
    "people_queries_v": """
SELECT * FROM (VALUES (1, 'customer 000000007'), (2, 'machinery'), (3, 'zqxjvw')) AS t(query_id, qtext)""",
    "supplier_queries_v": """
SELECT * FROM (VALUES (1, 'supplier 000000003'), (2, 'supplier'), (3, 'zqxjvw')) AS t(query_id, qtext)""",
    "prefix_queries_v": """
SELECT * FROM (VALUES (1, 'wid'), (2, 'blu bol'), (3, 'zqxjvw')) AS t(query_id, qtext)""",
    "log_prefix_v": """
SELECT * FROM (VALUES (1, 'cli'), (2, 'report 3'), (3, 'zqxjvw')) AS t(query_id, qtext)""",
    "mixed_queries_v": """
SELECT * FROM (VALUES (1, 'red customer'), (2, 'the widget'), (3, 'zqxjvw')) AS t(query_id, qtext)""",
    "memories_v": """
SELECT conv_id * 1000 + turn AS mem_id, conv_id, turn, role, text,
       CASE WHEN (conv_id * 1000 + turn) % 10 = 3 THEN CAST(NULL AS BIGINT)
            ELSE CAST(1706745600 - conv_id * 3600 - turn * 60 AS BIGINT) * 1000 END AS createdAt
FROM conversations""",
    "episodes_v": """
SELECT f.doc_id, f.body AS memoryText, f.updatedAt AS lastUsedAt, 1.0e0 + coalesce(l.quality, 0) AS importanceScore
FROM files_v f LEFT JOIN labels l ON l.doc_id = f.doc_id""",
}

VIEW_DEPS: dict[str, list[str]] = {
    "tickets_v": ["orders", "lineitem", "customer", "nation"],
    "query_log_v": ["events"], "access_v": ["events"], "log_lines_v": ["events"],
    "containers_v": ["events"], "folders_v": ["region", "nation", "customer"],
    "requests_v": ["conversations"], "messages_v": ["conversations"], "responses_v": ["conversations"],
    "files_v": ["documents"], "chunk_vectors_v": ["embeddings"], "queries_v": ["embeddings"], "vector_queries_v": ["embeddings"],
    "mails_v": ["files_v"], "mail_queries_v": ["queries_v"], "files_img_v": ["files_v"],
    "attachments_v": ["files_v"], "doc_vectors_v": ["embeddings"], "text_vectors_v": ["embeddings"],
    "image_vectors_v": ["embeddings"], "people_v": ["customer"], "people_queries_v": [],
    "supplier_queries_v": [], "prefix_queries_v": [], "log_prefix_v": [], "mixed_queries_v": [],
    "memories_v": ["conversations"], "episodes_v": ["files_v", "labels"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table (parquet, schema from the file footer)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Register base tables and fixture views (with their dependencies) as temp views."""
    for name in names:
        if name in VIEW_SQL:
            register(spark, sf_dir, VIEW_DEPS[name])
            spark.sql(VIEW_SQL[name]).createOrReplaceTempView(name)
        else:
            table(spark, sf_dir, name).createOrReplaceTempView(name)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame (base tables are plain parquet reads)."""
    if name not in VIEW_SQL:
        return table(spark, sf_dir, name)
    register(spark, sf_dir, VIEW_DEPS[name])
    return spark.sql(VIEW_SQL[name])


def with_views(sql: str, names: list[str]) -> str:
    """Prefix an oracle query with the fixture views it reads (DuckDB side)."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for d in VIEW_DEPS.get(n, []):
            if d in VIEW_SQL:
                add(d)
        if n in VIEW_SQL and n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    if not ordered:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n].strip()})" for n in ordered)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
