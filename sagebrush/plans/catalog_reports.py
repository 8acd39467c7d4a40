"""Checked queries for tickets, chat threads, query log and memories."""

from __future__ import annotations

from pyspark.sql import functions as F

from sagebrush.operators import reports as RP
from sagebrush.plans.registry import register, tidy
from sagebrush.sources.tables import view

_SLA_SQL = """sla AS (SELECT id, department_id, status, account_id, product_id, team_id,
       (epoch(closed_ts) - epoch(created_ts)) / 86400e0 AS days_to_close,
       (epoch(first_response_ts) - epoch(created_ts)) / 3600e0 AS first_response_hours,
       CASE WHEN closed_ts IS NOT NULL THEN epoch(closed_ts) > epoch(due_ts) ELSE 1706745600e0 > epoch(due_ts) END AS overdue,
       coalesce(epoch(first_response_ts), 1706745600e0) > epoch(response_due_ts) AS response_overdue,
       coalesce(greatest(0e0, coalesce(epoch(hold_end_ts), 1706745600e0) - epoch(hold_start_ts)), 0e0) AS hold_seconds,
       escalated_ts IS NOT NULL AS escalated,
       coalesce(greatest(0e0, coalesce(epoch(escalated_end_ts), 1706745600e0) - epoch(escalated_ts)), 0e0) / 3600e0 AS escalation_hours,
       (coalesce(epoch(closed_ts), 1706745600e0) - epoch(created_ts)) / 86400e0 AS age_days
FROM tickets_v)"""


@register("A11_query_counts", sql="""SELECT owner, query_text, count(*) AS count, max((epoch_us(ts) // 1000)) AS timestamp
FROM query_log_v GROUP BY owner, query_text""", views=["query_log_v"])
def q_query_counts(spark, sf):
    return tidy(RP.query_counts(view(spark, sf, "query_log_v")))


@register("S9_read_query_log", sql="SELECT owner, query_text, ts, id FROM query_log_v", views=["query_log_v"])
def q_read_query_log(spark, sf):
    return tidy(view(spark, sf, "query_log_v").select("owner", "query_text", "ts", "id"))


@register("A12_thread_stats", sql="""SELECT conv_id, count(CASE WHEN turn > 0 THEN 1 END) AS reply_count,
       count(DISTINCT CASE WHEN turn > 0 THEN role END) AS replier_count,
       max(CASE WHEN turn > 0 THEN turn END) AS last_reply_pos
FROM conversations GROUP BY conv_id""")
def q_thread_stats(spark, sf):
    return tidy(RP.thread_stats(view(spark, sf, "conversations")))


@register("A12_thread_reactions", sql="""SELECT conv_id, count(CASE WHEN turn > 0 THEN 1 END) AS reply_count,
       count(DISTINCT CASE WHEN turn > 0 THEN role END) AS replier_count, max(CASE WHEN turn > 0 THEN turn END) AS last_reply_pos,
       CAST(sum(coalesce(len(reactions), 0)) AS BIGINT) AS reaction_count,
       CAST(len(list_distinct(flatten(list(coalesce(reactions, []))))) AS BIGINT) AS reaction_kinds
FROM messages_v GROUP BY conv_id""", views=["messages_v"])
def q_thread_reactions(spark, sf):
    return tidy(RP.thread_stats(view(spark, sf, "messages_v"), reactions="reactions"))


@register("A13_member_counts", sql="""SELECT 'channel' AS level, CAST(c_nationkey AS BIGINT) AS id,
       count(DISTINCT c_custkey) AS members FROM customer GROUP BY c_nationkey
UNION ALL SELECT 'team', CAST(n.n_regionkey AS BIGINT), count(DISTINCT c.c_custkey)
FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY n.n_regionkey""")
def q_member_counts(spark, sf):
    from sagebrush.operators.relations import import_parent

    c = import_parent(view(spark, sf, "customer"), view(spark, sf, "nation"), "c_nationkey", "n_nationkey",
                      ["n_regionkey"])
    return tidy(RP.member_counts(c, "c_custkey", "c_nationkey", "n_regionkey"))


@register("A14_ticket_sla", sql=f"""WITH {_SLA_SQL}
SELECT id, CAST(department_id AS BIGINT) AS department_id, status, round(days_to_close, 6) AS days_to_close,
       round(first_response_hours, 6) AS first_response_hours, overdue, response_overdue, round(hold_seconds, 6) AS hold_seconds, escalated,
       round(escalation_hours, 6) AS escalation_hours, round(age_days, 6) AS age_days FROM sla""",
          views=["tickets_v"])
def q_ticket_sla(spark, sf):
    return tidy(RP.ticket_sla(view(spark, sf, "tickets_v")).drop("account_id", "product_id", "team_id"))


_REPORT_SQL = """count(*) AS tickets, round(avg(age_days), 6) AS mean_age_days,
       round(quantile_cont(days_to_close, 0.5), 6) AS p50_days_to_close,
       round(quantile_cont(days_to_close, 0.9), 6) AS p90_days_to_close,
       sum(CAST(overdue AS INTEGER)) AS overdue"""


@register("A15_ticket_report", sql=f"""WITH {_SLA_SQL}
SELECT CAST(department_id AS BIGINT) AS department_id, status, {_REPORT_SQL}
FROM sla GROUP BY department_id, status""", views=["tickets_v"])
def q_ticket_report(spark, sf):
    return tidy(RP.ticket_report(RP.ticket_sla(view(spark, sf, "tickets_v")), ["department_id", "status"]))


@register("A15_ticket_reports", sql=f"""WITH {_SLA_SQL},
pairs AS (SELECT 'department' AS dimension, CAST(department_id AS VARCHAR) AS value, * FROM sla
          UNION ALL SELECT 'account', CAST(account_id AS VARCHAR), * FROM sla UNION ALL SELECT 'product', CAST(product_id AS VARCHAR), * FROM sla
          UNION ALL SELECT 'team', CAST(team_id AS VARCHAR), * FROM sla UNION ALL SELECT 'status', status, * FROM sla)
SELECT dimension, value, {_REPORT_SQL} FROM pairs GROUP BY dimension, value""", views=["tickets_v"])
def q_ticket_reports(spark, sf):
    return tidy(RP.ticket_reports(RP.ticket_sla(view(spark, sf, "tickets_v"))))


@register("W9_hold_time", sql="""SELECT id, round(greatest(0e0, epoch(coalesce(closed_ts, due_ts)) - epoch(first_response_ts)), 6)
AS hold_seconds FROM tickets_v""", views=["tickets_v"])
def q_hold_time(spark, sf):
    t = view(spark, sf, "tickets_v").withColumn("hold_end", F.coalesce("closed_ts", "due_ts"))
    return tidy(RP.hold_time(t, "first_response_ts", "hold_end"))


@register("J5_attach", sql="""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, o.o_custkey, o.o_orderdate
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey""")
def q_attach(spark, sf):
    out = RP.attach(view(spark, sf, "lineitem"), view(spark, sf, "orders"), "l_orderkey", "o_orderkey",
                    ["o_custkey", "o_orderdate"])
    return tidy(out.select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "o_orderdate"))


@register("J5_thread_root", sql="""SELECT c.conv_id, c.turn, r.root_pos FROM conversations c
JOIN (SELECT conv_id, min(turn) AS root_pos FROM conversations GROUP BY conv_id) r ON r.conv_id = c.conv_id""")
def q_thread_root(spark, sf):
    return tidy(RP.thread_root(view(spark, sf, "conversations")).select("conv_id", "turn", "root_pos"))


@register("W8_chat_turns", sql="""SELECT conv_id, user_turn, assistant_turn, user_chars, assistant_chars FROM (
  SELECT conv_id, turn AS user_turn, role, lead(role) OVER w AS next_role, lead(turn) OVER w AS assistant_turn,
         CAST(length(text) AS BIGINT) AS user_chars, CAST(length(lead(text) OVER w) AS BIGINT) AS assistant_chars
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND next_role = 'assistant'""")
def q_chat_turns(spark, sf):
    return tidy(RP.chat_turns(view(spark, sf, "conversations")))


@register("W10_recent_memory", sql="""SELECT conv_id, mem_id, rank, round(doc_recency, 6) AS doc_recency FROM (
  SELECT conv_id, mem_id,
         greatest(1e0 / (1e0 + 0.1e0 * sqrt(greatest((1706745600e0 - createdAt / 1000e0) / 31536000e0, 0e0))), 0.5e0)
             AS doc_recency,
         row_number() OVER (PARTITION BY conv_id ORDER BY createdAt DESC NULLS LAST, mem_id) AS rank
  FROM memories_v) WHERE rank <= 3""", views=["memories_v"])
def q_recent_memory(spark, sf):
    out = RP.recent_memory(view(spark, sf, "memories_v"), "conv_id", "mem_id", "createdAt", 3)
    return tidy(out.select("conv_id", "mem_id", "rank", "doc_recency"))
