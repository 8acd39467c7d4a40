"""Ticket, chat and query-log reports.

All are plain groupBy / window / join plans: partial aggregation before the
shuffle, windows partitioned by the entity key (conversation, owner).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagebrush import config as C
from sagebrush.functions import scoring as K


def epoch_s(ts: Column | str) -> Column:
    """Seconds since the epoch (double) of a timestamp or timestamp_ntz column (UTC session)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp")).cast("double") / F.lit(1e6)


def epoch_ms(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_millis(c.cast("timestamp"))


def query_counts(log: DataFrame, owner: str = "owner", text: str = "query_text", ts: str = "ts") -> DataFrame:
    """Per owner and query text: count and last time (epoch ms)."""
    return log.groupBy(owner, text).agg(F.count(F.lit(1)).alias("count"), F.max(epoch_ms(ts)).alias("timestamp"))


def thread_stats(messages: DataFrame, thread: str = "conv_id", pos: str = "turn", author: str = "role",
                 reactions: str | None = None) -> DataFrame:
    """Replies (messages after the root), distinct repliers, last reply position and, with the column of an array of
    reactions per message, the reactions of the thread and the different ones."""
    reply = F.col(pos) > 0
    out = [F.count(F.when(reply, F.lit(1))).alias("reply_count"),
           F.countDistinct(F.when(reply, F.col(author))).alias("replier_count"),
           F.max(F.when(reply, F.col(pos))).alias("last_reply_pos")]
    if reactions is None:
        return messages.groupBy(thread).agg(*out)
    # counted beside the messages, before anything is exploded: a message with many reactions stays one row
    stats = messages.groupBy(thread).agg(*out, F.sum(F.greatest(F.size(F.coalesce(reactions, F.array())), F.lit(0))).alias("reaction_count"))
    kinds = messages.select(thread, F.explode(reactions).alias("_r")).groupBy(thread).agg(F.countDistinct("_r").alias("reaction_kinds"))
    return stats.join(kinds, thread, "left").fillna(0, ["reaction_kinds"])


def member_counts(members: DataFrame, member: str, channel: str, team: str | None = None) -> DataFrame:
    """Distinct members per channel and (optionally) per team: (level, id, members)."""
    out = (members.groupBy(channel).agg(F.countDistinct(member).alias("members"))
           .select(F.lit("channel").alias("level"), F.col(channel).cast("bigint").alias("id"), "members"))
    if team:
        t = (members.groupBy(team).agg(F.countDistinct(member).alias("members"))
             .select(F.lit("team").alias("level"), F.col(team).cast("bigint").alias("id"), "members"))
        out = out.unionByName(t)
    return out


def ticket_sla(tickets: DataFrame, now_s: float = C.NOW_S) -> DataFrame:
    """Days to close, first response hours, overdue flags of closing and of the first response, paused and escalated
    time (timestamp arithmetic + when).  What has not happened yet is measured against ``now_s``."""
    now = F.lit(float(now_s))
    created, closed = epoch_s("created_ts"), epoch_s("closed_ts")
    first, due, response_due = epoch_s("first_response_ts"), epoch_s("due_ts"), epoch_s("response_due_ts")

    def span(start: str, end: str) -> Column:
        return F.when(F.col(start).isNotNull(), F.greatest(F.lit(0.0), F.coalesce(epoch_s(end), now) - epoch_s(start))).otherwise(F.lit(0.0))

    return tickets.select(
        "id", "department_id", "status", "account_id", "product_id", "team_id",
        ((closed - created) / F.lit(C.ONE_DAY_S)).alias("days_to_close"),
        ((first - created) / F.lit(3600.0)).alias("first_response_hours"),
        F.when(F.col("closed_ts").isNotNull(), closed > due).otherwise(now > due).alias("overdue"),
        (F.coalesce(first, now) > response_due).alias("response_overdue"),
        span("hold_start_ts", "hold_end_ts").alias("hold_seconds"),
        F.col("escalated_ts").isNotNull().alias("escalated"),
        (span("escalated_ts", "escalated_end_ts") / F.lit(3600.0)).alias("escalation_hours"),
        ((F.coalesce(closed, now) - created) / F.lit(C.ONE_DAY_S)).alias("age_days"))


def hold_time(tickets: DataFrame, start: str, end: str) -> DataFrame:
    """Paused time (s) between hold start and end, never negative; an open hold counts to ``end``."""
    return tickets.select("id", F.greatest(F.lit(0.0), epoch_s(end) - epoch_s(start)).alias("hold_seconds"))


def ticket_report(sla: DataFrame, dims: list[str]) -> DataFrame:
    """Count, mean age, exact p50/p90 of days to close and overdue tickets per dimension values.  Sums are partially aggregated;
    the quantiles come from ``grouped_quantiles``, which gathers no group."""
    from sagebrush.operators.windows import grouped_quantiles, join_same

    sums = sla.groupBy(*dims).agg(F.count(F.lit(1)).alias("tickets"), F.avg("age_days").alias("mean_age_days"),
                                  F.sum(F.col("overdue").cast("int")).alias("overdue"))
    days = grouped_quantiles(sla, dims, "days_to_close", {"p50_days_to_close": 0.5, "p90_days_to_close": 0.9})
    return join_same(sums, days, dims).select(*dims, "tickets", "mean_age_days", "p50_days_to_close", "p90_days_to_close", "overdue")


TICKET_DIMS = ("department_id", "account_id", "product_id", "team_id", "status")


def ticket_reports(sla: DataFrame) -> DataFrame:
    """A15 by each of the five dimensions: (dimension, value, the columns of ``ticket_report``).  One pass expands every ticket to its five
    (dimension, value) pairs, of which only the measures travel."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d.removesuffix("_id")).alias("dimension"), F.col(d).cast("string").alias("value")) for d in TICKET_DIMS]))
    return ticket_report(sla.select(pairs.alias("d"), "days_to_close", "age_days", "overdue")
                         .select("d.dimension", "d.value", "days_to_close", "age_days", "overdue"), ["dimension", "value"])


def attach(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str, cols: list[str]) -> DataFrame:
    """Equi join child rows to their parent (Spark picks sort-merge or broadcast by size)."""
    p = parents.select(F.col(parent_key).alias(child_key), *cols)
    return children.join(p, child_key, "inner")


def thread_root(messages: DataFrame, thread: str = "conv_id", pos: str = "turn") -> DataFrame:
    """J5 (thread): each message with its thread root position (self join on the thread key)."""
    roots = messages.groupBy(thread).agg(F.min(pos).alias("root_pos"))
    return messages.join(roots, thread)


def chat_turns(messages: DataFrame, thread: str = "conv_id", pos: str = "turn", role: str = "role",
               text: str = "text") -> DataFrame:
    """Pair each user message with the assistant message that directly follows it.

    "Next message" without a per-conversation window: messages are numbered inside their
    conversation by a distributed rank (a conversation with a third of all rows still spans
    many tasks), then joined to their successor on (conversation, number + 1), a key with
    no hot value."""
    from sagebrush.operators.windows import distributed_rank

    m = messages.select(thread, pos, role, text)
    ranked = distributed_rank(m, [], key=pos, qid=thread, out="_n")
    cur = ranked.filter(F.col(role) == "user").select(thread, F.col("_n").alias("_next"), F.col(pos).alias("user_turn"),
                                                     F.length(text).alias("user_chars"))
    nxt = ranked.filter(F.col(role) == "assistant").select(thread, (F.col("_n") - 1).alias("_next"),
                                                          F.col(pos).alias("assistant_turn"),
                                                          F.length(text).alias("assistant_chars"))
    return (cur.join(nxt, [thread, "_next"])
            .select(thread, "user_turn", "assistant_turn", "user_chars", "assistant_chars"))


def recent_memory(memories: DataFrame, owner: str, key: str, ts_ms: str, k: int,
                  now_s: float = C.NOW_S, rate: float = C.RECENCY_DECAY_RATE) -> DataFrame:
    """Newest k memories of every person, with their decay factor."""
    rec = K.doc_recency(K.document_age_nodefault(F.col(ts_ms), now_s), rate)
    w = Window.partitionBy(owner).orderBy(F.col(ts_ms).desc_nulls_last(), F.col(key).asc())
    return (memories.withColumn("doc_recency", rec).withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))
