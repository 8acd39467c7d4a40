"""Ranking windows, phases and candidate sets.

All top-k windows are ``row_number() <= k`` so Spark plans a partial
WindowGroupLimit before the shuffle: each partition forwards at most k rows
per query, which keeps a hot query from funnelling all its candidates into
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagebrush.functions.scoring import random_score


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def top_k(df: DataFrame, score, k: int, key: str = "doc_id", qid: str = "query_id",
          rank_col: str = "rank") -> DataFrame:
    """Best k per query, key ascending breaks ties."""
    w = Window.partitionBy(qid).orderBy(_c(score).desc(), F.col(key).asc())
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def normalize_linear(df: DataFrame, col: str, out: str, qid: str = "query_id",
                     only: Column | None = None) -> DataFrame:
    """(x - min)/(max - min) over the rows of one query (restricted to ``only``); 0 if max = min."""
    w = Window.partitionBy(qid)
    src = F.col(col) if only is None else F.when(only, F.col(col))
    mn, mx = F.min(src).over(w), F.max(src).over(w)
    val = F.when(mx == mn, F.lit(0.0)).otherwise((F.col(col) - mn) / (mx - mn))
    return df.withColumn(out, val if only is None else F.when(only, val))


def global_sorted(df: DataFrame, bin_index, relevance, key: str = "doc_id", qid: str = "query_id") -> DataFrame:
    """Newest bin first, relevance inside the bin, key breaks ties.

    Sorting on (bin asc, relevance desc) instead of the packed number keeps
    the order right past the point where the packed score turns negative."""
    return distributed_rank(df, [_c(bin_index).asc(), _c(relevance).desc()], key, qid)


def random_order(df: DataFrame, k: int, seed: str = "0", key: str = "doc_id", qid: str = "query_id") -> DataFrame:
    """Repeatable random sample of k per query (md5 score, then W1)."""
    return top_k(df.withColumn("random_score", random_score(key, seed)), "random_score", k, key, qid)


def candidates(lexical: DataFrame, vector: DataFrame, key: str = "doc_id", qid: str = "query_id") -> DataFrame:
    """Documents found by text or by vector; a missing side's scores are 0."""
    j = lexical.join(vector, [qid, key], "full_outer")
    fills = {c: 0.0 for c, t in j.dtypes if c not in (qid, key) and t == "double"}
    fills.update({c: 0 for c, t in j.dtypes if c not in (qid, key) and t in ("int", "bigint")})
    return j.fillna(fills)


def search_all_types(hits: dict[str, DataFrame], score: str = "score", k: int = 10,
                     key: str = "doc_id", qid: str = "query_id") -> DataFrame:
    """Union hits of several document types under one ranking."""
    out = None
    for name, df in hits.items():
        d = df.withColumn("doc_type", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    w = Window.partitionBy(qid).orderBy(F.col(score).desc(), F.col("doc_type").asc(), F.col(key).asc())
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def distributed_rank(df: DataFrame, order: list[Column], key: str = "doc_id", qid: str = "query_id",
                     out: str = "rank", partitions: int | None = None, base: Column | None = None) -> DataFrame:
    """``row_number`` over (qid ordered by ``order``, key) without putting a query's rows in one task.

    Rows are range-partitioned on (qid, order, key) — a query with a third of all rows spans many
    partitions — sorted inside partitions, numbered by their place there and checkpointed.  Per-(partition, qid)
    counts and first numbers (a table of at most partitions + queries rows) give each partition its offset
    through a small window, so a rank is an addition per row.  ``base`` (a per-row column, e.g. the number of
    rows ranked before this group) is added to the rank."""
    from sagebrush.session import BROADCAST_LIMIT_BYTES

    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    sort = [F.col(qid).asc()] + order + [F.col(key).asc()]
    s = (df.repartitionByRange(n, *sort).sortWithinPartitions(*sort)
         .withColumn("_pid", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()).checkpoint())
    counts = s.groupBy("_pid", qid).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.partitionBy(qid).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", qid, "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # partitions + queries rows at most: counted, so a proven bound decides whether they travel
    few = counts.count() * 64 <= BROADCAST_LIMIT_BYTES
    ranked = s.join(F.broadcast(offsets) if few else offsets, ["_pid", qid])
    r = F.col("_off") + F.col("_place") - F.col("_first") + F.lit(1)
    if base is not None:
        r = r + base
    return ranked.withColumn(out, r.cast("long")).drop("_pid", "_off", "_place", "_first")


def join_same(a: DataFrame, b: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of both sides where NULL equals NULL; the columns are those of ``a``."""
    right = b.select(*[F.col(c).alias(f"_right_{c}") for c in columns], *[c for c in b.columns if c not in columns])
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return a.join(right, cond, how).drop(*[f"_right_{c}" for c in columns])


def grouped_quantiles(df: DataFrame, dims: list[str], value: str, probs: dict[str, float], partitions: int | None = None) -> DataFrame:
    """Exact quantiles per group, interpolated between the two neighbouring ranks: (dims, a column per name of ``probs``).

    Equal values are counted first, with partial sums.  The counts are range-partitioned on (dims, value) and checkpointed; the totals
    of each (partition, group), a small table, say at which rank of its group a partition begins.  A running sum inside
    (partition, group) then tells each value the ranks that it covers, and the values at the wanted ranks are picked by a
    conditional maximum.  A group of any size spans as many partitions as it fills: nothing of it is gathered.  NULL values have no rank;
    a group that has only those has NULL quantiles; NULL is a group like others."""
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*dims, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    dealt = counts.repartitionByRange(n, *dims, "_v").withColumn("_pid", F.spark_partition_id()).checkpoint()
    parts = dealt.groupBy("_pid", *dims).agg(F.sum("_n").alias("_sum"))
    group = Window.partitionBy(*dims)
    offsets = parts.select("_pid", *dims, F.sum("_sum").over(group).alias("_all"),
                           F.coalesce(F.sum("_sum").over(group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    rows = join_same(dealt, offsets, ["_pid", *dims])
    until = F.col("_off") + F.sum("_n").over(Window.partitionBy("_pid", *dims).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_until", until).withColumn("_from", F.col("_until") - F.col("_n"))
    picks, out = [], []
    for name, q in probs.items():
        at = F.lit(float(q)) * (F.col("_all") - 1)
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_until")), F.col("_v"))).alias(f"_{name}_{side}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_{name}_part"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        out.append((lo + (hi - lo) * F.col(f"_{name}_part")).alias(name))
    found = rows.groupBy(*dims).agg(*picks).select(*dims, *out)
    return join_same(df.select(*dims).distinct(), found, dims, "left").select(*dims, *probs)
