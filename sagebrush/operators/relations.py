"""Filters, parent imports, permissions and folder trees.

Equality and range filters are plain Column predicates so Catalyst pushes
them into the Parquet scan.  Parent tables are broadcast only when their
plan size is proven small; permission and host matching are equi-joins on
exploded keys (never a nested-loop or cross join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagebrush.session import BROADCAST_LIMIT_BYTES, broadcast_if_small, estimated_bytes

SALTS = 32  # copies of a permission class that is joined by a shuffle


def exact(df: DataFrame, col: str, value) -> DataFrame:
    """whole-value match (pushed down to the scan)."""
    return df.filter(F.col(col) == F.lit(value))


def attr_filter(df: DataFrame, col: str, lo=None, hi=None, eq: dict | None = None) -> DataFrame:
    """range (inclusive) and equality predicates on attribute columns."""
    cond = F.lit(True)
    if lo is not None:
        cond = cond & (F.col(col) >= F.lit(lo))
    if hi is not None:
        cond = cond & (F.col(col) <= F.lit(hi))
    for k, v in (eq or {}).items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.filter(cond)


def permitted(df: DataFrame, perms: str, principals: list[str]) -> DataFrame:
    """rows whose permission array overlaps the caller's principals."""
    return df.filter(F.arrays_overlap(F.col(perms), F.array(*[F.lit(p) for p in principals])))


def tenant(df: DataFrame, col: str, workspace) -> DataFrame:
    """keep one workspace."""
    return df.filter(F.col(col) == F.lit(workspace))


def live_only(df: DataFrame, flags: list[str]) -> DataFrame:
    """drop rows flagged deleted / suspended / archived (NULL flag = live)."""
    cond = F.lit(True)
    for f in flags:
        cond = cond & ~F.coalesce(F.col(f).cast("boolean"), F.lit(False))
    return df.filter(cond)


def events_between(df: DataFrame, start: str, end: str, lo_ms: int, hi_ms: int,
                   cancelled: Column | None = None) -> DataFrame:
    """rows whose [start, end) overlaps [lo, hi); cancelled rows dropped;
    a start exactly at midnight UTC is flagged as a default start time."""
    out = df.filter((F.col(start) < F.lit(hi_ms)) & (F.col(end) > F.lit(lo_ms)))
    if cancelled is not None:
        out = out.filter(~F.coalesce(cancelled, F.lit(False)))
    return out.withColumn("is_default_start", (F.col(start) % F.lit(86400000)) == 0)


def in_folder(df: DataFrame, parent_col: str, folder) -> DataFrame:
    """items directly inside one folder / knowledge base."""
    return df.filter(F.col(parent_col) == F.lit(folder))


def visible_people(df: DataFrame, is_global: str, owner: str, caller: str) -> DataFrame:
    """F16: globally listed people, or contacts owned by the caller."""
    return df.filter(F.coalesce(F.col(is_global), F.lit(False)) | (F.col(owner) == F.lit(caller)))


def import_parent(child: DataFrame, parent: DataFrame, ref: str, parent_key: str, cols: list[str]) -> DataFrame:
    """Parent columns on the child (left join; missing parent gives NULLs).
    Parent (a `global` document type) is broadcast when its size is proven small."""
    p = parent.select(F.col(parent_key).alias(ref), *cols)
    return child.join(broadcast_if_small(p), ref, "left")


def imported_filter(child: DataFrame, parent: DataFrame, ref: str, parent_key: str, pred: Column) -> DataFrame:
    """Children whose parent satisfies ``pred`` (left-semi join, parent filtered first)."""
    p = parent.filter(pred).select(F.col(parent_key).alias(ref))
    return child.join(broadcast_if_small(p), ref, "left_semi")


def acl_semi(docs: DataFrame, key: str, perms: str, grants: DataFrame, user: str = "user",
             principal: str = "principal") -> DataFrame:
    """(user, doc) pairs a user may see; ``key`` is the documents' unique key.

    Documents share few permission lists, so principals are resolved once per different list (found by a partially aggregated
    distinct, in which a list that most documents have is one row a task): its users become one sorted array, the list's class.
    Documents then meet the class of their own list, by broadcast where the classes are proven small, and otherwise salted: a class
    stands ``SALTS`` times and documents are dealt over its copies, so a list or principal that all documents have is spread.
    Each document meets one class, so no pair arises twice and nothing is made distinct afterwards."""
    listed = docs.select(F.col(key).alias("_doc"), F.array_sort(F.array_distinct(perms)).alias("_list")).filter(F.size("_list") > 0)
    held = listed.select("_list").distinct().select("_list", F.explode("_list").alias("_p"))
    given = grants.select(F.col(user).alias("_user"), F.col(principal).alias("_p")).distinct()
    classes = held.join(broadcast_if_small(given), "_p").groupBy("_list").agg(F.sort_array(F.collect_set("_user")).alias("_users"))
    if estimated_bytes(classes) <= BROADCAST_LIMIT_BYTES:
        met = listed.join(F.broadcast(classes), "_list")
    else:
        copies = classes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = listed.withColumn("_salt", F.pmod(F.xxhash64("_doc"), F.lit(SALTS)).cast("int")).join(copies, ["_list", "_salt"])
    return met.select(F.explode("_users").alias(user), F.col("_doc").alias(key))


def folder_tree(folders: DataFrame, folder: str = "folder_id", parent: str = "parent_id",
                roots: DataFrame | None = None) -> DataFrame:
    """All descendants of every root (folders without parent, or ``roots``): (root_id, folder_id, depth), the least depth.

    Pointer doubling: after i rounds a jump leads from a folder to its ancestor 2^i levels up, and the closure holds all pairs
    of less than 2^i levels.  A round joins the jumps with the closure (pairs of 2^i levels more) and with themselves, so a tree of any
    depth takes about log2(depth) rounds.  Pairs that are known are not kept again, and a round that brings none is the last,
    so cycles end.  Rounds are checkpointed to the shared folder."""
    edges = folders.select(F.col(folder).alias("node"), F.col(parent).alias("up")).filter(F.col("up").isNotNull()).distinct()
    if roots is None:
        roots = folders.filter(F.col(parent).isNull()).select(F.col(folder).alias("root_id"))
    out = roots.select("root_id", F.col("root_id").alias(folder), F.lit(0).alias("depth")).distinct()
    jumps, levels = edges, 1
    while True:
        reached = (jumps.join(out, jumps["up"] == out[folder])
                   .select("root_id", F.col("node").alias(folder), (F.col("depth") + levels).alias("depth")))
        # one table a round: the closure, where a pair's least depth stays, and how many pairs are new
        both = (out.withColumn("_new", F.lit(0)).unionByName(reached.withColumn("_new", F.lit(1)))
                .groupBy("root_id", folder).agg(F.min("depth").alias("depth"), F.min("_new").alias("_new")).checkpoint())
        out = both.drop("_new")
        if both.filter("_new = 1").isEmpty():
            return out
        far = jumps.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumps = jumps.join(far, "up").select("node", F.col("top").alias("up")).distinct().checkpoint()
        levels *= 2


def host_of(url: Column) -> Column:
    """Host part of a URL (user info and port stripped), lower case."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def port_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?[^/:?#]+:([0-9]+)", 1)


def host_in_list(df: DataFrame, key: str, url: str, rules: DataFrame, rule: str = "rule") -> DataFrame:
    """rows whose host matches a rule: ``*``, exact host, host:port, ``.suffix``
    (proper subdomains) or ``domain`` (the domain itself or any subdomain).

    Implemented as an equi-join: every row emits its host's suffixes
    (``a.b.c``, ``b.c``, ``c``) and ``host:port``; rules are normalised to
    (kind, value) and joined on value; a left-semi join keeps matching rows.
    """
    r = rules.select(F.lower(F.trim(F.col(rule))).alias("r")).filter(F.col("r") != "")
    r = r.select(
        F.when(F.col("r") == "*", F.lit("any"))
         .when(F.col("r").startswith("."), F.lit("proper"))
         .otherwise(F.lit("self_or_sub")).alias("kind"),
        F.when(F.col("r") == "*", F.lit("*"))
         .when(F.col("r").startswith("."), F.expr("substring(r, 2)"))
         .otherwise(F.col("r")).alias("value"))
    host, port = host_of(F.col(url)), port_of(F.col(url))
    labels = F.split(host, r"\.")
    n = F.size(labels)
    # suffix i = labels[i..]; i = 0 is the host itself
    suffixes = F.transform(F.sequence(F.lit(0), n - 1),
                           lambda i: F.struct(F.array_join(F.slice(labels, i + 1, n), ".").alias("value"),
                                              (i > 0).alias("proper")))
    keys = F.concat(suffixes, F.array(F.struct(F.lit("*").alias("value"), F.lit(False).alias("proper")),
                                      F.struct(F.concat(host, F.lit(":"), port).alias("value"),
                                               F.lit(False).alias("proper"))))
    ex = df.select(key, F.explode(keys).alias("k"))
    cond_kind = ((F.col("kind") == "any") & (F.col("k.value") == "*")) | \
                ((F.col("kind") == "proper") & F.col("k.proper")) | (F.col("kind") == "self_or_sub")
    matched = ex.join(broadcast_if_small(r), ex["k.value"] == r["value"]).filter(cond_kind)
    return df.join(matched.select(key).distinct(), key, "left_semi")
