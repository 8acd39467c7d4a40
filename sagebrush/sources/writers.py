"""Sinks and feed semantics.

Paths are parameters and must point at shared storage on a cluster; the
registered checks use folders under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType, StructField, StructType

from sagebrush.schemas import declared


def upsert_latest(base: DataFrame, changes: DataFrame, key: str = "docId", ts: str = "updatedAt") -> DataFrame:
    """Feed writes replace the document with the same id; the newest ``ts`` wins and on a
    tie the change wins over the base row.

    A group-by with ``max_by(row, (ts, priority))`` instead of a window: the
    aggregate combines map-side, so a key updated millions of times does not
    pull all its versions into one task.  Only (ts, priority) is compared, so
    rows may hold maps."""
    cols = [c for c in base.columns if c != key]
    versions = base.select(key, F.lit(0).alias("_prio"), F.struct(*cols).alias("_row")).unionByName(
        changes.select(key, F.lit(1).alias("_prio"), F.struct(*cols).alias("_row")))
    best = versions.groupBy(key).agg(F.max_by("_row", F.struct(F.col(f"_row.{ts}"), F.col("_prio"))).alias("_row"))
    return best.select(key, "_row.*")


def write_bucketed(df: DataFrame, table: str, key: str = "docId", buckets: int = 200) -> None:
    """S2 base as a table of ``buckets`` files, each sorted by the key (in the warehouse, which a cluster shares)."""
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def merge_bucketed(spark: SparkSession, table: str, changes: DataFrame, key: str = "docId", ts: str = "updatedAt",
                   buckets: int = 200) -> DataFrame:
    """S2 against a bucketed base, bucket by bucket: the changes are brought down to one version per key (combined map-side) and
    dealt like the base, which is read in place and never shuffled.  The newest ``ts`` wins, on a tie the change."""
    cols = [c for c in spark.table(table).columns if c != key]
    newest = (changes.groupBy(key).agg(F.max_by(F.struct(*cols), F.col(ts)).alias("_new"))
              .select(F.col(key).alias("_key"), "_new").repartition(buckets, "_key"))
    base = spark.table(table).select(F.col(key), F.struct(*cols).alias("_old"))
    # a hint, as a small change set would else be broadcast, which a full join does not allow
    both = base.hint("merge").join(newest, F.col(key) == F.col("_key"), "full_outer")
    old, new = F.col("_old")[ts], F.col("_new")[ts]
    take_old = F.col("_new").isNull() | (F.col("_old").isNotNull() & (new.isNull() | (old > new)))
    row = F.when(take_old, F.col("_old")).otherwise(F.col("_new"))
    return both.select(F.coalesce(F.col(key), F.col("_key")).alias(key), row.alias("_row")).select(key, "_row.*")


def laid_out(df: DataFrame, *keys: str) -> DataFrame:
    """The rows gathered by the folder that they go to, so a folder has few files instead of one a task; the adaptive plan splits a
    folder that holds most of the rows."""
    return df.hint("rebalance", *[F.col(k) for k in keys])


def conform(df: DataFrame, doc_type: str) -> DataFrame:
    """``df`` in the columns and types that its document type declares; absent fields are null.  Fields that the type does
    not declare, or declares with another type, are an error (a long may be given as an int)."""
    want = declared(doc_type)
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    wrong = [f"{c}: not declared" for c in have if c not in want.fieldNames()]
    wrong += [f"{f.name}: {have[f.name]} instead of {f.dataType.simpleString()}" for f in want if f.name in have
              and (have[f.name], f.dataType.simpleString()) != ("int", "bigint") and have[f.name] != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"not a {doc_type}: {'; '.join(wrong)}")
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def write_docs(df: DataFrame, path: str, partition_by: str | None = "app", mode: str = "overwrite", doc_type: str | None = None) -> None:
    """S3: store one document type as Parquet, partitioned by a low-cardinality attribute
    (filters on it prune whole folders).  With ``doc_type`` the rows are held to the type's declaration."""
    if doc_type:
        df = conform(df, doc_type)
        partition_by = partition_by if partition_by in df.columns else None
    if partition_by:
        laid_out(df, partition_by).write.mode(mode).partitionBy(partition_by).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def read_docs(spark: SparkSession, path: str, schema=None, doc_type: str | None = None) -> DataFrame:
    """Read one document type under its declared schema (never inferred when given): a StructType or DDL text, or the name of a
    declared type."""
    want = declared(doc_type) if doc_type else schema
    if want is None:
        return spark.read.parquet(path)
    found = spark.read.schema(want).parquet(path)
    return found.select(*[f"`{c}`" for c in want.fieldNames()]) if doc_type else found     # folder columns in their declared place


def read_feed(spark: SparkSession, path: str, doc_type: str) -> tuple[DataFrame, DataFrame]:
    """S1 from a feed of JSON lines: (documents under the declared schema, wrong rows with their text and the reason).

    A row is wrong if it is no JSON, if a field has another type than the declared one, or if it lacks the id.  All fields are
    parsed whichever the caller selects, so the same rows are wrong in every query."""
    want = declared(doc_type)
    # keys of JSON objects are strings; those of an int map are cast behind the parser, and one that is no number is a wrong type
    by_int = {f.name: MapType(StringType(), f.dataType.valueType) for f in want
              if isinstance(f.dataType, MapType) and f.dataType.keyType == IntegerType()}
    whole = StructType([*(StructField(f.name, by_int.get(f.name, f.dataType)) for f in want), StructField("_wrong", StringType())])
    parsed = F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_wrong"})
    rows = spark.read.text(path).select("value", parsed.alias("d"))
    ill = F.col("d").isNull() | F.col("d._wrong").isNotNull()
    for c in by_int:
        ill = ill | F.coalesce(F.exists(F.map_keys(F.col(f"d.`{c}`")), lambda k: k.try_cast("int").isNull()), F.lit(False))
    rows = rows.withColumn("reason", F.when(ill, "malformed").when(F.col("d.docId").isNull(), "no docId"))
    good = rows.filter(F.col("reason").isNull()).select(*[
        (F.transform_keys(F.col(f"d.`{c}`"), lambda k, _: k.cast("int")) if c in by_int else F.col(f"d.`{c}`")).alias(c)
        for c in want.fieldNames()])
    return good, rows.filter(F.col("reason").isNotNull()).select("value", "reason")


def materialize_hits(hits: DataFrame, path: str, features: list[str], keys: tuple[str, ...] = ("query_id",)) -> None:
    """Ranked hits with their feature struct, one folder per query id range (partitioned)."""
    out = hits.withColumn("match_features", F.struct(*[F.col(c) for c in features])).drop(*features)
    laid_out(out, *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def daily_partitions(df: DataFrame, path: str, ts: str = "ts") -> None:
    """One folder per UTC day (the 24 h index period); date filters prune folders."""
    days = df.withColumn("day", F.to_date(F.col(ts).cast("timestamp")))
    laid_out(days, "day").write.mode("overwrite").partitionBy("day").parquet(path)
