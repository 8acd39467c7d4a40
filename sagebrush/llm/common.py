"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.session import ensure_checkpoint_dir

# the six characters of [\x20\x09-\x0D], the white space of the contracts
BLANKS = " \t\n\x0b\x0c\r"
# rows of an Arrow batch: texts are up to megabytes long, so few rows are held at a time
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Session settings that the operators rely on."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new folder below the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table written to the shared folder and read back: its lineage ends there, and a lost
    executor costs the reading of a file instead of the whole job before it."""
    path = scratch_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """What is written inside frees the files of its exchanges at its end, as the table has all that they had."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def forget(*tables: DataFrame) -> None:
    """Delete written tables whose readers have written what they made of them."""
    for table_ in tables:
        for path in {f.rsplit("/", 1)[0] for f in table_.inputFiles()}:
            there = table_.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(table_.sparkSession._jsc.hadoopConfiguration()).delete(there, True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, behind as many underscores as it takes until no column of the tables has it (Spark compares without case)."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_without(df: DataFrame, *replaced: str) -> list[str]:
    """The columns of ``df`` but those that a result replaces, compared without case as Spark does."""
    return [c for c in df.columns if c.lower() not in replaced]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """An Arrow batch with the given columns (lists or arrays) in the order of the schema."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
