"""A training-data pipeline over ``documents``: five stages, each a table that the next one reads.

Language ID rejects texts without a letter and labels the others with their recognised language, SimHash keeps one document of each near-duplicate group, decontamination
removes documents that repeat ten words of a benchmark item, mixing repeats small sources to the target weights, and
the last stage writes the token ids and returns what was read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrush.llm.common import prepare, table, unused, written
from sagebrush.llm.decontaminate import decontaminate
from sagebrush.llm.language import learn_profiles, predict
from sagebrush.llm.mixing import mix
from sagebrush.llm.simhash import keep_one
from sagebrush.llm.token_output import op4_token_output


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, their lang replaced by the recognised one; where nothing could be learned the given lang
    stays, "und" for a null one."""
    prepare(spark)
    letters = unused("_letters", docs)
    found = predict(docs, learn_profiles(docs), letters=letters).filter(F.col(letters))
    recognised = F.when(F.col("lang_pred") != "und", F.col("lang_pred"))
    return found.withColumn("lang", F.coalesce(recognised, "lang", "lang_pred")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of every near-duplicate component."""
    prepare(spark)
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    prepare(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents; one that is in several epochs stands several times."""
    prepare(spark)
    return mix(docs).select(docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of the token ids of every drawn document, from the written files."""
    prepare(spark)
    return op4_token_output(docs)


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup),
          ("benchmark_decontamination", benchmark_decontamination), ("source_mixing", source_mixing),
          ("token_output", token_output)]

# language profiles, fingerprints and the tokenizer have no form in SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
