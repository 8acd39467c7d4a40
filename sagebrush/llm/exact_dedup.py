"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Each input partition fingerprints its texts (64 bits of the normalised text), sorts the distinct values
   and sends them, Golomb-coded, to the owners of the value ranges (about five bytes a fingerprint at 10^7
   texts).  A fingerprint that occurs a million times in a partition is sent once.
2. An owner merges its messages and answers each with a bitmap: which of your fingerprints does another
   partition have too?
3. The partition marks its suspects: fingerprints with a set bit, or seen twice at home.
4. Only the texts of suspects are grouped on (fingerprint, digest, normalised text): equal bytes, not equal
   fingerprints, make a group.  The grouping is a partially aggregated count, so a text that a third of
   all rows repeat is one row per task in the shuffle.  What stays is found on narrow rows without texts.

Owners grow with the number of rows; no task or driver holds the fingerprints of all documents.

Texts are equal when identical after deleting all of ``[\\x20\\x09-\\x0D]``; null counts as empty, and empty
texts are equal to each other.  The row with the most code points in the original text stays, then the
smallest doc_id (a null id comes first).  Rows that repeat a doc_id count as rows of their group, and each
shows the group's result.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebrush.llm import golomb
from sagebrush.llm.common import BLANKS, unused, written

FINGERPRINTS_PER_OWNER = 2_000_000


def normalised(text):
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), BLANKS, "")


def _owners(fp: np.ndarray, bits: int) -> np.ndarray:
    return (fp >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(fp), np.int64)


def _send(bits: int):
    def send(rows: pd.DataFrame) -> pd.DataFrame:
        fp = np.unique(rows["fp"].to_numpy(np.int64).view(np.uint64))
        owner = _owners(fp, bits)
        cut = np.flatnonzero(np.diff(owner)) + 1
        parts = np.split(fp, cut)
        return pd.DataFrame({"part": rows["part"].iloc[0], "owner": [int(owner[c]) for c in [0, *cut]],
                             "code": [golomb.encode(p) for p in parts]})
    return send


def _answer(messages: pd.DataFrame) -> pd.DataFrame:
    """Per message, a bitmap over its fingerprints: set where another message has the fingerprint too."""
    lists = [golomb.decode(c) for c in messages["code"]]
    every = np.concatenate(lists)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    same = ranked[1:] == ranked[:-1]
    shared = np.zeros(len(every), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    ends = np.cumsum([len(x) for x in lists])[:-1]
    return pd.DataFrame({"part": messages["part"].to_numpy(), "owner": messages["owner"].to_numpy(),
                         "bitmap": [np.packbits(b).tobytes() for b in np.split(shared, ends)]})


def _mark(bits: int):
    def mark(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        distinct, at, n = np.unique(fp, return_inverse=True, return_counts=True)
        suspect = n > 1
        owner = _owners(distinct, bits)
        for own, bitmap in zip(answers["owner"], answers["bitmap"], strict=True):
            lo, hi = np.searchsorted(owner, [own, own + 1])
            suspect[lo:hi] |= np.unpackbits(np.frombuffer(bitmap, np.uint8))[: hi - lo].astype(bool)
        return rows.drop(columns=["part"]).assign(suspect=suspect[at])
    return mark


def suspects(fingerprints: DataFrame) -> DataFrame:
    """The rows of ``fingerprints`` (columns fp and part, and others) with ``suspect``: another row may have
    the same fingerprint."""
    n = fingerprints.count()
    bits = max(0, (max(n // FINGERPRINTS_PER_OWNER, int(fingerprints.sparkSession.conf.get(
        "spark.sql.shuffle.partitions"))) - 1).bit_length())
    sent = fingerprints.select("part", "fp").groupBy("part").applyInPandas(
        _send(bits), "part int, owner long, code binary")
    answered = sent.groupBy("owner").applyInPandas(_answer, "part int, owner long, bitmap binary")
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in fingerprints.schema if f.name != "part"]
    return fingerprints.groupBy("part").cogroup(answered.groupBy("part")).applyInPandas(
        _mark(bits), ", ".join([*kept, "suspect boolean"]))


def exact_groups(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    text = normalised(F.col("text"))
    narrow = docs.select("doc_id", F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("size"),
                         text.alias("norm"), F.spark_partition_id().alias("part")).select(
        "doc_id", "size", F.sha2("norm", 256).alias("sha"), F.xxhash64("norm").alias("fp"), "part")
    marked = written(suspects(written(narrow, "fingerprints")), "suspects")

    alone = marked.filter("not suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))

    # bytes of the suspects: equal digests whose texts differ would be an error, not a group
    suspect = marked.filter("suspect").drop("suspect")
    wanted = suspect.select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    verified = (texts.select(text.alias("norm")).groupBy(F.xxhash64("norm").alias("fp"),
                                                         F.sha2("norm", 256).alias("sha"), "norm")
                .agg(F.count(F.lit(1)).alias("n")).groupBy("fp", "sha")
                .agg(F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("texts"))
                .select("fp", "sha", F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
                    F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("bigint")).alias("group_size")))
    best = suspect.groupBy("fp", "sha").agg(F.min(F.struct(-F.col("size"), "doc_id")).alias("best"))
    groups = best.join(verified, ["fp", "sha"]).select("fp", "sha", F.col("best.doc_id").alias("keep_id"), "group_size")
    several = suspect.join(groups, ["fp", "sha"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"))
    return alone.unionByName(several)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns (of rows that repeat an id, all stay)."""
    name = unused("_dropped", docs)
    dropped = exact_groups(docs).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(dropped, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")
