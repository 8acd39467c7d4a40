"""Line deduplication within one edit, by a deletion-neighbourhood join.

A line (normalised: lower case, blanks collapsed and trimmed) of at least ``min_chars`` characters is removed when an
earlier such line of the corpus, by (doc_id, line number), is equal to it or one insertion, deletion or substitution
away; shorter lines stay.  With ``min_chars`` 1, as op1_line_dedup calls it, every line takes part that is not empty.
"Earlier" looks at all lines of the input, removed or not.

1. Equal lines meet on 128 bits of hash; the earliest of each stays in the game with one row, however often it occurs.
2. Lines that cannot have a partner are set aside exactly: lines one edit apart share the first or the last half
   (of the shorter length), so a line whose four half keys nobody else has needs no variants.
3. The others emit their deletion neighbourhood as hashed keys: the line itself and the line without character p,
   each with the place p.  In a key's group the line itself is one edit from all others, and two lines that lack the same
   place p are one substitution apart; the earliest partner is a minimum over the group, so no pairs are formed.
   A group holds different lines with a common variant: its size is bounded by line length times alphabet, not
   by the number of rows.
4. Every found partner is verified by edit distance on the texts.

Defined results: a null or empty text has no removable line and comes back as it is; rows that repeat both id and text
are one document and share its result; a null doc_id counts as the earliest id; an empty table gives no rows.  Lines
are separated by line feeds; removing a line removes its line feed too.  A very long text is read whole, and each of its lines
is a row of its own.  Columns named n_lines or n_removed are replaced; all others pass, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagebrush.llm.common import columns_without, unused, written
from sagebrush.session import BROADCAST_LIMIT_BYTES

MIN_CHARS = 20  # where the caller names no bound
SUSPECT_BYTES = 64  # of a suspect's place in a task's memory
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def variants(line: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, places) of a line's deletion neighbourhood: place -1 is the line itself."""
    points = np.frombuffer(line.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    n = len(points)
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE))), dtype=np.uint64)[:n]
    prefix = np.concatenate(([np.uint64(0)], np.cumsum(_mix(points + _BASE) * power, dtype=np.uint64)))
    # without character p everything behind it moves one place to the front
    lacking = prefix[:-1] + (prefix[-1] - prefix[1:]) * _INVERSE
    keys = np.concatenate((prefix[-1:], lacking))
    keys += np.concatenate(([n], np.full(n, n - 1))).astype(np.uint64) * _BASE  # lengths tell equal sums apart
    return _mix(keys).view(np.int64), np.arange(-1, n, dtype=np.int32)


def _neighbourhood(frames):
    for frame in frames:
        for rows in np.array_split(np.arange(len(frame)), max(1, len(frame) // 200)):
            part = frame.iloc[rows]
            made = [variants(line) for line in part["norm"]]
            if made:
                times = [len(k) for k, _ in made]
                yield pd.DataFrame({"key": np.concatenate([k for k, _ in made]), "place": np.concatenate([p for _, p in made]),
                                    **{c: np.repeat(part[c].to_numpy(), times) for c in ("did", "rk", "line_no")}})


def _row_key():
    return F.xxhash64(F.col("doc_id").cast("string"), F.lit("|"), F.col("text").cast("string"))


def _place():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def _rows(docs: DataFrame) -> DataFrame:
    """did and rk, the place and key of a row, and its text."""
    return docs.select(_place().alias("did"), _row_key().alias("rk"), F.col("text").cast("string").alias("text"))


def _lines(rows: DataFrame) -> DataFrame:
    """One row per line of the given rows (did, rk, text): line_no, norm."""
    split = rows.select("did", "rk", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # most lines have single blanks only, which a search for bytes tells faster than a pattern
    line, odd = F.lower("line"), F.lit(False)
    for blank in ("  ", "\t", "\x0b", "\f", "\r"):
        odd = odd | line.contains(blank)
    norm = F.trim(F.when(odd, F.regexp_replace(line, r"\s+", " ")).otherwise(line))
    return split.select("did", "rk", "line_no", norm.alias("norm"))


def _half_keys():
    """Hashes of the halves that a line shares with a line one edit away, of its own length or next to it."""
    keys = []
    for shorter in (F.length("norm"), F.length("norm") - 1):
        half = F.floor(shorter / 2).cast("int")
        keys.append(F.xxhash64(F.lit("first"), shorter, F.substring(F.col("norm"), F.lit(1), half)))
        keys.append(F.xxhash64(F.lit("last"), shorter, F.substring(F.col("norm"), F.length("norm") - (shorter - half) + 1, shorter - half)))
    return F.array(*keys)


def near_lines(firsts: DataFrame, rows: DataFrame) -> DataFrame:
    """Of the earliest lines ``firsts`` (did, rk, line_no, keys): those with an earlier one within one edit."""
    at = ["did", "rk", "line_no"]
    keys = firsts.select(F.explode("keys").alias("key"), "h", "g", *at)
    place = F.struct(*at)
    # two different lines of a key differ in one of their hashes; plain numbers let Spark aggregate by hashing
    shared = keys.groupBy("key").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("h", "g")]).filter(
        "min_h <> max_h or min_g <> max_g").select("key")
    suspects = written(keys.join(shared, "key", "left_semi").select(*at).distinct(), "suspects")
    # their texts: few suspects travel to the documents, many meet them in a shuffle
    small = suspects.count() * SUSPECT_BYTES <= BROADCAST_LIMIT_BYTES

    def side(df):
        return F.broadcast(df) if small else df

    holders = rows.join(side(suspects.select("did", "rk").distinct()), ["did", "rk"], "left_semi")
    texts = written(_lines(holders).join(side(suspects), at, "left_semi").distinct(), "suspect-lines")
    made = texts.mapInPandas(_neighbourhood, "key long, place int, did long, rk long, line_no int")
    group, own = Window.partitionBy("key"), Window.partitionBy("key", "place")
    itself, lacking = F.when(F.col("place") < 0, place), F.when(F.col("place") >= 0, place)
    found = made.select(*at, "place", F.min(itself).over(group).alias("itself"), F.min(lacking).over(group).alias("lacking"),
                        F.min(place).over(own).alias("same"))
    partners = F.array("same", F.when(F.col("place") < 0, F.col("lacking")).otherwise(F.col("itself")))
    pairs = found.select(*at, F.explode(partners).alias("p")).filter(F.col("p") < place).distinct()
    other = texts.select(F.struct(*at).alias("p"), F.col("norm").alias("earlier"))
    return pairs.join(texts, at).join(other, "p").filter(F.levenshtein("norm", "earlier") <= 1).select(*at).distinct()


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs`` with the removed lines gone from text, and n_lines and n_removed; lines of fewer than
    ``min_chars`` characters stay, and empty ones always."""
    at = ["did", "rk", "line_no"]
    source = _rows(docs)
    lines = _lines(source)
    # a line that stays is one of its own, whatever its text
    own = F.when(F.length("norm") < max(1, min_chars), F.xxhash64(*at))
    firsts = lines.groupBy(F.coalesce(own, F.xxhash64("norm")).alias("h"), F.coalesce(own, F.xxhash64(F.lit("again"), "norm")).alias("g")).agg(
        F.min(F.struct(*at)).alias("at"), F.first(F.when(own.isNull(), _half_keys())).alias("keys")).select("at.*", "h", "g", "keys")
    firsts = written(firsts, "first-lines")
    near = near_lines(firsts.filter("keys is not null"), source)
    kept = firsts.select(*at).join(near, at, "left_anti").groupBy("did", "rk").agg(F.array_sort(F.collect_set("line_no")).alias("kept"))
    # lines meet their document by id and key, as keys alone would collide in a large corpus
    own_did, own_rk, did, rk, own_kept = (unused(c, docs) for c in ("_own_did", "_own_rk", "_did", "_rk", "_kept"))
    rows = docs.withColumns({own_did: _place(), own_rk: _row_key()}).join(
        kept.select(F.col("did").alias(did), F.col("rk").alias(rk), F.col("kept").alias(own_kept)).hint("shuffle_hash"),
        (F.col(own_did) == F.col(did)) & (F.col(own_rk) == F.col(rk)), "left")
    text = F.col("text").cast("string")
    staying = F.coalesce(own_kept, F.array().cast("array<int>"))
    n = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    split = F.split(text, "\n")  # only of texts that lose a line
    left = F.when(F.size(staying) == n, text).otherwise(
        F.array_join(F.transform(staying, lambda i: F.element_at(split, i + 1)), "\n"))
    columns = columns_without(docs, "text", "n_lines", "n_removed")
    return rows.select(*[F.col(f"`{c}`") for c in columns], F.when(text.isNotNull(), left).alias("text"),
                       F.coalesce(n, F.lit(0)).cast("long").alias("n_lines"),
                       F.coalesce(n - F.size(staying), F.lit(0)).cast("long").alias("n_removed"))
