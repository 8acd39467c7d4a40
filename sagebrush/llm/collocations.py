"""Phrase collocations by set-oriented relational mining (SETM).

The occurrence relation of length k says which k-word phrase stands at which place.  Relations are persisted in the order of the
places: a row of the table is the part that one block of whole documents has, its groups (phrases) numbered within the block.

1. ``occurrences``: texts are split into pieces and words; a block keeps the number of the word at every place, with a gap after each
   piece, and its words per language with their counts.
2. Group-count: every block sends one row per different group with its count; Spark adds them up and keeps those of the whole
   corpus that reach ``least``.  The rows that are left tell each block which of its own groups are frequent.
3. Semi-join: the block drops the places of the other groups.  Merge-join: a frequent phrase at one place and a frequent one at the next
   are joined into a phrase that is a word longer; a gap keeps pieces apart.  This is the next relation, persisted like the first, and its
   groups are counted as in 2, up to the longest length.
4. Scores come from the counts of the first and last words of each phrase, which equi-joins of the group tables carry along: a phrase of
   k + 1 words meets the phrases of k words at its beginning and at its end.  A candidate is compared with those one word longer
   only: a longer one that takes its place implies such a one, as counts fall with length.

A phrase travels as the numbers of its words.  The frequent words (with their language) are numbered from 0 without gaps, by their
place in a written table, so a number takes as few bytes as their count allows (three up to 16 million) and no two words share one.

A group that a third of all places have is one row per block in the shuffle.  A task holds one block, ``BLOCK_BYTES`` of text or one
longer document.

Defined results: a null or empty text has no words; a null language counts as "und"; texts of any length are read whole; repeated rows
and ids count like others; equal scores and counts come by the phrase in UTF-8 byte order; an empty table gives no rows.  Other
columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagebrush.llm.common import forget, freed_shuffles, written

LEAST = 30
LONGEST = 4
TOP = 2000
SCALE = 2_000_000
BLOCK_BYTES = 48 << 20
_CHUNK = 2 << 20        # bytes of text that are split at once
_ROWS = 1 << 17         # rows of a batch of counts
_GAP = -1
# lower case for A-Z, a blank for a tab, and one mark for everything that ends a piece
_BYTES = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 10))

_OCCURRENCES = "block long, places binary, groups array<struct<lang:string,word:string,n:long>>"


def _packed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpacked(body: bytes, kind: str = "<i4") -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), kind)


class _Words:
    """The words of a block's texts, numbered by language and word; ``_GAP`` stands between pieces."""

    def __init__(self):
        self.known: dict[tuple[str, bytes], int] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, texts: list[bytes]) -> None:
        """Texts of one language."""
        data = b"\n".join((*texts, b"")).translate(_BYTES).replace(b"\n", b" \n ")
        words = pa.array([w for w in data.split(b" ") if w], pa.binary()).dictionary_encode()
        if len(words):
            own = [_GAP if w == b"\n" else self.known.setdefault((lang, w), len(self.known)) for w in words.dictionary.to_pylist()]
            self.parts.append(np.array(own, np.int32)[words.indices.to_numpy()])
        self.size += len(data)


def _occurrences(size: int):
    schema = pa.schema([("block", pa.int64()), ("places", pa.binary()),
                        ("groups", pa.list_(pa.struct([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])))])

    def run(batches):
        from pyspark import TaskContext

        block, words, held, n_held = TaskContext.get().partitionId() << 32, _Words(), {}, 0

        def split():
            nonlocal held, n_held
            for lang, texts in held.items():
                words.add(lang, texts)
            held, n_held = {}, 0

        def close():
            places = np.concatenate([np.zeros(0, np.int32), *words.parts])
            n = np.bincount(places[places >= 0], minlength=len(words.known))
            groups = pa.StructArray.from_arrays([pa.array([lang for lang, _ in words.known], pa.string()),
                                                 pa.array([w for _, w in words.known], pa.binary()).cast(pa.string()), pa.array(n)], ["lang", "word", "n"])
            whole = pa.ListArray.from_arrays(np.array([0, len(groups)], np.int32), groups)
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([_packed(places)], pa.binary()), whole], schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, []).append(text.encode("utf-8", "replace"))
                    n_held += len(held[lang][-1])
                    if n_held >= _CHUNK:
                        split()
                        if words.size >= size:
                            yield close()
                            block, words = block + 1, _Words()
        split()
        if words.known:
            yield close()
    return run


def occurrences(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The relation of single words: block, places (word number or gap at every place), groups (lang, word, count)."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(_occurrences(block_bytes), _OCCURRENCES), "word-occurrences")


def _count() -> Column:
    """The count of a block's row, whose group and count are one long, so that shuffled rows are short."""
    return F.col("own").bitwiseAND(F.lit((1 << 32) - 1))


def group_totals(counts: DataFrame, keys: list[str], least: int) -> DataFrame:
    return counts.groupBy(*keys).agg(F.sum(_count()).alias("total")).filter(F.col("total") >= least)


def frequent(counts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Of the blocks' counts (keys, block, own = group and n) the rows (keys, block, group, total) of groups that reach ``least``: one
    row per block and group is shuffled, once, and a window adds up a group, which has one row per block at most."""
    total = F.sum(_count()).over(Window.partitionBy(*keys))
    kept = counts.withColumn("total", total).filter(F.col("total") >= least)
    return written(kept.select(*keys, "block", F.shiftright("own", 32).alias("group"), "total"), "frequent-groups")


def _phrases(row, length: int) -> np.ndarray:
    """The words of a relation's groups: those of the phrase at the beginning, and the last one of the phrase at the end."""
    words = _unpacked(row["words"], "<i8").reshape(-1, length - 1)
    left, right = np.cumsum(_unpacked(row["left"])), _unpacked(row["right"])
    return np.column_stack((words[left], words[right, -1]))


def _extend(length: int):
    """Semi-join of a block's relation with its frequent groups, and merge-join with itself at the next place: the next relation."""
    def run(relation: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(relation) or not len(found):
            return pd.DataFrame(columns=["block", "places", "left", "right", "words"])
        row, found = relation.iloc[0], found.sort_values("group")
        group, places = found["group"].to_numpy(np.int64), _unpacked(row["places"])
        words = found["w0"].to_numpy(np.int64)[:, None] if length == 1 else _phrases(row, length)[group]
        kept = np.full(max(int(places.max(initial=0)), int(group.max())) + 2, _GAP, np.int32)
        kept[group] = np.arange(len(group))     # the last entry serves the gaps
        places = kept[places]
        both = np.flatnonzero((places[:-1] >= 0) & (places[1:] >= 0))
        pairs, of = np.unique(places[both].astype(np.int64) * len(group) + places[both + 1], return_inverse=True)
        joined = np.full(len(places), _GAP, np.int32)
        joined[both] = of
        left, right = ((x.astype(np.int32)) for x in np.divmod(pairs, len(group)))
        return pd.DataFrame({"block": [row["block"]], "places": [_packed(joined)], "left": [_packed(np.diff(left, prepend=np.int32(0)))], "right": [_packed(right)],
                             "words": [_packed(np.ascontiguousarray(words))]})
    return run


def extend(relation: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """The relation of phrases of ``length`` + 1 words: block, places, and of every group its beginning and its end among the frequent
    phrases, whose words stand beside them."""
    answers = found.select("block", "group", *(["w0"] if length == 1 else []))
    sides = relation.groupBy("block").cogroup(answers.groupBy("block"))
    return written(sides.applyInPandas(_extend(length), "block long, places binary, left binary, right binary, words binary"), "phrase-occurrences")


def _counts(length: int, width: int):
    """A row per block and group of a relation; a phrase's key is its words' numbers, ``width`` bytes each."""
    schema = pa.schema([("key", pa.binary()), ("block", pa.int64()), ("own", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                phrases, places = _phrases(row, length), _unpacked(row["places"])
                own = np.arange(len(phrases)) << 32 | np.bincount(places[places >= 0], minlength=len(phrases))
                for a in range(0, len(own), _ROWS):
                    part = phrases[a:a + _ROWS]
                    n, size = len(part), length * width
                    keys = np.ascontiguousarray(part.astype(">i8").view(np.uint8).reshape(n, length, 8)[:, :, 8 - width:])
                    keys = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * size + 1, size, dtype=np.int32)), pa.py_buffer(keys)])
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(n, row["block"])), pa.array(own[a:a + _ROWS])], schema=schema)
    return run


def phrase_counts(relation: DataFrame, length: int, width: int) -> DataFrame:
    return relation.mapInArrow(_counts(length, width), "key binary, block long, own long")


def _numbered(found: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, f, w0) of the frequent words, numbered without gaps, and the bytes that a number takes.

    A word's place in the written table is its partition and its place there; the partitions' sizes, a row each, say where their
    numbers begin."""
    words = found.groupBy("lang", "word").agg(F.first("total").alias("f")).withColumn("at", F.monotonically_increasing_id())
    words = written(words, "words").withColumn("part", F.shiftright("at", 33))
    sizes = words.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    own = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = written(words.join(F.broadcast(starts), "part").select("lang", "word", "f", own.alias("w0")), "numbered-words")
    return numbered, max(1, ((numbered.count() - 1).bit_length() + 7) // 8)


def group_tables(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[DataFrame], int]:
    """(lang, n) of all words; for every length the frequent groups, (lang, word, key, f) of words and (key, f) of phrases; a word's bytes in a key."""
    first = occurrences(docs, block_bytes)
    groups = first.select("block", F.posexplode("groups").alias("group", "g"))
    totals = written(groups.groupBy("g.lang").agg(F.sum("g.n").alias("n")), "word-totals")
    own = F.shiftleft(F.col("group").cast("long"), 32).bitwiseOR(F.col("g.n"))
    found = frequent(groups.select("block", "g.lang", "g.word", own.alias("own")), ["lang", "word"], least)
    numbered, width = _numbered(found)
    key = F.substring(F.unhex(F.lpad(F.hex("w0"), 16, "0")), 9 - width, width)
    tables = [numbered.select("lang", "word", key.alias("key"), "f")]
    of_block = found
    found = found.join(numbered.select("lang", "word", "w0"), ["lang", "word"])
    relation = first.select("block", "places")
    for length in range(2, longest + 1):
        before, relation = relation, extend(relation, found, length - 1)
        forget(before, of_block)
        counts = phrase_counts(relation, length, width)
        if length < longest:
            found = of_block = frequent(counts, ["key"], least)
            tables.append(written(found.groupBy("key").agg(F.first("total").alias("f")), "groups"))
        else:
            tables.append(written(group_totals(counts, ["key"], least).withColumnRenamed("total", "f"), "groups"))
            forget(relation)
    return totals, tables, width


def _quotient(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(SCALE * a / (l + r)) in decimals, so that no product passes its type."""
    whole = F.lit(SCALE).cast("decimal(9,0)") * a.cast("decimal(19,0)")
    below = (l.cast("decimal(19,0)") + r.cast("decimal(19,0)"))
    return ((whole - whole % below) / below).cast("decimal(38,0)").cast("long")


def scored(tables: list[DataFrame], width: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one replaces."""
    def begin_of(length):
        return F.substring("key", 1, (length - 1) * width)

    def end_of(length):
        return F.substring("key", width + 1, (length - 1) * width)

    before = tables[0].select("key", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("firsts"),
                              F.array("f").alias("lasts"))
    out = None
    for length, table in enumerate(tables[1:], start=2):
        begin = before.select(F.col("key").alias("begin"), "lang", F.col("phrase").alias("first_words"), "firsts")
        end = before.select(F.col("key").alias("end"), "last", "lasts")
        own = (table.select("key", begin_of(length).alias("begin"), end_of(length).alias("end"), "f").join(begin, "begin").join(end, "end")
               .select("key", "lang", F.concat_ws(" ", "first_words", "last").alias("phrase"), "last",
                       F.concat("firsts", F.array("f")).alias("firsts"), F.concat("lasts", F.array("f")).alias("lasts"), "f"))
        before = own = written(own, "phrases")
        cuts = []
        for k in range(1, length):
            l, r = F.col("firsts")[k - 1], F.col("lasts")[length - k - 1]  # noqa: E741
            cuts.append(F.struct(_quotient(F.col("f"), l, r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
        rows = own.select("key", "lang", "phrase", F.col("f").alias("a"), F.array_min(F.array(*cuts)).alias("b"))
        if length < len(tables):
            # the commonest phrase of one more word that begins or ends with this one
            longer = tables[length].select(F.explode(F.array(begin_of(length + 1), end_of(length + 1))).alias("key"), "f")
            longer = longer.groupBy("key").agg(F.max("f").alias("longer"))
            rows = rows.join(longer, "key", "left").filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * 100 < F.col("a").cast("decimal(19,0)") * 80))
        rows = rows.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
        out = rows if out is None else out.unionByName(rows)
    return out


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases."""
    with freed_shuffles(docs.sparkSession):
        totals, tables, width = group_tables(docs, least, longest, block_bytes)
        candidates = scored(tables, width)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
