"""Language identification by rank-order n-gram profiles and their out-of-place distance.

A text is lower-cased, everything but letters becomes one separator, and its 1-, 2- and 3-grams (not across
words) are counted over the whole text.  The profile of a language lists its ``PROFILE`` most frequent
n-grams by rank, counted over all texts of the language that may be learned from.  A document's most frequent
n-grams are compared with each profile: the distance adds up how far every n-gram is out of place,
``PROFILE`` where the profile lacks it.  The smallest distance wins; the score is one minus the share of the
largest possible distance.

Scale: counting is pre-aggregated per partition and summed by Spark on (language, n-gram), so a language with
most of the rows is as many groups as it has n-grams; the profiles (languages x PROFILE rows) are the only
thing sent to all workers, documents are scored where they are read.

Defined results: ``und`` with score 0 for a null or empty text, one without a letter, or where nothing could
be learned; rows without a language teach nothing; equal distances go to the alphabetically first language;
n-grams of equal counts are ordered by their characters; repeated rows are scored one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from sagebrush.llm.common import batch_of

PROFILE = 400
_BITS = 21            # a code point needs 21 bits; three fit a positive long
_GAP = 1              # code of the separator, below every letter
_CHUNK = 1 << 20      # characters counted at once while learning
_HELD = 4 << 20       # distinct counts that a partition holds before it merges them
_LETTERS: list = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def symbols(text: str | None) -> np.ndarray:
    """Letters as code points, each run of other characters as one separator; empty without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a separator is kept only behind a letter: none leads, none repeats
    out = np.where(letter, points, _GAP)[keep]
    return np.concatenate(([_GAP], out, [_GAP] * int(out[-1] != _GAP))).astype(np.int64)


def grams(seq: np.ndarray) -> np.ndarray:
    """The packed 1-, 2- and 3-grams of a symbol sequence; separators only at an end of an n-gram."""
    if not len(seq):
        return seq
    two = (seq[:-1] << _BITS) | seq[1:]
    three = ((two[:-1] << _BITS) | seq[2:])[seq[1:-1] != _GAP]
    return np.concatenate((seq[seq != _GAP], two, three))


def ranked(values: np.ndarray, size: int) -> np.ndarray:
    """The most frequent values, most frequent first, equal counts by value."""
    distinct, n = np.unique(values, return_counts=True)
    return distinct[np.lexsort((distinct, -n))[:size]]


def _merged(counts: list) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(np.concatenate([v for v, _ in counts]), return_inverse=True)
    return values, np.bincount(at, np.concatenate([n for _, n in counts])).astype(np.int64)


def _counter(schema: pa.Schema):
    def count(batches):
        held: dict[str, list] = {}
        open_: dict[str, list] = {}
        chars: dict[str, int] = {}

        def close(lang):
            seqs = open_.pop(lang, [])
            chars[lang] = 0
            if seqs:
                # separators at both ends keep n-grams from crossing texts, but for the bigram of two separators
                values, n = np.unique(grams(np.concatenate(seqs)), return_counts=True)
                ok = values != ((_GAP << _BITS) | _GAP)
                held.setdefault(lang, []).append((values[ok], n[ok]))
                if sum(len(v) for v, _ in held[lang]) > _HELD:
                    held[lang] = [_merged(held[lang])]

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seq = symbols(text)
                if len(seq):
                    open_.setdefault(lang, []).append(seq)
                    chars[lang] = chars.get(lang, 0) + len(seq)
                    if chars[lang] > _CHUNK:
                        close(lang)
        for lang in list(open_):
            close(lang)
        for lang, counts in held.items():
            values, n = _merged(counts)
            for i in range(0, len(values), 100_000):
                part = values[i:i + 100_000]
                yield batch_of(schema, lang=[lang] * len(part), gram=part, n=n[i:i + 100_000])
    return count


def learn_profiles(labelled: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Language -> its most frequent n-grams in rank order, from columns text and lang (at most ``size`` rows a
    language reach the driver)."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = (rows.filter("lang is not null and text is not null").mapInArrow(_counter(schema), "lang string, gram long, n long")
               .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)
    out: dict[str, list] = {}
    for r in top.select("lang", "rank", "gram").collect():
        out.setdefault(r.lang, []).append((r["rank"], r.gram))
    return {lang: [g for _, g in sorted(found)] for lang, found in sorted(out.items())}


class Profiles:
    """The profiles as one sorted n-gram table with a rank per language."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(profiles), size
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)  # the last row: unknown
        for column, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), column] = np.arange(len(profiles[lang]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of ranked n-grams to each language."""
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == own, at, len(self.grams))
        rank = self.ranks[at]
        out = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(own))[:, None]))
        return np.minimum(out, self.size).sum(axis=0)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """The nearest language, its score, and whether the text has a letter."""
        seq = symbols(text)
        if not len(seq) or not self.langs:
            return "und", 0.0, len(seq) > 0
        own = ranked(grams(seq), self.size)
        distance = self.distances(own)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (len(own) * self.size)), True


def _predictor(profiles, size: int, schema: pa.Schema, letters: str | None):
    def run(batches):
        model = Profiles(profiles.value, size)
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            new = {"lang_pred": [x for x, _, _ in found], "score": [s for _, s, _ in found]}
            if letters:
                new[letters] = [has for _, _, has in found]
            yield pa.RecordBatch.from_arrays([pa.array(new[f.name], type=f.type) if f.name in new else batch.column(f.name)
                                              for f in schema], schema=schema)
    return run


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, letters: str | None = None) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (columns of these names are replaced); text is read as a string.
    A column named ``letters``, if given, tells whether the text has a letter."""
    rows = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    out = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()),
                      *([StructField(letters, BooleanType())] if letters else [])])
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    return rows.mapInArrow(_predictor(shared, size, to_arrow_schema(out), letters), out)
