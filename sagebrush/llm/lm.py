"""Scores of an interpolated modified Kneser-Ney model of bigrams or trigrams over words, counted and served by hash shards.

The model: p(w | uv) = max(c(uvw) - T(c(uvw)), 0) / c(uv.) + g(uv) p(w | v), p(w | v) = max(b(vw) - D(b(vw)), 0) / b(v.) +
g(v) p(w), p(w) = max(a(w) - E(a(w)), 0) / a(.) + h / (V + 1), with c the counts in training texts, b(vw) and a(w) the number
of different words before vw and w, discounts T, D and E for counts 1, 2 and 3 or more from the counts of counts, and g(uv),
g(v), h the mass that the discounts free.  Texts begin after a begin mark and end with an end token; as nothing stands before
the mark, b of a text's first bigram is its count, and the first word is scored by its bigram.  A model of order two begins
with the second formula, where b is c.  The probabilities of the V known tokens and the unknown one add up to 1.

Scale: no task holds the model or the vocabulary.
* Texts become blocks of about ``BLOCK_TOKENS`` tokens: sorted 64-bit word hashes and the texts as coded ranks in them.
* A block sends its distinct n-grams of the model's order, as sorted Golomb-coded hashes with their training counts, to
  the shards that own the hash ranges.  A shard merges them into its part of the model, sorted hash arrays with count
  arrays, looks every message up in them and answers with the counts, in order.  It holds the arrays in memory-mapped files
  of its own folder for that call only: the map is transient, and another table cannot be scored from it.
* An n-gram is counted once for the statistics of the shorter ones in it: by the first block that sent it.  The blocks'
  statistics of bigrams, if the order is three, and of words go through the same exchange.  Then a block has all that its
  texts need.
Shards own hash ranges of n-grams and words, not of contexts, so a word or pair that makes up a third of the corpus is
one entry a block.  Shards and blocks grow in number, not in size.

Defined results: a null or empty text is the end token alone; rows are scored one by one, also repeated ones; with no
training text every token has probability 1 / (V + 1) = 1; a null doc_id stays null.  doc_id is an integer.
"""

from __future__ import annotations

import tempfile
import zlib
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebrush.llm import golomb
from sagebrush.llm.common import batch_of, written
from sagebrush.llm.token_output import pack, unpack

BLOCK_TOKENS = 2_000_000
BEGIN, END = np.uint64(1), np.uint64(2)
BIGRAM_COLUMNS = {2: ("count",), 3: ("context", "n1", "n2", "n3", "before")}  # by the order of the model
WORD_COLUMNS = ("count", "context", "n1", "n2", "n3", "before")
_BLOCK = "block long, doc_ids array<long>, held array<boolean>, sizes array<long>, words binary, ranked binary, control binary, data binary"
_MESSAGE = "block long, shard long, n long, keys binary, counts binary"
_REPLY = "block long, shard long, n long, counts binary, first binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text and of the end token."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six blanks only
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = [digest(w) for w in words]
    out[-1] = END
    return out


def _squeeze(columns: list[np.ndarray]) -> bytes:
    """Counts, column after column: a byte each, and eight bytes behind them for each that is 255 or more."""
    every = np.concatenate(columns)
    small = np.minimum(every, 255).astype(np.uint8)
    return zlib.compress(small.tobytes() + every[small == 255].astype("<i8").tobytes(), 1)


def _loosen(body: bytes, n: int, columns: int) -> list[np.ndarray]:
    raw = zlib.decompress(body)
    small = np.frombuffer(raw, np.uint8, n * columns)
    every = small.astype(np.int64)
    every[small == 255] = np.frombuffer(raw, "<i8", offset=n * columns)
    return np.split(every, columns)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, a place of each, and each key's place among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[new], order[new], at


# ---- blocks

def _blocks(size: int):
    names = [f.strip().split(" ")[0] for f in _BLOCK.split(",")]
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64())] + [pa.binary()] * 4
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, held, texts, n = [], [], [], 0

        def close():
            nonlocal ids, held, texts, n, block
            words, _, at = _distinct(np.concatenate(texts))
            order = np.argsort(-np.bincount(at), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            control, data = pack(rank[at])
            row = batch_of(schema, block=[block], doc_ids=[ids], held=[held], sizes=[[len(t) for t in texts]],
                           words=[golomb.encode(words)], ranked=[order.astype("<u4").tobytes()], control=[control], data=[data])
            ids, held, texts, n, block = [], [], [], 0, block + 1
            return row

        for batch in batches:
            for key, out, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held", "text")), strict=True):
                ids.append(key)
                held.append(out)
                texts.append(token_hashes(text))
                n += len(texts[-1])
                if n >= size:
                    yield close()
        if ids:
            yield close()
    return run


class Block:
    """The texts of a block as places in its word list, and its distinct bigrams."""

    def __init__(self, row):
        self.sizes = np.asarray(row["sizes"], np.int64)
        self.doc_ids, self.held = list(row["doc_ids"]), np.array([bool(x) for x in row["held"]])
        words = golomb.decode(row["words"])
        n = int(self.sizes.sum())
        place = np.frombuffer(row["ranked"], "<u4")[unpack(np.frombuffer(row["control"], np.uint8), np.frombuffer(row["data"], np.uint8), n)]
        # the begin mark joins the word list at its end: it is a context, never a token
        self.words = np.append(words, BEGIN)
        self.token = place.astype(np.int64)
        before = np.empty(n, np.int64)
        before[1:] = self.token[:-1]
        before[np.cumsum(self.sizes) - self.sizes] = len(words)
        self.learned = np.repeat(~self.held, self.sizes)
        # bigrams are kept in the order of their hashes, in which they are sent
        mixed = _mix(self.words)
        self.keys, at, self.pair = _distinct(_mix(self.words[before] * np.uint64(0x9E3779B97F4A7C15) + mixed[self.token]))
        self.left, self.right = before[at], self.token[at]

    def find_trigrams(self) -> None:
        """The distinct trigrams, as places of their first and last two words among the bigrams; a text's first word ends none."""
        inner = np.ones(len(self.token), bool)
        inner[np.cumsum(self.sizes) - self.sizes] = False
        self.inner = np.flatnonzero(inner)
        opening = self.pair[self.inner - 1]
        keys = _mix(self.keys[opening] * np.uint64(0x9E3779B97F4A7C15) + _mix(self.words)[self.token[self.inner]])
        self.trigram_keys, at, self.triple = _distinct(keys)
        self.opening, self.ending = opening[at], self.pair[self.inner[at]]

    def trigram_counts(self) -> np.ndarray:
        """Training count in this block of each trigram."""
        return np.bincount(self.triple[self.learned[self.inner]], minlength=len(self.opening))

    def bigram_counts(self) -> np.ndarray:
        """Training count in this block of each bigram."""
        return np.bincount(self.pair[self.learned], minlength=len(self.left))

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.token[self.learned], minlength=len(self.words))


# ---- the exchange between blocks and shards

def _shards(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _messages(block: int, keys: np.ndarray, columns: list[np.ndarray], bits: int) -> pd.DataFrame:
    """One message a shard: ascending keys and their columns.  Equal keys of a block would be a hash collision."""
    shard = _shards(keys, bits)
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(keys)]
    rows = [(block, int(shard[a]), b - a, golomb.encode(keys[a:b]), _squeeze([c[a:b] for c in columns]))
            for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    return pd.DataFrame(rows, columns=["block", "shard", "n", "keys", "counts"])


class Shard:
    """Sorted hash array and count arrays of a key range, stored in files and memory-mapped."""

    def __init__(self, folder: str, keys: list[np.ndarray], columns: list[list[np.ndarray]]):
        every = np.concatenate(keys)
        distinct, _, at = _distinct(every)
        self.first = np.empty(len(distinct), np.int64)
        self.first[at[::-1]] = np.arange(len(every) - 1, -1, -1)  # of equal keys the earliest is assigned last
        distinct.tofile(f"{folder}/keys")
        self.n = len(distinct)
        for i, parts in enumerate(columns):
            np.bincount(at, np.concatenate(parts), minlength=self.n).astype("<i8").tofile(f"{folder}/{i}")
        self.keys = np.memmap(f"{folder}/keys", np.uint64, "r", shape=(self.n,))
        self.columns = [np.memmap(f"{folder}/{i}", "<i8", "r", shape=(self.n,)) for i in range(len(columns))]

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, keys)


def _serve(n_columns: int, statistics):
    """Answers the messages of a shard; one more row, of block -1, holds its statistics."""
    def serve(messages: pd.DataFrame) -> pd.DataFrame:
        messages = messages.sort_values("block", kind="stable")
        keys = [golomb.decode(k) for k in messages["keys"]]
        columns = [_loosen(c, n, n_columns) for c, n in zip(messages["counts"], messages["n"], strict=True)]
        shard = int(messages["shard"].iloc[0])
        rows = []
        with tempfile.TemporaryDirectory() as folder:
            model = Shard(folder, keys, [[c[i] for c in columns] for i in range(n_columns)])
            start = 0
            for block, own in zip(messages["block"], keys, strict=True):
                at = model.look_up(own)
                first = model.first[at] == start + np.arange(len(own))
                rows.append((int(block), shard, len(own), _squeeze([c[at] for c in model.columns]), np.packbits(first).tobytes()))
                start += len(own)
            rows.append((-1, shard, model.n, np.asarray(statistics(*model.columns), "<i8").tobytes(), b""))
            del model
        return pd.DataFrame(rows, columns=["block", "shard", "n", "counts", "first"])
    return serve


def _counts_of_counts(x: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(x, 5), minlength=6)[1:5].tolist()


def _gram_statistics(*columns):
    """Of bigrams or trigrams: counts of counts of the last column, which the discounts come from."""
    return _counts_of_counts(columns[-1])


def _word_statistics(count, context, n1, n2, n3, before):
    """Of the words: counts of counts of a(w), their sum, V and N."""
    return [*_counts_of_counts(before), int((before > 2).sum()), int(before.sum()), int((count > 0).sum()), int(count.sum())]


def _reply(rows: pd.DataFrame, n_columns: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The answers to a block's messages, in the order of its keys: columns, and whether it was the first sender."""
    if not len(rows):  # a block of empty texts has no trigram
        return [np.zeros(0, np.int64)] * n_columns, np.zeros(0, bool)
    rows = rows.sort_values("shard")
    parts = [_loosen(c, n, n_columns) for c, n in zip(rows["counts"], rows["n"], strict=True)]
    first = [np.unpackbits(np.frombuffer(f, np.uint8))[:n].astype(bool) for f, n in zip(rows["first"], rows["n"], strict=True)]
    return [np.concatenate([p[i] for p in parts]) for i in range(n_columns)], np.concatenate(first)


def _totals(replies: DataFrame, width: int) -> list[int]:
    """Sums of the shards' statistics rows."""
    total = np.zeros(width, np.int64)
    for r in replies.filter("block = -1").select("counts").toLocalIterator():
        total += np.frombuffer(r["counts"], "<i8")
    return total.tolist()


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Discounts for the counts 0, 1, 2 and 3 or more."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [i - (i + 1) * y * more / n if n else 0.0 for i, n, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [0.0, *(min(max(d, 0.0), float(i)) for i, d in enumerate(raw, 1))]


# ---- the passes over blocks

def _bigram_messages(bits: int):
    """Of the bigrams, from the trigrams: sum and number by count of those that they open, number of those that they end."""
    def run(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return pd.DataFrame(columns=["block", "shard", "n", "keys", "counts"])
        own = Block(blocks.iloc[0])
        own.find_trigrams()
        (count,), first = _reply(replies, 1)
        n = len(own.left)
        take = first & (count > 0)
        opening, ending, count = own.opening[take], own.ending[take], count[take]

        def by(pair, weight=None):
            return np.bincount(pair, weight, minlength=n).astype(np.int64)

        # nothing stands before a begin mark: its bigrams count as often as they occur
        before = by(ending) + np.where(own.left == len(own.words) - 1, own.bigram_counts(), 0)
        columns = [by(opening, count), by(opening[count == 1]), by(opening[count == 2]), by(opening[count > 2]), before]
        return _messages(int(blocks["block"].iloc[0]), own.keys, columns, bits)
    return run


def _word_messages(bits: int, n_columns: int):
    def run(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):  # the statistics rows
            return pd.DataFrame(columns=["block", "shard", "n", "keys", "counts"])
        own = Block(blocks.iloc[0])
        (*_, count), first = _reply(replies, n_columns)
        n = len(own.words)
        take = first & (count > 0)
        left, right, count = own.left[take], own.right[take], count[take]

        def by(word, weight=None):
            return np.bincount(word, weight, minlength=n).astype(np.int64)

        columns = [own.word_counts(), by(left, count), by(left[count == 1]), by(left[count == 2]), by(left[count > 2]), by(right)]
        order = np.argsort(own.words)
        return _messages(int(blocks["block"].iloc[0]), own.words[order], [c[order] for c in columns], bits)
    return run


def _interpolated(count, discount, context, n1, n2, n3, lower):
    """Probabilities of n-grams from their counts, the sums and numbers by count of their contexts, and the next lower order."""
    total = np.maximum(context, 1)
    mass = (discount[1] * n1 + discount[2] * n2 + discount[3] * n3) / total
    p = np.maximum(count - discount[np.minimum(count, 3)], 0) / total + mass * lower
    return np.where(context > 0, p, lower)


def _scores(order: int, d: list[float], e: list[float], t: list[float], word_totals: list[int]):
    t1, t2, _, _, t3, every, v, n = word_totals
    free = (e[1] * t1 + e[2] * t2 + e[3] * t3) / every if every else 1.0
    d, e, t = np.array(d), np.array(e), np.array(t)

    def run(blocks: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        own = Block(blocks.iloc[0])
        columns = BIGRAM_COLUMNS[order]
        pairs, _ = _reply(replies[replies["kind"] == 0], len(columns))
        sorted_columns, _ = _reply(replies[replies["kind"] == 1], len(WORD_COLUMNS))
        by_hash = np.argsort(own.words)
        words = np.empty((len(WORD_COLUMNS), len(by_hash)), np.int64)
        words[:, by_hash] = sorted_columns
        c, *contexts, before = words
        low = (before - e[np.minimum(before, 3)]) / every if every else np.zeros(len(c))
        low = np.maximum(low, 0) + free / (v + 1)
        p = _interpolated(pairs[-1], d, *(x[own.left] for x in contexts), low[own.right])  # per bigram
        logs = np.log10(p)[own.pair]
        if order == 3:
            own.find_trigrams()
            (count,), _ = _reply(replies[replies["kind"] == 2], 1)
            logs[own.inner] = np.log10(_interpolated(count, t, *(x[own.opening] for x in pairs[:4]), p[own.ending]))[own.triple]
        starts = np.cumsum(own.sizes) - own.sizes
        base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        return pd.DataFrame({
            "doc_id": pd.array([None if x is None or x != x else int(x) for x in own.doc_ids], "Int64"), "held_out": own.held, "n_tokens": own.sizes,
            "n_known": np.add.reduceat((c[own.token] > 0).astype(np.int64), starts),
            "base_score": np.add.reduceat(base[own.token], starts), "score": np.add.reduceat(logs, starts)})
    return run


@contextmanager
def _freed_shuffles(spark):
    """What is written inside frees the files of its exchanges at its end, as the table has all that they had."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def score(docs: DataFrame, held_out, block_tokens: int = BLOCK_TOKENS, order: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity; the model, of bigrams or with
    ``order`` 3 of trigrams, learns from the rows for which the column ``held_out`` is false."""
    if order not in BIGRAM_COLUMNS:
        raise ValueError(f"order {order}: 2 or 3")
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"), F.col("text").cast("string").alias("text"))
    blocks = written(rows.mapInArrow(_blocks(block_tokens), _BLOCK), "lm-blocks")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(blocks.count() // 4, partitions - 1).bit_length()
    width = len(BIGRAM_COLUMNS[order])

    def send(frames):
        for frame in frames:
            for _, row in frame.iterrows():
                own = Block(row)
                if order == 2:
                    yield _messages(int(row["block"]), own.keys, [own.bigram_counts()], bits)
                else:  # about twice as many keys, so twice as many shards
                    own.find_trigrams()
                    yield _messages(int(row["block"]), own.trigram_keys, [own.trigram_counts()], bits + 1)

    def answered(messages, n_columns, statistics, what):
        with _freed_shuffles(spark):
            return written(messages.groupBy("shard").applyInPandas(_serve(n_columns, statistics), _REPLY), what)

    def with_replies(replies):
        return blocks.groupBy("block").cogroup(replies.filter("block >= 0").groupBy("block"))

    top = answered(blocks.mapInPandas(send, _MESSAGE), 1, _gram_statistics, "lm-grams")
    bigrams = top
    if order == 3:
        bigrams = answered(with_replies(top).applyInPandas(_bigram_messages(bits), _MESSAGE), width, _gram_statistics, "lm-bigrams")
    words = answered(with_replies(bigrams).applyInPandas(_word_messages(bits, width), _MESSAGE), len(WORD_COLUMNS), _word_statistics, "lm-words")
    totals = _totals(words, 8)
    every = bigrams.withColumn("kind", F.lit(0)).unionAll(words.withColumn("kind", F.lit(1)))
    if order == 3:
        every = every.unionAll(top.withColumn("kind", F.lit(2)))
    scores = with_replies(every).applyInPandas(
        _scores(order, discounts(*_totals(bigrams, 4)), discounts(*totals[:4]), discounts(*_totals(top, 4)), totals),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(totals[7]).cast("long").alias("train_tokens"),
                         "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
