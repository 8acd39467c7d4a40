"""Vector operators: exact and approximate nearest neighbours, embedders.

Exact top-k never materialises queries x documents as rows: blocks of queries and
blocks of vectors meet by a block key, a task multiplies two matrices at a time
and keeps a running top-k per query.  A global ``row_number() <= k`` window (Spark
plans a partial WindowGroupLimit before the shuffle) then picks the exact answer.
Ties: closeness desc, key asc.  The approximate search is in ``vector_index.py``.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagebrush.functions.text import tokens
from sagebrush.session import bound_arrow_batches, spread

def _closeness(cos: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.arccos(np.clip(cos, -1.0, 1.0)))


def _unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    norms[norms == 0] = 1.0
    return m / norms


# Bytes of a packed block of vectors or queries: a task holds a few of them, whatever the number of either.
BLOCK_BYTES = 4 * 1024 * 1024
# Candidates whose product is this near the k-th best are scored again, value by value, so that equal vectors score alike.
_MARGIN = 1e-9
# Entries of one product of vectors and queries (16 MB of doubles); a task holds about four arrays of that size.
_PRODUCT = 1 << 21


def _pack(name: str, id_cols: list[str], vec: str, block_bytes: int):
    """mapInPandas body: rows of (ids, vector) packed into matrices of bounded bytes, one row each."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def close():
            rows = pd.concat(held, ignore_index=True)
            m = np.stack([np.asarray(v, dtype=np.float64) for v in rows[vec].to_numpy()])
            return pd.DataFrame({name: [block], "width": [m.shape[1]], **{c: [rows[c].to_numpy()] for c in id_cols}, "m": [m.tobytes()]})

        for pdf in batches:
            pdf = pdf[pdf[vec].notna()]
            for _, own in pdf.groupby(pdf[vec].map(len)) if len(pdf) else []:
                width = len(own[vec].iloc[0])
                step = max(1, block_bytes // (8 * max(1, width)))
                if held and len(held[0][vec].iloc[0]) != width:
                    yield close()
                    block, held, size = block + 1, [], 0
                for i in range(0, len(own), step):
                    held.append(own.iloc[i:i + step])
                    size += len(held[-1]) * width * 8
                    if size >= block_bytes:
                        yield close()
                        block, held, size = block + 1, [], 0
        if held:
            yield close()
    return run


def packed(df: DataFrame, name: str, id_cols: list[str], vec: str, block_bytes: int | None = None) -> DataFrame:
    """Vectors as blocks: (name, width, an array per id column, m: the matrix as bytes of doubles).  NULL vectors drop out."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([T.StructField(name, T.LongType()), T.StructField("width", T.IntegerType()),
                           *[T.StructField(c, T.ArrayType(kinds[c])) for c in id_cols], T.StructField("m", T.BinaryType())])
    return df.select(*id_cols, vec).mapInPandas(_pack(name, id_cols, vec, block_bytes or BLOCK_BYTES), schema)


def _matrix(body: bytes, width: int) -> np.ndarray:
    return np.frombuffer(body, dtype=np.float64).reshape(-1, width)


def _best_pairs(queries: np.ndarray, vectors: np.ndarray, keys: np.ndarray, parts: np.ndarray, k: int | None):
    """(query index, row index, closeness) of the best chunk of each document, per query of the k best documents (closeness desc, key
    asc) or with k None of all.  ``vectors`` are in the order of (key, part).  Queries are taken a few at a time, so that two full
    blocks never make a product of more than ``_PRODUCT`` entries."""
    step = max(1, _PRODUCT // max(1, len(vectors)))
    found = [_best_of_slice(queries[a:a + step], vectors, keys, parts, k) for a in range(0, len(queries), step)]
    shifted = [(qs + i * step, rows, exact) for i, (qs, rows, exact) in enumerate(found)]
    return tuple(np.concatenate(column) for column in zip(*shifted, strict=True))


def _best_of_slice(queries: np.ndarray, vectors: np.ndarray, keys: np.ndarray, parts: np.ndarray, k: int | None):
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(first)
    cos = vectors @ queries.T                                      # rows x queries
    best = np.maximum.reduceat(cos, starts, axis=0)                # documents x queries
    if k is not None and len(starts) > k:
        kth = np.partition(best, len(starts) - k, axis=0)[len(starts) - k]
        near = best >= kth - _MARGIN
    else:
        near = np.ones(best.shape, dtype=bool)
    # every chunk of those documents that can be its best
    sizes = np.diff(np.append(starts, len(keys)))
    rows, qs = np.nonzero(np.repeat(near, sizes, axis=0) & (cos >= np.repeat(best, sizes, axis=0) - _MARGIN))
    exact = _closeness(np.einsum("ij,ij->i", vectors[rows], queries[qs]))
    order = np.lexsort((rows, -exact, np.searchsorted(starts, rows, side="right"), qs))     # best chunk of a document first
    rows, qs, exact = rows[order], qs[order], exact[order]
    doc = np.searchsorted(starts, rows, side="right")
    own = np.ones(len(rows), dtype=bool)
    own[1:] = (doc[1:] != doc[:-1]) | (qs[1:] != qs[:-1])
    rows, qs, exact = rows[own], qs[own], exact[own]
    if k is None:
        return qs, rows, exact
    order = np.lexsort((rows, -exact, qs))
    rows, qs, exact = rows[order], qs[order], exact[order]
    begin = np.searchsorted(qs, qs, side="left")
    top = np.arange(len(qs)) - begin < k
    return qs[top], rows[top], exact[top]


def _merge(a: pd.DataFrame | None, b: pd.DataFrame, key: str, k: int) -> pd.DataFrame:
    """The k best documents of both, per query."""
    if a is None:
        return b
    both = pd.concat((a, b), ignore_index=True).sort_values(["q", "closeness", key, "p"], ascending=[True, False, True, True], kind="stable")
    both = both.drop_duplicates(["q", key])
    return both[both.groupby("q").cumcount() < k]


def _meet(key: str, k: int | None, has_part: bool):
    """mapInPandas body over pairs of blocks.  With ``k`` a running top-k per query is kept for the query blocks of a cell."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, block, ids = None, None, None

        def out(found):
            return pd.DataFrame({"query_id": ids[found["q"].to_numpy()], key: found[key].to_numpy(), "p": found["p"].to_numpy(np.int64),
                                 "closeness": found["closeness"].to_numpy(np.float64)})

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if held is not None and row.qb != block:
                    yield out(held)
                    held = None
                if row.width != row.qwidth:
                    raise ValueError(f"vector width {row.width} != query width {row.qwidth}")
                block, ids = row.qb, np.asarray(row.query_id)
                keys = np.asarray(row.keys)
                parts = np.asarray(row.parts) if has_part else np.zeros(len(keys), dtype=np.int64)
                order = np.lexsort((parts, keys))
                keys, parts, m = keys[order], parts[order], _unit_rows(_matrix(row.m, row.width)[order])
                qs, rows, close = _best_pairs(_unit_rows(_matrix(row.qm, row.qwidth)), m, keys, parts, k)
                found = pd.DataFrame({"q": qs, key: keys[rows], "p": parts[rows], "closeness": close})
                if k is None:
                    yield out(found)
                else:
                    held = _merge(held, found, key, k)
        if held is not None:
            yield out(held)
    return run


def _closenesses(queries: DataFrame, vectors: DataFrame, k: int | None, key: str, part: str | None, vec: str, qid: str,
                 qvec: str) -> DataFrame:
    """(query_id, key, p, closeness): candidates of the k best documents, or with k None all documents.

    A grid: query blocks and vector blocks meet by an equi-join on the cell (vector group, query block), so that both sides are as large
    as they like and a task holds two blocks and a running top-k.  Vectors are scanned once; a small query side travels to them by Spark's
    own choice of a broadcast join, a large one is dealt over the groups."""
    spark = queries.sparkSession
    bound_arrow_batches(spark)
    qv = queries.select(F.col(qid).alias("query_id"), F.col(qvec).cast("array<double>").alias("e")).filter(F.col("e").isNotNull())
    schema = T.StructType([T.StructField("query_id", qv.schema["query_id"].dataType), T.StructField(key, vectors.schema[key].dataType),
                           T.StructField("p", T.LongType()), T.StructField("closeness", T.DoubleType())])
    ids = ["keys", "parts"] if part else ["keys"]
    v = vectors.select(F.col(key).alias("keys"), F.col(vec).cast("array<double>").alias("v"), *([F.col(part).cast("long").alias("parts")] if part else []))
    blocks = packed(spread(v), "vb", ids, "v")
    # queries are gathered into few partitions, which give full blocks
    qblocks = packed(qv.hint("rebalance"), "qb", ["query_id"], "e").select("qb", F.col("width").alias("qwidth"), "query_id", F.col("m").alias("qm"))
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = qblocks.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = blocks.withColumn("g", F.pmod(F.xxhash64("vb"), F.lit(groups)).cast("int")).join(cells, "g")
    cand = pairs.sortWithinPartitions("qb").mapInPandas(_meet(key, k, bool(part)), schema)
    # a document's chunks may sit in several blocks: best chunk overall, partially aggregated
    best = cand.groupBy("query_id", key).agg(F.max(F.struct("closeness", (-F.col("p")).alias("np"))).alias("b"))
    return best.select("query_id", key, (-F.col("b.np")).alias("p"), F.col("b.closeness").alias("closeness"))


def nn_exact(queries: DataFrame, vectors: DataFrame, k: int, key: str = "doc_id",
             part: str | None = None, vec: str = "v", qid: str = "query_id",
             qvec: str = "e") -> DataFrame:
    """J3 (+A5 when ``part`` is given): (query_id, key, p, closeness, nn_rank) for the
    k closest documents per query by angular closeness; a document's closeness
    is its closest chunk's."""
    cand = _closenesses(queries, vectors, k, key, part, vec, qid, qvec)
    w = Window.partitionBy("query_id").orderBy(F.col("closeness").desc(), F.col(key).asc())
    return cand.withColumn("nn_rank", F.row_number().over(w)).filter(F.col("nn_rank") <= k)


def closeness_all(queries: DataFrame, vectors: DataFrame, key: str = "doc_id", part: str | None = None,
                  vec: str = "v", qid: str = "query_id", qvec: str = "e") -> DataFrame:
    """A5 for every document: best closeness per (query, document), a partially aggregated maximum.  The queries are a
    stated set; nothing is ranked, so no task holds all documents of a query."""
    return _closenesses(queries, vectors, None, key, part, vec, qid, qvec)


def sum_over_vector_fields(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Text-vector + image-vector closeness per (query, doc), a missing side counts 0."""
    x = a.select("query_id", key, F.col("closeness").alias("c_text"))
    y = b.select("query_id", key, F.col("closeness").alias("c_image"))
    j = x.join(y, ["query_id", key], "full_outer")
    return j.select("query_id", key, (F.coalesce("c_text", F.lit(0.0)) + F.coalesce("c_image", F.lit(0.0)))
                    .alias("vector_score"))


def embedding_widths(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Distinct vector widths, sorted (one row per width)."""
    return df.select(F.size(col).alias("width")).filter(F.col("width") >= 0).distinct()


def check_dims(df: DataFrame, col: str, expected: int) -> tuple[DataFrame, DataFrame]:
    """Split rows with the expected width from the rest."""
    ok = F.size(col) == F.lit(expected)
    return df.filter(ok), df.filter(~ok | F.col(col).isNull())


def bfloat16_round(arr: np.ndarray) -> np.ndarray:
    """Round float32 values to bfloat16 precision (round to nearest even), kept as float32."""
    bits = np.ascontiguousarray(arr, dtype=np.float32).view(np.uint32)
    lsb = (bits >> 16) & 1
    rounded = ((bits + 0x7FFF + lsb) & 0xFFFF0000).astype(np.uint32)
    return rounded.view(np.float32)


def quantize_vectors(df: DataFrame, col: str = "embedding", out: str = "embedding_bf16") -> DataFrame:
    """bfloat16 copy of a vector column (Arrow batches, pandas UDF)."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _q(s: pd.Series) -> pd.Series:
        given = s.notna().to_numpy()
        vectors = [np.asarray(v, dtype=np.float32) for v in s[given]]
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        if vectors:     # one rounding pass over the whole batch
            flat = bfloat16_round(np.concatenate(vectors))
            out[given] = pd.Series(np.split(flat, np.cumsum([len(v) for v in vectors])[:-1]), index=s.index[given])
        return out

    return df.withColumn(out, _q(F.col(col)))


def to_bfloat16(df: DataFrame, col: str = "embedding", out: str = "embedding_b2") -> DataFrame:
    """The stored form, two bytes per entry (the upper half of the rounded float, little-endian)."""
    @F.pandas_udf(T.BinaryType())
    def _b(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else (bfloat16_round(np.asarray(v, dtype=np.float32)).view(np.uint32) >> 16).astype("<u2").tobytes())

    return df.withColumn(out, _b(F.col(col)))


def from_bfloat16(df: DataFrame, col: str = "embedding_b2", out: str = "embedding") -> DataFrame:
    """Floats of the stored form."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _f(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else (np.frombuffer(b, "<u2").astype(np.uint32) << 16).view(np.float32))

    return df.withColumn(out, _f(F.col(col)))


def rank_change(before: DataFrame, after: DataFrame, k: int, key: str = "doc_id", qid: str = "query_id", rank: str = "nn_rank") -> DataFrame:
    """Per query of two top-k lists: (query_id, kept, left, displaced, largest_shift, inversions).

    ``left`` neighbours are in the first list only; ``displaced`` ones have another rank or none in the second; a missing one counts as
    rank k + 1 for the largest shift; an inversion is a pair of kept neighbours in the other order.  A list has k rows at most, so its ranks
    are one array and inversions are counted in the row."""
    a = before.select(qid, key, F.col(rank).cast("int").alias("_a"))
    b = after.select(qid, key, F.col(rank).cast("int").alias("_b"))
    both = a.join(b, [qid, key], "full_outer").withColumn("_shift", F.abs(F.coalesce("_a", F.lit(k + 1)) - F.coalesce("_b", F.lit(k + 1))))
    lists = both.groupBy(qid).agg(
        F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("kept"),
        F.count(F.when(F.col("_b").isNull(), 1)).alias("left"),
        F.count(F.when(F.col("_a").isNotNull() & (F.col("_b").isNull() | (F.col("_a") != F.col("_b"))), 1)).alias("displaced"),
        F.max("_shift").alias("largest_shift"),
        F.array_sort(F.collect_list(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.struct("_a", "_b")))).alias("_pairs"))

    def later_and_before(pair, i):
        return F.size(F.filter(F.slice("_pairs", i + 2, F.lit(k)), lambda other: other["_b"] < pair["_b"]))

    inversions = F.aggregate(F.transform("_pairs", later_and_before), F.lit(0), lambda acc, x: acc + x)
    return lists.withColumn("inversions", inversions.cast("long")).drop("_pairs")


# --- embedders (X2) -------------------------------------------------------------------


# Tokens whose bucket a worker remembers (about 15 MB), and the bytes of a batch of texts that it holds.
MEMO_TOKENS = 100_000
EMBED_BATCH_BYTES = 8 * 1024 * 1024


class HashingEmbedder:
    """Deterministic test embedder: token counts hashed into ``dims`` buckets by
    the first 8 hex digits of md5(token), then L2-normalised.  The same vector
    is computable in plain SQL (see ``hashing_embed_sql``)."""

    def __init__(self, dims: int = 64, model: str = "hashing-test"):
        self.dims = dims
        self.model = model
        self._memo: dict[str, int] = {}
        self._sep: dict[str, bool] = {}

    def bucket(self, tok: str) -> int:
        b = self._memo.get(tok)
        if b is None:
            b = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:8], 16) % self.dims
            if len(self._memo) < MEMO_TOKENS:      # token frequencies are Zipf-like: memo hits dominate
                self._memo[tok] = b
        return b

    def tokens(self, text: str) -> list[str]:
        """Same tokens as the Spark/SQL definition (lower case, split on runs of characters that are
        not Unicode letters or numbers): separators become spaces via one C-level translate."""
        t = text.lower()
        table = {}
        for ch in set(t):
            sep = self._sep.get(ch)
            if sep is None:
                sep = unicodedata.category(ch)[0] not in "LN"
                self._sep[ch] = sep
            if sep:
                table[ord(ch)] = " "
        return t.translate(table).split(" ")

    def embed(self, texts: list[str | None]) -> np.ndarray:
        from collections import Counter

        out = np.zeros((len(texts), self.dims), dtype=np.float64)
        for i, t in enumerate(texts):
            if not t:
                continue
            row = out[i]
            counts = Counter(self.tokens(t))
            counts.pop("", None)
            for tok, n in counts.items():       # once per distinct token of the text
                row[self.bucket(tok)] += n
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        norms[norms == 0] = 1.0
        return out / norms


def embed_text(df: DataFrame, col: str, embedder=None, out: str = "embedding") -> DataFrame:
    """One vector per row via ``mapInPandas``; one Arrow batch = one embedder call.  Batches end at ``EMBED_BATCH_BYTES``."""
    embedder = embedder or HashingEmbedder()
    bound_arrow_batches(df.sparkSession, EMBED_BATCH_BYTES)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.DoubleType()))])
    if not df.isStreaming:
        df = spread(df)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vecs = embedder.embed(pdf[col].tolist())
            pdf[out] = list(vecs)
            yield pdf

    return df.mapInPandas(run, schema)


def embed_chunks(df: DataFrame, key: str, array_col: str, embedder=None) -> DataFrame:
    """P5: one vector per array element: (key, p, chunk, v)."""
    ex = df.select(key, F.posexplode(array_col).alias("p", "chunk"))
    return embed_text(ex, "chunk", embedder, out="v")


def hashing_embed_long(df: DataFrame, key: str, col: str, dims: int = 64) -> DataFrame:
    """The hashing embedder in pure DataFrame expressions: (key, dim, value) for non-zero dims."""
    ex = df.select(key, F.explode(tokens(col)).alias("tok"))
    bucket = (F.conv(F.substring(F.md5("tok"), 1, 8), 16, 10).cast("bigint") % F.lit(dims)).cast("int")
    counts = ex.groupBy(key, bucket.alias("dim")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    w = Window.partitionBy(key)
    return counts.select(key, "dim", (F.col("c") / F.sqrt(F.sum(F.col("c") * F.col("c")).over(w))).alias("value"))
