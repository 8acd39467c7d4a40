"""Approximate neighbours by an inverted file with residual product codes.

``build_index`` learns k-means centroids of unit vectors and, for what is left after the nearest centroid, a codebook per group of
dimensions, from a sample of at most ``SAMPLE_ROWS`` rows (the rows of least key hash; every row is indexed).  Each vector is stored as its
cell and one byte per group, packed into blocks of one cell and at most ``BLOCK_ROWS`` rows, so a cell that holds a third of all rows is many
rows of the table.

``search`` sends every query to the cells nearest to it (multi-probe).  Query blocks and code blocks meet by an equi-join on the cell;
codes are scored against a table of the queries' distances to the codebooks, a task keeps a running best ``rerank`` rows per query over
all its blocks, and the best ``rerank`` of a query are joined to their vectors and ranked exactly.  Only those vectors are read: the rest of the
table is seen as codes.  What a task gives out grows with the queries, not with the number of blocks that it has seen.

Where vectors have no clusters, as in the given tables, cells alone cannot prune (a fifth of the rows by cell then holds 56 % of the neighbours,
two fifths 82 %): three quarters of the cells are probed by default, and the codes do the pruning.  Clustered data need fewer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagebrush.functions.scoring import closeness_from_cos
from sagebrush.operators.vectors import _matrix, _unit_rows, packed
from sagebrush.session import bound_arrow_batches, spread

SAMPLE_ROWS = 20_000
CELLS = 64
PROBED_SHARE = 0.75
CODE_DIMS = 4            # dimensions that share a byte
CODEWORDS = 256
BLOCK_ROWS = 1 << 15
QUERY_ROWS = 512         # queries that meet a block together
SCORED = 1 << 20         # distances held at a time
RERANK = 10              # vectors read exactly per neighbour asked for


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre, in slices of bounded size."""
    half, out = (centres ** 2).sum(axis=1) / 2, np.empty(len(points), dtype=np.int64)
    for a in range(0, len(points), 8192):
        out[a:a + 8192] = np.argmin(half - points[a:a + 8192] @ centres.T, axis=1)
    return out


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids; an empty cell moves to the point that lies farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(points, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        used = n > 0
        centres[used] = sums[used] / n[used, None]
        if not used.all():
            far = np.argsort(-((points - centres[own]) ** 2).sum(axis=1), kind="stable")
            centres[~used] = points[far[:int((~used).sum())]]
    return centres


class VectorIndex:
    """Centroids, codebooks (one per group of dimensions) and the table of code blocks (cell, n, key, p, codes)."""

    def __init__(self, centroids: np.ndarray, codebooks: list[np.ndarray], blocks: DataFrame, key: str, part: str | None):
        self.centroids, self.codebooks, self.blocks, self.key, self.part = centroids, codebooks, blocks, key, part


def _groups(width: int) -> list[slice]:
    return [slice(a, min(a + CODE_DIMS, width)) for a in range(0, width, CODE_DIMS)]


def learn(sample: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Centroids and codebooks of a sample of unit vectors."""
    centroids = kmeans(sample, cells)
    rest = sample - centroids[_nearest(sample, centroids)]
    return centroids, [kmeans(np.ascontiguousarray(rest[:, g]), CODEWORDS, seed=i) for i, g in enumerate(_groups(sample.shape[1]))]


def encode(vectors: np.ndarray, centroids: np.ndarray, codebooks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Cell and codes of unit vectors."""
    cell = _nearest(vectors, centroids)
    rest = vectors - centroids[cell]
    codes = [_nearest(np.ascontiguousarray(rest[:, g]), book) for g, book in zip(_groups(vectors.shape[1]), codebooks, strict=True)]
    return cell, np.stack(codes, axis=1).astype(np.uint8)


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """mapInPandas body over blocks in the order of their cells: the small blocks of a cell become ones of ``BLOCK_ROWS`` rows or a little more."""
    held, n = [], 0

    def close():
        return pd.DataFrame({"cell": [held[0].cell], "n": [n], "keys": [np.concatenate([np.asarray(r.keys) for r in held])],
                             "parts": [np.concatenate([np.asarray(r.parts) for r in held])], "codes": [b"".join(r.codes for r in held)]})

    for pdf in batches:
        for row in pdf.itertuples(index=False):
            if held and (held[0].cell != row.cell or n >= BLOCK_ROWS):
                yield close()
                held, n = [], 0
            held.append(row)
            n += row.n
    if held:
        yield close()


def build_index(vectors: DataFrame, key: str = "doc_id", part: str | None = None, vec: str = "v", cells: int = CELLS,
                path: str | None = None) -> VectorIndex | None:
    """Index every row with a vector (the most frequent width of the sample; other widths cannot be compared and are an error when
    they are met).  With ``path`` the code blocks are written there, sorted by cell, and read from there; None if there are no vectors."""
    bound_arrow_batches(vectors.sparkSession)
    ids = ["keys", "parts"] if part else ["keys"]
    v = vectors.select(F.col(key).alias("keys"), F.col(vec).cast("array<double>").alias("v"),
                       *([F.col(part).cast("long").alias("parts")] if part else [])).filter(F.size("v") > 0)
    # a bounded sample, the same for the same rows
    sample = v.orderBy(F.xxhash64("keys"), *ids).limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    if not len(sample):
        return None
    width = sample.map(len).mode()[0]
    unit = _unit_rows(np.stack([np.asarray(x, dtype=np.float64) for x in sample if len(x) == width]))
    centroids, codebooks = learn(unit, cells)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def close(c):
            keys, parts, codes = zip(*held.pop(c), strict=True)
            keys, parts, codes = np.concatenate(keys), np.concatenate(parts), np.concatenate(codes)
            return pd.DataFrame({"cell": [c], "n": [len(keys)], "keys": [keys], "parts": [parts], "codes": [codes.tobytes()]})

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if row.width != width:
                    raise ValueError(f"vector width {row.width} != index width {width}")
                keys = np.asarray(row.keys)
                parts = np.asarray(row.parts) if part else np.zeros(len(keys), dtype=np.int64)
                cell, codes = encode(_unit_rows(_matrix(row.m, row.width)), centroids, codebooks)
                for c in np.unique(cell).tolist():
                    own = np.flatnonzero(cell == c)
                    held.setdefault(c, []).append((keys[own], parts[own], codes[own]))
                    if sum(len(x[0]) for x in held[c]) >= BLOCK_ROWS:
                        yield close(c)
        for c in list(held):
            yield close(c)

    kind = v.schema["keys"].dataType.simpleString()
    blocks = packed(spread(v), "vb", ids, "v").mapInPandas(run, f"cell int, n int, keys array<{kind}>, parts array<long>, codes binary")
    # every task above leaves a block a cell, however few its rows: they are put together, as a query meets every block of a cell
    groups = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(groups, "cell").sortWithinPartitions("cell").mapInPandas(_merged, blocks.schema)
    if path:
        blocks.sortWithinPartitions("cell").write.mode("overwrite").parquet(path)
        blocks = vectors.sparkSession.read.schema(blocks.schema).parquet(path)
    return VectorIndex(centroids, codebooks, blocks, key, part)


def _probes(centroids: np.ndarray, probed: int):
    """mapInPandas body: each query block is cut into the cells that its queries probe, ``QUERY_ROWS`` at a time.  ``qb`` names the slice."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                whole, whole_ids = _unit_rows(_matrix(row.m, row.width)), np.asarray(row.query_id)
                for a in range(0, len(whole), QUERY_ROWS):
                    q, ids = whole[a:a + QUERY_ROWS], whole_ids[a:a + QUERY_ROWS]
                    near = np.argsort(((centroids ** 2).sum(axis=1) - 2 * (q @ centroids.T)), axis=1, kind="stable")[:, :probed]
                    for c in np.unique(near).tolist():
                        own = np.flatnonzero((near == c).any(axis=1))
                        yield pd.DataFrame({"cell": [c], "qb": [block], "places": [own], "query_id": [ids[own]],
                                            "qm": [np.ascontiguousarray(q[own]).tobytes()]})
                    block += 1
    return run


class _Best:
    """The running best ``n`` rows (least distance, then key and part) of every query of a slice."""

    def __init__(self, n: int, key_kind):
        self.n, self.ids = n, {}
        self.far, self.place, self.parts = np.empty(0), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self.keys = np.empty(0, dtype=key_kind)
        self.bound = np.full(QUERY_ROWS, np.inf)     # the n-th best so far: what lies farther is not wanted

    def add(self, places, far, keys, parts) -> None:
        place, far = np.concatenate((self.place, places)), np.concatenate((self.far, far))
        keys, parts = np.concatenate((self.keys, keys)), np.concatenate((self.parts, parts))
        order = np.lexsort((parts, keys, far, place))
        place = place[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place, side="left")
        order, place, rank = order[rank < self.n], place[rank < self.n], rank[rank < self.n]
        self.place, self.far, self.keys, self.parts = place, far[order], keys[order], parts[order]
        self.bound[place[rank == self.n - 1]] = self.far[rank == self.n - 1]

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": np.asarray([self.ids[p] for p in self.place.tolist()]), "keys": self.keys, "parts": self.parts, "far": self.far})


def _scan(centroids: np.ndarray, codebooks: list[np.ndarray], n: int):
    """mapInPandas body over (query slice, code block) of a cell, in the order of slices: the rows of least distance by code, per query."""
    width = centroids.shape[1]
    groups = _groups(width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, at, books, table = None, None, None, None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                keys, parts, places = np.asarray(row.keys), np.asarray(row.parts), np.asarray(row.places)
                codes = np.frombuffer(row.codes, dtype=np.uint8).reshape(len(keys), len(groups))
                if row.qb != at:
                    if best is not None and len(best.far):
                        yield best.rows()
                    best, at, books = _Best(n, keys.dtype), row.qb, None
                if row.cell != books:
                    q, books = _matrix(row.qm, width) - centroids[row.cell], row.cell
                    # (codeword, query) distances of every group of dimensions
                    table = [((book[:, None, :] - q[None, :, g]) ** 2).sum(axis=2) for g, book in zip(groups, codebooks, strict=True)]
                best.ids.update(zip(places.tolist(), np.asarray(row.query_id).tolist(), strict=True))
                step = max(n, SCORED // max(1, len(places)))
                for a in range(0, len(keys), step):
                    far = np.zeros((min(step, len(keys) - a), len(places)))
                    for i, distances in enumerate(table):
                        far += distances[codes[a:a + step, i]]
                    bound = best.bound[places]
                    if len(far) > n:
                        bound = np.minimum(bound, np.partition(far, n - 1, axis=0)[n - 1])
                    rows, qs = np.nonzero(far <= bound)
                    best.add(places[qs], far[rows, qs], keys[a + rows], parts[a + rows])
        if best is not None and len(best.far):
            yield best.rows()
    return run


def candidates(index: VectorIndex, queries: DataFrame, k: int, qid: str = "query_id", qvec: str = "e",
               probed_share: float = PROBED_SHARE, rerank: int = RERANK) -> DataFrame:
    """(query_id, key, p) of the vectors that a search reads: the best by code of the probed cells."""
    probed, n = max(1, round(probed_share * len(index.centroids))), rerank * k
    qv = queries.select(F.col(qid).alias("query_id"), F.col(qvec).cast("array<double>").alias("e")).filter(F.size("e") > 0)
    kind, key_kind = qv.schema["query_id"].dataType.simpleString(), index.blocks.schema["keys"].dataType.elementType.simpleString()
    sent = packed(qv.hint("rebalance"), "qb", ["query_id"], "e").mapInPandas(
        _probes(index.centroids, probed), f"cell int, qb long, places array<long>, query_id array<{kind}>, qm binary")
    pairs = index.blocks.join(sent, "cell").sortWithinPartitions("qb", "cell")
    scanned = pairs.mapInPandas(_scan(index.centroids, index.codebooks, n), f"query_id {kind}, keys {key_kind}, parts long, far double")
    order = Window.partitionBy("query_id").orderBy("far", "keys", "parts")
    best = scanned.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n)
    return best.select("query_id", F.col("keys").alias(index.key), F.col("parts").alias("p"))


def search(index: VectorIndex, queries: DataFrame, vectors: DataFrame, k: int, vec: str = "v", qid: str = "query_id", qvec: str = "e",
           probed_share: float = PROBED_SHARE, rerank: int = RERANK) -> DataFrame:
    """(query_id, key, p, closeness, nn_rank): the candidates' vectors ranked exactly (closeness desc, key asc)."""
    found = candidates(index, queries, k, qid, qvec, probed_share, rerank)
    p = F.col(index.part).cast("long") if index.part else F.lit(0).cast("long")
    v = vectors.select(F.col(index.key), p.alias("p"), F.col(vec).cast("array<double>").alias("v"))
    q = queries.select(F.col(qid).alias("query_id"), F.col(qvec).cast("array<double>").alias("e"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    rows = found.join(v, [index.key, "p"]).join(q, "query_id")
    size = F.sqrt(dot("v", "v")) * F.sqrt(dot("e", "e"))
    cos = F.when(size > 0, dot("v", "e") / size).otherwise(F.lit(0.0))
    best = (rows.select("query_id", index.key, "p", closeness_from_cos(cos).alias("closeness"))
            .groupBy("query_id", index.key).agg(F.max(F.struct("closeness", (-F.col("p")).alias("np"))).alias("b")))
    order = Window.partitionBy("query_id").orderBy(F.col("b.closeness").desc(), F.col(index.key).asc())
    return (best.withColumn("nn_rank", F.row_number().over(order)).filter(F.col("nn_rank") <= k)
            .select("query_id", index.key, (-F.col("b.np")).alias("p"), F.col("b.closeness").alias("closeness"), "nn_rank"))


def nn_approx(queries: DataFrame, vectors: DataFrame, k: int, key: str = "doc_id", vec: str = "v", qid: str = "query_id",
              qvec: str = "e", path: str | None = None) -> DataFrame:
    """J4 in one call: build the index (at ``path`` where it is to be kept), search it."""
    index = build_index(vectors, key, None, vec, path=path)
    if index is None:
        kinds = queries.schema[qid].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"query_id {kinds[0]}, {key} {kinds[1]}, p long, closeness double, nn_rank int")
    return search(index, queries, vectors, k, vec, qid, qvec)
