"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

Entries become integers, x = floor(``SCALE`` * c) + ``SHIFT``, so that sums and deviations are exact; the vectors lie as blocks of a
matrix in a written table, and every product runs over its blocks.

1. One pass adds up the columns as decimals.  With S = q n + r (q a whole number, 0 <= r < n) a centred entry is (x - q) - r / n: small
   numbers are subtracted, nothing is lost to the large common offset.
2. A step of the bidiagonalisation is one pass.  Each task forms its part of w = X v_j - beta_(j-1) u_(j-1), and multiplies it
   with X' and with all earlier u's on the spot; the parts are added in a tree.  An earlier u_i is X c_i with a short vector c_i that the
   driver holds, so left vectors as long as the corpus are formed in the tasks and never stored or sent.  Their full
   reorthogonalisation takes the measured products U'w off w; where that cancels most of w, the pass is repeated.  The right vectors are
   orthogonalised twice against all earlier ones on the driver: they are as long as an embedding is wide.
3. The small upper bidiagonal matrix of alphas and betas is decomposed by numpy.  Its right singular vectors, carried back, are the
   components, its singular values divided by sqrt(n) the deviations along them.  A run ends when the wanted triplets have residuals at
   the level of rounding, or when the space is exhausted (a zero beta starts a new direction).  A run that ends before that is followed by
   another from a random start orthogonal to the components found, until it finds none that is larger: equal singular values, of which one
   start sees only one, are found that way.
4. One more pass adds up the covariance of the whitened vectors, whose largest departure from the identity is reported.

A pass reads the blocks and sends a few vectors of the embedding's width per task; the number of passes depends on the spectrum and is
the width at most (twice with equal values), never on the number of rows.

Defined results: a row whose vector is null or empty, or holds a null, an infinity or a NaN, is left out.  Vectors of one width are
whitened, that of most remaining rows (of equally many, the wider one); rows of other widths are left out.  Entries beyond 2^34 in
absolute value count as that bound, so that integers stay exact.  Repeated rows and ids are rows like others, a null id stays null.
Components whose deviation is below 1e-10 of the largest are noise and are not returned: a constant table or a single vector gives no
rows, as does an empty table.  A deviation beyond 64 bits is null.  Other columns of the input are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebrush.llm.common import batch_of, written

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
BLOCK_ENTRIES = 1 << 18     # entries of a block: 4,096 vectors of width 64
ENTRY_BOUND = float(1 << 34)
NOISE = 1e-10
CANCELLED = 1e-3            # a left vector that loses more of its length to reorthogonalisation is orthogonalised again
TREE_FROM = 16              # so many parts of a sum go to the driver as they are

_BLOCK = "width int, n int, ids array<long>, body binary"
_LONG, _DOUBLE = np.dtype("<i8"), np.dtype("<f8")


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    """x of finite entries."""
    return np.floor(np.clip(entries, -ENTRY_BOUND, ENTRY_BOUND) * SCALE).astype(np.int64) + SHIFT


def _blocks(schema: pa.Schema):
    def run(batches):
        held: dict[int, tuple[list, list]] = {}     # width -> ids, vectors

        def close(width):
            ids, rows = held.pop(width)
            body = np.concatenate(rows).astype(_LONG).tobytes()
            return batch_of(schema, width=[width], n=[len(body) // 8 // width], ids=[np.concatenate(ids).tolist()], body=[body])

        for batch in batches:
            ids, vectors = batch.column("vec_id"), batch.column("vector")
            flat = vectors.flatten()                # of the vectors that are not null
            sizes = np.diff(vectors.offsets.to_numpy())
            sizes[np.asarray(vectors.is_null())] = 0
            values = flat.to_numpy(zero_copy_only=False).astype(np.float64)     # a null entry becomes NaN
            begin = np.cumsum(sizes) - sizes
            wrong = np.zeros(len(values) + 1, np.int64)
            wrong[1:] = np.cumsum(~np.isfinite(values))
            good = (sizes > 0) & (wrong[begin + sizes] == wrong[begin])
            keys = np.array(ids.to_pylist(), dtype=object)
            for width in np.unique(sizes[good]).tolist():
                own = np.flatnonzero(good & (sizes == width))
                matrix = values[(begin[own][:, None] + np.arange(width)).ravel()]
                known = held.setdefault(width, ([], []))
                known[0].append(keys[own])
                known[1].append(whole_numbers(matrix))
                if sum(map(len, known[1])) >= BLOCK_ENTRIES:
                    yield close(width)
        for width in list(held):
            yield close(width)
    return run


def vector_blocks(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The remaining vectors as blocks of integer matrices, in a written table."""
    schema = pa.schema([("width", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("body", pa.binary())])
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    every = written(rows.mapInArrow(_blocks(schema), _BLOCK), "vector-blocks")
    width = every.groupBy("width").agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), F.desc("width")).first()
    return every.filter(F.col("width") == (width["width"] if width else 0))


def _matrix(body: bytes, width: int) -> np.ndarray:
    return np.frombuffer(body, _LONG).reshape(-1, width)


class Centring:
    """Exact sums of the columns, and centred blocks."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], object)
        self.part = np.array([(s % n) / n for s in sums], np.float64)

    @property
    def width(self) -> int:
        return len(self.sums)

    def centred(self, body: bytes) -> np.ndarray:
        return (_matrix(body, self.width) - self.whole) - self.part

    def deviations(self, body: bytes) -> list[int | None]:
        """Sum of (n x - S)^2 per row."""
        far = _matrix(body, self.width) - self.whole
        if self.width * (self.n * (int(np.abs(far).max(initial=0)) + 1)) ** 2 < 1 << 63:
            own = far * self.n - self.rest.astype(np.int64)
            return np.einsum("ij,ij->i", own, own).tolist()
        exact = ((far.astype(object) * self.n - self.rest) ** 2).sum(axis=1)
        return [x if x < 1 << 63 else None for x in exact.tolist()]


def centring(blocks: DataFrame) -> Centring | None:
    """Number of rows and sums of the columns, added as decimals; None where there are no rows."""
    def run(batches):
        for batch in batches:
            for width, body in zip(batch.column("width").to_pylist(), batch.column("body").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([_matrix(body, width).sum(axis=0).tolist()], pa.list_(pa.int64()))], names=["sums"])

    n = blocks.agg(F.sum("n")).first()[0]
    if not n:
        return None
    parts = blocks.select("width", "body").mapInArrow(run, "sums array<long>").select(F.posexplode("sums").alias("i", "s"))
    sums = parts.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return Centring(int(n), [int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])])


def _sum_rows(batches):
    total = None
    for batch in batches:
        for row in batch.column("v"):
            own = row.values.to_numpy()
            total = own if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])


def added(blocks: DataFrame, of_matrix, centre: Centring) -> np.ndarray:
    """The sum of ``of_matrix(centred block)``, a vector, over all blocks: within tasks, then in a tree."""
    def run(batches):
        total = None
        for batch in batches:
            for body in batch.column("body"):
                own = of_matrix(centre.centred(body.as_buffer()))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    parts = blocks.select("body").mapInArrow(run, "v array<double>")
    n = parts.rdd.getNumPartitions()
    if n > TREE_FROM:
        parts = parts.repartition(math.isqrt(n)).mapInArrow(_sum_rows, "v array<double>")
    return np.sum([np.asarray(r["v"]) for r in parts.collect()], axis=0)


class _Corpus:
    """The two products with the distributed matrix of centred rows."""

    def __init__(self, blocks: DataFrame, centre: Centring):
        self.blocks, self.centre, self.width = blocks, centre, centre.width
        self.left = np.zeros((self.width, 0))       # u_i = X left[:, i]

    def forward_and_back(self, a: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Of w = X a: its squared length, X'w, and U'w for all earlier u's."""
        left = self.left

        def products(x):
            w = x @ a
            return np.concatenate(([w @ w], x.T @ w, (x @ left).T @ w))

        got = added(self.blocks, products, self.centre)
        return float(got[0]), got[1:1 + self.width], got[1 + self.width:]


def _against(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):      # twice is enough
        v = v - basis @ (basis.T @ v)
    return v


def _start(rng, basis: np.ndarray, width: int) -> np.ndarray:
    v = _against(rng.standard_normal(width), basis)
    return v / np.linalg.norm(v)


def _run(corpus: _Corpus, locked: np.ndarray, wanted: int, rng):
    """One bidiagonalisation orthogonal to the locked right vectors: right vectors and singular values, by falling value,
    those that have converged, and whether the space is exhausted."""
    width, eps = corpus.width, np.finfo(float).eps
    right, images, alphas, betas = np.zeros((width, 0)), np.zeros((width, 0)), [], []
    corpus.left = np.zeros((width, 0))
    v, beta = _start(rng, locked, width), 0.0
    while True:
        # u_j = X c, with c = v_j - beta c_(j-1) - (what the earlier u's have of it)
        c = v - beta * corpus.left[:, -1] if beta else v
        squared, back, common = corpus.forward_and_back(c)
        before = squared
        c = c - corpus.left @ common
        squared = max(0.0, squared - float(common @ common))
        back = back - images @ common
        if squared < CANCELLED ** 2 * before:
            squared, back, common = corpus.forward_and_back(c)
            c, squared, back = c - corpus.left @ common, max(0.0, squared - float(common @ common)), back - images @ common
        alpha = math.sqrt(squared)
        largest = max([alpha, *alphas], default=0.0)
        if alpha <= eps * width * largest or alpha == 0.0:      # X v_j lies in the span of the earlier u's
            alpha, c, back = 0.0, np.zeros(width), np.zeros(width)
        else:
            c, back = c / alpha, back / alpha
        right, images = np.column_stack((right, v)), np.column_stack((images, back))
        corpus.left = np.column_stack((corpus.left, c))
        alphas.append(alpha)
        basis = np.column_stack((locked, right))
        rest = _against(back - alpha * v, basis)
        beta = float(np.linalg.norm(rest))
        small = np.diag(alphas) + np.diag(betas, 1) if betas else np.diag(alphas)
        q, values, p = np.linalg.svd(small)
        exhausted = basis.shape[1] >= width
        broken = beta <= eps * width * max(values[0], largest)
        residual = np.zeros(len(values)) if exhausted or broken else beta * np.abs(q[-1])
        done = residual <= 4 * eps * values[0]
        if exhausted or not broken and len(values) >= wanted and done[:wanted].all():
            keep = done if not exhausted else np.ones(len(values), bool)
            first = len(keep) if keep.all() else int(np.argmin(keep))
            return (right @ p.T)[:, :first], values[:first], exhausted
        if broken:
            v, beta = _start(rng, basis, width), 0.0
        else:
            v = rest / beta
        betas.append(beta)


def principal_directions(blocks: DataFrame, centre: Centring, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors of the centred rows (columns, largest entry positive) and singular values, largest first."""
    rng, wanted = np.random.default_rng(11), min(wanted, centre.width)
    corpus = _Corpus(blocks, centre)
    vectors, values = np.zeros((centre.width, 0)), np.zeros(0)
    while True:
        new, found, exhausted = _run(corpus, vectors, min(wanted, centre.width - vectors.shape[1]) if not len(values) else 1, rng)
        larger = len(values) < wanted or found[0] > values[wanted - 1]
        vectors, values = np.column_stack((vectors, new)), np.concatenate((values, found))
        order = np.argsort(-values, kind="stable")
        vectors, values = vectors[:, order], values[order]
        if exhausted or not larger:
            break
    vectors, values = vectors[:, :wanted], values[:wanted]
    keep = values > NOISE * values[0]
    vectors, values = vectors[:, keep], values[keep]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return vectors * sign, values


class Whitening:
    """A fitted whitening: ``components`` (columns), ``eigenvalues`` of the covariance, ``trace`` of it, ``identity_error``."""

    def __init__(self, centre: Centring, components: np.ndarray, eigenvalues: np.ndarray, trace: float):
        self.centre, self.components, self.eigenvalues, self.trace = centre, components, eigenvalues, trace
        self.explained = eigenvalues / trace if trace else eigenvalues
        self.identity_error = 0.0

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred @ self.components) / np.sqrt(self.eigenvalues)


def fit_whitening(blocks: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all rows of the blocks; None where there are none."""
    centre = centring(blocks)
    if centre is None:
        return None
    moments = added(blocks, lambda x: np.concatenate(([np.einsum("ij,ij->", x, x)], x.sum(axis=0))), centre)
    if not moments[0]:
        return Whitening(centre, np.zeros((centre.width, 0)), np.zeros(0), 0.0)
    vectors, values = principal_directions(blocks, centre, components)
    model = Whitening(centre, vectors, values ** 2 / centre.n, moments[0] / centre.n)
    mean = model.project(moments[None, 1:] / centre.n)

    def products(x):
        own = model.project(x) - mean
        return (own.T @ own).ravel()

    k = len(values)
    covariance = added(blocks, products, centre).reshape(k, k) / centre.n
    model.identity_error = float(np.abs(covariance - np.eye(k)).max())
    return model


def whiten(blocks: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, deviation, whitened, explained): a row per vector and component."""
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64())])

    def run(batches):
        k = model.components.shape[1]
        for batch in batches:
            for ids, body in zip(batch.column("ids").to_pylist(), batch.column("body").to_pylist(), strict=True):
                got, n = model.project(model.centre.centred(body)), len(ids)
                place = np.repeat(np.arange(n), k)
                yield batch_of(schema, vec_id=pa.array(ids, pa.int64()).take(pa.array(place)), component=np.tile(np.arange(1, k + 1, dtype=np.int32), n),
                               deviation=pa.array(model.centre.deviations(body), pa.int64()).take(pa.array(place)),
                               whitened=got.ravel(), explained=np.tile(model.explained, n))

    return blocks.select("ids", "body").mapInArrow(run, "vec_id long, component int, deviation long, whitened double, explained double")


def op11_whitening(df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    blocks = vector_blocks(df)
    model = fit_whitening(blocks, components)
    if model is None or not len(model.eigenvalues):
        rows, n, error = df.sparkSession.createDataFrame([], "vec_id long, component int, deviation long, whitened double, explained double"), 0, 0.0
    else:
        rows, n, error = whiten(blocks, model), model.centre.n, model.identity_error
    return rows.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained",
                       F.lit(error).alias("identity_error"))
