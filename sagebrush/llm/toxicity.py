"""Toxicity by non-negative positive-unlabelled learning.

The classifiers see confirmed toxic examples (P) and text whose label nobody looks at (U).  With the class
prior pi the risk of a score g is

    pi * E_P[l(g)] + max(0, E_U[l(-g)] - pi * E_P[l(-g)]),   l(z) = log(1 + exp(-z)),

where the second part, an estimate of the risk on clean text, is kept from going below zero: when a batch makes
it negative, the step goes uphill on it instead.  Features are the hashed words of a text and the 5-byte pieces
of its words (with word ends), kept where their share in P differs from that in U by ``MIN_Z`` standard errors.
``MEMBERS`` linear numpy classifiers are trained on different draws of P and U; their mean score is calibrated by
the class prior, too: the posterior of a score s is pi * f_P(s) / f_U(s), estimated by isotonic regression.

Bounds: P and U are at most ``MAX_POSITIVE`` and ``MAX_UNLABELLED`` labelled rows, chosen by the hash of their
id, and each brings its distinct features; the prior is counted over all labelled rows.  Scoring is a map over all
whole texts; only the model is broadcast (2^18 floats a member).

Defined results: a null or empty text gets the score of no words; labels that are null confirm nothing; with no
confirmed example at all every score is the prior, and with no labels it is 0; repeated rows are scored one by one.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sagebrush.llm.common import batch_of
from sagebrush.llm.decontaminate import words_of

MAX_POSITIVE = 3_000
MAX_UNLABELLED = 9_000
MEMBERS = 3
FEATURES = 1 << 18
THRESHOLD = 0.7
EPOCHS = 30
BATCH = 512
RATE = 0.01
DECAY = 1e-4
MIN_Z = 4.0
MIN_ROWS = 5
PIECE = 5
DRAW = 0.8
MEMO_WORDS = 500_000


class Words(dict):
    """Word -> its features, worked out when a word is first met; starts anew at ``MEMO_WORDS`` words."""

    def __init__(self, kept: np.ndarray | None = None):
        super().__init__()
        self.kept = kept

    def __missing__(self, word: bytes) -> tuple:
        whole = b"<" + word + b">"
        ids = {zlib.crc32(word) % FEATURES, *(zlib.crc32(whole[i:i + PIECE], 1) % FEATURES
                                              for i in range(len(whole) - PIECE + 1))}
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = out = tuple(i for i in ids if self.kept is None or self.kept[i])
        return out

    def features(self, text: str | None) -> np.ndarray:
        """The distinct features of a whole text, ascending."""
        found: set[int] = set()
        for word in set(words_of(text)):
            if ids := self[word]:
                found.update(ids)
        return np.array(sorted(found), np.int32)


def _featuriser(schema: pa.Schema):
    def run(batches):
        words = Words()
        for batch in batches:
            yield batch_of(schema, toxic=batch.column("toxic"), draw=batch.column("draw"),
                           words=[words.features(t) for t in batch.column("text").to_pylist()])
    return run


def _sums(weights: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(weights[flat])))
    return total[starts[1:]] - total[starts[:-1]]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, seed: int) -> np.ndarray:
    """Weights of one classifier (the last entry is the bias), by Adam on the non-negative risk."""
    rng = np.random.default_rng(seed)
    w = np.zeros(FEATURES + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    positive, unlabelled = ([rows[i] for i in rng.permutation(len(rows))[:max(1, int(DRAW * len(rows)))]]
                            for rows in (positive, unlabelled))
    n_batches = max(1, -(-len(unlabelled) // BATCH))
    for _ in range(EPOCHS):
        p_order, u_order = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for p_part, u_part in zip(np.array_split(p_order, n_batches), np.array_split(u_order, n_batches), strict=True):
            if not len(p_part):
                p_part = rng.integers(0, len(positive), 1)
            rows = [positive[i] for i in p_part] + [unlabelled[i] for i in u_part]
            starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
            flat = np.concatenate(rows) if starts[-1] else np.zeros(0, np.int32)
            g = _sums(w, starts, flat) + w[-1]
            n_p, n_u = len(p_part), len(u_part)
            clean_p, clean_u = np.logaddexp(0, g[:n_p]), np.logaddexp(0, g[n_p:])  # l(-g)
            rest = (clean_u.mean() if n_u else 0) - prior * clean_p.mean()
            s = _sigmoid(g)
            slope = np.zeros(len(rows))
            sign = 1 if rest >= 0 else -1      # below zero: uphill on that part alone
            slope[n_p:] += sign * s[n_p:] / max(n_u, 1)
            slope[:n_p] -= sign * prior * s[:n_p] / n_p
            if rest >= 0:
                slope[:n_p] += prior * (s[:n_p] - 1) / n_p
            grad = np.bincount(flat, np.repeat(slope, np.diff(starts)), minlength=FEATURES + 1)
            grad[-1] = slope.sum()
            grad += DECAY * w
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w


def informative(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Which features are more, or less, frequent in P than in U beyond chance."""
    in_p, in_u = (np.bincount(np.concatenate(rows), minlength=FEATURES) for rows in (positive, unlabelled))
    n_p, n_u = len(positive), len(unlabelled)
    share = (in_p + in_u) / (n_p + n_u)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n_p + 1 / n_u))
    return (np.abs(in_p / n_p - in_u / n_u) >= MIN_Z * error) & (in_p + in_u >= MIN_ROWS)


def calibration(g_p: np.ndarray, g_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Points (score, posterior): pool adjacent violators on P (weight prior) against U (weight 1)."""
    g = np.concatenate((g_p, g_u))
    mass = np.concatenate((np.full(len(g_p), prior / len(g_p)), np.zeros(len(g_u))))
    rest = np.concatenate((np.zeros(len(g_p)), np.full(len(g_u), 1 / len(g_u))))
    values, at = np.unique(g, return_inverse=True)
    blocks: list[list[float]] = []      # mass of P, of U, weighted score
    for p, u, x in zip(np.bincount(at, mass), np.bincount(at, rest), values, strict=True):
        blocks.append([p, u, x * (p + u)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    post = np.array([min(1.0, p / u) if u else 1.0 for p, u, _ in blocks])
    return np.array([x / (p + u) for p, u, x in blocks]), post


class Model:
    """The classifiers, their features and the calibration; without a confirmed example it gives the prior."""

    def __init__(self, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float):
        self.prior, self.weights = prior, []
        if not positive or not unlabelled:
            return
        prior = min(max(prior, 1e-4), 1 - 1e-4)
        self.kept = informative(positive, unlabelled)
        rows = [r[self.kept[r]] for r in positive + unlabelled]
        n = len(positive)
        self.weights = [train(rows[:n], rows[n:], prior, seed).astype(np.float32) for seed in range(MEMBERS)]
        g = self.raw(rows)
        self.points = calibration(g[:n], g[n:], prior)

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        starts = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        flat = np.concatenate(rows) if starts[-1] else np.zeros(0, np.int32)
        return np.mean([_sums(w.astype(np.float64), starts, flat) + w[-1] for w in self.weights], axis=0)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        if not self.weights:
            return np.full(len(rows), self.prior)
        g = self.raw(rows)
        # a small share of the uncalibrated score keeps the order within a flat piece
        return 0.999 * np.interp(g, *self.points) + 0.001 * _sigmoid(g)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from ``docs`` (doc_id, text) and the ``labels`` (doc_id, toxic) that may be learned from."""
    # one row an id: repeated labels confirm when one of them does
    known = labels.dropna(subset=["doc_id"]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.sum((F.col("toxic") == 1).cast("long")).alias("p"), F.count("toxic").alias("n")).first()
    prior = (counts.p or 0) / counts.n if counts.n else 0.0
    # the sample is drawn among ids; its bound lets it travel to the texts, which are not shuffled
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))
    p = known.filter("toxic = 1").select("doc_id", F.lit(True).alias("toxic"), draw.alias("draw")).orderBy(
        "draw", "doc_id").limit(MAX_POSITIVE)
    u = known.select("doc_id", F.lit(False).alias("toxic"), F.xxhash64(draw).alias("draw")).orderBy(
        "draw", "doc_id").limit(MAX_UNLABELLED)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(p.unionAll(u)), "doc_id")
    rows = rows.groupBy("doc_id", "toxic", "draw").agg(F.min("text").alias("text"))
    schema = pa.schema([("toxic", pa.bool_()), ("draw", pa.int64()), ("words", pa.list_(pa.int32()))])
    found = rows.mapInArrow(_featuriser(schema), "toxic boolean, draw long, words array<int>").toArrow()
    found = found.sort_by([("toxic", "descending"), ("draw", "ascending")])
    words = [np.array(x.values, np.int32) for x in found.column("words")]
    n = sum(found.column("toxic").to_pylist())
    return Model(words[:n], words[n:], prior)


def _scorer(model, schema: pa.Schema):
    def run(batches):
        own = model.value
        words = Words(own.kept if own.weights else np.zeros(FEATURES, bool))
        for batch in batches:
            score = own.scores([words.features(t) for t in batch.column("text").to_pylist()])
            yield batch_of(schema, doc_id=batch.column("doc_id").to_pylist(), held_out=batch.column("held_out").to_pylist(),
                           score=score, predicted=(score >= THRESHOLD).astype(np.int32))
    return run


def score(docs: DataFrame, model: Model, held_out=None) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted (1 from ``THRESHOLD`` on)."""
    rows = docs.select("doc_id", (F.lit(False) if held_out is None else held_out).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_scorer(shared, to_arrow_schema(StructType.fromDDL(out))), out)
