"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Source s with n_s of all tokens gets the weight n_s^a / sum n^a.  The exponent a is bisected: the largest one in
[0, 1] whose weights have at least ``entropy`` of the largest possible entropy (log of the number of sources); if some
source would then be read more than ``max_epochs`` times, a grows until none is.  The budget is a number of tokens; by
default the smallest with which every source is read whole at least once, so no document is lost and small
sources repeat.

A source's share of the budget is so many whole epochs and a rest.  Every epoch permutes the source's documents: a
hash of (id, text, epoch) deals them to blocks of about ``BLOCK_TOKENS`` and orders them there.  Of the last epoch the
blocks are taken in turn while they fit the rest, and the next block up to the document that no longer fits.
Only block sums are accumulated over a source, so a source with a third of all rows is many tasks.  The result
of that is a threshold a source, and drawing is a map over the documents: texts are never shuffled.

A document costs its words plus one end token, so an empty or null text costs one.  A null source is a source of its
own.  Equal rows are drawn alike.  An empty table gives no rows.  Columns named epoch, block or n_tokens are replaced;
all others travel in one struct, so their names cannot clash with those used here.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagebrush.llm.common import columns_without, written

ENTROPY = 0.95
MAX_EPOCHS = 4.0
BLOCK_TOKENS = 4_000_000
STEPS = 60
MAX_BROADCAST = 100_000  # sources
SEED = 7


def weights_at(tokens: list[float], exponent: float) -> list[float]:
    """Temperature weights, computed from logarithms so that no power overflows."""
    logs = [exponent * math.log(n) for n in tokens]
    top = max(logs)
    raw = [math.exp(x - top) for x in logs]
    total = sum(raw)
    return [x / total for x in raw]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def _largest(ok, low: float = 0.0, high: float = 1.0) -> float:
    """The largest exponent for which the monotone test holds (it holds at ``low``)."""
    if ok(high):
        return high
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if ok(mid) else (low, mid)
    return low


def budget_at(tokens: list[float], weights: list[float], budget: float | None) -> float:
    return max(n / w for n, w in zip(tokens, weights, strict=True)) if budget is None else float(budget)


def epochs_at(tokens: list[float], exponent: float, budget: float | None) -> list[float]:
    weights = weights_at(tokens, exponent)
    whole = budget_at(tokens, weights, budget)
    return [whole * w / n for n, w in zip(tokens, weights, strict=True)]


def exponent_for(tokens: list[float], target: float = ENTROPY, max_epochs: float = MAX_EPOCHS,
                 budget: float | None = None) -> float:
    """The exponent that meets the entropy target, or, where that repeats a source too often, the limit."""
    goal = target * math.log(len(tokens))
    found = _largest(lambda a: entropy(weights_at(tokens, a)) >= goal - 1e-12)

    def fits(a):
        return max(epochs_at(tokens, a, budget)) <= max_epochs * (1 + 1e-9)

    if fits(found):
        return found
    if not fits(1.0):
        raise ValueError("the budget needs more epochs of the whole corpus than max_epochs")
    return 1.0 - _largest(lambda d: fits(1.0 - d), 0.0, 1.0 - found)


def plan(counts: list[tuple], target: float = ENTROPY, max_epochs: float = MAX_EPOCHS,
         budget: float | None = None) -> list[tuple]:
    """(source, whole epochs, tokens of the last epoch, blocks, weight) of (source, tokens) rows."""
    if not counts:
        return []
    tokens = [float(n) for _, n in counts]
    a = exponent_for(tokens, target, max_epochs, budget)
    weights, epochs = weights_at(tokens, a), epochs_at(tokens, a, budget)
    out = []
    for (source, n), w, e in zip(counts, weights, epochs, strict=True):
        whole = math.floor(e + 1e-9)
        out.append((source, whole, max(0, round((e - whole) * n)), max(1, -(-n // BLOCK_TOKENS)), w))
    return out


def _draw():
    """Place of a row in its epoch's permutation, and the block that it is dealt to."""
    return F.xxhash64("_key", "epoch", F.lit(SEED))


def _spread(rows: DataFrame, sources: list[tuple], schema: str) -> DataFrame:
    """Joins the table of sources; up to ``MAX_BROADCAST`` of them travel to the rows, more meet them in a shuffle."""
    side = rows.sparkSession.createDataFrame(sources, schema)
    side = F.broadcast(side) if len(sources) <= MAX_BROADCAST else side
    return rows.join(side, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")


def _thresholds(sized: DataFrame, planned: list[tuple], kind: str) -> list[tuple]:
    """Per source (source, whole, rest, blocks, cut block, last draw taken in it)."""
    schema = f"_s {kind}, _whole int, _rest long, _blocks long"
    last = _spread(sized, [p[:4] for p in planned], schema).filter("_rest > 0").withColumn("epoch", F.col("_whole"))
    last = last.withColumn("_draw", _draw()).withColumn("block", F.pmod("_draw", "_blocks"))
    sums = last.groupBy("_source", "_rest", "block").agg(F.sum("n_tokens").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_source").orderBy("block"))
    over = sums.withColumn("_room", F.col("_rest") - upto + F.col("_n")).filter("_n > _room").groupBy("_source").agg(
        F.min(F.struct("block", "_room")).alias("first")).select("_source", "first.*")
    cut = {r[0]: (r[1], r[2]) for r in over.collect()}
    # one block a source, of about BLOCK_TOKENS, is put in order
    room = [(s, *cut[s]) for s, *_ in planned if s in cut]
    taken = {}
    if room:
        inside = _spread(last, room, f"_s {kind}, _block long, _room long").filter("block = _block")
        total = F.sum("n_tokens").over(Window.partitionBy("_source").orderBy("_draw"))
        fits = inside.withColumn("_sum", total).filter("_sum <= _room").groupBy("_source").agg(F.max("_draw"))
        taken = {r[0]: r[1] for r in fits.collect()}
    return [(s, whole, rest, blocks, cut.get(s, (blocks,))[0] if rest else 0, taken.get(s)) for s, whole, rest, blocks, _ in planned]


def mix(docs: DataFrame, target: float = ENTROPY, max_epochs: float = MAX_EPOCHS, budget: float | None = None) -> DataFrame:
    """The drawn rows: all columns of ``docs``, n_tokens, epoch and block; a row stands once for every epoch it is in."""
    kind = docs.schema["source"].dataType.simpleString()
    columns = [F.col(f"`{c}`") for c in columns_without(docs, "n_tokens", "epoch", "block")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*columns).alias("_row"), (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long").alias("n_tokens"),
                       F.xxhash64(F.col("doc_id").cast("string"), text).alias("_key"), F.col("source").alias("_source"))
    sized = written(rows.select("_source", "n_tokens", "_key"), "sizes")
    counts = [(r[0], r[1]) for r in sized.groupBy("_source").agg(F.sum("n_tokens")).collect()]
    counts.sort(key=lambda x: (x[0] is not None, x[0]))
    found = _thresholds(sized, plan(counts, target, max_epochs, budget), kind)
    # from here on a map: every row meets the thresholds of its source
    joined = _spread(rows, found, f"_s {kind}, _whole int, _rest long, _blocks long, _cut long, _last long")
    last = F.col("_whole") - F.when(F.col("_rest") > 0, 0).otherwise(1)
    drawn = joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), last))).withColumn("_draw", _draw()).withColumn(
        "block", F.pmod("_draw", "_blocks"))
    kept = (F.col("epoch") < F.col("_whole")) | (F.col("block") < F.col("_cut")) | (
        (F.col("block") == F.col("_cut")) & (F.col("_draw") <= F.col("_last")))
    return drawn.filter(kept).select("_row.*", "n_tokens", "epoch", "block")
