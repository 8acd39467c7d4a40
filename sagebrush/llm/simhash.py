"""SimHash near-duplicates, found with a Gray-order hierarchical index.

Fingerprints: the 64-bit majority over the XXH64 hashes (seed 42) of the 3-word shingles of the ASCII-lower-cased
text, repeats included.  Links: fingerprints that differ in at most ``distance`` bits; equal ones always.

Search: equal fingerprints are one node first, whatever their number.  Two fingerprints within ``distance`` bits
agree in one of ``distance + 1`` bit segments, so every node goes to that many buckets (segment, value).  A bucket of more
than ``BUCKET`` nodes is dealt again by segments of its remaining bits, as often as bits allow, so a value that a
third of all nodes share is spread, exactly.  Within a bucket the nodes are sorted by Gray rank and covered by a tree:
an upper node keeps the masked bits that all nodes below it share, each lower node only its further ones.  A query adds
up the differences on its way down, and a whole group is pruned as soon as they exceed the distance; at a leaf
the sum is the Hamming distance.  Links leave a task as a spanning forest (at most one row a node), never as the pairs of
a group.  Components come from alternating large-star and small-star rounds on written tables.

Defined results: a null or empty text, or one of white space only, has fingerprint zero and is linked like any other;
fewer words than a shingle make one shingle of all; rows that repeat an id are rows of that document; rows with a
null doc_id have a fingerprint but link nothing and have no component; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebrush.llm.common import batch_of, written

SHINGLE = 3
DISTANCE = 3
BUCKET = 20_000
FAN = 8
FRONTIER = 2_000_000  # (query, node) pairs held at once
ROWS = 200_000        # nodes indexed at once, more only if a single bucket has more
_PART = 1 << 18       # shingles hashed at once


def _majority(words_text: bytes, starts: np.ndarray, ends: np.ndarray) -> int:
    import xxhash

    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), _PART):
        s, e = starts[i:i + _PART].tolist(), ends[i:i + _PART].tolist()
        h = np.array([digest(words_text[a:b], 42) for a, b in zip(s, e, strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and the six blanks only
    if not words:
        return 0
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(words) - shingle + 1)
    return _majority(line, starts[:n], ends[len(words) - n:])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row: doc_id (long), fp (the fingerprint as a signed long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield batch_of(schema, doc_id=batch.column("doc_id"), fp=fp.view(np.int64))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the order of the reflected Gray code."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """The trees of several buckets, one root per bucket, as arrays per level."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray):
        """``bucket`` ascending, ``codes`` in Gray order within it."""
        self.codes = codes
        first = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1))
        size = np.diff(first, append=len(bucket))
        self.sizes = np.repeat(size, size)
        # a level: children from..to, masked pattern (value, mask), last leaf below
        full = np.full(len(codes), ~np.uint64(0))
        levels = [{"value": codes, "mask": full, "and": codes, "or": codes, "last": np.arange(len(codes))}]
        while (size > 1).any():
            below, child_first = levels[-1], np.cumsum(size) - size
            groups = -(-size // FAN)
            within = np.arange(groups.sum()) - np.repeat(np.cumsum(groups) - groups, groups)
            start = np.repeat(child_first, groups) + within * FAN
            every, some = np.bitwise_and.reduceat(below["and"], start), np.bitwise_or.reduceat(below["or"], start)
            n = np.diff(start, append=len(below["value"]))
            mask = ~(every ^ some)
            below["rest"] = below["mask"] & ~np.repeat(mask, n)   # what the parent does not hold already
            levels.append({"value": every & mask, "mask": mask, "and": every, "or": some, "start": start, "n": n,
                           "last": below["last"][start + n - 1]})
            size = groups
        self.levels = levels
        self.root = np.repeat(np.arange(len(size)), np.diff(first, append=len(bucket)))

    def links(self, distance: int):
        """Pairs (i, j), i < j, of leaves in one bucket within the distance; in blocks of bounded work."""
        block = (np.cumsum(self.sizes) - 1) // FRONTIER
        for queries in np.split(np.arange(len(self.codes)), np.flatnonzero(np.diff(block)) + 1):
            node, apart = self.root[queries], np.zeros(len(queries), np.int64)
            for above, below in zip(self.levels[:0:-1], self.levels[-2::-1], strict=True):
                n = above["n"][node]
                children = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(above["start"][node], n)
                queries, apart = np.repeat(queries, n), np.repeat(apart, n)
                apart = apart + np.bitwise_count((self.codes[queries] ^ below["value"][children]) & below["rest"][children])
                ok = (apart <= distance) & (below["last"][children] > queries)
                queries, node, apart = queries[ok], children[ok], apart[ok]
            if len(self.levels) > 1 and len(queries):
                yield queries, node


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        up = parent[at]
        if (up == at).all():
            return at
        at = up


def join_sets(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the sets of a[i] and b[i]; a parent is never larger than its child."""
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        open_ = a != b
        a, b = a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def forest(bucket: np.ndarray, codes: np.ndarray, ids: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smaller id of its set) that span the links within the buckets."""
    size = np.unique(bucket, return_inverse=True, return_counts=True)
    several = size[2][size[1]] > 1
    bucket, codes, ids = bucket[several], codes[several], ids[several]
    if not len(bucket):
        return ids, ids
    order = np.lexsort((gray_rank(codes), bucket))
    bucket, codes, ids = bucket[order], codes[order], ids[order]
    parent = np.arange(len(codes))
    for a, b in GrayIndex(bucket, codes).links(distance):
        join_sets(parent, a, b)
    root = _roots(parent, np.arange(len(parent)))
    least = np.full(len(parent), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    other = least[root] != ids
    return ids[other], least[root][other]


def _linker(distance: int):
    def run(frames):
        held: list[pd.DataFrame] = []
        rows = 0

        def edges(frame):
            a, b = forest(frame["key"].to_numpy(), frame["fp"].to_numpy().view(np.uint64), frame["id"].to_numpy(), distance)
            return pd.DataFrame({"u": a, "v": b})

        for frame in frames:  # sorted by key
            held.append(frame)
            rows += len(frame)
            if rows >= ROWS:
                every = pd.concat(held, ignore_index=True)
                whole = int(np.searchsorted(every["key"].to_numpy(), every["key"].iloc[-1]))  # the last bucket may go on
                if whole:
                    yield edges(every[:whole])
                held, rows = [every[whole:]], len(every) - whole
        if rows:
            yield edges(pd.concat(held, ignore_index=True))
    return run


def _segments(bits: list[int], n: int) -> list[list[int]]:
    cut = [len(bits) * i // n for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _keyed(rows: DataFrame, level: int, distance: int) -> DataFrame:
    """Each row once per segment of the bits that its bucket leaves open: columns key, left (mask of open bits), fp, id."""
    n = distance + 1
    schema = "key long, left long, fp long, id long"

    def run(frames):
        for f in frames:
            key, fp = f["key"].to_numpy(), f["fp"].to_numpy().view(np.uint64)
            left, out = f["left"].to_numpy().view(np.uint64), []
            for mask in np.unique(left):
                at = left == mask
                bits = [i for i in range(64) if int(mask) >> i & 1]
                for number, segment in enumerate(_segments(bits, n)):
                    own = sum(1 << i for i in segment)
                    # the bucket: hash of the earlier bucket, the segment's number and the bits in it
                    mixed = (fp[at] & np.uint64(own)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number + 1)
                    mixed = (mixed ^ (mixed >> np.uint64(29)) ^ key[at].view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                    mixed ^= mixed >> np.uint64(32)
                    out.append(pd.DataFrame({"key": mixed.view(np.int64), "left": np.full(at.sum(), np.uint64(int(mask) & ~own)).view(np.int64),
                                             "fp": f["fp"].to_numpy()[at], "id": f["id"].to_numpy()[at]}))
            if out:
                yield pd.concat(out, ignore_index=True)
    return rows.mapInPandas(run, schema)


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (u, v), u > v, that connect the ids of ``nodes`` (fp distinct, id) as the links do."""
    rows = _keyed(nodes.select(F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("left"), "fp", "id"), 0, distance)
    found = None
    open_bits = 64
    while True:
        open_bits -= -(-open_bits // (distance + 1))
        rows = written(rows, "buckets")
        # a re-dealt bucket is left by all its rows at once, so nothing is searched twice or lost
        hot = None
        if open_bits > 4 * (distance + 1):
            hot = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET).select("key"), "hot")
            if hot.isEmpty():
                hot = None
        cold = rows if hot is None else rows.join(hot, "key", "left_anti")
        n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        edges = cold.select("key", "fp", "id").repartition(n, "key").sortWithinPartitions("key").mapInPandas(
            _linker(distance), "u long, v long")
        found = edges if found is None else found.unionAll(edges)
        if hot is None:
            return found
        rows = _keyed(rows.join(hot, "key", "left_semi").select("key", "left", "fp", "id"), 1, distance)


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every u that has a smaller node in its component, by large-star and small-star rounds."""
    edges = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select("u", F.col("v").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """Per row: doc_id, fp, component_id (smallest doc_id reachable over links, its own included)."""
    rows = written(fingerprints(docs, shingle), "simhash")
    nodes = written(rows.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    roots = components(links(nodes, distance))
    named = nodes.join(roots.withColumnRenamed("u", "id"), "id", "left").select(
        "fp", F.coalesce("root", "id").alias("component_id"))
    named = written(named, "components")
    out = rows.join(named, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op8_simhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The documents that are the smallest id of their component, with all columns; rows without an id stay."""
    found = near_duplicates(docs, shingle, distance).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(found, docs["doc_id"] == found["_gone"], "left_anti")
