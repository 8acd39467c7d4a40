"""Removal of repeated byte strings by suffix sorting of shards in external memory.

A byte is removed when it lies in a string of ``length`` bytes that also starts earlier in the corpus: in an earlier document (by
doc_id) or earlier in its own.  Texts are UTF-8; strings are judged on the input and do not cross documents.

1. Texts are packed into blocks.  Every window of ``length`` bytes has an anchor, the smallest hash of its 32-byte strings;
   runs of windows with one anchor are segments.  Equal windows have equal anchors.
2. Anchors that occur once in the corpus settle their windows: those are unique.  A block sends its different anchors as
   sorted Golomb-coded hashes to the shards that own the hash ranges and gets back two bitmaps: anchors that occur again,
   and anchors that occur more than ``HOT`` times.  (An anchor is the least of many hashes; it is mixed once more, so the ranges are even.)
3. Where a passage that very many documents share begins and ends, each of them has a segment of its own around one hot anchor.  Of hot
   anchors the hashes of the single windows are exchanged in the same way, dealt by themselves over all shards: windows that occur once
   drop out, and what is left of such segments is the passage's own text, alike in all documents.
4. The remaining segments go to the shard of their anchor, equal segments of a block as one with the earliest place: the others are
   repeated from end to end and stay, as packed spans, with their block.  So a shard gets each different segment once per block.
5. A shard's different segments, of anchors that have more than one, are written to a file of the task as one text with
   separators that UTF-8 never holds (texts of ``TEXT_BYTES``, cut between anchors), and its suffixes are sorted by external induced sorting with disk-backed queues (``induced.py``).  Neighbours whose common prefix
   reaches ``length`` are one string: all but the earliest start are repeated.
6. Repeated spans return to the blocks, packed by block, where the bytes are removed and what is left is digested.

Shards are as many as blocks.  Memory holds Arrow batches, a block or a sorter's buffers; the shard's text and queues
are files in the task's temporary folder that end with the shard.

Defined results: a null or empty text has no bytes and no spans; a text shorter than ``length`` stays whole; a null doc_id comes
before all others; rows that repeat an id come in the order in which they are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebrush.llm import golomb
from sagebrush.llm.common import batch_of, written
from sagebrush.llm.induced import sorted_suffixes

LENGTH = 100
GRAM = 32
BLOCK_BYTES = 6 << 20
HOT = 50_000         # occurrences of an anchor beyond which its windows are exchanged one by one
TEXT_BYTES = 3 << 20  # of segments sorted together, more only if a single anchor has more
GAP = b"\xff"        # a byte that UTF-8 never holds
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STRETCH = 1 << 17   # bytes hashed at once
_NULL = -(1 << 63)
_TABLE = np.random.default_rng(10).integers(1, 1 << 63, 256, np.uint64)

_BLOCK = "block long, ids array<long>, null array<boolean>, sizes array<long>, body binary"
_MESSAGE = "block long, shard long, n long, keys binary, counts binary"
_ANSWER = "block long, shard long, n long, shared binary, hot binary"
_SEGMENT = "shard long, anchor long, block long, doc int, id long, start long, windows int, body binary"
_SPAN = "block long, spans binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base))), dtype=np.uint64)


_POWERS, _INVERSES = _powers(_BASE, _STRETCH + 4096), _powers(_INVERSE, _STRETCH + 4096)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of ``size`` bytes, by a polynomial modulo 2^64."""
    n = len(data)
    powers, inverses = (_POWERS, _INVERSES) if n < len(_POWERS) else (_powers(_BASE, n), _powers(_INVERSE, n))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers[:n], dtype=np.uint64, out=prefix[1:])
    return _mix((prefix[size:] - prefix[:-size]) * inverses[:n - size + 1])


def _sliding(smaller, values: np.ndarray, width: int) -> np.ndarray:
    """np.minimum or np.maximum over all ranges of ``width`` values."""
    step, out = 1, values
    while step * 2 <= width:
        out = smaller(out[:-step], out[step:])
        step *= 2
    n = len(values) - width + 1
    return smaller(out[:n], out[width - step:width - step + n]) if step < width else out


def anchors(data: np.ndarray, inside: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of every window (0 where ``inside`` is false), and the hash of every place that is the anchor of one.
    Worked out stretch by stretch, with the margins that both need, so that arrays stay in the processor's cache."""
    gram = min(GRAM, length)
    width = length - gram + 1
    n_grams, n = len(data) - gram + 1, len(inside)
    found, places = np.empty(n, np.uint64), []
    for start in range(0, n_grams, _STRETCH):
        end = min(start + _STRETCH, n_grams)
        low, high = max(0, start - width + 1), min(n_grams, end + width - 1)
        grams = gram_hashes(data[low:high + gram - 1], gram)
        # least of the windows low..high - width + 1
        least = np.where(inside[low:high - width + 1], _sliding(np.minimum, grams, width), np.uint64(0))
        own = least[start - low:end - low]
        found[start:start + len(own)] = own
        around = np.zeros(len(least) + 2 * (width - 1), np.uint64)
        around[width - 1:width - 1 + len(least)] = least
        most = _sliding(np.maximum, around, width)      # over the windows that hold a place
        at = slice(start - low, end - low)
        places.append(grams[at][most[at] == grams[at]])
    return found, np.concatenate(places)


def _packed(schema: pa.Schema, size: int):
    def run(batches):
        import zstandard
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids, texts, n = [], [], 0

        def close():
            nonlocal ids, texts, n, block
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            row = batch_of(schema, block=[block], ids=[[i or 0 for i in ids]], null=[[i is None for i in ids]],
                           sizes=[[len(t) for t in texts]], body=[body])
            ids, texts, n, block = [], [], 0, block + 1
            return row

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(key)
                texts.append((text or "").encode("utf-8", "replace"))
                n += len(texts[-1])
                if n >= size:
                    yield close()
        if ids:
            yield close()
    return run


class Block:
    """The texts of a block, and the segments of its windows."""

    def __init__(self, row, length: int, segments: bool = True):
        import zstandard

        self.sizes = np.asarray(row["sizes"], np.int64)
        self.null = np.array([bool(x) for x in row["null"]])
        self.ids = np.where(self.null, _NULL, np.asarray(row["ids"], np.int64))
        self.body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=int(self.sizes.sum()) or 1)
        self.offset = np.cumsum(self.sizes) - self.sizes
        if not segments:
            return
        data = np.frombuffer(self.body, np.uint8)
        doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        n = max(0, len(data) - length + 1)
        inside = doc[:n] == doc[length - 1:]    # windows that end in another text are none
        every, places = anchors(data, inside, length) if n else (np.zeros(0, np.uint64),) * 2
        every, places = _mix(every), _mix(places)
        new = np.ones(n, bool)
        new[1:] = (every[1:] != every[:-1]) | (doc[1:n] != doc[:max(0, n - 1)])
        edges = np.append(np.flatnonzero(new | ~inside), n)     # a segment ends where anchor or text changes
        self.at = np.flatnonzero(new & inside)
        self.windows = edges[np.searchsorted(edges, self.at, side="right")] - self.at
        self.doc = doc[self.at]
        self.keys, self.counts = np.unique(places, return_counts=True)
        self.of = np.searchsorted(self.keys, every[self.at])


def _shards(keys: np.ndarray, n: int) -> np.ndarray:
    """Owner of a hash: n equal ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _messages(block, keys: np.ndarray, counts: np.ndarray, n_shards: int) -> pd.DataFrame:
    """Sorted hashes and their counts (in a block of bounded bytes or one text), cut by owner."""
    shard = _shards(keys, n_shards)
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
    rows = [(block, int(shard[a]), b - a, golomb.encode(keys[a:b]), counts[a:b].astype("<u4").tobytes())
            for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    return pd.DataFrame(rows, columns=["block", "shard", "n", "keys", "counts"])


def _send(n_shards: int, length: int):
    def run(frames):
        for frame in frames:
            for _, row in frame.iterrows():
                own = Block(row, length)
                yield _messages(row["block"], own.keys, own.counts, n_shards)
    return run


def _hot_windows(own: Block, hot: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows of hot anchors, by segment, and the hashes of their strings."""
    segments = np.flatnonzero(hot[own.of])
    sizes = own.windows[segments]
    place = np.repeat(own.at[segments] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
    data, hashes = np.frombuffer(own.body, np.uint8), np.empty(len(place), np.uint64)
    for start in range(0, len(place), _STRETCH):
        part = place[start:start + _STRETCH]
        low = int(part.min())
        hashes[start:start + _STRETCH] = gram_hashes(data[low:int(part.max()) + length], length)[part - low]
    return place, hashes


def _send_windows(n_shards: int, length: int):
    """Messages about the windows of a block's hot anchors."""
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks) or not len(answers):
            return pd.DataFrame(columns=["block", "shard", "n", "keys", "counts"])
        hot = _bits(answers.sort_values("shard"), "hot")
        if not hot.any():
            return pd.DataFrame(columns=["block", "shard", "n", "keys", "counts"])
        own = Block(blocks.iloc[0], length)
        keys, counts = np.unique(_hot_windows(own, hot, length)[1], return_counts=True)
        return _messages(int(blocks["block"].iloc[0]), keys, counts, n_shards)
    return run


def _answer(hot: int):
    """Per message two bitmaps: the hash occurs more than once in the corpus, and more than ``hot`` times."""
    def run(messages: pd.DataFrame) -> pd.DataFrame:
        lists = [golomb.decode(k) for k in messages["keys"]]
        counts = np.concatenate([np.frombuffer(c, "<u4") for c in messages["counts"]])
        _, at = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(at, counts)[at]
        ends = np.cumsum([len(x) for x in lists])[:-1]
        bits = {"shared": total > 1, "hot": total > hot}
        return pd.DataFrame({"block": messages["block"].to_numpy(), "shard": messages["shard"].to_numpy(), "n": messages["n"].to_numpy(),
                             **{c: [np.packbits(b).tobytes() for b in np.split(x, ends)] for c, x in bits.items()}})
    return run


def _bits(rows: pd.DataFrame, column: str) -> np.ndarray:
    return np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(rows[column], rows["n"], strict=True)]).astype(bool)


def _packed_spans(doc, start, stop) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.array([doc, start, stop], "<i8").tobytes())


def _unpacked_spans(bodies) -> np.ndarray:
    import zstandard

    parts = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b), "<i8").reshape(3, -1) for b in bodies]
    return np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)


def _segments(n_shards: int, length: int):
    """Segments whose anchor occurs again, of hot anchors only their windows that occur again, equal ones of the block as one; the spans
    of the others are one packed row without windows."""
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["shard", "anchor", "block", "doc", "id", "start", "windows", "body"]
        if not len(blocks) or not len(answers):
            return pd.DataFrame(columns=columns)
        own, block = Block(blocks.iloc[0], length), int(blocks["block"].iloc[0])
        answers = answers.sort_values("shard")
        of_anchors, of_windows = (answers[answers["windows"] == kind] for kind in (False, True))
        shared, hot = _bits(of_anchors, "shared"), _bits(of_anchors, "hot")
        shard, signed = _shards(own.keys, n_shards), own.keys.view(np.int64)
        at, windows, doc, anchor = own.at, own.windows, own.doc, own.of
        if hot.any():
            place, hashes = _hot_windows(own, hot, length)
            keys = np.unique(hashes)
            again = place[_bits(of_windows, "shared")[np.searchsorted(keys, hashes)]]
            segment = np.searchsorted(at, again, side="right") - 1
            new = np.ones(len(again), bool)
            new[1:] = (np.diff(again) > 1) | (np.diff(segment) > 0)
            begin = np.flatnonzero(new)
            cool = np.flatnonzero(~hot[anchor])
            at, windows, doc, anchor = (np.concatenate((x[cool], y)) for x, y in (
                (at, again[begin]), (windows, np.diff(np.append(begin, len(again)))), (doc, doc[segment[begin]]), (anchor, anchor[segment[begin]])))
        take = np.flatnonzero(shared[anchor])
        # by place in the corpus, so that the first of equal segments is the earliest
        take = take[np.lexsort((at[take], doc[take], own.ids[doc[take]]))]
        rows, spans, seen = [], [], set()
        for i in take.tolist():
            begin, n, text = int(at[i]), int(windows[i]), int(doc[i])
            body, start = own.body[begin:begin + n + length - 1], begin - int(own.offset[text])
            if body in seen:
                spans.append((text, start, start + n + length - 1))
                continue
            seen.add(body)
            rows.append((int(shard[anchor[i]]), int(signed[anchor[i]]), block, text, int(own.ids[text]), start, n, body))
        if spans:
            rows.append((block % n_shards, 0, block, 0, 0, 0, 0, _packed_spans(*zip(*spans, strict=True))))
        return pd.DataFrame(rows, columns=columns)
    return run


def repeated_windows(text: np.ndarray, folder: str, length: int, ids, blocks, docs, starts, first: np.ndarray) -> np.ndarray:
    """Positions in the shard's text whose window of ``length`` bytes starts earlier in the corpus too.  The arrays describe the
    segments (id, block, doc, start in the document); ``first`` is where each begins in the text."""
    found = []
    held: list[np.ndarray] = []     # the current run of equal strings

    def settle():
        at = np.concatenate(held)
        if len(at) > 1:
            own = np.searchsorted(first, at, side="right") - 1
            place = starts[own] + at - first[own]
            order = np.lexsort((place, docs[own], blocks[own], ids[own]))
            found.append(at[order[1:]])

    for rows in sorted_suffixes(text, folder, length):
        at, long = rows["at"], rows["common"] >= length
        cuts = np.flatnonzero(~long)
        if not len(cuts):
            held.append(at)
            continue
        if held:
            held.append(at[:cuts[0]])
            settle()
        # runs that begin and end in this block
        sizes = np.diff(cuts)
        runs = np.flatnonzero(sizes > 1)
        if len(runs):
            number = np.repeat(np.arange(len(runs)), sizes[runs])
            inside = np.repeat(cuts[runs], sizes[runs]) + np.arange(len(number)) - np.repeat(np.cumsum(sizes[runs]) - sizes[runs], sizes[runs])
            spot = at[inside]
            own = np.searchsorted(first, spot, side="right") - 1
            order = np.lexsort((starts[own] + spot - first[own], docs[own], blocks[own], ids[own], number))
            found.append(spot[order[np.diff(number[order], prepend=-1) == 0]])
        held = [at[cuts[-1]:]]
    if held:
        settle()
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _by_block(blocks, docs, start, stop) -> pd.DataFrame:
    """One row of packed spans per block."""
    order = np.argsort(blocks, kind="stable")
    blocks, docs, start, stop = blocks[order], docs[order], start[order], stop[order]
    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
    rows = [(int(blocks[a]), _packed_spans(docs[a:b], start[a:b], stop[a:b])) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
    return pd.DataFrame(rows, columns=["block", "spans"])


def _shard_spans(rows: list[tuple], text_path: str, folder: str, length: int) -> pd.DataFrame:
    """Spans of one shard; ``rows``: (id, block, doc, start, offset in the text) of its different segments."""
    ids, blocks, docs, starts, first = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    text = np.memmap(text_path, np.uint8, "r")
    at = repeated_windows(text, folder, length, ids, blocks, docs, starts, first)
    own = np.searchsorted(first, at, side="right") - 1
    # strings over a separator are none, and equal to such only
    fits = at + length < np.append(first[1:], len(text))[own]
    at, own = at[fits], own[fits]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (own[1:] != own[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    own, a, b = own[begin], at[begin], at[end] if len(at) else at
    start = starts[own] + a - first[own]
    return _by_block(blocks[own], docs[own], start, start + (b - a) + length)


class _ShardText:
    """The different segments of a shard as one text in a file.  Equal segments of an anchor are one, at the
    earliest place; an anchor with a single different segment has nothing that it could share with another one (equal
    strings have equal anchors), so its segment stays out of the text unless it repeats a string within itself."""

    def __init__(self, length: int):
        self.length = length
        self.folder = tempfile.TemporaryDirectory()
        self.out = open(f"{self.folder.name}/text", "wb")  # noqa: SIM115
        self.rows, self.place, self.anchor, self.seen, self.only = [], 0, None, set(), None

    def add(self, anchor: int, row: tuple, body: bytes) -> bool:
        """False if the anchor's segments before this one, which come by place, have an equal one."""
        if anchor != self.anchor:
            self._settle()
            self.anchor, self.seen = anchor, set()
        digest = hashlib.blake2b(body, digest_size=16).digest()
        if digest in self.seen:
            return False
        self.seen.add(digest)
        if len(self.seen) == 1:
            self.only = row, body
            return True
        if self.only:
            self._write(*self.only)
            self.only = None
        self._write(row, body)
        return True

    def _write(self, row: tuple, body: bytes) -> None:
        self.out.write(body + GAP)
        self.rows.append((*row, self.place))
        self.place += len(body) + 1

    def _settle(self) -> None:
        """The end of an anchor: a single segment goes into the text only if it repeats a string itself."""
        if self.only:
            body, n = self.only[1], len(self.only[1]) - self.length + 1
            if len({body[k:k + self.length] for k in range(n)}) < n:
                self._write(*self.only)
        self.only = None

    def spans(self) -> pd.DataFrame | None:
        self._settle()
        self.out.close()
        found = _shard_spans(self.rows, f"{self.folder.name}/text", self.folder.name, self.length) if self.rows else None
        self.folder.cleanup()
        return found


def _sort_shards(length: int):
    """Rows sorted by (shard, anchor, place) in: spans out."""
    def run(frames):
        current, text, spans = None, None, []

        def settled():
            nonlocal spans
            found = [x for x in (text.spans() if text is not None else None, _by_block(*map(np.array, zip(*spans, strict=True))) if spans else None) if x is not None]
            spans = []
            return found

        for frame in frames:
            for shard, anchor, block, doc, key, start, windows, body in frame.itertuples(index=False):
                if not windows:
                    yield pd.DataFrame({"block": [block], "spans": [body]})
                    continue
                # strings of different anchors differ, so a text may end behind any anchor
                if shard != current or anchor != text.anchor and text.place >= TEXT_BYTES:
                    yield from settled()
                    current, text = shard, _ShardText(length)
                if not text.add(anchor, (key, block, doc, start), body):
                    spans.append((block, doc, start, start + windows + length - 1))
        yield from settled()
    return run


def removed_spans(blocks: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Spans (block, doc, start, stop) of repeated bytes; they may overlap."""
    n = max(1, blocks.count())
    messages = blocks.mapInPandas(_send(n, length), _MESSAGE)
    answers = messages.groupBy("shard").applyInPandas(_answer(hot), _ANSWER)
    answers = written(answers.withColumn("windows", F.lit(False)), "anchor-answers")
    windows = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_send_windows(n, length), _MESSAGE)
    of_windows = windows.groupBy("shard").applyInPandas(_answer(hot), _ANSWER).withColumn("windows", F.lit(True))
    both = answers.unionByName(of_windows)
    segments = blocks.groupBy("block").cogroup(both.groupBy("block")).applyInPandas(_segments(n, length), _SEGMENT)
    partitions = max(n, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = segments.repartition(partitions, "shard").sortWithinPartitions("shard", "anchor", "id", "block", "doc", "start")
    return dealt.mapInPandas(_sort_shards(length), _SPAN)


def _clean(length: int):
    def run(blocks: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        own = Block(blocks.iloc[0], length, segments=False)
        n = len(own.sizes)
        edge = np.zeros(int(own.sizes.sum()) + 1, np.int32)
        doc, start, stop = _unpacked_spans(spans["spans"])
        np.add.at(edge, own.offset[doc] + start, 1)
        np.add.at(edge, own.offset[doc] + stop, -1)
        gone = np.cumsum(edge[:-1]) > 0
        data = np.frombuffer(own.body, np.uint8)
        rows = []
        for i in range(n):
            a, b = int(own.offset[i]), int(own.offset[i] + own.sizes[i])
            drop = gone[a:b]
            n_spans = int(np.count_nonzero(np.diff(drop.astype(np.int8), prepend=0) == 1))
            rows.append((None if own.null[i] else int(own.ids[i]), b - a, int(drop.sum()), n_spans, data[a:b][~drop].tobytes()))
        out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])
        return out.assign(doc_id=out["doc_id"].astype("Int64"))
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, hot: int = HOT) -> DataFrame:
    """Per row: doc_id (long), n_bytes, n_removed, n_spans, kept (the bytes that are left)."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
    schema = pa.schema(list(zip([f.split()[0] for f in _BLOCK.split(", ")], kinds, strict=True)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = written(rows.mapInArrow(_packed(schema, block_bytes), _BLOCK), "text-blocks")
    spans = written(removed_spans(blocks, length, hot), "repeated-spans")
    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInPandas(
        _clean(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_repeats(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
