"""Suffix order with common prefixes by induced sorting in external memory.

Suffixes are sorted from seeds: the leftmost positions of ascending runs (S*).  In a first pass over unsorted seeds the
induction orders the substrings between seeds, equal ones get one name, and the shorter string of names is sorted in
turn; a second pass induces all suffixes from the sorted seeds, larger ones (L) in ascending, smaller ones (S) in
descending order.

The priority queue of a pass holds suffix tuples (position, common prefix with the tuple queued before it).  Keys
leave it in monotone order and equal first symbols in the order they came, so it is one append-only run per first
symbol, kept on disk beyond ``HELD`` tuples.  A tuple's common prefix follows from those of the suffixes that induce it: one more
than the smallest value between its inducer and the previous inducer of the same symbol, a range minimum over the block
and a running minimum per symbol across blocks.  Blocks of tuples are numpy arrays, so nothing loops over suffixes,
and a block, the queues' first ``HELD`` tuples, and the types, seeds, names and hashes of the text are arrays in memory.

Order and common prefixes are exact up to ``depth`` bytes, which is all that windows of that length need: names need no
further sorting beyond it, and prefixes are not compared beyond it.
"""

from __future__ import annotations

import os

import numpy as np

HELD = 1 << 21        # tuples in memory per queue
BLOCK = 1 << 15       # tuples worked on at once
_FAR = np.int32(1 << 30)


def tuple_type(size: int, depth: int) -> np.dtype:
    """Five bytes a tuple for texts under 4 GB and common prefixes under 250."""
    return np.dtype([("at", "<u4" if size < 1 << 32 else "<i8"), ("common", "u1" if depth < 250 else "<i4")])


class DiskQueue:
    """Monotone priority queue of tuples: a run on disk per first symbol, read in the order of writing."""

    def __init__(self, folder: str, name: str, kind: np.dtype):
        self.path, self.held, self.kind = f"{folder}/{name}", 0, kind
        self.new: list[list[np.ndarray]] = [[] for _ in range(256)]
        self.stored, self.size, self.taken = np.zeros(256, np.int64), np.zeros(256, np.int64), np.zeros(256, np.int64)

    def push(self, symbol: int, at: np.ndarray, common: np.ndarray) -> None:
        rows = np.empty(len(at), self.kind)
        rows["at"], rows["common"] = at, common
        self.new[symbol].append(rows)
        self.size[symbol] += len(rows)
        self.held += len(rows)
        if self.held > HELD:
            for s in range(256):
                self._store(s)

    def _store(self, symbol: int) -> None:
        if self.new[symbol]:
            with open(f"{self.path}-{symbol}", "ab") as out:
                for rows in self.new[symbol]:
                    out.write(rows.tobytes())
                    self.held -= len(rows)
            self.new[symbol] = []
            self.stored[symbol] = self.size[symbol]

    def read(self, symbol: int, start: int, end: int) -> np.ndarray:
        """Tuples start..end of a symbol's run."""
        if start >= self.stored[symbol]:    # the rest is in memory
            rows = np.concatenate(self.new[symbol]) if len(self.new[symbol]) > 1 else self.new[symbol][0]
            self.new[symbol] = [rows]
            return rows[start - self.stored[symbol]:end - self.stored[symbol]]
        end = min(end, int(self.stored[symbol]))
        with open(f"{self.path}-{symbol}", "rb") as run:
            run.seek(start * self.kind.itemsize)
            return np.frombuffer(run.read((end - start) * self.kind.itemsize), self.kind)

    def drop(self) -> None:
        """Removes the runs from the disk."""
        for s in np.flatnonzero(self.stored):
            os.remove(f"{self.path}-{s}")

    def pop(self, symbol: int):
        """Blocks of the symbol's tuples that were not taken yet, also of those that join while it is read."""
        while self.taken[symbol] < self.size[symbol]:
            start = int(self.taken[symbol])
            rows = self.read(symbol, start, min(start + BLOCK, int(self.size[symbol])))
            self.taken[symbol] += len(rows)
            yield rows

    def backwards(self, symbol: int):
        """All tuples of a symbol, last first, in blocks; their common prefix is then that with the tuple behind."""
        end, behind = int(self.size[symbol]), None
        while end:
            start = max(0, end - BLOCK)
            if start < self.stored[symbol] < end:
                start = int(self.stored[symbol])
            rows = self.read(symbol, start, end)[::-1].copy()
            common = rows["common"].copy()
            rows["common"][1:] = common[:-1]
            rows["common"][0] = 0 if behind is None else behind
            behind, end = common[-1], start
            yield rows


class RangeMinimum:
    """Minima of ranges of one block."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << len(self.levels) - 1 <= len(values):
            last, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minimum over low..high, both included."""
        level = np.frexp(high - low + 1)[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for k in np.unique(level):
            own = level == k
            row = self.levels[k]
            out[own] = np.minimum(row[low[own]], row[high[own] - (1 << k) + 1])
        return out


class Induction:
    """One pass: seeds in, all suffixes (or, from unsorted seeds, ordered seed substrings) out."""

    def __init__(self, text: np.ndarray, small: np.ndarray, folder: str, name: str, depth: int):
        self.text, self.small, self.depth = text, small, depth
        kind = tuple_type(len(text), depth)
        self.large_queue, self.small_queue = DiskQueue(folder, name + "L", kind), DiskQueue(folder, name + "S", kind)
        self.since = np.full(256, _FAR, np.int32)

    def _induce(self, queue: DiskQueue, rows: np.ndarray, want_small: bool) -> None:
        """Pushes the predecessors of the wanted type of a block in order."""
        common = np.ascontiguousarray(rows["common"])
        before = rows["at"].astype(np.int64) - 1
        ok = np.flatnonzero((before >= 0) & (self.small[before] == want_small))
        least = common.min() if len(common) else _FAR
        if not len(ok):
            np.minimum(self.since, least, out=self.since)
            return
        symbol = self.text[before[ok]]
        order = np.argsort(symbol, kind="stable")
        place, symbol = ok[order], symbol[order]
        start = np.flatnonzero(np.diff(symbol, prepend=symbol[0] ^ 1))
        low = np.empty(len(place), np.int64)
        low[1:] = place[:-1] + 1
        low[start] = 0
        minimum = RangeMinimum(common)
        basis = minimum(low, place)
        symbols = symbol[start]
        basis[start] = np.minimum(basis[start], self.since[symbols])
        value = np.minimum(basis, self.depth + 4) + 1
        ends = np.append(start[1:], len(place))
        np.minimum(self.since, least, out=self.since)
        for s, a, b in zip(symbols.tolist(), start.tolist(), ends.tolist(), strict=True):
            own = value[a:b].copy()
            if not queue.size[s]:
                own[0] = 0
            queue.push(s, before[place[a:b]], own)
        last = place[ends - 1]
        tail = np.full(len(last), _FAR, np.int32)
        more = last + 1 < len(common)
        tail[more] = minimum(last[more] + 1, np.full(more.sum(), len(common) - 1))
        self.since[symbols] = tail

    def _touch(self, a: int, b: int) -> int:
        """Common prefix of an L and an S suffix of one first symbol: the shorter run of it."""
        n, limit = 1, min(len(self.text) - max(a, b), self.depth + 4)
        while n < limit and self.text[a + n] == self.text[b + n]:
            n += 1
        return n

    def run(self, seeds: list[np.ndarray]):
        """Seeds: tuples per first symbol, in order.  Yields tuples of all suffixes in order."""
        n, queue = len(self.text), self.large_queue
        queue.push(int(self.text[n - 1]), np.array([n - 1]), np.array([0]))
        for s in range(256):
            last = None
            for rows in queue.pop(s):
                self._induce(queue, rows, False)
                last = int(rows["at"][-1])
            own = seeds[s]
            for i in range(0, len(own), BLOCK):
                rows = own[i:i + BLOCK].copy()
                if not i:
                    rows["common"][0] = 0 if last is None else self._touch(last, int(rows["at"][0]))
                self._induce(queue, rows, False)
        self.since[:] = _FAR
        touch = np.zeros(256, np.int32)
        for s in range(255, -1, -1):
            last = None
            for rows in self.small_queue.pop(s):
                self._induce(self.small_queue, rows, True)
                last = int(rows["at"][-1])
            for number, rows in enumerate(self.large_queue.backwards(s)):
                if not number and last is not None:
                    rows["common"][0] = touch[s] = self._touch(int(rows["at"][0]), last)
                self._induce(self.small_queue, rows, True)
        for s in range(256):
            start = 0
            while start < self.large_queue.size[s]:
                rows = self.large_queue.read(s, start, min(start + BLOCK, int(self.large_queue.size[s])))
                start += len(rows)
                yield rows
            ahead = touch[s]
            for rows in self._ascending(s):
                rows["common"][0], ahead = ahead, rows["common"][0]
                yield rows

    def _ascending(self, symbol: int):
        """S tuples of a symbol in ascending order, in blocks; a value is the common prefix with the tuple before, but the
        first place of a block holds what the first tuple of the next block needs."""
        end, queue = int(self.small_queue.size[symbol]), self.small_queue
        while end:
            start = max(0, end - BLOCK)
            if start < queue.stored[symbol] < end:
                start = int(queue.stored[symbol])
            rows = queue.read(symbol, start, end)[::-1].copy()
            rows["common"] = np.roll(rows["common"], 1)  # in the queue it is that with the next larger one
            end = start
            yield rows


def small_types(text: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than the one behind them; the last one is not."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    step[-1] = -1
    where = np.where(step != 0, np.arange(n), n)
    return step[np.minimum.accumulate(where[::-1])[::-1]] > 0


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of pairs of suffixes, cut at the first multiple of eight from ``depth`` on."""
    out = np.zeros(len(a), np.int32)
    inside = np.maximum(a, b) + depth + 8 <= len(text)
    for i in np.flatnonzero(~inside):       # the last few positions of the text
        n, limit = 0, min(len(text) - max(int(a[i]), int(b[i])), depth)
        while n < limit and text[a[i] + n] == text[b[i] + n]:
            n += 1
        out[i] = n
    open_ = np.flatnonzero(inside)
    words = np.ndarray((max(0, len(text) - 7),), "<u8", text, strides=(1,))
    for offset in range(0, depth, 8):
        diff = words[a[open_] + offset] ^ words[b[open_] + offset]
        same = diff == 0
        low = diff & (~diff + np.uint64(1))
        out[open_] = offset + np.where(same, 8, np.bitwise_count(low - np.uint64(1)) >> 3)
        open_ = open_[same]
    return out


def _by_symbol(text: np.ndarray, at: np.ndarray, common: np.ndarray, depth: int) -> list[np.ndarray]:
    rows = np.empty(len(at), tuple_type(len(text), depth))
    rows["at"], rows["common"] = at, common
    symbol = text[at]
    order = np.argsort(symbol, kind="stable")
    cuts = np.searchsorted(symbol[order], np.arange(257))
    return [rows[order[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]


def _hashes(text: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash modulo 2^64."""
    n = len(text)
    power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, np.uint64(0x9E3779B97F4A7C15)))), dtype=np.uint64)
    table = np.random.default_rng(1).integers(0, 1 << 63, 256, np.uint64)
    return np.concatenate(([np.uint64(0)], np.cumsum(table[text] * power, dtype=np.uint64))), power


def name_order(names: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes of the string of names, by their first ``depth`` // 2 names at least (a name stands for two
    bytes or more): ranks of twice the length follow from pairs of ranks."""
    rank, length = names, 1
    while rank.max(initial=-1) + 1 < len(rank) and length < depth // 2:
        behind = np.zeros(len(rank), np.int64)
        behind[:-length] = rank[length:] + 1
        rank = np.unique(rank.astype(np.int64) * (len(rank) + 1) + behind, return_inverse=True)[1]
        length *= 2
    return rank


def sorted_suffixes(text: np.ndarray, folder: str, depth: int):
    """Yields blocks of tuples (position, common prefix with the suffix before) of all suffixes of ``text`` (uint8, not empty)
    in order, exact up to ``depth`` bytes.  Queues live in ``folder``."""
    small = small_types(text)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(seeds):
        first = Induction(text, small, folder, "name", 0)
        is_seed = np.zeros(len(text), bool)
        is_seed[seeds] = True
        ordered = np.concatenate([rows["at"][is_seed[rows["at"]]] for rows in first.run(_by_symbol(text, seeds, np.zeros(len(seeds), np.int32), 0))])
        ends = np.append(seeds[1:] + 1, len(text))      # a seed substring ends with the next seed's symbol
        place = np.searchsorted(seeds, ordered)
        size = ends[place] - ordered
        prefix, power = _hashes(text)
        # hashes of two substrings are compared at a common power
        value = (prefix[ends[place]] - prefix[ordered]) * power[len(text) - 1 - ordered]
        new = np.ones(len(ordered), bool)
        new[1:] = (size[1:] != size[:-1]) | (value[1:] != value[:-1])
        new[place == len(seeds) - 1] = True
        after_last = np.flatnonzero(place[:-1] == len(seeds) - 1) + 1
        new[after_last] = True
        names = np.empty(len(seeds), np.int64)
        names[place] = np.cumsum(new) - 1
        del prefix, power, value
        first.large_queue.drop()
        first.small_queue.drop()
        order = seeds[np.argsort(name_order(names, depth), kind="stable")]
        common = np.zeros(len(order), np.int32)
        common[1:] = common_prefixes(text, order[:-1], order[1:], depth)
    else:
        order, common = seeds, np.zeros(0, np.int32)
    yield from Induction(text, small, folder, "sort", depth).run(_by_symbol(text, order, common, depth))
