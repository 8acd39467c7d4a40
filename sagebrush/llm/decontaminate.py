"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

Words are runs of ASCII letters, digits and all characters above ASCII, with A-Z lower-cased.  Every window
of ``window`` consecutive words of an item is a pattern `` w1 w2 ... wn `` (an item with fewer words, but not
none, is one pattern); a text is normalised to the same form and read once by the automaton.  The word spans
that it reports are mapped back to offsets in the original text.

Size: the windows travel to the workers in blocks of at most ``block_bytes`` of pattern text, one automaton
a block; a test set that fits one block (the usual case) is one automaton and one reading of the corpus,
a larger one adds a further reading per block.  Documents are never shuffled, so no key can be hot.

Defined results: a null or empty text has no words and is clean; null or empty items have no windows; an
item_id that occurs in several rows counts once; a null item_id counts as the id ``null``; repeated document
rows are judged one by one; empty tables give no rows or clean rows; a very long text is read whole; other columns pass
under any name, but for those named as in ``FOUND``.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from sagebrush.llm.common import unused

WINDOW = 10
BLOCK_BYTES = 8 << 20
FOUND = ("n_words", "word_spans", "item_ids")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_KEPT = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_AUTOMATA: dict = {}


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_KEPT).split()


def windows_of(words: list[bytes], window: int) -> set[bytes]:
    """The patterns of an item."""
    if not words:
        return set()
    return {b" " + b" ".join(words[i:i + window]) + b" " for i in range(max(1, len(words) - window + 1))}


def _blocks(benchmark: DataFrame, window: int, block_bytes: int):
    """The item windows, streamed partition by partition, in blocks of bounded size: [(pattern, [ids])]."""
    block: dict[bytes, set] = {}
    size = 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"),
                                F.col("text").alias("t")).toLocalIterator():
        for pattern in windows_of(words_of(row.t), window):
            if pattern not in block:
                size += len(pattern)
            block.setdefault(pattern, set()).add(row.i)
        if size >= block_bytes:
            yield block
            block, size = {}, 0
    yield block


def _automaton(patterns):
    """The automaton of a broadcast block; built once per worker process, only the newest is kept."""
    key = patterns.value["key"]
    if key not in _AUTOMATA:
        import ahocorasick

        _AUTOMATA.clear()
        machine = ahocorasick.Automaton()
        for pattern, ids in patterns.value["block"].items():
            machine.add_word(pattern.decode("latin-1"), (len(pattern), ids))
        machine.make_automaton()
        _AUTOMATA[key] = machine
    return _AUTOMATA[key]


def find_windows(machine, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Maximal runs [start, end) of hit words, and the items whose windows occur."""
    if not len(machine) or not words:
        return [], set()
    line = b" " + b" ".join(words) + b" "
    found = list(machine.iter(line.decode("latin-1")))
    if not found:
        return [], set()
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    items: set[str] = set()
    mark = np.zeros(len(words) + 1, np.int32)
    for last, (size, ids) in found:
        items |= ids
        mark[np.searchsorted(blanks, last - size + 1)] += 1
        mark[np.searchsorted(blanks, last)] -= 1
    hit = np.concatenate(([0], (np.cumsum(mark[:-1]) > 0).astype(np.int8), [0]))
    edge = np.flatnonzero(np.diff(hit))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), items


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _scanner(patterns, schema: pa.Schema, read: str):
    def scan(batches):
        for batch in batches:
            machine = _automaton(patterns)
            n_words, spans, items = [], [], []
            for text, before, ids in zip(*(batch.column(f).to_pylist() for f in (read, "word_spans", "item_ids")), strict=True):
                words = words_of(text)
                own, hit = find_windows(machine, words)
                n_words.append(len(words))
                earlier = [(x["start"], x["end"]) for x in before or ()]
                spans.append([{"start": s, "end": e} for s, e in (_united(own + earlier) if earlier else own)])
                items.append(sorted(hit | set(ids or ())))
            found = {"n_words": n_words, "word_spans": spans, "item_ids": items}
            yield pa.RecordBatch.from_arrays([pa.array(found[f.name], type=f.type) if f.name in FOUND else batch.column(f.name)
                                              for f in schema], schema=schema)
    return scan


def char_spans(text: str | None, word_spans) -> list[tuple[int, int]]:
    """Word spans as code-point offsets in the original text."""
    if not word_spans or not text:
        return []
    at = [m.span() for m in WORD.finditer(text)]
    return [(at[s][0], at[e - 1][1]) for s, e in word_spans]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
                       keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of the documents (default: all; those named as in ``FOUND`` are replaced) with n_words,
    word_spans (runs of hit words) and item_ids (sorted strings)."""
    spark = docs.sparkSession
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in FOUND]
    read = unused("_text", docs)
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.lit(0).cast("bigint").alias("n_words"),
                      F.array().cast("array<struct<start:int,end:int>>").alias("word_spans"),
                      F.array().cast("array<string>").alias("item_ids"), F.col("text").cast("string").alias(read))
    full, last = out.schema, StructType(out.schema.fields[:-1])
    blocks = _blocks(benchmark, window, block_bytes)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        following = following or None
        schema = last if following is None else full  # texts go on only where another block reads them
        patterns = spark.sparkContext.broadcast({"key": uuid.uuid4().hex, "block": block})
        out = out.mapInArrow(_scanner(patterns, to_arrow_schema(schema), read), schema)
        block = following
    return out


def with_char_spans(found: DataFrame) -> DataFrame:
    """Adds ``spans`` to a result that kept text: the hit runs as offsets in the original (code points, end exclusive)."""
    out = StructType([*[f for f in found.schema.fields if f.name != "spans"], StructField("spans", found.schema["word_spans"].dataType)])
    schema = to_arrow_schema(out)

    def add(batches):
        for batch in batches:
            spans = [[{"start": a, "end": b} for a, b in char_spans(t, [(x["start"], x["end"]) for x in s])] for t, s in zip(
                batch.column("text").to_pylist(), batch.column("word_spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in schema.names[:-1]],
                                              pa.array(spans, type=schema.field("spans").type)], schema=schema)
    return found.mapInArrow(add, out)


def n_hit():
    """Hit words of a document."""
    return F.aggregate("word_spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])


def op9_decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the contract."""
    found = find_contamination(docs, benchmark, keep=["doc_id"])
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("item_ids"), ","), 256).alias("items_sha256"),
                        (F.size("word_spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with all their columns."""
    found = find_contamination(docs, benchmark)
    return found.filter(F.size("word_spans") == 0).drop(*[c for c in FOUND if c not in docs.columns])
