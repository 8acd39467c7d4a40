"""Token ids in binary files: frequency ranks in byte-aligned variable-length coding with separate control bytes.

Documents are encoded with a public tokenizer, an end id is appended, and files hold them in ascending doc_id
order.  A file is little-endian: the magic ``IDS1``, four 64-bit counts (documents, ids, table entries, data
bytes), the documents' ids and null flags, their numbers of token ids, the rank table (token ids by falling
frequency in the file, equal counts by id), the control bytes (four 2-bit lengths each) and the data bytes (1 to 4 for
a rank).  Decoding looks the control byte up in a table of byte masks: numpy moves all data bytes to
their places at once.

Scale: texts are shuffled once, by range of (doc_id, hash of the text); a task sorts its range, streams it and closes a
file at ``FILE_IDS`` ids, so memory is bounded by a file.  File names carry the attempt, and only files of committed
tasks are in the manifest: a lost executor leaves an orphan, not a double.  Starts come from the
manifest's running sum over files, not over documents.  Reading is Spark's binaryFile source, one file a row.

The folder must be one that ``pyarrow.fs`` can write (file, hdfs, s3 or gs address).  doc_id is an integer; a null
id comes first, equal ids follow in the order of their text's hash.  A null or empty text is the end id alone.  An
empty table writes no file and reads back as no rows.  Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from sagebrush.llm.common import batch_of, scratch_path, written

MAGIC = b"IDS1"
FILE_IDS = 4 << 20
END_ID = 1
MEMO = 1_000_000         # words whose ids a worker remembers
JOINED = 500           # words given to the library as one text
_HEAD = struct.Struct("<4sQQQQ")
# control byte -> which of the sixteen bytes of four 32-bit ranks are present
_MASK = np.array([[b <= (c >> 2 * i & 3) for i in range(4) for b in range(4)] for c in range(256)], bool)
_MARKS = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
_TOKENIZERS: dict = {}


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    fill = -len(ranks) % 4
    four = np.concatenate((extra, np.zeros(fill, np.uint8))).reshape(-1, 4)
    control = (four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks of control and data bytes."""
    mask = _MASK[control].reshape(-1)[: 4 * n]
    out = np.zeros(4 * n, np.uint8)
    out[mask] = data
    return out.view("<u4")


def encode_file(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One file of documents."""
    counts = np.bincount(ids)
    values = np.flatnonzero(counts)
    ranked = values[np.lexsort((values, -counts[values]))]
    rank = np.zeros(len(counts), np.uint32)
    rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    control, data = pack(rank[ids])
    null = np.array([i is None for i in doc_ids], np.uint8)
    keys = np.array([i or 0 for i in doc_ids], "<i8")
    return b"".join((_HEAD.pack(MAGIC, len(doc_ids), len(ids), len(values), len(data)), keys.tobytes(), null.tobytes(),
                     np.asarray(sizes, "<u4").tobytes(), ranked.astype("<u4").tobytes(), control, data))


def decode_file(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc_ids, sizes, ids) of a file."""
    magic, n_docs, n_ids, n_table, n_data = _HEAD.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token id file")
    place = _HEAD.size

    def take(kind, n):
        nonlocal place
        out = np.frombuffer(content, kind, n, place)
        place += out.nbytes
        return out

    keys, null, sizes, ranked = take("<i8", n_docs), take(np.uint8, n_docs), take("<u4", n_docs), take("<u4", n_table)
    control = take(np.uint8, -(-n_ids // 4))
    ids = ranked[unpack(control, take(np.uint8, n_data), n_ids)] if n_ids else np.zeros(0, "<u4")
    return [None if x else k for k, x in zip(keys.tolist(), null.tolist(), strict=True)], sizes, ids


class Encoder:
    """Token ids of whole texts, as the library gives them.

    Where the tokenizer lower-cases and drops white space (``by_word``), none of its steps reaches over a blank, nor from
    a letter or digit to the punctuation behind it.  So each different word, lower-cased in ASCII and without
    that, is given to the library once and remembered; words of letters alone go there joined by blanks and are
    told apart by the tokens that end a word.  A text that may hold a special token goes whole.  The tests compare
    this with the library on whole texts."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        steps = re.sub(r"\s", "", str(self.library.pre_tokenizer)) + str(self.library.normalizer)
        self.by_word = "invert=True" in steps and "Removed" in steps and "Lowercase" in steps
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends[i] = bool(suffix) and token.endswith(suffix)
        self.memo: dict[bytes, bytes] = {}

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters: one token that ends a word for each."""
        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._each(words)
        raw, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def _learn(self, words: set[bytes]) -> None:
        bare, pairs = set(), []
        for word in words:
            base = word.rstrip(_MARKS)
            if base and len(base) < len(word) and (base[-1:].isalnum() or base[-1] >= 0x80 and base.decode()[-1].isalpha()):
                pairs.append((word, base, word[len(base):]))
                bare.update(pairs[-1][1:])
            else:
                bare.add(word)
        wanted = [w for w in bare if w not in self.memo]
        texts = [w.decode() for w in wanted]
        letters = [i for i, t in enumerate(texts) if t.isalpha()]
        others = [i for i, t in enumerate(texts) if not t.isalpha()]
        for i in range(0, len(letters), JOINED):
            own = letters[i:i + JOINED]
            self.memo.update(zip([wanted[k] for k in own], self._joined([texts[k] for k in own]), strict=True))
        self.memo.update(zip([wanted[k] for k in others], self._each([texts[k] for k in others]), strict=True))
        for word, base, tail in pairs:
            self.memo[word] = self.memo[base] + self.memo[tail]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.frombuffer(x, "<u4") for x in self._each(texts)]
        split = [None if "<|" in t else t.encode("utf-8", "replace").lower().replace(b"\n", b" ").split(b" ") for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        self._learn(set().union(*(w for w in split if w is not None)).difference(self.memo))
        find = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(find, words)) if words is not None else self._each([text])[0], "<u4")
                for words, text in zip(split, texts, strict=True)]


def _encoder(path: str) -> Encoder:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


_MANIFEST = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def _writer(path: str, folder: str, end_id: int):
    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        part, seq, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex
        store, base = fs.FileSystem.from_uri(folder)
        encoder = _encoder(path)
        keys: list = []
        found: list[np.ndarray] = []
        n_ids = 0

        def close():
            nonlocal keys, found, n_ids, seq
            name = f"{part:08d}-{seq:06d}-{attempt}.ids"
            content = encode_file(keys, np.array([len(x) for x in found]), np.concatenate(found))
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(content)
            row = batch_of(_MANIFEST, part=[part], seq=[seq], name=[name], n_docs=[len(keys)], n_ids=[n_ids])
            keys, found, n_ids, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
            for key, own in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                keys.append(key)
                found.append(np.append(own, np.uint32(end_id)))
                n_ids += len(own) + 1
                if n_ids >= FILE_IDS:
                    yield close()
        if keys:
            yield close()
    return run


def write_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = END_ID) -> tuple[str, DataFrame]:
    """Writes the files; returns their folder and the manifest (name, n_docs, n_ids, start) in file order."""
    from pyarrow import fs

    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-ids")
    if "://" not in folder:
        folder = "file://" + folder if not folder.startswith("file:") else folder
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    files = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        _writer(tokenizer, folder, end_id), "part long, seq long, name string, n_docs long, n_ids long")
    files = written(files, "token-manifest")
    # one row a file: the running sum is over files
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return folder, files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame, per_doc, schema: str) -> DataFrame:
    """Decodes the files of the manifest; ``per_doc(doc_id, start, ids)`` gives the row of a document, of which a
    column ``start`` counts from the first id of all files.  Files are decoded where they are read; their starts join the
    rows of documents, so neither contents nor the manifest are sent to all tasks."""
    out = StructType.fromDDL(schema)
    if manifest.isEmpty():
        return spark.createDataFrame([], out)
    whole = StructType([*out.fields, StructField("_file", StringType())])
    arrow = to_arrow_schema(whole)

    def run(batches):
        for batch in batches:
            for content, name in zip(batch.column("content"), batch.column("name").to_pylist(), strict=True):
                keys, sizes, ids = decode_file(content.as_buffer())
                ends = np.cumsum(sizes, dtype=np.int64)
                for i in range(0, len(keys), 10_000):
                    rows = [(*per_doc(k, int(e - s), ids[e - s:e]), name) for k, s, e in zip(
                        keys[i:i + 10_000], sizes[i:i + 10_000].astype(np.int64), ends[i:i + 10_000], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(
                        zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, whole)
    places = manifest.select(F.col("name").alias("_file"), F.col("start").alias("_start"))
    joined = rows.join(places, "_file")
    return joined.select(*[(F.col("start") + F.col("_start")).alias("start") if f.name == "start" else F.col(f.name) for f in out])


def digest(doc_id, start: int, ids: np.ndarray) -> tuple:
    return doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())


def op4_token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes all documents, reads the files back and returns doc_id, start, n_tokens, ids_crc32."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder, manifest = write_ids(docs, tokenizer)
    return read_ids(docs.sparkSession, folder, manifest, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
