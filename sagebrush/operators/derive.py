"""Derived columns, summaries and highlighting.

Everything here is a projection (no shuffle) except A18, which is a
partially aggregated group-by on the content hash: a hash shared by a third
of all rows is combined map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagebrush import config as C
from sagebrush.functions.text import query_terms


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def concat_default(cols: list, sep: str = " ") -> Column:
    """Join texts, a missing one becomes "" and separators are kept (unlike concat_ws)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(_c(c).cast("string"), F.lit("")))
    return F.concat(*parts)


def concat_with_array(cols: list, array_col, sep: str = " ") -> Column:
    """P1 with an array flattened by for_each (missing array = empty)."""
    arr = F.array_join(F.coalesce(_c(array_col), F.array().cast("array<string>")), sep)
    return F.concat(concat_default(cols, sep), F.lit(sep), arr)


def copy_field(df: DataFrame, src: str, dst: str) -> DataFrame:
    """Derived copy (matched as trigrams by the search side)."""
    return df.withColumn(dst, F.col(src))


def highlight_terms(text, terms: Column, open_tag: str = "<b>", close_tag: str = "</b>") -> Column:
    """Wrap whole-token, case-insensitive matches of ``terms`` (array<string> of
    lower-case tokens) in tags.  The text is cut into alternating runs of
    letter/digit and other characters, matching runs are wrapped, runs rejoined."""
    runs = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), 1)
    tagged = F.transform(runs, lambda r: F.when(F.array_contains(terms, F.lower(r)),
                                                F.concat(F.lit(open_tag), r, F.lit(close_tag))).otherwise(r))
    return F.array_join(tagged, "")


def highlight(df: DataFrame, col: str, queries: DataFrame, qtext: str = "qtext",
              open_tag: str = "<b>", close_tag: str = "</b>") -> DataFrame:
    """P9 per query: ``df`` carries query_id (e.g. hits); the query's terms come by join."""
    q = queries.select("query_id", query_terms(qtext).alias("terms"))
    from sagebrush.session import broadcast_if_small

    j = df.join(broadcast_if_small(q), "query_id")
    return j.withColumn(f"{col}_highlighted", highlight_terms(F.col(col), F.col("terms"), open_tag, close_tag)).drop("terms")


def highlight_array(arr, terms: Column, open_tag: str = "<b>", close_tag: str = "</b>") -> Column:
    """P9 for array fields: each element highlighted."""
    return F.transform(_c(arr), lambda e: highlight_terms(e, terms, open_tag, close_tag))


def epoch_ms_to_ts(col) -> Column:
    """Epoch ms -> timestamp."""
    return F.timestamp_millis(_c(col))


def chunk_provenance(df: DataFrame, key: str, chunks: str, meta: str) -> DataFrame:
    """One row per chunk with its position and the metadata row of the same chunk_index (one row for each, if there
    are several; nulls, if there is none).  Both arrays stand in one row, so they are zipped there and nothing is
    shuffled; metadata in the order of the chunks is taken by place, other metadata is searched per chunk."""
    m, c = F.col(meta), F.col(chunks)
    aligned = (F.size(m) == F.size(c)) & F.forall(F.transform(m, lambda x, i: x["chunk_index"].eqNullSafe(i)), lambda same: same)
    pairs = F.transform(c, lambda x, i: F.struct(
        i.alias("chunk_index"), x.alias("chunk"),
        F.when(aligned, F.array(F.get(m, i))).otherwise(F.filter(m, lambda y: y["chunk_index"] == i)).alias("m")))
    rows = df.select(key, F.explode(pairs).alias("r")).select(key, "r.chunk_index", "r.chunk", F.explode_outer("r.m").alias("m"))
    others = [f.name for f in df.schema[meta].dataType.elementType.fields if f.name != "chunk_index"]
    return rows.select(key, "chunk_index", "chunk", *[F.col("m").getField(f).alias(f) for f in others])


def user_doc_id(user_map: str, email) -> Column:
    """The caller's own id of a shared document (NULL if absent)."""
    return F.try_element_at(F.col(user_map), _c(email) if not isinstance(email, str) else F.lit(email))


def map_entries_long(df: DataFrame, key: str, map_col: str) -> DataFrame:
    """Map keys and values as rows."""
    return df.select(key, F.explode(map_col).alias("map_key", "map_value"))


def flatten_messages(df: DataFrame, threads: str, texts_field: str) -> Column:
    """All texts of an array<struct<..., texts: array<string>>> as one array."""
    return F.flatten(F.transform(F.col(threads), lambda t: t[texts_field]))


def content_hash(col) -> Column:
    """SHA-256 hex of the content."""
    return F.sha2(_c(col), 256)


def redact_url(col) -> Column:
    """Strip user and password from a URL."""
    return F.regexp_replace(_c(col), r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@]*@", "$1")


def error_excerpt(col) -> Column:
    """A body that is not JSON becomes {message: first 2000 chars, type}; JSON bodies give NULL."""
    body = _c(col)
    is_json = F.try_parse_json(body).isNotNull()  # the whole body: JSON with something behind it is none
    return F.when(~is_json & body.isNotNull(), F.struct(
        F.substring(body, 1, C.ERROR_EXCERPT_CHARS).alias("message"),
        F.lit("upstream_non_json_response").alias("type")))


def paragraph_chunks(col, max_chars: int = 512) -> Column:
    """Non-empty lines, each cut into pieces of at most ``max_chars`` characters."""
    lines = F.filter(F.split(F.coalesce(_c(col), F.lit("")), "\n"), lambda x: x != "")
    return F.flatten(F.transform(lines, lambda ln: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.length(ln) / F.lit(max_chars)).cast("int") - 1, F.lit(0))),
        lambda i: F.substring(ln, i * max_chars + 1, max_chars))))


def dedup_by_hash(df: DataFrame, key: str, col: str) -> DataFrame:
    """One row per distinct content (smallest key kept) with its copy count."""
    h = df.select(key, content_hash(col).alias("content_hash"))
    return h.groupBy("content_hash").agg(F.min(key).alias(f"kept_{key}"), F.count(F.lit(1)).alias("copies"))
