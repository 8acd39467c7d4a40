"""Text matching and scoring as joins over a token table.

Shape of the plan at scale:

* field lengths, N and avglen come straight from the document rows
  (no explode, one tiny global aggregate);
* a table of all tokens is counted where its documents are: their rows meet by key
  before they are tokenised, so a shuffle carries texts and not their tokens;
* document tokens are exploded and *semi-joined to the query terms first*
  (broadcast when the term list is proven small), so only postings of query
  terms are counted and shuffled;
* postings are grouped by (doc, field, token) with map-side partial
  aggregation, then joined to the (query, term) pairs on the token.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagebrush import config as C
from sagebrush.functions.text import grams, query_terms, tokens
from sagebrush.session import BROADCAST_LIMIT_BYTES, SPREAD_SETTING, broadcast_if_small, spread


def _fields(fields: dict[str, Column] | list[str], gram: bool = False) -> dict[str, Column]:
    if isinstance(fields, dict):
        return fields
    return {f: (grams(f) if gram else tokens(f)) for f in fields}


def field_tokens(docs: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """(key, field, toks, len): token arrays per field, one row per doc and field, from one reading of ``docs``."""
    each = F.array(*[F.struct(F.lit(name).alias("field"), expr.alias("toks")) for name, expr in fields.items()])
    return docs.select(F.col(key), F.explode(each).alias("f")).select(key, "f.field", "f.toks", F.size("f.toks").alias("len"))


def token_table(docs: DataFrame, key: str, fields, terms: DataFrame | None = None,
                gram: bool = False) -> DataFrame:
    """A1: (key, field, token, tf, first_pos, len).

    With ``terms`` (a one-column ``token`` DataFrame) only those tokens are
    kept, before the aggregation, so the shuffle carries query postings only.
    Without them the documents are shuffled by key, which is all that the aggregation asks for.
    """
    dealt = by_key(docs, key) if terms is None else spread(docs)
    ft = field_tokens(dealt, key, _fields(fields, gram))
    # posexplode_outer: no inferred size(toks) > 0 filter, so the tokeniser runs once per row
    ex = (ft.select(key, "field", "len", F.posexplode_outer("toks").alias("pos", "token"))
          .filter(F.col("token").isNotNull()))
    if terms is not None:
        ex = keep_terms(ex, terms)
    return (ex.groupBy(key, "field", "token", "len")
            .agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("first_pos")))


def by_key(docs: DataFrame, key: str) -> DataFrame:
    """Documents with the rows of a key in one task: a group-by on the key and more needs no further exchange."""
    n = docs.sparkSession.conf.get(SPREAD_SETTING, None) or docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return docs.repartition(int(n), key)


def term_list(terms: DataFrame) -> list[str]:
    """The distinct query terms: a stated set, collected once per query batch."""
    return [r["token"] for r in terms.select("token").distinct().collect()]


def keep_terms(exploded: DataFrame, terms: DataFrame) -> DataFrame:
    """Keep exploded token rows whose token is a query term: an IN-set predicate inside the codegen stage, so
    other tokens never reach a shuffle."""
    return exploded.filter(F.col("token").isin(term_list(terms)))


def few(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side of at most ``rows`` narrow rows where that is proven small, else leave the join to Spark."""
    return F.broadcast(df) if rows * 128 <= BROADCAST_LIMIT_BYTES else df


def corpus_stats(docs: DataFrame, key: str, fields, gram: bool = False) -> DataFrame:
    """A2 (global part): per field N (rows of the table) and avglen; no explode."""
    ft = field_tokens(spread(docs), key, _fields(fields, gram))
    return ft.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"),
                                   F.avg("len").cast("double").alias("avglen"))


def postings_and_stats(docs: DataFrame, key: str, fields: dict[str, Column],
                       terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """Query-term postings AND per-field statistics from ONE tokenising pass.

    Each (doc, field) token array gets an empty-string marker in front; the marker row carries
    the field length.  Marker and query-term rows go through the same partially aggregated
    group-by, and postings, document frequency and statistics all read that one aggregate
    (Spark reuses its exchange), so the corpus is tokenised once per query batch."""
    ft = field_tokens(spread(docs), key, fields)
    # marker = the empty string (tokens are never empty); the explicit not-null predicate matches the
    # one Spark infers from the join on `token`, so both branches keep the same aggregate input
    marked = F.concat(F.array(F.lit("")), F.col("toks"))
    ex = ft.select(key, "field", "len", F.posexplode_outer(marked).alias("pos", "token"))
    ex = ex.filter(F.col("token").isNotNull() & F.col("token").isin(["", *terms]))
    agg = (ex.groupBy(key, "field", "token", "len")
           .agg(F.count(F.lit(1)).alias("tf"), (F.min("pos") - 1).alias("first_pos")))
    # the marker is element 0, so its group has first_pos -1 and term groups first_pos >= 0.  Filtering
    # on the aggregate's output (not on the grouping column `token`, which Catalyst would push below
    # the aggregate) keeps every branch on the same aggregate, i.e. on one shared exchange
    postings = agg.filter((F.col("first_pos") >= 0) & (F.col("tf") > 0))
    markers = agg.filter((F.col("first_pos") == -1) & (F.col("tf") > 0))
    stats = markers.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"),
                                         F.avg("len").cast("double").alias("avglen"))
    return postings, stats


def doc_freq(postings: DataFrame, key: str) -> DataFrame:
    """A2 (per token part): documents containing each token, per field."""
    # postings are already one row per (doc, field, token).  Referencing tf and
    # first_pos keeps the postings aggregate identical to the scoring branch, so
    # Spark reuses its shuffle instead of tokenising the corpus a second time.
    has = (F.col("tf") > 0) & (F.col("first_pos") >= 0) & (F.col("len") >= 0)
    return postings.groupBy("field", "token").agg(F.count(F.when(has, F.lit(1))).alias("df"))


def query_tokens(queries: DataFrame, qid: str = "query_id", text: str = "qtext",
                 gram: bool = False) -> DataFrame:
    """(query_id, token, nq): distinct query terms and their count per query."""
    arr = F.array_distinct(grams(text)) if gram else query_terms(text)
    q = queries.select(F.col(qid).alias("query_id"), arr.alias("terms"))
    return q.select("query_id", F.size("terms").alias("nq"), F.explode("terms").alias("token"))


def bm25_term(tf: Column, n: Column, N: Column, dl: Column, avgdl: Column,
              k1: float = C.BM25_K1, b: float = C.BM25_B) -> Column:
    """One term of BM25 (Robertson & Zaragoza 2009)."""
    idf = F.log(F.lit(1.0) + (N - n + F.lit(0.5)) / (n + F.lit(0.5)))
    norm = tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl)
    return idf * tf * F.lit(k1 + 1.0) / norm


def native_term(tf: Column, first_pos: Column) -> Column:
    """One term of field_match (our stand-in for nativeRank, see README)."""
    pos_part = F.lit(0.5) / (F.lit(1.0) + first_pos / F.lit(C.NATIVE_POS_SCALE))
    tf_part = F.lit(0.5) * F.least(F.lit(1.0), F.log(F.lit(1.0) + tf) / F.lit(math.log(C.NATIVE_TF_SATURATION)))
    return pos_part + tf_part


def _term_scores(queries: DataFrame, docs: DataFrame, key: str, fdict: dict[str, Column], qid: str, text: str, gram: bool) -> DataFrame:
    """(query_id, key, field, nq, b, m): one row per query term that a field of a document holds.  The query side, the
    document frequencies (terms x fields) and the field statistics are small by the number of terms, which is known."""
    qt = query_tokens(queries, qid, text, gram)
    terms = term_list(qt)
    postings, stats = postings_and_stats(docs, key, fdict, terms)
    joined = (postings.join(few(qt, qt.count()), "token")
              .join(few(doc_freq(postings, key), len(terms) * len(fdict)), ["field", "token"])
              .join(few(stats, len(fdict)), "field"))
    return _scored(joined, key)


def _scored(joined: DataFrame, key: str) -> DataFrame:
    tf = F.col("tf").cast("double")
    return joined.select(
        "query_id", key, "field", "nq",
        bm25_term(tf, F.col("df").cast("double"), F.col("n_docs").cast("double"),
                  F.col("len").cast("double"), F.col("avglen")).alias("b"),
        native_term(tf, F.col("first_pos").cast("double")).alias("m"))


def _by_field(scored: DataFrame, key: str) -> DataFrame:
    return (scored.groupBy("query_id", key, "field")
            .agg(ordered_sum("b").alias("bm25"),
                 (ordered_sum("m") / F.first("nq").cast("double")).alias("native"),
                 F.lit(1).alias("matched")))


def text_features(queries: DataFrame, docs: DataFrame, key: str, fields,
                  qid: str = "query_id", text: str = "qtext", gram: bool = False) -> DataFrame:
    """Per (query_id, key, field): bm25, native, matched (only rows with a match).

    One reading of the documents, one shuffle for the postings, one for the sum."""
    return _by_field(_term_scores(queries, docs, key, _fields(fields, gram), qid, text, gram), key)


def wide_features(queries: DataFrame, docs: DataFrame, key: str, fields, qid: str = "query_id", text: str = "qtext",
                  gram: bool = False) -> DataFrame:
    """``text_features`` with the fields side by side (see ``wide_text_features``), by one conditional aggregate."""
    fdict = _fields(fields, gram)
    scored = _term_scores(queries, docs, key, fdict, qid, text, gram)
    aggs = []
    for f in fdict:
        own = F.col("field") == f
        aggs += [ordered_sum(F.when(own, F.col("b"))).alias(f"bm25_{f}"),
                 (ordered_sum(F.when(own, F.col("m"))) / F.first("nq").cast("double")).alias(f"native_{f}"),
                 F.max(F.when(own, 1).otherwise(0)).alias(f"matches_{f}")]
    return scored.groupBy("query_id", key).agg(*aggs)


def ordered_sum(col) -> Column:
    """Sum of a group's values in ascending order, so documents whose terms are
    equal get bit-identical scores and ties break on the key, not on float noise.
    Groups here are (query, doc, field): at most one value per query term."""
    return F.aggregate(F.array_sort(F.collect_list(col)), F.lit(0.0), lambda acc, x: acc + x)


def wide_text_features(feats: DataFrame, key: str, field_names: list[str]) -> DataFrame:
    """Fields side by side: bm25_<f>, native_<f>, matches_<f> (0 when absent)."""
    aggs = []
    for f in field_names:
        is_f = F.col("field") == f
        aggs += [F.coalesce(F.sum(F.when(is_f, F.col("bm25"))), F.lit(0.0)).alias(f"bm25_{f}"),
                 F.coalesce(F.sum(F.when(is_f, F.col("native"))), F.lit(0.0)).alias(f"native_{f}"),
                 F.coalesce(F.max(F.when(is_f, F.lit(1))), F.lit(0)).alias(f"matches_{f}")]
    return feats.groupBy("query_id", key).agg(*aggs)


def bm25(queries: DataFrame, docs: DataFrame, key: str, fields, **kw) -> DataFrame:
    """A3: (query_id, key, field, bm25)."""
    return text_features(queries, docs, key, fields, **kw).select("query_id", key, "field", "bm25")


def chunk_scores(queries: DataFrame, docs: DataFrame, key: str, array_field: str,
                 qid: str = "query_id", text: str = "qtext") -> DataFrame:
    """A4: elementwise BM25 per array element (key, p) with tf>0.

    Same idf as the field (documents containing the token anywhere in the
    array); tf and length per element, avglen over all elements.
    """
    elems = docs.select(key, F.posexplode(F.coalesce(F.col(array_field), F.array().cast("array<string>")))
                        .alias("p", "elem"))
    elems = (elems.select(key, "p", tokens("elem").alias("toks"))
             .withColumn("len", F.size("toks")).withColumn("field", F.lit(array_field)))
    qt = query_tokens(queries, qid, text)
    terms = term_list(qt)
    # an empty token marks every element, so lengths and postings come from one aggregate, read once
    marked = elems.select(key, "p", "field", "len", F.explode(F.concat(F.array(F.lit("")), "toks")).alias("token"))
    post = (marked.filter(F.col("token").isin(["", *terms])).groupBy(key, "p", "field", "token", "len")
            .agg(F.count(F.lit(1)).alias("tf"), F.max((F.col("token") == "").cast("int")).alias("mark")))
    avg = post.filter("mark = 1 and tf > 0").groupBy("field").agg(F.avg("len").cast("double").alias("avglen"))
    hits = post.filter("mark = 0 and tf > 0")
    dfreq = hits.groupBy("token").agg(F.countDistinct(key).alias("df"))
    n_docs = docs.count()
    j = (hits.join(few(qt, qt.count()), "token").join(few(dfreq, len(terms)), "token")
         .join(few(avg, 1), "field"))
    s = bm25_term(F.col("tf").cast("double"), F.col("df").cast("double"), F.lit(float(n_docs)),
                  F.col("len").cast("double"), F.col("avglen"))
    return j.withColumn("s", s).groupBy("query_id", key, "p").agg(ordered_sum("s").alias("chunk_bm25"))


def match_any(queries: DataFrame, docs: DataFrame, key: str, fields,
              qid: str = "query_id", text: str = "qtext") -> DataFrame:
    """(query_id, key) where any query token occurs in any fieldset column."""
    feats = text_features(queries, docs, key, fields, qid, text)
    return feats.select("query_id", key).distinct()


def match_all(queries: DataFrame, docs: DataFrame, key: str, fields,
              qid: str = "query_id", text: str = "qtext") -> DataFrame:
    """F5 (all): every distinct query token occurs in at least one fieldset column."""
    fdict = _fields(fields)
    qt = query_tokens(queries, qid, text)
    post = token_table(docs, key, fdict, terms=qt.select("token"))
    hit = post.select(key, "token").distinct().join(broadcast_if_small(qt), "token")
    return (hit.groupBy("query_id", key).agg(F.count(F.lit(1)).alias("k"), F.first("nq").alias("nq"))
            .filter(F.col("k") == F.col("nq")).select("query_id", key))


def match_grams(queries: DataFrame, docs: DataFrame, key: str, field: str,
                qid: str = "query_id", text: str = "qtext") -> DataFrame:
    """F6 + A3 on grams: (query_id, key, gram_bm25) for trigram (fuzzy) matching."""
    feats = text_features(queries, docs, key, [field], qid, text, gram=True)
    return feats.select("query_id", key, F.col("bm25").alias("gram_bm25"))


# --- persisted text index (A1/A2 written once; queries read only their terms' postings) -------------

def build_text_index(docs: DataFrame, key: str, fields, path: str, files_per_field: int | None = None,
                     gram: bool = False) -> None:
    """Tokenise the corpus ONCE and write three tables under ``path``:

    * ``postings`` (field, token, key, tf, first_pos, len): partitioned by field, range-clustered
      by (token, key) so one token's postings sit in few files, a hot token is spread over
      several, and Parquet min/max statistics let a ``token IN (...)`` filter skip row groups;
    * ``df`` (field, token, df): document frequency per token;
    * ``stats`` (field, n_docs, avglen).
    """
    fdict = _fields(fields, gram)
    spark = docs.sparkSession
    postings = token_table(docs, key, fdict)
    # a task sorts its range in memory, so there are as many ranges as a shuffle has partitions
    n = files_per_field or max(1, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (postings.repartitionByRange(n, "field", "token", key).sortWithinPartitions("field", "token", key)
     .write.mode("overwrite").partitionBy("field").parquet(f"{path}/postings"))
    p = spark.read.parquet(f"{path}/postings")
    (p.groupBy("field", "token").agg(F.count(F.lit(1)).alias("df"))
     .repartitionByRange(n, "field", "token").sortWithinPartitions("field", "token")
     .write.mode("overwrite").parquet(f"{path}/df"))
    corpus_stats(docs, key, fdict, gram).write.mode("overwrite").parquet(f"{path}/stats")


def text_features_indexed(queries: DataFrame, path: str, key: str, qid: str = "query_id", text: str = "qtext",
                          gram: bool = False) -> DataFrame:
    """A3/K17 from a persisted index: same output as ``text_features`` but the corpus is not
    read; only postings of the query terms (pushed-down IN filter) are scanned."""
    spark = queries.sparkSession
    qt = query_tokens(queries, qid, text, gram)
    terms = term_list(qt)
    postings = spark.read.parquet(f"{path}/postings").filter(F.col("token").isin(terms))
    dfreq = spark.read.parquet(f"{path}/df").filter(F.col("token").isin(terms))
    stats = spark.read.parquet(f"{path}/stats")
    joined = (postings.join(few(qt, qt.count()), "token").join(broadcast_if_small(dfreq), ["field", "token"])
              .join(broadcast_if_small(stats), "field"))
    return _by_field(_scored(joined, key), key)
