"""Search pipelines (R1-R6, R10, R13) over one document type.

Plan (R1): queries -> text features (token join, BM25 + field_match) full
outer join vector top-k (batched matmul) -> phase-1 score -> row_number
top-n -> document attributes joined to the *bounded* top-n side only
(broadcast: at most n rows per query) -> phase-2 score -> final rank.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagebrush import config as C
from sagebrush.functions import scoring as K
from sagebrush.functions.text import tokens
from sagebrush.operators.textindex import wide_features, wide_text_features
from sagebrush.operators.vectors import nn_exact
from sagebrush.session import BROADCAST_LIMIT_BYTES, broadcast_if_small


@dataclass
class DocSpec:
    """How a table is seen as one document type."""
    key: str
    text_fields: dict[str, Column]            # field name -> token array expression
    age_col: str | None = None                # epoch ms
    attrs: list[str] = field(default_factory=list)
    age_default_s: float = C.THREE_MONTHS_S   # age of a document without a time


def file_spec() -> DocSpec:
    """`files_v` as the file type: title and chunks (= lines, counted as their concatenation)."""
    return DocSpec(key="doc_id", text_fields={"title": tokens("title"), "chunks": tokens("body")},
                   age_col="updatedAt")


@dataclass
class Params:
    alpha: float = C.ALPHA
    recency_decay_rate: float = C.RECENCY_DECAY_RATE
    now_s: float = C.NOW_S
    bin_size_days: float = C.BIN_SIZE_DAYS
    target_hits: int = 20                     # vector candidates per query
    rerank_count: int = C.DEFAULT_RERANK
    hits: int | None = None                   # keep only the best `hits` per query
    seed: str = "0"
    text_index: str | None = None             # path of a persisted text index (build_text_index)
    where: Column | None = None               # F1/F3/F4/F7: which documents the caller may find
    n_queries: int | None = None              # number of queries, set by sized() (bounds the top-n side)


def sized(p: Params | None, queries: DataFrame) -> Params:
    """A copy of ``p`` that knows the number of queries (a parameter table: cheap to count)."""
    return replace(p or Params(), n_queries=queries.count())


def visible(docs: DataFrame, spec: DocSpec, p: Params) -> DataFrame:
    """Keys of the documents that a search may return."""
    return (docs if p.where is None else docs.filter(p.where)).select(spec.key)


def only_visible(cands: DataFrame, docs: DataFrame, spec: DocSpec, p: Params) -> DataFrame:
    """Text candidates that a search may return; statistics are those of the whole table, as in an index."""
    return cands if p.where is None else cands.join(broadcast_if_small(visible(docs, spec, p)), spec.key, "left_semi")


def vector_candidates(queries: DataFrame, vectors, docs: DataFrame, spec: DocSpec, p: Params, part: str | None) -> DataFrame:
    """(query_id, key, vector_score): nearest *visible* documents.  The filter comes before the top-k, so a query gets its
    ``target_hits`` among what it may see, and a vector without a document is never a candidate.  A pair
    (text, image) of vector tables gives the sum of both closenesses (A6)."""
    from sagebrush.operators.vectors import sum_over_vector_fields

    keys = broadcast_if_small(visible(docs, spec, p))
    near = [nn_exact(queries, v.join(keys, spec.key, "left_semi"), p.target_hits, key=spec.key, part=part)
            for v in (vectors if isinstance(vectors, (tuple, list)) else [vectors])]
    if len(near) == 2:
        return sum_over_vector_fields(*near, spec.key)
    return near[0].select("query_id", spec.key, F.col("closeness").alias("vector_score"))


def with_vectors(lexical: DataFrame, vec: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Text and vector candidates, a missing side scores 0."""
    fills = {"vector_score": 0.0}
    for f in names:
        fills.update({f"bm25_{f}": 0.0, f"native_{f}": 0.0, f"matches_{f}": 0})
    return lexical.join(vec, ["query_id", key], "full_outer").fillna(fills)


def features(queries: DataFrame, docs: DataFrame, vectors: DataFrame | None, spec: DocSpec,
             p: Params, part: str | None = "p") -> DataFrame:
    """U2 candidates with every base feature: bm25_/native_/matches_<field>, vector_score."""
    names = list(spec.text_fields)
    if p.text_index:
        from sagebrush.operators.textindex import text_features_indexed

        lexical = wide_text_features(text_features_indexed(queries, p.text_index, spec.key), spec.key, names)
    else:
        lexical = wide_features(queries, docs, spec.key, spec.text_fields)
    if p.where is not None or p.text_index:
        # statistics are those of the whole table, as in an index; only the candidates are filtered
        lexical = lexical.join(broadcast_if_small(visible(docs, spec, p)), spec.key, "left_semi")
    if vectors is None:
        return with_params(lexical.withColumn("vector_score", F.lit(0.0)), queries)
    return with_params(with_vectors(lexical, vector_candidates(queries, vectors, docs, spec, p, part), spec.key, names), queries)


QUERY_PARAMS = ("alpha", "recency_decay_rate", "bin_size_days")


def param(cands: DataFrame, name: str, default: float) -> Column:
    """A query input; the query's own value where the queries table has the column, else the call's."""
    return F.col(f"_{name}") if f"_{name}" in cands.columns else F.lit(float(default))


def with_params(cands: DataFrame, queries: DataFrame) -> DataFrame:
    own = [c for c in QUERY_PARAMS if c in queries.columns]
    if not own:
        return cands
    side = queries.select("query_id", *[F.col(c).cast("double").alias(f"_{c}") for c in own])
    return cands.join(broadcast_if_small(side), "query_id")


def combined_native(names: list[str]) -> Column:
    return K.mean_over_matched([F.col(f"native_{f}") for f in names], [F.col(f"matches_{f}") for f in names])


def combined_bm25(names: list[str]) -> Column:
    out = None
    for f in names:
        out = F.col(f"bm25_{f}") if out is None else out + F.col(f"bm25_{f}")
    return out


def attach_attrs(ranked: DataFrame, docs: DataFrame, spec: DocSpec, cols: list[str], max_rows: int | None = None) -> DataFrame:
    """Document attributes for ranked rows.  Every candidate is a visible document, so the join keeps all of them
    whichever side Spark moves; ``max_rows`` (queries x rerank_count), where known, proves the ranked side small
    enough to travel, and the document table then streams through without a shuffle."""
    d = docs.select(spec.key, *cols)
    row_bytes = 64 + 16 * len(ranked.columns)
    if max_rows is not None and max_rows * row_bytes <= BROADCAST_LIMIT_BYTES:
        return d.join(F.broadcast(ranked), spec.key)
    return ranked.join(d, spec.key)


def _recency(df: DataFrame, spec: DocSpec, p: Params) -> Column:
    rate = param(df, "recency_decay_rate", p.recency_decay_rate)
    return K.doc_recency(K.document_age(F.col(spec.age_col), p.now_s, spec.age_default_s), rate)


def two_phase(cands: DataFrame, docs: DataFrame, spec: DocSpec, p: Params,
              phase1: Column, phase2, recency: bool = True) -> DataFrame:
    """Phase 1 on all candidates, phase 2 on the top ``rerank_count`` only;
    the rest follow by phase 1.

    The top-n side is bounded (n rows per query), so document attributes are
    joined to it by broadcast and window features of phase 2 (e.g.
    normalize_linear) see only the reranked rows.  ``phase2`` is a Column or
    a callable ``df -> Column``.
    """
    from pyspark.sql import Window

    from sagebrush.operators.windows import distributed_rank

    w1 = Window.partitionBy("query_id").orderBy(F.col("phase1").desc(), F.col(spec.key).asc())
    scored = cands.withColumn("phase1", phase1)
    if not (p.hits is not None and p.hits <= p.rerank_count):
        # full ranking: the candidate set feeds the top-n, the anti-join and the rest; materialise it
        # once in the shared checkpoint folder instead of recomputing the text/vector pipeline
        scored = scored.checkpoint()
    # top rerank_count per query: `row_number <= n` is cut to n rows per partition before the shuffle
    top = (scored.withColumn("phase1_rank", F.row_number().over(w1)).filter(F.col("phase1_rank") <= p.rerank_count)
           .withColumn("reranked", F.lit(True)))
    if recency and spec.age_col:
        top = attach_attrs(top, docs, spec, [spec.age_col], p.n_queries and p.n_queries * p.rerank_count)
        top = top.withColumn("doc_recency", _recency(top, spec, p)).drop(spec.age_col)
    else:
        top = top.withColumn("doc_recency", F.lit(None).cast("double"))
    p2 = phase2(top) if callable(phase2) else phase2
    top = top.withColumn("phase2", p2).withColumn("score", F.col("phase2"))
    w2 = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(spec.key).asc())
    top = top.withColumn("rank", F.row_number().over(w2).cast("long")).drop("phase1_rank")
    if p.hits is not None and p.hits <= p.rerank_count:
        return top.filter(F.col("rank") <= p.hits)
    # the rest (unbounded per query) follows by phase 1: ranked without a per-query task
    rest = scored.join(broadcast_if_small(top.select("query_id", spec.key)), ["query_id", spec.key], "left_anti")
    n_top = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n_top"))
    rest = (rest.join(broadcast_if_small(n_top), "query_id", "left")
            .withColumn("_n_top", F.coalesce("_n_top", F.lit(0)))
            .withColumn("reranked", F.lit(False)).withColumn("doc_recency", F.lit(None).cast("double"))
            .withColumn("phase2", F.lit(None).cast("double")).withColumn("score", F.col("phase1")))
    rest = distributed_rank(rest, [F.col("phase1").desc()], spec.key, base=F.col("_n_top")).drop("_n_top")
    out = top.unionByName(rest, allowMissingColumns=True)
    if p.hits is not None:
        out = out.filter(F.col("rank") <= p.hits)
    return out


def prepare(queries: DataFrame, docs: DataFrame, vectors: DataFrame | None, spec: DocSpec, p: Params,
            part: str | None = "p") -> DataFrame:
    """Candidates plus matched_field_count, combined_nativeRank, combined_bm25."""
    names = list(spec.text_fields)
    cands = features(queries, docs, vectors, spec, p, part)
    return (cands.withColumn("matched_field_count", K.matched_field_count([F.col(f"matches_{f}") for f in names]))
            .withColumn("combined_nativeRank", combined_native(names))
            .withColumn("combined_bm25", combined_bm25(names)))


def hybrid_search(queries: DataFrame, docs: DataFrame, vectors: DataFrame | None, p: Params | None = None,
                  spec: DocSpec | None = None, profile: str = "default_native", part: str | None = "p") -> DataFrame:
    """R1 and its siblings for the file family (file, kb_items, datasource_file, mail, ...).

    profiles: default_native (R1), default_bm25 (R2), title_boosted_hybrid (R3),
    default_ai (R4), default_random (W5).
    """
    p = sized(p, queries)
    spec = spec or file_spec()
    names = list(spec.text_fields)
    cands = prepare(queries, docs, vectors, spec, p, part)
    a = param(cands, "alpha", p.alpha)
    vs = F.col("vector_score")
    cnr, cbm = F.col("combined_nativeRank"), F.col("combined_bm25")
    if profile == "default_native":
        return two_phase(cands, docs, spec, p, K.hybrid(a, vs, cnr), K.hybrid(a, vs, cnr) * F.col("doc_recency"))
    if profile == "default_bm25":
        return two_phase(cands, docs, spec, p, K.hybrid(a, vs, cbm), K.hybrid(a, vs, K.scale(cbm)), recency=False)
    if profile == "default_ai":
        return two_phase(cands, docs, spec, p, K.hybrid(a, vs, cnr), K.hybrid(a, vs, cnr), recency=False)
    if profile == "title_boosted_hybrid":
        t, c = names[0], names[1]
        text = K.weighted([(5.0, F.col(f"native_{t}")), (0.2, F.col(f"native_{c}"))])
        return two_phase(cands, docs, spec, p, K.hybrid(a, vs, text), K.hybrid(a, vs, text) * F.col("doc_recency"))
    if profile == "default_random":
        cands = cands.withColumn("random_score", K.random_score(F.col(spec.key), p.seed))
        return two_phase(cands, docs, spec, p, F.col("random_score"), F.col("phase1"), recency=False)
    raise ValueError(f"unknown profile {profile}")


def sorted_search(queries: DataFrame, docs: DataFrame, vectors: DataFrame | None, p: Params | None = None,
                  spec: DocSpec | None = None, variant: str = "binned_clamped") -> DataFrame:
    """R5 (global_sorted, W4): newest recency bin first, hybrid relevance inside a bin.

    ``binned_clamped``: multiplier 10,000 with relevance/10 clamped;
    ``binned_raw``: multiplier 1,000,000 with raw relevance.  The packed
    score is emitted, the order uses (bin asc, relevance desc, key asc)."""
    from sagebrush.operators.windows import global_sorted

    p = p or Params()
    spec = spec or file_spec()
    names = list(spec.text_fields)
    cands = features(queries, docs, vectors, spec, p)
    cands = attach_attrs(cands, docs, spec, [spec.age_col])
    a = param(cands, "alpha", p.alpha)
    rel = K.hybrid(a, F.col("vector_score"), combined_native(names))
    days = K.document_age_days(F.col(spec.age_col), p.now_s)
    b = K.recency_bin_index(days, param(cands, "bin_size_days", p.bin_size_days))
    if variant == "binned_clamped":
        mult, rel_used = C.BIN_MULTIPLIER_CLAMPED, K.normalized_hybrid(rel, C.BIN_MULTIPLIER_CLAMPED)
    else:
        mult, rel_used = C.BIN_MULTIPLIER_RAW, rel
    out = (cands.withColumn("document_age_days", days).withColumn("recency_bin_index", b)
           .withColumn("recency_bin_score", K.recency_bin_score(F.col("recency_bin_index"), mult))
           .withColumn("hybrid_relevance", rel).withColumn("relevance_used", rel_used)
           .withColumn("score", F.col("recency_bin_score") + F.col("relevance_used")))
    out = global_sorted(out, "recency_bin_index", "relevance_used", spec.key)
    if p.hits is not None:
        out = out.filter(F.col("rank") <= p.hits)
    return out.drop(spec.age_col)


def one_phase(cands: DataFrame, spec: DocSpec, score: Column, p: Params) -> DataFrame:
    """Profiles with a single phase: rank by ``score`` desc (NULLs last), key asc."""
    from pyspark.sql import Window

    out = cands.withColumn("score", score)
    if p.hits is not None:      # bounded: row_number <= hits is cut per partition before the shuffle
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), F.col(spec.key).asc())
        return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= p.hits)
    from sagebrush.operators.windows import distributed_rank

    return distributed_rank(out, [F.col("score").desc_nulls_last()], spec.key)


def with_query_columns(cands: DataFrame, queries: DataFrame, cols: list[str]) -> DataFrame:
    """Per-query inputs (e.g. is_intent_search) on every candidate; the queries
    side is a parameter table and is broadcast when its plan size is proven small."""
    return cands.join(broadcast_if_small(queries.select("query_id", *cols)), "query_id")


def people_search(queries: DataFrame, people: DataFrame, spec: DocSpec, p: Params,
                  profile: str = "default_native") -> DataFrame:
    """R8 (user/chat_user): no first phase given -> combined_nativeRank; then
    2x (default_native) or 3x (title_boosted_hybrid) on the reranked rows."""
    p = sized(p, queries)
    cands = prepare(queries, people, None, spec, p, None)
    factor = {"default_native": 2.0, "title_boosted_hybrid": 3.0, "default_ai": 1.0}[profile]
    cnr = F.col("combined_nativeRank")
    return two_phase(cands, people, spec, p, cnr, K.boost(cnr, factor), recency=False)


def name_lookup(queries: DataFrame, docs: DataFrame, spec: DocSpec, p: Params) -> DataFrame:
    """R13 (datasource / chat_team): nativeRank of the single name field."""
    cands = prepare(queries, docs, None, spec, p, None)
    name = list(spec.text_fields)[0]
    return one_phase(cands, spec, F.col(f"native_{name}"), p)


def mail_search(queries: DataFrame, mails: DataFrame, vectors: DataFrame | None, spec: DocSpec,
                p: Params, intent_col: str = "is_intent_search") -> DataFrame:
    """R10 (mail.default_native): people-only text score for intent searches (K13), else
    subject/chunks/weighted people fields over the matched count (K11, K12)."""
    p = sized(p, queries)
    cands = mail_native(prepare(queries, mails, vectors, spec, p, "p"), queries, intent_col)
    h = K.hybrid(param(cands, "alpha", p.alpha), F.col("vector_score"), F.col("combined_nativeRank"))
    return two_phase(cands, mails, spec, p, h, h * F.col("doc_recency"))


def mail_native(cands: DataFrame, queries: DataFrame, intent_col: str = "is_intent_search") -> DataFrame:
    """combined_nativeRank of mail: people only for an intent search, else subject, chunks and weighted people over
    the matched count (K11-K13)."""
    if intent_col in queries.columns:
        cands = with_query_columns(cands, queries, [intent_col])
    else:
        cands = cands.withColumn(intent_col, F.lit(0.0))
    n = F.col
    people = K.weighted([(0.8, n("native_from")), (0.4, n("native_to")), (0.2, n("native_cc") + n("native_bcc"))])
    simple = ((n("native_from") + n("native_to")) + n("native_cc")) + n("native_bcc")
    general = (n("native_subject") + n("native_chunks") + people) / F.when(
        n("matched_field_count") == 0, F.lit(1.0)).otherwise(n("matched_field_count").cast("double"))
    return cands.withColumn("combined_nativeRank", K.intent_switch(n(intent_col), simple, general))


def attachment_default_search(queries: DataFrame, docs: DataFrame, vectors: DataFrame, spec: DocSpec,
                              p: Params) -> DataFrame:
    """R11 (chat_attachment.default): 0.5*vector + sum of scaled BM25; phase 2 uses
    normalize_linear(vector_score) over the reranked rows of the query (W3)."""
    from pyspark.sql import Window

    p = sized(p, queries)
    cands = prepare(queries, docs, vectors, spec, p, None)
    scaled = None
    for f in spec.text_fields:
        t = K.scale(F.col(f"bm25_{f}"))
        scaled = t if scaled is None else scaled + t
    cands = cands.withColumn("scaled_bm25", scaled)

    def phase2(top: DataFrame) -> Column:
        w = Window.partitionBy("query_id")
        mn, mx = F.min("vector_score").over(w), F.max("vector_score").over(w)
        norm = F.when(mx == mn, F.lit(0.0)).otherwise((F.col("vector_score") - mn) / (mx - mn))
        return F.lit(0.5) * norm + F.col("scaled_bm25")

    return two_phase(cands, docs, spec, p, F.lit(0.5) * F.col("vector_score") + F.col("scaled_bm25"),
                     phase2, recency=False)


def attachment_search(queries: DataFrame, docs: DataFrame, text_vecs: DataFrame, image_vecs: DataFrame,
                      spec: DocSpec, p: Params) -> DataFrame:
    """R6 (file.attachmentRank): text + image chunk closeness (A6) and nativeRank over
    title, chunks and image_chunks; recency in phase 2."""
    p = sized(p, queries)
    cands = prepare(queries, docs, (text_vecs, image_vecs), spec, p, "p")
    h = K.hybrid(param(cands, "alpha", p.alpha), F.col("vector_score"), F.col("combined_nativeRank"))
    return two_phase(cands, docs, spec, p, h, h * F.col("doc_recency"))


def memory_search(queries: DataFrame, memories: DataFrame, vectors: DataFrame, spec: DocSpec, p: Params,
                  importance_col: str | None = None) -> DataFrame:
    """R9 (chat_memory / episodic_memory): one phase,
    (alpha*vector + (1-alpha)*bm25(text)) * doc_recency [* importance] (K3, K10, K14).
    The age has no default here: a missing timestamp gives a NULL score, ranked last."""
    cands = prepare(queries, memories, vectors, spec, p, None)
    extra = [spec.age_col] + ([importance_col] if importance_col else [])
    cands = attach_attrs(cands, memories, spec, extra)
    rec = K.doc_recency(K.document_age_nodefault(F.col(spec.age_col), p.now_s), param(cands, "recency_decay_rate", p.recency_decay_rate))
    cands = cands.withColumn("doc_recency", rec)
    score = K.hybrid(param(cands, "alpha", p.alpha), F.col("vector_score"), F.col("combined_bm25")) * F.col("doc_recency")
    if importance_col:
        score = K.importance_factor(score, F.col(importance_col))
    return one_phase(cands, spec, score, p)


def autocomplete(queries: DataFrame, docs: DataFrame, key: str, fields: list[str], p: Params) -> DataFrame:
    """BM25 over trigram copies of the fields (bm25(x_fuzzy) + ...), one phase."""
    from sagebrush.functions.text import grams

    spec = DocSpec(key=key, text_fields={f: grams(f) for f in fields})
    wide = only_visible(wide_features(queries, docs, key, spec.text_fields, gram=True), docs, spec, p)
    return one_phase(wide.withColumn("combined_bm25", combined_bm25(fields)), spec, F.col("combined_bm25"), p)


def query_log_autocomplete(queries: DataFrame, counts: DataFrame, p: Params) -> DataFrame:
    """R7 (user_query.autocomplete): bm25(query_text grams) in phase 1; phase 2 =
    normalize_linear(bm25) over the reranked rows + 5*freshness(timestamp) + count."""
    from pyspark.sql import Window

    from sagebrush.functions.text import grams

    p = sized(p, queries)
    spec = DocSpec(key="qid", text_fields={"query_text": grams("query_text")}, age_col="timestamp")
    wide = only_visible(wide_features(queries, counts, "qid", spec.text_fields, gram=True), counts, spec, p)
    cands = wide.withColumn("combined_bm25", F.col("bm25_query_text"))
    cands = attach_attrs(cands, counts, spec, ["timestamp", "count"])

    def phase2(top: DataFrame) -> Column:
        w = Window.partitionBy("query_id")
        mn, mx = F.min("combined_bm25").over(w), F.max("combined_bm25").over(w)
        norm = F.when(mx == mn, F.lit(0.0)).otherwise((F.col("combined_bm25") - mn) / (mx - mn))
        return norm + (F.lit(5.0) * K.freshness(F.col("timestamp"), p.now_s) + F.col("count").cast("double"))

    return two_phase(cands, counts, spec, p, F.col("combined_bm25"), phase2, recency=False)


def match_features(df: DataFrame, cols: list[str], out: str = "match_features") -> DataFrame:
    """P10: the feature values a profile used, as one struct column."""
    return df.withColumn(out, F.struct(*[F.col(c) for c in cols]))
