"""The rank-profile registry.

All 91 profiles are data: (schema, profile) -> family builder + parameters.
The builders turn the shared features of ``search.prepare`` (bm25_/native_/
matches_<field>, vector_score) into phase-1 / phase-2 Column expressions, so
every profile runs as the same Spark plan (token join + vector top-k +
row_number rerank) and Catalyst sees plain arithmetic.

A caller maps the schema's fields to the columns of its table with
``field_map``; fields absent from the map count as empty (no match).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagebrush import config as C
from sagebrush.functions import scoring as K
from sagebrush.functions.text import tokens
from sagebrush.plans import search as S


@dataclass
class Schema:
    """Fields entering combined_bm25 / combined_nativeRank, weighted meta fields,
    the age column(s) and the vector layout of one document type."""
    fields: list[str]
    age: str | None = None
    bin_age: str | None = None            # age column of the recency-bin variant (Q15)
    meta: dict[str, float] = field(default_factory=dict)
    divide_by_matched: bool = True        # chat_user sums without dividing (Q-table §2.10)
    vector: str | None = "chunks"         # "chunks" (mixed p -> v), "single", or None
    name: str | None = None               # the field of nativeRank(name) profiles
    score_only: list[str] = field(default_factory=list)   # searched and weighted, but in no combined function
    image: bool = False                   # vector_score adds the closeness of image chunks
    people: list[str] = field(default_factory=list)       # fields of the people score
    age_default_s: float = C.THREE_MONTHS_S


# --- fixed values: base functions per schema ------------------------------------------------------
SCHEMAS: dict[str, Schema] = {
    "chat_team": Schema(["name"], vector=None, name="name"),
    "chat_container": Schema(["name", "topic", "description"], age="updatedAt", bin_age="createdAt", name="name"),
    "chat_message": Schema(["text", "username", "name"], age="createdAt", bin_age="updatedAt", vector="single",
                           name="text"),
    "chat_attachment": Schema(["title", "filename", "chunks"], vector="single"),
    "chat_user": Schema(["name", "email", "statusText", "title"], age="updatedAt", bin_age="updatedAt",
                        divide_by_matched=False, name="name"),
    "chat_memory": Schema(["text"], age="createdAt", vector="single"),
    "episodic_memory": Schema(["memoryText"], age="lastUsedAt", vector="single"),
    "mail": Schema(["subject", "chunks"], age="timestamp", bin_age="timestamp", name="subject",
                   people=["from", "to", "cc", "bcc"]),
    "mail_attachment": Schema(["filename", "chunks"], age="timestamp", bin_age="timestamp", name="filename"),
    "file": Schema(["title", "chunks"], age="updatedAt", bin_age="updatedAt", name="title"),
    "kb_items": Schema(["fileName", "chunks", "image_chunks", "description"], age="updatedAt", bin_age="updatedAt",
                       name="fileName", image=True),
    "datasource": Schema(["name"], vector=None, name="name"),
    "datasource_file": Schema(["fileName", "chunks", "image_chunks"], age="updatedAt", bin_age="updatedAt",
                              name="fileName", image=True),
    "event": Schema(["name", "description", "url"], age="updatedAt", bin_age="startTime",
                    meta={"attachmentFilenames": 0.2, "attendeesNames": 0.2}, name="name",
                    age_default_s=C.THREE_MONTHS_S_EVENT_INITIAL),
    "ticket": Schema(["subject", "description", "threadSummary", "commentSummary"], age="createdTime", name="subject",
                     score_only=["wholeResolutionSummary"]),
    "user": Schema(["name", "email"], bin_age="lastLoggedIn", vector=None, name="name"),
    "user_query": Schema(["query_text"], age="timestamp", vector=None),
}

# fixed values: ticket field weights (default_bm25 and hybrid)
TICKET_WEIGHTS = {"subject": 2.0, "description": 1.5, "threadSummary": 1.0, "commentSummary": 0.5,
                  "wholeResolutionSummary": 1.0}

N, B, A, R, G, T = "native", "bm25", "ai", "random", "global_sorted", "title_boosted"

# --- fixed values: the 91 profiles (family, parameters) -------------------------------------------
PROFILES: dict[tuple[str, str], tuple[str, dict]] = {
    ("chat_team", "default"): ("name", {"mean_of_fields": True}),
    ("chat_container", "initial"): ("initial", {}),
    ("chat_container", "default_native"): (N, {"recency": False}),
    ("chat_container", "default_bm25"): (B, {}),
    ("chat_container", "title_boosted_hybrid"): (T, {"weights": {"name": 1.0}, "factor": 1.2, "recency": False}),
    ("chat_container", "default_ai"): (A, {}),
    ("chat_container", "autocomplete"): ("autocomplete", {"fields": ["name"]}),
    ("chat_container", "global_sorted"): ("sort_attr", {"attr": "createdAt"}),
    ("chat_message", "initial"): ("initial", {}),
    ("chat_message", "default_native"): (N, {"recency": False, "decay": "global"}),
    ("chat_message", "default_bm25"): (B, {"decay": "global"}),
    ("chat_message", "default_ai"): (A, {"decay": "first"}),
    ("chat_message", "default_random"): (R, {}),
    ("chat_message", "global_sorted"): (G, {"variant": "binned_clamped", "decay": True}),
    ("chat_message", "title_boosted_hybrid"): (T, {"weights": {"text": 1.0}, "factor": 1.2, "recency": False}),
    ("chat_attachment", "default"): ("attachment_default", {}),
    ("chat_user", "initial"): ("initial", {}),
    ("chat_user", "default_native"): (N, {"recency": False}),
    ("chat_user", "title_boosted_hybrid"): (T, {"weights": {"name": 5.0}, "recency": False, "freshness": True}),
    ("chat_user", "global_sorted"): (G, {"variant": "binned_clamped"}),
    ("chat_user", "default_bm25"): (B, {"text_only": True}),
    ("chat_user", "default_ai"): (A, {"text_only": True}),
    ("chat_user", "autocomplete"): ("autocomplete", {"fields": ["name", "email"]}),
    ("chat_memory", "initial"): ("initial", {}),
    ("chat_memory", "default_native"): ("memory", {}),
    ("episodic_memory", "initial"): ("initial", {}),
    ("episodic_memory", "default_native"): ("memory", {"importance": "importanceScore"}),
    ("mail", "initial"): ("initial", {}),
    ("mail", "default_native"): (N, {}),
    ("mail", "global_sorted"): (G, {"variant": "binned_raw"}),
    ("mail", "default_bm25"): (B, {}),
    ("mail", "default_ai"): (A, {}),
    ("mail", "title_boosted_hybrid"): (T, {"weights": {"subject": 5.0, "chunks": 0.2}}),
    ("mail", "default_random"): (R, {}),
    ("mail", "autocomplete"): ("autocomplete", {"fields": ["subject"]}),
    ("mail_attachment", "initial"): ("initial", {}),
    ("mail_attachment", "default_native"): (N, {"factor": 0.8}),
    ("mail_attachment", "global_sorted"): (G, {"variant": "binned_raw"}),
    ("mail_attachment", "default_bm25"): (B, {"scaled_first": True, "factor": 0.78}),
    ("mail_attachment", "default_ai"): (A, {}),
    ("mail_attachment", "default_random"): (R, {}),
    ("mail_attachment", "title_boosted_hybrid"): (T, {"weights": {"filename": 5.0, "chunks": 0.2}}),
    ("mail_attachment", "autocomplete"): ("autocomplete", {"fields": ["filename"], "plain": True}),
    ("file", "initial"): ("initial", {}),
    ("file", "default_native"): (N, {}),
    ("file", "attachmentRank"): ("attachment_rank", {}),
    ("file", "global_sorted"): (G, {"variant": "binned_clamped"}),
    ("file", "default_bm25"): (B, {}),
    ("file", "default_ai"): (A, {}),
    ("file", "default_random"): (R, {}),
    ("file", "title_boosted_hybrid"): (T, {"weights": {"title": 5.0, "chunks": 0.2}}),
    ("file", "autocomplete"): ("autocomplete", {"fields": ["title"]}),
    ("kb_items", "initial"): ("initial", {}),
    ("kb_items", "default_native"): (N, {}),
    ("kb_items", "global_sorted"): (G, {"variant": "binned_clamped"}),
    ("kb_items", "default_bm25"): (B, {}),
    ("kb_items", "default_ai"): (A, {}),
    ("kb_items", "title_boosted_hybrid"): (T, {"weights": {"fileName": 5.0, "chunks": 0.2}}),
    ("kb_items", "default_random"): (R, {}),
    ("kb_items", "autocomplete"): ("autocomplete", {"fields": ["fileName"]}),
    ("datasource", "default_profile"): ("name", {}),
    ("datasource_file", "initial"): ("initial", {}),
    ("datasource_file", "default_native"): (N, {}),
    ("datasource_file", "global_sorted"): (G, {"variant": "binned_clamped"}),
    ("datasource_file", "default_bm25"): (B, {}),
    ("datasource_file", "default_ai"): (A, {}),
    ("datasource_file", "default_random"): (R, {}),
    ("datasource_file", "title_boosted_hybrid"): (T, {"weights": {"fileName": 5.0, "chunks": 0.2}}),
    ("datasource_file", "autocomplete"): ("autocomplete", {"fields": ["fileName"]}),
    ("event", "initial"): ("initial", {}),
    ("event", "default_native"): (N, {}),
    ("event", "global_sorted"): (G, {"variant": "binned_raw"}),
    ("event", "default_bm25"): (B, {}),
    ("event", "default_ai"): (A, {}),
    ("event", "default_random"): (R, {}),
    ("event", "title_boosted_hybrid"): (T, {"weights": {"name": 1.0}, "factor": 1.2, "recency": False}),
    ("event", "autocomplete"): ("autocomplete", {"fields": ["name"]}),
    ("ticket", "default_bm25"): ("weighted_bm25", {}),
    ("ticket", "hybrid"): ("weighted_bm25", {"vector": True}),
    ("ticket", "initial"): ("initial", {}),
    ("ticket", "default_native"): (N, {}),
    ("ticket", "title_boosted_hybrid"): (T, {"weights": {"subject": 5.0, "description": 0.2}}),
    ("user", "initial"): ("initial", {}),
    ("user", "default_native"): ("people", {"factor": 2.0}),
    ("user", "title_boosted_hybrid"): ("people", {"factor": 3.0}),
    ("user", "global_sorted"): (G, {"variant": "binned_raw", "text_factor": 2.0}),
    ("user", "default_bm25"): (B, {"text_only": True, "phase1": "native"}),
    ("user", "default_ai"): (A, {"text_only": True}),
    ("user", "default_random"): (R, {}),
    ("user", "autocomplete"): ("autocomplete", {"fields": ["name", "email"]}),
    ("user_query", "autocomplete"): ("query_log", {}),
}


def profile(schema: str, name: str) -> tuple[str, dict]:
    """Look up one profile: (family, parameters)."""
    return PROFILES[(schema, name)]


def _spec(schema: str, key: str, field_map: dict[str, str], age_col: str | None) -> tuple[S.DocSpec, list[str], dict]:
    sc = SCHEMAS[schema]
    prim = [f for f in sc.fields if f in field_map]
    meta = {f: w for f, w in sc.meta.items() if f in field_map}
    others = [f for f in sc.score_only + sc.people if f in field_map]
    fields = {f: tokens(field_map[f]) for f in prim + list(meta) + others}
    return S.DocSpec(key, fields, age_col=age_col, age_default_s=sc.age_default_s), prim, meta


def rank(queries: DataFrame, docs: DataFrame, vectors: DataFrame | None, schema: str, name: str, key: str,
         field_map: dict[str, str], age_col: str | None = None, p: S.Params | None = None,
         part: str | None = "p", image_vectors: DataFrame | None = None) -> DataFrame:
    """Run profile ``schema.name`` over ``docs`` (columns named by ``field_map``); ``image_vectors`` are the image chunks of
    the types that score them."""
    fam, kw = profile(schema, name)
    p = S.sized(p, queries)
    sc = SCHEMAS[schema]
    spec, prim, meta = _spec(schema, key, field_map, age_col)
    if fam == "initial":
        raise ValueError("`initial` profiles only declare shared functions; they have no phases")
    if fam == "sort_attr":
        cands = S.attach_attrs(S.prepare(queries, docs, vectors, spec, p, part), docs, spec, [kw["attr"]])
        return S.one_phase(cands, spec, F.col(kw["attr"]).cast("double"), p)
    if fam == "memory":
        return S.memory_search(queries, docs, vectors, spec, p, importance_col=kw.get("importance"))
    if fam == "query_log":
        return S.query_log_autocomplete(queries, docs, p)
    if fam == "autocomplete":
        names = kw["fields"]
        if kw.get("plain"):      # Q10: scores the plain field, not the trigram copy
            feats = S.prepare(queries, docs, None, S.DocSpec(key, {f: tokens(field_map[f]) for f in names}), p, None)
            return S.one_phase(feats, spec, F.col("combined_bm25"), p)
        return S.autocomplete(queries, docs.select(key, *[F.col(field_map[f]).alias(f) for f in names]),
                              key, names, p)
    if fam == "attachment_default":
        return S.attachment_default_search(queries, docs, vectors, spec, p)
    if fam == "name":
        cands = S.prepare(queries, docs, None, spec, p, None)
        score = (F.col("combined_nativeRank") if kw.get("mean_of_fields")
                 else F.col(f"native_{sc.name}"))
        if kw.get("mean_of_fields"):
            score = sum((F.col(f"native_{f}") for f in prim), F.lit(0.0)) / F.lit(float(len(prim)))
        return S.one_phase(cands, spec, score, p)

    use_vec = vectors if (sc.vector and not kw.get("text_only")) else None
    if use_vec is not None and sc.image and image_vectors is not None:
        use_vec = (vectors, image_vectors)
    cands = S.prepare(queries, docs, use_vec, spec, p, part if sc.vector == "chunks" else None)
    others = set(spec.text_fields) - set(prim) - set(meta)
    if others:
        # the people of mail count as matched fields but enter through their own score; other fields only by weight
        matched = [F.col(f"matches_{f}") for f in [*prim, *(f for f in sc.people if f in others)]]
        cands = (cands.withColumn("matched_field_count", K.matched_field_count(matched))
                 .withColumn("combined_nativeRank", S.combined_native(prim)).withColumn("combined_bm25", S.combined_bm25(prim)))
        if all(f in others for f in sc.people) and sc.people and fam in (N, A, G):
            cands = S.mail_native(cands, queries)
    if not sc.divide_by_matched:
        cands = cands.withColumn("combined_nativeRank", sum((F.col(f"native_{f}") for f in prim), F.lit(0.0)))
    if meta:
        extra_n = sum((F.lit(w) * F.col(f"native_{f}") for f, w in meta.items()), F.lit(0.0))
        extra_b = sum((F.lit(w) * F.col(f"bm25_{f}") for f, w in meta.items()), F.lit(0.0))
        cnr_prim = K.mean_over_matched([F.col(f"native_{f}") for f in prim], [F.col(f"matches_{f}") for f in prim])
        cands = (cands.withColumn("matched_field_count",
                                  K.matched_field_count([F.col(f"matches_{f}") for f in prim]))
                 .withColumn("combined_nativeRank", cnr_prim + extra_n)
                 .withColumn("combined_bm25", sum((F.col(f"bm25_{f}") for f in prim), F.lit(0.0)) + extra_b))
    a = S.param(cands, "alpha", p.alpha)
    vs = F.col("vector_score")
    decay = kw.get("decay")
    v1 = vs * F.lit(C.VECTOR_DECAY) if decay == "first" else vs
    v2 = vs * F.lit(C.VECTOR_DECAY) if decay == "global" else vs
    cnr, cbm = F.col("combined_nativeRank"), F.col("combined_bm25")
    factor = F.lit(float(kw.get("factor", 1.0)))
    rec = kw.get("recency", True) and spec.age_col is not None

    if fam == N:
        p2 = factor * K.hybrid(a, v2, cnr)
        return S.two_phase(cands, docs, spec, p, K.hybrid(a, v1, cnr),
                           p2 * F.col("doc_recency") if rec else p2, recency=rec)
    if fam == B:
        if kw.get("text_only"):
            p1 = cnr if kw.get("phase1") == "native" else cbm
            return S.two_phase(cands, docs, spec, p, p1, K.scale(cbm), recency=False)
        p1 = K.hybrid(a, v1, K.scale(cbm) if kw.get("scaled_first") else cbm)
        return S.two_phase(cands, docs, spec, p, p1, factor * K.hybrid(a, v2, K.scale(cbm)), recency=False)
    if fam == A:
        if kw.get("text_only"):
            return S.two_phase(cands, docs, spec, p, cnr, cnr, recency=False)
        return S.two_phase(cands, docs, spec, p, K.hybrid(a, v1, cnr), K.hybrid(a, vs, cnr), recency=False)
    if fam == R:
        cands = cands.withColumn("random_score", K.random_score(F.col(key), p.seed))
        return S.two_phase(cands, docs, spec, p, F.col("random_score"), F.col("phase1"), recency=False)
    if fam == T:
        text = K.weighted([(w, F.col(f"native_{f}")) for f, w in kw["weights"].items() if f in prim])
        p1 = K.hybrid(a, vs, text)
        p2 = factor * K.hybrid(a, vs, text)
        if kw.get("freshness"):
            cands = S.attach_attrs(cands, docs, spec, [spec.age_col])
            cands = cands.withColumn("freshness_score", K.freshness_score(F.col(spec.age_col), p.now_s))
            return S.two_phase(cands.drop(spec.age_col), docs, spec, p, p1, p2 * F.col("freshness_score"),
                               recency=False)
        return S.two_phase(cands, docs, spec, p, p1, p2 * F.col("doc_recency") if rec else p2, recency=rec)
    if fam == "people":
        return S.two_phase(cands, docs, spec, p, cnr, K.boost(cnr, kw["factor"]), recency=False)
    if fam == "weighted_bm25":
        text = K.weighted([(w, F.col(f"bm25_{f}")) for f, w in TICKET_WEIGHTS.items() if f in spec.text_fields])
        score = K.hybrid(a, vs, text) if kw.get("vector") else text
        return S.one_phase(cands, spec, score, p)
    if fam == G:
        return _global_sorted(cands, docs, spec, p, kw, a, cnr)
    if fam == "attachment_rank":
        raise ValueError("file.attachmentRank needs text and image vectors: use search.attachment_search")
    raise ValueError(f"unknown family {fam}")


def feature_columns(schema: str, name: str, field_map: dict[str, str]) -> list[str]:
    """P10: the columns of ``rank`` that profile ``schema.name`` scores with, by its family: the parts of its formula and
    the score of each of its fields (``chunk_scores`` comes from ``profile_features``)."""
    fam, kw = profile(schema, name)
    sc = SCHEMAS[schema]
    fields = [f for f in [*sc.fields, *sc.meta, *sc.people, *sc.score_only] if f in field_map]
    native, bm25 = [f"native_{f}" for f in fields], [f"bm25_{f}" for f in fields]
    vector = ["vector_score"] if sc.vector and not kw.get("text_only") else []
    if fam == "autocomplete":
        return [f"bm25_{f}" for f in kw["fields"]]
    if fam == "query_log":
        return ["bm25_query_text"]
    if fam in ("weighted_bm25", "memory", "attachment_default"):
        return [*(["vector_score"] if fam != "weighted_bm25" or kw.get("vector") else []), *bm25]
    if fam == T:
        return [f"native_{f}" for f in kw["weights"] if f in field_map]
    if fam in ("name", "people"):
        return ["matched_field_count", *native]
    if fam == B:
        return [*vector, "combined_bm25", *bm25]
    if fam == A:
        return [*vector, "combined_nativeRank", *native]
    parts = ["matched_field_count", *vector, "combined_nativeRank", *native]
    if fam == G:
        used = ["relevance_used"] if kw["variant"] == "binned_clamped" else []
        return [*parts, "document_age_days", "recency_bin_index", "recency_bin_score", "hybrid_relevance", *used]
    return [*parts, "doc_recency"] if fam == N and kw.get("recency", True) else parts


def profile_features(ranked: DataFrame, queries: DataFrame, docs: DataFrame, schema: str, name: str, key: str,
                     field_map: dict[str, str], chunks: str | None = None) -> DataFrame:
    """P10: the rows of ``rank`` with a struct ``match_features`` of the profile's own features.  With ``chunks``, an array column of
    ``docs``, it holds ``chunk_scores``, a map from the places of matching chunks to their BM25: one row of a document
    gathers no more than its own chunks, and only ranked documents are scored."""
    cols = feature_columns(schema, name, field_map)
    if chunks is None:
        return S.match_features(ranked, cols)
    from sagebrush.operators.textindex import chunk_scores

    scores = chunk_scores(queries, docs, key, chunks).groupBy("query_id", key).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("p", "chunk_bm25")))).alias("chunk_scores"))
    return S.match_features(ranked.join(scores, ["query_id", key], "left"), [*cols, "chunk_scores"])


def _global_sorted(cands: DataFrame, docs: DataFrame, spec: S.DocSpec, p: S.Params, kw: dict, a: Column,
                   cnr: Column) -> DataFrame:
    from sagebrush.operators.windows import global_sorted

    cands = S.attach_attrs(cands, docs, spec, [spec.age_col])
    vs = F.col("vector_score") * (F.lit(C.VECTOR_DECAY) if kw.get("decay") else F.lit(1.0))
    text = cnr * F.lit(float(kw.get("text_factor", 1.0)))
    rel = K.hybrid(a, vs, text) if "text_factor" not in kw else text
    days = K.document_age_days(F.col(spec.age_col), p.now_s, kw.get("default_s", C.THREE_MONTHS_S))
    b = K.recency_bin_index(days, S.param(cands, "bin_size_days", p.bin_size_days))
    if kw["variant"] == "binned_clamped":
        mult, used = C.BIN_MULTIPLIER_CLAMPED, K.normalized_hybrid(rel, C.BIN_MULTIPLIER_CLAMPED)
    else:
        mult, used = C.BIN_MULTIPLIER_RAW, rel
    out = (cands.withColumn("document_age_days", days).withColumn("recency_bin_index", b)
           .withColumn("recency_bin_score", K.recency_bin_score(F.col("recency_bin_index"), mult))
           .withColumn("hybrid_relevance", rel).withColumn("relevance_used", used)
           .withColumn("score", F.col("recency_bin_score") + F.col("relevance_used")))
    return global_sorted(out, "recency_bin_index", "relevance_used", spec.key).drop(spec.age_col)
