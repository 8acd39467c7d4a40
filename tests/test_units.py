"""Known-answer, formula-edge and property tests (hand-made inputs + small fixtures)."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from testdata import SF001


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_tokens(spark):
    from sagebrush.functions.text import grams, tokens

    df = spark.createDataFrame([(1, "  Hello, World!! 42x "), (2, ""), (3, None), (4, "Élan--vité")], "id int, s string")
    got = dict(rows(df.select("id", tokens("s").alias("t")), "id", "t"))
    assert got == {1: ["hello", "world", "42x"], 2: [], 3: [], 4: ["élan", "vité"]}
    g = df.filter("id = 1").select(grams("s").alias("g")).first()["g"]
    assert g == ["hel", "ell", "llo", "wor", "orl", "rld", "42x"]


def _bm25_expected(docs, query):
    toks = [d.lower().split() for d in docs]
    n = len(docs)
    avg = sum(len(t) for t in toks) / n
    out = {}
    for i, t in enumerate(toks):
        s = 0.0
        for q in set(query.split()):
            tf = t.count(q)
            if not tf:
                continue
            df = sum(1 for x in toks if q in x)
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            s += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
        if s:
            out[i] = s
    return out


def test_bm25_known_answer(spark):
    from sagebrush.operators.textindex import bm25

    docs = ["the cat sat", "the dog", "cat cat cat dog", "bird", "the the the cat"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id int, body string")
    q = spark.createDataFrame([(1, "cat the")], "query_id int, qtext string")
    got = {r["doc_id"]: r["bm25"] for r in bm25(q, d, "doc_id", ["body"]).collect()}
    exp = _bm25_expected(docs, "cat the")
    assert set(got) == set(exp)
    for k in exp:
        assert got[k] == pytest.approx(exp[k], rel=1e-12)


def test_formula_edges(spark):
    from sagebrush.functions import scoring as K

    df = spark.createDataFrame([(None,), (1706745600000 + 86400000,), (1706745600000 - 31536000000,)], "ts long")
    r = df.select(K.document_age("ts").alias("a"), K.doc_recency(K.document_age("ts")).alias("r"),
                  K.document_age_days("ts").alias("d")).collect()
    assert r[0]["a"] == pytest.approx(7890000 / 31536000)
    assert r[1]["a"] == 0.0 and r[1]["r"] == 1.0          # future timestamp: age clamped at 0
    assert r[2]["a"] == pytest.approx(1.0)
    assert r[0]["d"] == pytest.approx(7890000 / 86400)
    one = spark.range(1).select(
        K.mean_over_matched([F.lit(0.0), F.lit(0.0)], [F.lit(0), F.lit(0)]).alias("m"),
        K.hybrid(0.0, F.lit(0.9), F.lit(0.2)).alias("h0"), K.hybrid(1.0, F.lit(0.9), F.lit(0.2)).alias("h1"),
        K.scale(F.lit(4.0)).alias("s"), K.normalized_hybrid(F.lit(1e9)).alias("nh")).first()
    assert one["m"] == 0.0 and one["h0"] == pytest.approx(0.2) and one["h1"] == pytest.approx(0.9)
    assert one["s"] == pytest.approx(2 * math.atan(1.0) / 3.14159)
    assert one["nh"] == 9999.0


def test_normalize_linear_equal_values(spark):
    from sagebrush.operators.windows import normalize_linear

    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (2, 3, 1.0), (2, 4, 3.0)], "query_id int, doc_id int, x double")
    got = {r["doc_id"]: r["n"] for r in normalize_linear(df, "x", "n").collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 0.0, 4: 1.0}


def _tiny_search(spark):
    from pyspark.sql import functions as F

    from sagebrush.functions.text import tokens
    from sagebrush.plans import search as S

    q = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0])], "query_id int, qtext string, e array<double>")
    data = [(10, "alpha beta", True, 1706000000000), (11, "alpha", True, 1600000000000), (12, "alpha alpha beta", False, None)]
    d = spark.createDataFrame(data, "doc_id int, title string, mine boolean, updatedAt long")
    v = spark.createDataFrame([(10, 0, [0.1, 0.9]), (11, 0, [0.5, 0.5]), (12, 0, [0.9, 0.1]), (99, 0, [1.0, 0.0])],
                              "doc_id int, p int, v array<double>")
    spec = S.DocSpec("doc_id", {"title": tokens("title"), "chunks": tokens("title")}, age_col="updatedAt")
    return S, q, d, v, spec, F


@pytest.mark.parametrize("profile", ["default_native", "default_ai", "default_bm25", "title_boosted_hybrid"])
def test_search_returns_visible_documents_whatever_hits(spark, profile):
    S, q, d, v, spec, F = _tiny_search(spark)
    for where, seen in ((None, {10, 11, 12}), (F.col("mine"), {10, 11})):
        found = []
        for hits in (None, 1, 2, 10):
            p = S.Params(target_hits=2, rerank_count=50, hits=hits, where=where)
            out = S.hybrid_search(q, d, v, p, spec, profile).orderBy("rank").collect()
            assert p.n_queries is None                       # the caller's object is left alone
            found.append([(r["doc_id"], round(r["score"], 9)) for r in out])
        assert {i for i, _ in found[0]} == seen              # 99 has a vector but no document
        assert found[1] == found[0][:1] and found[2] == found[0][:2] and found[3] == found[0]


def test_autocomplete_returns_visible_rows_only(spark):
    from sagebrush.plans import search as S

    parts = spark.createDataFrame([(1, "green apple", "a"), (2, "green pear", "b"), (3, "greenish", "b")], "p_partkey int, p_name string, owner string")
    q = spark.createDataFrame([(1, "green")], "query_id int, qtext string")
    found = S.autocomplete(q, parts, "p_partkey", ["p_name"], S.Params())
    own = S.autocomplete(q, parts, "p_partkey", ["p_name"], S.Params(where=F.col("owner") == "a"))
    assert sorted(r["p_partkey"] for r in found.collect()) == [1, 2, 3] and [r["p_partkey"] for r in own.collect()] == [1]
    kept = {r["p_partkey"]: r["combined_bm25"] for r in found.collect()}
    assert own.first()["combined_bm25"] == kept[1]      # statistics are those of all rows
    log = spark.createDataFrame([(1, "green tea", 1706000000000, 3, "a"), (2, "green bag", 1706000000000, 9, "b")], "qid int, query_text string, timestamp long, count long, owner string")
    mine = S.query_log_autocomplete(q, log, S.Params(where=F.col("owner") == "a"))
    assert [r["qid"] for r in mine.collect()] == [1] and S.query_log_autocomplete(q, log, S.Params()).count() == 2


def test_grouped_quantiles_are_exact_and_gather_nothing(spark):
    from sagebrush.operators.windows import grouped_quantiles

    rng = np.random.default_rng(9)
    data = [("hot", int(x)) for x in rng.integers(0, 50, 3000)] + [("cold", 5), (None, 7), (None, 8), ("none", None), ("two", 1), ("two", 2)]
    df = spark.createDataFrame(data, "g string, v int").repartition(7)
    got = {r["g"]: (r["p0"], r["p50"], r["p90"], r["p100"]) for r in grouped_quantiles(df, ["g"], "v", {"p0": 0.0, "p50": 0.5, "p90": 0.9, "p100": 1.0}).collect()}
    values = {}
    for g, v in data:
        values.setdefault(g, []).append(v)
    for g, own in values.items():
        own = [x for x in own if x is not None]
        want = tuple(float(np.percentile(own, p)) for p in (0, 50, 90, 100)) if own else (None,) * 4
        assert got[g] == pytest.approx(want) if own else got[g] == want
    assert set(got) == set(values)


def test_rank_change_counts_inversions(spark):
    from sagebrush.operators.vectors import from_bfloat16, rank_change, to_bfloat16

    a = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "a", 1)], "query_id int, doc_id string, nn_rank int")
    b = spark.createDataFrame([(1, "c", 1), (1, "a", 2), (1, "d", 3), (2, "a", 1)], "query_id int, doc_id string, nn_rank int")
    assert sorted(rows(rank_change(a, b, 3), "query_id", "kept", "left", "displaced", "largest_shift", "inversions")) == [(1, 2, 1, 3, 2, 1), (2, 1, 0, 0, 0, 0)]
    v = spark.createDataFrame([(1, [1.0, -2.5, 1.00390625, 3e38, 1e-40]), (2, None)], "id int, embedding array<float>")
    back = {r["id"]: r["back"] for r in from_bfloat16(to_bfloat16(v), out="back").collect()}
    assert back[2] is None and back[1][:3] == [1.0, -2.5, 1.0]
    assert to_bfloat16(v).filter("id = 1").select(F.length("embedding_b2")).first()[0] == 10


def test_vector_candidates_are_filtered_before_the_cut(spark):
    S, q, d, v, spec, F = _tiny_search(spark)
    p = S.Params(target_hits=1, where=F.col("mine"))
    assert [r["doc_id"] for r in S.vector_candidates(q, v, d, spec, p, "p").collect()] == [11]


def test_folder_tree_of_any_depth_and_with_cycles(spark):
    from sagebrush.operators.relations import folder_tree

    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(40)], "folder_id int, parent_id int")
    assert sorted(rows(folder_tree(chain), "folder_id", "depth")) == [(i, i) for i in range(40)]
    long_chain = spark.range(10_000).select(F.col("id").alias("folder_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    folders = []
    original = type(long_chain).checkpoint
    try:
        type(long_chain).checkpoint = lambda self, *a, **b: folders.append(1) or original(self, *a, **b)
        deep = folder_tree(long_chain)
    finally:
        type(long_chain).checkpoint = original
    assert deep.filter("depth = folder_id").count() == 10_000 == deep.count()
    assert len(folders) <= 30       # fourteen rounds of doubling and the last
    # several parents, and roots inside another root's tree
    net = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (5, 1)], "folder_id int, parent_id int")
    inner = spark.createDataFrame([(1,), (2,), (9,)], "root_id int")
    assert sorted(tuple(r) for r in folder_tree(net, roots=inner).collect()) == [
        (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 1), (2, 2, 0), (2, 4, 1), (2, 5, 2), (9, 9, 0)]
    ring = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "folder_id int, parent_id int")
    roots = spark.createDataFrame([(1,)], "root_id int")
    assert sorted(rows(folder_tree(ring, roots=roots), "folder_id", "depth")) == [(1, 0), (2, 1), (3, 2)]


def test_nn_exact_in_query_blocks(spark, monkeypatch):
    from sagebrush.operators import vectors as V

    rng = np.random.default_rng(5)
    q = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(30)], "query_id int, e array<double>")
    v = spark.createDataFrame([(i % 40, i // 40, rng.normal(size=8).tolist()) for i in range(120)], "doc_id int, p int, v array<double>").repartition(4)
    whole = sorted(rows(V.nn_exact(q, v, 5, part="p"), "query_id", "doc_id", "p", "nn_rank"))
    every = {}
    for r in V.closeness_all(q, v, part="p").collect():
        every.setdefault(r["query_id"], []).append((-r["closeness"], r["doc_id"], r["p"]))
    assert whole == sorted((i, d, p, n) for i, x in every.items() for n, (_, d, p) in enumerate(sorted(x)[:5], 1))
    for size in (200, 700, 1 << 20):    # blocks of 3, 10 and all rows
        monkeypatch.setattr(V, "BLOCK_BYTES", size)
        assert sorted(rows(V.nn_exact(q, v, 5, part="p"), "query_id", "doc_id", "p", "nn_rank")) == whole
    equal = spark.createDataFrame([(i, [1.0, 2.0, 3.0] if i % 2 else [3.0, 1.0, 0.5]) for i in range(60)] + [(99, None)], "doc_id int, v array<float>").repartition(5)
    same = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None)], "query_id int, e array<double>")
    assert sorted(rows(V.nn_exact(same, equal, 7), "doc_id", "nn_rank")) == [(2 * i + 1, i + 1) for i in range(7)]     # ties by key
    assert V.nn_exact(same.filter("false"), equal, 7).count() == 0 and V.nn_exact(same, equal.filter("false"), 7).count() == 0


def test_nn_exact_of_many_wide_queries(spark):
    from sagebrush.operators import vectors as V

    # 8,192 queries of width 1,024 are 64 MB: sixteen blocks, none of which passes the driver
    q = spark.range(8192).select(F.col("id").alias("query_id"), F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.hash(F.col("id"), i) / F.lit(2.0**31)).alias("e"))
    v = q.filter("query_id % 97 = 0").select((F.col("query_id") * 10).alias("doc_id"), F.col("e").alias("v"))
    got = V.nn_exact(q, v, 2)
    own = got.filter("doc_id = query_id * 10 AND nn_rank = 1 AND closeness > 0.999999").count()
    assert got.count() == 2 * 8192 and own == v.count()


def test_embed_requests_fail_as_a_whole(spark):
    from sagebrush.operators.embedding_jobs import embed_requests

    def upstream(key, inputs, model):
        request, batch = key.split(":")
        data = [{"index": i, "embedding": [1.0, 2.0]} for i in range(len(inputs))]
        body = {"data": data, "model": "other"}
        if request == "1" and batch == "1":
            return 500, {"error": {"message": "broken"}}, {}
        if request == "2":
            return 200, {"object": "list"}, {}
        if request == "3" and batch == "0":
            return 200, {"data": data[1:]}, {}
        if request == "5":
            return 200, {"data": []}, {}
        return 201, body, {}

    bodies = [(i, '{"input": ["a", "b", "c"], "model": "asked"}') for i in (1, 2, 3, 4, 5)] + [(6, '{"input": "x"}')]
    df = spark.createDataFrame(bodies, "request_id long, body string")
    vecs, summ, _ = embed_requests(df, upstream, batch_size=2, max_retries=1, sleep=lambda s: None)
    assert sorted(rows(vecs, "request_id", "index")) == [(4, 0), (4, 1), (4, 2), (6, 0)]
    got = {r["request_id"]: (r["http_status"], r["model"], r["error"]) for r in summ.collect()}
    assert got[1][::2] == (500, "broken") and got[2][0] == 502 and got[3][0] == 502 and got[5][0] == 502
    assert got[4] == (200, "asked", None) and got[6] == (200, "other", None)


def test_overload_phrase_is_retried_whatever_the_status(spark):
    from sagebrush.operators.embedding_jobs import embed_requests

    calls = {}

    def upstream(key, inputs, model):
        calls[key] = calls.get(key, 0) + 1
        if calls[key] == 1:
            return 200, {"error": "Model overloaded"}, {}
        return 200, {"data": [{"embedding": [1.0]} for _ in inputs]}, {}

    df = spark.createDataFrame([(1, '{"input": ["a"]}')], "request_id long, body string")
    vecs, summ, _ = embed_requests(df, upstream, sleep=lambda s: None)
    assert vecs.count() == 1 and summ.first()["http_status"] == 200


def test_candidates_symmetric(spark):
    from sagebrush.operators.windows import candidates

    lex = spark.createDataFrame([(1, 1, 2.0), (1, 2, 1.0)], "query_id int, doc_id int, bm25 double")
    vec = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.4)], "query_id int, doc_id int, vs double")
    a = {(r["doc_id"], r["bm25"], r["vs"]) for r in candidates(lex, vec).collect()}
    b = {(r["doc_id"], r["bm25"], r["vs"]) for r in candidates(vec, lex).collect()}
    assert a == b == {(1, 2.0, 0.0), (2, 1.0, 0.5), (3, 0.0, 0.4)}


def test_relabel_known_answer(spark):
    from sagebrush.operators.logs import container_rules, relabel

    data = [("/app-web", "bridge", "0123456789abcdef", "web", "org/web:1", "stdout"),
            ("/x-app-db", "bridge", "abcdefabcdefabcd", None, "postgres:16", "stderr"),
            ("/loki", "host", "111111111111", "", "grafana/loki:3", "stdout"),
            ("/grafana", "bridge", "2222222222223333", None, "grafana/grafana", "stdout"),
            ("/random", "bridge", "3333333333334444", "svc", "busybox", "stdout"),
            ("/promtail", "none", "short", None, "promtail:latest", "stdout"),
            ("/postgres-main", "bridge", "4444444444445555", "pg", "postgres", "stdout")]
    df = spark.createDataFrame(data, "container_name_raw string, network_mode string, container_id_raw string, "
                                     "compose_service string, docker_image string, log_stream string")
    out = {r["container_name_raw"]: (r["service"], r["container_id"], r["image"])
           for r in relabel(df, container_rules("app")).collect()}
    assert set(out) == {"/app-web", "/x-app-db", "/loki", "/grafana", "/promtail", "/postgres-main"}
    assert out["/app-web"] == ("web", "0123456789ab", "org/web")
    assert out["/x-app-db"] == ("x-app-db", "abcdefabcdef", "postgres")
    assert out["/loki"] == ("loki", "111111111111", "grafana/loki")
    assert out["/promtail"] == ("promtail", None, "promtail")      # id shorter than 12: label not set


def test_route_of(spark):
    from sagebrush.operators.logs import route_of

    paths = {"/keycloak": "keycloak_exact", "/keycloak/x.js": "keycloak", "/twirp/a": "twirp",
             "/validate": "twirp", "/app.css": "static", "/grafana/x.js": "grafana", "/grafana": "grafana_exact",
             "/api/x": "api", "/apix": "root", "/health": "health", "/rtc/room": "rtc", "/": "root",
             "/auth/login": "auth", "/api/x.png": "static"}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: r["r"] for r in df.select("path", route_of("path").alias("r")).collect()}
    assert got == paths


def test_host_in_list(spark):
    from sagebrush.operators.relations import host_in_list

    urls = [(1, "https://example.com/a"), (2, "http://a.example.com"), (3, "http://example.net"),
            (4, "http://b.example.net/x"), (5, "http://localhost:8080/"), (6, "http://localhost/"),
            (7, "http://user:pw@sub.example.com:9/x"), (8, "http://notexample.com")]
    df = spark.createDataFrame(urls, "id int, url string")
    rules = spark.createDataFrame([("example.com",), (".example.net",), ("localhost:8080",)], "rule string")
    got = sorted(r["id"] for r in host_in_list(df, "id", "url", rules).collect())
    assert got == [1, 2, 4, 5, 7]
    star = spark.createDataFrame([("*",)], "rule string")
    assert host_in_list(df, "id", "url", star).count() == 8


def test_retry_delay(spark):
    from sagebrush.operators.embedding_jobs import _retry_delay_py, retry_delay_ms

    df = spark.createDataFrame([(0, "2", "k"), (3, None, "k"), (10, "x", "k")], "a int, ra string, k string")
    got = [r["d"] for r in df.select(retry_delay_ms(F.col("a").cast("double"), "ra", F.col("k")).alias("d")).collect()]
    assert got[0] == 2000.0
    assert 8000.0 <= got[1] < 9000.0 and got[1] == _retry_delay_py(3, None, "k")
    assert 60000.0 <= got[2] < 61000.0


def test_requests_over_limit(spark):
    from sagebrush.streaming.pipelines import requests_over_limit

    df = spark.sql("SELECT 'a' AS k, timestamp_seconds(id * 10) AS t FROM range(9) UNION ALL SELECT 'b', timestamp_seconds(0)")
    got = {(r["key"], r["window_start"]): (r["requests"], r["over"]) for r in requests_over_limit(df, "k", "t", 3, 1).collect()}
    assert got == {("a", 0): (6, 2), ("a", 60): (3, 0), ("b", 0): (1, 0)}


def test_upsert_of_rows_with_a_map(spark):
    from sagebrush.sources.writers import upsert_latest

    base = spark.sql("SELECT 1 AS docId, 5 AS updatedAt, map('a', 1) AS m UNION ALL SELECT 2, 5, map()")
    change = spark.sql("SELECT 1 AS docId, 5 AS updatedAt, map('b', 2) AS m")
    got = {r["docId"]: r["m"] for r in upsert_latest(base, change).collect()}
    assert got == {1: {"b": 2}, 2: {}}


def test_batches_round_trip(spark):
    from sagebrush.operators.embedding_jobs import assign_batches, merge_batches

    inputs = [(1, [f"t{i}" for i in range(7)]), (2, ["x"])]
    df = spark.createDataFrame(inputs, "request_id long, inputs array<string>")
    b = assign_batches(df, size=3)
    items = b.select("request_id", "batch", "start",
                     F.count(F.lit(1)).over(__import__("pyspark.sql").sql.Window.partitionBy("request_id", "batch"))
                     .alias("input_count"), F.col("local_index").alias("resp_pos"),
                     F.col("local_index").alias("item_index"), F.array(F.lit(0.0)).alias("embedding"),
                     F.lit("m").alias("model"), "input")
    merged, summary = merge_batches(items)
    got = sorted(rows(merged, "request_id", "index", "input"))
    assert got == sorted([(r, i, t) for r, ts in inputs for i, t in enumerate(ts)])
    assert {r["request_id"]: r["length_mismatch"] for r in summary.collect()} == {1: 0, 2: 0}


def test_embed_requests_matches_embedder(spark):
    from sagebrush.operators.embedding_jobs import EmbedderUpstream, embed_requests
    from sagebrush.operators.vectors import HashingEmbedder

    bodies = [(1, '{"input": ["a b", "b c", "c d", "d e"], "model": "m"}'), (2, '{"input": "solo text"}'),
              (3, '{"input": []}'), (4, "{bad")]
    df = spark.createDataFrame(bodies, "request_id long, body string")
    emb = HashingEmbedder(16)
    up = EmbedderUpstream(emb, fail_first=lambda k: k == "1:0")
    vecs, summ, bad = embed_requests(df, up, batch_size=3, expected_dims=16, sleep=lambda s: None)
    got = {(r["request_id"], r["index"]): r["embedding"] for r in vecs.collect()}
    exp_inputs = {(1, 0): "a b", (1, 1): "b c", (1, 2): "c d", (1, 3): "d e", (2, 0): "solo text"}
    assert set(got) == set(exp_inputs)
    for k, text in exp_inputs.items():
        assert np.allclose(got[k], emb.embed([text])[0])
    assert sorted(r["request_id"] for r in bad.collect()) == [3, 4]
    assert {r["request_id"]: r["http_status"] for r in summ.collect()} == {1: 200, 2: 200}


def test_upsert_idempotent(spark):
    from sagebrush.sources.writers import upsert_latest

    base = spark.createDataFrame([(1, 10, "a"), (2, 10, "b")], "k int, ts int, v string")
    ch = spark.createDataFrame([(1, 11, "a2"), (2, 9, "old"), (3, 1, "c")], "k int, ts int, v string")
    once = upsert_latest(base, ch, "k", "ts")
    twice = upsert_latest(once, ch, "k", "ts")
    assert sorted(rows(once, "k", "ts", "v")) == sorted(rows(twice, "k", "ts", "v")) == [
        (1, 11, "a2"), (2, 10, "b"), (3, 1, "c")]


def test_bfloat16():
    from sagebrush.operators.vectors import bfloat16_round

    x = np.array([1.0, 1.00390625, 1.005859375, -3.14159], dtype=np.float32)
    y = bfloat16_round(x)
    assert y[0] == 1.0 and y[1] == 1.0            # tie to even
    assert y[2] == np.float32(1.0078125)
    assert abs(y[3] - x[3]) < 0.02


def test_nn_approx_recall(spark):
    from sagebrush.operators import vector_index as X
    from sagebrush.operators.vectors import nn_exact
    from sagebrush.sources.tables import view

    large = "/root/testdata/sf0.1"
    q, v = view(spark, large, "vector_queries_v"), view(spark, large, "doc_vectors_v")
    exact = {(r["query_id"], r["doc_id"]) for r in nn_exact(q, v, 20).collect()}
    index = X.build_index(v)
    assert index.blocks.agg(F.sum("n")).first()[0] == v.count()        # every row is in the index
    found = X.search(index, q, v, 20)
    got = {(r["query_id"], r["doc_id"]): r for r in found.collect()}
    assert len(got) == len(exact) and len(exact & set(got)) / len(exact) >= 0.9    # the registered parameters
    read = X.candidates(index, q, 20).groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert read <= 0.2 * v.count()
    # all cells and all rows read is the exact search
    whole = X.search(index, q, v, 20, probed_share=1.0, rerank=v.count())
    assert {(r["query_id"], r["doc_id"]) for r in whole.collect()} == exact


def test_vector_index_odd_rows(spark, tmp_path):
    from sagebrush.operators import vector_index as X

    rng = np.random.default_rng(2)
    data = [(i // 2, i % 2, rng.normal(size=6).tolist()) for i in range(200)] + [(500 + i, 0, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(150)]
    data += [(900, 0, None), (901, 0, []), (902, 0, [0.0] * 6)]
    v = spark.createDataFrame(data, "doc_id long, p int, v array<double>").repartition(3)
    q = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), ("b", None)], "query_id string, e array<double>")
    index = X.build_index(v, part="p", cells=8, path=f"{tmp_path}/index")
    assert index.blocks.agg(F.sum("n")).first()[0] == 351
    got = X.search(index, q, v, 5, probed_share=0.5).orderBy("nn_rank").collect()
    assert [(r["query_id"], r["doc_id"], r["nn_rank"]) for r in got] == [("a", 500 + i, i + 1) for i in range(5)]
    assert X.build_index(v.filter("false")) is None and X.nn_approx(q, v.filter("false"), 3).count() == 0
    assert X.search(index, q.filter("false"), v, 5).count() == 0


def test_folder_tree_depths(spark):
    from sagebrush.operators.relations import folder_tree
    from sagebrush.sources.tables import view

    t = folder_tree(view(spark, SF001, "folders_v"))
    depth = dict(rows(t.groupBy("depth").count(), "depth", "count"))
    assert depth[0] == 5 and depth[1] == 25


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_scale_shape(spark):
    from sagebrush.plans import load_catalog

    qs, _ = load_catalog()
    j1 = _plan(qs["J1_import_parent"](spark, SF001))
    assert "BroadcastHashJoin" in j1 or "BroadcastExchange" in j1
    for name in ["A3_bm25", "R1_hybrid_search", "J3_nn_exact", "F11_host_in_list", "J6_acl_semi"]:
        p = _plan(qs[name](spark, SF001))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
    # filters reach the parquet scan
    f1 = qs["F1_exact"](spark, SF001)
    assert "PushedFilters: [IsNotNull(source), EqualTo(source,src3)]" in _plan(f1)


def test_profile_registry_complete():
    from sagebrush.plans.profiles import PROFILES, SCHEMAS

    assert len(PROFILES) == 91
    families = {"initial", "native", "bm25", "ai", "random", "global_sorted", "title_boosted", "autocomplete",
                "sort_attr", "attachment_default", "attachment_rank", "memory", "name", "people", "weighted_bm25",
                "query_log"}
    assert {f for f, _ in PROFILES.values()} <= families
    assert {s for s, _ in PROFILES} == set(SCHEMAS)


def test_size_estimate_and_spread(spark):
    from sagebrush.session import broadcast_if_small, estimated_bytes, spread

    d = spark.read.parquet(f"{SF001}/documents.parquet")
    assert 0 < estimated_bytes(d) < 1 << 40
    assert spread(d).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert "ResolvedHint" in broadcast_if_small(spark.read.parquet(f"{SF001}/region.parquet"))._jdf.queryExecution() \
        .analyzed().toString()


def test_bounded_hits_equal_full_ranking_head(spark):
    from sagebrush.plans import search as S
    from sagebrush.sources.tables import view

    q, d, v = view(spark, SF001, "queries_v"), view(spark, SF001, "files_v"), view(spark, SF001, "chunk_vectors_v")
    full = S.hybrid_search(q, d, v, S.Params(target_hits=20, rerank_count=50))
    head = S.hybrid_search(q, d, v, S.Params(target_hits=20, rerank_count=50, hits=10))
    a = sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in full.filter("rank <= 10").collect())
    b = sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in head.collect())
    assert a == b
    plan = head._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_distributed_rank_equals_row_number(spark):
    from pyspark.sql import Window

    from sagebrush.operators.windows import distributed_rank

    rng = np.random.default_rng(3)
    # query 1 is hot (most rows), scores with many ties, NULLs included
    data = [(1 if i % 10 else int(rng.integers(2, 5)), i, float(rng.integers(0, 20)) if i % 17 else None)
            for i in range(3000)]
    df = spark.createDataFrame(data, "query_id int, doc_id int, s double")
    got = distributed_rank(df, [F.col("s").desc_nulls_last()], "doc_id", partitions=7)
    w = Window.partitionBy("query_id").orderBy(F.col("s").desc_nulls_last(), F.col("doc_id").asc())
    exp = df.withColumn("rank", F.row_number().over(w))
    assert sorted(rows(got, "query_id", "doc_id", "rank")) == sorted(rows(exp, "query_id", "doc_id", "rank"))


def test_merge_into_a_bucketed_base_does_not_shuffle_it(spark):
    from sagebrush.sources.writers import merge_bucketed, upsert_latest, write_bucketed

    base = spark.createDataFrame([(i, i * 10, f"b{i}") for i in range(50)] + [(99, None, "no time")], "docId long, updatedAt long, v string")
    changes = spark.createDataFrame([(1, 5, "older"), (2, 20, "tie"), (3, 31, "new"), (3, 30, "less new"), (60, 1, "added"), (99, 1, "timed"), (4, None, "untimed")],
                                    "docId long, updatedAt long, v string")
    write_bucketed(base, "base_of_test", buckets=4)
    merged = merge_bucketed(spark, "base_of_test", changes, buckets=4)
    got = {r["docId"]: r["v"] for r in merged.collect()}
    assert (got[1], got[2], got[3], got[60], got[99], got[5]) == ("b1", "tie", "new", "added", "timed", "b5") and len(got) == 52
    timed = changes.filter("updatedAt IS NOT NULL AND docId <> 99")
    want = {r["docId"]: r["v"] for r in upsert_latest(base, timed).collect()}
    assert {k: v for k, v in got.items() if k not in (4, 99)} == {k: v for k, v in want.items() if k not in (4, 99)}
    # above the scan of the base there is a join, and no exchange between
    plan = _plan(merged).splitlines()
    at = next(i for i, line in enumerate(plan) if "FileScan parquet" in line and "base_of_test" in line)
    join = max(i for i in range(at) if "SortMergeJoin" in plan[i])
    assert not any("Exchange" in line for line in plan[join:at]) and "Bucketed: true" in plan[at]
    spark.sql("DROP TABLE base_of_test")


def test_change_log_is_compacted(spark, tmp_path):
    from sagebrush.streaming import pipelines as ST

    feed, log, ck = (f"{tmp_path}/{x}" for x in ("feed", "log", "ck"))
    schema = "k long, ts long, v string"
    for n, rows_ in enumerate(([(1, 1, "a"), (2, 1, "b")], [(1, 3, "c")], [(1, 2, "late"), (3, 1, "d")], [(2, 1, "tie")])):
        spark.createDataFrame(rows_, schema).write.mode("append").parquet(feed)
        ST.stream_upsert(spark.readStream.schema(schema).parquet(feed), log, ck)
        if n in (1, 3):
            ST.compact_changes(spark, log, "k", "ts")
            ST.compact_changes(spark, log, "k", "ts")        # again: nothing to do
    got = sorted(rows(ST.read_changes(spark, log), "k", "ts", "v"))
    assert got == [(1, 3, "c"), (2, 1, "tie"), (3, 1, "d")]
    assert len([p for p in (tmp_path / "log").iterdir() if p.is_dir()]) == 1


@pytest.mark.parametrize("most", [1, 3])
def test_calls_in_flight_are_bounded(spark, most):
    import json

    from sagebrush.operators.embedding_jobs import embed_requests

    def upstream(key, inputs, model):       # tells when each call began and ended
        import time

        began = time.time()
        time.sleep(0.3)
        data = [{"index": i, "embedding": [1.0]} for i in range(len(inputs))]
        return 200, {"data": data, "model": "m", "usage": {"began": began, "ended": time.time()}}, {}

    bodies = spark.createDataFrame([(i, json.dumps({"input": ["a", "b"]})) for i in range(12)], "request_id long, body string").repartition(8)
    _, summary, _ = embed_requests(bodies, upstream, in_flight=most)
    spans = [(r["usage"]["began"], r["usage"]["ended"]) for r in summary.select("usage").collect()]
    assert len(spans) == 12
    assert max(sum(a <= t < b for a, b in spans) for t, _ in spans) <= most


def test_a_call_without_an_answer_times_out(spark):
    import json

    from sagebrush.operators.embedding_jobs import CallTimeout, call_within, embed_requests

    def slow(key, inputs, model):
        import time

        time.sleep(5)

    with pytest.raises(CallTimeout):
        call_within(slow, 50, "k", [], None)
    with pytest.raises(ZeroDivisionError):
        call_within(lambda: 1 / 0, 1000)
    bodies = spark.createDataFrame([(1, json.dumps({"input": "a"}))], "request_id long, body string")
    emb, summary, _ = embed_requests(bodies, slow, max_retries=1, sleep=lambda s: None, timeout_ms=100)
    row = summary.first()
    assert emb.count() == 0 and "did not answer" in row["error"] and row["http_status"] == 502


def test_line_rate_throttle(spark, tmp_path):
    """Batches keep to the burst, lines come once and in order, also over a restart, growing, truncated and unfinished files."""
    import time

    from sagebrush.streaming import pipelines as ST

    src, sink, ck = tmp_path / "logs", str(tmp_path / "sink"), str(tmp_path / "ck")
    src.mkdir()
    (src / "a.log").write_text("".join(f"a{i}\n" for i in range(95)) + "unfinished")
    (src / "b.log").write_bytes("".join(f"b{i} \u00e4\r\n" for i in range(30)).encode())
    (src / "other.txt").write_text("no\n")

    def run():
        ST.run_batches_to_versions(ST.throttled_log_stream(spark, str(src), ck, rate=100, burst=20, glob="*.log"), sink, ck)
        return sorted((r._batch, r.line) for r in spark.read.parquet(sink).collect())

    began = time.monotonic()
    first = run()
    sizes = collections.Counter(b for b, _ in first)
    assert max(sizes.values()) <= 20 and len(sizes) >= 7
    assert time.monotonic() - began >= (125 - 20) / 100     # the rate holds over all batches
    assert sorted(x for _, x in first) == sorted([f"a{i}" for i in range(95)] + [f"b{i} \u00e4" for i in range(30)])
    with open(src / "a.log", "a") as f:
        f.write(" now\nlast\n")
    (src / "b.log").write_text("again\n")
    both = run()        # a new reader: nothing is read twice
    assert set(first) <= set(both)
    assert sorted(x for _, x in both) == sorted([x for _, x in first] + ["unfinished now", "last", "again"])
    assert run() == both


def test_typed_documents(spark, tmp_path):
    from sagebrush import schemas as SC
    from sagebrush.sources import writers as WR

    mails = spark.createDataFrame([("m1", {"a": "1"}, 5, "inbox")], "docId string, userMap map<string, string>, `timestamp` int, app string")
    WR.write_docs(mails, str(tmp_path / "m"), doc_type="mail")
    back = WR.read_docs(spark, str(tmp_path / "m"), doc_type="mail")
    assert back.schema.simpleString() == SC.declared("mail").simpleString()
    row = back.first()
    assert (row.docId, row.userMap, row["timestamp"], row.app, row.subject, row.chunk_embeddings) == ("m1", {"a": "1"}, 5, "inbox", None, None)
    for bad in (mails.withColumn("extra", F.lit(1)), mails.withColumn("subject", F.lit(1))):
        with pytest.raises(ValueError, match="not a mail"):
            WR.write_docs(bad, str(tmp_path / "bad"), doc_type="mail")
    with pytest.raises(ValueError, match="not declared"):
        WR.read_docs(spark, str(tmp_path / "m"), doc_type="unknown")
    SC.declare("team", "docId string, boxes array<struct<x: int, y: int>>, v map<int, array<float>>")
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "x.json").write_text('{"docId":"1","boxes":[{"x":1,"y":2}],"more":1}\n{"docId":"2","boxes":"none"}\n{"docId":"3","v":{"one":[1.0]}}\n{"docId":"4","v":{"7":[0.5]}}\n{"boxes":[]}\n\n{"docId":\n{}\n')
    good, wrong = WR.read_feed(spark, str(feed), "team")
    assert good.schema.simpleString() == SC.declared("team").simpleString()
    assert sorted((r.docId, r.boxes and r.boxes[0].y, r.v) for r in good.collect()) == [("1", 2, None), ("4", None, {7: [0.5]})]
    reasons = collections.Counter((r.value, r.reason) for r in wrong.collect())
    assert reasons == {('{"docId":"2","boxes":"none"}', "malformed"): 1, ('{"docId":"3","v":{"one":[1.0]}}', "malformed"): 1,
                       ('{"boxes":[]}', "no docId"): 1, ("", "malformed"): 1, ('{"docId":', "malformed"): 1, ("{}", "no docId"): 1}
    assert good.select("docId").count() == 2        # whichever column is read


@pytest.mark.parametrize("limit", [0, 1 << 26])
def test_permission_classes(spark, monkeypatch, limit):
    """A principal that all documents hold, by both kinds of join, against plain sets."""
    from sagebrush.operators import relations as RL

    monkeypatch.setattr(RL, "BROADCAST_LIMIT_BYTES", limit)
    lists = [["all"], ["all", "x"], ["x", "all", "x"], ["y"], [], None, ["nobody"], ["all", None]]
    docs = spark.createDataFrame([(i, lists[i % 8 if i % 3 else 0]) for i in range(400)], "id long, perms array<string>")
    grants = [("u1", "all"), ("u2", "x"), ("u2", "all"), ("u3", "y"), ("u3", "y"), ("u4", None)]
    got = RL.acl_semi(docs, "id", "perms", spark.createDataFrame(grants, "user string, principal string")).collect()
    want = {(u, r.id) for r in docs.collect() for u, p in grants if p is not None and p in (r.perms or [])}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_chunk_provenance_by_place_and_by_search(spark):
    """Metadata in order, out of order, with gaps, repeats and none; a null array of chunks has no rows."""
    from sagebrush.operators.derive import chunk_provenance

    rows_ = [(1, ["a", "b"], [(0, "x"), (1, "y")]), (2, ["a", "b", "c"], [(2, "z"), (0, "x"), (0, "w")]), (3, ["a"], None),
             (4, [], [(0, "x")]), (5, None, [(0, "x")]), (6, ["a"], [(None, "n")]), (7, ["a"], [None])]
    df = spark.createDataFrame(rows_, "k int, chunks array<string>, meta array<struct<chunk_index: int, label: string>>")
    out = chunk_provenance(df, "k", "chunks", "meta")
    assert "Exchange" not in out._jdf.queryExecution().toString()
    assert sorted(rows(out, "k", "chunk_index", "chunk", "label"), key=str) == sorted([
        (1, 0, "a", "x"), (1, 1, "b", "y"), (2, 0, "a", "x"), (2, 0, "a", "w"), (2, 1, "b", None), (2, 2, "c", "z"),
        (3, 0, "a", None), (6, 0, "a", None), (7, 0, "a", None)], key=str)


def test_feature_columns_of_profiles():
    from sagebrush.plans.profiles import PROFILES, feature_columns

    assert feature_columns("file", "default_native", {"title": "t", "chunks": "b"}) == [
        "matched_field_count", "vector_score", "combined_nativeRank", "native_title", "native_chunks", "doc_recency"]
    assert feature_columns("user", "default_native", {"name": "n", "email": "e"}) == ["matched_field_count", "native_name", "native_email"]
    assert feature_columns("event", "title_boosted_hybrid", {"name": "n", "description": "d"}) == ["native_name"]
    assert feature_columns("file", "autocomplete", {"title": "t"}) == ["bm25_title"]
    assert feature_columns("chat_message", "default_bm25", {"text": "b"}) == ["vector_score", "combined_bm25", "bm25_text"]
    assert all(isinstance(feature_columns(s, n, {}), list) for s, n in PROFILES)


def test_approximate_scan_keeps_one_running_best(spark, monkeypatch):
    import pandas as pd

    from sagebrush.operators import vector_index as VI

    rng = np.random.default_rng(3)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "doc_id int, v array<double>").repartition(12)
    index = VI.build_index(v, cells=4)
    assert index.blocks.count() == 4        # the blocks of twelve tasks are one a cell
    # a slice of three queries (two with one id) over five blocks of a cell, with equal codes
    books = index.codebooks
    codes = rng.integers(0, 6, size=(50, 2)).astype(np.uint8)
    q, places, ids = rng.normal(size=(3, 8)), np.array([0, 4, 7]), np.array([5, 5, 9])
    at = [slice(a, a + 10) for a in range(0, 50, 10)]
    monkeypatch.setattr(VI, "SCORED", 12)
    pairs = pd.DataFrame([{"cell": 1, "qb": 8, "places": places, "query_id": ids, "qm": q.tobytes(), "keys": np.arange(50)[s][::-1], "parts": np.zeros(10, dtype=int),
                           "codes": codes[s][::-1].tobytes()} for s in at])
    got = pd.concat(VI._scan(index.centroids, books, 4)(iter([pairs[:2], pairs[2:]])))
    rest = q - index.centroids[1]
    far = np.array([[sum(((books[g][c[g]] - rest[i, 4 * g:4 * g + 4]) ** 2).sum() for g in range(2)) for c in codes] for i in range(3)])
    want = sorted((int(ids[i]), int(k)) for i in range(3) for k in np.lexsort((np.arange(50), far[i]))[:4])
    assert sorted(zip(got["query_id"].tolist(), got["keys"].tolist(), strict=True)) == want


def test_products_of_full_blocks_are_bounded(monkeypatch):
    import tracemalloc

    from sagebrush.operators import vectors as V

    rng = np.random.default_rng(4)
    q, v, keys, parts = rng.normal(size=(4000, 4)), rng.normal(size=(4000, 4)), np.arange(4000) // 2, np.arange(4000) % 2
    tracemalloc.start()
    found = V._best_pairs(q, v, keys, parts, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6         # the whole product alone is 128 MB
    monkeypatch.setattr(V, "_PRODUCT", 1 << 30)
    for a, b in zip(found, V._best_pairs(q, v, keys, parts, 3), strict=True):
        assert (a == b).all()


def test_token_table_shuffles_documents_not_tokens(spark, capsys):
    from sagebrush.functions.text import tokens
    from sagebrush.operators.textindex import token_table

    d = spark.createDataFrame([(1, "a b a"), (1, "b a c"), (None, "a"), (None, "a"), (2, None), (3, "")], "doc_id int, t string")
    table = token_table(d, "doc_id", {"t": tokens("t")})
    table.explain()
    exchanges = [x for x in capsys.readouterr().out.splitlines() if "Exchange" in x and "AQE" not in x]
    assert len(exchanges) == 1 and "token" not in exchanges[0]
    got = collections.Counter(rows(table, "doc_id", "token", "tf", "first_pos", "len"))
    assert got == collections.Counter([(1, "a", 3, 0, 3), (1, "b", 2, 0, 3), (1, "c", 1, 2, 3), (None, "a", 2, 0, 1)])


def test_embedding_holds_little(spark, monkeypatch):
    from sagebrush.operators import vectors as V

    monkeypatch.setattr(V, "MEMO_TOKENS", 3)
    small, whole = V.HashingEmbedder(16), ["a b c d e f a", "f g", None, ""]
    got = small.embed(whole)
    assert len(small._memo) == 3
    monkeypatch.undo()
    assert (got == V.HashingEmbedder(16).embed(whole)).all()

    class Sizes:
        def embed(self, texts):
            return np.full((len(texts), 1), float(len(texts)))

    d = spark.range(40, numPartitions=1).select("id", F.repeat(F.lit("x"), 1 << 20).alias("t"))
    monkeypatch.setattr("sagebrush.operators.vectors.spread", lambda df: df)
    most = V.embed_text(d, "t", Sizes()).agg(F.max(F.col("embedding")[0]), F.count("*")).first()
    assert most[0] <= 10 and most[1] == 40      # 40 MB of text in one task come a few MB at a time


def test_stream_copy_feeds_all_cores(spark, tmp_path):
    from sagebrush.plans.catalog_streaming import _stream_copy
    from sagebrush.streaming import pipelines as ST

    stream = _stream_copy(spark, spark.range(5000), "spread-test")
    sink = str(tmp_path / "sink")
    ST.run_to_sink(stream.select("id", F.spark_partition_id().alias("task"), F.col("_metadata.file_path").alias("file")), sink, str(tmp_path / "ck"))
    back = spark.read.parquet(sink)
    assert sorted(rows(back, "id")) == [(i,) for i in range(5000)]
    assert back.select("file").distinct().count() == 4 * spark.sparkContext.defaultParallelism
    seen = [x for x in (tmp_path / "ck" / "offsets").iterdir() if x.name.isdigit()]
    assert len(seen) == 4       # the number of micro-batches is the same


def test_batch_folders_carry_the_number(spark, tmp_path):
    from sagebrush.streaming import pipelines as ST

    folder, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    spark.range(30).repartition(3).write.parquet(folder)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(folder)
    ST.run_batches_to_versions(stream, sink, str(tmp_path / "ck"))
    back = spark.read.parquet(sink)
    assert sorted(rows(back, "id")) == [(i,) for i in range(30)]
    assert sorted(rows(back.select("_batch").distinct(), "_batch")) == [(0,), (1,), (2,)]
    one = next((tmp_path / "sink" / "_batch=1").glob("*.parquet"))
    assert spark.read.parquet(str(one)).columns == ["id"]      # no column of its own for what the folder says


def test_streams_share_one_bucket(tmp_path):
    """Readers of one folder divide its files and pass no more lines together than the bucket holds and gains."""
    import time

    from sagebrush.sources.throttled import _ThrottledReader

    src = tmp_path / "logs"
    src.mkdir()
    for name, n in (("a", 300), ("b", 200), ("c", 200), ("d", 90)):
        (src / f"{name}.log").write_text("".join(f"{name}{i:05}\n" for i in range(n)))
    began = time.monotonic()
    readers = [_ThrottledReader({"path": str(src), "position": str(tmp_path / f"at-{i}.json"), "glob": "*.log", "linesPerSecond": "1000",
                                 "burst": "50", "stream": str(i), "streams": "2", "owners": str(tmp_path / "owners.json"),
                                 "bucket": str(tmp_path / "bucket")}) for i in range(2)]
    at, passed = [{}, {}], 0
    while passed < 790:
        for i, reader in enumerate(readers):
            to = reader.latestOffset()
            n = sum(end - at[i].get(name, 0) for name, end in to.items()) // 7
            passed, at[i] = passed + n, to
            assert n <= 50 and passed <= 50 + 1000 * (time.monotonic() - began)
    assert not at[0].keys() & at[1].keys() and len(at[0]) == len(at[1]) == 2
    with pytest.raises(ValueError, match="beyond the 1 of this run"):
        _ThrottledReader({"path": str(src), "position": str(tmp_path / "at-0.json"), "owners": str(tmp_path / "owners.json"),
                          "bucket": str(tmp_path / "bucket"), "glob": "*.log"}).latestOffset()


def test_throttled_streams_of_one_folder(spark, tmp_path):
    """Several micro-batches at a time: every line comes once, a file's lines by one stream and in order, also over a restart."""
    import time

    from sagebrush.streaming import pipelines as ST

    src, sink, ck = tmp_path / "logs", str(tmp_path / "sink"), str(tmp_path / "ck")
    src.mkdir()
    for name, n in (("a", 70), ("b", 50), ("c", 40), ("d", 1)):
        (src / f"{name}.log").write_text("".join(f"{name}{i:03}\n" for i in range(n)))

    def run():
        ST.run_throttled_to_versions(spark, str(src), sink, ck, 3, rate=200, burst=20, glob="*.log")
        return sorted((r._stream, r._batch, r.line, r.job) for r in spark.read.parquet(sink).collect())

    began = time.monotonic()
    first = run()
    assert time.monotonic() - began >= (161 - 20) / 200     # the rate holds over all streams
    assert sorted(x for _, _, x, _ in first) == [f"{f}{i:03}" for f, n in (("a", 70), ("b", 50), ("c", 40), ("d", 1)) for i in range(n)]
    assert max(collections.Counter((s, b) for s, b, _, _ in first).values()) <= 20
    assert {j for _, _, _, j in first} == {"app-logs"} and {s for s, _, _, _ in first} == {0, 1, 2}
    for f in "abcd":
        lines = [(s, b, x) for s, b, x, _ in first if x.startswith(f)]
        assert len({s for s, _, _ in lines}) == 1 and [x for _, _, x in lines] == sorted(x for _, _, x in lines)
    with open(src / "b.log", "a") as f:
        f.write("b050\n")
    (src / "e.log").write_text("e000\n")
    both = run()
    assert set(first) <= set(both) and sorted(x for _, _, x, _ in set(both) - set(first)) == ["b050", "e000"]
    assert len(both) == len(first) + 2 and run() == both


def test_session_of_streams(spark, tmp_path):
    from sagebrush.streaming import pipelines as ST

    own = ST._session_of_streams(spark, str(tmp_path / "ck"))
    assert own.conf.get(ST._FILE_MANAGER).endswith(".FileSystemBasedCheckpointFileManager") and spark.conf.get(ST._FILE_MANAGER, None) is None
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(ST._FILE_MANAGER, named := "org.apache.spark.sql.execution.streaming.checkpointing.FileContextBasedCheckpointFileManager")
    try:
        assert ST._session_of_streams(spark, str(tmp_path / "ck")).conf.get(ST._FILE_MANAGER) == named
    finally:
        spark.conf.unset(ST._FILE_MANAGER)


def test_streams_at_a_time_have_a_session_each(spark, tmp_path, monkeypatch):
    from sagebrush.streaming import pipelines as ST

    seen, ran = [], []
    monkeypatch.setattr(ST, "throttled_log_stream", lambda session, *a, **k: seen.append(session._jsparkSession.sessionUUID()))
    monkeypatch.setattr(ST, "run_batches_to_versions", lambda lines, sink, ck: ran.append((sink, ck)))
    ST.run_throttled_to_versions(spark, str(tmp_path), "sink", f"{tmp_path}/ck/", 3, rate=10, burst=10)
    assert len(set(seen)) == 3 and spark._jsparkSession.sessionUUID() not in seen
    assert sorted(ran) == [(f"sink/_stream={i}", f"{tmp_path}/ck/{i}") for i in range(3)]
