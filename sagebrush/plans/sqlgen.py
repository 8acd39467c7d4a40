"""DuckDB oracle text for the search family, written independently of the
Spark code path: unnest + GROUP BY for postings, cross product for vectors."""

from __future__ import annotations

from sagebrush.plans.registry import sql_closeness, sql_tokens


def osum(expr: str) -> str:
    """Sum in ascending order (same association as the Spark side)."""
    return f"list_reduce(list_prepend(0e0, list_sort(list({expr}))), lambda a, b: a + b)"


def _osum_fix(sql: str) -> str:
    out, i = [], 0
    while True:
        j = sql.find("osum(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        k, depth = j + 5, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        out.append(osum(sql[j + 5:k - 1]))
        i = k


def sql_grams(expr: str) -> str:
    return (f"flatten(list_transform({sql_tokens(expr)}, lambda t: list_transform("
            f"range(0, greatest(length(t) - 3, 0) + 1), lambda i: substr(t, i + 1, 3))))")


def text_block(qview: str, dview: str, key: str, fields: dict[str, str], gram: bool = False,
               p: str = "", qtext: str = "qtext") -> str:
    """CTEs {p}qt, {p}ft, {p}stats, {p}post, {p}dfreq, {p}sc, {p}wide."""
    tok = sql_grams if gram else sql_tokens
    qarr = f"list_distinct({sql_grams(qtext)})" if gram else sql_tokens(qtext)
    ft = "\n            UNION ALL ".join(
        f"SELECT {key} AS k, '{name}' AS field, {tok(expr)} AS toks FROM {dview}" for name, expr in fields.items())
    wide = ",\n            ".join(
        f"coalesce(sum(CASE WHEN field = '{f}' THEN bm25 END), 0e0) AS bm25_{f}, "
        f"coalesce(sum(CASE WHEN field = '{f}' THEN native END), 0e0) AS native_{f}, "
        f"coalesce(max(CASE WHEN field = '{f}' THEN 1 END), 0) AS matches_{f}" for f in fields)
    return _osum_fix(f"""{p}qt AS (SELECT query_id, token, count(*) OVER (PARTITION BY query_id) AS nq
            FROM (SELECT DISTINCT query_id, unnest({qarr}) AS token FROM {qview})),
{p}ft AS ({ft}),
{p}stats AS (SELECT field, count(*) AS nd, avg(len(toks)) AS avglen FROM {p}ft GROUP BY field),
{p}ex AS (SELECT k, field, len(toks) AS dl, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM {p}ft),
{p}post AS (SELECT k, field, token, dl, count(*) AS tf, min(pos) AS first_pos FROM {p}ex
         WHERE token IN (SELECT token FROM {p}qt) GROUP BY k, field, token, dl),
{p}dfreq AS (SELECT field, token, count(*) AS n FROM {p}post GROUP BY field, token),
{p}sc AS (SELECT qt.query_id, post.k AS {key}, post.field,
              osum(ln(1e0 + (s.nd - d.n + 0.5e0) / (d.n + 0.5e0)) * post.tf * 2.2e0
                  / (post.tf + 1.2e0 * (0.25e0 + 0.75e0 * post.dl / s.avglen))) AS bm25,
              osum(0.5e0 / (1e0 + post.first_pos / 16e0) + 0.5e0 * least(1e0, ln(1e0 + post.tf) / ln(9e0)))
                  / max(qt.nq) AS native
       FROM {p}post post JOIN {p}qt qt ON qt.token = post.token
       JOIN {p}dfreq d ON d.field = post.field AND d.token = post.token
       JOIN {p}stats s ON s.field = post.field GROUP BY qt.query_id, post.k, post.field),
{p}wide AS (SELECT query_id, {key},
            {wide}
         FROM {p}sc GROUP BY query_id, {key})""")


def vec_block(qview: str, vview: str, key: str, part: str | None, k: int | None, p: str = "",
              qvec: str = "e", vcol: str = "v") -> str:
    """CTEs {p}vall, {p}vbest, {p}vec(query_id, key, p, closeness, nn_rank)."""
    pcol = f"v.{part}" if part else "CAST(0 AS BIGINT)"
    cut = f"WHERE nn_rank <= {k}" if k else ""
    return f"""{p}vall AS (SELECT q.query_id, v.{key}, {pcol} AS p, {sql_closeness('q.' + qvec, 'v.' + vcol)} AS c
                 FROM {qview} q, {vview} v WHERE v.{vcol} IS NOT NULL),
{p}vbest AS (SELECT query_id, {key}, p, c AS closeness FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, {key} ORDER BY c DESC, p) AS r FROM {p}vall) WHERE r = 1),
{p}vec AS (SELECT query_id, {key}, p, closeness, nn_rank FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY closeness DESC, {key}) AS nn_rank FROM {p}vbest)
        {cut})"""


def cand_block(key: str, fields: list[str], has_vec: bool, p: str = "", src: str = "") -> str:
    """CTE {p}f: U2 candidates with matched_field_count, cnr (combined nativeRank), cbm25."""
    cols = ", ".join(f"coalesce(w.bm25_{f}, 0e0) AS bm25_{f}, coalesce(w.native_{f}, 0e0) AS native_{f}, "
                     f"coalesce(w.matches_{f}, 0) AS matches_{f}" for f in fields)
    mfc = " + ".join(f"matches_{f}" for f in fields)
    nat = " + ".join(f"native_{f}" for f in fields)
    bm = " + ".join(f"bm25_{f}" for f in fields)
    if has_vec:
        cand = f"""{p}cand AS (SELECT coalesce(w.query_id, v.query_id) AS query_id, coalesce(w.{key}, v.{key}) AS {key},
            {cols}, coalesce(v.closeness, 0e0) AS vector_score
         FROM {src}wide w FULL OUTER JOIN {src}vec v ON w.query_id = v.query_id AND w.{key} = v.{key})"""
    else:
        cand = f"""{p}cand AS (SELECT w.query_id, w.{key}, {cols}, 0e0 AS vector_score FROM {src}wide w)"""
    return f"""{cand},
{p}f AS (SELECT *, {mfc} AS matched_field_count,
             ({nat}) / CASE WHEN {mfc} = 0 THEN 1e0 ELSE ({mfc}) END AS cnr,
             {bm} AS cbm25
      FROM {p}cand)"""


def recency_sql(ts: str, rate: str = "0.1e0", default: str = "7890000e0") -> str:
    return (f"greatest(1e0 / (1e0 + {rate} * sqrt(greatest(coalesce(1706745600e0 - {ts} / 1000e0, {default})"
            f" / 31536000e0, 0e0))), 0.5e0)")


def scale_sql(x: str) -> str:
    return f"(2e0 * atan(({x}) / 4e0) / 3.14159e0)"


def two_phase_sql(ctes: str, key: str, dview: str, age: str | None, phase1: str, phase2: str, n: int,
                  extra: str = "") -> str:
    """W2 oracle over candidate CTE ``f``; phase2 may use doc_recency and ``pn_*`` window columns."""
    rec = f"CASE WHEN phase1_rank <= {n} THEN {recency_sql('d.' + age)} END" if age else "CAST(NULL AS DOUBLE)"
    join = f"JOIN {dview} d ON d.{key} = p1r.{key}" if age else ""
    return f"""WITH {ctes},
p1 AS (SELECT *, {phase1} AS phase1 FROM f),
p1r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phase1 DESC, {key}) AS phase1_rank FROM p1),
p2 AS (SELECT p1r.*, phase1_rank <= {n} AS reranked, {rec} AS doc_recency FROM p1r {join}),
p2w AS (SELECT *{extra} FROM p2),
p3 AS (SELECT *, CASE WHEN reranked THEN {phase2} END AS phase2 FROM p2w),
p4 AS (SELECT *, CASE WHEN reranked THEN phase2 ELSE phase1 END AS score FROM p3)
SELECT CAST(query_id AS BIGINT) AS query_id, {key},
       row_number() OVER (PARTITION BY query_id ORDER BY reranked DESC, score DESC, {key}) AS rank,
       reranked, round(score, 6) AS score, round(phase1, 6) AS phase1, round(vector_score, 6) AS vector_score,
       round(cnr, 6) AS combined_nativeRank, round(doc_recency, 6) AS doc_recency,
       CAST(matched_field_count AS BIGINT) AS matched_field_count
FROM p4"""
