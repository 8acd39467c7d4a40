"""Scalar ranking functions as Column expressions.

They stay inside whole-stage codegen; parameters may be Python numbers or
Columns (e.g. per-query columns of a queries DataFrame).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sagebrush import config as C


def _v(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(float(x))


def scale(x) -> Column:
    """K1: 2*atan(x/4)/3.14159."""
    return F.lit(2.0) * F.atan(_v(x) / F.lit(4.0)) / F.lit(C.PI_APPROX)


def age_seconds(ts_ms, now_s=C.NOW_S, unit: str = "ms") -> Column:
    """now - ts in seconds; ``unit`` says what the stored number is (ms or s)."""
    ts = _v(ts_ms)
    ts_s = ts / F.lit(1000.0) if unit == "ms" else ts.cast("double")
    return _v(now_s) - ts_s


def _missing(ts) -> Column:
    t = _v(ts)
    return t.isNull() | F.isnan(t.cast("double"))


def document_age(ts_ms, now_s=C.NOW_S, default_s=C.THREE_MONTHS_S) -> Column:
    """K2: max(if missing: 3 months else now - ts/1000, / 1 year, 0)."""
    age = F.when(_missing(ts_ms), F.lit(float(default_s))).otherwise(age_seconds(ts_ms, now_s))
    return F.greatest(age / F.lit(float(C.ONE_YEAR_S)), F.lit(0.0))


def document_age_nodefault(ts_ms, now_s=C.NOW_S) -> Column:
    """K2 variant without a default (memory schemas): NULL stays NULL."""
    return F.greatest(age_seconds(ts_ms, now_s) / F.lit(float(C.ONE_YEAR_S)), F.lit(0.0))


def doc_recency(age_years, rate=C.RECENCY_DECAY_RATE, floor=C.MAX_DOC_DECAY) -> Column:
    """K3: max(1/(1+rate*sqrt(age)), 0.5)."""
    return F.greatest(F.lit(1.0) / (F.lit(1.0) + _v(rate) * F.sqrt(_v(age_years))), _v(floor))


def freshness_score(ts, now_s=C.NOW_S, unit: str = "ms") -> Column:
    """K4: exp(-(now - t)/86400), age clamped at >= 0 (one function, explicit unit)."""
    age = F.greatest(age_seconds(ts, now_s, unit), F.lit(0.0))
    return F.exp(-age / F.lit(C.ONE_DAY_S))


def freshness(ts_ms, now_s=C.NOW_S, max_age_s=C.FRESHNESS_MAX_AGE_S) -> Column:
    """K5: greatest(0, 1 - (now - t/1000)/max_age)."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - age_seconds(ts_ms, now_s) / F.lit(float(max_age_s)))


def document_age_days(ts_ms, now_s=C.NOW_S, default_s=C.THREE_MONTHS_S) -> Column:
    """K6: max(0, missing ? 3 months/1 day : (now - ts/1000)/1 day)."""
    days = F.when(_missing(ts_ms), F.lit(float(default_s) / C.ONE_DAY_S)).otherwise(
        age_seconds(ts_ms, now_s) / F.lit(C.ONE_DAY_S))
    return F.greatest(F.lit(0.0), days)


def recency_bin_index(age_days, bin_size_days=1.0) -> Column:
    """K7: floor(age_days / bin_size_days), as a double like the source expression."""
    return F.floor(_v(age_days) / _v(bin_size_days)).cast("double")


def recency_bin_score(bin_index, multiplier=C.BIN_MULTIPLIER_CLAMPED) -> Column:
    """K8: 1e9 - bin*multiplier."""
    return F.lit(C.MAX_SCORE_BASE) - _v(bin_index) * _v(multiplier)


def normalized_hybrid(h, multiplier=C.BIN_MULTIPLIER_CLAMPED) -> Column:
    """K9: max(0, min(h/10, multiplier - 1))."""
    return F.greatest(F.lit(0.0), F.least(_v(h) / F.lit(10.0), _v(multiplier) - F.lit(1.0)))


def hybrid(alpha, vector, text) -> Column:
    """alpha*v + (1-alpha)*t."""
    a = _v(alpha)
    return a * _v(vector) + (F.lit(1.0) - a) * _v(text)


def weighted(terms: list[tuple[float, object]]) -> Column:
    """Sum of weight * score column."""
    out = None
    for w, c in terms:
        t = F.lit(float(w)) * _v(c)
        out = t if out is None else out + t
    return out


def matched_field_count(match_cols: list) -> Column:
    """Number of fields with a match (each argument is 0/1)."""
    out = None
    for c in match_cols:
        out = _v(c) if out is None else out + _v(c)
    return out


def mean_over_matched(score_cols: list, match_cols: list) -> Column:
    """sum(scores) / (matched == 0 ? 1 : matched)."""
    total = None
    for c in score_cols:
        total = _v(c) if total is None else total + _v(c)
    n = matched_field_count(match_cols)
    return total / F.when(n == 0, F.lit(1.0)).otherwise(n.cast("double"))


def intent_switch(flag, people_only, general) -> Column:
    """People-only score when the query is an intent search."""
    return F.when(_v(flag).cast("boolean"), _v(people_only)).otherwise(_v(general))


def importance_factor(score, importance) -> Column:
    """Multiply by the stored importance."""
    return _v(score) * _v(importance)


def boost(score, factor: float) -> Column:
    """Constant factor."""
    return F.lit(float(factor)) * _v(score)


def random_score(key, seed="0") -> Column:
    """First 8 hex digits of md5(seed ':' key) / 2^32, repeatable."""
    h = F.md5(F.concat(F.lit(str(seed)), F.lit(":"), _v(key).cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def closeness_from_cos(cos) -> Column:
    """Angular closeness 1/(1+acos(clip(cos,-1,1)))."""
    c = F.least(F.greatest(_v(cos), F.lit(-1.0)), F.lit(1.0))
    return F.lit(1.0) / (F.lit(1.0) + F.acos(c))


def retry_delay_ms(attempt, retry_after_s=None, jitter_key=None,
                   base_ms=C.RETRY_BASE_MS, cap_ms=C.RETRY_CAP_MS) -> Column:
    """Retry-after seconds if given and finite, else min(base*2^n, cap) + jitter.

    Jitter is made repeatable: floor(md5-fraction(jitter_key) * min(1000, capped)).
    """
    capped = F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), _v(attempt)), F.lit(float(cap_ms)))
    if jitter_key is None:
        jitter = F.lit(0.0)
    else:
        jitter = F.floor(random_score(jitter_key, "jitter") *
                         F.least(F.lit(float(C.RETRY_JITTER_CAP_MS)), capped)).cast("double")
    computed = capped + jitter
    if retry_after_s is None:
        return computed
    ra = _v(retry_after_s).cast("double")
    finite = ra.isNotNull() & ~F.isnan(ra) & (F.abs(ra) != F.lit(float("inf")))
    return F.when(finite, F.greatest(F.lit(0.0), ra * F.lit(1000.0))).otherwise(computed)
