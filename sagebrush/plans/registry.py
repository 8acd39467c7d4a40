"""Registry of the checked queries: name -> (Spark callable, DuckDB oracle SQL or None).

Each callable takes (spark, sf_dir) and returns a DataFrame over the whole
driver tables.  ``tidy`` rounds doubles to 6 decimals and widens integers so
both engines agree on types.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagebrush.sources.tables import with_views

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] | list[str] = ()):
    def deco(fn):
        def run(spark, sf_dir):
            from sagebrush.session import ensure_checkpoint_dir, ship_package, spread_locally

            ensure_checkpoint_dir(spark)
            ship_package(spark)
            spread_locally(spark)
            # the fixtures are defined in UTC (timestamp_ntz columns read as UTC wall-clock time)
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql, list(views))
        return fn
    return deco


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


# --- SQL text helpers (DuckDB side) -------------------------------------------------

def sql_tokens(expr: str) -> str:
    """tokens(expr) in DuckDB: same definition as sagebrush.functions.text.tokens."""
    return ("list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(" + expr +
            ", '')), '^[^\\p{L}\\p{N}]+', ''), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')")


def sql_closeness(a: str, b: str) -> str:
    """Angular closeness of two float lists, computed in double."""
    da, db = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    cos = (f"list_dot_product({da}, {db}) / (sqrt(list_dot_product({da}, {da})) * "
           f"sqrt(list_dot_product({db}, {db})))")
    return f"(1e0 / (1e0 + acos(greatest(-1e0, least(1e0, {cos})))))"


def sql_random_score(key: str, seed: str = "0") -> str:
    return f"(CAST(('0x' || substr(md5('{seed}' || ':' || CAST({key} AS VARCHAR)), 1, 8)) AS UBIGINT) / 4294967296e0)"
