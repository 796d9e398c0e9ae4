"""Registry of runnable queries and their equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from flowlens.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with its SQL where one exists."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round6(fn(tune(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            # the same nudge as in round6: exact ties must round alike in both engines
            ORACLES[name] = sql.replace(", 6) + 0.0", " + 1e-9, 6) + 0.0")
        return fn

    return wrap


def round6(df: DataFrame) -> DataFrame:
    """Round doubles and drop the sign of zero, so that values compare as text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double") + F.lit(1e-9), 6) + F.lit(0.0)).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def sql_round(cols: dict[str, str]) -> str:
    """SELECT list that rounds each expression to six places."""
    return ", ".join(f"round(CAST({e} AS DOUBLE), 6) + 0.0 AS {n}" for n, e in cols.items())
