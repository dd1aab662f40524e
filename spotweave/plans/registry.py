"""Named queries, each with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType

from spotweave.plans.base_sql import with_views
from spotweave.sources.views import Views, views

DIGITS = 6
NUDGE = 1.00000000001
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded for comparison across engines; adding zero turns -0.0 into 0.0.

    Values that lie exactly between two roundings, such as 1/128, would fall to either side by the last bit of a sum. The
    factor moves all of them to the same side.
    """
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append((F.round(F.col(f.name).cast("double") * F.lit(NUDGE), digits) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = DIGITS):
    """Register a query. `sql` is its oracle body over the base views; `doubles` names the columns to round in it."""

    def wrap(fn: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, path: rounded(fn(views(spark, path)), digits)
        if sql is not None:
            body = sql
            if doubles:
                reps = ", ".join(f"round(cast({c} AS double) * cast({NUDGE} AS double), {digits}) + 0.0 AS {c}" for c in doubles.split())
                body = f"SELECT * REPLACE ({reps}) FROM (\n{sql}\n) AS q"
            ORACLES[name] = with_views(body)
        return fn

    return wrap
