"""Input checks. They look at schemas, or take one row at most; none pulls data to the driver."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F


class InputError(ValueError):
    """An input table breaks the contract of an operator."""


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> DataFrame:
    """Fail on missing columns, ignore extra ones."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise InputError(f"{what} is missing columns {missing}")
    return df


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail if `df` has no row."""
    if df.isEmpty():
        raise InputError(message)
    return df


def require_none(offenders: DataFrame, message: str, show: int = 10) -> None:
    """Fail if `offenders` has rows; a few of them go into the message."""
    few = offenders.limit(show).collect()
    if few:
        raise InputError(f"{message}: {[tuple(r) for r in few]}")


def row_count_mismatches(left: DataFrame, right: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Per `group`, how many keys occur on one side only."""
    sides = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    return (
        sides.groupBy(*keys)
        .agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
        .filter("_l <> _r")
        .groupBy(group)
        .agg(F.sum("_l").alias("left_only"), F.sum("_r").alias("right_only"))
    )
