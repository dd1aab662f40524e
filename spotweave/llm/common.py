"""Column expressions shared by the corpus operators.

White space and letter case follow ASCII rules throughout: white space is U+0020 and U+0009-U+000D, and only A-Z are lower-cased.
"""

from __future__ import annotations

import ctypes
import gc
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SPACES = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(df: DataFrame, rows: int = 1000, size: str = "4m") -> DataFrame:
    """`df`, with the batches that go to Python workers bounded in rows and bytes, unless the session sets its own bounds.

    Texts are long: the default of 10,000 rows a batch is tens of MB of text, held several times over.
    """
    for key, default, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(rows)),
        ("spark.sql.execution.arrow.maxBytesPerBatch", None, size),
    ):
        if df.sparkSession.conf.get(key, None) in (None, default):
            df.sparkSession.conf.set(key, value)
    return df


def give_back() -> None:
    """At the end of a task: the memory it freed goes back to the system, so a worker that waits for its next task is small.

    The pools of Arrow and of the C library would keep it otherwise, in every waiting worker of an executor.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def text_of(column: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def strip_spaces(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def delete_spaces(c: Column) -> Column:
    for space in SPACES:
        c = F.replace(c, F.lit(space), F.lit(""))
    return c


def two_hashes(*cols: Column) -> list[Column]:
    """128 bits as two longs; nulls and empty values differ."""
    parts = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (17, 91)]


def packed(df: DataFrame, columns: list[str] | None = None) -> Column:
    """All columns of a row (or some) as one struct, so that an operator's own names cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in columns or df.columns]).alias("_row")


def unpacked(df: DataFrame, columns: list[str], added: list[str]) -> DataFrame:
    """The columns of the struct, except those that share a name with an added one, and the added ones."""
    return df.select(*[F.col("_row")[c].alias(c) for c in columns if c not in added], *added)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """`df` without columns that an operator is about to add under the same names."""
    return df.drop(*[n for n in names if n in df.columns])

