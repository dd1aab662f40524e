"""Ranks, prefix sums and exact quantiles inside groups of any size.

A window over a group puts the whole group into one task. That is fine while groups are small, so the size of the
largest group is looked at first. Beyond `bucket_rows` the table is range-partitioned by group and order, and written
once with the number of the range each row fell into. A large group then spans many ranges of bounded size; a row's
position is its position in the range plus the size of the group's earlier ranges. The result is exact either way, and the
same: null keys are a group in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spotweave.session import materialise

BUCKET_ROWS = 2_000_000


def _sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest group and of the whole table."""
    row = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _null_safe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on `on`, with null equal to null, so that a null key stays a group of its own. Keeps the left keys."""
    renamed = right.withColumnsRenamed({c: f"_on{i}" for i, c in enumerate(on)})
    same = [F.col(f"_l.{c}").eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)]
    return left.alias("_l").join(renamed, same).drop(*[f"_on{i}" for i in range(len(on))])


def largest_group(df: DataFrame, keys: list[str]) -> int:
    return _sizes(df, keys)[0]


def _ranges(d: DataFrame, on: list[str], n: int) -> DataFrame:
    """Rows with `_bucket`, rising along (group, order). It is stored, so later reads all see the same ranges."""
    return materialise(d.repartitionByRange(n, *on, "_ord").withColumn("_bucket", F.spark_partition_id()))


def running_total(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    weight: Column | None = None,
    out: str = "rank",
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Inclusive prefix sum of `weight` (1 if None, which gives the row number) along `order` within `keys`.

    `order` must be a total order of the group; put a key of the row last.
    """
    d = df.withColumn("_ord", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    d = d.withColumn("_w", F.lit(1).cast("long") if weight is None else weight)
    largest, rows = _sizes(df, keys)
    if largest <= bucket_rows:
        w = W.partitionBy(*keys).orderBy("_ord").rowsBetween(W.unboundedPreceding, W.currentRow)
        return d.withColumn(out, F.sum("_w").over(w)).drop("_ord", "_w")
    on = keys or ["_all"]
    d = d if keys else d.withColumn("_all", F.lit(1))
    cut = _ranges(d, on, -(-rows // bucket_rows) + 1)
    sizes = cut.groupBy(*on, "_bucket").agg(F.sum("_w").alias("_total"))
    earlier = W.partitionBy(*on).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*on, "_bucket", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*on, "_bucket").orderBy("_ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    done = _null_safe(cut.withColumn("_in", F.sum("_w").over(inside)), offsets, [*on, "_bucket"]).withColumn(out, F.col("_in") + F.col("_before"))
    return done.drop("_ord", "_w", "_bucket", "_before", "_in", *([] if keys else ["_all"]))


def row_number(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    return running_total(df, keys, order, None, out, bucket_rows)


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per distinct value of a group its average rank; ties are folded before anything is sorted."""
    folded = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    upto = running_total(folded, keys, [F.col(value)], F.col("_ties"), "_upto", bucket_rows)
    return upto.select(
        *keys, value, (F.col("_upto") - (F.col("_ties") - F.lit(1)) / F.lit(2.0)).cast("double").alias(out)
    )


def group_quantile(df: DataFrame, keys: list[str], value: str, q: float, out: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Exact quantile per group, linear between the two nearest order statistics."""
    d = df.select(*keys, value).filter(F.col(value).isNotNull())
    if largest_group(d, keys) <= bucket_rows:
        return d.groupBy(*keys).agg(F.percentile(value, q).alias(out))
    folded = d.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    upto = running_total(folded, keys, [F.col(value)], F.col("_ties"), "_upto", bucket_rows)
    on = keys or ["_all"]
    if not keys:
        upto, d = upto.withColumn("_all", F.lit(1)), d.withColumn("_all", F.lit(1))
    pos = d.groupBy(*on).agg(((F.count(F.lit(1)) - 1) * F.lit(q)).alias("_pos"))
    first, last = F.col("_upto") - F.col("_ties"), F.col("_upto") - 1
    lo, hi = F.floor("_pos"), F.ceil("_pos")
    hit = lambda p: F.max(F.when((first <= p) & (p <= last), F.col(value)))
    ends = _null_safe(upto, pos, on).groupBy(*on).agg(
        hit(lo).alias("_lo"), hit(hi).alias("_hi"), F.first("_pos").alias("_pos")
    )
    return ends.select(
        *keys, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_pos") - F.floor("_pos"))).alias(out)
    )
