"""Ranks and quantiles inside groups, over stored range partitions as large groups need them. One group has a null key."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.operators import ordering
from spotweave.plans.registry import query
from spotweave.sources.views import Views

FEW = 500  # rows of a range: far fewer than a group has, so every group spans several ranges
_SQL = "(SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, round(o_totalprice / 1000) AS price FROM orders)"


def _orders(v: Views):
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")
    return v.table("orders").select("o_orderkey", status, F.round(F.col("o_totalprice") / 1000).alias("price"))


@query("O1_row_numbers_in_ranges", f"SELECT *, row_number() OVER (PARTITION BY status ORDER BY price, o_orderkey) AS rank FROM {_SQL}", "price")
def _(v: Views):
    return ordering.row_number(_orders(v), ["status"], [F.col("price"), F.col("o_orderkey")], bucket_rows=FEW)


@query(
    "O2_average_ranks_in_ranges",
    f"SELECT status, price, any_value(r) + (count(*) - 1) / 2.0 AS rank FROM (SELECT *, rank() OVER (PARTITION BY status ORDER BY price) AS r FROM {_SQL}) GROUP BY status, price",
    "price rank",
)
def _(v: Views):
    return ordering.average_ranks(_orders(v), ["status"], "price", "rank", bucket_rows=FEW // 20)


@query("O3_quantiles_in_ranges", f"SELECT status, quantile_cont(price, 0.3) AS q30 FROM {_SQL} GROUP BY status", "q30")
def _(v: Views):
    return ordering.group_quantile(_orders(v), ["status"], "price", 0.3, "q30", bucket_rows=FEW // 20)
