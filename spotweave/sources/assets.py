"""Asset bookkeeping over listing tables: audits, plans, reconciliation, conversion status."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotweave.operators.align import barcode_order_flags
from spotweave.operators.ordering import group_quantile
from spotweave.operators.sizefactor import SAMPLE


def audit_samples(st: DataFrame, patch: DataFrame, total: str) -> DataFrame:
    """Per sample: barcode overlap both ways, totals, and the offset between the two coordinate systems."""
    keys = [SAMPLE, "barcode"]
    a = st.select(*keys, "st_index", F.col("x").alias("_sx"), F.col("y").alias("_sy"), F.col(total).alias("_total"))
    b = patch.select(*keys, "patch_index", F.col("x").alias("_px"), F.col("y").alias("_py"))
    j = (
        a.join(b, keys, "full_outer")
        .withColumn("_dx", F.col("_px") - F.col("_sx"))
        .withColumn("_dy", F.col("_py") - F.col("_sy"))
        .withColumn(
            "side",
            F.when(F.col("patch_index").isNull(), "st_only").when(F.col("st_index").isNull(), "patch_only").otherwise("both"),
        )
    )
    n = lambda s: F.count(F.when(F.col("side") == s, 1))
    agg = j.groupBy(SAMPLE).agg(
        F.count("st_index").alias("st_n"),
        F.count("patch_index").alias("patch_n"),
        n("both").alias("intersection"),
        n("patch_only").alias("patch_not_in_st"),
        n("st_only").alias("st_not_in_patch"),
        F.min("_total").alias("total_min"),
        F.avg("_total").alias("total_mean"),
        F.max("_total").alias("total_max"),
        F.avg("_dx").alias("mean_dx"),
        F.avg("_dy").alias("mean_dy"),
        F.stddev_pop("_dx").alias("std_dx"),
        F.stddev_pop("_dy").alias("std_dy"),
        F.max(F.abs("_dx")).alias("max_abs_dx"),
        F.max(F.abs("_dy")).alias("max_abs_dy"),
    )
    median = group_quantile(a, [SAMPLE], "_total", 0.5, "total_median")
    ratio = lambda d: F.when(F.col(d) > 0, F.col("intersection") / F.col(d))
    return (
        agg.join(median, SAMPLE, "left")
        .join(barcode_order_flags(j), SAMPLE, "left")
        .withColumn("barcode_order_monotonic", F.coalesce("barcode_order_monotonic", F.lit(True)))
        .withColumn("st_coverage_of_patch", ratio("patch_n"))
        .withColumn("patch_coverage_of_st", ratio("st_n"))
    )


def audit_rollup(audit: DataFrame, min_coverage: float, worst: int = 20) -> DataFrame:
    """Counts and coverage by status, and the samples with the lowest coverage."""
    cov = F.col("patch_coverage_of_st")
    d = audit.withColumn(
        "status", F.when(F.col("intersection") == 0, "no_overlap").when(cov < min_coverage, "low_coverage").otherwise("ok")
    )
    by_status = d.groupBy(F.lit("status").alias("part"), F.col("status").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(cov).alias("mean_coverage"), F.min(cov).alias("min_coverage")
    )
    low = d.filter("status <> 'no_overlap'").orderBy(cov, SAMPLE).limit(worst)
    return by_status.unionByName(
        low.select(
            F.lit("worst").alias("part"), F.col(SAMPLE).alias("key"), F.col("st_n").alias("n"),
            cov.alias("mean_coverage"), cov.alias("min_coverage"),
        )
    )


def asset_plan_status(plan: DataFrame, listing: DataFrame) -> DataFrame:
    """Planned files against a listing: complete, size_mismatch or missing, and the bytes still to come."""
    j = plan.join(listing.select("path", "actual_bytes"), "path", "left")
    status = (
        F.when(F.col("actual_bytes").isNull(), "missing")
        .when(F.col("actual_bytes") == F.col("size_bytes"), "complete")
        .otherwise("size_mismatch")
    )
    actual = F.coalesce("actual_bytes", F.lit(0))
    return j.select(
        SAMPLE, "path", "asset_group", F.col("size_bytes").alias("expected_bytes"), actual.alias("actual_bytes"),
        F.greatest(F.col("size_bytes") - actual, F.lit(0)).alias("remaining_bytes"), status.alias("status"),
        F.col("actual_bytes").isNotNull().alias("already_downloaded"),
    )


def asset_totals(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("expected_bytes").alias("expected_bytes"),
        F.sum("actual_bytes").alias("actual_bytes"),
        F.sum(F.when(F.col("status") != "complete", F.col("expected_bytes")).otherwise(F.lit(0))).alias("remaining_expected_bytes"),
    )


def planned_paths(samples: DataFrame, patterns: DataFrame) -> DataFrame:
    """Every sample × every file pattern. `patterns` is the short fixed list of (asset_group, prefix, suffix)."""
    return samples.select(SAMPLE).crossJoin(F.broadcast(patterns)).select(
        SAMPLE, "asset_group", F.concat("prefix", F.col(SAMPLE), "suffix").alias("path")
    )


def validation_report(features: DataFrame, counts: DataFrame, coords: DataFrame, samples: DataFrame) -> DataFrame:
    """Per sample the number of spots in each of its three tables and what that says about it."""
    parts = [
        t.select(SAMPLE, "spot_id", F.lit(name).alias("_t")) for name, t in (("features", features), ("counts", counts), ("coords", coords))
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    n = lambda name: F.count(F.when(F.col("_t") == name, 1)).alias(f"{name}_rows")
    by = rows.groupBy(SAMPLE).agg(n("features"), n("counts"), n("coords"))
    cols = ["features_rows", "counts_rows", "coords_rows"]
    d = samples.select(SAMPLE).join(by, SAMPLE, "left").select(SAMPLE, *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])
    missing = F.least(*cols) == 0
    same = (F.col("features_rows") == F.col("counts_rows")) & (F.col("features_rows") == F.col("coords_rows"))
    names = F.concat_ws(";", *[F.when(F.col(c) == 0, F.lit(c[:-5])) for c in cols])
    return d.withColumn("missing", names).withColumn(
        "status", F.when(missing, "missing_required").when(~same, "shape_mismatch").otherwise("ok")
    )


def conversion_report(st: DataFrame, patch: DataFrame, totals: DataFrame, min_patch_coverage: float) -> DataFrame:
    """Status per sample of joining raw spots to patches: coverage gate first, then totals and size factors of the
    matched spots. `totals` holds (sample_id, barcode, total, nnz)."""
    from spotweave.operators.sizefactor import valid_spot, with_group_stats

    keys = [SAMPLE, "barcode"]
    j = st.select(*keys, F.lit(1).alias("_st")).join(patch.select(*keys, F.lit(1).alias("_patch")), keys, "full_outer")
    n = j.groupBy(SAMPLE).agg(
        F.count("_st").alias("st_n"), F.count("_patch").alias("patch_n"), F.count(F.col("_st") + F.col("_patch")).alias("kept_n")
    )
    n = n.withColumn("patch_coverage_of_st", F.when(F.col("st_n") > 0, F.col("kept_n") / F.col("st_n")).otherwise(F.lit(0.0)))
    kept = j.filter("_st = 1 AND _patch = 1").select(*keys).join(totals, keys, "left")
    kept = kept.withColumn("total", F.coalesce("total", F.lit(0))).withColumn("nnz", F.coalesce("nnz", F.lit(0)))
    kept = kept.withColumn("valid", valid_spot(F.col("total")))
    with_sf = with_group_stats(kept, [SAMPLE], F.avg(F.when(F.col("valid"), F.col("total"))).alias("_m")).withColumn(
        "sf", F.col("total") / F.col("_m")
    )
    stats = with_sf.groupBy(SAMPLE).agg(
        F.sum("nnz").cast("long").alias("counts_nnz"),
        F.count(F.when(F.col("valid"), 1)).alias("valid_n"),
        F.count(F.when(~F.col("valid"), 1)).alias("invalid_n"),
        F.min("sf").alias("sf_min"),
        F.avg("sf").alias("sf_mean_all_spots"),
        F.avg(F.when(F.col("valid"), F.col("sf"))).alias("sf_mean_valid_spots"),
        F.max("sf").alias("sf_max"),
    )
    below = F.col("patch_coverage_of_st") < min_patch_coverage
    d = n.join(stats, SAMPLE, "left")
    status = (
        F.when((F.col("st_n") == 0) | (F.col("patch_n") == 0), "missing_required_raw_asset")
        .when(below, "below_min_patch_coverage")
        .when(F.coalesce("valid_n", F.lit(0)) == 0, "no_valid_spot")
        .otherwise("ok")
    )
    d = d.withColumn("status", status)
    detail = ["counts_nnz", "valid_n", "invalid_n", "sf_min", "sf_mean_all_spots", "sf_mean_valid_spots", "sf_max"]
    return d.select(
        SAMPLE, "status", "st_n", "patch_n", "kept_n", "patch_coverage_of_st",
        *[F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in detail],
    )
