"""Barcode, gene and spot alignment, labels, leakage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotweave.checks import require_columns, require_none, require_rows
from spotweave.functions.scalars import gene_key
from spotweave.operators.ordering import running_total
from spotweave.operators.sizefactor import SAMPLE, SPOT

CELL = ["sample_id", "spot_id", "gene"]


def align_barcodes(st: DataFrame, patch: DataFrame, group: str = SAMPLE) -> DataFrame:
    """Barcodes of both sides with their positions. Unmatched barcodes keep a NULL on the other side."""
    keys = [group, "barcode"]
    return (
        st.select(*keys, "st_index")
        .join(patch.select(*keys, "patch_index"), keys, "full_outer")
        .withColumn(
            "side",
            F.when(F.col("patch_index").isNull(), "st_only").when(F.col("st_index").isNull(), "patch_only").otherwise("both"),
        )
    )


def barcode_order_flags(aligned: DataFrame, group: str = SAMPLE) -> DataFrame:
    """Per group: does the st position rise along the patch order?

    The matched rows are ranked once by patch position and once by st position; the order is monotonic when both ranks
    agree everywhere, which needs no look at the previous row across task borders.
    """
    both = aligned.filter("side = 'both'").select(group, "st_index", "patch_index")
    r = running_total(both, [group], [F.col("patch_index")], out="_rp")
    r = running_total(r, [group], [F.col("st_index")], out="_rs")
    return r.groupBy(group).agg(F.bool_and(F.col("_rp") == F.col("_rs")).alias("barcode_order_monotonic"))


def barcode_summary(aligned: DataFrame, group: str = SAMPLE) -> DataFrame:
    side = lambda *names: F.count(F.when(F.col("side").isin(*names), 1))
    counts = aligned.groupBy(group).agg(
        side("both", "st_only").alias("st_n"),
        side("both", "patch_only").alias("patch_n"),
        side("both").alias("intersection"),
        side("patch_only").alias("patch_not_in_st"),
        side("st_only").alias("st_not_in_patch"),
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    out = counts.join(barcode_order_flags(aligned, group), group, "left")
    return out.select(
        "*",
        ratio("intersection", "patch_n").alias("st_coverage_of_patch"),
        ratio("intersection", "st_n").alias("patch_coverage_of_st"),
    ).withColumn("barcode_order_monotonic", F.coalesce("barcode_order_monotonic", F.lit(True)))


def align_genes(target: DataFrame, prediction: DataFrame) -> DataFrame:
    """Genes on both lists in target order: first position on the target list, last on the prediction list."""
    t = target.groupBy("gene").agg(F.min("gene_index").alias("target_index"))
    p = prediction.groupBy("gene").agg(F.max("gene_index").alias("prediction_index"))
    return require_rows(t.join(p, "gene"), "no gene is on both lists")


def slide_gene_keys(sample_genes: DataFrame, key: str = "var_names", name: str = "gene", symbol: str = "symbol") -> DataFrame:
    """Gene key of every column of a slide; invalid keys become NULL."""
    if key in ("var_names", "genes_path"):
        chosen = F.col(name)
    elif key in ("symbol", "canonical_symbol"):
        chosen = F.coalesce(F.col(symbol), F.col(name)) if symbol in sample_genes.columns else F.col(name)
    else:
        raise ValueError(f"unknown gene key {key!r}")
    return sample_genes.withColumn("gene_key", gene_key(chosen))


def project_genes(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """Counts on the target gene axis; columns that share a target gene are added up.

    `mapping` holds (gene, target_gene).
    """
    return (
        counts.join(mapping, "gene")
        .groupBy(*SPOT, F.col("target_gene").alias("gene"))
        .agg(F.sum("count").alias("count"))
    )


def measured_only(cells: DataFrame, sample_genes: DataFrame) -> DataFrame:
    """Drop cells of genes the sample did not measure: unknown is not zero."""
    return cells.join(sample_genes.select(SAMPLE, "gene"), [SAMPLE, "gene"], "left_semi")


def dense_truth(spots: DataFrame, sample_genes: DataFrame, counts: DataFrame) -> DataFrame:
    """Every spot × every gene measured in its sample; an absent count is a zero.

    The output is dense by definition. Metrics do not go through it: they take zeros in through counts of spots.
    """
    grid = spots.join(sample_genes.select(SAMPLE, "gene"), SAMPLE)
    return grid.join(counts.select(*CELL, "count"), CELL, "left").withColumn(
        "true_count", F.coalesce("count", F.lit(0)).cast("long")
    ).drop("count")


def apply_split(samples: DataFrame, split_table: DataFrame, split_type: str = "leave_slide_out") -> DataFrame:
    chosen = split_table.filter(F.col("split_type") == split_type).select(SAMPLE, "split").distinct()
    return samples.drop("split").join(chosen, SAMPLE, "left").withColumn("split", F.coalesce("split", F.lit("unassigned")))


def with_labels(df: DataFrame, samples: DataFrame, labels: list[str], missing: str = "unknown") -> DataFrame:
    known = samples.groupBy(SAMPLE).agg(*[F.min(c).alias(c) for c in labels])
    out = df.drop(*labels).join(known, SAMPLE, "left")
    for c in labels:
        out = out.withColumn(c, F.coalesce(c, F.lit(missing)))
    return out


def with_coordinates(scores: DataFrame, spots: DataFrame) -> DataFrame:
    return scores.join(spots.select(*SPOT, "x", "y"), SPOT, "left")


def leaked_groups(samples: DataFrame, group_cols: list[str]) -> DataFrame:
    """Group values that occur in more than one split; columns the table lacks are skipped."""
    cols = [c for c in group_cols if c in samples.columns]
    pairs = samples.select(
        "split",
        F.explode(F.array(*[F.struct(F.lit(c).alias("group_col"), F.col(c).cast("string").alias("value")) for c in cols])).alias("g"),
    ).select("split", "g.*")
    return (
        pairs.filter("value IS NOT NULL")
        .distinct()
        .groupBy("group_col", "value")
        .agg(F.count("split").alias("n_splits"), F.array_join(F.array_sort(F.collect_set("split")), "|").alias("splits"))
        .filter("n_splits > 1")
    )


def assert_disjoint_groups(samples: DataFrame, group_cols: list[str]) -> None:
    require_none(leaked_groups(samples, group_cols), "groups occur in several splits")


def calibration_overlap(calibration: DataFrame, test: DataFrame) -> DataFrame:
    require_columns(calibration, [SAMPLE], "calibration table")
    require_columns(test, [SAMPLE], "test table")
    return calibration.select(SAMPLE).distinct().join(test.select(SAMPLE).distinct(), SAMPLE, "left_semi")


def assert_no_test_calibration(calibration: DataFrame, test: DataFrame) -> None:
    require_none(calibration_overlap(calibration, test), "calibration samples are test samples")


def metric_drift(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str], tolerance: float = 1.0e-10) -> DataFrame:
    """Largest absolute difference per metric of two tables with the same keys."""
    j = a.select(*keys, *[F.col(m).alias(f"a_{m}") for m in metrics]).join(
        b.select(*keys, *[F.col(m).alias(f"b_{m}") for m in metrics]), keys
    )
    rows = F.explode(
        F.array(*[F.struct(F.lit(m).alias("metric"), F.abs(F.col(f"a_{m}") - F.col(f"b_{m}")).alias("delta")) for m in metrics])
    )
    return (
        j.select(rows.alias("r")).select("r.*").groupBy("metric")
        .agg(F.count("delta").alias("n_compared"), F.max("delta").alias("max_abs_delta"))
        .withColumn("within_tolerance", F.coalesce(F.col("max_abs_delta") < tolerance, F.lit(False)))
    )


def target_consistency(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per sample: do two target tables hold the same spots and genes, and how far apart are their values?"""
    j = a.select(*CELL, F.col("value").alias("_a")).join(b.select(*CELL, F.col("value").alias("_b")), CELL, "full_outer")
    one_sided = F.col("_a").isNull() | F.col("_b").isNull()
    per_spot = j.groupBy(*SPOT).agg(
        F.count(F.lit(1)).alias("_cells"),
        F.count(F.when(one_sided, 1)).alias("_one_sided"),
        F.bool_or(F.col("_a").isNotNull()).alias("_in_a"),
        F.bool_or(F.col("_b").isNotNull()).alias("_in_b"),
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("_d"),
    )
    return per_spot.groupBy(SAMPLE).agg(
        F.count(F.lit(1)).alias("checked_spots"),
        F.bool_and(F.col("_in_a") & F.col("_in_b")).alias("spot_ids_match"),
        (F.sum(F.when(F.col("_in_a") & F.col("_in_b"), F.col("_one_sided")).otherwise(F.lit(0))) == 0).alias("measured_genes_match"),
        F.max("_d").alias("max_abs_diff"),
    )
