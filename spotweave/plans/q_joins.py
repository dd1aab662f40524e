"""Alignment, label lookups and consistency checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.operators import align as op
from spotweave.operators import baselines, evaluate
from spotweave.plans.base_sql import PEARSON, sums
from spotweave.plans.registry import query
from spotweave.sources.views import Views


@query(
    "J1_barcode_alignment",
    """SELECT sample_id, barcode, st_index, patch_index, CASE WHEN patch_index IS NULL THEN 'st_only' WHEN st_index IS NULL THEN 'patch_only' ELSE 'both' END AS side
FROM st_barcodes FULL JOIN patch_barcodes USING (sample_id, barcode)""",
)
def _(v: Views):
    return op.align_barcodes(v.st_barcodes, v.patch_barcodes)


@query(
    "J1_barcode_order",
    """WITH j AS (SELECT sample_id, s.st_index, p.patch_index FROM st_barcodes s FULL JOIN patch_barcodes p USING (sample_id, barcode)),
m AS (SELECT sample_id, st_index > lag(st_index) OVER (PARTITION BY sample_id ORDER BY patch_index) AS up FROM j WHERE st_index IS NOT NULL AND patch_index IS NOT NULL)
SELECT a.*, coalesce(f.mono, true) AS barcode_order_monotonic, intersection / nullif(patch_n, 0) AS st_coverage_of_patch, intersection / nullif(st_n, 0) AS patch_coverage_of_st
FROM (SELECT sample_id, count(st_index) AS st_n, count(patch_index) AS patch_n, count(st_index + patch_index) AS intersection,
  count(*) - count(st_index) AS patch_not_in_st, count(*) - count(patch_index) AS st_not_in_patch FROM j GROUP BY sample_id) a
LEFT JOIN (SELECT sample_id, coalesce(bool_and(up), true) AS mono FROM m GROUP BY sample_id) f USING (sample_id)""",
    "st_coverage_of_patch patch_coverage_of_st",
)
def _(v: Views):
    return op.barcode_summary(op.align_barcodes(v.st_barcodes, v.patch_barcodes))


@query(
    "J2_gene_alignment",
    """SELECT gene, min(t) AS target_index, max(p) AS prediction_index FROM
(SELECT p_brand AS gene, p_partkey AS t FROM part WHERE p_size > 10) JOIN (SELECT p_brand AS gene, p_partkey AS p FROM part WHERE p_retailprice < 950) USING (gene) GROUP BY gene""",
)
def _(v: Views):
    part = v.table("part").select(F.col("p_brand").alias("gene"), F.col("p_partkey").alias("gene_index"), "p_size", "p_retailprice")
    return op.align_genes(part.filter("p_size > 10"), part.filter("p_retailprice < 950"))


@query(
    "J3_gene_projection",
    """SELECT sample_id, spot_id, CASE WHEN gene IN ('Brand#24', 'Brand#25') THEN 'MERGED' ELSE gene END AS gene, cast(sum(count) AS bigint) AS count
FROM counts WHERE gene <> 'Brand#23' GROUP BY ALL""",
)
def _(v: Views):
    target = F.when(F.col("gene").isin("Brand#24", "Brand#25"), "MERGED").otherwise(F.col("gene"))
    mapping = v.genes.filter("gene <> 'Brand#23'").select("gene", target.alias("target_gene"))
    return op.project_genes(v.counts, mapping)


@query("J4_measured_only", "SELECT sample_id, spot_id, gene, count FROM measured_cells")
def _(v: Views):
    return op.measured_only(v.cells.select("sample_id", "spot_id", "gene", "count"), v.sample_genes)


@query(
    "J5_dense_truth",
    """SELECT s.sample_id, s.spot_id, g.gene, cast(coalesce(c.count, 0) AS bigint) AS true_count FROM spots s
JOIN sample_genes g ON g.sample_id = s.sample_id LEFT JOIN counts c ON c.sample_id = s.sample_id AND c.spot_id = s.spot_id AND c.gene = g.gene""",
)
def _(v: Views):
    return op.dense_truth(v.spots.select("sample_id", "spot_id"), v.sample_genes, v.counts)


@query(
    "J6_apply_split",
    """SELECT s.sample_id, s.organ, coalesce(t.split, 'unassigned') AS split FROM samples s LEFT JOIN
(SELECT sample_id, CASE WHEN organ = 'ASIA' THEN 'test' ELSE 'train' END AS split FROM samples WHERE spots_under_tissue >= 0) t USING (sample_id)""",
)
def _(v: Views):
    table = v.samples.filter("spots_under_tissue >= 0").select(
        "sample_id", F.when(F.col("organ") == "ASIA", "test").otherwise("train").alias("split"), F.lit("leave_slide_out").alias("split_type")
    )
    other = table.withColumn("split_type", F.lit("other")).withColumn("split", F.lit("never"))
    return op.apply_split(v.samples.select("sample_id", "organ", "split"), table.unionByName(other))


@query(
    "J8_label_lookup",
    """SELECT c_custkey, coalesce(organ, 'unknown') AS organ, coalesce(cohort, 'unknown') AS cohort FROM customer
LEFT JOIN samples ON sample_id = cast(c_custkey AS varchar)""",
)
def _(v: Views):
    d = v.table("customer").select("c_custkey", F.col("c_custkey").cast("string").alias("sample_id"))
    return op.with_labels(d, v.samples, ["organ", "cohort"]).drop("sample_id")


@query(
    "J9_mean_with_fallback",
    """WITH g AS (SELECT gene, avg(true_count) AS m FROM eval_cells GROUP BY gene),
o AS (SELECT organ, gene, avg(true_count) AS m FROM eval_cells JOIN samples USING (sample_id) WHERE split = 'val' GROUP BY ALL)
SELECT organ, g.gene, coalesce(o.m, g.m) AS mean_rate, o.m IS NULL AS is_fallback
FROM (SELECT DISTINCT organ FROM samples) JOIN g ON true LEFT JOIN o USING (organ, gene)""",
    "mean_rate",
)
def _(v: Views):
    labelled = v.eval_cells.join(v.samples.select("sample_id", "organ", "split"), "sample_id")
    overall = labelled.groupBy("gene").agg(F.avg("true_count").alias("mean_rate"))
    organ = labelled.filter("split = 'val'").groupBy("organ", "gene").agg(F.avg("true_count").alias("mean_rate"))
    return baselines.with_fallback(organ, overall, v.samples.select("organ").distinct())


@query(
    "J11_leakage",
    """SELECT group_col, value, count(DISTINCT split) AS n_splits, string_agg(DISTINCT split, '|' ORDER BY split) AS splits
FROM (SELECT split, 'patient_id' AS group_col, patient_id AS value FROM samples UNION ALL SELECT split, 'cohort', cohort FROM samples
UNION ALL SELECT split, 'sample_id', sample_id FROM samples) GROUP BY ALL HAVING count(DISTINCT split) > 1""",
)
def _(v: Views):
    return op.leaked_groups(v.samples, ["patient_id", "cohort", "sample_id", "absent_column"])


@query(
    "J12_calibration_overlap",
    "SELECT sample_id FROM samples WHERE spots_under_tissue > 3000 AND split = 'test'",
)
def _(v: Views):
    return op.calibration_overlap(v.samples.filter("spots_under_tissue > 3000"), v.samples.filter("split = 'test'"))


@query(
    "J15_metric_drift",
    """SELECT m AS metric, count(*) AS n_compared, 0.0 AS max_abs_delta, true AS within_tolerance
FROM (SELECT DISTINCT sample_id FROM counts) JOIN (VALUES ('mae'), ('pearson'), ('rmse')) t(m) ON true GROUP BY m""",
    "max_abs_delta",
)
def _(v: Views):
    """The same metrics by two routes: straight per sample, and merged from (sample, gene) sums."""
    from spotweave.functions.moments import merged_sums, metric_columns, pair_metrics

    pairs = evaluate.pairs_of_kind(v.eval_cells, "count")
    a = pair_metrics(pairs, ["sample_id"])
    b = evaluate.sample_gene_sums(pairs).groupBy("sample_id").agg(*merged_sums()).select("sample_id", *metric_columns())
    return op.metric_drift(a, b, ["sample_id"], ["pearson", "mae", "rmse"], 1.0e-8)


@query(
    "J16_side_by_side",
    f"""WITH m AS (SELECT organ, method, {PEARSON} AS pearson FROM (SELECT organ, method, {sums()} FROM ablations JOIN samples USING (sample_id) GROUP BY ALL))
SELECT a.organ, a.pearson AS pearson_a, b.pearson AS pearson_b, a.pearson - b.pearson AS delta
FROM m a LEFT JOIN m b ON a.organ = b.organ AND b.method = 'count_no_sf' WHERE a.method = 'count_pred_sf'""",
    "pearson_a pearson_b delta",
)
def _(v: Views):
    from spotweave.functions.moments import merged_sums, metric_columns

    s = evaluate.ablation_sums(v.ablation_cells, ["sample_id"]).join(v.samples.select("sample_id", "organ"), "sample_id")
    m = s.groupBy("organ", "method").agg(*merged_sums()).select("organ", "method", *metric_columns())
    a = m.filter("method = 'count_pred_sf'").select("organ", F.col("pearson").alias("pearson_a"))
    b = m.filter("method = 'count_no_sf'").select("organ", F.col("pearson").alias("pearson_b"))
    return a.join(b, "organ", "left").withColumn("delta", F.col("pearson_a") - F.col("pearson_b"))


@query(
    "J17_coordinates",
    "SELECT c.sample_id, c.spot_id, c.signature, c.rate_true, s.x, s.y FROM spot_scores c LEFT JOIN spots s USING (sample_id, spot_id)",
    "rate_true x y",
)
def _(v: Views):
    return op.with_coordinates(v.spot_scores.select("sample_id", "spot_id", "signature", "rate_true"), v.spots)


@query(
    "J18_target_consistency",
    """WITH a AS (SELECT sample_id, spot_id, gene, ln(1 + true_count) AS v FROM eval_cells),
b AS (SELECT sample_id, spot_id, gene, count, ln(1 + count) AS v FROM counts),
j AS (SELECT sample_id, spot_id, a.v AS av, b.v AS bv FROM a FULL JOIN b USING (sample_id, spot_id, gene)),
s AS (SELECT sample_id, spot_id, count(*) - count(av + bv) AS one_sided, count(av) > 0 AS in_a, count(bv) > 0 AS in_b, max(abs(av - bv)) AS d FROM j GROUP BY ALL)
SELECT sample_id, count(*) AS checked_spots, bool_and(in_a AND in_b) AS spot_ids_match, sum(one_sided) = 0 AS measured_genes_match, max(d) AS max_abs_diff FROM s GROUP BY sample_id""",
    "max_abs_diff",
)
def _(v: Views):
    """The dense target against the sparse one: same spots, but zeros are on one side only."""
    a = v.eval_cells.select("sample_id", "spot_id", "gene", F.log1p("true_count").alias("value"))
    return op.target_consistency(a, v.counts.select("sample_id", "spot_id", "gene", F.log1p("count").alias("value")))
