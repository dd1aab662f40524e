"""Totals, size factors, standardisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.functions.scalars import log_sf_shifted
from spotweave.operators import sizefactor as op
from spotweave.operators import align
from spotweave.plans.registry import query
from spotweave.sources.views import Views


@query("A1_spot_totals", "SELECT sample_id, spot_id, total FROM totals")
def _(v: Views):
    return v.totals.select("sample_id", "spot_id", "total")


@query("A2_size_factor", "SELECT sample_id, spot_id, total, valid, sf, log_sf FROM sf_t", "sf log_sf")
def _(v: Views):
    return op.size_factor(v.totals, strict=True).select("sample_id", "spot_id", "total", "valid", "sf", "log_sf")


@query(
    "A3_log_size_factor_raw",
    """SELECT sample_id, spot_id, ln(total / m + 1e-8) AS log_sf FROM totals
JOIN (SELECT sample_id, avg(CASE WHEN total > 0 THEN total END) AS m FROM totals GROUP BY ALL) USING (sample_id)""",
    "log_sf",
)
def _(v: Views):
    return op.log_size_factor_of_totals(v.totals).select("sample_id", "spot_id", "log_sf")


@query(
    "A4_predicted_sf_mean_one",
    """SELECT sample_id, spot_id, e / m AS plain, e / (m + 1e-8) AS eps, CASE WHEN m > 0 THEN e / m ELSE e END AS guarded
FROM (SELECT *, exp(pred_log_sf_raw) AS e, avg(exp(pred_log_sf_raw)) OVER (PARTITION BY sample_id) AS m FROM pred_log_sf)""",
    "plain eps guarded",
)
def _(v: Views):
    return op.normalised_variants(v.pred_log_sf).select("sample_id", "spot_id", "plain", "eps", "guarded")


@query(
    "A5_feature_standardizer",
    """SELECT cast(i AS int) AS dim, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END AS std
FROM (SELECT unnest(range(0, 64)) AS i, unnest(features) AS x FROM features JOIN (SELECT 1) ON true) GROUP BY ALL""",
    "mean std",
)
def _(v: Views):
    s = op.fit_standardizer(v.features)
    return s.select(F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "s")).select("dim", "s.mean", "s.std")


@query(
    "A6_log1p_rate_targets",
    """SELECT e.sample_id, e.spot_id, e.gene, e.true_count, ln(1 + e.true_count / greatest(e.sf, 1e-6)) AS log1p_rate,
  ln(greatest(e.sf, 1e-8)) AS true_log_sf FROM eval_cells e JOIN samples s ON s.sample_id = e.sample_id
  WHERE s.split IN ('train', 'val')""",
    "log1p_rate true_log_sf",
)
def _(v: Views):
    chosen = v.samples.filter(F.col("split").isin("train", "val")).select("sample_id")
    spots = v.sf.filter("valid").select("sample_id", "spot_id", "sf", F.col("log_sf").alias("true_log_sf"))
    spots = spots.join(chosen, "sample_id", "left_semi")
    cells = align.dense_truth(spots, v.sample_genes, v.counts)
    return op.log1p_rate_targets(cells).drop("sf")


@query(
    "A7_asset_audit",
    """SELECT sample_id, count(st_index) AS st_n, count(patch_index) AS patch_n, count(d) AS intersection,
  count(CASE WHEN st_index IS NULL THEN 1 END) AS patch_not_in_st,
  count(CASE WHEN patch_index IS NULL THEN 1 END) AS st_not_in_patch,
  CASE WHEN count(patch_index) > 0 THEN count(d) / count(patch_index) END AS st_coverage_of_patch,
  CASE WHEN count(st_index) > 0 THEN count(d) / count(st_index) END AS patch_coverage_of_st,
  min(sx) AS total_min, median(sx) AS total_median, avg(sx) AS total_mean, max(sx) AS total_max,
  avg(d) AS mean_dx, avg(e) AS mean_dy, stddev_pop(d) AS std_dx, stddev_pop(e) AS std_dy, max(abs(d)) AS max_abs_dx,
  max(abs(e)) AS max_abs_dy,
  coalesce(bool_and(up), true) AS barcode_order_monotonic
FROM (SELECT sample_id, s.st_index, p.patch_index, s.x AS sx, p.x - s.x AS d, p.y - s.y AS e,
    CASE WHEN s.st_index IS NOT NULL AND p.patch_index IS NOT NULL THEN s.st_index > lag(s.st_index) OVER (PARTITION BY sample_id, s.st_index IS NULL OR p.patch_index IS NULL ORDER BY p.patch_index) END AS up
  FROM st_barcodes s FULL JOIN patch_barcodes p USING (sample_id, barcode)) GROUP BY sample_id""",
    "st_coverage_of_patch patch_coverage_of_st total_min total_median total_mean total_max mean_dx mean_dy std_dx std_dy max_abs_dx max_abs_dy",
)
def _(v: Views):
    from spotweave.sources.assets import audit_samples

    return audit_samples(v.st_barcodes, v.patch_barcodes, total="x")


@query(
    "A8_asset_audit_rollup",
    """WITH a AS (SELECT sample_id, count(st_index) AS st_n, count(patch_index) AS patch_n, count(both_) AS n_both
FROM (SELECT sample_id, s.st_index, p.patch_index, CASE WHEN s.st_index IS NOT NULL AND p.patch_index IS NOT NULL THEN 1 END AS both_
  FROM st_barcodes s FULL JOIN patch_barcodes p USING (sample_id, barcode)) GROUP BY sample_id),
b AS (SELECT *, n_both / nullif(st_n, 0) AS cov,
  CASE WHEN n_both = 0 THEN 'no_overlap' WHEN n_both / nullif(st_n, 0) < 0.5 THEN 'low_coverage' ELSE 'ok' END AS status FROM a)
SELECT 'status' AS part, status AS key, count(*) AS n, avg(cov) AS mean_coverage, min(cov) AS min_coverage FROM b GROUP BY status
UNION ALL (SELECT 'worst', sample_id, st_n, cov, cov FROM b WHERE status <> 'no_overlap' ORDER BY cov, sample_id LIMIT 20)""",
    "mean_coverage min_coverage",
)
def _(v: Views):
    from spotweave.sources.assets import audit_rollup, audit_samples

    return audit_rollup(audit_samples(v.st_barcodes, v.patch_barcodes, total="x"), min_coverage=0.5)


@query(
    "A9_sf_training_set",
    """WITH d AS (SELECT f.sample_id, f.spot_id, t.log_sf, f.features FROM features f
  JOIN sf_t t ON t.sample_id = f.sample_id AND t.spot_id = f.spot_id % 72 AND t.valid
  JOIN samples s ON s.sample_id = f.sample_id WHERE s.split = 'train'),
u AS (SELECT sample_id, spot_id, log_sf, unnest(range(0, 64)) AS i, unnest(features)::double AS x FROM d),
m AS (SELECT i, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END AS std FROM u GROUP BY i)
SELECT sample_id, spot_id, cast(i AS int) AS dim, log_sf, (x - mean) / std AS x FROM u JOIN m USING (i)""",
    "log_sf x",
)
def _(v: Views):
    f = v.features.withColumn("_spot", F.col("spot_id")).withColumn("spot_id", F.col("spot_id") % 72)
    # The vectors stand for spots of the sample that carries their label, several per grid position.
    target = f.select("sample_id", "spot_id", "_spot").join(v.sf, ["sample_id", "spot_id"])
    target = target.select("sample_id", F.col("_spot").alias("spot_id"), "valid", "log_sf")
    d = op.sf_training_set(v.features, target, v.samples, ["train"])
    return d.select("sample_id", "spot_id", "log_sf", F.posexplode("features").alias("dim", "x"))


@query(
    "P16_log_sf_variants",
    "SELECT sample_id, spot_id, ln(greatest(sf, 1e-8)) AS clipped, ln(sf + 1e-8) AS shifted FROM sf_t",
    "clipped shifted",
)
def _(v: Views):
    return v.sf.select("sample_id", "spot_id", F.col("log_sf").alias("clipped"), log_sf_shifted(F.col("sf")).alias("shifted"))
