"""Statistical baselines and gene selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.functions.moments import metric_columns
from spotweave.operators import baselines as op
from spotweave.operators import cohort, evaluate, sfmetrics
from spotweave.plans.base_sql import METRIC_DOUBLES, PEARSON, define, exact_sums, metrics, sums
from spotweave.plans.q_evaluate import GENE_DOUBLES, _levels
from spotweave.plans.q_sfmetrics import SF, sf_sql
from spotweave.plans.registry import query
from spotweave.sources.views import MARKER_CLASSES, Views

define("true_rates", "SELECT e.*, true_count / greatest(sf, 1e-6) AS true_rate, split, organ FROM eval_cells e JOIN samples USING (sample_id)")
define("global_rate", "SELECT gene, avg(true_rate) AS mean_rate, count(*) AS n_spots FROM true_rates WHERE split = 'train' GROUP BY gene")
define("organ_rate", "SELECT organ, gene, avg(true_rate) AS mean_rate, count(*) AS n_spots FROM true_rates WHERE split = 'train' GROUP BY organ, gene")
define(
    "baseline_cells",
    """SELECT t.sample_id, t.spot_id, t.gene, t.true_count, t.true_rate, t.sf, p.pred_sf, coalesce(g.mean_rate, 0) AS rg,
  coalesce(o.mean_rate, g.mean_rate, 0) AS ro FROM true_rates t JOIN pred_sf p USING (sample_id, spot_id)
LEFT JOIN global_rate g ON g.gene = t.gene LEFT JOIN organ_rate o ON o.gene = t.gene AND o.organ = t.organ""",
)
define(
    "baseline_pairs",
    "\nUNION ALL ".join(
        f"SELECT sample_id, spot_id, gene, '{m}' AS method, '{k}' AS prediction_kind, {p} AS pred, {t} AS true_ FROM baseline_cells"
        for m, k, p, t in (
            ("global_mean_rate", "rate", "rg", "true_rate"),
            ("global_sf_only_count_pred_sf", "count", "rg * pred_sf", "true_count"),
            ("global_sf_only_count_oracle_sf", "count", "rg * sf", "true_count"),
            ("organ_sf_only_count_pred_sf", "count", "ro * pred_sf", "true_count"),
            ("organ_sf_only_count_oracle_sf", "count", "ro * sf", "true_count"),
        )
    ),
)
MK = "method, prediction_kind"


def _train(v: Views):
    return v.samples.filter("split = 'train'")


def _rates(v: Views, by=None):
    train = _train(v)
    sf = v.sf.join(train.select("sample_id"), "sample_id", "left_semi")
    return op.mean_rates(v.rated_counts, sf, v.sample_genes, train, by)


def _sums(v: Views):
    spots = v.pred_sf.select("sample_id", "spot_id", "sf", "pred_sf")
    return op.baseline_sums(v.rated_counts, spots, v.sample_genes, v.samples, _rates(v), _rates(v, ["organ"]))


@query("B1_global_mean_rate", "SELECT gene, mean_rate, n_spots FROM global_rate", "mean_rate")
def _(v: Views):
    return _rates(v)


@query(
    "B2_organ_mean_rate",
    """SELECT d.organ, g.gene, coalesce(o.mean_rate, g.mean_rate) AS mean_rate, o.mean_rate IS NULL AS is_fallback
FROM (SELECT DISTINCT organ FROM samples) d JOIN global_rate g ON true LEFT JOIN organ_rate o ON o.organ = d.organ AND o.gene = g.gene""",
    "mean_rate",
)
def _(v: Views):
    return op.with_fallback(_rates(v, ["organ"]), _rates(v), v.samples.select("organ").distinct())


@query("B3_baseline_gene_metrics", f"SELECT {MK}, gene, {metrics('n_obs', True)} FROM (SELECT {MK}, gene, {exact_sums()} FROM baseline_pairs GROUP BY {MK}, gene)", GENE_DOUBLES)
def _(v: Views):
    return op.baseline_marts(_sums(v), v.samples)["per_gene"]


@query("B3_baseline_levels", _levels("baseline_pairs", MK), METRIC_DOUBLES)
def _(v: Views):
    return op.baseline_marts(_sums(v), v.samples)["levels"]


@query(
    "B3_baseline_summary",
    f"""SELECT {MK}, avg(r) AS mean_gene_pearson, quantile_cont(r, 0.5) AS median_gene_pearson, count(r) AS valid_genes
FROM (SELECT {MK}, gene, {PEARSON} AS r FROM (SELECT {MK}, gene, {exact_sums()} FROM baseline_pairs GROUP BY {MK}, gene)) GROUP BY {MK}""",
    "mean_gene_pearson median_gene_pearson",
)
def _(v: Views):
    return op.baseline_marts(_sums(v), v.samples)["summary"]


@query(
    "B3_slides_with_sf",
    """SELECT p.*, g.n_measured_genes, s.split, s.organ, s.cohort FROM (SELECT sample_id, count(*) AS n_spots, avg(pred_sf) AS pred_sf_mean,
  stddev_pop(pred_sf) AS pred_sf_std, stddev_pop(sf) AS true_sf_std FROM pred_sf GROUP BY sample_id) p
JOIN (SELECT sample_id, count(*) AS n_measured_genes FROM sample_genes GROUP BY sample_id) g USING (sample_id) JOIN samples s USING (sample_id)""",
    "pred_sf_mean pred_sf_std true_sf_std",
)
def _(v: Views):
    return op.slides_with_sf(v.pred_sf, v.sample_genes, v.samples)


@query("B4_constant_sf", sf_sql("split", "(SELECT *, 0.0 AS zero FROM sf_spots)", "zero", exact_sums), SF)
def _(v: Views):
    return sfmetrics.sf_metrics(v.sf_spots.withColumn("zero", F.lit(0.0)), ["split"], "zero")


@query(
    "B5_gene_presence",
    """SELECT gene, slides_present, n_slides, required_slides, slides_present >= required_slides AS is_candidate
FROM (SELECT gene, count(DISTINCT sample_id) AS slides_present FROM sample_genes GROUP BY gene),
(SELECT count(*) AS n_slides, cast(greatest(2, ceil(0.7::double * count(*))) AS bigint) AS required_slides FROM samples)""",
)
def _(v: Views):
    return op.gene_presence(v.sample_genes, v.samples, 2, 0.7)


@query(
    "B6_gene_selection",
    """WITH n AS (SELECT sample_id, count(*) AS n FROM sf_t WHERE valid GROUP BY sample_id),
p AS (SELECT gene, count(DISTINCT sample_id) AS slides_present, cast(sum(n) AS bigint) AS measured_spots FROM sample_genes JOIN n USING (sample_id) GROUP BY gene),
c AS (SELECT gene, cast(sum(count) AS bigint) AS total_count, count(*) AS detected_spots FROM counts GROUP BY gene), t AS (SELECT sum(n) AS nv, (SELECT count(*) FROM samples) AS ns FROM n)
SELECT gene, slides_present, slides_present / ns AS slide_fraction, measured_spots, total_count, total_count / nv AS mean_count, detected_spots,
  detected_spots / nv AS detected_fraction, detected_spots / measured_spots AS detected_fraction_measured
FROM p JOIN c USING (gene), t ORDER BY slides_present DESC, detected_spots DESC, total_count DESC, gene LIMIT 12""",
    "slide_fraction mean_count detected_fraction detected_fraction_measured",
)
def _(v: Views):
    return op.gene_selection_report(v.counts, v.sf, v.sample_genes, v.samples, min_slides=2, min_detected=1, top_n=12)


@query(
    "B7_target_coverage",
    """WITH c AS (SELECT s.sample_id, s.split, s.organ, count(g.gene) AS c FROM samples s LEFT JOIN
(SELECT sample_id, gene FROM sample_genes WHERE gene IN (SELECT gene FROM gene_sets)) g USING (sample_id) GROUP BY ALL)
SELECT 'slide' AS level, sample_id AS key, 1 AS n_slides, c AS min_genes, cast(c AS double) AS median_genes, c AS max_genes FROM c
UNION ALL SELECT 'split', split, count(*), min(c), median(c), max(c) FROM c GROUP BY split
UNION ALL SELECT 'organ', organ, count(*), min(c), median(c), max(c) FROM c GROUP BY organ""",
    "median_genes",
)
def _(v: Views):
    c = op.target_coverage(v.sample_genes, v.gene_sets.select("gene").distinct(), v.samples)
    g = F.col("measured_target_genes")
    slide = c.select(
        F.lit("slide").alias("level"), F.col("sample_id").alias("key"), F.lit(1).cast("long").alias("n_slides"), g.alias("min_genes"),
        g.cast("double").alias("median_genes"), g.alias("max_genes"),
    )
    for k in ("split", "organ"):
        slide = slide.unionByName(op.coverage_by_group(c, [k]).withColumnRenamed(k, "key").withColumn("level", F.lit(k)))
    return slide


def _classes(v: Views):
    rows = [(p, c, g) for p, c, genes in MARKER_CLASSES for g in genes]
    return v.spark.createDataFrame(rows, "priority int, gene_class string, gene string")


define(
    "gene_diag",
    f"""SELECT m.*, coalesce(k.gene_class, 'other') AS gene_class FROM
(SELECT gene, max(n) AS n_obs, {", ".join(f"max(CASE WHEN method = '{m}' THEN r END) AS {m}_pearson, max(CASE WHEN method = '{m}' THEN mae END) AS {m}_mae" for m in ('rate', 'count_no_sf', 'count_pred_sf', 'count_oracle_sf'))},
 max(CASE WHEN method = 'count_pred_sf' THEN rmse END) AS count_pred_sf_rmse, max(CASE WHEN method = 'count_pred_sf' THEN det END) AS count_pred_sf_detected_fraction,
 max(CASE WHEN method = 'count_pred_sf' THEN tstd END) AS count_pred_sf_true_std
FROM (SELECT gene, method, n, {PEARSON} AS r, sae/n AS mae, sqrt(sse/n) AS rmse, nz*1.0/n AS det, sqrt(stt/n-(st/n)^2) AS tstd
  FROM (SELECT gene, method, {sums()} FROM ablations GROUP BY gene, method)) GROUP BY gene) m
LEFT JOIN (SELECT gene, arg_min(gene_class, priority) AS gene_class FROM marker_classes GROUP BY gene) k USING (gene)""",
)
DIAG = "rate_pearson count_no_sf_pearson count_pred_sf_pearson count_oracle_sf_pearson rate_mae count_no_sf_mae count_pred_sf_mae count_oracle_sf_mae count_pred_sf_rmse count_pred_sf_detected_fraction count_pred_sf_true_std"


def gene_diagnostics(v: Views):
    """Ablation metrics of a gene side by side, with its class."""
    m = evaluate.ablation_sums(v.ablation_cells, ["gene"]).select("method", "gene", *metric_columns("n_obs", True))
    of = lambda method, c: F.max(F.when(F.col("method") == method, F.col(c))).alias(f"{method}_{c}")
    cols = [of(a, c) for a in evaluate.ABLATIONS for c in ("pearson", "mae")]
    cols += [of("count_pred_sf", c) for c in ("rmse", "detected_fraction", "true_std")]
    wide = m.groupBy("gene").agg(F.max("n_obs").alias("n_obs"), *cols)
    return cohort.gene_classes(wide, _classes(v))


@query("E13_gene_diagnostics", "SELECT * FROM gene_diag", DIAG)
def _(v: Views):
    return gene_diagnostics(v)


_CLASS_METRICS = ["rate_pearson", "count_no_sf_pearson", "count_pred_sf_pearson", "count_oracle_sf_pearson", "count_pred_sf_mae", "count_pred_sf_rmse", "count_pred_sf_detected_fraction"]


@query(
    "E14_gene_class_summary",
    "SELECT gene_class, count(*) AS n_genes, count(count_pred_sf_pearson) AS n_valid_count_pred_sf, "
    + ", ".join(f"avg({c}) AS mean_{c}, quantile_cont({c}, 0.5) AS median_{c}" for c in _CLASS_METRICS)
    + " FROM gene_diag GROUP BY gene_class",
    " ".join(f"mean_{c} median_{c}" for c in _CLASS_METRICS),
)
def _(v: Views):
    aggs = [f(c).alias(f"{n}_{c}") for c in _CLASS_METRICS for n, f in (("mean", F.avg), ("median", lambda x: F.percentile(x, 0.5)))]
    return gene_diagnostics(v).groupBy("gene_class").agg(
        F.count(F.lit(1)).alias("n_genes"), F.count("count_pred_sf_pearson").alias("n_valid_count_pred_sf"), *aggs
    )


@query(
    "J14_gene_report_join",
    f"""SELECT d.gene, d.gene_class, d.count_pred_sf_pearson, r.total_count AS selection_total_count, r.slides_present AS selection_slides_present
FROM gene_diag d LEFT JOIN (SELECT gene, cast(sum(count) AS bigint) AS total_count FROM counts GROUP BY gene) c USING (gene)
LEFT JOIN (SELECT gene, count(DISTINCT sample_id) AS slides_present, any_value(tc) AS total_count FROM sample_genes
  JOIN (SELECT gene, cast(sum(count) AS bigint) AS tc FROM counts GROUP BY gene) USING (gene) GROUP BY gene) r USING (gene)""",
    "count_pred_sf_pearson",
)
def _(v: Views):
    report = op.gene_selection_report(v.counts, v.sf, v.sample_genes, v.samples)
    keep = ["total_count", "slides_present"]
    report = report.select("gene", *[F.col(c).alias(f"selection_{c}") for c in keep])
    return gene_diagnostics(v).select("gene", "gene_class", "count_pred_sf_pearson").join(report, "gene", "left")


@query(
    "B8_overlay_genes",
    """WITH ok AS (SELECT gene, gene_class, count_pred_sf_pearson AS pearson FROM gene_diag WHERE count_pred_sf_pearson IS NOT NULL AND n_obs >= 100 AND count_pred_sf_true_std > 0),
e AS (SELECT * FROM ok WHERE gene_class <> 'other' OR (SELECT count(*) FROM ok WHERE gene_class <> 'other') < 3),
r AS (SELECT *, row_number() OVER (ORDER BY pearson, gene) - 1 AS i, count(*) OVER () AS n FROM e),
p AS (SELECT gene, i AS pos_, 'poor' AS selection_reason FROM r WHERE i < 2 UNION ALL SELECT gene, 2, 'median' FROM r WHERE i = n // 2
UNION ALL SELECT gene, n - i + 2, 'good' FROM r WHERE i >= n - 3),
f AS (SELECT gene, min(pos_) AS pos_, arg_min(selection_reason, pos_) AS selection_reason FROM p GROUP BY gene ORDER BY 2 LIMIT 6)
SELECT f.gene, selection_reason, gene_class, pearson FROM f JOIN e USING (gene)""",
    "pearson",
)
def _(v: Views):
    d = gene_diagnostics(v).select(
        "gene", "gene_class", "n_obs", F.col("count_pred_sf_pearson").alias("pearson"), F.col("count_pred_sf_true_std").alias("true_std")
    )
    return op.overlay_genes(d)


@query(
    "B9_diagnostic_slides",
    f"""WITH m AS ({sf_sql('sample_id', 'sf_spots')}),
p AS (SELECT sample_id, 'worst' AS selection_reason, row_number() OVER (ORDER BY log_sf_pearson, sample_id) AS pos_ FROM m QUALIFY pos_ <= 4
UNION ALL SELECT sample_id, 'best', 100 + row_number() OVER (ORDER BY log_sf_pearson DESC, sample_id) AS pos_ FROM m QUALIFY pos_ <= 104
UNION ALL SELECT sample_id, 'low_tail', 200 + row_number() OVER (ORDER BY sf_top_decile_mean_ratio, sample_id) AS pos_ FROM m QUALIFY pos_ <= 204)
SELECT sample_id, arg_min(selection_reason, pos_) AS selection_reason FROM p GROUP BY sample_id ORDER BY min(pos_) LIMIT 8""",
)
def _(v: Views):
    return op.diagnostic_slides(sfmetrics.sf_metrics(v.sf_spots, ["sample_id"]))
