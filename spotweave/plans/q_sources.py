"""Sources and sinks: written to the shared folder and read back, or views of listing tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.operators import align, cohort, evaluate, generalization, sizefactor
from spotweave.plans.base_sql import PEARSON, define, sums
from spotweave.plans.q_evaluate import BUNDLE_SQL, bundle_rows
from spotweave.plans.q_models import LEAVE_OUT_ALL, gene_rows
from spotweave.plans.q_sfmetrics import SF, sf_sql
from spotweave.plans.q_splits import split_rows
from spotweave.plans.registry import query
from spotweave.session import materialise
from spotweave.sources import assets, tables
from spotweave.sources.views import Views, gene_set_table, GENE_SETS


def metadata_frame(v: Views):
    return v.samples.select(
        "dataset_title", F.col("sample_id").alias("id"), "image_filename", "organ", "species", F.col("patient_id").alias("patient"),
        "st_technology", F.col("spots_under_tissue").cast("string").alias("spots_under_tissue"), F.col("nb_genes_text").alias("nb_genes"),
    )


def _csv(v: Views, df, name: str) -> str:
    path = tables.scratch_path(v.spark, name)
    df.write.csv(path, header=True)
    return path


@query(
    "S1_metadata_source",
    """SELECT sample_id AS id, organ, species, cast(spots_under_tissue AS double) AS spots_under_tissue, try_cast(nb_genes_text AS double) AS nb_genes FROM samples""",
)
def _(v: Views):
    d = tables.read_metadata(v.spark, _csv(v, metadata_frame(v), "metadata"))
    return d.select("id", "organ", "species", "spots_under_tissue", "nb_genes")


@query("S2_manifest_source", "SELECT sample_id, split, 's' || sample_id || '/features' AS features_path FROM samples")
def _(v: Views):
    m = v.samples.select(
        "sample_id", "split", *[F.concat(F.lit("s"), "sample_id", F.lit(f"/{a}")).alias(f"{a}_path") for a in ("features", "counts")]
    )
    return tables.read_manifest(v.spark, _csv(v, m, "manifest")).select("sample_id", "split", "features_path")


@query(
    "S3_spot_tables",
    """SELECT t.sample_id, t.spot_id, t.x, t.y, t.total, t.total >= 40 AND s.sf > 0 AS valid, s.sf, ln(greatest(s.sf, 1e-8)) AS log_sf
FROM totals t JOIN sf_t s USING (sample_id, spot_id)""",
    "x y sf log_sf",
)
def _(v: Views):
    stored = v.sf.select("sample_id", "spot_id", F.col("sf").alias("stored_sf"))
    coords = v.spots
    return tables.spot_table(v.spots.select("sample_id", "spot_id"), coords, v.counts, stored, min_total=40)


@query(
    "S4_validation_report",
    """WITH f AS (SELECT sample_id, count(*) AS n FROM features GROUP BY 1), c AS (SELECT sample_id, count(DISTINCT spot_id) AS n FROM counts GROUP BY 1),
p AS (SELECT sample_id, count(*) AS n FROM spots GROUP BY 1),
j AS (SELECT s.sample_id, coalesce(f.n, 0) AS features_rows, coalesce(c.n, 0) AS counts_rows, coalesce(p.n, 0) AS coords_rows FROM samples s
  LEFT JOIN f USING (sample_id) LEFT JOIN c USING (sample_id) LEFT JOIN p USING (sample_id))
SELECT *, concat_ws(';', CASE WHEN features_rows = 0 THEN 'features' END, CASE WHEN counts_rows = 0 THEN 'counts' END, CASE WHEN coords_rows = 0 THEN 'coords' END) AS missing,
  CASE WHEN least(features_rows, counts_rows, coords_rows) = 0 THEN 'missing_required' WHEN features_rows <> counts_rows OR features_rows <> coords_rows THEN 'shape_mismatch' ELSE 'ok' END AS status FROM j""",
)
def _(v: Views):
    return assets.validation_report(v.features, v.counts, v.spots, v.samples)


@query("S5_gene_list_source", "SELECT gene, cast(row_number() OVER (ORDER BY gene_index) - 1 AS int) AS gene_index FROM genes")
def _(v: Views):
    """A list file in panel order with junk lines between."""
    path = tables.scratch_path(v.spark, "genes")
    packed = v.genes.agg(F.array_sort(F.collect_list(F.struct("gene_index", "gene"))).alias("a"))
    text = F.array_join(F.transform("a", lambda s: F.concat(F.lit(" "), s["gene"])), "\n\nNaN\n")
    packed.select(text.alias("value")).coalesce(1).write.text(path)
    return tables.selected_genes(v.spark, names_path=path)


@query("S5_gene_index_list", "SELECT cast(gene_index AS bigint) AS gene_index, cast(row_number() OVER (ORDER BY gene_index DESC) - 1 AS int) AS position FROM genes")
def _(v: Views):
    """A list of panel positions from the last to the first, with blank lines between."""
    path = tables.scratch_path(v.spark, "indices")
    packed = v.genes.agg(F.array_sort(F.collect_list(-F.col("gene_index"))).alias("a"))
    packed.select(F.array_join(F.transform("a", lambda i: (-i).cast("string")), "\n \n").alias("value")).coalesce(1).write.text(path)
    return tables.selected_genes(v.spark, indices_path=path)


_DEFAULT = ", ".join(f"('{s}', '{g}', {i})" for s, genes in tables.DEFAULT_GENE_SETS.items() for i, g in enumerate(genes))


@query(
    "S7_default_gene_sets",
    f"""SELECT d.signature, d.gene, d.position, g.gene IS NOT NULL AS on_panel FROM (VALUES {_DEFAULT}) d(signature, gene, position) LEFT JOIN genes g USING (gene)""",
)
def _(v: Views):
    sets = tables.read_gene_sets(v.spark)
    panel = v.genes.select("gene", F.lit(True).alias("on_panel"))
    return sets.join(panel, "gene", "left").select("signature", "gene", "position", F.coalesce("on_panel", F.lit(False)).alias("on_panel"))


@query(
    "S6_slide_gene_keys",
    """SELECT sample_id, gene, CASE WHEN gene_index % 5 = 0 THEN gene WHEN gene_index % 7 = 0 THEN NULL ELSE 'SYM' || gene_index END AS gene_key FROM sample_genes""",
)
def _(v: Views):
    i = F.col("gene_index")
    symbol = F.when(i % 5 == 0, F.lit(None)).when(i % 7 == 0, "none").otherwise(F.concat(F.lit("SYM"), i.cast("string")))
    return align.slide_gene_keys(v.sample_genes.withColumn("symbol", symbol), "symbol").select("sample_id", "gene", "gene_key")


@query(
    "S7_gene_set_source",
    """SELECT c.sample_id, s.signature, count(DISTINCT c.gene) AS n_genes, cast(sum(c.count) AS bigint) AS total FROM counts c JOIN gene_sets s USING (gene) GROUP BY ALL""",
)
def _(v: Views):
    noisy = gene_set_table(v.spark, GENE_SETS).select("signature", F.concat(F.lit(" "), "gene", F.lit(" ")).alias("gene"))
    blank = noisy.select("signature", F.lit("  ").alias("gene")).distinct()
    sets = tables.read_gene_sets(v.spark, _csv(v, noisy.unionByName(blank), "sets"))
    return v.counts.join(sets, "gene").groupBy("sample_id", "signature").agg(
        F.countDistinct("gene").alias("n_genes"), F.sum("count").alias("total")
    )


@query(
    "S9_prediction_choice",
    """SELECT sample_id, kind, arg_min(location, priority) AS location, min(priority) AS priority FROM
(SELECT cast(l_suppkey AS varchar) AS sample_id, l_returnflag AS kind, cast(l_linenumber AS int) AS priority, 'place-' || l_linenumber AS location, max(l_quantity) > 45 AS found
 FROM lineitem GROUP BY ALL) WHERE found GROUP BY ALL""",
)
def _(v: Views):
    c = v.table("lineitem").groupBy(
        F.col("l_suppkey").cast("string").alias("sample_id"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("priority")
    ).agg((F.max("l_quantity") > 45).alias("found"))
    c = c.withColumn("location", F.concat(F.lit("place-"), F.col("priority").cast("string")))
    return tables.choose_prediction_source(c)


@query("S10_counts_to_long", "SELECT sample_id, spot_id, gene, count FROM counts")
def _(v: Views):
    """Dense vectors by panel position, unpacked again."""
    m = v.counts.join(v.genes, "gene").groupBy("sample_id", "spot_id").agg(
        F.map_from_entries(F.collect_list(F.struct("gene_index", "count"))).alias("m")
    )
    last = v.genes.agg(F.max("gene_index").alias("last"))  # one row
    cells = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    dense = m.crossJoin(last).select("sample_id", "spot_id", cells.alias("values"))
    return tables.counts_to_long(dense, v.genes)


@query("S11_size_factor_sink", "SELECT sample_id, spot_id, sf, split FROM sf_t JOIN samples USING (sample_id) WHERE split <> 'train'", "sf")
def _(v: Views):
    path = tables.scratch_path(v.spark, "sf")
    tables.write_size_factors(v.sf.join(v.samples.select("sample_id", "split"), "sample_id"), path)
    return v.spark.read.parquet(path).filter("split <> 'train'").select("sample_id", "spot_id", "sf", "split")


_CONV = """WITH tot AS (SELECT cast(c_nationkey AS varchar) AS sample_id, c_custkey AS barcode, cast(floor(sum(o_totalprice)) AS bigint) AS total, count(*) AS nnz
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
j AS (SELECT coalesce(s.sample_id, p.sample_id) AS sample_id, s.barcode AS sb, p.barcode AS pb FROM st_barcodes s FULL JOIN patch_barcodes p ON s.sample_id = p.sample_id AND s.barcode = p.barcode),
n AS (SELECT sample_id, count(sb) AS st_n, count(pb) AS patch_n, count(sb + pb) AS kept_n FROM j GROUP BY 1),
k AS (SELECT j.sample_id, coalesce(total, 0) AS total, coalesce(nnz, 0) AS nnz FROM j LEFT JOIN tot t ON t.sample_id = j.sample_id AND t.barcode = j.sb WHERE sb IS NOT NULL AND pb IS NOT NULL),
m AS (SELECT sample_id, avg(CASE WHEN total >= 1 THEN total END) AS m FROM k GROUP BY 1),
a AS (SELECT sample_id, cast(sum(nnz) AS bigint) AS counts_nnz, count(CASE WHEN total >= 1 THEN 1 END) AS valid_n, count(CASE WHEN total < 1 THEN 1 END) AS invalid_n,
  min(total/m) AS sf_min, avg(total/m) AS sf_mean_all_spots, avg(CASE WHEN total >= 1 THEN total/m END) AS sf_mean_valid_spots, max(total/m) AS sf_max FROM k JOIN m USING (sample_id) GROUP BY 1),
r AS (SELECT n.*, CASE WHEN st_n > 0 THEN kept_n / st_n ELSE 0.0 END AS patch_coverage_of_st, a.* EXCLUDE (sample_id) FROM n LEFT JOIN a USING (sample_id)),
s AS (SELECT *, CASE WHEN st_n = 0 OR patch_n = 0 THEN 'missing_required_raw_asset' WHEN patch_coverage_of_st < 0.3 THEN 'below_min_patch_coverage' WHEN coalesce(valid_n, 0) = 0 THEN 'no_valid_spot' ELSE 'ok' END AS status FROM r)
SELECT sample_id, status, st_n, patch_n, kept_n, patch_coverage_of_st, """ + ", ".join(
    f"CASE WHEN status = 'ok' THEN {c} END AS {c}" for c in ("counts_nnz", "valid_n", "invalid_n", "sf_min", "sf_mean_all_spots", "sf_mean_valid_spots", "sf_max")
) + " FROM s"


@query("S12_conversion_report", _CONV, "patch_coverage_of_st sf_min sf_mean_all_spots sf_mean_valid_spots sf_max")
def _(v: Views):
    o = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    totals = o.groupBy(F.col("c_nationkey").cast("string").alias("sample_id"), F.col("c_custkey").alias("barcode")).agg(
        F.floor(F.sum("o_totalprice")).cast("bigint").alias("total"), F.count(F.lit(1)).alias("nnz")
    )
    return assets.conversion_report(v.st_barcodes, v.patch_barcodes, totals, 0.3)


define(
    "bundle",
    """WITH s AS (SELECT sample_id, spot_id, sf / ((SELECT avg(sf) FROM pred_log_sf) + 1e-8) AS true_sf, exp(pred_log_sf_raw) / ((SELECT avg(exp(pred_log_sf_raw)) FROM pred_log_sf) + 1e-8) AS pred_sf FROM pred_log_sf)
SELECT a.sample_id, a.spot_id, a.gene, a.pred_rate, s.pred_sf, ln(s.pred_sf + 1e-8) AS pred_log_sf, a.pred_rate * s.pred_sf AS pred_count, a.pred_rate AS pred_count_no_sf,
  a.pred_rate * s.true_sf AS pred_count_oracle_sf, a.true_count, a.true_count / greatest(s.true_sf, 1e-6) AS true_rate, s.true_sf
FROM ablation_cells a JOIN s USING (sample_id, spot_id)""",
)


def bundle(v: Views):
    one = sizefactor.normalise_predicted(v.pred_log_sf, scope=[], out="pred_sf").withColumn("_log", F.log("sf"))
    one = sizefactor.normalise_predicted(one, "_log", scope=[], out="true_sf").select("sample_id", "spot_id", "pred_sf", "true_sf")
    d = v.ablation_cells.drop("pred_sf").join(one, ["sample_id", "spot_id"])
    r = F.col("pred_rate")
    return d.select(
        "sample_id", "spot_id", "gene", "pred_rate", "pred_sf", F.log(F.col("pred_sf") + 1.0e-8).alias("pred_log_sf"),
        (r * F.col("pred_sf")).alias("pred_count"), r.alias("pred_count_no_sf"), (r * F.col("true_sf")).alias("pred_count_oracle_sf"),
        "true_count", (F.col("true_count") / F.greatest("true_sf", F.lit(1.0e-6))).alias("true_rate"), "true_sf",
    )


@query(
    "S13_prediction_bundle", "SELECT * FROM bundle",
    "pred_rate pred_sf pred_log_sf pred_count pred_count_no_sf pred_count_oracle_sf true_rate true_sf",
)
def _(v: Views):
    return bundle(v)


_BUNDLE_R = {k: f"(SELECT gene, {PEARSON} AS {k}_pearson FROM (SELECT gene, {sums(p, t)} FROM bundle GROUP BY gene))" for k, (p, t) in evaluate.BUNDLE_PAIRS.items()}
define(
    "bundle_genes",
    "SELECT * FROM (SELECT gene, avg(true_count) AS true_mean_count, avg(pred_count) AS pred_mean_count, var_pop(true_count) AS true_var_count, var_pop(pred_count) AS pred_var_count FROM bundle GROUP BY gene) "
    + " ".join(f"JOIN {q} USING (gene)" for q in _BUNDLE_R.values()),
)
define("bundle_spots", "SELECT DISTINCT 1 AS one, sample_id, spot_id, ln(pred_sf + 1e-8) AS pred_log_sf, ln(true_sf + 1e-8) AS true_log_sf FROM bundle")


@query("S13_bundle_gene_metrics", "SELECT * FROM bundle_genes", "true_mean_count pred_mean_count true_var_count pred_var_count " + " ".join(f"{k}_pearson" for k in _BUNDLE_R))
def _(v: Views):
    return evaluate.bundle_gene_metrics(bundle(v))


@query(
    "S13_bundle_metrics",
    "SELECT 'bundle' AS part, 'n_spots' AS metric, cast(count(*) AS double) AS value FROM bundle_spots UNION ALL SELECT 'bundle', 'n_genes', count(*) FROM bundle_genes"
    + "".join(f" UNION ALL SELECT 'sf', '{m}', {m} FROM ({sf_sql('one', 'bundle_spots')})" for m in SF.split())
    + "".join(
        f" UNION ALL SELECT '{k}', '{m}', {f} FROM bundle_genes" for k in _BUNDLE_R
        for m, f in (("mean_gene_pearson", f"avg({k}_pearson)"), ("median_gene_pearson", f"median({k}_pearson)"), ("valid_genes", f"count({k}_pearson)"))
    ),
    "value",
)
def _(v: Views):
    d = materialise(bundle(v))
    return evaluate.bundle_metrics(d, materialise(evaluate.bundle_gene_metrics(d)))


_HELD = " UNION ALL ".join(
    f"""SELECT 'leave_{key}_out' AS split_type, h AS heldout, s AS stage,
  CASE WHEN h NOT IN (SELECT {key} FROM gene_base) THEN 'missing_rows' WHEN metric IS NULL THEN 'missing_model' ELSE 'ok' END AS status, value
FROM (SELECT DISTINCT heldout AS h FROM split_rows WHERE split_type = 'leave_{key}_out') CROSS JOIN (VALUES ('sf'), ('expression'), ('combined')) t(s)
LEFT JOIN (SELECT heldout AS h, stage AS s, metric, value FROM ({LEAVE_OUT_ALL[key]})) USING (h, s)"""
    for key in ("organ", "cohort")
)
define(
    "formal",
    f"""SELECT split_type, heldout, trim(regexp_replace(lower(heldout), '[^a-z0-9]+', '_', 'g'), '_') AS task_slug, stage, status,
  CASE WHEN stage = 'sf' THEN value END AS metric_log_sf_pearson, CASE WHEN stage = 'expression' THEN value END AS metric_mean_gene_pearson,
  CASE WHEN stage = 'combined' THEN value END AS metric_count_pred_sf_mean_gene_pearson, 'formal_' || split_type AS run_name FROM ({_HELD})""",
)


def formal_rows(v: Views):
    """A result row per held-out label and stage, from models fitted without that label. The mart is kept; finished labels are not fitted again."""
    if not hasattr(v, "_formal"):
        v._formal_path = tables.scratch_path(v.spark, "results")
        d, genes = gene_rows(v, every_feature=True)
        tasks = split_rows(v).filter("split_type <> 'leave_slide_out'").select("split_type", "heldout").distinct()
        labels = {"leave_organ_out": "organ", "leave_cohort_out": "cohort"}
        v._formal = generalization.result_table(generalization.run_tasks(d, genes, tasks, labels, v._formal_path))
    return v._formal


def run_summaries(v: Views):
    """The result rows written as one CSV per run and found again by a glob."""
    root = tables.scratch_path(v.spark, "runs")
    for t in ("leave_organ_out", "leave_cohort_out"):
        formal_rows(v).filter(F.col("split_type") == t).drop("run_name").write.csv(f"{root}/formal_{t}/summary.csv", header=True)
    return tables.read_run_summaries(v.spark, f"{root}/formal_*/summary.csv")


@query(
    "S15_run_summaries",
    "SELECT run_name, split_type, heldout, stage, status, coalesce(metric_log_sf_pearson, metric_mean_gene_pearson, metric_count_pred_sf_mean_gene_pearson) AS value FROM formal",
    "value",
)
def _(v: Views):
    d = run_summaries(v)
    val = F.coalesce("metric_log_sf_pearson", "metric_mean_gene_pearson", "metric_count_pred_sf_mean_gene_pearson")
    return d.select("run_name", "split_type", "heldout", "stage", "status", val.try_cast("double").alias("value"))


@query(
    "S16_metric_marts",
    """SELECT 'per_gene' AS mart, count(DISTINCT gene) AS n_rows FROM eval_cells UNION ALL SELECT 'slides', count(DISTINCT sample_id) FROM eval_cells
UNION ALL SELECT 'levels', count(DISTINCT split) + count(DISTINCT split || '/' || organ) + count(DISTINCT sample_id) FROM eval_cells JOIN samples USING (sample_id) UNION ALL SELECT 'summary', 1""",
)
def _(v: Views):
    """All marts of a bundle written to folders and read back."""
    marts = evaluate.evaluate_bundle(v.eval_cells, v.samples, "rate")
    paths = tables.write_marts(marts, tables.scratch_path(v.spark, "marts"))
    out = None
    for name, path in paths.items():
        n = v.spark.read.parquet(path).agg(F.lit(name).alias("mart"), F.count(F.lit(1)).alias("n_rows"))
        out = n if out is None else out.unionByName(n)
    return out


@query("S16_metric_values", BUNDLE_SQL, "a b")
def _(v: Views):
    """The values of all marts, written to folders and read back."""
    paths = tables.write_marts(evaluate.evaluate_bundle(v.eval_cells, v.samples, "log1p_count", ["test"]), tables.scratch_path(v.spark, "marts"))
    return bundle_rows({name: v.spark.read.parquet(path) for name, path in paths.items()})


_STATUS = """SELECT p.sample_id, p.path, p.asset_group, size_bytes AS expected_bytes, coalesce(actual_bytes, 0) AS actual_bytes,
  greatest(size_bytes - coalesce(actual_bytes, 0), 0) AS remaining_bytes, CASE WHEN actual_bytes IS NULL THEN 'missing' WHEN actual_bytes = size_bytes THEN 'complete' ELSE 'size_mismatch' END AS status,
  actual_bytes IS NOT NULL AS already_downloaded FROM asset_plan p LEFT JOIN asset_listing USING (path)"""


@query("S18_asset_status", _STATUS)
def _(v: Views):
    return assets.asset_plan_status(v.asset_plan, v.asset_listing)


@query(
    "S18_asset_totals",
    f"""SELECT status, count(*) AS n_files, cast(sum(expected_bytes) AS bigint) AS expected_bytes, cast(sum(actual_bytes) AS bigint) AS actual_bytes,
cast(sum(CASE WHEN status <> 'complete' THEN expected_bytes ELSE 0 END) AS bigint) AS remaining_expected_bytes FROM ({_STATUS}) GROUP BY status""",
)
def _(v: Views):
    return assets.asset_totals(assets.asset_plan_status(v.asset_plan, v.asset_listing))


@query("S18_planned_paths", "SELECT sample_id, g AS asset_group, p || sample_id || s AS path FROM samples, (VALUES ('counts', 'st/', '.parquet'), ('thumbnail', 'thumbs/', '_small.jpg')) t(g, p, s)")
def _(v: Views):
    patterns = v.spark.createDataFrame([("counts", "st/", ".parquet"), ("thumbnail", "thumbs/", "_small.jpg")], "asset_group string, prefix string, suffix string")
    return assets.planned_paths(v.samples, patterns)


@query("S19_split_source", "SELECT sample_id, organ FROM samples WHERE species = 'Homo sapiens' AND st_technology = 'Visium' AND spots_under_tissue >= 200")
def _(v: Views):
    """An empty manifest falls back to the filtered metadata."""
    fallback = cohort.cohort_filter(v.samples).select("sample_id", "organ")
    return cohort.first_non_empty(fallback.filter("organ = 'no such organ'"), fallback)
