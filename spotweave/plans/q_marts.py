"""Cohort summaries, readiness and evidence marts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from spotweave.functions.moments import metric_columns
from spotweave.operators import baselines as bl
from spotweave.operators import composition as comp
from spotweave.operators import evaluate, genesets, heldout, marts as op, spatial, splits, states
from spotweave.operators.ordering import group_quantile
from spotweave.plans import q_genesets as qg
from spotweave.plans import q_models as qm
from spotweave.plans import q_spatial as qs
from spotweave.plans.base_sql import PEARSON, define, exact_sums, sums
from spotweave.plans.q_baselines import _sums
from spotweave.plans.q_evaluate import _ABL_SUMMARY
from spotweave.plans.q_sources import formal_rows
from spotweave.plans.registry import query
from spotweave.session import materialise
from spotweave.sources.views import Views


@query(
    "R1_value_counts",
    "\nUNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value, count(*) AS n_slides FROM samples GROUP BY {c}" for c in ("species", "st_technology", "organ", "dataset_title")),
)
def _(v: Views):
    return op.value_counts(v.samples, ["species", "st_technology", "organ", "dataset_title"])


@query(
    "R1_spot_stats",
    """SELECT organ, count(spots_under_tissue) AS count, cast(sum(spots_under_tissue) AS bigint) AS sum, median(spots_under_tissue) AS median, min(spots_under_tissue) AS min,
max(spots_under_tissue) AS max FROM samples GROUP BY organ""",
    "median",
)
def _(v: Views):
    return op.spot_stats(v.samples)


define(
    "sample_assets",
    """SELECT sample_id, a AS asset, 's' || sample_id || '/' || a AS path, CASE a WHEN 'features' THEN spots_under_tissue >= 500 WHEN 'counts' THEN sample_id IN (SELECT sample_id FROM counts)
  WHEN 'coords' THEN true ELSE sample_id IN (SELECT sample_id FROM counts WHERE count >= 80) END AS found
FROM samples, (VALUES ('features'), ('counts'), ('coords'), ('size_factor')) t(a)""",
)


def sample_assets(v: Views):
    """Which stored assets each sample has, judged by its data."""
    any_count = v.counts.groupBy("sample_id").agg(F.max("count").alias("_top"))
    s = v.samples.select("sample_id", "spots_under_tissue").join(any_count.hint("merge"), "sample_id", "left")
    found = {
        "features": F.col("spots_under_tissue") >= 500, "counts": F.col("_top").isNotNull(), "coords": F.lit(True),
        "size_factor": F.coalesce(F.col("_top") >= 80, F.lit(False)),
    }
    rows = F.array(*[F.struct(F.lit(a).alias("asset"), f.alias("found")) for a, f in found.items()])
    d = s.select("sample_id", F.explode(rows).alias("r")).select("sample_id", "r.asset", "r.found")
    return d.select("sample_id", "asset", F.concat(F.lit("s"), "sample_id", F.lit("/"), "asset").alias("path"), "found")


define(
    "manifest_assets",
    """SELECT * FROM sample_assets UNION ALL
SELECT sample_id, a, 's' || sample_id || '/' || a, CASE a WHEN 'spots' THEN spots_under_tissue >= 800 ELSE spots_under_tissue % 2 = 0 END FROM samples, (VALUES ('spots'), ('genes')) t(a)""",
)


def manifest_assets(v: Views):
    """The assets of `sample_assets` and the optional spot and gene lists."""
    found = {"spots": F.col("spots_under_tissue") >= 800, "genes": F.col("spots_under_tissue") % 2 == 0}
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("asset"), f.alias("found")) for a, f in found.items()])).alias("r")
    d = v.samples.select("sample_id", rows).select("sample_id", "r.asset", "r.found")
    more = d.select("sample_id", "asset", F.concat(F.lit("s"), "sample_id", F.lit("/"), "asset").alias("path"), "found")
    return sample_assets(v).unionByName(more)


_FLAGS = "SELECT sample_id, " + ", ".join(f"bool_or(found) FILTER (asset = '{a}') AS has_{a}" for a in ("features", "counts", "coords", "size_factor", "spots", "genes")) + " FROM manifest_assets GROUP BY 1"


@query(
    "R2_manifest_candidates",
    f"""SELECT s.sample_id, organ, st_technology AS platform, dataset_title, has_features, has_counts, has_coords, has_size_factor, has_features AND has_counts AND has_coords AS ready_for_training
FROM samples s JOIN ({_FLAGS}) f USING (sample_id)""",
)
def _(v: Views):
    return op.manifest(v.samples, manifest_assets(v))[0]


@query(
    "R2_manifest",
    f"""SELECT s.sample_id, patient_id, cohort, organ, disease_state, st_technology AS platform, dataset_title, '' AS study_link, 'unsplit' AS split, 's' || s.sample_id || '/features' AS features_path,
's' || s.sample_id || '/counts' AS counts_path, 's' || s.sample_id || '/coords' AS coords_path, CASE WHEN has_size_factor THEN 's' || s.sample_id || '/size_factor' ELSE '' END AS size_factor_path,
CASE WHEN has_spots THEN 's' || s.sample_id || '/spots' ELSE '' END AS spots_path, CASE WHEN has_genes THEN 's' || s.sample_id || '/genes' ELSE '' END AS genes_path,
spots_under_tissue AS n_spots, TRY_CAST(nb_genes_text AS DOUBLE) AS n_genes, 'mean' AS sf_normalization FROM samples s JOIN ({_FLAGS}) f USING (sample_id) WHERE has_features AND has_counts AND has_coords""",
)
def _(v: Views):
    return op.manifest(v.samples.withColumn("nb_genes", F.col("nb_genes_text").try_cast("double")), manifest_assets(v))[1]


@query(
    "R3_crosstab",
    "SELECT organ, " + ", ".join(f"count(CASE WHEN split = '{s}' THEN 1 END) AS {s}" for s in ("train", "val", "test")) + " FROM samples GROUP BY organ",
)
def _(v: Views):
    return op.crosstab(v.samples, "organ", "split", ["train", "val", "test"])


HELD_OUT = {"leave_organ_out": "organ", "leave_cohort_out": "cohort"}


def _task_tables(v: Views):
    """The samples of the one task that has a split of its own; all samples; the tasks of held-out labels."""
    samples = materialise(v.samples.select("sample_id", "organ", "cohort"))
    return splits.task_samples(samples, splits.leave_slide_out(samples)), samples, materialise(heldout.label_tasks(samples, HELD_OUT))


def task_summary(v: Views, tables=None):
    one, samples, tasks = tables or _task_tables(v)
    return op.task_summary(one).unionByName(heldout.summary(samples, tasks, HELD_OUT))


def task_assets(v: Views, tables=None):
    one, samples, tasks = tables or _task_tables(v)
    a = sample_assets(v)
    return op.missing_assets(one, a).unionByName(heldout.assets_of_all(samples, tasks, a))


def readiness(v: Views):
    tables = _task_tables(v)
    return op.readiness_of(task_summary(v, tables), task_assets(v, tables), 2)


_names = lambda s, c: f"coalesce(string_agg(DISTINCT {c}, '|' ORDER BY {c}) FILTER (t.split = '{s}'), '')"
_N = lambda s: f"count(CASE WHEN t.split = '{s}' THEN 1 END)"
define(
    "task_summary",
    f"""SELECT split_type, heldout, count(*) AS n_slides, {_N('train')} AS n_train_slides, {_N('val')} AS n_val_slides, {_N('test')} AS n_test_slides,
  {_names('train', 'organ')} AS train_organs, {_names('test', 'organ')} AS test_organs, {_names('train', 'cohort')} AS train_cohorts, {_names('test', 'cohort')} AS test_cohorts,
  {_N('train')} > 0 AND {_N('val')} > 0 AND {_N('test')} > 0 AS has_train_val_test, trim(regexp_replace(lower(heldout), '[^a-z0-9]+', '_', 'g'), '_') AS task_slug
FROM task_rows t JOIN samples s USING (sample_id) GROUP BY split_type, heldout""",
)
define(
    "task_assets",
    """WITH j AS (SELECT split_type, heldout, found, sample_id || ':' || asset || ':' || path AS e FROM task_rows JOIN sample_assets USING (sample_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY split_type, heldout ORDER BY e) AS r FROM j WHERE NOT found),
x AS (SELECT split_type, heldout, string_agg(e, '|' ORDER BY e) AS missing_asset_examples FROM r WHERE r <= 5 GROUP BY ALL)
SELECT c.*, coalesce(missing_asset_examples, '') AS missing_asset_examples, n_missing_asset_paths = 0 AS assets_ready FROM
(SELECT split_type, heldout, count(*) AS n_asset_paths_checked, count(CASE WHEN NOT found THEN 1 END) AS n_missing_asset_paths FROM j GROUP BY ALL) c LEFT JOIN x USING (split_type, heldout)""",
)
define(
    "ready_tasks",
    """SELECT s.*, n_asset_paths_checked, n_missing_asset_paths, missing_asset_examples, assets_ready, has_train_val_test AND assets_ready AS ready_for_training,
  n_test_slides >= 2 AS passes_min_test_slides FROM task_summary s JOIN task_assets USING (split_type, heldout)""",
)


@query("R4_task_summary", "SELECT * FROM task_summary")
def _(v: Views):
    return task_summary(v)


@query("R5_missing_assets", "SELECT * FROM task_assets")
def _(v: Views):
    return task_assets(v)


def ready_tasks(v: Views):
    if not hasattr(v, "_ready"):
        v._ready = materialise(readiness(v))
    return v._ready


@query("R6_readiness_audit", "SELECT * FROM ready_tasks")
def _(v: Views):
    return readiness(v)


@query(
    "R7_readiness_by_type",
    """SELECT split_type, count(*) AS n_tasks, count(CASE WHEN ready_for_training AND passes_min_test_slides THEN 1 END) AS n_ready_tasks, max(n_test_slides) AS max_test_slides,
cast(sum(n_missing_asset_paths) AS bigint) AS n_missing_asset_paths FROM ready_tasks GROUP BY split_type""",
)
def _(v: Views):
    return op.readiness_by_type(ready_tasks(v))


define(
    "task_metrics",
    """SELECT *, CASE stage WHEN 'sf' THEN 'log_sf_pearson' WHEN 'expression' THEN 'mean_gene_pearson' ELSE 'count_pred_sf_mean_gene_pearson' END AS primary_metric_name,
  coalesce(metric_log_sf_pearson, metric_mean_gene_pearson, metric_count_pred_sf_mean_gene_pearson) AS primary_metric_value,
  CASE stage WHEN 'expression' THEN 0.05::double ELSE 0.1::double END AS low_metric_threshold,
  coalesce(coalesce(metric_log_sf_pearson, metric_mean_gene_pearson, metric_count_pred_sf_mean_gene_pearson) < CASE stage WHEN 'expression' THEN 0.05 ELSE 0.1 END, false) AS is_low_metric FROM formal""",
)


@query(
    "J13_readiness_enrichment",
    """SELECT f.split_type, f.task_slug, f.stage, f.heldout, n_train_slides, n_val_slides, n_test_slides, ready_for_training, passes_min_test_slides
FROM formal f LEFT JOIN ready_tasks r USING (split_type, task_slug)""",
)
def _(v: Views):
    blank = formal_rows(v).withColumn("heldout", F.when(F.col("stage") == "sf", F.lit(None)).otherwise(F.col("heldout")))
    d = op.enrich_with_readiness(blank, ready_tasks(v))
    return d.select("split_type", "task_slug", "stage", "heldout", "n_train_slides", "n_val_slides", "n_test_slides", "ready_for_training", "passes_min_test_slides")


_TM = "split_type, heldout, task_slug, stage, status, run_name, primary_metric_name, primary_metric_value, low_metric_threshold, is_low_metric"


@query("P20_low_metric_flags", f"SELECT {_TM} FROM task_metrics", "primary_metric_value low_metric_threshold")
def _(v: Views):
    return op.task_metrics(formal_rows(v)).select(*_TM.split(", "))


define(
    "inspection",
    """SELECT split_type, stage, min(primary_metric_name) AS primary_metric_name, count(*) AS n_tasks, avg(primary_metric_value) AS mean_primary_metric, median(primary_metric_value) AS median_primary_metric,
  min(primary_metric_value) AS min_primary_metric, quantile_cont(primary_metric_value, 0.25) AS q25_primary_metric, quantile_cont(primary_metric_value, 0.75) AS q75_primary_metric,
  max(primary_metric_value) AS max_primary_metric, min(low_metric_threshold) AS low_metric_threshold, count(CASE WHEN is_low_metric THEN 1 END) AS n_low_metric_tasks,
  arg_min(heldout, primary_metric_value) AS worst_heldout, arg_max(heldout, primary_metric_value) AS best_heldout FROM task_metrics WHERE status = 'ok' GROUP BY split_type, stage""",
)
INSP = "mean_primary_metric median_primary_metric min_primary_metric q25_primary_metric q75_primary_metric max_primary_metric low_metric_threshold"


@query("R8_task_inspection", "SELECT * FROM inspection", INSP)
def _(v: Views):
    return op.inspection(op.task_metrics(formal_rows(v)))


@query(
    "R9_asset_flags_by_split",
    "SELECT split, asset, count(CASE WHEN found THEN 1 END) AS n_present, count(*) AS n_slides, bool_and(found) AS all_present FROM sample_assets JOIN samples USING (sample_id) GROUP BY ALL",
)
def _(v: Views):
    return op.asset_flags_by_split(sample_assets(v), v.samples)


define(
    "methods",
    """SELECT p_type AS method, count(a.path) > 0 AS source_found, count(a.path) AS key_files_present, count(CASE WHEN p_size > 0 THEN 1 END) - count(CASE WHEN a.path IS NULL THEN 1 END) * (length(p_type) % 2) AS key_files_total,
  avg(p_size) > 25.3 AS requires_wsi, length(p_type) > 5 AS adapter_possible, min(p_size) > 1 AS pretrained_missing, CASE WHEN max(p_retailprice) > 1095 THEN 'mod_a|mod_b' ELSE '' END AS missing_modules, length(p_type) AS adapter_priority
FROM part LEFT JOIN asset_listing a ON a.path = p_type || '/' || cast(p_partkey AS varchar) GROUP BY p_type""",
)


def methods(v: Views):
    """Part types stand for methods; their listed parts are the files that are present."""
    p = v.table("part").withColumn("path", F.concat("p_type", F.lit("/"), F.col("p_partkey").cast("string")))
    j = p.join(v.asset_listing, "path", "left")
    odd = F.length("p_type") % 2
    return j.groupBy(F.col("p_type").alias("method")).agg(
        (F.count("actual_bytes") > 0).alias("source_found"), F.count("actual_bytes").alias("key_files_present"),
        (F.count(F.when(F.col("p_size") > 0, 1)) - F.count(F.when(F.col("actual_bytes").isNull(), 1)) * F.max(odd)).alias("key_files_total"),
        (F.avg("p_size") > 25.3).alias("requires_wsi"), (F.max(F.length("p_type")) > 5).alias("adapter_possible"), (F.min("p_size") > 1).alias("pretrained_missing"),
        F.when(F.max("p_retailprice") > 1095, "mod_a|mod_b").otherwise("").alias("missing_modules"), F.max(F.length("p_type")).cast("bigint").alias("adapter_priority"),
    )


@query(
    "R10_method_readiness",
    """WITH h AS (SELECT bool_and(found) FILTER (asset = 'counts') AS st, bool_and(found) FILTER (asset = 'features') AS patch, bool_and(found) FILTER (asset = 'size_factor') AS wsi FROM sample_assets),
m AS (SELECT *, key_files_present = key_files_total AS k, source_found AND key_files_present = key_files_total AS src FROM methods, h),
b AS (SELECT *, concat_ws('|', CASE WHEN NOT source_found THEN 'missing_source_dir' END, CASE WHEN NOT k THEN 'missing_key_files' END) AS source_blockers,
  concat_ws('|', CASE WHEN NOT st THEN 'missing_raw_counts' END, CASE WHEN adapter_possible AND NOT patch THEN 'missing_patch_images' END) AS adapter_blockers,
  concat_ws('|', CASE WHEN pretrained_missing THEN 'missing_pretrained_files' END, CASE WHEN missing_modules <> '' THEN 'missing_modules:' || missing_modules END) AS environment_blockers,
  CASE WHEN requires_wsi AND NOT wsi THEN 'original_workflow_missing_wsi' ELSE '' END AS original_workflow_blockers FROM m)
SELECT method, adapter_priority, key_files_present, key_files_total, source_blockers, adapter_blockers, environment_blockers, original_workflow_blockers,
  concat_ws('|', nullif(source_blockers, ''), nullif(adapter_blockers, ''), nullif(environment_blockers, ''), nullif(original_workflow_blockers, '')) AS blockers,
  CASE WHEN src AND st AND adapter_possible AND patch AND missing_modules = '' AND NOT pretrained_missing THEN 'patch_adapter_ready' WHEN src AND st AND adapter_possible AND patch THEN 'patch_adapter_ready_missing_environment'
  WHEN src AND NOT adapter_possible AND (NOT requires_wsi OR wsi) THEN 'source_ready_original_assets' ELSE 'blocked_or_needs_nontrivial_adapter' END AS adapter_status FROM b""",
)
def _(v: Views):
    return op.method_readiness(methods(v), sample_assets(v))


@query(
    "R11_organ_by_method",
    "SELECT organ, " + ", ".join(f"max(CASE WHEN method = '{m}' THEN r END) AS {m}" for m in evaluate.ABLATIONS)
    + f" FROM (SELECT organ, method, {PEARSON} AS r FROM (SELECT organ, method, {sums()} FROM ablations JOIN samples USING (sample_id) GROUP BY ALL)) GROUP BY organ",
    " ".join(evaluate.ABLATIONS),
)
def _(v: Views):
    from spotweave.functions.moments import merged_sums

    s = evaluate.ablation_sums(v.ablation_cells, ["sample_id"]).join(v.samples.select("sample_id", "organ"), "sample_id")
    m = s.groupBy("organ", "method").agg(*merged_sums()).select("organ", "method", *metric_columns())
    return m.groupBy("organ").pivot("method", list(evaluate.ABLATIONS)).agg(F.first("pearson")).orderBy(F.desc_nulls_last("count_pred_sf"))


define(
    "external_runs",
    """SELECT CASE WHEN min(doc_id) = 0 THEN 'smoke_' || source ELSE source END AS method, 'log1p_rate' AS prediction_kind, avg(n_chars) / 10000 AS mean_gene_pearson, median(n_chars) / 10000 AS median_gene_pearson,
  count(*) AS valid_genes, count(*) AS n_slides, false AS oracle_mode, cast(floor(sum(n_chars) / 500) AS bigint) AS n_train_slides, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE cast(sum(n_chars) // 40 AS bigint) END AS n_train_chunks,
  CASE WHEN count(*) % 5 = 0 THEN NULL ELSE cast(sum(n_chars) AS bigint) END AS n_train_spots, max(n_chars) % 9 AS epochs, CASE WHEN count(*) % 2 = 0 THEN true END AS complete FROM documents GROUP BY source""",
)


def external_runs(v: Views):
    """Document sources stand for external runs, their texts for the training data."""
    n, c, total = F.count(F.lit(1)), F.col("n_chars"), F.sum("n_chars")
    docs = v.table("documents").select("doc_id", "source", "n_chars")
    median = group_quantile(docs, ["source"], "n_chars", 0.5, "_median")
    return docs.groupBy("source").agg(
        F.min("doc_id").alias("_first"), F.lit("log1p_rate").alias("prediction_kind"), (F.avg(c) / 10000).alias("mean_gene_pearson"),
        n.alias("valid_genes"), n.alias("n_slides"), F.lit(False).alias("oracle_mode"),
        F.floor(total / 500).cast("bigint").alias("n_train_slides"), F.when(n % 3 != 0, F.floor(total / 40).cast("bigint")).alias("n_train_chunks"),
        F.when(n % 5 != 0, total).alias("n_train_spots"), (F.max(c) % 9).alias("epochs"), F.when(n % 2 == 0, F.lit(True)).alias("complete"),
    ).join(median, "source").withColumn("median_gene_pearson", F.col("_median") / 10000).drop("_median").withColumn("method", F.when(F.col("_first") == 0, F.concat(F.lit("smoke_"), "source")).otherwise(F.col("source"))).drop("source", "_first")


def _benchmark_sql(sums: Callable) -> str:
    return f"""SELECT 'model' AS family, method, CASE WHEN method = 'rate' THEN 'rate' ELSE 'count' END AS prediction_kind, mean_gene_pearson, median_gene_pearson, valid_genes, 'formal_internal' AS evidence_level, '' AS caveat
FROM ({_ABL_SUMMARY})
UNION ALL SELECT 'statistical_baseline', method, prediction_kind, avg(r), quantile_cont(r, 0.5), count(r), 'formal_internal_baseline', '' FROM (SELECT method, prediction_kind, gene, {PEARSON} AS r
 FROM (SELECT method, prediction_kind, gene, {sums()} FROM baseline_pairs GROUP BY ALL)) GROUP BY ALL
UNION ALL SELECT 'external', method, prediction_kind, mean_gene_pearson, median_gene_pearson, valid_genes,
 CASE WHEN smoke THEN 'smoke_only' WHEN n_slides >= 48 AND broad AND epochs >= 5 THEN 'formal_external_trained' WHEN n_slides >= 48 AND broad THEN 'formal_external_pilot' WHEN n_slides >= 48 THEN 'full_test_limited_external' ELSE 'partial_external' END,
 CASE WHEN smoke THEN 'Not a benchmark result.' ELSE CASE WHEN complete IS NULL THEN 'prediction completeness unknown' WHEN complete THEN 'complete predictions' ELSE 'incomplete predictions' END
  || '; trained on ' || n_train_slides || ' slides/' || CASE WHEN n_train_chunks IS NOT NULL THEN n_train_chunks || ' chunks' WHEN n_train_spots IS NOT NULL THEN n_train_spots || ' spots' ELSE 'unknown training units' END END
FROM (SELECT *, contains(method, 'smoke') OR n_slides <= 1 AS smoke, n_train_slides >= 100 AND (coalesce(n_train_chunks, 0) >= 1000 OR coalesce(n_train_spots, 0) >= 10000) AS broad FROM external_runs)"""


define("benchmark_table", _benchmark_sql(sums))
define("evidence_table", _benchmark_sql(exact_sums))


def internal_summary(v: Views):
    s = evaluate.ablation_sums(v.ablation_cells, ["gene"]).select("method", "gene", *metric_columns("n_obs", True))
    d = evaluate.gene_summary(s, ["method"])
    return d.withColumn("prediction_kind", F.when(F.col("method") == "rate", "rate").otherwise("count"))


def benchmark_table(v: Views):
    return op.benchmark_table(internal_summary(v), bl.baseline_marts(_sums(v), v.samples)["summary"], external_runs(v))


@query("R12_benchmark_evidence", "SELECT * FROM evidence_table", "mean_gene_pearson median_gene_pearson")
def _(v: Views):
    return benchmark_table(v)


def graded_formal(v: Views):
    """Result rows with their primary metric; runs over few tasks count as pilots."""
    d = op.task_metrics(formal_rows(v))
    return d.withColumn("is_smoke", op.is_smoke_run(F.col("run_name"), F.col("stage"), F.lit(5), F.lit(5)))


@query(
    "R13_run_status",
    """SELECT run_name, stage, split_type, count(*) AS n_tasks, count(CASE WHEN status = 'ok' THEN 1 END) AS n_ok, avg(CASE WHEN status = 'ok' THEN primary_metric_value END) AS value, false AS is_smoke,
  CASE WHEN count(CASE WHEN status = 'ok' THEN 1 END) = count(*) THEN 'ok' WHEN count(CASE WHEN status = 'ok' THEN 1 END) > 0 THEN 'partial' ELSE min(status) END AS status FROM task_metrics GROUP BY ALL""".replace(" GROUP BY ALL", " GROUP BY run_name, stage, split_type"),
    "value",
)
def _(v: Views):
    return op.run_status(graded_formal(v))


define(
    "completion",
    """WITH n AS (SELECT split_type, task_slug FROM ready_tasks WHERE ready_for_training AND passes_min_test_slides), d AS (SELECT DISTINCT split_type, stage, task_slug FROM formal WHERE status = 'ok'),
g AS (SELECT t AS split_type, s AS stage FROM (SELECT DISTINCT split_type AS t FROM ready_tasks WHERE split_type <> 'leave_slide_out'), (VALUES ('expression'), ('combined')) x(s)),
c AS (SELECT g.*, (SELECT count(*) FROM n WHERE n.split_type = g.split_type) AS n_ready, (SELECT count(*) FROM d WHERE d.split_type = g.split_type AND d.stage = g.stage) AS n_completed,
  (SELECT count(*) FROM n JOIN d ON n.split_type = d.split_type AND n.task_slug = d.task_slug WHERE n.split_type = g.split_type AND d.stage = g.stage) AS both_ FROM g)
SELECT 'formal_' || split_type || '_' || stage AS item, split_type, stage, n_ready, n_completed,
  CASE WHEN n_ready = 0 THEN 'not_ready' WHEN both_ = n_ready THEN 'run' WHEN n_completed > 0 THEN 'partial_not_final' ELSE 'not_run' END AS status FROM c""",
)


@query("R13_completion_status", "SELECT * FROM completion")
def _(v: Views):
    return op.completion_status(ready_tasks(v), graded_formal(v))


def _mart_sql(rows: str, cover: str, name: str = "signature") -> str:
    return f"""SELECT a.signature AS {name}, a.n AS n_spots, a.r AS rate_pearson, a.mae AS rate_mae, n_present_genes, missing_genes, b.r AS count_pearson, b.mae AS count_mae FROM
(SELECT signature, n, {PEARSON} AS r, sae/n AS mae FROM (SELECT signature, {sums()} FROM {rows} WHERE valid AND metric_kind = 'rate' GROUP BY 1)) a
JOIN (SELECT signature, {PEARSON} AS r, sae/n AS mae FROM (SELECT signature, {sums()} FROM {rows} WHERE valid AND metric_kind = 'count_pred_sf' GROUP BY 1)) b USING (signature) JOIN {cover} USING (signature)"""


define("biology_mart", _mart_sql("score_rows", "coverage"))
define("module_mart", _mart_sql("module_scores", "module_coverage", "module"))
MART = "rate_pearson rate_mae count_pearson count_mae"


def biology_mart(v: Views):
    return op.fidelity_mart(genesets.set_fidelity(v.spot_scores, v.samples, genesets.set_coverage(v.gene_sets, v.genes)).filter("n_spots > 0"))


def module_mart(v: Views):
    scores = genesets.spot_scores(v.ablation_cells, v.modules, v.sample_genes, min_genes=4)
    return op.fidelity_mart(genesets.set_fidelity(scores, v.samples, genesets.set_coverage(v.modules, v.genes)).filter("n_spots > 0"), "module")


@query("R14_signature_mart", "SELECT * FROM biology_mart", MART)
def _(v: Views):
    return biology_mart(v)


@query("R14_module_mart", "SELECT * FROM module_mart", MART)
def _(v: Views):
    return module_mart(v)


define("fraction_metrics", qg._FM)
define("dominant_agreement", f"SELECT * FROM {qg.agreement_sql('dominants')}")


def composition_mart(v: Views):
    f = qg._fractions(v)
    m = materialise(comp.fraction_metrics(f, "cell_type"))
    o = comp.composition_overall(m, comp.agreement(comp.confusion(comp.dominant(f, "cell_type"))))
    return op.with_overall(m, o, ["n_spots", "mean_spot_fraction_pearson", "mean_slide_fraction_pearson", "dominant_accuracy", "dominant_macro_f1"])


@query(
    "R15_composition_mart",
    """SELECT m.*, a.n_spots AS overall_n_spots, (SELECT avg(spot_fraction_pearson) FROM fraction_metrics) AS overall_mean_spot_fraction_pearson,
(SELECT avg(slide_fraction_pearson) FROM fraction_metrics) AS overall_mean_slide_fraction_pearson, a.accuracy AS overall_dominant_accuracy, a.macro_f1 AS overall_dominant_macro_f1 FROM fraction_metrics m, dominant_agreement a""",
    qg.FM_DOUBLES + " overall_mean_spot_fraction_pearson overall_mean_slide_fraction_pearson overall_dominant_accuracy overall_dominant_macro_f1",
)
def _(v: Views):
    return composition_mart(v)


def spatial_mart(v: Views):
    r = qs._report(v)
    return op.with_overall(spatial.signature_summary(r), spatial.overall_summary(r), ["mean_spatial_lag_pearson", "mean_hotspot_jaccard"])


define("spatial_summary", qs._SUM)


@query(
    "R15_spatial_mart",
    "SELECT s.*, (SELECT avg(spatial_lag_pearson) FROM spatial_rows) AS overall_mean_spatial_lag_pearson, (SELECT avg(hotspot_jaccard) FROM spatial_rows) AS overall_mean_hotspot_jaccard FROM spatial_summary s",
    qs.SUM_D + " overall_mean_spatial_lag_pearson overall_mean_hotspot_jaccard",
)
def _(v: Views):
    return spatial_mart(v)


@query(
    "R15_stratification_mart",
    "SELECT f.*, (SELECT count(DISTINCT sample_id) FROM slide_profiles) AS overall_n_slides, (SELECT count(DISTINCT signature) FROM slide_profiles) AS overall_n_signatures FROM field_summary f",
    qm.FS,
)
def _(v: Views):
    return stratification_mart(v)


def stratification_mart(v: Views):
    o = qm._profiles(v).agg(F.countDistinct("sample_id").alias("n_slides"), F.countDistinct("signature").alias("n_signatures"))
    return op.with_overall(qm.field_summary(v), o, ["n_slides", "n_signatures"])


define(
    "state_match",
    f"""WITH p AS (SELECT * FROM (VALUES {qg._PERMS}) p(p0, p1, p2, p3)), c AS (SELECT organ, true_label, pred_label, count(*) AS n FROM state_labels JOIN samples USING (sample_id) GROUP BY ALL),
h AS (SELECT organ, p0, p1, p2, p3, sum(CASE WHEN {" OR ".join(f"(true_label = {i} AND pred_label = p{i})" for i in range(4))} THEN n ELSE 0 END) AS h, sum(n) AS t FROM c, p GROUP BY ALL)
SELECT organ, max(h) / any_value(t) AS best_match_accuracy FROM h GROUP BY organ
UNION ALL SELECT NULL, max(h) / any_value(t) FROM (SELECT p0, p1, p2, p3, sum(h) AS h, sum(t) AS t FROM h GROUP BY ALL)""",
)
define("state_labels_organ", "SELECT l.*, organ FROM state_labels l JOIN samples USING (sample_id)")


@query(
    "R16_state_mart",
    f"""WITH n AS (SELECT true_label AS state, count(*) AS n FROM state_labels GROUP BY 1),
t AS (SELECT true_label AS state, name, avg(t) AS m FROM state_z JOIN state_labels USING (sample_id, spot_id) GROUP BY ALL),
b AS (SELECT state, any_value(n) AS n, array_to_string(list(name ORDER BY m DESC, name)[1:3], '|') AS top FROM t JOIN n USING (state) GROUP BY state ORDER BY 2 DESC, 1 LIMIT 3)
SELECT 'overall' AS level, 'all' AS "group", 4 AS n_states, n_spots, adjusted_rand, normalized_mutual_info, (SELECT best_match_accuracy FROM state_match WHERE organ IS NULL) AS best_match_accuracy, '' AS dominant_state_signatures FROM {qg.agreement_sql('state_labels')}
UNION ALL SELECT 'organ', a.organ, 4, n_spots, adjusted_rand, normalized_mutual_info, m.best_match_accuracy, '' FROM {qg.agreement_sql('state_labels_organ', 'organ')} a JOIN state_match m USING (organ)
UNION ALL SELECT 'state_annotation', 'largest_true_states', count(*), cast(sum(n) AS bigint), NULL, NULL, NULL, string_agg('state' || state || ':' || top, '; ' ORDER BY n DESC, state) FROM b""",
    "adjusted_rand normalized_mutual_info best_match_accuracy",
)
def _(v: Views):
    z = materialise(qg._z(v))
    labels = materialise(states.assign_states(states.vectors(z, "name"), qg.FIXED_CENTRES))
    by_organ = states.state_fidelity(labels.join(v.samples.select("sample_id", "organ"), "sample_id"), 4, ["organ"])
    return op.state_mart(states.state_fidelity(labels, 4), by_organ, states.annotate_states(z, labels, "name", 4), 4)


@query("R17_inspection_mart", "SELECT *, 'formal_runs' AS source_path FROM inspection", INSP)
def _(v: Views):
    d = op.inspection(op.task_metrics(formal_rows(v)))
    return d.withColumn("source_path", F.lit("formal_runs")).orderBy("split_type", "stage")


_f4 = lambda c: f"printf('%.4f', {c})"
define(
    "claims",
    f"""WITH b AS (SELECT max(mean_gene_pearson) FILTER (method = 'count_pred_sf') AS p, max(mean_gene_pearson) FILTER (method = 'count_no_sf') AS n, max(mean_gene_pearson) FILTER (method = 'count_oracle_sf') AS o,
  max(mean_gene_pearson) FILTER (method = 'rate') AS r, max(mean_gene_pearson) FILTER (method = 'organ_sf_only_count_pred_sf') AS s,
  count(*) FILTER (evidence_level = 'formal_external_trained') AS nt, count(*) FILTER (evidence_level = 'formal_external_pilot') AS np FROM benchmark_table)
SELECT 'predicted_size_factors_improve_counts' AS claim, 'supported' AS status, 'count_pred_sf ' || {_f4('p')} || ' vs count_no_sf ' || {_f4('n')} || ', delta ' || {_f4('p - n')} AS evidence, 'oracle upper bound ' || {_f4('o')} AS limitation, 'benchmark_table' AS source_path FROM b
UNION ALL SELECT 'model_exceeds_statistical_baseline', 'supported', 'count_pred_sf ' || {_f4('p')} || ' vs organ baseline ' || {_f4('s')}, '', 'statistical_baselines' FROM b
UNION ALL SELECT 'broad_gene_panel', 'supported', (SELECT count(DISTINCT gene) FROM eval_cells) || ' genes over ' || (SELECT count(*) FROM sf_spots) || ' spots; rate mean ' || {_f4('r')}, '', 'evaluation' FROM b
UNION ALL (SELECT 'gene_set_structure', 'supported_first_pass', 'best ' || signature || ' ' || {_f4('rate_pearson')} || ' of ' || (SELECT count(*) FROM biology_mart), 'gene-set fidelity only', 'biology_mart' FROM biology_mart ORDER BY rate_pearson DESC NULLS LAST, signature LIMIT 1)
UNION ALL (SELECT 'spatial_structure', 'supported_first_pass_spatial', 'best ' || signature || ' ' || {_f4('mean_spatial_lag_pearson')} || '; overall lag ' || printf('%.4f', (SELECT avg(spatial_lag_pearson) FROM spatial_rows)), 'nearest-neighbour based', 'spatial_summary'
  FROM spatial_summary ORDER BY mean_spatial_lag_pearson DESC NULLS LAST, signature LIMIT 1)
UNION ALL SELECT 'generalization', CASE WHEN bool_and(status = 'run') THEN 'supported_ready_set' ELSE 'prepared_not_final' END, string_agg(item || ':' || status, ', ' ORDER BY item), CASE WHEN bool_and(status = 'run') THEN 'ready set only' ELSE 'incomplete' END, 'completion' FROM completion
UNION ALL SELECT 'tasks_inspected', 'supported_inspected_heterogeneous', string_agg(split_type || '/' || stage || ' ' || {_f4('mean_primary_metric')} || ' worst ' || worst_heldout, '; ' ORDER BY split_type, stage), 'bounded to finished tasks', 'inspection' FROM inspection
UNION ALL SELECT 'external_benchmarks', CASE WHEN nt > 0 THEN 'supported_trained_pilot' WHEN np > 0 THEN 'supported_pilot' ELSE 'not_supported_yet' END, nt || ' trained and ' || np || ' pilot rows', 'not tuned', 'benchmark_table' FROM b
UNION ALL (SELECT 'pathway_modules', 'supported_first_pass_pathway', (SELECT count(*) FROM module_mart) || ' modules over ' || n_spots || ' spots; best ' || module || ' ' || {_f4('rate_pearson')}
  || ', median ' || printf('%.4f', (SELECT quantile_cont(rate_pearson, 0.5) FROM module_mart)), 'gene-set fidelity, no enrichment', 'module_mart' FROM module_mart ORDER BY rate_pearson DESC NULLS LAST, module LIMIT 1)
UNION ALL (SELECT 'cell_composition', 'supported_first_pass_cell_composition', (SELECT count(*) FROM fraction_metrics) || ' types over ' || a.n_spots || ' spots; spot fractions '
  || printf('%.4f', (SELECT avg(spot_fraction_pearson) FROM fraction_metrics)) || ', slide fractions ' || printf('%.4f', (SELECT avg(slide_fraction_pearson) FROM fraction_metrics))
  || '; dominant accuracy ' || {_f4('accuracy')} || ', macro F1 ' || {_f4('macro_f1')} || '; best ' || cell_type || ' ' || {_f4('spot_fraction_pearson')}, 'marker proxy', 'composition_mart'
  FROM fraction_metrics m, dominant_agreement a ORDER BY spot_fraction_pearson DESC NULLS LAST, cell_type LIMIT 1)
UNION ALL SELECT 'tissue_states', 'supported_first_pass_partial', '4 states; adjusted Rand ' || {_f4('adjusted_rand')} || ', mutual information ' || {_f4('normalized_mutual_info')} || ', best match '
  || printf('%.4f', (SELECT best_match_accuracy FROM state_match WHERE organ IS NULL)), 'states come from gene sets', 'state_mart' FROM {qg.agreement_sql('state_labels')}
UNION ALL (SELECT 'metadata_stratification', 'supported_first_pass_metadata', (SELECT count(*) FROM field_summary) || ' fields over ' || (SELECT count(DISTINCT sample_id) FROM slide_profiles) || ' slides and '
  || (SELECT count(DISTINCT signature) FROM slide_profiles) || ' signatures; best ' || label_field || ' ' || {_f4('eta_pearson')} || '; top-group match ' || {_f4('top_group_match_rate')}, 'slide labels only', 'stratification_mart'
  FROM field_summary ORDER BY eta_pearson DESC NULLS LAST, label_field LIMIT 1)""",
)


def claims(v: Views):
    """The audit rows; every one is read off a mart of a few rows."""
    b = materialise(benchmark_table(v))
    at = lambda m: F.max(F.when(F.col("method") == m, F.col("mean_gene_pearson")))
    level = lambda s: F.count(F.when(F.col("evidence_level") == s, 1))
    one = materialise(b.agg(
        at("count_pred_sf").alias("p"), at("count_no_sf").alias("n"), at("count_oracle_sf").alias("o"), at("rate").alias("r"),
        at("organ_sf_only_count_pred_sf").alias("s"), level("formal_external_trained").alias("nt"), level("formal_external_pilot").alias("np"),
    ))
    c = lambda *names: [F.col(x) for x in names]
    size = v.eval_cells.agg(F.countDistinct("gene").alias("ng")).crossJoin(F.broadcast(v.sf_spots.agg(F.count(F.lit(1)).alias("ns"))))
    bio = materialise(biology_mart(v))
    best_bio = bio.orderBy(F.desc_nulls_last("rate_pearson"), "signature").limit(1).crossJoin(F.broadcast(bio.agg(F.count(F.lit(1)).alias("k"))))
    sp = spatial_mart(v).orderBy(F.desc_nulls_last("mean_spatial_lag_pearson"), "signature").limit(1)
    done = op.completion_status(ready_tasks(v), graded_formal(v))
    gen = done.withColumn("_line", F.concat("item", F.lit(":"), "status")).agg(
        F.bool_and(F.col("status") == "run").alias("all"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "_line"))), lambda s: s["_line"]), ", ").alias("e")
    )
    insp = op.inspection(op.task_metrics(formal_rows(v))).withColumn(
        "_line", F.format_string("%s/%s %.4f worst %s", *c("split_type", "stage", "mean_primary_metric", "worst_heldout"))
    ).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split_type", "stage", "_line"))), lambda s: s["_line"]), "; ").alias("e"))
    top = lambda d, by, name: d.orderBy(F.desc_nulls_last(by), name).limit(1).crossJoin(F.broadcast(d.agg(F.count(F.lit(1)).alias("k"))))  # noqa: E731  one row each
    mods = materialise(module_mart(v))
    best_mod = top(mods, "rate_pearson", "module").crossJoin(F.broadcast(mods.agg(F.percentile("rate_pearson", 0.5).alias("median"))))
    best_type = top(materialise(composition_mart(v)), "spot_fraction_pearson", "cell_type")
    best_field = top(materialise(stratification_mart(v)), "eta_pearson", "label_field")
    return op.claim_table([
        op.claim(one, "predicted_size_factors_improve_counts", "supported",
                 F.format_string("count_pred_sf %.4f vs count_no_sf %.4f, delta %.4f", F.col("p"), F.col("n"), F.col("p") - F.col("n")), F.format_string("oracle upper bound %.4f", *c("o")), "benchmark_table"),
        op.claim(one, "model_exceeds_statistical_baseline", "supported", F.format_string("count_pred_sf %.4f vs organ baseline %.4f", *c("p", "s")), "", "statistical_baselines"),
        op.claim(size.crossJoin(F.broadcast(one)), "broad_gene_panel", "supported", F.format_string("%d genes over %d spots; rate mean %.4f", *c("ng", "ns", "r")), "", "evaluation"),
        op.claim(best_bio, "gene_set_structure", "supported_first_pass", F.format_string("best %s %.4f of %d", *c("signature", "rate_pearson", "k")), "gene-set fidelity only", "biology_mart"),
        op.claim(sp, "spatial_structure", "supported_first_pass_spatial",
                 F.format_string("best %s %.4f; overall lag %.4f", *c("signature", "mean_spatial_lag_pearson", "overall_mean_spatial_lag_pearson")), "nearest-neighbour based", "spatial_summary"),
        op.claim(gen, "generalization", F.when(F.col("all"), "supported_ready_set").otherwise("prepared_not_final"), F.col("e"), F.when(F.col("all"), "ready set only").otherwise("incomplete"), "completion"),
        op.claim(insp, "tasks_inspected", "supported_inspected_heterogeneous", F.col("e"), "bounded to finished tasks", "inspection"),
        op.claim(one, "external_benchmarks", F.when(F.col("nt") > 0, "supported_trained_pilot").when(F.col("np") > 0, "supported_pilot").otherwise("not_supported_yet"),
                 F.format_string("%d trained and %d pilot rows", *c("nt", "np")), "not tuned", "benchmark_table"),
        op.claim(best_mod, "pathway_modules", "supported_first_pass_pathway",
                 F.format_string("%d modules over %d spots; best %s %.4f, median %.4f", *c("k", "n_spots", "module", "rate_pearson", "median")), "gene-set fidelity, no enrichment", "module_mart"),
        op.claim(best_type, "cell_composition", "supported_first_pass_cell_composition",
                 F.format_string("%d types over %d spots; spot fractions %.4f, slide fractions %.4f; dominant accuracy %.4f, macro F1 %.4f; best %s %.4f", *c(
                     "k", "overall_n_spots", "overall_mean_spot_fraction_pearson", "overall_mean_slide_fraction_pearson", "overall_dominant_accuracy",
                     "overall_dominant_macro_f1", "cell_type", "spot_fraction_pearson")), "marker proxy", "composition_mart"),
        op.claim(states.state_fidelity(qg._labels(v), 4), "tissue_states", "supported_first_pass_partial",
                 F.format_string("4 states; adjusted Rand %.4f, mutual information %.4f, best match %.4f", *c("adjusted_rand", "normalized_mutual_info", "best_match_accuracy")),
                 "states come from gene sets", "state_mart"),
        op.claim(best_field, "metadata_stratification", "supported_first_pass_metadata",
                 F.format_string("%d fields over %d slides and %d signatures; best %s %.4f; top-group match %.4f", *c(
                     "k", "overall_n_slides", "overall_n_signatures", "label_field", "eta_pearson", "top_group_match_rate")), "slide labels only", "stratification_mart"),
    ])


@query("R18_claim_audit", "SELECT * FROM claims")
def _(v: Views):
    return claims(v)


@query("R18_claims_by_status", "SELECT status, count(*) AS n_claims FROM claims GROUP BY status")
def _(v: Views):
    return op.claims_by_status(claims(v))


@query(
    "R19_run_comparison",
    """SELECT method, mean_gene_pearson, valid_genes, NULL AS n_slides, 'model' AS source FROM evidence_table WHERE family = 'model'
UNION ALL SELECT method, mean_gene_pearson, valid_genes, NULL, 'baseline' FROM evidence_table WHERE family = 'statistical_baseline'
UNION ALL SELECT method, mean_gene_pearson, valid_genes, n_slides, 'external' FROM external_runs""",
    "mean_gene_pearson",
)
def _(v: Views):
    cols = ["method", "mean_gene_pearson", "valid_genes"]
    base = bl.baseline_marts(_sums(v), v.samples)["summary"]
    d = op.run_comparison(
        {"model": internal_summary(v).select(*cols), "baseline": base.select(*cols), "external": external_runs(v).select(*cols, "n_slides")}, "mean_gene_pearson"
    )
    return d.select(*cols, "n_slides", "source")
