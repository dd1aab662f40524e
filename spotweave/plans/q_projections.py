"""Filters, predicates and derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.functions import scalars as fx
from spotweave.operators import cohort, genesets, sizefactor
from spotweave.plans.registry import query
from spotweave.sources.views import MARKER_CLASSES, Views


@query(
    "P1_cohort_filter",
    """SELECT sample_id, organ, dataset_title, spots_under_tissue FROM samples
WHERE species = 'Homo sapiens' AND st_technology = 'Visium' AND spots_under_tissue >= 200""",
)
def _(v: Views):
    return cohort.cohort_filter(v.samples).select("sample_id", "organ", "dataset_title", "spots_under_tissue")


@query("P2_split_filter", "SELECT sample_id, split FROM samples WHERE split IN ('val', 'test')")
def _(v: Views):
    return cohort.in_splits(v.samples, ["val", "test"]).select("sample_id", "split")


@query("P3_select_by_ids", "SELECT sample_id, organ FROM samples WHERE sample_id IN (SELECT sample_id FROM counts WHERE count >= 100)")
def _(v: Views):
    ids = v.counts.filter("count >= 100").select("sample_id").distinct()
    return cohort.select_samples(v.samples, ids).select("sample_id", "organ")


@query("P4_valid_spots", "SELECT sample_id, spot_id, total >= 60 AS valid FROM totals")
def _(v: Views):
    return v.totals.select("sample_id", "spot_id", sizefactor.valid_spot(F.col("total"), 60).alias("valid"))


@query(
    "P5_gene_keys",
    """SELECT doc_id, CASE WHEN lower(regexp_replace(lang, '^\\s+|\\s+$', '', 'g')) NOT IN ('', 'nan', 'none', 'null', 'unspecified_gene_id') THEN regexp_replace(lang, '^\\s+|\\s+$', '', 'g') END AS lang_key,
CASE WHEN t NOT IN ('', 'nan', 'none', 'null', 'unspecified_gene_id') THEN k END AS word_key
FROM (SELECT *, lower(k) AS t FROM (SELECT *, regexp_replace(CASE WHEN n_chars % 2 = 0 THEN ' None ' ELSE source || '  ' END, '^\\s+|\\s+$', '', 'g') AS k FROM documents))""",
)
def _(v: Views):
    noisy = F.when(F.col("n_chars") % 2 == 0, " None ").otherwise(F.concat("source", F.lit("  ")))
    return v.table("documents").select("doc_id", fx.gene_key(F.col("lang")).alias("lang_key"), fx.gene_key(noisy).alias("word_key"))


@query(
    "P6_clean_labels",
    "SELECT sample_id, CASE WHEN lower(trim(disease_state)) = 'unknown' THEN '' ELSE trim(disease_state) END AS disease_state, '' AS tissue FROM samples",
)
def _(v: Views):
    return v.samples.select("sample_id", *[fx.clean_label(F.col(c)).alias(c) for c in ("disease_state", "tissue")])


@query(
    "P7_tolerant_bool",
    "SELECT o_orderkey, o_orderstatus = 'F' AS flag FROM orders",
)
def _(v: Views):
    text = F.when(F.col("o_orderstatus") == "F", "TRUE").when(F.col("o_orderstatus") == "O", "False").otherwise("n/a")
    return v.table("orders").select("o_orderkey", fx.tolerant_bool(text, False).alias("flag"))


@query(
    "P8_slugify",
    """SELECT doc_id, CASE WHEN s = '' THEN 'all' ELSE s END AS slug FROM (SELECT doc_id, trim(substring(
  trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_'), 1, 80), '_') AS s FROM documents)""",
)
def _(v: Views):
    return v.table("documents").select("doc_id", fx.slugify(F.col("text")).alias("slug"))


@query("P9_stable_score", "SELECT sample_id, sha1('2026|' || organ || '|' || sample_id) AS score FROM samples")
def _(v: Views):
    return v.samples.select("sample_id", fx.stable_score(2026, F.col("organ"), F.col("sample_id")).alias("score"))


@query(
    "P10_bounded_names",
    """SELECT doc_id, CASE WHEN length(s) <= 40 THEN s ELSE rtrim(substring(s, 1, 31), '_-') || '_' || substring(sha1(s), 1, 8) END AS name
FROM (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') AS s FROM documents)""",
)
def _(v: Views):
    return v.table("documents").select("doc_id", fx.bounded_name(fx.slugify(F.col("text"), None), 40).alias("name")).withColumn(
        "name", F.when(F.col("name") == "all", "").otherwise(F.col("name"))
    )


@query(
    "P11_gene_classes",
    """SELECT p_partkey, p_brand AS gene, coalesce(gene_class, 'other') AS gene_class FROM part LEFT JOIN
(SELECT gene, arg_min(gene_class, priority) AS gene_class FROM marker_classes GROUP BY gene) ON gene = p_brand""",
)
def _(v: Views):
    rows = [(p, c, g) for p, c, genes in MARKER_CLASSES for g in genes]
    classes = v.spark.createDataFrame(rows, "priority int, gene_class string, gene string")
    parts = v.table("part").select("p_partkey", F.col("p_brand").alias("gene"))
    return cohort.gene_classes(parts, classes)


@query(
    "P12_quality_tier",
    "SELECT sample_id, spot_id, CASE WHEN sf >= 0.65 THEN 'good' WHEN sf >= 0.35 THEN 'medium' ELSE 'bad' END AS tier FROM sf_t",
)
def _(v: Views):
    return v.sf.select("sample_id", "spot_id", fx.quality_tier(F.col("sf")).alias("tier"))


@query("P13_blank_to_null", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM orders")
def _(v: Views):
    padded = F.when(F.col("o_orderstatus") == "P", "   ").otherwise(F.col("o_orderstatus"))
    return v.table("orders").select("o_orderkey", fx.blank_to_null(padded).alias("status"))


@query(
    "P14_truth_by_kind",
    """SELECT sample_id, spot_id, gene, cast(true_count AS double) AS count, ln(1 + true_count) AS log1p_count,
  true_count / greatest(sf, 1e-6) AS rate, ln(1 + true_count / greatest(sf, 1e-6)) AS log1p_rate FROM eval_cells""",
    "count log1p_count rate log1p_rate",
)
def _(v: Views):
    return v.eval_cells.select(
        "sample_id", "spot_id", "gene", *[fx.truth_value(k, F.col("true_count"), F.col("sf")).alias(k) for k in fx.KINDS]
    )


@query(
    "P15_prediction_by_kind",
    """SELECT sample_id, spot_id, gene, greatest(value - 2, 0) AS count, greatest(value - 2, 0) AS rate, value - 2 AS log1p_count,
  value - 2 AS log1p_rate FROM predictions""",
    "count log1p_count rate log1p_rate",
)
def _(v: Views):
    shifted = F.col("value") - 2
    return v.predictions.select("sample_id", "spot_id", "gene", *[fx.prediction_value(k, shifted).alias(k) for k in fx.KINDS])


@query(
    "P17_recomposition",
    "SELECT sample_id, spot_id, gene, pred_rate, pred_rate * pred_sf AS pred_count FROM ablation_cells",
    "pred_rate pred_count",
)
def _(v: Views):
    return v.ablation_cells.select("sample_id", "spot_id", "gene", "pred_rate", (F.col("pred_rate") * F.col("pred_sf")).alias("pred_count"))


@query(
    "P18_select_tasks",
    """SELECT 'leave_organ_out' AS split_type, organ AS heldout, lower(replace(organ, ' ', '_')) AS task_slug, count(*) AS n_test
FROM samples WHERE organ IN ('ASIA', 'EUROPE', 'MIDDLE EAST') GROUP BY organ""",
)
def _(v: Views):
    tasks = v.samples.groupBy(F.lit("leave_organ_out").alias("split_type"), F.col("organ").alias("heldout")).agg(F.count(F.lit(1)).alias("n_test"))
    tasks = tasks.withColumn("task_slug", fx.slugify(F.col("heldout")))
    return cohort.select_tasks(tasks, ["leave_organ_out"], ["asia", "europe", "middle_east"], None).select("split_type", "heldout", "task_slug", "n_test")


@query(
    "P19_scaled_coordinates",
    """SELECT sample_id, spot_id, x * 100 / (2000 + s_suppkey % 50) AS thumb_x, y * 80 / (1500 + s_suppkey % 30) AS thumb_y
FROM spots JOIN supplier ON cast(s_suppkey AS varchar) = sample_id""",
    "thumb_x thumb_y",
)
def _(v: Views):
    k = F.col("s_suppkey")
    sizes = v.table("supplier").select(
        k.cast("string").alias("sample_id"), (k % 50 + 2000).alias("full_width"), (k % 30 + 1500).alias("full_height"),
        F.lit(100).alias("thumb_width"), F.lit(80).alias("thumb_height"),
    )
    return cohort.scaled_coordinates(v.spots, sizes).select("sample_id", "spot_id", "thumb_x", "thumb_y")


@query(
    "P22_standardised_features",
    """WITH u AS (SELECT sample_id, spot_id, unnest(range(0, 64)) AS i, unnest(features)::double AS x FROM features),
m AS (SELECT i, avg(x) AS mean, CASE WHEN stddev_pop(x) < 1e-6 THEN 1.0 ELSE stddev_pop(x) END AS std FROM u GROUP BY i)
SELECT sample_id, spot_id, cast(i AS int) AS dim, (x - mean) / std AS x FROM u JOIN m USING (i)""",
    "x",
)
def _(v: Views):
    d = sizefactor.standardize(v.features, sizefactor.fit_standardizer(v.features))
    return d.select("sample_id", "spot_id", F.posexplode("features").alias("dim", "x"))


@query(
    "P23_score_kinds",
    """SELECT sample_id, spot_id, signature, 'rate' AS score_kind, rate_true AS true_score, rate_pred AS pred_score, valid FROM spot_scores
UNION ALL SELECT sample_id, spot_id, signature, 'count_pred_sf', count_pred_sf_true, count_pred_sf_pred, valid FROM spot_scores""",
    "true_score pred_score",
)
def _(v: Views):
    return genesets.long_scores(v.spot_scores).withColumnsRenamed({"true": "true_score", "pred": "pred_score"})
