"""Cohort summaries, readiness tables and evidence marts. All of these are label-sized: samples, tasks, methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spotweave.functions.scalars import slugify
from spotweave.operators.ordering import group_quantile
from spotweave.operators.sizefactor import SAMPLE

TASK = ["split_type", "heldout"]

# Primary metric and low-value threshold per stage.
PRIMARY = {
    "sf": ("metric_log_sf_pearson", "log_sf_pearson", 0.10),
    "expression": ("metric_mean_gene_pearson", "mean_gene_pearson", 0.05),
    "combined": ("metric_count_pred_sf_mean_gene_pearson", "count_pred_sf_mean_gene_pearson", 0.10),
}


def value_counts(samples: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n_slides), NULL values counted as their own value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])
    return samples.select(F.explode(pairs).alias("p")).select("p.*").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_slides"))


def spot_stats(samples: DataFrame, key: str = "organ", value: str = "spots_under_tissue") -> DataFrame:
    d = samples.groupBy(key).agg(F.count(value).alias("count"), F.sum(value).alias("sum"), F.min(value).alias("min"), F.max(value).alias("max"))
    return d.join(group_quantile(samples, [key], value, 0.5, "median"), key, "left")


# The columns of a manifest, in order.
MANIFEST_COLUMNS = [
    "sample_id", "patient_id", "cohort", "organ", "disease_state", "platform", "dataset_title", "study_link", "split",
    "features_path", "counts_path", "coords_path", "size_factor_path", "spots_path", "genes_path", "n_spots", "n_genes",
    "sf_normalization",
]


def manifest(
    samples: DataFrame, assets: DataFrame, required: tuple[str, ...] = ("features", "counts", "coords"), sf_normalization: str = "mean"
) -> tuple[DataFrame, DataFrame]:
    """(candidates with a flag per asset, manifest rows of the ready ones). `assets` is (sample_id, asset, path, found).

    Manifest rows have exactly `MANIFEST_COLUMNS`. Paths of assets that were not found are empty. Metadata that `samples` lacks is
    empty text, the patient then is the sample itself, and sizes are NULL.
    """
    names = ("features", "counts", "coords", "size_factor")
    has = lambda a: F.coalesce(F.bool_or(F.when(F.col("asset") == a, F.col("found"))), F.lit(False))
    path = lambda a: F.coalesce(F.max(F.when((F.col("asset") == a) & F.col("found"), F.col("path"))), F.lit(""))
    flags = assets.groupBy(F.col(SAMPLE).alias("_of")).agg(
        *[has(a).alias(f"_has_{a}") for a in names], *[path(a).alias(f"_{a}_path") for a in (*names, "spots", "genes")]
    )
    given = lambda c, default: samples[c] if c in samples.columns else default
    j = samples.join(flags, samples[SAMPLE] == flags["_of"], "left")
    found = {a: F.coalesce(f"_has_{a}", F.lit(False)) for a in names}
    ready = F.lit(True)
    for a in required:
        ready = ready & found[a]
    empty, unknown = F.lit(""), F.lit(None).cast("long")
    values = {
        SAMPLE: samples[SAMPLE], "patient_id": given("patient_id", samples[SAMPLE].cast("string")), "platform": given("st_technology", empty),
        "split": F.lit("unsplit"), "n_spots": given("spots_under_tissue", unknown), "n_genes": given("nb_genes", unknown),
        "sf_normalization": F.lit(sf_normalization),
    }
    values |= {c: F.col(f"_{c}") for c in MANIFEST_COLUMNS if c.endswith("_path")}
    candidates = j.select(
        samples[SAMPLE], given("organ", empty).alias("organ"), values["platform"].alias("platform"), given("dataset_title", empty).alias("dataset_title"),
        *[found[a].alias(f"has_{a}") for a in names], ready.alias("ready_for_training"),
    )
    rows = j.filter(ready).select(*[(values[c] if c in values else given(c, empty)).alias(c) for c in MANIFEST_COLUMNS])
    return candidates, rows


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    at = [F.count(F.when(F.col(column) == v, 1)).alias(v) for v in values]
    return df.groupBy(row).agg(*at)


def task_summary(tasks: DataFrame) -> DataFrame:
    """Split sizes and label lists per task. `tasks` has a row per (task, sample)."""
    n = lambda s: F.count(F.when(F.col("split") == s, 1))
    names = lambda s, c: F.array_join(F.array_sort(F.collect_set(F.when(F.col("split") == s, F.col(c)))), "|")
    d = tasks.groupBy(*TASK).agg(
        F.count(F.lit(1)).alias("n_slides"), n("train").alias("n_train_slides"), n("val").alias("n_val_slides"), n("test").alias("n_test_slides"),
        names("train", "organ").alias("train_organs"), names("test", "organ").alias("test_organs"),
        names("train", "cohort").alias("train_cohorts"), names("test", "cohort").alias("test_cohorts"),
    )
    full = (F.col("n_train_slides") > 0) & (F.col("n_val_slides") > 0) & (F.col("n_test_slides") > 0)
    return d.withColumn("has_train_val_test", full).withColumn("task_slug", slugify(F.col("heldout")))


def missing_assets(tasks: DataFrame, assets: DataFrame, examples: int = 5) -> DataFrame:
    """Checked and missing asset paths per task, with the first few missing ones.

    Examples are the lowest few of a ranking that Spark cuts down before the shuffle; the lists stay short. Samples are merged: their ids
    alone are small as files, and a broadcast of them would grow in the driver with the samples.
    """
    from pyspark.sql import Window as W

    j = tasks.select(*TASK, SAMPLE).join(assets.filter("path <> ''").hint("merge"), SAMPLE)
    counts = j.groupBy(*TASK).agg(F.count(F.lit(1)).alias("n_asset_paths_checked"), F.count(F.when(~F.col("found"), 1)).alias("n_missing_asset_paths"))
    label = F.concat_ws(":", SAMPLE, "asset", "path")
    few = j.filter(~F.col("found")).select(*TASK, label.alias("_e"))
    few = few.withColumn("_r", F.row_number().over(W.partitionBy(*TASK).orderBy("_e"))).filter(F.col("_r") <= examples)
    few = few.groupBy(*TASK).agg(F.array_join(F.array_sort(F.collect_list("_e")), "|").alias("missing_asset_examples"))
    return counts.join(few, TASK, "left").withColumn("missing_asset_examples", F.coalesce("missing_asset_examples", F.lit(""))).withColumn(
        "assets_ready", F.col("n_missing_asset_paths") == 0
    )


def readiness(tasks: DataFrame, assets: DataFrame, min_test_slides: int = 5) -> DataFrame:
    return readiness_of(task_summary(tasks), missing_assets(tasks, assets), min_test_slides)


def readiness_of(summary: DataFrame, missing: DataFrame, min_test_slides: int = 5) -> DataFrame:
    d = summary.join(missing, TASK, "left")
    d = d.na.fill(0, ["n_asset_paths_checked", "n_missing_asset_paths"]).withColumn("assets_ready", F.coalesce("assets_ready", F.lit(True)))
    d = d.withColumn("ready_for_training", F.col("has_train_val_test") & F.col("assets_ready"))
    d = d.withColumn("passes_min_test_slides", F.col("n_test_slides") >= min_test_slides)
    return d.orderBy("split_type", F.desc("n_test_slides"), "heldout")


def readiness_by_type(ready: DataFrame) -> DataFrame:
    return ready.groupBy("split_type").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count(F.when(F.col("ready_for_training") & F.col("passes_min_test_slides"), 1)).alias("n_ready_tasks"),
        F.max("n_test_slides").alias("max_test_slides"), F.sum("n_missing_asset_paths").alias("n_missing_asset_paths"),
    )


def enrich_with_readiness(formal: DataFrame, ready: DataFrame) -> DataFrame:
    """Task results with what the readiness audit knows of their task; a missing heldout is filled from it."""
    keep = ["n_train_slides", "n_val_slides", "n_test_slides", "ready_for_training", "passes_min_test_slides"]
    one = ready.groupBy("split_type", "task_slug").agg(*[F.max(c).alias(c) for c in keep], F.min("heldout").alias("_heldout"))
    return formal.join(one, ["split_type", "task_slug"], "left").withColumn("heldout", F.coalesce("heldout", "_heldout")).drop("_heldout")


def task_metrics(formal: DataFrame) -> DataFrame:
    """Primary metric of each stage as a number, and whether it is low."""
    value, name, low = F.lit(None).cast("double"), F.lit(""), F.lit(None).cast("double")
    for stage, (column, label, threshold) in PRIMARY.items():
        at = F.col("stage") == stage
        value = F.when(at, F.col(column).try_cast("double")).otherwise(value)
        name = F.when(at, F.lit(label)).otherwise(name)
        low = F.when(at, F.lit(threshold)).otherwise(low)
    d = formal.withColumn("primary_metric_name", name).withColumn("primary_metric_value", value).withColumn("low_metric_threshold", low)
    return d.withColumn("is_low_metric", F.coalesce(F.col("primary_metric_value") < F.col("low_metric_threshold"), F.lit(False)))


def inspection(metrics: DataFrame) -> DataFrame:
    """Spread of the primary metric over finished tasks, with the worst and the best one."""
    v = F.col("primary_metric_value")
    ok = metrics.filter("status = 'ok'")
    d = ok.groupBy("split_type", "stage").agg(
        F.min("primary_metric_name").alias("primary_metric_name"), F.count(F.lit(1)).alias("n_tasks"), F.avg(v).alias("mean_primary_metric"),
        F.percentile(v, 0.5).alias("median_primary_metric"), F.min(v).alias("min_primary_metric"), F.percentile(v, 0.25).alias("q25_primary_metric"),
        F.percentile(v, 0.75).alias("q75_primary_metric"), F.max(v).alias("max_primary_metric"), F.min("low_metric_threshold").alias("low_metric_threshold"),
        F.count(F.when(F.col("is_low_metric"), 1)).alias("n_low_metric_tasks"),
        F.min_by("heldout", F.when(v.isNotNull(), F.struct(v, F.col("heldout")))).alias("worst_heldout"),
        F.max_by("heldout", F.when(v.isNotNull(), F.struct(v, F.col("heldout")))).alias("best_heldout"),
    )
    return d.filter("mean_primary_metric IS NOT NULL")


def asset_flags_by_split(assets: DataFrame, samples: DataFrame) -> DataFrame:
    j = assets.join(samples.select(SAMPLE, "split"), SAMPLE)
    return j.groupBy("split", "asset").agg(
        F.count(F.when(F.col("found"), 1)).alias("n_present"), F.count(F.lit(1)).alias("n_slides"), F.bool_and("found").alias("all_present")
    )


def method_readiness(methods: DataFrame, assets: DataFrame) -> DataFrame:
    """Blockers and adapter status of every method, from its own flags and what all samples have.

    `methods`: method, source_found, key_files_present, key_files_total, requires_wsi, adapter_possible,
    pretrained_missing, missing_modules, adapter_priority. `assets`: (sample_id, asset, path, found).
    """
    every = lambda a: F.coalesce(F.bool_and(F.when(F.col("asset") == a, F.col("found"))), F.lit(False))
    have = assets.agg(every("counts").alias("_st"), every("features").alias("_patch"), every("size_factor").alias("_wsi"))
    m = methods.crossJoin(F.broadcast(have))
    keys = F.col("key_files_present") == F.col("key_files_total")
    source = F.col("source_found") & keys
    text = lambda cond, s: F.when(cond, F.lit(s))
    joined = lambda *parts: F.concat_ws("|", *parts)
    src = joined(text(~F.col("source_found"), "missing_source_dir"), text(~keys, "missing_key_files"))
    ada = joined(text(~F.col("_st"), "missing_raw_counts"), text(F.col("adapter_possible") & ~F.col("_patch"), "missing_patch_images"))
    env = joined(
        text(F.col("pretrained_missing"), "missing_pretrained_files"),
        F.when(F.col("missing_modules") != "", F.concat(F.lit("missing_modules:"), F.col("missing_modules"))),
    )
    org = joined(text(F.col("requires_wsi") & ~F.col("_wsi"), "original_workflow_missing_wsi"))
    data_ready = source & F.col("_st") & F.col("adapter_possible") & F.col("_patch")
    env_ready = (F.col("missing_modules") == "") & ~F.col("pretrained_missing")
    status = (
        F.when(data_ready & env_ready, "patch_adapter_ready").when(data_ready, "patch_adapter_ready_missing_environment")
        .when(source & ~F.col("adapter_possible") & (~F.col("requires_wsi") | F.col("_wsi")), "source_ready_original_assets")
        .otherwise("blocked_or_needs_nontrivial_adapter")
    )
    blank = lambda c: F.when(c != "", c)
    return m.select(
        "method", "adapter_priority", "key_files_present", "key_files_total", src.alias("source_blockers"), ada.alias("adapter_blockers"),
        env.alias("environment_blockers"), org.alias("original_workflow_blockers"),
        F.concat_ws("|", blank(src), blank(ada), blank(env), blank(org)).alias("blockers"), status.alias("adapter_status"),
    ).orderBy("adapter_priority", "method")


def evidence_tier(runs: DataFrame) -> DataFrame:
    """Evidence level of external runs: smoke, trained, pilot, limited or partial.

    `runs`: method, n_slides, oracle_mode, n_train_slides, n_train_chunks, n_train_spots, epochs, complete.
    """
    n = F.coalesce("n_slides", F.lit(0))
    broad = (F.coalesce("n_train_slides", F.lit(0)) >= 100) & (
        (F.coalesce("n_train_chunks", F.lit(0)) >= 1000) | (F.coalesce("n_train_spots", F.lit(0)) >= 10000)
    )
    smoke = F.coalesce("oracle_mode", F.lit(False)) | F.lower("method").contains("smoke") | (n <= 1)
    level = (
        F.when(smoke, "smoke_only").when((n >= 48) & broad & (F.coalesce("epochs", F.lit(0)) >= 5), "formal_external_trained")
        .when((n >= 48) & broad, "formal_external_pilot").when(n >= 48, "full_test_limited_external").otherwise("partial_external")
    )
    done = F.when(F.col("complete").isNull(), "prediction completeness unknown").when(F.col("complete"), "complete predictions").otherwise("incomplete predictions")
    units = F.when(F.col("n_train_chunks").isNotNull(), F.concat(F.col("n_train_chunks").cast("string"), F.lit(" chunks"))).when(
        F.col("n_train_spots").isNotNull(), F.concat(F.col("n_train_spots").cast("string"), F.lit(" spots"))
    ).otherwise(F.lit("unknown training units"))
    trained = F.when(F.col("n_train_slides").isNotNull(), F.concat(F.lit("; trained on "), F.col("n_train_slides").cast("string"), F.lit(" slides/"), units)).otherwise(F.lit(""))
    caveat = F.when(smoke, "Not a benchmark result.").otherwise(F.concat(done, trained))
    return runs.withColumn("evidence_level", level).withColumn("caveat", caveat)


def benchmark_table(internal: DataFrame, baseline: DataFrame, external: DataFrame) -> DataFrame:
    """Union of own methods, statistical baselines and graded external runs."""
    cols = ["method", "prediction_kind", "mean_gene_pearson", "median_gene_pearson", "valid_genes"]
    own = internal.select(F.lit("model").alias("family"), *cols, F.lit("formal_internal").alias("evidence_level"), F.lit("").alias("caveat"))
    base = baseline.select(F.lit("statistical_baseline").alias("family"), *cols, F.lit("formal_internal_baseline").alias("evidence_level"), F.lit("").alias("caveat"))
    ext = evidence_tier(external).select(F.lit("external").alias("family"), *cols, "evidence_level", "caveat")
    return own.unionByName(base).unionByName(ext)


def is_smoke_run(run_name: Column, stage: Column, sf_epochs: Column, expression_epochs: Column) -> Column:
    named = F.lower(run_name).rlike("smoke|pilot")
    one = lambda c: F.coalesce(c == 1, F.lit(False))
    short = F.when(stage == "sf", one(sf_epochs)).when(stage == "expression", one(expression_epochs)).when(
        stage == "combined", one(sf_epochs) | one(expression_epochs)
    ).otherwise(F.lit(False))
    return named | short


def run_status(formal: DataFrame) -> DataFrame:
    """Per run, stage and split type: all tasks ok, some, or none; and the mean of the primary metric of finished tasks."""
    ok = F.col("status") == "ok"
    d = formal.groupBy("run_name", "stage", "split_type").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count(F.when(ok, 1)).alias("n_ok"), F.min("status").alias("_first"),
        F.avg(F.when(ok, F.col("primary_metric_value"))).alias("value"), F.bool_or("is_smoke").alias("is_smoke"),
    )
    status = F.when(F.col("n_ok") == F.col("n_tasks"), "ok").when(F.col("n_ok") > 0, "partial").otherwise(F.col("_first"))
    return d.withColumn("status", status).drop("_first")


def completion_status(ready: DataFrame, formal: DataFrame, stages: tuple[str, ...] = ("expression", "combined")) -> DataFrame:
    """Per split type and stage: is every ready task finished by a formal (not smoke) run?"""
    need = ready.filter("ready_for_training AND passes_min_test_slides").select("split_type", "task_slug").distinct()
    done = formal.filter("status = 'ok' AND NOT is_smoke").select("split_type", "stage", "task_slug").distinct()
    types = ready.select("split_type").distinct().filter("split_type <> 'leave_slide_out'")
    grid = types.select("split_type", F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"))
    both = need.select("split_type", "task_slug", F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"), F.lit(1).alias("_need")).join(
        done.withColumn("_done", F.lit(1)), ["split_type", "stage", "task_slug"], "full_outer"
    )
    n = both.groupBy("split_type", "stage").agg(
        F.count("_need").alias("n_ready"), F.count("_done").alias("n_completed"), F.count(F.col("_need") + F.col("_done")).alias("_both")
    )
    d = grid.join(n, ["split_type", "stage"], "left").na.fill(0)
    status = (
        F.when(F.col("n_ready") == 0, "not_ready").when(F.col("_both") == F.col("n_ready"), "run")
        .when(F.col("n_completed") > 0, "partial_not_final").otherwise("not_run")
    )
    return d.select(F.concat(F.lit("formal_"), "split_type", F.lit("_"), "stage").alias("item"), "split_type", "stage", "n_ready", "n_completed", status.alias("status"))


def fidelity_mart(fidelity: DataFrame, name: str = "signature") -> DataFrame:
    """Rate and count rows of the same set side by side, best first."""
    o = fidelity.filter("level = 'overall'")
    rate = o.filter("metric_kind = 'rate'").select(
        F.col("signature").alias(name), "n_spots", F.col("pearson").alias("rate_pearson"), F.col("mae").alias("rate_mae"), "n_present_genes",
        F.coalesce("missing_genes", F.lit("")).alias("missing_genes"),
    )
    count = o.filter("metric_kind = 'count_pred_sf'").select(F.col("signature").alias(name), F.col("pearson").alias("count_pearson"), F.col("mae").alias("count_mae"))
    return rate.join(count, name).orderBy(F.desc_nulls_last("rate_pearson"), name)


def with_overall(rows: DataFrame, overall: DataFrame, columns: list[str], prefix: str = "overall_") -> DataFrame:
    """Columns of a one-row table attached to every row."""
    return rows.crossJoin(F.broadcast(overall.select(*[F.col(c).alias(prefix + c) for c in columns])))


def state_mart(overall: DataFrame, by_organ: DataFrame, annotations: DataFrame, n_states: int, top: int = 3) -> DataFrame:
    """Overall row, organ rows, and the largest states as one line of text."""
    cols = ["n_spots", "adjusted_rand", "normalized_mutual_info", "best_match_accuracy"]
    none = F.lit("").alias("dominant_state_signatures")
    a = overall.select(F.lit("overall").alias("level"), F.lit("all").alias("group"), F.lit(n_states).cast("long").alias("n_states"), *cols, none)
    b = by_organ.select(F.lit("organ").alias("level"), F.col("organ").alias("group"), F.lit(n_states).cast("long").alias("n_states"), *cols, none)
    big = annotations.orderBy(F.desc("n_true_spots"), "state").limit(top)
    line = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("n_true_spots")).alias("o"), "state", "top_true_signatures"))),
            lambda s: F.concat(F.lit("state"), s["state"].cast("string"), F.lit(":"), s["top_true_signatures"]),
        ),
        "; ",
    )
    null = F.lit(None).cast("double")
    c = big.agg(F.sum("n_true_spots").alias("n_spots"), F.count(F.lit(1)).alias("n_states"), line.alias("dominant_state_signatures")).select(
        F.lit("state_annotation").alias("level"), F.lit("largest_true_states").alias("group"), "n_states", "n_spots",
        null.alias("adjusted_rand"), null.alias("normalized_mutual_info"), null.alias("best_match_accuracy"), "dominant_state_signatures",
    )
    return a.unionByName(b).unionByName(c)


def claim(rows: DataFrame, name: str, status: str | Column, evidence: Column, limitation: str | Column = "", source: str = "") -> DataFrame:
    """One audit row read off a mart: (claim, status, evidence, limitation, source_path)."""
    as_col = lambda c: F.lit(c) if isinstance(c, str) else c
    return rows.select(F.lit(name).alias("claim"), as_col(status).alias("status"), evidence.alias("evidence"), as_col(limitation).alias("limitation"), F.lit(source).alias("source_path"))


def claim_table(claims: list[DataFrame]) -> DataFrame:
    out = claims[0]
    for c in claims[1:]:
        out = out.unionByName(c)
    return out


def claims_by_status(claims: DataFrame) -> DataFrame:
    return claims.groupBy("status").agg(F.count(F.lit(1)).alias("n_claims"))


def run_comparison(tables: dict[str, DataFrame], sort_by: str) -> DataFrame:
    """Rows of several result tables under one header, labelled by origin."""
    out = None
    for label, t in tables.items():
        d = t.withColumn("source", F.lit(label))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out.orderBy(F.desc_nulls_last(sort_by), "source")
