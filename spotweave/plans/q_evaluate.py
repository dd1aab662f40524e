"""Predicted against measured values."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.functions.moments import metric_columns, merged_sums, pair_metrics
from spotweave.operators import evaluate as op
from spotweave.plans.base_sql import METRIC_DOUBLES, PEARSON, R2, metrics, sums
from spotweave.plans.registry import query
from spotweave.sources.views import Views


def _per_gene(source: str, keys: str = "gene") -> str:
    return f"SELECT {keys}, {metrics('n_obs', True)} FROM (SELECT {keys}, {sums()} FROM {source} GROUP BY {keys})"


GENE_DOUBLES = METRIC_DOUBLES + " detected_fraction"


@query("E1_gene_metrics", _per_gene("pairs_count"), GENE_DOUBLES)
def _(v: Views):
    return op.gene_metrics(op.pairs_of_kind(v.eval_cells, "count"))


@query(
    "E2_gene_summary",
    f"""SELECT avg(pearson) AS mean_gene_pearson, quantile_cont(pearson, 0.5) AS median_gene_pearson, count(pearson) AS valid_genes
FROM ({_per_gene('pairs_count')})""",
    "mean_gene_pearson median_gene_pearson",
)
def _(v: Views):
    return op.gene_summary(op.gene_metrics(op.pairs_of_kind(v.eval_cells, "count")))


def _levels(source: str, extra: str = "") -> str:
    e = f"{extra}, " if extra else ""
    parts = []
    for level, keys in (("overall", "split"), ("organ", "split, organ"), ("slide", "split, organ, cohort, disease_state, sample_id")):
        have = [k.strip() for k in keys.split(",")]
        cols = ", ".join(k if k in have else f"NULL AS {k}" for k in ("split", "organ", "cohort", "disease_state", "sample_id"))
        parts.append(
            f"SELECT {e}'{level}' AS level, {cols}, {metrics('n_values')} FROM (SELECT {e}{keys}, {sums()} "
            f"FROM {source} JOIN samples USING (sample_id) GROUP BY {e}{keys})"
        )
    return "\nUNION ALL ".join(parts)


@query("E3_level_metrics", _levels("pairs_count"), METRIC_DOUBLES)
def _(v: Views):
    sums_ = op.sample_gene_sums(op.pairs_of_kind(v.eval_cells, "count"))
    return op.level_metrics(sums_, v.samples)


_BUNDLE = """
WITH p AS (SELECT e.*, ln(1 + true_count) AS true_, value AS pred FROM eval_cells e JOIN samples s USING (sample_id) WHERE s.split = 'test'),
b AS (SELECT 'per_gene' AS mart, gene AS key, n, {p} AS a, sae / n AS b FROM (SELECT gene, {s} FROM p GROUP BY gene)
UNION ALL SELECT 'overall', split, n, {p}, sae / n FROM (SELECT split, {s} FROM p JOIN samples USING (sample_id) GROUP BY split)
UNION ALL SELECT 'organ', organ, n, {p}, sae / n FROM (SELECT organ, {s} FROM p JOIN samples USING (sample_id) GROUP BY organ)
UNION ALL SELECT 'slide', sample_id, n, {p}, sae / n FROM (SELECT sample_id, {s} FROM p GROUP BY sample_id)
UNION ALL SELECT 'slides', sample_id, count(DISTINCT spot_id), count(DISTINCT gene), 0 FROM p GROUP BY sample_id)
SELECT * FROM b UNION ALL SELECT 'summary', 'all', count(a), avg(a), quantile_cont(a, 0.5) FROM b WHERE mart = 'per_gene'
"""


BUNDLE_SQL = _BUNDLE.format(p=PEARSON, s=sums())


def bundle_rows(m: dict):
    """The marts of a bundle in one table."""
    row = lambda mart, key, n, a, b: [F.lit(mart).alias("mart"), F.col(key).alias("key"), F.col(n).alias("n"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")]
    levels = m["levels"].withColumn("key", F.coalesce("sample_id", "organ", "split"))
    return (
        m["per_gene"].select(*row("per_gene", "gene", "n_obs", "pearson", "mae"))
        .unionByName(levels.select(F.col("level").alias("mart"), "key", F.col("n_values").alias("n"), F.col("pearson").alias("a"), F.col("mae").alias("b")))
        .unionByName(m["slides"].withColumn("z", F.lit(0)).select(*row("slides", "sample_id", "n_spots", "n_measured_genes", "z")))
        .unionByName(m["summary"].withColumn("k", F.lit("all")).select(*row("summary", "k", "valid_genes", "mean_gene_pearson", "median_gene_pearson")))
    )


@query("E4_bundle_evaluation", BUNDLE_SQL, "a b")
def _(v: Views):
    return bundle_rows(op.evaluate_bundle(v.eval_cells, v.samples, "log1p_count", ["test"]))


@query(
    "E4_oracle_mode",
    """SELECT gene, count(*) AS n_obs, CASE WHEN count(*) >= 3 AND var_pop(true_) > 0 THEN 1.0 END AS pearson, 0.0 AS mae
FROM pairs_count JOIN samples USING (sample_id) WHERE split = 'test' GROUP BY gene""",
    "pearson mae",
)
def _(v: Views):
    m = op.evaluate_bundle(v.eval_cells, v.samples, "count", ["test"], oracle=True)
    return m["per_gene"].select("gene", "n_obs", "pearson", "mae")


@query(
    "E5_masked_gene_pearson",
    """SELECT avg(r) AS mean_gene_pearson, quantile_cont(r, 0.5) AS median_gene_pearson, count(r) AS valid_genes
FROM (SELECT gene, CASE WHEN count(*) >= 3 THEN corr(value, true_count) END AS r FROM eval_cells GROUP BY gene)""",
    "mean_gene_pearson median_gene_pearson",
)
def _(v: Views):
    """Two-pass form: covariances about the mean instead of raw sums."""
    p = op.pairs_of_kind(v.eval_cells, "count")
    r = F.covar_pop("pred", "true") / F.nullif(F.sqrt(F.var_pop("pred") * F.var_pop("true")), F.lit(0.0))
    g = p.groupBy("gene").agg(F.when(F.count(F.lit(1)) >= 3, r).alias("pearson"))
    return op.gene_summary(g)


@query(
    "E6_incremental_gene_pearson",
    f"SELECT gene, {PEARSON} AS pearson FROM (SELECT gene, {sums()} FROM pairs_count GROUP BY gene)",
    "pearson",
)
def _(v: Views):
    """State per sample first, as batches arrive; merged states give the same answer as one pass."""
    per_sample = op.sample_gene_sums(op.pairs_of_kind(v.eval_cells, "count"))
    return per_sample.groupBy("gene").agg(*merged_sums()).select("gene", *metric_columns()).select("gene", "pearson")


_ABL_GENE = _per_gene("ablations", "method, gene")
_ABL_SUMMARY = f"""SELECT method, avg(pearson) AS mean_gene_pearson, quantile_cont(pearson, 0.5) AS median_gene_pearson,
  count(pearson) AS valid_genes FROM ({_ABL_GENE}) GROUP BY method"""


@query("E11_count_ablations", _ABL_SUMMARY, "mean_gene_pearson median_gene_pearson")
def _(v: Views):
    sums_ = op.ablation_sums(v.ablation_cells, ["gene"])
    per_gene = sums_.select("method", "gene", *metric_columns("n_obs", True))
    return op.gene_summary(per_gene, ["method"])


@query("E12_ablation_levels", _levels("ablations", "method"), METRIC_DOUBLES)
def _(v: Views):
    return op.level_metrics(op.ablation_sums(v.ablation_cells, ["sample_id", "gene"]), v.samples, ["method"])


@query(
    "E12_ablation_genes",
    f"SELECT gene, method, {metrics('n_obs', True)} FROM (SELECT gene, method, {sums()} FROM ablations GROUP BY gene, method)",
    METRIC_DOUBLES + " detected_fraction",
)
def _(v: Views):
    return op.gene_metrics_of_sums(op.ablation_sums(v.ablation_cells, ["gene"]), ["gene", "method"])


@query("E15_pearson", f"SELECT sample_id, n AS n_obs, {PEARSON} AS pearson FROM (SELECT sample_id, {sums()} FROM pairs_count GROUP BY sample_id)", "pearson")
def _(v: Views):
    return pair_metrics(op.pairs_of_kind(v.eval_cells, "count"), ["sample_id"]).select("sample_id", "n_obs", "pearson")


def _ranked(keys: str, source: str = "pairs_count") -> str:
    over = lambda c: f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2.0"
    return f"SELECT {keys}, {over('pred')} AS pred, {over('true_')} AS true_ FROM {source}"


def _spearman(keys: str, source: str = "pairs_count") -> str:
    return f"SELECT {keys}, {PEARSON} AS spearman FROM (SELECT {keys}, {sums()} FROM ({_ranked(keys, source)}) GROUP BY {keys})"


@query("E16_spearman", _spearman("sample_id"), "spearman")
def _(v: Views):
    return op.spearman(op.pairs_of_kind(v.eval_cells, "count"), ["sample_id"])


@query("E17_r2", f"SELECT sample_id, {R2} AS r2 FROM (SELECT sample_id, {sums()} FROM pairs_count GROUP BY sample_id)", "r2")
def _(v: Views):
    return op.r2_metrics(op.pairs_of_kind(v.eval_cells, "count"), ["sample_id"])


def _extended(keys: str, moments: bool = False) -> str:
    m = ", st/n AS true_mean, sp/n AS pred_mean, stt/n-(st/n)*(st/n) AS true_var, spp/n-(sp/n)*(sp/n) AS pred_var" if moments else ""
    return f"""SELECT {keys}, {PEARSON} AS pearson, sse/n AS mse, sqrt(sse/n) AS rmse, sae/n AS mae, {R2} AS r2, spearman{m}
FROM (SELECT {keys}, {sums()} FROM pairs_count GROUP BY {keys}) JOIN ({_spearman(keys)}) USING ({keys})"""


EXT = "pearson spearman mse rmse mae r2"


def _matrix(keys: str) -> str:
    k = f"{keys}, "
    return f"""SELECT a.*, g.mean_gene_pearson, g.median_gene_pearson, g.n_genes, s.n_spots FROM ({_extended(keys)}) a
JOIN (SELECT {keys}, avg(r) AS mean_gene_pearson, quantile_cont(r, 0.5) AS median_gene_pearson, count(*) AS n_genes
  FROM (SELECT {k}gene, {PEARSON} AS r FROM (SELECT {k}gene, {sums()} FROM pairs_count GROUP BY {k}gene)) GROUP BY {keys}) g USING ({keys})
JOIN (SELECT {keys}, count(DISTINCT sample_id || '/' || spot_id) AS n_spots FROM pairs_count GROUP BY {keys}) s USING ({keys})"""


@query(
    "E18_overall_matrix_metrics",
    _matrix("one").replace("FROM pairs_count", "FROM (SELECT *, 1 AS one FROM pairs_count)").replace("SELECT a.*", "SELECT a.* EXCLUDE (one)"),
    EXT + " mean_gene_pearson median_gene_pearson",
)
def _(v: Views):
    return op.matrix_metrics(op.pairs_of_kind(v.eval_cells, "count"), [])


@query("E19_gene_extended", _extended("gene", True), EXT + " true_mean pred_mean true_var pred_var", 5)
def _(v: Views):
    return op.extended_metrics(op.pairs_of_kind(v.eval_cells, "count"), ["gene"], moments=True)


@query("E20_spot_metrics", _extended("sample_id, spot_id"), EXT)
def _(v: Views):
    return op.extended_metrics(op.pairs_of_kind(v.eval_cells, "count"), ["sample_id", "spot_id"])


@query("E21_sample_metrics", _matrix("sample_id"), EXT + " mean_gene_pearson median_gene_pearson")
def _(v: Views):
    return op.matrix_metrics(op.pairs_of_kind(v.eval_cells, "count"), ["sample_id"])


@query(
    "E22_hvg_metrics",
    f"""SELECT count(*) AS hvg_top_k, avg(pearson) AS hvg_mean_pearson, quantile_cont(pearson, 0.5) AS hvg_median_pearson
FROM (SELECT * FROM ({_extended('gene', True)}) ORDER BY true_var DESC, gene LIMIT 10)""",
    "hvg_mean_pearson hvg_median_pearson",
)
def _(v: Views):
    g = op.gene_metrics(op.pairs_of_kind(v.eval_cells, "count")).withColumn("true_var", F.col("true_std") ** 2)
    return op.hvg_metrics(g, 10)


@query("E23_marker_metrics", f"SELECT * FROM ({_per_gene('pairs_count')}) WHERE upper(gene) IN ('BRAND#3', 'BRAND#7', 'BRAND#20')", GENE_DOUBLES)
def _(v: Views):
    return op.marker_metrics(op.gene_metrics(op.pairs_of_kind(v.eval_cells, "count")), ["brand#3", "Brand#7", "bRAND#20", "absent"])


@query(
    "E24_partial_pearson",
    """WITH d AS (SELECT gene, greatest(value, 0) AS p, cast(true_count AS double) AS t, ln(sf + 1e-8) AS c FROM eval_cells),
f AS (SELECT gene, regr_slope(p, c) AS ps, regr_intercept(p, c) AS pi, regr_slope(t, c) AS ts, regr_intercept(t, c) AS ti FROM d GROUP BY gene)
SELECT gene, count(*) AS n_obs, corr(p - ps * c - pi, t - ts * c - ti) AS partial_pearson FROM d JOIN f USING (gene) GROUP BY gene""",
    "partial_pearson",
)
def _(v: Views):
    logged = v.eval_cells.select("sample_id", "spot_id", "gene", "value", "true_count", "sf", F.log(F.col("sf") + F.lit(1e-8)).alias("log_sf"))
    pairs = logged.select("gene", F.greatest("value", F.lit(0.0)).alias("pred"), F.col("true_count").cast("double").alias("true"), "log_sf")
    return op.partial_gene_pearson(pairs, "log_sf")
