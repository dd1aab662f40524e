"""Predicted against measured values by gene, spot, sample, organ and split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spotweave.functions.moments import (
    SUMS,
    merged_sums,
    metric_columns,
    pearson_of_sums,
    r2_of_sums,
    stack_sums,
    sum_pairs,
)
from spotweave.functions.scalars import finite, prediction_value, rate_of, truth_value
from spotweave.operators.align import CELL, measured_only
from spotweave.operators.ordering import average_ranks
from spotweave.operators.sizefactor import SAMPLE, SPOT
from spotweave.session import materialise

LABELS = ["split", "organ", "cohort", "disease_state"]


def evaluation_cells(predictions: DataFrame, sf: DataFrame, counts: DataFrame, sample_genes: DataFrame) -> DataFrame:
    """(value, true_count, sf) for every predicted cell of a valid spot and a measured gene.

    Predictions are dense already, so zeros of the sparse truth come out of a left join and nothing is blown up.
    """
    spots = sf.filter("valid").select(*SPOT, "sf")
    p = measured_only(predictions.select(*CELL, "value"), sample_genes)
    return (
        p.join(spots, SPOT)
        .join(counts.select(*CELL, "count"), CELL, "left")
        .select(*CELL, "sf", "value", F.coalesce("count", F.lit(0)).cast("long").alias("true_count"))
    )


def pairs_of_kind(cells: DataFrame, kind: str) -> DataFrame:
    return cells.select(
        *CELL,
        prediction_value(kind, F.col("value")).alias("pred"),
        truth_value(kind, F.col("true_count"), F.col("sf")).alias("true"),
    )


def gene_metrics(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["gene"]
    return sum_pairs(pairs, keys).select(*keys, *metric_columns("n_obs", detected=True))


def gene_metrics_of_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.select(*keys, *metric_columns("n_obs", detected=True))


def gene_summary(per_gene: DataFrame, keys: list[str] | None = None, metric: str = "pearson") -> DataFrame:
    """Mean, median and number of defined correlations; one value per gene, so the groups are as small as the panel."""
    return per_gene.groupBy(*(keys or [])).agg(
        F.avg(metric).alias("mean_gene_pearson"),
        F.percentile(metric, 0.5).alias("median_gene_pearson"),
        F.count(metric).alias("valid_genes"),
    )


def sample_gene_sums(pairs: DataFrame) -> DataFrame:
    """The fine-grained state all levels roll up from; as large as samples × genes, not as the cells."""
    return sum_pairs(pairs, [SAMPLE, "gene"])


def level_metrics(sums: DataFrame, samples: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Overall, organ and slide rows within each split, rolled up from per-sample sums by grouping sets."""
    extra = extra or []
    per_sample = sums.groupBy(*extra, SAMPLE).agg(*merged_sums())
    labelled = per_sample.join(samples.select(SAMPLE, *LABELS), SAMPLE)
    rolled = labelled.groupingSets(
        [
            [*extra, "split"],
            [*extra, "split", "organ"],
            [*extra, *LABELS, SAMPLE],
        ],
        *extra,
        *LABELS,
        SAMPLE,
    ).agg(*merged_sums(), F.grouping("organ").alias("_no_organ"), F.grouping(SAMPLE).alias("_no_sample"))
    level = F.when(F.col("_no_organ") == 1, "overall").when(F.col("_no_sample") == 1, "organ").otherwise("slide")
    return rolled.select(*extra, level.alias("level"), *LABELS, SAMPLE, *metric_columns("n_values"))


def slides_evaluated(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """Spots and genes that entered per slide."""
    by_gene = pairs.groupBy(SAMPLE, "gene").agg(F.count(F.lit(1)).alias("c"))
    genes = by_gene.groupBy(SAMPLE).agg(F.max("c").alias("n_spots"), F.count(F.lit(1)).alias("n_measured_genes"))
    return genes.join(samples.select(SAMPLE, "split", "organ", "cohort"), SAMPLE)


def evaluate_bundle(cells: DataFrame, samples: DataFrame, kind: str, splits: list[str] | None = None, oracle: bool = False) -> dict[str, DataFrame]:
    """All marts of one method: per_gene, levels, slides, summary. With `oracle` the truth predicts itself."""
    if splits:
        chosen = samples.filter(F.col("split").isin(splits)).select(SAMPLE)
        cells = cells.join(chosen, SAMPLE, "left_semi")
    pairs = pairs_of_kind(cells, kind)
    if oracle:
        pairs = pairs.withColumn("pred", F.col("true"))
    sums = materialise(sample_gene_sums(pairs))
    per_gene = sums.groupBy("gene").agg(*merged_sums()).select("gene", *metric_columns("n_obs", detected=True))
    slides = sums.groupBy(SAMPLE).agg(F.max("n").alias("n_spots"), F.count(F.lit(1)).alias("n_measured_genes"))
    return {
        "per_gene": per_gene,
        "levels": level_metrics(sums, samples),
        "slides": slides.join(samples.select(SAMPLE, "split", "organ", "cohort"), SAMPLE),
        "summary": gene_summary(per_gene),
    }


ABLATIONS = ("rate", "count_no_sf", "count_pred_sf", "count_oracle_sf")


def ablation_columns(cells: DataFrame) -> dict[str, tuple[Column, Column]]:
    """Prediction and truth of each ablation; `pred_rate`, `pred_sf`, `sf` and `true_count` are columns of `cells`."""
    rate, count = F.col("pred_rate"), F.col("true_count").cast("double")
    return {
        "rate": (rate, rate_of(F.col("true_count"), F.col("sf"))),
        "count_no_sf": (rate, count),
        "count_pred_sf": (rate * F.col("pred_sf"), count),
        "count_oracle_sf": (rate * F.col("sf"), count),
    }


def ablation_sums(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the four ablations in one pass: side by side while aggregating, one row per method afterwards."""
    wide = sum_pairs(cells, keys, {name + "_": pt for name, pt in ablation_columns(cells).items()})
    return stack_sums(wide, keys, {name: name + "_" for name in ABLATIONS}, "method")


def rate_of_log1p(value: Column) -> Column:
    return F.greatest(F.expm1(value), F.lit(0.0))


def ablation_cells(cells: DataFrame, pred_sf: DataFrame) -> DataFrame:
    """Cells with the predicted rate (from a log1p-rate prediction) and the normalised predicted size factor."""
    return cells.withColumn("pred_rate", rate_of_log1p(F.col("value"))).join(pred_sf.select(*SPOT, "pred_sf"), SPOT)


def _with_ranks(pairs: DataFrame, keys: list[str]) -> DataFrame:
    ok = materialise(pairs.filter(finite(F.col("pred")) & finite(F.col("true"))).select(*keys, "pred", "true"))
    folded = ok.groupBy(*keys, "pred", "true").agg(F.count(F.lit(1)).alias("_c"))
    rp = average_ranks(ok, keys, "pred", "_rp")
    rt = average_ranks(ok, keys, "true", "_rt")
    return folded.join(rp, [*keys, "pred"]).join(rt, [*keys, "true"])


def spearman(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pearson of average ranks; equal (pred, true) pairs are folded and weighted."""
    r = _with_ranks(pairs, keys)
    c, p, t = F.col("_c"), F.col("_rp"), F.col("_rt")
    sums = r.groupBy(*keys).agg(
        F.sum("_c").alias("n"),
        F.sum(c * p).alias("sp"),
        F.sum(c * t).alias("st"),
        F.sum(c * p * p).alias("spp"),
        F.sum(c * t * t).alias("stt"),
        F.sum(c * p * t).alias("spt"),
    )
    return sums.select(*keys, pearson_of_sums().alias("spearman"))


def _extended(sums: DataFrame, keys: list[str], moments: bool) -> DataFrame:
    cols = [
        pearson_of_sums().alias("pearson"),
        (F.col("sse") / F.col("n")).alias("mse"),
        F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
        (F.col("sae") / F.col("n")).alias("mae"),
        r2_of_sums().alias("r2"),
    ]
    if moments:
        var = lambda s, q: F.greatest(F.col(q) / F.col("n") - (F.col(s) / F.col("n")) ** 2, F.lit(0.0))
        cols += [
            (F.col("st") / F.col("n")).alias("true_mean"),
            (F.col("sp") / F.col("n")).alias("pred_mean"),
            var("st", "stt").alias("true_var"),
            var("sp", "spp").alias("pred_var"),
        ]
    return sums.filter("n > 0").select(*keys, *cols)


def extended_metrics(pairs: DataFrame, keys: list[str], moments: bool = False) -> DataFrame:
    """pearson, spearman, mse, rmse, mae, r2 per group (gene, spot or sample)."""
    base = _extended(sum_pairs(pairs, keys), keys, moments)
    rho = spearman(pairs, keys)
    return base.join(rho, keys, "left") if keys else base.crossJoin(F.broadcast(rho))


def r2_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """R² per group, from sums alone."""
    return sum_pairs(pairs, keys).filter("n > 0").select(*keys, r2_of_sums().alias("r2"))


def matrix_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of all cells of a group, its size, and mean and median of its gene correlations."""
    flat = extended_metrics(pairs, keys)
    by_gene = sum_pairs(pairs, [*keys, "gene"])
    genes = by_gene.select(*keys, "gene", pearson_of_sums().alias("_r"), "n").groupBy(*keys).agg(
        F.avg("_r").alias("mean_gene_pearson"),
        F.percentile("_r", 0.5).alias("median_gene_pearson"),
        F.count(F.lit(1)).alias("n_genes"),
    )
    spots = pairs.select(*keys, *[c for c in SPOT if c not in keys]).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_spots"))
    if not keys:
        return flat.crossJoin(F.broadcast(genes)).crossJoin(F.broadcast(spots))
    return flat.join(genes, keys).join(spots, keys)


def hvg_metrics(per_gene: DataFrame, top_k: int = 1000) -> DataFrame:
    """Correlations of the k genes that vary most in truth."""
    top = per_gene.orderBy(F.desc("true_var"), "gene").limit(top_k)
    return top.agg(
        F.count(F.lit(1)).alias("hvg_top_k"),
        F.avg("pearson").alias("hvg_mean_pearson"),
        F.percentile("pearson", 0.5).alias("hvg_median_pearson"),
    )


def marker_metrics(per_gene: DataFrame, markers: list[str]) -> DataFrame:
    return per_gene.filter(F.upper("gene").isin([m.upper() for m in markers]))


def partial_gene_pearson(pairs: DataFrame, covariate: str) -> DataFrame:
    """Correlation of pred and true per gene after a linear fit on one covariate is taken out of both.

    Equal to (r_pt − r_pc·r_tc) / √((1 − r_pc²)(1 − r_tc²)), so three sets of sums in one pass replace the fits. A flat
    covariate explains nothing and leaves the plain correlation.
    """
    p, t, c = "pred", "true", covariate
    ok = pairs.filter(finite(F.col(p)) & finite(F.col(t)) & finite(F.col(c)))
    wide = sum_pairs(ok, ["gene"], {"a_": (p, t), "b_": (p, c), "c_": (t, c)})
    r = stack_sums(wide, ["gene"], {"pt": "a_", "pc": "b_", "tc": "c_"}, "pair").select(
        "gene", "pair", "n", pearson_of_sums().alias("r")
    )
    one = r.groupBy("gene").agg(
        F.max("n").alias("n_obs"),
        *[F.max(F.when(F.col("pair") == k, F.col("r"))).alias(k) for k in ("pt", "pc", "tc")],
    )
    pc, tc = F.coalesce("pc", F.lit(0.0)), F.coalesce("tc", F.lit(0.0))
    rest = (F.lit(1.0) - pc * pc) * (F.lit(1.0) - tc * tc)
    value = (F.col("pt") - pc * tc) / F.sqrt(rest)
    return one.select("gene", "n_obs", F.when((F.col("n_obs") >= 3) & (rest > 1.0e-12), value).alias("partial_pearson"))


BUNDLE_PAIRS = {
    "rate": ("pred_rate", "true_rate"), "count_no_sf": ("pred_count_no_sf", "true_count"), "count_pred_sf": ("pred_count", "true_count"),
    "count_oracle_sf": ("pred_count_oracle_sf", "true_count"),
}


def bundle_gene_metrics(bundle: DataFrame) -> DataFrame:
    """Per gene of a prediction bundle: the correlation of every kind of prediction, and mean and variance of true and predicted counts."""
    out = sum_pairs(bundle, ["gene"], {f"{k}_": pair for k, pair in BUNDLE_PAIRS.items()})
    for k in BUNDLE_PAIRS:
        m = out.withColumnsRenamed({f"{k}_{c}": c for c in SUMS}).select("*", *metric_columns("n_obs", prefix="_"))
        out = m.withColumnRenamed("_pearson", f"{k}_pearson")
        if k == "count_pred_sf":
            out = out.withColumns({f"{side}_mean_count": F.col(f"_{side}_mean") for side in ("true", "pred")})
            out = out.withColumns({f"{side}_var_count": F.pow(F.col(f"_{side}_std"), 2) for side in ("true", "pred")})
        out = out.drop(*SUMS, *[c for c in out.columns if c.startswith("_")])
    return out


def bundle_metrics(bundle: DataFrame, gene_metrics_: DataFrame) -> DataFrame:
    """(part, metric, value) of a bundle: its size, the size-factor metrics over its spots and the summary over genes per kind."""
    from spotweave.operators.sfmetrics import METRICS, sf_metrics

    def long(d: DataFrame, part: str, names: list[str]) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
        return d.select(F.explode(pairs).alias("p")).select(F.lit(part).alias("part"), "p.*")

    spots = bundle.select("sample_id", "spot_id", "pred_sf", "true_sf").distinct()
    logs = spots.select(F.log(F.col("pred_sf") + 1.0e-8).alias("pred_log_sf"), F.log(F.col("true_sf") + 1.0e-8).alias("true_log_sf"))
    size = spots.agg(F.count(F.lit(1)).alias("n_spots")).crossJoin(gene_metrics_.agg(F.count(F.lit(1)).alias("n_genes")))  # one row each
    out = long(size, "bundle", ["n_spots", "n_genes"]).unionByName(long(sf_metrics(logs, []), "sf", list(METRICS)))
    for k in BUNDLE_PAIRS:
        out = out.unionByName(long(gene_summary(gene_metrics_, metric=f"{k}_pearson"), k, ["mean_gene_pearson", "median_gene_pearson", "valid_genes"]))
    return out
