"""Statistical baselines, gene selection, and picks for inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spotweave.functions.moments import SUMS, merged_sums, metric_columns
from spotweave.functions.scalars import rate_of
from spotweave.operators.evaluate import gene_summary, level_metrics
from spotweave.operators.ordering import group_quantile, row_number
from spotweave.operators.sizefactor import SAMPLE, SPOT
from spotweave.session import materialise


def with_fallback(organ: DataFrame, overall: DataFrame, organs: DataFrame) -> DataFrame:
    """Organ value per (organ, gene), the overall value where the organ has none."""
    # organs × panel genes: both are label-sized lists, the output is the lookup table itself.
    grid = organs.crossJoin(overall.select("gene", F.col("mean_rate").alias("_all")))
    j = grid.join(organ.select("organ", "gene", F.col("mean_rate").alias("_organ")), ["organ", "gene"], "left")
    return j.select("organ", "gene", F.coalesce("_organ", "_all").alias("mean_rate"), F.col("_organ").isNull().alias("is_fallback"))


def _with_factors(counts: DataFrame, spots: DataFrame, *factors: str) -> DataFrame:
    """Counts of `spots` with the factors of their spots. Counts that carry them already, of valid spots only, are not joined."""
    cells = [*SPOT, "gene", "count"]
    if all(f in counts.columns for f in factors):
        return counts.select(*cells, *factors)
    return counts.select(*cells).join(spots.select(*SPOT, *factors), SPOT)


def _rate_parts(counts: DataFrame, sf: DataFrame, sample_genes: DataFrame, samples: DataFrame) -> DataFrame:
    """Per (organ, sample, gene): Σ rate of stored counts, and valid spots as the denominator.

    A table with a row per sample and gene takes two bytes a row in its file and a hundred in a broadcast, so these joins are merges.
    """
    spots = sf.filter("valid").select(*SPOT, "sf")
    sums = _with_factors(counts, spots, "sf").groupBy(SAMPLE, "gene").agg(F.sum(rate_of(F.col("count"), F.col("sf"))).alias("s"))
    n = spots.groupBy(SAMPLE).agg(F.count(F.lit(1)).alias("n"))
    return (
        sample_genes.select(SAMPLE, "gene").join(n.hint("merge"), SAMPLE).join(samples.select(SAMPLE, "organ").hint("merge"), SAMPLE)
        .join(sums.hint("merge"), [SAMPLE, "gene"], "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    )


def mean_rates(counts: DataFrame, sf: DataFrame, sample_genes: DataFrame, samples: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean rate per gene over valid spots of samples that measured it. Zeros enter through the denominator only."""
    keys = [*(by or []), "gene"]
    p = _rate_parts(counts, sf, sample_genes, samples)
    return p.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("mean_rate"), F.sum("n").alias("n_spots"))


METHODS = {
    "global_mean_rate": ("global", "one", "rate"),
    "global_sf_only_count_pred_sf": ("global", "pred_sf", "count"),
    "global_sf_only_count_oracle_sf": ("global", "sf", "count"),
    "organ_sf_only_count_pred_sf": ("organ", "pred_sf", "count"),
    "organ_sf_only_count_oracle_sf": ("organ", "sf", "count"),
}


def baseline_sums(
    counts: DataFrame, spots: DataFrame, sample_genes: DataFrame, samples: DataFrame, global_rates: DataFrame, organ_rates: DataFrame
) -> DataFrame:
    """Power sums of the five baselines per (method, sample, gene) without a single dense row.

    A baseline predicts rate(gene)·f(spot) everywhere. Its sums over all spots of a sample are rate·Σf and rate²·Σf²;
    products with the truth need stored counts only; and the absolute error is Σ p over all cells plus Σ (|p−t| − p)
    over stored ones. So one pass over the sparse counts and one over the spots is enough.

    `spots` holds the valid spots with sf and pred_sf. Counts get the organ of their sample where they lie and the rates by organ and gene,
    which are few rows; nothing with a row per sample passes through the driver.
    """
    few = materialise(
        organ_rates.select("organ", "gene", "mean_rate", F.lit(False).alias("all"))
        .unionByName(global_rates.select("gene", "mean_rate", F.lit(True).alias("all")), allowMissingColumns=True)
    )
    by_gene = few.filter("all").select("gene", F.col("mean_rate").alias("r_global"))
    by_organ = few.filter("NOT all").select("organ", "gene", F.col("mean_rate").alias("r_organ"))

    def rated(rows: DataFrame, how: str) -> DataFrame:
        d = rows.join(samples.select(SAMPLE, "organ").hint(how), SAMPLE).join(by_gene, "gene", "left").join(by_organ, ["organ", "gene"], "left")
        return d.select(*rows.columns, F.coalesce("r_global", F.lit(0.0)).alias("r_global"), F.coalesce("r_organ", "r_global", F.lit(0.0)).alias("r_organ"))

    rates = rated(sample_genes.select(SAMPLE, "gene"), "merge")
    factor = lambda f: F.lit(1.0) if f == "one" else F.col(f)
    per_sample = spots.groupBy(SAMPLE).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(factor(f)).alias(f"f1_{f}") for f in ("one", "pred_sf", "sf")],
        *[F.sum(factor(f) * factor(f)).alias(f"f2_{f}") for f in ("one", "pred_sf", "sf")],
    )
    stored = (
        rated(_with_factors(counts, spots, "sf", "pred_sf"), "shuffle_hash")  # genes off the panel go with the last join
        .withColumn("t_count", F.col("count").cast("double"))
        .withColumn("t_rate", rate_of(F.col("count"), F.col("sf")))
    )
    for m, (r, f, kind) in METHODS.items():
        stored = stored.withColumn(f"p_{m}", F.col(f"r_{r}") * factor(f))
    aggs: list[Column] = [F.count(F.lit(1)).alias("nz")]
    for kind in ("count", "rate"):
        t = F.col(f"t_{kind}")
        aggs += [F.sum(t).alias(f"st_{kind}"), F.sum(t * t).alias(f"stt_{kind}")]
    for m, (_, _, kind) in METHODS.items():
        p, t = F.col(f"p_{m}"), F.col(f"t_{kind}")
        aggs += [F.sum(p * t).alias(f"spt_{m}"), F.sum(F.abs(p - t) - p).alias(f"sad_{m}")]
    sparse = stored.groupBy(SAMPLE, "gene").agg(*aggs)
    j = rates.join(per_sample.hint("merge"), SAMPLE).join(sparse.hint("merge"), [SAMPLE, "gene"], "left").na.fill(0)
    sets = []
    for m, (r, f, kind) in METHODS.items():
        rate = F.col(f"r_{r}")
        sp, spp = rate * F.col(f"f1_{f}"), rate * rate * F.col(f"f2_{f}")
        st, stt, spt = F.col(f"st_{kind}"), F.col(f"stt_{kind}"), F.col(f"spt_{m}")
        vals = {"n": F.col("n"), "sp": sp, "st": st, "spp": spp, "stt": stt, "spt": spt, "sae": sp + F.col(f"sad_{m}"),
                "sse": spp - 2 * spt + stt, "nz": F.col("nz")}
        sets.append(F.struct(F.lit(m).alias("method"), F.lit(kind).alias("prediction_kind"), *[vals[c].alias(c) for c in SUMS]))
    return j.select(SAMPLE, "gene", F.explode(F.array(*sets)).alias("s")).select(SAMPLE, "gene", "s.*")


def baseline_marts(sums: DataFrame, samples: DataFrame) -> dict[str, DataFrame]:
    s = materialise(sums)
    keys = ["method", "prediction_kind"]
    per_gene = s.groupBy(*keys, "gene").agg(*merged_sums()).select(*keys, "gene", *metric_columns("n_obs", True))
    return {"per_gene": per_gene, "levels": level_metrics(s, samples, keys), "summary": gene_summary(per_gene, keys)}


def slides_with_sf(spots: DataFrame, sample_genes: DataFrame, samples: DataFrame) -> DataFrame:
    n = sample_genes.groupBy(SAMPLE).agg(F.count(F.lit(1)).alias("n_measured_genes"))
    s = spots.groupBy(SAMPLE).agg(
        F.count(F.lit(1)).alias("n_spots"), F.avg("pred_sf").alias("pred_sf_mean"),
        F.stddev_pop("pred_sf").alias("pred_sf_std"), F.stddev_pop("sf").alias("true_sf_std"),
    )
    return s.join(n, SAMPLE).join(samples.select(SAMPLE, "split", "organ", "cohort"), SAMPLE)


def gene_presence(sample_genes: DataFrame, samples: DataFrame, min_slides: int = 1, min_fraction: float | None = None) -> DataFrame:
    """Genes by the number of samples that have them, with the threshold and whether it is met."""
    n = samples.agg(F.count(F.lit(1)).alias("n_slides"))
    need = F.lit(min_slides) if min_fraction is None else F.greatest(F.lit(min_slides), F.ceil(F.lit(min_fraction) * F.col("n_slides")))
    g = sample_genes.select(SAMPLE, "gene").distinct().groupBy("gene").agg(F.count(F.lit(1)).alias("slides_present"))
    return g.crossJoin(F.broadcast(n)).withColumn("required_slides", need.cast("long")).withColumn(
        "is_candidate", F.col("slides_present") >= F.col("required_slides")
    )


def gene_selection_report(
    counts: DataFrame, sf: DataFrame, sample_genes: DataFrame, samples: DataFrame, min_slides: int = 1,
    min_fraction: float | None = None, min_detected: int = 1, top_n: int = 0,
) -> DataFrame:
    presence = gene_presence(sample_genes, samples, min_slides, min_fraction).filter("is_candidate")
    spots = sf.filter("valid").select(*SPOT)
    per_sample = spots.groupBy(SAMPLE).agg(F.count(F.lit(1)).alias("n"))
    n_valid = per_sample.agg(F.sum("n").alias("n_valid"))
    measured = sample_genes.select(SAMPLE, "gene").distinct().join(per_sample, SAMPLE).groupBy("gene").agg(F.sum("n").alias("measured_spots"))
    seen = counts.join(spots, SPOT, "left_semi").groupBy("gene").agg(
        F.sum("count").alias("total_count"), F.count(F.when(F.col("count") > 0, 1)).alias("detected_spots")
    )
    d = presence.join(measured, "gene", "left").join(seen, "gene", "left").na.fill(0).crossJoin(F.broadcast(n_valid))
    valid = F.greatest("n_valid", F.lit(1))
    out = d.filter(F.col("detected_spots") >= min_detected).select(
        "gene", "slides_present", (F.col("slides_present") / F.col("n_slides")).alias("slide_fraction"), "measured_spots", "total_count",
        (F.col("total_count") / valid).alias("mean_count"), "detected_spots", (F.col("detected_spots") / valid).alias("detected_fraction"),
        (F.col("detected_spots") / F.greatest("measured_spots", F.lit(1))).alias("detected_fraction_measured"),
    )
    ordered = out.orderBy(F.desc("slides_present"), F.desc("detected_spots"), F.desc("total_count"), "gene")
    return ordered.limit(top_n) if top_n > 0 else ordered


def target_coverage(sample_genes: DataFrame, targets: DataFrame, samples: DataFrame) -> DataFrame:
    """Target genes measured per sample."""
    hit = sample_genes.join(targets.select("gene"), "gene", "left_semi").select(SAMPLE, "gene").distinct()
    n = hit.groupBy(SAMPLE).agg(F.count(F.lit(1)).alias("measured_target_genes"))
    return samples.select(SAMPLE, "split", "organ").join(n, SAMPLE, "left").withColumn(
        "measured_target_genes", F.coalesce("measured_target_genes", F.lit(0))
    )


def coverage_by_group(coverage: DataFrame, keys: list[str]) -> DataFrame:
    c = "measured_target_genes"
    d = coverage.groupBy(*keys).agg(F.count(c).alias("n_slides"), F.min(c).alias("min_genes"), F.max(c).alias("max_genes"))
    return d.join(group_quantile(coverage, keys, c, 0.5, "median_genes"), keys)


def _distinct_by_priority(picks: DataFrame, key: str, cap: int) -> DataFrame:
    """First reason a key was picked for, in order of picking, at most `cap` keys."""
    first = picks.groupBy(key).agg(F.min("_at").alias("_at"), F.min_by("selection_reason", "_at").alias("selection_reason"))
    return first.orderBy("_at").limit(cap)


def overlay_genes(per_gene: DataFrame, max_genes: int = 6, metric: str = "pearson", min_obs: int = 100) -> DataFrame:
    """2 poorest, 1 middle, 3 best genes by correlation; marker genes only, if there are three of them.

    `per_gene` has gene, gene_class, n_obs, true_std and the metric; one row per panel gene.
    """
    ok = per_gene.filter(F.col(metric).isNotNull() & (F.col("n_obs") >= min_obs) & (F.col("true_std") > 0))
    flags = ok.agg(F.count(F.when(F.col("gene_class") != "other", 1)).alias("_markers"))
    ok = ok.crossJoin(F.broadcast(flags)).filter("_markers < 3 OR gene_class <> 'other'")
    ok = ok.select("gene", "gene_class", F.col(metric).alias("m"))
    n = ok.agg(F.count(F.lit(1)).alias("n"))
    place = lambda d, at, reason: d.select("gene", "gene_class", F.col("m").alias(metric), at.cast("long").alias("_at"), F.lit(reason).alias("selection_reason"))
    by = Window.orderBy("_o")
    low = ok.withColumn("_o", F.struct("m", "gene", "gene_class")).orderBy("_o").limit(2).withColumn("_r", F.row_number().over(by))  # few rows
    high = ok.withColumn("_o", F.struct("m", "gene", "gene_class")).orderBy(F.desc("_o")).limit(3).withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_o"))))
    middle = row_number(ok, [], [F.col("m"), F.col("gene"), F.col("gene_class")], "_r").crossJoin(n).filter(F.col("_r") - 1 == F.floor(F.col("n") / 2))
    picks = place(low, F.col("_r") - 1, "poor").unionByName(place(middle, F.lit(2), "median")).unionByName(place(high, F.col("_r") + 2, "good"))
    chosen = _distinct_by_priority(picks, "gene", max_genes)
    return chosen.select("gene", "selection_reason").join(picks.select("gene", "gene_class", metric).distinct(), "gene")


def diagnostic_slides(slide_metrics: DataFrame, max_slides: int = 8, each: int = 4) -> DataFrame:
    """Slides with the worst and best correlation and the lowest tail ratio, distinct, in that order."""
    parts = []
    for j, (reason, order) in enumerate(
        (
            ("worst", F.asc_nulls_last("log_sf_pearson")),
            ("best", F.desc_nulls_last("log_sf_pearson")),
            ("low_tail", F.asc_nulls_last("sf_top_decile_mean_ratio")),
        )
    ):
        top = slide_metrics.orderBy(order, SAMPLE).limit(each)
        cols = [F.lit(reason).alias("selection_reason"), SAMPLE, "log_sf_pearson", "sf_top_decile_mean_ratio"]
        ranked = top.select(*cols).agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        (F.coalesce("log_sf_pearson", F.lit(9e9)) if reason == "worst" else -F.coalesce("log_sf_pearson", F.lit(-9e9)) if reason == "best" else F.coalesce("sf_top_decile_mean_ratio", F.lit(9e9))).alias("o"),
                        SAMPLE,
                    )
                )
            ).alias("a")
        ).select(F.posexplode("a").alias("i", "s"))
        parts.append(ranked.select(F.col(f"s.{SAMPLE}").alias(SAMPLE), F.lit(reason).alias("selection_reason"), (F.col("i") + 100 * j).alias("_at")))
    return _distinct_by_priority(parts[0].unionByName(parts[1]).unionByName(parts[2]), SAMPLE, max_slides).select(SAMPLE, "selection_reason")
