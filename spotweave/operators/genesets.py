"""Gene-set scores per spot and how well predicted scores follow measured ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spotweave.functions.moments import merged_sums, metric_columns, stack_sums, sum_pairs
from spotweave.functions.scalars import rate_of
from spotweave.operators.sizefactor import SAMPLE, SPOT

KINDS = ("rate", "count_pred_sf")


def _short(gene_sets: DataFrame) -> DataFrame:
    """Sets are short lists: joined by a shuffle, all cells of a gene would meet in one task."""
    return F.broadcast(gene_sets.select("signature", "gene"))


def set_coverage(gene_sets: DataFrame, genes: DataFrame) -> DataFrame:
    """Per set: size, genes on the panel, and both lists in set order. Sets are small tables by nature."""
    known = genes.select("gene", F.lit(True).alias("_on")).distinct()
    j = gene_sets.join(known, "gene", "left")
    listed = lambda present: F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.when(F.col("_on").isNotNull() == present, F.struct("position", "gene")))),
            lambda s: s["gene"],
        ),
        "|",
    )
    return j.groupBy("signature").agg(
        F.count(F.lit(1)).alias("n_target_genes"),
        F.count("_on").alias("n_present_genes"),
        listed(True).alias("present_genes"),
        listed(False).alias("missing_genes"),
    )


def set_scores(cells: DataFrame, gene_sets: DataFrame, value: str, min_genes: int = 2) -> DataFrame:
    """Mean of `value` over the measured member genes of a spot; NULL and invalid below `min_genes`.

    `cells` holds every measured gene of a spot, zeros included.
    """
    return (
        cells.join(_short(gene_sets), "gene")
        .groupBy(*SPOT, "signature")
        .agg(F.avg(value).alias("_score"), F.count(F.lit(1)).alias("n_measured"))
        .select(*SPOT, "signature", F.when(F.col("n_measured") >= min_genes, F.col("_score")).alias("score"), (F.col("n_measured") >= min_genes).alias("valid"))
    )


def sparse_set_scores(counts: DataFrame, sf: DataFrame, gene_sets: DataFrame, sample_genes: DataFrame, min_genes: int = 2) -> DataFrame:
    """log1p-rate scores of the measured side alone, without zero rows: the sum runs over stored counts, the
    denominator is the number of member genes the sample measured."""
    members = (
        sample_genes.join(_short(gene_sets), "gene")
        .groupBy(SAMPLE, "signature")
        .agg(F.count(F.lit(1)).alias("n_measured"))
    )
    spots = sf.filter("valid").select(*SPOT, "sf")
    summed = (
        counts.join(_short(gene_sets), "gene")
        .join(spots, SPOT)
        .groupBy(*SPOT, "signature")
        .agg(F.sum(F.log1p(rate_of(F.col("count"), F.col("sf")))).alias("_sum"))
    )
    ok = F.col("n_measured") >= min_genes
    return (
        spots.join(members, SAMPLE)
        .join(summed, [*SPOT, "signature"], "left")
        .select(*SPOT, "signature", F.when(ok, F.coalesce("_sum", F.lit(0.0)) / F.col("n_measured")).alias("score"), ok.alias("valid"))
    )


def spot_scores(cells: DataFrame, gene_sets: DataFrame, sample_genes: DataFrame, min_genes: int = 2) -> DataFrame:
    """The spot-score table: measured and predicted scores on the rate and on the count scale, in one aggregation.

    `cells` holds (true_count, sf, pred_rate, pred_sf) for every measured gene of every valid spot.
    """
    count = F.col("true_count").cast("double")
    members = cells.join(_short(gene_sets), "gene")
    agg = members.groupBy(*SPOT, "signature").agg(  # sums, as averages would shuffle a count each
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.log1p(rate_of(count, F.col("sf")))).alias("rate_true"),
        F.sum(F.log1p("pred_rate")).alias("rate_pred"),
        F.sum(F.log1p(count)).alias("count_pred_sf_true"),
        F.sum(F.log1p(F.col("pred_rate") * F.col("pred_sf"))).alias("count_pred_sf_pred"),
    )
    ok = F.col("_n") >= min_genes
    scores = ["rate_true", "rate_pred", "count_pred_sf_true", "count_pred_sf_pred"]
    return agg.select(
        *SPOT, "signature", *[F.when(ok, F.col(c) / F.col("_n")).alias(c) for c in scores],
        ok.alias("rate_valid"), ok.alias("count_pred_sf_valid"),
    )


def score_columns(kind: str) -> tuple[str, str, str]:
    if kind not in KINDS:
        raise ValueError(f"unknown score kind {kind!r}; one of {KINDS}")
    return f"{kind}_true", f"{kind}_pred", f"{kind}_valid"


def scores_of_kind(scores: DataFrame, kind: str, *keep: str) -> DataFrame:
    t, p, v = score_columns(kind)
    return scores.select(*SPOT, "signature", *keep, F.col(t).alias("true"), F.col(p).alias("pred"), F.col(v).alias("valid"))


def long_scores(scores: DataFrame) -> DataFrame:
    """(score_kind, true, pred, valid) rows of both scales."""
    sets = [F.struct(F.lit(k).alias("score_kind"), *[F.col(c).alias(a) for c, a in zip(score_columns(k), ("true", "pred", "valid"))]) for k in KINDS]
    return scores.select(*SPOT, "signature", F.explode(F.array(*sets)).alias("s")).select(*SPOT, "signature", "s.*")


def set_fidelity(scores: DataFrame, samples: DataFrame, coverage: DataFrame) -> DataFrame:
    """Agreement of predicted and measured scores overall, per organ and per slide, with the coverage of the set.

    Reduced once to (sample, signature) for both scales side by side; the levels roll up from there.
    """
    valid = lambda c, k: F.when(F.col(f"{k}_valid"), F.col(c))
    wide = sum_pairs(scores, [SAMPLE, "signature"], {k + "_": (valid(f"{k}_pred", k), valid(f"{k}_true", k)) for k in KINDS})
    sums = stack_sums(wide, [SAMPLE, "signature"], {k: k + "_" for k in KINDS}, "metric_kind")
    labelled = sums.join(samples.select(SAMPLE, F.coalesce("organ", F.lit("unknown")).alias("organ")), SAMPLE)
    keys = ["metric_kind", "signature"]
    rolled = labelled.groupingSets([keys, [*keys, "organ"], [*keys, SAMPLE]], *keys, "organ", SAMPLE).agg(
        *merged_sums(), F.grouping("organ").alias("_o"), F.grouping(SAMPLE).alias("_s")
    )
    level = F.when(F.col("_o") == 0, "organ").when(F.col("_s") == 0, "slide").otherwise("overall")
    done = rolled.select(level.alias("level"), *keys, "organ", SAMPLE, *metric_columns("n_spots"))
    return done.join(coverage, "signature", "left")


def overlay_picks(fidelity: DataFrame, scores: DataFrame, max_sets: int = 6, max_slides: int = 3) -> DataFrame:
    """Best sets on the rate scale × first slides that have them; a report of at most max_sets × max_slides rows."""
    best = fidelity.filter("level = 'overall' AND metric_kind = 'rate'").orderBy(F.desc_nulls_last("pearson"), "signature").limit(max_sets)
    slides = scores.select(SAMPLE).distinct().orderBy(SAMPLE).limit(max_slides)
    present = scores.groupBy(SAMPLE, "signature").agg(F.count(F.when(F.col("rate_valid"), 1)).alias("n_valid"))
    return (
        present.join(F.broadcast(best.select("signature")), "signature")
        .join(F.broadcast(slides), SAMPLE)
        .select(SAMPLE, "signature", "n_valid", (F.col("n_valid") >= 3).alias("drawable"))
    )
