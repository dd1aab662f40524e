"""Do predicted slide profiles separate the same labels as measured ones?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spotweave.functions.moments import pearson
from spotweave.functions.scalars import clean_label
from spotweave.operators.sizefactor import SAMPLE, with_group_stats
from spotweave.session import materialise

FIELD = ["label_field"]


def slide_profiles(scores: DataFrame, samples: DataFrame, fields: list[str]) -> DataFrame:
    """Mean scores per slide and signature over valid spots, with cleaned label fields."""
    slide = scores.filter(F.coalesce(F.col("valid"), F.lit(False))).groupBy(SAMPLE, "signature").agg(
        F.avg("true").alias("true_mean"), F.avg("pred").alias("pred_mean"), F.count(F.lit(1)).alias("n_spots")
    )
    have = [f for f in fields if f in samples.columns]
    return slide.join(samples.select(SAMPLE, *[clean_label(F.col(f)).alias(f) for f in have]), SAMPLE, "left")


def _long(profiles: DataFrame, fields: list[str]) -> DataFrame:
    have = [f for f in fields if f in profiles.columns]
    labels = F.array(*[F.struct(F.lit(f).alias("label_field"), F.col(f).alias("label_value")) for f in have])
    d = profiles.select(SAMPLE, "signature", "true_mean", "pred_mean", "n_spots", F.explode(labels).alias("l"))
    return d.select(SAMPLE, "signature", "true_mean", "pred_mean", "n_spots", "l.*").filter("label_value <> ''")


def eligible_groups(profiles: DataFrame, fields: list[str], min_slides: int = 2) -> DataFrame:
    """(field, value) with enough slides, for fields that have at least two such values."""
    slides = _long(profiles, fields).select(*FIELD, "label_value", SAMPLE).distinct()
    g = slides.groupBy(*FIELD, "label_value").agg(F.count(F.lit(1)).alias("n_group_slides")).filter(F.col("n_group_slides") >= min_slides)
    return with_group_stats(
        g, FIELD, F.count(F.lit(1)).alias("n_groups"), F.array_join(F.array_sort(F.collect_list("label_value")), "|").alias("groups")
    ).filter("n_groups >= 2")


def _members(profiles: DataFrame, fields: list[str], min_slides: int) -> DataFrame:
    """Profiles of the labels that count. They have a row per slide, signature and field: hinted, or by the size of their files they would be broadcast."""
    return _long(profiles, fields).join(eligible_groups(profiles, fields, min_slides).hint("merge"), [*FIELD, "label_value"])


def group_profiles(profiles: DataFrame, fields: list[str], min_slides: int = 2) -> DataFrame:
    return _members(profiles, fields, min_slides).groupBy(*FIELD, "label_value", "signature").agg(
        F.countDistinct(SAMPLE).alias("n_slides"), F.sum("n_spots").alias("n_spots"),
        F.avg("true_mean").alias("true_mean"), F.avg("pred_mean").alias("pred_mean"),
        F.stddev_pop("true_mean").alias("true_std"), F.stddev_pop("pred_mean").alias("pred_std"),
    )


def signature_effects(profiles: DataFrame, fields: list[str], min_slides: int = 2) -> DataFrame:
    """η² = between / total sum of squares per field and signature, top groups and their agreement, range of means."""
    m = _members(profiles, fields, min_slides)
    keys = [*FIELD, "signature"]
    by_group = m.groupBy(*keys, "label_value").agg(
        F.count(F.lit(1)).alias("n"), F.avg("true_mean").alias("t"), F.avg("pred_mean").alias("p")
    )
    total = m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("true_mean").alias("_gt"), F.avg("pred_mean").alias("_gp"),
        (F.var_pop("true_mean") * F.count(F.lit(1))).alias("_sst"), (F.var_pop("pred_mean") * F.count(F.lit(1))).alias("_ssp"),
        F.max("n_groups").alias("n_groups"), F.max("groups").alias("groups"),
    )
    j = by_group.join(total, keys)

    def ssb(c: str, g: str) -> Column:
        return F.sum(F.col("n") * (F.col(c) - F.col(g)) * (F.col(c) - F.col(g)))

    def top(c: str) -> Column:
        return F.min_by("label_value", F.struct(-F.col(c), F.col("label_value")))

    a = j.groupBy(*keys).agg(
        F.max("_n").alias("n_slides"), F.max("n_groups").alias("n_groups"), F.max("groups").alias("groups"), F.count(F.lit(1)).alias("_present"),
        ssb("t", "_gt").alias("_bt"), ssb("p", "_gp").alias("_bp"), F.max("_sst").alias("_sst"), F.max("_ssp").alias("_ssp"),
        top("t").alias("true_top_group"), top("p").alias("pred_top_group"),
        (F.max("t") - F.min("t")).alias("true_group_range"), (F.max("p") - F.min("p")).alias("pred_group_range"),
    )
    enough = (F.col("n_slides") >= 3) & (F.col("_present") >= 2)
    eta = lambda b, s: F.when(enough & (F.col(s) > 0), F.col(b) / F.nullif(F.col(s), F.lit(0.0)))
    a = a.withColumn("true_eta_squared", eta("_bt", "_sst")).withColumn("pred_eta_squared", eta("_bp", "_ssp"))
    return a.select(
        *keys, "n_slides", "n_groups", "groups", "true_eta_squared", "pred_eta_squared",
        F.abs(F.col("pred_eta_squared") - F.col("true_eta_squared")).alias("abs_eta_error"), "true_top_group", "pred_top_group",
        (F.col("true_top_group") == F.col("pred_top_group")).alias("top_group_match"), "true_group_range", "pred_group_range",
    )


def group_contrasts(profiles: DataFrame, fields: list[str], min_slides: int = 2) -> DataFrame:
    """Cohen's d of every pair of label values a < b, per signature that either of them has.

    Only group statistics are paired, one row per label value and signature; slides and spots are not.
    """
    stats = _members(profiles, fields, min_slides).groupBy(*FIELD, "label_value", "signature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("true_mean").alias("t"), F.avg("pred_mean").alias("p"),
        F.var_samp("true_mean").alias("vt"), F.var_samp("pred_mean").alias("vp"),
    )
    g = eligible_groups(profiles, fields, min_slides).select(*FIELD, "label_value")
    b = g.select(*FIELD, F.col("label_value").alias("group_b"))
    pairs = g.withColumnRenamed("label_value", "group_a").join(b, FIELD).filter("group_a < group_b")
    sides = pairs.select("*", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("group_a").alias("label_value")),
                                                F.struct(F.lit(1).alias("side"), F.col("group_b").alias("label_value")))).alias("s"))
    j = sides.select(*FIELD, "group_a", "group_b", "s.*").join(stats, [*FIELD, "label_value"])
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    keys = [*FIELD, "group_a", "group_b", "signature"]
    w = j.groupBy(*keys).agg(*[of(s, c).alias(f"_{c}{n}") for s, n in ((0, "a"), (1, "b")) for c in ("n", "t", "p", "vt", "vp")])
    na, nb = F.coalesce("_na", F.lit(0)), F.coalesce("_nb", F.lit(0))

    def d(mean: str, var: str) -> Column:
        pooled = F.sqrt(((na - 1) * F.col(f"_{var}a") + (nb - 1) * F.col(f"_{var}b")) / F.nullif(na + nb - 2, F.lit(0)))
        return F.when((na >= 2) & (nb >= 2) & (pooled > 0), (F.col(f"_{mean}a") - F.col(f"_{mean}b")) / F.nullif(pooled, F.lit(0.0)))

    out = w.select(*keys, na.alias("n_a"), nb.alias("n_b"), d("t", "vt").alias("true_cohen_d"), d("p", "vp").alias("pred_cohen_d"))
    same = F.signum("true_cohen_d") == F.signum("pred_cohen_d")
    return out.withColumn("abs_contrast_error", F.abs(F.col("pred_cohen_d") - F.col("true_cohen_d"))).withColumn(
        "same_direction", F.coalesce(same, F.lit(False))
    )


def field_summary(effects: DataFrame, contrasts: DataFrame, top_k: int = 3) -> DataFrame:
    """One row per label field; fields whose η² cannot be correlated come last."""
    effects, contrasts = materialise(effects), materialise(contrasts)
    e = effects.groupBy(*FIELD).agg(
        F.count(F.lit(1)).alias("n_signatures"), F.max("n_slides").alias("n_slides"), F.max("n_groups").alias("n_groups"),
        F.max("groups").alias("groups"), F.avg("abs_eta_error").alias("mean_abs_eta_error"),
        F.avg(F.col("top_group_match").cast("double")).alias("top_group_match_rate"),
    )

    def pair_r(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
        both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        return both.groupBy(*FIELD).agg(pearson(x, y).alias(out))

    # One row per signature and field: ranking the signatures of a field is a small window.
    both = effects.filter("true_eta_squared IS NOT NULL AND pred_eta_squared IS NOT NULL")
    rank = lambda c: F.row_number().over(W.partitionBy(*FIELD).orderBy(F.desc(c), "signature"))
    r = both.withColumn("_rt", rank("true_eta_squared")).withColumn("_rp", rank("pred_eta_squared"))
    a, b = F.col("_rt") <= top_k, F.col("_rp") <= top_k
    jac = r.groupBy(*FIELD).agg((F.count(F.when(a & b, 1)) / F.count(F.when(a | b, 1))).alias("top_signature_eta_jaccard"))
    c = contrasts.groupBy(*FIELD).agg(
        F.avg(F.col("same_direction").cast("double")).alias("contrast_same_direction_rate"), F.count(F.lit(1)).alias("n_contrasts")
    )
    out = (
        e.join(pair_r(effects, "true_eta_squared", "pred_eta_squared", "eta_pearson"), FIELD, "left")
        .join(jac, FIELD, "left").join(pair_r(contrasts, "true_cohen_d", "pred_cohen_d", "contrast_pearson"), FIELD, "left").join(c, FIELD, "left")
    )
    return out.withColumn("n_contrasts", F.coalesce("n_contrasts", F.lit(0))).orderBy(F.desc_nulls_last("eta_pearson"), *FIELD)
