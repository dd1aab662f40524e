"""Cell-type composition from gene-set scores, and agreement of label assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spotweave.functions.moments import metric_columns, sum_pairs
from spotweave.functions.scalars import finite
from spotweave.operators.sizefactor import SAMPLE, SPOT, with_group_stats
from spotweave.session import materialise


def _in_spot():
    """A window over a spot: one row per cell type, so always small."""
    return W.partitionBy(*SPOT)


def mapping_coverage(cell_types: DataFrame, scores: DataFrame) -> DataFrame:
    have = scores.select("signature").distinct().withColumn("_have", F.lit(True))
    j = cell_types.join(have, "signature", "left")
    used = F.col("_have").isNotNull()
    return j.select("cell_type", "signature", used.alias("used"), F.when(used, "").otherwise("signature_score_missing").alias("reason"))


def complete_cases(scores: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Scores of spots where every used signature is valid and finite on both sides; long, one row per `name`.

    `names` maps signatures to output names ((signature, name), a short list); signatures no spot has are not required.
    """
    used = names.join(scores.select("signature").distinct(), "signature", "left_semi")
    need = used.agg(F.count(F.lit(1)).alias("_need"))
    ok = F.coalesce(F.col("valid"), F.lit(False)) & finite(F.col("true")) & finite(F.col("pred"))
    rows = scores.join(F.broadcast(used), "signature").select(*SPOT, name, "true", "pred", ok.alias("_ok"))
    full = rows.withColumn("_n", F.count(F.when(F.col("_ok"), 1)).over(_in_spot())).crossJoin(F.broadcast(need))
    return full.filter("_n = _need").select(*SPOT, name, "true", "pred")


def score_scaling(cases: DataFrame, name: str) -> DataFrame:
    std = F.stddev_pop("true")
    return cases.groupBy(name).agg(F.avg("true").alias("true_mean"), F.when(std < 1.0e-6, 1.0).otherwise(std).alias("true_std"))


def zscores_from_true(cases: DataFrame, name: str) -> DataFrame:
    """Both sides scaled by mean and spread of the measured side."""
    scale = score_scaling(cases, name)  # one row per name
    z = lambda c: (F.col(c) - F.col("true_mean")) / F.col("true_std")
    return cases.join(F.broadcast(scale), name).select(*SPOT, name, z("true").alias("true"), z("pred").alias("pred"))


def softmax_fractions(z: DataFrame, name: str, temperature: float = 1.0) -> DataFrame:
    """Fractions per spot, shifted by the largest score of the spot before the exponential."""
    t = F.lit(max(temperature, 1.0e-6))
    shifted = lambda c: F.exp((F.col(c) - F.max(c).over(_in_spot())) / t)
    d = z.select(*SPOT, name, shifted("true").alias("_et"), shifted("pred").alias("_ep"))
    share = lambda c: F.col(c) / F.sum(c).over(_in_spot())
    return d.select(*SPOT, name, share("_et").alias("true"), share("_ep").alias("pred"))


def dominant(fractions: DataFrame, name: str) -> DataFrame:
    """Largest fraction per spot on both sides; the first name wins a tie.

    Names are compared in reverse through their code points, so that `max_by` prefers the first one.
    """
    def best(c: str) -> Column:
        return F.min_by(name, F.struct(-F.col(c), F.col(name)))

    return fractions.groupBy(*SPOT).agg(best("true").alias("true_label"), best("pred").alias("pred_label"))


def _fraction_columns(prefix: str) -> list[Column]:
    enough = F.col("n") >= 3
    cols = metric_columns("n")
    keep = {"pearson": f"{prefix}_fraction_pearson", "mae": f"{prefix}_fraction_mae", "rmse": f"{prefix}_fraction_rmse",
            "true_mean": f"{prefix}_true_mean_fraction", "pred_mean": f"{prefix}_pred_mean_fraction"}
    names = ["n", "pearson", "mae", "rmse", "true_mean", "pred_mean"]
    out = [F.when(enough, F.col("n")).otherwise(F.lit(0)).cast("long").alias(f"{prefix}_n")]
    for n, c in zip(names[1:], cols[1:6]):
        out.append(F.when(enough, c).alias(keep[n]))
    return out


def slide_means(fractions: DataFrame, name: str) -> DataFrame:
    return fractions.groupBy(SAMPLE, name).agg(F.avg("true").alias("true"), F.avg("pred").alias("pred"), F.count(F.lit(1)).alias("n_spots"))


def fraction_metrics(fractions: DataFrame, name: str) -> DataFrame:
    """Per cell type over spots and over slide means; fewer than three values give no metric."""
    spot = sum_pairs(fractions, [name]).select(name, *_fraction_columns("spot"))
    slide = sum_pairs(slide_means(fractions, name), [name]).select(name, *_fraction_columns("slide"))
    return spot.join(slide, name)


def slide_table(fractions: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Wide: true_, pred_ and delta_ per type."""
    m = slide_means(fractions, name)
    at = lambda c, v: F.max(F.when(F.col(name) == v, F.col(c)))
    cols = []
    for v in values:
        cols += [at("true", v).alias(f"true_{v}"), at("pred", v).alias(f"pred_{v}"), (at("pred", v) - at("true", v)).alias(f"delta_{v}")]
    return m.groupBy(SAMPLE).agg(F.max("n_spots").alias("n_spots"), *cols)


def spot_table(fractions: DataFrame, labels: DataFrame, name: str, values: list[str]) -> DataFrame:
    at = lambda c, v: F.max(F.when(F.col(name) == v, F.col(c))).alias(f"{c}_fraction_{v}")
    wide = fractions.groupBy(*SPOT).agg(*[at(c, v) for v in values for c in ("true", "pred")])
    return labels.withColumnsRenamed({"true_label": "true_dominant", "pred_label": "pred_dominant"}).join(wide, SPOT)


def confusion(labels: DataFrame, keys: list[str] | None = None, values: DataFrame | None = None) -> DataFrame:
    """Counts per (true, pred); with `values` (one column, `label`, a short list) zero cells are listed too."""
    keys = keys or []
    c = labels.groupBy(*keys, "true_label", "pred_label").agg(F.count(F.lit(1)).alias("n_spots"))
    if values is None:
        return c
    grid = values.select(F.col("label").alias("true_label")).crossJoin(values.select(F.col("label").alias("pred_label")))
    if keys:
        grid = c.select(*keys).distinct().crossJoin(grid)
    return grid.join(c, [*keys, "true_label", "pred_label"], "left").withColumn("n_spots", F.coalesce("n_spots", F.lit(0)))


def agreement(conf: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accuracy, macro F1, adjusted Rand index and normalised mutual information from a confusion table.

    The table has one row per label pair, so all of this is small however many spots stand behind it.
    """
    keys = keys or []
    c = materialise(conf.filter("n_spots > 0"))
    n = F.col("n_spots")
    pairs = lambda x: x * (x - 1) / F.lit(2.0)

    def margin(label: str, name: str) -> DataFrame:
        m = c.groupBy(*keys, F.col(label).alias("label")).agg(F.sum(n).alias("_m"))
        return with_group_stats(m, keys, F.sum("_m").alias("_total")).select(*keys, "label", F.col("_m").alias(f"_{name}"), "_total")

    a, b = margin("true_label", "a"), margin("pred_label", "b")
    entropy = lambda m: -F.sum(F.col(m) / F.col("_total") * F.log(F.col(m) / F.col("_total")))
    sa = a.groupBy(*keys).agg(F.sum(pairs(F.col("_a"))).alias("_pa"), entropy("_a").alias("_ha"), F.max("_total").alias("n_spots"))
    sb = b.groupBy(*keys).agg(F.sum(pairs(F.col("_b"))).alias("_pb"), entropy("_b").alias("_hb"))
    j = (
        c.join(a.select(*keys, F.col("label").alias("true_label"), "_a", "_total"), [*keys, "true_label"])
        .join(b.select(*keys, F.col("label").alias("pred_label"), "_b"), [*keys, "pred_label"])
    )
    mi = F.sum(n / F.col("_total") * F.log(n * F.col("_total") / (F.col("_a") * F.col("_b"))))
    sc = j.groupBy(*keys).agg(
        F.sum(pairs(n)).alias("_pc"), mi.alias("_mi"),
        F.sum(F.when(F.col("true_label") == F.col("pred_label"), n).otherwise(F.lit(0))).alias("_hit"),
    )
    hits = c.filter("true_label = pred_label").select(*keys, F.col("true_label").alias("label"), n.alias("_tp"))
    f1 = (
        a.drop("_total").join(b.drop("_total"), [*keys, "label"], "full_outer").join(hits, [*keys, "label"], "left").na.fill(0, ["_a", "_b", "_tp"])
        .groupBy(*keys).agg(F.avg(2 * F.col("_tp") / (F.col("_a") + F.col("_b"))).alias("macro_f1"))
    )
    if keys:
        d = sa.join(sb, keys).join(sc, keys).join(f1, keys)
    else:
        d = sa.crossJoin(F.broadcast(sb)).crossJoin(F.broadcast(sc)).crossJoin(F.broadcast(f1))
    total = pairs(F.col("n_spots"))
    expected = F.col("_pa") * F.col("_pb") / F.nullif(total, F.lit(0.0))
    top = (F.col("_pa") + F.col("_pb")) / 2.0
    gap = top - expected
    ari = F.when(F.coalesce(gap, F.lit(0.0)) == 0, F.lit(1.0)).otherwise((F.col("_pc") - expected) / F.nullif(gap, F.lit(0.0)))
    mean_h = (F.col("_ha") + F.col("_hb")) / 2.0
    nmi = F.when(mean_h <= 1.0e-12, F.lit(1.0)).otherwise(F.greatest(F.col("_mi"), F.lit(0.0)) / F.nullif(mean_h, F.lit(0.0)))
    return d.select(
        *keys, "n_spots", (F.col("_hit") / F.col("n_spots")).alias("accuracy"), "macro_f1",
        ari.alias("adjusted_rand"), nmi.alias("normalized_mutual_info"),
    )


def composition_overall(metrics: DataFrame, agree: DataFrame) -> DataFrame:
    """One row: averages over the cell types, and the agreement of dominant labels."""
    cols = []
    for c in ("spot_fraction_pearson", "slide_fraction_pearson"):
        cols += [F.avg(c).alias(f"mean_{c}"), F.percentile(c, 0.5).alias(f"median_{c}")]
    m = metrics.agg(F.count(F.lit(1)).alias("n_cell_types"), *cols)
    a = agree.select(
        "n_spots", F.col("accuracy").alias("dominant_accuracy"), F.col("macro_f1").alias("dominant_macro_f1"),
        F.col("adjusted_rand").alias("dominant_adjusted_rand"), F.col("normalized_mutual_info").alias("dominant_nmi"),
    )
    return m.crossJoin(F.broadcast(a))
