"""Size-factor agreement, calibration, selection score and losses as table metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spotweave.checks import require_rows
from spotweave.functions.moments import pearson, pearson_of_sums, sum_pairs
from spotweave.functions.scalars import log_gamma, sigmoid
from spotweave.operators.ordering import group_quantile, row_number
from spotweave.operators.sizefactor import mean_one_log, with_group_stats
from spotweave.session import materialise

EPS = 1.0e-8
METRICS = [
    "log_sf_pearson", "sf_pearson", "log_sf_mae", "log_sf_rmse", "sf_std_ratio", "sf_top_decile_mean_ratio", "log_sf_top_decile_mae",
]


def _join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))  # without keys b is one row


def renormalised(df: DataFrame, keys: list[str], pred: str, true: str, q: float) -> DataFrame:
    """Both sides mean-one over the whole group, logs of that, and the tail flag `_tail` (true log ≥ its q-quantile).

    Columns: keys, ps, ts, pl, tl, _tail.
    """
    e = df.select(*keys, F.exp(pred).alias("ps"), F.exp(true).alias("ts"))
    d = with_group_stats(e, keys, F.avg("ps").alias("_mp"), F.avg("ts").alias("_mt"))
    d = d.select(*keys, (F.col("ps") / (F.col("_mp") + EPS)).alias("ps"), (F.col("ts") / (F.col("_mt") + EPS)).alias("ts"))
    d = materialise(d.withColumn("pl", F.log(F.col("ps") + EPS)).withColumn("tl", F.log(F.col("ts") + EPS)))
    cut = group_quantile(d, keys, "tl", q, "_q")
    return _join(d, cut, keys).withColumn("_tail", F.col("tl") >= F.col("_q")).drop("_q")


def sf_metrics(df: DataFrame, keys: list[str], pred: str = "pred_log_sf", true: str = "true_log_sf") -> DataFrame:
    """The seven size-factor metrics per group. The scope of the normalisation is the group."""
    d = renormalised(df, keys, pred, true, 0.90)
    tail = lambda c: F.avg(F.when(F.col("_tail"), c))
    gap = F.abs(F.col("pl") - F.col("tl"))
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_spots"),
        pearson("pl", "tl").alias("log_sf_pearson"),
        pearson("ps", "ts").alias("sf_pearson"),
        F.avg(gap).alias("log_sf_mae"),
        F.sqrt(F.avg(gap * gap)).alias("log_sf_rmse"),
        (F.stddev_pop("ps") / (F.stddev_pop("ts") + EPS)).alias("sf_std_ratio"),
        (tail(F.col("ps")) / (tail(F.col("ts")) + EPS)).alias("sf_top_decile_mean_ratio"),
        tail(gap).alias("log_sf_top_decile_mae"),
    )


GROUPINGS = {
    "overall": ["split"],
    "slide": ["split", "sample_id", "organ", "cohort"],
    "organ": ["split", "organ"],
    "cohort": ["split", "cohort"],
}


def grouped_sf_metrics(spots: DataFrame, pred: str, label: str, levels: list[str] | None = None) -> DataFrame:
    """Metrics at several levels as one long table, with spot counts and the spread of both logs."""
    labels = ["split", "organ", "cohort", "sample_id"]
    sets = []
    for level in levels or list(GROUPINGS):
        cols = [F.col(c) if c in GROUPINGS[level] else F.lit(None).cast("string") for c in labels]
        sets.append(F.struct(F.lit(level).alias("level"), *[c.alias(n) for c, n in zip(cols, labels)]))
    d = spots.select(pred, "true_log_sf", F.explode(F.array(*sets)).alias("_s")).select(pred, "true_log_sf", "_s.*")
    group = F.concat_ws("\u0001", *[F.coalesce(c, F.lit("")) for c in ["level", *labels]])
    d = d.withColumn("_g", group)
    about = d.groupBy("_g", "level", *labels).agg(
        F.stddev_pop("true_log_sf").alias("true_log_sf_std"), F.stddev_pop(pred).alias("pred_log_sf_std")
    )
    return about.join(sf_metrics(d, ["_g"], pred), "_g").select(
        "level", F.lit(label).alias("prediction"), *labels, "n_spots", *METRICS, "true_log_sf_std", "pred_log_sf_std"
    )


def fit_affine(df: DataFrame, pred: str = "pred_log_sf", true: str = "true_log_sf") -> DataFrame:
    """One row (scale, bias) of the least-squares line from predicted to true logs; a flat prediction only shifts."""
    s = df.agg(
        F.count(F.when(F.col(pred).isNotNull() & F.col(true).isNotNull(), 1)).alias("n"),
        F.var_pop(pred).alias("v"), F.covar_pop(pred, true).alias("c"), F.avg(pred).alias("mp"), F.avg(true).alias("mt"),
    )
    require_rows(s.filter("n >= 3"), "calibration needs at least three spots")
    flat = F.col("v") < 1.0e-12
    scale = F.when(flat, F.lit(1.0)).otherwise(F.col("c") / F.when(~flat, F.col("v")))
    return s.withColumn("scale", scale).select("scale", (F.col("mt") - F.col("scale") * F.col("mp")).alias("bias"))


def apply_affine(spots: DataFrame, line: DataFrame, pred: str = "pred_log_sf") -> DataFrame:
    d = spots.crossJoin(F.broadcast(line)).withColumn("_raw", F.col("scale") * F.col(pred) + F.col("bias")).drop("scale", "bias")
    d = mean_one_log(d, "_raw", "pred_log_sf_calibrated").drop("_raw")
    return d.withColumn("residual_log_sf_calibrated", F.col("pred_log_sf_calibrated") - F.col("true_log_sf"))


def selection_score(
    df: DataFrame, keys: list[str], pred: str = "pred_log_sf", true: str = "true_log_sf", q: float = 0.90,
    under: float = 1.0, tail_mae: float = 0.25, std: float = 0.50, top_ratio: float = 0.75, corr: float = 0.20,
) -> DataFrame:
    d = renormalised(df, keys, pred, true, q)
    tail = lambda c: F.avg(F.when(F.col("_tail"), c))
    gap = F.greatest(F.col("tl") - F.col("pl"), F.lit(0.0))
    d = d.groupBy(*keys).agg(
        tail(gap * gap).alias("_u"), tail(F.abs(F.col("pl") - F.col("tl"))).alias("_m"),
        (F.stddev_pop("ps") / (F.stddev_pop("ts") + EPS)).alias("_s"),
        (tail(F.col("ps")) / (tail(F.col("ts")) + EPS)).alias("_t"),
        F.coalesce(pearson("pl", "tl"), F.lit(0.0)).alias("_r"),
    )
    score = (
        F.lit(under) * F.col("_u") + F.lit(tail_mae) * F.col("_m") + F.lit(std) * F.log(F.col("_s") + EPS) ** 2
        + F.lit(top_ratio) * F.log(F.col("_t") + EPS) ** 2 + F.lit(corr) * (1.0 - F.col("_r"))
    )
    return d.select(*keys, score.alias("selection_score"))


def distribution_losses(
    df: DataFrame, keys: list[str], order_key: list[str], pred: str, true: str, top_fraction: float = 0.25, top_weight: float = 3.0
) -> DataFrame:
    """1 − Pearson, sorted MSE, weighted sorted MSE of the upper tail, squared log ratio of the spreads, per group.

    Sorted losses pair the i-th smallest prediction with the i-th smallest target: both sides are ranked, then joined
    on the rank.
    """
    cols = list(dict.fromkeys([*keys, *order_key]))
    base = materialise(df.select(*cols, F.col(pred).alias("p"), F.col(true).alias("t")))
    tie = [F.col(c) for c in order_key]
    p = row_number(base, keys, [F.col("p"), *tie], "_r").select(*keys, "_r", "p")
    t = row_number(base, keys, [F.col("t"), *tie], "_r").select(*keys, "_r", "t")
    n = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.stddev_pop("p").alias("_sp"), F.stddev_pop("t").alias("_st"))
    j = _join(p.join(t, [*keys, "_r"]), n, keys)
    k = F.greatest(F.lit(2), F.least(F.col("_n"), F.bround(F.col("_n") * F.lit(top_fraction))))
    at = F.col("_r") - (F.col("_n") - k) - 1  # 0 … k−1 inside the tail
    weight = F.when(at >= 0, F.lit(1.0) + F.lit(max(top_weight, 1.0) - 1.0) * at / (k - 1))
    d2 = (F.col("p") - F.col("t")) ** 2
    losses = j.groupBy(*keys).agg(
        F.avg(d2).alias("sorted_mse"), (F.sum(weight * d2) / F.sum(weight)).alias("upper_tail_loss"),
        F.max("_sp").alias("_sp"), F.max("_st").alias("_st"),
    )
    r = sum_pairs(base, keys, {"": ("p", "t")}).select(*keys, (F.lit(1.0) - F.coalesce(pearson_of_sums(), F.lit(0.0))).alias("pearson_loss"))
    floor = lambda c: F.greatest(F.col(c), F.lit(1.0e-6))
    return _join(losses, r, keys).select(
        *keys, "pearson_loss", "sorted_mse", "upper_tail_loss", (F.log(floor("_sp") / floor("_st")) ** 2).alias("log_std_loss")
    )


def pairwise_rank_loss(df: DataFrame, keys: list[str], order_key: list[str], pred: str, true: str, margin: float = 0.05, seed: int = 2026) -> DataFrame:
    """Mean hinge over a sample of about n pairs with different targets.

    Instead of drawing pairs at random, the rows of a group are put into the order of a seeded hash and each is
    compared with its successor (the last with none): n − 1 pairs, each row in at most two of them, found by an equi
    join on the position rather than by listing pairs.
    """
    cols = list(dict.fromkeys([*keys, *order_key]))
    hashed = F.sha1(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in order_key]).cast("binary"))
    base = materialise(df.select(*cols, F.col(pred).alias("p"), F.col(true).alias("t"), hashed.alias("_h")))
    r = materialise(row_number(base, keys, [F.col("_h"), *[F.col(c) for c in order_key]], "_r").select(*keys, "_r", "p", "t"))
    nxt = r.select(*keys, (F.col("_r") - 1).alias("_r"), F.col("p").alias("_p2"), F.col("t").alias("_t2"))
    j = r.join(nxt, [*keys, "_r"]).filter(F.col("t") != F.col("_t2"))
    hinge = F.greatest(F.lit(0.0), F.lit(margin) - F.signum(F.col("t") - F.col("_t2")) * (F.col("p") - F.col("_p2")))
    return j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(hinge).alias("rank_loss"))


def tail_gated_losses(
    df: DataFrame, keys: list[str], pred: str, true: str, q: float = 0.80, scale: float = 0.35, delta: float = 0.5, tail_weight: float = 1.0,
    threshold: float | None = None,
) -> DataFrame:
    """Losses weighted towards the upper tail of the target, per group: base MSE and Huber with weights
    1 + w·gate, under-prediction, MSE and under-prediction on the factor scale, and tail classification."""
    d = materialise(df.select(*keys, F.col(pred).alias("p"), F.col(true).alias("t")))
    if threshold is None:
        d = _join(d, group_quantile(d, keys, "t", q, "_q"), keys)
    else:
        d = d.withColumn("_q", F.lit(float(threshold)))
    p, t = F.col("p"), F.col("t")
    gate = sigmoid((t - F.col("_q")) / F.lit(max(scale, 1.0e-6)))
    err = F.abs(p - t)
    huber = F.when(err <= delta, err * err * 0.5).otherwise(F.lit(delta) * (err - 0.5 * delta))
    clamp = lambda c: F.exp(F.greatest(F.least(c, F.lit(4.0)), F.lit(-8.0)))
    relu = lambda c: F.greatest(c, F.lit(0.0))
    z = (p - F.col("_q")) / F.lit(max(scale, 1.0e-6))
    soft = lambda c: F.log1p(F.exp(-F.abs(c))) + relu(-c)  # noqa: E731  −ln σ(c)
    d = d.select(
        *keys,
        gate.alias("g"), (F.lit(1.0) + F.lit(tail_weight) * gate).alias("w"), (err * err).alias("sq"), huber.alias("hub"),
        (relu(t - p) ** 2).alias("un"), ((clamp(p) - clamp(t)) ** 2).alias("ssq"), (relu(clamp(t) - clamp(p)) ** 2).alias("sun"),
        (t >= F.col("_q")).cast("double").alias("y"), soft(z).alias("pos"), soft(-z).alias("neg"),
    )
    wmean = lambda v, w: F.sum(F.col(v) * w) / F.greatest(F.sum(w), F.lit(EPS))
    a = d.groupBy(*keys).agg(
        wmean("sq", F.col("w")).alias("weighted_mse"), wmean("hub", F.col("w")).alias("weighted_huber"),
        wmean("un", F.col("g")).alias("tail_under"), wmean("ssq", F.lit(1.0) + F.col("g")).alias("sf_mse"),
        wmean("sun", F.col("g")).alias("sf_tail_under"),
        F.sum("y").alias("_y"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("y") * F.col("pos")).alias("_pos"), F.sum((1 - F.col("y")) * F.col("neg")).alias("_neg"),
    )
    weight = F.least(F.greatest((F.col("_n") - F.col("_y")) / F.greatest(F.col("_y"), F.lit(1.0)), F.lit(1.0)), F.lit(10.0))
    return a.withColumn("tail_bce", (weight * F.col("_pos") + F.col("_neg")) / F.col("_n")).drop("_y", "_n", "_pos", "_neg")


def weighted_total(losses: DataFrame, weights: dict[str, float], base: str = "weighted_huber", out: str = "total_loss") -> DataFrame:
    total: Column = F.col(base)
    for name, w in weights.items():
        total = total + F.lit(float(w)) * F.col(name)
    return losses.withColumn(out, total)


def negative_binomial_nll(df: DataFrame, keys: list[str], count: str, mu: str, theta: str, eps: float = 1.0e-8) -> DataFrame:
    y = F.col(count).cast("double")
    m, th = F.greatest(F.col(mu), F.lit(eps)), F.greatest(F.col(theta), F.lit(eps))
    both = F.log(th + m + eps)
    logp = (
        log_gamma(y + th) - log_gamma(th) - log_gamma(y + 1.0) + th * (F.log(th + eps) - both) + y * (F.log(m + eps) - both)
    )
    return df.select(*keys, logp.alias("_lp")).groupBy(*keys).agg(F.count("_lp").alias("n"), (-F.avg("_lp")).alias("nll"))
