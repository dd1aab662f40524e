"""Size-factor metrics, calibration and losses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from spotweave.operators import sfmetrics as op
from spotweave.operators.sizefactor import normalise_predicted
from spotweave.plans.base_sql import PEARSON, define, sums
from spotweave.plans.registry import query
from spotweave.sources.views import Views

SF = " ".join(op.METRICS)


def norm_sql(keys: str, source: str, pred: str = "pred_log_sf", q: float = 0.9) -> str:
    """Renormalised values and tail flags per group, as a chain of subqueries."""
    return f"""(SELECT *, tl >= quantile_cont(tl, {q}) OVER (PARTITION BY {keys}) AS tail FROM
(SELECT *, ln(ps + 1e-8) AS pl, ln(ts + 1e-8) AS tl FROM
(SELECT *, exp({pred}) / (avg(exp({pred})) OVER (PARTITION BY {keys}) + 1e-8) AS ps,
  exp(true_log_sf) / (avg(exp(true_log_sf)) OVER (PARTITION BY {keys}) + 1e-8) AS ts FROM {source})))"""


def sf_sql(keys: str, source: str, pred: str = "pred_log_sf", sums: Callable = sums) -> str:
    n = norm_sql(keys, source, pred)
    return f"""SELECT {keys}, n_spots, r1.r AS log_sf_pearson, r2.r AS sf_pearson, log_sf_mae, log_sf_rmse, sf_std_ratio,
  sf_top_decile_mean_ratio, log_sf_top_decile_mae FROM
(SELECT {keys}, count(*) AS n_spots, avg(abs(pl-tl)) AS log_sf_mae, sqrt(avg((pl-tl)*(pl-tl))) AS log_sf_rmse,
  stddev_pop(ps) / (stddev_pop(ts) + 1e-8) AS sf_std_ratio,
  avg(CASE WHEN tail THEN ps END) / (avg(CASE WHEN tail THEN ts END) + 1e-8) AS sf_top_decile_mean_ratio,
  avg(CASE WHEN tail THEN abs(pl-tl) END) AS log_sf_top_decile_mae FROM {n} GROUP BY {keys})
JOIN (SELECT {keys}, {PEARSON} AS r FROM (SELECT {keys}, {sums('pl', 'tl')} FROM {n} GROUP BY {keys})) r1 USING ({keys})
JOIN (SELECT {keys}, {PEARSON} AS r FROM (SELECT {keys}, {sums('ps', 'ts')} FROM {n} GROUP BY {keys})) r2 USING ({keys})"""


def levels_sql(source: str, label: str, levels: tuple[str, ...], pred: str = "pred_log_sf") -> str:
    out = []
    for level in levels:
        keys = op.GROUPINGS[level]
        cols = ", ".join(k if k in keys else f"NULL AS {k}" for k in ("split", "organ", "cohort", "sample_id"))
        k = ", ".join(keys)
        out.append(
            f"SELECT '{level}' AS level, '{label}' AS prediction, {cols}, n_spots, {', '.join(op.METRICS)}, true_log_sf_std, pred_log_sf_std "
            f"FROM ({sf_sql(k, source, pred)}) JOIN (SELECT {k}, stddev_pop(true_log_sf) AS true_log_sf_std, stddev_pop({pred}) AS pred_log_sf_std "
            f"FROM {source} GROUP BY {k}) USING ({k})"
        )
    return "\nUNION ALL ".join(out)


define(
    "calibrated",
    """SELECT *, ln(e / (avg(e) OVER (PARTITION BY sample_id) + 1e-8) + 1e-8) AS pred_log_sf_calibrated
FROM (SELECT s.*, exp(pred_log_sf * scale + mt - scale * mp) AS e FROM sf_spots s,
  (SELECT covar_pop(pred_log_sf, true_log_sf) / var_pop(pred_log_sf) AS scale, avg(pred_log_sf) AS mp, avg(true_log_sf) AS mt
   FROM sf_spots WHERE split = 'val'))""",
)


@query("E7_sf_metrics", sf_sql("split", "sf_spots"), SF)
def _(v: Views):
    return op.sf_metrics(v.sf_spots, ["split"])


@query("E8_grouped_sf_metrics", levels_sql("sf_spots", "uncalibrated", ("overall", "slide", "organ", "cohort")), SF + " true_log_sf_std pred_log_sf_std")
def _(v: Views):
    return op.grouped_sf_metrics(v.sf_spots, "pred_log_sf", "uncalibrated")


def _calibrated(v: Views):
    line = op.fit_affine(v.sf_spots.filter("split = 'val'"))
    return op.apply_affine(v.sf_spots, line)


@query(
    "E9_metric_summary_long",
    levels_sql("sf_spots", "uncalibrated", ("overall", "organ")) + "\nUNION ALL "
    + levels_sql("calibrated", "val_affine_calibrated", ("overall", "organ"), "pred_log_sf_calibrated"),
    SF + " true_log_sf_std pred_log_sf_std",
)
def _(v: Views):
    a = op.grouped_sf_metrics(v.sf_spots, "pred_log_sf", "uncalibrated", ["overall", "organ"])
    b = op.grouped_sf_metrics(_calibrated(v), "pred_log_sf_calibrated", "val_affine_calibrated", ["overall", "organ"])
    return a.unionByName(b)


@query("E10_organ_sf_metrics", sf_sql("organ", "sf_spots").replace("SELECT organ, n_spots", "SELECT organ, n_spots", 1) + " WHERE n_spots >= 3", SF)
def _(v: Views):
    return op.sf_metrics(v.sf_spots, ["organ"]).filter("n_spots >= 3")


@query(
    "E25_affine_calibration",
    """SELECT sample_id, spot_id, pred_log_sf_calibrated, pred_log_sf_calibrated - true_log_sf AS residual_log_sf_calibrated FROM calibrated""",
    "pred_log_sf_calibrated residual_log_sf_calibrated",
)
def _(v: Views):
    return _calibrated(v).select("sample_id", "spot_id", "pred_log_sf_calibrated", "residual_log_sf_calibrated")


@query(
    "E26_selection_score",
    f"""SELECT split, u + 0.25 * m + 0.5 * ln(s + 1e-8)^2 + 0.75 * ln(t + 1e-8)^2 + 0.2 * (1 - coalesce(r, 0)) AS selection_score
FROM (SELECT split, avg(CASE WHEN tail THEN greatest(tl-pl, 0)^2 END) AS u, avg(CASE WHEN tail THEN abs(pl-tl) END) AS m,
  stddev_pop(ps) / (stddev_pop(ts) + 1e-8) AS s, avg(CASE WHEN tail THEN ps END) / (avg(CASE WHEN tail THEN ts END) + 1e-8) AS t
  FROM {norm_sql('split', 'sf_spots')} GROUP BY split)
JOIN (SELECT split, {PEARSON} AS r FROM (SELECT split, {sums('pl', 'tl')} FROM {norm_sql('split', 'sf_spots')} GROUP BY split)) USING (split)""",
    "selection_score",
)
def _(v: Views):
    return op.selection_score(v.sf_spots, ["split"])


@query(
    "E27_distribution_losses",
    f"""WITH n AS (SELECT split, count(*) AS n, stddev_pop(pred_log_sf) AS sp, stddev_pop(true_log_sf) AS st, corr(pred_log_sf, true_log_sf) AS r
  FROM sf_spots GROUP BY split),
p AS (SELECT split, pred_log_sf AS p, row_number() OVER (PARTITION BY split ORDER BY pred_log_sf) AS r FROM sf_spots),
t AS (SELECT split, true_log_sf AS t, row_number() OVER (PARTITION BY split ORDER BY true_log_sf) AS r FROM sf_spots),
j AS (SELECT split, (p - t)^2 AS d2, r - (n - k) - 1 AS pos_, k FROM p JOIN t USING (split, r)
  JOIN (SELECT split, n, greatest(2, least(n, round_even(n * 0.25::double, 0))) AS k FROM n) USING (split))
SELECT split, 1 - any_value(n.r) AS pearson_loss, avg(d2) AS sorted_mse,
  sum(CASE WHEN pos_ >= 0 THEN (1 + 2.0 * pos_ / (k - 1)) * d2 END) / sum(CASE WHEN pos_ >= 0 THEN 1 + 2.0 * pos_ / (k - 1) END) AS upper_tail_loss,
  any_value(ln(greatest(sp, 1e-6) / greatest(st, 1e-6))^2) AS log_std_loss
FROM j JOIN n USING (split) GROUP BY split""",
    "pearson_loss sorted_mse upper_tail_loss log_std_loss",
)
def _(v: Views):
    return op.distribution_losses(v.sf_spots, ["split"], ["sample_id", "spot_id"], "pred_log_sf", "true_log_sf")


@query(
    "E28_pairwise_rank_loss",
    """WITH r AS (SELECT split, pred_log_sf AS p, true_log_sf AS t,
  row_number() OVER (PARTITION BY split ORDER BY sha1('2026|' || sample_id || '|' || spot_id), sample_id, spot_id) AS r FROM sf_spots)
SELECT a.split, count(*) AS n_pairs, avg(greatest(0, 0.05 - sign(a.t - b.t) * (a.p - b.p))) AS rank_loss
FROM r a JOIN r b ON a.split = b.split AND b.r = a.r + 1 WHERE a.t <> b.t GROUP BY a.split""",
    "rank_loss",
)
def _(v: Views):
    return op.pairwise_rank_loss(v.sf_spots, ["split"], ["sample_id", "spot_id"], "pred_log_sf", "true_log_sf")


_TAIL = """WITH b AS (SELECT split, pred_log_sf AS p, true_log_sf AS t, quantile_cont(true_log_sf, 0.8) OVER (PARTITION BY split) AS q FROM sf_spots),
c AS (SELECT *, 1 / (1 + exp(-(t - q) / 0.35)) AS g, abs(p - t) AS e, exp(greatest(least(p, 4), -8)) AS sp, exp(greatest(least(t, 4), -8)) AS st,
  (p - q) / 0.35 AS z, CASE WHEN t >= q THEN 1.0 ELSE 0.0 END AS y FROM b),
a AS (SELECT split, sum((1 + g) * e * e) / sum(1 + g) AS weighted_mse,
  sum((1 + g) * CASE WHEN e <= 0.5 THEN e * e / 2 ELSE 0.5 * (e - 0.25) END) / sum(1 + g) AS weighted_huber,
  sum(g * greatest(t - p, 0)^2) / sum(g) AS tail_under, sum((1 + g) * (sp - st)^2) / sum(1 + g) AS sf_mse,
  sum(g * greatest(st - sp, 0)^2) / sum(g) AS sf_tail_under,
  least(greatest((count(*) - sum(y)) / greatest(sum(y), 1), 1), 10) AS pw, sum(y * -ln(1 / (1 + exp(-z)))) AS pos,
  sum((1 - y) * -ln(1 - 1 / (1 + exp(-z)))) AS neg, count(*) AS n FROM c GROUP BY split)
SELECT split, weighted_mse, weighted_huber, tail_under, sf_mse, sf_tail_under, (pw * pos + neg) / n AS tail_bce,
  weighted_huber + 0.5 * tail_under + 0.2 * sf_mse + 0.1 * (pw * pos + neg) / n AS total_loss FROM a"""


@query("E29_tail_gated_losses", _TAIL, "weighted_mse weighted_huber tail_under sf_mse sf_tail_under tail_bce total_loss")
def _(v: Views):
    d = op.tail_gated_losses(v.sf_spots, ["split"], "pred_log_sf", "true_log_sf")
    return op.weighted_total(d, {"tail_under": 0.5, "sf_mse": 0.2, "tail_bce": 0.1})


@query(
    "E30_negative_binomial_nll",
    """WITH d AS (SELECT gene, true_count AS y, greatest(value, 1e-8) AS m, 1 + sf AS th FROM eval_cells)
SELECT gene, count(*) AS n, -avg(lgamma(y + th) - lgamma(th) - lgamma(y + 1) + th * (ln(th + 1e-8) - ln(th + m + 1e-8))
  + y * (ln(m + 1e-8) - ln(th + m + 1e-8))) AS nll FROM d GROUP BY gene""",
    "nll",
)
def _(v: Views):
    d = v.eval_cells.withColumn("theta", F.col("sf") + 1.0)
    return op.negative_binomial_nll(d, ["gene"], "true_count", "value", "theta")


@query(
    "S14_sf_prediction_table",
    """SELECT sample_id, spot_id, x, y, raw AS pred_log_sf, exp(raw) / (avg(exp(raw)) OVER (PARTITION BY sample_id) + 1e-8) AS pred_sf, true_sf
FROM (SELECT s.sample_id, s.spot_id, s.x, s.y, ln(1 + coalesce(price, 0) / 1000) AS raw, CASE WHEN t.valid THEN t.sf END AS true_sf
  FROM spots s LEFT JOIN (SELECT sample_id, spot_id, sum(price) AS price FROM measured_cells GROUP BY ALL) m USING (sample_id, spot_id)
  LEFT JOIN sf_t t USING (sample_id, spot_id))""",
    "x y pred_log_sf pred_sf true_sf",
)
def _(v: Views):
    """All spots of a slide have a prediction, and all of them make its mean; only valid ones have a measured factor."""
    priced = v.measured_cells.groupBy("sample_id", "spot_id").agg(F.sum("price").alias("price"))
    d = v.spots.join(priced, ["sample_id", "spot_id"], "left").withColumn("pred_log_sf", F.log1p(F.coalesce("price", F.lit(0.0)) / 1000))
    d = normalise_predicted(d, "pred_log_sf")
    true = v.sf.select("sample_id", "spot_id", F.when(F.col("valid"), F.col("sf")).alias("true_sf"))
    return d.join(true, ["sample_id", "spot_id"], "left").select("sample_id", "spot_id", "x", "y", "pred_log_sf", "pred_sf", "true_sf")


@query("E12_sf_by_sample", sf_sql("sample_id", "sf_spots"), SF)
def _(v: Views):
    return op.sf_metrics(v.sf_spots, ["sample_id"])


@query(
    "P21_residuals",
    """SELECT sample_id, spot_id, pred_sf - sf AS residual_sf, pred_log_sf - true_log_sf AS residual_log_sf, abs(pred_log_sf - true_log_sf) AS abs_error
FROM sf_spots""",
    "residual_sf residual_log_sf abs_error",
)
def _(v: Views):
    r = F.col("pred_log_sf") - F.col("true_log_sf")
    one = v.sf_spots.withColumn("pred_sf", F.exp("pred_log_sf") - F.lit(1.0e-8))
    return one.select("sample_id", "spot_id", (F.col("pred_sf") - F.col("sf")).alias("residual_sf"), r.alias("residual_log_sf"), F.abs(r).alias("abs_error"))
