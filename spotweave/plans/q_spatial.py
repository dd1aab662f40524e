"""Neighbours, spatial fidelity and context features."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.operators import spatial as op
from spotweave.operators.genesets import scores_of_kind
from spotweave.operators.neighbors import knn
from spotweave.plans.base_sql import define
from spotweave.plans.registry import query
from spotweave.session import materialise
from spotweave.sources.views import Views, place

G = "sample_id, signature"
define("usable_scores", "SELECT sample_id, signature, spot_id, rate_true AS t, rate_pred AS p, x, y FROM spot_scores JOIN spots USING (sample_id, spot_id) WHERE valid")


def knn_sql(source: str, keys: str, k: int) -> str:
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys.split(", "))
    ks = ", ".join(f"a.{c}" for c in keys.split(", "))
    return f"""SELECT * FROM (SELECT {ks}, a.spot_id, b.spot_id AS neighbor_id, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2,
row_number() OVER (PARTITION BY {ks}, a.spot_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.spot_id) AS rank
FROM {source} a JOIN {source} b ON {on} AND a.spot_id <> b.spot_id) WHERE rank <= {k}"""


def _edges(name: str, source: str, keys: str, k: int):
    define(name, knn_sql(source, keys, k))


_edges("spot_edges", "spots", "sample_id", 6)
_edges("score_edges", "usable_scores", G, 6)
_edges("feature_edges", "features", "sample_id", 24)
define(
    "score_z",
    f"""SELECT *, CASE WHEN stddev_pop(t) OVER w > 1e-12 THEN (t - avg(t) OVER w) / nullif(stddev_pop(t) OVER w, 0) ELSE 0.0 END AS zt,
  CASE WHEN stddev_pop(p) OVER w > 1e-12 THEN (p - avg(p) OVER w) / nullif(stddev_pop(p) OVER w, 0) ELSE 0.0 END AS zp, count(*) OVER w AS n
FROM usable_scores WINDOW w AS (PARTITION BY {G})""",
)
define(
    "score_lag",
    f"""SELECT z.sample_id, z.signature, z.spot_id, any_value(z.t) AS t, any_value(z.p) AS p, any_value(z.zt) AS zt, any_value(z.zp) AS zp, avg(o.zt) AS lt, avg(o.zp) AS lp, count(*) AS k
FROM score_z z JOIN score_edges e ON e.sample_id = z.sample_id AND e.signature = z.signature AND e.spot_id = z.spot_id
JOIN score_z o ON o.sample_id = e.sample_id AND o.signature = e.signature AND o.spot_id = e.neighbor_id GROUP BY ALL""",
)
define(
    "hot",
    f"""SELECT {G}, count(CASE WHEN rt <= h AND rp <= h THEN 1 END) / count(CASE WHEN rt <= h OR rp <= h THEN 1 END) AS j FROM
(SELECT *, greatest(1, round_even(n::double * 0.2::double, 0)) AS h, row_number() OVER (PARTITION BY {G} ORDER BY t DESC, spot_id) AS rt,
  row_number() OVER (PARTITION BY {G} ORDER BY p DESC, spot_id) AS rp FROM score_z) GROUP BY {G}""",
)
define(
    "spatial_rows",
    f"""SELECT {G}, count(*) AS n_spots, max(k) AS k_neighbors, corr(t, p) AS spot_pearson, sum(zt*lt)/sum(zt*zt) AS true_moran_i,
  sum(zp*lp)/sum(zp*zp) AS pred_moran_i, abs(sum(zp*lp)/sum(zp*zp) - sum(zt*lt)/sum(zt*zt)) AS moran_abs_delta, corr(lt, lp) AS spatial_lag_pearson,
  any_value(j) AS hotspot_jaccard FROM score_lag JOIN hot USING ({G}) GROUP BY {G} HAVING count(*) >= 30""",
)
REP = "spot_pearson true_moran_i pred_moran_i moran_abs_delta spatial_lag_pearson hotspot_jaccard"


def _scores(v: Views):
    """The stored scores with the places of their spots, which are on the grid by their ids; the rows of a sample stay together."""
    return scores_of_kind(v.spot_scores, "rate").select("*", *place())


def _report(v: Views):
    return materialise(op.spatial_report(_scores(v), together=True))


@query("J10_nearest_neighbors", "SELECT sample_id, spot_id, neighbor_id, d2, cast(rank AS int) AS rank FROM spot_edges", "d2")
def _(v: Views):
    return knn(v.spots, ["sample_id"], 6)


@query("J10_nearest_neighbors_grid", "SELECT sample_id, spot_id, neighbor_id, d2, cast(rank AS int) AS rank FROM spot_edges", "d2")
def _(v: Views):
    """The growing grid also on small samples."""
    return knn(v.spots, ["sample_id"], 6, small=0)


_OUT = "SELECT cast(p_size % 5 AS varchar) AS sample_id, p_partkey AS spot_id, CASE WHEN p_partkey % 500 = 0 THEN p_retailprice * 1e6 ELSE p_retailprice END AS x, cast(p_partkey % 89 AS double) AS y FROM part"
define("price_points", _OUT)


@query("J10_neighbors_with_outliers", f"SELECT sample_id, spot_id, neighbor_id, d2, cast(rank AS int) AS rank FROM ({knn_sql('price_points', 'sample_id', 6)})", "d2")
def _(v: Views):
    """Hundreds of points a group in a dense band, with points a million times as far out."""
    x = F.col("p_retailprice")
    p = v.table("part").select(
        (F.col("p_size") % 5).cast("string").alias("sample_id"), F.col("p_partkey").alias("spot_id"),
        F.when(F.col("p_partkey") % 500 == 0, x * 1e6).otherwise(x).alias("x"), (F.col("p_partkey") % 89).cast("double").alias("y"),
    )
    return knn(p, ["sample_id"], 6)


@query("L1_group_zscores", f"SELECT {G}, spot_id, zt AS z_true, zp AS z_pred FROM score_z", "z_true z_pred")
def _(v: Views):
    return op.group_zscores(op.usable(_scores(v)), op.GROUP, ["true", "pred"], together=True).select(*op.GROUP, "spot_id", "z_true", "z_pred")


def _lagged(v: Views):
    ok = op.usable(_scores(v))
    z = op.group_zscores(ok, op.GROUP, ["true", "pred"], together=True)
    return op.shared_lag(z, ok, 6, ["z_true", "z_pred"], together=True)


@query("L2_spatial_lag", f"SELECT {G}, spot_id, lt AS lag_z_true, lp AS lag_z_pred FROM score_lag", "lag_z_true lag_z_pred")
def _(v: Views):
    return _lagged(v).select(*op.GROUP, "spot_id", "lag_z_true", "lag_z_pred")


@query(
    "L3_moran_i",
    f"SELECT {G}, CASE WHEN count(*) >= 3 THEN sum(zt*lt)/nullif(sum(zt*zt), 0) END AS moran_z_true, CASE WHEN count(*) >= 3 THEN sum(zp*lp)/nullif(sum(zp*zp), 0) END AS moran_z_pred FROM score_lag GROUP BY {G}",
    "moran_z_true moran_z_pred",
)
def _(v: Views):
    return op.moran(_lagged(v), op.GROUP, ["z_true", "z_pred"])


@query("L4_hotspot_jaccard", f"SELECT {G}, j AS hotspot_jaccard FROM hot", "hotspot_jaccard")
def _(v: Views):
    return op.hotspot_jaccard(op.usable(_scores(v)), op.GROUP, 0.2, together=True)


@query("L5_spatial_report", "SELECT * FROM spatial_rows", REP)
def _(v: Views):
    return op.spatial_report(_scores(v), together=True)


_SUM = """SELECT signature, count(*) AS n_pairs, count(DISTINCT sample_id) AS n_slides, cast(sum(n_spots) AS bigint) AS n_spots, avg(spot_pearson) AS mean_spot_pearson,
  avg(true_moran_i) AS mean_true_moran_i, avg(pred_moran_i) AS mean_pred_moran_i, avg(moran_abs_delta) AS mean_abs_moran_delta,
  avg(spatial_lag_pearson) AS mean_spatial_lag_pearson, median(spatial_lag_pearson) AS median_spatial_lag_pearson, avg(hotspot_jaccard) AS mean_hotspot_jaccard
FROM spatial_rows GROUP BY signature"""
SUM_D = "mean_spot_pearson mean_true_moran_i mean_pred_moran_i mean_abs_moran_delta mean_spatial_lag_pearson median_spatial_lag_pearson mean_hotspot_jaccard"


@query("L6_signature_summary", _SUM, SUM_D)
def _(v: Views):
    return op.signature_summary(_report(v))


@query(
    "L6_overall_summary",
    f"""SELECT count(DISTINCT signature) AS n_signatures, count(DISTINCT sample_id) AS n_slides, count(*) AS n_pairs, cast(sum(n_spots) AS bigint) AS n_spots,
  avg(moran_abs_delta) AS mean_abs_moran_delta, avg(spatial_lag_pearson) AS mean_spatial_lag_pearson, median(spatial_lag_pearson) AS median_spatial_lag_pearson,
  avg(hotspot_jaccard) AS mean_hotspot_jaccard, (SELECT arg_max(signature, mean_spatial_lag_pearson) FROM ({_SUM})) AS best_signature,
  (SELECT max(mean_spatial_lag_pearson) FROM ({_SUM})) AS best_signature_spatial_lag_pearson FROM spatial_rows""",
    "mean_abs_moran_delta mean_spatial_lag_pearson median_spatial_lag_pearson mean_hotspot_jaccard best_signature_spatial_lag_pearson",
)
def _(v: Views):
    return op.overall_summary(_report(v))


@query(
    "L7_neighbor_means",
    """SELECT e.sample_id, e.spot_id, k, cast(i AS int) AS dim, avg(f.features[i + 1]::double) AS value
FROM feature_edges e JOIN features f ON f.sample_id = e.sample_id AND f.spot_id = e.neighbor_id, range(64) t(i), (VALUES (8), (24)) s(k)
WHERE e.rank <= k GROUP BY ALL""",
    "value",
)
def _(v: Views):
    edges = materialise(knn(v.features, ["sample_id"], 24))
    parts = [
        op.neighbor_means(v.features, edges.filter(F.col("rank") <= k)).select(
            "sample_id", "spot_id", F.lit(k).alias("k"), F.posexplode("neighbor_mean").alias("dim", "value")
        )
        for k in (8, 24)
    ]
    return parts[0].unionByName(parts[1])


define(
    "context_rows",
    """WITH d AS (SELECT sample_id, spot_id, sqrt(d2) AS d FROM feature_edges WHERE rank <= 8),
m AS (SELECT sample_id, greatest(median(d), 1.0) AS s FROM d WHERE d > 0 GROUP BY sample_id),
a AS (SELECT sample_id, spot_id, avg(d) / any_value(s) AS dm, stddev_pop(d) / any_value(s) AS ds, max(d) / any_value(s) AS dx FROM d JOIN m USING (sample_id) GROUP BY ALL),
n AS (SELECT sample_id, spot_id, (x - min(x) OVER w) / greatest(max(x) OVER w - min(x) OVER w, 1.0) AS x_norm,
  (y - min(y) OVER w) / greatest(max(y) OVER w - min(y) OVER w, 1.0) AS y_norm FROM features WINDOW w AS (PARTITION BY sample_id))
SELECT sample_id, spot_id, x_norm, y_norm, x_norm - 0.5 AS x_centered, y_norm - 0.5 AS y_centered, sqrt((x_norm-0.5)^2 + (y_norm-0.5)^2) AS radius_norm,
  ln(1+dm) AS log1p_neighbor_dist_mean, ln(1+ds) AS log1p_neighbor_dist_std, ln(1+dx) AS log1p_neighbor_dist_max, ln(1 + 1/(dm+1e-6)) AS log1p_local_density
FROM n JOIN a USING (sample_id, spot_id)""",
)


@query("L8_coordinate_context", "SELECT * FROM context_rows", " ".join(op.CONTEXT))
def _(v: Views):
    return op.coordinate_context(v.features, materialise(knn(v.features, ["sample_id"], 8)))


@query(
    "L9_context_report",
    """SELECT s.sample_id, CASE WHEN n IS NULL THEN 'missing' ELSE 'written' END AS status, coalesce(n, 0) AS n_spots, cast(CASE WHEN n IS NULL THEN 0 ELSE 64 * 3 + 9 END AS bigint) AS n_features
FROM samples s LEFT JOIN (SELECT sample_id, count(*) AS n FROM features GROUP BY sample_id) USING (sample_id)""",
)
def _(v: Views):
    return op.context_report(op.context_features(v.features), v.samples)


@query(
    "L10_spot_layers",
    """SELECT sample_id, spot_id, 'log1p_total_counts' AS layer, x, y, ln(1 + total) AS value FROM sf_t
UNION ALL SELECT sample_id, spot_id, 'true_log_sf', x, y, log_sf FROM sf_t
UNION ALL SELECT s.sample_id, s.spot_id, g.gene || '_log1p_count', x, y, ln(1 + coalesce(c.count, 0)) FROM spots s JOIN sample_genes g USING (sample_id)
LEFT JOIN counts c ON c.sample_id = s.sample_id AND c.spot_id = s.spot_id AND c.gene = g.gene WHERE g.gene IN ('Brand#3', 'Brand#17')""",
    "x y value",
)
def _(v: Views):
    genes = v.spark.createDataFrame([("Brand#3",), ("Brand#17",), ("Brand#99",)], "gene string")
    return op.spot_layers(v.sf, v.counts, genes, v.sample_genes)


@query(
    "L10_missing_genes",
    "SELECT w.gene FROM (VALUES ('Brand#3'), ('Brand#17'), ('Brand#99')) w(gene) WHERE w.gene NOT IN (SELECT gene FROM sample_genes)",
)
def _(v: Views):
    genes = v.spark.createDataFrame([("Brand#3",), ("Brand#17",), ("Brand#99",)], "gene string")
    return op.missing_genes(genes, v.sample_genes)


@query(
    "L10_gene_overlay",
    """SELECT sample_id, spot_id, gene, true_count, pred_rate * pred_sf AS pred_count, pred_rate AS count_no_sf, pred_rate * sf AS count_oracle_sf, sf AS true_sf, pred_sf
FROM ablation_cells WHERE gene IN ('Brand#3', 'Brand#17')""",
    "pred_count count_no_sf count_oracle_sf true_sf pred_sf",
)
def _(v: Views):
    c = v.ablation_cells.filter(F.col("gene").isin("Brand#3", "Brand#17"))
    r = F.col("pred_rate")
    return c.select(
        "sample_id", "spot_id", "gene", "true_count", (r * F.col("pred_sf")).alias("pred_count"), r.alias("count_no_sf"),
        (r * F.col("sf")).alias("count_oracle_sf"), F.col("sf").alias("true_sf"), "pred_sf",
    )
