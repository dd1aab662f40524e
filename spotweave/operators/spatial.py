"""Spatial structure of scores, and context features from neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spotweave.functions.moments import pearson
from spotweave.functions.scalars import finite
from spotweave.operators.neighbors import knn, neighbor_lists
from spotweave.operators.ordering import group_quantile, row_number
from spotweave.operators.sizefactor import SAMPLE, SPOT, with_group_stats, with_named_stats
from spotweave.session import materialise

GROUP = ["sample_id", "signature"]
EDGES_PER_TASK = 100_000


def group_zscores(df: DataFrame, keys: list[str], columns: list[str], together: bool = False) -> DataFrame:
    """`z_<column>` within the group; a flat column becomes zeros. `together`: the rows of a group lie in one partition already."""
    d = with_named_stats(df, keys, {f"_{n}_{c}": f(c) for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))}, together)
    for c in columns:
        s = F.col(f"_s_{c}")
        d = d.withColumn(f"z_{c}", F.when(s > 1.0e-12, (F.col(c) - F.col(f"_m_{c}")) / s).otherwise(F.lit(0.0)))
    return d.drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def usable(scores: DataFrame) -> DataFrame:
    """Rows with valid, finite scores on both sides and coordinates: (keys, spot_id, true, pred, x, y)."""
    ok = F.coalesce(F.col("valid"), F.lit(False)) & finite(F.col("true")) & finite(F.col("pred")) & finite(F.col("x")) & finite(F.col("y"))
    return scores.filter(ok).select(*GROUP, "spot_id", "true", "pred", "x", "y")


def spatial_lag(z: DataFrame, edges: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """`lag_<column>`: mean of the column over the neighbours of a point."""
    there = z.select(*keys, F.col("spot_id").alias("neighbor_id"), *columns)
    lag = edges.join(there, [*keys, "neighbor_id"]).groupBy(*keys, "spot_id").agg(
        *[F.avg(c).alias(f"lag_{c}") for c in columns], F.count(F.lit(1)).alias("n_neighbors")
    )
    return z.join(lag, [*keys, "spot_id"])


def _moran_columns(columns: list[str]) -> list[Column]:
    cols = []
    for c in columns:
        den = F.sum(F.col(c) * F.col(c))
        cols.append(F.when((F.count(F.lit(1)) >= 3) & (den > 0), F.sum(F.col(c) * F.col(f"lag_{c}")) / den).alias(f"moran_{c}"))
    return cols


def moran(lagged: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Moran's I with row-standardised weights: Σ z·lag / Σ z²."""
    return lagged.groupBy(*keys).agg(*_moran_columns(columns))


def hotspot_jaccard(df: DataFrame, keys: list[str], fraction: float, together: bool = False) -> DataFrame:
    """Overlap of the top share of points by measured and by predicted value; lower ids win ties."""
    base = df.select(*keys, "spot_id", "true", "pred")
    base = base if together else materialise(base)
    r = row_number(base, keys, [-F.col("true"), F.col("spot_id")], "_rt")
    r = row_number(r, keys, [-F.col("pred"), F.col("spot_id")], "_rp")
    r = with_named_stats(r, keys, {"_n": F.count(F.lit(1))}, together)
    hot = F.greatest(F.lit(1), F.bround(F.col("_n").cast("double") * F.lit(float(fraction))))
    a, b = F.col("_rt") <= hot, F.col("_rp") <= hot
    return r.groupBy(*keys).agg(
        F.when(F.max("_n") >= 3, F.count(F.when(a & b, 1)) / F.count(F.when(a | b, 1))).alias("hotspot_jaccard")
    )


def _shared_sets(points: DataFrame) -> DataFrame:
    """(sample, signature, _set): signatures of a sample that are usable on the same spots share a set.

    Two sets of spots are taken for equal when their sizes and two independent 64-bit sums of hashes agree.
    """
    return materialise(points.groupBy(*GROUP).agg(F.concat_ws("/", *_set_parts()).alias("_set")))


def _set_parts() -> list[Column]:
    spot = F.col("spot_id")
    return [F.count(F.lit(1)), F.bit_xor(F.xxhash64(spot)), F.bit_xor(F.xxhash64(spot, F.lit("second")))]


def shared_edges(points: DataFrame, k: int) -> DataFrame:
    """Neighbours per (sample, signature). Signatures of a sample that are usable on the same spots share one search."""
    sets = _shared_sets(points)
    first = sets.groupBy(SAMPLE, "_set").agg(F.min("signature").alias("signature"))
    chosen = points.join(first, GROUP).select(SAMPLE, "_set", "spot_id", "x", "y")
    edges = knn(chosen, [SAMPLE, "_set"], k)
    return edges.join(sets, [SAMPLE, "_set"]).drop("_set")


def shared_lag(z: DataFrame, points: DataFrame, k: int, columns: list[str], small: int | None = None, together: bool = False) -> DataFrame:
    """As `spatial_lag` over `shared_edges`, per (sample, signature), without a row per edge: the signatures of a shared set are folded
    into one row per spot, the neighbours' values come with the search, and a lag is added up inside the row.

    `together` says that the rows of a sample lie in one partition and that `z` has the rows of `points`; nothing is moved then.
    """
    kept = [c for c in z.columns if c not in (*GROUP, "spot_id", "x", "y")]
    entry = F.struct("signature", *kept)
    marked = z.withColumn("_set", F.concat_ws("/", *[c.over(W.partitionBy(*GROUP)) for c in _set_parts()])) if together else z.join(_shared_sets(points), GROUP)
    folded = marked.groupBy(SAMPLE, "_set", "spot_id").agg(
        F.first("x").alias("x"), F.first("y").alias("y"), F.array_sort(F.collect_list(entry)).alias("_own")
    )
    folded = folded.withColumn("_z", F.transform("_own", lambda e: F.struct(*[e[c].alias(c) for c in columns])))
    near = neighbor_lists(folded, [SAMPLE, "_set"], k, small=small, carry="_z", keep=("_own",), together=together).filter(F.size("near") > 0)

    def lagged(e: Column, i: Column) -> Column:
        mean = lambda c: F.aggregate("near", F.lit(0.0), lambda a, n: a + n["_v"][i][c]) / F.size("near")
        return F.struct(e.alias("own"), *[mean(c).alias(f"lag_{c}") for c in columns])

    rows = near.select(SAMPLE, "spot_id", F.size("near").cast("long").alias("n_neighbors"), F.explode(F.transform("_own", lagged)).alias("_l"))
    return rows.select(SAMPLE, "spot_id", "_l.own.*", *[f"_l.lag_{c}" for c in columns], "n_neighbors")


def spatial_report(scores: DataFrame, k: int = 6, fraction: float = 0.2, min_spots: int = 30, together: bool = False) -> DataFrame:
    """Per (slide, signature) with enough usable spots: correlations, Moran's I, lag correlation, hotspot overlap.

    Neighbours are taken among the usable spots of that signature. `together` says that `scores` are read from a table with the rows
    of a sample in one partition: then only the rows of the report are moved.
    """
    ok = with_named_stats(usable(scores), GROUP, {"_n": F.count(F.lit(1))}, together)
    ok = ok.filter(F.col("_n") >= max(min_spots, 3)).drop("_n")
    ok = ok if together else materialise(ok)
    z = group_zscores(ok, GROUP, ["true", "pred"], together)
    lagged = shared_lag(z, ok, k, ["z_true", "z_pred"], together=together)
    sums = lagged.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("n_spots"), F.max("n_neighbors").alias("k_neighbors"), pearson("true", "pred").alias("spot_pearson"),
        pearson("lag_z_true", "lag_z_pred").alias("spatial_lag_pearson"), *_moran_columns(["z_true", "z_pred"]),
    )
    d = sums.join(hotspot_jaccard(ok, GROUP, fraction, together), GROUP)
    return d.select(
        *GROUP, "n_spots", "k_neighbors", "spot_pearson", F.col("moran_z_true").alias("true_moran_i"), F.col("moran_z_pred").alias("pred_moran_i"),
        F.abs(F.col("moran_z_pred") - F.col("moran_z_true")).alias("moran_abs_delta"), "spatial_lag_pearson", "hotspot_jaccard",
    )


def signature_summary(report: DataFrame) -> DataFrame:
    """Over slides, per signature."""
    median = group_quantile(report, ["signature"], "spatial_lag_pearson", 0.5, "median_spatial_lag_pearson")
    means = report.groupBy("signature").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct(SAMPLE).alias("n_slides"), F.sum("n_spots").alias("n_spots"),
        F.avg("spot_pearson").alias("mean_spot_pearson"), F.avg("true_moran_i").alias("mean_true_moran_i"),
        F.avg("pred_moran_i").alias("mean_pred_moran_i"), F.avg("moran_abs_delta").alias("mean_abs_moran_delta"),
        F.avg("spatial_lag_pearson").alias("mean_spatial_lag_pearson"), F.avg("hotspot_jaccard").alias("mean_hotspot_jaccard"),
    )
    return means.join(median, "signature", "left")


def overall_summary(report: DataFrame) -> DataFrame:
    by = signature_summary(report)
    best = by.agg(
        F.max_by("signature", F.struct(F.coalesce("mean_spatial_lag_pearson", F.lit(-2.0)), "signature")).alias("best_signature"),
        F.max("mean_spatial_lag_pearson").alias("best_signature_spatial_lag_pearson"),
    )
    whole = report.agg(
        F.countDistinct("signature").alias("n_signatures"), F.countDistinct(SAMPLE).alias("n_slides"), F.count(F.lit(1)).alias("n_pairs"),
        F.sum("n_spots").alias("n_spots"), F.avg("moran_abs_delta").alias("mean_abs_moran_delta"),
        F.avg("spatial_lag_pearson").alias("mean_spatial_lag_pearson"), F.avg("hotspot_jaccard").alias("mean_hotspot_jaccard"),
    )
    median = group_quantile(report, [], "spatial_lag_pearson", 0.5, "median_spatial_lag_pearson")
    return whole.crossJoin(F.broadcast(median)).crossJoin(F.broadcast(best))


def neighbor_means(spots: DataFrame, edges: DataFrame, features: str = "features", out: str = "neighbor_mean") -> DataFrame:
    """Elementwise mean of the neighbours' vectors; a spot without neighbours keeps its own.

    The k vectors of a spot are gathered (k is a small parameter) and added inside one expression. Edges are few bytes and get a vector
    each, so the number of tasks follows their count and not their size.
    """
    n = max(int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // EDGES_PER_TASK))
    there = spots.select(SAMPLE, F.col("spot_id").alias("neighbor_id"), F.col(features).alias("_v")).repartition(n, SAMPLE, "neighbor_id")
    met = edges.repartition(n, SAMPLE, "neighbor_id").join(there.hint("merge"), [SAMPLE, "neighbor_id"])
    near = met.repartition(n, *SPOT).groupBy(*SPOT).agg(F.collect_list(F.struct("rank", "_v")).alias("_near"))
    ordered = F.transform(F.array_sort("_near"), lambda s: s["_v"])
    total = F.aggregate(
        F.slice(ordered, F.lit(2), F.size(ordered) - 1), F.element_at(ordered, 1), lambda a, v: F.zip_with(a, v, lambda p, q: p + q)
    )
    mean = near.select(*SPOT, F.transform(total, lambda x: x / F.size("_near")).alias(out))
    return spots.join(mean, SPOT, "left").withColumn(out, F.coalesce(out, features))


CONTEXT = [
    "x_norm", "y_norm", "x_centered", "y_centered", "radius_norm", "log1p_neighbor_dist_mean", "log1p_neighbor_dist_std",
    "log1p_neighbor_dist_max", "log1p_local_density",
]


def coordinate_context(spots: DataFrame, edges: DataFrame) -> DataFrame:
    """Position in the slide and distances to neighbours, in units of the slide's median neighbour distance."""
    d = edges.select(*SPOT, F.sqrt("d2").alias("_d"))
    stats = d.groupBy(*SPOT).agg(F.avg("_d").alias("_m"), F.stddev_pop("_d").alias("_s"), F.max("_d").alias("_x"))
    scale = group_quantile(d.filter("_d > 0"), [SAMPLE], "_d", 0.5, "_scale")
    s = with_group_stats(
        spots.select(*SPOT, "x", "y"), [SAMPLE], F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1")
    )
    s = s.join(stats, SPOT, "left").join(scale, SAMPLE, "left")
    unit = lambda c: (F.col(c) - F.col(f"_{c}0")) / F.greatest(F.col(f"_{c}1") - F.col(f"_{c}0"), F.lit(1.0))
    s = s.withColumn("x_norm", unit("x")).withColumn("y_norm", unit("y"))
    s = s.withColumn("x_centered", F.col("x_norm") - 0.5).withColumn("y_centered", F.col("y_norm") - 0.5)
    size = F.greatest(F.coalesce("_scale", F.lit(1.0)), F.lit(1.0))
    rel = lambda c: F.coalesce(F.col(c), F.lit(0.0)) / size
    return s.select(
        *SPOT, "x_norm", "y_norm", "x_centered", "y_centered",
        F.sqrt(F.col("x_centered") ** 2 + F.col("y_centered") ** 2).alias("radius_norm"),
        F.log1p(rel("_m")).alias("log1p_neighbor_dist_mean"), F.log1p(rel("_s")).alias("log1p_neighbor_dist_std"),
        F.log1p(rel("_x")).alias("log1p_neighbor_dist_max"), F.log1p(F.lit(1.0) / (rel("_m") + 1.0e-6)).alias("log1p_local_density"),
    )


def context_features(spots: DataFrame, ks: tuple[int, ...] = (8, 24)) -> DataFrame:
    """Own features, neighbour means for each k, and the coordinate context of the smallest k, as one vector."""
    ks = tuple(sorted(set(ks)))
    base = materialise(spots.select(*SPOT, "x", "y", "features"))
    edges = materialise(knn(base, [SAMPLE], ks[-1]))
    d = base
    for k in ks:
        d = neighbor_means(d, edges.filter(F.col("rank") <= k), out=f"_mean{k}")
    d = d.join(coordinate_context(base, edges.filter(F.col("rank") <= ks[0])), SPOT)
    return d.select(*SPOT, F.concat("features", *[f"_mean{k}" for k in ks], F.array(*CONTEXT)).alias("context"))


def context_report(context: DataFrame, samples: DataFrame) -> DataFrame:
    n = context.groupBy(SAMPLE).agg(F.count(F.lit(1)).alias("n_spots"), F.max(F.size("context")).cast("long").alias("n_features"))
    return samples.select(SAMPLE).join(n, SAMPLE, "left").select(
        SAMPLE, F.when(F.col("n_spots").isNull(), "missing").otherwise("written").alias("status"),
        F.coalesce("n_spots", F.lit(0)).alias("n_spots"), F.coalesce("n_features", F.lit(0)).alias("n_features"),
    )


def spot_layers(sf: DataFrame, counts: DataFrame, genes: DataFrame, sample_genes: DataFrame) -> DataFrame:
    """Long (sample, spot, layer, x, y, value): log totals, log size factor and log counts of chosen genes.

    A gene has a value for every spot of a sample that measured it, 0 where nothing was counted.
    """
    base = sf.select(
        *SPOT, "x", "y",
        F.explode(
            F.array(
                F.struct(F.lit("log1p_total_counts").alias("layer"), F.log1p("total").alias("value")),
                F.struct(F.lit("true_log_sf").alias("layer"), F.col("log_sf").alias("value")),
            )
        ).alias("l"),
    ).select(*SPOT, "l.layer", "x", "y", "l.value")
    chosen = genes.select("gene").distinct()
    grid = sf.select(*SPOT, "x", "y").join(sample_genes.select(SAMPLE, "gene").join(chosen, "gene", "left_semi"), SAMPLE)
    picked = grid.join(counts.join(chosen, "gene", "left_semi").select(*SPOT, "gene", "count"), [*SPOT, "gene"], "left")
    value = F.log1p(F.coalesce("count", F.lit(0))).alias("value")
    return base.unionByName(picked.select(*SPOT, F.concat("gene", F.lit("_log1p_count")).alias("layer"), "x", "y", value))


def missing_genes(genes: DataFrame, sample_genes: DataFrame) -> DataFrame:
    return genes.select("gene").join(sample_genes.select("gene").distinct(), "gene", "left_anti")
