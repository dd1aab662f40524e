"""Spot states by k-means on measured scores, and how predictions land in them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from spotweave.checks import InputError
from spotweave.operators.composition import agreement, confusion
from spotweave.operators.sizefactor import SPOT
from spotweave.operators.splits import fit_subset
from spotweave.session import materialise



def vectors(z: DataFrame, name: str) -> DataFrame:
    """Long z-scores to one pair of vectors per spot, in name order; a spot has one entry per signature."""
    packed = z.groupBy(*SPOT).agg(F.array_sort(F.collect_list(F.struct(name, "true", "pred"))).alias("_s"))
    return packed.select(*SPOT, F.col("_s.true").alias("true_z"), F.col("_s.pred").alias("pred_z"))


def start_centres(vecs: DataFrame, n_states: int, seed: int = 2026) -> list[list[float]]:
    """The measured vectors of the k rows with the lowest hashes."""
    rows = fit_subset(vecs, SPOT, n_states, seed).select("true_z").collect()  # k rows
    if len(rows) < n_states:
        raise InputError(f"need at least {n_states} rows to fit {n_states} states")
    return [list(map(float, r.true_z)) for r in rows]


def fit_centres(vecs: DataFrame, n_states: int = 6, seed: int = 2026, max_fit: int | None = None, max_iter: int = 100, tol: float = 1.0e-4) -> list[list[float]]:
    """k centres of the measured vectors by Lloyd's rounds over all rows; a round is one aggregate and k short rows at the driver.

    `max_fit` is the optional subset of the method, off by default. A state that loses all rows keeps its centre. The rounds end when
    no centre moves by more than `tol`.
    """
    fit = (fit_subset(vecs, SPOT, max_fit, seed) if max_fit else vecs).select(*SPOT, "true_z")
    fit = materialise(fit)
    centres = start_centres(fit, n_states, seed)
    for _ in range(max_iter):
        means = [F.avg(F.col("true_z")[i]).alias(f"m{i}") for i in range(len(centres[0]))]
        rows = fit.groupBy(_nearest(F.col("true_z"), centres).alias("label")).agg(*means).collect()  # at most k rows
        new = list(centres)
        for r in rows:
            new[r.label] = [float(r[f"m{i}"]) for i in range(len(centres[0]))]
        moved = max(sum((a - b) ** 2 for a, b in zip(x, y)) for x, y in zip(centres, new)) ** 0.5
        centres = new
        if moved <= tol:
            break
    return centres


def _nearest(vec: Column, centres: list[list[float]]) -> Column:
    """Index of the nearest centre, the first on a tie."""
    dists = [
        F.aggregate(
            F.zip_with(vec, F.array(*[F.lit(x) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x
        )
        for c in centres
    ]
    arr = F.array(*dists)
    return F.array_position(arr, F.array_min(arr)).cast("int") - 1


def assign_states(vecs: DataFrame, centres: list[list[float]]) -> DataFrame:
    d = vecs.withColumn("true_label", _nearest(F.col("true_z"), centres)).withColumn("pred_label", _nearest(F.col("pred_z"), centres))
    return d.withColumn("same_state", F.col("true_label") == F.col("pred_label"))


def best_assignment(gain: np.ndarray) -> int:
    """Largest sum of one-to-one cells of a square table, by shortest augmenting paths with potentials: O(n³)."""
    n = len(gain)
    cost = (gain.max(initial=0) - gain).astype(np.int64)
    row_of = np.full(n + 1, -1)  # the row matched to each column; column n is the free start
    u, v = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    far = np.iinfo(np.int64).max // 4
    for i in range(n):
        row_of[n], j = i, n
        least, came, used = np.full(n, far), np.full(n, n), np.zeros(n + 1, dtype=bool)
        while row_of[j] >= 0:
            used[j] = True
            r = row_of[j]
            slack = cost[r] - u[r] - v[:n]
            better = ~used[:n] & (slack < least)
            least[better], came[better] = slack[better], j
            j = int(np.where(used[:n], far, least).argmin())
            step = least[j]
            u[row_of[used]] += step
            v[used] -= step
            least[~used[:n]] -= step
        while j != n:
            row_of[j], j = row_of[came[j]], int(came[j])
    return int(sum(gain[row_of[j], j] for j in range(n)))


def best_match(conf: DataFrame, n_labels: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Share of rows matched by the best one-to-one relabelling, per group.

    `conf` has integer labels from 0 and counts; there may be any number of labels, also beyond `n_labels`. Spots were counted into
    the table before, so a group here is one small table.
    """
    keys = keys or []
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in conf.select(*keys).schema] + ["n_spots bigint", "best_match_accuracy double"])

    def match(df: pd.DataFrame) -> pd.DataFrame:
        k = int(max(n_labels, df["true_label"].max() + 1, df["pred_label"].max() + 1))
        gain = np.zeros((k, k), dtype=np.int64)
        np.add.at(gain, (df["true_label"].to_numpy(), df["pred_label"].to_numpy()), df["n_spots"].to_numpy())
        total = int(gain.sum())
        out = df[keys].head(1).reset_index(drop=True)
        return out.assign(n_spots=total, best_match_accuracy=best_assignment(gain) / total) if keys else pd.DataFrame({"n_spots": [total], "best_match_accuracy": [best_assignment(gain) / total]})

    return conf.groupBy(*keys).applyInPandas(match, schema)


def state_fidelity(labels: DataFrame, n_states: int, keys: list[str] | None = None) -> DataFrame:
    keys = keys or []
    conf = materialise(confusion(labels, keys))
    a = agreement(conf, keys).select(*keys, "n_spots", "adjusted_rand", "normalized_mutual_info")
    b = best_match(conf, n_states, keys).select(*keys, "best_match_accuracy")
    return a.join(b, keys) if keys else a.crossJoin(F.broadcast(b))


def confusion_wide(conf: DataFrame, n_states: int) -> DataFrame:
    at = lambda j: F.coalesce(F.sum(F.when(F.col("pred_label") == j, F.col("n_spots"))), F.lit(0)).alias(f"pred_{j}")
    return conf.groupBy(F.col("true_label").alias("true_state")).agg(*[at(j) for j in range(n_states)])


def annotate_states(z: DataFrame, labels: DataFrame, name: str, n_states: int) -> DataFrame:
    """Per state: sizes on both sides, the three signatures with the highest measured centroid, and both centroids."""
    d = z.join(labels.select(*SPOT, "true_label", "pred_label"), SPOT)
    ct = d.groupBy(F.col("true_label").alias("state"), name).agg(F.avg("true").alias("t"), F.count(F.lit(1)).alias("nt"))
    cp = d.groupBy(F.col("pred_label").alias("state"), name).agg(F.avg("pred").alias("p"), F.count(F.lit(1)).alias("np"))
    both = ct.join(cp, ["state", name], "full_outer")
    packed = both.groupBy("state").agg(
        F.coalesce(F.max("nt"), F.lit(0)).alias("n_true_spots"),
        F.coalesce(F.max("np"), F.lit(0)).alias("n_pred_spots"),
        F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct((-F.col("t")).alias("o"), F.col(name).alias("s"), "t")))).alias("a"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct(name, "t"))))).alias("true_centroid"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("p").isNotNull(), F.struct(name, "p"))))).alias("pred_centroid"),
    )
    top = F.slice("a", 1, 3)
    return packed.select(
        "state", "n_true_spots", "n_pred_spots",
        F.array_join(F.transform(top, lambda s: s["s"]), "|").alias("top_true_signatures"),
        F.array_join(F.transform(top, lambda s: F.format_string("%.3f", s["t"])), "|").alias("top_true_z"),
        F.to_json("true_centroid").alias("true_centroid_json"), F.to_json("pred_centroid").alias("pred_centroid_json"),
    )
