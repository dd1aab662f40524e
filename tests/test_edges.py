"""Small frames with hand-made or brute-force answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave.checks import InputError
from spotweave.functions import moments, scalars
from spotweave.operators import (
    align, baselines, cohort, composition, evaluate, linear, ordering, pixels, sizefactor, spatial, splits, states,
)
from spotweave.operators.neighbors import knn
from spotweave.sources import tables
from spotweave.streaming import accumulators


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_size_factor_is_mean_one(spark):
    spots = frame(spark, [("a", i) for i in range(3)], "sample_id string, spot_id long")
    counts = frame(spark, [("a", i, g, c) for i, c in enumerate((1, 2, 4)) for g in "xy"], "sample_id string, spot_id long, gene string, count long")
    rows = sizefactor.size_factor(sizefactor.spot_totals(spots, counts)).collect()
    assert all(r.valid and math.isfinite(r.log_sf) for r in rows)
    assert abs(np.mean([r.sf for r in rows]) - 1) < 1e-12


def test_stored_factor_keeps_total_mask(spark):
    spots = frame(spark, [("a", 0, [1.0], 0.0, 0.0), ("a", 1, [1.0], 1.0, 0.0)], "sample_id string, spot_id long, features array<double>, x double, y double")
    counts = frame(spark, [("a", 1, "g", 4)], "sample_id string, spot_id long, gene string, count long")
    sf = frame(spark, [("a", 0, 1e-8), ("a", 1, 1.0)], "sample_id string, spot_id long, stored_sf double")
    t = tables.spot_table(spots.drop("x", "y"), spots, counts, sf)
    assert [r.valid for r in t.orderBy("spot_id").collect()] == [False, True]
    with pytest.raises(InputError):
        tables.spot_table(spots.drop("x", "y"), spots.filter("spot_id = 1"), counts, sf)


def test_sample_without_valid_spot_is_an_error(spark):
    totals = frame(spark, [("a", 0, 0)], "sample_id string, spot_id long, total long")
    with pytest.raises(InputError):
        sizefactor.size_factor(totals, strict=True)


def test_pair_metrics_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("two", 1.0, 1.0), ("two", 2.0, 2.0), ("flat", 0.1, 1.0), ("flat", 0.1, 2.0), ("flat", 0.1, 3.0),
            ("bad", nan, 1.0), ("bad", inf, 1.0), ("ok", 1.0, 2.0), ("ok", 2.0, 1.0), ("ok", 4.0, 5.0), ("ok", nan, 9.0)]
    d = frame(spark, rows, "k string, pred double, true double")
    m = {r.k: r for r in moments.pair_metrics(d, ["k"]).collect()}
    assert m["two"].pearson is None and m["flat"].pearson is None
    assert m["bad"].n_obs == 0 and m["bad"].mae is None
    assert m["ok"].n_obs == 3 and abs(m["ok"].pearson - np.corrcoef([1, 2, 4], [2, 1, 5])[0, 1]) < 1e-12


@pytest.mark.parametrize("limit", [10_000, 7])
def test_order_operators_are_exact_in_buckets(spark, limit):
    rng = np.random.default_rng(1)
    rows = [("hot", int(i), float(v)) for i, v in enumerate(rng.integers(0, 25, 150))] + [("small", i, float(i)) for i in range(3)]
    d = frame(spark, rows, "k string, id long, v double")
    got = ordering.row_number(d, ["k"], [F.col("v"), F.col("id")], "r", limit).collect()
    for k in ("hot", "small"):
        mine = [(r.v, r.id) for r in sorted((r for r in got if r.k == k), key=lambda r: r.r)]
        assert mine == sorted((v, i) for kk, i, v in rows if kk == k)
    q = {r.k: r.q for r in ordering.group_quantile(d, ["k"], "v", 0.9, "q", limit).collect()}
    assert abs(q["hot"] - np.quantile([v for k, _, v in rows if k == "hot"], 0.9)) < 1e-12
    ranks = {(r.k, r.v): r.a for r in ordering.average_ranks(d, ["k"], "v", "a", limit).collect()}
    hot = np.array([v for k, _, v in rows if k == "hot"])
    for v in set(hot):
        assert ranks[("hot", v)] == (hot < v).sum() + ((hot == v).sum() + 1) / 2
    total = ordering.row_number(d, [], [F.col("k"), F.col("v"), F.col("id")], "r", limit)
    assert sorted(r.r for r in total.collect()) == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("small", [0, None])
def test_knn_matches_brute_force(spark, small):
    rng = np.random.default_rng(2)
    pts = [("clump", i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.normal(0, 0.01, (60, 2)), rng.uniform(-50, 50, (25, 2))]))]
    pts += [("line", i, float(i), 0.0) for i in range(30)] + [("same", i, 1.0, 1.0) for i in range(12)] + [("two", 0, 0.0, 0.0), ("two", 1, 1.0, 0.0), ("one", 0, 0.0, 0.0)]
    d = frame(spark, pts, "g string, spot_id long, x double, y double")
    got = {}
    for r in knn(d, ["g"], 5, small=small).collect():
        got.setdefault((r.g, r.spot_id), []).append((r.rank, r.neighbor_id))
    for g, i, x, y in pts:
        best = sorted(((x - a) ** 2 + (y - b) ** 2, j) for h, j, a, b in pts if h == g and j != i)[:5]
        assert [n for _, n in sorted(got.get((g, i), []))] == [j for _, j in best]


def test_moran_is_affine_invariant(spark):
    pts = [("s", "sig", i, float((i * 7) % 11), float(i % 5), float(i % 6), float(i // 6)) for i in range(36)]
    d = frame(spark, pts, "sample_id string, signature string, spot_id long, true double, pred double, x double, y double").withColumn("valid", F.lit(True))
    a = spatial.spatial_report(d, 4, 0.2, 30).first()
    b = spatial.spatial_report(d.withColumn("true", F.col("true") * 3 + 7), 4, 0.2, 30).first()
    assert abs(a.true_moran_i - b.true_moran_i) < 1e-9 and a.n_spots == 36 and a.k_neighbors == 4
    assert spatial.spatial_report(d, 4, 0.2, 37).count() == 0


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 5)) * [1, 2, 3, 4, 5] + 1
    y = np.stack([x @ [1, 2, 0, 0, -1] + 3, x[:, 0] * 2], 1) + rng.normal(size=(90, 2)) * 0.1
    g = [f"g{i % 3}" for i in range(90)]
    d = frame(spark, [(g[i], x[i].tolist(), y[i].tolist()) for i in range(90)], "k string, features array<double>, targets array<double>")
    models = linear.solve_ridge(linear.left_out(linear.cross_products(d, "k"), "k"), "k", 2, 10.0).collect()
    assert len(models) == 6
    for m in models:
        keep = np.array(g) != m.k
        xs, ys = x[keep], y[keep, m.target]
        z = (xs - xs.mean(0)) / xs.std(0)
        w = np.linalg.solve(z.T @ z + 10 * np.eye(5), z.T @ (ys - ys.mean())) / xs.std(0)
        assert np.allclose(m.weights, w) and abs(m.intercept - (ys.mean() - xs.mean(0) @ w)) < 1e-9 and m.n_train == keep.sum()


def test_kmeans_is_a_lloyd_fixpoint(spark):
    rng = np.random.default_rng(4)
    z = np.vstack([rng.normal(c, 0.2, (30, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    d = frame(spark, [("s", i, z[i].tolist(), z[i].tolist()) for i in range(90)], "sample_id string, spot_id long, true_z array<double>, pred_z array<double>")
    centres = np.array(states.fit_centres(d, 3))
    labels = np.array([r.true_label for r in states.assign_states(d, centres.tolist()).orderBy("spot_id").collect()])
    assert (labels == ((z[:, None] - centres) ** 2).sum(2).argmin(1)).all()
    assert np.allclose(sorted(map(tuple, centres)), sorted(tuple(z[labels == k].mean(0)) for k in range(3)), atol=1e-3)
    same = states.state_fidelity(states.assign_states(d, centres.tolist()), 3).first()
    assert same.adjusted_rand == 1 and abs(same.normalized_mutual_info - 1) < 1e-12 and same.best_match_accuracy == 1
    with pytest.raises(InputError):
        states.fit_centres(d.limit(2), 3)


def test_composition_fractions_sum_to_one(spark):
    rows = [("s", i, t, float(i * k % 5), float(i + k)) for i in range(6) for k, t in enumerate(("a", "b", "c"))]
    d = frame(spark, rows, "sample_id string, spot_id long, t string, true double, pred double")
    f = composition.softmax_fractions(composition.zscores_from_true(d, "t"), "t")
    for r in f.groupBy("spot_id").agg(F.sum("true").alias("a"), F.sum("pred").alias("b")).collect():
        assert abs(r.a - 1) < 1e-12 and abs(r.b - 1) < 1e-12
    ties = frame(spark, [("s", 0, "b", 0.5, 0.5), ("s", 0, "a", 0.5, 0.5)], "sample_id string, spot_id long, t string, true double, pred double")
    assert composition.dominant(ties, "t").first().true_label == "a"


def test_splits_are_leakage_free(spark):
    s = frame(spark, [(str(i), f"o{i % 3}", f"c{i % 4}") for i in range(23)], "sample_id string, organ string, cohort string")
    a = splits.leave_slide_out(s)
    assert a.count() == 23 and a.select("sample_id").distinct().count() == 23
    align.assert_disjoint_groups(splits.group_splits(s, "cohort", 0.5, 0.25), ["cohort"])
    with pytest.raises(InputError):
        align.assert_disjoint_groups(a.join(s, "sample_id"), ["organ"])
    folds = splits.group_folds(s, "cohort", 2)
    assert folds.groupBy("cohort").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    with pytest.raises(InputError):
        align.assert_no_test_calibration(s.limit(3), s)


def test_scalars(spark):
    long = "spatial_multimodal_analysis_maldi_msi_and_spatial_transcriptomics_within_the_same_tissue_section"
    d = frame(spark, [("breast",), (long,)], "s string").select("s", scalars.bounded_name(F.col("s"), 40).alias("n")).collect()
    assert d[0].n == "breast" and len(d[1].n) <= 40 and d[1].n.startswith("spatial_multimodal_analysis") and d[1].n != long
    x = [1e-8, 0.3, 1.0, 2.5, 40.0, 4000.0]
    for r in frame(spark, [(v,) for v in x], "x double").select("x", scalars.log_gamma(F.col("x")).alias("g")).collect():
        assert abs(r.g - math.lgamma(r.x)) < 1e-9 * max(1, abs(math.lgamma(r.x)))
    labels = [r[0] for r in frame(spark, [(" Unknown ",), (None,), (" Lung ",)], "s string").select(scalars.clean_label(F.col("s"))).collect()]
    assert labels == ["", "", "Lung"]


def test_patch_descriptors(spark):
    rows = [(0, 255, 255, 255)] * 16 + [(1, 120, 40, 80)] * 16
    r = {x.patch_id: x for x in pixels.patch_descriptors(frame(spark, rows, "patch_id int, r int, g int, b int")).collect()}
    assert r[0].tissue_fraction == 0 and r[1].tissue_fraction == 1
    assert len(pixels.NAMES) == 23 and all(math.isfinite(r[1][n]) for n in pixels.NAMES)


def test_stream_equals_batch_over_many_triggers(spark, tmp_path):
    rows = [("s%d" % (i % 3), "g%d" % (i % 4), float(i % 7), float(i % 5)) for i in range(120)]
    d = frame(spark, rows, "sample_id string, gene string, pred double, true double")
    d.repartition(4).write.parquet(str(tmp_path / "in"))
    s = accumulators.read_pairs_stream(spark, str(tmp_path / "in"), d.schema, files_per_trigger=1)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    got, want = key(accumulators.gene_metrics_of(accumulators.accumulate_stream(s))), key(evaluate.gene_metrics(d))
    assert len(got) == len(want) == 4
    for a, b in zip(got, want):
        assert a[0] == b[0] and np.allclose(a[1:], b[1:])


def test_hot_sample_baselines_need_no_dense_rows(spark):
    """Sparse algebra against dense rows, with one sample holding most of the spots."""
    spots = [("hot", i, 1.0 + i % 3, 0.5 + i % 2) for i in range(40)] + [("b", 0, 1.0, 2.0)]
    counts = [("hot", i, "x", 1 + i % 4) for i in range(0, 40, 3)] + [("b", 0, "y", 2)]
    sp = frame(spark, spots, "sample_id string, spot_id long, sf double, pred_sf double")
    ct = frame(spark, counts, "sample_id string, spot_id long, gene string, count long")
    sg = frame(spark, [("hot", "x"), ("hot", "y"), ("b", "y")], "sample_id string, gene string")
    sm = frame(spark, [("hot", "o"), ("b", "p")], "sample_id string, organ string")
    gr = frame(spark, [("x", 0.7), ("y", 0.2)], "gene string, mean_rate double")
    og = frame(spark, [("o", "x", 0.9)], "organ string, gene string, mean_rate double")
    got = {(r.method, r.sample_id, r.gene): r for r in baselines.baseline_sums(ct, sp, sg, sm, gr, og).collect()}
    truth = {(s, i, g): c for s, i, g, c in counts}
    f = {(s, i): p for s, i, _, p in spots}
    p = np.array([0.9 * f[("hot", i)] for i in range(40)])
    t = np.array([truth.get(("hot", i, "x"), 0) for i in range(40)], float)
    r = got[("organ_sf_only_count_pred_sf", "hot", "x")]
    for name, v in {"n": 40, "sp": p.sum(), "spt": (p * t).sum(), "sae": abs(p - t).sum(), "sse": ((p - t) ** 2).sum(), "nz": (t > 0).sum()}.items():
        assert abs(r[name] - v) < 1e-9


def test_input_errors(spark):
    s = frame(spark, [("1", "o")], "sample_id string, organ string")
    with pytest.raises(InputError):
        cohort.select_samples(s, frame(spark, [("9",)], "sample_id string"))
    with pytest.raises(InputError):
        tables.selected_genes(spark, "a", "b")
    with pytest.raises(ValueError):
        scalars.truth_value("other", F.lit(1), F.lit(1))
    with pytest.raises(InputError):
        align.align_genes(frame(spark, [("x", 0)], "gene string, gene_index int"), frame(spark, [("y", 0)], "gene string, gene_index int"))


def test_manifest_columns_and_defaults(spark):
    """All columns of the contract; unknown metadata is empty, the patient is the sample, lost and missing assets have no path."""
    from spotweave.operators import marts

    samples = spark.createDataFrame([("a", "lung", 7), ("b", None, None), ("c", "lung", 3)], "sample_id string, organ string, spots_under_tissue long")
    assets = spark.createDataFrame(
        [(s, k, f"{s}/{k}", True) for s in "ab" for k in ("features", "counts", "coords")] + [("a", "genes", "a/genes", True), ("a", "spots", "a/spots", False)],
        "sample_id string, asset string, path string, found boolean",
    )
    candidates, rows = marts.manifest(samples, assets)
    assert rows.columns == marts.MANIFEST_COLUMNS
    got = {r.sample_id: r for r in rows.collect()}
    assert set(got) == {"a", "b"}
    a = got["a"]
    assert (a.patient_id, a.study_link, a.genes_path, a.spots_path, a.size_factor_path, a.n_spots, a.n_genes) == ("a", "", "a/genes", "", "", 7, None)
    assert got["b"].organ is None and got["b"].n_spots is None
    assert {r.sample_id: (r.has_coords, r.ready_for_training) for r in candidates.collect()} == {"a": (True, True), "b": (True, True), "c": (False, False)}
