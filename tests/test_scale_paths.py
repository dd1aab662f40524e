"""The paths that only large inputs take give what the small ones give."""

import itertools
import math
import re
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave import session
from spotweave.checks import InputError
from spotweave.operators import neighbors, ordering, spatial, splits, states

ROWS = [(k, v, i) for i, (k, v) in enumerate(itertools.product(["a", None, "b"], [1.0, 1.0, 2.5, float("nan"), 4.0, 4.0, 4.0, -1.0, 0.0, 7.0]))]


def key(r):
    return tuple("nan" if isinstance(x, float) and math.isnan(x) else str(x) for x in r)


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k string, v double, i long")


def test_null_keys_nan_and_ties_through_both_rank_paths(df):
    for make in (
        lambda n: ordering.row_number(df, ["k"], [F.col("v"), F.col("i")], bucket_rows=n),
        lambda n: ordering.average_ranks(df, ["k"], "v", "rank", n),
        lambda n: ordering.group_quantile(df.filter("NOT isnan(v)"), ["k"], "v", 0.3, "q", n),
        lambda n: ordering.running_total(df, ["k"], [F.col("i")], F.col("i"), "s", n),
    ):
        small, large = (sorted(key(r) for r in make(n).collect()) for n in (1000, 3))
        assert small == large and any(r[0] == "None" for r in small)


def test_balanced_draws_add_up_and_do_not_starve_small_samples(spark):
    rows = spark.createDataFrame([("a", 0)] + [("b", i) for i in range(1000)], "sample_id string, spot_id long")
    got = splits.balanced_draws(rows, ["spot_id"], 1001).collect()
    by = {s: sum(r.draws for r in got if r.sample_id == s) for s in "ab"}
    assert len(got) == 1001 and by["a"] + by["b"] == 1001 and abs(by["a"] - 500) < 80


def test_best_assignment_of_any_size():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 6):
        g = rng.integers(0, 50, (n, n))
        assert states.best_assignment(g) == max(sum(g[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))


def test_best_match_with_twenty_labels(spark):
    turn = [(i, (7 * i + 3) % 20, 10 + i) for i in range(20)] + [(i, i, 1) for i in range(20)]
    conf = spark.createDataFrame(turn, "true_label int, pred_label int, n_spots long")
    row = states.best_match(conf).first()
    assert row.n_spots == sum(t[2] for t in turn) and row.best_match_accuracy == pytest.approx(sum(10 + i for i in range(20)) / row.n_spots, abs=0.01)


def test_neighbours_with_outliers_piles_and_points_nowhere(spark):
    rng = np.random.default_rng(2)
    p = np.vstack([rng.random((300, 2)), rng.random((60, 2)) * 1000, [[1e6, 1e6], [-1e9, 3.0]], np.repeat([[0.5, 0.5]], 30, 0)])
    lost = [(float("inf"), 0.0), (0.0, float("nan")), (None, 1.0)]
    rows = [("g", i, float(x), float(y)) for i, (x, y) in enumerate(p)] + [("g", 1000 + i, x, y) for i, (x, y) in enumerate(lost)]
    d = spark.createDataFrame(rows, "sample_id string, spot_id long, x double, y double")
    got = {}
    for r in neighbors.knn(d, ["sample_id"], 4, small=0).collect():
        got.setdefault(r.spot_id, {})[r["rank"]] = r.neighbor_id
    assert set(got) == set(range(len(p)))
    for i in range(len(p)):
        d2 = ((p - p[i]) ** 2).sum(1)
        d2[i] = np.inf
        assert [got[i][k] for k in (1, 2, 3, 4)] == list(np.lexsort((np.arange(len(p)), d2))[:4])
    assert neighbors.invalid_points(d, ["sample_id"]).first().n_invalid == 3


def test_points_are_not_broadcast_to_points(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "FEW", 0)  # the last few points may be broadcast
    p = spark.createDataFrame([("g", i, float(i % 9), float(i // 9)) for i in range(81)], "sample_id string, spot_id long, x double, y double")
    p = session.materialise(p)
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    reps = session.materialise(p.select("sample_id", F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("spot_id").alias("_rep")))
    places = session.materialise(reps.drop("_rep").select("*", *[F.lit(v).alias(n) for n, v in (("_x0", 0.0), ("_y0", 0.0), ("_w", 2.0), ("_covers", False))]))
    block = neighbors._nearest_of_block(places, places, reps, ["sample_id"], 5, 1)
    small = neighbors._compare_all(reps.withColumnRenamed("_rep", "_id"), ["sample_id"], 4)
    for d in (block, small, neighbors._search_grid(reps.withColumnRenamed("_rep", "_id"), ["sample_id"], 4)):
        assert "BroadcastHashJoin" not in plan(d)
        assert d.count() == 81


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda *a: None)
    for master, ok in (("local[2]", True), ("spark://host:7077", False), ("local-cluster[3,2,1000]", False)):
        context = SimpleNamespace(getConf=lambda: conf, master=master, applicationId=f"app-{master}")
        fake = SimpleNamespace(conf=conf, sparkContext=context)
        if ok:
            assert session.shared_dir(fake)
        else:
            with pytest.raises(InputError):
                session.shared_dir(fake)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_cells_unfold_from_the_rows_of_the_spots(spark):
    """No shuffle and no join: nothing that grows with spots × genes is moved; the rows equal those of the joins."""
    from spotweave.operators import align, evaluate, sizefactor
    from spotweave.sources.views import views

    v = views(spark, "/root/testdata/sf0.001")
    for d in (v.predictions, v.eval_cells, v.ablation_cells, v.measured_cells):
        assert "Exchange" not in _plan(d) and "Join" not in _plan(d)
    sf = sizefactor.size_factor(sizefactor.spot_totals(v.spots, v.counts))
    dense = align.dense_truth(v.spots.select("sample_id", "spot_id"), v.sample_genes, v.counts)
    assert dense.select(*align.CELL).exceptAll(v.predictions.select(*align.CELL)).isEmpty()
    joined = evaluate.evaluation_cells(v.predictions, sf, v.counts, v.sample_genes)
    got, want = ({(r.sample_id, r.spot_id, r.gene): (r.value, r.true_count, r.sf) for r in d.collect()} for d in (v.eval_cells, joined))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and len(want) > 1000
    totals = sizefactor.normalise_predicted(v.pred_log_sf).select("sample_id", "spot_id", "pred_sf")
    mine, theirs = ({(r.sample_id, r.spot_id): r.pred_sf for r in d.collect()} for d in (v.pred_sf, totals))
    assert mine.keys() == theirs.keys() and all(mine[k] == pytest.approx(theirs[k]) for k in mine)


def test_gene_sets_meet_cells_without_a_shuffle_by_gene(spark):
    from spotweave.operators import genesets
    from spotweave.sources.views import views

    v = views(spark, "/root/testdata/sf0.001")
    for d in (genesets.spot_scores(v.ablation_cells, v.gene_sets, v.sample_genes), genesets.set_scores(v.eval_cells, v.gene_sets, "value")):
        assert "hashpartitioning(gene" not in _plan(d)


def test_lags_come_with_the_neighbours_and_equal_the_join(spark):
    """Two signatures share their spots, one lacks some; a lone spot has no lag. Small and grid search agree with joins over edges."""
    from spotweave.operators import spatial

    rng = np.random.default_rng(4)
    rows = []
    for s, sig, n in (("a", "p", 40), ("a", "q", 40), ("a", "r", 23), ("b", "p", 1), ("c", "p", 30)):
        rows += [(s, sig, i, float(i % 8), float(i // 8), *map(float, rng.normal(size=2))) for i in range(n)]
    z = spark.createDataFrame(rows, "sample_id string, signature string, spot_id long, x double, y double, z_true double, z_pred double")
    cols = ["z_true", "z_pred"]
    want = spatial.spatial_lag(z, spatial.shared_edges(z, 6), spatial.GROUP, cols)
    out = [*spatial.GROUP, "spot_id", *cols, "lag_z_true", "lag_z_pred", "n_neighbors"]
    expected = sorted(map(tuple, want.select(*out).collect()))
    for small in (None, 0):
        lag = spatial.shared_lag(z, z, 6, cols, small=small)
        if small is None:
            assert "neighbor_id" not in _plan(lag)
        got = sorted(map(tuple, lag.select(*out).collect()))
        assert [g[:3] for g in got] == [e[:3] for e in expected] and len(got) == 133
        for g, e in zip(got, expected):
            assert g[3:] == pytest.approx(e[3:])


def test_tasks_of_the_neighbour_means_follow_the_edges(spark, monkeypatch):
    """Rows on a lattice are few bytes: chosen by size, one task would gather the vectors of all spots."""
    monkeypatch.setattr(neighbors, "PLACES_PER_TASK", 7)
    monkeypatch.setattr(spatial, "EDGES_PER_TASK", 9)
    spots = [("a", i, float(i % 6), float(i // 6), [float(i), float(i * i)]) for i in range(60)]
    d = spark.createDataFrame(spots, "sample_id string, spot_id long, x double, y double, features array<double>")
    edges = session.materialise(neighbors.knn(d, ["sample_id"], 4, small=0))
    near = {i: sorted(((x - u) ** 2 + (y - v) ** 2, j) for _, j, u, v, _ in spots if j != i)[:4] for _, i, x, y, _ in spots}
    means = spatial.neighbor_means(d, edges)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * 60 // 9))
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 3 and f", {n}), REPARTITION_BY_NUM" in plan
    assert {r.spot_id: r.neighbor_mean for r in means.collect()} == {i: [sum(spots[j][4][c] for _, j in e) / 4 for c in (0, 1)] for i, e in near.items()}


def test_scores_of_spots_stay_with_their_sample(spark):
    """F8: the stored tables keep the rows of a sample together, so scores and slide means need no shuffle of spots."""
    from spotweave.operators import genesets
    from spotweave.sources.views import views

    v = views(spark, "/root/testdata/sf0.001")
    scores = genesets.scores_of_kind(v.spot_scores, "rate")
    means = scores.groupBy("sample_id", "signature").agg(F.count("true"))
    for d in (genesets.spot_scores(v.ablation_cells, v.gene_sets, v.sample_genes), means):
        assert "Exchange hashpartitioning(sample_id" not in _plan(d)
    plain = spark.createDataFrame(scores.collect(), scores.schema)  # the same rows, not together
    want = sorted(map(tuple, plain.groupBy("sample_id", "signature").agg(F.count("true")).collect()))
    assert sorted(map(tuple, means.collect())) == want and len(want) > 10


def test_fractions_of_spots_stay_with_their_sample(spark):
    """neither dominant types nor slide means shuffle the fractions."""
    from spotweave.operators import composition
    from spotweave.plans import q_genesets
    from spotweave.sources.views import views

    fractions = q_genesets._fractions(views(spark, "/root/testdata/sf0.001"))
    for d in (composition.dominant(fractions, "cell_type"), composition.slide_means(fractions, "cell_type")):
        assert "Exchange hashpartitioning(sample_id" not in _plan(d)


def test_vectors_of_spots_stay_with_their_sample(spark):
    """the vectors of a spot are packed where its scores lie, in as many tasks as the lines need."""
    from spotweave.plans import q_genesets
    from spotweave.sources.views import views

    v = views(spark, "/root/testdata/sf0.001")
    vecs = states.vectors(q_genesets._z(v), "name")
    assert "Exchange hashpartitioning(sample_id" not in _plan(vecs) and vecs.rdd.getNumPartitions() == v.buckets


def test_spatial_report_of_rows_that_lie_together(spark):
    """nothing but the report is moved, and it equals the one of scattered rows; small samples and those the grid searches."""
    rng = np.random.default_rng(5)
    rows = []
    for s, sig, n in (("a", "p", 40), ("a", "q", 40), ("a", "r", 33), ("b", "p", 12), ("c", "p", 150), ("c", "q", 30), (None, "p", 35)):
        rows += [(s, sig, i, float(i % 8), float(i // 8), *map(float, rng.normal(size=2)), i % 37 != 36) for i in range(n)]
    rows += [("d", "flat", i, float(i % 8), float(i // 8), 2.0, float(i % 5), True) for i in range(31)]
    d = spark.createDataFrame(rows, "sample_id string, signature string, spot_id long, x double, y double, true double, pred double, valid boolean")
    far = d.filter("sample_id IS NOT NULL")
    here = session.materialise(far.repartition(5, "sample_id"), by="sample_id", buckets=5)
    few = here.filter("sample_id <> 'c'")
    assert "Exchange hashpartitioning(sample_id" not in _plan(spatial.shared_lag(
        spatial.group_zscores(spatial.usable(few), spatial.GROUP, ["true", "pred"], together=True), spatial.usable(few), 6, ["z_true", "z_pred"], together=True
    ))
    for mine, theirs, n in ((here, far, 6), (few, far.filter("sample_id <> 'c'"), 4)):
        got, want = (sorted(key(r) for r in x.collect()) for x in (
            spatial.spatial_report(t, 6, 0.2, 30, together=w).select(*spatial.GROUP, "n_spots", "k_neighbors", *[
                F.round(c, 9).alias(c) for c in ("spot_pearson", "true_moran_i", "pred_moran_i", "moran_abs_delta", "spatial_lag_pearson", "hotspot_jaccard")
            ]) for t, w in ((mine, True), (theirs, False))
        ))
        assert got == want and len(got) == n


def test_counts_meet_the_factors_of_their_spots_without_a_join(spark):
    """the rates behind the baselines equal those of counts joined with factors; no cell is shuffled by spot for them."""
    from spotweave.operators import baselines
    from spotweave.plans import q_baselines
    from spotweave.sources.views import views

    v = views(spark, "/root/testdata/sf0.001")
    spots = v.pred_sf.select("sample_id", "spot_id", "sf", "pred_sf")
    mine, theirs = baselines._with_factors(v.rated_counts, spots, "sf", "pred_sf"), baselines._with_factors(v.counts, spots, "sf", "pred_sf")
    assert "Join" not in _plan(mine) and "Join" in _plan(theirs)
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, theirs.collect())) and mine.count() > 100
    joined = baselines.mean_rates(v.counts, v.sf.join(q_baselines._train(v).select("sample_id"), "sample_id", "left_semi"), v.sample_genes, q_baselines._train(v))
    got, want = ({r.gene: (r.mean_rate, r.n_spots) for r in d.collect()} for d in (q_baselines._rates(v), joined))
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)


def _broadcast_by(df, column: str) -> list[str]:
    return re.findall(rf"BroadcastHashJoin \[[^\]]*\b{column}#[^\n]*", _plan(df))


def test_baselines_send_no_table_of_samples_and_genes_through_the_driver(spark):
    """two bytes a row in a file are a hundred in a broadcast, so such tables are merged; counts stay where they lie."""
    from spotweave.operators import baselines
    from spotweave.plans import q_baselines
    from spotweave.sources.views import views

    v = views(spark, "/root/testdata/sf0.001")
    parts = baselines._rate_parts(v.rated_counts, v.sf, v.sample_genes, v.samples)
    sums = q_baselines._sums(v)
    for d in (parts, sums):
        assert not _broadcast_by(d, "sample_id")
    hashed = re.search(r"ShuffledHashJoin \[sample_id#.*?FileScan", _plan(sums), re.S).group()  # its first input are the counts
    assert "Exchange" not in hashed
    got = {(r.method, r.sample_id, r.gene): r for r in sums.collect()}
    off = v.cells.select("sample_id", "spot_id", "gene", "count").join(v.pred_sf.select("sample_id", "spot_id", "sf", "pred_sf"), ["sample_id", "spot_id"])
    wide = baselines.baseline_sums(off, v.pred_sf.select("sample_id", "spot_id", "sf", "pred_sf"), v.sample_genes, v.samples, q_baselines._rates(v), q_baselines._rates(v, ["organ"]))
    want = {(r.method, r.sample_id, r.gene): r for r in wide.collect()}  # with counts off the panel as well
    assert off.count() > v.rated_counts.count() and got.keys() == want.keys() and len(got) == 5 * v.sample_genes.count()
    assert all(got[k][3:] == pytest.approx(want[k][3:]) for k in got)


def test_readiness_and_strata_send_no_table_of_samples_through_the_driver(spark):
    """ids of samples, and slides by label, are merged with what belongs to them."""
    from spotweave.operators import heldout, marts, stratify
    from spotweave.plans import q_marts, q_models
    from spotweave.sources.views import views

    v = views(spark, "/root/testdata/sf0.001")
    one, samples, tasks = q_marts._task_tables(v)
    picks = session.materialise(heldout.validation_picks(samples, tasks, q_marts.HELD_OUT))
    for d in (one, marts.missing_assets(one, q_marts.sample_assets(v)), heldout._names(samples, tasks, picks, q_marts.HELD_OUT)):
        assert not _broadcast_by(d, "sample_id")
    members = stratify._members(session.materialise(q_models._profiles(v)), q_models.FIELDS, 2)
    assert not _broadcast_by(members, "label_value") and members.count() > 10


def test_many_parts_are_not_broadcast(spark, monkeypatch):
    """beyond a number of parts lines meet them in a merge, with the same rows."""
    from spotweave.sources import views as at

    path = "/root/testdata/sf0.001"
    monkeypatch.setattr(at.Views, "stored", lambda self, d: d)
    few = at.Views(spark, path).spot_rows
    monkeypatch.setattr(at, "PARTS_TO_BROADCAST", 10)
    many = at.Views(spark, path).spot_rows
    assert _broadcast_by(few, "l_partkey") and not _broadcast_by(many, "l_partkey")
    flat = lambda d: sorted((r.sample_id, r.spot_id, str(r.total), str(r.sf and round(r.sf, 9)), len(r.cells), len(r.others)) for r in d.collect())
    assert flat(few) == flat(many) and len(flat(many)) == 720
