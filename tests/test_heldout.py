"""Leave-one-label-out: tasks by label algebra, models over whole vectors, the results mart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spotweave import session
from spotweave.operators import generalization, heldout, linear, marts, splits

COLUMNS = {"leave_organ_out": "organ", "leave_cohort_out": "cohort"}


def samples(spark, n):
    """Skewed organs, cohorts of one and two samples, some labels missing."""
    rng = np.random.default_rng(n)
    rows = [(f"s{i}", None if i % 17 == 0 else f"o{int(rng.integers(0, 3 + i % 5))}", None if i % 13 == 0 else f"c{i // 2 if i < n // 2 else 0}") for i in range(n)]
    return spark.createDataFrame(rows, "sample_id string, organ string, cohort string")


@pytest.mark.parametrize("slack", [2.0, 0.05])
def test_label_algebra_gives_what_the_rows_give(spark, slack, monkeypatch):
    monkeypatch.setattr(heldout, "SLACK", slack)
    s = samples(spark, 120)
    rows = splits.leave_organ_out(s).unionByName(splits.leave_cohort_out(s, min_test_slides=2))
    long = session.materialise(splits.task_samples(s, rows))
    tasks = session.materialise(heldout.label_tasks(s, COLUMNS, {"leave_cohort_out": 2}))
    want = marts.task_summary(long)
    got = heldout.summary(s, tasks, COLUMNS).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    picks = heldout.validation_picks(s, tasks, COLUMNS, slack=slack)
    key = lambda d: sorted(map(tuple, d.select("split_type", "heldout", "sample_id").collect()))
    assert key(picks) == key(long.filter("split = 'val'"))
    a = s.select("sample_id", F.lit("counts").alias("asset"), F.concat(F.lit("p"), "sample_id").alias("path"), (F.length("sample_id") > 2).alias("found"))
    columns = marts.missing_assets(long, a).columns
    assert sorted(map(tuple, heldout.assets_of_all(s, tasks, a).select(*columns).collect())) == sorted(map(tuple, marts.missing_assets(long, a).collect()))
    assert heldout.summary(s.limit(0), heldout.label_tasks(s.limit(0), COLUMNS), COLUMNS).count() == 0


def test_no_rows_of_samples_by_labels(spark):
    """The plan of the summary pairs tasks with blocks of samples only."""
    s = samples(spark, 60)
    tasks = heldout.label_tasks(s, COLUMNS)
    plan = heldout.summary(s, session.materialise(tasks), COLUMNS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Cross") + plan.count("Join Inner\n") <= 2  # the one-row lists of names


def rows_of_groups(spark, rng, d, sizes):
    rows, x = [], []
    for g, n in sizes.items():
        for i in range(n):
            v = rng.normal(size=d) + len(x) % 3
            x.append((g, v, 0.3 * v[0] - 0.2 * v[-1] + rng.normal() * 0.1))
            rows.append((f"s{g}", i, g, v.tolist(), float(x[-1][2])))
    return spark.createDataFrame(rows, "sample_id string, spot_id long, g string, features array<double>, log_sf double"), x


def test_tiles_of_wide_matrices_and_groups_left_out(spark, monkeypatch):
    monkeypatch.setattr(linear, "TILE", 16)
    monkeypatch.setattr(linear, "HELD_BYTES", 1)  # every batch hands its matrices on
    df, x = rows_of_groups(spark, np.random.default_rng(5), 50, {"a": 70, None: 40, "b": 30})
    targets = df.select("sample_id", "spot_id", F.lit("t").alias("target"), F.col("log_sf").alias("y"))
    got = {m.g: m for m in linear.leave_group_out_models(df.repartition(7), targets, "g").collect()}
    for g in ("a", "b"):
        keep = [r for r in x if r[0] != g]
        z, y = np.array([r[1] for r in keep]), np.array([r[2] for r in keep])
        s = (z - z.mean(0)) / z.std(0)
        w = np.linalg.solve(s.T @ s + 10 * np.eye(50), s.T @ (y - y.mean())) / z.std(0)
        assert np.allclose(got[g].weights, w) and got[g].n_train == len(keep)
        assert abs(got[g].intercept - (y.mean() - z.mean(0) @ w)) < 1e-9


def test_singular_systems_have_the_shortest_solution():
    a = np.array([[1.0, 1.0], [1.0, 1.0]])
    assert np.allclose(linear.solve_spd(a, np.array([[2.0], [2.0]])), [[1.0], [1.0]])


def test_results_mart_keeps_finished_tasks(spark, tmp_path, monkeypatch):
    df, _ = rows_of_groups(spark, np.random.default_rng(6), 4, {"a": 30, "b": 30})
    df = df.withColumn("only", F.lit("all"))
    genes = df.select("sample_id", "spot_id", F.lit("g1").alias("target"), F.abs("log_sf").alias("y"))
    tasks = spark.createDataFrame([("by_g", "a"), ("by_g", "b"), ("by_g", "nowhere"), ("by_all", "all")], "split_type string, heldout string")
    labels, path = {"by_g": "g", "by_all": "only"}, f"{tmp_path}/mart"
    first = generalization.run_tasks(df, genes, tasks.filter("heldout <> 'b'"), labels, path)
    status = lambda d: {(r.heldout, r.stage): r.status for r in d.collect()}
    want = {("a", s): "ok" for s in generalization.STAGES} | {("nowhere", s): "missing_rows" for s in generalization.STAGES}
    want |= {("all", s): "missing_model" for s in generalization.STAGES}  # no training rows
    assert status(first) == want
    fitted = []
    whole = generalization.generalization_rows
    monkeypatch.setattr(generalization, "generalization_rows", lambda df, c, g, a, todo: fitted.append(sorted(r[0] for r in todo.collect())) or whole(df, c, g, a, todo))
    again = generalization.run_tasks(df, genes, tasks, labels, path)
    assert fitted == [["b", "nowhere"], ["all"]]  # `a` is finished
    assert status(again) == want | {("b", s): "ok" for s in generalization.STAGES}
    wide = generalization.result_table(again).filter("heldout = 'b' AND stage = 'sf'").first()
    assert wide.run_name == "formal_by_g" and wide.metric_log_sf_pearson > 0.5 and wide.metric_mean_gene_pearson is None

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(generalization, "generalization_rows", broken)
    with pytest.raises(RuntimeError):
        generalization.run_tasks(df, genes, tasks, labels, path)
    left = status(generalization.read_results(spark, path))
    assert left["nowhere", "sf"] == "error" and left["a", "sf"] == "ok" and left["b", "combined"] == "ok"


def test_gene_set_positions_follow_the_file(spark, tmp_path):
    from spotweave.sources import tables

    lines = [f"set{i % 3},g{i}" for i in range(500)]
    (tmp_path / "sets.csv").write_text("signature,gene\n" + "\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")  # many blocks of one file
    try:
        got = {(r.signature, r.gene): r.position for r in tables.read_gene_sets(spark, f"{tmp_path}/sets.csv").collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {tuple(line.split(",")): i for i, line in enumerate(lines)}
