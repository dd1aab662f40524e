"""Splits and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.operators import splits as op
from spotweave.plans.base_sql import define
from spotweave.plans.registry import query
from spotweave.sources.views import Views

define(
    "split_rows",
    """WITH r AS (SELECT sample_id, organ, count(*) OVER (PARTITION BY organ) AS n,
  row_number() OVER (PARTITION BY organ ORDER BY sha1('2026|' || organ || '|' || sample_id), sample_id) AS r FROM samples),
k AS (SELECT *, round_even(n::double * 0.7::double, 0) AS a, round_even(n::double * 0.1::double, 0) AS b FROM r),
m AS (SELECT *, CASE WHEN a + b >= n AND n >= 3 THEN greatest(1, n - 2) ELSE a END AS nt, CASE WHEN a + b >= n AND n >= 3 THEN 1 ELSE b END AS nv FROM k)
SELECT sample_id, CASE WHEN r <= nt THEN 'train' WHEN r <= nt + nv THEN 'val' ELSE 'test' END AS split, 'leave_slide_out' AS split_type, '' AS heldout FROM m
UNION ALL SELECT sample_id, CASE WHEN organ = h THEN 'test' ELSE 'train' END, 'leave_organ_out', h FROM samples, (SELECT DISTINCT organ AS h FROM samples)
UNION ALL SELECT sample_id, CASE WHEN cohort = h THEN 'test' ELSE 'train' END, 'leave_cohort_out', h FROM samples,
  (SELECT cohort AS h FROM samples GROUP BY cohort HAVING count(*) >= 1)""",
)
define(
    "task_rows",
    """WITH t AS (SELECT sample_id, split, split_type, CASE WHEN split_type = 'leave_slide_out' THEN split_type ELSE heldout END AS heldout FROM split_rows),
c AS (SELECT *, count(CASE WHEN split = 'train' THEN 1 END) OVER w AS n_train, count(CASE WHEN split = 'val' THEN 1 END) OVER w AS n_val FROM t
  WINDOW w AS (PARTITION BY split_type, heldout)),
r AS (SELECT *, row_number() OVER (PARTITION BY split_type, heldout, split = 'train' ORDER BY sha1('2026|' || split_type || ':' || heldout || '|' || sample_id), sample_id) AS r FROM c)
SELECT sample_id, split_type, heldout, CASE WHEN n_val = 0 AND n_train >= 2 AND split = 'train'
  AND r <= least(greatest(1, round_even(n_train::double * 0.1::double, 0)), n_train - 1) THEN 'val' ELSE split END AS split FROM r""",
)


def split_rows(v: Views):
    return (
        op.leave_slide_out(v.samples)
        .unionByName(op.leave_organ_out(v.samples))
        .unionByName(op.leave_cohort_out(v.samples, min_test_slides=1))
    )


@query("G1_leave_slide_out", "SELECT * FROM split_rows WHERE split_type = 'leave_slide_out'")
def _(v: Views):
    return op.leave_slide_out(v.samples)


@query("G2_leave_organ_out", "SELECT * FROM split_rows WHERE split_type = 'leave_organ_out'")
def _(v: Views):
    return op.leave_organ_out(v.samples)


@query("G3_leave_cohort_out", "SELECT * FROM split_rows WHERE split_type = 'leave_cohort_out'")
def _(v: Views):
    return op.leave_cohort_out(v.samples, min_test_slides=1)


@query(
    "G4_group_splits",
    """WITH g AS (SELECT cohort, row_number() OVER (ORDER BY sha1('2026|' || cohort), cohort) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT cohort FROM samples)),
k AS (SELECT *, floor(n * 0.7::double) AS nt, floor((n - floor(n * 0.7::double)) * (0.15::double / (1.0::double - 0.7::double)) + 1e-9) AS nv FROM g)
SELECT sample_id, s.cohort, CASE WHEN r <= nt THEN 'train' WHEN r <= nt + nv THEN 'val' ELSE 'test' END AS split FROM samples s JOIN k USING (cohort)""",
)
def _(v: Views):
    return op.group_splits(v.samples.select("sample_id", "cohort"), "cohort")


_FOLDS = """WITH g AS (SELECT cohort, row_number() OVER (ORDER BY count(*) DESC, cohort) - 1 AS i FROM samples GROUP BY cohort),
f AS (SELECT cohort, cast(CASE WHEN (i // 3) % 2 = 0 THEN i % 3 ELSE 2 - i % 3 END AS int) AS own FROM g)
"""


@query(
    "G5_group_folds",
    _FOLDS + """SELECT cast(k AS int) AS fold, CASE WHEN k = own THEN 'oof' ELSE 'train' END AS role, sample_id FROM samples JOIN f USING (cohort), range(3) t(k)""",
)
def _(v: Views):
    return op.fold_lists(op.group_folds(v.samples, "cohort", 3), 3)


@query("G6_validation_carve_out", "SELECT * FROM task_rows")
def _(v: Views):
    t = split_rows(v).withColumn("heldout", F.when(F.col("split_type") == "leave_slide_out", F.col("split_type")).otherwise(F.col("heldout")))
    return op.add_validation(t)


@query(
    "G7_tasks",
    """SELECT split_type, h AS heldout, count(*) AS n_rows, trim(regexp_replace(lower(h), '[^a-z0-9]+', '_', 'g'), '_') AS task_slug
FROM (SELECT split_type, CASE WHEN split_type = 'leave_slide_out' THEN split_type ELSE heldout END AS h FROM split_rows) GROUP BY ALL""",
)
def _(v: Views):
    return op.enumerate_tasks(split_rows(v))


@query(
    "J7_task_samples",
    "SELECT t.split_type, t.heldout, t.sample_id, t.split, s.organ, s.cohort FROM task_rows t JOIN samples s USING (sample_id)",
)
def _(v: Views):
    return op.task_samples(v.samples.select("sample_id", "organ", "cohort"), split_rows(v))


@query(
    "G8_balanced_draws",
    """WITH w AS (SELECT sample_id, spot_id, 1.0 / count(*) OVER (PARTITION BY sample_id) AS weight,
  row_number() OVER (PARTITION BY sample_id ORDER BY spot_id) AS r, count(*) OVER (PARTITION BY sample_id) AS n FROM sf_t WHERE valid),
s AS (SELECT sample_id, n, row_number() OVER (ORDER BY sample_id) AS no, count(*) OVER () AS k FROM (SELECT DISTINCT sample_id, n FROM w)),
u AS (SELECT cast('0x' || substring(sha1('2026|sample|' || i), 1, 8) AS bigint) / 4294967296.0::double AS u,
  cast('0x' || substring(sha1('2026|row|' || i), 1, 8) AS bigint) / 4294967296.0::double AS v FROM range((SELECT count(*) FROM w)) t(i)),
d AS (SELECT sample_id, cast(floor(v * n) AS bigint) + 1 AS r, count(*) AS draws FROM u JOIN s ON no = cast(floor(u * k) AS bigint) + 1 GROUP BY ALL)
SELECT sample_id, spot_id, weight, coalesce(draws, 0) AS draws FROM w LEFT JOIN d USING (sample_id, r)""",
    "weight",
)
def _(v: Views):
    w = op.balanced_weights(v.sf.filter("valid").select("sample_id", "spot_id"))
    return op.balanced_draws(w, ["spot_id"], w.count())


@query(
    "G9_fit_subset",
    "SELECT sample_id, spot_id FROM sf_t WHERE valid ORDER BY sha1('2026|' || sample_id || '|' || spot_id), sample_id, spot_id LIMIT 200",
)
def _(v: Views):
    return op.fit_subset(v.sf.filter("valid").select("sample_id", "spot_id"), ["sample_id", "spot_id"], 200)


@query("S17_split_tables", "SELECT split_type, count(*) AS n_rows, count(DISTINCT heldout) AS n_heldout FROM (SELECT split_type, coalesce(nullif(heldout, ''), '-') AS heldout FROM split_rows) GROUP BY split_type")
def _(v: Views):
    """Written one folder per split type and read back."""
    from spotweave.sources.tables import scratch_path, write_splits

    path = scratch_path(v.spark, "splits")
    write_splits(split_rows(v), path)
    back = v.spark.read.csv(path, header=True)
    return back.groupBy("split_type").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(F.coalesce("heldout", F.lit("-"))).alias("n_heldout"))
