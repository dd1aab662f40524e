"""Stratification, patch statistics, linear models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from spotweave.operators import linear, pixels, stratify
from spotweave.operators.genesets import scores_of_kind
from spotweave.operators.splits import group_folds
from spotweave.plans.base_sql import METRIC_DOUBLES, PEARSON, define, metrics, sums
from spotweave.plans.q_evaluate import GENE_DOUBLES
from spotweave.plans.q_sfmetrics import SF, sf_sql
from spotweave.plans.registry import query
from spotweave.session import materialise
from spotweave.sources.views import Views
from spotweave.streaming import accumulators

FIELDS = ["organ", "cohort", "disease_state", "tissue", "absent_field"]

define(
    "slide_profiles",
    """SELECT p.*, s.organ, s.cohort, CASE WHEN lower(trim(disease_state)) = 'unknown' THEN '' ELSE trim(disease_state) END AS disease_state, '' AS tissue
FROM (SELECT sample_id, signature, avg(rate_true) AS true_mean, avg(rate_pred) AS pred_mean, count(*) AS n_spots FROM spot_scores WHERE valid GROUP BY ALL) p JOIN samples s USING (sample_id)""",
)
define(
    "strata",
    """WITH l AS (SELECT sample_id, signature, true_mean, pred_mean, n_spots, 'organ' AS label_field, organ AS label_value FROM slide_profiles
UNION ALL SELECT sample_id, signature, true_mean, pred_mean, n_spots, 'cohort', cohort FROM slide_profiles
UNION ALL SELECT sample_id, signature, true_mean, pred_mean, n_spots, 'disease_state', disease_state FROM slide_profiles),
g AS (SELECT label_field, label_value FROM l WHERE label_value <> '' GROUP BY ALL HAVING count(DISTINCT sample_id) >= 2),
f AS (SELECT label_field, count(*) AS n_groups, string_agg(label_value, '|' ORDER BY label_value) AS groups FROM g GROUP BY ALL HAVING count(*) >= 2)
SELECT l.*, n_groups, groups FROM l JOIN g USING (label_field, label_value) JOIN f USING (label_field)""",
)
define(
    "effects",
    """WITH g AS (SELECT label_field, signature, label_value, count(*) AS n, avg(true_mean) AS t, avg(pred_mean) AS p FROM strata GROUP BY ALL),
s AS (SELECT label_field, signature, count(*) AS n_slides, avg(true_mean) AS gt, avg(pred_mean) AS gp, var_pop(true_mean) * count(*) AS sst, var_pop(pred_mean) * count(*) AS ssp,
  max(n_groups) AS n_groups, max(groups) AS groups FROM strata GROUP BY ALL),
e AS (SELECT label_field, signature, any_value(n_slides) AS n_slides, any_value(n_groups) AS n_groups, any_value(groups) AS groups,
  CASE WHEN any_value(n_slides) >= 3 AND count(*) >= 2 AND any_value(sst) > 0 THEN sum(n*(t-gt)^2)/any_value(sst) END AS true_eta_squared,
  CASE WHEN any_value(n_slides) >= 3 AND count(*) >= 2 AND any_value(ssp) > 0 THEN sum(n*(p-gp)^2)/any_value(ssp) END AS pred_eta_squared,
  first(label_value ORDER BY t DESC, label_value) AS true_top_group, first(label_value ORDER BY p DESC, label_value) AS pred_top_group,
  max(t) - min(t) AS true_group_range, max(p) - min(p) AS pred_group_range FROM g JOIN s USING (label_field, signature) GROUP BY ALL)
SELECT *, abs(pred_eta_squared - true_eta_squared) AS abs_eta_error, true_top_group = pred_top_group AS top_group_match FROM e""",
)
define(
    "contrasts",
    """WITH g AS (SELECT label_field, signature, label_value, count(*) AS n, avg(true_mean) AS t, avg(pred_mean) AS p, var_samp(true_mean) AS vt, var_samp(pred_mean) AS vp FROM strata GROUP BY ALL),
v AS (SELECT DISTINCT label_field, label_value FROM strata),
k AS (SELECT DISTINCT a.label_field, a.label_value AS group_a, b.label_value AS group_b, g.signature FROM v a JOIN v b ON a.label_field = b.label_field AND a.label_value < b.label_value
  JOIN g ON g.label_field = a.label_field AND g.label_value IN (a.label_value, b.label_value)),
j AS (SELECT k.*, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b, a.t AS ta, b.t AS tb, a.p AS pa, b.p AS pb,
  sqrt(((a.n-1)*a.vt + (b.n-1)*b.vt) / nullif(a.n+b.n-2, 0)) AS st, sqrt(((a.n-1)*a.vp + (b.n-1)*b.vp) / nullif(a.n+b.n-2, 0)) AS sp FROM k
  LEFT JOIN g a ON a.label_field = k.label_field AND a.signature = k.signature AND a.label_value = k.group_a
  LEFT JOIN g b ON b.label_field = k.label_field AND b.signature = k.signature AND b.label_value = k.group_b),
d AS (SELECT label_field, group_a, group_b, signature, n_a, n_b, CASE WHEN n_a >= 2 AND n_b >= 2 AND st > 0 THEN (ta - tb) / st END AS true_cohen_d,
  CASE WHEN n_a >= 2 AND n_b >= 2 AND sp > 0 THEN (pa - pb) / sp END AS pred_cohen_d FROM j)
SELECT *, abs(pred_cohen_d - true_cohen_d) AS abs_contrast_error, coalesce(sign(true_cohen_d) = sign(pred_cohen_d), false) AS same_direction FROM d""",
)


def _profiles(v: Views):
    return stratify.slide_profiles(scores_of_kind(v.spot_scores, "rate"), v.samples, FIELDS)


@query("X1_slide_profiles", "SELECT * FROM slide_profiles", "true_mean pred_mean")
def _(v: Views):
    return _profiles(v)


@query(
    "X2_group_profiles",
    """SELECT label_field, label_value, signature, count(DISTINCT sample_id) AS n_slides, cast(sum(n_spots) AS bigint) AS n_spots, avg(true_mean) AS true_mean,
  avg(pred_mean) AS pred_mean, stddev_pop(true_mean) AS true_std, stddev_pop(pred_mean) AS pred_std FROM strata GROUP BY ALL""",
    "true_mean pred_mean true_std pred_std",
)
def _(v: Views):
    return stratify.group_profiles(materialise(_profiles(v)), FIELDS)


@query(
    "X3_signature_effects", "SELECT * FROM effects",
    "true_eta_squared pred_eta_squared abs_eta_error true_group_range pred_group_range",
)
def _(v: Views):
    return stratify.signature_effects(materialise(_profiles(v)), FIELDS)


@query("X4_group_contrasts", "SELECT * FROM contrasts", "true_cohen_d pred_cohen_d abs_contrast_error")
def _(v: Views):
    return stratify.group_contrasts(materialise(_profiles(v)), FIELDS)


define(
    "field_summary",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY label_field ORDER BY true_eta_squared DESC, signature) AS rt, row_number() OVER (PARTITION BY label_field ORDER BY pred_eta_squared DESC, signature) AS rp
  FROM effects WHERE true_eta_squared IS NOT NULL AND pred_eta_squared IS NOT NULL),
e AS (SELECT label_field, count(*) AS n_signatures, max(n_slides) AS n_slides, max(n_groups) AS n_groups, max(groups) AS groups,
  CASE WHEN count(*) >= 3 THEN corr(true_eta_squared, pred_eta_squared) END AS eta_pearson, avg(abs_eta_error) AS mean_abs_eta_error,
  avg(CASE WHEN top_group_match THEN 1.0 ELSE 0.0 END) AS top_group_match_rate FROM effects GROUP BY label_field),
j AS (SELECT label_field, count(CASE WHEN rt <= 3 AND rp <= 3 THEN 1 END) / count(CASE WHEN rt <= 3 OR rp <= 3 THEN 1 END) AS top_signature_eta_jaccard FROM r GROUP BY label_field),
c AS (SELECT label_field, CASE WHEN count(true_cohen_d + pred_cohen_d) >= 3 THEN corr(true_cohen_d, pred_cohen_d) END AS contrast_pearson,
  avg(CASE WHEN same_direction THEN 1.0 ELSE 0.0 END) AS contrast_same_direction_rate, count(*) AS n_contrasts FROM contrasts GROUP BY label_field)
SELECT e.*, top_signature_eta_jaccard, contrast_pearson, contrast_same_direction_rate, coalesce(n_contrasts, 0) AS n_contrasts
FROM e LEFT JOIN j USING (label_field) LEFT JOIN c USING (label_field)""",
)
FS = "eta_pearson mean_abs_eta_error top_group_match_rate top_signature_eta_jaccard contrast_pearson contrast_same_direction_rate"


def field_summary(v: Views):
    p = materialise(_profiles(v))
    return stratify.field_summary(stratify.signature_effects(p, FIELDS), stratify.group_contrasts(p, FIELDS))


@query("X5_field_summary", "SELECT * FROM field_summary", FS)
def _(v: Views):
    return field_summary(v)


_Q = lambda c: ", ".join(f"quantile_cont({c}, {q / 100}) AS {'gray' if c == 'gray' else 'rgb'}_p{q}{'' if c == 'gray' else '_' + c}" for q in (10, 50, 90))


@query(
    "I1_patch_descriptors",
    f"""WITH a AS (SELECT patch_id, r/255.0::double AS r, g/255.0::double AS g, b/255.0::double AS b FROM pixels),
d AS (SELECT *, 0.299::double*r + 0.587::double*g + 0.114::double*b AS gray, (greatest(r,g,b) - least(r,g,b)) / greatest(greatest(r,g,b), 1e-6) AS sat FROM a)
SELECT patch_id, {', '.join(f'avg({c}) AS rgb_mean_{c}, stddev_pop({c}) AS rgb_std_{c}' for c in 'rgb')}, {_Q('r')}, {_Q('g')}, {_Q('b')}, {_Q('gray')},
  avg(gray) AS gray_mean, stddev_pop(gray) AS gray_std, avg(CASE WHEN gray < 0.92::double AND sat > 0.05::double THEN 1.0 ELSE 0.0 END) AS tissue_fraction,
  avg(sat) AS saturation_mean, stddev_pop(sat) AS saturation_std FROM d GROUP BY patch_id""",
    " ".join(pixels.NAMES),
)
def _(v: Views):
    return pixels.patch_descriptors(v.pixels)


# --- linear models: over two features, where SQL writes the solution out, and over all of them, where SQL eliminates --------

ALPHA = 10.0


def _sums(y: str = "y") -> str:
    return f"count(*) AS n, sum(x1) AS a, sum(x2) AS b, sum({y}) AS y, sum(x1*x1) AS aa, sum(x2*x2) AS bb, sum(x1*x2) AS ab, sum(x1*{y}) AS ay, sum(x2*{y}) AS by_"


def _solved(keys: str, source: str) -> str:
    """Intercept and weights from training sums, standardised features, intercept not penalised."""
    return f"""(SELECT {keys}, y/n - w1*a/n - w2*b/n AS w0, w1, w2 FROM (SELECT *, (p*c1-q*c2)/(p*p-q*q)/s1 AS w1, (p*c2-q*c1)/(p*p-q*q)/s2 AS w2 FROM
(SELECT *, n + {ALPHA} AS p, (ab - a*b/n)/(s1*s2) AS q, (ay - a*y/n)/s1 AS c1, (by_ - b*y/n)/s2 AS c2 FROM
(SELECT *, sqrt(aa/n - (a/n)^2) AS s1, sqrt(bb/n - (b/n)^2) AS s2 FROM {source} WHERE n >= 2))))"""


def _two(v: Views):
    """The regression rows with their first two features."""
    return v.regression.withColumn("features", F.slice("features", 1, 2))


def _train_test(v: Views):
    d = _two(v).withColumn("fold", F.col("spot_id") % 5)
    return d.filter("fold < 4"), d.filter("fold = 4")


define(
    "two_features",
    """SELECT sample_id, spot_id, features[1]::double AS x1, features[2]::double AS x2,
  features[1]::double * 2.0 - features[2]::double * 1.5 + features[3]::double * 0.5 + 0.01::double * (spot_id % 17) AS y FROM features""",
)
define("ridge_fit", f"SELECT * FROM {_solved('1 AS one', f'(SELECT {_sums()} FROM two_features WHERE spot_id % 5 < 4)')}")
define("ridge_scored", "SELECT 'ridge' AS baseline, w0 + w1*x1 + w2*x2 AS pred_log_sf, y AS true_log_sf FROM two_features, ridge_fit WHERE spot_id % 5 = 4")
define("constant_scored", "SELECT 'constant' AS baseline, 0.0::double AS pred_log_sf, y AS true_log_sf FROM two_features WHERE spot_id % 5 = 4")
_RIDGE_SQL = f"SELECT *, cast({ALPHA} AS double) AS alpha FROM ({sf_sql('baseline', 'ridge_scored')})"


@query("M1_ridge_baseline", _RIDGE_SQL, SF)
def _(v: Views):
    return linear.ridge_baseline(*_train_test(v))


N_FEATURES = 64


def _define_ridge(name: str, rows: str, key: str, targets: str, train: str = "true", leave_out: bool = True) -> None:
    """Views of a ridge over all features by Gauss-Jordan elimination. `rows` has the key, sample_id, spot_id and features, `targets` has
    sample_id, spot_id, target and y. A model is fitted on the other keys' rows, or on the key's own where `train` holds. The last view,
    all_{name}, has the prediction of every row and target."""
    x, gram, sums_, aug, weights = (f"{v}_{name}" for v in ("wide_x", "wide_gram", "wide_sums", "wide_aug", "wide_w"))
    d = N_FEATURES
    define(x, f"SELECT cast({key} AS varchar) AS k, sample_id, spot_id, {train} AS fit, i, CASE WHEN i = 0 THEN 1.0::double ELSE features[i]::double END AS x FROM {rows} CROSS JOIN (SELECT unnest(range(0, {d + 1})) AS i)")
    own = f"SELECT a.k, a.i, b.i AS j, sum(a.x * b.x) AS v FROM {x} a JOIN {x} b USING (k, sample_id, spot_id) WHERE a.fit GROUP BY ALL"
    own_y = f"SELECT k, target, i, sum(x * y) AS v FROM {x} JOIN {targets} USING (sample_id, spot_id) WHERE fit GROUP BY ALL"
    if leave_out:
        own = f"WITH o AS ({own}) SELECT k, i, j, t.v - o.v AS v FROM o JOIN (SELECT i, j, sum(v) AS v FROM o GROUP BY ALL) t USING (i, j)"
        own_y = f"WITH o AS ({own_y}) SELECT k, target, i, t.v - o.v AS v FROM o JOIN (SELECT target, i, sum(v) AS v FROM o GROUP BY ALL) t USING (target, i)"
    define(gram, own)
    define(sums_, f"SELECT *, dense_rank() OVER (ORDER BY target) AS c FROM ({own_y})")
    define(
        aug,
        f"""WITH m AS (SELECT k, j AS i, v AS s FROM {gram} WHERE i = 0), n AS (SELECT k, s AS n FROM m WHERE i = 0 AND s >= 2),
z AS (SELECT k, i, s, n, sqrt((v - s*s/n)/n) AS sd FROM m JOIN n USING (k) JOIN {gram} g USING (k, i) WHERE g.i = g.j AND i > 0),
e AS (SELECT g.k, g.i, g.j, (v - a.s*b.s/a.n)/(a.sd*b.sd) + CASE WHEN g.i = g.j THEN {ALPHA} ELSE 0 END AS v FROM {gram} g JOIN z a ON a.k = g.k AND a.i = g.i JOIN z b ON b.k = g.k AND b.i = g.j
UNION ALL SELECT y.k, y.i, {d} + y.c, (y.v - z.s*t.v/z.n)/z.sd FROM {sums_} y JOIN z ON z.k = y.k AND z.i = y.i JOIN {sums_} t ON t.k = y.k AND t.c = y.c AND t.i = 0)
SELECT e.k, e.i, any_value(s) AS s, any_value(n) AS n, any_value(sd) AS sd, list(v ORDER BY j) AS r FROM e JOIN z ON z.k = e.k AND z.i = e.i GROUP BY e.k, e.i""",
    )
    define(
        weights,
        f"""WITH RECURSIVE gj AS (SELECT 1 AS p, k, i, r FROM {aug} UNION ALL
SELECT p + 1, k, i, CASE WHEN i = p THEN list_transform(r, lambda u: u / q) ELSE list_transform(list_zip(r, pr), lambda u: u[1] - c / q * u[2]) END
FROM (SELECT a.p, a.k, a.i, a.r, b.r AS pr, a.r[a.p] AS c, b.r[a.p] AS q FROM gj a JOIN gj b ON a.k = b.k AND b.i = b.p WHERE a.p <= {d})),
t AS (SELECT DISTINCT target, c FROM {sums_})
SELECT gj.k, gj.i, target, gj.r[{d} + c] / sd AS w FROM gj JOIN {aug} u ON u.k = gj.k AND u.i = gj.i CROSS JOIN t WHERE p = {d + 1}
UNION ALL SELECT gj.k, 0, t.target, any_value(y.v) / any_value(n) - sum(gj.r[{d} + t.c] / sd * s / n) FROM gj JOIN {aug} u ON u.k = gj.k AND u.i = gj.i CROSS JOIN t
JOIN {sums_} y ON y.k = gj.k AND y.c = t.c AND y.i = 0 WHERE p = {d + 1} GROUP BY gj.k, t.target""",
    )
    define(f"all_{name}", f"SELECT x.k, sample_id, spot_id, target, sum(w * x) AS prediction FROM {x} x JOIN {weights} w USING (k, i) GROUP BY ALL")


define("wide_y", "SELECT sample_id, spot_id, '' AS target, y FROM two_features")
_define_ridge("ridge", "features", "'all'", "wide_y", "spot_id % 5 < 4", leave_out=False)
define("ridge_scored_all", "SELECT 'ridge' AS baseline, prediction AS pred_log_sf, y AS true_log_sf FROM all_ridge JOIN wide_y USING (sample_id, spot_id, target) WHERE spot_id % 5 = 4")
_RIDGE_ALL_SQL = f"SELECT *, cast({ALPHA} AS double) AS alpha FROM ({sf_sql('baseline', 'ridge_scored_all')})"


def _train_test_all(v: Views):
    d = v.regression.withColumn("fold", F.col("spot_id") % 5)
    return d.filter("fold < 4"), d.filter("fold = 4")


@query("M1_ridge_all_features", _RIDGE_ALL_SQL, SF)
def _(v: Views):
    return linear.ridge_baseline(*_train_test_all(v))


@query("M3_baseline_table_all_features", f"{_RIDGE_ALL_SQL} UNION ALL SELECT *, NULL FROM ({sf_sql('baseline', 'constant_scored')})", SF)
def _(v: Views):
    return linear.baseline_table(*_train_test_all(v))


WEIGHTS = [0.5, -0.25, 2.0, 1.0] + [0.0] * 60


@query(
    "M2_linear_scores",
    f"SELECT sample_id, spot_id, 0.1 + {' + '.join(f'({w}::double) * features[{i + 1}]::double' for i, w in enumerate(WEIGHTS[:4]))} AS prediction FROM features",
    "prediction",
)
def _(v: Views):
    model = v.spark.createDataFrame([(0.1, WEIGHTS)], "intercept double, weights array<double>")
    return linear.score(v.features, model, []).select("sample_id", "spot_id", "prediction")


@query("M3_baseline_table", f"{_RIDGE_SQL} UNION ALL SELECT *, NULL FROM ({sf_sql('baseline', 'constant_scored')})", SF)
def _(v: Views):
    return linear.baseline_table(*_train_test(v))


def gene_rows(v: Views, every_feature: bool = False):
    """Vectors stand for spots of the sample of their label, several per spot (see FIXTURES.md); all genes that every one of those
    samples measured are targets."""
    f = (v.regression if every_feature else _two(v)).withColumn("cell", F.col("spot_id") % 72).drop("y", "x", "y")
    sf = v.sf.filter("valid").select("sample_id", F.col("spot_id").alias("cell"), "sf", "log_sf")
    d = materialise(f.join(sf, ["sample_id", "cell"]).join(v.samples.select("sample_id", "organ", "cohort"), "sample_id"))
    have = d.select("sample_id").distinct()
    n = have.agg(F.count(F.lit(1)).alias("_n"))
    common = v.sample_genes.join(have, "sample_id").groupBy("gene").agg(F.count(F.lit(1)).alias("c")).crossJoin(n).filter("c = _n").select("gene")
    c = v.counts.join(common, "gene", "left_semi").withColumnRenamed("spot_id", "cell")
    y = F.log1p(F.col("count") / F.greatest("sf", F.lit(1e-6)))
    return d, materialise(d.join(c, ["sample_id", "cell"]).select("sample_id", "spot_id", F.col("gene").alias("target"), y.alias("y")))


define("gene_base", "SELECT t.sample_id, t.spot_id, x1, x2, s.spot_id AS cell, sf, log_sf, organ, cohort FROM two_features t JOIN sf_t s ON s.sample_id = t.sample_id AND s.spot_id = t.spot_id % 72 AND s.valid JOIN samples p ON p.sample_id = t.sample_id")
define("gene_common", "SELECT gene FROM sample_genes WHERE sample_id IN (SELECT sample_id FROM gene_base) GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT sample_id) FROM gene_base)")
define(
    "gene_long",
    """SELECT b.*, '' AS gene, log_sf AS y FROM gene_base b UNION ALL
SELECT b.*, g.gene, ln(1 + coalesce(c.count, 0) / greatest(sf, 1e-6)) FROM gene_base b CROSS JOIN gene_common g
LEFT JOIN counts c ON c.sample_id = b.sample_id AND c.spot_id = b.cell AND c.gene = g.gene""",
)


def _loo_sql(key: str, table: str, target: str) -> str:
    parts = ("n", "a", "b", "y", "aa", "bb", "ab", "ay", "by_")
    less = ", ".join(f"t.{c} - o.{c} AS {c}" for c in parts)
    own = f"(SELECT {key}, {target}, {_sums()} FROM {table} GROUP BY ALL)"
    whole = f"(SELECT {target}, {', '.join(f'sum({c}) AS {c}' for c in parts)} FROM {own} GROUP BY ALL)"
    train = f"(SELECT o.{key}, o.{target}, {less} FROM {own} o JOIN {whole} t USING ({target}))"
    return f"SELECT l.*, w0 + w1*x1 + w2*x2 AS prediction FROM {table} l JOIN {_solved(f'{key}, {target}', train)} USING ({key}, {target})"


def _define_leave_out(loo: str, key: str) -> str:
    """The results of the three stages from the view `loo` of predictions per row and gene ('' is the size factor)."""
    sf, counts = f"{loo}_sf", f"{loo}_counts"
    define(sf, f"SELECT {key}, spot_id, sample_id, prediction AS pred_log_sf, y AS true_log_sf FROM {loo} WHERE gene = ''")
    define(
        counts,
        f"""SELECT l.{key}, l.gene, greatest(exp(l.prediction) - 1, 0) * e AS pred, (exp(l.y) - 1) * exp(l.log_sf) AS true_ FROM {loo} l
JOIN (SELECT sample_id, spot_id, exp(pred_log_sf) / (avg(exp(pred_log_sf)) OVER (PARTITION BY {key}) + 1e-8) AS e FROM {sf}) USING (sample_id, spot_id) WHERE gene <> ''""",
    )
    mean = lambda source, p, t: f"SELECT k, avg({PEARSON}) AS v FROM (SELECT {key} AS k, gene, {sums(p, t)} FROM {source} WHERE gene <> '' GROUP BY ALL) GROUP BY k"
    return f"""WITH r AS (SELECT {key} AS k, 'sf' AS stage, 'log_sf_pearson' AS metric, log_sf_pearson AS v FROM ({sf_sql(key, sf)})
UNION ALL SELECT k, 'expression', 'mean_gene_pearson', v FROM ({mean(loo, 'prediction', 'y')})
UNION ALL SELECT k, 'combined', 'count_pred_sf_mean_gene_pearson', v FROM ({mean(counts, 'pred', 'true_')}))
SELECT h AS heldout, s AS stage, CASE WHEN metric IS NULL THEN 'missing_model' ELSE 'ok' END AS status, metric, v AS value
FROM (SELECT DISTINCT {key} AS h FROM gene_base) CROSS JOIN (VALUES ('sf'), ('expression'), ('combined')) t(s) LEFT JOIN r ON k = h AND stage = s"""


define("gene_targets", "SELECT sample_id, spot_id, gene AS target, y FROM gene_long")
define("gene_features", "SELECT b.*, f.features FROM gene_base b JOIN features f USING (sample_id, spot_id)")
LEAVE_OUT_ALL: dict[str, str] = {}  # SQL of the results over all features, by key

for _name, _key in (("group", "sample_id"), ("organ", "organ"), ("cohort", "cohort")):
    define(f"loo_{_key}", _loo_sql(_key, "gene_long", "gene"))

    @query(f"M4_leave_{_name}_out", _define_leave_out(f"loo_{_key}", _key), "value")
    def _(v: Views, key: str = _key):
        return linear.generalization_rows(*_gene_args(v, key))

    _define_ridge(f"by_{_key}", "gene_features", _key, "gene_targets")
    define(f"wide_loo_{_key}", f"SELECT g.*, a.prediction FROM gene_long g JOIN all_by_{_key} a ON a.sample_id = g.sample_id AND a.spot_id = g.spot_id AND a.target = g.gene")
    LEAVE_OUT_ALL[_key] = _define_leave_out(f"wide_loo_{_key}", _key)

    @query(f"M4_leave_{_name}_out_all_features", LEAVE_OUT_ALL[_key], "value")
    def _(v: Views, key: str = _key):
        return heldout_rows(v, key)


def heldout_rows(v: Views, key: str):
    """Results of models over all features, each fitted without one label."""
    d, genes = gene_rows(v, every_feature=True)
    return linear.generalization_rows(d, key, genes)


def _gene_args(v: Views, key: str):
    d, genes = gene_rows(v)
    return d, key, genes


_FOLD_ROWS = ("SELECT f.*, cast(fold AS varchar) AS fold FROM two_features f JOIN feature_folds USING (sample_id)")
define(
    "feature_folds",
    """SELECT sample_id, CASE WHEN (i // 4) % 2 = 0 THEN i % 4 ELSE 3 - i % 4 END AS fold
FROM (SELECT sample_id, row_number() OVER (ORDER BY count(*) DESC, sample_id) - 1 AS i FROM features GROUP BY sample_id)""",
)


define("fold_rows", _FOLD_ROWS)


@query(
    "M5_crossfit_predictions",
    f"SELECT sample_id, spot_id, fold, prediction, y AS truth FROM ({_loo_sql('fold', '(SELECT *, 1 AS one FROM fold_rows)', 'one')})",
    "prediction truth",
)
def _(v: Views):
    folds = group_folds(_two(v), "sample_id", 4).withColumn("fold", F.col("fold").cast("string"))
    targets = folds.select("sample_id", "spot_id", F.lit("y").alias("target"), "y")
    return linear.leave_group_out_scores(folds, targets, "fold").select("sample_id", "spot_id", "fold", "prediction", "truth")


_define_ridge("by_fold", "(SELECT f.*, fold FROM features f JOIN feature_folds USING (sample_id))", "fold", "wide_y")


@query(
    "M5_crossfit_predictions_all_features",
    "SELECT a.sample_id, a.spot_id, a.k AS fold, prediction, y AS truth FROM all_by_fold a JOIN wide_y USING (sample_id, spot_id)",
    "prediction truth",
)
def _(v: Views):
    folds = group_folds(v.regression, "sample_id", 4).withColumn("fold", F.col("fold").cast("string"))
    targets = folds.select("sample_id", "spot_id", F.lit("y").alias("target"), "y")
    return linear.leave_group_out_scores(folds, targets, "fold").select("sample_id", "spot_id", "fold", "prediction", "truth")


# --- streams -----------------------------------------------------------------------------------------------------------


def _event_state(v: Views, labelled: bool = False):
    schema = v.table("events").schema
    s = accumulators.read_pairs_stream(v.spark, v.path, schema, "events.parquet")
    pairs = s.select(
        F.col("user_id").cast("string").alias("sample_id"), F.col("event_type").alias("gene"), F.col("value").alias("pred"),
        F.get_json_object("props", "$.k").cast("double").alias("true"),
    )
    if labelled:
        return accumulators.accumulate_stream(accumulators.with_labels(pairs, v.samples, ["organ"]), [*accumulators.KEYS, "organ"])
    return accumulators.accumulate_stream(pairs)


define(
    "event_pairs",
    "SELECT cast(user_id AS varchar) AS sample_id, event_type AS gene, value AS pred, cast(json_extract_string(props, '$.k') AS double) AS true_ FROM events",
)


@query("T1_stream_gene_metrics", f"SELECT gene, {metrics('n_obs', True)} FROM (SELECT gene, {sums()} FROM event_pairs GROUP BY gene)", GENE_DOUBLES)
def _(v: Views):
    return accumulators.gene_metrics_of(_event_state(v))


@query(
    "T2_stream_levels",
    f"""SELECT 'overall' AS level, NULL AS gene, NULL AS sample_id, {metrics('n_values')} FROM (SELECT {sums()} FROM event_pairs)
UNION ALL SELECT 'gene', gene, NULL, {metrics('n_values')} FROM (SELECT gene, {sums()} FROM event_pairs GROUP BY gene)
UNION ALL SELECT 'slide', NULL, sample_id, {metrics('n_values')} FROM (SELECT sample_id, {sums()} FROM event_pairs GROUP BY sample_id)""",
    METRIC_DOUBLES,
)
def _(v: Views):
    return accumulators.level_metrics_of(_event_state(v))


_EVENT_LEVELS = {"overall": None, "gene": "gene", "slide": "sample_id", "organ": "organ"}


@query(
    "T2_stream_organ_levels",
    "WITH e AS (SELECT event_pairs.*, organ FROM event_pairs LEFT JOIN samples USING (sample_id)) "
    + " UNION ALL ".join(
        f"SELECT '{level}' AS level, {', '.join(c if c == by else f'NULL AS {c}' for c in ('gene', 'sample_id', 'organ'))}, {metrics('n_values')} "
        f"FROM (SELECT {f'{by}, ' if by else ''}{sums()} FROM e {'WHERE organ IS NOT NULL' if by == 'organ' else ''} {f'GROUP BY {by}' if by else ''})"
        for level, by in _EVENT_LEVELS.items()
    ),
    METRIC_DOUBLES,
)
def _(v: Views):
    return accumulators.level_metrics_of(_event_state(v, labelled=True))
