"""Gene sets, cell-type composition, states."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from spotweave.operators import composition as comp
from spotweave.operators import genesets as op
from spotweave.operators import states
from spotweave.plans.base_sql import METRIC_DOUBLES, PEARSON, define, metrics, sums
from spotweave.plans.registry import query
from spotweave.sources.views import Views

_COVER = """SELECT signature, count(*) AS n_target_genes, count(g.gene) AS n_present_genes,
  coalesce(string_agg(s.gene, '|' ORDER BY position) FILTER (g.gene IS NOT NULL), '') AS present_genes,
  coalesce(string_agg(s.gene, '|' ORDER BY position) FILTER (g.gene IS NULL), '') AS missing_genes
FROM {sets} s LEFT JOIN genes g ON g.gene = s.gene GROUP BY signature"""
define("coverage", _COVER.format(sets="gene_sets"))
define(
    "score_rows",
    """SELECT sample_id, spot_id, signature, valid, 'rate' AS metric_kind, rate_pred AS pred, rate_true AS true_ FROM spot_scores
UNION ALL SELECT sample_id, spot_id, signature, valid, 'count_pred_sf', count_pred_sf_pred, count_pred_sf_true FROM spot_scores""",
)


@query("N1_set_coverage", "SELECT * FROM coverage")
def _(v: Views):
    return op.set_coverage(v.gene_sets, v.genes)


@query("N2_set_scores", "SELECT sample_id, spot_id, signature, rate_true AS score, valid FROM spot_scores", "score")
def _(v: Views):
    """From sparse counts; the oracle averages dense rows."""
    return op.sparse_set_scores(v.counts, v.sf, v.gene_sets, v.sample_genes)


@query(
    "N3_spot_scores",
    """SELECT sample_id, spot_id, signature, rate_true, rate_pred, count_pred_sf_true, count_pred_sf_pred, valid AS rate_valid,
  valid AS count_pred_sf_valid FROM spot_scores""",
    "rate_true rate_pred count_pred_sf_true count_pred_sf_pred",
)
def _(v: Views):
    return op.spot_scores(v.ablation_cells, v.gene_sets, v.sample_genes)


def _fidelity(rows: str, cover: str) -> str:
    parts = []
    for level, key in (("overall", ""), ("organ", ", organ"), ("slide", ", sample_id")):
        o = "organ" if level == "organ" else "NULL AS organ"
        i = "sample_id" if level == "slide" else "NULL AS sample_id"
        parts.append(
            f"SELECT '{level}' AS level, metric_kind, signature, {o}, {i}, {metrics('n_spots')} FROM (SELECT metric_kind, signature{key}, "
            f"{sums()} FROM {rows} JOIN samples USING (sample_id) WHERE valid GROUP BY metric_kind, signature{key})"
        )
    return f"SELECT f.*, c.* EXCLUDE (signature) FROM ({' UNION ALL '.join(parts)}) f LEFT JOIN {cover} c USING (signature)"


@query("N4_set_fidelity", _fidelity("score_rows", "coverage"), METRIC_DOUBLES)
def _(v: Views):
    return op.set_fidelity(v.spot_scores, v.samples, op.set_coverage(v.gene_sets, v.genes)).filter("n_spots > 0")


define("module_coverage", _COVER.format(sets="modules"))
define(
    "module_scores",
    """WITH s AS (SELECT a.sample_id, a.spot_id, g.signature, count(*) >= 4 AS valid, avg(ln(1 + true_rate)) AS rt, avg(ln(1 + pred_rate)) AS rp,
  avg(ln(1 + true_count)) AS ct, avg(ln(1 + pred_rate * pred_sf)) AS cp FROM ablation_cells a JOIN modules g USING (gene) GROUP BY ALL)
SELECT sample_id, spot_id, signature, valid, 'rate' AS metric_kind, rp AS pred, rt AS true_ FROM s
UNION ALL SELECT sample_id, spot_id, signature, valid, 'count_pred_sf', cp, ct FROM s""",
)


@query("N5_module_fidelity", _fidelity("module_scores", "module_coverage"), METRIC_DOUBLES)
def _(v: Views):
    scores = op.spot_scores(v.ablation_cells, v.modules, v.sample_genes, min_genes=4)
    return op.set_fidelity(scores, v.samples, op.set_coverage(v.modules, v.genes)).filter("n_spots > 0")


@query(
    "N6_overlay_picks",
    f"""WITH b AS (SELECT signature, {PEARSON} AS r FROM (SELECT signature, {sums()} FROM score_rows WHERE valid AND metric_kind = 'rate' GROUP BY signature)
  ORDER BY r DESC NULLS LAST, signature LIMIT 3),
s AS (SELECT DISTINCT sample_id FROM spot_scores ORDER BY sample_id LIMIT 3)
SELECT sample_id, signature, count(CASE WHEN valid THEN 1 END) AS n_valid, count(CASE WHEN valid THEN 1 END) >= 3 AS drawable
FROM spot_scores JOIN b USING (signature) JOIN s USING (sample_id) GROUP BY ALL""",
)
def _(v: Views):
    f = op.set_fidelity(v.spot_scores, v.samples, op.set_coverage(v.gene_sets, v.genes))
    return op.overlay_picks(f, v.spot_scores, 3, 3)


# --- cell-type composition ------------------------------------------------------------------------------------------

define(
    "cases",
    """WITH r AS (SELECT s.sample_id, s.spot_id, m.cell_type AS name, s.valid, s.rate_true AS t, s.rate_pred AS p FROM spot_scores s JOIN cell_type_map m USING (signature))
SELECT * FROM (SELECT *, count(CASE WHEN valid THEN 1 END) OVER (PARTITION BY sample_id, spot_id) AS k FROM r)
WHERE k = (SELECT count(DISTINCT name) FROM r)""",
)
define(
    "case_z",
    """SELECT sample_id, spot_id, name, (t - m) / s AS t, (p - m) / s AS p FROM cases
JOIN (SELECT name, avg(t) AS m, CASE WHEN stddev_pop(t) < 1e-6 THEN 1.0 ELSE stddev_pop(t) END AS s FROM cases GROUP BY name) USING (name)""",
)
define(
    "fractions",
    """SELECT sample_id, spot_id, name, exp(t) / sum(exp(t)) OVER w AS true_, exp(p) / sum(exp(p)) OVER w AS pred FROM case_z
WINDOW w AS (PARTITION BY sample_id, spot_id)""",
)
define(
    "dominants",
    """SELECT sample_id, spot_id, first(name ORDER BY true_ DESC, name) AS true_label, first(name ORDER BY pred DESC, name) AS pred_label
FROM fractions GROUP BY sample_id, spot_id""",
)
TYPES = ["type_a", "type_b", "type_c", "type_d"]


def _cases(v: Views):
    return comp.complete_cases(op.scores_of_kind(v.spot_scores, "rate"), v.cell_type_map.select("signature", "cell_type"), "cell_type")


def _fractions(v: Views):
    return v.stored(comp.softmax_fractions(comp.zscores_from_true(v.stored(_cases(v)), "cell_type"), "cell_type"))


@query("S8_cell_type_coverage", """SELECT cell_type, signature, s IS NOT NULL AS used, CASE WHEN s IS NULL THEN 'signature_score_missing' ELSE '' END AS reason
FROM cell_type_map LEFT JOIN (SELECT DISTINCT signature AS s FROM spot_scores) ON s = signature""")
def _(v: Views):
    from spotweave.sources.tables import clean_cell_type_map

    noisy = v.cell_type_map.unionByName(v.cell_type_map.withColumn("cell_type", F.concat(F.lit(" "), "cell_type")))
    return comp.mapping_coverage(clean_cell_type_map(noisy), v.spot_scores)


@query("C1_complete_cases", "SELECT sample_id, spot_id, name AS cell_type, t AS true_score, p AS pred_score FROM cases", "true_score pred_score")
def _(v: Views):
    return _cases(v).withColumnsRenamed({"true": "true_score", "pred": "pred_score"})


@query("C2_zscores", "SELECT sample_id, spot_id, name AS cell_type, t AS true_z, p AS pred_z FROM case_z", "true_z pred_z")
def _(v: Views):
    return comp.zscores_from_true(v.stored(_cases(v)), "cell_type").withColumnsRenamed({"true": "true_z", "pred": "pred_z"})


@query("C3_softmax_fractions", "SELECT sample_id, spot_id, name AS cell_type, true_ AS true_fraction, pred AS pred_fraction FROM fractions", "true_fraction pred_fraction")
def _(v: Views):
    return _fractions(v).withColumnsRenamed({"true": "true_fraction", "pred": "pred_fraction"})


@query("C4_dominant_type", "SELECT * FROM dominants")
def _(v: Views):
    return comp.dominant(_fractions(v), "cell_type")


def _fm(prefix: str, rows: str) -> str:
    g = lambda c: f"CASE WHEN n >= 3 THEN {c} END"
    return f"""SELECT name, CASE WHEN n >= 3 THEN n ELSE 0 END AS {prefix}_n, {g(PEARSON)} AS {prefix}_fraction_pearson, {g('sae/n')} AS {prefix}_fraction_mae,
  {g('sqrt(sse/n)')} AS {prefix}_fraction_rmse, {g('st/n')} AS {prefix}_true_mean_fraction, {g('sp/n')} AS {prefix}_pred_mean_fraction
FROM (SELECT name, {sums()} FROM {rows} GROUP BY name)"""


_SLIDE = "(SELECT sample_id, name, avg(true_) AS true_, avg(pred) AS pred FROM fractions GROUP BY ALL)"
_FM = f"SELECT s.name AS cell_type, s.* EXCLUDE (name), l.* EXCLUDE (name) FROM ({_fm('spot', 'fractions')}) s JOIN ({_fm('slide', _SLIDE)}) l USING (name)"
FM_DOUBLES = " ".join(f"{p}_{m}" for p in ("spot", "slide") for m in ("fraction_pearson", "fraction_mae", "fraction_rmse", "true_mean_fraction", "pred_mean_fraction"))


@query("C5_fraction_metrics", _FM, FM_DOUBLES)
def _(v: Views):
    return comp.fraction_metrics(_fractions(v), "cell_type")


@query(
    "C6_slide_fractions",
    "SELECT sample_id, max(c) AS n_spots, "
    + ", ".join(f"max(CASE WHEN name='{t}' THEN true_ END) AS true_{t}, max(CASE WHEN name='{t}' THEN pred END) AS pred_{t}, max(CASE WHEN name='{t}' THEN pred - true_ END) AS delta_{t}" for t in TYPES)
    + " FROM (SELECT sample_id, name, avg(true_) AS true_, avg(pred) AS pred, count(*) AS c FROM fractions GROUP BY ALL) GROUP BY sample_id",
    " ".join(f"true_{t} pred_{t} delta_{t}" for t in TYPES),
)
def _(v: Views):
    return comp.slide_table(_fractions(v), "cell_type", TYPES)


@query(
    "C7_spot_fractions",
    "SELECT sample_id, spot_id, d.true_label AS true_dominant, d.pred_label AS pred_dominant, "
    + ", ".join(f"max(CASE WHEN name='{t}' THEN true_ END) AS true_fraction_{t}, max(CASE WHEN name='{t}' THEN pred END) AS pred_fraction_{t}" for t in TYPES)
    + " FROM fractions JOIN dominants d USING (sample_id, spot_id) GROUP BY ALL",
    " ".join(f"true_fraction_{t} pred_fraction_{t}" for t in TYPES),
)
def _(v: Views):
    f = _fractions(v)
    return comp.spot_table(f, comp.dominant(f, "cell_type"), "cell_type", TYPES)


@query(
    "C8_confusion",
    """SELECT a.t AS true_label, b.t AS pred_label, count(d.spot_id) AS n_spots FROM (SELECT DISTINCT name AS t FROM cases) a JOIN (SELECT DISTINCT name AS t FROM cases) b ON true
LEFT JOIN dominants d ON d.true_label = a.t AND d.pred_label = b.t GROUP BY ALL""",
)
def _(v: Views):
    f = _fractions(v)
    return comp.confusion(comp.dominant(f, "cell_type"), values=f.select(F.col("cell_type").alias("label")).distinct())


def agreement_sql(rows: str, keys: str = "") -> str:
    """Accuracy, macro F1, ARI and NMI of (true_label, pred_label) rows."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    return f"""(WITH c AS (SELECT {k}true_label, pred_label, count(*) AS n FROM {rows} GROUP BY ALL),
m AS (SELECT *, sum(n) OVER ({part}) AS t, sum(n) OVER (PARTITION BY {k}true_label) AS a, sum(n) OVER (PARTITION BY {k}pred_label) AS b FROM c),
pa AS (SELECT {k}sum(a*(a-1)/2.0) AS pa, -sum(a/t*ln(a/t)) AS ha FROM (SELECT DISTINCT {k}true_label, a, t FROM m) {g}),
pb AS (SELECT {k}sum(b*(b-1)/2.0) AS pb, -sum(b/t*ln(b/t)) AS hb FROM (SELECT DISTINCT {k}pred_label, b, t FROM m) {g}),
pc AS (SELECT {k}max(t)::bigint AS n_spots, sum(n*(n-1)/2.0) AS pc, sum(n/t*ln(n*t/(a*b))) AS mi, coalesce(sum(n) FILTER (true_label = pred_label), 0)/max(t) AS accuracy FROM m {g}),
lab AS (SELECT {k}true_label AS l FROM c UNION SELECT {k}pred_label FROM c),
f AS (SELECT {k}avg(2.0*coalesce(tp, 0)/(coalesce(a, 0)+coalesce(b, 0))) AS macro_f1 FROM lab
  LEFT JOIN (SELECT {k}true_label AS l, sum(n) AS a, sum(n) FILTER (true_label = pred_label) AS tp FROM c GROUP BY {k}true_label) x USING ({k}l)
  LEFT JOIN (SELECT {k}pred_label AS l, sum(n) AS b FROM c GROUP BY {k}pred_label) y USING ({k}l) {g})
SELECT {k}n_spots, accuracy, macro_f1,
  CASE WHEN n_spots < 2 OR (pa+pb)/2 = pa*pb/(n_spots*(n_spots-1)/2.0) THEN 1.0 ELSE (pc - pa*pb/(n_spots*(n_spots-1)/2.0)) / ((pa+pb)/2 - pa*pb/(n_spots*(n_spots-1)/2.0)) END AS adjusted_rand,
  CASE WHEN (ha+hb)/2 <= 1e-12 THEN 1.0 ELSE greatest(mi, 0)/((ha+hb)/2) END AS normalized_mutual_info
FROM pa JOIN pb {using} JOIN pc {using} JOIN f {using})"""


@query(
    "C9_composition_overall",
    f"""SELECT m.*, a.n_spots, a.accuracy AS dominant_accuracy, a.macro_f1 AS dominant_macro_f1, a.adjusted_rand AS dominant_adjusted_rand, a.normalized_mutual_info AS dominant_nmi
FROM (SELECT count(*) AS n_cell_types, avg(spot_fraction_pearson) AS mean_spot_fraction_pearson, median(spot_fraction_pearson) AS median_spot_fraction_pearson,
 avg(slide_fraction_pearson) AS mean_slide_fraction_pearson, median(slide_fraction_pearson) AS median_slide_fraction_pearson FROM ({_FM})) m, {agreement_sql('dominants')} a""",
    "mean_spot_fraction_pearson median_spot_fraction_pearson mean_slide_fraction_pearson median_slide_fraction_pearson dominant_accuracy dominant_macro_f1 dominant_adjusted_rand dominant_nmi",
)
def _(v: Views):
    f = _fractions(v)
    agree = comp.agreement(comp.confusion(comp.dominant(f, "cell_type")))
    return comp.composition_overall(comp.fraction_metrics(f, "cell_type"), agree)


# --- states -----------------------------------------------------------------------------------------------------------

AG = "accuracy macro_f1 adjusted_rand normalized_mutual_info"


@query("K3_cluster_agreement", f"SELECT * FROM {agreement_sql('label_pairs')}", AG)
def _(v: Views):
    return comp.agreement(comp.confusion(v.label_pairs))


define(
    "doc_states",
    """SELECT doc_id, lang AS grp, cast(CASE WHEN n_chars < 400 THEN 0 WHEN n_chars < 900 THEN 1 WHEN n_chars < 2000 THEN 2 ELSE 3 END AS int) AS true_label,
  cast(length(source) * 7 + n_chars % 3 AS int) % 4 AS pred_label FROM documents""",
)


def _doc_states(v: Views):
    n = F.col("n_chars")
    return v.table("documents").select(
        "doc_id", F.col("lang").alias("grp"), F.when(n < 400, 0).when(n < 900, 1).when(n < 2000, 2).otherwise(3).alias("true_label"),
        ((F.length("source") * 7 + n % 3).cast("int") % 4).alias("pred_label"),
    )


_PERMS = ", ".join("(" + ", ".join(map(str, p)) + ")" for p in permutations(range(4)))


def _match_sql(keys: str = "", table: str = "doc_states") -> str:
    k = f"{keys}, " if keys else ""
    hit = " OR ".join(f"(true_label = {i} AND pred_label = p.p{i})" for i in range(4))
    return f"""SELECT {k}any_value(t) AS n_spots, max(h) / any_value(t) AS best_match_accuracy FROM (SELECT {k}p0, p1, p2, p3, count(*) AS t, count(CASE WHEN {hit} THEN 1 END) AS h
FROM {table}, (VALUES {_PERMS}) p(p0, p1, p2, p3) GROUP BY {k}p0, p1, p2, p3) {'GROUP BY ' + keys if keys else ''}"""


@query("K4_best_match_accuracy", _match_sql("grp"), "best_match_accuracy")
def _(v: Views):
    return states.best_match(comp.confusion(_doc_states(v), ["grp"]), 4, ["grp"])


@query(
    "K5_grouped_agreement",
    f"SELECT a.grp, a.n_spots, adjusted_rand, normalized_mutual_info, best_match_accuracy FROM {agreement_sql('doc_states', 'grp')} a JOIN ({_match_sql('grp')}) b USING (grp)",
    "adjusted_rand normalized_mutual_info best_match_accuracy",
)
def _(v: Views):
    return states.state_fidelity(_doc_states(v), 4, ["grp"])


def _z(v: Views):
    names = v.gene_sets.select("signature").distinct().filter("signature NOT IN ('set_e', 'set_f')").withColumn("name", F.col("signature"))
    cases = v.stored(comp.complete_cases(op.scores_of_kind(v.spot_scores, "rate"), names, "name"))
    return comp.zscores_from_true(cases, "name")


define(
    "state_z",
    """WITH r AS (SELECT sample_id, spot_id, signature AS name, valid, rate_true AS t, rate_pred AS p FROM spot_scores WHERE signature NOT IN ('set_e', 'set_f')),
c AS (SELECT * FROM (SELECT *, count(CASE WHEN valid THEN 1 END) OVER (PARTITION BY sample_id, spot_id) AS k FROM r) WHERE k = (SELECT count(DISTINCT name) FROM r))
SELECT sample_id, spot_id, name, (t - m) / s AS t, (p - m) / s AS p FROM c
JOIN (SELECT name, avg(t) AS m, CASE WHEN stddev_pop(t) < 1e-6 THEN 1.0 ELSE stddev_pop(t) END AS s FROM c GROUP BY name) USING (name)""",
)


@query(
    "K1_state_vectors",
    """SELECT sample_id, spot_id, t[1] AS t0, t[2] AS t1, t[3] AS t2, t[4] AS t3, p[1] AS p0, p[2] AS p1, p[3] AS p2, p[4] AS p3, len(t) AS n
FROM (SELECT sample_id, spot_id, list(t ORDER BY name) AS t, list(p ORDER BY name) AS p FROM state_z GROUP BY ALL)""",
    "t0 t1 t2 t3 p0 p1 p2 p3",
)
def _(v: Views):
    d = states.vectors(_z(v), "name")
    entries = [F.col(f"{side}_z")[i].alias(f"{side[0]}{i}") for side in ("true", "pred") for i in range(4)]
    return d.select("sample_id", "spot_id", *entries, F.size("true_z").cast("long").alias("n"))


ROUNDS = 6


def _lloyd_sql() -> str:
    """Lloyd's rounds written out: centres c0, c1, … from the rows with the lowest hashes, and the labels of the last."""
    m = ["m1", "m2", "m3", "m4"]
    near = lambda side, c: f"(SELECT sample_id, spot_id, t, arg_min(label, ({' + '.join(f'({side}[{i}] - {x})^2' for i, x in enumerate(m, 1))}, label)) AS label FROM v, {c} GROUP BY ALL)"
    out = [
        "v AS MATERIALIZED (SELECT sample_id, spot_id, list(t ORDER BY name) AS t, list(p ORDER BY name) AS p FROM state_z GROUP BY ALL)",
        "c0 AS MATERIALIZED (SELECT cast(row_number() OVER (ORDER BY h, sample_id, spot_id) - 1 AS int) AS label, "
        + ", ".join(f"t[{i}] AS {x}" for i, x in enumerate(m, 1))
        + " FROM (SELECT *, sha1('2026|' || sample_id || '|' || spot_id) AS h FROM v ORDER BY h, sample_id, spot_id LIMIT 4))",
    ]
    for r in range(ROUNDS):
        means = ", ".join(f"coalesce(avg(t[{i}]), any_value({x})) AS {x}" for i, x in enumerate(m, 1))
        out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.label, {means} FROM c{r} c LEFT JOIN {near('t', f'c{r}')} a USING (label) GROUP BY c.label)")
    return "WITH " + ", ".join(out) + f"""
SELECT a.sample_id, a.spot_id, a.label AS true_label, b.label AS pred_label FROM {near('t', f'c{ROUNDS}')} a JOIN {near('p', f'c{ROUNDS}')} b USING (sample_id, spot_id)"""


define("lloyd_labels", _lloyd_sql())


def _lloyd(v: Views):
    if not hasattr(v, "_lloyd"):
        vecs = v.stored(states.vectors(_z(v), "name"))
        v._lloyd = v.stored(states.assign_states(vecs, states.fit_centres(vecs, 4, max_iter=ROUNDS, tol=-1.0)))
    return v._lloyd


@query(
    "K2_kmeans_states",
    f"SELECT a.n_spots, adjusted_rand, normalized_mutual_info, best_match_accuracy FROM ({agreement_sql('lloyd_labels')}) a, ({_match_sql('', 'lloyd_labels')}) b",
    "adjusted_rand normalized_mutual_info best_match_accuracy",
)
def _(v: Views):
    return states.state_fidelity(_lloyd(v), 4)


for _level in ("sample_id", "organ", "cohort"):
    define(f"lloyd_by_{_level}", f"SELECT l.*, {'l' if _level == 'sample_id' else 's'}.{_level} AS grp FROM lloyd_labels l JOIN samples s USING (sample_id)")

    @query(
        f"K5_states_by_{_level}",
        f"""SELECT a.grp AS {_level}, a.n_spots, adjusted_rand, normalized_mutual_info, best_match_accuracy FROM {agreement_sql(f'lloyd_by_{_level}', 'grp')} a
JOIN ({_match_sql('grp', f'lloyd_by_{_level}')}) b USING (grp)""",
        "adjusted_rand normalized_mutual_info best_match_accuracy",
    )
    def _(v: Views, level: str = _level):
        labels = _lloyd(v) if level == "sample_id" else _lloyd(v).join(v.samples.select("sample_id", level), "sample_id")
        return states.state_fidelity(labels, 4, [level])


FIXED_CENTRES = [[1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, -0.5], [-0.5, -0.5, 0.5, 0.5], [0.0, 0.0, -1.0, 0.5]]
_dist = lambda side, c: f"(({side}[1]-({c[0]}))^2+({side}[2]-({c[1]}))^2+({side}[3]-({c[2]}))^2+({side}[4]-({c[3]}))^2)"


def _nearest_sql(side: str) -> str:
    ds = ", ".join(_dist(side, c) for c in FIXED_CENTRES)
    return f"cast(list_position([{ds}], list_min([{ds}])) - 1 AS int)"


define(
    "state_labels",
    f"""SELECT sample_id, spot_id, {_nearest_sql('t')} AS true_label, {_nearest_sql('p')} AS pred_label
FROM (SELECT sample_id, spot_id, list(t ORDER BY name) AS t, list(p ORDER BY name) AS p FROM state_z GROUP BY ALL)""",
)


def _labels(v: Views):
    return states.assign_states(states.vectors(_z(v), "name"), FIXED_CENTRES)


@query("K2_assignment", "SELECT *, true_label = pred_label AS same_state FROM state_labels")
def _(v: Views):
    return _labels(v).select("sample_id", "spot_id", "true_label", "pred_label", "same_state")


@query(
    "K6_state_annotation",
    """WITH t AS (SELECT true_label AS state, name, avg(t) AS m, count(*) AS n FROM state_z JOIN state_labels USING (sample_id, spot_id) GROUP BY ALL),
p AS (SELECT pred_label AS state, max(n) AS n FROM (SELECT pred_label, name, count(*) AS n FROM state_z JOIN state_labels USING (sample_id, spot_id) GROUP BY ALL) GROUP BY ALL)
SELECT state, coalesce(max(t.n), 0) AS n_true_spots, coalesce(max(p.n), 0) AS n_pred_spots,
  array_to_string(list(name ORDER BY m DESC, name)[1:3], '|') AS top_true_signatures,
  array_to_string(list_transform(list(m ORDER BY m DESC, name)[1:3], lambda x: format('{:.3f}', x)), '|') AS top_true_z
FROM t FULL JOIN p USING (state) GROUP BY state""",
)
def _(v: Views):
    z = _z(v)
    d = states.annotate_states(z, states.assign_states(states.vectors(z, "name"), FIXED_CENTRES), "name", 4)
    return d.drop("true_centroid_json", "pred_centroid_json")


@query(
    "K7_state_confusion",
    "SELECT true_label AS true_state, " + ", ".join(f"count(CASE WHEN pred_label = {j} THEN 1 END) AS pred_{j}" for j in range(4)) + " FROM state_labels GROUP BY true_label",
)
def _(v: Views):
    return states.confusion_wide(comp.confusion(_labels(v)), 4)


@query(
    "K7_score_scaling",
    """SELECT signature, avg(rate_true) AS true_mean, CASE WHEN stddev_pop(rate_true) < 1e-6 THEN 1.0 ELSE stddev_pop(rate_true) END AS true_std
FROM spot_scores WHERE valid GROUP BY signature""",
    "true_mean true_std",
)
def _(v: Views):
    return comp.score_scaling(op.scores_of_kind(v.spot_scores, "rate").filter("valid"), "signature")
