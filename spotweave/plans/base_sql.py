"""The views of `sources.views` once more, as SQL, so that the oracle does not share code with the library."""

from __future__ import annotations

import re

from spotweave.sources.views import CELL_TYPES, GENE_SETS, MARKER_CLASSES, MODULES


def _set_rows(sets: dict[str, list[str]]) -> str:
    rows = [f"('{s}', '{g}', {i})" for s, genes in sets.items() for i, g in enumerate(genes)]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS t(signature, gene, position)"


def finite(c: str) -> str:
    return f"({c} IS NOT NULL AND NOT isnan({c}) AND NOT isinf({c}))"


def sums(p: str = "pred", t: str = "true_", extra: str = "") -> str:
    """Power sums of two columns; the pairs of the oracle are finite by construction."""
    return (
        f"count(*) AS n, sum({p}) AS sp, sum({t}) AS st, sum({p}*{p}) AS spp, sum({t}*{t}) AS stt, sum({p}*{t}) AS spt, "
        f"sum(abs({p}-{t})) AS sae, sum(({p}-{t})*({p}-{t})) AS sse, count(CASE WHEN {t} > 0 THEN 1 END) AS nz{extra}"
    )


def exact_sums(p: str = "pred", t: str = "true_", extra: str = "") -> str:
    """As `sums`, with compensated sums: in plain ones the rounding of many rows exceeds the share at which a side counts as constant."""
    return sums(p, t, extra).replace("sum(", "fsum(")


VP = "(CASE WHEN spp-sp*sp/n > 1e-12*spp THEN spp-sp*sp/n ELSE 0 END)"
VT = "(CASE WHEN stt-st*st/n > 1e-12*stt THEN stt-st*st/n ELSE 0 END)"
PEARSON = f"(CASE WHEN n >= 3 AND {VP} > 0 AND {VT} > 0 THEN (spt-sp*st/n)/sqrt({VP}*{VT}) END)"
R2 = f"(CASE WHEN n >= 2 AND {VT} > 0 THEN 1-sse/{VT} END)"


def metrics(n: str = "n_obs", detected: bool = False) -> str:
    d = ", nz*1.0/n AS detected_fraction" if detected else ""
    return (
        f"n AS {n}, {PEARSON} AS pearson, sae/n AS mae, sqrt(sse/n) AS rmse, st/n AS true_mean, sp/n AS pred_mean, "
        f"sqrt({VT}/n) AS true_std, sqrt({VP}/n) AS pred_std{d}"
    )


METRIC_DOUBLES = "pearson mae rmse true_mean pred_mean true_std pred_std"

VIEWS: dict[str, str] = {
    "samples": """
SELECT cast(s_suppkey AS varchar) AS sample_id, s_name AS image_filename, n_name AS dataset_title, n_name AS cohort,
  r_name AS organ, cast(s_suppkey % 7 AS varchar) AS patient_id,
  CASE WHEN s_acctbal < 0 THEN 'Mus musculus' ELSE 'Homo sapiens' END AS species,
  CASE WHEN s_suppkey % 10 = 9 THEN 'Xenium' ELSE 'Visium' END AS st_technology,
  cast(floor(s_acctbal) AS bigint) AS spots_under_tissue,
  CASE WHEN s_acctbal < 0 THEN 'n/a' ELSE cast(cast(floor(s_acctbal / 10) AS bigint) AS varchar) END AS nb_genes_text,
  CASE WHEN s_acctbal < 1000 THEN ' Unknown' WHEN s_acctbal < 5000 THEN 'Healthy' ELSE 'Cancer ' END AS disease_state,
  'unknown' AS tissue,
  CASE WHEN s_suppkey % 10 < 7 THEN 'train' WHEN s_suppkey % 10 = 7 THEN 'val' ELSE 'test' END AS split
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "genes": """
SELECT DISTINCT p_brand AS gene, cast(split_part(p_brand, '#', 2) AS int) - 1 AS gene_index FROM part""",
    "cells": """
SELECT cast(l_suppkey AS varchar) AS sample_id, l_orderkey % 64 AS spot_id, p_brand AS gene,
  cast(sum(l_quantity) AS bigint) AS count, sum(l_extendedprice) AS price, max(l_discount) AS discount
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "sample_genes": """
SELECT sample_id, gene, gene_index FROM (SELECT sample_id, gene FROM cells GROUP BY ALL HAVING max(discount) >= 0.095)
JOIN genes USING (gene)""",
    "measured_cells": "SELECT c.* FROM cells c SEMI JOIN sample_genes g ON c.sample_id = g.sample_id AND c.gene = g.gene",
    "counts": "SELECT sample_id, spot_id, gene, count FROM measured_cells",
    "spots": """
SELECT sample_id, cast(i AS bigint) AS spot_id, cast(i % 8 AS double) AS x, cast(i // 8 AS double) AS y
FROM samples, range(72) AS r(i)""",
    "totals": """
SELECT s.*, cast(coalesce(t.total, 0) AS bigint) AS total
FROM spots s LEFT JOIN (SELECT sample_id, spot_id, sum(count) AS total FROM counts GROUP BY ALL) t USING (sample_id, spot_id)""",
    "sf_t": """
SELECT t.*, total >= 1 AS valid, total / m AS sf, ln(greatest(total / m, 1e-8)) AS log_sf
FROM totals t JOIN (SELECT sample_id, avg(total) AS m FROM totals WHERE total >= 1 GROUP BY ALL) USING (sample_id)""",
    "predictions": """
SELECT s.sample_id, s.spot_id, g.gene, coalesce(c.price / 1499, 0.5) AS value
FROM spots s JOIN sample_genes g ON s.sample_id = g.sample_id
LEFT JOIN measured_cells c ON c.sample_id = s.sample_id AND c.spot_id = s.spot_id AND c.gene = g.gene""",
    "eval_cells": """
SELECT p.sample_id, p.spot_id, p.gene, f.sf, p.value, coalesce(c.count, 0) AS true_count
FROM predictions p JOIN sf_t f ON f.sample_id = p.sample_id AND f.spot_id = p.spot_id AND f.valid
LEFT JOIN counts c ON c.sample_id = p.sample_id AND c.spot_id = p.spot_id AND c.gene = p.gene""",
    "pairs_count": """
SELECT sample_id, spot_id, gene, greatest(value, 0) AS pred, cast(true_count AS double) AS true_ FROM eval_cells""",
    "pred_log_sf": """
SELECT f.sample_id, f.spot_id, f.sf, f.log_sf, ln(1 + p.price / 1000) AS pred_log_sf_raw
FROM sf_t f JOIN (SELECT sample_id, spot_id, sum(price) AS price FROM measured_cells GROUP BY ALL) p
  USING (sample_id, spot_id) WHERE f.valid""",
    "pred_sf": """
SELECT p.*, exp(pred_log_sf_raw) / (m + 1e-8) AS pred_sf
FROM pred_log_sf p JOIN (SELECT sample_id, avg(exp(pred_log_sf_raw)) AS m FROM pred_log_sf GROUP BY ALL) USING (sample_id)""",
    "sf_spots": """
SELECT p.*, ln(pred_sf + 1e-8) AS pred_log_sf, ln(sf + 1e-8) AS true_log_sf, split, organ, cohort
FROM pred_sf p JOIN samples USING (sample_id)""",
    "ablation_cells": """
SELECT e.*, greatest(exp(ln(1 + greatest(value, 0))) - 1, 0) AS pred_rate, p.pred_sf,
  true_count / greatest(e.sf, 1e-6) AS true_rate
FROM eval_cells e JOIN pred_sf p USING (sample_id, spot_id)""",
    "ablations": """
SELECT sample_id, spot_id, gene, 'rate' AS method, pred_rate AS pred, true_rate AS true_ FROM ablation_cells
UNION ALL SELECT sample_id, spot_id, gene, 'count_no_sf', pred_rate, true_count FROM ablation_cells
UNION ALL SELECT sample_id, spot_id, gene, 'count_pred_sf', pred_rate * pred_sf, true_count FROM ablation_cells
UNION ALL SELECT sample_id, spot_id, gene, 'count_oracle_sf', pred_rate * sf, true_count FROM ablation_cells""",
    "features": """
SELECT cast(label AS varchar) AS sample_id, vec_id AS spot_id, cast(vec_id % 25 AS double) AS x,
  cast(vec_id // 25 AS double) AS y, embedding AS features FROM embeddings""",
    "gene_sets": _set_rows(GENE_SETS),
    "modules": _set_rows(MODULES),
    "cell_type_map": "SELECT * FROM (VALUES "
    + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in CELL_TYPES)
    + ") AS t(cell_type, signature, lineage)",
    "marker_classes": "SELECT * FROM (VALUES "
    + ", ".join(f"({p}, '{c}', '{g}')" for p, c, genes in MARKER_CLASSES for g in genes)
    + ") AS t(priority, gene_class, gene)",
    "spot_scores": """
SELECT a.sample_id, a.spot_id, g.signature,
  CASE WHEN count(*) >= 2 THEN avg(ln(1 + true_rate)) END AS rate_true,
  CASE WHEN count(*) >= 2 THEN avg(ln(1 + pred_rate)) END AS rate_pred,
  CASE WHEN count(*) >= 2 THEN avg(ln(1 + true_count)) END AS count_pred_sf_true,
  CASE WHEN count(*) >= 2 THEN avg(ln(1 + pred_rate * pred_sf)) END AS count_pred_sf_pred,
  count(*) >= 2 AS valid
FROM ablation_cells a JOIN gene_sets g USING (gene) GROUP BY ALL""",
    "label_pairs": "SELECT doc_id, cast(quality AS bigint) AS true_label, cast(toxic AS bigint) AS pred_label FROM labels",
    "st_barcodes": """
SELECT cast(c_nationkey AS varchar) AS sample_id, c_custkey AS barcode, c_custkey AS st_index, c_acctbal AS x,
  cast(length(c_name) AS double) AS y FROM customer""",
    "patch_barcodes": """
SELECT cast(c_nationkey AS varchar) AS sample_id, c_custkey AS barcode,
  CASE WHEN c_nationkey = 3 THEN -c_custkey ELSE c_custkey END AS patch_index,
  c_acctbal + top / 1000 AS x, cast(length(c_name) + 1 AS double) AS y
FROM (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY ALL) JOIN customer ON o_custkey = c_custkey
WHERE top < 480000
UNION ALL SELECT cast(s_nationkey AS varchar), s_suppkey + 10000000000, s_suppkey + 10000000000, s_acctbal, 0.0 FROM supplier""",
    "asset_plan": """
SELECT cast(p_partkey AS varchar) AS sample_id, p_type || '/' || cast(p_partkey AS varchar) AS path, p_type AS asset_group,
  cast(p_size AS bigint) AS size_bytes FROM part""",
    "asset_listing": """
SELECT p_type || '/' || cast(p_partkey AS varchar) AS path,
  cast(p_size - CASE WHEN least_q > 1 THEN 1 ELSE 0 END AS bigint) AS actual_bytes
FROM (SELECT l_partkey, min(l_quantity) AS least_q, count(*) AS lines FROM lineitem GROUP BY ALL) JOIN part ON l_partkey = p_partkey
WHERE lines > 24""",
    "pixels": """
SELECT vec_id AS patch_id, i AS pixel,
  cast(floor(255 * least(abs(cast(embedding[i*3+1] AS double)), 1.0)) AS int) AS r,
  cast(floor(255 * least(abs(cast(embedding[i*3+2] AS double)), 1.0)) AS int) AS g,
  cast(floor(255 * least(abs(cast(embedding[i*3+3] AS double)), 1.0)) AS int) AS b
FROM embeddings, range(21) AS t(i)""",
}


def define(name: str, sql: str) -> None:
    """Add a view used by several oracles of one family."""
    VIEWS[name] = sql


def _used(sql: str) -> list[str]:
    words = set(re.findall(r"[a-z_0-9]+", sql))
    return [v for v in VIEWS if v in words]


def with_views(body: str) -> str:
    """Prefix `body` with every base view it needs, in order of definition."""
    needed: set[str] = set()
    todo = _used(body)
    while todo:
        v = todo.pop()
        if v not in needed:
            needed.add(v)
            todo += [u for u in _used(VIEWS[v]) if u != v]
    ctes = [f"{v} AS MATERIALIZED ({VIEWS[v].strip()})" for v in VIEWS if v in needed]
    if not ctes:
        return body
    own = body.lstrip()
    rest = ",\n" + own[5:] if own.startswith("WITH ") else "\n" + body
    return "WITH " + ",\n".join(ctes) + rest
