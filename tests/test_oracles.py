"""A query of every family against its SQL on the smallest tables. `tests/compare.py` runs all of them."""

import pytest

import __spark_entry__ as entry
from compare import difference, duck

PATH = "/root/testdata/sf0.001"
SOME = [
    "A2_size_factor", "E3_level_metrics", "E8_grouped_sf_metrics", "E16_spearman", "P8_slugify", "J1_barcode_order", "B3_baseline_summary",
    "G6_validation_carve_out", "N4_set_fidelity", "C9_composition_overall", "K5_grouped_agreement", "L5_spatial_report", "X4_group_contrasts",
    "S12_conversion_report", "R6_readiness_audit", "I1_patch_descriptors", "T2_stream_levels",
]


@pytest.fixture(scope="module")
def con():
    return duck(PATH)


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, PATH), con, entry.oracle_sql()[name]) is None


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 190
    assert all(s.lstrip().upper().startswith(("SELECT", "WITH")) for s in o.values())


def test_sql_sees_a_constant_prediction_on_larger_tables():
    con = duck("/root/testdata/sf0.1")
    shifts = {"supplier": {"s_suppkey": 70_000}, "part": {"p_partkey": 100_000}, "lineitem": {"l_orderkey": 6_400_000, "l_partkey": 100_000, "l_suppkey": 70_000}}
    for t, keys in shifts.items():
        moved = ", ".join(f"{c} + i * {n} AS {c}" for c, n in keys.items())
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT t.* REPLACE ({moved}) FROM '/root/testdata/sf0.1/{t}.parquet' t, range(6) r(i)")
    sql = entry.oracle_sql()
    constant = "WHERE method = 'global_mean_rate'"
    assert con.execute(f"SELECT count(*) > 0, count(pearson) FROM ({sql['B3_baseline_gene_metrics']}) {constant}").fetchone() == (True, 0)
    for name in ("B3_baseline_summary", "R12_benchmark_evidence", "R19_run_comparison"):
        assert con.execute(f"SELECT valid_genes FROM ({sql[name]}) {constant}").fetchall() == [(0,)]
    assert con.execute(f"SELECT count(*) > 0, count(log_sf_pearson), count(sf_pearson) FROM ({sql['B4_constant_sf']})").fetchone() == (True, 0, 0)
