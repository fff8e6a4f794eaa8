"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from fieldaudit import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One or two of each kind: the rest is held against SQL by the driver's contract.
NAMES = ["t0_position", "t3_systematic_sample", "m4_future_mean", "m8c_future_entity_rate_constant", "m9_source_assignment", "e1_auroc", "e3_localization", "d1_mutual_information", "g4_group_budget", "g6_graph_cut",
         "g13_selection_digest", "j3_precedence", "a11_scopes", "w2_average_rank", "e10_directional_repair", "q5_row_invariants", "b4_nested_bootstrap", "b21_dose_effects", "g8_random_seeds", "g9_audit_policies", "f16_train_scaling_columns", "b9_exact_sign_flip", "b19_concordance", "c4_claims", "m12_composed", "l6_score_ledger", "e12_false_repair_flags"]


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, connection, name):
    want = connection.sql(plans.ORACLE_SQL[name])
    got = plans.QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want.fetchall()))


def test_registry_is_whole():
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES) and len(plans.QUERIES) > 120
