"""Registered queries against their SQL, on the small tables."""

import pytest
from compare import same

SMALL = "/root/testdata/sf0.001"
NAMES = ["op1_quality_rules", "op3_secret_scans", "op4_benchmark_decontamination", "op5_chat_formatting", "op8_suffix_array_dedup", "op9_minhash_near_dups", "op11_fill_in_middle", "op12_exact_dedup"]


def test_all_are_registered(registered):
    assert {n.split("_")[0] for n in registered.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(registered.ORACLE_SQL) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, registered, name):
    same(registered.QUERIES[name](spark, SMALL), duck.sql(registered.ORACLE_SQL[name]))
