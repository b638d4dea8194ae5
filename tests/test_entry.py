import pytest

import __spark_entry__ as spark_entry
from check_oracles import compare, duck


def test_entry_runs(spark):
    assert spark_entry.entry(spark).columns == ["lam", "j", "rhs", "x"]


def test_every_oracle_has_a_query():
    assert set(spark_entry.oracle_sql()) <= set(spark_entry.queries())


# The whole catalogue is checked by tests/check_oracles.py; these touch every route once.
SAMPLE = [
    "from_table",
    "strip_map",
    "block_slice_both",
    "block_range",
    "col_prod",
    "gram_wide",
    "tsqr_q_direct",
    "cond_numbers",
    "ridge_tsqr",
    "lsq_many_targets_normal",
    "sgd_targets",
    "bcd_tsqr",
    "bcd_one_pass",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, folder, name):
    frame = spark_entry.queries()[name](spark, folder)
    assert compare(frame, duck(folder).execute(spark_entry.oracle_sql()[name])) == ""
