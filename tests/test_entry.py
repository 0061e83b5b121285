"""Registered queries agree with their statements on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

SAMPLE = ("build_bars_hourly", "rsi", "adx", "daily_ema", "final_decision", "decisions_as_of",
          "extract_execution", "parse_log", "rule_votes_long")


def test_every_statement_has_a_query():
    queries, oracle = entry_module.queries(), entry_module.oracle_sql()
    assert set(oracle) <= set(queries)
    own = set(entry_module.registered.queries())
    assert own <= set(queries)
    assert own - set(oracle) == {"base_scores", "stacked_scores"}


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_statement(spark, name):
    import check_oracle
    verdict, _ = check_oracle.compare(
        spark, check_oracle.connect(SF), name, entry_module.queries()[name],
        entry_module.oracle_sql()[name], SF)
    assert verdict.startswith("ok"), verdict


def test_flagship(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "final_decision" in df.columns
