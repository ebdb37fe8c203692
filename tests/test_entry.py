"""Driver contract: entry, queries and oracle keys; every query runs on sf0.001."""

import pytest

import __spark_entry__ as E


def test_entry_rows(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"conv_id", "turn", "blocked", "source", "answer"} <= set(df.columns)
    assert {r["source"] for r in rows} <= {"llm", "input_guard", "output_guard"}


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(set(E.queries()) - set(E._training()[0])))
def test_query_runs(spark, sf, name):
    df = E.queries()[name](spark, sf)
    assert df.columns and len(df.take(1)) == 1
