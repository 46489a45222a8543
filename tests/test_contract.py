"""The driver contract: names, the flagship, and a few queries against their SQL."""

import duckdb
import pytest
from compare import compare, connect

import __spark_entry__ as contract

def test_every_query_has_sql():
    # Training-data operators that SQL cannot express have tests of their own.
    without = set(contract.queries()) - set(contract.oracle_sql())
    assert not {name for name in without if name != "pipeline" and not name.startswith("op")}
    assert not set(contract.oracle_sql()) - set(contract.queries())


def test_flagship(spark):
    frame = contract.entry(spark)
    assert frame.columns[:2] == ["city", "timestamp"] and frame.count() > 0


@pytest.mark.parametrize(
    "name",
    ["latest_features", "lag_features", "period_stats", "compare_entities", "pr_auc", "hash_split", "refresh_equals_full"],
)
def test_query_equals_its_sql(spark, sf_dir, name):
    found = compare(
        spark, connect(sf_dir), contract.queries()[name], contract.oracle_sql()[name], sf_dir
    )
    assert found is None


def test_all_sql_is_accepted(sf_dir):
    con = connect(sf_dir)
    for name, text in contract.oracle_sql().items():
        assert isinstance(con.execute(text), duckdb.DuckDBPyConnection), name


def test_windows_share_one_exchange_and_sort(spark, sf_dir, capsys):
    """The main branch of the feature plan has one exchange, one sort and one window."""
    from obsweave.checks.testbed import observations
    from obsweave.plans.features import windowed_features, with_physics

    rows = windowed_features(with_physics(observations(spark, sf_dir)), groups=("rolling",))
    rows.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(city") == 1
    assert plan.count("Sort [city") == 1 and plan.count("Window [") == 1
