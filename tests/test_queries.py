import importlib
import sys

import pytest
from oracle import connect, same

from tallyloom.plans.oracles import oracle_sql
from tallyloom.plans.queries import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(oracle_sql()) == set(queries())


@pytest.mark.parametrize("name", queries())
def test_query_equals_sql(spark, sf_dir, con, name):
    same(queries()[name](spark, sf_dir), con, oracle_sql()[name])


@pytest.mark.parametrize("name", ["mapping_rejected", "mapping_checked", "auto_match_default", "similarity_thai", "bulk_files_classified", "bulk_import_counters", "mapping_stored", "default_years", "months_reordered", "terms_escaped"])
def test_query_has_rows(spark, sf_dir, name):
    rows = queries()[name](spark, sf_dir).collect()
    assert rows
    if name == "mapping_rejected":
        assert {r.kind for r in rows} == {"no code", "null code", "no other code", "unknown method", "no method", "no number", "above", "below"}
    if name == "auto_match_default":
        assert {0.95, 1.0} <= {r.score for r in rows} and min(r.score for r in rows) >= 0.95
    if name == "default_years":
        assert len({r.fy for r in rows}) > 1
    if name == "terms_escaped":
        assert all(r.own for r in rows) and {r.found for r in rows} == {True, False} and all(any(c in r.escaped for r in rows) for c in ("~%", "~_", "~~"))
    if name == "similarity_thai":
        assert len({r.score for r in rows}) > 3 and max(r.score for r in rows) < 0.5 < 1


def test_entry_works_without_the_training_subpackage(spark, monkeypatch):
    """As after deleting its folders and the pipeline's file."""
    for name in [n for n in sys.modules if n.startswith("tallyloom.llm") or n in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("tallyloom.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(queries()) == set(entry.oracle_sql())
    assert entry.entry(spark).limit(1).count() == 1
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def pushed(df, column):
    """Whether a range of a column is among the filters that a scan gets."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return any(f"GreaterThanOrEqual({column}" in part.split("]")[0] and f"LessThan({column}" in part.split("]")[0] for part in plan.split("PushedFilters: [")[1:])


def test_date_filters_reach_the_scan(spark, sf_dir):
    assert pushed(queries()["h_year_summary"](spark, sf_dir), "l_shipdate")
    assert pushed(queries()["i_year_summary"](spark, sf_dir), "o_orderdate")
    assert pushed(queries()["reconcile_headline"](spark, sf_dir), "o_orderdate")
