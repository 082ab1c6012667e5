"""Each registered query against its SQL twin, and the others for rows and a stable schema."""

from __future__ import annotations

import pytest
from conftest import SF
from oracle import compare, duck

from factloom.plans import all_queries

QUERIES = all_queries()
# These train models; the model tests cover them on smaller fields.
SLOW = {"model_tournament", "model_card", "model_predictions", "model_drivers", "model_reasons", "reloaded_model", "regression_tournament", "analysis_findings"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_matches_sql(spark, con, name):
    state, note = compare(spark, con, name, SF)
    # At this scale a filter on rare values may leave nothing on both sides.
    assert state in ("ok", "EMPTY"), note


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql and n not in SLOW])
def test_gives_rows(spark, name):
    df = QUERIES[name].run(spark, SF)
    assert df.columns
    assert df.limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 8
    assert set(entry.oracle_sql()) <= set(entry.queries())
