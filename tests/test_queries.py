"""Every registered query against its SQL at the smallest scale, or run where it has none.

PLUMBLINE_TESTS=short takes the headline queries only. Queries of the optional subpackage have tests of their own.
"""

import importlib
import os

import pytest

import __spark_entry__ as E
from bench import HEADLINE
from oracle import compare, duck

QUERIES, SQL = E.queries(), E.oracle_sql()
OWN = [k for a in E.AREAS for k in importlib.import_module(f"plumbline.catalog.{a}").Q]
CHOSEN = HEADLINE if os.environ.get("PLUMBLINE_TESTS") == "short" else OWN


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", [n for n in CHOSEN if n in SQL])
def test_matches_sql(spark, sf, con, name):
    ok, why, _ = compare(QUERIES[name](spark, sf), con, SQL[name])
    assert ok, why


@pytest.mark.parametrize("name", [n for n in CHOSEN if n not in SQL])
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    rows = E.entry(spark).collect()
    assert rows and all(abs(r["p_fake"] - 0.5) < 1e-6 for r in rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and set(HEADLINE) <= set(QUERIES)
