"""Queries with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest

from helixframe.llm import queries as q

from ..helpers import SF, same


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_against_sql(spark, name):
    same(q.queries()[name](spark, SF), q.oracle_sql()[name])
