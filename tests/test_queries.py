"""Every query of the account, session and request-log operators against its SQL."""

from __future__ import annotations

import pytest
from support import SF, from_elsewhere, from_spark, from_sql

import __spark_entry__
from millrace.plans import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, name):
    got = from_spark(registry.queries()[name](spark, SF))
    assert got == from_sql(registry.oracle_sql()[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 1
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_queries_with_python_workers_run_without_the_repository_on_their_path(tmp_path):
    names = ["rate_limit", "rate_limit_stream", "session_fold_stream"]
    assert from_elsewhere(tmp_path, names) == names
