"""Every query of the account, session and request-log operators, with its SQL counterpart."""

from __future__ import annotations

from millrace.plans import account_queries, change_queries, session_queries, stream_queries, text_queries  # noqa: F401
from millrace.plans.base import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
