"""Times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How long tokens are valid.
LIFETIMES = {"access": "8 DAYS", "refresh": "30 DAYS", "password_reset": "48 HOURS"}


def iso(ts: Column) -> Column:
    """ISO 8601 with offset; the fraction is left out when it is zero."""
    whole = F.pmod(F.unix_micros(ts), F.lit(1_000_000)) == 0
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    )


def expires_at(ts: Column, kind: str) -> Column:
    return ts + F.expr(f"INTERVAL {LIFETIMES[kind]}")
