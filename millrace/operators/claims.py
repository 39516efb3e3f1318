"""Audit of token claims (no signature is checked)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decode(token: Column) -> Column:
    """The claims of a three-part token; null if its middle part is no JSON object."""
    part = F.translate(F.get(F.split(token, r"\."), F.lit(1)), "-_", "+/")
    padded = F.rpad(part, (F.ceil(F.char_length(part) / 4) * 4).cast("int"), F.lit("="))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.from_json(text, "sub string, exp long, nbf long, type string")


def audit(tokens: DataFrame, as_of: Column) -> DataFrame:
    """Tokens (column ``token``) by type and state: unreadable (no expiry), not yet valid or expired at ``as_of``, or valid."""
    claims, now = tokens.select(decode(F.col("token")).alias("c")), F.unix_seconds(as_of)
    state = F.when(F.col("c.exp").isNull(), "unreadable").when(F.col("c.nbf") > now, "not_yet_valid").when(F.col("c.exp") <= now, "expired").otherwise("valid")
    return claims.groupBy(F.col("c.type").alias("type"), state.alias("state")).agg(F.count("*").alias("n"))
