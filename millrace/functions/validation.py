"""Field rules for records, and the split into accepted and rejected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import EMAIL

Rule = tuple[str, Column, str, str]


def required(field: str) -> Rule:
    return field, F.col(field).isNull(), "Field required", "missing"


def longest(field: str, n: int) -> Rule:
    return field, F.char_length(field) > n, f"String should have at most {n} characters", "string_too_long"


def shortest(field: str, n: int) -> Rule:
    return field, F.char_length(field) < n, f"String should have at least {n} characters", "string_too_short"


def email(field: str) -> Rule:
    return field, ~F.col(field).rlike(rf"^{EMAIL}\z"), "value is not a valid email address", "value_error"


def one_of(field: str, values: list[str]) -> Rule:
    return field, ~F.col(field).isin(values), "Input should be " + " or ".join(f"'{v}'" for v in values), "enum"


def account_rules() -> list[Rule]:
    """Fixed limits of an account record."""
    return [
        required("email"), email("email"), longest("email", 255), longest("full_name", 255), one_of("role", ["admin", "user"]),
        shortest("password", 8), longest("password", 128),
    ]


def item_rules() -> list[Rule]:
    """Fixed limits of an item record."""
    return [required("title"), shortest("title", 1), longest("title", 255), longest("description", 255)]


def check(df: DataFrame, rules: list[Rule], errors: str = "errors") -> DataFrame:
    """``df`` with an array of (loc, msg, type) for the rules that a row breaks; a rule on a null value holds."""
    found = [F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(f).alias("loc"), F.lit(m).alias("msg"), F.lit(t).alias("type"))) for f, bad, m, t in rules]
    return df.withColumn(errors, F.filter(F.array(*found), lambda e: e.isNotNull()))


def accepted(checked: DataFrame, errors: str = "errors") -> DataFrame:
    return checked.filter(F.size(errors) == 0).drop(errors)


def rejected(checked: DataFrame, errors: str = "errors") -> DataFrame:
    return checked.filter(F.size(errors) > 0)
