"""JSON bodies of partial updates: which fields were sent, which values fit, and what is wrong with the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.validation import Rule

# Texts that count as booleans, and messages by error type.
TRUE_TEXTS = ("1", "on", "t", "true", "y", "yes")
FALSE_TEXTS = ("0", "off", "f", "false", "n", "no")
MESSAGES = {
    "json_invalid": "JSON decode error",
    "model_attributes_type": "Input should be a valid dictionary or object to extract fields from",
    "string_type": "Input should be a valid string",
    "bool_type": "Input should be a valid boolean",
    "bool_parsing": "Input should be a valid boolean, unable to interpret input",
}
#: The fields of an account that a body may set, with their kinds.
ACCOUNT_FIELDS = {"email": "string", "full_name": "string", "is_active": "boolean", "role": "string", "is_app_admin": "boolean", "password": "string"}
ERRORS = "array<struct<loc: array<string>, msg: string, type: string>>"


def _error(kind: str, *loc: str) -> Column:
    return F.struct(F.array(F.lit("body"), *map(F.lit, loc)).alias("loc"), F.lit(MESSAGES[kind]).alias("msg"), F.lit(kind).alias("type"))


def _string(value: Column, kind: Column, name: str) -> tuple[Column, Column]:
    return F.when(kind == "STRING", F.try_variant_get(value, "$", "string")), F.when(kind != "STRING", _error("string_type", name))


def _boolean(value: Column, kind: Column, name: str) -> tuple[Column, Column]:
    text = F.lower(F.try_variant_get(value, "$", "string"))
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    known = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
    known = known.when(kind == "STRING", F.when(text.isin(*TRUE_TEXTS), True).when(text.isin(*FALSE_TEXTS), False))
    known = known.when(number, F.when(F.try_variant_get(value, "$", "double") == 1, True).when(F.try_variant_get(value, "$", "double") == 0, False))
    parsed = F.when(known.isNull(), F.when(number | (kind == "STRING"), _error("bool_parsing", name)).otherwise(_error("bool_type", name)))
    return known, parsed


_RULES = {"string": _string, "boolean": _boolean}


def parse_patch(df: DataFrame, column: str, fields: dict[str, str] | None = None) -> DataFrame:
    """Bodies of partial updates as typed fields, beside ``set_fields``, ``unknown_fields`` and ``errors``.

    ``fields`` gives each field's kind, string or boolean. ``set_fields`` are the known keys of the body's object, those sent as null too, which
    is what tells null from unset; ``unknown_fields`` are the other keys, which do nothing. ``errors`` has a struct ``loc, msg, type`` per field whose value
    does not fit, or one for a body that is no JSON (a missing one included) or no object. Strings must be strings; booleans may be numbers and texts that mean
    one. A field with an error is null. Other columns stay, but one with a field's name is replaced. Keys that repeat make a body invalid.
    """
    fields = fields or ACCOUNT_FIELDS
    body = F.try_parse_json(F.col(column))
    read = df.withColumn("_body", body).withColumn("_kind", F.schema_of_variant("_body"))
    is_object = F.coalesce(F.col("_kind").startswith("OBJECT"), F.lit(False))
    none = F.array().cast("array<string>")
    read = read.withColumn("_keys", F.when(is_object, F.coalesce(F.json_object_keys(column), none)).otherwise(none))
    names = F.array(*map(F.lit, fields))
    read = read.withColumns({"set_fields": F.array_intersect("_keys", names), "unknown_fields": F.array_except("_keys", names)})

    values, errors = {}, []
    for name, kind in fields.items():
        value = F.try_variant_get(F.col("_body"), f"$.{name}", "variant")
        shown = F.schema_of_variant(value)
        given = F.array_contains("set_fields", name) & (shown != "VOID")
        known, wrong = _RULES[kind](value, shown, name)
        values[name] = F.when(given, known)
        errors.append(F.when(given, wrong))
    whole = F.when(F.col("_kind").isNull(), F.array(_error("json_invalid"))).when(~is_object, F.array(_error("model_attributes_type")))
    found = F.coalesce(whole, F.array_compact(F.array(*errors))).cast(ERRORS)
    kept = [c for c in df.columns if c not in fields and c not in ("set_fields", "unknown_fields", "errors")]
    return read.select(*kept, *[v.alias(n) for n, v in values.items()], "set_fields", "unknown_fields", found.alias("errors"))


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without errors, and the others (their errors as they are, for a table of rejects)."""
    return parsed.filter(F.size("errors") == 0).drop("errors"), parsed.filter(F.size("errors") > 0)


def check_fields(parsed: DataFrame, rules: list[Rule]) -> DataFrame:
    """``parsed`` with further errors, for the rules that a field breaks which was sent (with ``loc`` under the body)."""
    found = [
        F.when(
            F.array_contains("set_fields", field) & F.coalesce(bad, F.lit(False)),
            F.struct(F.array(F.lit("body"), F.lit(field)).alias("loc"), F.lit(message).alias("msg"), F.lit(kind).alias("type")),
        )
        for field, bad, message, kind in rules
    ]
    return parsed.withColumn("errors", F.concat("errors", F.array_compact(F.array(*found)).cast(ERRORS)))
