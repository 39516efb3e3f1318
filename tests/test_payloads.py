"""Bodies of partial updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import validation
from millrace.sources import payloads

BODIES = {
    1: '{"full_name": null, "role": "admin"}',
    2: '{"full_name": 5, "is_active": "maybe", "role": ["x"], "is_app_admin": {}}',
    3: '{"is_active": 1, "is_app_admin": "OFF", "x y": 1, "full_name": ""}',
    4: "[]",
    5: "5",
    6: "null",
    7: "{",
    8: "",
    9: None,
    10: "{}",
    11: '{"is_active": 1.0, "is_app_admin": 2, "password": "short"}',
    12: '{"role": "owner", "email": "no", "full_name": "' + "n" * 300 + '"}',
}


def parsed(spark):
    df = spark.createDataFrame(list(BODIES.items()), "id long, body string").withColumn("_other", F.lit("kept")).withColumn("role", F.lit("replaced"))
    return payloads.parse_patch(df, "body")


def errors(row):
    return [(".".join(e.loc), e.type) for e in row.errors]


def test_what_was_sent_what_fits_and_what_does_not(spark):
    got = {r.id: r for r in parsed(spark).collect()}
    assert (got[1].set_fields, got[1].full_name, got[1].role, errors(got[1]), got[1]["_other"]) == (["full_name", "role"], None, "admin", [], "kept")
    assert errors(got[2]) == [("body.full_name", "string_type"), ("body.is_active", "bool_parsing"), ("body.role", "string_type"), ("body.is_app_admin", "bool_type")]
    assert (got[3].is_active, got[3].is_app_admin, got[3].unknown_fields, got[3].full_name, errors(got[3])) == (True, False, ["x y"], "", [])
    for i in (4, 5, 6):
        assert errors(got[i]) == [("body", "model_attributes_type")] and got[i].set_fields == []
    for i in (7, 8, 9):
        assert errors(got[i]) == [("body", "json_invalid")] and got[i].set_fields == [] and got[i].role is None
    assert errors(got[10]) == [] and got[10].set_fields == []
    assert got[11].is_active is True and errors(got[11]) == [("body.is_app_admin", "bool_parsing")]


def test_rules_apply_to_fields_that_were_sent_and_rejects_are_set_apart(spark):
    checked = payloads.check_fields(parsed(spark), validation.account_rules())
    got = {r.id: r for r in checked.collect()}
    assert errors(got[12]) == [("body.email", "value_error"), ("body.full_name", "string_too_long"), ("body.role", "enum")]
    assert errors(got[11])[-1] == ("body.password", "string_too_short") and errors(got[10]) == []
    good, bad = payloads.quarantine(checked)
    assert {r.id for r in good.collect()} == {1, 3, 10} and bad.count() == 9 and "errors" not in good.columns
