"""Redaction of whole log records: message, arguments, extra fields of any shape, traceback."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.nested import map_strings
from millrace.functions.text import REDACTIONS, redact

#: Containers that are entered on the way to a string; those deeper stay as they are.
DEPTH = 4
_TOKEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(\s*+:)?|[{}\[\]]', re.DOTALL)
#: What a text must hold for each of ``REDACTIONS`` to find anything: one of the parts, in any case where the second list says so.
_PARTS = (
    (("@",), ()),
    ((".eyJ",), ()),
    (("sk-",), ()),
    (("sk-ant-",), ()),
    ((), ("token", "key", "secret", "password", "authorization")),
    (("Bearer",), ()),
    ((), ("password", "passwd", "pwd", "secret_key", "api_key", "apikey", "auth_token", "access_token", "refresh_token")),
)


def redact_records(records: DataFrame, message: str = "message", args: str = "args", extra: str | None = None, traceback: str = "traceback") -> DataFrame:
    """Log records with their personal data and secrets replaced, columns that are missing left out.

    The message and the traceback are redacted as text. Of ``args`` (an array, map or struct) only the strings directly in it are; ``extra`` (any type)
    is walked to ``DEPTH`` containers. Map keys, numbers and nulls stay. Other columns stay.
    """
    kinds = {f.name: f.dataType for f in records.schema}
    rules = {message: redact, traceback: redact}
    rules |= {c: lambda col, c=c, d=d: map_strings(col, kinds[c], redact, d) for c, d in ((args, 1), (extra, DEPTH)) if c}
    return records.withColumns({c: rule(F.col(c)) for c, rule in rules.items() if c in kinds})


def _plain_rules() -> list[tuple[re.Pattern, str]]:
    return [(re.compile(pattern), replacement.replace("$1", r"\1")) for pattern, replacement in REDACTIONS]


def _folded(text: str) -> str:
    """The text with all forms of a letter that a pattern without regard to case takes for the same as that letter."""
    return text.replace("\u0130", "i").replace("\u0131", "i").casefold() if not text.isascii() else text.lower()


def redact_text_value(text: str, rules: list[tuple[re.Pattern, str]]) -> str:
    """A pattern is only tried on a text that holds what all its matches hold; looking for that costs little."""
    folded = None
    for (pattern, replacement), (exact, any_case) in zip(rules, _PARTS, strict=True):
        if any_case and folded is None:
            folded = _folded(text)
        if any(part in text for part in exact) or (any_case and any(part in folded for part in any_case)):
            new = pattern.sub(replacement, text)
            text, folded = new, folded if new == text else None
    return text


def redact_json_value(text: str, rule: Callable[[str], str], depth: int = DEPTH) -> str:
    """JSON text with ``rule`` applied to the strings reached through at most ``depth`` containers. Keys, and everything that does not change, stay to
    the letter: numbers, spaces, escapes."""
    level = 0

    def step(m: re.Match) -> str:
        nonlocal level
        token = m[0]
        if token in "{[":
            level += 1
        elif token in "}]":
            level -= 1
        elif not m[1] and level <= depth:
            value = json.loads(token, strict=False)
            if (new := rule(value)) != value:
                return json.dumps(new, ensure_ascii=False)
        return token

    return _TOKEN.sub(step, text)


def redact_json(c: Column) -> Column:
    """JSON text of any shape, each row its own, redacted as ``redact_json_value`` does; text that is no JSON is redacted as text.

    Spark's built-in functions need one schema for a column; rows whose shapes differ go through Arrow batches instead.
    """

    @F.pandas_udf("string")
    def walk(texts: pd.Series) -> pd.Series:
        rules = _plain_rules()
        return texts.map(lambda t: redact_json_value(t, lambda v: redact_text_value(v, rules)), na_action="ignore")

    return F.when(F.try_parse_json(c).isNotNull(), walk(c)).otherwise(redact(c))
