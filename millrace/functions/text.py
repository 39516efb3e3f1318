"""Text rules as column expressions: normalising, redacting, labels, lists, templates."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Redaction patterns with their replacements, in the order in which they run.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
REDACTIONS = (
    (EMAIL, "[EMAIL_REDACTED]"),
    (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", "[JWT_REDACTED]"),
    (r"sk-[a-zA-Z0-9]{20,}", "[API_KEY_REDACTED]"),
    (r"sk-ant-[a-zA-Z0-9_-]{20,}", "[API_KEY_REDACTED]"),
    (r"(?i)(?:token|key|secret|password|authorization)[=: ]+['\"]?([A-Za-z0-9_/+=.-]{40,})", "[SECRET_REDACTED]"),
    (r"Bearer\s+[A-Za-z0-9._~+/=-]{10,}", "Bearer [TOKEN_REDACTED]"),
    (
        r"(?i)(password|passwd|pwd|secret_key|api_key|apikey|auth_token|access_token|refresh_token)[\s]*[=:]\s*['\"]?\S+['\"]?",
        "$1=[REDACTED]",
    ),
)
#: An email begins where no character of its name comes before, or where the last match has ended. That finds the same
#: ones, but a run without "@" is gone through once, not from each of its characters.
_EMAIL_START = r"(?:\G|(?<![a-zA-Z0-9._%+-]))"
JWT = REDACTIONS[1][0]
#: A token begins at the first "eyJ" of a run of its characters or not at all in that run, so each run is gone through once.
_JWT_START = r"(?<![A-Za-z0-9_-])(?>([A-Za-z0-9_-]*?)eyJ)[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]+"
#: Patterns that find the same in linear time, with their replacements.
_LINEAR = {EMAIL: (_EMAIL_START + EMAIL, REDACTIONS[0][1]), JWT: (_JWT_START, "$1" + REDACTIONS[1][1])}
#: What every match of a pattern holds one of.
_NEEDED = {EMAIL: "@", JWT: (".eyJ",), REDACTIONS[2][0]: ("sk-",), REDACTIONS[3][0]: ("sk-ant-",), REDACTIONS[5][0]: ("Bearer",), REDACTIONS[6][0]: "=:"}
#: Characters that a URI component keeps although the form encoding escapes them.
URI_KEEPS = {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~", "+": "%20"}


# The characters of Unicode's White_Space property.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without surrounding white space of any kind, Unicode spaces included; only the edges are looked at."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def normalize_email(c: Column) -> Column:
    return F.lower(strip(c))


def search_pattern(search: str) -> str:
    """An ILIKE pattern for a substring. ``%`` and ``_`` stay wildcards; a backslash means itself."""
    return "%" + search.replace("\\", "\\\\") + "%"


def redact(c: Column) -> Column:
    """Personal data and secrets replaced, pattern after pattern; later ones see what earlier ones left.

    A pattern is only tried on texts that hold the characters which all its matches have.
    """

    def step(text: Column, rule: tuple[str, str]) -> Column:
        pattern, replacement = _LINEAR.get(rule[0], rule)
        flags = "(?U)" if r"\s" in pattern or r"\S" in pattern else ""
        replaced = lambda x: F.regexp_replace(x, flags + pattern.replace("(?i)", "(?iu)"), replacement)
        needed = _NEEDED.get(rule[0])
        if needed is None:
            return replaced(text)
        holds = lambda x: reduce(lambda a, b: a | b, [x.contains(part) for part in needed])
        return F.transform(F.array(text), lambda x: F.when(holds(x), replaced(x)).otherwise(x))[0]

    return reduce(step, REDACTIONS, c)


def request_id(c: Column, ascii_only: bool = False) -> Column:
    """The stripped id, cut to 64 characters, if it has only letters, digits, ``_`` and ``-``; else null."""
    cut = F.substring(strip(c), 1, 64)
    allowed = r"^[A-Za-z0-9_-]+\z" if ascii_only else r"^[\p{L}\p{N}_-]+\z"
    return F.when(cut.rlike(allowed), cut)


def or_default(c: Column, default: str) -> Column:
    """``default`` for null and empty text."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def parse_list(c: Column) -> Column:
    """Items of a comma list, trimmed, without empty ones; text that starts with ``[`` is one item."""
    items = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(c.startswith("["), F.array(c)).otherwise(items)


def without_trailing_slash(items: Column) -> Column:
    return F.transform(items, lambda x: F.regexp_replace(x, "/+$", ""))


def error_message(body: Column, default: str) -> Column:
    """The first validation message of a JSON body, else its detail, else ``default``."""
    return F.coalesce(
        F.get_json_object(body, "$.detail[0].msg"), F.nullif(F.get_json_object(body, "$.detail"), F.lit("")), F.lit(default)
    )


def initials(name: Column) -> Column:
    words = F.slice(F.split(name, " "), 1, 2)
    return F.upper(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", "-"), r"[^\w-]+", "")


def uri_component(c: Column) -> Column:
    """Percent-encoded as a URI component (a space is %20)."""
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), reversed(URI_KEEPS.items()), F.url_encode(c))


#: Characters that stay as they are in a whole URI but not in a component.
URI_RESERVED = {"%3B": ";", "%2C": ",", "%2F": "/", "%3F": "?", "%3A": ":", "%40": "@", "%26": "&", "%3D": "=", "%2B": "+", "%24": "$", "%23": "#"}


def encode_uri(c: Column) -> Column:
    """Percent-encoded but for letters, digits, marks and the characters that separate a URI's parts."""
    return reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), URI_RESERVED.items(), uri_component(c))


_KINDS = {"scalar": T.StringType(), "array": T.ArrayType(T.StringType()), "map": T.MapType(T.StringType(), T.StringType())}


def _pairs(name: Column, value: Column, kind: T.DataType) -> Column:
    """``name=value`` texts of a value of any nesting: items repeat the name, entries and fields add ``[key]`` to it; nulls give none."""
    if isinstance(kind, T.ArrayType):
        found = F.flatten(F.transform(value, lambda x: _pairs(name, x, kind.elementType)))
    elif isinstance(kind, T.MapType):
        inner = lambda e: _pairs(F.concat(name, F.lit("["), e["key"].cast("string"), F.lit("]")), e["value"], kind.valueType)
        found = F.flatten(F.transform(F.array_sort(F.map_entries(value)), inner))
    elif isinstance(kind, T.StructType):
        fields = [_pairs(F.concat(name, F.lit(f"[{f.name}]")), value[f.name], f.dataType) for f in kind.fields]
        found = F.concat(*fields) if fields else F.array().cast("array<string>")
    else:
        if isinstance(kind, T.TimestampType):
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        found = F.array(F.concat(uri_component(name), F.lit("="), uri_component(value.cast("string"))))
    return F.when(value.isNotNull(), found).otherwise(F.array().cast("array<string>"))


def query_string(parameters: dict[str, tuple[Column, str | T.DataType]]) -> Column:
    """``?k=v&...`` from values and their types: ``scalar`` (text), ``array`` and ``map`` of text, or any Spark type, nested as it may be.

    Arrays repeat their name, maps (in key order) and structs write ``k[s]``, timestamps are ISO 8601 in UTC; names and values are encoded and nulls left out.
    """
    parts = [_pairs(F.lit(name), value, _KINDS[kind] if isinstance(kind, str) else kind) for name, (value, kind) in parameters.items()]
    joined = F.array_join(F.concat(*parts), "&") if parts else F.lit("")
    return F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined))


def fill(template: Column, values: dict[str, Column], opening: str = "{", closing: str = "}", encode: Callable[[Column], Column] | None = None) -> Column:
    """The template with every known placeholder replaced (null: by nothing); unknown ones stay.

    The template is taken apart once, into the texts between placeholders and the names in them; values are put between the texts and
    never looked at, so what looks like a placeholder in a value stays. ``encode`` is applied to values.
    """
    mark = re.escape(opening) + "(.*?)" + re.escape(closing)
    texts, names = F.split(template, mark), F.regexp_extract_all(template, F.lit(mark), 1)
    put = encode or (lambda c: c)

    def value(name: Column) -> Column:
        known = reduce(lambda rest, item: F.when(name == item[0], F.coalesce(put(item[1]), F.lit(""))).otherwise(rest), values.items(), F.lit(None).cast("string"))
        return F.coalesce(known, F.concat(F.lit(opening), name, F.lit(closing)))

    behind = F.transform(names, lambda name, i: F.concat(value(name), F.get(texts, i + 1)))
    return F.concat(F.get(texts, F.lit(0)), F.array_join(behind, ""))
