"""Rules applied to nested values by walking their schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def map_strings(c: Column, kind: T.DataType, rule: Callable[[Column], Column], depth: int = 4) -> Column:
    """``rule`` on every string that is reached through at most ``depth`` containers; map keys stay, null structs stay null."""
    if isinstance(kind, T.StringType):
        return rule(c)
    if depth == 0:
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: map_strings(x, kind.elementType, rule, depth - 1))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: map_strings(v, kind.valueType, rule, depth - 1))
    if isinstance(kind, T.StructType):
        fields = [map_strings(c[f.name], f.dataType, rule, depth - 1).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c
