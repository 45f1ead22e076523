"""Filters, sort keys and their meaning as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions.vector import cosine

# Names of filter operators and of value types.
OPERATORS = "eq ne gt gte lt lte in nin contains startswith endswith exists type regex near".split()
TYPES = {
    "string": (T.StringType,), "int": (T.ByteType, T.ShortType, T.IntegerType, T.LongType), "float": (T.FloatType, T.DoubleType, T.DecimalType),
    "bool": (T.BooleanType,), "list": (T.ArrayType,), "dict": (T.MapType, T.StructType), "datetime": (T.TimestampType, T.TimestampNTZType, T.DateType),
}


def field_type(schema: T.StructType, path: str) -> T.DataType | None:
    """The type of a dotted path; None where there is no such field. Maps are not entered."""
    kind: T.DataType | None = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return None
        kind = kind[part].dataType
    return kind


def field_column(df: DataFrame, path: str) -> Column:
    """A missing path is null."""
    return F.lit(None) if field_type(df.schema, path) is None else F.col(path)


def _text(df: DataFrame, path: str) -> tuple[Column, Callable]:
    """The field, and how a test of one string applies to it: any element of an array may pass."""
    column, kind = field_column(df, path), field_type(df.schema, path)
    if isinstance(kind, T.ArrayType):
        return column, lambda test: F.coalesce(F.exists(column, lambda x: test(x.cast("string"))), F.lit(False))
    return column, lambda test: F.coalesce(test(column.cast("string")), F.lit(False))


@dataclass(frozen=True)
class Filter:
    field: str
    operator: str
    value: Any = None

    def validate(self) -> None:
        if self.operator not in OPERATORS:
            raise QueryError(f"Invalid operator: {self.operator}")

    def on(self, df: DataFrame) -> Column:
        """True or false, never null."""
        self.validate()
        op, v, c = self.operator, self.value, field_column(df, self.field)
        known = lambda test: F.coalesce(test, F.lit(False))
        if op in ("eq", "ne"):
            same = c.isNull() if v is None else c.eqNullSafe(F.lit(v))
            return same if op == "eq" else ~same
        if op in ("gt", "gte", "lt", "lte"):
            return known({"gt": c.__gt__, "gte": c.__ge__, "lt": c.__lt__, "lte": c.__le__}[op](F.lit(v)))
        if op in ("in", "nin"):
            values = list(v) if isinstance(v, (list, tuple, set, frozenset)) else [v]
            some = [x for x in values if x is not None]
            inside = known(c.isin(some)) if some else F.lit(False)
            inside = inside | c.isNull() if len(some) < len(values) else inside
            return inside if op == "in" else ~inside
        if op in ("contains", "startswith", "endswith", "regex"):
            pattern = str(v) if op in ("regex", "contains") else f"^{v}" if op == "startswith" else f"{v}$"
            return _text(df, self.field)[1](lambda x: x.rlike(f"(?i){pattern}"))
        if op == "exists":
            return c.isNotNull() if v in (True, None) else c.isNull()
        if op == "type":
            kind = field_type(df.schema, self.field)
            return F.lit(kind is not None and isinstance(kind, TYPES.get(str(v), ()))) & c.isNotNull()
        to, far = (v["vector"], v.get("distance", 1.0)) if isinstance(v, dict) else (v, 1.0)
        return known(1 - cosine(c, F.array(*[F.lit(float(x)) for x in to])) <= far)


def contains_text(df: DataFrame, path: str, text: str) -> Column:
    """Whether the field holds the text as it stands, in any case; of an array, any element."""
    return _text(df, path)[1](lambda x: F.contains(F.lower(x), F.lit(text.lower())))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def equal_fields(df: DataFrame, wanted: dict[str, Any]) -> Column:
    """Storage filter: every dotted path equals its value. The key $or holds alternatives, which then stand alone."""
    if "$or" in wanted:
        return any_of([equal_fields(df, w) for w in wanted["$or"]])
    return all_of([Filter(f, "eq", v).on(df) for f, v in wanted.items()])


@dataclass(frozen=True)
class Sort:
    field: str
    direction: str = "asc"

    def validate(self) -> None:
        if self.direction not in ("asc", "desc"):
            raise QueryError(f"Invalid sort direction: {self.direction}")

    def column(self) -> Column:
        self.validate()
        return F.asc(self.field) if self.direction == "asc" else F.desc(self.field)


def escaped(text: str) -> str:
    """A text as a pattern that matches only itself."""
    return re.escape(text)
