"""Rules, integrity checks and schemas as Column expressions; every check reports all that is wrong in a row."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ValidationError
from .schema import ALL_ENTITY_TYPES, ALL_RELATION_TYPES, VALIDATION_STATES
from .search.filters import TYPES, field_column, field_type

_NUMERIC = (T.NumericType,)


@dataclass(frozen=True)
class Rule:
    """A test of one column; passes(df, field) is a Column that is true where the value is fine."""

    message: str

    def passes(self, df: DataFrame, field: str) -> Column:
        raise NotImplementedError("Validation rules must implement passes()")


@dataclass(frozen=True)
class Required(Rule):
    def passes(self, df: DataFrame, field: str) -> Column:
        c = field_column(df, field)
        return c.isNotNull() & (F.trim(c) != "") if isinstance(field_type(df.schema, field), T.StringType) else c.isNotNull()


@dataclass(frozen=True)
class OfType(Rule):
    kinds: tuple[str, ...] = ()

    def passes(self, df: DataFrame, field: str) -> Column:
        kind = field_type(df.schema, field)
        fits = kind is not None and any(isinstance(kind, TYPES[k]) for k in self.kinds)
        return field_column(df, field).isNotNull() & F.lit(fits)


@dataclass(frozen=True)
class InRange(Rule):
    low: float | None = None
    high: float | None = None

    def passes(self, df: DataFrame, field: str) -> Column:
        if not isinstance(field_type(df.schema, field), _NUMERIC):
            return F.lit(False)
        c = F.col(field)
        tests = [c >= self.low] if self.low is not None else []
        tests += [c <= self.high] if self.high is not None else []
        return c.isNotNull() & reduce(lambda a, b: a & b, tests, F.lit(True))


@dataclass(frozen=True)
class Matches(Rule):
    """The text of the value begins with a match; null counts as the text None."""

    pattern: str = ""

    def passes(self, df: DataFrame, field: str) -> Column:
        return F.coalesce(field_column(df, field).cast("string"), F.lit("None")).rlike(f"^(?:{self.pattern})")


@dataclass(frozen=True)
class Custom(Rule):
    """test: from the column to a boolean Column, which a pandas_udf gives as well."""

    test: Callable[[Column], Column] = lambda c: F.lit(True)

    def passes(self, df: DataFrame, field: str) -> Column:
        return self.test(field_column(df, field))


def messages(*tests: tuple[Column, str | Column]) -> Column:
    """array<string> of the messages whose failure test holds, in order."""
    each = F.array(*[F.when(F.coalesce(bad, F.lit(False)), m if isinstance(m, Column) else F.lit(m)) for bad, m in tests])
    return F.filter(each, lambda x: x.isNotNull())


class RuleSet:
    def __init__(self) -> None:
        self.rules: list[tuple[str, Rule]] = []

    def add(self, field: str, rule: Rule) -> RuleSet:
        self.rules.append((field, rule))
        return self

    def errors(self, df: DataFrame) -> Column:
        if not self.rules:
            return F.array().cast("array<string>")
        return messages(*[(~F.coalesce(r.passes(df, f), F.lit(False)), f"{f}: {r.message}") for f, r in self.rules])

    def validate(self, df: DataFrame) -> DataFrame:
        return with_result(df, self.errors(df))


def with_result(df: DataFrame, errors: Column, warnings: Column | None = None) -> DataFrame:
    """df with a struct validation: is_valid, errors, warnings."""
    none = F.array().cast("array<string>")
    return df.withColumn("validation", F.struct((F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), (none if warnings is None else warnings).alias("warnings")))


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def _not_unit(c: Column) -> Column:
    return c.isNull() | ~c.between(0, 1)


def _out_of_range(ranged: Column) -> Column:
    """Whether any of the ranged metrics breaks min < max or min <= value <= max."""
    return F.exists(F.map_values(ranged), lambda m: F.coalesce(~((m["min"] < m["max"]) & m["value"].between(m["min"], m["max"])), F.lit(True)))


def _not_finite(metrics: Column) -> Column:
    return F.exists(F.map_values(metrics), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def _null_entry(attributes: Column) -> Column:
    """Of JSON text: a key that is blank or a value that is null."""
    entries = F.from_json(attributes, "map<string,string>")
    return F.exists(F.map_entries(entries), lambda e: _blank(e["key"]) | e["value"].isNull())


def node_errors() -> Column:
    """Every broken invariant of a node row (schema NODE_DDL)."""
    m, k = "metadata.", "metadata.metrics."
    return messages(
        (_blank(F.col("name")), "name: blank"),
        (~F.coalesce(F.col("entity_type").isin(ALL_ENTITY_TYPES), F.lit(False)), "entity_type: unknown"),
        (F.exists("observations", lambda x: x.isNull()), "observations: holds a null"),
        (F.exists("validation_rules", lambda x: x.isNull()), "validation_rules: holds a null"),
        (F.exists("examples", lambda x: x.isNull()), "examples: holds a null"),
        (_not_finite(F.col("metrics")), "metrics: holds a value that is no finite number"),
        (F.col("metadata").isNull(), "metadata: missing"),
        (F.col(m + "created_at").isNull(), "created_at: missing"),
        (F.col(m + "last_modified").isNull(), "last_modified: missing"),
        (F.col(m + "last_modified") < F.col(m + "created_at"), "last_modified: earlier than created_at"),
        (F.col(m + "version").isNull() | (F.col(m + "version") < 1), "version: below 1"),
        *[(_blank(F.col(m + f)), f"{f}: blank") for f in ("author", "source", "status")],
        (F.exists(m + "tags", lambda x: x.isNull()), "tags: holds a null"),
        *[(_not_unit(F.col(k + f)), f"{f}: outside 0 to 1") for f in ("complexity", "reliability", "coverage", "impact", "confidence")],
        (_out_of_range(F.col(k + "custom_metrics")), "custom_metrics: outside their own bounds"),
        (_null_entry(F.col("attributes")), "attributes: a blank key or a null value"),
    )


def edge_errors() -> Column:
    """Every broken invariant of an edge row (schema EDGE_DDL)."""
    m = "metadata."
    return messages(
        (_blank(F.col("from_entity")), "from_entity: blank"),
        (_blank(F.col("to_entity")), "to_entity: blank"),
        (~F.coalesce(F.col("relation_type").isin(ALL_RELATION_TYPES), F.lit(False)), "relation_type: unknown"),
        (F.col("metadata").isNull(), "metadata: missing"),
        (F.col(m + "created_at").isNull(), "created_at: missing"),
        (F.col(m + "last_modified").isNull(), "last_modified: missing"),
        (F.col(m + "last_modified") < F.col(m + "created_at"), "last_modified: earlier than created_at"),
        (_not_unit(F.col(m + "confidence")), "confidence: outside 0 to 1"),
        (_blank(F.col(m + "source")), "source: blank"),
        (F.col(m + "weight").isNull() | (F.col(m + "weight") < 0), "weight: missing or below 0"),
        (_not_unit(F.col("impact_score")), "impact_score: outside 0 to 1"),
        (~F.coalesce(F.col("validation_status").isin(VALIDATION_STATES), F.lit(False)), f"validation_status: none of {', '.join(VALIDATION_STATES)}"),
        (_out_of_range(F.col("custom_metrics")), "custom_metrics: outside their own bounds"),
        (_null_entry(F.col("attributes")), "attributes: a blank key or a null value"),
    )


def validate_nodes(nodes: DataFrame) -> DataFrame:
    return with_result(nodes, node_errors())


def validate_edges(edges: DataFrame) -> DataFrame:
    return with_result(edges, edge_errors())


# Keywords of a JSON schema that are tested, and those that only describe.
TESTED = ("type", "required", "properties", "enum", "minimum", "maximum", "pattern", "minLength", "maxLength")
DESCRIBING = ("$schema", "$id", "$comment", "title", "description", "default", "examples")


class JsonSchemas:
    """JSON schemas by type, of the keywords in TESTED at any depth of properties, compiled to Columns over a JSON text; a schema with
    another keyword is refused. A type without schema passes with a warning."""

    def __init__(self) -> None:
        self.schemas: dict[str, dict[str, Any]] = {}

    def register(self, kind: str, schema: dict[str, Any] | str) -> None:
        schema = json.loads(schema) if isinstance(schema, str) else schema
        self._known(schema)
        self.schemas[kind] = schema

    def _known(self, schema: dict[str, Any], at: str = "") -> None:
        if other := sorted(set(schema) - {*TESTED, *DESCRIBING}):
            raise ValidationError(f"Schema keywords without a test{f' at {at}' if at else ''}: {', '.join(other)}")
        for p, inner in schema.get("properties", {}).items():
            self._known(inner, f"{at}.{p}" if at else p)

    def _tests(self, data: Column, schema: dict[str, Any]) -> list[tuple[Column, str]]:
        v = F.try_parse_json(data)
        return [(data.isNotNull() & v.isNull(), "not a JSON document"), *self._inside(v, schema, data.isNull() | F.is_variant_null(v))]

    def _inside(self, v: Column, schema: dict[str, Any], absent: Column, at: str = "") -> list[tuple[Column, str]]:
        """Tests of the object at a path; absent: whether there is none, which lacks what is required at the top only."""
        get = lambda p, kind: F.try_variant_get(v, f"$.{p}", kind)
        kinds = {"string": "STRING", "integer": "BIGINT", "number": "DOUBLE|BIGINT|DECIMAL.*|FLOAT", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}
        tests = []
        for name in schema.get("required", []):
            missing = get(f"{at}{name}", "variant").isNull()
            tests.append((~absent & missing if at else absent | missing, f"'{at}{name}' is a required property"))
        for name, s in schema.get("properties", {}).items():
            p = f"{at}{name}"
            raw = get(p, "variant")
            if "type" in s:
                wanted = [s["type"]] if isinstance(s["type"], str) else s["type"]
                tests.append((raw.isNotNull() & ~F.schema_of_variant(raw).rlike(f"^({'|'.join(kinds[k] for k in wanted)})$"), f"'{p}' is not of type {', '.join(wanted)}"))
            if "enum" in s:
                tests.append((raw.isNotNull() & ~get(p, "string").isin([str(x) for x in s["enum"]]), f"'{p}' is not one of {s['enum']}"))
            if "minimum" in s:
                tests.append((get(p, "double") < s["minimum"], f"'{p}' is less than the minimum of {s['minimum']}"))
            if "maximum" in s:
                tests.append((get(p, "double") > s["maximum"], f"'{p}' is greater than the maximum of {s['maximum']}"))
            if "pattern" in s:
                tests.append((~get(p, "string").rlike(s["pattern"]), f"'{p}' does not match '{s['pattern']}'"))
            if "minLength" in s:
                tests.append((F.length(get(p, "string")) < s["minLength"], f"'{p}' is too short"))
            if "maxLength" in s:
                tests.append((F.length(get(p, "string")) > s["maxLength"], f"'{p}' is too long"))
            if "properties" in s or "required" in s:
                is_object = F.coalesce(F.schema_of_variant(raw).startswith("OBJECT"), F.lit(False))
                tests += self._inside(v, s, ~is_object, f"{p}.")
        return tests

    def errors(self, kind: Column, data: Column) -> Column:
        out = F.array().cast("array<string>")
        for name, schema in self.schemas.items():
            out = F.when(kind == name, messages(*self._tests(data, schema))).otherwise(out)
        return out

    def validate(self, df: DataFrame, kind: str, data: str) -> DataFrame:
        known = F.coalesce(F.col(kind).isin(list(self.schemas)), F.lit(False))
        warnings = F.when(~known, F.array(F.concat(F.lit("No schema registered for "), F.coalesce(F.col(kind), F.lit("null"))))).otherwise(F.array().cast("array<string>"))
        return with_result(df, self.errors(F.col(kind), F.col(data)), warnings)


def report_text(validation: str = "validation") -> Column:
    v = F.col(validation)
    lines = F.concat(F.transform(v["errors"], lambda e: F.concat(F.lit("Error: "), e)), F.transform(v["warnings"], lambda w: F.concat(F.lit("Warning: "), w)))
    passed = F.concat(F.array(F.lit("Validation passed successfully")), F.transform(v["warnings"], lambda w: F.concat(F.lit("Warning: "), w)))
    return F.array_join(F.when(v["is_valid"], passed).otherwise(lines), "\n")


def report_json(validation: str = "validation") -> Column:
    return F.to_json(validation)
