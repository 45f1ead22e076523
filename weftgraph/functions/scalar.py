"""Scalar functions of the data model, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import VALIDATION_STATES, _RANGED


def edge_id(src: Column, relation: Column, dst: Column) -> Column:
    """Text form of an edge's key; use key columns to compare, as names may hold ':'."""
    return F.concat_ws(":", src, relation, dst)


def edge_id_parts(key: Column, relations: list[str]) -> Column:
    """struct<from_entity, relation_type, to_entity> of an edge_id; a relation's name separates, so ends may hold ':'."""
    pattern = rf"(?s)^(.+?):({'|'.join(sorted(relations, key=len, reverse=True))}):(.+)$"
    return F.struct(F.regexp_extract(key, pattern, 1).alias("from_entity"), F.regexp_extract(key, pattern, 2).alias("relation_type"), F.regexp_extract(key, pattern, 3).alias("to_entity"))


SEARCHABLE = ("name", "documentation", "observations", "examples", "tags")


def searchable_text(fields: tuple[str, ...] = SEARCHABLE) -> Column:
    """The non-empty ones of a node's fields joined by blanks; lists are joined first."""
    as_text = {
        "name": F.col("name"), "documentation": F.col("documentation"), "observations": F.array_join("observations", " "),
        "examples": F.array_join("examples", " "), "tags": F.array_join("metadata.tags", " "),
    }
    return F.concat_ws(" ", *[F.nullif(as_text[f], F.lit("")) for f in fields])


def iso_format(at: Column) -> Column:
    return F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def iso_parse(text: Column) -> Column:
    return F.to_timestamp_ntz(text)


def backup_name(prefix: str, at: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_backup_"), F.date_format(at, "yyyyMMdd_HHmmss"))


def page_count(total: Column, page_size: Column) -> Column:
    return F.ceil(total / page_size).cast("long")


def appended(values: Column, value: Column) -> Column:
    """values with value at the end unless it is there; a blank value is an error."""
    checked = F.when(F.coalesce(F.trim(value), F.lit("")) == "", F.raise_error(F.lit("value must be a non-empty string")).cast("string")).otherwise(value)
    have = F.coalesce(values, F.array().cast("array<string>"))
    return F.when(F.array_contains(have, checked), have).otherwise(F.concat(have, F.array(checked)))


def append_to(nodes: DataFrame, column: str, value: Column, where: Column, now: Column | None = None) -> DataFrame:
    """Add an observation, dependency or tag to the nodes that meet the condition; all but tags touch last_modified."""
    at = F.localtimestamp() if now is None else now
    if column == "tags":
        new = F.col("metadata").withField("tags", appended(F.col("metadata.tags"), value))
        return nodes.withColumn("metadata", F.when(where, new).otherwise(F.col("metadata")))
    touched = F.col("metadata").withField("last_modified", at)
    return nodes.withColumns({column: F.when(where, appended(F.col(column), value)).otherwise(F.col(column)), "metadata": F.when(where, touched).otherwise(F.col("metadata"))})


def with_custom_metric(metrics: Column, name: str, value: float, low: float = 0.0, high: float = 1.0) -> Column:
    """A map of ranged metrics with one set."""
    if not low < high or not low <= value <= high:
        raise ValueError(f"Custom metric {name} must lie between {low} and {high}")
    entry = F.create_map(F.lit(name), F.struct(F.lit(float(value)).alias("value"), F.lit(float(low)).alias("min"), F.lit(float(high)).alias("max")))
    others = F.map_filter(F.coalesce(metrics, F.create_map().cast(_RANGED)), lambda k, _: k != name)
    return F.map_concat(others, entry)


def with_status(nodes: DataFrame, status: str, where: Column, now: Column | None = None) -> DataFrame:
    if not status.strip():
        raise ValueError("status must be a non-empty string")
    new = F.col("metadata").withField("status", F.lit(status)).withField("last_modified", F.localtimestamp() if now is None else now)
    return nodes.withColumn("metadata", F.when(where, new).otherwise(F.col("metadata")))


def with_confidence(edges: DataFrame, confidence: float, where: Column, now: Column | None = None) -> DataFrame:
    if not 0 <= confidence <= 1:
        raise ValueError("confidence must be between 0 and 1")
    new = F.col("metadata").withField("confidence", F.lit(float(confidence))).withField("last_modified", F.localtimestamp() if now is None else now)
    return edges.withColumn("metadata", F.when(where, new).otherwise(F.col("metadata")))


def with_validation_status(edges: DataFrame, status: str, where: Column) -> DataFrame:
    if status not in VALIDATION_STATES:
        raise ValueError(f"validation_status must be one of: {', '.join(VALIDATION_STATES)}")
    return edges.withColumn("validation_status", F.when(where, F.lit(status)).otherwise(F.col("validation_status")))
