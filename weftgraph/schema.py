"""The data model: value domains and table schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Entity types by domain, relation types, event types, validation states.
ENTITY_TYPES = {
    "code": ["code_module", "code_function", "code_class", "code_pattern", "library", "api"],
    "game_design": ["game_mechanic", "game_system", "game_resource", "game_component", "game_pattern", "player_behavior"],
    "systems": ["system", "subsystem", "component", "interface", "requirement", "constraint", "stakeholder"],
    "analysis": ["data_source", "dataset", "metric", "insight", "hypothesis", "evidence", "correlation"],
    "documentation": ["document", "specification", "standard", "procedure", "reference", "example", "use_case"],
}
RELATION_TYPES = {
    "code": ["imports", "inherits_from", "calls", "implements", "depends_on", "tested_by"],
    "game_design": ["interacts_with", "generates", "consumes", "balances", "counters", "extends"],
    "systems": ["composed_of", "connects_to", "provides", "requires", "constrains", "validates"],
    "analysis": ["derived_from", "correlates_with", "supports", "contradicts", "confirms", "sources"],
    "documentation": ["references", "describes", "exemplifies", "supersedes", "relates_to"],
}
EVENT_TYPES = [
    "node_created", "node_updated", "node_deleted", "edge_created", "edge_updated", "edge_deleted",
    "graph_validated", "schema_updated", "backup_created", "backup_restored",
]
VALIDATION_STATES = ["unverified", "verified", "invalid"]
#: Names that are not the value in capitals.
_NAMES = {"specification": "SPEC"}

DOMAINS = list(ENTITY_TYPES)
ALL_ENTITY_TYPES = [v for values in ENTITY_TYPES.values() for v in values]
ALL_RELATION_TYPES = [v for values in RELATION_TYPES.values() for v in values]

_RANGED = "map<string,struct<value:double,min:double,max:double>>"
_NODE_METRICS = f"struct<complexity:double,reliability:double,coverage:double,impact:double,confidence:double,custom_metrics:{_RANGED}>"
NODE_DDL = (
    "name string, entity_type string, observations array<string>, "
    f"metadata struct<created_at:timestamp_ntz,last_modified:timestamp_ntz,version:int,author:string,source:string,tags:array<string>,status:string,metrics:{_NODE_METRICS},custom_attributes:string>, "
    "attributes string, dependencies array<string>, documentation string, code_reference string, data_schema string, "
    "metrics map<string,double>, validation_rules array<string>, examples array<string>"
)
EDGE_DDL = (
    "from_entity string, to_entity string, relation_type string, "
    "metadata struct<created_at:timestamp_ntz,last_modified:timestamp_ntz,confidence:double,source:string,bidirectional:boolean,temporal:boolean,weight:double,custom_attributes:string>, "
    f"impact_score double, attributes string, context string, validation_status string, custom_metrics {_RANGED}"
)
EVENT_DDL = "id long, event_type string, data string, timestamp timestamp_ntz, metadata string, batch_id string, processed boolean, created_at timestamp_ntz"
DEAD_LETTER_DDL = "id long, event_id long, error_message string, retry_count int, last_retry timestamp_ntz, created_at timestamp_ntz"
BATCH_DDL = "id string, status string, event_count long, created_at timestamp_ntz, completed_at timestamp_ntz"
LINK_DDL = "event_id long, linked_batch string"
EVENT_SCHEMA_DDL = "event_type string, schema string, created_at timestamp_ntz, updated_at timestamp_ntz"
NODE_KEY = ["name"]
EDGE_KEY = ["from_entity", "relation_type", "to_entity"]


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def name_of(value: str) -> str:
    """An enumeration value's name."""
    return _NAMES.get(value, value.upper())


def value_of(name: str) -> str:
    return next((v for v, n in _NAMES.items() if n == name), name.lower())


def domain_of(entity_type: Column) -> Column:
    """The domain that a type belongs to; null for an unknown type."""
    out = F.lit(None).cast("string")
    for domain, values in ENTITY_TYPES.items():
        out = F.when(entity_type.isin(values), domain).otherwise(out)
    return out


def _now(now: Column | None) -> Column:
    return F.localtimestamp() if now is None else now


def complete(df: DataFrame, ddl: str, defaults: dict[str, Column]) -> DataFrame:
    """df in the columns of ddl; missing or null ones get their default, or null."""
    out = []
    for f in struct_of(ddl):
        have = df[f.name].cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(have, defaults[f.name].cast(f.dataType)) if f.name in defaults else have).alias(f.name))
    return df.select(*out)


def with_node_defaults(df: DataFrame, author: str = "system", source: str = "cli", now: Column | None = None) -> DataFrame:
    at = _now(now)
    none = F.lit(None)
    metrics = F.struct(*[F.lit(0.0).alias(m) for m in ("complexity", "reliability", "coverage", "impact")], F.lit(1.0).alias("confidence"), F.create_map().cast(_RANGED).alias("custom_metrics"))
    meta = F.struct(at.alias("created_at"), at.alias("last_modified"), F.lit(1).alias("version"), F.lit(author).alias("author"), F.lit(source).alias("source"), F.array().cast("array<string>").alias("tags"), F.lit("active").alias("status"), metrics.alias("metrics"), F.lit("{}").alias("custom_attributes"))
    empty = F.array().cast("array<string>")
    return complete(df, NODE_DDL, {"metadata": meta, "observations": empty, "dependencies": empty, "examples": empty, "attributes": F.lit("{}"), "documentation": none})


def with_edge_defaults(df: DataFrame, source: str = "cli", now: Column | None = None) -> DataFrame:
    at = _now(now)
    meta = F.struct(at.alias("created_at"), at.alias("last_modified"), F.lit(1.0).alias("confidence"), F.lit(source).alias("source"), F.lit(False).alias("bidirectional"), F.lit(False).alias("temporal"), F.lit(1.0).alias("weight"), F.lit("{}").alias("custom_attributes"))
    return complete(df, EDGE_DDL, {"metadata": meta, "impact_score": F.lit(1.0), "attributes": F.lit("{}"), "validation_status": F.lit("unverified"), "custom_metrics": F.create_map().cast(_RANGED)})
