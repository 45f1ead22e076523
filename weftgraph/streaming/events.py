"""Event tables: construction, queries, batches and the dead-letter queue."""

from __future__ import annotations

import json
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import stored
from ..schema import EVENT_DDL, EVENT_TYPES, struct_of

BATCH_SIZE, BATCH_SECONDS, MAX_RETRIES = 100, 1.0, 3
_OPERATIONS = ("created", "updated", "deleted")


def event(kind: str, data: dict[str, Any], at: datetime | None = None, metadata: dict[str, Any] | None = None) -> tuple:
    if kind not in EVENT_TYPES:
        raise ValueError(f"Unknown event type: {kind}")
    return (kind, json.dumps(data), at or datetime.now(), None if metadata is None else json.dumps(metadata))


def entity_event(entity: str, operation: str, entity_id: str, data: dict[str, Any] | None = None) -> tuple:
    """Of a node or an edge that was created, updated or deleted (in any case)."""
    if operation.lower() not in _OPERATIONS:
        raise ValueError(f"Invalid operation: {operation}")
    return event(f"{entity}_{operation.lower()}", {f"{entity}_id": entity_id, **(data or {})})


def error_event(message: str, details: dict[str, Any] | None = None) -> tuple:
    return event("schema_updated", {"error": True, "message": message, **(details or {})})


def events_frame(spark: SparkSession, events: list[tuple]) -> DataFrame:
    return spark.createDataFrame(events, "event_type string, data string, timestamp timestamp_ntz, metadata string")


def stored_form(events: DataFrame, first_id: Column | int = 0) -> DataFrame:
    """events with ids (unique, rising within a partition) and bookkeeping columns, as the table events."""
    at = F.localtimestamp()
    have = set(events.columns)
    ids = F.col("id") if "id" in have else F.monotonically_increasing_id() + first_id
    extra = {"id": ids, "metadata": F.col("metadata") if "metadata" in have else F.lit(None), "batch_id": F.col("batch_id") if "batch_id" in have else F.lit(None), "processed": F.lit(False), "created_at": at}
    return events.select(*[(extra[f.name] if f.name in extra else F.col(f.name)).cast(f.dataType).alias(f.name) for f in struct_of(EVENT_DDL)])


def query_events(events: DataFrame, event_type: str | None = None, start: datetime | None = None, end: datetime | None = None, batch_id: str | None = None, limit: int = 0, at: str = "timestamp", id_col: str = "id") -> DataFrame:
    """Newest first (then the highest id); bounds are inclusive; limit 0 is none."""
    tests = [(event_type, F.col("event_type") == event_type), (start, F.col(at) >= F.lit(start)), (end, F.col(at) <= F.lit(end))]
    tests.append((batch_id, F.col("batch_id") == batch_id if "batch_id" in events.columns else F.lit(True)))
    for given, test in tests:
        if given is not None:
            events = events.where(test)
    out = events.orderBy(F.desc(at), F.desc(id_col))
    return out.limit(limit) if limit else out


def numbered(events: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """events with n: 0, 1, … within each group, in order. Rows are dealt by ranges of group and order and counted in each; what
    the ranges before hold is added (a row for each range and each group in it), so a group may fill any number of tasks."""
    row, own = F.monotonically_increasing_id(), F.spark_partition_id()
    ranged = events.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order)
    held = stored(ranged.select("*", own.alias("__range"), row.alias("__row")))
    starts = held.groupBy(*groups, "__range").agg(F.min("__row").alias("__first"), F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(*[F.col(g).alias(f"__of_{g}") for g in groups], F.col("__range").alias("__of"), "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    same = [F.col(g).eqNullSafe(F.col(f"__of_{g}")) for g in groups]
    joined = held.join(starts, [*same, F.col("__range") == F.col("__of")])
    return joined.select(*events.columns, (F.col("__row") - F.col("__first") + F.col("__before")).alias("n"))


def batched(events: DataFrame, size: int = BATCH_SIZE, at: str = "timestamp", id_col: str = "id", gap: float | None = None) -> DataFrame:
    """events with batch_no: per type, in order of time, a new batch after `size` events or, with gap, when the first event of
    the batch's window of `gap` seconds is over."""
    if gap is None:
        return numbered(events, ["event_type"], [at, id_col]).withColumn("batch_no", F.expr(f"n div {size}")).drop("n")
    events = events.withColumn("__window", F.floor(F.unix_micros(F.col(at).cast("timestamp")) / int(gap * 1_000_000)))
    out = numbered(events, ["event_type", "__window"], [at, id_col]).withColumn("__part", F.expr(f"n div {size}")).drop("n")
    number = numbered(out.select("event_type", "__window", "__part").distinct(), ["event_type"], ["__window", "__part"]).withColumnRenamed("n", "batch_no")
    return out.join(number, ["event_type", "__window", "__part"]).drop("__window", "__part")


def retryable(events: DataFrame, dead: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Events in the dead-letter queue whose count of retries is below the limit, with that count."""
    return events.join(dead.where(F.col("retry_count") < max_retries).select(F.col("event_id").alias("id"), "retry_count", "error_message"), "id")


def after_retry(dead: DataFrame, tried: DataFrame, succeeded: DataFrame) -> DataFrame:
    """The queue after a retry of events tried (id): those that succeeded leave, the others count one more."""
    kept = dead.join(succeeded.select(F.col("id").alias("event_id")).distinct(), "event_id", "left_anti")
    again = tried.select(F.col("id").alias("event_id")).distinct().withColumn("__again", F.lit(1))
    out = kept.join(again, "event_id", "left")
    now = F.when(F.col("__again").isNotNull(), F.localtimestamp()).otherwise(F.col("last_retry"))
    return out.withColumns({"retry_count": (F.col("retry_count") + F.coalesce("__again", F.lit(0))).cast("int"), "last_retry": now}).select(*dead.columns)
