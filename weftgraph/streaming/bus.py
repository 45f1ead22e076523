"""An event bus on Structured Streaming.

publish() checks and stores events in one commit and delivers them at once, in batches of a type; enqueue() lets them wait in this
process until a batch is full or its time is over. stream() publishes what appears in a folder, and batch_stream() lets it wait in the
stream's state until its batch is full or its time is over. follow() is a subscription as a stream of its own: the stored events first,
then what is published. Invalid events are refused; events whose handler fails go to the dead-letter queue. Which batch an event went
out in is a row of the table event_links.

A commit of events holds the stream and batch that it came from, so a batch that a restart repeats is stored once; so do the books of
its delivery, so handlers get it again only if the process died while they had it.
"""

from __future__ import annotations

import json
import logging
import threading
import uuid
from collections import defaultdict
from collections.abc import Callable
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import EventError, ValidationError
from ..schema import EVENT_DDL, struct_of
from ..sources.store import Change, GraphStore
from ..validation import JsonSchemas
from .events import BATCH_SECONDS, BATCH_SIZE, MAX_RETRIES, after_retry, batched, query_events, retryable, stored_form

Handler = Callable[[DataFrame], None]
log = logging.getLogger(__name__)


class EventBus:
    """Handlers get a DataFrame of events of one type; what they raise sends that batch to the dead-letter queue."""

    def __init__(self, spark: SparkSession, store: GraphStore, batch_size: int = BATCH_SIZE, max_retries: int = MAX_RETRIES, batch_seconds: float = BATCH_SECONDS):
        self.spark, self.store, self.batch_size, self.max_retries, self.batch_seconds = spark, store.initialize(), batch_size, max_retries, batch_seconds
        self.schemas = JsonSchemas()
        self.handlers: dict[str, list[Handler]] = defaultdict(list)
        self._waiting: list[DataFrame] = []
        self._count = 0
        self._timer: threading.Timer | None = None
        self._lock = threading.RLock()

    # subscriptions

    def subscribe(self, event_type: str, handler: Handler, replay: bool = False) -> None:
        """With replay the handler first gets the stored events of its type, newest first."""
        self.handlers[event_type].append(handler)
        if replay:
            handler(query_events(self.events(), event_type))

    def unsubscribe(self, event_type: str, handler: Handler) -> bool:
        if handler in self.handlers[event_type]:
            self.handlers[event_type].remove(handler)
            return True
        return False

    def subscriber_count(self, event_type: str | None = None) -> int:
        return len(self.handlers[event_type]) if event_type else sum(map(len, self.handlers.values()))

    def clear_subscribers(self, event_type: str | None = None) -> None:
        if event_type:
            self.handlers.pop(event_type, None)
        else:
            self.handlers.clear()

    def register_schema(self, event_type: str, schema: dict[str, Any] | str) -> None:
        """Takes the place of an earlier schema of the type."""
        self.schemas.register(event_type, schema)
        began = self.store.version()
        kept = self.store.read("event_schemas")
        at = F.localtimestamp()
        created = kept.where(F.col("event_type") == event_type).select("created_at").first()
        row = self.spark.range(1).select(F.lit(event_type).alias("event_type"), F.lit(json.dumps(self.schemas.schemas[event_type])).alias("schema"), (F.lit(created[0]) if created else at).alias("created_at"), at.alias("updated_at"))
        self.store.write("event_schemas", kept.where(F.col("event_type") != event_type).unionByName(row), began)

    # publishing

    def checked(self, events: DataFrame) -> DataFrame:
        return events.withColumn("errors", self.schemas.errors(F.col("event_type"), F.col("data")))

    def publish(self, events: DataFrame, validate: bool = True, deliver: bool = True, source: tuple[str, int] | None = None) -> DataFrame:
        """Store events (event_type, data, timestamp[, metadata]) and deliver them in batches; the stored rows.

        source: a stream and the number of its batch, or of another numbered delivery; what comes again under a number is not stored
        again, and is delivered only if it was not.
        """
        from ..runtime import counted

        if validate and (bad := self.checked(events).where(F.size("errors") > 0).first()):
            raise ValidationError(f"Event schema validation failed: {'; '.join(bad['errors'])}")
        name = source and (f"{source[0]}/events", source[1])
        rows = None
        if name is None or not self.store.committed(*name):
            held, seen = counted(stored_form(events), F.max("id").alias("top"))
            first = self.store.claim_ids((seen["top"] + 1) if seen["n"] else 0)
            rows = held.withColumn("id", F.col("id") + first)
            if source:
                rows = rows.withColumn("batch_id", F.lit(f"{source[0]}/{source[1]}"))
            self.store.commit({"events": Change(rows=rows)}, stream=name)
        if source and (rows is None or not deliver):
            rows = self.store.read("events").where(F.col("batch_id") == f"{source[0]}/{source[1]}")
        if deliver:
            self.deliver(rows, source)
        return rows

    def enqueue(self, events: DataFrame, validate: bool = True) -> None:
        """Store events and let them wait: they go out when batch_size of them wait, or batch_seconds after the first."""
        with self._lock:
            rows = self.publish(events, validate, deliver=False)
            self._waiting.append(rows)
            self._count += rows.count()
            if self._count >= self.batch_size:
                self.flush()
            elif self._timer is None:
                self._timer = threading.Timer(self.batch_seconds, self.flush)
                self._timer.daemon = True
                self._timer.start()

    def flush(self) -> int:
        """Deliver what waits; how many events."""
        with self._lock:
            if self._timer is not None:
                self._timer.cancel()
            waiting, count = self._waiting, self._count
            self._waiting, self._count, self._timer = [], 0, None
            if waiting:
                self.deliver(reduce(DataFrame.unionByName, waiting))
            return count

    def deliver(self, rows: DataFrame, source: tuple[str, int] | None = None) -> None:
        """Events go to the handlers of their type, which get all of them with the number of their batch; batches of batch_size
        events at most are recorded, with the events that each holds. rows may name their batches themselves, in batch_no."""
        from ..runtime import checkpointed

        done = source and (f"{source[0]}/delivered", source[1])
        if done and self.store.committed(*done):
            return
        dealt = checkpointed(rows if "batch_no" in rows.columns else batched(rows, self.batch_size))
        run = f"{source[0]}.{source[1]}".replace("-", "") if source else uuid.uuid4().hex
        name = F.concat_ws("-", F.lit(run), "event_type", "batch_no")
        at, failed = F.localtimestamp(), {}
        for kind in [r[0] for r in dealt.select("event_type").distinct().collect()]:  # a row for each type
            if problem := self._hand_out(kind, dealt.where(F.col("event_type") == kind)):
                failed[kind] = problem
        state = F.when(F.col("event_type").isin(list(failed)), "FAILED").otherwise("COMPLETED")
        books = dealt.groupBy("event_type", "batch_no").agg(F.count("*").alias("event_count"))
        changes = {
            "event_batches": Change(rows=books.select(name.alias("id"), state.alias("status"), "event_count", at.alias("created_at"), at.alias("completed_at"))),
            "event_links": Change(rows=dealt.select(F.col("id").alias("event_id"), name.alias("linked_batch"))),
        }
        if failed:
            problem = F.create_map(*[F.lit(x) for pair in failed.items() for x in pair])[F.col("event_type")]
            dead = dealt.where(F.col("event_type").isin(list(failed)))
            changes["dead_letter_queue"] = Change(rows=dead.select("id", F.col("id").alias("event_id"), problem.alias("error_message"), F.lit(0).alias("retry_count"), F.lit(None).cast("timestamp_ntz").alias("last_retry"), at.alias("created_at")))
        self.store.commit(changes, stream=done)

    def events(self) -> DataFrame:
        """The stored events, with the batch that each went out in."""
        links = self.store.read("event_links").groupBy(F.col("event_id").alias("id")).agg(F.max("linked_batch").alias("linked_batch"))
        known = self.store.read("events").join(links, "id", "left")
        batch = F.coalesce("linked_batch", "batch_id")
        return known.select(*[{"batch_id": batch, "processed": F.col("processed") | F.col("linked_batch").isNotNull()}.get(c, F.col(c)).alias(c) for c in struct_of(EVENT_DDL).names])

    def get_events(self, event_type: str | None = None, start: datetime | None = None, end: datetime | None = None, batch_id: str | None = None, limit: int = 0) -> DataFrame:
        """Stored events, newest first."""
        return query_events(self.events(), event_type, start, end, batch_id, limit)

    def _hand_out(self, kind: str, part: DataFrame) -> str:
        problems = []
        for handler in list(self.handlers[kind]):
            try:
                handler(part)
            except Exception as e:  # a subscriber's own failure must not stop the others
                log.warning("handler of %s failed: %s", kind, e)
                problems.append(f"{type(e).__name__}: {e}")
        return "; ".join(problems)

    def retry_dead_letters(self) -> int:
        """Deliver again what may be retried; how many events succeeded."""
        from ..runtime import checkpointed

        began = self.store.version()
        dead = checkpointed(self.store.read("dead_letter_queue"))
        again = checkpointed(retryable(self.events(), dead, self.max_retries))
        good = again.where("false").select("id")
        for kind in [r[0] for r in again.select("event_type").distinct().collect()]:
            part = again.where(F.col("event_type") == kind)
            if not self._hand_out(kind, part.select(*struct_of(EVENT_DDL).names)):
                good = good.union(part.select("id"))
        self.store.write("dead_letter_queue", after_retry(dead, again, good), began)
        return good.distinct().count()

    # streams

    def _source(self, source: str, format: str, files_per_batch: int | None) -> DataFrame:
        reader = self.spark.readStream.schema("event_type string, data string, timestamp timestamp_ntz, metadata string").format(format)
        return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(source)

    def _refuse(self, rows: DataFrame, source: tuple[str, int]) -> DataFrame:
        """Valid rows; the others go to the dead-letter queue with their errors."""
        rows = self.checked(rows)
        bad, at, no = rows.where(F.size("errors") > 0), F.localtimestamp(), F.lit(None).cast("long")
        dead = bad.select(no.alias("id"), no.alias("event_id"), F.array_join("errors", "; ").alias("error_message"), F.lit(self.max_retries).alias("retry_count"), F.lit(None).cast("timestamp_ntz").alias("last_retry"), at.alias("created_at"))
        if not self.store.committed(f"{source[0]}/refused", source[1]) and not bad.isEmpty():
            self.store.commit({"dead_letter_queue": Change(rows=dead)}, stream=(f"{source[0]}/refused", source[1]))
        return rows.where(F.size("errors") == 0).drop("errors")

    def stream(self, source: str, checkpoint: str, format: str = "json", once: bool = True, seconds: float = 1.0, files_per_batch: int | None = None) -> StreamingQuery:
        """Publish the events that appear as files under source. Invalid rows go to the dead-letter queue with their errors."""
        name = f"stream:{checkpoint}"

        def each(batch: DataFrame, number: int) -> None:
            good = self._refuse(batch, (name, number))
            if not good.isEmpty():
                self.publish(good, validate=False, source=(name, number))

        writer = self._source(source, format, files_per_batch).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()

    def batch_stream(self, source: str, checkpoint: str, format: str = "json", seconds: float = 1.0, files_per_batch: int | None = None, lanes: int = 1) -> StreamingQuery:
        """Like stream(), but the events of a type wait in the stream's state until batch_size of them are there, or batch_seconds have
        passed since the first one came, over restarts as well. They are stored and delivered when their batch goes out.

        Sets the session's state store to the one that has timers. lanes: how many batches of a type fill side by side.
        """
        from .batches import STATE_STORE, batched_stream

        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        name = f"batches:{checkpoint}"

        def each(batch: DataFrame, number: int) -> None:
            if batch.isEmpty():
                return
            good = self._refuse(batch, (name, number))
            place = F.to_json(F.struct("lane", "batch_no"))
            marked = good.withColumn("metadata", F.to_json(F.struct(F.col("metadata").alias("own"), place.alias("place"))))
            stored = self.publish(marked.drop("lane", "batch_no"), validate=False, deliver=False, source=(name, number))
            at = F.from_json(F.get_json_object("metadata", "$.place"), "lane int, batch_no long")
            own = F.get_json_object("metadata", "$.own")
            dealt = stored.withColumn("batch_no", F.concat_ws(".", at["lane"], at["batch_no"])).withColumn("metadata", own)
            self.deliver(dealt, (name, number))

        events = batched_stream(self._source(source, format, files_per_batch), self.batch_size, self.batch_seconds, lanes)
        return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()

    def follow(self, event_type: str | None, handler: Handler, checkpoint: str, replay: bool = True, once: bool = False, seconds: float = 1.0) -> StreamingQuery:
        """A subscription that is a stream over the commits: with replay from the first stored event on, else from now on. Each event of
        the type (or of all) reaches the handler in the order of the commits, those published meanwhile after them; the checkpoint
        knows how far it is, over restarts. A handler that raises ends the stream, which begins again at that batch."""
        mark = f"follow:{checkpoint}"
        if not replay and not self.store.committed(mark, 0):
            self.store.commit({}, stream=(mark, self.store.version() + 1))
        after = self.store.log.state().streams.get(mark, -1)

        def each(batch: DataFrame, _: int) -> None:
            found = sorted((r["number"], json.loads(r["value"])) for r in batch.collect())  # a small line for each commit
            names = [c["rows"] for n, e in found if n > after and (c := e.get("tables", {}).get("events")) and "rows" in c]
            if names:
                rows = self.spark.read.schema(struct_of(EVENT_DDL)).format(self.store.format).load([self.store.folder("events", n) for n in names])
                rows = rows.where(F.col("event_type") == event_type) if event_type else rows
                if not rows.isEmpty():
                    handler(rows)

        log_ = self.spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "[0-9]*").option("maxFilesPerTrigger", 1000).load(self.store.log.path)
        named = log_.select(F.regexp_extract("_metadata.file_name", r"(\d+)", 1).cast("long").alias("number"), "value")
        writer = named.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def windowed_counts(events: DataFrame, at: str = "timestamp", late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Counts by event time and type, for tables and streams; rows later than the watermark are left out of streams."""
    source = events.withWatermark(at, late) if events.isStreaming else events
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return source.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def require_type(event_type: str) -> str:
    from ..schema import EVENT_TYPES

    if event_type not in EVENT_TYPES:
        raise EventError(f"Unknown event type: {event_type}")
    return event_type
