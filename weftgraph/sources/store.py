"""Tables of nodes, edges and events in a folder, as Parquet or JSON lines, under one log of commits.

A commit adds a folder of rows to a table, or one of keys whose earlier rows go, and then an entry to the log: so a change writes what it
changes and no more, readers see all of it or nothing, and of two writers that began from the same version one is told so. All
access goes through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ConflictError, StorageError
from ..functions.scalar import backup_name, edge_id
from ..runtime import one_row
from ..schema import BATCH_DDL, DEAD_LETTER_DDL, EDGE_DDL, EDGE_KEY, EVENT_DDL, EVENT_SCHEMA_DDL, LINK_DDL, NODE_DDL, NODE_KEY, struct_of
from .commits import CommitLog, State

TABLES = {"nodes": NODE_DDL, "edges": EDGE_DDL, "events": EVENT_DDL, "event_links": LINK_DDL, "dead_letter_queue": DEAD_LETTER_DDL, "event_batches": BATCH_DDL, "event_schemas": EVENT_SCHEMA_DDL}
#: Keys of the tables whose rows are changed.
KEYS = {"nodes": NODE_KEY, "edges": EDGE_KEY}
FORMATS = ("parquet", "json")


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def read_keyed_json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """key and the fields of ddl from a file (or a folder of files) that is one JSON object of records by key; none for a blank file.
    A key given twice gives two rows.

    The file is read in splits, cut at each closing brace wherever it stands. Whether a piece begins within a string, and how deep, is
    a running sum over the pieces of its split and the totals of the splits before (a row for each split); where the depth is back
    at one, a record ends. Only the pieces of one record come together.
    """
    raw = spark.read.option("lineSep", "}").text(path)
    pieces = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    before = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    splits = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def running(pieces: DataFrame, amount: str, to: str) -> DataFrame:
        """pieces with the sum of amount over all pieces of the file before each."""
        own = pieces.withColumn(to, F.coalesce(F.sum(amount).over(before), F.lit(0)))
        totals = pieces.groupBy("file", "block").agg(F.sum(amount).alias("all")).withColumn("start", F.coalesce(F.sum("all").over(splits), F.lit(0))).drop("all")
        return own.join(totals, ["file", "block"]).withColumn(to, F.col(to) + F.col("start")).drop("start")

    plain = F.regexp_replace("value", r"\\.", "")  # escaped quotes are no quotes
    pieces = pieces.withColumn("quotes", _count(plain, '"'))
    pieces = running(pieces, "quotes", "opened")
    text = F.concat(F.when(F.col("opened") % 2 == 1, '"').otherwise(""), plain)
    outside = F.regexp_replace(text, r'"[^"]*("|$)', "")
    closes = F.when((F.col("opened") + F.col("quotes")) % 2 == 0, 1).otherwise(0)
    pieces = running(pieces.withColumn("closes", closes).withColumn("step", _count(outside, "{") + _count(outside, "[") - _count(outside, "]") - F.col("closes")), "step", "depth")
    pieces = pieces.withColumn("ends", ((F.col("closes") == 1) & (F.col("depth") + F.col("step") == 1)).cast("int"))
    pieces = running(pieces, "ends", "record")
    whole = pieces.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "row", "value"))).alias("parts"), F.max("ends").alias("ends")).where("ends = 1")
    member = F.regexp_replace(F.array_join(F.col("parts.value"), "}"), r"^\s*[{,]\s*", "")
    entry = F.from_json(F.concat(F.lit("{"), member, F.lit("}}")), f"map<string,struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in struct_of(ddl))}>>")
    return whole.select(F.explode(entry).alias("key", "record")).select("key", "record.*")


def keyed_json(df: DataFrame, key: Column, fields: list[str] | None = None, *more: str) -> DataFrame:
    """One row for each record: the line `"key": {...}` of such an object, of all columns or of fields; null ones are left out.
    Columns of more stand beside it."""
    name = F.to_json(F.array(key))
    return df.select(*more, F.concat(name.substr(F.lit(2), F.length(name) - 2), F.lit(": "), F.to_json(F.struct(*(fields or ["*"])))).alias("value"))


def write_keyed_json(df: DataFrame, key: Column, path: str, one_file: bool = True) -> None:
    """A JSON object of records by key, in the order of the key.

    As one file it is the work of one task, which streams it record by record, and takes the place of an older file in one rename. With
    one_file=False it is a new folder of such objects, by ranges of the key, written side by side and committed together.
    """
    spark = df.sparkSession
    of = df.select(key.cast("string").alias("__key"), "*")
    lines = keyed_json(of, F.col("__key"), df.columns, "__key").select(F.col("__key").alias("key"), "value")

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark = "{"
        for f in frames:
            values = [v for v in f["value"] if v is not None]
            if values:
                yield pd.DataFrame({"value": [f"{mark}{values[0]}", *(f", {v}" for v in values[1:])]})
                mark = ", "
        yield pd.DataFrame({"value": ["{}" if mark == "{" else "}"]})

    if not one_file:
        lines.orderBy("key").mapInPandas(joined, "value string").write.text(path)
        return
    to = f"{path}.{uuid.uuid4().hex}"
    ends = one_row(spark, key=None, value=None).select(*[F.col(c).cast("string").alias(c) for c in ("key", "value")])  # there is a row for the task even if there is no record
    lines.unionByName(ends).orderBy(F.asc_nulls_last("key")).coalesce(1).mapInPandas(joined, "value string").write.text(to)
    fs = _file_context(spark, to)
    part = next(s.getPath() for s in _files(spark, to) if s.getPath().getName().startswith("part-"))
    _replace(spark, fs, part, path)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(to), True)


def _file_context(spark: SparkSession, path: str):
    fs = spark._jvm.org.apache.hadoop.fs
    at = fs.Path(path)
    return fs.FileContext.getFileContext(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri(), spark._jsc.hadoopConfiguration())


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return list(fs.listStatus(at)) if fs.exists(at) else []


def _replace(spark: SparkSession, fs, new, old: str) -> None:
    """Rename a file over another in one step."""
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    fs.rename(new, spark._jvm.org.apache.hadoop.fs.Path(old), how)


def node_json(df: DataFrame) -> DataFrame:
    return df.select(F.col("name").alias("key"), F.to_json(F.struct("*")).alias("value"))


def edge_json(df: DataFrame) -> DataFrame:
    return df.select(edge_id(F.col("from_entity"), F.col("relation_type"), F.col("to_entity")).alias("key"), F.to_json(F.struct("*")).alias("value"))


def from_json_rows(df: DataFrame, ddl: str) -> DataFrame:
    """Rows of column value back to the fields of ddl."""
    return df.select(F.from_json("value", ddl).alias("r")).select("r.*")


@dataclass
class Change:
    """Of a table: rows to add, keys whose earlier rows go, or that all earlier rows go (full)."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    full: bool = False


class TableStore(ABC):
    """What a backend offers; GraphStore is the one for file systems."""

    @abstractmethod
    def read(self, table: str) -> DataFrame: ...

    @abstractmethod
    def version(self) -> int: ...

    @abstractmethod
    def commit(self, changes: dict[str, Change], began: int | None = None) -> bool: ...

    @abstractmethod
    def exists(self, table: str) -> bool: ...

    def write(self, table: str, df: DataFrame, began: int | None = None) -> None:
        """Put df in place of the table's rows."""
        self.commit({table: Change(rows=df, full=True)}, began)

    def append(self, table: str, df: DataFrame) -> None:
        self.commit({table: Change(rows=df)})


class GraphStore(TableStore):
    def __init__(self, spark: SparkSession, path: str, format: str = "parquet"):
        if format not in FORMATS:
            raise StorageError(f"Unknown storage format: {format}")
        self.spark, self.path, self.format = spark, path.rstrip("/"), format
        self.log = CommitLog(spark, self.path)

    # files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    # tables

    def initialize(self) -> GraphStore:
        """Make the tables that are not there, empty, in one commit."""
        state = self.log.state()
        if state.number < 0 and any(_files(self.spark, f"{self.path}/{table}") for table in TABLES):
            raise StorageError(f"{self.path} has tables but no log of commits")
        if missing := [table for table in TABLES if table not in state.tables]:
            self.commit({table: Change(full=True) for table in missing})
        return self

    def version(self) -> int:
        """The number of the last commit."""
        return self.log.state().number

    def exists(self, table: str) -> bool:
        return table in self.log.state().tables

    def folder(self, table: str, name: str) -> str:
        return f"{self.path}/{table}/{name}"

    def read(self, table: str) -> DataFrame:
        """The rows as of now. Where commits took rows away, an anti join leaves them out; compact() ends that."""
        return self._of(self.log.state(), table)

    def _of(self, state: State, table: str) -> DataFrame:
        schema, parts = struct_of(TABLES[table]), state.tables.get(table, [])
        load = lambda schema, names: self.spark.read.schema(schema).format(self.format).load([self.folder(table, n) for n in names])
        last_gone = max((p["n"] for p in parts if "gone" in p), default=-1)
        after = [p["rows"] for p in parts if "rows" in p and p["n"] >= last_gone]
        out = [load(schema, after)] if after else []
        if before := [p for p in parts if "rows" in p and p["n"] < last_gone]:
            key, at = KEYS[table], F.lit(0)
            gone = [load(struct_of(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema if f.name in key)), [p["gone"]]).select(*[F.col(k).alias(f"__{k}") for k in key], F.lit(p["n"]).alias("__gone")) for p in parts if "gone" in p]
            rows = reduce(DataFrame.unionByName, [load(schema, [p["rows"]]).withColumn("__at", at + p["n"]) for p in before])
            same = reduce(Column.__and__, [F.col(k) == F.col(f"__{k}") for k in key])
            out.append(rows.join(reduce(DataFrame.unionByName, gone), same & (F.col("__gone") > F.col("__at")), "left_anti").drop("__at"))
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], schema)

    def commit(self, changes: dict[str, Change], began: int | None = None, stream: tuple[str, int] | None = None) -> bool:
        """Change tables, all or none.

        began: the version that the changes were made from; if another commit has changed one of these tables since, nothing happens
        but a ConflictError. Without it the changes hold whatever went before. stream: a stream and the number of its batch; if that
        batch or a later one of the stream was committed before, nothing happens and the answer is False.
        """
        entry, made = {"tables": {}}, []
        if stream:
            entry["streams"] = {stream[0]: stream[1]}
            if self.committed(*stream):
                return False
        for table, change in changes.items():
            entry["tables"][table] = {"full": True} if change.full else {}
            schema = struct_of(TABLES[table])
            for what, df, names in (("rows", change.rows, schema.names), ("gone", change.gone, KEYS.get(table))):
                if df is not None:
                    name = f"{what}-{uuid.uuid4().hex}"
                    made.append(self.folder(table, name))
                    df.select(*[F.col(f.name).cast(f.dataType) for f in schema if f.name in names]).write.format(self.format).save(made[-1])
                    entry["tables"][table][what] = name
        try:
            while True:
                state = self.log.state()
                if began is not None and state.number > began and (both := self.log.touched_since(began, state.number) & set(changes)):
                    raise ConflictError(f"Changed by another writer: {', '.join(sorted(both))}")
                if stream and state.streams.get(stream[0], -1) >= stream[1]:
                    break
                if self.log.add(state, entry):
                    return True
        except ConflictError:
            for path in made:
                self._delete(path)
            raise
        for path in made:
            self._delete(path)
        return False

    def committed(self, name: str, batch: int) -> bool:
        return self.log.state().streams.get(name, -1) >= batch

    def claim_ids(self, count: int) -> int:
        """The first of count event ids that no other writer gets."""
        while True:
            state = self.log.state()
            if self.log.add(state, {"next_id": state.next_id + count}):
                return state.next_id

    def compact(self, table: str) -> None:
        """Write the table anew, without what has gone. Tables that are only added to need none of it."""
        state = self.log.state()
        if any("gone" in p for p in state.tables.get(table, [])) or table in KEYS and len(state.tables.get(table, [])) > 1:
            self.write(table, self._of(state, table), began=state.number)

    def cleanup(self) -> None:
        """Remove folders that the current state does not name. No other writer may be at work, nor a reader of an earlier state."""
        state = self.log.state()
        for table in TABLES:
            named = {p[k] for p in state.tables.get(table, []) for k in ("rows", "gone") if k in p}
            for status in _files(self.spark, f"{self.path}/{table}"):
                if status.getPath().getName() not in named:
                    self._delete(status.getPath().toString())

    def backup(self, to: str | None = None) -> str:
        """Copy all tables, as they are at one moment; by default to <path>_backup_<time>."""
        if to is None:
            to = self.spark.range(1).select(backup_name(self.path, F.current_timestamp())).first()[0]
        state = self.log.state()
        GraphStore(self.spark, to, self.format).commit({table: Change(rows=self._of(state, table), full=True) for table in TABLES if table in state.tables})
        return to

    def restore(self, backup: str) -> None:
        """Put a backup's tables in place of the current ones, in one commit; the backup stays."""
        if not self._exists(backup):
            raise StorageError(f"Backup directory does not exist: {backup}")
        other = GraphStore(self.spark, backup, self.format)
        state = other.log.state()
        self.commit({table: Change(rows=other._of(state, table), full=True) for table in TABLES if table in state.tables})


def rows_from_json(text: str, load: Callable[[str], str] | None = None) -> list[dict[str, Any]]:
    """Rows of a command line argument: a JSON object or list, or @name for a file that load reads."""
    try:
        found = json.loads(load(text[1:]) if text.startswith("@") and load else text)
    except json.JSONDecodeError as e:
        raise StorageError(f"Invalid JSON: {e}") from e
    return found if isinstance(found, list) else [found]
