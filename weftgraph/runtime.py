"""Lineage cuts that survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .errors import ConfigurationError


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or on one machine a folder of our own."""
    sc = spark.sparkContext
    if (at := sc.getCheckpointDir()) is None:
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not sc.master.startswith("local"):
                raise ConfigurationError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="weftgraph-")
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir()
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs a re-read only."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def counted(df: DataFrame, *aggregates: Column) -> tuple[DataFrame, dict]:
    """checkpointed(df), with its number of rows as n and other aggregates of them, seen while it is written: no job besides.

    A task that is run again may be counted twice, so n tells whether there are rows, and changes of the others a change of df.
    """
    seen = Observation()
    out = checkpointed(df.observe(seen, F.count(F.lit(1)).alias("n"), *aggregates))
    return out, seen.get


def one_row(spark: SparkSession, **values) -> DataFrame:
    """A row of constants, which no Python worker has to make."""
    return spark.range(0, 1, 1, 1).select(*[F.lit(value).alias(name) for name, value in values.items()])


#: Paths of tables to remove at the end of each open scratch(), the innermost last.
_open: list[list[str]] = []


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(spark: SparkSession, write: Callable[[str], None]) -> str:
    """A path in the shared folder, after write(path); removed at the end of the scratch() around it, or else with the session."""
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    write(path)
    fs, at = _file(spark, path)
    fs.deleteOnExit(at)
    if _open:
        _open[-1].append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Like checkpointed(), as compressed columns, at a written() path."""
    spark = df.sparkSession
    path = written(spark, df.write.parquet)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """df with place: the number of each row in the order in which they stand, from 0; stored()."""
    held = stored(df.withColumn("at", F.monotonically_increasing_id()))
    rows = held.groupBy(F.shiftright("at", 33).alias("range")).count().orderBy("range").collect()  # a row for each task
    starts, n = [], 0
    for r in rows:
        starts.append((r["range"], n))
        n += r["count"]
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "range long, before long"))
    return held.join(starts, F.shiftright("at", 33) == F.col("range")).select(*df.columns, (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("place"))


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, at = _file(spark, path)
        fs.delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables stored inside are removed at the end: by then, what was made of them must have been written. Gives their paths, the
    latest last; those taken off the list stay."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        remove(spark, _open.pop())


@contextmanager
def dealt_by(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """df dealt and sorted by key and held while rounds join it again and again: only the other side of those joins moves."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.repartition(parts, key).sortWithinPartitions(key).persist()
    try:
        yield held
    finally:
        held.unpersist()
