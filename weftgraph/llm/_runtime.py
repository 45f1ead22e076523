"""What the operators share: input selection, bounded Arrow blocks and lineage cuts that survive lost executors."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import checkpointed, counted, stored

__all__ = ["Rows", "blocks", "checkpointed", "counted", "frequent", "hex64", "pick", "release", "ship", "stored"]

#: Bytes of text that one step in a Python worker holds as objects at once.
BLOCK_BYTES = 4 << 20


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application: they need not have it installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="weftgraph-")) / "weftgraph.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        sc.addPyFile(str(to))
        _shipped.add(sc.applicationId)


def pick(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that an operator works on; any other column, whatever its name, is left behind."""
    ship(docs.sparkSession)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))


def release() -> None:
    """Give freed memory back to the system: an executor's idle Python workers should not hold what a task has needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices whose buffers hold about `most` bytes; one longer row is a slice of its own."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        step = max(1, min(rows, rows * most // max(batch.nbytes, 1)))
        for at in range(0, rows, step):
            part = batch.slice(at, step)
            if part.num_rows > 1 and part.nbytes > 2 * most:  # long rows stand together
                for k in range(part.num_rows):
                    yield part.slice(k, 1)
            else:
                yield part
    release()


#: Rows that a key may always have in one range, and how many rows of a key that has as many as allowed are looked at on average.
_ROWS_OF_A_KEY, _SEEN = 1_000, 64


def frequent(rows: DataFrame, key: str, share: float | None = None) -> list[int]:
    """The values of key that would fill half a range of an exchange, and some that fill a quarter: for those that do, another way
    keeps tasks even.

    rows is a written table. Half a range is 0.5 / spark.sql.shuffle.partitions of all rows (a thousandth at most, 1,000 rows at
    least), or share of them. Keys are counted in a sample in which such a key has 64 rows on average, as a range exchange samples
    its bounds; the values returned are at most 4 for each partition. Which values are found decides how even the tasks are, not
    what they return.
    """
    n = rows.count()
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    allowed = max(2.0, n * share) if share else max(float(_ROWS_OF_A_KEY), n * min(0.001, 0.5 / parts))
    every = max(1.0, allowed / _SEEN)
    seen = rows.select(key)
    seen = seen.sample(1 / every, seed=11) if every > 1 else seen
    counts = seen.groupBy(key).count().where(F.col("count") >= max(2.0, allowed / every / 2))
    return [r[0] for r in counts.select(key).collect()]


class Rows:
    """Sparse rows of a sample that fits on the driver: slots and values of all rows, one after the other, and a bias of 1 in each."""

    def __init__(self, at: np.ndarray, value: np.ndarray, lengths: np.ndarray, width: int):
        self.at, self.value, self.lengths, self.width = at, value, lengths, width
        self.ends = np.concatenate([[0], np.cumsum(lengths)])
        self._by_slot: tuple[np.ndarray, ...] | None = None

    @classmethod
    def of(cls, table: pa.Table, width: int) -> Rows:
        """From the list columns at and value."""
        at, value = (table[c].combine_chunks() for c in ("at", "value"))
        lengths = np.diff(at.offsets.to_numpy()) if table.num_rows else np.empty(0, np.int64)
        return cls(at.flatten().to_numpy(), value.flatten().to_numpy(), lengths, width)

    def __len__(self) -> int:
        return len(self.lengths)

    def take(self, rows: np.ndarray) -> Rows:
        """Those where rows is true."""
        inside = np.repeat(rows, self.lengths)
        return Rows(self.at[inside], self.value[inside], self.lengths[rows], self.width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        """A value for each row; w has the bias last."""
        out = np.full(len(self), w[-1], dtype=np.float64)
        if len(self.at):
            out[self.lengths > 0] += np.add.reduceat(self.value * w.astype(np.float32)[self.at], self.ends[:-1][self.lengths > 0])
        return out

    def back(self, r: np.ndarray) -> np.ndarray:
        """The rows' sum, each times its value in r."""
        if self._by_slot is None:
            order = np.argsort(self.at, kind="stable")
            slots, first = np.unique(self.at[order], return_index=True)
            self._by_slot = np.repeat(np.arange(len(self), dtype=np.int32), self.lengths)[order], self.value[order], slots, first
        row, value, slots, first = self._by_slot
        out = np.zeros(self.width + 1)
        out[-1] = r.sum()
        if len(slots):
            out[slots] = np.add.reduceat(value * r.astype(np.float32)[row], first)
        return out

    def squares(self) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.value.astype(np.float64) ** 2)])
        return sums[self.ends[1:]] - sums[self.ends[:-1]] + 1


def hex64(col):
    """16 lowercase hexadecimal digits of a long."""
    return F.lpad(F.lower(F.hex(col)), 16, "0")
