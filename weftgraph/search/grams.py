"""An index for text search: which blocks of rows hold which three characters in a row.

Rows are dealt into blocks by their key's hash, and stand in the order of their blocks; postings say in which blocks a gram of the
lower-cased text occurs, in the order of the grams. A needle can only be where all its grams are, so a search reads the postings of
its grams (row groups of other grams are skipped by their bounds), then the blocks that hold all of them, and looks for the needle
itself in these: the result is that of a scan with `contains`, whatever the letters' case.

Needles of under three characters have no gram and scan all rows. Null texts are never found, every other row is found by the empty
needle. Texts are taken whole, of any length; keys may be null or repeat. Frequent grams stand in every block and leave out nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryError

#: Rows of a block, and blocks named in a filter; more of them come by a join.
BLOCK, NAMED = 1000, 2000


def grams(text: Column) -> Column:
    """The different runs of three characters of the lower-cased text, by one walk over it."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1)))


class TextIndex:
    """Opened from a folder that build() has written: rows/ (block, key, text), postings/ (gram, block)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, df: DataFrame, path: str, text: Column, key: str = "name", block: int = BLOCK) -> TextIndex:
        if block < 1:
            raise QueryError("a block holds one row at least")
        spark = df.sparkSession
        rows = df.select(F.col(key).alias("key"), text.cast("string").alias("text"))
        blocks = max(1, -(-rows.count() // block))
        # Rows that repeat a key are spread by their texts.
        placed = rows.withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(blocks)))
        placed.repartitionByRange("block").sortWithinPartitions("block").write.parquet(f"{path}/rows")
        held = spark.read.parquet(f"{path}/rows")
        # A task drops repeats before the shuffle, so a frequent gram comes once for each block and task.
        postings = held.select(F.explode(grams(F.col("text"))).alias("gram"), "block").distinct()
        postings.repartitionByRange("gram", "block").sortWithinPartitions("gram", "block").write.parquet(f"{path}/postings")
        return cls(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def blocks(self, needle: str) -> DataFrame | None:
        """The blocks that hold every gram of the needle; None if it has no gram."""
        wanted = [r[0] for r in self.spark.range(1).select(F.explode(grams(F.lit(needle)))).collect()]
        if not wanted:
            return None
        found = self.spark.read.parquet(f"{self.path}/postings").where(F.col("gram").isin(wanted))
        return found.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("block")

    def search(self, needle: str, named: int = NAMED) -> DataFrame:
        """key, text of the rows whose text contains the needle, in any case."""
        rows, blocks = self.rows(), self.blocks(needle)
        if blocks is not None:
            some = [r["block"] for r in blocks.limit(named + 1).collect()]
            rows = rows.where(F.col("block").isin(some)) if len(some) <= named else rows.join(blocks, "block", "left_semi")
        return rows.where(F.contains(F.lower("text"), F.lower(F.lit(needle)))).select("key", "text")
