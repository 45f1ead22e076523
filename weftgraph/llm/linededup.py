"""Line deduplication with built-in functions only: hashes travel, texts do not; documents get keep bitmaps.

A text is split at \\n (null or empty: one empty line). A line's key is the line without [\\x20\\x09-\\x0D] at both ends and with
A-Z lower-cased. Keys of at least `min_chars` code points that several documents hold keep their lines only in the smallest
doc_id that holds them (there all of them, repeats included); shorter keys always keep theirs.

Rows of (128-bit key hash, doc_id, position) are dealt by ranges of the hash and sorted by document and position within;
a window streams over each key and marks what comes after its first document. Keys that would fill half a range are found beforehand
in a sample of the rows, at most four for each range; their first documents come from a partial aggregate, sent to the rows as a
table of that bounded size. It makes no difference to the result which keys are found.

Rows without doc_id come after all others: they lose lines that any row with a doc_id holds, and keep those that only they
hold. Rows that repeat a doc_id count as one document. An empty table gives an empty one, and texts of any length are taken
whole. Extra columns of the input pass through apply_bitmaps() untouched; only names that begin with two underscores are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import frequent, pick, stored

#: What counts as white space at a line's ends, and a key's least length in code points.
BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """lower() is A-Z alone where a line is ASCII; else the letters are mapped one by one."""
    trimmed = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(trimmed) == F.length(trimmed), F.lower(trimmed)).otherwise(F.translate(trimmed, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (hash of the text, to tell rows of one doc_id apart), pos, h1, h2 of every line long enough."""
    texts = pick(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("row"), "text")  # hashed once, not for each line
    lines = texts.select("doc_id", "row", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.select("doc_id", "row", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keys.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(rows: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, row, pos of the lines in rows (as of line_rows, computed once) that an earlier document holds.

    share: keys with more than this share of all rows do not go through the range exchange.
    """
    hot = frequent(rows, "h1", share)
    late = lambda first: first.isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > first))
    if hot:
        often = rows.where(F.col("h1").isin(hot))
        firsts = often.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
        often = often.join(F.broadcast(firsts), ["h1", "h2"]).where(late(F.col("first"))).select("doc_id", "row", "pos")
        rows = rows.where(~F.col("h1").isin(hot))
    order = [F.asc_nulls_last("doc_id"), F.asc("pos")]
    stream = Window.partitionBy("h1", "h2").orderBy(*order)
    ranged = rows.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", *order)
    rare = ranged.withColumn("first", F.first("doc_id").over(stream)).where(late(F.col("first"))).select("doc_id", "row", "pos")
    return rare.unionByName(often) if hot else rare


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, share: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, keep: for each document that loses lines, its bitmap as words of 64 lines up to the last that loses one.

    Bit i % 64 of word i div 64 is 0 if line i goes; lines beyond the last word stay. The table is written, so that its size is
    known when texts meet it: Spark sends a small one to them, and shuffles both sides of a large one.
    """
    gone = dropped_lines(stored(line_rows(docs, min_chars, id_col, text_col)), share)
    words = gone.groupBy("doc_id", "row", F.expr("pos div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    lists = words.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("words"))
    before = lambda i: F.coalesce(F.get("words", i - 1)["word"], F.lit(-1).cast("bigint"))
    filled = F.transform("words", lambda w, i: F.concat(F.array_repeat(F.lit(-1).cast("bigint"), (w["word"] - before(i) - 1).cast("int")), F.array(w["bits"])))
    return stored(lists.select("doc_id", "row", F.flatten(filled).alias("keep")))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with its text column reduced to the kept lines, plus columns n_lines, n_dropped, kept_text.

    The text column itself is left as it was; kept_text is '' for a null text.
    """
    b = bitmaps.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("keep").alias("__keep"))
    joined = docs.join(b, docs[id_col].eqNullSafe(b["__id"]) & (F.xxhash64(docs[text_col].cast("string")) == b["__row"]), "left")
    lines = _lines(docs[text_col].cast("string"))
    word = lambda i: F.coalesce(F.get("__keep", F.floor(i / 64).cast("int")), F.lit(-1).cast("bigint"))
    bit = lambda i: F.getbit(word(i), i % 64) == 1
    kept = F.when(F.col("__keep").isNull(), lines).otherwise(F.filter(lines, lambda _, i: bit(i)))
    out = joined.withColumn("__lines", F.size(lines).cast("long")).withColumn("__kept", kept)
    return out.select(*[docs[c] for c in docs.columns], F.col("__lines").alias("n_lines"), (F.col("__lines") - F.size("__kept")).cast("long").alias("n_dropped"), F.array_join("__kept", "\n").alias("kept_text"))
