"""Lempel-Ziv phrase fingerprints.

A text is parsed from left to right into phrases: each phrase is the shortest stretch that the text's dictionary does not hold
yet, and joins it (LZ78). The set of phrases is hashed; the `size` smallest hashes are the fingerprint. Two texts that compress
alike share phrases, so the share of common values among the smallest of both fingerprints estimates the likeness of their
dictionaries (Jaccard index, 0 to 1).

Null texts count as empty. An empty text has the fingerprint '' and likeness 1 to another empty one, 0 to any other.
A phrase that the text's end cuts off is in the dictionary already and adds nothing. Rows with equal doc_id are ordered by their
texts; rows without doc_id come last. Repeated rows have equal fingerprints. A text of any length is parsed whole; its dictionary,
some 100 bytes for each phrase, is in its worker's memory meanwhile. An empty table gives an empty one, and a single document is
its own successor. Other columns, whatever their names, are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ._runtime import blocks, pick

#: Hashes in a fingerprint, 8 hexadecimal digits each.
SIZE = 128
#: Range bounds of the dealing are off by at most 1 / ACCURACY of a range; what a task counts ids with grows with it.
ACCURACY = 10
_BASE = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


@lru_cache(maxsize=4)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2**64, and of its inverse."""
    base, inverse = np.full(length, _BASE), np.full(length, _U(pow(int(_BASE), -1, 1 << 64)))
    base[:1] = inverse[:1] = 1
    return np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


class Parse:
    """The dictionary of the text so far, and what has been read of the phrase that is open."""

    def __init__(self) -> None:
        self.seen: set[str] = set()
        self.open = ""

    def copy(self) -> Parse:
        other = Parse()
        other.seen, other.open = self.seen.copy(), self.open
        return other

    def feed(self, text: str) -> Parse:
        text = self.open + text
        seen, add, start, end, n = self.seen, self.seen.add, 0, len(self.open) + 1, len(text)
        while end <= n:
            phrase = text[start:end]
            if phrase not in seen:
                add(phrase)
                start = end
            end += 1
        self.open = text[start:]
        return self


def phrase_hashes(phrases: set[str]) -> np.ndarray:
    """A 64-bit hash of each phrase: a polynomial of its code points and length, mixed."""
    if not phrases:
        return np.empty(0, np.uint64)
    whole = "".join(phrases)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + _U(1)
    ends = np.cumsum(np.fromiter(map(len, phrases), np.int64, len(phrases)))
    starts = np.concatenate([[0], ends[:-1]])
    up, down = _powers(1 << max(16, len(whole).bit_length()))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[_U(0)], np.cumsum(points * up[: len(points)], dtype=np.uint64)])
        h = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
        h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def signature(phrases: set[str], size: int = SIZE) -> np.ndarray:
    """The smallest `size` 32-bit hashes, ascending and without repeats."""
    return np.unique((phrase_hashes(phrases) >> _U(32)).astype(np.uint32))[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = np.union1d(a, b)[:size]
    return float(np.isin(least, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def _hex(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = [t or "" for t in block.column(1).to_pylist()]
            sigs = [_hex(signature(Parse().feed(t).seen, size)) for t in texts]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(map(len, texts), pa.int64()), pa.array(sigs, pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    docs = pick(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def _place(ids: Column, bounds: list[int], step: int = 64) -> Column:
    """How many of the ascending bounds are at most the id, by two short scans instead of one long one."""
    if not bounds:
        return F.lit(0)
    all_, coarse = F.lit(bounds), F.lit(bounds[::step])
    block = F.size(F.filter(coarse, lambda b: b <= ids))
    within = F.size(F.filter(F.slice(all_, (block - 1) * step + 1, F.lit(step)), lambda b: b <= ids))
    return F.when(ids.isNull(), len(bounds)).when(block == 0, 0).otherwise((block - 1) * step + within).cast("int")


def _bounds(docs: DataFrame, parts: int) -> list:
    """Ids that cut all ids into at most `parts` ranges: quantiles of numbers, of other types the least id of each range that Spark
    deals ids by."""
    cuts = [k / parts for k in range(1, parts)]
    if not cuts:
        return []
    if isinstance(docs.schema["doc_id"].dataType, NumericType):
        found = docs.agg(F.percentile_approx("doc_id", cuts, ACCURACY * parts).alias("b")).first()["b"]
        return sorted(set(found or []))
    dealt = docs.select("doc_id").where("doc_id is not null").repartitionByRange(parts, "doc_id")
    return sorted({r["least"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("least")).collect()})[1:]


def edit_probe(docs: DataFrame, divisor: int = 4, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has its last floor(n / divisor) code points replaced by the first as many (or all) of the next document
    in ascending doc_id; after the last comes the first. Returns doc_id, n_chars, edited, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The texts are read once, and one shuffle deals them by ranges of doc_id; each range also gets the first document of the next
    one, so every task meets each document's successor while it streams. The parse of a text and of its edited text is shared
    up to the cut.
    Ranges come from counts over all ids, or from Spark's range partitioning where ids are no numbers; what the driver holds is one
    id for each range. Ids are of any type that has an order.
    """
    spark = docs.sparkSession
    docs = pick(docs, id_col, text_col)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(docs, parts)
    placed = docs.withColumn("part", _place(F.col("doc_id"), bounds))
    kind = docs.schema["doc_id"].dataType.simpleString()
    firsts = placed.groupBy("part").agg(F.min("doc_id").alias("first"))  # a row for each range
    before = F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy()))
    follow = firsts.select("first", before.alias("before"))
    led = placed.join(F.broadcast(follow), placed["doc_id"].eqNullSafe(follow["first"]), "left")
    here, ahead = F.struct("part", F.lit(False).alias("ahead")), F.struct(F.col("before").alias("part"), F.lit(True).alias("ahead"))
    to = F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, ahead))
    rows = led.select("doc_id", "text", F.explode(to).alias("to")).select("doc_id", "text", "to.part", "to.ahead")
    rows = rows.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "ahead", F.asc_nulls_last("doc_id"), F.asc_nulls_first("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the document that waits for its successor
        names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for block in blocks(batches):
            types[0] = block.column(0).type
            out = []
            for doc_id, text, part, ahead in zip(*(c.to_pylist() for c in block.columns), strict=True):
                if ahead and (held is None or held[0] != part):
                    continue  # rows that share the successor's doc_id
                text = text or ""
                cut = len(text) - len(text) // divisor
                parse = Parse().feed(text[:cut])
                at_cut = None if ahead else parse.copy()
                sig = signature(parse.feed(text[cut:]).seen, size)
                if held is not None and held[0] == part:
                    _, before, was, was_cut, state, was_sig = held
                    tail = text[: len(was) - was_cut]
                    new = signature(state.feed(tail).seen, size)
                    out.append((before, len(was), was[:was_cut] + tail, _hex(was_sig), _hex(new), likeness(was_sig, new, size), likeness(was_sig, sig, size)))
                held = None if ahead else (part, doc_id, text, cut, at_cut, sig)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
