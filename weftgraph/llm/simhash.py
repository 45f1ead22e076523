"""SimHash near-duplicates by deletion-variant signatures.

A text's words (split at ASCII white space, A-Z lower-cased) give `shingle`-word shingles, repeats included; fewer words give
the whole sequence, none the fingerprint zero. Bit b of the fingerprint is set if it is set in over half of the shingles' XXH64.
Fingerprints at most `radius` = 4 bits apart are linked.

Cut into 3 segments, two linked fingerprints differ by at most one bit in some segment (4 bits over 3 segments). Each segment
is indexed as it is and with each bit in turn made a wildcard, so that segment meets its one-bit neighbours by equality: rows
with the wildcard bit clear join those with it set, and the exact segment joins itself. The join's condition counts the
differing bits, so only links leave it.

A bucket of over `dense` different fingerprints is split by the same method one level deeper: its members agree outside the other
two segments but for one bit, so those are cut into 3 pieces of which linked ones again differ by at most one bit in some piece.
Only what is crowded even then (thousands of fingerprints that agree in all but some 30 bits: one family of near copies) goes
another exact way, whose rows grow in proportion: each emits the 2,081 values at most 2 bits away, and those that share a value
are linked to the least of them. Two fingerprints share one exactly if they differ by at most 4 bits, so components stay the same.

Copies collapse before any of this: the work is on different fingerprints, a document only looks up its own.
Null texts count as empty; all empty texts are linked. A row without doc_id belongs to its group but never names it; a group
without any doc_id has a null component_id. Rows that repeat a doc_id are kept. Texts of any length are taken whole, an empty
table gives an empty one, and other columns, whatever their names, are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import star_components
from ._runtime import blocks, checkpointed, counted, pick

SEGMENTS = ((0, 21), (21, 21), (42, 22))
RADIUS = 4
#: The other two segments of a bucket of segment 0, 1 or 2 (42 or 43 bits), as one number, are cut into these.
PIECES = ((0, 14), (14, 14), (28, 15))
#: Different fingerprints in a bucket above which it is split.
DENSE = 1024
_WIDTH = max(width for _, width in SEGMENTS)


def text_fingerprint(text: str | None, shingle: int) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
    starts = [0, *ends]
    hashes = np.array([xxh64_intdigest(joined[a : b - 1], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (64 bits as a long) of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            fps = np.array([text_fingerprint(t, shingle) for t in block.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    docs = pick(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _variants(of: Column, pieces: tuple[tuple[int, int], ...]) -> list[Column]:
    """Of a number: for each piece, the exact one and one with each bit deleted. A key holds piece, wildcard and value; its lowest
    bit is the deleted bit."""
    out = []
    for s, (at, width) in enumerate(pieces):
        value = F.shiftrightunsigned(of, at).bitwiseAND(F.lit((1 << width) - 1))
        out.append((value + ((s * 32) << _WIDTH)) * 2)
        for bit in range(width):
            rest = value.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << bit)))
            out.append((rest + ((s * 32 + bit + 1) << _WIDTH)) * 2 + F.shiftright(value, bit).bitwiseAND(F.lit(1)))
    return out


def _keyed(rows: DataFrame, of: Column, pieces: tuple[tuple[int, int], ...], key: str) -> DataFrame:
    """rows with a row for each variant: its key, the deleted bit, and whether none is deleted."""
    each = rows.select("*", F.explode(F.array(*_variants(of, pieces))).alias("k"))
    return each.select(*rows.columns, F.shiftright("k", 1).alias(key), (F.col("k") % 2).alias("bit"), (F.shiftright("k", _WIDTH + 1) % 32 == 0).alias("exact"))


def _meet(keyed: DataFrame, on: list[str], radius: int) -> DataFrame:
    """a, b: fingerprints of one bucket that differ in its deleted bit, or in none of its bits, and by at most radius bits."""
    left = keyed.where("bit = 0").select(*on, F.col("fp").alias("a"))
    right = keyed.where("bit = 1 or exact").select(*on, F.col("fp").alias("b"), "exact")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = left.join(right, on).where(near & (~F.col("exact") | (F.col("a") < F.col("b"))))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _split(keyed: DataFrame, on: list[str], dense: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of buckets of up to dense members, and those of the others, if there are any."""
    crowded, seen = counted(keyed.groupBy(*on).count().where(F.col("count") > dense).select(*on))
    if not seen["n"]:
        return keyed, None
    return keyed.join(crowded, on, "left_anti"), keyed.join(crowded, on, "left_semi")


def links(fps: DataFrame, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """a, b: pairs of different fingerprints of fps (column fp, each once) at most radius bits apart, enough for components:
    all of them, but of buckets that are crowded twice only each one's link to the least that shares a neighbour."""
    if radius != RADIUS:
        raise ValueError("three pieces with one wildcard and neighbours of two bits hold for a radius of 4")
    few, many = _split(_keyed(fps.select("fp"), F.col("fp"), SEGMENTS, "key"), ["key"], dense)
    pairs = _meet(few, ["key"], radius)
    if many is not None:
        low = lambda bits: F.lit((1 << bits) - 1)
        segment = F.shiftright("key", _WIDTH + 5)
        first = F.shiftrightunsigned("fp", 21)
        second = F.shiftleft(F.shiftrightunsigned("fp", 42), 21).bitwiseOR(F.col("fp").bitwiseAND(low(21)))
        other = F.when(segment == 0, first).when(segment == 1, second).otherwise(F.col("fp").bitwiseAND(low(42)))
        few, many = _split(_keyed(many.select("fp", "key"), other, PIECES, "part"), ["key", "part"], dense)
        pairs = pairs.unionByName(_meet(few, ["key", "part"], radius))
    if many is not None:
        members = many.select("fp").distinct()
        flips = [0, *(1 << i for i in range(64)), *(1 << i | 1 << j for i, j in combinations(range(64), 2))]
        flips = [f - (1 << 64) if f >> 63 else f for f in flips]
        ball = members.select("fp", F.explode(F.lit(flips)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("near"))
        least = ball.groupBy("near").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("near", "a")
        pairs = pairs.unionByName(ball.join(least, "near").where("fp <> a").select("a", F.col("fp").alias("b")))
    return pairs.distinct()


def groups(docs: DataFrame, shingle: int = 4, dense: int = DENSE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach) of every document."""
    each = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    fps = checkpointed(fps.repartition(parts, "fp"))  # small rows, but each gives 67 keys: not to be merged into few tasks
    of = star_components(links(fps.select("fp"), dense=dense)).select(F.col("node").alias("fp"), "component")
    named = fps.join(of, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = checkpointed(named.groupBy("component").agg(F.min("least").alias("component_id")))  # dealt anew below, so that Spark can split a large component
    return each.join(named.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
