"""Substring deduplication by sliding sentence spans.

A sentence ends at a line break or at [.!?] before white space. A span is a run of at least `size` consecutive sentences (3 by default)
that hold at least `min_words` words (any number by default): the shortest from each sentence on, and the shortest up to each; blank ones
do not count. Every longer repeated run of as many sentences and words is covered by such spans, so none is missed; a shorter one is
never a span, but for a sentence of at least `alone` words, if that is given. A span's words, lower-cased and joined by single blanks, are hashed to 128 bits. Its first occurrence, by doc_id, then
text hash, then place in the text, stays; the sentences of all others go, also where a document repeats itself.

Rows of spans are dealt by ranges of the hash and sorted within. Hashes that would fill half a range are found in a sample of the rows,
at most four for each range; their first occurrences come from a partial aggregate and go to the workers as a table of that bounded
size, so such spans are neither moved nor joined.

Null texts count as empty and have no sentences; texts with fewer sentences than a span needs have no spans; both stay as they
are, as does an empty table. Texts of any length are taken whole. Rows without doc_id come last in the order. Rows that repeat
doc_id and text are one document: they have the same spans, and keep the same text. Other columns, whatever their names, are
left behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import blocks, frequent, pick, stored

#: Sentences of a span.
SIZE = 3
_END = re.compile(r"[.!?]+\s+|\s*\n\s*")
_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def sentences(text: str) -> list[tuple[int, int]]:
    """Begin and end of each sentence, with the white space after it; together they are the whole text."""
    out, at = [], 0
    for m in _END.finditer(text):
        out.append((at, m.end()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def spans(counts: list[int], size: int = SIZE, min_words: int = 0, alone: int | None = None) -> list[tuple[int, int]]:
    """The shortest runs of at least size sentences and min_words words from and up to each sentence, and the sentences of at least alone
    words, as first and past-last number, by the words of each sentence; blank ones do not count."""
    words = np.array(counts, dtype=np.int64)
    full = np.flatnonzero(words)
    n = len(full)
    total = np.concatenate([[0], np.cumsum(words[full])])
    at = np.arange(n)
    stop = np.maximum(at + size, np.searchsorted(total, total[:-1] + min_words))
    start = np.minimum(at + 1 - size, np.searchsorted(total, total[1:] - min_words, side="right") - 1)
    forth, back = stop <= n, start >= 0
    long = at[words[full] >= alone] if alone is not None else at[:0]
    start, stop = np.divmod(np.unique(np.concatenate([(at * (n + 1) + stop)[forth], (start * (n + 1) + at + 1)[back], long * (n + 2) + 1])), n + 1)
    return list(zip(full[start].tolist(), (full[stop - 1] + 1).tolist(), strict=True))


def span_rows(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", min_words: int = 0, alone: int | None = None) -> DataFrame:
    """doc_id, row (hash of the text), own (hash of both), start, stop (sentence numbers), h1, h2 of every span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for block in blocks(batches):
            rows, found, hashes = [], [], []
            for i, text in enumerate(block.column(3).to_pylist()):
                norm = [" ".join(text[a:b].lower().split()) for a, b in sentences(text)] if text else []
                of = spans([s.count(" ") + 1 if s else 0 for s in norm], size, min_words, alone)
                rows += [i] * len(of)
                found += of
                hashes += [xxh3_128_digest(" ".join(filter(None, norm[a:b])).encode("utf-8", "surrogatepass")) for a, b in of]
            if not rows:
                continue
            take, pair = pa.array(rows, pa.int64()), np.array(found, dtype=np.int32)
            h = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(block.column(k).take(take) for k in range(3)), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["doc_id", "row", "own", "start", "stop", "h1", "h2"])

    docs = pick(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("row"), F.xxhash64("doc_id", "text").alias("own"), "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, own long, start int, stop int, h1 long, h2 long")


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending runs with those that meet or overlap joined."""
    out: list[tuple[int, int]] = []
    for start, stop in runs:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def _frequent_spans(rows: DataFrame, hot: list[int], place) -> DataFrame:
    """As repeated_spans() for the spans whose h1 is in hot; the runs of a document that lie together are merged here."""
    often = rows.where(F.col("h1").isin(hot))
    firsts = {(r["h1"], r["h2"]): (r["own"], r["start"]) for r in often.groupBy("h1", "h2").agg(F.min_by(F.struct("own", "start"), place).alias("f")).select("h1", "h2", "f.*").collect()}  # a row for each of hot
    sent = rows.sparkSession.sparkContext.broadcast(firsts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = sent.value
        for batch in batches:
            own, h1, h2, start, stop = (batch.column(i).to_pylist() for i in (2, 5, 6, 3, 4))
            at, found = [], []
            spot = None
            for i, (o, a, b) in enumerate(zip(own, h1, h2, strict=True)):
                if firsts[a, b] == (o, start[i]):
                    continue
                if spot != o:  # the spans of a document lie together
                    spot = o
                    at.append(i)
                    found.append([])
                found[-1].append((start[i], stop[i]))
            found = [merged(sorted(f)) for f in found]
            take = pa.array([i for i, f in zip(at, found, strict=True) for _ in f], pa.int64())
            runs = np.array([r for f in found for r in f], dtype=np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(runs[:, 0]), pa.array(runs[:, 1])], names=["doc_id", "row", "start", "stop"])

    return often.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, row long, start int, stop int")


def repeated_spans(rows: DataFrame, share: float | None = None) -> DataFrame:
    """doc_id, row, start, stop of the spans in rows (computed once) that occur earlier.

    share: hashes with more than this share of all rows do not go through the range exchange.
    """
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "start")
    hot = frequent(rows, "h1", share)
    rare = rows.where(~F.col("h1").isin(hot)) if hot else rows
    order = [F.asc_nulls_last("doc_id"), F.asc("row"), F.asc("start")]
    ranged = rare.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", *order)
    stream = Window.partitionBy("h1", "h2").orderBy(*order)
    found = ranged.withColumn("first", F.first(place).over(stream)).where(place > F.col("first")).select("doc_id", "row", "start", "stop")
    return found.unionByName(_frequent_spans(rows, hot, place)) if hot else found


def dedup(docs: DataFrame, size: int = SIZE, share: float | None = None, id_col: str = "doc_id", text_col: str = "text", min_words: int = 0, alone: int | None = None) -> DataFrame:
    """doc_id, n_sentences, removed (merged runs of removed sentences), kept_text of every document."""
    docs = pick(docs, id_col, text_col)
    gone = repeated_spans(stored(span_rows(docs, size, min_words=min_words, alone=alone)), share)
    of = gone.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # at most three for each sentence
    of = stored(of.select(F.col("doc_id").alias("id"), F.col("row").alias("of"), "spans"))  # of known size: few such documents are sent to the texts, many meet them in a shuffle
    joined = docs.join(of, docs["doc_id"].eqNullSafe(of["id"]) & (F.xxhash64(docs["text"]) == of["of"]), "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            counts, runs, texts = [], [], []
            for text, found in zip(block.column(1).to_pylist(), block.column(2).to_pylist(), strict=True):
                text = text or ""
                parts = sentences(text)
                counts.append(len(parts))
                gone = merged(sorted((s["start"], s["stop"]) for s in found or []))
                runs.append([{"start": a, "stop": b} for a, b in gone])
                at, kept = 0, []
                for a, b in gone:
                    kept.append(text[at : parts[a][0]])
                    at = parts[b - 1][1]
                texts.append("".join(kept) + text[at:])
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(texts, pa.string())], names=["doc_id", "n_sentences", "removed", "kept_text"])

    return joined.mapInArrow(cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_sentences long, removed array<struct<start:int,stop:int>>, kept_text string")
