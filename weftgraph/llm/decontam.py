"""Benchmark decontamination with an FM-index over each shard of the corpus.

Words: A-Z lower-cased, then maximal runs of letters a-z, digits and all characters from U+0080. A benchmark item's windows are
its runs of `window` consecutive words; an item of fewer, but not none, is one window. A document word inside any occurrence of
a window is hit.

A shard is a run of whole documents that one task streams. Its words become numbers: a benchmark word its rank, any other word a
separator, which no window contains. Over that sequence stands an FM-index: suffix array by prefix doubling, its
Burrows-Wheeler transform in a wavelet matrix with popcount ranks, and the positions of sampled suffixes. All windows search
backwards at once, from their last word to their first; the rows that remain walk to a sampled suffix to find their positions;
the spans are merged for each document. Runs of benchmark words shorter than the shortest window are left out of the sequence,
as no window fits into them.

The benchmark is taken in blocks of at most `block_words` words (a longer item is a block of its own). One block is sent with
the tasks at a time: with several, each has its pass over the documents, and what a pass has found is written with the texts and
merged with what the next one finds. Only words of the block are in a pass's index, so an index is far smaller than its shard.

Null texts and texts without words have no words and are not contaminated. Rows are judged one by one, so repeated doc_ids,
null doc_ids and repeated rows change nothing; texts of any length are searched whole. A repeated item_id counts once; a null one
is called 'null'. An empty table gives an empty one, an empty benchmark no hits. Other columns, whatever their names, are left
behind.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import blocks, pick, release, stored

WINDOW = 13
#: Words of one block of the benchmark (some 10 bytes each), and of one shard of the corpus.
BLOCK_WORDS, SHARD_WORDS = 2_000_000, 400_000
#: Every so many positions, a suffix is sampled.
SAMPLED = 8
_U = np.uint64
_RUN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")  # a word before its letters are lowered
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD).split() if text else []


class Bits:
    """Bits in 64-bit words with a count before each."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        at = np.asarray(at, dtype=np.int64)
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((_U(1) << bit) - _U(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & _U(1) == 1


class Wavelet:
    """Wavelet matrix of numbers below 2**levels."""

    def __init__(self, values: np.ndarray, levels: int):
        self.planes, self.zeros = [], []
        for level in range(levels - 1, -1, -1):
            bit = (values >> level) & 1
            self.planes.append((level, Bits(bit)))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for (level, bits), zeros in zip(self.planes, self.zeros, strict=True):
            ones = bits.rank(at)
            at = np.where((symbols >> level) & 1 == 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self._down(symbols, at) - self._down(symbols, np.zeros_like(at))

    def access(self, at: np.ndarray) -> np.ndarray:
        symbols = np.zeros_like(at)
        for (level, bits), zeros in zip(self.planes, self.zeros, strict=True):
            one, ones = bits.get(at), bits.rank(at)
            symbols |= one.astype(np.int64) << level
            at = np.where(one, zeros + ones, at - ones)
        return symbols


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Positions in the order of their suffixes up to the next separator (0); ties by position. text ends with 0."""
    n = len(text)
    take = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    open_ = np.ones(n, dtype=bool)  # no separator so far
    for k in range(take):
        symbol = np.zeros(n, dtype=np.int64)
        symbol[: max(n - k, 0)] = text[k:]
        symbol[~open_] = 0
        key = (key << bits) | symbol
        open_ &= symbol != 0
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    gap = np.flatnonzero(text == 0)
    left = gap[np.searchsorted(gap, np.arange(n))] - np.arange(n)  # symbols before the separator
    while True:
        same = np.concatenate([~first[1:], [False]]) | ~first
        group = np.flatnonzero(same)
        group = group[left[order[group]] >= take]  # shorter ones are equal up to their separator
        if not len(group):
            return order
        at = order[group]
        head, tail = rank[at], np.where(left[at] >= take, rank[np.minimum(at + take, n - 1)], -1)
        again = np.lexsort((at, tail, head))
        at, head, tail = at[again], head[again], tail[again]
        order[group] = at
        new = np.concatenate([[True], (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])])
        rank[at] = np.maximum.accumulate(np.where(new, group, 0))
        first[group] = new
        take *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, bits: int):
        """text: numbers from 0 (separator) to 2**bits - 1; it begins and ends with 0."""
        order = suffix_array(text, bits)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        self.tree = Wavelet(text[order - 1], bits)  # of the first suffix, the last symbol: 0
        # a suffix at a run's first symbol is sampled too, so that no walk crosses a separator
        sampled = (order % SAMPLED == 0) | (text[order - 1] == 0)
        self.marks, self.samples = Bits(sampled), order[sampled]

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each window. windows: a row each, its words at the row's end."""
        n = len(windows)
        low, high = np.zeros(n, dtype=np.int64), np.full(n, self.starts[-1])
        for step in range(1, windows.shape[1] + 1):
            live = np.flatnonzero((lengths >= step) & (low < high))
            if not len(live):
                break
            c = windows[live, -step]
            low[live] = self.starts[c] + self.tree.rank(c, low[live])
            high[live] = self.starts[c] + self.tree.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in these rows."""
        out, rows, todo, steps = np.zeros(len(rows), dtype=np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            here = self.marks.get(rows)
            out[todo[here]] = self.samples[self.marks.rank(rows[here])] + steps
            rows, todo = rows[~here], todo[~here]
            if len(todo):
                c = self.tree.access(rows)
                rows = self.starts[c] + self.tree.rank(c, rows)
            steps += 1
        return out


class Phrases:
    """The windows of a block of the benchmark: each different one once, with the items that have it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        by: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for name, words in items:
            for i in range(max(1, len(words) - window + 1) if words else 0):
                by[tuple(words[i : i + window])].add(name)
        self.names = sorted({n for names in by.values() for n in names})
        at = {n: i for i, n in enumerate(self.names)}
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for p in by for w in p}))}
        self.bits = max(1, len(self.ids).bit_length())
        self.lengths = np.array([len(p) for p in by], dtype=np.int64)
        self.windows = np.zeros((len(by), window), dtype=np.int64)
        for row, p in enumerate(by):
            self.windows[row, window - len(p) :] = [self.ids[w] for w in p]
        self.owners = [np.array(sorted(at[n] for n in names)) for names in by.values()]
        self.owner_counts = np.array([len(o) for o in self.owners], dtype=np.int64)


def _hits(docs: list[np.ndarray], phrases: Phrases) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
    """For the documents of a shard (a number for each word): merged spans of hit words, and the items that occur."""
    spans, items = [[] for _ in docs], [[] for _ in docs]
    if not len(phrases.lengths):
        return spans, items
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    ends = np.cumsum(sizes + 1)
    raw = np.zeros(int(ends[-1]) + 1, dtype=np.int64)  # a separator before each document and at the end
    for d, end in zip(docs, ends, strict=True):
        raw[end - len(d) : end] = d
    edge = np.diff((raw != 0).astype(np.int8))
    a, b = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    long = b - a >= phrases.lengths.min()
    a, b = a[long], b[long]
    if not len(a):
        return spans, items
    width = b - a + 1  # a run and the separator after it
    at = np.repeat(a - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())  # places in raw
    at = np.concatenate([[0], at])
    index = FMIndex(raw[at], phrases.bits)
    low, high = index.search(phrases.windows, phrases.lengths)
    found = np.flatnonzero(high > low)
    if not len(found):
        return spans, items
    counts = (high - low)[found]
    which = np.repeat(found, counts)
    rows = np.repeat(low[found] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    place = at[index.locate(rows)]
    doc = np.searchsorted(ends, place, side="right")
    cover = np.zeros(len(raw) + 1, dtype=np.int64)
    np.add.at(cover, place, 1)
    np.add.at(cover, place + phrases.lengths[which], -1)
    edge = np.diff((np.concatenate([[0], np.cumsum(cover)[:-1], [0]]) > 0).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    for d, s, e in zip(np.searchsorted(ends, starts, side="right").tolist(), starts.tolist(), stops.tolist(), strict=True):
        begin = int(ends[d] - sizes[d])
        spans[d].append((s - begin, e - begin))
    pairs = np.unique(doc * len(phrases.lengths) + which)
    of, window = pairs // len(phrases.lengths), pairs % len(phrases.lengths)
    owner = np.concatenate([phrases.owners[w] for w in window.tolist()])
    for p in np.unique(np.repeat(of, phrases.owner_counts[window]) * len(phrases.names) + owner).tolist():
        items[p // len(phrases.names)].append(phrases.names[p % len(phrases.names)])
    return spans, items


def _item_blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[Phrases]:
    held, size = [], 0
    for name, text in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("string")).toLocalIterator():
        words = words_of(text)
        if held and size + len(words) > most:
            yield Phrases(held, window)
            held, size = [], 0
        held.append((name, words))
        size += len(words)
    yield Phrases(held, window)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _searched(docs: DataFrame, phrases: Phrases, last: bool) -> DataFrame:
    """docs (doc_id, text and, after a first pass, spans and items) with what one block finds: n_words and n_hit instead of the
    text in the last pass."""
    sent = docs.sparkSession.sparkContext.broadcast(phrases)  # of block_words words
    names = ["doc_id", "n_words", "spans", "items", "n_hit"] if last else ["doc_id", "text", "spans", "items"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import repeat

        phrases = sent.value
        number = phrases.ids.get
        held, counts, shard, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            spans, items = _hits(shard, phrases)
            columns = [pa.concat_arrays([b.column(i) for b in held]) for i in range(held[0].num_columns)]
            if len(columns) > 2:
                earlier = zip(columns[2].to_pylist(), columns[3].to_pylist(), strict=True)
                both = [(_merged([*now, *((x["start"], x["stop"]) for x in was)]), sorted({*named, *known})) for now, named, (was, known) in zip(spans, items, earlier, strict=True)]
                spans, items = map(list, zip(*both, strict=True))
            n_hit = [sum(stop - start for start, stop in s) for s in spans]
            listed = pa.array([[{"start": a, "stop": b} for a, b in s] for s in spans], _SPANS), pa.array(items, pa.list_(pa.string()))
            found = [columns[0], pa.array(counts, pa.int64()), *listed, pa.array(n_hit, pa.int64())] if last else [columns[0], columns[1], *listed]
            return pa.RecordBatch.from_arrays(found, names=names)

        for block in blocks(batches):
            held.append(block if not last or block.num_columns > 2 else block.select([0]))
            for text in block.column(1).to_pylist():
                words = words_of(text)
                counts.append(len(words))
                shard.append(np.fromiter(map(number, words, repeat(0)), np.int64, len(words)))
                size += len(words)
            if size >= SHARD_WORDS:
                yield flush()
                held, counts, shard, size = [], [], [], 0
        if held:
            yield flush()
        held, shard = [], []
        release()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, " if last else f"doc_id {kind}, text string, "
    out = docs.mapInArrow(run, schema + "spans array<struct<start:int,stop:int>>, items array<string>" + (", n_hit long" if last else ""))
    if last:
        return out
    written = stored(out)
    sent.destroy()
    return written


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, spans (word positions hit: start, stop; merged and ascending), items (names of items with windows that
    occur, ascending), n_hit of every document; no shuffle."""
    docs = pick(docs, id_col, text_col)
    rest = _item_blocks(benchmark, window, block_words)
    phrases = next(rest)
    for after in rest:
        docs = _searched(docs, phrases, last=False)
        phrases = after
    return _searched(docs, phrases, last=True)


def removed(docs: DataFrame, benchmark: DataFrame, mask: str = " ", window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_hit, kept_text of every document: each hit span, from its first word's begin to its last word's end, is mask."""
    texts = pick(docs, id_col, text_col)
    key = F.struct("doc_id", "text")
    found = hits(texts.select(key.alias("row"), "text"), benchmark, window, id_col="row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            texts = []
            for text, spans in zip(block.column(1).to_pylist(), block.column(3).to_pylist(), strict=True):
                at, out = 0, []
                if spans:
                    places = [m.span() for m in _RUN.finditer(text)]
                    for s in spans:
                        out += [text[at : places[s["start"]][0]], mask]
                        at = places[s["stop"] - 1][1]
                texts.append("".join(out) + (text or "")[at:])
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(2), pa.array(texts, pa.string())], names=["doc_id", "n_hit", "kept_text"])

    rows = found.select(F.col("doc_id.doc_id").alias("doc_id"), F.col("doc_id.text").alias("text"), "n_hit", "spans")
    return rows.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_hit long, kept_text string")
