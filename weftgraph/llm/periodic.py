"""Periodic runs of words: where a text repeats itself without a gap, as in loops and boilerplate.

A text's words are its maximal pieces without [\\x20\\x09-\\x0D]. A run is a stretch of consecutive words with smallest period q (words
q apart are equal), of at least `least` words and two periods, that no neighbouring word extends.

Main and Lorentz: a segment is cut at its midpoint, and what repeats across the midpoint is found from two Z-functions over interned
word ids, for each period at once; the halves follow. A stretch that a word beyond the segment would extend belongs to a larger
segment, so each run is found once, and of the periods that name the same stretch the smallest is kept. A Z-function visits only the
places that begin with its first word, since all others have length 0, and compares whole stretches at once; a segment goes unread if
no six of its words return within it, because a run of twelve holds six such words. Segments within a run that was found already have
its runs in common, period after period, so three periods of it are looked at. Time is n log n at worst, memory is linear.

Null, empty and blank texts have no words and no runs. Rows that repeat an id or a text each get their row. Null ids pass, extra
columns are left behind, an empty table gives an empty one. Texts of any length are taken whole, one after the other in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._runtime import blocks, pick

#: A run's least number of words.
LEAST = 12
#: Any run repeats that many words in a row: half of LEAST, and no more than a period of a longer one.
GRAM = LEAST // 2

Words = list[bytes]


def words_of(text: str | None) -> Words:
    return text.encode().split() if text else []


def interned(words: Words) -> np.ndarray:
    """A number for each word, equal for equal words."""
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))


def z_function(x: np.ndarray, upto: int) -> np.ndarray:
    """For each place before upto, how many values from there on are those that x begins with; 0 at place 0."""
    n, z, v = len(x), [0] * upto, x.tolist()
    raw = memoryview(x).cast("B")
    left = right = 0
    for i in np.flatnonzero(x[:upto] == x[0])[1:].tolist():
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        else:
            k = 1
        most = n - i
        near = min(most, k + 8)
        while k < near and v[k] == v[i + k]:
            k += 1
        if k == near < most:  # whole stretches by doubled steps, then by halved ones to the first difference
            step = 8
            while step:
                while step <= most - k and raw[4 * k : 4 * (k + step)] == raw[4 * (i + k) : 4 * (i + k + step)]:
                    k += step
                    step *= 2
                step //= 2
        left, right, z[i] = i, i + k, k
    return np.array(z, np.int64)


def _earlier(ids: np.ndarray) -> np.ndarray:
    """For each place, the last one before it that seems to begin with the same GRAM words, or -1; hashes may only see too many."""
    n = len(ids) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    order = np.argsort(h, kind="stable")
    out = np.full(n, -1, np.int64)
    same = h[order[1:]] == h[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of the rows (start, end, period) with the same start and end, the one with the smallest period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    return rows[first]


def _crossing(ids: np.ndarray, low: int, mid: int, high: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (start, end, period) of what repeats inside [low, high) and holds the words on both sides of mid, and which of them no
    word beyond the segment extends: those are runs."""
    a, b = ids[low:mid], ids[mid:high]
    na, nb, gap = len(a), len(b), np.array([-1], np.int32)
    ahead = z_function(np.concatenate([b, gap, a, b]), nb + 1 + na)
    back = z_function(np.concatenate([a[::-1], gap, b[::-1], a[::-1]]), na + 1 + nb)
    found = []
    p = np.arange(1, nb + 1)  # words from mid on against those p after them, and backwards from both
    fore = np.append(ahead[1:nb], 0)
    rear = back[na + 1 + nb - p]
    found.append((mid - rear, mid + p + fore, p))
    p = np.arange(1, na + 1)  # the same with those p before
    fore = ahead[nb + 1 + na - p]
    rear = np.append(back[1:na], 0)
    found.append((mid - p - rear, mid + fore, p))
    start, end, p = (np.concatenate(c) for c in zip(*found, strict=True))
    keep = (end - start >= np.maximum(least, 2 * p)) & (start < mid) & (end > mid)
    start, end, p = start[keep], end[keep], p[keep]
    rows = _smallest(np.stack([start, end, p], axis=1))
    (start, end, p), n = rows.T, len(ids)
    longer = (start == low) & (start > 0) & (ids[np.maximum(start - 1, 0)] == ids[np.maximum(start - 1, 0) + p])
    longer |= (end == high) & (end < n) & (ids[np.minimum(end, n - 1)] == ids[np.minimum(end, n - 1) - p])
    return rows, ~longer


def _inside(ids: np.ndarray, earlier: np.ndarray, low: int, high: int, least: int, cover: int) -> list[np.ndarray]:
    """Rows (start, end, period) of the runs inside [low, high). cover: the least period of a stretch that holds all of it, or 0."""
    if high - low < least or earlier[low : high - GRAM + 1].max() < low:
        return []
    if 0 < 6 * cover < high - low:
        # within a run of period q, runs are shorter than 2q and return every q words
        left = _inside(ids, earlier, low, low + 3 * cover, least, 0)
        found = [*left, *_inside(ids, earlier, high - 3 * cover, high, least, 0)]
        for rows in left:
            rows = rows[(rows[:, 0] > low) & (rows[:, 0] <= low + cover) & (rows[:, 2] < cover)]
            times = (high - 1 - rows[:, 1]) // cover
            by = (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + 1) * cover
            again = np.repeat(rows, times, axis=0)
            again[:, :2] += by[:, None]
            found.append(again)
        return found
    mid = (low + high) // 2
    rows, whole = _crossing(ids, low, mid, high, least)
    found = [rows[whole]]
    for a, b in ((low, mid), (mid, high)):
        over = rows[(rows[:, 0] <= a) & (rows[:, 1] >= b), 2]
        found += _inside(ids, earlier, a, b, least, int(over.min()) if len(over) else cover)
    return found


def runs_of(ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    if least < LEAST:
        raise ValueError(f"runs of fewer than {LEAST} words are not looked for")
    found = _inside(ids, _earlier(ids), 0, len(ids), least, 0) if len(ids) >= least else []
    rows = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    rows = _smallest(rows)
    rows = np.stack([rows[:, 0], rows[:, 1] - rows[:, 0], rows[:, 2]], axis=1)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapsed(words: Words, rows: np.ndarray) -> bytes:
    """The words without those that a run of rows holds after its first period, joined by a space."""
    if not len(rows):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, rows[:, 0] + rows[:, 2], 1)
    np.add.at(edges, rows[:, 0] + rows[:, 1], -1)
    stay = np.cumsum(edges[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(stay).tolist()])


def _scanned(docs: DataFrame, least: int, id_col: str, text_col: str, edit: Callable | None, digests: bool) -> DataFrame:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    longest = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def one(doc_id, text: str | None) -> tuple:
        words = words_of(text)
        words = edit(doc_id, words) if edit else words
        rows = runs_of(interned(words), least)
        best = rows[np.lexsort((rows[:, 2], rows[:, 0], -rows[:, 1]))[0]].tolist() if len(rows) else None
        top = dict(zip(("start", "length", "period"), best, strict=True)) if best else None
        if digests:
            lines = "".join("%d,%d,%d\n" % (a, b, c) for a, b, c in rows.tolist())
            return len(words), len(rows), top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, rows)).hexdigest()
        return len(words), len(rows), top, [{"start": a, "length": b, "period": c} for a, b, c in rows.tolist()], collapsed(words, rows).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), longest, *([pa.string()] * 2 if digests else [spans, pa.string()])]
        names = ["doc_id", "n_words", "n_runs", "longest", *(["runs_sha256", "collapsed_sha256"] if digests else ["runs", "collapsed"])]
        for block in blocks(batches):
            found = [one(i, t) for i, t in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([block.column(0), *[pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]], names=names)

    docs, span = pick(docs, id_col, text_col), "struct<start: bigint, length: bigint, period: bigint>"
    last = "runs_sha256 string, collapsed_sha256 string" if digests else f"runs array<{span}>, collapsed string"
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_runs bigint, longest {span}, {last}")


def scan(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_runs, longest (the longest run, of equals the first, then that of the smaller period; null without runs),
    runs (start, length, period by start, then period), collapsed (the text's words, each run cut to its first period). No shuffle."""
    return _scanned(docs, least, id_col, text_col, None, False)


def digests(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[object, Words], Words] | None = None) -> DataFrame:
    """As scan(), with digests in place of the runs (lines `start,length,period`) and the collapsed text; edit(id, words) gives the
    words to look at in place of the text's own."""
    return _scanned(docs, least, id_col, text_col, edit, True)
