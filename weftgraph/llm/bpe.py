"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

Each match of the split pattern is merged on its own. The leaves of the tree stand for byte positions; a leaf holds the rank of
the pair that begins there, joined with its position, so that the root is the leftmost pair of the smallest rank. A merge
updates the leaves of the merged pair, of its right half and of its left neighbour: three logarithmic point updates. Trees of
short pieces stand side by side in arrays and step together; a long piece has its own. Pieces recur, so merged pieces are kept
in a table of bounded size per Python worker.

Texts: null counts as empty and gives no ids; an id that is null decodes to nothing; an unknown id raises. Texts of any length,
repeated rows and repeated ids are taken row by row; an empty table gives an empty one. Other columns, whatever their names, are
left behind.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._runtime import blocks, pick, release

#: Merged pieces that a worker keeps, some 150 bytes each; beyond it the table starts anew.
PIECES_KEPT = 200_000
#: Bytes of text or ids whose pieces a worker holds as objects at once.
BLOCK = 1 << 20
_NONE = 1 << 62


def read_ranks(path: str) -> bytes:
    """The rank file as it is; it is small (under 1 MB for 50,000 tokens) and goes to the workers with the task."""
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line.strip())}


def _put(tree: list[int], at: int, value: int) -> None:
    tree[at] = value
    at >>= 1
    while at:
        left, right = tree[2 * at], tree[2 * at + 1]
        least = left if left < right else right
        if tree[at] == least:
            return
        tree[at] = least
        at >>= 1


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece. A piece that is a token is that token; else pairs merge by rank, leftmost first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(n - 1, 1).bit_length()
    shift = size.bit_length()
    mask = (1 << shift) - 1
    rank = ranks.get
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << shift | i
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right
    ends = list(range(1, n + 1))  # where the token that begins here ends
    before = list(range(-1, n))  # where the token before it begins
    while (top := tree[1]) != _NONE:
        i = top & mask
        j = ends[i]
        k = ends[j]
        ends[i] = k
        _put(tree, size + j, _NONE)
        if k < n:
            before[k] = i
            r = rank(piece[i : ends[k]])
            _put(tree, size + i, _NONE if r is None else r << shift | i)
        else:
            _put(tree, size + i, _NONE)
        p = before[i]
        if p >= 0:
            r = rank(piece[p:k])
            _put(tree, size + p, _NONE if r is None else r << shift | p)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


class PairTable:
    """(left id, right id) -> id of the merged token, as an open-addressed table for whole arrays of pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = array("q"), array("q")
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    keys.append(left << 31 | right)
                    values.append(rank)
        keys, values = np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int32)
        slots = self._slots(keys)
        while len(keys):  # of those that want a free slot, one gets it; the others go one further
            free = self.keys[slots] == -1
            self.keys[slots[free]] = keys[free]
            mine = self.keys[slots] == keys
            self.values[slots[mine]] = values[mine]
            keys, values, slots = keys[~mine], values[~mine], (slots[~mine] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids; -1 where the pair does not merge."""
        keys = left << 31 | right
        slots = self._slots(keys)
        there = self.keys[slots]
        out = np.where(there == keys, self.values[slots], np.int32(-1)).astype(np.int64)
        todo = np.flatnonzero((there != keys) & (there != -1))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
            there = self.keys[slots[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (there != -1)]
        return out


def merge_pieces(pieces: list[bytes], size: int, ranks: dict[bytes, int], single: np.ndarray, pairs: PairTable) -> list[bytes]:
    """As merge_piece for pieces of 2 to `size` bytes (a power of two): their trees stand side by side and step together.

    single: the id of each byte. The ids come packed as 32-bit numbers.
    """
    count, levels = len(pieces), size.bit_length() - 1
    lengths = np.fromiter(map(len, pieces), np.int64, count)
    shift, mask = levels + 1, 2 * size - 1
    ids = single[np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8)].reshape(count, size)
    place = np.arange(size)
    tree = np.full((count, 2 * size), _NONE, dtype=np.int64)
    pair = pairs.get(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(count, size - 1)
    tree[:, size : 2 * size - 1] = np.where((pair >= 0) & (place[:-1] + 1 < lengths[:, None]), pair << shift | place[:-1], _NONE)
    for level in range(levels - 1, -1, -1):
        low = tree[:, 2 << level : 4 << level]
        tree[:, 1 << level : 2 << level] = np.minimum(low[:, ::2], low[:, 1::2])
    ends = np.tile(np.concatenate([place + 1, [size + 1]]), (count, 1))
    before = np.tile(np.arange(-1, size), (count, 1))
    live = np.flatnonzero(tree[:, 1] != _NONE)
    while len(live):
        top = tree[live, 1]
        i = top & mask
        j = ends[live, i]
        k = ends[live, j]
        ids[live, i] = merged = top >> shift
        ends[live, i] = k
        follows = k < lengths[live]
        before[live, k] = i  # past the end it is not looked at
        right = np.where(follows, pairs.get(merged, ids[live, np.minimum(k, size - 1)]), -1)
        p = before[live, i]
        left = np.where(p >= 0, pairs.get(ids[live, np.maximum(p, 0)], merged), -1)
        tree[live, size + j] = _NONE
        tree[live, size + i] = np.where(right >= 0, right << shift | i, _NONE)
        has = np.flatnonzero(p >= 0)
        tree[live[has], size + p[has]] = np.where(left[has] >= 0, left[has] << shift | p[has], _NONE)
        rows, at = np.concatenate([live, live, live[has]]), size + np.concatenate([i, j, p[has]])
        for _ in range(levels):
            at >>= 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
        live = live[tree[live, 1] != _NONE]
    whole = np.fromiter((ranks.get(p, -1) for p in pieces), np.int64, count)
    starts = np.zeros((count, size), dtype=bool)
    at = np.zeros(count, dtype=np.int64)
    rows = np.arange(count)
    while len(rows):
        starts[rows, at] = True
        at = ends[rows, at]
        more = at < lengths[rows]
        rows, at = rows[more], at[more]
    known = whole >= 0
    starts[known] = place == 0
    ids[known, 0] = whole[known]
    packed, cuts = ids[starts].astype("<i4").tobytes(), (4 * np.cumsum(starts.sum(axis=1))).tolist()
    return [packed[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


class _Pieces(dict):
    """Text of a piece -> its ids as packed 32-bit numbers."""

    #: Longer pieces get a tree of their own and are not kept.
    LONG = 64

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs = ranks, PairTable(ranks)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)

    def __missing__(self, piece: str) -> bytes:
        return np.array(merge_piece(piece.encode(), self.ranks), dtype="<i4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Merge those that are not kept yet. If the table would grow beyond its bound it holds these alone afterwards."""
        new = pieces.difference(self)
        if len(self) + len(new) > PIECES_KEPT:
            self.clear()
            new = pieces
        by: dict[int, list[tuple[str, bytes]]] = {}
        for piece in new:
            data = piece.encode()
            if 2 <= len(data) <= self.LONG:
                by.setdefault(1 << (len(data) - 1).bit_length(), []).append((piece, data))
            elif len(data) == 1:
                self[piece] = np.array([self.ranks[data]], dtype="<i4").tobytes()
        for size, group in by.items():
            step = (1 << 17) // size  # bounds the arrays
            for at in range(0, len(group), step):
                part = group[at : at + step]
                self.update(zip([p for p, _ in part], merge_pieces([d for _, d in part], size, self.ranks, self.single, self.pairs), strict=True))


@lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str):
    import regex

    return regex.compile(pattern).findall, _Pieces(parse_ranks(data))


@lru_cache(maxsize=2)
def _decoder(data: bytes) -> list[bytes]:
    ranks = parse_ranks(data)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces = _encoder(ranks, pattern)
        of = pieces.__getitem__
        for block in blocks(batches, BLOCK):
            matches = [split(text) if text else [] for text in block.column(1).to_pylist()]
            pieces.learn(set().union(*matches))
            packed = [b"".join(map(of, m)) for m in matches]
            ends = np.zeros(len(packed) + 1, dtype=np.int64)
            np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([block.column(0), ids], names=["doc_id", "ids"])
        pieces.clear()  # idle workers hold none
        release()

    docs = pick(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id and ids of encoded, with the bytes of its ids as column decoded (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _decoder(ranks)
        token = table.__getitem__
        for block in blocks(batches, BLOCK):
            ids = block.column(1)
            out = [b"".join(map(token, x)) if x else b"" for x in ([i for i in row if i is not None] if row and None in row else row for row in ids.to_pylist())]
            yield pa.RecordBatch.from_arrays([block.column(0), ids, pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    encoded = encoded.select("doc_id", "ids")
    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")
