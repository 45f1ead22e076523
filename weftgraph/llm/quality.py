"""Quality classifier from weak labels.

Simple labellers look at a whole text and each vote good, bad or nothing. Expectation-maximisation (two classes, one table of
vote probabilities for each labeller and class) estimates how accurate each is from how they overlap, without any true label:
it needs only how often each pattern of votes occurs, at most 3 ** labellers rows. The posterior of a text's pattern is its
label for a linear scorer over hashed features (words, runs of four character classes, and steps of the labellers' measures),
which is then applied to every text.

A measure is a share of what was counted, drawn towards a value at which its labeller is silent by as much as EVIDENCE words (or
as many letters) would draw it. So a labeller speaks when it has seen enough, by the same rule for a text of any length.

The scorer is fitted on a sample of about `rows_most` texts, chosen by a hash of doc_id and text: half of them from those whose label is
good and half from the others, or all there are, so a class of any rarity is learnt from. Votes and EM cover all texts. If all labels
are of one class there is nothing to learn, and the scorer is constant at the prior.
A text that is null or holds no word is given no votes; its score is 0 and it is not kept. With no texts that have words the
scorer is constant at the prior; an empty table gives an empty one. Rows are judged one by one, so ties and repeated rows change
nothing. Texts of any length count whole. Other columns, whatever their names, are left behind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import exp
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import Rows, blocks, pick, stored

DIMENSIONS = 1 << 14
ROWS_MOST = 4_000
#: Share of texts taken to be good when EM starts.
PRIOR = 0.8
_CLASS = np.full(256, 1, dtype=np.uint32)  # lower-case letters and bytes of other scripts
for _c in range(128):
    _ch = chr(_c)
    _CLASS[_c] = 1 if _ch.islower() else 2 if _ch.isupper() else 3 if _ch.isdigit() else 4 if _ch in " \t\r" else 5 if _ch == "\n" else 6 if _ch in ".,;:'\"?-()" else 7 if _ch == "!" else 8 if _ch == "|" else 9 + _c % 7


_ODD_RUN = re.compile(r"[^\w\s.,;:'\"?()\-]{1,}(?:\s|$)")


#: Words, and letters, by which a measure is drawn to its labeller's silence.
EVIDENCE, LETTERS = 8, 40


def measures(text: str) -> list[float] | None:
    """Shares that the labellers judge by; None without words."""
    words = text.split()
    if not words:
        return None
    n = len(words)
    cls = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)], minlength=16).tolist()
    letters, counts = cls[1] + cls[2], Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    seen = [  # what was counted, of how many, how many more stand for silence, and the silent value
        (sum(cls[8:]), len(text), LETTERS, 0.012),  # odd symbols
        (cls[2], letters, LETTERS, 0.20),  # capitals
        (len(counts), min(n, 200 + n // 4), EVIDENCE, 0.30),  # different words
        (max(counts.values()), n, EVIDENCE, 0.25),  # the most frequent word
        (counts["|"], n, EVIDENCE, 0.02),  # cells
        (cls[7], n, EVIDENCE, 0.03),  # exclamation marks
        (cls[6], n, EVIDENCE, 0.03),  # punctuation
        (sum(map(len, words)), n, EVIDENCE, 2.5),  # mean word length
        (len(_ODD_RUN.findall(text)), n, EVIDENCE, 0.006),  # runs of odd symbols
        (letters, sum(cls) - cls[4] - cls[5], LETTERS, 0.80),  # letters in what is printed
        (sum(map(eq, words, words[1:])), n, EVIDENCE, 0.06),  # words that repeat the one before
        (pairs, min(n, 400 + n // 2), EVIDENCE, 0.50),  # different pairs of words
    ]
    return [(k + more * silent) / (of + more) for k, of, more, silent in seen]


# For each measure, bad if below the first or above the second; good between the third and the fourth.
LIMITS = [
    (-1.0, 0.03, -1.0, 0.01),
    (-1.0, 0.40, 0.005, 0.15),
    (0.20, 9.0, 0.45, 9.0),
    (-1.0, 0.40, -1.0, 0.20),
    (-1.0, 0.10, -1.0, 0.01),
    (-1.0, 0.20, -1.0, 0.02),
    (0.005, 0.70, 0.05, 0.50),
    (2.0, 14.0, 3.0, 10.0),
    (-1.0, 0.10, -1.0, 0.005),
    (0.55, 9.0, 0.85, 9.0),
    (-1.0, 0.20, -1.0, 0.05),
    (0.40, 9.0, 0.75, 9.0),
]
LABELLERS = len(LIMITS)


def votes(m: list[float]) -> list[int]:
    """2 good, 1 bad, 0 none."""
    return [1 if x < low or x > high else 2 if a <= x <= b else 0 for x, (low, high, a, b) in zip(m, LIMITS, strict=True)]


def features(text: str, m: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: the runs of classes and the words, each scaled to length 1, and a step of each measure."""
    c = _CLASS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    counts = np.zeros(DIMENSIONS, dtype=np.float32)
    if len(c) >= 4:
        code = (c[:-3] << np.uint32(12)) | (c[1:-2] << np.uint32(8)) | (c[2:-1] << np.uint32(4)) | c[3:]
        counts += np.bincount((code * np.uint32(2654435761)) >> np.uint32(18), minlength=DIMENSIONS)
        counts = np.sqrt(counts)
        counts /= np.linalg.norm(counts)
    words = Counter(text.lower().split())
    slots = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words)) >> np.uint32(18)
    held = np.sqrt(np.bincount(slots, weights=np.fromiter(words.values(), np.float64, len(words)), minlength=DIMENSIONS)).astype(np.float32)
    counts += held / max(float(np.linalg.norm(held)), 1e-9)
    for i, x in enumerate(m):
        step = min(15, int(16 * x / (1 + x)))
        counts[((i * 16 + step + 1) * 2654435761 % (1 << 32)) >> 18] += 0.5
    at = np.flatnonzero(counts)
    return at, counts[at]


class WeakModel:
    """EM over vote patterns."""

    def __init__(self, patterns: list[tuple[list[int], int]], rounds: int = 100):
        v = np.array([p for p, _ in patterns], dtype=np.int64).reshape(-1, LABELLERS)
        n = np.array([c for _, c in patterns], dtype=np.float64)
        self.prior = PRIOR
        self.tables = np.empty((2, LABELLERS, 3))  # class bad, good; labeller; vote
        self.tables[:] = 1
        if not len(v):
            return
        post = np.where((v == 1).sum(1) > 0, np.where((v == 1).sum(1) * 3 > (v == 2).sum(1), 0.1, 0.6), 0.95)
        for _ in range(rounds):
            for k, w in enumerate((n * (1 - post), n * post)):
                for vote in (1, 2):
                    self.tables[k, :, vote] = (w[:, None] * (v == vote)).sum(0) + 0.5
                self.tables[k] /= self.tables[k, :, 1:].sum(1, keepdims=True)
                self.tables[k, :, 0] = 1  # no vote says nothing
            self.prior = float((n * post).sum() + 1) / (n.sum() + 2)
            new = self.posterior(v)
            if np.abs(new - post).max() < 1e-9:
                break
            post = new

    def posterior(self, v: np.ndarray) -> np.ndarray:
        logs = np.log(self.tables[:, np.arange(LABELLERS), v]).sum(-1)  # class, row
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - self.prior) / self.prior), -500, 500)))

    def accuracies(self) -> list[float]:
        """Of each labeller, how often a vote of it is right."""
        right = self.prior * self.tables[1, :, 2] + (1 - self.prior) * self.tables[0, :, 1]
        wrong = self.prior * self.tables[1, :, 1] + (1 - self.prior) * self.tables[0, :, 2]
        return (right / (right + wrong)).tolist()


def _fit(x: Rows, y: np.ndarray, rounds: int = 150, penalty: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels, both classes weighted alike, by accelerated gradient descent."""
    w, good = np.zeros(x.width + 1), float(y.mean())
    weight = (y / max(good, 1e-6) + (1 - y) / max(1 - good, 1e-6)) / (2 * len(y))
    target = (y / max(good, 1e-6)) / (2 * len(y)) / np.maximum(weight, 1e-12)
    ahead, rate = w.copy(), 1.0 / (0.25 * float(x.squares().max()) * float(weight.sum()) + penalty)
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x.dot(ahead), -30, 30)))
        new = ahead - rate * (penalty * ahead + x.back(weight * (p - target)))
        ahead = new + (k / (k + 3)) * (new - w)
        w = new
    return w.astype(np.float32)


def _votes(docs: DataFrame) -> DataFrame:
    """row, pattern of each text that has words, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            m = [measures(t) if t else None for t in block.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([None if x is None else "".join(map(str, votes(x))) for x in m], pa.string())], names=["row", "pattern"])

    return stored(docs.select("row", "text").mapInArrow(run, "row long, pattern string").where("pattern is not null"))


def train(docs: DataFrame, rows_most: int = ROWS_MOST, id_col: str = "doc_id", text_col: str = "text") -> tuple[WeakModel, np.ndarray]:
    """The weak-label model of all docs, and the scorer's weights (the last is the bias)."""
    docs = pick(docs, id_col, text_col).select("text", F.xxhash64("doc_id", "text").alias("row"))
    voted = _votes(docs)
    counted = voted.groupBy("pattern").count().collect()  # at most 3 ** LABELLERS rows
    patterns = sorted(([int(c) for c in r["pattern"]], r["count"]) for r in counted)
    weak = WeakModel(patterns)
    bias = np.zeros(DIMENSIONS + 1, np.float32)
    bias[-1] = np.log(weak.prior / max(1 - weak.prior, 1e-9))
    if not patterns:
        return weak, bias
    label = weak.posterior(np.array([p for p, _ in patterns]))
    of = {"".join(map(str, p)): float(y) for (p, _), y in zip(patterns, label, strict=True)}
    totals = [sum(n for (_, n), y in zip(patterns, label, strict=True) if (y >= 0.5) == good) for good in (False, True)]
    labels = docs.sparkSession.createDataFrame(list(of.items()), "pattern string, label double")  # a row for each pattern
    place = (F.xxhash64(F.lit(1), "row") / F.lit(2.0**64)) + 0.5
    share = F.when(F.col("label") >= 0.5, rows_most / 2 / max(totals[1], 1)).otherwise(rows_most / 2 / max(totals[0], 1))
    chosen = voted.join(F.broadcast(labels), "pattern").where(place < share).select("row", "label").dropDuplicates(["row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            out = [features(t, measures(t)) for t in block.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(1), pa.array([o[0].astype(np.int32) for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.list_(pa.float32()))], names=["label", "at", "value"])

    chosen = stored(chosen)  # of known size: about rows_most rows
    texts = docs.join(F.broadcast(chosen), "row").dropDuplicates(["row"]).select("text", "label")
    table = texts.mapInArrow(run, "label double, at array<int>, value array<float>").orderBy(F.xxhash64("at", "value")).limit(2 * rows_most).toArrow()
    y = np.array(table["label"].to_pylist(), dtype=np.float64)
    return weak, _fit(Rows.of(table, DIMENSIONS), y) if len(y) and y.min() < 0.5 <= y.max() else bias


def score(docs: DataFrame, weak: WeakModel, weights: np.ndarray, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_good, n_bad (votes), weak_label (posterior), score, keep of every whole text; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast((weak, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weak, weights = sent.value
        for block in blocks(batches):
            out = []
            for text in block.column(1).to_pylist():
                if not text or (m := measures(text)) is None:
                    out.append((0, 0, 0.0, 0.0, False))
                    continue
                v = votes(m)
                at, values = features(text, m)
                p = 1 / (1 + exp(-max(-30.0, min(30.0, float(values @ weights[at] + weights[-1])))))
                out.append((v.count(2), v.count(1), float(weak.posterior(np.array([v]))[0]), p, p >= threshold))
            kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))], names=["doc_id", "n_good", "n_bad", "weak_label", "score", "keep"])

    docs = pick(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_good int, n_bad int, weak_label double, score double, keep boolean")
