"""Language identification in two steps: the family first, then linear support vector machines between its languages.

A text becomes hashed counts of its byte trigrams (lower-cased, what is no letter as one blank), scaled to length 1. A one-versus-
rest linear SVM chooses the family; within it each pair of languages has a linear SVM and most votes win, then the larger sum of
margins, then the name. Families are a fixed table of language codes; a code that is not in it is a family of its own.

Texts that are null or hold no letter are 'und' with score 0. Without any labelled row all texts are 'und'; with a single label
all others get it with score 1. Whole texts count, both in training and in prediction. Training takes at most about
`per_language` rows of each label, and `rows_most` in all, chosen by a hash of doc_id and text; a row without lang or text does
not train. Texts of any length, repeated rows and repeated ids are judged row by row; an empty table gives an empty one, and a
model without labels if it trains. Other columns, whatever their names, are left behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import Rows, blocks, pick, ship

# Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "la"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "be"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "semitic": ["ar", "he", "mt"],
    "indic": ["hi", "bn", "mr", "ne", "ur", "pa", "gu"],
    "sinitic": ["zh"],
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}
UND = "und"
DIMENSIONS = 1 << 14
PER_LANGUAGE, ROWS_MOST = 500, 6_000
_LETTER = re.compile(r"[^\W\d_]")
_BYTES = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint32)


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of the text's vector of length 1."""
    b = _BYTES[np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)]
    blank = b == 32
    b = b[~(blank & np.concatenate([[False], blank[:-1]]))]
    if len(b) < 3:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    slot = ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
    counts = np.bincount(slot, minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    values = np.sqrt(counts[at].astype(np.float32))
    return at, values / np.linalg.norm(values)


def _svm(x: Rows, y: np.ndarray, rounds: int = 150, penalty: float = 1e-4) -> np.ndarray:
    """Linear SVM with squared hinge loss and bias (last weight), classes weighted alike, by accelerated gradient descent."""
    w = np.zeros(x.width + 1)
    ahead, weight = w.copy(), np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    rate = 1.0 / (2 * 2 + penalty)  # rows have a length of at most sqrt(2)
    for k in range(rounds):
        short = np.maximum(0, 1 - y * x.dot(ahead))
        new = ahead - rate * (penalty * ahead - 2 * x.back(weight * y * short))
        ahead = new + (k / (k + 3)) * (new - w)
        w = new
    return w.astype(np.float32)


class Model:
    def __init__(self, x: Rows, labels: list[str]):
        """x: a row for each label."""
        self.labels = sorted(set(labels))
        family = np.array([FAMILY_OF.get(v, v) for v in labels])
        self.families = sorted(set(family.tolist()))
        self.of = [[v for v in self.labels if FAMILY_OF.get(v, v) == f] for f in self.families]
        y = np.array(labels)
        columns = [_svm(x, np.where(family == f, 1, -1)) for f in self.families] if len(self.families) > 1 else []
        self.pairs = [(a, b) for langs in self.of for a, b in combinations(langs, 2)]
        for a, b in self.pairs:
            rows = (y == a) | (y == b)
            columns.append(_svm(x.take(rows), np.where(y[rows] == a, 1, -1)))
        self.weights = np.stack(columns, axis=1) if columns else np.zeros((DIMENSIONS + 1, 0), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.labels or not has_letter(text):
            return UND, 0.0
        at, values = features(text)
        margins = (values @ self.weights[at] + self.weights[-1]).tolist()
        score, k, skip = 1.0, 0, 0
        if len(self.families) > 1:
            skip = len(self.families)
            k = max(range(skip), key=lambda i: margins[i])
            score = 1 / (1 + exp(-4 * margins[k]))
        langs = self.of[k]
        votes = {v: [0, 0.0] for v in langs}
        for (a, b), m in zip(self.pairs, margins[skip:], strict=True):
            if a in votes and b in votes:
                votes[a if m >= 0 else b][0] += 1
                votes[a][1] += m
                votes[b][1] -= m
        best = max(langs, key=lambda v: (*votes[v], v))
        for (a, b), m in zip(self.pairs, margins[skip:], strict=True):
            if best in (a, b):
                score *= 1 / (1 + exp(-4 * (m if best == a else -m)))
        return best, min(1.0, max(0.0, score))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, rows_most: int = ROWS_MOST, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the rows of docs that have a label. The driver gets the features of at most rows_most rows."""
    ship(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.select("lang").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows_most).collect()}
    most = max(2, min(per_language, rows_most // max(len(counts), 1)))
    share = F.create_map([F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, most / n))]) if counts else None
    if not counts:
        return Model(Rows(np.empty(0, np.int32), np.empty(0, np.float32), np.empty(0, np.int64), DIMENSIONS), [])
    place = (F.xxhash64("doc_id", "text") / F.lit(2.0**64)) + 0.5
    chosen = rows.where(place < share[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            vectors = [features(t) for t in block.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(2), pa.array([v[0].astype(np.int32) for v in vectors], pa.list_(pa.int32())), pa.array([v[1] for v in vectors], pa.list_(pa.float32()))], names=["lang", "at", "value"])

    table = chosen.mapInArrow(run, "lang string, at array<int>, value array<float>").orderBy(F.xxhash64("at", "value"), "lang").limit(rows_most).toArrow()
    return Model(Rows.of(table, DIMENSIONS), table["lang"].to_pylist())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every whole text; no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # dimensions x (families + pairs of languages) weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for block in blocks(batches):
            found = [model.predict(t) for t in block.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    docs = pick(docs, id_col, text_col)
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether the CRC-32 of doc_id as text is divisible by folds; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0
