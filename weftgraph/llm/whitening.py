"""Whitening of embeddings by their principal components, from exact integer means.

An entry c of a vector counts as the whole number x = floor(64 c) + 1,000,000. The fit list is each different x vector once: n vectors
whose sums S are exact. Rows (n x - S) / n, centred as whole numbers before they become doubles, are a RowMatrix; its Gramian divided
by n is the covariance, whose eigenvectors the driver finds (dimensions² numbers, whatever the rows). A vector's whitened values are
its centred projections on the components of largest eigenvalue, each divided by the root of that eigenvalue.

Rows whose vector is null or holds a null, NaN or infinite entry, or one of 2^46 or more, are left out, as are vectors of another length
than most different vectors have (of equally frequent ones the longest). Empty vectors count as such a length, with no component and so no
row. Rows that repeat a vector or an id each get their rows; null ids pass; extra columns are left behind; an empty table gives an
empty one. A component whose eigenvalue is rounding error beside the largest (no variance is left, as in a fit list of one) has no
whitened value: null, and it is left out of identity_error; explained is null if there is no variance at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import ship, stored

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
_LARGEST = 2.0**46  # of an entry's size: x then has 52 bits


def whole(vector: Column) -> Column:
    """The vector's entries as whole numbers; null if one is null, not finite or too large."""
    entries = vector.cast("array<double>")
    fits = F.forall(entries, lambda c: F.coalesce(F.abs(c) < _LARGEST, F.lit(False)))  # NaN is larger than any number
    return F.when(fits, F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + OFFSET))


class Whitening:
    """n, sums (S), components (a column for each), values (their eigenvalues), explained (a share of the variance for each),
    identity_error of the fit list's whitened values."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, most: int):
        self.n, self.sums = n, sums
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:most]
        self.values, self.components = values[order], vectors[:, order]
        total = float(np.trace(covariance))
        self.sound = self.values > len(sums) * np.finfo(float).eps * max(float(values.max(initial=0.0)), 0.0)
        self.explained = [float(v) / total if total > 0 else None for v in self.values]
        self.identity_error: float | None = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly; x has a vector in each row. Whole numbers of 64 bits where these hold their sum of squares, else Python's."""
        largest = max([abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))]) * self.n + max(map(abs, self.sums))
        if largest < 2**62:
            out = x * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
            if len(self.sums) * int(np.abs(out).max(initial=0)) ** 2 < 2**63:
                return out
        return x.astype(object) * self.n - np.array(self.sums, dtype=object)

    def project(self, centred: np.ndarray) -> np.ndarray:
        """Whitened values, NaN where a component has no variance."""
        scale = np.sqrt(np.where(self.sound, self.values, np.nan))
        return (centred / self.n).astype(np.float64) @ self.components / scale


def _dimension(distinct: DataFrame) -> int | None:
    found = distinct.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else None


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int], int]:
    """Rows, their sums and the widest range of values in a dimension."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, low, high = 0, np.zeros(d, object), None, None
        for f in frames:
            x = np.stack(f["x"].to_list())
            part = (x >> 26).sum(axis=0).astype(object) * 2**26 + (x & (2**26 - 1)).sum(axis=0).astype(object)
            n, total = n + len(x), total + part
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
        if n:
            yield pd.DataFrame({"at": range(d), "n": n, "total": [str(v) for v in total], "low": low, "high": high})

    parts = fit.mapInPandas(run, "at int, n long, total string, low long, high long")  # d rows for each task
    found = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").collect()
    return found[0]["n"], [int(r["total"]) for r in found], max(r["high"] - r["low"] for r in found)


def _gramian(vectors: DataFrame) -> np.ndarray:
    """Of a column of arrays of doubles."""
    rows = MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector(vectors.columns[0]).alias("v")), "v")
    return RowMatrix(rows).computeGramianMatrix().toArray()


def _whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """key, deviation, whitened of rows of key and x."""
    sent = rows.sparkSession.sparkContext.broadcast(model)  # dimensions x components numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for f in frames:
            centred = model.centred(np.stack(f["x"].to_list()))
            yield pd.DataFrame({"key": f["key"], "deviation": (centred * centred).sum(axis=1).astype(str), "whitened": list(model.project(centred))})

    return rows.mapInPandas(run, "key string, deviation string, whitened array<double>")


def fit(embeddings: DataFrame, most: int = COMPONENTS, vector_col: str = "embedding") -> Whitening | None:
    """The model of the table's different vectors; None if no row is left, or none with entries."""
    ship(embeddings.sparkSession)
    rows = embeddings.select(whole(embeddings[vector_col]).alias("x")).where("x is not null")
    distinct = stored(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"))
    d = _dimension(distinct)
    if not d:
        return None
    distinct = distinct.where(F.size("x") == d)
    n, sums, span = _sums(distinct, d)
    exact = "long" if max(abs(n * s) for s in (*sums, 1)) < 2**62 and n * (max(map(abs, sums)) // n + span + 1) < 2**62 else "decimal(38,0)"
    number = F.lit(n).cast(exact)
    centre = F.lit(sums if exact == "long" else [str(s) for s in sums]).cast(f"array<{exact}>")
    vectors = distinct.select(F.zip_with("x", centre, lambda v, s: (v.cast(exact) * number - s).cast("double") / n).alias("v"))
    model = Whitening(n, sums, _gramian(vectors) / n, most)
    sound = np.flatnonzero(model.sound).tolist()
    if sound:
        white = _whitened(distinct.select(F.lit("").alias("key"), "x"), model)
        white = white.select(F.slice("whitened", 1, len(sound)).alias("v"))  # of falling eigenvalues, those with variance come first
        model.identity_error = float(np.abs(_gramian(white) / n - np.eye(len(sound))).max())
    return model


def apply(embeddings: DataFrame, model: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation (decimal(38,0), the sum over dimensions of (n x - S)²; null if longer), whitened,
    explained, identity_error: a row for each component of each vector. No shuffle. Ids are carried as strings and cast back."""
    kind = embeddings.select(embeddings[id_col]).schema[0].dataType.simpleString()
    out = f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None:
        return embeddings.sparkSession.createDataFrame([], out)
    rows = embeddings.select(embeddings[id_col].cast("string").alias("key"), whole(embeddings[vector_col]).alias("x")).where((F.size("x") == len(model.sums)) & F.col("x").isNotNull())
    white = _whitened(rows, model)
    each = white.select("key", F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"), F.posexplode("whitened").alias("at", "value"))
    explained = F.lit(model.explained).cast("array<double>")
    return each.select(
        F.col("key").cast(kind).alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("value"), F.col("value")).alias("whitened"), explained[F.col("at")].alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
