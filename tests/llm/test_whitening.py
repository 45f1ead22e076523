from fractions import Fraction

import numpy as np
import pytest

from weftgraph.llm import queries, whitening


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, "k", 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, key string, x int, whitened double")

    return make


def run(df, most=16):
    return whitening.apply(df, whitening.fit(df, most)).collect()


def plain(vectors, most):
    """x, S, n, V (all as fractions) and V's eigenvalues and vectors."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    fit = [list(v) for v in sorted({tuple(v) for v in x})]
    n, d = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    centred = [[n * v[k] - sums[k] for k in range(d)] for v in fit]
    cov = np.array([[float(Fraction(sum(c[i] * c[j] for c in centred), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:most]
    return x, sums, n, cov, values[order], vectors[:, order]


def same(rows, ids, vectors, most):
    x, sums, n, cov, values, axes = plain(vectors, most)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(rows) == len(ids) * len(values) == len(got)
    for k, value in enumerate(values):
        want = np.array([float(sum(Fraction(n * v[j] - sums[j], n) * Fraction(float(axes[j, k])) for j in range(len(sums)))) for v in x]) / np.sqrt(value)
        have = np.array([got[i, k + 1]["whitened"] for i in ids])
        sign = 1 if abs(have - want).max() < abs(have + want).max() else -1
        assert np.allclose(have, sign * want, rtol=1e-9, atol=1e-9)
        for i, v in zip(ids, x, strict=True):
            r = got[i, k + 1]
            assert r["n"] == n and int(r["deviation"]) == sum((n * v[j] - sums[j]) ** 2 for j in range(len(sums)))
            assert r["explained"] == pytest.approx(value / np.trace(cov), rel=1e-9) and r["identity_error"] < 1e-9


def test_query_as_exact_fractions(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    same(queries.op11_whitening(spark, small).collect(), [i for i, _ in rows], [v for _, v in rows], 16)


def test_repeated_and_bad_rows(table):
    rng = np.random.default_rng(3)
    good = [(i, (rng.normal(size=5) * [9, 5, 3, 2, 1]).tolist()) for i in range(60)]
    copies = [(100 + i, good[0][1]) for i in range(200)]
    bad = [(300, None), (301, []), (302, [1.0] * 4 + [None]), (303, [float("nan")] * 5), (304, [float("inf")] * 5), (305, [1e30] * 5), (306, [1.0, 2.0])]
    rows = good + copies
    same(run(table(rows + bad), 3), [i for i, _ in rows], [v for _, v in rows], 3)


def test_null_and_repeated_ids(table):
    rows = run(table([(None, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [3.0, 1.0]), (2**60 + 1, [5.0, 5.0])]))
    assert sorted((str(r["vec_id"]), r["component"]) for r in rows) == sorted((i, c) for i in ("None", "7", "7", str(2**60 + 1)) for c in (1, 2))


def test_no_variance(table):
    rows = run(table([(1, [2.0, 2.0]), (2, [2.0, 2.0])]))
    assert len(rows) == 4 and all((r["whitened"], r["explained"], r["identity_error"], r["n"], int(r["deviation"])) == (None, None, None, 1, 0) for r in rows)
    rows = run(table([(i, [float(i), 2.0]) for i in range(9)]))
    assert {r["component"] for r in rows if r["whitened"] is None} == {2} and rows[0]["identity_error"] < 1e-12


def test_large_entries_are_exact(table):
    vectors = [[1e13, 0.25], [-1e13, 1.0], [0.5, 3.0], [7.0, -2.0]]
    x, sums, n, *_ = plain(vectors, 2)
    got = {r["vec_id"]: int(r["deviation"]) for r in run(table(list(enumerate(vectors))))}
    assert got == {i: sum((n * v[k] - sums[k]) ** 2 for k in range(2)) for i, v in enumerate(x)}


def test_empty_tables(table):
    assert run(table([])) == [] and run(table([(1, None), (2, [])])) == []
    df = table([])
    assert whitening.apply(df, whitening.fit(df)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_a_model_of_another_table(table):
    model = whitening.fit(table([(i, [float(i % 5), float(i % 3)]) for i in range(30)]))
    (row, *_) = whitening.apply(table([(1, [1e13, 1.0])]), model).collect()
    assert int(row["deviation"]) == sum((model.n * x - s) ** 2 for x, s in zip([int(64e13) + 1_000_000, 64 + 1_000_000], model.sums, strict=True))
