"""Whitening against an eigendecomposition of the whole covariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm import whitening as W
from lexispark.llm.queries import queries

DATA = "/root/testdata/sf0.001"


def brute(vectors):
    """Mean, eigenvalues and unit eigenvectors (rows, largest entry positive) of the distinct vectors."""
    x = np.unique(np.floor(256 * np.array(vectors, dtype=float)), axis=0)
    mean = x.mean(axis=0)
    values, q = np.linalg.eigh((x - mean).T @ (x - mean) / len(x))
    q = q[:, ::-1].T
    return x, mean, values[::-1], q * np.sign(q[np.arange(len(q)), np.abs(q).argmax(axis=1)])[:, None]


def test_query_equals_the_eigendecomposition(spark):
    rows = queries()["op11_whitening"](spark, DATA).toPandas()
    table = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    x, mean, values, q = brute(table.embedding.tolist())
    assert len(rows) == 4 * len(table) and set(rows.n) == {len(x)}
    by_id = table.set_index("vec_id").embedding
    sums = [int(v) for v in x.sum(axis=0)]
    for r in rows.itertuples():
        own = np.floor(256 * np.array(by_id[r.vec_id], dtype=float))
        assert r.deviation == sum((len(x) * int(a) - s) ** 2 for a, s in zip(own, sums, strict=True))
        assert abs(r.whitened - (own - mean) @ q[r.component - 1] / np.sqrt(values[r.component - 1])) < 1e-8
        assert abs(r.explained / (values[r.component - 1] / values.sum()) - 1) < 1e-9 and 0 <= r.identity_error < 1e-9


@pytest.mark.parametrize("lift", [0.0, 1e-4, 10.0])
def test_flat_and_steep_spectra_are_certified(lift):
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((90, 90)))[0]
    values = np.sort(100 + lift * rng.standard_normal(90).cumsum() ** 2 + 1e-3 * np.arange(90))[::-1]
    v = turn * values @ turn.T
    got, q, residuals, _ = W.leading(lambda b: v @ b, 90, 4, spare=12)
    assert np.allclose(got, values[:4], rtol=1e-10) and residuals.max() <= W.FLOOR * values[0]
    assert np.allclose(q.T @ q, np.eye(4), atol=1e-12)
    assert np.abs(np.abs(np.sum(turn[:, :4] * q, axis=0)) - 1).max() < 1e-6


def test_multiple_and_missing_eigenvalues():
    for v in (np.eye(50) * 7, np.diag([5.0, 5, 5, 5, 5, 5] + [0.0] * 44), np.zeros((40, 40))):
        values, q, residuals, _ = W.leading(lambda b, v=v: v @ b, len(v), 4)
        assert np.allclose(values, np.sort(np.diag(v))[::-1][:4], atol=1e-9) and np.allclose(v @ q, q * values, atol=1e-9)


def test_rows_that_count_and_rows_that_do_not(spark):
    rows = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (2, None), (3, []), (4, [1.0, None, 3.0]), (5, [1.0, float("nan"), 3.0]), (6, [float("inf"), 1.0, 1.0]), (None, [-0.001, 0.0, 4.0]), (8, [3.0, -2.0, 1.0]), (9, [0.25, 1.0, -1.0])]
    rows += [(k, [1.0, 2.0, 0.5]) for k in range(100, 150)]  # a vector that most rows share
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit("x"), "n": F.lit(1), "whitened": F.lit(2)})
    got = W.whitening(frame).toPandas()
    x, mean, values, q = brute([v for _, v in rows if v and all(c is not None and np.isfinite(c) for c in v)])
    assert len(x) == 4 and set(got.n) == {4} and sorted(set(got.component)) == [1, 2, 3] and len(got) == 3 * (len(rows) - 5)
    one = got[got.vec_id.isna()].sort_values("component")
    assert np.allclose(one.whitened, ((np.floor(256 * np.array([-0.001, 0.0, 4.0])) - mean) @ q.T / np.sqrt(values)), atol=1e-9)
    assert got[got.vec_id == 1].groupby("component").whitened.agg(["count", "nunique"]).values.tolist() == [[2, 1]] * 3


def test_tables_without_components(spark):
    schema = "vec_id long, embedding array<float>"
    assert W.whitening(spark.createDataFrame([], schema)).count() == 0
    assert W.whitening(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert W.whitening(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    with pytest.raises(ValueError, match="entries"):
        W.fit(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema))


def test_sums_are_exact_beyond_doubles(spark):
    rows = spark.createDataFrame([(1, [3e9, 1.0]), (2, [-1e9, 2.0]), (3, [1e9 + 1, 5.0])], "vec_id long, embedding array<double>")
    model = W.fit(rows)
    assert model.sums == [256 * 3_000_000_001, 256 * 8]
    with pytest.raises(Exception, match="range of a long"):
        W.transform(rows, model).collect()
