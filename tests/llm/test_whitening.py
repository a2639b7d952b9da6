"""Whitening against numpy's eigenvectors and plain integers."""

import numpy as np
import pytest

from quaver.llm import whitening as W


def brute(x, most=32):
    n, total = len(x), x.sum(axis=0)
    centred = x - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    return values, (centred @ axes[:, :most]) / np.sqrt(values[:most]), [sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, total, strict=True)) for r in x]


def test_equals_numpy(spark):
    rng = np.random.default_rng(1)
    v = (rng.normal(size=(300, 12)) @ np.diag(np.linspace(1, 3, 12))).astype(np.float32)
    data = [(i, r.tolist(), i) for i, r in enumerate(v)]
    junk = [(900, None, 0), (901, [float("nan")] * 12, 0), (902, [None, *[1.0] * 11], 0), (903, [float("inf")] * 12, 0), (904, [], 0), (905, [1.0, 2.0], 0)]
    df = spark.createDataFrame(data + junk, "vec_id LONG, embedding ARRAY<FLOAT>, n INT")
    got = W.whiten(df.repartition(7), components=5).toPandas()
    x = np.floor(64 * v.astype(float)).astype(np.int64) + 1_000_000
    values, white, deviation = brute(x, 5)
    mine = got.pivot(index="vec_id", columns="component", values="whitened")
    assert list(mine.index) == list(range(300)) and list(mine.columns) == [1, 2, 3, 4, 5]
    signs = np.sign((mine.to_numpy() * white).sum(axis=0))
    assert np.abs(mine.to_numpy() * signs - white).max() < 1e-8
    one = got[got.component == 1].set_index("vec_id").sort_index()
    assert one.deviation.tolist() == deviation and set(got.n) == {300}
    assert np.allclose(got[got.vec_id == 0].sort_values("component").explained, values[:5] / values.sum(), rtol=1e-12)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10


def test_null_and_repeated_keys_empty_tables_and_flat_vectors(spark):
    schema = "vec_id LONG, embedding ARRAY<DOUBLE>"
    assert W.whiten(spark.createDataFrame([], schema)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, schema)).count() == 0
    rows = [(None, [1.0, 0.0, 2.0]), (None, [0.0, 5.0, 2.0]), (3, [2.0, 1.0, 2.0]), (3, [2.0, 1.0, 2.0])]
    got = W.whiten(spark.createDataFrame(rows, schema)).toPandas()
    # The third place is constant: two components at most have variance.
    assert sorted(got.component.unique()) == [1, 2] and len(got) == 8 and got.vec_id.isna().sum() == 4
    with pytest.raises(Exception, match="64 bits|double precision"):
        W.whiten(spark.createDataFrame([(1, [1e30]), (2, [0.0])], schema)).collect()


@pytest.mark.parametrize("kind", ["random", "repeated", "clustered", "low rank", "diagonal", "zero"])
def test_leading_pairs(kind):
    rng = np.random.default_rng(4)
    n = 30
    q, _ = np.linalg.qr(rng.normal(size=(n, n)))
    spectrum = {
        "random": rng.uniform(0, 5, n),
        "repeated": np.repeat([9.0, 4.0, 4.0, 1.0, 0.5], 6),
        "clustered": 3 + 1e-13 * np.arange(n),
        "low rank": np.concatenate([[5, 4, 3], np.zeros(n - 3)]),
        "diagonal": np.arange(1.0, n + 1),
        "zero": np.zeros(n),
    }[kind]
    a = np.diag(spectrum) if kind in ("diagonal", "zero") else q @ np.diag(spectrum) @ q.T
    a = (a + a.T) / 2
    values, axes = W.leading_pairs(a, 20)
    true = np.sort(spectrum)[::-1][: len(values)]
    assert len(values) == {"low rank": 3, "zero": 0}.get(kind, 20)
    assert np.allclose(values, true, rtol=0, atol=1e-12)
    assert np.abs(axes.T @ axes - np.eye(len(values))).max(initial=0) < 1e-12
    assert np.abs(a @ axes - axes * values).max(initial=0) < 1e-12


def test_inertia_counts():
    rng = np.random.default_rng(9)
    for _ in range(20):
        a = rng.normal(size=(17, 17))
        a = a + a.T
        a[rng.random((17, 17)) < 0.3] = 0
        a = np.triu(a) + np.triu(a, 1).T
        np.fill_diagonal(a, 0)
        values = np.linalg.eigvalsh(a)
        for shift in rng.uniform(values[0] - 1, values[-1] + 1, 10):
            assert W.inertia(a, shift) == (values < shift).sum()


def test_exact_products():
    rng = np.random.default_rng(2)
    for reach in (3, 1 << 20, 1 << 26, 1 << 30):
        z = rng.integers(-reach, reach + 1, (50, 4))
        wide = z.astype(object)
        assert (W._exact_products(z) == wide.T @ wide).all()
