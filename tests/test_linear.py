"""The shared linear solver against dense Newton steps."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from quaver.operators import linear as L


def data(n=240, width=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * (rng.random((n, width)) < 0.7)
    two = (x @ rng.normal(size=width) + 0.5 * rng.normal(size=n) > 0).astype(float)
    three = (x[:, :3] + 0.3 * rng.normal(size=(n, 3))).argmax(axis=1).astype(float)
    return x, two, three, rng.integers(1, 4, n).astype(float)


def table(spark, *conditions):
    rows = []
    for name, x, y, weight in conditions:
        for i, v in enumerate(x):
            at = np.flatnonzero(v)
            vector = Vectors.dense(v) if i % 2 else Vectors.sparse(len(v), at.tolist(), v[at].tolist())
            rows.append((name, float(y[i]), float(weight[i]), vector))
    return spark.createDataFrame(rows, ["condition", "label", "weight", "features"])


def dense(spec, x, y, weight, classes):
    """Damped Newton on numerical second derivatives of the same objective, written out plainly."""
    width = len(classes) if spec.loss == "softmax" or len(classes) > 2 else 1
    wide = np.column_stack([x, np.ones(len(x))])
    held = np.ones(wide.shape[1])
    held[-1] = spec.penalise_shift

    def value(w):
        total = 0.5 * (held[:, None] * w * w).sum()
        for row, label, s in zip(wide, y, weight, strict=True):
            z = row @ w
            if spec.loss == "softmax":
                total += s * (np.log(np.exp(z).sum()) - z[classes.index(label)])
            else:
                for j in range(width):
                    t = 1 if label == (classes[-1] if width == 1 else classes[j]) else -1
                    total += s * (max(0, 1 - t * z[j]) ** 2 if spec.loss == "squared_hinge" else np.log1p(np.exp(-t * z[j])))
        return total

    def gradient(w):
        z = wide @ w
        if spec.loss == "softmax":
            e = np.exp(z)
            r = e / e.sum(axis=1, keepdims=True) - (y[:, None] == np.array(classes))
        else:
            t = np.where(y[:, None] == np.array(classes[-1:] if width == 1 else classes), 1.0, -1.0)
            r = -2 * t * np.maximum(0, 1 - t * z) if spec.loss == "squared_hinge" else -t / (1 + np.exp(t * z))
        return wide.T @ (r * weight[:, None]) + held[:, None] * w

    w = np.zeros((wide.shape[1], width))
    for _ in range(60):
        g = gradient(w)
        if np.abs(g).max() < 1e-10:
            break
        h = np.empty((w.size, w.size))
        for k in range(w.size):
            d = np.zeros(w.size)
            d[k] = 1e-6
            h[:, k] = (gradient(w + d.reshape(w.shape)) - gradient(w - d.reshape(w.shape))).ravel() / 2e-6
        step = np.linalg.lstsq(h + 1e-9 * np.eye(len(h)), g.ravel(), rcond=None)[0].reshape(w.shape)
        t = 1.0
        while value(w - t * step) > value(w) and t > 1e-6:
            t /= 2
        w = w - t * step
    return w


def test_models_fitted_together_equal_dense_ones(spark):
    x, two, three, weight = data()
    one = np.ones(len(x))
    specs = [L.svm("a"), L.logistic("a"), L.logistic("b", "M", multinomial=True), L.svm("b", "S3"), L.logistic("w", "weighted")]
    rows = table(spark, ("a", x, two, one), ("b", x, three, one), ("w", x, two, weight))
    fitted = L.fit(rows.repartition(6), specs, x.shape[1], tolerance=1e-9)
    for model, (y, s) in zip(fitted, [(two, one), (two, one), (three, one), (three, one), (two, weight)], strict=True):
        want = dense(model.spec, x, y, s, model.classes)
        got = np.vstack([model.weights, model.shift])
        if model.spec.loss == "softmax":
            got, want = got - got.mean(axis=1, keepdims=True), want - want.mean(axis=1, keepdims=True)
        assert np.abs(got - want).max() < 1e-4, model.spec


def test_partitions_do_not_matter(spark):
    x, two, _, weight = data()
    rows = table(spark, ("all", x, two, weight))
    fits = [L.fit(rows.repartition(n), [L.svm()], x.shape[1], tolerance=1e-8)[0].weights for n in (1, 7)]
    assert np.abs(fits[0] - fits[1]).max() < 1e-6


def test_odd_tables(spark):
    x, two, _, one = data(20)
    rows = table(spark, ("all", x, two, one))
    with pytest.raises(ValueError, match="no training rows"):
        L.fit(rows.where("false"), [L.svm()], 5)
    with pytest.raises(ValueError, match="no training rows"):
        L.fit(rows, [L.svm("other")], 5)
    nulls = rows.withColumn("label", L.F.lit(None).cast("double")).unionAll(rows)
    assert L.fit(nulls, [L.logistic()], 5)[0].classes == [0.0, 1.0]
    single = L.fit(rows.where("label = 1"), [L.svm(), L.logistic()], 5)
    got = L.predict(rows, single, ["label"]).collect()
    assert len(got) == 40 and {(r.prediction, r.probability) for r in got} == {(1, None)}
    assert L.predict(rows.where("false"), single, ["label"]).count() == 0


def test_passes_have_two_tasks_a_core_at_most(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quaver.operators import passes

    monkeypatch.setattr(passes, "TASK_BYTES", 1)
    blocks = spark.range(0, 400, 1, 40).select(F.encode(F.col("id").cast("string"), "utf-8").alias("at"))
    kept, tasks = passes.dealt(blocks, ["at"])
    assert tasks == kept.rdd.getNumPartitions() == passes.ROUNDS * spark.sparkContext.defaultParallelism
    assert kept.count() == 400
    kept.unpersist()
