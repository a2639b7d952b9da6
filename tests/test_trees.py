"""Tree ensembles: the same forest however rows are dealt, boosting against plain loops."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quaver.operators import trees as R


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6))
    y = (x[:, :3] + 0.3 * rng.normal(size=(400, 3))).argmax(axis=1)
    return spark.createDataFrame([(i, float(y[i]), Vectors.dense(x[i])) for i in range(400)], ["id", "label", "features"])


def told(model, rows, predict):
    return sorted((r.id, r.prediction, r.probability) for r in predict(model, rows, ["id", "label"]).collect())


def test_forest_does_not_depend_on_partitions_or_on_where_it_grows(rows, monkeypatch):
    train, test = rows.where("id < 300"), rows.where("id >= 300")
    found = []
    for parts, local in [(1, 1 << 16), (7, 1 << 16), (40, 1 << 16), (5, 60)]:
        monkeypatch.setattr(R, "LOCAL", local)
        found.append(told(R.fit_forest(train.repartition(parts), "id", trees=15), test.repartition(3), R.predict_forest))
    assert found[0] == found[1] == found[2] == found[3]
    truth = {r.id: r.label for r in test.collect()}
    assert np.mean([truth[i] == p for i, p, _ in found[0]]) > 0.7


def test_bags_are_poisson():
    weight = R.bag_weights(0, 3, np.arange(200_000))
    assert abs(weight.mean() - 1) < 0.02 and abs(weight.var() - 1) < 0.03 and abs((weight == 0).mean() - np.exp(-1)) < 0.01
    assert (R.bag_weights(0, 3, np.arange(10)) == weight[:10]).all() and (R.bag_weights(0, 4, np.arange(1000)) != weight[:1000]).any()


def test_best_split_equals_a_search():
    rng = np.random.default_rng(1)
    for _ in range(30):
        hist = rng.integers(0, 4, (3, R.BINS, 2)) * (rng.random((3, R.BINS, 1)) < 0.2)
        hist[1:] = 0
        counts = [(hist[0, : c + 1].sum(0), hist[0, c + 1 :].sum(0)) for c in range(R.BINS - 1)]
        h = lambda n: -sum(v * np.log(v / n.sum()) for v in n if v)
        costs = [round(h(a) + h(b), 9) if a.sum() and b.sum() else np.inf for a, b in counts]
        got = R.best_split(hist, np.arange(3), 1)
        assert got == ((0, int(np.argmin(costs))) if np.isfinite(min(costs)) else None)


def plain_boost(bins, y, k, rounds, ridge=1.0):
    """Depth two, a class and a node at a time."""
    z = np.zeros((len(y), k))
    for _ in range(rounds):
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        step = np.zeros_like(z)
        for c in range(k):
            g, h = p[:, c] - (y == c), 2 * p[:, c] * (1 - p[:, c])

            def best(rows, g=g, h=h):
                found, most = None, 1e-9
                whole = g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                for f in range(bins.shape[1]):
                    for cut in range(R.BINS - 1):
                        a, b = rows[bins[rows, f] <= cut], rows[bins[rows, f] > cut]
                        if h[a].sum() < 1 or h[b].sum() < 1:
                            continue
                        gain = g[a].sum() ** 2 / (h[a].sum() + ridge) + g[b].sum() ** 2 / (h[b].sum() + ridge) - whole
                        if gain > most + 1e-12:
                            found, most = (a, b), gain
                return found

            def leaf(rows, c=c, g=g, h=h):
                step[rows, c] = -g[rows].sum() / (h[rows].sum() + ridge)

            root = np.arange(len(y))
            for side in best(root) or (root,):
                for part in best(side) or (side,):
                    leaf(part)
        z += step
    return z


def test_boosting_equals_plain_loops(rows, monkeypatch):
    monkeypatch.setattr(R, "ROUNDS_KEPT", 2)
    few = rows.where("id < 80")
    model = R.fit_boosted(few.repartition(3), "id", rounds=5)
    got = [(r.id, r.label, r.features) for r in few.orderBy("id").collect()]
    x = np.array([g[2].toArray() for g in got])
    bins = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(model.edges)])
    want = plain_boost(bins, np.array([g[1] for g in got]), 3, 5)
    assert np.abs(model.margins(bins.astype(np.uint8)) - want).max() < 1e-9


def test_two_classes_are_binary_boosting(rows):
    """Softmax over two classes mirrors itself, and half its ridge is the ridge of one logistic margin."""
    two = rows.where("label < 2 AND id < 150")
    model = R.fit_boosted(two, "id", rounds=4, ridge=2.0, least=0.0)
    got = [(r.label, r.features.toArray()) for r in two.orderBy("id").collect()]
    x, y = np.array([g[1] for g in got]), np.array([g[0] for g in got])
    bins = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(model.edges)]).astype(np.uint8)
    z = model.margins(bins)
    assert np.abs(z[:, 0] + z[:, 1]).max() < 1e-9
    f = np.zeros(len(y))
    for r in range(4):
        p = 1 / (1 + np.exp(-f))
        at = R.place(bins, model.feature[r][1], model.cut[r][1], 2)
        for leaf in range(4):
            m = at == leaf
            if m.any():
                f[m] += -(p[m] - y[m]).sum() / ((p[m] * (1 - p[m])).sum() + 1.0)
    assert np.abs(f - (z[:, 1] - z[:, 0])).max() < 1e-9


def test_odd_rows(spark, rows):
    few = rows.where("id < 40")
    odd = few.unionAll(few.limit(2).withColumn("features", F.lit(None).cast(few.schema["features"].dataType)))
    forest, boosted = R.fit_forest(odd, "id", trees=5), R.fit_boosted(odd, "id", rounds=3)
    for model, predict in ((forest, R.predict_forest), (boosted, R.predict_boosted)):
        got = predict(model, odd, ["id"]).collect()
        assert len(got) == 42 and sum(r.prediction is None for r in got) == 2
        assert predict(model, odd.where("false"), ["id"]).count() == 0
        with pytest.raises(ValueError, match="no training rows"):
            (R.fit_forest if model is forest else R.fit_boosted)(few.where("false"), "id")
    one = few.withColumn("label", F.lit(2.0))
    assert {r.prediction for r in R.predict_forest(R.fit_forest(one, "id", trees=3), few, ["id"]).collect()} == {2}
    assert {r.prediction for r in R.predict_boosted(R.fit_boosted(one, "id"), few, ["id"]).collect()} == {2}


def test_boosting_deals_few_partitions_over_the_cores(spark):
    rows = spark.range(0, 9000, 1, 1).select("id", (F.col("id") % 2).alias("label"), array_to_vector(F.array((F.col("id") % 7).cast("double"))).alias("features"))
    blocks = R.binned(rows, "id", [np.array([2.5])], [0.0, 1.0], 1000)
    assert {r.n for r in blocks.select("n").collect()} == {1000}
    kept, tasks = R.dealt(blocks, ["bins"], 2000, spread=True)
    assert tasks == kept.rdd.getNumPartitions() == 5
    assert kept.agg(F.sum("n")).first()[0] == 9000
    kept.unpersist()


def plain_grow(name, bins, label, weight, k, seed, most):
    """A node at a time, by its whole histogram."""
    counts = np.bincount(label, weight, minlength=k)
    found = R.best_split(R._histogram(bins, label, weight, k), R._feature_order(seed, name, bins.shape[1]), most) if (counts > 0).sum() > 1 else None
    if found is None:
        return tuple(counts.astype(int).tolist())
    below = bins[:, found[0]] <= found[1]
    sides = [plain_grow(R._child(name, side), bins[m], label[m], weight[m], k, seed, most) for side, m in ((1, below), (2, ~below))]
    return (int(found[0]), int(found[1]), *sides)


@pytest.mark.parametrize("n, width, k, values, constant", [(1, 3, 2, 32, 0), (400, 6, 3, 32, 2), (3000, 20, 2, 32, 5), (1500, 9, 5, 3, 3), (900, 4, 2, 2, 0), (60, 1, 4, 32, 0)])
def test_nodes_of_a_depth_are_split_together(monkeypatch, n, width, k, values, constant):
    """Trees equal those grown a node at a time, in a few steps a depth instead of one a node."""
    rng = np.random.default_rng(n)
    bins, label, weight = rng.integers(0, values, (n, width)).astype(np.uint8), rng.integers(0, k, n), rng.integers(1, 5, n)
    bins[:, :constant] = 7
    most, steps = max(1, int(width**0.5)), []
    for name in ("_split_wide", "_split_narrow"):
        own = getattr(R, name)
        monkeypatch.setattr(R, name, lambda *a, own=own: steps.append(1) or own(*a))
    tree = R.grow(77, bins, label, weight, k, 0, most)

    def shape(at):
        if tree["feature"][at] < 0:
            return tuple(tree["counts"][at].tolist())
        return (int(tree["feature"][at]), int(tree["cut"][at]), shape(tree["left"][at]), shape(tree["left"][at] + 1))

    assert shape(0) == plain_grow(77, bins, label, weight, k, 0, most)
    assert len(steps) < 100 and (n < 1000 or len(tree["feature"]) > 5 * len(steps))


def test_bins_come_from_the_smallest_keys_and_few_rows_are_sorted(spark, monkeypatch):
    frame = type(spark.range(1))
    monkeypatch.setattr(R, "SAMPLE", 50)
    many = spark.range(4000).select("id", array_to_vector(F.array(F.rand(3))).alias("features"))
    alike = many.withColumn("id", F.lit(7))
    wanted = [sorted((k, v[0]) for k, v in ((r.k, r.features) for r in df.select(F.xxhash64("id").alias("k"), "features").collect()))[:50] for df in (many, alike)]
    sorted_rows, plain = [], frame.orderBy

    def watched(self, *columns):
        sorted_rows.append(self.count())
        return plain(self, *columns)

    monkeypatch.setattr(frame, "orderBy", watched)
    for df, rows in zip((many, alike), wanted, strict=True):
        values = np.unique([v for _, v in rows])
        assert R.bin_edges(df, "id")[0].tolist() == np.unique(np.quantile(values if len(values) == 50 else [v for _, v in rows], np.arange(1, R.BINS) / R.BINS, method="lower")).tolist()
    assert sorted_rows[0] < 400


def test_plans_of_boosting_stay_short(rows, monkeypatch):
    monkeypatch.setattr(R, "ROUNDS_KEPT", 1)
    monkeypatch.setattr(R, "ROUNDS_SETTLED", 3, raising=False)
    depths, slopes = [], R._slopes

    def watched(blocked, *others):
        depths.append(blocked._jdf.queryExecution().logical().toString().count("MapInArrow"))
        return slopes(blocked, *others)

    monkeypatch.setattr(R, "_slopes", watched)
    long = R.fit_boosted(rows, "id", rounds=8)
    assert len(depths) == 16 and max(depths) <= 4
    monkeypatch.setattr(R, "ROUNDS_SETTLED", 100)
    assert told(R.fit_boosted(rows, "id", rounds=8), rows, R.predict_boosted) == told(long, rows, R.predict_boosted)
