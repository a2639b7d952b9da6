import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.functions import vectors as V
from quaver.operators import embeddings as E


def test_elementary(rows):
    df = rows([([3.0, 4.0], [1.0, 0.0], [0.0, 0.0])], "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>, z ARRAY<DOUBLE>")
    got = df.select(
        V.blend("b", "a").alias("blend"), V.cosine("a", "b").alias("cos"), V.cosine("a", "z").alias("none"),
        V.unit("a").alias("unit"), V.unit("z").alias("zero"), V.average("a", "b", "z").alias("avg"),
        V.add("a", F.lit(None).cast("array<double>")).alias("half"),
    ).first()
    assert got.blend == pytest.approx([2.2, 2.4]) and got.cos == pytest.approx(0.6) and got.none is None
    assert got.unit == pytest.approx([0.6, 0.8]) and got.zero == [0.0, 0.0]
    assert got.avg == pytest.approx([4 / 3, 4 / 3]) and got.half == [3.0, 4.0]


def test_masked_mean(rows):
    df = rows([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1.0, 1.0, 0.0]), ([[1.0, 2.0]], [0.0])], "v ARRAY<ARRAY<DOUBLE>>, m ARRAY<DOUBLE>")
    got = [r[0] for r in df.select(E.masked_mean("v", "m")).collect()]
    assert got == [[2.0, 3.0], [0.0, 0.0]]


def test_context_sum_by_distance(rows):
    text = rows([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "row_id BIGINT, v ARRAY<DOUBLE>")
    ctx = rows([(1, [0.0, 2.0]), (1, [5.0, 0.0])], "row_id BIGINT, v ARRAY<DOUBLE>")
    got = {r.row_id: r.embedding for r in E.context_sum(text, ctx, "row_id", "v").collect()}
    assert got[1] == pytest.approx([1.0, 2.0]) and got[2] == [0.0, 1.0]
    weighted = ctx.withColumn("w", F.lit(0.5))
    got = {r.row_id: r.embedding for r in E.context_sum(text, weighted, "row_id", "v", "w").collect()}
    assert got[1] == pytest.approx([3.5, 1.0])


def test_feature_table_sums(rows):
    a = rows([(1, [1.0]), (2, [2.0])], "row_id BIGINT, v ARRAY<DOUBLE>")
    b = rows([(2, [5.0]), (3, [7.0])], "row_id BIGINT, v ARRAY<DOUBLE>")
    assert {r.row_id: r.features for r in E.add_features(a, b, "row_id", "v").collect()} == {1: [1.0], 2: [7.0], 3: [7.0]}
    assert E.shared_columns(a, b) == ["row_id", "v"]
    assert E.side_by_side(a, b.withColumnRenamed("v", "w"), "row_id").count() == 1


def pair_table(spark, phi):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=4).tolist(), rng.normal(size=4).tolist(), float(phi(i))) for i in range(10)]
    return spark.createDataFrame(data, "id BIGINT, clean ARRAY<DOUBLE>, noisy ARRAY<DOUBLE>, phi DOUBLE")


def test_alignment_identities(spark):
    score = lambda phi, size=10: [r.alignment for r in E.alignment(pair_table(spark, phi), "id", batch_size=size).orderBy("batch").collect()]
    # A constant weight is the plain mean, so its size does not matter.
    assert score(lambda i: 0.3) == pytest.approx(score(lambda i: 1.0))
    assert score(lambda i: 0.0) == [0.0]
    # A last batch of a single pair scores 0.
    assert score(lambda i: 1.0, 9)[1] == 0.0
    rows = pair_table(spark, lambda i: i / 10).collect()
    z = np.array([r.clean for r in rows] + [r.noisy for r in rows])
    z = z / np.linalg.norm(z, axis=1, keepdims=True)
    top = bottom = 0.0
    for k in range(20):
        sims = [float(z[k] @ z[j]) / 0.15 for j in range(20) if j != k]
        loss = math.log(sum(map(math.exp, sims))) - float(z[k] @ z[(k + 10) % 20]) / 0.15
        top, bottom = top + rows[k % 10].phi * loss, bottom + rows[k % 10].phi
    assert score(lambda i: i / 10)[0] == pytest.approx(top / bottom)


def test_alignment_refuses_huge_batches(spark):
    with pytest.raises(ValueError):
        E.alignment(pair_table(spark, lambda i: 1), "id", batch_size=5000)


def test_mean_pool_of_a_hot_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("g"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    hot = E.mean_pool(df, ["g"], "v").filter("g = -1").first().pooled
    assert hot == pytest.approx([sum(range(0, 2000, 3)) / 667, 1.0])
