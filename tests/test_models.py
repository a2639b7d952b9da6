import pytest
from pyspark.sql import functions as F

from quaver.operators import classifiers as K
from quaver.operators.metrics import f1_summary


@pytest.fixture(scope="module")
def texts(spark):
    words = F.when(F.col("id") % 2 == 0, "calm blue sea").otherwise("angry red fire")
    return spark.range(60).select(
        F.col("id").alias("row_id"), F.concat_ws(" ", words, F.col("id")).alias("text"), (F.col("id") % 2).cast("int").alias("label")
    )


@pytest.mark.parametrize("name", ["SVM", "LR"])
def test_text_models_learn(texts, name):
    train, test = K.text_features(texts.filter("row_id < 40"), [texts.filter("row_id >= 40")], "row_id")
    out = K.fit_predict(name, train, test, "row_id")
    assert f1_summary(out).first().macro_f1 == 1.0
    known = out.filter(F.col("probability").isNotNull()).count()
    assert known == (20 if name == "LR" else 0)


def test_grid_returns_result_rows(texts):
    train = texts.filter("row_id < 40").withColumn("noise_level", F.lit("clean"))
    rest = texts.filter("row_id >= 40")
    got = K.fit_grid(train, rest, {"clean": rest, "low": rest}, "row_id", models=("LR",)).collect()
    assert {(r.model, r.noise_level, r.val_f1_macro, r.test_f1_macro) for r in got} == {
        ("tfidf_lr", "clean", 1.0, 1.0), ("tfidf_lr", "low", 1.0, 1.0),
    }


def test_weights_and_names(spark):
    df = K.from_arrays(
        spark.range(40).select("id", F.array(F.col("id") * 1.0, F.lit(1.0)).alias("v"), (F.col("id") > 9).cast("int").alias("label")), "v"
    )
    weighted = K.with_class_weights(df)
    sums = {r.label: r.s for r in weighted.groupBy("label").agg(F.sum("weight").alias("s")).collect()}
    assert sums[0.0] == pytest.approx(sums[1.0])
    out = K.fit_predict("M_LR", weighted, df, "id", "weight")
    assert f1_summary(out).first().accuracy > 0.9


def test_voting(spark, monkeypatch):
    df = K.from_arrays(spark.range(30).select("id", F.array(F.col("id") * 1.0).alias("v"), (F.col("id") > 14).cast("int").alias("label")), "v")
    monkeypatch.setattr(K, "VOTERS", ("LR", "SVM", "M_LR"))
    out = K.classify("VC", df, df, "id")
    assert out.count() == 30 and f1_summary(out).first().accuracy > 0.8
    everything = K.classify("A", df, df, "id")
    assert {r.model: r["count"] for r in everything.groupBy("model").count().collect()} == {"LR": 30, "SVM": 30, "M_LR": 30, "VC": 30}


def test_a_text_without_a_known_term_is_an_empty_sparse_row(texts):
    odd = texts.filter("row_id < 2").withColumn("text", F.lit("\u4e00"))
    _, test = K.text_features(texts, [odd], "row_id")
    assert [(r.features.size > 50, len(r.features.values), type(r.features).__name__) for r in test.collect()] == [(True, 0, "SparseVector")] * 2


def test_grid_conditions():
    levels = ["clean", "low", "high", "all"]
    assert K.uses("train", "clean", levels) == levels and K.uses("val", "clean", levels) == levels
    assert K.uses("train", "low", levels) == ["low", "all"] and K.uses("test", "high", levels) == ["high"]
