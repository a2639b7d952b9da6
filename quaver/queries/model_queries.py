"""Classifiers over TF-IDF features of documents and over embeddings.

No SQL engine trains these models: where a query has SQL, it covers the rows that are predicted, by label, and whether the
model beats the most frequent label.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.operators import classifiers as K
from quaver.operators.bounded import dropped, settled, written
from quaver.operators.metrics import f1_summary
from quaver.operators.splits import noise_levels, stratified_split
from quaver.queries import query, table
from quaver.queries import common as C
from quaver.queries.common import corpus
from quaver.queries.split_queries import QUOTAS


def _text_parts(spark, folder):
    rows = corpus(spark, folder).select("row_id", "text", "label")
    parts = written(stratified_split(rows, "row_id"))
    return {name: parts.filter(F.col("split") == name).drop("split") for name in ("train", "val", "test")}


def _text_model(spark, folder, name):
    parts = _text_parts(spark, folder)
    train, test = K.text_features(parts["train"], [parts["test"]], "row_id")
    return K.fit_predict(name, train, test, "row_id")


def _vector_parts(spark, folder, classes=2):
    e = table(spark, folder, "embeddings").select("vec_id", "embedding", (F.col("label") % classes).alias("label"))
    rows = settled(K.from_arrays(stratified_split(e, "vec_id"), "embedding").drop("embedding"))
    return rows.filter("split <> 'test'").drop("split"), rows.filter("split = 'test'").drop("split")


def _scores(predictions):
    return f1_summary(predictions, by=["model"])


@query()
def svm(spark, folder):
    return _text_model(spark, folder, "SVM")


@query()
def lr(spark, folder):
    return _text_model(spark, folder, "LR")


@query()
def rf(spark, folder):
    return K.fit_predict("RF", *_vector_parts(spark, folder), "vec_id")


@query()
def gbt(spark, folder):
    return K.fit_predict("XGBOOST", *_vector_parts(spark, folder), "vec_id")


@query()
def lr_weighted(spark, folder):
    """Multinomial logistic regression with balanced class weights."""
    train, test = _vector_parts(spark, folder)
    return K.fit_predict("M_LR", K.with_class_weights(train), test, "vec_id", "weight")


@query()
def model_grid(spark, folder):
    """Validation and test macro F1 of both text models, trained and tested per level."""
    rows = corpus(spark, folder).select("row_id", "text", "label")
    parts = written(stratified_split(rows, "row_id"))
    clean = parts.select("row_id", "text", "label", F.col("split").alias("role"), F.lit("clean").alias("noise_level"))
    noisy = noise_levels(parts.filter("split <> 'val'"), "row_id").select("row_id", "text", "label", F.col("split").alias("role"), "noise_level")
    copies = written(clean.unionByName(noisy))
    dropped(parts)
    return K.grid(copies, ["clean", "low", "medium", "high"], "row_id", drop=True)


def _covered(models: list[str], classes: int = 2) -> str:
    names = ", ".join(f"({C.q(m)})" for m in models)
    return f"""WITH corpus AS (SELECT vec_id AS row_id, label % {classes} AS label FROM embeddings WHERE label IS NOT NULL), {QUOTAS}
    SELECT model, label::INT AS label, count(*) AS n_rows, count(*) AS n_predicted
    FROM parts, (VALUES {names}) m(model) WHERE split = 'test' GROUP BY model, label"""


@query(_covered(["LR", "RF", "XGBOOST", "VC"]))
def classify_all(spark, folder):
    """All three classifiers and their vote, as dispatched by A."""
    return K.coverage(K.classify("A", *_vector_parts(spark, folder), "vec_id"))


@query(_covered(["XGBOOST"], 3))
def gbt_three_classes(spark, folder):
    return K.coverage(K.fit_predict("XGBOOST", *_vector_parts(spark, folder, 3), "vec_id"))


@query(_covered(["M_LR"]))
def lr_weighted_rows(spark, folder):
    train, test = _vector_parts(spark, folder)
    return K.coverage(K.fit_predict("M_LR", K.with_class_weights(train), test, "vec_id", "weight"))


@query(f"WITH {C.CORPUS}, {QUOTAS} SELECT 'SVM' AS model, count(*) AS n_rows, true AS beats_majority FROM parts WHERE split = 'test'")
def svm_beats_majority(spark, folder):
    return K.beats_majority(_text_model(spark, folder, "SVM"))
