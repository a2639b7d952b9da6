"""Classical classifiers by name, TF-IDF features for them, and the fit-and-evaluate grid."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.operators import counted, linear, trees
from quaver.operators.bounded import dropped, reuse, settled, swept, written
from quaver.operators.passes import dealt
from quaver.operators.metrics import f1_summary, majority_vote
from quaver.operators.tables import class_weights, level_rows, top_terms
from quaver.operators.tfidf import MAX_TERMS, fit_idf, index_terms, pack_vectors, term_lists, term_totals, with_empty

VOTERS = ("LR", "RF", "XGBOOST")


def from_arrays(df: DataFrame, array: str, label: str = "label") -> DataFrame:
    """Array features as MLlib vectors."""
    return df.withColumn("features", array_to_vector(F.col(array).cast("array<double>"))).withColumn(
        "label", F.col(label).cast("double")
    )


def with_class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Balanced class weight of each row."""
    return train.join(F.broadcast(class_weights(train, label).select(label, "weight")), label)


def fit_linear(name: str, train: DataFrame, weight: str | None = None, tolerance: float = 1e-4) -> linear.Model:
    """One linear model on (label, features); rows weigh alike unless ``weight`` names their column."""
    spec = linear.svm(name=name) if name == "SVM" else linear.logistic(name=name, multinomial=name == "M_LR")
    if not weight and hasattr(train, "texts"):
        return counted.fit_texts(train.texts, spec, tolerance)
    weigh_by = F.col(weight).cast("double") if weight else F.lit(1.0)
    first = train.select("features").where("features IS NOT NULL").first()
    rows = train.select(F.lit("all").alias("condition"), F.col("label").cast("double").alias("label"), weigh_by.alias("weight"), "features")
    return linear.fit(rows, [spec], first[0].size if first else 0, tolerance)[0]


def fit_predict(name: str, train: DataFrame, test: DataFrame, row_id: str, weight: str | None = None) -> DataFrame:
    """(row, label, model, prediction, probability of class 1 where the model has one)."""
    rows = test.select(row_id, F.col("label").cast("int").alias("label"), "features")
    keep = [row_id, "label"]
    if name in ("SVM", "LR", "M_LR"):
        if hasattr(test, "texts") and test.texts.row_id == row_id and test.texts.terms is getattr(getattr(train, "texts", None), "terms", None):
            return counted.predict_texts(test.texts, fit_linear(name, train, weight))
        return linear.predict(rows.withColumn("condition", F.lit("all")), [fit_linear(name, train, weight)], keep)
    if weight:
        raise ValueError(f"{name} takes no row weights")
    if name == "RF":
        return trees.predict_forest(trees.fit_forest(train, row_id), rows, keep)
    if name == "XGBOOST":
        return trees.predict_boosted(trees.fit_boosted(train, row_id), rows, keep)
    raise KeyError(name)


def classify(name: str, train: DataFrame, test: DataFrame, row_id: str) -> DataFrame:
    """Dispatch by name: a single model, VC (majority of three), or A (all three and their vote)."""
    if name not in ("A", "VC", "M_VC"):
        return fit_predict(name, train, test, row_id)
    votes = reuse(reduce(DataFrame.unionByName, [fit_predict(m, train, test, row_id) for m in VOTERS]))
    labels = test.select(row_id, F.col("label").cast("int").alias("label"))
    vote = majority_vote(votes, row_id).join(labels, row_id).select(
        row_id, "label", F.lit("VC" if name == "A" else name).alias("model"), "prediction", F.lit(None).cast("double").alias("probability")
    )
    return votes.unionByName(vote) if name == "A" else vote


def coverage(predictions: DataFrame) -> DataFrame:
    """(model, label, n_rows, n_predicted) of a prediction table."""
    return predictions.groupBy("model", "label").agg(F.count(F.lit(1)).alias("n_rows"), F.count("prediction").alias("n_predicted"))


def beats_majority(predictions: DataFrame) -> DataFrame:
    """(model, n_rows, beats_majority): whether more rows are right than the most frequent label has."""
    cells = predictions.groupBy("model", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("prediction")).alias("right"))
    return cells.groupBy("model").agg(F.sum("n").alias("n_rows"), (F.sum("right") > F.max("n")).alias("beats_majority"))


def text_features(train: DataFrame, others: list[DataFrame], row_id: str, k: int = MAX_TERMS) -> list[DataFrame]:
    """TF-IDF vectors of the training rows and, with the same vocabulary, of others.

    The tables know their ``texts``, from which linear models are fitted without making the vectors.
    """
    with swept(train.sparkSession):
        # MAX_TERMS rows at most
        known = index_terms(fit_idf(term_totals(train, row_id), train, k)).select("term", "index", "idf").toArrow()
    terms = counted.terms_of({"all": known})
    entries = [(*r, 0) for r in zip(*(known[c].to_pylist() for c in ("term", "index", "idf")), strict=True)]

    def vectors(rows: DataFrame) -> DataFrame:
        lists = term_lists(rows, row_id, entries).select(row_id, "indices", "values")
        # A text without a term of the vocabulary is a row all the same.
        labelled = rows.select(row_id, F.col("label").cast("double").alias("label"))
        out = pack_vectors(with_empty(labelled.join(lists, row_id, "left")), len(entries))
        out.texts = counted.Texts(rows, row_id, terms)
        return out

    return [vectors(train), *[vectors(o) for o in others]]


def uses(role: str, level: str, conditions: list[str]) -> list[str]:
    """Conditions that use the rows of a role and level: training rows those that train on the level, test rows those of their own."""
    if role == "val":
        return conditions
    own = [c for c in conditions if c in ("all", level)]
    return conditions if role == "train" and level == "clean" else [c for c in own if role == "train" or c == level]


def condition_features(rows: DataFrame, conditions: list[str], row_id: str, k: int = MAX_TERMS) -> tuple[DataFrame, counted.Terms, dict[tuple, list[str]]]:
    """Blocks of rows (row id, text, label, role, noise_level), the terms of the conditions, and the conditions that use the rows of a role and level.

    Roles are train, val and test; a row may be used by several conditions, see :func:`uses`, and is held once. A condition's vocabulary
    and idf come from the training rows that it uses. Row ids need only be unique within a role and level.
    """
    spark = rows.sparkSession
    key = F.struct("role", "noise_level", F.col(row_id).cast("string").alias("id"))
    keyed = rows.select(key.alias("key"), "text", F.col("label").cast("double").alias("label"))
    with swept(spark):
        cells = rows.groupBy("role", "noise_level").count().collect()
        used = {(r["role"], r["noise_level"]): uses(r["role"], r["noise_level"], conditions) for r in cells}
        totals = settled(term_totals(keyed.where("key.role = 'train'"), "key", lambda key: key["noise_level"]))
        known = {}
        for condition in conditions:
            mine = [r for r in cells if r["role"] == "train" and condition in used["train", r["noise_level"]]]
            n = sum(r["count"] for r in mine)
            seen = totals.where(F.col("level").isin([r["noise_level"] for r in mine])).groupBy("term").agg(F.sum("tf").alias("corpus_tf"), F.sum("df").alias("df"))
            idf = top_terms(seen, "term", "corpus_tf", k).select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
            # At most k terms a condition.
            known[condition] = index_terms(idf).select("term", "index", "idf").toArrow()
    terms = counted.terms_of(known)
    used = {cell: own for cell, own in used.items() if None not in cell}
    return counted.blocks(keyed, "key", terms, used, lambda key: (key["role"], key["noise_level"])), terms, used


def grid(rows: DataFrame, conditions: list[str], row_id: str, models=("SVM", "LR"), tolerance: float = 1e-4, drop: bool = False) -> DataFrame:
    """One result row per model and condition, from rows (row id, text, label, role, noise_level).

    A condition's models learn from the clean training rows and those of its own level. All models of all conditions are
    fitted together, a pass over the one table of blocks for all of them; all their predictions are one more pass. Macro F1 of
    the validation rows and of the condition's test rows, rounded to four digits. With ``drop``, rows of :func:`written` go as soon
    as the blocks are there.
    """
    blocks, terms, used = condition_features(rows, conditions, row_id)
    make = {"SVM": linear.svm, "LR": linear.logistic, "M_LR": lambda c, n: linear.logistic(c, n, multinomial=True)}
    specs = [make[m](c, m) for c in conditions for m in models]
    blocked, tasks = dealt(blocks, ["places", "sizes", "rows", "times", "unit"], settle=True)
    if drop:
        dropped(rows)
    fitted = counted.fit(blocked, tasks, specs, terms, used, tolerance)
    found = counted.predict(blocked.where("role <> 'train'"), fitted, terms, used)
    scored = f1_summary(found.withColumn("label", F.col("label").cast("int")), by=["condition", "model", "role"])
    lines: dict[tuple[str, str], dict] = {}
    for r in scored.select("condition", "model", "role", F.round("macro_f1", 4).alias("f1")).collect():
        lines.setdefault((r["condition"], r["model"]), {})[r["role"]] = r["f1"]
    out = [(f"tfidf_{m.lower()}", c, v.get("val"), v.get("test")) for (c, m), v in sorted(lines.items())]
    return rows.sparkSession.createDataFrame(out, "model STRING, noise_level STRING, val_f1_macro DOUBLE, test_f1_macro DOUBLE")


def fit_grid(train: DataFrame, val: DataFrame, tests: dict[str, DataFrame], row_id: str, models=("SVM", "LR")) -> DataFrame:
    """:func:`grid` over separate tables: training rows with their ``noise_level``, validation rows, test rows by condition."""
    slim = [F.col(row_id).cast("string").alias(row_id), "text", "label"]
    parts = [train.select(*slim, F.lit("train").alias("role"), "noise_level"), val.select(*slim, F.lit("val").alias("role"), F.lit("clean").alias("noise_level"))]
    parts += [df.select(*slim, F.lit("test").alias("role"), F.lit(c).alias("noise_level")) for c, df in tests.items()]
    rows = written(reduce(DataFrame.unionByName, parts))
    return grid(rows, list(tests), row_id, models, drop=True)
