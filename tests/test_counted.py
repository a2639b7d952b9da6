"""Texts kept as counts against their TF-IDF vectors."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quaver.operators import classifiers as K
from quaver.operators import counted as N
from quaver.operators import linear as L
from quaver.operators import passes
from quaver.operators.bounded import dropped, written
from quaver.operators.tfidf import fit_idf, term_counts, term_totals


@pytest.fixture
def texts(spark):
    rows = [(i, f"{'calm blue sea' if i % 2 else 'angry red fire'} {'very ' * (i % 4)}{i}", i % 2) for i in range(60)]
    rows += [(3, "another text of three", 1), (3, "and one more", None), (None, "no key", 0), (None, "calm", 1), (70, None, 1), (71, "", 0), (72, "一", 1)]
    return spark.createDataFrame(rows, "row_id BIGINT, text STRING, label INT")


def files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle_" in found.apply(i).toString() for i in range(found.size()))


def test_numbers_are_packed():
    for x in ([], [0], [254, 255, 256, 0, 510, 3], list(range(2000))):
        data = pa.py_buffer(N.packed(np.array(x, np.int64)))
        assert N.numbers(data).tolist() == x and N.totals(data).tolist() == np.cumsum(np.array(x, np.int64)).tolist()


@pytest.mark.parametrize("name", ["SVM", "LR", "M_LR"])
def test_a_model_of_counts_equals_one_of_vectors(texts, name):
    train, test = K.text_features(texts, [texts], "row_id")
    model = K.fit_linear(name, train, tolerance=1e-9)
    other = K.fit_linear(name, train.where("true"), tolerance=1e-9)
    assert model.classes == other.classes and model.weights.shape == other.weights.shape
    plain = [m.weights - m.weights.mean(axis=1, keepdims=name == "M_LR") * (name == "M_LR") for m in (model, other)]
    assert np.abs(plain[0] - plain[1]).max() < 1e-5
    got = [sorted(map(str, K.fit_predict(name, a, b, "row_id").select("row_id", "label", "model", "prediction").collect())) for a, b in ((train, test), (train.where("true"), test))]
    assert got[0] == got[1] and len(got[0]) == 67


def test_margins_of_blocks_are_those_of_vectors(texts):
    train, test = K.text_features(texts, [texts], "row_id")
    vectors = sorted((str(r.row_id), str(r.label), tuple(r.features.toArray())) for r in test.collect())
    size = len(test.texts.terms.names)
    weights = np.random.default_rng(0).normal(size=(size, 1))
    model = L.Model(L.logistic(), [0.0, 1.0], weights, np.array([0.25]))
    found = sorted((str(r.row_id), str(None if r.label is None else float(r.label)), r.probability) for r in N.predict_texts(test.texts, model).collect())
    want = sorted((i, y, 1 / (1 + np.exp(-(np.array(v) @ weights[:, 0] + 0.25)))) for i, y, v in vectors)
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert np.allclose([f[2] for f in found], [w[2] for w in want], atol=1e-12)


def test_totals_are_those_of_counts(texts):
    plain = texts.where("row_id IS NOT NULL")
    pairs = [sorted(map(tuple, fit_idf(f(plain, "row_id"), plain, 50).collect())) for f in (term_counts, term_totals)]
    assert pairs[0] == pairs[1] and len(pairs[0]) == 50


def test_a_grid_holds_each_text_once_in_few_bytes(spark):
    rows = spark.range(300).select(
        F.col("id").alias("row_id"), F.concat_ws(" ", *[F.conv(F.abs(F.xxhash64("id", F.lit(k))) % 100000, 10, 36) for k in range(120)]).alias("text"),
        (F.col("id") % 2).alias("label"), F.when(F.col("id") < 200, "train").otherwise("val").alias("role"), F.lit("clean").alias("noise_level"),
    )
    blocks, terms, used = K.condition_features(rows, ["clean", "low", "high"], "row_id")
    found = blocks.collect()
    assert sum(r.n for r in found) == 300 and {tuple(v) for v in used.values()} == {("clean", "low", "high")}
    entries = sum(len(N.numbers(pa.py_buffer(bytes(r.rows)))) for r in found)
    assert entries > 50_000
    # Twelve for each entry and condition in vectors.
    assert sum(len(r[c]) for r in found for c in ("label", "places", "sizes", "rows", "times", "unit")) < 4 * entries


def test_passes_leave_no_shuffle_files_and_one_copy(spark):
    context = spark.sparkContext
    kept_now = lambda: set(context._jsc.getPersistentRDDs())
    held = kept_now()
    blocks = spark.range(0, 400, 1, 40).select(F.encode(F.col("id").cast("string"), "utf-8").alias("at"))
    kept, tasks = passes.dealt(blocks, ["at"])
    assert tasks == 1 and len(kept_now() - held) == 1
    kept, tasks = passes.dealt(blocks, ["at"], 100)
    assert tasks == kept.rdd.getNumPartitions() > 1
    before = files(spark)
    got = passes.sums(kept, tasks, lambda batches: {0: np.full(20_000, float(sum(b.num_rows for b in batches)))})
    assert set(got[0]) == {400.0}
    until = time.time() + 20
    while files(spark) > before and time.time() < until:
        time.sleep(0.2)
    assert files(spark) <= before
    passes.release(kept)
    assert not kept_now() - held


def test_written_rows_come_back(spark):
    rows = spark.createDataFrame([(1, "a", [1.0]), (None, None, None)], "i INT, t STRING, v ARRAY<DOUBLE>").repartition(2, "i")
    table = written(rows)
    assert sorted(map(str, table.collect())) == sorted(map(str, rows.collect())) and table.schema == rows.schema
    dropped(table)


def test_pairs_of_wide_models_are_in_a_file():
    pairs = L._Pairs()
    for k in range(L.MEMORY + 3):
        pairs.add(np.full(1 << 15, k + 1.0), np.ones(1 << 15))
    assert isinstance(pairs.held, np.memmap)
    assert [(s[0], y[-1], r) for s, y, r in pairs][:1] == [(4.0, 1.0, 1 / (4.0 * (1 << 15)))] and len(list(pairs)) == L.MEMORY


def test_a_fit_makes_no_vectors_and_leaves_no_shuffles(texts, monkeypatch):
    train, test = K.text_features(texts.where("row_id < 40"), [texts.where("row_id >= 40")], "row_id")
    monkeypatch.setattr(K.linear, "blocks", None)
    before = files(texts.sparkSession)
    assert K.fit_linear("SVM", train).weights.any()
    until = time.time() + 20
    while files(texts.sparkSession) > before and time.time() < until:
        time.sleep(0.2)
    assert files(texts.sparkSession) <= before


def test_majority_is_beaten_without_vectors(texts, monkeypatch):
    few = texts.where("row_id < 60 AND label IS NOT NULL").dropDuplicates(["row_id"])
    train, test = K.text_features(few.where("row_id < 40"), [few.where("row_id >= 40")], "row_id")
    for name in ("blocks", "predict"):
        monkeypatch.setattr(K.linear, name, None)
    assert [tuple(r) for r in K.beats_majority(K.fit_predict("SVM", train, test, "row_id")).collect()] == [("SVM", 20, True)]


def test_probabilities_come_without_vectors(texts, monkeypatch):
    few = texts.where("row_id < 60 AND label IS NOT NULL").dropDuplicates(["row_id"])
    train, test = K.text_features(few.where("row_id < 40"), [few.where("row_id >= 40")], "row_id")
    for name in ("blocks", "predict"):
        monkeypatch.setattr(K.linear, name, None)
    found = K.fit_predict("LR", train, test, "row_id").collect()
    assert len(found) == 20 and all((r.probability > 0.5) == (r.prediction == 1) == (r.label == 1) for r in found)
