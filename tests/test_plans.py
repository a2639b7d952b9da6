"""Properties of physical plans that matter on large data."""

import pytest

import __spark_entry__ as entry
from quaver.operators import splits as S
from quaver.operators.tables import keep_first
from quaver.operators.tfidf import term_counts

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    "stratified_split augment_train pair_anchor pair_inner dedupe_first tfidf batch_id seeded_shuffle thread_context "
    "ctx_embedding macro_f1 baseline_delta dist_align kendall class_weights".split(),
)
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_noise_is_a_projection(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumnRenamed("doc_id", "row_id")
    text = plan(S.noise_levels(docs.select("row_id", "text"), "row_id"))
    assert "Exchange" not in text and "Python" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_copies_collapse_before_the_shuffle(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    text = plan(keep_first(docs, "text", ["doc_id"]))
    assert text.count("Exchange") == 1 and "partial_min_by" in text.split("Exchange")[1]


def test_ngram_counts_shuffle_texts_only(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumnRenamed("doc_id", "row_id")
    text = plan(term_counts(docs, "row_id"))
    assert text.count("Exchange") == 1 and "explode" not in text.split("Exchange")[1].lower()


def test_whole_split_rows_are_not_shuffled(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumnRenamed("doc_id", "row_id")
    text = plan(S.stratified_split(docs.select("row_id", "text", "lang"), "row_id", "lang"))
    whole = text.split("Window")[0]
    assert "Exchange hashpartitioning" not in whole
