"""Documents to training sequences: language, near-duplicates, benchmark leaks, personal data, packing.

``STAGES`` are functions of (spark, documents, folder). Each works on all rows that its predecessor kept, and all
but the last return the columns of ``documents``. Rows whose ``doc_id`` is null can't be named by
a decision: they pass the stages that compare documents. Rows that share a ``doc_id`` are one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm.common import new_path
from quaver.llm.decontamination import contaminated
from quaver.llm.language_id import UNKNOWN, fit_languages, has_letter, predict_languages
from quaver.llm.lsh_forest import near_duplicates
from quaver.llm.packing import best_fit, word_length
from quaver.llm.pii import pii_spans

#: A text whose best language scores less is rejected: no better than a draw among four.
LEAST_SCORE = 0.25


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns of these names out of the way, and how to name them again."""
    taken = {f"__own_{c}": c for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed({v: k for k, v in taken.items()}), taken


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts with letters whose language is told; a missing label is filled in."""
    net = fit_languages(docs)
    rows, own = _aside(docs, "lang_pred", "lang_score")
    if not net.labels:  # nothing to learn from: only texts without letters go
        return docs.where(has_letter(F.col("text")))
    found = predict_languages(rows, net).where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).drop("lang_pred", "lang_score").withColumnsRenamed(own).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the smallest id."""
    found = near_duplicates(docs.select("doc_id", "text"), size=5, percent=80)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item within its edit budget."""
    hits = contaminated(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(hits.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows."""
    rows, own = _aside(docs, "pii_spans", "pii_masked")
    found = pii_spans(rows).withColumn("text", F.col("pii_masked")).drop("pii_spans", "pii_masked").withColumnsRenamed(own)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of texts, by words and one end token each."""
    return best_fit(docs.select("doc_id", word_length(F.col("text")).alias("n_tokens")))


STAGES = [
    ("language", language),
    ("near_duplicate", near_duplicate),
    ("benchmark", benchmark),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Learned models and signatures can't be put in SQL; the stages are held against brute force in tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each from the written rows of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        rows = stage(spark, docs, sf_dir)
        rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
