"""From raw files to the merged corpus, its noisy copies and the final splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.functions import fixed
from quaver.functions.text import clean_text, junk_class, longer_than, strip_zero_width
from quaver.operators.bounded import reuse
from quaver.operators.splits import augment_from, noise_levels, split_statistics, stratified_split
from quaver.operators.tables import keep_first, language_subset
from quaver.sources.adapters import adapt_all
from quaver.sources.readers import read_csv


def merge(tables: dict[str, DataFrame]) -> DataFrame:
    """Adapt, stack, keep the first copy of each text, drop texts of 5 characters or fewer.

    ``row_id`` is the digest of the text, which is unique here, so splits and noise
    that depend on it are the same on any cluster.
    """
    stacked = adapt_all(tables)
    if stacked is None:
        raise ValueError("no table has an adapter")
    # The length test does not depend on which copy is kept, so it goes first.
    kept = keep_first(stacked.filter(longer_than("text", 5)), "text", ["source_priority", "ordinal"])
    return kept.withColumn("row_id", F.sha2("text", 256)).drop("source_priority", "ordinal")


def drop_junk(df: DataFrame) -> DataFrame:
    """Remove junk rows; strip zero-width spaces from the rest."""
    return df.filter(junk_class("text").isNull()).withColumn("text", strip_zero_width("text"))


def build_corpus(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """Corpus from named CSV files, kept because several branches read it."""
    return reuse(merge({name: read_csv(spark, path) for name, path in files.items()}))


def noisy_source(corpus: DataFrame) -> DataFrame:
    """Rows to corrupt: the code-mixed subset, or everything when that is empty."""
    mixed = language_subset(corpus)
    return corpus if mixed.isEmpty() else mixed


def build_splits(corpus: DataFrame, row_id: str = "row_id", seed: int = fixed.SEED) -> dict[str, DataFrame]:
    """Split the corpus, add noisy copies to train, corrupt the test part per level."""
    parts = reuse(stratified_split(corpus, row_id, "label", seed))
    pick = lambda name: parts.filter(F.col("split") == name).drop("split")
    train = augment_from(pick("train"), noisy_source(corpus), row_id, seed=seed)
    clean = lambda df: df.withColumn("noise_level", F.lit("clean"))
    tests = noise_levels(pick("test"), row_id, seed=seed)
    return {
        "train": train,
        "val": clean(pick("val")),
        "test": clean(pick("test")).unionByName(tests, allowMissingColumns=True),
        "stats": split_statistics(corpus, train, pick("val"), pick("test")),
    }


def noisy_label_counts(rows: DataFrame, row_id: str, level: str = "high", by: str = "lang_pair") -> DataFrame:
    """Clean, de-duplicate, filter and corrupt a labelled table, then count by language.

    The shortest route through the library; used as its smoke query.
    """
    cleaned = rows.withColumn("text", clean_text("text")).filter(longer_than("text", 5))
    first = keep_first(cleaned, "text", [row_id])
    noisy = noise_levels(first, row_id, levels=(level,))
    changed = (F.col("text") != F.col("text_original")).cast("int")
    return noisy.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(changed).alias("n_changed"), F.sum(F.length("text")).alias("n_chars")
    )
