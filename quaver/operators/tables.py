"""De-duplication, profiles and label bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.functions.fixed import LEVEL_CODES
from quaver.operators.ordering import rank_by_ordinal
from quaver.operators.splits import text_key


def keep_first(df: DataFrame, key: str, order: list[str], last: bool = False) -> DataFrame:
    """First (or last) row per key by ``order``, which must be unique.

    The winner is an aggregate, so copies collapse before the shuffle and a hot
    key costs one row per task. String keys travel as digests.
    """
    grouping = text_key(key) if dict(df.dtypes)[key] == "string" else F.col(key)
    pick = F.max_by if last else F.min_by
    rows = df.groupBy(grouping.alias("__k")).agg(pick(F.struct(*df.columns), F.struct(*order)).alias("__row"))
    return rows.select("__row.*")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: its position, the row count and its null count."""
    counts = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns],
    )
    entries = [
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"), F.col(c).alias("nulls"))
        for i, c in enumerate(df.columns)
    ]
    return counts.select(F.col("__rows").alias("row_count"), F.inline(F.array(*entries)))


def preview(df: DataFrame, order: list[str], n: int = 2) -> DataFrame:
    """First ``n`` rows by an explicit order."""
    return df.orderBy(*order).limit(n)


def label_ratio(df: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """Positive and negative counts and the positive share per group."""
    positive = F.col(label) == 1
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(positive).alias("positive"),
        F.count_if(~positive).alias("negative"),
        F.avg(positive.cast("double")).alias("positive_ratio"),
    )


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (2 * count) per label."""
    counts = value_counts(df.filter(F.col(label).isNotNull()), [label])
    total = F.sum("n").over(W.partitionBy(F.lit(1)))
    return counts.withColumn("weight", total / (2.0 * F.greatest(F.col("n"), F.lit(1))))


def annotator_means(
    df: DataFrame, key: str, text: str, score: str, order: str, cut: float = 0.5
) -> DataFrame:
    """One row per item: first non-null text, mean score, thresholded label."""
    means = (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.min_by(text, F.when(F.col(text).isNotNull(), F.col(order))).alias(text),
            F.avg(score).alias(score),
        )
    )
    return means.withColumn("label", score_label(score, cut))


def score_label(score: str, cut: float = 0.5) -> Column:
    """1 at or above the cut, else 0; a missing score is 0."""
    return F.coalesce((F.col(score) >= cut).cast("int"), F.lit(0))


def map_labels(label, mapping: dict) -> Column:
    """Dictionary lookup; unmapped values become null."""
    out = F
    for key, value in mapping.items():
        out = out.when((label if isinstance(label, Column) else F.col(label)) == key, value)
    return out.otherwise(None)


def binary_label(label, positive: str = "HOF") -> Column:
    column = label if isinstance(label, Column) else F.col(label)
    return F.when(column == positive, 1).otherwise(0)


def fit_label_codes(df: DataFrame, label: str) -> DataFrame:
    """Sorted distinct values and their codes 0..k-1, by a sample sort."""
    values = df.select(label).filter(F.col(label).isNotNull()).distinct()
    return rank_by_ordinal(values, label, "__rank").select(label, (F.col("__rank") - 1).cast("int").alias("code"))


def encode_labels(df: DataFrame, label: str, codes: DataFrame) -> DataFrame:
    """Attach the fitted codes; values unseen in fitting get null."""
    return df.join(codes, label, "left")


def level_rows(df: DataFrame, condition: str, level: str = "noise_level") -> DataFrame:
    """Rows a condition trains on: everything, clean only, or clean and one level."""
    if condition == "all":
        return df
    return df.filter(F.col(level).isin("clean", condition))


def noisy_rows(df: DataFrame, condition: str, level: str = "noise_level") -> DataFrame:
    """Noisy rows of a condition: none for clean, all levels for all."""
    if condition == "clean":
        return df.filter(F.lit(False))
    if condition == "all":
        return df.filter(F.col(level).isin("low", "medium", "high"))
    return df.filter(F.col(level) == condition)


def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop(subset=subset)


def language_subset(df: DataFrame, pair: str = "hi-en") -> DataFrame:
    return df.filter(F.col("lang_pair") == pair)


def row_shape(post="post", context="context", text="text") -> Column:
    """Which parts of a hierarchical row are filled; null for any other pattern."""
    filled = [F.coalesce(F.col(c), F.lit("")) != "" for c in (post, context, text)]
    return (
        F.when(filled[0] & ~filled[1] & ~filled[2], "post")
        .when(filled[0] & filled[1] & ~filled[2], "post_context")
        .when(filled[0] & filled[1] & filled[2], "post_context_text")
    )


def row_shape_with_default(context="context", text="text") -> Column:
    """Variant in which every remaining row counts as complete."""
    blank = [F.coalesce(F.col(c), F.lit("")) == "" for c in (context, text)]
    return F.when(blank[0], "post").when(blank[1], "post_context").otherwise("post_context_text")


def level_code(level="noise_level") -> Column:
    """clean, low, medium, high as 0..3."""
    return map_labels(level, {k: F.lit(v) for k, v in LEVEL_CODES.items()})


def order_by_level(df: DataFrame, level: str, *then: str) -> DataFrame:
    return df.orderBy(level_code(level), *then)


def language_ratio(langs, wanted: str = "HIN") -> Column:
    """Share of tokens carrying a language tag."""
    tags = langs if isinstance(langs, Column) else F.col(langs)
    return F.size(F.filter(tags, lambda t: t == wanted)) / F.greatest(F.size(tags), F.lit(1))


def top_terms(counts: DataFrame, term: str, frequency: str, k: int = 100_000) -> DataFrame:
    """The k most frequent terms; ties go to the smaller term."""
    return counts.orderBy(F.desc(frequency), term).limit(k)


def positive_rows(rows: DataFrame, predictions: DataFrame, row_id: str) -> DataFrame:
    """Rows that a model predicted positive."""
    return rows.join(predictions.filter(F.col("prediction") == 1).select(row_id), row_id, "left_semi")
