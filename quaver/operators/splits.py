"""Exact train / validation / test splits and training-set augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.functions import fixed
from quaver.functions.noise import token_noise
from quaver.operators.ordering import cut_by_rank, hash_bucket, hash_key, leading_rows

LEVELS = tuple(fixed.TOKEN_RATES)


def _quota(counts: DataFrame, label: str, size: str, wanted, out: str) -> DataFrame:
    """Share ``wanted`` rows among labels by largest remainder; one row per label."""
    everything = W.partitionBy(F.lit(1))
    total = F.sum(size).over(everything)
    exact = F.col("__wanted") * F.col(size) / total
    seats = counts.withColumn("__wanted", wanted(total)).withColumn("__exact", exact)
    seats = seats.withColumn("__floor", F.floor("__exact"))
    left = F.col("__wanted") - F.sum("__floor").over(everything)
    place = F.row_number().over(everything.orderBy((F.col("__exact") - F.col("__floor")).desc(), label))
    return seats.withColumn(out, F.col("__floor") + F.when(place <= left, 1).otherwise(0)).drop(
        "__wanted", "__exact", "__floor"
    )


def split_quotas(
    counts: DataFrame,
    label: str,
    test_share: float = fixed.TEST_SHARE,
    validation_share: float = fixed.VALIDATION_SHARE,
) -> DataFrame:
    """Rows of each label for test and validation, from the table (label, n).

    The test part takes ceil(share * N) rows; validation takes its share of what
    is left, so that it is the same share of the whole.
    """
    of_rest = validation_share / (1.0 - test_share)
    out = _quota(counts, label, "n", lambda total: F.ceil(F.lit(test_share) * total), "n_test")
    if validation_share == 0:
        return out.withColumn("n_val", F.lit(0).cast("bigint"))
    out = out.withColumn("__rest", F.col("n") - F.col("n_test"))
    return _quota(out, label, "__rest", lambda total: F.ceil(F.lit(of_rest) * total), "n_val").drop("__rest")


def _hashed(df: DataFrame, row_id: str, seed: int) -> DataFrame:
    return df.withColumn("__key", hash_key(row_id, seed)).withColumn("__bucket", hash_bucket(F.col("__key")))


def stratified_split(
    df: DataFrame,
    row_id: str,
    label: str = "label",
    seed: int = fixed.SEED,
    test_share: float = fixed.TEST_SHARE,
    validation_share: float = fixed.VALIDATION_SHARE,
) -> DataFrame:
    """Add ``split``: test, val or train, exactly stratified by label.

    Rows without a label are dropped.
    """

    def limits(totals: DataFrame) -> DataFrame:
        quotas = split_quotas(totals, label, test_share, validation_share)
        return quotas.withColumn("limits", F.array("n_test", F.col("n_test") + F.col("n_val")))

    keyed = _hashed(df.filter(F.col(label).isNotNull()), row_id, seed)
    parts = cut_by_rank(keyed, "__bucket", ["__key", row_id], limits, ["test", "val", "train"], label)
    return parts.drop("__key", "__bucket")


def stratified_holdout(df: DataFrame, row_id: str, label: str, share: float = 0.01, seed: int = fixed.SEED) -> DataFrame:
    """One stratified cut: ``val`` takes ceil(share * N) rows, the rest is ``train``."""
    cut = stratified_split(df, row_id, label, seed, test_share=share, validation_share=0.0)
    return cut.withColumn("split", F.when(F.col("split") == "test", "val").otherwise("train"))


def random_split(df: DataFrame, row_id: str, share: float = 0.9, seed: int = fixed.SEED) -> DataFrame:
    """``train`` takes int(share * N) random rows, the rest is ``val``."""
    keyed = _hashed(df, row_id, seed).withColumn("__all", F.lit(0))
    limits = lambda totals: totals.withColumn("limits", F.array(F.floor(F.lit(share) * F.col("n"))))
    parts = cut_by_rank(keyed, "__bucket", ["__key", row_id], limits, ["train", "val"], "__all")
    return parts.drop("__key", "__bucket", "__all")


def positional_split(df: DataFrame, ordinal: str, share: float = 0.8) -> DataFrame:
    """``train`` is the leading int(share * N) rows in ordinal order, ``test`` the rest; tied rows go by their content."""
    return leading_rows(df, ordinal, share, "split", ("train", "test"))


def noise_levels(df: DataFrame, row_id: str, levels=LEVELS, seed: int = fixed.SEED) -> DataFrame:
    """One noisy copy of every row per level, keeping the original text."""
    copies = df.withColumn("noise_level", F.explode(F.array(*[F.lit(v) for v in levels])))
    return copies.withColumn("text_original", F.col("text")).withColumn(
        "text", token_noise("text", "noise_level", row_id, seed)
    )


def text_key(text) -> object:
    """Fixed-width stand-in for a text of any length in joins and groupings."""
    return F.sha2(text if not isinstance(text, str) else F.col(text), 256)


def restrict_to_texts(noisy: DataFrame, clean: DataFrame) -> DataFrame:
    """Noisy rows whose original is one of the clean texts.

    Only digests of the clean side move; a hot original is split by AQE.
    """
    wanted = clean.select(text_key("text").alias("__k")).distinct()
    return noisy.withColumn("__k", text_key("text_original")).join(wanted, "__k", "left_semi").drop("__k")


def _as_clean(train: DataFrame) -> DataFrame:
    return train.withColumn("noise_level", F.lit("clean")).withColumn("text_original", F.lit(None).cast("string"))


def augment_train(train: DataFrame, noisy: DataFrame) -> DataFrame:
    """Clean training rows plus those rows of a stored noisy table that copy their texts."""
    return _as_clean(train).unionByName(restrict_to_texts(noisy, train), allowMissingColumns=True)


def training_copies(train: DataFrame, source: DataFrame, levels=LEVELS) -> DataFrame:
    """Source rows whose text is a training text, once per level (``noise_level``), not yet corrupted.

    Either side may carry its texts' digests as ``text_key`` instead of reading the texts.
    """
    key = lambda df: F.col("text_key") if "text_key" in df.columns else text_key("text")
    wanted = train.select(key(train).alias("__k")).distinct()
    kept = source.withColumn("__k", key(source)).join(wanted, "__k", "left_semi").drop("__k")
    each = F.array(*[F.lit(v) for v in levels]) if levels else F.lit(None).cast("array<string>")
    return kept.withColumn("noise_level", F.explode(each))


def augment_from(train: DataFrame, source: DataFrame, row_id: str, levels=LEVELS, seed: int = fixed.SEED) -> DataFrame:
    """Like :func:`augment_train`, with the noise made here.

    Source rows are restricted to training texts first, so each is moved once
    and corrupted afterwards, not once per level with its noisy text.
    """
    wanted = restrict_to_texts(source.withColumn("text_original", F.col("text")), train).drop("text_original")
    return _as_clean(train).unionByName(noise_levels(wanted, row_id, levels, seed), allowMissingColumns=True)


def split_statistics(clean: DataFrame, train: DataFrame, val: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """(metric, value) rows: part sizes and positive shares."""

    def tag(df: DataFrame, part: str) -> DataFrame:
        return df.select(F.lit(part).alias("part"), F.col(label).alias("y"))

    rows = tag(clean, "clean").union(tag(train, "train")).union(tag(val, "val")).union(tag(test, "test"))
    size = lambda part: F.count_if(F.col("part") == part).cast("double")
    share = lambda part: F.avg(F.when(F.col("part") == part, (F.col("y") == 1).cast("double")))
    one = rows.agg(
        size("clean").alias("total_clean"),
        size("train").alias("train_size"),
        size("val").alias("val_size"),
        size("test").alias("test_size"),
        share("train").alias("hate_ratio_train"),
        share("test").alias("hate_ratio_test"),
    )
    return one.unpivot([], one.columns, "metric", "value")
