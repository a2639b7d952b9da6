"""Pairing clean rows with their noisy twins.

Where the noise is made here (:func:`late_anchor_pairs`, :func:`late_clean_only_pairs`), pairs are chosen as row
ids, levels and text digests; the noisy text is a function of them, made after the choice, and never for counts.
Stored noisy tables go through :func:`anchor_pairs` and :func:`clean_only_pairs`.
Texts are joined through digests: no copy of a long text is shuffled as a key,
and each lookup side holds one row per text. Null originals never match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.functions import fixed
from quaver.functions.noise import token_noise
from quaver.functions.similarity import phi
from quaver.operators.splits import LEVELS, text_key, training_copies
from quaver.operators.tables import LEVEL_CODES, keep_first, level_code, noisy_rows


def canonical_partner(noisy: DataFrame, order: list[str], keep: str = "first") -> DataFrame:
    """One noisy partner per original text: the first or last in document order."""
    pick = F.min_by if keep == "first" else F.max_by
    known = noisy.filter(F.col("text_original").isNotNull())
    return known.groupBy(text_key("text_original").alias("__k")).agg(
        pick(F.struct(F.col("text").alias("partner"), level_code().alias("level")), F.struct(*order)).alias("__p")
    )


def _clean_anchors(clean: DataFrame, partners: DataFrame, keys: list[str]) -> DataFrame:
    joined = clean.withColumn("__k", text_key("text")).join(partners, "__k", "left")
    paired = F.col("__p").isNotNull()
    return joined.select(
        *keys,
        F.col("text").alias("clean_text"),
        F.coalesce("__p.partner", "text").alias("noisy_text"),
        F.col("label").cast("int").alias("label"),
        F.coalesce(F.col("__p.level"), F.lit(0)).alias("noise_id"),
        F.lit(True).alias("ce_mask_clean"),
        F.lit(False).alias("ce_mask_noisy"),
        paired.alias("has_pair"),
    )


def anchor_pairs(train: DataFrame, order: list[str], condition: str = "all", keep: str = "first") -> DataFrame:
    """One row per training row: the row, its partner or itself, and loss masks.

    Clean rows take their canonical noisy partner; noisy rows take their
    original if it occurs among the clean texts.
    """
    train = train.na.drop(subset=["text", "label"])
    clean = train.filter(F.col("noise_level") == "clean")
    noisy = noisy_rows(train, condition)
    keys = list(dict.fromkeys([*order, "noise_level"]))
    clean_side = _clean_anchors(clean, canonical_partner(noisy, order, keep), keys)
    known = clean.select(text_key("text").alias("__k")).distinct().withColumn("__known", F.lit(True))
    paired = F.coalesce(F.col("__known"), F.lit(False))
    # Rows without an original match nothing; a key of their own keeps them from
    # meeting in one task.
    spread = F.coalesce(text_key("text_original"), F.concat_ws("|", F.lit("none"), *order))
    noisy_side = (
        noisy.withColumn("__k", spread)
        .join(known, "__k", "left")
        .select(
            *keys,
            F.when(paired, F.col("text_original")).otherwise(F.col("text")).alias("clean_text"),
            F.col("text").alias("noisy_text"),
            F.col("label").cast("int").alias("label"),
            level_code().alias("noise_id"),
            F.lit(False).alias("ce_mask_clean"),
            F.lit(True).alias("ce_mask_noisy"),
            paired.alias("has_pair"),
        )
    )
    return clean_side.unionByName(noisy_side)


def clean_only_pairs(train: DataFrame, order: list[str], condition: str) -> DataFrame:
    """Each distinct clean text with its last noisy partner; phi is 0 without one.

    Training on ``clean`` borrows the partners of level ``low``.
    """
    train = train.na.drop(subset=["text", "label"])
    clean = keep_first(train.filter(F.col("noise_level") == "clean"), "text", order)
    level = "low" if condition == "clean" else condition
    noisy = train.filter((F.col("noise_level") == level) & (F.col("text_original") != ""))
    pairs = _clean_anchors(clean, canonical_partner(noisy, order, "last"), order)
    pairs = pairs.drop("ce_mask_clean", "ce_mask_noisy")
    # A solo row is its own placeholder, so its weight is 0 by construction.
    return with_phi(pairs)


def condition_levels(condition: str, levels=LEVELS) -> list[str]:
    """Noisy levels that a condition trains on, in their order."""
    kept = [v for v in levels if condition in ("all", v)]
    return sorted(kept, key=LEVEL_CODES.get)


def _late_partners(source: DataFrame, row_id: str, level: str | None, keep: str) -> DataFrame:
    """The row whose copy at ``level`` is the partner of each source text: by digest, without a text."""
    pick = F.min if keep == "first" else F.max
    known = source.filter(F.col("text").isNotNull() & F.col("label").isNotNull() & F.lit(level is not None))
    return known.groupBy(text_key("text").alias("__k")).agg(pick(row_id).alias("__partner"))


def _late_clean(clean: DataFrame, partners: DataFrame, row_id: str, level: str | None, seed: int) -> DataFrame:
    paired = F.col("__partner").isNotNull()
    # Equal digests, equal texts: the partner's noisy text is made from the row's own text.
    noisy = token_noise("text", F.lit(level), "__partner", seed) if level else F.col("text")
    return clean.withColumn("__k", text_key("text")).join(partners, "__k", "left").select(
        F.col(row_id),
        F.lit("clean").alias("noise_level"),
        F.col("text").alias("clean_text"),
        F.when(paired, noisy).otherwise(F.col("text")).alias("noisy_text"),
        F.col("label").cast("int").alias("label"),
        F.when(paired, F.lit(LEVEL_CODES.get(level))).otherwise(0).alias("noise_id"),
        F.lit(True).alias("ce_mask_clean"),
        F.lit(False).alias("ce_mask_noisy"),
        paired.alias("has_pair"),
    )


def late_anchor_pairs(
    train: DataFrame, source: DataFrame, row_id: str, condition: str = "all", keep: str = "first", levels=LEVELS, seed: int = fixed.SEED
) -> DataFrame:
    """:func:`anchor_pairs` of clean training rows and the copies of ``source`` rows that :func:`augment_from` would add.

    Rows are in the order of ``row_id`` (not null), then level. So a text's first partner is the copy of its first source row at
    the condition's lowest level, and the last one that of its last row at the highest.
    """
    train, chosen = train.na.drop(subset=["text", "label"]), condition_levels(condition, levels)
    level = (chosen[0] if keep == "first" else chosen[-1]) if chosen else None
    clean_side = _late_clean(train, _late_partners(source, row_id, level, keep), row_id, level, seed)
    copies = training_copies(train, source, chosen).na.drop(subset=["text", "label"])
    noisy_side = copies.select(
        F.col(row_id),
        "noise_level",
        F.col("text").alias("clean_text"),
        token_noise("text", "noise_level", row_id, seed).alias("noisy_text"),
        F.col("label").cast("int").alias("label"),
        level_code().alias("noise_id"),
        F.lit(False).alias("ce_mask_clean"),
        F.lit(True).alias("ce_mask_noisy"),
        F.lit(True).alias("has_pair"),
    )
    return clean_side.unionByName(noisy_side)


def late_clean_only_pairs(train: DataFrame, source: DataFrame, row_id: str, condition: str, seed: int = fixed.SEED) -> DataFrame:
    """:func:`clean_only_pairs` with the noise made here: each distinct clean text with the copy of its last source row."""
    clean = keep_first(train.na.drop(subset=["text", "label"]), "text", [row_id])
    level = "low" if condition == "clean" else condition
    partners = _late_partners(source.filter(F.col("text") != ""), row_id, level, "last")
    pairs = _late_clean(clean, partners, row_id, level, seed)
    return with_phi(pairs.drop("noise_level", "ce_mask_clean", "ce_mask_noisy"))


def with_phi(pairs: DataFrame) -> DataFrame:
    """Add the phonetic dissimilarity weight of each pair."""
    return pairs.withColumn("phi", phi("clean_text", "noisy_text"))


def pair_inner(clean: DataFrame, noisy: DataFrame) -> DataFrame:
    """All clean-noisy combinations with the same original text.

    Equal combinations are returned once with their multiplicity ``n_pairs``, so
    the result grows with the distinct rows, not with their product. Use
    :func:`expand_pairs` for one row per combination.
    """
    # Counting the text itself leaves out nulls without computing it twice.
    key = text_key("text_original").alias("__k")
    left = clean.filter(F.col("text_original").isNotNull() & F.col("label").isNotNull())
    left = left.groupBy(key, "text_original", "text", "label").agg(F.count("text").alias("__l")).filter("__l > 0")
    right = noisy.filter(F.col("text_original").isNotNull())
    right = right.groupBy(key, F.col("text").alias("text_noisy"), F.col("noise_level").alias("noise_level_noisy"))
    right = right.agg(F.count("text").alias("__r")).filter("__r > 0")
    return left.join(right, "__k").select(
        "text_original",
        "text",
        "text_noisy",
        "label",
        "noise_level_noisy",
        (F.col("__l") * F.col("__r")).alias("n_pairs"),
    )


def expand_pairs(pairs: DataFrame) -> DataFrame:
    """One row per combination of :func:`pair_inner`."""
    return pairs.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("n_pairs")))).drop("__copy", "n_pairs")


def pair_statistics(pairs: DataFrame) -> DataFrame:
    """Paired, solo and total counts, and whether pairs span two noise levels."""
    paired = F.col("has_pair")
    return pairs.agg(
        F.count_if(paired).alias("n_pair"),
        F.count_if(~paired).alias("n_solo"),
        F.count(F.lit(1)).alias("n_total"),
        F.count_distinct(F.when(paired, F.col("noise_id"))).alias("n_levels"),
    ).withColumn("has_diverse_noise", F.col("n_levels") >= 2)


def phi_by_level(pairs: DataFrame, level: str = "noise_id") -> DataFrame:
    """Mean weight of the real pairs per noise level."""
    return (
        pairs.filter("has_pair").groupBy(level).agg(F.count(F.lit(1)).alias("n"), F.avg("phi").alias("mean_phi"))
    )


def phi_histogram(pairs: DataFrame, level: str = "noise_id", bins: int = 20) -> DataFrame:
    """Counts of pair weights in equal bins over [0, 1]."""
    bin_ = F.least(F.floor(F.col("phi") * bins), F.lit(bins - 1)).alias("bin")
    return pairs.filter("has_pair").groupBy(level, bin_).agg(F.count(F.lit(1)).alias("n"))
