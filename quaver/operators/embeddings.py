"""Operators over tables of dense vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.functions import fixed
from quaver.functions import vectors as V
from quaver.operators.ordering import batch_id

#: A batch meets itself, so its pairs grow with the square of this.
MAX_BATCH = 4096


def mean_pool(df: DataFrame, keys: list[str], vector: str, mask: Column | None = None, out: str = "pooled") -> DataFrame:
    """Mean vector per group over the rows whose mask is set; vectors of a group have one length.

    A vector sum is one aggregate buffer per group and task, so a hot group is combined before it moves.
    """
    kept = df if mask is None else df.filter(mask)
    mean = Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))
    return kept.filter(F.col(vector).isNotNull()).groupBy(*keys).agg(vector_to_array(mean).alias(out))


def masked_mean(vectors, mask) -> Column:
    """Mean of an array of token vectors under a 0/1 mask, denominator kept above 1e-9."""
    vectors, mask = F.col(vectors), F.col(mask)
    kept = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x * m))
    zero = F.transform(F.get(vectors, F.lit(0)), lambda x: x * 0.0)
    total = F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    n = F.aggregate(mask, F.lit(0.0), lambda s, m: s + m)
    return F.transform(total, lambda x: x / F.greatest(n, F.lit(1e-9)))


def context_sum(
    text: DataFrame, contexts: DataFrame, row_id: str, vector: str, weight: str | None = None, out: str = "embedding"
) -> DataFrame:
    """Text vector plus the weighted sum of its context vectors.

    ``text`` has (row_id, vector); ``contexts`` has (row_id, vector[, weight]).
    Without a weight column a context counts by its cosine distance to the text.
    """
    joined = contexts.withColumnRenamed(vector, "__ctx").join(text, row_id)
    w = F.col(weight) if weight else V.cosine_distance(vector, "__ctx")
    scaled = joined.select(row_id, V.scale("__ctx", w).alias("__term"))
    total = Summarizer.sum(array_to_vector(F.col("__term").cast("array<double>")))
    sums = scaled.filter("__term IS NOT NULL").groupBy(row_id).agg(vector_to_array(total).alias("__sum"))
    return text.select(row_id, vector).join(sums, row_id, "left").select(row_id, V.add(vector, "__sum").alias(out))


def add_features(left: DataFrame, right: DataFrame, row_id: str, vector: str, out: str = "features") -> DataFrame:
    """Sum two feature tables row by row; a side that lacks a row counts as 0."""
    other = right.select(row_id, F.col(vector).alias("__other"))
    joined = left.select(row_id, vector).join(other, row_id, "full")
    return joined.select(row_id, V.add(vector, "__other").alias(out))


def side_by_side(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Columns of two feature tables, aligned by row id."""
    return left.join(right, row_id)


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """Columns both feature tables have, in the order of the first."""
    return [c for c in left.columns if c in set(right.columns)]


def alignment(
    pairs: DataFrame,
    ordinal: str,
    clean: str = "clean",
    noisy: str = "noisy",
    phi: str = "phi",
    batch_size: int = 32,
    temperature: float = fixed.TEMPERATURE,
) -> DataFrame:
    """Weighted contrastive alignment of clean and noisy vectors per batch.

    A vector's loss is the log of the summed exponentials of its scaled cosines with all other vectors of the
    batch, less the scaled cosine with its partner; a batch is the mean of losses weighted by phi, 0 if
    it is a single pair. Vectors meet within consecutive batches of a fixed size only.
    """
    if not 1 <= batch_size <= MAX_BATCH:
        raise ValueError(f"batch_size must be between 1 and {MAX_BATCH}")
    rows = batch_id(pairs.select(ordinal, clean, noisy, phi), ordinal, batch_size, "batch")
    both = F.array(F.struct(V.unit(clean).alias("z")), F.struct(V.unit(noisy).alias("z")))
    sides = rows.select("batch", F.col(ordinal).alias("pair"), F.col(phi).alias("phi"), F.posexplode(both).alias("side", "v"))
    sides = sides.select("batch", "pair", "phi", "side", "v.z")
    own, other = sides.alias("a"), sides.drop("phi").alias("b")
    same_pair = F.col("a.pair").eqNullSafe(F.col("b.pair"))
    met = own.join(other, F.col("a.batch") == F.col("b.batch")).filter(~(same_pair & (F.col("a.side") == F.col("b.side"))))
    # Cosines are at most 1, so the largest exponent is known beforehand and nothing overflows.
    closeness = ((V.dot("a.z", "b.z") - 1.0) / temperature).alias("s")
    scores = met.select("a.batch", "a.pair", "a.side", "a.phi", closeness, same_pair.alias("partner"))
    losses = scores.groupBy("batch", "pair", "side", "phi").agg(
        (F.log(F.sum(F.exp("s"))) - F.sum(F.when(F.col("partner"), F.col("s")).otherwise(0.0))).alias("loss")
    )
    value = F.sum(F.col("phi") * F.col("loss")) / F.greatest(F.sum("phi"), F.lit(1e-8))
    n = F.floor(F.count(F.lit(1)) / 2)
    return losses.groupBy("batch").agg(n.cast("long").alias("pairs"), F.when(n > 1, value).otherwise(0.0).alias("alignment"))
