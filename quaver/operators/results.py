"""Result records to robustness tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.functions import fixed
from quaver.operators.tables import level_code

CONDITIONS = tuple(fixed.LEVEL_CODES)


def results_pivot(
    results: DataFrame, model="model", condition="test_noise", score="test_f1_macro", digits: int = 4
) -> DataFrame:
    """Mean score per model and condition, with the clean-to-high degradation."""
    wide = results.groupBy(model).pivot(condition, list(CONDITIONS)).agg(F.avg(score))
    return wide.withColumn("degradation", F.col("clean") - F.col("high")).select(
        model, *[F.round(c, digits).alias(c) for c in (*CONDITIONS, "degradation")]
    )


def condition_average(pivoted: DataFrame, out: str = "average") -> DataFrame:
    """Mean over the conditions that are present."""
    present = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in CONDITIONS]
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in CONDITIONS])
    n = reduce(lambda a, b: a + b, present)
    return pivoted.withColumn(out, F.when(n > 0, total / n))


def seed_statistics(results: DataFrame, by: list[str], score="test_f1_macro") -> DataFrame:
    """Mean and sample deviation over seeds; a single seed has deviation 0."""
    return results.groupBy(*by).agg(
        F.avg(score).alias("mean_f1"),
        F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std_f1"),
        F.count(score).alias("n_seeds"),
    )


def baseline_delta(results: DataFrame, baseline: str, keys: list[str], model="model", score="test_f1_macro") -> DataFrame:
    """Gain over the baseline in percentage points, per remaining model."""
    means = results.groupBy(model, *keys).agg(F.avg(score).alias("score"))
    base = means.filter(F.col(model) == baseline).select(*keys, F.col("score").alias("baseline_score"))
    gains = means.filter(F.col(model) != baseline).join(base, keys)
    return gains.withColumn("delta_pp", (F.col("score") - F.col("baseline_score")) * 100.0)


def best_per_condition(results: DataFrame, model="model", condition="test_noise", score="test_f1_macro") -> DataFrame:
    """All models that share the best mean score of a condition."""
    means = results.groupBy(model, condition).agg(F.round(F.avg(score), 6).alias("score"))
    place = F.rank().over(W.partitionBy(condition).orderBy(F.desc("score")))
    return means.withColumn("place", place).filter("place = 1").drop("place")


def ablation_gain(results: DataFrame, steps: list[str], model="model", score="test_f1_macro") -> DataFrame:
    """Average score of each added component and its gain over the step before."""
    number = F
    for i, name in enumerate(steps):
        number = number.when(F.col(model) == name, i)
    means = results.withColumn("step", number).filter(F.col("step").isNotNull())
    means = means.groupBy("step", model).agg(F.avg(score).alias("avg_f1"))
    before = F.lag("avg_f1").over(W.partitionBy(F.lit(1)).orderBy("step"))
    return means.withColumn("gain_pp", (F.col("avg_f1") - before) * 100.0)


def gain_rises(deltas: DataFrame, model="model", condition="test_noise", delta="delta_pp") -> DataFrame:
    """Whether a model's gain never falls from clean to high noise."""
    before = F.lag(delta).over(W.partitionBy(model).orderBy(level_code(condition)))
    steps = deltas.withColumn("__step", F.col(delta) - before)
    return steps.groupBy(model).agg(F.every(F.coalesce(F.col("__step") >= 0, F.lit(True))).alias("rises"))


def best_epoch(log: DataFrame, by: list[str], epoch="epoch", score="val_f1") -> DataFrame:
    """Epoch with the highest validation score, the earliest on ties."""
    best = F.max_by(F.struct(epoch, score), F.struct(F.col(score), -F.col(epoch)))
    return log.groupBy(*by).agg(best.alias("__b")).select(*by, "__b.*")


def epoch_losses(log: DataFrame, by: list[str], epoch="epoch", loss="train_loss") -> DataFrame:
    """Mean step loss per epoch."""
    return log.groupBy(*by, epoch).agg(F.avg(loss).alias("mean_loss"))


def ordered_results(results: DataFrame, model="model", condition="test_noise", then: tuple[str, ...] = ()) -> DataFrame:
    """By model name, then condition name, then further columns; a missing name sorts first as ''."""
    return results.orderBy(F.coalesce(model, F.lit("")), F.coalesce(condition, F.lit("")), *then)
