"""Classification metrics and agreement measures.

Everything starts from one confusion count per group, the only pass over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.functions import fixed
from quaver.functions.draws import digest
from quaver.operators.bounded import reuse
from quaver.operators.ordering import batch_id, rank_by_ordinal, running_total


def confusion(df: DataFrame, label="label", prediction="prediction", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), label, prediction).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, classes: list, label="label", prediction="prediction") -> DataFrame:
    """Confusion counts with one column per predicted class."""
    wide = confusion(df, label, prediction).groupBy(label).pivot(prediction, classes).agg(F.first("n"))
    return wide.select(label, *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(f"predicted_{c}") for c in classes])


def accuracy(df: DataFrame, label="label", prediction="prediction", by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def class_scores(df: DataFrame, label="label", prediction="prediction", by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as label or prediction."""
    by = by or []
    cells = confusion(df, label, prediction, by)
    right = F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)
    none = F.lit(0).cast("bigint")
    parts = F.array(
        F.struct(F.col(label).alias("class"), right.alias("tp"), F.col("n").alias("support"), none.alias("predicted")),
        F.struct(F.col(prediction).alias("class"), none.alias("tp"), none.alias("support"), F.col("n").alias("predicted")),
    )
    sums = (
        cells.select(*by, F.inline(parts))
        .groupBy(*by, "class")
        .agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    )
    p, r = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    return sums.select(
        *by,
        "class",
        p.alias("precision"),
        r.alias("recall"),
        _ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "tp",
    )


def f1_summary(df: DataFrame, label="label", prediction="prediction", by: list[str] | None = None) -> DataFrame:
    """Macro, weighted and positive-class F1, and accuracy, per group."""
    by = by or []
    total = F.sum("support")
    return (
        class_scores(df, label, prediction, by)
        .groupBy(*by)
        .agg(
            F.avg("f1").alias("macro_f1"),
            _ratio(F.sum(F.col("f1") * F.col("support")), total).alias("weighted_f1"),
            F.max(F.when(F.col("class") == 1, F.col("f1"))).alias("positive_f1"),
            _ratio(F.sum("tp").cast("double"), total).alias("accuracy"),
            total.alias("support"),
        )
    )


def class_report(df: DataFrame, label="label", prediction="prediction") -> DataFrame:
    """Per-class rows followed by accuracy, macro average and weighted average."""
    scores = class_scores(df, label, prediction)
    total = F.sum("support")
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / total
    lines = [("macro avg", F.avg), ("weighted avg", weighted)]
    summary = scores.agg(
        F.array(
            F.struct(
                F.lit("accuracy").alias("row"),
                F.lit(None).cast("double").alias("precision"),
                F.lit(None).cast("double").alias("recall"),
                (F.sum("tp") / total).alias("f1"),
                total.alias("support"),
            ),
            *[
                F.struct(
                    F.lit(name).alias("row"),
                    fn("precision").alias("precision"),
                    fn("recall").alias("recall"),
                    fn("f1").alias("f1"),
                    total.alias("support"),
                )
                for name, fn in lines
            ],
        ).alias("__rows")
    ).select(F.inline("__rows"))
    per_class = scores.select(F.col("class").cast("string").alias("row"), "precision", "recall", "f1", "support")
    return per_class.unionByName(summary)


def batch_averaged_f1(df: DataFrame, ordinal: str, batch_size: int = 32, label="label", prediction="prediction") -> DataFrame:
    """Mean over consecutive batches of the batch's weighted F1 and accuracy."""
    batches = batch_id(df.select(ordinal, label, prediction), ordinal, batch_size, "batch")
    return f1_summary(batches, label, prediction, ["batch"]).agg(
        F.count(F.lit(1)).alias("batches"),
        F.avg("weighted_f1").alias("batch_f1"),
        F.avg("accuracy").alias("batch_accuracy"),
    )


def majority_vote(predictions: DataFrame, row_id: str, prediction="prediction") -> DataFrame:
    """Most frequent class per row over a long prediction table; ties to the smaller class."""
    votes = predictions.groupBy(row_id, prediction).agg(F.count(F.lit(1)).alias("votes"))
    best = F.max_by(F.struct(prediction, "votes"), F.struct("votes", -F.col(prediction)))
    return votes.groupBy(row_id).agg(best.alias("__b")).select(row_id, "__b.*")


def disagreements(
    predictions: DataFrame, row_id: str, first: str, second: str, n: int = 50, seed: int = fixed.SEED
) -> DataFrame:
    """Reproducible sample of rows on which two models differ."""
    one = F.max(F.when(F.col("model") == first, F.col("prediction")))
    two = F.max(F.when(F.col("model") == second, F.col("prediction")))
    sides = (
        predictions.filter(F.col("model").isin(first, second))
        .groupBy(row_id)
        .agg(one.alias("first_prediction"), two.alias("second_prediction"))
    )
    differing = sides.filter(F.col("first_prediction") != F.col("second_prediction"))
    return differing.orderBy(digest(seed, F.col(row_id)), row_id).limit(n)


def align_distributions(train: DataFrame, test: DataFrame, key: str, value: str) -> DataFrame:
    """Test frequencies on the training keys; missing ones are 0."""
    left = train.select(key, F.col(value).alias("train_value"))
    right = test.select(key, F.col(value).alias("test_value"))
    return left.join(right, key, "left").withColumn("test_value", F.coalesce("test_value", F.lit(0)))


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Frequency of each category, most useful after an explode."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("pearson"))


def _cells(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct value pairs and how many rows hold each."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return reuse(known.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("w")))


def average_rank(cells: DataFrame, column: str, weight: str, out: str) -> DataFrame:
    """(value, rank) with ties sharing their mean rank.

    A value held by many rows is one row here, with its weight.
    """
    sizes = cells.groupBy(column).agg(F.sum(weight).alias("__n"))
    ranked = rank_by_ordinal(sizes, column, "__r")
    summed = running_total(ranked, [], "__r", "__n", "__before")
    return summed.select(column, (F.col("__before") + (F.col("__n") + 1) / 2.0).alias(out))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks."""
    cells = _cells(df, x, y)
    ranked = cells.join(average_rank(cells, "x", "w", "rx"), "x").join(average_rank(cells, "y", "w", "ry"), "y")
    # Average ranks have the mean (n + 1) / 2 on both sides.
    middle = (cells.agg(F.sum("w")).first()[0] or 0) / 2.0 + 0.5
    a, b = F.col("rx") - middle, F.col("ry") - middle
    both = F.sum(F.col("w") * a * b)
    return ranked.agg((both / F.sqrt(F.sum(F.col("w") * a * a) * F.sum(F.col("w") * b * b))).alias("spearman"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall's tau-b without forming pairs.

    Two rows are discordant when y falls while x rises. Writing y's rank in
    binary, such a pair shares a prefix and then differs in one bit, so for each
    bit the pairs are running counts over x within the prefix.
    """
    cells = _cells(df, x, y)
    xs = rank_by_ordinal(cells.groupBy("x").agg(F.sum("w").alias("wx")), "x", "xr")
    ys = rank_by_ordinal(cells.groupBy("y").agg(F.sum("w").alias("wy")), "y", "yr")
    bits = max(ys.agg(F.max("yr")).first()[0] or 0, 1).bit_length()
    ranked = cells.join(xs.select("x", "xr"), "x").join(ys.select("y", "yr"), "y")
    one = F.expr("yr >> bit & 1") == 1
    levels = (
        ranked.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits))))
        .withColumn("prefix", F.expr("yr >> (bit + 1)"))
        .groupBy("bit", "prefix", "xr")
        .agg(F.sum(F.when(one, F.col("w")).otherwise(0)).alias("ones"), F.sum(F.when(one, 0).otherwise(F.col("w"))).alias("zeros"))
    )
    below = running_total(levels, ["bit", "prefix"], "xr", "ones", "earlier")
    two = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2.0
    sums = (
        below.agg(F.sum(F.col("earlier").cast("double") * F.col("zeros")).alias("v"))
        .select(F.lit("discordant").alias("k"), "v")
        .unionByName(xs.agg(F.sum(two("wx")).alias("v")).select(F.lit("tie_x").alias("k"), "v"))
        .unionByName(ys.agg(F.sum(two("wy")).alias("v")).select(F.lit("tie_y").alias("k"), "v"))
        .unionByName(cells.agg(F.sum(two("w")).alias("v")).select(F.lit("tie_xy").alias("k"), "v"))
        .unionByName(
            cells.agg(F.sum("w").alias("w")).select(F.lit("all").alias("k"), two("w").alias("v"))
        )
    )
    part = lambda name: F.max(F.when(F.col("k") == name, F.col("v")))
    every, tie_x, tie_y, tie_xy, bad = (part(n) for n in ("all", "tie_x", "tie_y", "tie_xy", "discordant"))
    good = every - tie_x - tie_y + tie_xy - bad
    scale = F.sqrt((every - tie_x) * (every - tie_y))
    return sums.agg(F.when(scale > 0, (good - bad) / scale).alias("kendall"))
