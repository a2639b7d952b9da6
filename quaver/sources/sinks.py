"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_splits(df: DataFrame, path: str, keys=("split", "noise_level"), file_format: str = "parquet") -> None:
    """Rows partitioned by split and level, so that a condition reads its folders only."""
    writer = df.write.mode("overwrite").partitionBy(*keys)
    if file_format == "csv":
        writer.options(header=True, quote='"', escape='"').csv(path)
    else:
        writer.format(file_format).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def write_results(results: DataFrame, path: str, run: str | None = None, keys=("model", "seed", "condition", "train_noise", "test_noise")) -> None:
    """One JSON record per result row; a run replaces what it wrote before and leaves others alone.

    A named run has a folder of its own. Without a name, rows belong to runs by those ``keys`` that ``results`` has.
    """
    if run is not None:
        results.write.mode("overwrite").json(f"{path}/{run}")
        return
    own = F.sha2(F.to_json(F.struct(F.lit(0).alias("run"), *[k for k in keys if k in results.columns])), 256)
    writer = results.withColumn("result_run", F.substring(own, 1, 16)).write.mode("overwrite").partitionBy("result_run")
    writer.option("partitionOverwriteMode", "dynamic").json(path)


def write_statistics(wide: DataFrame, path: str) -> None:
    """One row of metrics as (metric, value) lines."""
    columns = [F.col(c).cast("double").alias(c) for c in wide.columns]
    write_csv(wide.select(*columns).unpivot([], wide.columns, "metric", "value"), path)


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").parquet(path)
