"""Exact ranks, cuts and running totals without a one-task window.

Rows are put into ordered buckets (by a hash, or ranges of a sample sort); a count per bucket gives every
bucket its starting rank; the order inside a bucket is settled locally. Cuts need a local
order only in the bucket that a cut falls into, so the corpus is not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quaver.functions import fixed
from quaver.functions.draws import digest
from quaver.operators.bounded import settled

HEX_DIGITS = 4
#: Bits of Spark's row numbers below the number of the partition.
_PART_BITS = 33


def hash_key(row_id, seed: int = fixed.SEED) -> Column:
    """Sort key that orders rows at random but reproducibly."""
    return digest(seed, row_id if isinstance(row_id, Column) else F.col(row_id))


def hash_bucket(key: Column, digits: int = HEX_DIGITS) -> Column:
    """Leading hex digits: bucket order is key order."""
    return F.substring(key, 1, digits)


def _starts(bucketed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before each bucket; one small row per bucket."""
    w = W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)
    counts = bucketed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counts.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))


def rank_in_buckets(df: DataFrame, bucket: str, order: list, out: str) -> DataFrame:
    """Exact global 1-based rank; ``order`` must be unique within the table."""
    starts = F.broadcast(_starts(df.select(bucket), [bucket]).drop("__n"))  # a row per bucket
    local = F.row_number().over(W.partitionBy(bucket).orderBy(*order))
    return (
        df.withColumn("__local", local)
        .join(starts, bucket)
        .withColumn(out, (F.col("__before") + F.col("__local")).cast("bigint"))
        .drop("__local", "__before", bucket)
    )


def rank_by_hash(df: DataFrame, row_id: str, out: str = "position", seed: int = fixed.SEED) -> DataFrame:
    """Position of each row in a seeded shuffle."""
    keyed = df.withColumn("__key", hash_key(row_id, seed)).withColumn("__bucket", hash_bucket(F.col("__key")))
    return rank_in_buckets(keyed, "__bucket", ["__key", row_id], out).drop("__key")


def content_key(df: DataFrame) -> Column:
    """A digest of the whole row (but for maps): the order of rows that nothing else tells apart, whatever the partitions."""
    return F.xxhash64(*[F.col(c) for c, kind in df.dtypes if "map<" not in kind])


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """1-based positions of the rows of :func:`settled`, in the order of its partitions and within them; nothing is shuffled."""
    placed = rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", _PART_BITS))
    starts = F.broadcast(_starts(placed.select("__part"), ["__part"]).drop("__n"))  # a row per partition
    local = F.col("__at").bitwiseAND(F.lit((1 << _PART_BITS) - 1))
    return placed.join(starts, "__part").withColumn(out, F.col("__before") + local + 1).drop("__at", "__part", "__before")


def sample_sorted(df: DataFrame, order: list) -> DataFrame:
    """Rows in ``order`` over ranges of equal size, settled; only rows that are equal in all of ``order`` must share a range."""
    return settled(df.repartitionByRange(*order).sortWithinPartitions(*order))


def rank_by_ordinal(df: DataFrame, ordinal: str, out: str = "position", tie: str | None = None) -> DataFrame:
    """Position of each row by ``ordinal`` (of any orderable type), then ``tie``, then content; rows without an ordinal come last.

    A frequent ordinal, or many rows without one, are cut into ranges by what follows it. Rows alike in every
    column but maps share a range.
    """
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in (ordinal, tie) if c]
    ordered = sample_sorted(df.withColumn("__content", content_key(df)), [*keys, F.col("__content")])
    return numbered(ordered.drop("__content"), out)


def leading_rows(df: DataFrame, ordinal: str, share: float, out: str, names: tuple[str, str]) -> DataFrame:
    """Call the first int(share * N) rows by ``ordinal``, then content, ``names[0]`` and the others ``names[1]``.

    Only distinct keys are sorted, with their numbers of rows; they give the key at the cut, and every row
    is compared with it where it lies. Equal keys at the cut belong to rows alike in every column but maps:
    as many as are wanted are taken.
    """
    keyed = df.withColumn("__key", F.struct(F.col(f"`{ordinal}`").isNull().alias("last"), F.col(f"`{ordinal}`").alias("o"), content_key(df).alias("content")))
    sizes = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__w"))
    ordered = sample_sorted(sizes, [F.col("__key")]).withColumn("__part", F.spark_partition_id())
    starts = ordered.groupBy("__part").agg(F.sum("__w").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    total = starts.agg(F.sum("__n")).first()[0] or 0
    wanted = int(share * total)
    # The range that the cut falls into is the only one that is summed up row by row.
    torn = F.broadcast(starts.filter((F.col("__before") < wanted) & (F.col("__before") + F.col("__n") >= wanted)).drop("__n"))
    within = W.partitionBy("__part").orderBy("__key")
    summed = ordered.join(torn, "__part").withColumn("__upto", F.col("__before") + F.sum("__w").over(within))
    cut = summed.filter(F.col("__upto") >= wanted).orderBy("__upto").limit(1)
    edge = F.broadcast(cut.select(F.lit(0).alias("__all"), F.col("__key").alias("__cut"), (F.col("__upto") - wanted).alias("__over")))
    placed = keyed.withColumn("__all", F.lit(0)).join(edge, "__all", "left")
    at_cut = F.coalesce((F.col("__key") == F.col("__cut")) & (F.col("__over") > 0), F.lit(False))
    name = F.when(F.coalesce(F.col("__key") <= F.col("__cut"), F.lit(False)), names[0]).otherwise(names[1])
    columns = [*[f"`{c}`" for c in df.columns], out]
    whole = placed.filter(~at_cut).withColumn(out, name).select(columns)
    alike = numbered(settled(placed.filter(at_cut)), "__number")
    late = alike.groupBy().agg(F.count(F.lit(1)).alias("__n")).withColumn("__all", F.lit(0))
    taken = F.col("__number") <= F.col("__n") - F.col("__over")
    split = alike.join(F.broadcast(late), "__all").withColumn(out, F.when(taken, names[0]).otherwise(names[1])).select(columns)
    return whole.unionByName(split)


def batch_id(df: DataFrame, ordinal: str, batch_size: int, out: str = "batch", tie: str | None = None) -> DataFrame:
    """Sequential batches of ``batch_size`` rows in the order of :func:`rank_by_ordinal`."""
    ranked = rank_by_ordinal(df, ordinal, "__rank", tie)
    return ranked.withColumn(out, F.floor((F.col("__rank") - 1) / batch_size)).drop("__rank")


def seeded_shuffle(df: DataFrame, row_id: str, seed: int = fixed.SEED) -> DataFrame:
    """Whole table in reproducible random order."""
    return df.orderBy(hash_key(row_id, seed), row_id)


def hash_sample(df: DataFrame, row_id: str, n: int, seed: int = fixed.SEED) -> DataFrame:
    """Reproducible uniform sample of exactly ``n`` rows (top-n, no full sort)."""
    return df.orderBy(hash_key(row_id, seed), row_id).limit(n)


def cut_by_rank(
    df: DataFrame,
    bucket: str,
    order: list[str],
    limits: Callable[[DataFrame], DataFrame],
    names: list[str],
    group: str,
    out: str = "split",
) -> DataFrame:
    """Give every row the part that its rank within its group falls into.

    ``limits`` maps the table (group, n) to (group, limits), where ``limits`` is
    the ascending array of last ranks of all parts but the final one.
    """
    starts = _starts(df.select(group, bucket), [group, bucket])
    totals = starts.groupBy(group).agg(F.sum("__n").alias("n"))
    ends = limits(totals).select(group, "limits")
    # The bucket in which each limit falls is the last one that starts below it.
    edge = [
        F.max(F.when(F.col("__before") < F.get("limits", F.lit(k)), F.struct("__before", bucket))).alias(f"__edge{k}")
        for k in range(len(names) - 1)
    ]
    # Quotas and edges: a row per group.
    edges = F.broadcast(starts.join(F.broadcast(ends), group).groupBy(group, "limits").agg(*edge))

    placed = df.join(edges, group)
    at = [F.col(f"__edge{k}.{bucket}") for k in range(len(names) - 1)]
    on_edge = F.lit(False)
    for a in at:
        on_edge = on_edge | F.coalesce(F.col(bucket) == a, F.lit(False))

    def name(inside: Callable[[int], Column]) -> Column:
        result = F
        for k, label in enumerate(names[:-1]):
            result = result.when(F.coalesce((F.col(bucket) < at[k]) | inside(k), F.lit(False)), label)
        return result.otherwise(names[-1])

    columns = [*df.columns, out]
    whole = placed.filter(~on_edge).withColumn(out, name(lambda k: F.lit(False))).select(columns)
    local = F.row_number().over(W.partitionBy(group, bucket).orderBy(*order))
    torn = (
        placed.filter(on_edge)
        .withColumn("__local", local)
        .withColumn(
            out,
            name(
                lambda k: (F.col(bucket) == at[k])
                & (F.col(f"__edge{k}.__before") + F.col("__local") <= F.get("limits", F.lit(k)))
            ),
        )
        .select(columns)
    )
    return whole.unionByName(torn)


def running_total(df: DataFrame, group: list[str], order: str, value: str, out: str, width: int = 1 << 16) -> DataFrame:
    """Sum of ``value`` over earlier rows of the group.

    ``order`` is a dense integer rank, unique in its group; a task sorts at most
    ``width`` rows of a group.
    """
    chunked = df.withColumn("__chunk", F.floor(F.col(order) / width))
    keys = [*group, "__chunk"]
    sums = chunked.groupBy(*keys).agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*group).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0))).drop("__sum")
    local = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (
        chunked.withColumn("__part", F.coalesce(F.sum(value).over(local), F.lit(0)))
        .join(sums, keys)
        .withColumn(out, F.col("__start") + F.col("__part"))
        .drop("__chunk", "__part", "__start")
    )
