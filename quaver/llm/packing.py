"""Best-fit packing into bins of several permitted sizes.

Texts longer than the largest size are cut into pieces; nothing is dropped. Pieces are dealt by a hash
into groups of bounded size, and each group is packed by itself: longest first, into the open bin
with the least room that fits. Where none fits, a bin of the size that is expected to cost least per
token is opened; in the end each bin shrinks to the smallest size that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096)
#: Rows of a group on average. The room a group leaves unused is a few bins, so larger groups gain little.
GROUP_ROWS = 8192
#: Pieces of rows alike that one task numbers at a time.
STRETCH = 1 << 16


def bin_cost(capacity: float, quadratic: float = 16384.0) -> float:
    """Cost of a sequence: linear work and attention, which are equal at ``quadratic`` tokens."""
    return capacity + capacity * capacity / quadratic


def word_length(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text and one end token; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+")).cast("long") + 1


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lengths in descending order, none above the largest capacity: bin, offset, and size of each bin."""
    sizes = sorted(capacities)
    n = len(lengths)
    left = np.concatenate([np.cumsum(lengths[::-1])[::-1], [0]])  # tokens from each piece on
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room: list[tuple[int, int]] = []  # (free tokens, bin), ascending
    filled: list[int] = []
    for i, length in enumerate(lengths.tolist()):
        at = bisect_left(room, (length, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            # What is left to come bounds how far a size can be filled.
            free = min((c for c in sizes if c >= length), key=lambda c: (bin_cost(c) / min(c, left[i]), c))
            b = len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += length
        if free > length:
            insort(room, (free - length, b))
    return bins, offsets, np.array([sizes[bisect_left(sizes, f)] for f in filled], np.int64)


def best_fit(items: DataFrame, key: str = "doc_id", length: str = "n_tokens", capacities: tuple[int, ...] = CAPACITIES, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: ``key``, ``piece``, ``piece_start``, ``piece_tokens``, ``bin_id``, ``bin_offset``, ``bin_size``.

    Null lengths and lengths below 1 take no room: their rows come back with bin fields null. Repeated rows are
    packed as often as they come; an empty table gives no rows. Only ``key`` and ``length`` are read. Pieces of one key, repeated rows
    and null keys are dealt like all others: rows alike are counted first, and each piece of each copy has a number that
    the hash takes in. Group and bin follow from the rows' contents, so the packing doesn't depend on partitions; ties
    between pieces of one length go by key and piece.
    """
    largest = max(capacities)
    size = F.col("__length")
    # Pieces of a row; a row without room is one.
    cuts = F.coalesce(F.greatest(F.floor((size + largest - 1) / largest), F.lit(1)), F.lit(1)).cast("long")
    rows = items.select(F.col(key).alias("__key"), F.col(length).cast("long").alias("__length"))
    total = rows.agg(F.sum(F.when(size > 0, cuts))).first()[0] or 0
    groups = max(1, -(-total // group_rows))
    alike = rows.groupBy("__key", "__length").agg(F.count(F.lit(1)).alias("__copies")).withColumn("__cuts", cuts)
    # A long text or many copies are numbered by many tasks, a stretch of numbers each.
    last = F.col("__cuts") * F.col("__copies") - 1
    stretches = alike.withColumn("__stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / STRETCH).cast("long"))))
    dealt = stretches.repartition("__key", "__length", "__stretch")
    first = F.col("__stretch") * STRETCH
    units = dealt.withColumn("__unit", F.explode(F.sequence(first, F.least(first + STRETCH - 1, last))))
    pieces = units.withColumn("piece", F.col("__unit") % F.col("__cuts")).select(
        F.col("__key").alias("item"),
        "piece",
        (F.col("piece") * largest).alias("start"),
        F.when(size.isNotNull(), F.least(F.lit(largest).cast("long"), size - F.col("piece") * largest)).alias("tokens"),
        F.pmod(F.xxhash64("__key", "__length", "__unit"), F.lit(groups)).alias("grp"),
    )
    kind = items.schema[key].dataType.simpleString()
    fields = f"`{key}` {kind}, piece BIGINT, piece_start BIGINT, piece_tokens BIGINT, bin_id BIGINT, bin_offset BIGINT, bin_size BIGINT"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        group = int(part["grp"].iloc[0])
        part = part.sort_values(["tokens", "item", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets, sizes = pack(part["tokens"].to_numpy(np.int64), capacities)
        return pd.DataFrame(
            {key: part["item"].array, "piece": part["piece"].array, "piece_start": part["start"].array, "piece_tokens": part["tokens"].array}
            | {"bin_id": bins + (group << 32), "bin_offset": offsets, "bin_size": sizes[bins]}
        )

    packed = pieces.where("tokens > 0").groupBy("grp").applyInPandas(run, fields)
    none = [F.lit(None).cast("bigint").alias(c) for c in ("bin_id", "bin_offset", "bin_size")]
    empty = pieces.where("tokens IS NULL OR tokens <= 0").select(F.col("item").alias(key), "piece", F.col("start").alias("piece_start"), F.col("tokens").alias("piece_tokens"), *none)
    return packed.unionByName(empty)
