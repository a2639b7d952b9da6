"""Connected components of an edge table: each vertex's smallest reachable id."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import stored

#: Edges that a task contracts at once.
BLOCK = 1 << 16


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of edges as stars around the smallest id of each of the block's components."""
    parent: dict[int, int] = {}
    held = 0

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> pa.RecordBatch:
        rows = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
            held += 1
            if held == BLOCK:
                yield stars()
                parent.clear()
                held = 0
    yield stars()


def contracted(edges: DataFrame) -> DataFrame:
    """Fewer edges (``a`` > ``b``) with the same components: every task contracts blocks of its edges, without a shuffle."""
    kept = stored(edges.select("a", "b").where("a <> b"), "edges")
    parts = max(1, kept.count() // BLOCK)
    return stored(kept.coalesce(parts).mapInArrow(_contracted, "a BIGINT, b BIGINT"), "edges")


def some_components(edges: DataFrame) -> DataFrame:
    """``id``, ``component_id``: an id that is surely reachable, for some of the ids. Ids with different ones may be linked all the same."""
    return contracted(edges).groupBy("a").agg(F.min("b").alias("component_id")).withColumnRenamed("a", "id")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``id``, ``component_id`` for every id of the links in ``edges`` (``a``, ``b``).

    Edges are contracted in blocks first. Then large-star and small-star steps alternate (each a group-by
    with a minimum and a join that Spark can split, as both of its sides are written tables), so that long chains
    and hubs end in few rounds. Self-links and repeated links do no harm; an empty table gives none.
    """
    edges = contracted(edges)
    before = _mark(edges)
    for _ in range(most_rounds):
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low")
        large = both.join(low, "a").where("b > a AND b <> m")
        large = stored(large.select(F.col("b").alias("a"), F.col("m").alias("b")), "edges")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
        edges = stored(large.join(low, "a").select(ends.alias("e")).select("e.a", "e.b").where("a <> b").distinct(), "edges")
        now = _mark(edges)
        if now == before:
            stars = edges.groupBy("a").agg(F.min("b").alias("component_id")).select(F.col("a").alias("id"), "component_id")
            return stars.unionByName(stars.select(F.col("component_id").alias("id"), "component_id").distinct())
        before = now
    raise RuntimeError("components did not settle")


def _mark(edges: DataFrame) -> tuple:
    """Number and sum of digests of the edges: equal only for the same set."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
