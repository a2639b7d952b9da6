"""Windows that occur more than once: the Spark side shared by byte and word windows.

A document is cut into runs of consecutive windows that share one anchor, where the anchor is a function of
a window's content alone. Equal windows have equal anchors, so only runs of one anchor have to be compared,
and equal runs count as one class. ``runs`` are rows (anchor, run, doc_id, start, size): two fingerprints, and
the first window and the number of windows of the run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import drop, release, stored

RUNS = "anchor BIGINT, run BIGINT, doc_id BIGINT, start BIGINT, size BIGINT"


def shared_runs(runs: DataFrame) -> DataFrame:
    """The runs whose anchor occurs at least twice, as a written table.

    Anchors are counted first, so that the full rows move once and most are dropped on arrival.
    """
    twice = stored(runs.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    found = stored(runs.join(twice, "anchor").select("anchor", "run", "doc_id", "start", "size"), "runs")
    drop(twice)
    release(runs.sparkSession)
    return found


def classes(runs: DataFrame) -> DataFrame:
    """Distinct runs: ``anchor``, ``run``, ``size``, their first place and how often they occur; ``variants`` of the anchor."""
    each = stored(
        runs.groupBy("anchor", "run", "size")
        .agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n"))
        .select("anchor", "run", "size", F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"), "n"),
        "classes",
    )
    variants = stored(each.groupBy("anchor").agg(F.count("*").alias("variants")), "variants")
    found = stored(each.join(variants, "anchor"), "classes")
    drop(each)
    drop(variants)
    release(runs.sparkSession)
    return found


def with_texts(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``rows``: the documents that ``rows`` (by ``doc_id``) name, each with its own rows.

    A document has at most as many rows as windows.
    """
    own = [F.col(c) for c in rows.columns if c != "doc_id"]
    grouped = stored(rows.groupBy("doc_id").agg(F.collect_list(F.struct(*own)).alias("rows")), "rows-by-document")
    joined = docs.join(grouped.hint("shuffle_hash"), "doc_id")
    joined.stored_at = grouped.stored_at  # for ``drop``, once the join is written
    return joined
