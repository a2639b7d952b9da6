"""Conversation threads: flattening, contexts and hierarchical rows.

A nested thread is one row; everything about it is computed inside the row and
exploded once, without a shuffle. Flat turn tables use windows per comment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.functions import fixed
from quaver.functions.text import strip_spaces
from quaver.operators.tables import binary_label

_reply = T.StructType([T.StructField("tweet_id", T.StringType()), T.StructField("tweet", T.StringType())])
_comment = T.StructType([*_reply.fields, T.StructField("replies", T.ArrayType(_reply))])
THREAD_SCHEMA = T.StructType([*_reply.fields, T.StructField("comments", T.ArrayType(_comment))])
LABEL_SCHEMA = T.MapType(T.StringType(), T.StringType())

SEP = fixed.CONTEXT_SEPARATOR


def _or_empty(array: Column) -> Column:
    """A missing list reads as an empty one."""
    return F.filter(array, lambda x: x.isNotNull())


def _each(node_of_root, node_of_comment, node_of_reply) -> Column:
    """Array with one entry per root, comment and reply, in thread order."""

    def comment_entries(c: Column) -> Column:
        replies = F.coalesce(
            F.transform(_or_empty(c["replies"]), lambda r, i: node_of_reply(c, r, i)),
            F.array(),
        )
        return F.concat(F.array(node_of_comment(c)), replies)

    below = F.flatten(F.transform(_or_empty(F.col("comments")), comment_entries))
    return F.concat(F.array(node_of_root), F.coalesce(below, F.array()))


def _label(labels: Column, tweet_id: Column) -> Column:
    return F.coalesce(F.element_at(labels, tweet_id), F.lit("NONE"))


def flatten_threads(threads: DataFrame) -> DataFrame:
    """All tweets of nested threads, trimmed, longer than 3 characters, labelled.

    Needs tweet_id, tweet, comments and a label map ``labels``; other columns
    are carried along.
    """
    kept = [c for c in threads.columns if c not in ("tweet_id", "tweet", "comments", "labels")]
    node = lambda n: F.struct(
        F.coalesce(n["tweet_id"], F.lit("")).alias("tweet_id"), n["tweet"].alias("tweet")
    )
    root = F.struct(F.coalesce("tweet_id", F.lit("")).alias("tweet_id"), F.col("tweet"))
    nodes = _each(root, node, lambda c, r, i: node(r))
    flat = threads.select(*kept, "labels", F.inline(nodes))
    return (
        flat.withColumn("text", strip_spaces("tweet"))
        .filter(F.length("text") > 3)
        .withColumn("label_str", _label(F.col("labels"), F.col("tweet_id")))
        .select("tweet_id", "text", binary_label("label_str").alias("label"), "label_str", *kept)
    )


def _previous(replies: Column, i: Column) -> Column:
    """Separator-led concatenation of the first ``i`` replies."""
    earlier = F.transform(F.slice(replies, F.lit(1), i), lambda r: F.concat(F.lit(SEP), r["tweet"]))
    return F.array_join(earlier, "")


def context_rows(threads: DataFrame) -> DataFrame:
    """Root with itself as context; comments with the root; replies with the root,
    their comment and all earlier replies."""
    kept = [c for c in threads.columns if c not in ("tweet_id", "tweet", "comments", "labels")]
    row = lambda n, context: F.struct(
        n["tweet_id"].alias("tweet_id"), context.alias("context"), n["tweet"].alias("text")
    )
    root = F.struct(F.col("tweet_id"), F.col("tweet").alias("context"), F.col("tweet").alias("text"))
    rows = _each(
        root,
        lambda c: row(c, F.col("tweet")),
        lambda c, r, i: row(r, F.concat(F.col("tweet"), c["tweet"], _previous(_or_empty(c["replies"]), i))),
    )
    flat = threads.select(*kept, "labels", F.inline(rows))
    return flat.withColumn("label", _label(F.col("labels"), F.col("tweet_id"))).drop("labels")


def hierarchical_rows(threads: DataFrame, running: bool = False) -> DataFrame:
    """(post, context, text, label) rows; empty string marks an absent part.

    ``running`` adds the earlier replies to a reply's context; the published
    builder leaves them out.
    """
    kept = [c for c in threads.columns if c not in ("tweet_id", "tweet", "comments", "labels")]
    nothing = F.lit("")
    row = lambda tid, context, text: F.struct(
        tid.alias("tweet_id"), F.col("tweet").alias("post"), context.alias("context"), text.alias("text")
    )

    def reply(c: Column, r: Column, i: Column) -> Column:
        context = F.concat(c["tweet"], _previous(_or_empty(c["replies"]), i)) if running else c["tweet"]
        return row(r["tweet_id"], context, r["tweet"])

    rows = _each(
        row(F.col("tweet_id"), nothing, nothing), lambda c: row(c["tweet_id"], c["tweet"], nothing), reply
    )
    flat = threads.select(*kept, "labels", F.inline(rows))
    label = binary_label(_label(F.col("labels"), F.col("tweet_id")))
    return flat.withColumn("label", label).drop("labels", "tweet_id")


def split_context(context="context", spaced: bool = True) -> Column:
    """Context parts as an array."""
    return F.split(F.col(context), r" \[SEP\] " if spaced else r"\[SEP\]")


def join_labels(tweets: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Attach labels by key; tweets without one are NONE."""
    return tweets.join(labels, keys, "left").withColumn("label_str", F.coalesce("label_str", F.lit("NONE")))


def running_context(turns: DataFrame, thread: list[str], order: str, text: str, out: str = "previous") -> DataFrame:
    """Earlier texts of the same comment, each led by the separator.

    A row's context holds all earlier rows, so the output of one comment grows
    with the square of its length, as the operator demands.
    """
    earlier = W.partitionBy(*thread).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    parts = F.collect_list(F.concat(F.lit(SEP), F.col(text))).over(earlier)
    return turns.withColumn(out, F.array_join(parts, ""))


def place_turns(turns: DataFrame, conversation: str, turn: str, replies: int = 2) -> DataFrame:
    """Read a flat conversation as a thread: turn 0 is the root, then each comment
    is followed by ``replies`` replies."""
    after = F.col(turn) - 1
    return (
        turns.withColumn("comment_no", F.when(F.col(turn) == 0, 0).otherwise(F.floor(after / (replies + 1)) + 1))
        .withColumn("reply_no", F.when(F.col(turn) == 0, 0).otherwise(after % (replies + 1)))
        .withColumn(
            "kind",
            F.when(F.col(turn) == 0, "root").when(F.col("reply_no") == 0, "comment").otherwise("reply"),
        )
    )


def flat_context_rows(placed: DataFrame, conversation: str, turn: str, text: str = "text") -> DataFrame:
    """Context of every turn of a placed flat conversation table.

    Replies look back within their comment only; the root comes from a join
    with one row per conversation. A root or comment that is missing counts as empty.
    """
    root = placed.filter(F.col("kind") == "root").select(conversation, F.col(text).alias("__root"))
    comment = placed.filter(F.col("kind") == "comment").select(
        conversation, "comment_no", F.col(text).alias("__comment")
    )
    replies = running_context(
        placed.filter(F.col("kind") == "reply"), [conversation, "comment_no"], turn, text, "__previous"
    )
    top = placed.filter(F.col("kind") != "reply").withColumn("__previous", F.lit("")).withColumn("__comment", F.lit(""))
    low = replies.join(comment, [conversation, "comment_no"], "left")
    there = lambda c: F.coalesce(c, F.lit(""))
    return (
        top.unionByName(low)
        .join(root, conversation, "left")
        .withColumn("context", F.concat(there("__root"), there("__comment"), "__previous"))
        .drop("__root", "__comment", "__previous")
    )


def flat_hierarchical_rows(placed: DataFrame, conversation: str, turn: str, text: str = "text", running: bool = False) -> DataFrame:
    """(post, context, text) of every turn of a placed flat conversation table."""
    with_parts = placed
    root = placed.filter(F.col("kind") == "root").select(conversation, F.col(text).alias("post"))
    comment = placed.filter(F.col("kind") == "comment").select(
        conversation, "comment_no", F.col(text).alias("__comment")
    )
    if running:
        replies = running_context(
            placed.filter(F.col("kind") == "reply"), [conversation, "comment_no"], turn, text, "__previous"
        )
        with_parts = placed.filter(F.col("kind") != "reply").withColumn("__previous", F.lit("")).unionByName(replies)
    else:
        with_parts = placed.withColumn("__previous", F.lit(""))
    joined = with_parts.join(root, conversation, "left").join(comment, [conversation, "comment_no"], "left")
    is_reply = F.col("kind") == "reply"
    return (
        joined.withColumn("post", F.coalesce("post", F.lit("")))
        .withColumn(
            "context",
            F.when(F.col("kind") == "root", "").otherwise(F.concat(F.coalesce("__comment", F.lit("")), F.col("__previous"))),
        )
        .withColumn("text", F.when(is_reply, F.col(text)).otherwise(""))
        .drop("__comment", "__previous")
    )


def topic_report(rows: DataFrame, by: str = "topic") -> DataFrame:
    """Tweets, positives and positive share per topic or thread."""
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("label") == 1).alias("positive"),
        F.avg((F.col("label") == 1).cast("double")).alias("positive_ratio"),
    )
