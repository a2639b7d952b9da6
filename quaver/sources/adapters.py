"""Adapters from source layouts to (text, label, source, lang_pair).

Null texts and labels are dropped explicitly.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.functions.text import list_literal_text, longer_than, strip_spaces
from quaver.operators.tables import annotator_means, score_label

log = logging.getLogger(__name__)

# Spellings of a positive label per source.
HASOC_POSITIVE = ("HOF", "1", "HATE", "OFF", "OFFENSIVE", "TRUE")
HINDI_POSITIVE = ("1", "HOF", "HATE", "OFFENSIVE", "OFF", "TRUE")
OLID_POSITIVE = ("OFF", "1", "OFFENSIVE", "HATE")
HATEVAL_POSITIVE = ("1", "True", "hate")
HATEXPLAIN_POSITIVE = ("hatespeech", "offensive", "1", "hate")
TWEETEVAL_POSITIVE = ("1", "hate")


def find_column(columns: list[str], words: tuple[str, ...], default: str | None = None) -> str | None:
    """First column whose lower-cased name contains any of the words."""
    hits = (c for c in columns if any(w in c.lower() for w in words))
    return next(hits, default)


def _column(df: DataFrame, words: tuple[str, ...], position: int) -> Column:
    return F.col(f"`{find_column(df.columns, words, df.columns[position])}`")


def _in(value: Column, accepted: tuple[str, ...]) -> Column:
    return F.when(value.cast("string").isin(*accepted), 1).otherwise(0)


def unified(df: DataFrame, text: Column, label: Column, source: str, lang_pair: str) -> DataFrame:
    out = df.select(
        text.cast("string").alias("text"),
        label.cast("int").alias("label"),
        F.lit(source).alias("source"),
        F.lit(lang_pair).alias("lang_pair"),
    )
    return out.na.drop()


def adapt_hasoc(df: DataFrame) -> DataFrame:
    text = _column(df, ("text", "tweet", "content", "post", "sentence"), 0)
    label = _column(df, ("task_1", "label", "task1", "hof", "class"), 1)
    positive = _in(strip_spaces(F.upper(label.cast("string"))), HASOC_POSITIVE)
    return unified(df, text, positive, "hasoc2021", "hi-en").filter(longer_than("text", 5))


def adapt_davidson(df: DataFrame) -> DataFrame:
    positive = F.when(F.col("class").try_cast("double").isin(0.0, 1.0), 1).otherwise(0)
    return unified(df, F.col("tweet"), positive, "davidson", "en")


def adapt_semeval(df: DataFrame) -> DataFrame:
    text = next((c for c in ("text", "tweet") if c in df.columns), None) or df.columns[1]
    return unified(df, F.col(f"`{text}`"), F.lit(0), "semeval2020", "hi-en").filter(longer_than("text", 5))


def adapt_hindi_offensive(df: DataFrame) -> DataFrame:
    text = _column(df, ("text", "tweet", "sentence", "content"), 0)
    label = _column(df, ("label", "class", "category", "hate"), 1)
    return unified(df, text, _in(F.upper(label.cast("string")), HINDI_POSITIVE), "hindi_offensive", "hi-en")


def adapt_ucb_hate(df: DataFrame, order: str | None = None) -> DataFrame:
    """Annotator rows are averaged per comment first; ``order`` tells which text is first, by default the least."""
    score = "hate_speech_score"
    if {"comment_id", score} <= set(df.columns):
        rows = df.withColumn(score, F.col(score).try_cast("double"))
        if order is None:
            order = "text"
        means = annotator_means(rows, "comment_id", "text", score, order)
        return unified(means, F.col("text"), F.col("label"), "ucb_measuring_hate", "en")
    label = score_label(score) if score in df.columns else F.lit(0)
    return unified(df, _column(df, ("text",), 0), label, "ucb_measuring_hate", "en")


def adapt_olid(df: DataFrame) -> DataFrame:
    label = _column(df, ("subtask_a", "label"), 1)
    return unified(df, _column(df, ("tweet", "text"), 0), _in(F.upper(label.cast("string")), OLID_POSITIVE), "olid", "en")


def adapt_hateval(df: DataFrame) -> DataFrame:
    label = _column(df, ("hs", "label"), 1)
    if isinstance(df.select(label).schema[0].dataType, T.BooleanType):
        label = F.when(label, "True")
    return unified(df, _column(df, ("text", "tweet"), 0), _in(label, HATEVAL_POSITIVE), "hateval2019", "en")


def adapt_hatexplain(df: DataFrame) -> DataFrame:
    text = list_literal_text("post_tokens") if "post_tokens" in df.columns else _column(df, ("text",), 0)
    label = find_column(df.columns, ("label",))
    positive = _in(F.lower(F.col(f"`{label}`").cast("string")), HATEXPLAIN_POSITIVE) if label else F.lit(0)
    return unified(df, text, positive, "hatexplain", "en")


def adapt_tweeteval_hate(df: DataFrame) -> DataFrame:
    label = _column(df, ("label",), 1)
    return unified(df, _column(df, ("text",), 0), _in(label, TWEETEVAL_POSITIVE), "tweeteval_hate", "en")


def adapt_tagged_blocks(df: DataFrame, source: str = "semeval2020") -> DataFrame:
    return unified(df, F.col("text"), F.lit(0), source, "hi-en").filter(longer_than("text", 5))


# File-name fragments in the order in which they are tried.
ROUTES: tuple[tuple[str, Callable[[DataFrame], DataFrame]], ...] = (
    ("hasoc", adapt_hasoc),
    ("davidson", adapt_davidson),
    ("semeval", adapt_semeval),
    ("sentimix", adapt_semeval),
    ("hindi_offensive", adapt_hindi_offensive),
    ("hatexplain", adapt_hatexplain),
    ("tweeteval", adapt_tweeteval_hate),
    ("ucb_measuring", adapt_ucb_hate),
    ("olid", adapt_olid),
    ("hateval", adapt_hateval),
)


def adapter_for(file_name: str) -> Callable[[DataFrame], DataFrame] | None:
    return next((adapt for fragment, adapt in ROUTES if fragment in file_name), None)


def adapt_all(tables: dict[str, DataFrame]) -> DataFrame | None:
    """Route tables by file name, tag each with its priority and stack them.

    Unknown names are ignored; an adapter that fails is logged and skipped. ``ordinal`` orders the rows of
    a table by their content, so that "first" means the same however files are read.
    """
    out = None
    for priority, name in enumerate(sorted(tables)):
        adapt = adapter_for(name)
        if adapt is None:
            continue
        try:
            part = adapt(tables[name])
        except Exception as problem:  # a table without the expected columns
            log.warning("could not adapt %s: %s", name, problem)
            continue
        content = F.xxhash64("text", "label", "source", "lang_pair")
        part = part.withColumn("source_priority", F.lit(priority)).withColumn("ordinal", content)
        out = part if out is None else out.unionByName(part)
    return out
