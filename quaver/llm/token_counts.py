"""Token counts through a digest cache.

Contents are named by the digest of their normalised text, tokenizers by the digest of their file.
Counts that are stored under both are joined; only distinct contents without one are encoded, and
their counts are appended to the cache, a plain Parquet folder partitioned by tokenizer digest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import text_groups

#: Words whose counts a worker keeps; beyond that it starts afresh.
MEMO_WORDS = 400_000
CACHE = "digest BINARY, tokenizer STRING, n_tokens BIGINT"


def content_digest(text: Column) -> Column:
    """Digest of a text as it is encoded: null counts as empty, nothing else is changed.

    Any change of white space or case could change a count under some tokenizer, so the
    normal form is the text itself.
    """
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's file: another file, another version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=4)
def _counter(path: str):
    """A function from texts to counts.

    Where a tokenizer file drops white space and splits on it before merging, a text's count is the
    sum of its words' counts, and a worker counts each word once. Other files encode whole texts.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]

    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def encode(texts):
        return [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    if not _splits_on_space(file):
        return encode
    special = tuple(t["content"].lower() for t in file.get("added_tokens", []))
    memo: dict[str, int] = {"": 0}

    def by_word(texts):
        if len(memo) > MEMO_WORDS:
            memo.clear()
            memo[""] = 0
        split = [_pieces(x, special) for x in texts]
        new = list({w for ws in split for w in ws if w not in memo})
        memo.update(zip(new, encode(new), strict=True))
        return [sum(map(memo.__getitem__, ws)) for ws in split]

    return by_word


#: Below these letters no combining mark occurs, so case and composition don't interact.
_HIGH = re.compile("[\u0300-\U0010ffff]")
_MARKS = re.compile(r"(?<=[a-z\u00df-\u00f6])([^\w\s]+)(?!\S)")


def _pieces(text: str, special: tuple[str, ...] = ()) -> list[str]:
    """Parts between white space (only what every engine counts as such), in few spellings.

    The file lower-cases anyway, and a run of marks between a letter and white space is a part of
    its own. Special strings are looked for before that, so texts that hold one stay as they are.
    """
    if not _HIGH.search(text):
        low = text.lower()
        if not any(x in low for x in special):
            text = _MARKS.sub(r" \1", low)
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _splits_on_space(file: dict) -> bool:
    """True if white space is removed by an inverted split whose pattern can't match it."""
    steps = file.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    first = steps[0] if steps else {}
    parts = first.get("pattern", {}).get("Regex", "").split("|")
    safe = all(p in ("[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+") or p.startswith("'") for p in parts)
    plain = not any(set(t["content"]) & set(" \t\r\n") or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file.get("added_tokens", []))
    lower = {"type": "Lowercase"} in (file.get("normalizer") or {}).get("normalizers", [])
    return lower and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) and safe and plain


def encode_counts(contents: DataFrame, path: str) -> DataFrame:
    """``digest``, ``n_tokens`` of rows (digest, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            texts, counts = batch.column(1), []
            for first, last, _, _ in text_groups(batch, "text"):
                counts += count([x or "" for x in texts.slice(first, last - first).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return contents.select("digest", "text").mapInArrow(run, "digest BINARY, n_tokens BIGINT")


def token_counts(docs: DataFrame, path: str, cache: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_bytes`` and ``n_tokens``; null texts count as empty.

    ``cache`` is a folder on storage that all executors share; it need not exist. Of the rows with a
    missing content the one with the smallest ``key`` is encoded, so only digests are grouped and only
    missing texts move; with few misses none do. Rows, repeated ones and null keys too, and other
    columns stay as they are; columns of ``docs`` named ``n_bytes`` or ``n_tokens`` are replaced.
    """
    spark, version = docs.sparkSession, tokenizer_digest(path)
    digest = content_digest(F.col(text))
    known = _cached(spark, cache, version)
    missing = (
        docs.select(digest.alias("__digest"), F.col(key).alias("__key"))
        .groupBy("__digest")
        .agg(F.min("__key").alias("__key"))
        .join(known.select(F.col("digest").alias("__digest")), "__digest", "left_anti")
        .alias("m")
    )
    here = docs.select(F.col(key).alias("key"), digest.alias("digest"), F.col(text).alias("text")).alias("d")
    chosen = F.col("d.key").eqNullSafe(F.col("m.__key")) & (F.col("d.digest") == F.col("m.__digest"))
    new = encode_counts(here.join(missing, chosen, "left_semi"), path).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    new.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = _cached(spark, cache, version).select(F.col("digest").alias("__digest"), F.col("n_tokens").alias("__n"))
    rest = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long")
    rows = docs.select(*rest, digest.alias("__digest"), size.alias("n_bytes"))
    return rows.join(counts, "__digest", "left").select(*rest, "n_bytes", F.col("__n").alias("n_tokens"))


def _cached(spark, cache: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer, one row per digest (runs that overlapped may have added the same)."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(cache)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], CACHE)
    rows = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
