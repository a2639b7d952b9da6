"""CSV records that hold newlines, read by many tasks per file.

A file is cut into byte ranges wherever the scan likes. Whether a range begins inside a quoted field follows
from the ranges before it: the first pass gives every range's end state for both possible starts (a row per
range), a window over those rows composes them. The second pass then cuts each range into records by itself;
only records that reach over the end of a range are put together from their fragments.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of records that a task holds before it hands them on.
BATCH_BYTES = 1 << 22
_TAIL, _MIDDLE, _HEAD = 0, 1, 2


class LineStates:
    """Whether a line ends inside a quoted field, given how it begins.

    A quote opens a field only at its start and is doubled within it; what follows a closing quote
    belongs to the field up to the next separator.
    """

    def __init__(self, sep: str):
        mark = re.escape(sep.encode())
        quoted = rb'[^"]*+(?:""[^"]*+)*+"[^%b]*+' % mark
        field = rb'(?:"%b|[^"%b][^%b]*+)?+' % (quoted, mark, mark)
        self._from_outside = re.compile(rb"%b(?:%b%b)*+" % (field, mark, field)).fullmatch
        self._from_inside = re.compile(rb"%b(?:%b%b)*+" % (quoted, mark, field)).fullmatch

    def after(self, line: bytes, inside: int) -> int:
        if b'"' not in line:
            return inside
        whole = self._from_inside if inside else self._from_outside
        return 0 if whole(line) else 1


def _range_ends(sep: str):
    """Per range: the state after it if it begins outside quotes, and if it begins inside; whether any line has a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, seen, now = LineStates(sep), [], None
        for batch in batches:
            for line, key, at, filled in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (key, at) != now:
                    now = (key, at)
                    seen.append([key, at, 0, 1, False])
                seen[-1][4] |= filled
                if line is not None:
                    end = seen[-1]
                    same = end[2] == end[3]
                    end[2] = states.after(line, end[2])
                    end[3] = end[2] if same else states.after(line, end[3])
        columns = list(zip(*seen, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "at", "from_outside", "from_inside", "filled"])

    return run


def _starts(ends: DataFrame) -> DataFrame:
    """(key, at, inside, next_inside, header): the state at the start of each range and of the one after it, and where the header is.

    A range sets the state, swaps it or keeps it. So it is what the last setting range left, swapped as often
    as ranges since then swap it.
    """
    file = W.partitionBy("key").orderBy("at")
    before = file.rowsBetween(W.unboundedPreceding, -1)
    sets = F.col("from_outside") == F.col("from_inside")
    swaps = F.col("from_outside") > F.col("from_inside")
    counted = ends.withColumn("swaps", F.coalesce(F.sum(swaps.cast("int")).over(before), F.lit(0)))
    last = F.last(F.when(sets, F.struct("from_outside", "swaps")), ignorenulls=True).over(before)
    placed = counted.withColumn("set", last)
    state = F.coalesce("set.from_outside", F.lit(0)) + F.col("swaps") - F.coalesce("set.swaps", F.lit(0))
    return placed.withColumn("inside", (state % 2).cast("int")).select(
        "key",
        "at",
        "inside",
        F.coalesce(F.lead("inside").over(file), F.lit(0)).alias("next_inside"),
        (F.col("at") == F.min(F.when(F.col("filled"), F.col("at"))).over(W.partitionBy("key"))).alias("header"),
    )


def _records(sep: str):
    """Whole records of each range, without the file's header and without records of no characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, now = LineStates(sep), None
        keys, found, size = [], [], 0
        inside, parts, whole, header = 0, [], True, False
        for batch in batches:
            for line, key, at, begins, heads in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (key, at) != now:
                    now, inside, parts, whole, header = (key, at), begins, [], not begins, heads
                parts.append(line)
                inside = states.after(line, inside)
                if inside:
                    continue
                record = b"\n".join(parts).removesuffix(b"\r") if whole else b""
                parts, whole = [], True
                if record and header:
                    header = False
                elif record:
                    keys.append(key)
                    found.append(record)
                    size += len(record)
            if size >= BATCH_BYTES:
                yield _batch(keys, found)
                keys, found, size = [], [], 0
        yield _batch(keys, found)

    return run


def _batch(keys: list[str], found: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.binary())], ["key", "record"])


def _fragments(sep: str):
    """What a range holds of records that begin before it or end after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, now, out = LineStates(sep), None, []
        inside, parts, tail, header = 0, [], False, False

        def close(kind: int) -> None:
            # The file's first record with any characters is its header.
            out.append((*now, kind, header and kind == _HEAD, b"\n".join(parts)))

        for batch in batches:
            for line, key, at, begins, heads in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (key, at) != now:
                    if parts:
                        close(_MIDDLE if tail else _HEAD)
                    now, inside, parts, tail, header = (key, at), begins, [], bool(begins), heads
                parts.append(line)
                inside = states.after(line, inside)
                if not inside:
                    if tail:
                        close(_TAIL)
                    header = header and not any(p.strip(b"\r") for p in parts)
                    parts, tail = [], False
        if parts:
            close(_MIDDLE if tail else _HEAD)
        columns = list(zip(*out, strict=True)) or [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "at", "kind", "header", "part"])

    return run


def _joined(fragments: DataFrame) -> DataFrame:
    """Records put together from their fragments; one that is never closed ends with its file, without the last line's end."""
    file = W.partitionBy("key").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    begun = F.last(F.when(F.col("kind") == _HEAD, F.col("at")), ignorenulls=True).over(file)
    parts = F.array_sort(F.collect_list(F.struct("at", "kind", F.col("part").cast("string").alias("part"))))
    whole = fragments.withColumn("begun", begun).groupBy("key", "begun").agg(parts.alias("parts"), F.bool_or("header").alias("header"))
    text = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["part"]), "\n"), "\r$", "")
    return whole.filter(~F.col("header")).select("key", text.alias("record"))


def csv_records(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    """``key`` (JSON of the file's path and partition columns) and ``record``: the text of each record but the header.

    UTF-8 files with quotes ``"``, doubled inside a field, and lines that end with LF or CRLF. Files without a record
    and lines without a character give nothing. The lines are scanned three times, and none is shuffled;
    what moves is a row per range and the records over the ends of ranges.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    key = F.to_json(F.struct(F.col("_metadata.file_path").alias("path"), *[c for c in lines.columns if c != "value"]))
    line, at = F.col("value").cast("binary"), F.col("_metadata.file_block_start")
    placed = lines.select(line.alias("line"), key.alias("key"), at.alias("at"))
    filled = (F.col("line") != F.lit(b"")) & (F.col("line") != F.lit(b"\r"))
    asked = placed.select(F.when(F.col("line").contains(F.lit(b'"')), F.col("line")).alias("line"), "key", "at", filled.alias("filled"))
    ends = asked.mapInArrow(_range_ends(sep), "key STRING, at BIGINT, from_outside INT, from_inside INT, filled BOOLEAN")
    # One row per range of the scan (128 MB by default) with a quoted field over its end or a header after blank ranges.
    starts = F.broadcast(_starts(ends).filter("inside = 1 OR next_inside = 1 OR (header AND at > 0)"))
    known = placed.join(starts, ["key", "at"], "left")
    begins = [F.coalesce("inside", F.lit(0)).alias("inside"), F.coalesce("header", F.col("at") == 0).alias("header")]
    whole = known.select("line", "key", "at", *begins).mapInArrow(_records(sep), "key STRING, record BINARY")
    torn = known.filter(F.col("inside").isNotNull()).select("line", "key", "at", *begins)
    joined = _joined(torn.mapInArrow(_fragments(sep), "key STRING, at BIGINT, kind INT, header BOOLEAN, part BINARY"))
    return whole.withColumn("record", F.col("record").cast("string")).unionByName(joined)


def parse_records(records: DataFrame, schema: T.StructType, partitions: T.StructType, options: dict) -> DataFrame:
    """Columns of :func:`csv_records`, then those of the folder's partitions."""
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)
    row = F.from_csv("record", fields, options)
    parsed = records.select(row.alias("__row"), F.from_json("key", partitions).alias("__file"))
    return parsed.select("__row.*", *([F.col("__file.*")] if len(partitions) else []))
