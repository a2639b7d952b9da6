"""File readers that return DataFrames."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.functions.text import SPACE_RUN
from quaver.operators.tables import language_ratio, level_rows
from quaver.operators.threads import LABEL_SCHEMA, THREAD_SCHEMA
from quaver.sources.csv_ranges import csv_records, parse_records

# Cells that count as missing in a CSV file.
MISSING = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null", "",
)


#: Files whose starts are sent to all tasks, about 200 bytes each.
FEW_FILES = 100_000


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table as it is stored; how it is cut into tasks is a setting of the session."""
    return spark.read.parquet(path)


def missing_as_null(df: DataFrame) -> DataFrame:
    """Cells spelled like a missing value become null."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[
            F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def read_csv(spark: SparkSession, path, schema=None, sep: str = ",") -> DataFrame:
    """CSV with a header; texts may hold newlines and doubled quotes, and many tasks read one file.

    Without a schema every column is a string, named by the header of the first file: nothing is inferred from data.
    """
    options = {"multiLine": "true", "quote": '"', "escape": '"', "sep": sep}
    named = spark.read.options(header=True, **options)
    named = (named.schema(schema) if schema is not None else named).csv(path)
    if not named.columns:
        return named
    partitions = spark.read.text(path).schema.fields[1:]
    folders = {f.name for f in partitions}
    cells = T.StructType([f for f in named.schema if f.name not in folders])
    return missing_as_null(parse_records(csv_records(spark, path, sep), cells, T.StructType(partitions), options))


def read_tsv(spark: SparkSession, path, names: list[str]) -> DataFrame:
    """Tab-separated file without a header, all columns strings."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return missing_as_null(spark.read.schema(schema).options(sep="\t", quote='"', escape='"').csv(path))


def field_counts(text: str, sep: str) -> list[int]:
    """Fields of each record; quoted fields may hold marks and newlines. A record counts 0 if something follows a closing quote."""
    counts, fields, start, quoted, closed, sound = [], 1, True, False, False, True
    for c in text:
        if quoted:
            if c == '"':
                quoted, closed = False, True
        elif c == '"' and (start or closed):
            quoted, closed = True, False  # opens a field, or the second of two within one
        elif c == sep or c == "\n":
            if c == "\n":
                counts.append(fields if sound else 0)
                fields, sound = 0, True
            fields, closed = fields + 1, False
            start = True
            continue
        elif closed:
            sound = False
        start = False
    if not start and not quoted:
        counts.append(fields if sound else 0)
    return counts


def sniff_separator(spark: SparkSession, path, candidates: str = ",;|", lines: int = 200) -> str:
    """The mark that cuts most records of the first ``lines`` lines into one number of fields, two at least; a tab when none does."""
    head = "".join(r[0] + "\n" for r in spark.read.text(path).limit(lines).collect())

    def score(sep: str) -> tuple[float, int]:
        counts = field_counts(head, sep)
        usual = Counter(n for n in counts if n > 1).most_common(1)
        return (usual[0][1] / len(counts), usual[0][0]) if usual else (0.0, 0)

    return max("\t" + candidates, key=score)


def read_sniffed(spark: SparkSession, path, schema=None) -> DataFrame:
    return read_csv(spark, path, schema, sniff_separator(spark, path))


def union_splits(parts: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    """Tag each part with its name and stack them."""
    out = None
    for name, part in parts.items():
        tagged = part.withColumn(tag, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def _path_part(path: Column, from_end: int) -> Column:
    """Decoded path element counted from the file name (1 is its folder)."""
    return F.url_decode(F.element_at(F.split(path, "/"), -1 - from_end))


def _thread_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    files = (
        spark.read.option("pathGlobFilter", name).option("recursiveFileLookup", True).text(root, wholetext=True)
    )
    path = F.col("_metadata.file_path")
    return files.select(
        _path_part(path, 3).alias("split"),
        _path_part(path, 2).alias("topic"),
        _path_part(path, 1).alias("thread"),
        F.col("value"),
    )


def read_threads(spark: SparkSession, root: str) -> DataFrame:
    """Threads under ``{root}/{split}/{topic}/{thread}/`` that have both files.

    A file that does not parse is skipped, like a thread that lacks one.
    """
    keys = ["split", "topic", "thread"]
    schema = T.StructType([*THREAD_SCHEMA.fields, T.StructField("__bad", T.StringType())])
    parsed = F.from_json("value", schema, {"columnNameOfCorruptRecord": "__bad"})
    data = _thread_files(spark, root, "data.json").select(*keys, parsed.alias("__t"))
    data = data.filter(F.col("__t").isNotNull() & F.col("__t.__bad").isNull())
    labels = _thread_files(spark, root, "labels.json").select(
        *keys, F.from_json("value", LABEL_SCHEMA).alias("labels")
    )
    both = data.join(labels.filter(F.col("labels").isNotNull()), keys)
    return both.select(*keys, "__t.*", "labels").drop("__bad")


def read_tagged_blocks(spark: SparkSession, path) -> DataFrame:
    """Token-tagged tweets: a ``meta uid sentiment`` line, then ``token tag`` lines.

    Each block is one record of the scan, so a file is read in parallel. Any line that
    starts with ``meta`` opens a block; lines before the first one are ignored. Lines of
    one field get the tag O; blocks without tokens are dropped.
    """
    records = spark.read.option("lineSep", "\nmeta").text(path)
    placed = records.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    return parse_blocks(placed.mapInArrow(_without_prefaces, "value STRING"))


def _without_prefaces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the first record of a file, the only one that keeps its marker, if it lacks it."""
    before = None
    for batch in batches:
        kept = []
        for value, path, at in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            preface = at == 0 and (path, at) != before and not value.startswith("meta")
            before = (path, at)
            if not preface:
                kept.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string())], ["value"])


def _blocks_of_text(text) -> Column:
    """Blocks of one text that holds a whole file: what follows each ``meta`` at the start of a line."""
    return F.slice(F.split(F.concat(F.lit("\n"), text), "\nmeta"), 2, 1 << 30)


def parse_tagged_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Tagged blocks of a column of whole files, beside the frame's other columns."""
    kept = [c for c in df.columns if c != text]
    return parse_blocks(df.select(*kept, F.explode(_blocks_of_text(F.col(text))).alias("value")))


def parse_blocks(records: DataFrame) -> DataFrame:
    """Fields of tagged blocks (``value``), with or without their leading ``meta``."""
    filled = lambda line: F.filter(F.split(line, SPACE_RUN), lambda x: x != "")
    # The separator is gone from every record but the first of a file.
    lines = F.split(F.when(F.col("value").startswith("meta"), F.col("value")).otherwise(F.concat(F.lit("meta"), "value")), "\n")
    head = filled(F.get("lines", F.lit(0)))
    body = F.filter(F.transform(F.slice("lines", F.lit(2), F.size("lines")), filled), lambda p: F.size(p) > 0)
    kept = [c for c in records.columns if c != "value"]
    parsed = records.select(*kept, lines.alias("lines")).select(
        *kept, F.get(head, F.lit(1)).alias("uid"), F.lower(F.get(head, F.lit(2))).alias("sentiment"), body.alias("body")
    )
    return (
        parsed.filter(F.col("uid").isNotNull() & (F.size("body") > 0))
        .withColumn("tokens", F.transform("body", lambda p: F.get(p, F.lit(0))))
        .withColumn("langs", F.transform("body", lambda p: F.coalesce(F.get(p, F.lit(1)), F.lit("O"))))
        .withColumn("text", F.array_join("tokens", " "))
        .withColumn("lang_ids", F.array_join("langs", " "))
        .withColumn("hindi_ratio", language_ratio("langs"))
        .select(*kept, "uid", "text", "sentiment", "lang_ids", "hindi_ratio", "tokens", "langs")
    )


def attach_test_labels(tweets: DataFrame, labels: DataFrame) -> DataFrame:
    """Replace the sentiment by the one of a label table, by uid."""
    return tweets.drop("sentiment").join(labels.select("uid", "sentiment"), "uid", "left")


# Every field a result record may carry, whichever tool wrote it.
RESULT_SCHEMA = """
    model STRING, encoder STRING, train_noise STRING, test_noise STRING, noise_level STRING, noise STRING,
    seed BIGINT, test_f1_macro DOUBLE, test_f1 DOUBLE, best_val_f1 DOUBLE, val_f1 DOUBLE, val_f1_macro DOUBLE,
    alpha DOUBLE, beta DOUBLE, gamma DOUBLE, lambda_max DOUBLE, enable_aux BOOLEAN,
    epoch BIGINT, epochs BIGINT, lr DOUBLE, batch_size BIGINT, max_len BIGINT, ablation STRING, __bad STRING
"""


def read_results(spark: SparkSession, path) -> DataFrame:
    """All result records below a folder; unreadable files are left out."""
    raw = spark.read.schema(RESULT_SCHEMA).json(
        path,
        multiLine=True,
        recursiveFileLookup=True,
        pathGlobFilter="*.json",
        mode="PERMISSIVE",
        columnNameOfCorruptRecord="__bad",
    )
    good = raw.select("*", F.col("_metadata.file_path").alias("path")).filter(F.col("__bad").isNull())
    return normalise_results(good.drop("__bad"))


def normalise_results(raw: DataFrame) -> DataFrame:
    """One spelling for the condition, test score and validation score."""
    same = {
        "test_noise": ("test_noise", "noise_level", "noise"),
        "test_f1_macro": ("test_f1_macro", "test_f1"),
        "best_val_f1": ("best_val_f1", "val_f1", "val_f1_macro"),
    }
    dropped = [c for names in same.values() for c in names[1:]]
    return raw.withColumns({out: F.coalesce(*names) for out, names in same.items()}).drop(*dropped)


def read_feature_tables(spark: SparkSession, folder: str) -> DataFrame:
    """All feature files of a folder as one table: ``part_file``, and ``position`` of each row as if the files were read one after another by name.

    The number of rows before each file is added to a row's place in its file; rows stay where they are read.
    """
    rows = spark.read.parquet(folder).select(
        "*", F.col("_metadata.file_name").alias("part_file"), F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__row")
    )
    sizes = rows.groupBy("part_file", "__path").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.orderBy("part_file", "__path").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__path", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    # A row per file, told from the listing; beyond the bound the plan chooses the join.
    if len(rows.inputFiles()) <= FEW_FILES:
        starts = F.broadcast(starts)
    return rows.join(starts, "__path").withColumn("position", F.col("__before") + F.col("__row")).drop("__path", "__before", "__row")


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def inventory(spark: SparkSession, files: dict[str, str], reader=read_csv) -> DataFrame:
    """(name, present, rows, columns) per file and a TOTAL row."""
    schema = "name STRING, present BOOLEAN, rows BIGINT, columns STRING"
    out = spark.createDataFrame([], schema)
    for name, path in files.items():
        if not table_exists(spark, path):
            line = spark.createDataFrame([(name, False, None, None)], schema)
        else:
            df = reader(spark, path)
            line = df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(name).alias("name"), F.lit(True).alias("present"), "rows",
                F.lit(", ".join(df.columns[:5])).alias("columns"),
            )
        out = out.unionByName(line)
    both = out.groupingSets([("name", "present", "columns"), ()], "name", "present", "columns")
    # Only the grand total lacks a name.
    counted = both.agg(F.sum("rows").alias("rows"), F.grouping("name").alias("__all"))
    return counted.select(
        F.when(F.col("__all") == 1, "TOTAL").otherwise(F.col("name")).alias("name"), "present",
        F.when(F.col("__all") == 1, F.coalesce("rows", F.lit(0))).otherwise(F.col("rows")).alias("rows"), "columns",
    )


def read_condition(splits: DataFrame, condition: str) -> dict[str, DataFrame]:
    """Train, validation and test rows of a condition.

    The filters are on partition columns, so only matching folders are scanned.
    A condition without test rows is tested on clean ones; ``all`` is tested on
    every condition, told apart by ``noise_level``.
    """
    rows = splits.na.drop(subset=["text", "label"])
    tests = rows.filter(F.col("split") == "test")
    if condition != "all":
        wanted = tests.filter(F.col("noise_level") == condition)
        tests = tests.filter(F.col("noise_level") == "clean") if wanted.isEmpty() else wanted
    return {
        "train": level_rows(rows.filter(F.col("split") == "train"), condition),
        "val": rows.filter(F.col("split") == "val"),
        "test": tests,
    }


def first_filled(spark: SparkSession, paths: list[str], reader=read_csv) -> DataFrame:
    """First of the files that exists and holds rows."""
    for path in paths:
        if table_exists(spark, path):
            df = reader(spark, path)
            if not df.isEmpty():
                return df
    raise FileNotFoundError(f"no rows in any of {paths}")
