"""TF-IDF over character n-grams with sublinear term frequency and smooth idf."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quaver.operators.tables import top_terms

MAX_TERMS = 100_000
#: Letters of distinct words, and rows, that a task counts at once.
HELD_LETTERS, HELD_ROWS = 1 << 19, 4096
#: Rows of a batch that a task returns.
ROWS_OUT = 1 << 18


def _grams(rows: list[Counter], low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(row, place of the n-gram among the names, tf, names) of rows of word counts, by row and n-gram."""
    times = np.array([n for r in rows for n in r.values()], np.int64)
    if not len(times):
        return *[np.zeros(0, np.int64)] * 3, []
    # Words apart by single spaces: each is padded by the spaces on both its sides, so an n-gram is of one word if no space is inside.
    line = np.frombuffer(" ".join(["", *[w for r in rows for w in r], ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.flatnonzero(np.bincount(line))
    number = np.zeros(int(letters[-1]) + 1, np.int64)
    number[letters] = np.arange(1, len(letters) + 1)
    code, space = number[line], line == 32
    word = np.cumsum(space) - 1
    bits = len(letters).bit_length()
    starts, inside = [], np.ones(len(line), bool)
    for k in range(2, high + 1):
        inside = inside[: len(line) - k + 1] & ~space[k - 2 : len(line) - 1] if k > 2 else inside[:-1]
        if k >= low:
            starts.append(np.flatnonzero(inside))
    places = np.concatenate(starts)
    if bits * high <= 62:
        grams = []
        for k, at in zip(range(max(2, low), high + 1), starts, strict=True):
            gram = code[at]
            for i in range(1, k):
                gram = gram << bits | code[at + i]
            grams.append(gram << bits * (high - k))
        gram, names = np.concatenate(grams), None
    else:
        cut = [np.pad(code[at[:, None] + np.arange(k)], ((0, 0), (0, high - k))) for k, at in zip(range(max(2, low), high + 1), starts, strict=True)]
        names, gram = np.unique(np.concatenate(cut), axis=0, return_inverse=True)
        gram = gram.reshape(-1)
    # Row, n-gram and number of times share one integer, so that a plain sort brings equal n-grams together.
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    wide, last = int(times.max()).bit_length(), len(rows).bit_length()
    middle = bits * high if names is None else len(names).bit_length()
    apart = None
    if wide + middle + last > 62:
        apart, gram = np.unique(gram, return_inverse=True)
        middle = len(apart).bit_length()
    own = word[places]
    packed = owner[own] << (wide + middle) | gram << wide | times[own]
    packed.sort()
    keys = packed >> wide
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    tf = np.add.reduceat(packed & ((1 << wide) - 1), first)
    row, gram = keys[first] >> middle, keys[first] & ((1 << middle) - 1)
    gram = gram if apart is None else apart[gram]
    distinct, gram = np.unique(gram, return_inverse=True)
    if names is None:
        names = np.column_stack([distinct >> bits * (high - 1 - i) & ((1 << bits) - 1) for i in range(high)])
    else:
        names = names[distinct]
    spelt = np.concatenate([[0], letters])[names].astype(np.uint32)
    terms = np.ascontiguousarray(spelt).view(f"<U{high}").ravel().tolist()
    if not letters[0]:
        # The letter NUL: an array of strings loses it at the end.
        terms = [t.ljust(n, "\0") for t, n in zip(terms, (names > 0).sum(axis=1).tolist(), strict=True)]
    return row, gram, tf, terms


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def counted(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[tuple[list, list[list], np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """Groups of (keys, their rows' values, row, n-gram, tf, names of n-grams) from rows (key, text, value or none) in the order of their keys; rows that share a key are one."""
    keys, own, rows, held = [], [], [], 0
    for batch in batches:
        values = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for key, text, value in zip(batch.column(0).to_pylist(), batch.column(1), values, strict=True):
            text = text.as_py()
            words = Counter(text.split()) if text is not None else Counter()
            if keys and _same(keys[-1], key):
                rows[-1].update(words)
                own[-1].append(value)
                continue
            if held >= HELD_LETTERS or len(rows) >= HELD_ROWS:
                yield keys, own, *_grams(rows, low, high)
                keys, own, rows, held = [], [], [], 0
            keys.append(key)
            own.append([value])
            rows.append(words)
            held += sum(map(len, words)) + len(words)
    if keys:
        yield keys, own, *_grams(rows, low, high)


def by_key(df: DataFrame, row_id: str, text: str, *others: str) -> DataFrame:
    """(row, lower-cased text, others), rows that share an id next to each other in one partition."""
    return df.select(row_id, F.lower(text).alias("__text"), *others).repartition(row_id).sortWithinPartitions(row_id)


def term_counts(df: DataFrame, row_id: str, text: str = "text", low: int = 2, high: int = 4) -> DataFrame:
    """(row, term, tf) of the character n-grams inside each text's words.

    The texts are partitioned by row once; words are counted first and n-grams taken from distinct words, a bounded
    number of rows at a time, so that nothing but the texts is shuffled or sorted.
    """
    texts = by_key(df, row_id, text)
    out = T.StructType([texts.schema[row_id], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    kind = to_arrow_type(texts.schema[row_id].dataType)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, row, gram, tf, terms in counted(batches, low, high):
            names, ids = pa.array(terms, pa.string()), pa.array(keys, kind)
            for at in range(0, len(tf), ROWS_OUT):
                part = slice(at, at + ROWS_OUT)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[part])), names.take(pa.array(gram[part])), pa.array(tf[part])], out.names)

    return texts.mapInArrow(count, out)


def term_totals(df: DataFrame, row_id: str, level: Callable[[object], str | None] | None = None, text: str = "text", low: int = 2, high: int = 4) -> DataFrame:
    """(level, term, tf, df): the sums of :func:`term_counts` over the rows of a level of their key, and in how many a term is.

    Tasks add up a group of rows before anything is hashed or shuffled.
    """
    texts = by_key(df, row_id, text)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, row, gram, tf, terms in counted(batches, low, high):
            levels = [level(k) for k in keys] if level else [None] * len(keys)
            names = pa.array(terms, pa.string())
            for name in dict.fromkeys(levels):
                mine = np.array([v == name for v in levels])[row]
                rows = np.bincount(gram[mine], minlength=len(terms))
                # Sums of doubles are exact: a task's tokens are far fewer than 2**53.
                total = np.bincount(gram[mine], tf[mine], minlength=len(terms)).astype(np.int64)
                have = np.flatnonzero(rows)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(have), pa.string()), names.take(pa.array(have)), pa.array(total[have]), pa.array(rows[have])], ["level", "term", "tf", "df"])

    parts = texts.mapInArrow(add, "level STRING, term STRING, tf BIGINT, df BIGINT")
    return parts.groupBy("level", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def term_lists(df: DataFrame, row_id: str, entries: list[tuple], conditions: Callable[[object], list[int]] | None = None, text: str = "text") -> DataFrame:
    """(row, condition, indices, values): weights (1 + ln tf) * idf of each row's terms, scaled to unit length, sorted by index.

    ``entries`` are (term, index, idf, condition), a vocabulary of at most MAX_TERMS per condition; ``conditions`` gives those that a row's key asks
    for, 0 without it. Rows without a known term are left out.
    """
    terms: dict[int, dict[str, tuple[int, float]]] = {}
    for term, index, idf, condition in entries:
        terms.setdefault(condition, {})[term] = (index, idf)
    shared = df.sparkSession.sparkContext.broadcast(terms)
    texts = by_key(df, row_id, text)
    out = T.StructType(
        [texts.schema[row_id], T.StructField("condition", T.IntegerType()), T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]
    )
    kind = to_arrow_type(texts.schema[row_id].dataType)

    def weigh_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for keys, _, row, gram, tf, terms in counted(batches, 2, 4):
            ids, wanted = pa.array(keys, kind), [conditions(k) if conditions else [0] for k in keys]
            for c, vocabulary in known.items():
                found = [vocabulary.get(t, (-1, 0.0)) for t in terms]
                index, idf = np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.float64)
                asked = np.array([c in w for w in wanted])
                mine = np.flatnonzero(asked[row] & (index[gram] >= 0))
                mine = mine[np.lexsort((index[gram[mine]], row[mine]))]
                if not len(mine):
                    continue
                weight = (1.0 + np.log(tf[mine])) * idf[gram[mine]]
                have, first = np.unique(row[mine], return_index=True)
                sizes = np.diff(np.append(first, len(mine)))
                unit = weight / np.repeat(np.sqrt(np.add.reduceat(weight * weight, first)), sizes)
                ends = pa.array(np.append(first, len(mine)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(index[gram[mine]], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(unit))]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(have)), pa.array(np.full(len(have), c), pa.int32()), *lists], out.names)

    return texts.mapInArrow(weigh_rows, out)


def vocabulary(counts: DataFrame, k: int = MAX_TERMS) -> DataFrame:
    """The k most frequent terms with their document frequency, from :func:`term_counts` or :func:`term_totals`."""
    rows = F.sum("df") if "df" in counts.columns else F.count(F.lit(1))
    totals = counts.groupBy("term").agg(F.sum("tf").alias("corpus_tf"), rows.alias("df"))
    return top_terms(totals, "term", "corpus_tf", k)


def fit_idf(counts: DataFrame, documents: DataFrame, k: int = MAX_TERMS) -> DataFrame:
    """(term, idf) with idf = ln((1 + n) / (1 + df)) + 1."""
    n = documents.count()
    return vocabulary(counts, k).select("term", (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def weigh(counts: DataFrame, row_id: str, idf: DataFrame) -> DataFrame:
    """(row, term, weight): (1 + ln tf) * idf, scaled to unit length per row."""
    raw = counts.join(idf, "term").withColumn("__w", (1.0 + F.log("tf")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("__w") * F.col("__w")).over(W.partitionBy(row_id)))
    return raw.select(row_id, "term", (F.col("__w") / length).alias("weight"))


def tfidf(df: DataFrame, row_id: str, text: str = "text", k: int = MAX_TERMS) -> DataFrame:
    """Fit and apply on the same rows."""
    # k rows at most; indices are places among them.
    terms = fit_idf(term_counts(df, row_id, text), df, k).toPandas()
    names = df.sparkSession.sparkContext.broadcast(pa.array(terms["term"], pa.string()))
    lists = term_lists(df, row_id, [(t, i, w, 0) for i, (t, w) in enumerate(zip(terms["term"], terms["idf"], strict=True))], text=text)
    out = T.StructType([lists.schema[row_id], T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            indices, values = batch.column(2), batch.column(3)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(indices.value_lengths()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), names.value.take(indices.flatten()), values.flatten()], out.names)

    return lists.mapInArrow(flat, out)


def index_terms(idf: DataFrame) -> DataFrame:
    """Number the vocabulary (at most MAX_TERMS rows) in term order."""
    return idf.withColumn("index", (F.row_number().over(W.partitionBy(F.lit(1)).orderBy("term")) - 1).cast("int"))


def _unit(lists: pa.ListArray) -> pa.ListArray:
    sizes = np.asarray(lists.value_lengths(), np.int64)
    entries, rows = np.asarray(lists.flatten()), np.repeat(np.arange(len(sizes)), sizes)
    length = np.sqrt(np.bincount(rows, entries * entries, minlength=len(sizes)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(entries / length[rows]))


def pack_vectors(df: DataFrame, size: int, out: str = "features", unit: bool = False) -> DataFrame:
    """``df`` with its last two columns, sorted indices and values, as one sparse MLlib vector, scaled to length one if ``unit``."""
    keep = df.columns[:-2]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            indices, values = batch.columns[-2:]
            if unit:
                values = _unit(values)
            parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)), indices, values]
            vector = pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], vector], [*keep, out])

    return df.mapInArrow(pack, T.StructType([*[df.schema[c] for c in keep], T.StructField(out, VectorUDT())]))


def entry_lists(weights: DataFrame, by: list[str]) -> DataFrame:
    """(by, indices, values): the rows (by, index, weight) of each group in index order."""
    entries = F.array_sort(F.collect_list(F.struct("index", "weight")))
    packed = weights.groupBy(*by).agg(entries.alias("__e"))
    return packed.select(
        *by,
        F.transform("__e", lambda e: e["index"]).alias("indices"),
        F.transform("__e", lambda e: e["weight"]).alias("values"),
    )


def to_vectors(weights: DataFrame, row_id: str, indexed: DataFrame, size: int, out: str = "features", rows: DataFrame | None = None) -> DataFrame:
    """One sparse vector per row for MLlib; with ``rows``, one for each of its rows, empty where no term is known."""
    lists = entry_lists(weights.join(indexed.select("term", "index"), "term"), [row_id])
    if rows is not None:
        lists = with_empty(rows.join(lists, row_id, "left"))
    return pack_vectors(lists, size, out)


def with_empty(lists: DataFrame) -> DataFrame:
    """Rows without entries get empty lists."""
    none = [F.array().cast(t) for t in ("array<int>", "array<double>")]
    return lists.withColumn("indices", F.coalesce("indices", none[0])).withColumn("values", F.coalesce("values", none[1]))
