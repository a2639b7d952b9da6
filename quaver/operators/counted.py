"""Linear models on TF-IDF weights of texts that are kept as counts.

A weight is (1 + ln tf) * idf / length: a factor of the entry, one of the term and one of the row. Blocks hold the whole numbers term by term, so
an entry takes a byte or two instead of the twelve of a sparse vector, each text is held once for all conditions, and a pass reads rows
and terms in order. The weights are those of :func:`quaver.operators.tfidf.term_lists`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quaver.operators import linear
from quaver.operators.bounded import swept
from quaver.operators.passes import dealt, sums
from quaver.operators.tfidf import by_key, counted


@dataclass(frozen=True)
class Terms:
    """The terms of all conditions in order; a condition's places among them ascend, with the idf there."""

    names: pa.Array
    places: dict[str, np.ndarray]
    idf: dict[str, np.ndarray]

    def sizes(self) -> dict[str, int]:
        return {c: len(p) for c, p in self.places.items()}

    def wide(self, condition: str, values: np.ndarray) -> np.ndarray:
        """Values of a condition's terms, times idf, at the places of all terms."""
        out = np.zeros(len(self.names))
        out[self.places[condition]] = values * self.idf[condition]
        return out


def terms_of(known: dict[str, pa.Table]) -> Terms:
    """From (term, index, idf) of each condition."""
    known = {c: t.sort_by("index") for c, t in known.items()}
    names = pa.array(sorted(set().union(*[t["term"].to_pylist() for t in known.values()])), pa.string())
    places = {c: np.asarray(pc.index_in(t["term"].combine_chunks(), value_set=names), np.int64) for c, t in known.items()}
    return Terms(names, places, {c: np.asarray(t["idf"], np.float64) for c, t in known.items()})


@dataclass(frozen=True)
class Texts:
    """Rows (row id, text, label) as table, the name of the id, and the terms by which they are seen."""

    rows: DataFrame
    row_id: str
    terms: Terms


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, a byte each; 255 adds to the next byte."""
    more = values // 255
    out = np.full(len(values) + int(more.sum()), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = values - 255 * more
    return len(out).to_bytes(8, "little") + pa.compress(out.tobytes(), codec="zstd", asbytes=True)


def _bytes(data: pa.Buffer) -> np.ndarray:
    size = int.from_bytes(memoryview(data)[:8], "little")
    if not size:
        return np.zeros(0, np.uint8)
    return np.frombuffer(pa.decompress(data.slice(8), size, codec="zstd"), np.uint8)


def totals(data: pa.Buffer) -> np.ndarray:
    """Running totals of packed numbers."""
    raw = _bytes(data)
    out = np.cumsum(raw, dtype=np.int64)
    last = raw != 255
    return out if last.all() else out[last]


def numbers(data: pa.Buffer) -> np.ndarray:
    raw = _bytes(data)
    return raw.astype(np.int64) if not len(raw) or raw.max() < 255 else np.diff(totals(data), prepend=0)


_LOGS = 1.0 + np.log(np.arange(1, 257))
_PACKED = ("places", "sizes", "rows", "times")
_BLOCK = [T.StructField("role", T.StringType()), T.StructField("level", T.StringType()), T.StructField("n", T.IntegerType())]
_BLOCK += [T.StructField(c, T.BinaryType()) for c in ("label", *_PACKED, "unit")]


def _block(row: np.ndarray, at: np.ndarray, tf: np.ndarray, n: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Packed columns of a block, and (row, term, 1 + ln tf) of its entries, term by term."""
    if len(tf) and tf.max() < 1 << 15 and int(at.max() + 1) * n < 1 << 48:
        # One plain sort of numbers is faster than the order of another array.
        both = (at * n + row) << 15 | tf
        both.sort()
        tf, both = both & ((1 << 15) - 1), both >> 15
        at, row = both // n, both % n
    else:
        order = np.lexsort((row, at))
        row, at, tf = row[order], at[order], tf[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    places, sizes = at[first], np.diff(np.append(first, len(at)))
    gaps = np.diff(row, prepend=0)
    gaps[first] = row[first]
    return [packed(x) for x in (np.diff(places, prepend=0), sizes - 1, gaps, tf - 1)], row, at, 1.0 + np.log(tf)


def blocks(df: DataFrame, key: str, terms: Terms, used: dict[tuple, list[str]], cell: Callable[[object], tuple], ids: bool = False) -> DataFrame:
    """Blocks of rows (key, text, label); ``cell`` gives a key's role and level, ``used`` the conditions of those, in whose order ``unit`` has them.

    Rows that share a key share all their texts' words; a row whose key is null has none. Training rows without a label are left out.
    With ``ids`` the keys of a block's rows are kept.
    """
    shared = df.sparkSession.sparkContext.broadcast(terms)
    texts = by_key(df, key, "text", "label")
    kind = texts.schema[key].dataType
    fields = [*_BLOCK, *([T.StructField("ids", T.ArrayType(kind))] if ids else [])]
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        idf = {c: known.wide(c, np.ones(len(p))) for c, p in known.places.items()}
        for keys, own, row, gram, tf, names in counted(batches, 2, 4):
            place = np.asarray(pc.fill_null(pc.index_in(pa.array(names, pa.string()), value_set=known.names), -1), np.int64)[gram]
            place[np.array([k is None for k in keys])[row]] = -1
            row, place, tf = (x[place >= 0] for x in (row, place, tf))
            cells: dict[tuple, list[int]] = {}
            for i, k in enumerate(keys):
                cells.setdefault(cell(k), []).append(i)
            for (role, level), mine in cells.items():
                if not used.get((role, level)):
                    continue
                kept = [[v for v in own[i] if v is not None or role != "train"] for i in mine]
                times = np.array([len(v) for v in kept])
                n = int(times.sum())
                if not n:
                    continue
                # Entries of a row come once for each of those that share its key.
                copies = np.zeros(len(keys), np.int64)
                copies[mine] = times
                begin = np.zeros(len(keys), np.int64)
                begin[mine] = np.cumsum(times) - times
                again = copies[row]
                entry = np.repeat(np.arange(len(row)), again)
                nth = np.arange(len(entry)) - np.repeat(np.cumsum(again) - again, again)
                columns, r, at, log = _block(begin[row[entry]] + nth, place[entry], tf[entry], n)
                length = [np.sqrt(np.bincount(r, (log * idf[c][at]) ** 2, minlength=n)) for c in used[role, level]]
                unit = np.concatenate([np.divide(1.0, x, out=np.zeros(n), where=x > 0) for x in length])
                label = np.array([np.nan if v is None else v for vs in kept for v in vs], np.float64)
                arrays = [pa.array([role], pa.string()), pa.array([level], pa.string()), pa.array([n], pa.int32())]
                arrays += [pa.array([x], pa.binary()) for x in (label.tobytes(), *columns, unit.tobytes())]
                if ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array([keys[i] for i, vs in zip(mine, kept, strict=True) for _ in vs], arrow)))
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

    return texts.mapInArrow(run, T.StructType(fields))


@dataclass
class Block:
    cell: tuple
    n: int
    label: np.ndarray
    places: np.ndarray
    sizes: np.ndarray
    rows: np.ndarray
    logs: np.ndarray
    unit: np.ndarray

    def margins(self, points: list[np.ndarray], shift: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """A column for each of the points, which have weights times idf at all places."""
        return np.column_stack([unit * np.bincount(self.rows, self.logs * np.repeat(p[self.places], self.sizes), minlength=self.n) + s for p, s in zip(points, shift, strict=True)])


def _opened(batch: pa.RecordBatch, k: int) -> Block:
    role, level, n = (batch.column(i)[k].as_py() for i in range(3))
    label, *columns, unit = (batch.column(i)[k].as_buffer() for i in range(3, 9))
    places, sizes, gaps, times = totals(columns[0]), numbers(columns[1]) + 1, totals(columns[2]), numbers(columns[3])
    begin = np.cumsum(sizes) - sizes
    before = np.where(begin > 0, gaps[begin - 1], 0) if len(gaps) else gaps
    logs = _LOGS[times] if not len(times) or times.max() < len(_LOGS) else 1.0 + np.log(times + 1.0)
    return Block((role, level), n, np.frombuffer(label), places, sizes, gaps - np.repeat(before, sizes), logs, np.frombuffer(unit).reshape(-1, n))


def _asked(block: Block, used: dict[tuple, list[str]], models: list[linear.Model]) -> Iterator[tuple[int, linear.Model, np.ndarray]]:
    """Models that use a block, with the scale of its rows."""
    for unit, condition in zip(block.unit, used[block.cell], strict=True):
        for j, m in enumerate(models):
            if m.spec.condition == condition:
                yield j, m, unit


def _points(models: list[linear.Model], terms: Terms) -> list[list[np.ndarray]]:
    return [[terms.wide(m.spec.condition, w) for w in m.weights.T] for m in models]


def _pass(blocked: DataFrame, tasks: int, models: list[linear.Model], terms, used: dict[tuple, list[str]]) -> list[tuple[float, np.ndarray]]:
    """Summed loss and flat gradient (weights, then shift) of each model at its current point."""
    shared = blocked.sparkSession.sparkContext.broadcast(models)

    def arrays(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        found: dict[int, tuple] = {}
        models, known = shared.value, terms.value
        points = _points(models, known)
        for batch in batches:
            for k in range(batch.num_rows):
                block = _opened(batch, k)
                begin = np.cumsum(block.sizes) - block.sizes
                for j, m, unit in _asked(block, used, models):
                    z = block.margins(points[j], m.shift, unit)
                    loss, residual = linear.loss_and_residual(m.spec.loss, z, linear.targets(block.label, m.classes, z.shape[1]))
                    value, slope, shift = found.setdefault(j, (np.zeros(1), np.zeros((z.shape[1], len(known.names))), np.zeros(z.shape[1])))
                    value += float(loss.sum())
                    shift += residual.sum(axis=0)
                    for c in range(z.shape[1] if len(begin) else 0):
                        slope[c][block.places] += np.add.reduceat(block.logs * (unit * residual[:, c])[block.rows], begin)
        out = {}
        for j, (value, slope, shift) in found.items():
            condition = models[j].spec.condition
            own = slope[:, known.places[condition]] * known.idf[condition]
            out[j] = np.concatenate([value, own.T.reshape(-1), shift])
        return out

    found = sums(blocked, tasks, arrays)
    shared.destroy()
    none = [np.zeros(1 + m.weights.size + m.shift.size) for m in models]
    return [(float(v[0]), v[1:]) for v in (found.get(j, none[j]) for j in range(len(models)))]


def fit(blocked: DataFrame, tasks: int, specs: list[linear.Spec], terms: Terms, used: dict[tuple, list[str]], tolerance: float = 1e-4) -> list[linear.Model]:
    """:func:`quaver.operators.linear.fit` on the blocks of training rows; ``tasks`` hold the blocks."""
    train = blocked.where("role = 'train'")

    def labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = np.unique(np.frombuffer(batch.column(1)[k].as_buffer()))[: linear.MOST_CLASSES + 1]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(own), pa.string()), pa.array(own)], ["level", "label"])

    seen: dict[str, set] = {}
    most = (linear.MOST_CLASSES + 1) * max(1, len(used))
    with swept(blocked.sparkSession):
        found = train.select("level", "label").mapInArrow(labels, "level STRING, label DOUBLE").distinct().limit(most).collect()
    for r in found:
        for condition in used["train", r["level"]]:
            seen.setdefault(condition, set()).add(r["label"])
    shared = blocked.sparkSession.sparkContext.broadcast(terms)
    try:
        return linear.descend(specs, {c: sorted(v) for c, v in seen.items()}, terms.sizes(), tolerance, lambda models: _pass(train, tasks, models, shared, used))
    finally:
        shared.destroy()


def predict(blocked: DataFrame, models: list[linear.Model], terms: Terms, used: dict[tuple, list[str]], row_id: str | None = None) -> DataFrame:
    """(role, condition, label, model, prediction, probability of the second class) of blocks' rows, after the row id where blocks keep it."""
    context = blocked.sparkSession.sparkContext
    shared = context.broadcast((models, terms))
    fields = [T.StructField(row_id, blocked.schema["ids"].dataType.elementType)] if row_id else []
    fields += [T.StructField(c, T.StringType()) for c in ("role", "condition")] + [T.StructField("label", T.DoubleType())]
    fields += [T.StructField("model", T.StringType()), T.StructField("prediction", T.IntegerType()), T.StructField("probability", T.DoubleType())]
    # A name may be the row id's too.
    at = [f"c{i}" for i in range(len(fields))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, known = shared.value
        points = _points(models, known)
        for batch in batches:
            for k in range(batch.num_rows):
                block = _opened(batch, k)
                ids = [batch.column(9).slice(k, 1).flatten()] if row_id else []
                for j, m, unit in _asked(block, used, models):
                    label, p = linear.decided(m, block.margins(points[j], m.shift, unit) if points[j] else None, block.n)
                    names = [pa.array([v] * block.n, pa.string()) for v in (block.cell[0], m.spec.condition)]
                    made = [pa.array([m.spec.name] * block.n), pa.array(label.astype(np.int32), pa.int32()), pa.array(p, pa.float64(), mask=np.isnan(p))]
                    yield pa.RecordBatch.from_arrays([*ids, *names, pa.array(block.label, mask=np.isnan(block.label)), *made], at)

    found = blocked.mapInArrow(run, T.StructType([T.StructField(a, f.dataType) for a, f in zip(at, fields, strict=True)]))
    return found.toDF(*[f.name for f in fields])


#: Cells and conditions of a single model.
ONE = {("train", "all"): ["all"], ("test", "all"): ["all"]}


def _part(texts: Texts, role: str) -> DataFrame:
    rows = texts.rows.select(texts.row_id, "text", F.col("label").cast("double").alias("label"))
    return blocks(rows, texts.row_id, texts.terms, ONE, lambda key: (role, "all"), ids=role == "test")


def fit_texts(texts: Texts, spec: linear.Spec, tolerance: float = 1e-4) -> linear.Model:
    blocked, tasks = dealt(_part(texts, "train"), list(_PACKED), settle=True)
    return fit(blocked, tasks, [spec], texts.terms, ONE, tolerance)[0]


def predict_texts(texts: Texts, model: linear.Model) -> DataFrame:
    """(row, label, model, prediction, probability)."""
    found = predict(_part(texts, "test"), [model], texts.terms, ONE, texts.row_id)
    return found.select(texts.row_id, F.col("label").cast("int").alias("label"), "model", "prediction", "probability")
