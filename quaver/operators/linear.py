"""Linear classifiers fitted together on one feature table.

Any number of models (loss, condition) share each pass over the rows: a task returns the loss and the gradient of
every model that is still moving, tasks' parts are summed by model and block of coordinates, and the
driver takes one step of limited-memory BFGS per model. The driver and a task hold vectors of the models' size, never rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.operators.bounded import swept
from quaver.operators.passes import dealt, release, sums

#: Entries of features that a block holds.
ENTRIES = 1 << 20
#: Pairs of steps that a model's curvature is taken from; few of them mean many more passes on correlated n-grams.
MEMORY = 30
#: More labels than this are a mistake in the choice of the label column.
MOST_CLASSES = 1000

_SMALLEST = 1e-14


@dataclass(frozen=True)
class Spec:
    """What to fit: ``loss`` is squared_hinge, logistic (two classes) or softmax; rows are those of ``condition``.

    The objective is half the squared weights plus ``c`` times the summed loss. ``penalise_shift`` treats the
    shift as one more weight, as the published linear SVM does.
    """

    name: str
    loss: str
    condition: str = "all"
    c: float = 1.0
    penalise_shift: bool = False
    most_steps: int = 1000


@dataclass
class Model:
    """``weights`` (features x columns) and ``shift``; one column for two classes, else one per class."""

    spec: Spec
    classes: list[float]
    weights: np.ndarray
    shift: np.ndarray
    steps: int = 0
    slope: float = 0.0


def svm(condition: str = "all", name: str = "SVM", steps: int = 2000) -> Spec:
    return Spec(name, "squared_hinge", condition, penalise_shift=True, most_steps=steps)


def logistic(condition: str = "all", name: str = "LR", steps: int = 1000, multinomial: bool = False) -> Spec:
    return Spec(name, "softmax" if multinomial else "logistic", condition, most_steps=steps)


# Rows as blocks of sparse features.


def csr(column: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each entry, index, value) of a column of MLlib vectors, dense or sparse."""
    kind, _, indices, values = (column.field(i) for i in range(4))
    sizes = np.asarray(values.value_lengths().fill_null(0), np.int64)
    dense = np.asarray(kind.fill_null(1), np.int64) == 1
    entry = np.asarray(values.flatten(), np.float64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    given = ~dense[rows] if len(rows) else np.zeros(0, bool)
    at[given] = np.asarray(indices.flatten(), np.int64)
    return rows, at, entry


#: Bytes of a batch that are unpacked at once.
SLICE = 8 << 20


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of up to 64 MB in parts, so that arrays made of one stay small."""
    for batch in batches:
        step = max(1, batch.num_rows * SLICE // max(SLICE, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (condition, label, weight, features) as blocks of one condition."""
    for batch in _slices(batches):
        conditions = np.array(batch.column(0).to_pylist(), dtype=object)
        label, weight = (np.asarray(batch.column(i).cast(pa.float64())) for i in (1, 2))
        rows, at, entry = csr(batch.column(3))
        bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        for condition in sorted(set(conditions.tolist())):
            mine = np.flatnonzero(conditions == condition)
            cuts = np.cumsum(bounds[mine + 1] - bounds[mine]) // ENTRIES
            for part in np.split(mine, np.flatnonzero(np.diff(cuts)) + 1):
                counts = bounds[part + 1] - bounds[part]
                take = np.concatenate([np.arange(bounds[r], bounds[r + 1]) for r in part]) if len(part) else np.zeros(0, int)
                arrays = [counts.astype(np.int64), at[take].astype(np.int32), entry[take], label[part], weight[part]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([condition]), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]],
                    ["condition", "counts", "at", "entry", "label", "weight"],
                )


_BLOCK = "condition STRING, counts BINARY, at BINARY, entry BINARY, label BINARY, weight BINARY"


def blocks(rows: DataFrame) -> DataFrame:
    """Rows (condition, label, weight, features) packed for the passes; partitions stay those of the input."""
    return rows.select("condition", "label", "weight", "features").mapInArrow(_blocks, _BLOCK)


def _read(batch: pa.RecordBatch, k: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kinds = (np.int64, np.int32, np.float64, np.float64, np.float64)
    counts, at, entry, label, weight = (np.frombuffer(batch.column(i + 1)[k].as_buffer(), t) for i, t in enumerate(kinds))
    return batch.column(0)[k].as_py(), np.repeat(np.arange(len(counts)), counts), at, entry, label, weight


def _margins(rows: np.ndarray, at: np.ndarray, entry: np.ndarray, n: int, weights: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return np.column_stack([np.bincount(rows, entry * weights[at, j], minlength=n) + shift[j] for j in range(weights.shape[1])])


def targets(label: np.ndarray, classes: list[float], columns: int) -> np.ndarray:
    """+1 and -1 per column: the class of the column, or the second of two classes."""
    wanted = np.array(classes[-1:] if columns == 1 else classes)
    return np.where(label[:, None] == wanted, 1.0, -1.0)


def loss_and_residual(loss: str, z: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss per row and its derivative by each margin."""
    if loss == "squared_hinge":
        gap = np.maximum(0.0, 1.0 - target * z)
        return (gap * gap).sum(axis=1), -2.0 * target * gap
    if loss == "logistic":
        return np.logaddexp(0.0, -target * z).sum(axis=1), -target * np.exp(-np.logaddexp(0.0, target * z))
    top = z.max(axis=1, keepdims=True)
    total = np.log(np.exp(z - top).sum(axis=1, keepdims=True)) + top
    return (total - z)[target > 0], np.exp(z - total) - (target > 0)


# One pass for all models.


def _pass(blocked: DataFrame, tasks: int, models: list[Model]) -> list[tuple[float, np.ndarray]]:
    """Summed loss and flat gradient (weights, then shift) of each model at its current point."""
    shared = blocked.sparkSession.sparkContext.broadcast(models)

    def arrays(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        totals: dict[int, tuple] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                condition, rows, at, entry, label, weight = _read(batch, k)
                for j, m in enumerate(shared.value):
                    if m.spec.condition != condition:
                        continue
                    width = m.weights.shape[1]
                    z = _margins(rows, at, entry, len(label), m.weights, m.shift)
                    loss, residual = loss_and_residual(m.spec.loss, z, targets(label, m.classes, width))
                    residual *= weight[:, None]
                    value, slope, shift = totals.setdefault(j, (np.zeros(1), np.zeros_like(m.weights), np.zeros(width)))
                    value += float(loss @ weight)
                    for c in range(width):
                        slope[:, c] += np.bincount(at, entry * residual[rows, c], minlength=len(m.weights))
                    shift += residual.sum(axis=0)
        return {j: np.concatenate([value, slope.reshape(-1), shift]) for j, (value, slope, shift) in totals.items()}

    found = sums(blocked, tasks, arrays)
    shared.destroy()
    none = [np.zeros(1 + m.weights.size + m.shift.size) for m in models]
    return [(float(v[0]), v[1:]) for v in (found.get(j, none[j]) for j in range(len(models)))]


class _Pairs:
    """The last MEMORY steps of a model with the changes of its slope, and one over their product.

    Those of wide models are in a file that has no name: each is read twice a step, and a grid's are hundreds of megabytes. They shape
    steps only, so single precision will do there.
    """

    def __init__(self):
        self.held, self.products, self.file = None, [], None

    def add(self, s: np.ndarray, y: np.ndarray) -> None:
        if self.held is None and len(s) > 1 << 14:
            self.file = tempfile.TemporaryFile()
            self.held = np.memmap(self.file, np.float32, "w+", shape=(MEMORY, 2, len(s)))
        elif self.held is None:
            self.held = np.empty((MEMORY, 2, len(s)))
        slot = len(self.products) % MEMORY
        self.held[slot, 0], self.held[slot, 1] = s, y
        self.products.append(1.0 / float(s @ y))

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        for n in range(max(0, len(self.products) - MEMORY), len(self.products)):
            yield *np.asarray(self.held[n % MEMORY]), self.products[n]


@dataclass
class _Walk:
    """Where one model's descent stands."""

    model: Model
    x: np.ndarray
    f: float = np.inf
    g: np.ndarray | None = None
    direction: np.ndarray | None = None
    reach: float = 1.0
    steps: int = 0
    pairs: _Pairs = field(default_factory=lambda: _Pairs())
    first: float = 0.0

    def point(self) -> np.ndarray:
        return self.x if self.direction is None else self.x + self.reach * self.direction

    def place(self) -> Model:
        at, m = self.point(), self.model
        split = m.weights.size
        return Model(m.spec, m.classes, at[:split].reshape(m.weights.shape), at[split:])

    def penalty(self) -> np.ndarray:
        held = np.ones(len(self.x))
        if not self.model.spec.penalise_shift:
            held[self.model.weights.size :] = 0
        return held

    def turn(self) -> None:
        """Two-loop recursion over the kept pairs."""
        q, used = self.g.copy(), []
        pairs = list(self.pairs)
        for s, y, r in reversed(pairs):
            a = r * (s @ q)
            q -= a * y
            used.append(a)
        if pairs:
            s, y, r = pairs[-1]
            q /= r * (y @ y)
        for (s, y, r), a in zip(pairs, reversed(used), strict=True):
            q += s * (a - r * (y @ q))
        self.direction = -q
        self.reach = 1.0 if pairs else 1.0 / max(1.0, float(np.linalg.norm(q)))

    def see(self, loss: float, gradient: np.ndarray, tolerance: float) -> bool:
        """Take in the value at the last point; true when the descent has ended."""
        at, held, c = self.point(), self.penalty(), self.model.spec.c
        f = c * loss + 0.5 * float((held * at) @ at)
        g = c * gradient + held * at
        if self.g is None:
            self.f, self.g, self.first = f, g, float(np.abs(g).max(initial=0))
        else:
            slope = float(self.g @ self.direction)
            if not f <= self.f + 1e-4 * self.reach * slope + _SMALLEST * abs(self.f):
                # The minimum of the parabola through both values, within bounds.
                bend = f - self.f - self.reach * slope
                best = -slope * self.reach * self.reach / (2 * bend) if np.isfinite(bend) and bend > 0 else 0.0
                self.reach = float(np.clip(best, 0.1 * self.reach, 0.5 * self.reach))
                return self.reach < 1e-12
            s, y = at - self.x, g - self.g
            if s @ y > 1e-12 * float(np.linalg.norm(s) * np.linalg.norm(y)):
                self.pairs.add(s, y)
            self.x, self.f, self.g, self.steps = at, f, g, self.steps + 1
        if float(np.abs(self.g).max(initial=0)) <= tolerance * max(self.first, _SMALLEST) or self.steps >= self.model.spec.most_steps:
            return True
        self.turn()
        return False


def _labels(blocked: DataFrame, most: int) -> dict[str, list[float]]:
    """Labels of each condition, ``most`` in all at most, from the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = np.unique(np.frombuffer(batch.column(1)[k].as_buffer()))[:most]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(own), pa.string()), pa.array(own)], ["condition", "label"])

    seen: dict[str, list[float]] = {}
    with swept(blocked.sparkSession):
        found = blocked.select("condition", "label").mapInArrow(run, "condition STRING, label DOUBLE").distinct().limit(most).collect()
    for r in found:
        seen.setdefault(r["condition"], []).append(r["label"])
    return {c: sorted(v) for c, v in seen.items()}


def fit(rows: DataFrame, specs: list[Spec], sizes: dict[str, int] | int, tolerance: float = 1e-4) -> list[Model]:
    """Fit every spec on rows (condition, label, weight, features); ``sizes``: features of a condition, or of all.

    A fit ends when the largest entry of the gradient has fallen to ``tolerance`` of its first value. Rows whose label or
    features are null teach nothing. With one class that class is always predicted; without rows a ValueError is raised.
    """
    rows = rows.where("label IS NOT NULL AND features IS NOT NULL")
    blocked, tasks = dealt(blocks(rows), ["at", "entry"])
    try:
        seen = _labels(blocked, MOST_CLASSES * max(1, len(specs)) + 1)
        return descend(specs, seen, sizes, tolerance, lambda models: _pass(blocked, tasks, models))
    finally:
        release(blocked)


def descend(
    specs: list[Spec], seen: dict[str, list[float]], sizes: dict[str, int] | int, tolerance: float, sums_at: Callable[[list[Model]], list[tuple[float, np.ndarray]]]
) -> list[Model]:
    """Models fitted by ``sums_at``, which gives the summed loss and flat gradient of models at their points; ``seen``: labels of a condition."""
    walks = []
    for spec in specs:
        classes = seen.get(spec.condition, [])
        if not classes:
            raise ValueError(f"no training rows for {spec.name} ({spec.condition})")
        if len(classes) > MOST_CLASSES:
            raise ValueError(f"over {MOST_CLASSES} labels")
        size = sizes if isinstance(sizes, int) else sizes[spec.condition]
        width = len(classes) if spec.loss == "softmax" or len(classes) > 2 else 1
        if spec.loss == "logistic" and width > 1:
            spec = Spec(spec.name, "softmax", spec.condition, spec.c, spec.penalise_shift, spec.most_steps)
        if len(classes) == 1:
            width = 0
        walks.append(_Walk(Model(spec, classes, np.zeros((size, width)), np.zeros(width)), np.zeros(size * width + width)))
    moving = [w for w in walks if w.x.size]
    while moving:
        values = sums_at([w.place() for w in moving])
        moving = [w for w, (loss, gradient) in zip(moving, values, strict=True) if not w.see(loss, gradient, tolerance)]
    out = []
    for w in walks:
        w.direction = None
        done = w.place()
        done.steps, done.slope = w.steps, 0.0 if w.g is None else float(np.abs(w.g).max(initial=0))
        out.append(done)
    return out


def scores(model: Model, rows: np.ndarray, at: np.ndarray, entry: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(predicted class, probability of the last class; NaN where the model gives none)."""
    return decided(model, None if len(model.classes) == 1 else _margins(rows, at, entry, n, model.weights, model.shift), n)


def decided(model: Model, z: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`scores` of ``n`` rows' margins, which a model of one class has none of."""
    classes = np.array(model.classes)
    if len(classes) == 1:
        return np.full(n, classes[0]), np.full(n, np.nan)
    if z.shape[1] == 1:
        p = np.exp(-np.logaddexp(0.0, -z[:, 0])) if model.spec.loss == "logistic" else np.full(n, np.nan)
        return classes[(z[:, 0] > 0).astype(int)], p
    if model.spec.loss == "softmax":
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return classes[z.argmax(axis=1)], (e / e.sum(axis=1, keepdims=True))[:, 1]
    return classes[z.argmax(axis=1)], np.full(n, np.nan)


def predict(rows: DataFrame, models: list[Model], keep: list[str]) -> DataFrame:
    """A row per row and model of its condition: ``keep``, model, prediction and probability of the second class."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    slim = rows.select(*keep, "condition", "features")
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            conditions = np.array(batch.column(n_keep).to_pylist(), dtype=object)
            rows, at, entry = csr(batch.column(n_keep + 1))
            for m in shared.value:
                mine = np.flatnonzero(conditions == m.spec.condition)
                if not len(mine):
                    continue
                # Features are numbered within their condition.
                place = np.full(batch.num_rows, -1)
                place[mine] = np.arange(len(mine))
                own = place[rows] >= 0
                label, p = scores(m, place[rows[own]], at[own], entry[own], len(mine))
                columns = [batch.column(i).take(pa.array(mine)) for i in range(n_keep)]
                made = [pa.array([m.spec.name] * len(mine)), pa.array(label.astype(np.int32), pa.int32()), pa.array(p, pa.float64(), mask=np.isnan(p))]
                yield pa.RecordBatch.from_arrays([*columns, *made], [*keep, "model", "prediction", "probability"])

    added = [T.StructField("model", T.StringType()), T.StructField("prediction", T.IntegerType()), T.StructField("probability", T.DoubleType())]
    return slim.mapInArrow(run, T.StructType([*slim.schema.fields[:n_keep], *added]))
