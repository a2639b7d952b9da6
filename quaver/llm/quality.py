"""Document quality with a byte-level convolutional network in numpy.

Bytes are embedded and filtered with several widths over the whole document. Filter responses are max-pooled over
overlapping chunks that cover every byte, a learned layer turns each chunk into one logit, and a small
logistic layer combines the logits of all chunks of a document (mean, largest, smallest, number) into
one probability. Nothing but the bytes of the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.llm.common import stored, text_groups

#: Bytes pooled into one chunk, and bytes from one chunk's start to the next: neighbours share a quarter.
CHUNK, STRIDE = 256, 192
WIDTHS = (2, 4, 6)
FILTERS = 16
DIM = 8
#: Positions filtered at once.
BLOCK = 1 << 15
_SPAN = max(WIDTHS)
_BLANK = 0x20
_TOTAL = FILTERS * len(WIDTHS)


@dataclass
class QualityNet:
    """``embed`` 256 x DIM, ``filters`` (span x DIM) x all filters (zero beyond a filter's width), one logit per chunk.

    ``combine`` holds the document layer: four weights and a shift; ``centre`` and ``scale`` standardise its inputs.
    """

    embed: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray
    combine: np.ndarray = field(default_factory=lambda: np.zeros(5))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(4))
    scale: np.ndarray = field(default_factory=lambda: np.ones(4))

    def responses(self, padded: np.ndarray) -> np.ndarray:
        """Filter responses at each position that has ``_SPAN`` bytes from it on."""
        e = self.embed[padded].reshape(-1)
        view = np.lib.stride_tricks.sliding_window_view(e, _SPAN * DIM)[::DIM]
        return view @ self.filters

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.shift, 0) @ self.out + self.out_shift[0]

    def probability(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.centre) / self.scale
        return _sigmoid(x @ self.combine[:4] + self.combine[4])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


def chunk_bounds(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, last byte + 1) of the chunks of texts of these sizes; an empty text has one of one blank."""
    sizes = np.maximum(sizes, 1)
    counts = np.maximum(1, -(-(sizes - (CHUNK - STRIDE)) // STRIDE))
    owner = np.repeat(np.arange(len(sizes)), counts)
    start = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
    return owner, start, np.minimum(start + CHUNK, sizes[owner])


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with blanks after each, so that no filter sees two texts, and where each text starts."""
    sizes = np.diff(offsets)
    room = np.maximum(sizes, 1) + _SPAN
    starts = np.cumsum(room) - room
    out = np.full(int(room.sum()), _BLANK, np.uint8)
    out[np.arange(len(data)) + np.repeat(starts - offsets[:-1], sizes)] = data
    return out, starts


def chunk_logits(net: QualityNet, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, logit) of every chunk. Each position is filtered once and pooled into the one or two chunks that hold it."""
    padded, starts = _spaced(data, offsets)
    owner, first, last = chunk_bounds(np.diff(offsets))
    first, last = first + starts[owner], last + starts[owner]
    out = np.empty(len(owner))
    lo = 0
    while lo < len(owner):
        hi = max(lo + 1, int(np.searchsorted(last, first[lo] + BLOCK, "right")))
        base = first[lo]
        z = net.responses(padded[base : last[hi - 1] + _SPAN - 1])
        edges = np.stack([first[lo:hi] - base, last[lo:hi] - base], axis=1).reshape(-1)
        # The last edge may be the array's end, which reduceat takes as given by leaving it out.
        pooled = np.maximum.reduceat(z, edges[:-1] if edges[-1] == len(z) else edges, axis=0)[::2]
        out[lo:hi] = net.logits(pooled)
        lo = hi
    return owner, out


def document_features(net: QualityNet, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean, largest and smallest chunk logit and the log of the number of chunks, per text."""
    owner, logit = chunk_logits(net, data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(owner, minlength=n)
    begins = np.cumsum(counts) - counts
    return np.stack(
        [
            np.bincount(owner, logit, minlength=n) / counts,
            np.maximum.reduceat(logit, begins),
            np.minimum.reduceat(logit, begins),
            np.log(counts),
        ],
        axis=1,
    )


def train_chunks(windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, epochs: int = 4, seed: int = 11, rate: float = 2e-3) -> QualityNet:
    """Fit the filters and the chunk layer by Adam on mini-batches; both classes weigh alike.

    ``windows`` hold CHUNK + span - 1 bytes each, of which the first ``lengths`` positions are pooled.
    """
    rng = np.random.default_rng(seed)
    used = np.zeros((_SPAN * DIM, _TOTAL), np.float32)
    for i, width in enumerate(WIDTHS):
        used[: width * DIM, i * FILTERS : (i + 1) * FILTERS] = 1
    net = QualityNet(
        rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        (rng.normal(0, 0.2, (_SPAN * DIM, _TOTAL)) * used).astype(np.float32),
        np.zeros(_TOTAL, np.float32),
        rng.normal(0, 0.1, _TOTAL).astype(np.float32),
        np.zeros(1, np.float32),
    )
    weight = (len(labels) / np.maximum(np.bincount(labels, minlength=2), 1) / 2).astype(np.float32)
    params = [net.embed, net.filters, net.shift, net.out, net.out_shift]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, places = 0, np.arange(CHUNK)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), 64):
            rows = order[lo : lo + 64]
            x, y, n = windows[rows], labels[rows], len(rows)
            e = net.embed[x].reshape(n, -1)
            patches = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(e, _SPAN * DIM, axis=1)[:, ::DIM])
            z = (patches.reshape(n * CHUNK, -1) @ net.filters).reshape(n, CHUNK, _TOTAL)
            z[places >= lengths[rows][:, None]] = -np.inf
            at = z.argmax(axis=1)
            pooled = np.take_along_axis(z, at[:, None], axis=1)[:, 0] + net.shift
            h = np.maximum(pooled, 0)
            d = ((_sigmoid(h @ net.out + net.out_shift[0]) - y) * weight[y] / n).astype(np.float32)
            dh = d[:, None] * net.out * (pooled > 0)
            # Each filter's gradient comes from the one place at which it was largest.
            chosen = patches[np.arange(n)[:, None], at]
            d_filters = np.einsum("nf,nfd->df", dh, chosen, optimize=True) * used
            d_patch = (dh[:, :, None] * net.filters.T[None]).reshape(n * _TOTAL, _SPAN, DIM)
            d_embed = np.zeros_like(net.embed)
            text_at = np.repeat(np.arange(n), _TOTAL)
            for k in range(_SPAN):
                np.add.at(d_embed, x[text_at, at.ravel() + k], d_patch[:, k])
            step += 1
            grads = [d_embed, d_filters, dh.sum(0), h.T @ d, d.sum(keepdims=True)]
            for i, (w, g) in enumerate(zip(params, grads, strict=True)):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                w -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit_combination(net: QualityNet, features: np.ndarray, labels: np.ndarray, weights: np.ndarray, ridge: float = 1.0) -> None:
    """Fit the document layer: weighted logistic regression on standardised features by Newton's method."""
    net.centre = features.mean(axis=0)
    net.scale = np.maximum(features.std(axis=0), 1e-6)
    x = np.column_stack([(features - net.centre) / net.scale, np.ones(len(features))])
    penalty = np.diag([ridge] * 4 + [1e-3])
    beta = np.zeros(5)
    for _ in range(50):
        p = _sigmoid(x @ beta)
        gradient = x.T @ (weights * (p - labels)) + penalty @ beta
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        beta -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    net.combine = beta


def _sampled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, texts_per_label: int, seed: int) -> tuple[DataFrame, dict[int, float]]:
    """About ``texts_per_label`` labelled texts of each label, never over twice as many, and how many rows each stands for."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(label).cast("int").alias("label")).distinct()
    counts = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    draw = F.pmod(F.xxhash64("__key", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    parts = []
    for value, count in sorted(counts.items()):
        chosen = known.where((F.col("label") == value) & (draw < min(1.0, texts_per_label / count))).limit(2 * texts_per_label)
        rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(chosen), "__key")  # 2 * texts_per_label keys
        parts.append(rows.select("label", "text").limit(2 * texts_per_label))
    if not parts:
        return docs.sparkSession.createDataFrame([], "label INT, text STRING"), {}
    sample = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    return stored(sample, "quality-sample"), {v: c / min(c, texts_per_label) for v, c in counts.items()}


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    texts_per_label: int = 2000,
    chunks_per_text: int = 6,
    seed: int = 11,
) -> QualityNet:
    """Train on about ``texts_per_label`` labelled texts of each label.

    The sample is drawn by a hash of the key among ``labels`` (at most twice that number is kept), so that one text
    with many copies neither fills it nor is left out whole. The filters learn from at most ``chunks_per_text`` chunks of each
    text, spread evenly over it; the document layer learns from all chunks of the sampled texts, weighted back to
    the labels' shares. Rows without key or with a label other than 0 and 1 teach nothing. With no usable row the
    network says 0.5, with one label that label's side.
    """
    sample, stands_for = _sampled(docs, labels, key, text, label, texts_per_label, seed)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_groups(batch):
                padded, starts = _spaced(data, offsets)
                padded = np.concatenate([padded, np.full(CHUNK, _BLANK, np.uint8)])
                owner, begin, end = chunk_bounds(np.diff(offsets))
                count = np.bincount(owner, minlength=last - first)
                nth = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
                m = np.minimum(count, chunks_per_text)[owner]
                kept = np.flatnonzero((nth * m) // count[owner] != ((nth - 1) * m) // count[owner])
                at = (starts[owner] + begin)[kept]
                size = (end - begin)[kept]
                room = np.arange(CHUNK + _SPAN - 1)
                # What follows the chunk is its text's next bytes, or blanks at the text's end.
                left = np.maximum(np.diff(offsets), 1)[owner][kept] - begin[kept]
                cut = np.where(room < left[:, None], padded[np.minimum(at[:, None] + room, len(padded) - 1)], _BLANK).astype(np.uint8)
                own = batch.column(0).slice(first, last - first).take(pa.array(owner[kept]))
                yield pa.RecordBatch.from_arrays([own, pa.array(size, pa.int32()), pa.array([w.tobytes() for w in cut], pa.binary())], ["label", "size", "window"])

    seen = sample.mapInArrow(windows, "label INT, size INT, window BINARY").toPandas()
    if not len(seen):
        return QualityNet(*_untrained())
    # Arrow batches arrive in no fixed order.
    seen = seen.sort_values(["label", "window", "size"])
    codes = seen["label"].to_numpy(np.int64)
    net = train_chunks(np.frombuffer(b"".join(map(bytes, seen["window"])), np.uint8).reshape(len(seen), -1), seen["size"].to_numpy(), codes, seed=seed)
    known = sample.mapInArrow(_features(net, sample), "label INT, f0 DOUBLE, f1 DOUBLE, f2 DOUBLE, f3 DOUBLE").toPandas()
    known = known.sort_values(list(known.columns))
    y = known["label"].to_numpy(np.float64)
    fit_combination(net, known[["f0", "f1", "f2", "f3"]].to_numpy(), y, np.array([stands_for[int(v)] for v in y]))
    return net


def _untrained():
    return np.zeros((256, DIM), np.float32), np.zeros((_SPAN * DIM, _TOTAL), np.float32), *[np.zeros(_TOTAL, np.float32)] * 2, np.zeros(1, np.float32)


def _features(net: QualityNet, sample: DataFrame):
    shared = sample.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_groups(batch):
                columns = [pa.array(c) for c in document_features(shared.value, data, offsets).T]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *columns], ["label", "f0", "f1", "f2", "f3"])

    return run


def score_quality(docs: DataFrame, net: QualityNet, text: str = "text") -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1, higher: label 1 likelier).

    Every byte of every text is read, in groups of bounded size; null and empty texts count as one blank. Rows are scored
    alone, so repeated rows get equal scores; an empty table stays empty. Other columns are kept; one named
    ``quality_score`` is replaced. No shuffle.
    """
    kept = [c for c in docs.columns if c != "quality_score"]
    place = kept.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            score = np.empty(batch.num_rows)
            for first, last, data, offsets in text_groups(batch.select([place]).rename_columns(["text"])):
                score[first:last] = model.probability(document_features(model, data, offsets))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(score)], [*kept, "quality_score"])

    slim = docs.select(*kept)
    return slim.mapInArrow(run, T.StructType([*slim.schema.fields, T.StructField("quality_score", T.DoubleType())]))
