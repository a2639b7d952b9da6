"""Language identification with a byte convolutional network.

Bytes are embedded, filtered with several widths, max-pooled over a window and classified by softmax.
The network is trained in numpy on a bounded, balanced sample of labelled windows; texts are cut into
fixed-length windows that cover them whole and are classified in batches. A text's score is the
softmax of the mean log-probability over its windows that hold letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.llm.common import text_groups

UNKNOWN = "und"
WINDOW = 64
WIDTHS = (2, 3, 4, 5)
FILTERS = 12
DIM = 8
#: Windows classified at once.
BATCH = 512
_SPAN = max(WIDTHS)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = True
_LETTER[0xC3:0xF5] = True


@dataclass
class ByteNet:
    """``embed`` 256 x DIM, ``filters`` (span x DIM) x all filters (zero beyond a filter's width), softmax layer."""

    labels: list[str]
    embed: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray

    def pooled(self, windows: np.ndarray, places_too: bool = False):
        n = len(windows)
        places = WINDOW - _SPAN + 1
        e = self.embed[windows]
        view = np.lib.stride_tricks.sliding_window_view(e.reshape(n, WINDOW * DIM), _SPAN * DIM, axis=1)[:, ::DIM]
        patches = np.ascontiguousarray(view).reshape(n * places, _SPAN * DIM)
        z = (patches @ self.filters).reshape(n, places, -1)
        at = z.argmax(axis=1) if places_too else None
        return z.max(axis=1) + self.shift, at, patches

    def log_probs(self, windows: np.ndarray) -> np.ndarray:
        z, _, _ = self.pooled(windows)
        return _log_softmax(np.maximum(z, 0) @ self.out + self.out_shift)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 letters in lower case (UTF-8: C3 80-9E after a C3)."""
    out = _FOLD[data]
    if len(data) > 1:
        upper = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][upper] += 0x20
    return out


def text_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts (blank-padded, only those with letters) and the text of each."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[owner] + nth * WINDOW
    length = np.minimum(WINDOW, offsets[owner + 1] - starts)
    padded = np.concatenate([folded(data), np.full(WINDOW, 0x20, np.uint8)])
    at = starts[:, None] + np.arange(WINDOW)
    windows = np.where(np.arange(WINDOW) < length[:, None], padded[at], 0x20).astype(np.uint8)
    held = _LETTER[windows].any(axis=1)
    return windows[held], owner[held]


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], epochs: int = 6, seed: int = 7, rate: float = 2e-3) -> ByteNet:
    """Fit by Adam on mini-batches; classes weigh alike."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    used = np.zeros((_SPAN * DIM, total), np.float32)
    for i, width in enumerate(WIDTHS):
        used[: width * DIM, i * FILTERS : (i + 1) * FILTERS] = 1
    net = ByteNet(
        names,
        rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        (rng.normal(0, 0.2, (_SPAN * DIM, total)) * used).astype(np.float32),
        np.zeros(total, np.float32),
        rng.normal(0, 0.1, (total, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    weight = (len(labels) / np.maximum(np.bincount(labels, minlength=len(names)), 1) / len(names)).astype(np.float32)
    params = [net.embed, net.filters, net.shift, net.out, net.out_shift]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, places = 0, WINDOW - _SPAN + 1
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), 128):
            rows = order[lo : lo + 128]
            x, y = windows[rows], labels[rows]
            n = len(rows)
            z, at, patches = net.pooled(x, places_too=True)
            h = np.maximum(z, 0)
            p = np.exp(_log_softmax(h @ net.out + net.out_shift))
            p[np.arange(n), y] -= 1
            p *= weight[y][:, None] / n
            dh = (p @ net.out.T) * (z > 0)
            # Each filter's gradient comes from the one place at which it was largest.
            place = (np.arange(n)[:, None] * places + at).ravel()
            chosen = patches[place].reshape(n, total, -1)
            d_filters = np.einsum("nf,nfd->df", dh, chosen, optimize=True) * used
            d_patch = (dh[:, :, None] * net.filters.T[None]).reshape(n * total, _SPAN, DIM)
            d_embed = np.zeros_like(net.embed)
            text_at = np.repeat(np.arange(n), total)
            for k in range(_SPAN):
                np.add.at(d_embed, x[text_at, at.ravel() + k], d_patch[:, k])
            step += 1
            for i, (w, g) in enumerate(zip(params, [d_embed, d_filters, dh.sum(0), h.T @ p, p.sum(0)], strict=True)):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.001 * (g * g - second[i])
                w -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fit_languages(labelled: DataFrame, text: str = "text", label: str = "lang", texts_per_label: int = 1500, windows_per_text: int = 4, seed: int = 7) -> ByteNet:
    """Train on about ``texts_per_label`` texts of each label and at most ``windows_per_text`` windows of each.

    The sample is drawn by a hash of the text, and windows are spread evenly over the text, so that it
    is bounded whatever the size of the table. Rows without label or letters are left out.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(label).alias("label"), F.col(text).alias("text"))
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return ByteNet([], *[np.zeros((1, 1), np.float32)] * 5)
    names = sorted(counts)
    share = F.create_map(*[F.lit(v) for n in names for v in (n, min(1.0, texts_per_label / counts[n]))])
    draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_groups(batch, "text"):
                windows, owner = text_windows(data, offsets)
                count = np.bincount(owner, minlength=last - first)
                start = np.cumsum(count) - count
                nth = np.arange(len(owner)) - start[owner]
                # The k-th of m windows to keep of n is the one at k * n // m.
                m = np.minimum(count, windows_per_text)[owner]
                kept = (nth * m) // count[owner] != ((nth - 1) * m) // count[owner]
                labels = batch.column(0).slice(first, last - first).take(pa.array(owner[kept]))
                yield pa.RecordBatch.from_arrays([labels, pa.array([w.tobytes() for w in windows[kept]], pa.binary())], ["label", "window"])

    sample = rows.where(draw < share[F.col("label")]).mapInArrow(spread, "label STRING, window BINARY").toPandas()
    limit = texts_per_label * windows_per_text
    sample = sample.sort_values(["label", "window"]).groupby("label", group_keys=False).sample(frac=1, random_state=seed).groupby("label").head(limit)
    windows = np.frombuffer(b"".join(map(bytes, sample["window"])), np.uint8).reshape(-1, WINDOW)
    codes = np.searchsorted(np.array(names), sample["label"].to_numpy(str))
    return train(windows, codes, names, seed=seed)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict_languages(docs: DataFrame, net: ByteNet, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (0 to 1).

    Null texts and texts without a letter are ``und`` with score 0; so is every text if nothing was
    learned. Whole texts are read, in windows of a fixed length, a bounded number at a time; letters outside
    the windows' alphabet test (first bytes of UTF-8 sequences) count as any other byte. Rows and other columns are kept; columns
    of those two names are replaced. No shuffle.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "__letter")]
    place = kept.index(text)
    names = net.labels
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            known = np.array(batch.column(len(kept)).to_pylist(), dtype=bool)
            sums, counts = np.zeros((n, max(1, len(names)))), np.zeros(n)
            for first, last, data, offsets in text_groups(batch.select([place]).rename_columns(["text"]), "text") if names else ():
                windows, owner = text_windows(data, offsets)
                for lo in range(0, len(windows), BATCH):
                    logs = model.log_probs(windows[lo : lo + BATCH])
                    own = owner[lo : lo + BATCH]
                    for k in range(len(names)):
                        sums[first:last, k] += np.bincount(own, logs[:, k], minlength=last - first)
                    counts[first:last] += np.bincount(own, minlength=last - first)
            p = np.exp(_log_softmax(sums / np.maximum(counts, 1)[:, None]))
            best = p.argmax(axis=1)
            known &= bool(names)
            pred = [names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            score = np.where(known, p[np.arange(n), best], 0.0)
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*kept, "lang_pred", "lang_score"])

    slim = docs.select(*kept, has_letter(F.col(text)).alias("__letter"))
    schema = T.StructType([*slim.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return slim.mapInArrow(run, schema)
