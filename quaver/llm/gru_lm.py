"""Log-likelihood of whole documents under a gated recurrent language model.

Word counts come from all training documents. The most frequent words, buckets of rarer words by their last
bytes, and the end of a text are the model's symbols; its softmax is factored into classes of symbols. A word
of a bucket has its share of the bucket's counts (add one), so every text has a probability. The network
is trained on every token of all training documents, in numpy by truncated backpropagation, in rounds: learners on all executors
start from the same weights, each goes over stretches of its own, and their weights are averaged. At scoring, texts run side by side in lanes, window by window,
and the state is carried over until a text ends.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import drop, lower_ascii, mixed, signed, span_hashes, stored, text_groups, word_bounds
from quaver.operators.passes import sums

CLASSES = 64
PER_CLASS = 64
SYMBOLS = CLASSES * PER_CLASS
BUCKETS = 256  # a byte, see ``_counted``
#: Words with a symbol of their own; then come the buckets, and last the end of a text.
OWN_WORDS = SYMBOLS - BUCKETS - 1
END = SYMBOLS - 1
#: Words at most whose counts go to all executors (16 bytes each); counts of the others are joined.
SHARED_WORDS = 131_072
#: Bytes of a stretch: a text is cut into stretches of words, wherever it is long.
STRETCH = 4096
#: Learning rates of the rounds; each round has stretches of its own.
RATES = (8e-3, 4e-3, 2e-3)
#: Tokens a learner holds at once.
BLOCK = 1 << 19
#: Lanes of a learner, at least and at most: more where it has more tokens, so that its steps don't get fewer than about 250 a round.
LANES = (64, 256)
EMBED, HIDDEN = 16, 32
#: Bytes of texts that run side by side, and of those whose words are cut at once, in a core's cache.
GROUP, CACHED = 4 << 20, 1 << 18
#: Rows whose output layers are worked on together, in a core's cache too.
ROWS = 1024

COUNTS = "word BIGINT, bucket INT, c BIGINT"

#: Of the last two bytes of a word.
_BUCKET = (mixed(np.arange(1 << 16, dtype=np.uint64), 21) % np.uint64(BUCKETS)).astype(np.int32)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit names (equal names of different words: one in 10^5 for 10^7 words), buckets, and each text's first word."""
    return _words(data, offsets)[1:]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words' starts, and what :func:`words_of` gives."""
    if len(data) <= CACHED or len(offsets) <= 2:
        return _cut(data, offsets)
    found, first, at, n = [], [np.zeros(1, np.int64)], 0, 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CACHED, "right")) - 1)
        starts, names, bucket, own = _cut(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        found.append((starts + offsets[at], names, bucket))
        first.append(own[1:] + n)
        at, n = to, n + len(names)
    return *map(np.concatenate, zip(*found, strict=True)), np.concatenate(first)


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = lower_ascii(data)
    starts, ends, first = word_bounds(data, offsets)
    last = data[ends - 1].astype(np.int64) if len(ends) else np.zeros(0, np.int64)
    before = np.where(ends - starts > 1, data[ends - 2], 0).astype(np.int64) if len(ends) else last
    bucket = _BUCKET.take(before << 8 | last)
    return starts, signed(span_hashes(data, starts, ends)), bucket, first


def _counted(names: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct names, their buckets and counts."""
    # Sorting numbers alone is much faster than their order: buckets take the place of the lowest byte, unless names need it.
    ranked = np.sort(names)
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)])
    word, count = ranked[first], np.diff(np.append(first, len(ranked)))
    if (word[1:] >> 8 == word[:-1] >> 8).any():
        word, at, count = np.unique(names, return_index=True, return_counts=True)
        return word, bucket[at], count
    return word, (np.sort(names >> 8 << 8 | bucket)[first] & 255).astype(np.int32), count


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word``, ``bucket``, ``c`` over all texts; words are counted per group of texts before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_groups(batch, "text", GROUP):
                names, bucket, _ = words_of(data, offsets)
                yield pa.RecordBatch.from_arrays([*map(pa.array, _counted(names, bucket))], ["word", "bucket", "c"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, COUNTS).groupBy("word").agg(F.max("bucket").alias("bucket"), F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Shared counts (sorted by name), symbols of the most frequent, and what buckets hold."""

    words: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray  # of ``words``; -1: by bucket
    rest_tokens: np.ndarray  # by bucket, of words without a symbol of their own
    rest_words: np.ndarray
    tokens: int  # N
    distinct: int  # V
    texts: int

    @cached_property
    def slots(self) -> np.ndarray:
        """Where the words of each leading part of a name begin."""
        return np.concatenate([[0], np.cumsum(np.bincount(_slot(self.words), minlength=1 << 20))]).astype(np.int32)

    def look_up(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and symbols; -1 where the word isn't shared."""
        counts, symbols = np.full(len(names), -1), np.full(len(names), -1)
        if not len(self.words):
            return counts, symbols
        for first in range(0, len(names), CACHED // 8):
            part = slice(first, first + CACHED // 8)
            some = names[part]
            slot = _slot(some)
            at, end = self.slots.take(slot), self.slots.take(slot + 1)
            hit = (at < end) & (self.words.take(at, mode="clip") == some)
            left = np.flatnonzero(~hit & (at + 1 < end))
            while len(left):
                at[left] += 1
                same = self.words[at[left]] == some[left]
                hit[left[same]] = True
                left = left[~same & (at[left] + 1 < end[left])]
            missed = np.flatnonzero(~hit)
            for out, of in ((counts, self.counts), (symbols, self.symbols)):
                of.take(at, out=out[part], mode="clip")
                out[part][missed] = -1
        return counts, symbols


def _slot(names: np.ndarray) -> np.ndarray:
    return (names >> 44) + (1 << 19)


def build_vocabulary(counts: DataFrame, texts: int) -> Vocabulary:
    """From stored counts: a bounded number of words and bucket sums come to the driver.

    Shared are the words above a frequency, the least one at which they aren't too many, and of the next grade about as
    many as still fit, by a hash. Frequencies are read off a histogram of logarithms, so no task sends more than its part of them.
    """
    grade = F.floor(F.log2("c") * 64).cast("int")
    cut, held, part = 1 << 20, 0, 0
    for value, n in sorted(map(tuple, counts.groupBy(grade.alias("g")).count().collect()), reverse=True):
        if held + n > SHARED_WORDS:
            part = int((SHARED_WORDS - held) / n * (1 << 20))
            break
        held += n
        cut = value
    of_next = (grade == (cut - 1 if not part else value)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < part)
    top = counts.where((grade >= cut) | of_next).toPandas().sort_values(["c", "word"], ascending=[False, True], ignore_index=True)
    words, c = top["word"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    symbols = np.where(np.arange(len(words)) < OWN_WORDS, np.arange(len(words)), -1)
    sums = counts.groupBy("bucket").agg(F.sum("c"), F.count("*")).collect()
    tokens, distinct = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b, total, n in sums:
        tokens[b], distinct[b] = total, n
    n_all, v_all = int(tokens.sum()), int(distinct.sum())
    own = top.head(OWN_WORDS)
    tokens -= np.bincount(own["bucket"].to_numpy(np.int64), own["c"].to_numpy(np.float64), minlength=BUCKETS).astype(np.int64)
    distinct -= np.bincount(own["bucket"].to_numpy(np.int64), minlength=BUCKETS)
    order = np.argsort(words)
    return Vocabulary(words[order], c[order], symbols[order], tokens, distinct, n_all + texts, v_all + (texts > 0), texts)


def _exponents(logits: Callable[[], np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of rows of logits, in their place; the rows' sums, and the natural log-probabilities at ``at`` (places in all of them)."""
    with np.errstate(over="ignore"):
        x = logits()
        np.exp(x, out=x)
        total, picked = x @ np.ones(x.shape[1], x.dtype), x.ravel().take(at)
    # Softmax needs no shift while no exponential that counts overflows or vanishes.
    if not (total.max() < 1e26 and picked.min() > 1e-26):
        x = logits()
        x -= x.max(axis=1, keepdims=True)
        logs = x.ravel().take(at)
        np.exp(x, out=x)
        total = x @ np.ones(x.shape[1], x.dtype)
        return x, total, logs - np.log(total)
    return x, total, np.log(picked / total)


def _parts(x: np.ndarray) -> np.ndarray:
    """What belongs to the two gates and the candidate, one after the other; the gates' with the sign that exp(-x) needs."""
    parts = x.reshape(len(x), 3, HIDDEN).swapaxes(0, 1).copy()  # of weights too, which must stay as they are
    np.negative(parts[:2], out=parts[:2])
    return parts


class Room:
    """Arrays that one window after the other uses: new ones of their size would cost a page fault for every 4 KB."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int, kind: type = np.float32) -> np.ndarray:
        """An array of any content, up to the next call with this name."""
        size = math.prod(shape)
        if name not in self.held or len(self.held[name]) < size or self.held[name].dtype != kind:
            self.held[name] = np.empty(size, kind)
        return self.held[name][:size].reshape(shape)

    def __reduce__(self):
        return Room, ()


class Gru:
    """Embedding, gated recurrent layer, class softmax and softmax within each class."""

    NAMES = ("embed", "inp", "rec", "shift", "cls", "cls_shift", "word", "word_shift")

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        n = lambda *s, f: rng.normal(0, f, s).astype(np.float32)
        self.embed, self.inp, self.rec = n(SYMBOLS, EMBED, f=0.3), n(EMBED, 3 * HIDDEN, f=0.25), n(HIDDEN, 3 * HIDDEN, f=0.15)
        self.shift = np.zeros(3 * HIDDEN, np.float32)
        self.cls, self.cls_shift = n(HIDDEN, CLASSES, f=0.1), np.zeros(CLASSES, np.float32)
        self.word, self.word_shift = n(CLASSES, HIDDEN, PER_CLASS, f=0.1), np.zeros((CLASSES, PER_CLASS), np.float32)
        self.room = Room()

    def start_from(self, frequency: np.ndarray) -> None:
        """Output shifts at the symbols' overall frequencies."""
        p = (frequency + 1.0).reshape(CLASSES, PER_CLASS)
        self.cls_shift = np.log(p.sum(1) / p.sum()).astype(np.float32)
        self.word_shift = np.log(p / p.sum(1, keepdims=True)).astype(np.float32)

    def given(self) -> np.ndarray:
        """What each symbol gives to the gates and the candidate."""
        table = np.matmul(self.embed, _parts(self.inp), out=self.room("table", 3, SYMBOLS, HIDDEN))
        table += _parts(self.shift[None])
        return table

    def steps(self, x: np.ndarray, resets: np.ndarray, state: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after each of the inputs (time x lanes), and the last; ``resets`` empty a lane's state first."""
        out, last, _ = self.window(x, resets, state, _parts(table))
        return out.copy(), last

    def window(self, x: np.ndarray, resets: np.ndarray, state: np.ndarray, table: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """:meth:`steps` with the ``table`` of :meth:`given`; the states are in the room.

        Third, for learning (``keep``): for each time, the gates, what the state gives to the candidate, and the candidate; and the state before.
        """
        shape, times = state.shape, len(x) if keep else 1
        rec, out, given = _parts(self.rec), self.room("states", len(x), *shape), self.room("given", 3, *shape)
        kept, befores = self.room("kept", times, 4, *shape), self.room("befores", times, *shape)
        opened = resets.any(axis=1)
        with np.errstate(over="ignore"):  # of a gate that is shut
            for t in range(len(x)):
                one, before = kept[t if keep else 0], befores[t if keep else 0]
                gate, cand = one[:2], one[3]
                if opened[t]:
                    before[:] = state
                    before[resets[t]] = 0
                    state = before
                elif keep:
                    before[:] = state
                table.take(x[t], axis=1, out=given, mode="clip")
                np.matmul(state, rec, out=one[:3])
                gate += given[:2]
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
                np.multiply(gate[1], one[2], out=cand)
                cand += given[2]
                np.tanh(cand, out=cand)
                state = np.subtract(state, cand, out=out[t])
                state *= gate[0]
                state += cand
        return out, state.copy(), (kept, befores)

    def log_probs(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target, 0 where there is none (below 0); with ``grads``, also the states' gradient of the mean loss."""
        kind = np.where(targets < 0, CLASSES, targets // PER_CLASS).astype(np.uint8)
        order = np.argsort(kind, kind="stable")
        cuts = np.searchsorted(kind[order], np.arange(CLASSES + 1))
        order = order[: cuts[-1]]
        float_kind = np.result_type(states, self.cls)
        n, all_logs = len(order), np.zeros(len(targets), float_kind)
        kind, inner = kind[order], targets[order] % PER_CLASS
        h = states.take(order, axis=0, out=self.room("by_class", n, HIDDEN, kind=states.dtype), mode="clip")
        logs, back = np.empty(n, float_kind), None
        if grads is not None:
            grads |= {k: np.zeros_like(getattr(self, k)) for k in ("cls", "cls_shift", "word", "word_shift")}
            back = self.room("back", n, HIDDEN)
        # Classes go side by side while their rows are in a core's cache, and rows of a large class in parts.
        spans = [(c, a, min(a + ROWS, cuts[c + 1])) for c in range(CLASSES) for a in range(cuts[c], cuts[c + 1], ROWS)]
        while spans:
            at = next((i for i, (_, _, to) in enumerate(spans) if to - spans[0][1] > ROWS), len(spans))
            some, spans = spans[:at], spans[at:]
            self._class_log_probs(h, kind, inner, some, logs, grads, back)
        all_logs[order] = logs
        if grads is None:
            return all_logs, None
        place = np.full(len(targets), -1)
        place[order] = np.arange(n)
        d = back.take(place, axis=0, out=self.room("d_states", len(targets), HIDDEN), mode="clip")
        if n < len(targets):
            d[place < 0] = 0
        return all_logs, d

    def _class_log_probs(self, h: np.ndarray, kind: np.ndarray, inner: np.ndarray, spans: list, logs: np.ndarray, grads: dict | None, back: np.ndarray | None) -> None:
        """:meth:`log_probs` of ``spans`` (class, first row, last row + 1) of the rows by class."""
        first, last = spans[0][1], spans[-1][2]
        rows, begin = slice(first, last), np.arange(last - first)
        own = [(c, h[a:b], slice(a - first, b - first)) for c, a, b in spans]
        p, q = self.room("p", last - first, CLASSES, kind=logs.dtype), self.room("q", last - first, PER_CLASS, kind=logs.dtype)

        def of_class() -> np.ndarray:
            return np.add(np.matmul(h[rows], self.cls, out=p), self.cls_shift, out=p)

        def in_class() -> np.ndarray:
            for c, states, at in own:
                part = np.matmul(states, self.word[c], out=q[at])
                part += self.word_shift[c]
            return q

        p_at, q_at = begin * CLASSES + kind[rows], begin * PER_CLASS + inner[rows]
        _, p_total, p_logs = _exponents(of_class, p_at)
        _, q_total, q_logs = _exponents(in_class, q_at)
        np.add(p_logs, q_logs, out=logs[rows])
        if grads is None:
            return
        ones, share = np.ones(last - first, np.float32), np.float32(1 / len(logs))
        for x, total, at in ((p, p_total, p_at), (q, q_total, q_at)):
            x *= (share / total)[:, None]
            x.reshape(-1)[at] -= share
        grads["cls"] += h[rows].T @ p
        grads["cls_shift"] += ones @ p
        d, more = np.matmul(p, self.cls.T, out=back[rows]), self.room("by_word", last - first, HIDDEN)
        for c, states, at in own:
            grads["word"][c] += states.T @ q[at]
            grads["word_shift"][c] += ones[at] @ q[at]
            np.matmul(q[at], self.word[c].T, out=more[at])
        d += more

    def learn(self, x: np.ndarray, y: np.ndarray, resets: np.ndarray, state: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of one window, backpropagated to its first step; the state goes on to the next."""
        states, last, (kept, befores) = self.window(x, resets, state, self.given(), keep=True)
        grads: dict = {}
        logs, d_out = self.log_probs(states.reshape(-1, HIDDEN), y.ravel(), grads)
        d_out = d_out.reshape(states.shape)
        # To the gates, what the reset gate lets through of the state, and the candidate.
        d, weights = self.room("d", 4, *states.shape), np.ascontiguousarray(self.rec.reshape(HIDDEN, 3, HIDDEN).transpose(1, 2, 0))
        d_next, less, through = self.room("d_next", *state.shape), self.room("less", *state.shape), self.room("through", 3, *state.shape)
        d_next[:] = 0
        opened = resets.any(axis=1)
        for t in range(len(x) - 1, -1, -1):
            (z, r, hn, cand), before = kept[t], befores[t]
            into, slope, d_hn, one = d[:, t]
            dh = d_out[t]
            dh += d_next
            np.multiply(cand, cand, out=one)
            np.subtract(1, one, out=one)
            one *= dh
            np.subtract(before, cand, out=into)
            into *= dh
            into *= z
            dh *= z
            one -= np.multiply(one, z, out=less)
            into -= np.multiply(into, z, out=less)
            np.multiply(one, r, out=d_hn)
            np.multiply(d_hn, hn, out=slope)
            slope -= np.multiply(slope, r, out=less)
            np.matmul(d[:3, t], weights, out=through)
            np.add(dh, through[0], out=d_next)
            d_next += through[1]
            d_next += through[2]
            if opened[t]:
                d_next[resets[t]] = 0
        d, before, ids = d.reshape(4, -1, HIDDEN), befores.reshape(-1, HIDDEN), x.ravel()
        grads["rec"] = np.concatenate([before.T @ part for part in d[:3]], axis=1)
        d = [d[i] for i in (0, 1, 3)]
        ones, given = np.ones(len(ids), np.float32), self.embed.take(ids, axis=0, out=self.room("embedded", len(ids), EMBED, kind=self.embed.dtype), mode="clip")
        grads["shift"] = np.concatenate([ones @ part for part in d])
        grads["inp"] = np.concatenate([given.T @ part for part in d], axis=1)
        d_given, more = self.room("d_given", len(ids), EMBED), self.room("more", len(ids), EMBED)
        d_given[:] = 0
        for i, part in enumerate(d):
            d_given += np.matmul(part, self.inp[:, i * HIDDEN : (i + 1) * HIDDEN].T, out=more)
        grads["embed"] = np.zeros_like(self.embed)
        order = np.argsort(ids.astype(np.uint16), kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        grads["embed"][ids[order][first]] = np.add.reduceat(d_given.take(order, axis=0, out=more, mode="clip"), first)
        return grads, last, float(-logs.sum() / max(1, (y >= 0).sum()))


def _lanes(symbols: np.ndarray, sizes: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts dealt to lanes in order, about alike in tokens: first token and length of each lane, longest first."""
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    cuts = np.unique(np.concatenate([[0], ends[np.minimum(np.searchsorted(ends, total * np.arange(1, lanes) / lanes), len(ends) - 1)], [total]]))
    begin, length = cuts[:-1], np.diff(cuts)
    order = np.argsort(-length, kind="stable")
    return begin[order], length[order]


def score_texts(net: Gru, symbols: np.ndarray, sizes: np.ndarray, lanes: int = 256, window: int = 64) -> np.ndarray:
    """Natural log-probability of each text: ``sizes`` symbols each (1 at least, the end included), one after the other."""
    n = len(symbols)
    starts = np.cumsum(sizes) - sizes
    opens = np.zeros(n, dtype=bool)
    opens[starts] = True
    given = np.concatenate([[END], symbols[:-1]])
    given[starts] = END
    logs = np.zeros(n)
    table = net.given()
    begin, length = _lanes(symbols, sizes, lanes)
    state = np.zeros((len(begin), HIDDEN), np.float32)
    for at in range(0, int(length[0]), window):
        live = int((length > at).sum())
        steps = min(window, int(length[0]) - at)
        place = begin[:live] + at + np.arange(steps)[:, None]
        inside = at + np.arange(steps)[:, None] < length[:live]
        place = np.where(inside, place, 0)
        states, state, _ = net.window(given[place], opens[place] & inside, state[:live], table)
        found, _ = net.log_probs(states.reshape(-1, HIDDEN), np.where(inside, symbols[place], -1).ravel())
        logs[place[inside]] = found[inside.ravel()]
    return np.add.reduceat(logs, starts)


class Learner:
    """Adam over truncated windows; lanes carry their state from window to window."""

    def __init__(self, net: Gru, rate: float, lanes: int = 64, window: int = 32):
        self.net, self.rate, self.lanes, self.window, self.step = net, rate, lanes, window, 0
        self.first = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}
        self.second = {k: np.zeros_like(getattr(net, k)) for k in net.NAMES}

    def go_over(self, symbols: np.ndarray, sizes: np.ndarray, before: np.ndarray) -> None:
        """Stretches of ``sizes`` symbols each (1 at least), and the symbol ahead of each stretch: END if it opens its text."""
        starts = np.cumsum(sizes) - sizes
        opens = np.zeros(len(symbols), dtype=bool)
        opens[starts] = True
        given = np.concatenate([[END], symbols[:-1]])
        given[starts] = before
        begin, length = _lanes(symbols, sizes, self.lanes)
        state = np.zeros((len(begin), HIDDEN), np.float32)
        for at in range(0, int(length[0]), self.window):
            live = int((length > at).sum())
            steps = min(self.window, int(length[0]) - at)
            inside = at + np.arange(steps)[:, None] < length[:live]
            place = np.where(inside, begin[:live] + at + np.arange(steps)[:, None], 0)
            y = np.where(inside, symbols[place], -1)
            grads, state, _ = self.net.learn(given[place], y, opens[place] & inside, state[:live])
            self._follow(grads)

    def _follow(self, grads: dict) -> None:
        self.step += 1
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        scale = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        rate, root = np.float32(self.rate / (1 - 0.9**self.step)), np.float32(1 / math.sqrt(1 - 0.998**self.step))
        for k, g in grads.items():
            first, second, w = self.first[k], self.second[k], getattr(self.net, k)
            g *= scale
            change = np.subtract(g, first, out=self.net.room("change", *g.shape))
            change *= np.float32(0.1)
            first += change
            g *= g
            g -= second
            g *= np.float32(0.002)
            second += g
            np.sqrt(second, out=g)
            g *= root
            g += np.float32(1e-8)
            np.divide(first, g, out=change)
            change *= rate
            w -= change


def _symbols(names: np.ndarray, bucket: np.ndarray, first: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of texts with their ends, tokens per text, and the words' shared counts."""
    counts, own = vocabulary.look_up(names)
    own = np.where(own >= 0, own, OWN_WORDS + bucket)
    sizes = np.diff(first)
    ends = np.insert(own, first[1:], END)
    return ends, sizes + 1, counts


def stretches(training: DataFrame, vocabulary: Vocabulary, share: float = 1.0, learners: int = 1, text: str = "text", seed: int = 11) -> DataFrame:
    """``round``, ``learner``, ``rank``, ``before``, ``symbols``: the stretches of all texts (or a share of them), dealt by a hash of row and place.

    A text's words are in the stretch in which they start, and its end in the last. ``before`` is the symbol ahead of a stretch, END for a text's
    first, so that every token is to be predicted once. Rows alike in all columns are told apart by a running number in their batch, so that
    copies go to all learners.
    """
    shared = training.sparkSession.sparkContext.broadcast(vocabulary)
    rows = training.select(F.xxhash64(*[F.col(f"`{c}`") for c, kind in training.dtypes if not kind.startswith("map")], F.lit(seed)).alias("row"), F.col(text).alias("text"))
    limit = np.uint64(min(1.0, share) * ((1 << 64) - 1025))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, int] = {}
            named = batch.column(0).to_numpy().view(np.uint64)
            for first, last, data, offsets in text_groups(batch, "text", GROUP):
                n = np.maximum(1, -(-np.diff(offsets) // STRETCH))
                owner = np.repeat(np.arange(last - first), n)
                begin = np.cumsum(n) - n
                number = np.arange(len(owner)) - begin[owner]
                alike = np.zeros(last - first, np.uint64)
                for i, name in enumerate(named[first:last].tolist()):
                    alike[i] = seen[name] = seen.get(name, -1) + 1
                draws = mixed(mixed(named[first:last] + alike, 31)[owner] + number.astype(np.uint64), 32)
                starts, word, bucket, of = _words(data, offsets)
                symbols, sizes, _ = _symbols(word, bucket, of, shared.value)
                texts = np.repeat(np.arange(last - first), np.diff(of))
                held = np.bincount(begin[texts] + (starts - offsets[texts]) // STRETCH, minlength=len(owner))
                held[begin + n - 1] += 1
                ends = np.cumsum(held)
                before = np.where(number > 0, np.append(symbols, END)[ends - held - 1], END)
                deal = mixed(draws, 33)
                packed = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(np.insert(2 * ends, 0, 0).astype(np.int32)), pa.py_buffer(symbols.astype(np.int16))])
                columns = [
                    pa.array((deal % np.uint64(len(RATES))).astype(np.int32)),
                    pa.array((deal // np.uint64(8) % np.uint64(learners)).astype(np.int64)),
                    pa.array(signed(draws)),
                    pa.array(before.astype(np.int32)),
                    packed,
                ]
                made = pa.RecordBatch.from_arrays(columns, ["round", "learner", "rank", "before", "symbols"])
                yield made.filter(pa.array((held > 0) & (draws <= limit)))

    return rows.mapInArrow(run, "round INT, learner BIGINT, rank BIGINT, before INT, symbols BINARY")


def _flat(net: Gru) -> np.ndarray:
    return np.concatenate([getattr(net, k).ravel() for k in net.NAMES]).astype(np.float64)


def _unflat(weights: np.ndarray) -> Gru:
    net, at = Gru(), 0
    for k in net.NAMES:
        old = getattr(net, k)
        setattr(net, k, weights[at : at + old.size].astype(np.float32).reshape(old.shape))
        at += old.size
    return net


def _round(rows: DataFrame, net: Gru, rate: float, learners: int, lanes: int) -> Gru:
    """The average of the learners' weights, by their tokens; ``net`` where no stretch belongs to the round."""
    start = rows.sparkSession.sparkContext.broadcast(_flat(net))

    def run(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = np.zeros(len(start.value) + 1)
        one, name, tokens = None, None, 0
        held: list[tuple[np.ndarray, int]] = []

        def learn() -> None:
            if held:
                one.go_over(np.concatenate([h[0] for h in held]).astype(np.int64), np.array([len(h[0]) for h in held]), np.array([h[1] for h in held]))
                held.clear()

        def end() -> None:
            if one is not None:
                learn()
                total[:-1] += _flat(one.net) * tokens
                total[-1] += tokens

        size = 0
        for batch in batches:
            for learner, before, symbols in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                if learner != name:
                    end()
                    one, name, tokens, size = Learner(_unflat(start.value), rate, lanes), learner, 0, 0
                own = np.frombuffer(symbols, np.int16)
                held.append((own, before))
                tokens += len(own)
                size += len(own)
                if size >= BLOCK:
                    learn()
                    size = 0
        end()
        return {0: total}

    dealt = rows.repartitionById(learners, F.col("learner").cast("int")).sortWithinPartitions("learner", "rank", "symbols")
    total = sums(dealt.select("learner", "before", "symbols"), max(2, learners), run).get(0)
    return net if total is None or not total[-1] else _unflat(total[:-1] / total[-1])


def fit_model(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", seed: int = 11) -> Gru:
    """Train on all texts: each stretch is gone over once, in one of the rounds.

    A learner's tokens grow with the root of all, and so does the number of learners.
    """
    net = Gru(seed)
    if not vocabulary.tokens:
        return net
    tokens = float(vocabulary.tokens) / len(RATES)
    learners = max(1, round(tokens / max(BLOCK / 2, 256 * vocabulary.tokens**0.5)))
    lanes = int(np.clip(tokens / learners / (32 * 250), *LANES))
    rows = stored(stretches(docs, vocabulary, 1.0, learners, text, seed), "stretches")
    frequency = np.zeros(SYMBOLS)
    own = vocabulary.symbols >= 0
    frequency[vocabulary.symbols[own]] = vocabulary.counts[own]
    frequency[OWN_WORDS : OWN_WORDS + BUCKETS] = vocabulary.rest_tokens
    frequency[END] = vocabulary.texts
    net.start_from(frequency)
    for k, rate in enumerate(RATES):
        net = _round(rows.where(F.col("round") == k), net, rate, learners, lanes)
    drop(rows)
    return net


def score_documents(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` (both log10) of every row of ``docs``.

    ``training`` are the rows to learn from (column ``text``), all of them. Tokens are words ``[^\\x20\\x09-\\x0D]+``, ASCII letters in
    lower case, and one end per text; null texts count as empty. ``base_score`` is that of add-one word counts.
    Without training rows all words are unknown and the network is as it was initialised. Keys may be null or
    repeated, with equal or other texts: each row of ``docs`` is scored by itself. Empty tables give no rows, ties do not
    arise, and of ``docs`` other columns are not read.
    """
    spark = docs.sparkSession
    counts = stored(word_counts(training, text), "counts")
    vocabulary = build_vocabulary(counts, training.count())
    net = fit_model(training, vocabulary, text)
    model = spark.sparkContext.broadcast((vocabulary, net))
    kind = docs.schema[key].dataType.simpleString()
    names = ["__key", "n_tokens", "known", "base", "own", "rare"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, network = model.value
        all_words = np.log10(words.tokens + words.distinct + 1)
        in_bucket = np.log10(words.rest_tokens + words.rest_words + 1.0)
        end_count = np.log10(words.texts + 1)
        for batch in batches:
            for at, until, data, offsets in text_groups(batch, "text", GROUP):
                word, bucket, first = words_of(data, offsets)
                symbols, sizes, counted = _symbols(word, bucket, first, words)
                owner = np.repeat(np.arange(until - at), np.diff(first))
                n = until - at
                logs = np.log10(np.maximum(counted, 0) + 1.0)
                base = np.bincount(owner, logs, minlength=n) + end_count - sizes * all_words
                # A word of a bucket: its own share there; its count comes from the join where it isn't shared.
                member = symbols >= OWN_WORDS
                member[np.cumsum(sizes) - 1] = False
                inside = np.delete(member, np.cumsum(sizes) - 1)
                share = np.bincount(owner, np.where(inside, logs - in_bucket[bucket], 0.0), minlength=n)
                own_score = score_texts(network, symbols, sizes) / np.log(10) + share
                known = np.bincount(owner, counted > 0, minlength=n).astype(np.int64) + (words.texts > 0)
                some = counted < 0
                ends = np.insert(np.cumsum(np.bincount(owner[some], minlength=n)), 0, 0).astype(np.int32)
                rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(word[some]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *map(pa.array, (sizes, known, base, own_score)), rare], names)

    # Written with a name for each row, so that words that aren't shared meet their counts by it.
    scored = docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(score, f"__key {kind}, n_tokens BIGINT, known BIGINT, base DOUBLE, own DOUBLE, rare ARRAY<BIGINT>")
    scored = stored(scored.withColumn("__row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("__row", F.explode("rare").alias("word"))
    joined = rest.join(counts.select("word", "c"), "word").groupBy("__row").agg(F.sum(F.log10(F.col("c") + 1)).alias("logs"), F.count("*").alias("n"))
    out = scored.drop("rare").join(joined, "__row", "left")
    zero = F.lit(0)
    return out.select(
        F.col("__key").alias(key),
        "n_tokens",
        (F.col("known") + F.coalesce("n", zero)).alias("n_known"),
        F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", zero)).alias("base_score"),
        (F.col("own") + F.coalesce("logs", zero)).alias("score"),
    )
