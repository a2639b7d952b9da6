"""Repeated word windows by recompression.

Words get 64-bit names. First maximal runs of one word are named, then, in each round, pairs: a coin that
depends on nothing but the symbol and the round puts it left or right, and each left symbol that is followed by a
right one is joined with it under a new name. A name is a function of what it stands for, so every
executor gives the same one, and equal word sequences are parsed alike except for a few symbols at
their ends. A window's anchor is the least-named top symbol of its inner part, with the words that follow. Spark counts anchors over all
documents; anchors that occur twice reveal candidates, and runs of windows around them are compared by
fingerprints of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import mixed, powers, release, signed, span_hashes, stored, text_groups, word_bounds
from quaver.llm.repeats import RUNS, classes, shared_runs, with_texts

WINDOW = 35
ROUNDS = 3
#: Words that name an anchor, from the start of its symbol on: few enough to fit every window, many enough to be rare.
ANCHOR_WORDS = 8


def sequence_hashes(names: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of stretches of a sequence of names."""
    sums = np.zeros(len(names) + 1, dtype=np.uint64)
    np.cumsum(mixed(names, 77) * powers(len(names)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * powers(len(names) + 1, back=True)[starts] + (ends - starts).astype(np.uint64), 78)


def parse(words: np.ndarray, firsts: np.ndarray, rounds: int = ROUNDS) -> tuple[list[np.ndarray], np.ndarray]:
    """Symbol starts of each level (0: runs of words) and the names of the top level.

    ``firsts``: where documents begin; no symbol crosses that. Each level's starts are word positions.
    """
    n = len(words)
    opens = np.zeros(n, dtype=bool)
    opens[firsts[firsts < n]] = True
    levels = []
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (words[1:] != words[:-1]) | opens[1:]
    starts = np.flatnonzero(fresh)
    length = np.diff(np.append(starts, n))
    names = words[starts]
    names = np.where(length > 1, mixed(names ^ mixed(length.astype(np.uint64), 3), 200), names)
    levels.append(starts)
    for level in range(1, rounds + 1):
        left = (mixed(names, 300 + level) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(names), dtype=bool)
        joins[:-1] = left[:-1] & ~left[1:] & ~opens[starts[1:]]
        i = np.flatnonzero(joins)
        names = names.copy()
        names[i] = mixed(names[i] * np.uint64(3) ^ mixed(names[i + 1], 5), 400 + level)
        single = np.ones(len(names), dtype=bool)
        single[i + 1] = False
        names, starts = names[single], starts[single]
        levels.append(starts)
    return levels, names


def _inner(levels: list[np.ndarray], window_starts: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window, first and last + 1 of the top-level symbols that its content alone determines.

    The run at each end may reach outside. In each round the outermost symbol on both sides may be
    joined with one that stands outside, so it is given up, up to the next boundary of the new level.
    """
    low, high = window_starts, window_starts + window
    below = None
    for starts in levels:
        bounds = np.append(starts, n)
        is_bound = np.zeros(n + 1, dtype=np.int64)
        is_bound[bounds] = 1
        upto = np.cumsum(is_bound)  # boundaries at or before a place
        if below is None:
            low = bounds[np.minimum(upto[low], len(bounds) - 1)]
            high = bounds[np.maximum(upto[high] - is_bound[high] - 1, 0)]
        else:
            lower, lower_upto, lower_is = below
            low = lower[np.minimum(lower_upto[low], len(lower) - 1)]
            high = lower[np.maximum(lower_upto[high] - lower_is[high] - 1, 0)]
            low = bounds[np.minimum(upto[low] - is_bound[low], len(bounds) - 1)]
            high = bounds[np.maximum(upto[high] - 1, 0)]
        below = bounds, upto, is_bound
    return upto[low] - 1, upto[high] - 1


def window_anchors(words: np.ndarray, firsts: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS):
    """Window starts, anchor names and anchor places. Windows without an inner symbol name themselves."""
    n = len(words)
    bounds = np.append(firsts, n)
    sizes = np.diff(bounds)
    counts = np.maximum(sizes - window + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.repeat(bounds[:-1], counts) + np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    levels, names = parse(words, firsts, rounds)
    lo, hi = _inner(levels, starts, n, window)
    # An anchor is named by its symbol and the words from there on, which have to lie in the window too.
    top = levels[-1]
    wide = min(ANCHOR_WORDS, window)
    names = mixed(names ^ sequence_hashes(words, top, np.minimum(top + wide, n)), 8)
    hi = np.minimum(hi, np.searchsorted(top, starts + window - wide, "right"))
    # Least name in [lo, hi), the leftmost of equals: a sparse table of (40 bits of the name, place).
    place = np.arange(len(names), dtype=np.uint64)
    table = [((mixed(names, 9) >> np.uint64(24)) << np.uint64(24)) | place]
    span = np.maximum(hi - lo, 0)
    widest = int(span.max()) if len(span) else 0
    while (2 << (len(table) - 1)) <= widest:
        step = 1 << (len(table) - 1)
        last = table[-1]
        grown = last.copy()
        grown[:-step] = np.minimum(last[:-step], last[step:])
        table.append(grown)
    some = np.flatnonzero(span > 0)
    best = np.zeros(total, dtype=np.uint64)
    level = np.floor(np.log2(span[some])).astype(np.int64)
    for k in range(len(table)):
        i = some[level == k]
        best[i] = np.minimum(table[k][lo[i]], table[k][hi[i] - (1 << k)])
    index = (best & np.uint64(0xFFFFFF)).astype(np.int64)
    anchor, at = names[index], levels[-1][index].astype(np.int64)
    none = np.flatnonzero(span <= 0)
    if len(none):
        anchor[none] = mixed(sequence_hashes(words, starts[none], starts[none] + window), 13)
        at[none] = -1 - starts[none]
    return starts, anchor, at


def _parts(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, word names, first word of each text, words of each text).

    A group holds far fewer than 2**24 words unless one text alone is longer than that; such a text
    is cut where its windows can overlap.
    """
    for first, _, data, offsets in text_groups(batch, "text"):
        starts, ends, at = word_bounds(data, offsets)
        yield first, span_hashes(data, starts, ends), at[:-1], np.diff(at)


#: Words handled at once; longer texts are cut, with an overlap of a window.
MOST_WORDS = 1 << 22


def word_runs(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, most: int = MOST_WORDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, words, at, _ in _parts(batch, window):
                for base in range(0, max(1, len(words) - window + 1), most):
                    part = words[base : base + most + window - 1]
                    inner = at[(at > base) & (at < base + len(part))] - base
                    firsts = np.concatenate([[0], np.unique(inner)]).astype(np.int64)
                    starts, anchor, place = window_anchors(part, firsts, window, rounds)
                    if not len(starts):
                        continue
                    fresh = np.ones(len(starts), dtype=bool)
                    fresh[1:] = (np.diff(starts) != 1) | (place[1:] != place[:-1])
                    i = np.flatnonzero(fresh)
                    size = np.diff(np.append(i, len(starts)))
                    begin = starts[i]
                    owner = np.searchsorted(at, begin + base, "right") - 1
                    name = sequence_hashes(part, begin, begin + size + window - 1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(anchor[i])), pa.array(signed(name)), pa.array(ids[first + owner], pa.int64()), pa.array(begin + base - at[owner], pa.int64()), pa.array(size, pa.int64())],
                        ["anchor", "run", "doc_id", "start", "size"],
                    )

    return docs.mapInArrow(run, RUNS)


def _variant_windows(chosen: DataFrame, window: int) -> DataFrame:
    """(anchor, run, at, name, n) of each window of the chosen classes' first places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2).to_pylist()
            for first, words, at, many in _parts(batch, window):
                # A row with the same key and another text may be shorter.
                rows = [(r, at[i]) for i in range(len(at)) for r in lists[first + i] if r["start"] + r["size"] + window - 1 <= many[i]]
                if not rows:
                    continue
                size = np.array([r["size"] for r, _ in rows])
                begin = np.array([r["start"] + a for r, a in rows])
                which = np.repeat(np.arange(len(rows)), size)
                offset = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
                name = sequence_hashes(words, begin[which] + offset, begin[which] + offset + window)
                column = [np.array([r[k] for r, _ in rows], np.int64)[which] for k in ("anchor", "run", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (column[0], column[1], offset, signed(name), column[2])], ["anchor", "run", "at", "name", "n"])

    return chosen.select("doc_id", "text", "rows").mapInArrow(run, "anchor BIGINT, run BIGINT, at BIGINT, name BIGINT, n BIGINT")


def repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``key``, ``spans``, ``n_words``, ``kept_text``: words covered by windows that occur more than once.

    A window is ``window`` consecutive words ``[^\\x20\\x09-\\x0D]+``, unchanged; one that starts at any second
    place, in the same document too, is repeated, and all its places count. ``spans`` are maximal stretches
    (start, end) of such words; ``kept_text`` joins the others by one blank. Null and empty texts have no
    words. Keys are integers; rows without one come back without spans, and rows that share one are places of
    the same document (their texts should be equal), each a place of its own. Texts of any length are
    read whole. Other columns are not read.
    """
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = own.where("doc_id IS NOT NULL AND text IS NOT NULL")
    runs = shared_runs(word_runs(named, window, rounds))
    kinds = classes(runs)
    several = kinds.where("variants > 1").select("doc_id", "anchor", "run", "start", "size", "n")
    windows = stored(_variant_windows(with_texts(several, named), window), "windows")
    release(docs.sparkSession)
    names = stored(windows.groupBy("anchor", "name").agg(F.sum("n").alias("n")).where("n > 1").select("anchor", "name"), "names")
    some = windows.join(names, ["anchor", "name"]).groupBy("anchor", "run").agg(F.sort_array(F.collect_list("at")).alias("at"))
    some = some.select("anchor", "run", "at")
    whole = kinds.where("variants = 1 AND n > 1").select("anchor", "run", F.lit(None).cast("array<bigint>").alias("at"))
    decided = stored(whole.unionByName(some), "decisions")
    release(docs.sparkSession)
    marked = runs.join(decided, ["anchor", "run"]).select("doc_id", "start", "size", "at")
    marks = marked.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size", "at")).alias("marks"))
    marks = stored(marks, "marks")
    release(docs.sparkSession)
    return _apply(own.join(marks.hint("shuffle_hash"), "doc_id", "left"), key, window)


def _apply(rows: DataFrame, key: str, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            spans, counts, kept = [], [], []
            for value, marks in zip(texts, lists, strict=True):
                data = (value or "").encode()
                words = [w for w in data.translate(_BLANKS).split(b" ") if w]
                edge = np.zeros(len(words) + 1, np.int64)
                for m in marks or ():
                    if m["start"] + m["size"] + window - 1 > len(words):
                        continue  # of another row with the same key
                    places = [m["start"] + a for a in m["at"]] if m["at"] is not None else None
                    if places is None:
                        edge[m["start"]] += 1
                        edge[m["start"] + m["size"] + window - 1] -= 1
                    else:
                        np.add.at(edge, places, 1)
                        np.add.at(edge, [p + window for p in places], -1)
                covered = np.cumsum(edge)[:-1] > 0
                change = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                spans.append([{"start": int(a), "end": int(b)} for a, b in change.reshape(-1, 2)])
                counts.append(len(words))
                kept.append(b" ".join(w for w, c in zip(words, covered.tolist(), strict=True) if not c).decode() if marks else b" ".join(words).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(counts, pa.int64()), pa.array(kept, pa.string())], [key, "spans", "n_words", "kept_text"])

    return rows.select("doc_id", "text", "marks").mapInArrow(run, f"`{key}` BIGINT, spans ARRAY<STRUCT<start: BIGINT, end: BIGINT>>, n_words BIGINT, kept_text STRING")


_BLANKS = bytes(0x20 if b in (9, 10, 11, 12, 13) else b for b in range(256))
