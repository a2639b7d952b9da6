"""Repeated byte strings by suffix sorting in two stages.

Only suffixes that are smaller than their successors are sorted directly; scanning the buckets of first bytes
in order then puts every other suffix in its place, and adjacent common prefixes show which
strings of ``window`` bytes are equal. To sort in bounded pieces, a text is cut into runs of windows that
share an anchor (the least-hashed short substring of a window, which equal windows share), anchors are
counted over all documents, and the distinct runs of an anchor that occurs more than once are sorted
together, many anchors in one suffix array. Equal runs are merged before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import _BYTES, drop, mixed, powers, release, signed, span_hashes, stored, text_groups
from quaver.llm.repeats import RUNS, classes, shared_runs, with_texts

WINDOW = 100
#: Length of an anchor.
GRAM = 16
#: Bytes handled at once in a text; longer ones are cut, with an overlap of a window.
MOST_BYTES = 1 << 22
#: Bytes of runs in one suffix array.
ARRAY_BYTES = 1 << 20
#: Runs of anchors with more distinct runs are cut and named again by longer anchors (see ``_parts``): a hot anchor's
#: array would be one task's work. Parts of longer anchors that are still as hot are compared window by window.
MOST_VARIANTS = 64
#: Windows at most of a part of a hot anchor's run.
BAND = 16


def _words64(text: np.ndarray, pad: int) -> np.ndarray:
    """The eight bytes from each place on as one big-endian number; zeros follow the text."""
    x = np.concatenate([text, np.zeros(pad + 8, np.uint8)]).astype(np.uint64)
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    return (x[:-4] << np.uint64(32)) | x[4:]


def suffix_order(text: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """All suffixes of ``text``, ordered by at least their first ``depth`` bytes, in two stages."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    # A suffix is small if it is less than its successor: decided by the next byte that differs.
    differs = np.append(text[1:] != text[:-1], True)
    ends = np.flatnonzero(differs)
    rises = np.append(text[1:] > text[:-1], False)[ends]
    small = np.repeat(rises, np.diff(np.concatenate([[-1], ends])))

    # Stage one: the small suffixes, eight bytes at a time, as long as some are tied.
    eight = _words64(text, depth + 8)
    order = np.flatnonzero(small)
    order = order[np.argsort(eight[order], kind="stable")]
    key = eight[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(order) else np.zeros(0, np.int64)
    for at in range(8, depth, 8):
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        rows, own = order[tied], group[tied]
        key = eight[rows + at]
        by = np.lexsort((key, own))
        order[tied] = rows[by]
        key, own = key[by], own[by]
        fresh = np.ones(len(group), dtype=bool)
        fresh[1:] = group[1:] != group[:-1]
        fresh[tied[1:]] |= (key[1:] != key[:-1]) & (own[1:] == own[:-1])
        group = np.cumsum(fresh) - 1

    # Stage two: buckets in order; each suffix found puts its larger predecessor at the end of the front of its bucket.
    cuts = np.searchsorted(text[order], np.arange(257))
    fronts: list[list[np.ndarray]] = [[] for _ in range(256)]
    fronts[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(fronts[c]) if fronts[c] else np.zeros(0, np.int64)
        front = [wave]
        while len(wave):
            before = wave[wave > 0] - 1
            wave = before[text[before] == c]
            front.append(wave)
        bucket = np.concatenate([*front, order[cuts[c] : cuts[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        before, first = before[first > c], first[first > c]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        for piece in np.split(before, np.flatnonzero(np.diff(first)) + 1) if len(before) else ():
            fronts[text[piece[0]]].append(piece)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """Length of the common prefix of each suffix with the one before it in ``order``, ``most`` at most."""
    eight = _words64(text, most + 8)
    length = np.zeros(len(order), np.int64)
    active = np.arange(1, len(order))
    left = len(text) - np.maximum(order[active], order[active - 1]) if len(active) else active
    for at in range(0, most, 8):
        x = eight[order[active] + at] ^ eight[order[active - 1] + at]
        same = x == 0
        rest = np.flatnonzero(~same)
        # Leading equal bytes of the eight.
        bits = x[rest]
        lead = np.zeros(len(rest), np.int64)
        for k in range(1, 8):
            lead += bits < (np.uint64(1) << np.uint64(64 - 8 * k))
        length[active[rest]] = np.minimum(at + lead, left[rest])
        active, left = active[same], left[same]
        length[active] = np.minimum(at + 8, left)
        if not len(active):
            break
    return np.minimum(length, most)


def window_anchors(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Window starts, anchor names and anchor places in the texts of a group."""
    starts, grams, at, _ = _least_grams(data, offsets, window, gram)
    return starts, grams[at], at


def _least_grams(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the names of all grams, the place of each window's least, and the running sums that names come from."""
    n = len(data)
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - window + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.uint64)
    starts = np.arange(total) + np.repeat(offsets[:-1] - np.cumsum(counts) + counts, counts)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * powers(n), out=sums[1:])
    grams = mixed((sums[gram:] - sums[:-gram]) * powers(n - gram + 1, back=True))
    least = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    reach = window - gram + 1  # places of an anchor in a window
    step = 1
    while 2 * step <= reach:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if reach > step:
        least = np.minimum(least[: len(least) - (reach - step)], least[reach - step :])
    return starts, grams, (least[starts] & np.uint64(0xFFFFFF)).astype(np.int64), sums


def _pieces(data: np.ndarray, offsets: np.ndarray, window: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The group, or parts of it if it is one very long text: (base, bytes, offsets)."""
    if len(data) <= most:
        yield 0, data, offsets
        return
    for base in range(0, max(1, len(data) - window + 1), most):
        end = min(len(data), base + most + window - 1)
        yield base, data[base:end], np.clip(offsets, base, end) - base


def byte_runs(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST_BYTES) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, whole, every in text_groups(batch, "text"):
                for base, data, offsets in _pieces(whole, every, window, most):
                    starts, grams, at, sums = _least_grams(data, offsets, window, gram)
                    if not len(starts):
                        continue
                    fresh = np.ones(len(starts), dtype=bool)
                    fresh[1:] = (np.diff(starts) != 1) | (at[1:] != at[:-1])
                    i = np.flatnonzero(fresh)
                    size = np.diff(np.append(i, len(starts)))
                    begin = starts[i]
                    owner = np.searchsorted(every, begin + base, "right") - 1
                    name = span_hashes(data, begin, begin + size + window - 1, sums)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(signed(grams[at[i]])), pa.array(signed(name)), pa.array(ids[first + owner], pa.int64()), pa.array(begin + base - every[owner], pa.int64()), pa.array(size, pa.int64())],
                        ["anchor", "run", "doc_id", "start", "size"],
                    )

    return docs.mapInArrow(run, RUNS)


def _run_bytes(chosen: DataFrame, window: int) -> DataFrame:
    """The chosen classes with the bytes of their first places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, lists = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            out: dict[str, list] = {k: [] for k in ("anchor", "run", "doc_id", "start", "variants", "bytes")}
            for i, text, own in zip(ids, texts, lists, strict=True):
                data = text.as_py().encode()
                for r in own:
                    if r["start"] + r["size"] + window - 1 > len(data):
                        continue  # of another row with the same key
                    for k in ("anchor", "run", "start", "variants"):
                        out[k].append(r[k])
                    out["doc_id"].append(i)
                    out["bytes"].append(data[r["start"] : r["start"] + r["size"] + window - 1])
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(out, kinds, strict=True)], list(out))

    return chosen.select("doc_id", "text", "rows").mapInArrow(run, "anchor BIGINT, run BIGINT, doc_id BIGINT, start BIGINT, variants BIGINT, bytes BINARY")


def later_windows(runs: list[bytes], places: np.ndarray, window: int = WINDOW) -> list[np.ndarray]:
    """For each run, offsets of the windows that also stand at an earlier place in another run.

    ``places``: (document, start) of each run. Only the stretch of a run between its first and its last window whose
    fingerprint occurs twice is sorted.
    """
    low, high = _repeated_stretch(runs, window)
    some = np.flatnonzero(high > low)
    found = [np.zeros(0, np.int64)] * len(runs)
    if len(some):
        cut = places[some].copy()
        cut[:, 1] += low[some]
        for r, at in zip(some.tolist(), _sorted_later([runs[r][low[r] : high[r] + window - 1] for r in some.tolist()], cut, window), strict=True):
            found[r] = at + low[r]
    return found


def _repeated_stretch(runs: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each run whose fingerprint occurs twice, and the one after the last (0, 0: none)."""
    data = np.frombuffer(b"".join(runs), np.uint8)
    sizes = np.array([len(r) for r in runs], np.int64)
    n, counts = len(data), np.maximum(sizes - window + 1, 0)
    owner = np.repeat(np.arange(len(runs)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (np.cumsum(sizes) - sizes)[owner] + offset
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * powers(n), out=sums[1:])
    names = (sums[starts + window] - sums[starts]) * powers(n + 1, back=True)[starts]
    ordered = np.sort(names)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    low, high = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
    if len(twice):
        hit = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, names), len(twice) - 1)] == names)
        high[owner[hit]] = offset[hit] + 1
        low[owner[hit[::-1]]] = offset[hit[::-1]]
    return low, high


def _sorted_later(runs: list[bytes], places: np.ndarray, window: int) -> list[np.ndarray]:
    text = np.frombuffer(b"\0".join(runs) + b"\0", np.uint8)
    sizes = np.array([len(r) for r in runs])
    begins = np.cumsum(sizes + 1) - sizes - 1
    order = suffix_order(text, window)
    equal = common_prefixes(text, order, window) >= window
    group = np.cumsum(~equal)
    owner = np.searchsorted(begins, order, "right") - 1
    offset = order - begins[owner]
    inside = offset + window <= sizes[owner]  # other suffixes run past the end of their run
    group, owner, offset = group[inside], owner[inside], offset[inside]
    document, start = places[owner, 0], places[owner, 1] + offset
    by = np.lexsort((start, document, group))
    # Not the first place of its group; rows that share a key may name it twice.
    head = np.searchsorted(group[by], group[by])
    later = (document[by] != document[by][head]) | (start[by] != start[by][head])
    owner, offset = owner[by][later], offset[by][later]
    by = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[by], np.arange(len(runs) + 1))
    return [np.sort(offset[by][a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def _sorted_windows(rows: DataFrame, window: int, array_bytes: int) -> DataFrame:
    """``anchor``, ``run``, ``at`` from suffix arrays over the rows of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush():
            found = later_windows([r[4] for r in held], np.array([r[2:4] for r in held], np.int64), window)
            rows = [(r[0], r[1], at.tolist()) for r, at in zip(held, found, strict=True) if len(at)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["anchor", "run", "at"]
            )

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= array_bytes and row[0] != held[-1][0]:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size += len(row[4]) + 1
        if held:
            yield flush()

    ordered = rows.select("anchor", "run", "doc_id", "start", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(run, "anchor BIGINT, run BIGINT, at ARRAY<BIGINT>")


def _compared_windows(rows: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many runs: each window is a row, and the earliest of equal ones is found by an aggregate over 128 bits of their SHA-256."""
    n = F.octet_length("bytes") - window + 1
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).select(
        "anchor", "run", F.struct("doc_id", (F.col("start") + F.col("i")).alias("start")).alias("place"), F.col("i").cast("long").alias("i"), F.unhex(F.substring(F.sha2(F.expr(f"substring(bytes, i + 1, {window})"), 256), 1, 32)).alias("digest")
    )
    each = stored(each, "hot-windows")
    first = stored(each.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "hot-digests")
    later = each.join(first, "digest").where("place <> first")
    return later.groupBy("anchor", "run").agg(F.sort_array(F.collect_list("i")).alias("at"))


def _parts(hot: DataFrame, window: int, gram: int, band: int = BAND) -> DataFrame:
    """Runs of hot anchors in parts of ``band`` windows at most, counted from the anchor's place, with longer anchors.

    The windows of a part share ``window - band + 1`` bytes at the same distance from the old anchor; these are the new
    anchor. Equal windows have the old anchor at the same place, so they stand in parts of one new anchor. ``whole_anchor`` and
    ``whole_run`` name the run, ``skip`` is the part's first window in it.
    """
    fields = "anchor BIGINT, run BIGINT, doc_id BIGINT, start BIGINT, size BIGINT, whole_anchor BIGINT, whole_run BIGINT, skip BIGINT"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors, names, ids, places = (batch.column(i).to_numpy() for i in range(4))
            values = batch.column(4)
            sizes = np.array([len(v) for v in values.to_pylist()], np.int64)
            data = np.frombuffer(b"".join(values.to_pylist()), np.uint8)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            starts, _, at = window_anchors(data, offsets, window, gram)
            owner = np.searchsorted(offsets, starts, "right") - 1
            level = (at - starts) // band
            fresh = np.ones(len(starts), dtype=bool)
            fresh[1:] = (owner[1:] != owner[:-1]) | (level[1:] != level[:-1])
            i = np.flatnonzero(fresh)
            size = np.diff(np.append(i, len(starts)))
            begin, own = starts[i], owner[i]
            left = at[i] - level[i] * band
            core = span_hashes(data, left, left + window - band + 1)
            core = mixed(core ^ mixed(anchors[own].view(np.uint64) + level[i].astype(np.uint64), 41), 42)
            skip = begin - offsets[own]
            columns = (signed(core), signed(span_hashes(data, begin, begin + size + window - 1)), ids[own], places[own] + skip, size, anchors[own], names[own], skip)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in fields.split(", ")])

    return hot.select("anchor", "run", "doc_id", "start", "bytes").mapInArrow(run, fields)


def _narrowed_windows(hot: DataFrame, window: int, gram: int, most_variants: int, array_bytes: int) -> DataFrame:
    """``anchor``, ``run``, ``at`` of runs of hot anchors, from the distinct parts of these runs."""
    parts = stored(_parts(hot, window, gram), "parts")
    # Parts by themselves under their anchor are settled: nothing equals their windows.
    shared = parts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    where = ["doc_id", "start", "whole_anchor", "whole_run", "skip"]
    kinds = parts.join(shared, "anchor").groupBy("anchor", "run", "size").agg(F.min(F.struct(*where)).alias("first"), F.count("*").alias("n"))
    kinds = stored(kinds.select("anchor", "run", "size", "first.*", "n"), "part-classes")
    variants = kinds.groupBy("anchor").agg(F.count("*").alias("variants")).where("variants > 1")
    chosen = kinds.join(variants, "anchor").select("anchor", "run", "doc_id", "start", "size", "variants", "skip", "whole_anchor", "whole_run")
    source = hot.select(F.col("anchor").alias("whole_anchor"), F.col("run").alias("whole_run"), F.col("bytes").alias("whole"))
    chosen = chosen.join(source, ["whole_anchor", "whole_run"]).withColumn("bytes", F.expr(f"substring(whole, int(skip) + 1, int(size) + {window - 1})"))
    chosen = stored(chosen.select("anchor", "run", "doc_id", "start", "variants", "bytes"), "part-bytes")
    release(hot.sparkSession)
    found = _sorted_windows(chosen.where(F.col("variants") <= most_variants), window, array_bytes)
    found = found.unionByName(_compared_windows(chosen.where(F.col("variants") > most_variants), window))
    found = stored(found, "part-windows")
    drop(chosen)
    decided = kinds.select("anchor", "run", "n", F.struct("doc_id", "start").alias("first")).join(found, ["anchor", "run"], "left").where("n > 1 OR at IS NOT NULL")
    marked = parts.join(decided, ["anchor", "run"])
    own = F.when(F.struct("doc_id", "start") == F.col("first"), F.coalesce("at", F.array().cast("array<bigint>"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("size") - 1))
    marked = marked.select("whole_anchor", "whole_run", F.transform(own, lambda i: i + F.col("skip")).alias("at")).where("size(at) > 0")
    grouped = marked.groupBy(F.col("whole_anchor").alias("anchor"), F.col("whole_run").alias("run"))
    narrowed = stored(grouped.agg(F.sort_array(F.flatten(F.collect_list("at"))).alias("at")), "narrowed")
    for table in (parts, kinds, found):
        drop(table)
    release(hot.sparkSession)
    return narrowed


def later_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, most_variants: int = MOST_VARIANTS, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """``key``, ``n_bytes``, ``spans``, ``kept``: UTF-8 bytes covered by strings of ``window`` bytes that also start earlier.

    Earlier: in a document with a smaller key, or in the same one before; overlaps count, and matches don't cross
    documents. ``spans`` are the maximal stretches (start, end) to remove, ``kept`` the other bytes. Null and
    empty texts have no bytes. Keys are integers; rows without one come back whole, and rows that share one are
    places of the same document (their texts should be equal). Texts of any
    length are read whole. Other columns are not read.
    """
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    named = own.where("doc_id IS NOT NULL AND text IS NOT NULL")
    runs = shared_runs(byte_runs(named, window, gram))
    kinds = classes(runs)
    several = kinds.where("variants > 1").select("doc_id", "anchor", "run", "start", "size", "variants")
    named_runs = with_texts(several, named)
    segments = stored(_run_bytes(named_runs, window), "segments")
    drop(named_runs)
    del named_runs
    release(docs.sparkSession)
    narrowed = _narrowed_windows(segments.where(F.col("variants") > most_variants), window, gram, most_variants, array_bytes)
    later = stored(_sorted_windows(segments.where(F.col("variants") <= most_variants), window, array_bytes).unionByName(narrowed), "later")
    drop(segments)
    drop(narrowed)
    release(docs.sparkSession)
    decided = kinds.select("anchor", "run", "n", F.struct("doc_id", "start").alias("first")).join(later, ["anchor", "run"], "left")
    decided = stored(decided.where("n > 1 OR at IS NOT NULL"), "decisions")
    drop(later)
    drop(kinds)
    release(docs.sparkSession)
    marked = runs.join(decided, ["anchor", "run"]).select("doc_id", "start", "size", F.when(F.struct("doc_id", "start") == F.col("first"), F.coalesce("at", F.array().cast("array<bigint>"))).alias("at"))
    marked = marked.where("at IS NULL OR size(at) > 0")
    marks = stored(marked.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size", "at")).alias("marks")), "marks")
    drop(runs)
    drop(decided)
    release(docs.sparkSession)
    return _apply(own.join(marks.hint("shuffle_hash"), "doc_id", "left"), key, window)


def _apply(rows: DataFrame, key: str, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            some, cuts = lists.is_valid().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            start, size, places = lists.values.flatten()
            start, size = start.to_numpy(), size.to_numpy()
            every, place, within = places.is_null().to_numpy(zero_copy_only=False), places.values.to_numpy(), places.offsets.to_numpy()
            for first, last, whole, offsets in text_groups(batch, "text"):
                spans, kept = [], []
                for i in range(first, last):
                    data = whole[offsets[i - first] : offsets[i - first + 1]]
                    if not some[i] or cuts[i] == cuts[i + 1]:
                        spans.append([])
                        kept.append(data.tobytes())
                        continue
                    edge = np.zeros(len(data) + 1, np.int64)
                    own = np.arange(cuts[i], cuts[i + 1])
                    own = own[start[own] + size[own] + window - 1 <= len(data)]  # others are of another row with the same key
                    all_of = own[every[own]]
                    np.add.at(edge, start[all_of], 1)
                    np.add.at(edge, start[all_of] + size[all_of] + window - 1, -1)
                    for m in own[~every[own]]:
                        at = start[m] + place[within[m] : within[m + 1]]
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + window, -1)
                    covered = np.cumsum(edge)[:-1] > 0
                    change = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in change.reshape(-1, 2)])
                    kept.append(data[~covered].tobytes())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                n_bytes = pa.array(np.diff(offsets), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), n_bytes, pa.array(spans, kind), pa.array(kept, pa.binary())], [key, "n_bytes", "spans", "kept"])

    return rows.select("doc_id", "text", "marks").mapInArrow(run, f"`{key}` BIGINT, n_bytes BIGINT, spans ARRAY<STRUCT<start: BIGINT, end: BIGINT>>, kept BINARY")
