"""MinHash near-duplicates with an LSH forest.

Each tree sorts the documents by its own sequence of minimum hashes. In a sorted order, the neighbours of a
document share the longest prefixes with it, so the depth at which two documents meet adapts to how
crowded their region is: neighbours become candidates first, in every tree. Candidates are confirmed on
whole shingle sets, in two rounds: first each document's best candidates, then those that would
still join two components. Where more documents share the least prefix than neighbours reach, all of them are then
compared on whole sets, in bounded blocks that return components; only pairs within one component are spared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import lower_ascii, mixed, powers, signed, span_hashes, stored, text_groups, word_bounds
from quaver.llm.components import components, some_components

TREES = 16
DEPTH = 8
#: Least common prefix of candidates, and neighbours that are looked at on each side.
LEAST_PREFIX = 3
REACH = 4
#: Candidates of a document that are confirmed in the first round.
FIRST = 2
#: Documents and shingles, on average, of a block of a crowded prefix; shared shingles that are counted at once.
BLOCK_ROWS = 512
BLOCK_SHINGLES = 1 << 20
COLUMNS = 4096

_rng = np.random.default_rng(99)
_MUL = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text: ``size`` words in a row, ASCII letters in
    lower case; with fewer words, the whole sequence as one; without words, none."""
    data = lower_ascii(data)
    starts, ends, first = word_bounds(data, offsets)
    words = span_hashes(data, starts, ends)
    n = len(words)
    rolled = np.zeros(n, dtype=np.uint64)
    step = powers(size + 1)
    if n >= size:
        for k in range(size):
            rolled[: n - size + 1] += mixed(words[k : n - size + 1 + k], k + 1) * step[k]
        rolled = mixed(rolled, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            short = np.zeros(1, dtype=np.uint64)
            for k in range(a, b):
                short += mixed(words[k : k + 1], k - a + 1) * step[k - a]
            out.append(mixed(short, 1000 + b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES x DEPTH minimum hashes, 16 bits of each, as big-endian keys."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(shingles), 512):
        values = shingles[lo : lo + 512, None] * _MUL + _ADD
        np.minimum(least, values.min(axis=0), out=least)
    return (mixed(least) >> np.uint64(48)).astype(">u2").reshape(TREES, DEPTH)


def _signed_docs(docs: DataFrame, size: int) -> DataFrame:
    """``id``, ``n_shingles``, set digest ``h1``, ``h2``, and one ``key`` per tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_groups(batch, "text"):
                sets = shingle_sets(data, offsets, size)
                with np.errstate(over="ignore"):
                    h1 = np.array([mixed(s, 5).sum(dtype=np.uint64) for s in sets], np.uint64)
                    h2 = np.array([mixed(s, 11).sum(dtype=np.uint64) for s in sets], np.uint64)
                    keys = pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(h1)), pa.array(signed(h2)), keys],
                    ["id", "n_shingles", "h1", "h2", "keys"],
                )

    return docs.mapInArrow(run, "id BIGINT, n_shingles BIGINT, h1 BIGINT, h2 BIGINT, keys BINARY")


def _neighbours(trees: DataFrame, reach: int) -> tuple[DataFrame, DataFrame]:
    """``a`` < ``b``, ``prefix``: pairs at most ``reach`` places apart in a tree's order with a common prefix of LEAST_PREFIX or more;
    and ``run`` (tree and prefix), ``id`` of the rows of prefixes that more than ``reach`` rows share.

    Rows (``key``: tree and hashes, ``id``) are range-partitioned by key and id, which splits equal keys
    too. The rows at the edges of partitions, a few each, are joined up in a second, small order.
    """

    def pairs_of(keys: list[bytes], ids: np.ndarray, edge: np.ndarray | None = None):
        n = len(ids)
        if n < 2:
            return [], [], [], np.zeros(0, np.int64)
        grid = np.frombuffer(b"".join(keys), np.uint8).reshape(n, -1)
        tree, grid = grid[:, :2], grid[:, 2:].reshape(n, DEPTH, 2)
        out: tuple[list, list, list] = ([], [], [])
        crowd = np.zeros(n + 1, np.int64)
        for k in range(1, min(reach, n - 1) + 1):
            same = (grid[k:] == grid[:-k]).all(axis=2)
            prefix = np.where(same.all(axis=1), DEPTH, same.argmin(axis=1))
            good = (prefix >= LEAST_PREFIX) & (tree[k:] == tree[:-k]).all(axis=1)
            at = np.flatnonzero(good)
            out[0].append(np.minimum(ids[at], ids[at + k]))
            out[1].append(np.maximum(ids[at], ids[at + k]))
            out[2].append(prefix[at])
            if k == reach:  # all rows between the two share the prefix
                crowd[at] += 1
                crowd[at + k + 1] -= 1
        return *[np.concatenate(x) for x in out], np.flatnonzero(np.cumsum(crowd)[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        ids = np.zeros(0, np.int64)
        names = ["a", "b", "prefix", "key"]
        head = 0
        for batch in batches:
            # The last rows of a batch meet the first rows of the next.
            keys = keys[len(keys) - min(reach, len(keys)) :] + batch.column(0).to_pylist()
            ids = np.concatenate([ids[len(ids) - min(reach, len(ids)) :], batch.column(1).to_numpy(zero_copy_only=False)])
            a, b, prefix, crowd = pairs_of(keys, ids)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(prefix, pa.int64()), pa.nulls(len(a), pa.binary())], names)
            yield crowded(keys, ids, crowd, names)
            if head < reach:
                fresh = batch.num_rows
                take = min(reach - head, fresh)
                at = len(ids) - fresh
                yield edge(keys[at : at + take], ids[at : at + take], names)
                head += take
        last = min(reach, len(ids))
        yield edge(keys[len(keys) - last :], ids[len(ids) - last :], names)

    def crowded(keys, ids, crowd, names):
        n = len(crowd)
        return pa.RecordBatch.from_arrays([pa.array(ids[crowd], pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.zeros(n, np.int64)), pa.array([keys[i] for i in crowd], pa.binary())], names)

    def edge(keys, ids, names):
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(keys, pa.binary())], names)

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(k, i) for batch in batches for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)})
        keys, ids = [k for k, _ in rows], np.array([i for _, i in rows], np.int64)
        a, b, prefix, crowd = pairs_of(keys, ids)
        names = ["a", "b", "prefix", "key"]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(prefix, pa.int64()), pa.nulls(len(a), pa.binary())], names)
        yield crowded(keys, ids, crowd, names)

    ordered = trees.repartitionByRange("key", "id").sortWithinPartitions("key", "id").select("key", "id")
    found = stored(ordered.mapInArrow(run, "a BIGINT, b BIGINT, prefix BIGINT, key BINARY"), "forest")
    # 2 x reach rows of each partition of the order, whatever the number of documents in them.
    edges = found.where("key IS NOT NULL AND prefix IS NULL").select("key", F.col("a").alias("id")).coalesce(1)
    stitched = stored(edges.mapInArrow(stitch, "a BIGINT, b BIGINT, prefix BIGINT, key BINARY"), "forest")
    whole = found.where("key IS NULL OR prefix IS NOT NULL").unionByName(stitched)
    crowd = whole.where("key IS NOT NULL").select(F.expr(f"substring(key, 1, {2 + 2 * LEAST_PREFIX})").alias("run"), F.col("a").alias("id")).distinct()
    return whole.where("key IS NULL").select("a", "b", "prefix"), crowd


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_groups(batch, "text"):
                sets = [s.tobytes() for s in shingle_sets(data, offsets, size)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(sets, pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(run, "id BIGINT, shingles BINARY")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 x intersection >= percent x union of the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select([0, 1]).filter(pa.array(good))

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(run, "a BIGINT, b BIGINT")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right, by products of bounded 0/1 matrices."""
    out = np.zeros((len(left), len(right)), np.float64)
    x, y = np.concatenate(left), np.concatenate(right)
    x_row, y_row = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    common = np.intersect1d(x, y)
    if not len(common):
        return out
    x_at, y_at = np.minimum(np.searchsorted(common, x), len(common) - 1), np.minimum(np.searchsorted(common, y), len(common) - 1)
    x_in, y_in = common[x_at] == x, common[y_at] == y
    x_at, x_row, y_at, y_row = x_at[x_in], x_row[x_in], y_at[y_in], y_row[y_in]
    x_by, y_by = np.argsort(x_at, kind="stable"), np.argsort(y_at, kind="stable")
    x_at, x_row, y_at, y_row = x_at[x_by], x_row[x_by], y_at[y_by], y_row[y_by]
    for lo in range(0, len(common), COLUMNS):
        wide = min(COLUMNS, len(common) - lo)
        grids = []
        for at, row, n in ((x_at, x_row, len(left)), (y_at, y_row, len(right))):
            a, b = np.searchsorted(at, [lo, lo + wide])
            grid = np.zeros((n, wide), np.float32)
            grid[row[a:b], at[a:b] - lo] = 1
            grids.append(grid)
        out += grids[0] @ grids[1].T
    return out


def _block_links(left: list[int], right: list[int], good: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold together what ``good`` (left x right) links: one for each row that is reached, not one for each pair."""
    out = []
    fresh_left, fresh_right = good.any(axis=1), good.any(axis=0)
    while fresh_left.any():
        start = int(np.flatnonzero(fresh_left)[0])
        fresh_left[start] = False
        todo = [start]
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(good[i] & fresh_right).tolist():
                fresh_right[j] = False
                out.append((left[i], right[j]))
                more = np.flatnonzero(good[:, j] & fresh_left).tolist()
                fresh_left[more] = False
                out.extend((left[k], right[j]) for k in more)
                todo.extend(more)
    return [(a, b) for a, b in out if a != b]


def _crowd_links(crowd: DataFrame, sets: DataFrame, sizes: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) that join the documents of crowded prefixes as all their linked pairs would.

    Rows of a prefix's largest component (by ``known``) need no comparison among themselves. All others meet every row of the prefix:
    both are dealt into blocks of bounded size, and each pair of blocks is one task's group. A prefix in one component is done.
    """
    rows = stored(crowd.join(sizes.select("id", "n_shingles"), "id").join(known, "id", "left").withColumn("c", F.coalesce("component_id", "id")).drop("component_id"), "crowd")
    per = rows.groupBy("run", "c").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    total = per.groupBy("run").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.max(F.struct("n", "c", "w")).alias("most"))

    def blocks(n, w):
        return F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(w / BLOCK_SHINGLES)).cast("int")

    open_ = total.where("n > most.n").select(
        "run", F.col("most.c").alias("main"), blocks(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w")).alias("few"), blocks(F.col("most.n"), F.col("most.w")).alias("many")
    )
    dealt = rows.join(stored(open_, "open"), "run")
    salt = F.xxhash64("id", F.lit(3))
    mine = F.when(F.col("c") == F.col("main"), F.col("few") + F.pmod(salt, F.col("many"))).otherwise(F.pmod(salt, F.col("few"))).cast("int")
    dealt = dealt.select("run", "id", "few", "many", mine.alias("own"))
    others = F.sequence(F.lit(0), F.when(F.col("own") < F.col("few"), F.col("few") + F.col("many")).otherwise(F.col("few")) - 1)
    met = dealt.withColumn("other", F.explode(others)).select("run", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id")
    full = stored(met, "meetings").join(sets.hint("merge"), "id").select("run", "i", "j", "own", "id", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, kept = None, ([], []), ([], [])
        for batch in batches:
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            for at, (name, own, one) in enumerate(zip(names, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if name != now:
                    yield links(now, ids, kept)
                    now, ids, kept = name, ([], []), ([], [])
                side = int(own != name[1])
                ids[side].append(one)
                kept[side].append(np.frombuffer(batch.column(5)[at].as_py(), np.uint64))
        yield links(now, ids, kept)

    def links(name, ids, kept):
        out = []
        if name is not None:
            side = int(name[1] != name[2])
            if ids[0] and ids[side]:
                n = [np.array([len(s) for s in kept[k]], np.int64) for k in (0, side)]
                common = shared_counts(kept[0], kept[side]).astype(np.int64)
                out = _block_links(ids[0], ids[side], 100 * common >= percent * (n[0][:, None] + n[1][None, :] - common))
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return full.repartition("run", "i", "j").sortWithinPartitions("run", "i", "j").mapInArrow(run, "a BIGINT, b BIGINT")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id``: documents linked by a Jaccard similarity of ``percent`` / 100 or more.

    Keys are distinct integers; rows without a key are left out, and a repeated key counts as one document
    with the smallest component of its rows. Texts with equal shingle sets are one candidate, so
    copies never multiply. Null and empty texts have no shingles and link with nothing. Other columns
    are not read.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    signed_docs = stored(_signed_docs(rows, size), "signatures")
    same = ["h1", "h2", "n_shingles"]
    groups = signed_docs.where("n_shingles > 0").groupBy(*same).agg(F.min(F.struct("id", "keys")).alias("m"))
    reps = stored(groups.select(*same, F.col("m.id").alias("id"), F.col("m.keys").alias("keys")), "representatives")
    width = 2 * DEPTH
    one = F.struct(F.concat(F.unhex(F.lpad(F.hex(F.col("t")), 4, "0")), F.expr(f"substring(keys, t * {width} + 1, {width})")).alias("key"), "id")
    trees = reps.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))).select(one.alias("r")).select("r.*")
    near, crowd = _neighbours(trees, REACH)
    pairs = stored(near.groupBy("a", "b").agg(F.count("*").alias("met"), F.sum("prefix").alias("depth")).where("a <> b"), "pairs")

    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    # Named joins: the plan is the same at every size, and texts move once.
    sets = stored(_sets(rows.join(ends.hint("shuffle_hash"), "id", "left_semi"), size), "sets")
    # Every document's candidates are bounded (trees x reach on both sides), so ranks among them are too.
    each = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"), F.struct("depth", "met", F.xxhash64("a", "b").alias("tie")).alias("rank"))
    best = each.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("rank", "a", "b")), asc=False), 1, FIRST).alias("p"))
    chosen = best.select(F.explode("p").alias("p")).select("p.a", "p.b").distinct()
    first = stored(_confirmed(chosen, sets, percent), "links")
    group = stored(some_components(first), "groups")

    def where(column):
        return group.select(F.col("id").alias(column), F.col("component_id").alias(f"c{column}"))

    rest = pairs.select("a", "b").join(chosen, ["a", "b"], "left_anti").join(where("a"), "a", "left").join(where("b"), "b", "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    second = _confirmed(rest, sets, percent)
    final = components(first.unionByName(second))
    final = stored(final, "joined")
    more = stored(_crowd_links(crowd, sets, reps, final, percent), "crowd-links")
    if not more.isEmpty():
        final = components(final.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(more))

    rep = reps.select(*same, F.col("id").alias("rep")).join(final.select(F.col("id").alias("rep"), "component_id"), "rep", "left")
    rep = rep.select(*same, F.coalesce("component_id", "rep").alias("component_id"))
    rep = stored(rep, "components")
    out = signed_docs.select("id", *same).join(rep, same, "left")
    return out.select(F.col("id").alias(key), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
