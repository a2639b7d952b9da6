"""Prefix trie of conversations, rolled up in bands of depth.

Turns are ranked within their conversation by a range sort that cuts hot conversations too, and travel from there as
128-bit digests in chunks of bounded length; texts do not move again. A prefix is named by the sum of its
turns' digests, each mixed with its depth, so that prefixes of a conversation that lies in many chunks follow from running sums.

Subtree sums: the trie is cut into bands of HEIGHT depths. A node explodes only to its ancestors inside its band;
the band roots form a smaller trie, rolled up in the same way, and their completed totals are then added to the ancestors
in the band above. A trie of depth d takes log(d) rounds to base HEIGHT, and no node more than HEIGHT rows a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.llm.common import mixed, signed, stored

HEIGHT = 8
#: Turns in one chunk, and conversation ids in one piece of a list of ends.
CHUNK = 1024
IDS = 4096
#: Parts into which the children of one node are dealt when they look up their parent.
SLOTS = 64
#: Conversations c - c % SHARED lend their first turns to the conversations after them, fewer than HEADS each.
SHARED, HEADS = 100, 6

_TURN = "conv LONG, start LONG, d1 ARRAY<LONG>, d2 ARRAY<LONG>, chars ARRAY<INT>"


def head_length(conv: Column) -> Column:
    """How many turns a conversation takes from its base: unsigned crc32 of its decimal id, modulo HEADS."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns of one partition as chunks: (part, conv, start within the partition, digests, characters).

    A chunk ends with its conversation, after CHUNK turns or with the batch.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    now, seen = None, 0
    for batch in batches:
        conv = np.asarray(batch.column(0), np.int64)
        n = len(conv)
        if not n:
            continue
        begins = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        nth = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
        cuts = np.flatnonzero(nth % CHUNK == 0)
        start = nth[cuts]
        if conv[0] == now:
            start = np.where(conv[cuts] == now, start + seen, start)
        else:
            seen = 0
        seen = int(nth[-1]) + 1 + (seen if len(begins) == 1 else 0)
        now = conv[-1]
        offsets = pa.array(np.append(cuts, n), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, batch.column(i)) for i in (1, 2, 3)]
        columns = [pa.array(np.full(len(cuts), part), pa.int32()), pa.array(conv[cuts]), pa.array(start, pa.int64()), *lists]
        yield pa.RecordBatch.from_arrays(columns, ["part", "conv", "start", "d1", "d2", "chars"])


def turn_chunks(conversations: DataFrame) -> DataFrame:
    """(conv, start, d1, d2, chars) of each conversation's turns in order, at most CHUNK a row.

    Order: turn, nulls first; equal turns by role, then text. Rows without a conversation id are left out.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", text("role").alias("role"), text("text").alias("text")
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    slim = dealt.select(
        "conv",
        F.xxhash64(F.lit(1), "role", "text").alias("d1"),
        F.xxhash64(F.lit(2), "role", "text").alias("d2"),
        F.length("text").alias("chars"),
    )
    local = stored(slim.mapInArrow(_chunks, "part INT, " + _TURN), "trie-turns")
    # A conversation that goes on in the next partition starts there after all that came before: one small row a partition.
    edges = local.groupBy("part").agg(
        F.min("conv").alias("first"), F.max(F.struct("conv", (F.col("start") + F.size("d1")).alias("n"))).alias("last")
    )
    begun, offsets = {}, []
    for r in edges.orderBy("part").collect():
        if r["first"] in begun:
            offsets.append((r["part"], r["first"], begun[r["first"]]))
        begun = {r["last"]["conv"]: r["last"]["n"] + (begun.get(r["last"]["conv"], 0) if r["first"] == r["last"]["conv"] else 0)}
    if not offsets:
        return local.drop("part")
    before = conversations.sparkSession.createDataFrame(offsets, "part INT, conv LONG, before LONG")
    moved = local.join(F.broadcast(before), ["part", "conv"], "left")  # a row a partition at most
    return moved.select("conv", (F.col("start") + F.coalesce("before", F.lit(0))).alias("start"), "d1", "d2", "chars")


def rebuilt_chunks(chunks: DataFrame) -> DataFrame:
    """(conv, start, d1, d2, chars, total, head): the rebuilt conversations, each with a chunk for its head, be it empty."""
    sizes = chunks.groupBy("conv").agg(F.sum(F.size("d1")).cast("long").alias("n"))
    entries = F.arrays_zip("d1", "d2", "chars")
    first = chunks.where((F.col("conv") % SHARED == 0) & (F.col("start") < HEADS))
    # A base's first turns may lie in several chunks; at most HEADS entries of each are kept.
    base = (
        first.select("conv", F.struct("start", F.slice(entries, 1, HEADS).alias("e")).alias("c"))
        .groupBy("conv")
        .agg(F.slice(F.flatten(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["e"])), 1, HEADS).alias("head"))
    )
    convs = sizes.select("conv", "n", head_length(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % SHARED).alias("base"))
    joined = convs.join(base.select(F.col("conv").alias("base"), "head"), "base", "left")  # fewer than SHARED conversations a base
    none = F.array().cast("array<struct<d1:bigint,d2:bigint,chars:int>>")
    head = F.when(F.col("h") > 0, F.slice(F.col("head"), 1, F.greatest(F.col("h"), F.lit(1)).cast("int")))
    built = joined.select("conv", "h", "n", F.coalesce(head, none).alias("e")).withColumn("k", F.size("e"))
    total = F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    built = built.select("conv", "h", "k", "e", total.alias("total"))
    fields = [F.col("e")[name].alias(name) for name in ("d1", "d2", "chars")]
    heads = built.select("conv", F.lit(0).cast("long").alias("start"), *fields, "total", F.lit(True).alias("head"))
    own = chunks.join(built.drop("e"), "conv")  # chunks of CHUNK turns: a hot conversation is few rows
    cut = F.greatest(F.col("h") - F.col("start"), F.lit(0)).cast("int")
    kept = [F.slice(c, cut + 1, F.greatest(F.size(c), F.lit(1))).alias(c) for c in ("d1", "d2", "chars")]
    own = own.where(F.col("start") + F.size("d1") > F.col("h"))
    own = own.select("conv", (F.greatest("start", F.col("h")) - F.col("h") + F.col("k")).alias("start"), *kept, "total", F.lit(False).alias("head"))
    return heads.unionByName(own)


def _mix(d: np.ndarray, depth: np.ndarray, lane: int) -> np.ndarray:
    """A turn's digest at its depth."""
    return mixed(d.view(np.uint64) + mixed(depth.astype(np.uint64), lane), lane + 2)


_HALVES = [f"{h}{lane}" for lane in (1, 2) for h in ("high", "low")]


def _lists(batch: pa.RecordBatch, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, depth of each entry's turn, d1, d2, chars) of the chunk columns from ``start`` on."""
    sizes = np.asarray(batch.column(start + 1).value_lengths(), np.int64)
    nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    depth = np.repeat(np.asarray(batch.column(start), np.int64), sizes) + nth + 1
    return sizes, depth, *[np.asarray(batch.column(start + i).flatten()) for i in (1, 2, 3)]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk the digest sums modulo 2**64, as halves that further sums cannot overflow."""
    for batch in batches:
        sizes, depth, *lanes = _lists(batch, 1)
        ends = np.cumsum(sizes)
        halves = []
        for lane in (0, 1):
            run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(lanes[lane], depth, lane + 1))])
            value = run[ends] - run[ends - sizes]
            halves += [(value >> np.uint64(32)).astype(np.int64), (value & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, halves)], [*batch.schema.names, *_HALVES])


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per prefix of a chunk: (conv, t, a, b, chars, ended), t its depth; the head chunk adds the root."""
    for batch in batches:
        sizes, depth, d1, d2, chars = _lists(batch, 1)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        conv, total = np.asarray(batch.column(0)), np.asarray(batch.column(5))
        names = []
        for lane, d in ((0, d1), (1, d2)):
            high, low = (np.asarray(batch.column(6 + 2 * lane + i)).astype(np.uint64) for i in (0, 1))
            before = (high << np.uint64(32)) + low
            run = np.cumsum(_mix(d, depth, lane + 1))
            begins = np.cumsum(sizes) - sizes
            offset = before - np.concatenate([np.zeros(1, np.uint64), run])[begins]
            names.append(run + np.repeat(offset, sizes))
        root = np.asarray(batch.column(10))
        n = int(root.sum())
        columns = [
            np.concatenate([conv[owner], conv[root]]),
            np.concatenate([depth, np.zeros(n, np.int64)]),
            np.concatenate([signed(names[0]), np.zeros(n, np.int64)]),
            np.concatenate([signed(names[1]), np.zeros(n, np.int64)]),
            np.concatenate([chars.astype(np.int64), np.zeros(n, np.int64)]),
            np.concatenate([depth == total[owner], total[root] == 0]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["conv", "t", "a", "b", "chars", "ended"])


def prefixes(chunks: DataFrame) -> DataFrame:
    """(conv, t, a, b, chars, ended): each conversation's prefixes by name (a, b), from the root (0, 0) on."""
    kinds = ", ".join(f"{h} LONG" for h in _HALVES)
    summed = chunks.mapInArrow(_totals, f"{_TURN}, total LONG, head BOOLEAN, {kinds}")
    # An empty head chunk starts where the first own one does, and adds nothing.
    earlier = "OVER (PARTITION BY conv ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    before = [F.expr(f"coalesce(sum({h}) {earlier}, 0)").alias(h) for h in _HALVES]
    run = summed.select("conv", "start", "d1", "d2", "chars", "total", *before, "head")
    return run.mapInArrow(_names, "conv LONG, t LONG, a LONG, b LONG, chars LONG, ended BOOLEAN")


def _banded(rows: DataFrame, extra: list[str]) -> DataFrame:
    """(conv, band, path): a conversation's prefixes in each band, with the next band's root at the end.

    ``rows``: (conv, t, a, b, extra) with t = 0, 1, ... in each conversation. At most HEIGHT + 1 entries a row.
    """
    t = F.col("t")
    band = F.floor(t / HEIGHT)
    both = F.when((t % HEIGHT == 0) & (t > 0), F.array(band - 1, band)).otherwise(F.array(band))
    entry = F.struct("t", "a", "b", *extra)
    return rows.select("conv", F.explode(both).alias("band"), entry.alias("e")).groupBy("conv", "band").agg(F.array_sort(F.collect_list("e")).alias("path"))


def _paths(bands: DataFrame, nodes: DataFrame) -> DataFrame:
    """(t, a, b, up) once for each node but the root: its ancestors within its band, farthest first, or for a band's root the band above.

    ``nodes``: (t, a, b, conv) with the smallest member. What a conversation is the smallest member of is the end of
    its path, so a band's first such depth marks the entries to take.
    """
    t = F.col("t")
    above = F.when(t % HEIGHT == 0, t / HEIGHT - 1).otherwise(F.floor(t / HEIGHT)).cast("long")
    since = nodes.where(t > 0).select("conv", above.alias("band"), "t").groupBy("conv", "band").agg(F.min("t").alias("since"))
    joined = bands.join(since, ["conv", "band"])  # one row of each side
    at = joined.select("path", "since", F.posexplode("path").alias("i", "e")).where("i > 0 AND e.t >= since")
    up = F.transform(F.slice("path", 1, F.col("i")), lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b")))
    return at.select("e.t", "e.a", "e.b", up.alias("up"))


def subtree_sums(bands: DataFrame, nodes: DataFrame, values: list[str], deepest: int, paths: DataFrame | None = None) -> DataFrame:
    """(a, b, values summed over the subtree) of each node of a trie whose depths are t = 0 .. ``deepest``.

    ``bands``: conversations' paths by band; ``nodes``: (t, a, b, conv, values).
    """
    up = (paths if paths is not None else stored(_paths(bands, nodes), "trie-paths")).select("t", "a", "b", "up")
    own = nodes.select("t", "a", "b", *values)
    inside = own.join(up.select("a", "b", "up"), ["a", "b"], "left")
    me = F.struct("a", "b")
    sums = lambda: [F.sum(v).cast("long").alias(v) for v in values]
    in_band = F.when((F.col("t") % HEIGHT == 0) | F.col("up").isNull(), F.array(me)).otherwise(F.concat("up", F.array(me)))
    credit = inside.select(F.explode(in_band).alias("to"), *values)
    if deepest < HEIGHT:
        return credit.groupBy("to.a", "to.b").agg(*sums())
    # A band's own sum reaches its root, and the roots are a trie of their own.
    root = F.when((F.col("t") % HEIGHT == 0) | F.col("up").isNull(), me).otherwise(F.get("up", F.lit(0)))
    held = inside.select(root.alias("to"), *values).groupBy("to.a", "to.b").agg(*sums())
    roots = nodes.where(F.col("t") % HEIGHT == 0).select((F.col("t") / HEIGHT).cast("long").alias("t"), "a", "b", "conv").join(held, ["a", "b"])
    roots = stored(roots, "trie-roots")
    steps = bands.select("conv", F.col("band").alias("t"), F.get("path", F.lit(0)).alias("e"))
    above = stored(_banded(steps.select("conv", "t", "e.a", "e.b"), []), "trie-bands")
    complete = stored(subtree_sums(above, roots, values, deepest // HEIGHT), "trie-totals")
    # A completed root adds to the band above it; its own subtree is what its total says.
    lent = complete.join(up.where(F.col("t") % HEIGHT == 0).select("a", "b", "up"), ["a", "b"]).select(F.explode("up").alias("to"), *values)
    everything = credit.unionByName(lent)
    return everything.groupBy("to.a", "to.b").agg(*sums())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, conv) as joined lists of at most IDS ids: (a, b, first id, list)."""
    now, ids = None, []
    out: list[tuple] = []

    def table() -> pa.RecordBatch:
        a, b, first, text = zip(*out, strict=True)
        arrays = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(first, pa.int64()), pa.array(text, pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["a", "b", "first", "ids"])

    for batch in batches:
        for a, b, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (a, b) != now or len(ids) == IDS:
                if ids:
                    out.append((*now, ids[0], ",".join(map(str, ids))))
                now, ids = (a, b), []
            ids.append(conv)
        if len(out) >= IDS:
            yield table()
            out.clear()
    if ids:
        out.append((*now, ids[0], ",".join(map(str, ids))))
    if out:
        yield table()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as one digest a node, fed piece by piece."""
    now, state = None, None
    out: list[tuple] = []

    def table() -> pa.RecordBatch:
        a, b, text = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(text, pa.string())], ["a", "b", "ends_sha256"])

    for batch in batches:
        a, b, ids = (batch.column(i).to_pylist() for i in (0, 1, 3))
        for key, text in zip(zip(a, b, strict=True), ids, strict=True):
            if key == now:
                state.update(b",")
            else:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            state.update(text.encode())
        if len(out) >= IDS:
            yield table()
            out.clear()
    if now is not None:
        out.append((*now, state.hexdigest()))
    if out:
        yield table()


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of (a, b, conv): the digest of each node's ids, ascending and comma-joined.

    A range sort cuts the ids of a hot node into pieces in many tasks. SHA-256 itself is a chain, so one task feeds a
    node's pieces, IDS ids a row, to its digest as a stream; it holds one piece at a time.
    """
    order = ["a", "b", "conv"]
    pieces = stored(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "a LONG, b LONG, first LONG, ids STRING"), "trie-ends")
    dealt = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return dealt.mapInArrow(_digests, "a LONG, b LONG, ends_sha256 STRING")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations, one row per node.

    ``conversations``: (conv_id, turn, role, text); other columns are not read, whatever their names. Turns are ordered by turn
    (nulls first), then role and text, so tied and repeated rows have a defined place; null roles and texts are empty. Rows without
    conv_id belong to no conversation. Conversation c is rebuilt from the first h turns of conversation c - c % 100
    (h: ``head_length``) and its own turns after its first h. Columns: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. An empty table has no node.
    """
    bands = stored(_banded(prefixes(rebuilt_chunks(turn_chunks(conversations))), ["chars", "ended"]), "trie-bands")
    # The next band's root ends a path and begins the next one: it counts there.
    entries = bands.select("conv", "band", F.explode("path").alias("e")).where(F.col("e.t") < (F.col("band") + 1) * HEIGHT)
    nodes = entries.groupBy(F.col("e.t").alias("t"), F.col("e.a").alias("a"), F.col("e.b").alias("b")).agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.max("e.chars").alias("chars")
    )
    nodes = stored(nodes, "trie-nodes")
    paths = stored(_paths(bands, nodes), "trie-paths")
    parent = F.element_at("up", -1)
    links = paths.select("a", "b", parent["a"].alias("pa"), parent["b"].alias("pb"), F.pmod(F.xxhash64("a", "b"), F.lit(SLOTS)).alias("slot"))
    # Children are counted in slots first, and look their parent up by slot: a hot parent's children go to SLOTS tasks.
    slots = stored(links.groupBy("pa", "pb", "slot").agg(F.count(F.lit(1)).alias("n")), "trie-slots")
    children = slots.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.sum("n").alias("n_children"))
    counted = nodes.join(children, ["a", "b"], "left").na.fill(0, ["n_children"])
    values = counted.select(
        "t", "a", "b", "conv", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")
    )
    deepest = nodes.agg(F.max("t")).first()[0] or 0
    totals = subtree_sums(bands, values, ["n_leaves", "saved_tokens"], deepest, paths)
    named = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv").alias("parent_conv_id"))
    parents = links.join(slots.drop("n").join(named, ["pa", "pb"]), ["pa", "pb", "slot"]).select("a", "b", "parent_conv_id")
    ends = end_digests(entries.where("e.ended").select("e.a", "e.b", "conv"))
    none = hashlib.sha256(b"").hexdigest()
    found = counted.join(totals, ["a", "b"]).join(parents, ["a", "b"], "left").join(ends, ["a", "b"], "left")
    return found.select(
        F.col("conv").alias("conv_id"),
        F.col("t").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
