"""Near-duplicate vectors by NN-descent.

Equal vectors are merged, and vectors that lie within half the link angle of a leader form a ball: its members
are all linked by the triangle inequality, so a crowded region is one vertex, however many
vectors it holds. The neighbour graph of leaders starts from neighbours in sorted orders of random
sign codes and is refined by joining neighbours of neighbours. A list that is full of links is
saturated and doubles. Recall is audited by brute force on a bounded set of queries, and further
orders and rounds follow until it suffices. Only pairs within the threshold are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver.llm.common import mixed, signed, stored
from quaver.llm.components import components

#: Neighbours in a list at first, sorted orders of one start, and how far an order is looked along.
LIST = 8
ORDERS = 12
REACH = 6
#: Bits of a sign code in an order, and in a leader's bucket.
CODE_BITS = 32
BUCKET_BITS = 16
LEADER_ROUNDS = 3
#: Members that are joined at once around one vertex; more are dealt into several groups.
GROUP = 64
#: Audit: queries (a documented bound, whatever the size of the table) and the recall to reach.
QUERIES = 512
RECALL = 0.95
MOST_STARTS = 4
_SLACK = 1e-6

LISTS = "u BIGINT, v BIGINT, cos DOUBLE"


def _planes(seed: int, bits: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, bits, dim]).normal(size=(dim, bits))


def _codes(x: np.ndarray, seed: int, bits: int) -> np.ndarray:
    signs = x @ _planes(seed, bits, x.shape[1]) > 0
    return (signs.astype(np.int64) << np.arange(bits)[::-1]).sum(axis=1)


def _matrix(column) -> np.ndarray:
    """Unit vectors of one dimension from a binary column."""
    return np.frombuffer(b"".join(v.as_buffer() for v in column), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def unit_vectors(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``id``, ``dim``, ``x``: doubles of the direction as bytes; null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, out = [], []
            for value in batch.column(1):
                x = None if value.as_py() is None else value.values
                good = x is not None and len(x) > 0 and x.null_count == 0
                if good:
                    x = np.asarray(x.to_numpy(zero_copy_only=False), np.float64)
                    good = bool(np.isfinite(x).all()) and bool(x.any())
                if good:
                    x = x / np.abs(x).max()
                    out.append((x / np.sqrt((x * x).sum())).tobytes())
                    dims.append(len(x))
                else:
                    out.append(None)
                    dims.append(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["id", "dim", "x"])

    return vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")).mapInArrow(run, "id BIGINT, dim INT, x BINARY")


def _by_dim(batch: pa.RecordBatch, dims) -> Iterator[np.ndarray]:
    for d in np.unique(dims):
        yield np.flatnonzero(dims == d)


def _coded(rows: DataFrame, seeds: list[int], bits: int) -> DataFrame:
    """``rows`` (id, dim, x) once for each seed, with ``seed`` and ``code``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for at in _by_dim(batch, dims):
                part = batch.take(pa.array(at))
                x = _matrix(part.column(2))
                for seed in seeds:
                    codes = pa.array(_codes(x, seed, bits))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(at), seed), pa.int32()), codes], ["id", "dim", "x", "seed", "code"])

    return rows.select("id", "dim", "x").mapInArrow(run, "id BIGINT, dim INT, x BINARY, seed INT, code BIGINT")


def _cosines(pairs: DataFrame, left: str, right: str, *keep: str) -> DataFrame:
    """``keep`` columns and ``cos`` of two binary columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(keep)
            cos = np.array([np.frombuffer(a.as_buffer(), np.float64) @ np.frombuffer(b.as_buffer(), np.float64) for a, b in zip(batch.column(n), batch.column(n + 1), strict=True)], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(cos)], [*keep, "cos"])

    rows = pairs.select(*keep, left, right)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{fields}, cos DOUBLE")


def _balls(reps: DataFrame, half: float) -> DataFrame:
    """``id``, ``leader``, ``angle`` of every vector; a vector that no leader is near leads itself."""
    left, found = reps.select("id", "dim", "x"), None
    least = math.cos(half)
    for round_ in range(LEADER_ROUNDS):
        coded = stored(_coded(left, [1000 + round_], BUCKET_BITS), "codes")
        leaders = stored(coded.groupBy("dim", "code").agg(F.min_by("x", "id").alias("lx"), F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n"), "leaders")
        near = _cosines(coded.join(leaders, ["dim", "code"]), "x", "lx", "id", "leader").where((F.col("cos") >= least) | (F.col("id") == F.col("leader")))
        near = stored(near, "near")
        led = stored(near.where("id <> leader").select("leader").distinct(), "led")
        joined = stored(near.join(led, "leader"), "joined")
        part = joined.select("id", "leader", F.when(F.col("id") == F.col("leader"), 0.0).otherwise(F.acos(F.least(F.col("cos"), F.lit(1.0)))).alias("angle"))
        found = part if found is None else found.unionByName(part)
        left = stored(left.join(joined.select("id"), "id", "left_anti"), "left")
    alone = left.select("id", F.col("id").alias("leader"), F.lit(0.0).alias("angle"))
    return stored(found.unionByName(alone), "balls")


def _start(vertices: DataFrame, seeds: list[int]) -> DataFrame:
    """Pairs (u, v, cos), both ways, of vertices near each other in some order: each vertex's best of each order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = table.slice(max(0, len(table) - REACH))
            ids, group = table.column(0).to_numpy(), table.column(1).to_numpy() * 100_003 + table.column(3).to_numpy()
            us, vs, cs = [], [], []
            for g in np.unique(group):
                at = np.flatnonzero(group == g)
                x, own = _matrix(table.column(2).take(pa.array(at)).combine_chunks()), ids[at]
                n = len(own)
                cos = np.full((n, 2 * REACH), -2.0)
                for k in range(1, min(REACH, n - 1) + 1):
                    c = np.einsum("ij,ij->i", x[k:], x[:-k])
                    cos[:-k, k - 1] = c
                    cos[k:, REACH + k - 1] = c
                best = np.argsort(-cos, axis=1)[:, :4]
                rows = np.repeat(np.arange(n), best.shape[1])
                shift = best.ravel()
                other = rows + np.where(shift < REACH, shift + 1, REACH - shift - 1)
                value = cos[rows, shift]
                good = value > -2
                us.append(own[rows[good]])
                vs.append(own[other[good]])
                cs.append(value[good])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(cs))], ["u", "v", "cos"])

    coded = _coded(vertices, seeds, CODE_BITS)
    ordered = coded.repartitionByRange("seed", "dim", "code", "id").sortWithinPartitions("seed", "dim", "code", "id")
    return ordered.select("id", "dim", "x", "seed").mapInArrow(run, LISTS)


def _lists(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """The best ``size`` neighbours of each vertex: ``u``, ``v``, ``cos``, ``r`` (reach of v's ball), ``full``.

    A vertex has at most as many different neighbours as came from its bounded lists and their joins.
    """
    own = vertices.select(F.col("id").alias("u"), "size")
    # Both groupings and the join work on one partitioning.
    best = pairs.repartition("u").groupBy("u", "v").agg(F.max("cos").alias("cos")).groupBy("u").agg(F.sort_array(F.collect_list(F.struct("cos", "v")), asc=False).alias("all"))
    cut = best.join(own, "u").select("u", F.slice("all", 1, F.col("size")).alias("l"), "size")
    return cut.select("u", "size", F.explode("l").alias("e")).select("u", "e.v", "e.cos", "size")


def _refine(lists: DataFrame, vertices: DataFrame) -> DataFrame:
    """Pairs that joining neighbours of neighbours finds: each vertex's neighbours, both ways, meet around it.

    Around a vertex that very many name, neighbours meet in groups of GROUP; each group holds the vertex too.
    """
    both = lists.select(F.col("u").alias("c"), F.col("v").alias("m")).unionByName(lists.select(F.col("v").alias("c"), F.col("u").alias("m"))).distinct()
    both = stored(both, "around")
    crowd = stored(both.groupBy("c").agg(F.count("*").alias("n")), "crowd")
    worst = lists.groupBy("u").agg(F.min("cos").alias("cos"), F.count("*").alias("n"), F.first("size").alias("size"))
    floor = worst.select(F.col("u").alias("m"), F.when(F.col("n") >= F.col("size"), F.col("cos")).otherwise(-2.0).alias("floor"))
    deal = both.join(crowd, "c").select("c", F.pmod(F.xxhash64("m"), F.greatest(F.lit(1), F.ceil(F.col("n") / GROUP))).alias("g"), "m")
    rows = deal.join(stored(floor, "floors"), "m", "left").join(vertices.select(F.col("id").alias("m"), "dim", "x"), "m")
    rows = rows.select("c", "g", "m", "dim", "x", F.coalesce("floor", F.lit(-2.0)).alias("floor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            c, g = table.column(0).to_numpy(), table.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(c) != 0) | (np.diff(g) != 0)) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            rest = table.slice(last)
            yield from joined(table.slice(0, last), cuts)
        if rest is not None and len(rest):
            c, g = rest.column(0).to_numpy(), rest.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(c) != 0) | (np.diff(g) != 0)) + 1
            yield from joined(rest, np.append(cuts, len(rest)))

    def joined(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(table):
            return
        ids, dims, floors = table.column(2).to_numpy(), table.column(3).to_numpy(), table.column(5).to_numpy()
        values = table.column(4).combine_chunks()
        same = len(np.unique(dims)) == 1
        x = _matrix(values) if same else None
        us, vs, cs = [], [], []
        for a, b in zip(np.concatenate([[0], cuts[:-1]]), cuts, strict=True):
            if b - a < 2:
                continue
            y = x[a:b] if same else _matrix(values.slice(a, b - a))
            cos = y @ y.T
            np.fill_diagonal(cos, -3.0)
            i, j = np.nonzero(cos > floors[a:b, None])
            us.append(ids[a + i])
            vs.append(ids[a + j])
            cs.append(cos[i, j])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(cs))], ["u", "v", "cos"])

    # Groups of one dimension only: leaders of different dimensions never meet in an order.
    return rows.repartition("c", "g").sortWithinPartitions("c", "g").mapInArrow(run, LISTS)


def _audit(vertices: DataFrame, found: DataFrame, theta: float) -> tuple[int, int]:
    """Links of a bounded set of queries: (found, all), all by brute force over every vertex."""
    spark = vertices.sparkSession
    chosen = vertices.orderBy(F.xxhash64("id"), "id").limit(QUERIES).select("id", "dim", "x", "r").collect()
    shared = spark.sparkContext.broadcast([(q["id"], q["dim"], bytes(q["x"]), q["r"]) for q in chosen])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_dim: dict[int, list] = {}
        for q in shared.value:
            by_dim.setdefault(q[1], []).append(q)
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for at in _by_dim(batch, dims):
                queries = by_dim.get(int(dims[at[0]]), [])
                if not queries:
                    continue
                part = batch.take(pa.array(at))
                ids, r = part.column(0).to_numpy(), part.column(3).to_numpy()
                y = np.frombuffer(b"".join(q[2] for q in queries), np.float64).reshape(len(queries), -1)
                angle = np.arccos(np.clip(_matrix(part.column(2)) @ y.T, -1, 1))
                q_ids, q_r = np.array([q[0] for q in queries]), np.array([q[3] for q in queries])
                i, j = np.nonzero((angle <= theta + r[:, None] + q_r[None, :]) & (ids[:, None] != q_ids[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[j]), pa.array(ids[i])], ["u", "v"])

    truth = vertices.select("id", "dim", "x", "r").mapInArrow(run, "u BIGINT, v BIGINT")
    both = found.select("u", "v").unionByName(found.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().withColumn("hit", F.lit(1))
    row = truth.join(both, ["u", "v"], "left").agg(F.count("hit"), F.count("*")).first()
    return int(row[0]), int(row[1])


def _edges(lists: DataFrame, vertices: DataFrame, theta: float) -> DataFrame:
    """``u`` < ``v``, ``angle``, and both balls' reach and weight, of pairs that may hold a link."""
    pairs = lists.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "cos").groupBy("u", "v").agg(F.max("cos").alias("cos"))
    for c in ("u", "v"):
        pairs = pairs.join(vertices.select(F.col("id").alias(c), F.col("r").alias(f"r{c}"), F.col("weight").alias(f"w{c}")), c)
    pairs = pairs.withColumn("angle", F.acos(F.greatest(F.least("cos", F.lit(1.0)), F.lit(-1.0))))
    return pairs.where(F.col("angle") <= theta + F.col("ru") + F.col("rv") + _SLACK)


def _member_counts(unsure: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """For pairs of balls that are neither all linked nor all apart: ``id`` (a distinct vector), ``other`` ball, linked weight there.

    Members of one ball meet those of the other in blocks of a bounded number; counts leave, not pairs.
    """
    both = unsure.select("u", "v").unionByName(unsure.select(F.col("v").alias("u"), F.col("u").alias("v")))
    size = members.groupBy("leader").agg(F.count("*").alias("n"))
    blocks = members.join(stored(size, "sizes"), "leader").groupBy("leader", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / 256)).alias("block"))
    blocks = blocks.agg(F.collect_list(F.struct("x", "n_equal")).alias("them")).select(F.col("leader").alias("v"), "them")
    mine = members.select(F.col("leader").alias("u"), "id", "x")
    rows = both.join(mine, "u").join(stored(blocks, "blocks"), "v").select("id", "v", "x", "them")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for x, them in zip(batch.column(2), batch.column(3), strict=True):
                inner = them.values
                y = _matrix(inner.field("x"))
                cos = y @ np.frombuffer(x.as_buffer(), np.float64)
                counts.append(int(inner.field("n_equal").to_numpy(zero_copy_only=False)[cos >= least].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], ["id", "other", "n"])

    return rows.mapInArrow(run, "id BIGINT, other BIGINT, n BIGINT").groupBy("id", "other").agg(F.sum("n").alias("n")).where("n > 0")


def near_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", least: float = 0.95) -> DataFrame:
    """``key``, ``n_links``, ``component_id``: vectors linked by a cosine of ``least`` or more.

    Null, empty and zero vectors and vectors with null or non-finite components link with nothing; nor do vectors
    of different lengths with each other. Keys are distinct integers; rows without a key are left out.
    Other columns are not read.
    """
    spark = vectors.sparkSession
    theta = math.acos(least)
    units = stored(unit_vectors(vectors.where(F.col(key).isNotNull()), key, column), "units")
    usable = units.where("x IS NOT NULL")
    reps = stored(usable.groupBy("dim", "x").agg(F.min("id").alias("id"), F.count("*").alias("n_equal")), "distinct")
    balls = _balls(reps, theta / 2 - _SLACK)
    members = stored(reps.join(balls, "id").select("id", "leader", "angle", "n_equal", "x", "dim"), "members")
    shape = members.groupBy("leader").agg(F.max("angle").alias("r"), F.sum("n_equal").alias("weight"), F.min("id").alias("least_id"))
    vertices = reps.select("id", "dim", "x").join(stored(shape, "shapes").withColumnRenamed("leader", "id"), "id")
    vertices = stored(vertices.withColumn("size", F.lit(LIST)), "vertices")

    lists, recall = None, (0, 0)
    for start in range(MOST_STARTS):
        pairs = _start(vertices, [start * ORDERS + i for i in range(ORDERS)])
        if lists is not None:
            pairs = pairs.unionByName(lists.select("u", "v", "cos"))
        lists = stored(_lists(pairs, vertices), "lists")
        while True:
            pairs = _refine(lists, vertices).unionByName(lists.select("u", "v", "cos"))
            lists = stored(_lists(pairs, vertices), "lists")
            # A list that holds nothing but links may lack some: it doubles, and the join is repeated.
            reach = vertices.select(F.col("id").alias("v"), F.col("r").alias("rv"))
            judged = lists.join(reach, "v").join(vertices.select(F.col("id").alias("u"), F.col("r").alias("ru")), "u")
            full = judged.groupBy("u", "size").agg(F.count("*").alias("n"), F.min((F.acos(F.greatest(F.least("cos", F.lit(1.0)), F.lit(-1.0))) <= theta + F.col("ru") + F.col("rv")).cast("int")).alias("all"))
            full = stored(full.where("n >= size AND all = 1").select(F.col("u").alias("id"), F.lit(2).alias("grow")), "saturated")
            if full.isEmpty():
                break
            vertices = stored(vertices.join(full, "id", "left").withColumn("size", F.col("size") * F.coalesce("grow", F.lit(1))).drop("grow"), "vertices")
        edges = stored(_edges(lists, vertices, theta), "edges")
        recall = _audit(vertices, edges, theta)
        if recall[0] >= RECALL * recall[1]:
            break

    whole = edges.where(F.col("angle") + F.col("ru") + F.col("rv") <= theta - _SLACK)
    plain = edges.where("ru = 0 AND rv = 0").where(F.col("cos") >= least)
    unsure = edges.where((F.col("ru") + F.col("rv") > 0) & (F.col("angle") + F.col("ru") + F.col("rv") > theta - _SLACK))
    sure = whole.where("ru + rv > 0").unionByName(plain)
    ball_links = sure.select(F.col("u").alias("leader"), F.col("wv").alias("n")).unionByName(sure.select(F.col("v").alias("leader"), F.col("wu").alias("n")))
    ball_links = ball_links.groupBy("leader").agg(F.sum("n").alias("more"))
    partial = stored(_member_counts(unsure, members, least), "partial")
    crossed = partial.join(members.select("id", "leader"), "id").select(F.col("leader").alias("a"), F.col("other").alias("b"))
    groups = components(sure.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(crossed))
    named = vertices.select(F.col("id").alias("leader"), "weight", "least_id").join(groups.withColumnRenamed("id", "leader"), "leader", "left")
    named = stored(named.withColumn("root", F.coalesce("component_id", "leader")).drop("component_id"), "named")
    smallest = stored(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "smallest")
    per_ball = named.join(smallest, "root").join(stored(ball_links, "ball-links"), "leader", "left").select("leader", "component_id", (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("n"))
    own = stored(partial.groupBy("id").agg(F.sum("n").alias("own")), "own")
    per_rep = members.select("id", "leader", "dim", "x").join(stored(per_ball, "per-ball"), "leader").join(own, "id", "left")
    per_rep = stored(per_rep.select("dim", "x", "component_id", (F.col("n") + F.coalesce("own", F.lit(0))).alias("n_links")), "per-vector")
    linked = units.join(per_rep, ["dim", "x"], "left")
    return linked.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
