"""Tree ensembles on binned features: a random forest and softmax boosting.

Features are cut into at most BINS bins at quantiles of a sample that a hash of the row id draws, so that bins, bags and trees do not
depend on how rows are dealt to partitions. Counts are whole numbers, and so exact in any order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.operators.bounded import reuse, settled
from quaver.operators.linear import MOST_CLASSES
from quaver.operators.passes import dealt, release, sums

BINS = 32
#: Rows whose values set the bins.
SAMPLE = 10_000
#: Weighted rows up to which a node's whole subtree is grown by one task.
LOCAL = 1 << 16
#: Nodes whose histograms one pass adds up.
NODES = 256
#: Rows from which a node of a subtree is split by a histogram instead of sorted values, counts of histograms held at once, and votes.
WIDE, CELLS = 64, 1 << 20
#: Features are held densely; more than this is a table for linear models.
MOST_FEATURES = 4096
#: Rounds of boosting after which margins are written into the blocks.
ROUNDS_KEPT = 10
#: Rounds after which those blocks are settled: plans hold the plans of the kept tables that theirs came from, and the driver keeps a plan for each pass.
ROUNDS_SETTLED = 100
#: Rows of a block in boosting, whose arrays of a pass stay in a core's cache, and bytes of bins that a task of a pass reads, in forests too:
#: a pass does much for each row.
BOOST_ROWS, BOOST_BYTES = 2048, 1 << 20
#: Probabilities are added as whole multiples of 2**-40.
_UNIT = float(1 << 40)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeded(seed: int, *numbers) -> np.ndarray:
    out = _mixed(np.array(seed, np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for n in numbers:
        with np.errstate(over="ignore"):
            out = _mixed(out * np.uint64(0xD1342543DE82EF95) + np.asarray(n).astype(np.uint64) + np.uint64(1))
    return out


#: Poisson(1): a row's weight is the number of these sums that its draw reaches.
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(20)])


def bag_weights(seed: int, tree: int, keys: np.ndarray) -> np.ndarray:
    """Bootstrap weights of rows: a function of seed, tree and row key alone."""
    draw = _seeded(seed, np.uint64(tree), keys.view(np.uint64)).astype(np.float64) / 2.0**64
    return np.searchsorted(_POISSON, draw, side="right")


def bin_edges(rows: DataFrame, row_id: str) -> list[np.ndarray]:
    """Ascending cuts of each feature, a value above k of them is in bin k. From at most SAMPLE rows."""
    keyed = rows.select(F.xxhash64(row_id).alias("k"), vector_to_array("features").alias("v"))
    # Each task returns as many rows as the sample has, so those that cannot be among the smallest go first; equal keys may leave too few.
    n = rows.count()
    below = min(2 * SAMPLE * (1 << 64) // max(1, n), (1 << 64) - 1) - (1 << 63)
    sample = keyed.where(F.col("k") <= F.lit(below)).orderBy("k", "v").limit(SAMPLE).collect()
    if len(sample) < min(n, SAMPLE):
        sample = keyed.orderBy("k", "v").limit(SAMPLE).collect()
    if not sample:
        raise ValueError("no training rows")
    x = np.array([r["v"] for r in sample])
    if x.shape[1] > MOST_FEATURES:
        raise ValueError(f"over {MOST_FEATURES} features")
    out = []
    for column in x.T:
        values = np.unique(column[np.isfinite(column)])
        if len(values) > BINS:
            values = np.unique(np.quantile(column[np.isfinite(column)], np.arange(1, BINS) / BINS, method="lower"))
            out.append(values)
        else:
            out.append((values[1:] + values[:-1]) / 2)
    return out


_BLOCK = "n INT, keys BINARY, label BINARY, bins BINARY"


def binned(rows: DataFrame, row_id: str, edges: list[np.ndarray], classes: list[float], most: int | None = None) -> DataFrame:
    """Blocks (n, keys, label codes, bins) of the rows, ``most`` rows each at most; features that are not finite are in the last bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, most) for b in batches for at in range(0, b.num_rows, most)) if most else batches:
            n = batch.num_rows
            bins = to_bins(batch.column(2), n, edges)
            label = np.searchsorted(np.array(classes), np.asarray(batch.column(1))).astype(np.int32)
            parts = [np.asarray(batch.column(0), np.int64), label, bins]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], ["n", "keys", "label", "bins"])

    slim = rows.select(F.xxhash64(row_id).alias("key"), F.col("label").cast("double").alias("label"), vector_to_array("features").alias("v"))
    return slim.mapInArrow(run, _BLOCK)


def to_bins(lists: pa.Array, n: int, edges: list[np.ndarray]) -> np.ndarray:
    x = np.asarray(lists.flatten(), np.float64).reshape(n, len(edges))
    return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.uint8) if edges else np.zeros((n, 0), np.uint8)


def _open(batch: pa.RecordBatch, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, label, bins = (np.frombuffer(batch.column(i + 1)[k].as_buffer(), t) for i, t in enumerate((np.int64, np.int32, np.uint8)))
    return keys, label, bins.reshape(len(keys), width)


def _classes(rows: DataFrame) -> list[float]:
    found = sorted(r[0] for r in rows.select(F.col("label").cast("double")).distinct().limit(MOST_CLASSES + 1).collect())
    if not found:
        raise ValueError("no training rows")
    if len(found) > MOST_CLASSES:
        raise ValueError(f"over {MOST_CLASSES} labels")
    return found


def _values() -> Column:
    """The features as an array, null where there are none."""
    return F.when(F.col("features").isNotNull(), vector_to_array("features"))


def _usable(rows: DataFrame) -> DataFrame:
    return rows.where("label IS NOT NULL AND features IS NOT NULL")


# Random forest.


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Weighted entropy n * H along the last axis."""
    total = counts.sum(axis=-1)
    part = np.where(counts > 0, counts * np.log(np.maximum(counts, 1)), 0.0).sum(axis=-1)
    return np.where(total > 0, total * np.log(np.maximum(total, 1)), 0.0) - part


def best_split(hist: np.ndarray, order: np.ndarray, most: int) -> tuple[int, int] | None:
    """(feature, last bin of the left side) of the largest fall in entropy among the first ``most`` features of ``order`` that vary; ties to the smaller."""
    varied = order[((hist[order].sum(axis=2) > 0).sum(axis=1) > 1)][:most]
    if not len(varied):
        return None
    varied = np.sort(varied)
    left = np.cumsum(hist[varied], axis=1)[:, :-1]
    whole = hist[varied[0]].sum(axis=0)
    right = whole - left
    cost = _entropy(left) + _entropy(right)
    cost = np.where((left.sum(axis=2) > 0) & (right.sum(axis=2) > 0), cost, np.inf)
    at = int(np.round(cost, 9).argmin())
    return int(varied[at // cost.shape[1]]), at % cost.shape[1]


def _histogram(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, n_classes: int) -> np.ndarray:
    """(features, bins, classes) weighted counts."""
    width = bins.shape[1]
    place = (np.arange(width) * BINS + bins) * n_classes + label[:, None]
    return np.bincount(place.ravel(), np.repeat(weight, width), minlength=width * BINS * n_classes).reshape(width, BINS, n_classes)


def _feature_order(seed: int, name: int, width: int) -> np.ndarray:
    return np.argsort(_seeded(seed, np.uint64(name), np.arange(width)), kind="stable")


def _feature_orders(seed: int, names: np.ndarray, width: int) -> np.ndarray:
    """:func:`_feature_order` of many nodes."""
    draw = _seeded(seed, names[:, None], np.arange(width))
    # Numbers alone sort faster than their order: the feature takes the lowest bits, unless draws are alike above them.
    bits = np.uint64(max(1, (width - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    ranked = np.sort(draw & ~low | np.arange(width, dtype=np.uint64), axis=1)
    if (ranked[:, 1:] >> bits == ranked[:, :-1] >> bits).any():
        return np.argsort(draw, axis=1, kind="stable")
    return (ranked & low).astype(np.int64)


def _child(name: int, side: int) -> int:
    return int(_seeded(side, np.uint64(name)))


@dataclass
class Tree:
    """Nodes in parallel lists; ``feature`` -1 is a leaf, -2 a node whose subtree a task grows."""

    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    left: list = field(default_factory=list)
    right: list = field(default_factory=list)
    name: list = field(default_factory=list)
    counts: list = field(default_factory=list)

    def add(self, name: int, counts: np.ndarray) -> int:
        for column, value in zip((self.feature, self.cut, self.left, self.right, self.name, self.counts), (-1, 0, 0, 0, name, counts), strict=True):
            column.append(value)
        return len(self.name) - 1

    def split(self, node: int, feature: int, cut: int, counts: tuple) -> tuple[int, int]:
        children = tuple(self.add(_child(self.name[node], side), c) for side, c in enumerate(counts, 1))
        self.feature[node], self.cut[node], (self.left[node], self.right[node]) = feature, cut, children
        return children

    def route(self, bins: np.ndarray) -> np.ndarray:
        return route(bins, *[np.array(c, np.int64) for c in (self.feature, self.cut, self.left, self.right)])


def route(bins: np.ndarray, feature, cut, left, right) -> np.ndarray:
    """Node at which each row stops."""
    at, moving = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(moving):
        moving = moving[feature[at[moving]] >= 0]
        node = at[moving]
        at[moving] = np.where(bins[moving, feature[node]] <= cut[node], left[node], right[node])
    return at


def _logs(most: int) -> np.ndarray:
    """n * log(n) of whole numbers up to ``most``."""
    n = np.arange(most + 1, dtype=np.float64)
    return n * np.log(np.maximum(n, 1))


def _costs(left: np.ndarray, whole: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Rounded entropies of both sides; infinite where a side is empty."""
    below = above = held = lost = 0
    for c in range(left.shape[-1]):
        own, other = left[..., c], whole[..., c] - left[..., c]
        below, above = below + own, above + other
        held, lost = held + logs[own], lost + logs[other]
    cost = (logs[below] - held) + (logs[above] - lost)
    return np.where((below > 0) & (above > 0), np.round(cost, 9), np.inf)


def _split_wide(values, label, weight, node, features, chosen, counts, logs) -> tuple[np.ndarray, np.ndarray]:
    """(feature, cut) of each node by histograms of its chosen features, which ascend."""
    n, most, k = *features.shape, counts.shape[1]
    place = ((node[:, None] * most + np.arange(most)) * BINS + values) * k + label[:, None]
    hist = np.bincount(place.ravel(), np.repeat(weight, most), minlength=n * most * BINS * k).astype(np.int32).reshape(n, most, BINS, k)
    cost = _costs(np.cumsum(hist, axis=2)[:, :, :-1], counts[:, None, None, :], logs)
    cost = np.where(chosen[:, :, None], cost, np.inf).reshape(n, -1)
    at = cost.argmin(axis=1)
    return features[np.arange(n), at // (BINS - 1)], at % (BINS - 1)


def _split_narrow(values, label, weight, node, features, chosen, counts, logs) -> tuple[np.ndarray, np.ndarray]:
    """The same by sorted values: the work follows the rows, not the bins."""
    n, most, k = *features.shape, counts.shape[1]
    low, high = max(1, int(weight.max()).bit_length()), max(1, (k - 1).bit_length())
    pair = node[:, None] * most + np.arange(most)
    key = ((pair * BINS + values) << high | label[:, None]) << low | weight[:, None]
    key = np.sort(key[chosen[node]])
    own, group = key & ((1 << low) - 1), key >> (low + high)
    name = key >> low & ((1 << high) - 1)
    last = np.flatnonzero(np.append(group[1:] != group[:-1], True))
    pair, value = group[last] // BINS, group[last] % BINS
    left = np.empty((len(last), k), np.int64)
    for c in range(k):
        left[:, c] = np.cumsum(np.where(name == c, own, 0))[last]
    # What lies ahead of a pair's first value is that of the pairs before it.
    opens = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    ahead = np.where(opens[:, None] > 0, left[opens - 1], 0)
    left -= np.repeat(ahead, np.diff(np.append(opens, len(pair))), axis=0)
    at = pair // most
    cost = _costs(left, counts[at], logs)
    begin = np.searchsorted(at, np.arange(n))
    least = np.minimum.reduceat(cost, begin)
    hit = np.flatnonzero(cost == least[at])
    hit = hit[np.searchsorted(at[hit], np.arange(n))]
    return features[np.arange(n), pair[hit] % most], value[hit]


def grow(name: int, bins: np.ndarray, label: np.ndarray, weight: np.ndarray, n_classes: int, seed: int, most: int) -> dict[str, np.ndarray]:
    """A whole subtree, until its nodes are pure or no feature varies: ``feature`` (-1 is a leaf), ``cut``, ``left`` (the right child follows it) and ``counts``.

    All nodes of a depth are split together, as :func:`best_split` splits one; rows (of some weight each) lie node by node.
    """
    width, k = bins.shape[1], n_classes
    label, weight = label.astype(np.int64), weight.astype(np.int64)
    logs = _logs(int(weight.sum()))
    names, sizes, at = np.array([name], np.uint64), np.array([len(label)]), np.arange(len(label))
    out: dict[str, list] = {"feature": [], "cut": [], "left": [], "counts": []}
    held = 1
    while len(names):
        m = len(names)
        node = np.repeat(np.arange(m), sizes)
        counts = np.bincount(node * k + label, weight, minlength=m * k).astype(np.int64).reshape(m, k)
        feature, cut, left = np.full(m, -1), np.zeros(m, np.int64), np.zeros(m, np.int64)
        mixed = (counts > 0).sum(axis=1) > 1
        live = np.flatnonzero(mixed) if width else np.zeros(0, np.int64)
        if len(live):
            rows = mixed[node]
            at, label, weight = at[rows], label[rows], weight[rows]
            size = sizes[live]
            begin, owner = np.cumsum(size) - size, np.repeat(np.arange(len(live)), size)
            order = _feature_orders(seed, names[live], width)
            features = np.sort(order[:, :most], axis=1)
            values = bins[at[:, None], features[owner]]
            chosen = np.minimum.reduceat(values, begin) != np.maximum.reduceat(values, begin)
            short = ~chosen.all(axis=1)
            if short.any():
                # Not all of the first features vary: others take their places. Chosen ones come first, ascending.
                rows = short[owner]
                all_bins, first = bins[at[rows]], np.cumsum(size[short]) - size[short]
                varied = np.minimum.reduceat(all_bins, first) != np.maximum.reduceat(all_bins, first)
                by_rank = np.take_along_axis(varied, order[short], axis=1)
                taken = np.zeros_like(varied)
                np.put_along_axis(taken, order[short], by_rank & (np.cumsum(by_rank, axis=1) <= most), axis=1)
                features[short] = np.argsort(~taken, axis=1, kind="stable")[:, :most]
                chosen[short] = np.take_along_axis(taken, features[short], axis=1)
                values[rows] = np.take_along_axis(all_bins, features[owner[rows]], axis=1)
            some = chosen.any(axis=1)
            wide = some & (size >= WIDE)
            for kind, split in ((wide, _split_wide), (some & ~wide, _split_narrow)):
                todo = np.flatnonzero(kind)
                step = max(1, CELLS // (most * BINS * k)) if split is _split_wide else max(1, CELLS // most)
                for lo in range(0, len(todo), step):
                    mine = todo[lo : lo + step]
                    part = np.repeat(begin[mine] - np.cumsum(size[mine]) + size[mine], size[mine]) + np.arange(size[mine].sum())
                    of = np.repeat(np.arange(len(mine)), size[mine])
                    feature[live[mine]], cut[live[mine]] = split(values[part].astype(np.int64), label[part], weight[part], of, features[mine], chosen[mine], counts[live[mine]], logs)
        parents = np.flatnonzero(feature >= 0)
        left[parents] = held + 2 * np.arange(len(parents))
        held += 2 * len(parents)
        for column, values in zip(out.values(), (feature, cut, left, counts), strict=True):
            column.append(values)
        if not len(parents):
            break
        rows = np.repeat(feature[live] >= 0, size)
        at, label, weight = at[rows], label[rows], weight[rows]
        size = sizes[parents]
        owner = np.repeat(np.arange(len(parents)), size)
        below = bins[at, feature[parents][owner]] <= cut[parents][owner]
        lower = np.bincount(owner, below, minlength=len(parents)).astype(np.int64)
        sizes = np.column_stack([lower, size - lower]).ravel()
        # A row's new place: its side's first, and how many of that side lie ahead of it.
        first = (np.cumsum(sizes) - sizes).reshape(-1, 2)
        ahead = np.cumsum(below) - below
        of_side = ahead - ahead[np.cumsum(size) - size][owner]
        inside = np.arange(len(at)) - (np.cumsum(size) - size)[owner]
        to = np.where(below, first[owner, 0] + of_side, first[owner, 1] + inside - of_side)
        moved = np.empty_like(to)
        moved[to] = np.arange(len(to))
        at, label, weight = at[moved], label[moved], weight[moved]
        names = np.column_stack([_seeded(side, names[parents]) for side in (1, 2)]).ravel()
    return {column: np.concatenate(values) for column, values in out.items()}


@dataclass
class Forest:
    """Upper trees, and a table (tree, node, feature, cut, left, share) of the subtrees below them; a leaf's ``left`` is the number of its share."""

    classes: list[float]
    edges: list[np.ndarray]
    tops: list[Tree]
    below: DataFrame


_SUBTREE = "tree INT, node INT, feature BINARY, cut BINARY, left BINARY, share BINARY"


def fit_forest(train: DataFrame, row_id: str, trees: int = 500, seed: int = 0) -> Forest:
    """Random forest by entropy with sqrt(features) candidates a node, trees grown until leaves are pure.

    Bags are stateless: a row's weight in a tree is drawn from (seed, tree, row id), so rows that share an id share it. Nodes with more than
    LOCAL weighted rows are split by histograms that all tasks add up; below, a node's rows move to one task, which
    grows the rest. Both ways split alike. The driver holds the upper trees only.
    """
    train = _usable(train)
    classes = _classes(train)
    edges = bin_edges(train, row_id)
    width, k = len(edges), len(classes)
    most = max(1, int(np.sqrt(width)))
    blocked, tasks = dealt(binned(train, row_id, edges, classes), ["bins"], BOOST_BYTES, spread=True)
    rows = blocked.agg(F.sum("n")).first()[0]
    tops = [Tree() for _ in range(trees)]
    for i, tree in enumerate(tops):
        tree.add(int(_seeded(seed, np.uint64(i))), None)
        tree.feature[0] = -2
    # A root's weight is about the number of rows; whether it is over the bound is settled without looking at the bag.
    waiting = [(i, 0, False) for i in range(trees)] if rows > LOCAL else []
    while waiting:
        now, waiting = waiting[:NODES], waiting[NODES:]
        # The candidates, and only where not all of them vary the others too.
        asked = [(i, node, np.arange(width) if every else np.sort(_feature_order(seed, tops[i].name[node], width)[:most])) for i, node, every in now]
        for (i, node, features), (*_, every), hist in zip(asked, now, _node_histograms(blocked, tasks, tops, asked, width, k, seed), strict=True):
            tree, counts = tops[i], hist[0].sum(axis=0) if width else np.zeros(k)
            impure = (counts > 0).sum() > 1
            if impure and len(features) < width and ((hist.sum(axis=2) > 0).sum(axis=1) < 2).any():
                waiting.append((i, node, True))
                continue
            found = best_split(hist, _feature_order(seed, tree.name[node], width) if every else np.arange(len(features)), most) if impure else None
            tree.feature[node], tree.counts[node] = -1, counts
            if found is not None:
                at, cut = found
                sides = hist[at, : cut + 1].sum(axis=0), hist[at, cut + 1 :].sum(axis=0)
                for child, own in zip(tree.split(node, int(features[at]), cut, sides), sides, strict=True):
                    tree.feature[child] = -2
                    if own.sum() > LOCAL:
                        waiting.append((i, child, False))
    below = reuse(_grown(blocked, tops, width, k, seed, most))
    below.count()
    release(blocked)
    return Forest(classes, edges, tops, below)


def _node_histograms(blocked: DataFrame, tasks: int, tops: list[Tree], asked: list[tuple[int, int, np.ndarray]], width: int, k: int, seed: int) -> list[np.ndarray]:
    """(features, bins, classes) counts of each (tree, node, features)."""
    used: dict[int, list] = {}
    for j, (i, node, features) in enumerate(asked):
        used.setdefault(i, []).append((j, node, features))
    shared = blocked.sparkSession.sparkContext.broadcast({i: (tops[i], nodes) for i, nodes in used.items()})

    def arrays(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            for b in range(batch.num_rows):
                keys, label, bins = _open(batch, b, width)
                for i, (tree, nodes) in shared.value.items():
                    weight = bag_weights(seed, i, keys)
                    at = tree.route(bins)
                    for j, node, features in nodes:
                        mine = np.flatnonzero((at == node) & (weight > 0))
                        hist = _histogram(bins[mine[:, None], features], label[mine], weight[mine], k).ravel()
                        out[j] = out[j] + hist if j in out else hist
        return out

    found = sums(blocked, tasks, arrays)
    shared.destroy()
    return [found.get(j, np.zeros(len(features) * BINS * k)).reshape(len(features), BINS, k) for j, (_, _, features) in enumerate(asked)]


def _by_node(at: np.ndarray, mine: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each node of the rows ``mine``, and those of them that stop there."""
    if not len(mine):
        return []
    mine = mine[np.argsort(at[mine], kind="stable")]
    nodes, first = np.unique(at[mine], return_index=True)
    return list(zip(nodes.tolist(), np.split(mine, first[1:]), strict=True))


def _binary(values: list[np.ndarray]) -> pa.Array:
    return pa.array([v.tobytes() for v in values], pa.binary())


def _grown(blocked: DataFrame, tops: list[Tree], width: int, k: int, seed: int, most: int) -> DataFrame:
    shared = blocked.sparkSession.sparkContext.broadcast(tops)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                keys, label, bins = _open(batch, b, width)
                label = label.astype(np.uint16)
                for i, tree in enumerate(shared.value):
                    weight, at = bag_weights(seed, i, keys).astype(np.uint8), tree.route(bins)
                    parts = _by_node(at, np.flatnonzero((weight > 0) & (np.array(tree.feature)[at] == -2)))
                    if parts:
                        ids = [pa.array(v, pa.int32()) for v in ([i] * len(parts), [node for node, _ in parts])]
                        yield pa.RecordBatch.from_arrays([*ids, *[_binary([c[mine] for _, mine in parts]) for c in (weight, label, bins)]], ["tree", "node", "weight", "label", "bins"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def subtree() -> pa.RecordBatch:
            weight, label, bins = (np.concatenate(c) for c in zip(*held, strict=True))
            tree = grow(shared.value[now[0]].name[now[1]], bins.reshape(len(label), width), label, weight, k, seed, most)
            leaf = tree["feature"] < 0
            counts = tree["counts"][leaf].astype(np.float64)
            share = np.round(counts / counts.sum(axis=1, keepdims=True) * _UNIT).astype(np.int64)
            tree["left"][leaf] = np.arange(len(share))
            packed = [tree["feature"].astype(np.int16), tree["cut"].astype(np.uint8), tree["left"].astype(np.int32), share]
            ids = [pa.array([v], pa.int32()) for v in now]
            return pa.RecordBatch.from_arrays([*ids, *[_binary([p]) for p in packed]], ["tree", "node", "feature", "cut", "left", "share"])

        for batch in batches:
            for b in range(batch.num_rows):
                key = (batch.column(0)[b].as_py(), batch.column(1)[b].as_py())
                if key != now:
                    if held:
                        yield subtree()
                    now, held = key, []
                held.append([np.frombuffer(batch.column(i + 2)[b].as_py(), t) for i, t in enumerate((np.uint8, np.uint16, np.uint8))])
        if held:
            yield subtree()

    dealt_rows = blocked.mapInArrow(deal, "tree INT, node INT, weight BINARY, label BINARY, bins BINARY")
    parts = dealt_rows.repartition("tree", "node").sortWithinPartitions("tree", "node")
    return parts.mapInArrow(build, _SUBTREE)


def predict_forest(forest: Forest, rows: DataFrame, keep: list[str], name: str = "RF") -> DataFrame:
    """``keep``, model, prediction and probability of the second class: the mean of the leaves' shares over all trees.

    The rows of a block that reach a subtree meet it in the task that holds it; shares are whole numbers, so sums do not
    depend on their order. Rows without features get no prediction.
    """
    k, edges = len(forest.classes), forest.edges
    width = len(edges)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(forest.tops)
    slim = rows.select(*keep, _values().alias("__v"))
    n_keep = len(keep)
    fields = list(slim.schema.fields[:n_keep])
    block_schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("nth", T.IntegerType()), *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in fields], T.StructField("__bins", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        for nth, batch in enumerate(batches):
            n = batch.num_rows
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(i)) for i in range(n_keep)]
            known = batch.column(n_keep).is_valid()
            bins = np.full((n, width), 255, np.uint8)
            mine = np.flatnonzero(np.asarray(known))
            bins[mine] = to_bins(batch.column(n_keep).filter(known), len(mine), edges)
            ids = [pa.array([v], pa.int32()) for v in (TaskContext.get().partitionId(), nth)]
            yield pa.RecordBatch.from_arrays([*ids, *lists, pa.array([bins.tobytes()], pa.binary())], block_schema.names)

    # Kept, so that a block has one name for both of its readers.
    packed = reuse(slim.mapInArrow(pack, block_schema))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                bins = np.frombuffer(batch.column(2)[b].as_buffer(), np.uint8).reshape(-1, width)
                for i, tree in enumerate(shared.value):
                    parts = _by_node(tree.route(bins), np.arange(len(bins)))
                    known = []
                    for node, _ in parts:
                        counts = tree.counts[node]
                        known.append(np.zeros(0, np.int64) if counts is None or tree.feature[node] == -2 else np.round(np.asarray(counts, float) / np.sum(counts) * _UNIT).astype(np.int64))
                    size = len(parts)
                    ids = [pa.array(v, pa.int32()) for v in ([i] * size, [node for node, _ in parts], batch.column(0).take(pa.array([b] * size)), batch.column(1).take(pa.array([b] * size)), [len(bins)] * size)]
                    pieces = [_binary([mine.astype(np.int32) for _, mine in parts]), _binary([bins[mine] for _, mine in parts]), _binary(known)]
                    yield pa.RecordBatch.from_arrays([*ids, *pieces], ["tree", "node", "part", "nth", "n", "mine", "bins", "known"])

    asked = packed.select("part", "nth", "__bins").mapInArrow(ask, "tree INT, node INT, part INT, nth INT, n INT, mine BINARY, bins BINARY, known BINARY")
    # A subtree is read once, ahead of the rows that meet it; its row has no block.
    met = forest.below.unionByName(asked, allowMissingColumns=True).repartition("tree", "node").sortWithinPartitions("tree", "node", F.col("n").asc_nulls_first())
    met = met.select("tree", "node", "feature", "cut", "left", "share", "part", "nth", "n", "mine", "bins", "known")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes: dict[tuple, np.ndarray] = {}
        cells, now, tree, share = 0, None, [], None

        def told() -> Iterator[pa.RecordBatch]:
            for (part, nth), total in votes.items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([nth], pa.int32()), _binary([total])], ["part", "nth", "votes"])
            votes.clear()

        for batch in batches:
            for b in range(batch.num_rows):
                name = (batch.column(0)[b].as_py(), batch.column(1)[b].as_py())
                if batch.column(2)[b].is_valid:
                    feature, cut, left = (np.frombuffer(batch.column(i + 2)[b].as_py(), t).astype(np.int64) for i, t in enumerate((np.int16, np.uint8, np.int32)))
                    now, tree, share = name, [feature, cut, left, left + 1], np.frombuffer(batch.column(5)[b].as_py(), np.int64).reshape(-1, k)
                    continue
                block = (batch.column(6)[b].as_py(), batch.column(7)[b].as_py())
                if block not in votes:
                    votes[block] = np.zeros((batch.column(8)[b].as_py(), k), np.int64)
                    cells += votes[block].size
                mine = np.frombuffer(batch.column(9)[b].as_buffer(), np.int32)
                if name == now:
                    bins = np.frombuffer(batch.column(10)[b].as_buffer(), np.uint8).reshape(-1, width)
                    votes[block][mine] += share[tree[2][route(bins, *tree)]]
                elif len(batch.column(11)[b].as_py()):
                    votes[block][mine] += np.frombuffer(batch.column(11)[b].as_buffer(), np.int64)
                if cells > CELLS:
                    yield from told()
                    cells = 0
        yield from told()

    votes = met.mapInArrow(answer, "part INT, nth INT, votes BINARY").groupBy("part", "nth").agg(F.collect_list("votes").alias("votes"))
    joined = packed.join(votes, ["part", "nth"]).select(*keep, F.col("__bins"), "votes")
    out = T.StructType([*fields, T.StructField("model", T.StringType()), T.StructField("prediction", T.IntegerType()), T.StructField("probability", T.DoubleType())])
    classes = np.array(forest.classes)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                lists = [batch.column(i).slice(b, 1).flatten() for i in range(n_keep)]
                total = sum(np.frombuffer(v, np.int64) for v in batch.column(n_keep + 1)[b].as_py()).reshape(-1, k)
                unknown = np.frombuffer(batch.column(n_keep)[b].as_buffer(), np.uint8).reshape(len(total), width)[:, 0] == 255 if width else np.zeros(len(total), bool)
                prediction = pa.array(classes[total.argmax(axis=1)].astype(np.int32), pa.int32(), mask=unknown)
                p = total[:, min(1, k - 1)] / np.maximum(1, total.sum(axis=1))
                yield pa.RecordBatch.from_arrays([*lists, pa.array([name] * len(total)), prediction, pa.array(p, pa.float64(), mask=unknown)], out.names)

    return joined.mapInArrow(tell, out)


# Softmax boosting.


@dataclass
class Boosted:
    """Complete trees of one depth: per round and class the heap of (feature, cut) and the leaves' values."""

    classes: list[float]
    edges: list[np.ndarray]
    depth: int
    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    leaf: list = field(default_factory=list)

    def margins(self, bins: np.ndarray, begin: int = 0) -> np.ndarray:
        out = np.zeros((len(bins), len(self.classes)))
        for r in range(begin, len(self.leaf)):
            for c in range(out.shape[1]):
                out[:, c] += self.leaf[r][c][place(bins, self.feature[r][c], self.cut[r][c], self.depth)]
        return out


def place(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Number of each row's node at a depth; a node without a feature sends its rows left."""
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for level in range(levels):
        heap = (1 << level) - 1 + at
        f = feature[heap]
        at = 2 * at + ((f >= 0) & (bins[rows, np.maximum(f, 0)] > cut[heap]))
    return at


def newton_split(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[int, int] | None:
    """(feature, cut) of the largest gain, from (feature, bin) sums of slopes and curvatures; None if none gains."""
    left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    whole_g, whole_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    right_g, right_h = whole_g - left_g, whole_h - left_h
    gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - whole_g**2 / (whole_h + ridge)
    gain = np.where((left_h >= least) & (right_h >= least), gain, -np.inf)
    at = int(gain.argmax()) if gain.size else 0
    if not gain.size or not gain.flat[at] > 1e-9:
        return None
    return at // gain.shape[1], at % gain.shape[1]


def fit_boosted(train: DataFrame, row_id: str, rounds: int = 500, depth: int = 2, rate: float = 1.0, ridge: float = 1.0, least: float = 1.0) -> Boosted:
    """Softmax boosting by Newton steps, one tree per class and round; as many classes as there are labels.

    A level of all of a round's trees is one pass: tasks add up slopes and curvatures by (class, node, feature, bin). Margins are written into
    the blocks every ROUNDS_KEPT rounds, so that a pass evaluates a bounded number of trees. Rounds end early when no tree of a round gains.
    """
    train = _usable(train)
    classes = _classes(train)
    edges = bin_edges(train, row_id)
    model = Boosted(classes, edges, depth)
    if len(classes) == 1:
        return model
    width, k = len(edges), len(classes)
    blocked, tasks = dealt(binned(train, row_id, edges, classes, BOOST_ROWS).withColumn("margin", F.lit(b"")), ["bins"], BOOST_BYTES, spread=True)
    context = train.sparkSession.sparkContext
    begin = 0
    for r in range(rounds):
        if r - begin == ROUNDS_KEPT:
            older, made = blocked, _with_margins(blocked, model, begin, width)
            blocked = reuse(made) if r % ROUNDS_SETTLED else settled(made)
            blocked.count()
            release(older)
            begin = r
        feature = np.full((k, (1 << depth) - 1), -1, np.int64)
        cut = np.zeros_like(feature)
        for level in range(depth + 1):
            if level == depth and depth:
                break
            cells = _slopes(blocked, tasks, context, model, begin, feature, cut, level, width, k)
            nodes = 1 << level
            if level == 0 or depth == 0:
                leaf = np.zeros((k, 1 << depth))
            for c in range(k):
                for node in range(nodes):
                    g, h = cells[c, node]
                    found = newton_split(g, h, ridge, least) if depth else None
                    whole = -rate * g[0].sum() / (h[0].sum() + ridge)
                    span = (1 << depth) // nodes
                    leaf[c, node * span : (node + 1) * span] = whole if h[0].sum() > 0 else leaf[c, node * span : (node + 1) * span]
                    if found is None:
                        continue
                    f, b = found
                    heap = nodes - 1 + node
                    feature[c, heap], cut[c, heap] = f, b
                    for side, part in enumerate((slice(0, b + 1), slice(b + 1, None))):
                        lo = node * span + side * span // 2
                        leaf[c, lo : lo + span // 2] = -rate * g[f, part].sum() / (h[f, part].sum() + ridge)
        if not (feature >= 0).any():
            break
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(leaf)
    release(blocked)
    return model


def _margin(batch: pa.RecordBatch, b: int, bins: np.ndarray, model: Boosted, begin: int) -> np.ndarray:
    held = np.frombuffer(batch.column(4)[b].as_buffer())
    own = model.margins(bins, begin)
    return own + held.reshape(own.shape) if len(held) else own


def _with_margins(blocked: DataFrame, model: Boosted, begin: int, width: int) -> DataFrame:
    shared = blocked.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_margin(batch, b, _open(batch, b, width)[2], shared.value, begin).tobytes() for b in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(made, pa.binary())], batch.schema.names)

    return blocked.mapInArrow(run, _BLOCK + ", margin BINARY")


def _slopes(blocked, tasks, context, model, begin, feature, cut, level, width, k) -> np.ndarray:
    """(class, node, slope or curvature, feature, bin) sums at a level of the trees being grown."""
    recent = Boosted(model.classes, [], model.depth, model.feature[begin:], model.cut[begin:], model.leaf[begin:])
    shared = context.broadcast((recent, feature, cut))
    nodes = 1 << level

    def arrays(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out = {c: np.zeros(nodes * 2 * width * BINS) for c in range(k)}
        trees, feature, cut = shared.value
        for batch in batches:
            for b in range(batch.num_rows):
                _, label, bins = _open(batch, b, width)
                z = _margin(batch, b, bins, trees, 0)
                e = np.exp(z - z.max(axis=1, keepdims=True))
                p = e / e.sum(axis=1, keepdims=True)
                whole = np.arange(width) * BINS + bins
                for c in range(k):
                    at = place(bins, feature[c], cut[c], level)
                    cell = (whole + (2 * width * BINS * at)[:, None] if level else whole).ravel()
                    slope = np.repeat(p[:, c] - (label == c), width)
                    curve = np.repeat(np.maximum(2.0 * p[:, c] * (1.0 - p[:, c]), 1e-16), width)
                    out[c] += np.bincount(cell, slope, minlength=len(out[c])) + np.bincount(cell + width * BINS, curve, minlength=len(out[c]))
        return out

    found = sums(blocked, tasks, arrays)
    shared.destroy()
    return np.stack([found[c].reshape(nodes, 2, width, BINS) for c in range(k)])


def predict_boosted(model: Boosted, rows: DataFrame, keep: list[str], name: str = "XGBOOST") -> DataFrame:
    """``keep``, model, prediction and probability of the second class; no shuffle. Rows without features get no prediction."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    slim = rows.select(*keep, _values().alias("__v"))
    n_keep = len(keep)
    out = T.StructType([*slim.schema.fields[:n_keep], T.StructField("model", T.StringType()), T.StructField("prediction", T.IntegerType()), T.StructField("probability", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        classes = np.array(m.classes)
        for batch in batches:
            known = batch.column(n_keep).is_valid()
            mine = np.flatnonzero(np.asarray(known))
            z = m.margins(to_bins(batch.column(n_keep).filter(known), len(mine), m.edges))
            e = np.exp(z - z.max(axis=1, keepdims=True))
            label, p = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            label[mine] = classes[z.argmax(axis=1)]
            p[mine] = (e / e.sum(axis=1, keepdims=True))[:, min(1, z.shape[1] - 1)]
            unknown = ~np.asarray(known)
            made = [pa.array([name] * batch.num_rows), pa.array(label, pa.int32(), mask=unknown), pa.array(p, pa.float64(), mask=unknown)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *made], out.names)

    return slim.mapInArrow(run, out)
