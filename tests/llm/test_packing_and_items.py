"""Hot keys in packing, plain best fit per group, and benchmark items against all distances."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quaver.llm import decontamination as D
from quaver.llm import packing as P


def groups(packed):
    return {r.g: r["count"] for r in packed.groupBy(F.expr("bin_id >> 32").alias("g")).count().collect()}


def test_pieces_of_hot_keys_are_dealt_evenly(spark):
    nulls = spark.range(20_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "100 AS n_tokens", "'x' AS bin_id")
    packed = P.best_fit(nulls)
    assert packed.count() == 20_000 and len(groups(packed)) == 3 and max(groups(packed).values()) < 8192
    long = spark.range(4).selectExpr("id AS doc_id", "12000000 + id AS n_tokens")
    sizes = groups(P.best_fit(long))
    assert sum(sizes.values()) == 4 * 2930 and len(sizes) == 2 and max(sizes.values()) < 8192


def test_stretches_of_copies_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(P, "STRETCH", 7)
    rows = spark.createDataFrame([("a", 9000)] * 13 + [("b", 60_000), (None, None), (None, None), ("c", 0)], "k STRING, n BIGINT")
    for n in (1, 5):
        packed = P.best_fit(rows.repartition(n), "k", "n")
        got = Counter((r.k, r.piece, r.piece_start, r.piece_tokens) for r in packed.collect())
        wanted = Counter({("a", i, 4096 * i, min(4096, 9000 - 4096 * i)): 13 for i in range(3)})
        wanted += Counter((("b", i, 4096 * i, min(4096, 60_000 - 4096 * i))) for i in range(15))
        assert got == wanted + Counter({(None, 0, 0, None): 2, ("c", 0, 0, 0): 1})
    assert P.best_fit(rows.limit(0), "k", "n").count() == 0


def plain_best_fit(lengths, sizes):
    """Every open bin is looked at for every piece."""
    bins = []
    for i, length in enumerate(lengths):
        fitting = [b for b in bins if b["room"] >= length]
        if fitting:
            b = min(fitting, key=lambda b: (b["room"], b["number"]))
        else:
            left = sum(lengths[i:])
            size = min((c for c in sizes if c >= length), key=lambda c: (P.bin_cost(c) / min(c, left), c))
            b = {"room": size, "number": len(bins), "held": []}
            bins.append(b)
        b["room"] -= length
        b["held"].append(length)
    return [(b["held"], min(c for c in sizes if c >= sum(b["held"]))) for b in bins]


def test_whole_result_equals_plain_best_fit(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 17, 300, 511, 512, 700, 2000, 4095, 4096, 9001, 40_000])) for i in range(500)]
    packed = P.best_fit(spark.createDataFrame(rows, "doc_id BIGINT, n_tokens BIGINT"), group_rows=90).collect()
    by_group = defaultdict(list)
    for r in packed:
        by_group[r.bin_id >> 32].append(r)
    assert len(by_group) > 5 and Counter(r.doc_id for r in packed) == Counter({i: -(-n // 4096) for i, n in rows})
    for part in by_group.values():
        part.sort(key=lambda r: (-r.piece_tokens, r.doc_id, r.piece))
        held = defaultdict(list)
        for r in part:
            held[r.bin_id].append((r.bin_offset, r.piece_tokens, r.bin_size))
        got = [([n for _, n, _ in sorted(held[b])], held[b][0][2]) for b in sorted(held)]
        assert got == plain_best_fit([r.piece_tokens for r in part], P.CAPACITIES)


def least_distance(item, text):
    """Edits from an item to the nearest part of a text, by the whole table of distances."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, b in enumerate(text, 1):
            row[j] = min(last[j - 1] + (a != b), last[j] + 1, row[j - 1] + 1)
    return min(row)


@pytest.mark.parametrize("block", [10**6, 150])
def test_items_equal_all_distances(spark, block):
    rng = random.Random(9)
    words = [("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))) for _ in range(30)]
    items = [(f"q{i // 2}", " ".join(rng.choice(words) for _ in range(rng.randint(6, 16)))) for i in range(16)]
    items += [items[0], ("q1", None), (None, "no name"), ("q90", "..."), ("q91", items[3][1])]
    docs = [(None, None), (0, ""), (1, "...")]
    for d in range(2, 40):
        parts = [rng.choice(words) for _ in range(20)]
        taken = list(items[rng.randrange(16)][1])
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(taken))
            taken[at : at + rng.randint(0, 1)] = rng.choice("abcdefgh ")
        docs.append((d, " ".join([*parts[:7], "".join(taken), *parts[7:]])))
    docs.append(docs[5])
    docs_frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id BIGINT, text STRING, item_id INT")
    found = D.contaminated(docs_frame, spark.createDataFrame(items, "item_id STRING, text STRING"), block_chars=block)
    wanted = Counter()
    for doc, text in docs:
        best = {}
        for name, item in items:
            item = D.reduced(item)
            if name is None or not item or not text:
                continue
            edits = least_distance(item, D.reduced(text))
            if edits <= D.budget(len(item)):
                best[name] = min(edits, best.get(name, edits))
        wanted.update((doc, name, edits) for name, edits in best.items())
    assert Counter(map(tuple, found.collect())) == wanted and len(wanted) > 20
