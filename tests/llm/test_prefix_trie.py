"""The prefix trie against a plain walk over rebuilt conversations."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from quaver.llm import prefix_trie as P

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort()
    members, kids, ends = defaultdict(set), defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        node = ()
        members[node].add(c)
        for turn in own.get(base, [])[:h] + own[c][h:]:
            child = (*node, turn[2:])
            kids[node].add(child)
            node = child
            members[node].add(c)
        ends[node].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        cost = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        for k in range(len(node) + 1):
            leaves[node[:k]] += not kids.get(node)
            saved[node[:k]] += cost
    return sorted(
        (
            min(members[v]),
            len(v),
            min(members[v[:-1]]) if v else -1,
            len(members[v]),
            len(kids.get(v, ())),
            leaves[v],
            saved[v],
            hashlib.sha256(",".join(map(str, sorted(ends.get(v, [])))).encode()).hexdigest(),
        )
        for v in members
    )


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def test_equals_a_plain_walk(spark):
    rng = random.Random(5)
    rows = []
    for c in [*range(0, 14), *range(95, 112), 200, 300, 305, 1207, -3, -100, -150]:
        for turn in range(rng.choice([1, 2, 3, 7, 9, 20])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "ccc", "", None])))
    rows += [(7, None, "system", "first"), (7, 2, "user", "a"), (7, 2, "user", "a"), (None, 1, "user", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    assert got(P.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_hot_deep_and_shared_conversations(spark, monkeypatch):
    """Chunks and ids cut small, one conversation with a third of the turns, a depth of several bands of bands, many exact copies."""
    monkeypatch.setattr(P, "CHUNK", 7)
    monkeypatch.setattr(P, "IDS", 5)
    monkeypatch.setattr(P, "HEIGHT", 3)
    rows = [(50, t, "user", f"long {t % 11}") for t in range(120)]
    rows += [(51, t, "user", f"long {t % 11}" if t < 100 else f"other {t}") for t in range(104)]
    rows += [(c, t, "user", "same") for c in range(1000, 1060) for t in range(3)]
    rows += [(c, 0, "user", f"hello {c}") for c in range(2000, 2040)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(9)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(P.prefix_trie(df)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_empty_table_and_clashing_columns(spark):
    assert P.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, t, "user", "x" * t) for t in range(8)]
    extra = spark.createDataFrame([(*r, 5, "e", 1) for r in rows], SCHEMA + ", n_convs INT, path STRING, part INT")
    assert got(P.prefix_trie(extra)) == brute(rows)


@pytest.mark.parametrize("conv", [0, 1, 99, 12345, -7])
def test_head_length(spark, conv):
    assert spark.range(1).select(P.head_length(P.F.lit(conv))).first()[0] == zlib.crc32(str(conv).encode()) % 6
