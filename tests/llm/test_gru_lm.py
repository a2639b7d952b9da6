"""The language model against plain loops: scores from the trained weights, keys, and what it learns from."""

import math
import pickle
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from quaver.llm import gru_lm
from quaver.llm.common import stored

WORD = re.compile("[^\x20\x09-\x0d]+")


def texts(n, seed=3):
    rng = random.Random(seed)
    common = ["ash", "Birch", "cedar", "elm", "fir", "oak"]
    return [" ".join(rng.choice(common) if rng.random() < 0.8 else f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 90))) for _ in range(n)]


def plain(net, symbols):
    """Natural log-probability of symbols, one step at a time."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, before, total, n = np.zeros(gru_lm.HIDDEN), gru_lm.END, 0.0, gru_lm.HIDDEN
    for s in symbols:
        a, b = net.embed[before].astype(float) @ net.inp + net.shift, h @ net.rec
        z, r = sigmoid(a[:n] + b[:n]), sigmoid(a[n : 2 * n] + b[n : 2 * n])
        h = z * h + (1 - z) * np.tanh(a[2 * n :] + r * b[2 * n :])
        c, k = divmod(int(s), gru_lm.PER_CLASS)
        for logits, at in ((h @ net.cls + net.cls_shift, c), (h @ net.word[c] + net.word_shift[c], k)):
            total += logits[at] - math.log(np.exp(logits).sum())
        before = int(s)
    return total


@pytest.mark.parametrize("shared", [gru_lm.SHARED_WORDS, 12])
def test_scores_follow_from_the_weights(spark, monkeypatch, shared):
    rows = list(enumerate(texts(40)))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    counts = stored(gru_lm.word_counts(docs), "counts")
    with monkeypatch.context() as few:
        few.setattr(gru_lm, "SHARED_WORDS", shared)
        few.setattr(gru_lm, "OWN_WORDS", 4)
        vocabulary = gru_lm.build_vocabulary(counts, len(rows))
    assert 6 < len(vocabulary.words) < shared + 10 and (vocabulary.symbols >= 0).sum() == 4
    monkeypatch.setattr(gru_lm, "build_vocabulary", lambda *a: vocabulary)
    net = gru_lm.fit_model(docs, vocabulary)
    monkeypatch.setattr(gru_lm, "fit_model", lambda *a, **k: net)
    got = {r["doc_id"]: r["score"] for r in gru_lm.score_documents(docs, docs).collect()}

    low = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    c = Counter(low(w) for _, t in rows for w in WORD.findall(t))
    for i, t in rows:
        data = np.frombuffer(t.encode(), np.uint8)
        names, bucket, _ = gru_lm.words_of(data, np.array([0, len(data)]))
        _, own = vocabulary.look_up(names)
        symbols = [int(s) if s >= 0 else gru_lm.OWN_WORDS + int(b) for s, b in zip(own, bucket, strict=True)]
        score = plain(net, [*symbols, gru_lm.END]) / math.log(10)
        for w, s, b in zip(WORD.findall(t), own, bucket, strict=True):
            if s < 0:
                score += math.log10((c[low(w)] + 1) / (vocabulary.rest_tokens[b] + vocabulary.rest_words[b] + 1))
        assert got[i] == pytest.approx(score, rel=1e-4)


def test_null_and_repeated_keys(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "SHARED_WORDS", 5)
    rows = [(1, "oak rare1 ash"), (1, "elm rare2 rare3 fir"), (None, "oak rare1 x1"), (None, "oak rare1 x1"), (None, None), (2, ""), (None, "rare2"), (3, "never seen oak")]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id BIGINT, text STRING, score STRING")
    training = docs.where("doc_id IS NULL OR doc_id <> 3")
    c = Counter(w for k, t in rows if k != 3 for w in (t or "").split())
    n, v = sum(c.values()) + len(rows) - 1, len(c) + 1
    c[None] = len(rows) - 1
    want = sorted((k or 0, len((t or "").split()) + 1, sum(c[w] > 0 for w in [*(t or "").split(), None]), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*(t or "").split(), None]), 6)) for k, t in rows)
    got = gru_lm.score_documents(docs, training).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert gru_lm.score_documents(docs.limit(0), training).count() == 0
    assert {r["n_known"] for r in gru_lm.score_documents(docs, docs.limit(0)).collect()} == {0}


def test_what_it_learns_from_grows(spark):
    """Every word of every text stands in one stretch; a share of them grows with the table, and copies are drawn one by one."""
    rows = [(i, t) for i, t in enumerate(texts(300))] + [(None, "oak elm " * 3000)] * 300 + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    vocabulary = gru_lm.build_vocabulary(stored(gru_lm.word_counts(docs), "counts"), len(rows))
    tokens = lambda d, share: [len(r["symbols"]) // 2 for r in gru_lm.stretches(d, vocabulary, share, 4).collect()]
    assert sum(tokens(docs, 1.0)) == vocabulary.tokens
    some = sum(tokens(docs, 0.1))
    assert 0.07 * vocabulary.tokens < some < 0.13 * vocabulary.tokens
    assert 1.7 * some < sum(tokens(docs.union(docs), 0.1)) < 2.3 * some
    learners = Counter(r["learner"] for r in gru_lm.stretches(docs, vocabulary, 0.1, 4).collect())
    assert len(learners) == 4 and max(learners.values()) < 0.5 * sum(learners.values())


def test_learning_does_not_depend_on_partitions(spark):
    rows = list(enumerate(texts(200, 8)))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    vocabulary = gru_lm.build_vocabulary(stored(gru_lm.word_counts(docs), "counts"), len(rows))
    one, many = (gru_lm.fit_model(d, vocabulary) for d in (docs.coalesce(1), docs.repartition(7)))
    assert np.allclose(gru_lm._flat(one), gru_lm._flat(many))
    symbols = np.concatenate([np.frombuffer(r["symbols"], np.int16) for r in gru_lm.stretches(docs, vocabulary, 1.0, 1).collect()]).astype(np.int64)
    fresh = gru_lm.Gru()
    assert gru_lm.score_texts(one, symbols, np.array([len(symbols)]))[0] > gru_lm.score_texts(fresh, symbols, np.array([len(symbols)]))[0]


def test_every_training_token_is_learned_once(spark, monkeypatch):
    """Of a table of a million tokens too: all are dealt to the rounds, and each is a target after the symbol ahead of it in its text."""
    rows = [*enumerate(texts(100, 5)), *[(200 + i, "oak elm fir " * 5000) for i in range(70)], (900, None), (901, " ")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    vocabulary = gru_lm.build_vocabulary(stored(gru_lm.word_counts(docs), "counts"), len(rows))
    dealt = []
    monkeypatch.setattr(gru_lm, "_round", lambda rows, net, *args: dealt.append([len(r["symbols"]) // 2 for r in rows.collect()]) or net)
    gru_lm.fit_model(docs, vocabulary)
    assert vocabulary.tokens > 1_000_000 and sum(map(sum, dealt)) == vocabulary.tokens
    assert all(sum(d) > 0.2 * vocabulary.tokens for d in dealt)

    monkeypatch.setattr(gru_lm, "STRETCH", 64)
    few = docs.where("doc_id < 201 OR doc_id >= 900")
    taken = [(np.frombuffer(r["symbols"], np.int16).astype(np.int64), r["before"]) for r in gru_lm.stretches(few, vocabulary).collect()]
    pairs = Counter()

    class Watched(gru_lm.Gru):
        def learn(self, x, y, resets, state):
            pairs.update(zip(x[y >= 0].tolist(), y[y >= 0].tolist(), strict=True))
            return {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}, state, 0.0

    gru_lm.Learner(Watched(), 1e-3, lanes=8).go_over(np.concatenate([t[0] for t in taken]), np.array([len(t[0]) for t in taken]), np.array([t[1] for t in taken]))
    want = Counter()
    for i, t in rows:
        if i < 201 or i >= 900:
            data = np.frombuffer((t or "").encode(), np.uint8)
            symbols = gru_lm._symbols(*gru_lm.words_of(data, np.array([0, len(data)])), vocabulary)[0].tolist()
            want.update(zip([gru_lm.END, *symbols[:-1]], symbols, strict=True))
    assert pairs == want


def test_words_are_counted_with_their_buckets():
    rng = np.random.default_rng(2)
    names = rng.integers(-(2**63), 2**63, 300)
    for known in (names, np.append(names, names[:5] ^ 1), names[:0]):
        bucket = (known % gru_lm.BUCKETS).astype(np.int32)
        at = rng.integers(0, len(known), 4000) if len(known) else np.zeros(0, np.int64)
        want = sorted((w, w % gru_lm.BUCKETS, n) for w, n in Counter(known[at].tolist()).items())
        assert [tuple(map(int, r)) for r in zip(*gru_lm._counted(known[at], bucket[at]), strict=True)] == want


def test_groups_of_texts_are_cut_alike(monkeypatch):
    data = " \t".join(texts(60)).encode() + b" x" * 500
    offsets = np.array([0, 0, 10, 11, 700, 701, 3000, 3000, len(data) - 1, len(data), len(data)])
    whole = gru_lm._words(np.frombuffer(data, np.uint8), offsets)
    monkeypatch.setattr(gru_lm, "CACHED", 600)
    assert all((a == b).all() for a, b in zip(whole, gru_lm._words(np.frombuffer(data, np.uint8), offsets), strict=True))


def test_windows_use_the_same_arrays():
    """The first window makes the large arrays; others need a part of their memory."""
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, gru_lm.SYMBOLS, (2, 32, 256))
    net, state = gru_lm.Gru(3), np.zeros((256, gru_lm.HIDDEN), np.float32)
    net.learn(x, y, x < 9, state)
    tracemalloc.start()
    try:
        net.learn(x, y, x < 9, state)
        assert tracemalloc.get_traced_memory()[1] < 6 << 20
    finally:
        tracemalloc.stop()
    assert not pickle.loads(pickle.dumps(net)).room.held


def test_far_logits_and_rows_without_a_target():
    rng = np.random.default_rng(6)
    net, states = gru_lm.Gru(3), rng.uniform(-1, 1, (3000, gru_lm.HIDDEN)).astype(np.float32)
    targets = np.where(rng.random(3000) < 0.2, -1, rng.choice([5, 70, 4000], 3000))
    for far in (1, 400):
        net.cls *= far
        got, want = net.log_probs(states, targets)[0], np.zeros(3000)
        for i, s in enumerate(targets):
            c, k = divmod(int(s), gru_lm.PER_CLASS)
            for logits, at in ((states[i].astype(float) @ net.cls, c), (states[i].astype(float) @ net.word[c], k)) if s >= 0 else ():
                want[i] += logits[at] - logits.max() - math.log(np.exp(logits - logits.max()).sum())
        assert np.allclose(got, want, rtol=1e-4, atol=1e-4) and not got[targets < 0].any()


def test_look_up_in_parts(monkeypatch):
    rng = np.random.default_rng(9)
    words = np.sort(rng.integers(-(2**63), 2**63, 5000))
    words = np.unique(np.append(words, words[:300] + 1))
    vocabulary = gru_lm.Vocabulary(words, np.arange(len(words)), np.arange(len(words)) - 7, *[None] * 5)
    at = rng.integers(0, len(words), 3000)
    names = np.concatenate([words[at], words[at] ^ (1 << 20)])
    known = {w: i for i, w in enumerate(words.tolist())}
    want = [known.get(w, -1) for w in names.tolist()]
    for size in (gru_lm.CACHED, 8 * 11):
        monkeypatch.setattr(gru_lm, "CACHED", size)
        counts, symbols = vocabulary.look_up(names)
        assert counts.tolist() == want and symbols.tolist() == [i - 7 if i >= 0 else -1 for i in want]


def test_weights_stay_as_they_are():
    """Scoring and gradients leave all weights alone, shifts of the gates too, and scores follow from them."""
    rng = np.random.default_rng(8)
    net = gru_lm.Gru(3)
    net.shift += rng.normal(0, 1, net.shift.shape).astype(np.float32)
    symbols, sizes = rng.integers(0, gru_lm.SYMBOLS, 60), np.array([25, 35])
    flat, want = gru_lm._flat(net), [plain(net, s) for s in np.split(symbols, [25])]
    for _ in range(2):
        assert gru_lm.score_texts(net, symbols, sizes) == pytest.approx(want, rel=1e-4)
        assert (gru_lm._flat(net) == flat).all()
        net.learn(symbols[:-1, None], symbols[1:, None], symbols[:-1, None] < 9, np.zeros((1, gru_lm.HIDDEN), np.float32))
        assert (gru_lm._flat(net) == flat).all()
