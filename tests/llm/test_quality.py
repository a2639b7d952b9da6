"""The quality network: chunks, scores against plain loops, held-out accuracy, defined results of odd rows."""

import random

import numpy as np
import pytest

from quaver.llm import quality as Q


def packed(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)


def random_net(seed=0):
    rng = np.random.default_rng(seed)
    net = Q.QualityNet(*[p + rng.normal(0, 0.5, p.shape).astype(np.float32) for p in Q._untrained()])
    net.combine, net.centre, net.scale = rng.normal(size=5), rng.normal(size=4), rng.uniform(0.5, 2, 4)
    return net


def plain_features(net, text):
    """Chunk by chunk and position by position."""
    raw = text.encode() or b" "
    padded = raw + b" " * Q._SPAN
    z = [sum(net.embed[padded[i + k]] @ net.filters[k * Q.DIM : (k + 1) * Q.DIM] for k in range(Q._SPAN)) for i in range(len(raw))]
    logits, start = [], 0
    while True:
        pooled = np.max(z[start : start + Q.CHUNK], axis=0)
        logits.append(np.maximum(pooled + net.shift, 0) @ net.out + net.out_shift[0])
        if start + Q.CHUNK >= len(raw):
            break
        start += Q.STRIDE
    return [np.mean(logits), max(logits), min(logits), np.log(len(logits))]


TEXTS = ["", "a", "né", "word " * 60, "x" * Q.CHUNK, "x" * (Q.CHUNK + 1), "The quick. " * 300, "Z" * Q.STRIDE]


def test_features_equal_a_plain_loop(monkeypatch):
    net = random_net()
    want = np.array([plain_features(net, t) for t in TEXTS])
    for block in (Q.BLOCK, 300):
        monkeypatch.setattr(Q, "BLOCK", block)
        assert np.allclose(Q.document_features(net, *packed(TEXTS)), want, atol=1e-3)


def test_chunks_overlap_and_cover():
    for size in [0, 1, 255, 256, 257, 448, 449, 5000]:
        _, first, last = Q.chunk_bounds(np.array([size]))
        assert first[0] == 0 and last[-1] == max(size, 1) and (last - first <= Q.CHUNK).all()
        assert (first[1:] < last[:-1]).all()


def labelled(spark, n=240):
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice("the of and house river slowly went over small quiet".split()) for _ in range(rng.randint(5, 150)))
    bad = lambda: " ".join(rng.choice("x$$ 99## @@! zz%% ||| qq&&".split()) for _ in range(rng.randint(5, 150)))
    rows = [(i, good() if i % 3 else "opening words " + bad(), int(i % 3 > 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, quality INT")


def test_learns_held_out_rows_and_keeps_columns(spark):
    df = labelled(spark)
    net = Q.fit_quality(df.where("doc_id < 160"), df.where("doc_id < 160").select("doc_id", "quality"))
    odd = spark.createDataFrame([(None, None, 1), (5000, "", 0), (5000, "", 0), (6000, "river " * 50_000, 1)], df.schema)
    got = Q.score_quality(df.where("doc_id >= 160").unionAll(odd).withColumn("quality_score", Q.F.lit("old")), net).toPandas()
    known = got[(got.doc_id >= 160) & (got.doc_id < 5000)]
    assert ((known.quality_score >= 0.5) == (known.quality == 1)).mean() >= 0.97
    assert len(got) == 84 and got.quality_score.between(0, 1).all()
    empty = got[got.doc_id.isna() | (got.doc_id == 5000)]
    assert empty.quality_score.nunique() == 1
    assert got[got.doc_id == 6000].quality_score.iloc[0] > 0.5


def test_nothing_to_learn_from_and_empty_tables(spark):
    df = labelled(spark, 6)
    none = Q.fit_quality(df, df.where("false").select("doc_id", "quality"))
    assert Q.score_quality(df, none).select("quality_score").distinct().collect() == [(0.5,)]
    assert Q.score_quality(df.where("false"), none).count() == 0
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id LONG, quality INT")
    assert Q.score_quality(df, Q.fit_quality(df, nulls)).first().quality_score == 0.5
    single = Q.fit_quality(df, df.where("quality = 1").select("doc_id", "quality"))
    assert Q.score_quality(df, single).agg({"quality_score": "min"}).first()[0] > 0.5


def test_sample_stays_bounded_under_copies(spark):
    docs = spark.range(600).select(Q.F.lit(1).cast("long").alias("doc_id"), Q.F.lit("copy").alias("text"))
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0)], "doc_id LONG, quality INT")
    sample, stands = Q._sampled(docs, labels, "doc_id", "text", "quality", 20, 1)
    assert {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()} == {0: 40, 1: 40}
    assert stands == pytest.approx({0: 1.0, 1: 1.0})
