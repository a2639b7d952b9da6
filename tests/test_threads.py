import json

import pytest

from quaver.operators import tables as T
from quaver.operators import threads as H
from quaver.sources.readers import read_threads

THREAD = {
    "tweet_id": "1",
    "tweet": "root post",
    "comments": [
        {
            "tweet_id": "2",
            "tweet": " first comment ",
            "replies": [{"tweet_id": str(i), "tweet": f"reply {i}"} for i in (3, 4, 5)],
        },
        {"tweet_id": "6", "tweet": "abc"},
        {"tweet_id": "7", "tweet": "abcd"},
    ],
}
LABELS = {"1": "HOF", "2": "NONE", "3": "HOF", "4": "NONE", "6": "HOF", "7": "HOF"}


@pytest.fixture
def threads(spark, tmp_path):
    def write(split, topic, thread, data=None, labels=None):
        folder = tmp_path / split / topic / thread
        folder.mkdir(parents=True)
        if data is not None:
            (folder / "data.json").write_text(data if isinstance(data, str) else json.dumps(data, indent=1))
        if labels is not None:
            (folder / "labels.json").write_text(json.dumps(labels))

    write("train", "some topic", "t1", THREAD, LABELS)
    write("train", "some topic", "t2", {"tweet_id": "20", "tweet": "alone", "comments": []}, {"20": "NONE"})
    write("test", "other", "t3", {"tweet_id": "30", "tweet": "no comments key"}, {"30": "HOF"})
    write("test", "other", "no-labels", {"tweet_id": "40", "tweet": "dropped"})
    write("test", "other", "no-data", None, {"50": "HOF"})
    write("test", "other", "broken", "{", {"60": "HOF"})
    return read_threads(spark, str(tmp_path))


def test_read_threads(threads):
    assert {(r.split, r.topic, r.thread) for r in threads.collect()} == {
        ("train", "some topic", "t1"),
        ("train", "some topic", "t2"),
        ("test", "other", "t3"),
    }


def test_flatten(threads):
    got = {r.tweet_id: r for r in H.flatten_threads(threads).collect()}
    assert sorted(got, key=int) == ["1", "2", "3", "4", "5", "7", "20", "30"]
    assert got["2"].text == "first comment"
    assert (got["3"].label, got["5"].label, got["5"].label_str) == (1, 0, "NONE")
    report = {r.topic: (r.n, r.positive) for r in H.topic_report(H.flatten_threads(threads)).collect()}
    assert report == {"some topic": (7, 3), "other": (1, 1)}


def test_context_rows(threads):
    got = {r.tweet_id: r for r in H.context_rows(threads).collect()}
    assert got["1"].context == "root post"
    assert got["2"].context == "root post"
    assert got["3"].context == "root post first comment "
    assert got["5"].context == "root post first comment  [SEP] reply 3 [SEP] reply 4"
    assert got["5"].label == "NONE" and got["30"].context == "no comments key"
    parts = H.context_rows(threads).filter("tweet_id = '5'").select(H.split_context()).first()[0]
    assert parts == ["root post first comment ", "reply 3", "reply 4"]


def test_hierarchical_rows(threads):
    rows = [tuple(r) for r in H.hierarchical_rows(threads).filter("thread = 't1'").select("post", "context", "text", "label").collect()]
    assert rows[0] == ("root post", "", "", 1)
    assert rows[1] == ("root post", " first comment ", "", 0)
    assert rows[4] == ("root post", " first comment ", "reply 5", 0)
    running = H.hierarchical_rows(threads, running=True).filter("text = 'reply 5'").first()
    assert running.context == " first comment  [SEP] reply 3 [SEP] reply 4"


def test_flat_and_nested_contexts_agree(rows):
    nested = {"tweet_id": "0", "tweet": "r", "comments": []}
    turns = [(1, 0, "r")]
    turn = 1
    for c in range(2):
        comment = {"tweet_id": str(turn), "tweet": f"c{c}", "replies": []}
        turns.append((1, turn, f"c{c}"))
        turn += 1
        for k in range(2):
            comment["replies"].append({"tweet_id": str(turn), "tweet": f"c{c}r{k}"})
            turns.append((1, turn, f"c{c}r{k}"))
            turn += 1
        nested["comments"].append(comment)
    flat = rows(turns, "conv_id BIGINT, turn BIGINT, text STRING")
    placed = H.place_turns(flat, "conv_id", "turn")
    spark = flat.sparkSession
    tree = spark.createDataFrame([(json.dumps(nested), {"x": "y"})], "j STRING, labels MAP<STRING, STRING>")
    from pyspark.sql import functions as F

    tree = tree.select(F.from_json("j", H.THREAD_SCHEMA).alias("t"), "labels").select("t.*", "labels")
    want = {(int(r.tweet_id), r.context, r.text) for r in H.context_rows(tree).collect()}
    assert {(r.turn, r.context, r.text) for r in H.flat_context_rows(placed, "conv_id", "turn").collect()} == want
    for running in (False, True):
        a = {(r.post, r.context, r.text) for r in H.hierarchical_rows(tree, running).collect()}
        b = {(r.post, r.context, r.text) for r in H.flat_hierarchical_rows(placed, "conv_id", "turn", running=running).collect()}
        assert a == b


def test_row_shape(rows):
    df = rows([("p", "", ""), ("p", "c", ""), ("p", "c", "t"), ("p", "", "t"), ("", "", "")], "post STRING, context STRING, text STRING")
    got = [tuple(r) for r in df.select(T.row_shape(), T.row_shape_with_default()).collect()]
    assert [g[0] for g in got] == ["post", "post_context", "post_context_text", None, None]
    assert [g[1] for g in got] == ["post", "post_context", "post_context_text", "post", "post"]
