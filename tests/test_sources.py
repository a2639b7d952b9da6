import json

import pytest
from pyspark.sql import functions as F

from quaver.operators.results import condition_average, results_pivot, seed_statistics
from quaver.plans import corpus as C
from quaver.sources import adapters as A
from quaver.sources import readers as R
from quaver.sources import sinks as K


def test_csv_with_newlines_quotes_and_missing_values(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('id,text\n1,"two\nlines, ""quoted"""\n2,nan\n3,\n4,"NA"\n5, nan is fine\n')
    got = {r.id: r.text for r in R.read_csv(spark, str(path)).collect()}
    assert got == {"1": 'two\nlines, "quoted"', "2": None, "3": None, "4": None, "5": " nan is fine"}


def test_tsv_and_sniffing(spark, tmp_path):
    tsv = tmp_path / "x.tsv"
    tsv.write_text("u1\tsome text\t2\nu2\tother\t0\n")
    assert [tuple(r) for r in R.read_tsv(spark, str(tsv), ["uid", "text", "label"]).collect()][0] == ("u1", "some text", "2")
    for sep in (",", ";", "\t"):
        path = tmp_path / f"s{ord(sep)}.csv"
        path.write_text(f"a{sep}b\n1{sep}2\n")
        assert R.read_sniffed(spark, str(path)).columns == ["a", "b"]


BLOCKS = """meta\t1\tPositive
hello\tEng
duniya\tHIN
kya

meta 2
ok Eng

meta 3 neutral

metaphor HIN
is Eng
haan\tHIN"""


def test_tagged_blocks(spark, tmp_path):
    path = tmp_path / "x.conll"
    path.write_text(BLOCKS)
    got = {r.uid: r for r in R.read_tagged_blocks(spark, str(path)).collect()}
    assert sorted(got) == ["1", "2", "HIN"]
    assert (got["1"].text, got["1"].sentiment, got["1"].lang_ids) == ("hello duniya kya", "positive", "Eng HIN O")
    assert got["1"].hindi_ratio == pytest.approx(1 / 3)
    assert got["2"].sentiment is None and got["HIN"].text == "is haan"
    labels = spark.createDataFrame([("1", "neg"), ("1", "neu")], "uid STRING, sentiment STRING")
    joined = R.attach_test_labels(R.read_tagged_blocks(spark, str(path)), labels)
    assert sorted((r.uid, r.sentiment) for r in joined.collect() if r.sentiment) == [("1", "neg"), ("1", "neu")]
    assert joined.count() == 4


def test_results_of_all_layouts(spark, tmp_path):
    records = {
        "a/x.json": {"model": "m", "noise_level": "clean", "val_f1_macro": 0.81, "test_f1_macro": 0.8021},
        "b/y.json": {"model": "m", "noise": "high", "test_f1": 0.7751, "val_f1": 0.78, "epochs": 3, "lr": 0.001},
        "z.json": {"model": "n", "encoder": "e", "train_noise": "all", "test_noise": "clean", "seed": 42, "test_f1_macro": None, "best_val_f1": 0.5},
    }
    for name, record in records.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(record, indent=2))
    (tmp_path / "broken.json").write_text("{ not json")
    (tmp_path / "note.txt").write_text("{}")
    got = R.read_results(spark, str(tmp_path))
    assert {(r.model, r.test_noise, r.test_f1_macro, r.best_val_f1) for r in got.collect()} == {
        ("m", "clean", 0.8021, 0.81), ("m", "high", 0.7751, 0.78), ("n", "clean", None, 0.5),
    }
    table = {r.model: r for r in condition_average(results_pivot(got)).collect()}
    assert table["m"].degradation == pytest.approx(0.027) and table["m"].low is None
    assert table["m"].average == pytest.approx((0.8021 + 0.7751) / 2)


def test_seed_means_published(spark):
    # Three seeds whose mean and deviation round to .8498 and .002.
    df = spark.createDataFrame([("clean", 0.8475), ("clean", 0.8505), ("clean", 0.8514), ("low", 0.8453)], "test_noise STRING, test_f1_macro DOUBLE")
    got = {r.test_noise: r for r in seed_statistics(df, ["test_noise"]).collect()}
    assert round(got["clean"].mean_f1, 4) == 0.8498 and round(got["clean"].std_f1, 3) == 0.002
    assert got["low"].std_f1 == 0.0


def test_find_column():
    assert A.find_column(["id", "Tweet_Text", "label"], ("text",)) == "Tweet_Text"
    assert A.find_column(["a", "ths"], ("hs",)) == "ths"
    assert A.find_column(["a"], ("x",), "a") == "a"


def frame(spark, columns, *data):
    return spark.createDataFrame(list(data), ", ".join(f"`{c}` STRING" for c in columns))


def labels(df):
    return [r.label for r in df.collect()]


def test_adapters(spark):
    f = lambda columns, *data: frame(spark, columns, *data)
    hasoc = A.adapt_hasoc(f(["tweet_id", "text", "task_1"], ("1", "long enough", " hof "), ("2", "12345", "HOF"), ("3", "another one", "NOT"), ("4", None, "HOF")))
    # "tweet_id" contains "tweet", so it is the first text-like column.
    assert {r.text for r in hasoc.collect()} == set()
    hasoc = A.adapt_hasoc(f(["id", "text", "task_1"], ("1", "long enough", " hof "), ("2", "12345", "HOF"), ("3", "another", "NOT"), ("4", None, "HOF")))
    assert sorted((r.text, r.label, r.source, r.lang_pair) for r in hasoc.collect()) == [("another", 0, "hasoc2021", "hi-en"), ("long enough", 1, "hasoc2021", "hi-en")]
    assert labels(A.adapt_davidson(f(["tweet", "class"], ("a", "0"), ("b", "1"), ("c", "2")))) == [1, 1, 0]
    assert labels(A.adapt_semeval(f(["uid", "text", "label"], ("1", "some text", "2")))) == [0]
    assert [r.text for r in A.adapt_semeval(f(["uid", "body"], ("1", "some text"))).collect()] == ["some text"]
    assert labels(A.adapt_hindi_offensive(f(["sentence", "category"], ("a", "Hate"), ("b", " hate"), ("c", "no")))) == [1, 0, 0]
    assert labels(A.adapt_olid(f(["tweet", "subtask_a"], ("a", "off"), ("b", "NOT")))) == [1, 0]
    assert labels(A.adapt_hateval(f(["text", "HS"], ("a", "1"), ("b", "0"), ("c", "HATE")))) == [1, 0, 0]
    assert labels(A.adapt_tweeteval_hate(f(["text", "label"], ("a", "1"), ("b", "Hate")))) == [1, 0]
    explain = A.adapt_hatexplain(f(["post_tokens", "label"], ("['u', 'r']", "Offensive"), ("['x']", "normal")))
    assert [(r.text, r.label) for r in explain.collect()] == [("u r", 1), ("x", 0)]
    assert labels(A.adapt_hatexplain(f(["text"], ("abc",)))) == [0]
    boolean = spark.createDataFrame([("a", True), ("b", False)], "text STRING, HS BOOLEAN")
    assert labels(A.adapt_hateval(boolean)) == [1, 0]


def test_annotator_aggregation(spark):
    df = spark.createDataFrame(
        [(1, "7", None, "1.0"), (2, "7", "kept", "0.0"), (3, "7", "later", "0.5"), (4, "8", "low", "0.49"), (5, None, "x", "1")],
        "o INT, comment_id STRING, text STRING, hate_speech_score STRING",
    )
    got = {r.text: r.label for r in A.adapt_ucb_hate(df, "o").collect()}
    assert got == {"kept": 1, "low": 0}
    assert labels(A.adapt_ucb_hate(frame(spark, ["text"], ("abc",)))) == [0]


def test_routing_merge_and_splits(spark, tmp_path):
    tables = {
        "davidson.csv": frame(spark, ["tweet", "class"], *[(f"davidson text {i}", str(i % 3)) for i in range(60)]),
        "olid.csv": frame(spark, ["tweet", "subtask_a"], ("davidson text 1", "NOT"), ("tiny", "OFF"), ("olid text", "OFF")),
        "semeval_x.csv": frame(spark, ["uid", "text", "label"], *[(str(i), f"mixed bhasha {i}", "1") for i in range(20)]),
        "unknown.csv": frame(spark, ["text"], ("never read",)),
        "hateval.csv": frame(spark, ["only"], ("fails",)),
    }
    merged = C.reuse(C.merge(tables))
    assert merged.count() == 60 + 1 + 20
    assert merged.filter("text = 'davidson text 1'").first().source == "davidson"
    assert merged.select("row_id").distinct().count() == 81
    parts = C.build_splits(merged)
    assert parts["val"].count() == 12 and parts["test"].count() == 13 * 4
    noisy = parts["train"].filter("noise_level <> 'clean'")
    assert noisy.filter("lang_pair <> 'hi-en'").count() == 0 and noisy.count() > 0
    stats = {r.metric: r.value for r in parts["stats"].collect()}
    assert stats["total_clean"] == 81 and stats["train_size"] == parts["train"].count()

    everything = R.union_splits({k: parts[k] for k in ("train", "val", "test")})
    out = str(tmp_path / "final")
    K.write_splits(everything, out)
    stored = spark.read.parquet(out)
    low = R.read_condition(stored, "low")
    assert {r.noise_level for r in low["train"].select("noise_level").distinct().collect()} == {"clean", "low"}
    assert low["test"].select("noise_level").distinct().collect()[0][0] == "low"
    assert R.read_condition(stored.filter("noise_level <> 'low'"), "low")["test"].first().noise_level == "clean"
    assert R.read_condition(stored, "all")["test"].select("noise_level").distinct().count() == 4
    plan = stored.filter("split = 'train' AND noise_level = 'low'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan


def test_inventory_fallback_and_sinks(spark, tmp_path):
    K.write_csv(frame(spark, ["a", "b"], ("1", 'q"x'), ("2", "y")), str(tmp_path / "one"))
    K.write_csv(frame(spark, ["a", "b"]), str(tmp_path / "empty"))
    got = {r.name: r for r in R.inventory(spark, {"one": str(tmp_path / "one"), "gone": str(tmp_path / "gone")}).collect()}
    assert (got["one"].present, got["one"].rows, got["one"].columns) == (True, 2, "a, b")
    assert got["gone"].present is False and got["TOTAL"].rows == 2
    assert R.first_filled(spark, [str(tmp_path / p) for p in ("gone", "empty", "one")]).count() == 2
    with pytest.raises(FileNotFoundError):
        R.first_filled(spark, [str(tmp_path / "gone")])
    K.write_statistics(spark.createDataFrame([(4, 0.5)], "n INT, r DOUBLE"), str(tmp_path / "stats"))
    assert {tuple(r) for r in R.read_csv(spark, str(tmp_path / "stats")).collect()} == {("n", "4.0"), ("r", "0.5")}
    K.write_results(spark.createDataFrame([("m", "low", 0.5)], "model STRING, test_noise STRING, test_f1_macro DOUBLE"), str(tmp_path / "res"))
    assert spark.read.schema("model STRING").json(str(tmp_path / "res")).first().model == "m"
    features = spark.range(3).select(F.col("id").alias("row_id"), F.array(F.lit(1.0)).alias("features"))
    K.write_features(features, str(tmp_path / "feat"))
    assert R.read_feature_tables(spark, str(tmp_path / "feat")).count() == 3


def test_drop_junk(rows):
    df = rows([("1392749481536286721",), ("real​ text",)], "text STRING")
    assert [r.text for r in C.drop_junk(df).collect()] == ["real text"]


def test_lines_before_the_first_block_are_ignored(spark, tmp_path):
    (tmp_path / "a.conll").write_text("hello Eng\nworld Eng\nmeta 7 positive\nhi Eng\n")
    (tmp_path / "b.conll").write_text("meta 8 neutral\nyo Hin\n")
    got = {(r.uid, r.text) for r in R.read_tagged_blocks(spark, str(tmp_path)).collect()}
    assert got == {("7", "hi"), ("8", "yo")}


def test_a_bad_cell_is_no_failure(spark):
    from quaver.sources import adapters

    df = frame(spark, ["tweet", "class"], ("a tweet", "oops"), ("b tweet", "1"))
    assert {(r.text, r.label) for r in adapters.adapt_davidson(df).collect()} == {("a tweet", 0), ("b tweet", 1)}


def test_result_records_keep_all_fields(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"model": "m", "noise": "low", "test_f1": 0.5, "epoch": 3, "ablation": "gate"}))
    row = R.read_results(spark, str(tmp_path)).first()
    assert (row.epoch, row.ablation) == (3, "gate")


def test_a_run_replaces_its_records(spark, tmp_path):
    from quaver.sources import sinks

    rows = spark.createDataFrame([("m", 0.5)], "model STRING, test_f1 DOUBLE")
    for _ in range(2):
        sinks.write_results(rows, str(tmp_path / "res"), "run-1")
    sinks.write_results(rows, str(tmp_path / "res"), "run-2")
    assert len(R.read_results(spark, str(tmp_path / "res")).collect()) == 2


def test_runs_without_a_name_are_kept_apart(spark, tmp_path):
    def write(*rows):
        K.write_results(spark.createDataFrame(list(rows), "model STRING, seed INT, test_f1 DOUBLE"), str(tmp_path / "res"))

    write(("m", 1, 0.5), ("m", 2, 0.6))
    write(("n", 1, 0.7))
    write(("m", 1, 0.9))
    got = R.read_results(spark, str(tmp_path / "res")).collect()
    assert {(r.model, r.seed, r.test_f1_macro) for r in got} == {("m", 1, 0.9), ("m", 2, 0.6), ("n", 1, 0.7)} and len(got) == 3


@pytest.mark.parametrize(
    "content, sep",
    [
        ('"a, b, c"\t"d, e"\n1, 2, 3\tx\n4\ty, z\n', "\t"),
        ('id;text\n1;"one, two; three, four"\n2;"a ""b"", c\nnext, line"\n', ";"),
        ('id,text\n1,"x; y | z"\n2,"p; q"\n', ","),
        ("only\none\n", "\t"),
        ("", "\t"),
    ],
)
def test_sniffing_respects_quotes(spark, tmp_path, content, sep):
    path = tmp_path / "x.csv"
    path.write_text(content)
    assert R.sniff_separator(spark, str(path)) == sep


def test_positions_of_feature_files_equal_a_sequential_read(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    names = ["batch_b.parquet", "batch_a.parquet", "batch_c.parquet"]
    for k, (name, n) in enumerate(zip(names, (500, 3, 120), strict=True)):
        pq.write_table(pa.table({"v": [f"{name}{i}" for i in range(n)], "x": [k] * n}), tmp_path / name, row_group_size=50)
    wanted = [v for name in sorted(names) for v in pq.read_table(tmp_path / name)["v"].to_pylist()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = R.read_feature_tables(spark, str(tmp_path))
        assert [r.v for r in sorted(rows.collect(), key=lambda r: r.position)] == wanted
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(r.position for r in rows.select("position").collect()) == list(range(623))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
