import math

import pytest
from pyspark.sql import functions as F

from quaver.operators import ordering as O
from quaver.operators import splits as S


@pytest.fixture(scope="module")
def skewed(spark):
    """Nine of ten rows share one label."""
    return spark.range(1003).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("label"), F.lit("t").alias("text")
    )


def parts(df):
    return {r.row_id: r.split for r in df.select("row_id", "split").collect()}


def test_split_sizes_published():
    n = 112_542
    test = math.ceil(0.15 * n)
    val = math.ceil(0.15 / 0.85 * (n - test))
    assert (n - test - val, val, test) == (78_778, 16_882, 16_882)


def test_stratified_split_is_exact_and_stable(skewed):
    split = parts(S.stratified_split(skewed, "row_id"))
    assert len(split) == 1003
    sizes = {k: list(split.values()).count(k) for k in ("train", "val", "test")}
    assert sizes == {"test": math.ceil(0.15 * 1003), "val": math.ceil(0.15 / 0.85 * (1003 - 151)), "train": 1003 - 151 - 151}
    positives = [k for k in split if k % 10 == 0]
    in_test = sum(split[k] == "test" for k in positives)
    assert abs(in_test - 151 * 101 / 1003) <= 1
    for n in (1, 17):
        assert parts(S.stratified_split(skewed.repartition(n), "row_id")) == split


def test_split_equals_window_rank(skewed):
    from pyspark.sql import Window as W

    split = parts(S.stratified_split(skewed, "row_id"))
    ranked = skewed.withColumn("k", F.row_number().over(W.partitionBy("label").orderBy(O.hash_key("row_id"), "row_id")))
    limits = {lab: [0, 0] for lab in (0, 1)}
    for r in ranked.collect():
        kind = split[r.row_id]
        limits[r.label][0] = max(limits[r.label][0], r.k if kind == "test" else 0)
        limits[r.label][1] = max(limits[r.label][1], r.k if kind in ("test", "val") else 0)
    for r in ranked.collect():
        low, high = limits[r.label]
        assert split[r.row_id] == ("test" if r.k <= low else "val" if r.k <= high else "train")


def test_other_splits(skewed):
    sizes = lambda df: {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert sizes(S.random_split(skewed, "row_id")) == {"train": 902, "val": 101}
    assert sizes(S.stratified_holdout(skewed, "row_id", "label")) == {"train": 992, "val": 11}
    head = parts(S.positional_split(skewed, "row_id"))
    assert {k for k, v in head.items() if v == "train"} == set(range(802))


def test_unlabelled_rows_are_dropped(rows):
    df = rows([(i, None if i < 5 else i % 2) for i in range(25)], "row_id BIGINT, label INT")
    assert min(parts(S.stratified_split(df, "row_id"))) == 5


@pytest.mark.parametrize("n", [1, 5])
def test_ranks(spark, n):
    df = spark.range(0, 3000, 3).repartition(n)
    by_value = {r.id: r.position for r in O.rank_by_ordinal(df, "id").collect()}
    assert by_value == {3 * i: i + 1 for i in range(1000)}
    by_hash = {r.id: r.position for r in O.rank_by_hash(df, "id").collect()}
    assert sorted(by_hash.values()) == list(range(1, 1001))
    batches = {r.id: r.batch for r in O.batch_id(df, "id", 32).collect()}
    assert batches == {3 * i: i // 32 for i in range(1000)}


def test_running_total_spans_chunks(spark):
    df = spark.range(1, 101).select(F.lit("g").alias("g"), F.col("id").alias("r"), F.col("id").alias("v"))
    got = {r.r: r.before for r in O.running_total(df, ["g"], "r", "v", "before", width=7).collect()}
    assert got == {i: i * (i - 1) // 2 for i in range(1, 101)}


def test_sample_is_reproducible(spark):
    df = spark.range(500)
    a = [r.id for r in O.hash_sample(df, "id", 20).collect()]
    assert a == [r.id for r in O.hash_sample(df.repartition(9), "id", 20).collect()] and len(set(a)) == 20


def test_augmentation_keeps_train_texts_only(rows):
    train = rows([(1, "one text", 0), (2, "two text", 1)], "row_id BIGINT, text STRING, label INT")
    every = train.union(rows([(3, "held out", 1)], train.schema))
    out = S.augment_train(train, S.noise_levels(every, "row_id"))
    levels = {r.noise_level: r["count"] for r in out.groupBy("noise_level").count().collect()}
    assert levels == {"clean": 2, "low": 2, "medium": 2, "high": 2}
    assert out.filter("noise_level = 'clean' AND text_original IS NOT NULL").count() == 0
    made_here = S.augment_from(train, every, "row_id")
    assert {tuple(r) for r in made_here.select(out.columns).collect()} == {tuple(r) for r in out.collect()}


def test_split_statistics(rows):
    part = rows([(1,), (0,), (0,), (1,)], "label INT")
    stats = {r.metric: r.value for r in S.split_statistics(part, part, part.limit(1), part.limit(2)).collect()}
    assert stats["total_clean"] == 4 and stats["val_size"] == 1 and stats["hate_ratio_train"] == 0.5


def test_rows_without_ordinal_come_last(rows):
    df = rows([("a", 3.0), ("b", None), ("c", 1.0)], "k STRING, o DOUBLE")
    assert {r.k: r.position for r in O.rank_by_ordinal(df, "o").collect()} == {"c": 1, "a": 2, "b": 3}
    cut = {r.k: r.split for r in S.positional_split(df, "o", 0.7).collect()}
    assert cut == {"c": "train", "a": "train", "b": "test"}


def test_merge_does_not_depend_on_partitions(spark):
    from quaver.plans.corpus import merge

    raw = spark.createDataFrame([(f"some tweet {i % 50}", str(i % 3)) for i in range(200)], "tweet STRING, class STRING")
    out = [sorted(map(tuple, merge({"davidson.csv": raw.repartition(n)}).collect())) for n in (1, 4, 7)]
    assert out[0] == out[1] == out[2] and len(out[0]) == 50


def test_ties_do_not_follow_partitions(spark):
    rows = spark.range(40).select((F.col("id") % 2).alias("turn"), F.concat(F.lit("r"), "id").alias("name"))
    cut = [{r.name for r in S.positional_split(rows.repartition(n), "turn").filter("split = 'train'").collect()} for n in (1, 7)]
    assert cut[0] == cut[1] and len(cut[0]) == 32
    batches = [sorted((r.name, r.batch) for r in O.batch_id(rows.repartition(n), "turn", 8).collect()) for n in (1, 7)]
    assert batches[0] == batches[1]


@pytest.mark.parametrize("kind", ["string", "date", "double"])
def test_ranks_by_any_type_with_a_hot_value(spark, kind):
    value = {"string": "concat('k', lpad(o, 3, '0'))", "date": "date_add(DATE'2020-01-01', CAST(o AS INT))", "double": "o / 7"}[kind]
    hot = "CASE WHEN id % 3 = 0 THEN 5 WHEN id % 7 = 0 THEN NULL ELSE id % 90 END"
    rows = spark.range(900).selectExpr("id", f"{hot} AS o").selectExpr("id", f"{value} AS o", "map(id, id) AS extra")
    seen = [{r.id: r.position for r in O.rank_by_ordinal(rows.repartition(n), "o", tie="id").collect()} for n in (1, 7)]
    assert seen[0] == seen[1] and sorted(seen[0].values()) == list(range(1, 901))
    plain = sorted(((r.o is None, r.o if r.o is not None else 0, r.id) for r in rows.collect()))
    assert [i for _, _, i in plain] == sorted(seen[0], key=seen[0].get)
    untied = [{r.id: r.position for r in O.rank_by_ordinal(rows.drop("extra").repartition(n), "o").collect()} for n in (1, 7)]
    assert untied[0] == untied[1]
    cuts = [{r.id for r in S.positional_split(rows.drop("extra").repartition(n), "o", 0.41).filter("split = 'train'").collect()} for n in (1, 7)]
    assert cuts[0] == cuts[1] and len(cuts[0]) == 369
    assert cuts[0] == {i for i, p in untied[0].items() if p <= 369}


def test_a_hot_value_is_cut_into_ranges(spark):
    rows = spark.range(8000).selectExpr("id", "1 AS o")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = O.sample_sorted(rows.withColumn("c", O.content_key(rows)), [F.col("o"), F.col("c")]).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 2 and max(r["count"] for r in parts) < 5000


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 1.0])
def test_equal_rows_at_the_cut(spark, share):
    rows = spark.range(40).selectExpr("CAST(id % 2 AS STRING) AS turn", "'same' AS name")
    for n in (1, 7):
        cut = S.positional_split(rows.repartition(n), "turn", share)
        got = {(r.turn, r.split): r["count"] for r in cut.groupBy("turn", "split").count().collect()}
        taken = int(share * 40)
        assert got.get(("0", "train"), 0) == min(taken, 20) and got.get(("1", "train"), 0) == max(taken - 20, 0)
        assert sum(got.values()) == 40


def test_cut_of_an_empty_table(spark):
    assert S.positional_split(spark.range(0), "id").count() == 0
    assert O.rank_by_ordinal(spark.range(0), "id").count() == 0
