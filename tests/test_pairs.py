import random

import pytest
from pyspark.sql import functions as F

from quaver.functions import similarity as S
from quaver.operators import pairing as P
from quaver.operators.tables import keep_first


def test_jaro_winkler_worked_examples():
    got = S.jaro_winkler_many(["tera", "baap", "hai", "", "a"], ["tera", "bap", "hii", "x", ""])
    assert got.tolist() == pytest.approx([1.0, 14 / 15, 0.8, 0.0, 0.0])


def plain_jaro_winkler(a, b):
    """Textbook version."""
    if a == b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, hits = set(), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in used and b[j] == ch:
                used.add(j)
                hits.append(ch)
                break
    if not hits:
        return 0.0
    m = len(hits)
    t = sum(x != y for x, y in zip(hits, (b[j] for j in sorted(used)))) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


@pytest.mark.parametrize("longest", [6, 60])
def test_jaro_winkler_agrees_with_textbook(longest):
    rng = random.Random(5)
    make = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, longest)))
    a, b = [make() for _ in range(3000)], [make() for _ in range(3000)]
    assert S.jaro_winkler_many(a, b).tolist() == pytest.approx([plain_jaro_winkler(x, y) for x, y in zip(a, b)])


def test_phi(rows):
    df = rows(
        [
            ("tera baap hai", "tera bap hii"),
            ("same text", "same text"),
            ("", "x"),
            ("a b", "a"),
            ("Case", "cASE"),
            (None, "x"),
        ],
        "a STRING, b STRING",
    )
    got = [r[0] for r in df.select(S.phi("a", "b")).collect()]
    assert got[:5] == pytest.approx([1 - (1 + 14 / 15 + 0.8) / 3, 0.0, 0.0, 0.5, 0.0])
    assert got[5] is None


@pytest.fixture
def train(rows):
    return rows(
        [
            (1, "clean", "first text", None, 1),
            (2, "clean", "second text", None, 0),
            (3, "clean", "lonely text", None, 0),
            (4, "low", "frst text", "first text", 1),
            (5, "high", "f r s t", "first text", 1),
            (6, "medium", "secnd text", "second text", 0),
            (7, "low", "orphan copy", "text not in train", 1),
            (8, "low", "no original", None, 0),
            (9, "clean", None, None, 0),
            (10, "clean", "first text", None, 0),
        ],
        "ordinal BIGINT, noise_level STRING, text STRING, text_original STRING, label INT",
    )


def test_anchor_pairs(train):
    got = {r.ordinal: r for r in P.anchor_pairs(train, ["ordinal"]).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8, 10]
    assert all(r.ce_mask_clean != r.ce_mask_noisy for r in got.values())
    assert (got[1].noisy_text, got[1].noise_id, got[1].has_pair) == ("frst text", 1, True)
    assert (got[3].noisy_text, got[3].noise_id, got[3].has_pair) == ("lonely text", 0, False)
    assert (got[5].clean_text, got[5].noise_id, got[5].has_pair) == ("first text", 3, True)
    assert (got[7].clean_text, got[7].has_pair, got[7].noise_id) == ("orphan copy", False, 1)
    assert got[8].has_pair is False
    last = {r.ordinal: r for r in P.anchor_pairs(train, ["ordinal"], keep="last").collect()}
    assert last[1].noisy_text == "f r s t"
    only = P.anchor_pairs(train, ["ordinal"], "medium")
    assert {r.ordinal for r in only.filter("has_pair").collect()} == {2, 6}
    assert P.anchor_pairs(train, ["ordinal"], "clean").filter("has_pair").count() == 0


def test_clean_only_pairs(train):
    got = {r.ordinal: r for r in P.clean_only_pairs(train, ["ordinal"], "low").collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[1].noisy_text == "frst text" and got[1].phi > 0
    assert got[3].phi == 0.0 and got[3].noise_id == 0
    borrowed = P.clean_only_pairs(train, ["ordinal"], "clean")
    assert {r.ordinal for r in borrowed.filter("has_pair").collect()} == {1, 10} & {1}


def test_pair_inner_multiplicity(rows):
    clean = rows([("a", "a", 0)] * 3 + [(None, "b", 1)], "text_original STRING, text STRING, label INT")
    noisy = rows([("a", "aa", "low")] * 2 + [("a", "ab", "high"), (None, "b", "low")], "text_original STRING, text STRING, noise_level STRING")
    pairs = P.pair_inner(clean, noisy)
    assert sorted((r.text_noisy, r.n_pairs) for r in pairs.collect()) == [("aa", 6), ("ab", 3)]
    assert P.expand_pairs(pairs).count() == 9


def test_pair_statistics(train):
    stats = P.pair_statistics(P.anchor_pairs(train, ["ordinal"])).first()
    assert (stats.n_pair, stats.n_solo, stats.n_total, stats.n_levels, stats.has_diverse_noise) == (6, 3, 9, 3, True)


def test_keep_first_with_a_hot_key(spark):
    df = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("text"), F.lit(1).alias("label")
    )
    for n in (1, 13):
        out = keep_first(df.repartition(n), "text", ["id"])
        assert out.count() == 2001
        assert out.filter("text = 'hot'").first().id == 0
    again = keep_first(out, "text", ["id"])
    assert again.count() == 2001


def test_mean_phi_rises_with_level(spark):
    from quaver.operators.splits import noise_levels

    text = F.concat_ws(" ", *[F.concat(F.lit(w), F.col("id")) for w in ("vase", "the", "shadow", "quick", "ok", "nahi")])
    rows_ = spark.range(300).select(F.col("id").alias("row_id"), text.alias("text"))
    noisy = noise_levels(rows_, "row_id").withColumn("phi", S.phi("text_original", "text"))
    means = {r.noise_level: r.m for r in noisy.groupBy("noise_level").agg(F.avg("phi").alias("m")).collect()}
    assert 0 < means["low"] < means["medium"] < means["high"] < 1
    assert noisy.filter("phi < 0 OR phi > 1 OR phi IS NULL").count() == 0


def test_scores_do_not_depend_on_how_many_pairs_are_held(monkeypatch):
    import pandas as pd

    from quaver.functions import similarity as sim

    left = pd.Series(["tera baap hai", None, "", "a b c d e f g", "longword " * 40])
    right = pd.Series(["tera bap hii", "x", "y", "a x c y e", "longwort " * 41])
    whole = sim._mean_similarity(left, right)
    monkeypatch.setattr(sim, "PAIRS_AT_ONCE", 3)
    assert pd.Series(sim._mean_similarity(left, right)).round(12).equals(pd.Series(whole).round(12))


def test_long_words_score_like_short_ones():
    import random

    from quaver.functions import similarity as sim

    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(1, 20))) for _ in range(2))
        assert abs(sim._by_pointers(a, b) - sim.jaro_winkler_many([a], [b])[0]) < 1e-12


def late_tables(spark, n=1):
    from quaver.operators.splits import augment_from
    from quaver.operators.tables import level_code

    words = ("vase", "the", "shadow", "quick", "ok", "nahi", "karna", "shouting")
    text = F.concat_ws(" ", *[F.concat(F.lit(w), F.col("id") % 17) for w in words])
    text = F.when(F.col("id") % 23 == 0, None).when(F.col("id") % 29 == 0, "").otherwise(text)
    label = F.when(F.col("id") % 31 == 0, None).otherwise((F.col("id") % 2).cast("int"))
    source = spark.range(300).select(F.col("id").alias("row_id"), text.alias("text"), label.alias("label")).repartition(n)
    train = source.filter("label IS NOT NULL AND row_id % 17 < 9 AND row_id > 40")
    whole = augment_from(train, source, "row_id").select("row_id", "noise_level", "text", "text_original", "label")
    return train, source, whole.withColumn("ordinal", F.col("row_id") * 4 + level_code())


def as_rows(pairs, drop):
    columns = sorted(set(pairs.columns) - set(drop))
    return sorted((tuple(r) for r in pairs.select(columns).collect()), key=repr)


@pytest.mark.parametrize(("condition", "keep"), [("all", "first"), ("all", "last"), ("medium", "first"), ("clean", "first")])
def test_late_pairs_equal_pairs_of_the_noisy_table(spark, condition, keep):
    from quaver.operators.tables import level_code

    train, source, whole = late_tables(spark, 5)
    wanted = P.anchor_pairs(whole, ["ordinal"], condition, keep)
    late = P.late_anchor_pairs(train, source, "row_id", condition, keep)
    late = late.withColumn("ordinal", F.col("row_id") * 4 + level_code()).drop("row_id")
    assert as_rows(late, []) == as_rows(wanted, []) and late.filter("has_pair").count() > 0 or condition == "clean"


def test_late_clean_only_pairs_equal_those_of_the_noisy_table(spark):
    train, source, whole = late_tables(spark, 3)
    for condition in ("clean", "high"):
        wanted = P.clean_only_pairs(whole, ["ordinal"], condition)
        late = P.late_clean_only_pairs(train, source, "row_id", condition).withColumn("ordinal", F.col("row_id") * 4).drop("row_id")
        assert as_rows(late, []) == as_rows(wanted, [])


@pytest.mark.parametrize("name", ["pair_stats", "split_stats"])
def test_counts_make_no_noise_and_keep_no_text(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # Noise works on the tokens of a text, one by one.
    assert "lambda" not in plan and "regexp" not in plan
    assert "Python" not in plan
    assert all("text#" not in line for line in plan.splitlines() if "InMemoryRelation" in line)


def test_word_pairs_are_scored_where_they_are(spark, tmp_path):
    from quaver.queries import QUERIES

    spark.createDataFrame([(1, "one two three four five the is of", "s", "en")], "doc_id BIGINT, text STRING, source STRING, lang STRING").write.parquet(f"{tmp_path}/documents.parquet")
    plan = QUERIES["jaro_winkler"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert moved and not any("(x#" in line for line in moved), moved


def test_word_similarity_of_many_batches(spark):
    rows = [("dwayne", "duane"), (None, "a"), ("a", None), ("", ""), ("same", "same"), ("x" * 30, "x" * 29 + "y"), ("日本語", "日木語")]
    df = spark.createDataFrame([(i, *rows[i % len(rows)]) for i in range(25_000)], "i INT, a STRING, b STRING").coalesce(1)
    got = {r.i: r.s for r in df.select("i", S.jaro_winkler("a", "b").alias("s")).collect()}
    for i in range(25_000):
        a, b = rows[i % len(rows)]
        assert got[i] is None if a is None or b is None else abs(got[i] - plain_jaro_winkler(a, b)) < 1e-12
