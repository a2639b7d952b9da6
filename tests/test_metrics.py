import itertools
import random

import pytest
from pyspark.sql import functions as F

from quaver.operators import metrics as M
from quaver.operators import results as R
from quaver.operators import tables as T


@pytest.fixture
def worked(spark):
    """Confusion [[900, 100], [150, 350]]."""
    cells = [(0, 0, 900), (0, 1, 100), (1, 0, 150), (1, 1, 350)]
    df = spark.createDataFrame(cells, "label INT, prediction INT, n INT")
    return df.select("label", "prediction", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))


def test_worked_example(worked):
    got = M.f1_summary(worked).first()
    assert round(got.macro_f1, 3) == 0.807 and round(got.positive_f1, 3) == 0.737
    assert got.accuracy == pytest.approx(1250 / 1500)
    classes = {r["class"]: r for r in M.class_scores(worked).collect()}
    assert round(classes[0].f1, 3) == 0.878
    assert classes[1].precision == pytest.approx(350 / 450) and classes[1].recall == pytest.approx(0.7)
    report = {r.row: r for r in M.class_report(worked).collect()}
    assert list(report) != [] and report["accuracy"].precision is None
    assert report["weighted avg"].f1 == pytest.approx((classes[0].f1 * 1000 + classes[1].f1 * 500) / 1500)


def test_missing_and_single_classes(rows):
    got = M.f1_summary(rows([(0, 0), (1, 0)], "label INT, prediction INT")).first()
    assert got.positive_f1 == 0.0 and got.macro_f1 == pytest.approx((2 / 3) / 2)
    got = M.f1_summary(rows([(0, 0), (0, 0)], "label INT, prediction INT")).first()
    assert got.macro_f1 == 1.0 and got.positive_f1 is None
    got = M.class_scores(rows([(0, 2)], "label INT, prediction INT")).collect()
    assert {r["class"]: (r.precision, r.recall) for r in got} == {0: (0.0, 0.0), 2: (0.0, 0.0)}


def test_batch_average_differs_from_global(rows):
    df = rows([(i, i % 2, (i // 3) % 2) for i in range(70)], "id BIGINT, label INT, prediction INT")
    got = M.batch_averaged_f1(df, "id", 32).first()
    want = []
    for lo in range(0, 70, 32):
        part = df.filter((F.col("id") >= lo) & (F.col("id") < lo + 32))
        want.append(M.f1_summary(part).first().weighted_f1)
    assert got.batches == 3 and got.batch_f1 == pytest.approx(sum(want) / 3)


def tau_b(pairs):
    good = bad = tx = ty = 0
    for (a, b), (c, d) in itertools.combinations(pairs, 2):
        s = (a - c) * (b - d)
        good, bad = good + (s > 0), bad + (s < 0)
        tx, ty = tx + (a == c), ty + (b == d)
    n = len(pairs) * (len(pairs) - 1) / 2
    return (good - bad) / ((n - tx) * (n - ty)) ** 0.5


def average_ranks(values):
    ordered = sorted(values)
    return [ordered.index(v) + (ordered.count(v) + 1) / 2 for v in values]


@pytest.mark.parametrize("spread", [4, 1000])
def test_rank_correlations(rows, spread):
    rng = random.Random(3)
    pairs = [(rng.randrange(spread), rng.randrange(spread)) for _ in range(150)]
    pairs += [(x, x // 2) for x in range(50)] + [(1, 1)] * 40
    df = rows(pairs, "x INT, y INT")
    assert M.kendall(df, "x", "y").first()[0] == pytest.approx(tau_b(pairs))
    xs, ys = (average_ranks([p[k] for p in pairs]) for k in (0, 1))
    mean = (len(pairs) + 1) / 2
    top = sum((a - mean) * (b - mean) for a, b in zip(xs, ys))
    want = top / (sum((a - mean) ** 2 for a in xs) * sum((b - mean) ** 2 for b in ys)) ** 0.5
    assert M.spearman(df, "x", "y").first()[0] == pytest.approx(want)


def test_constant_side_has_no_correlation(rows):
    df = rows([(1, 2), (1, 3), (1, 4)], "x INT, y INT")
    assert M.kendall(df, "x", "y").first()[0] is None


def test_votes_and_disagreement(rows):
    df = rows(
        [(1, "a", 0), (1, "b", 1), (1, "c", 1), (2, "a", 0), (2, "b", 0), (2, "c", 1)], "row_id BIGINT, model STRING, prediction INT"
    )
    assert {(r.row_id, r.prediction, r.votes) for r in M.majority_vote(df, "row_id").collect()} == {(1, 1, 2), (2, 0, 2)}
    assert [r.row_id for r in M.disagreements(df, "row_id", "a", "b").collect()] == [1]


def test_alignment_of_distributions(rows):
    train = rows([("ORG", 5), ("GPE", 2)], "kind STRING, n BIGINT")
    test = rows([("ORG", 3), ("DATE", 9)], "kind STRING, n BIGINT")
    got = {r.kind: (r.train_value, r.test_value) for r in M.align_distributions(train, test, "kind", "n").collect()}
    assert got == {"ORG": (5, 3), "GPE": (2, 0)}


def test_epochs_ablation_and_order(rows):
    log = rows([("r", 1, 0.5), ("r", 2, 0.7), ("r", 3, 0.7)], "run STRING, epoch INT, val_f1 DOUBLE")
    assert R.best_epoch(log, ["run"]).first().epoch == 2
    results = rows(
        [("base", "clean", 0.8), ("base", "high", 0.7), ("full", "clean", 0.82), ("full", "high", 0.76)],
        "model STRING, test_noise STRING, test_f1_macro DOUBLE",
    )
    gains = R.ablation_gain(results, ["base", "full"]).orderBy("step").collect()
    assert gains[0].gain_pp is None and gains[1].gain_pp == pytest.approx(4.0)
    deltas = R.baseline_delta(results, "base", ["test_noise"])
    assert R.gain_rises(deltas).first().rises is True
    assert {r.model for r in R.best_per_condition(results).collect()} == {"full"}
    assert [r.test_noise for r in T.order_by_level(results, "test_noise", "model").collect()] == ["clean", "clean", "high", "high"]
    assert R.ordered_results(results).first().model == "base"


def test_label_operators(rows):
    df = rows([(1, "HOF"), (2, "NONE"), (3, None), (4, "x")], "id INT, y STRING")
    mapped = [r[0] for r in df.select(T.map_labels("y", {"HOF": F.lit(1), "NONE": F.lit(0)})).collect()]
    assert mapped == [1, 0, None, None]
    codes = T.fit_label_codes(df.filter("id < 3"), "y")
    assert {r.id: r.code for r in T.encode_labels(df, "y", codes).collect()} == {1: 0, 2: 1, 3: None, 4: None}
    weights = {r.label: r.weight for r in T.class_weights(rows([(0,)] * 3 + [(1,)], "label INT")).collect()}
    assert weights == {0: pytest.approx(4 / 6), 1: pytest.approx(2.0)}
    assert T.drop_missing(df, ["y"]).count() == 3
    profile = {r.column: (r.row_count, r.nulls) for r in T.null_profile(df).collect()}
    assert profile == {"id": (4, 0), "y": (4, 1)}
    assert [r.id for r in T.preview(df, ["id"]).collect()] == [1, 2]
    scored = rows([(0.5,), (0.49,), (None,)], "s DOUBLE")
    assert [r[0] for r in scored.select(T.score_label("s")).collect()] == [1, 0, 0]
