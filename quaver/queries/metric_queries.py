"""Classification metrics, votes and agreement over the labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import fixed
from quaver.functions.draws import RANGE, digest, quarter
from quaver.functions.text import tokens
from quaver.operators import metrics as M
from quaver.queries import common as C
from quaver.queries import query, table
from quaver.queries.common import corpus, draw, words

# Stand-in predictions: each model flips a label with its own rate, which grows
# with the noise level. Percent: base rate per model, plus 2 per level.
MODELS = {"encoder": 20, "gate": 19, "gate_pairing": 18, "full": 16, "char_cnn": 24}
SEEDS = (13, 42, 99)
_LEVELS = list(fixed.LEVEL_CODES)


def predictions(spark, folder):
    """(row_id, label, model, test_noise, seed, prediction) for all labelled documents."""
    rows = table(spark, folder, "labels").select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("label"))
    kinds = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(r).alias("rate")) for m, r in MODELS.items()])
    grid = rows.select("row_id", "label", F.inline(kinds))
    grid = grid.withColumn("test_noise", F.explode(F.array(*[F.lit(v) for v in _LEVELS])))
    grid = grid.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in SEEDS])))
    level = F.array_position(F.array(*[F.lit(v) for v in _LEVELS]), F.col("test_noise")) - 1
    u = quarter(digest(F.col("model"), F.col("test_noise"), F.col("seed"), F.col("row_id")), 0)
    flipped = u * 100 < (F.col("rate") + 2 * level) * RANGE
    return grid.withColumn("prediction", F.when(flipped, 1 - F.col("label")).otherwise(F.col("label"))).drop("rate")


PREDICTIONS = f"""preds AS (SELECT row_id, label, model, test_noise, seed,
    CASE WHEN u * 100 < (rate + 2 * code) * {RANGE} THEN 1 - label ELSE label END AS prediction
  FROM (SELECT *, {draw("md5(model || '|' || test_noise || '|' || seed || '|' || row_id)", 0)} AS u FROM (
    SELECT doc_id AS row_id, toxic AS label, model, rate, test_noise, code, seed FROM labels,
      (VALUES {', '.join(f"('{m}', {r})" for m, r in MODELS.items())}) a(model, rate),
      (VALUES {', '.join(f"('{v}', {i})" for i, v in enumerate(_LEVELS))}) b(test_noise, code),
      (VALUES {', '.join(f'({s})' for s in SEEDS)}) c(seed))))"""


def scores_sql(source: str, by: str = "") -> str:
    """CTEs ``cell`` and ``cls`` with the per-class scores of a prediction table."""
    lead = f"{by}, " if by else ""
    return f"""cell AS (SELECT {lead}label, prediction, count(*) AS n FROM {source} GROUP BY ALL),
      part AS (SELECT {lead}label AS class, CASE WHEN label = prediction THEN n ELSE 0 END AS tp, n AS support, 0 AS predicted FROM cell
        UNION ALL SELECT {lead}prediction, 0, 0, n FROM cell),
      agg AS (SELECT {lead}class, sum(tp)::BIGINT AS tp, sum(support)::BIGINT AS support, sum(predicted)::BIGINT AS predicted FROM part GROUP BY ALL),
      cls AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
        CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, 2.0 * tp / (predicted + support) AS f1 FROM agg)"""


@query("SELECT toxic AS label, quality AS prediction, count(*) AS n FROM labels GROUP BY ALL")
def confusion(spark, folder):
    rows = table(spark, folder, "labels").select(F.col("toxic").alias("label"), F.col("quality").alias("prediction"))
    return M.confusion(rows)


@query(
    """SELECT toxic AS label, sum((quality = 0)::INT)::BIGINT AS predicted_0, sum((quality = 1)::INT)::BIGINT AS predicted_1
    FROM labels GROUP BY toxic"""
)
def confusion_matrix(spark, folder):
    rows = table(spark, folder, "labels").select(F.col("toxic").alias("label"), F.col("quality").alias("prediction"))
    return M.confusion_matrix(rows, [0, 1])


_LABELLED = "lab AS (SELECT toxic AS label, quality AS prediction FROM labels)"


@query(
    f"""WITH {_LABELLED}, {scores_sql('lab')}
    SELECT class::VARCHAR AS "row", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6)::DOUBLE AS f1, support FROM cls
    UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM cls
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM cls
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM cls"""
)
def class_report(spark, folder):
    rows = table(spark, folder, "labels").select(F.col("toxic").alias("label"), F.col("quality").alias("prediction"))
    report = M.class_report(rows)
    return report.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("SELECT count(*) AS n, round(avg((toxic = quality)::INT), 6) AS accuracy FROM labels")
def accuracy(spark, folder):
    rows = table(spark, folder, "labels").select(F.col("toxic").alias("label"), F.col("quality").alias("prediction"))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("prediction")).cast("double")), 6).alias("accuracy")
    )


_BY = "model, test_noise, seed"
SUMMARY = f"""{PREDICTIONS}, {scores_sql('preds', _BY)},
  res AS (SELECT {_BY}, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
    max(CASE WHEN class = 1 THEN f1 END) AS positive_f1, sum(tp) / sum(support) AS accuracy, sum(support)::BIGINT AS support
  FROM cls GROUP BY ALL)"""


@query(
    f"""WITH {SUMMARY} SELECT {_BY}, round(macro_f1, 6)::DOUBLE AS macro_f1, round(weighted_f1, 6)::DOUBLE AS weighted_f1,
    round(positive_f1, 6)::DOUBLE AS positive_f1, round(accuracy, 6) AS accuracy, support FROM res"""
)
def macro_f1(spark, folder):
    out = M.f1_summary(predictions(spark, folder), by=["model", "test_noise", "seed"])
    return out.withColumns({c: F.round(c, 6) for c in ("macro_f1", "weighted_f1", "positive_f1", "accuracy")})


@query(
    f"""WITH b AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch, toxic AS label, quality AS prediction FROM labels),
    {scores_sql('b', 'batch')},
    w AS (SELECT batch, sum(f1 * support) / sum(support) AS f, sum(tp) / sum(support) AS a FROM cls GROUP BY batch)
    SELECT count(*) AS batches, round(avg(f), 6) AS batch_f1, round(avg(a), 6) AS batch_accuracy FROM w"""
)
def batch_f1(spark, folder):
    rows = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"), F.col("quality").alias("prediction"))
    out = M.batch_averaged_f1(rows, "doc_id", 32)
    return out.withColumns({c: F.round(c, 6) for c in ("batch_f1", "batch_accuracy")})


_VOTERS = ("encoder", "gate", "full")


@query(
    f"""WITH {PREDICTIONS}, v AS (SELECT row_id, prediction, count(*) AS votes FROM preds
      WHERE test_noise = 'high' AND seed = 42 AND model IN {_VOTERS} GROUP BY ALL)
    SELECT row_id, prediction, votes FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, prediction) AS k FROM v) WHERE k = 1"""
)
def majority_vote(spark, folder):
    rows = predictions(spark, folder).filter((F.col("test_noise") == "high") & (F.col("seed") == 42))
    return M.majority_vote(rows.filter(F.col("model").isin(*_VOTERS)), "row_id")


@query(
    f"""WITH {PREDICTIONS}, a AS (SELECT row_id, prediction FROM preds WHERE test_noise = 'high' AND seed = 42 AND model = 'encoder'),
    b AS (SELECT row_id, prediction FROM preds WHERE test_noise = 'high' AND seed = 42 AND model = 'full')
    SELECT row_id, a.prediction AS first_prediction, b.prediction AS second_prediction FROM a JOIN b USING (row_id)
    WHERE a.prediction <> b.prediction ORDER BY md5('{fixed.SEED}|' || row_id), row_id LIMIT 50"""
)
def disagreement(spark, folder):
    rows = predictions(spark, folder).filter((F.col("test_noise") == "high") & (F.col("seed") == 42))
    return M.disagreements(rows, "row_id", "encoder", "full")


# Word frequencies of positive documents against those predicted positive.
def word_distributions(spark, folder):
    rows = corpus(spark, folder)
    count = lambda df: M.frequency(df.select(F.explode(tokens("text")).alias("word")), "word")
    return M.align_distributions(count(rows.filter("label = 1")), count(rows.filter("prediction = 1")), "word", "n")


_ALIGNED = f"""{C.CORPUS},
  f1 AS (SELECT word, count(*) AS n FROM (SELECT unnest({words('text')}) AS word FROM corpus WHERE label = 1) GROUP BY word),
  f2 AS (SELECT word, count(*) AS n FROM (SELECT unnest({words('text')}) AS word FROM corpus WHERE prediction = 1) GROUP BY word),
  al AS (SELECT word, f1.n AS train_value, coalesce(f2.n, 0) AS test_value FROM f1 LEFT JOIN f2 USING (word))"""


@query(f"WITH {_ALIGNED} SELECT * FROM al")
def dist_align(spark, folder):
    return word_distributions(spark, folder)


@query(f"WITH {_ALIGNED} SELECT round(corr(train_value, test_value), 6) AS pearson FROM al")
def pearson(spark, folder):
    return M.pearson(word_distributions(spark, folder), "train_value", "test_value").select(F.round("pearson", 6).alias("pearson"))


@query(
    f"""WITH {_ALIGNED}, r AS (SELECT rank() OVER (ORDER BY train_value) + (count(*) OVER (PARTITION BY train_value) - 1) / 2.0 AS x,
      rank() OVER (ORDER BY test_value) + (count(*) OVER (PARTITION BY test_value) - 1) / 2.0 AS y FROM al)
    SELECT round(corr(x, y), 6) AS spearman FROM r"""
)
def spearman(spark, folder):
    return M.spearman(word_distributions(spark, folder), "train_value", "test_value").select(F.round("spearman", 6).alias("spearman"))


@query(
    f"""WITH {_ALIGNED}, c AS (SELECT train_value AS x, test_value AS y, count(*) AS w FROM al GROUP BY ALL),
    p AS (SELECT sum(CASE WHEN sign(a.x - b.x) * sign(a.y - b.y) > 0 THEN a.w * b.w ELSE 0 END) / 2.0 AS good,
      sum(CASE WHEN sign(a.x - b.x) * sign(a.y - b.y) < 0 THEN a.w * b.w ELSE 0 END) / 2.0 AS bad FROM c a, c b),
    t AS (SELECT (SELECT sum(w) * (sum(w) - 1) / 2.0 FROM c) AS every,
      (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(w) AS n FROM c GROUP BY x)) AS tx,
      (SELECT sum(n * (n - 1) / 2.0) FROM (SELECT sum(w) AS n FROM c GROUP BY y)) AS ty)
    SELECT round((good - bad) / sqrt((every - tx) * (every - ty)), 6)::DOUBLE AS kendall FROM p, t"""
)
def kendall(spark, folder):
    return M.kendall(word_distributions(spark, folder), "train_value", "test_value").select(F.round("kendall", 6).alias("kendall"))


@query(f"WITH {C.CORPUS} SELECT word, count(*) AS n FROM (SELECT unnest({words('text')}) AS word FROM corpus WHERE label = 1) GROUP BY word ORDER BY n, word")
def category_frequency(spark, folder):
    rows = corpus(spark, folder).filter("label = 1").select(F.explode(tokens("text")).alias("word"))
    return M.frequency(rows, "word").orderBy("n", "word")
