"""Robustness tables over result rows computed from the stand-in predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.operators import metrics as M
from quaver.operators import results as R
from quaver.operators.tables import level_code
from quaver.queries import query, table
from quaver.queries.metric_queries import SUMMARY, predictions
from quaver.sources.readers import normalise_results

STEPS = ["encoder", "gate", "gate_pairing", "full"]


def result_rows(spark, folder):
    """One record per model, condition and seed, scores rounded as stored."""
    summary = M.f1_summary(predictions(spark, folder), by=["model", "test_noise", "seed"])
    return summary.select("model", "test_noise", "seed", F.round("macro_f1", 6).alias("test_f1_macro"))


RESULTS = f"{SUMMARY}, r AS (SELECT model, test_noise, seed, round(macro_f1, 6)::DOUBLE AS test_f1_macro FROM res)"
_WIDE = ", ".join(f"avg(CASE WHEN test_noise = '{v}' THEN test_f1_macro END) AS {v}" for v in R.CONDITIONS)


# Six digits: means of three seeds can end in a tie at four, which engines round differently.
@query(
    f"""WITH {RESULTS}, p AS (SELECT model, {_WIDE} FROM r GROUP BY model)
    SELECT model, round(clean, 6) AS clean, round(low, 6) AS low, round(medium, 6) AS medium, round(high, 6) AS high,
      round(clean - high, 6) AS degradation, round((round(clean, 6) + round(low, 6) + round(medium, 6) + round(high, 6)) / 4, 8) AS average FROM p"""
)
def results_pivot(spark, folder):
    wide = R.condition_average(R.results_pivot(result_rows(spark, folder), digits=6))
    return wide.withColumn("average", F.round("average", 8))


@query(
    f"""WITH {RESULTS} SELECT model, test_noise, round(avg(test_f1_macro), 6) AS mean_f1,
    round(coalesce(stddev_samp(test_f1_macro), 0), 6) AS std_f1, count(*) AS n_seeds FROM r GROUP BY ALL"""
)
def seed_stats(spark, folder):
    out = R.seed_statistics(result_rows(spark, folder), ["model", "test_noise"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean_f1", "std_f1")})


_DELTA = f"""{RESULTS}, m AS (SELECT model, test_noise, avg(test_f1_macro) AS score FROM r GROUP BY ALL),
  dl AS (SELECT m.model, m.test_noise, m.score, b.score AS baseline_score, (m.score - b.score) * 100 AS delta_pp
    FROM m JOIN m b ON m.test_noise = b.test_noise AND b.model = 'encoder' WHERE m.model <> 'encoder')"""


@query(f"WITH {_DELTA} SELECT model, test_noise, round(score, 6) AS score, round(baseline_score, 6) AS baseline_score, round(delta_pp, 5) AS delta_pp FROM dl")
def baseline_delta(spark, folder):
    out = R.baseline_delta(result_rows(spark, folder), "encoder", ["test_noise"])
    return out.withColumns({"score": F.round("score", 6), "baseline_score": F.round("baseline_score", 6), "delta_pp": F.round("delta_pp", 5)})


@query(
    f"""WITH {_DELTA}, s AS (SELECT model, delta_pp - lag(delta_pp) OVER (PARTITION BY model ORDER BY
      CASE test_noise WHEN 'clean' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END) AS step FROM dl)
    SELECT model, bool_and(coalesce(step >= 0, true)) AS rises FROM s GROUP BY model"""
)
def gain_rises(spark, folder):
    return R.gain_rises(R.baseline_delta(result_rows(spark, folder), "encoder", ["test_noise"]))


@query(
    f"""WITH {RESULTS}, m AS (SELECT model, test_noise, round(avg(test_f1_macro), 6) AS score FROM r GROUP BY ALL)
    SELECT model, test_noise, score FROM (SELECT *, rank() OVER (PARTITION BY test_noise ORDER BY score DESC) AS k FROM m) WHERE k = 1"""
)
def best_per_condition(spark, folder):
    return R.best_per_condition(result_rows(spark, folder))


@query(
    f"""WITH {RESULTS}, a AS (SELECT model, list_position({STEPS}, model)::INT - 1 AS step, avg(test_f1_macro) AS avg_f1 FROM r
      WHERE model IN ({', '.join(f"'{s}'" for s in STEPS)}) GROUP BY model)
    SELECT step, model, round(avg_f1, 6) AS avg_f1, round((avg_f1 - lag(avg_f1) OVER (ORDER BY step)) * 100, 5) AS gain_pp FROM a"""
)
def ablation_gain(spark, folder):
    out = R.ablation_gain(result_rows(spark, folder), STEPS)
    return out.withColumns({"avg_f1": F.round("avg_f1", 6), "gain_pp": F.round("gain_pp", 5)})


@query(
    f"""WITH {RESULTS} SELECT model, test_noise, seed, test_f1_macro, CASE test_noise WHEN 'clean' THEN 0 WHEN 'low' THEN 1
    WHEN 'medium' THEN 2 ELSE 3 END AS code FROM r ORDER BY model, test_noise, seed"""
)
def ordered_results(spark, folder):
    rows = result_rows(spark, folder).withColumn("code", level_code("test_noise"))
    return R.ordered_results(rows, then=("seed",))


@query(
    f"""WITH {RESULTS} SELECT model, coalesce(test_noise, 'none') AS test_noise, count(*) AS n, round(avg(test_f1_macro), 6) AS mean_f1 FROM r GROUP BY ALL"""
)
def results_normalised(spark, folder):
    """Records written with three spellings of the same fields, read as one."""
    rows = result_rows(spark, folder)
    pick = lambda seed: F.col("seed") == seed
    spelled = rows.select(
        "model",
        F.when(pick(13), F.col("test_noise")).alias("test_noise"),
        F.when(pick(42), F.col("test_noise")).alias("noise_level"),
        F.when(pick(99), F.col("test_noise")).alias("noise"),
        F.when(~pick(99), F.col("test_f1_macro")).alias("test_f1_macro"),
        F.when(pick(99), F.col("test_f1_macro")).alias("test_f1"),
        *[F.lit(None).cast("double").alias(c) for c in ("best_val_f1", "val_f1", "val_f1_macro")],
    )
    out = normalise_results(spelled).groupBy("model", F.coalesce("test_noise", F.lit("none")).alias("test_noise"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("test_f1_macro"), 6).alias("mean_f1"))


# Days are epochs, event types are runs, the mean value of a day is its score.
_LOG = """el AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS epoch, value AS train_loss FROM events)"""


def step_log(spark, folder):
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("epoch")
    return table(spark, folder, "events").select("event_type", day, F.col("value").alias("train_loss"))


@query(
    f"""WITH {_LOG}, e AS (SELECT event_type, epoch, round(avg(train_loss), 4) AS val_f1 FROM el GROUP BY ALL)
    SELECT event_type, epoch, val_f1 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY val_f1 DESC, epoch) AS k FROM e) WHERE k = 1"""
)
def best_epoch(spark, folder):
    epochs = step_log(spark, folder).groupBy("event_type", "epoch").agg(F.round(F.avg("train_loss"), 4).alias("val_f1"))
    return R.best_epoch(epochs, ["event_type"])


@query(f"WITH {_LOG} SELECT event_type, epoch, round(avg(train_loss), 6) AS mean_loss FROM el GROUP BY ALL")
def epoch_losses(spark, folder):
    return R.epoch_losses(step_log(spark, folder), ["event_type"]).withColumn("mean_loss", F.round("mean_loss", 6))
