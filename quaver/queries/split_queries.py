"""Splits, samples, batches and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import fixed
from quaver.operators import ordering as O
from quaver.operators import splits as S
from quaver.operators.bounded import reuse
from quaver.queries import SQL, query, table
from quaver.queries import common as C
from quaver.queries.common import corpus, documents


def seats(source: str, size: str, wanted: str, out: str, name: str) -> str:
    """Largest-remainder shares of ``wanted`` rows, one row per label."""
    return f"""{name}0 AS (SELECT *, ({wanted}) * {size}::DOUBLE / sum({size}) OVER () AS e FROM {source}),
      {name}1 AS (SELECT *, floor(e)::BIGINT AS f FROM {name}0),
      {name} AS (SELECT * EXCLUDE (e, f), (f + CASE WHEN row_number() OVER (ORDER BY e - f DESC, label)
        <= ({wanted}) - sum(f) OVER () THEN 1 ELSE 0 END)::BIGINT AS {out} FROM {name}1)"""


_TEST = f"(SELECT ceil({fixed.TEST_SHARE} * sum(n)) FROM cnt)"
_VAL = f"(SELECT ceil({fixed.VALIDATION_SHARE / (1.0 - fixed.TEST_SHARE)!r}::DOUBLE * sum(rest)) FROM q2)"
QUOTAS = f"""cnt AS (SELECT label, count(*) AS n FROM corpus GROUP BY label),
  {seats('cnt', 'n', _TEST, 'n_test', 'q1')},
  q2 AS (SELECT *, n - n_test AS rest FROM q1),
  {seats('q2', 'rest', _VAL, 'n_val', 'q3')},
  rk AS (SELECT c.*, row_number() OVER (PARTITION BY label ORDER BY md5('{fixed.SEED}|' || row_id), row_id) AS k FROM corpus c),
  parts AS (SELECT rk.*, CASE WHEN k <= n_test THEN 'test' WHEN k <= n_test + n_val THEN 'val' ELSE 'train' END AS split
    FROM rk JOIN q3 USING (label))"""

SQL["noisy_test"] = SQL["noisy_test"].replace("{quotas}", QUOTAS)


@query(f"WITH {C.CORPUS}, {QUOTAS} SELECT row_id, label, split FROM parts")
def stratified_split(spark, folder):
    return S.stratified_split(corpus(spark, folder), "row_id").select("row_id", "label", "split")


@query(
    f"""WITH {C.CORPUS}, cnt AS (SELECT label, count(*) AS n FROM corpus GROUP BY label),
    {seats('cnt', 'n', '(SELECT ceil(0.01 * sum(n)) FROM cnt)', 'n_val', 'h')},
    rk AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('{fixed.SEED}|' || row_id)) AS k FROM corpus)
    SELECT row_id, label, CASE WHEN k <= n_val THEN 'val' ELSE 'train' END AS split FROM rk JOIN h USING (label)"""
)
def stratified_holdout(spark, folder):
    return S.stratified_holdout(corpus(spark, folder), "row_id", "label").select("row_id", "label", "split")


@query(
    f"""SELECT row_id, CASE WHEN k <= floor(0.9 * n) THEN 'train' ELSE 'val' END AS split
    FROM (SELECT event_id AS row_id, row_number() OVER (ORDER BY md5('{fixed.SEED}|' || event_id), event_id) AS k,
      count(*) OVER () AS n FROM events)"""
)
def random_split(spark, folder):
    rows = table(spark, folder, "events").select(F.col("event_id").alias("row_id"))
    return S.random_split(rows, "row_id")


@query(
    """SELECT row_id, lang_pair, CASE WHEN k <= floor(0.8 * n) THEN 'train' ELSE 'test' END AS split
    FROM (SELECT doc_id AS row_id, lang AS lang_pair, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents)"""
)
def positional_split(spark, folder):
    return S.positional_split(documents(spark, folder).select("row_id", "lang_pair"), "row_id")


@query("SELECT event_id, user_id, ((row_number() OVER (ORDER BY event_id) - 1) // 32)::BIGINT AS batch FROM events")
def batch_id(spark, folder):
    return O.batch_id(table(spark, folder, "events").select("event_id", "user_id"), "event_id", 32)


@query(f"SELECT doc_id AS row_id, source, lang AS lang_pair FROM documents ORDER BY md5('{fixed.SEED}|' || doc_id), doc_id LIMIT 50")
def hash_sample(spark, folder):
    return O.hash_sample(documents(spark, folder).select("row_id", "source", "lang_pair"), "row_id", 50)


@query(f"SELECT event_id, row_number() OVER (ORDER BY md5('{fixed.SEED}|' || event_id), event_id) AS \"position\" FROM events")
def shuffle_position(spark, folder):
    return O.rank_by_hash(table(spark, folder, "events").select("event_id"), "event_id")


@query(f"SELECT event_id, user_id, event_type FROM events ORDER BY md5('{fixed.SEED}|' || event_id), event_id")
def seeded_shuffle(spark, folder):
    return O.seeded_shuffle(table(spark, folder, "events").select("event_id", "user_id", "event_type"), "event_id")


_NOISY_TRAIN = f"src AS (SELECT row_id, text, level FROM corpus, {C.LEVEL_ROWS}), {C.token_noise('src')}"
AUGMENTED = f"""{C.CORPUS}, {QUOTAS}, {_NOISY_TRAIN},
  train AS (SELECT row_id, 'clean' AS noise_level, text, NULL::VARCHAR AS text_original, label FROM parts WHERE split = 'train'
    UNION ALL SELECT n.row_id, n.level, n.noisy, n.text_original, c.label FROM noisy_text n JOIN corpus c USING (row_id)
    WHERE n.text_original IN (SELECT text FROM parts WHERE split = 'train'))"""


def augmented(spark, folder):
    """Augmented training rows of the labelled documents."""
    rows = corpus(spark, folder).select("row_id", "text", "label")
    train = S.stratified_split(rows, "row_id").filter("split = 'train'").drop("split")
    columns = ["row_id", "noise_level", "text", "text_original", "label"]
    return S.augment_from(train, rows, "row_id").select(columns)


@query(f"WITH {AUGMENTED} SELECT * FROM train")
def augment_train(spark, folder):
    return augmented(spark, folder)


@query(
    f"""WITH {AUGMENTED}, s AS (SELECT (SELECT count(*) FROM corpus)::DOUBLE AS total_clean,
      (SELECT count(*) FROM train)::DOUBLE AS train_size, (SELECT count(*) FROM parts WHERE split = 'val')::DOUBLE AS val_size,
      (SELECT count(*) FROM parts WHERE split = 'test')::DOUBLE AS test_size,
      round((SELECT avg(label) FROM train), 6) AS hate_ratio_train,
      round((SELECT avg(label) FROM parts WHERE split = 'test'), 6) AS hate_ratio_test)
    SELECT metric, "value" FROM (UNPIVOT s ON COLUMNS(*) INTO NAME metric VALUE "value")"""
)
def split_stats(spark, folder):
    rows = corpus(spark, folder).select("row_id", "label", S.text_key("text").alias("text_key"))
    parts = reuse(S.stratified_split(rows, "row_id"))
    pick = lambda name: parts.filter(F.col("split") == name)
    # Sizes and shares need digests, no noise.
    copies = S.training_copies(pick("train"), rows)
    train = pick("train").select("label").unionByName(copies.select("label"))
    stats = S.split_statistics(rows, train, pick("val"), pick("test"))
    return stats.withColumn("value", F.round("value", 6))
