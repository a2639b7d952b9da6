"""De-duplication, profiles and label bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.operators import tables as T
from quaver.plans.corpus import noisy_label_counts
from quaver.queries import common as C
from quaver.queries import query, table
from quaver.queries.common import corpus, documents
from quaver.queries.text_queries import clean_sql


@query("SELECT row_id, text, source FROM (SELECT doc_id AS row_id, text, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_first(spark, folder):
    return T.keep_first(documents(spark, folder).select("row_id", "text", "source"), "text", ["row_id"])


@query(
    """SELECT "column", "ordinal", row_count, nulls FROM (
      SELECT 'event_id' AS "column", 0 AS "ordinal", count(*) AS row_count, count(*) - count(event_id) AS nulls FROM events
      UNION ALL SELECT 'ts', 1, count(*), count(*) - count(ts) FROM events
      UNION ALL SELECT 'user_id', 2, count(*), count(*) - count(user_id) FROM events
      UNION ALL SELECT 'event_type', 3, count(*), count(*) - count(event_type) FROM events
      UNION ALL SELECT 'value', 4, count(*), count(*) - count(value) FROM events
      UNION ALL SELECT 'props', 5, count(*), count(*) - count(props) FROM events)"""
)
def null_profile(spark, folder):
    return T.null_profile(table(spark, folder, "events"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def value_counts(spark, folder):
    return T.value_counts(table(spark, folder, "documents"), ["source", "lang"])


@query(
    f"""WITH {C.CORPUS} SELECT source, count(*) AS n, sum(label)::BIGINT AS positive, sum(1 - label)::BIGINT AS negative,
    round(avg(label), 6) AS positive_ratio FROM corpus GROUP BY source"""
)
def label_ratio_by_source(spark, folder):
    out = T.label_ratio(corpus(spark, folder), ["source"])
    return out.withColumn("positive_ratio", F.round("positive_ratio", 6))


@query(
    f"""WITH {C.CORPUS}, c AS (SELECT label, count(*) AS n FROM corpus GROUP BY label)
    SELECT label, n, round(sum(n) OVER () / (2.0 * n), 6)::DOUBLE AS weight FROM c"""
)
def class_weights(spark, folder):
    return T.class_weights(corpus(spark, folder)).withColumn("weight", F.round("weight", 6))


@query(
    """SELECT user_id, arg_min(event_type, event_id) AS event_type, round(avg(value), 6) AS value,
      (avg(value) >= 20)::INT AS label FROM events GROUP BY user_id"""
)
def annotator_agg(spark, folder):
    means = T.annotator_means(table(spark, folder, "events"), "user_id", "event_type", "value", "event_id", cut=20)
    return means.withColumn("value", F.round("value", 6))


@query("SELECT doc_id AS row_id, lang, dense_rank() OVER (ORDER BY lang) - 1 AS code FROM documents")
def label_encode(spark, folder):
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("row_id"), "lang")
    codes = T.fit_label_codes(rows, "lang").withColumn("code", F.col("code").cast("bigint"))
    return T.encode_labels(rows, "lang", codes)


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 END AS mapped, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flag FROM events")
def map_labels(spark, folder):
    mapped = T.map_labels("event_type", {"click": F.lit(1), "view": F.lit(0)})
    return table(spark, folder, "events").select("event_id", mapped.alias("mapped"), T.binary_label("event_type", "error").alias("flag"))


@query(
    f"""WITH c AS (SELECT doc_id AS row_id, {clean_sql()} AS t, lang, text AS original FROM documents),
    k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY row_id) AS p FROM c WHERE length(t) > 5) WHERE p = 1),
    src AS (SELECT row_id, t AS text, 'high' AS level FROM k), {C.token_noise('src')}
    SELECT k.lang AS lang_pair, count(*) AS n, sum((n.noisy <> n.text_original)::INT)::BIGINT AS n_changed,
      sum(length(n.noisy))::BIGINT AS n_chars FROM noisy_text n JOIN k USING (row_id) GROUP BY ALL"""
)
def noisy_counts(spark, folder):
    return noisy_label_counts(documents(spark, folder), "row_id")


@query(
    """SELECT row_count, lang, source FROM (SELECT count(*) AS row_count, d.lang, d.source FROM documents d
    SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) p USING (doc_id) GROUP BY ALL)"""
)
def positive_rows(spark, folder):
    predictions = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("prediction"))
    kept = T.positive_rows(table(spark, folder, "documents"), predictions, "doc_id")
    return kept.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    """SELECT lang, round(avg(len(list_filter(ws, lambda w: w = 'the')) / greatest(len(ws), 1)), 6) AS mean_ratio
    FROM (SELECT lang, list_filter(string_split(lower(text), ' '), lambda w: w <> '') AS ws FROM documents) GROUP BY lang"""
)
def language_ratio(spark, folder):
    tags = F.filter(F.split(F.lower("text"), " "), lambda w: w != "")
    return table(spark, folder, "documents").groupBy("lang").agg(F.round(F.avg(T.language_ratio(tags, "the")), 6).alias("mean_ratio"))
