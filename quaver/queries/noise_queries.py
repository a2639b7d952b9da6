"""Noise operators over all documents and all of their words."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import fixed
from quaver.functions import noise as N
from quaver.functions.draws import digest, quarter
from quaver.functions.text import tokens
from quaver.operators.splits import noise_levels as noisy_copies
from quaver.operators.splits import stratified_split as split_rows
from quaver.queries import query
from quaver.queries import common as C
from quaver.queries.common import corpus, documents, draw, pick, q, words

# The word operators hit every word here; its draws come from this key.
LEVEL = "every"
_ALL = f"src AS (SELECT doc_id AS row_id, text, '{LEVEL}' AS level FROM documents)"


def _every_word(spark, folder, change):
    noisy = N.map_words(F.col("text"), [fixed.SEED, LEVEL, F.col("row_id")], change)
    return documents(spark, folder).select("row_id", noisy.alias("text"))


def _every_word_sql(expression: str) -> str:
    return f"""WITH {_ALL}, {C.token_table('src')},
      n AS (SELECT row_id, i, {expression} AS v FROM (SELECT *, {draw('d', 2)} AS u2, {draw('d', 3)} AS u3 FROM tok)),
      j AS (SELECT row_id, string_agg(v, ' ' ORDER BY i) AS text FROM n GROUP BY row_id)
    SELECT s.row_id, coalesce(j.text, '') AS text FROM src s LEFT JOIN j USING (row_id)"""


@query(_every_word_sql(C.char_sub("w", "u2", "u3")))
def char_substitution(spark, folder):
    return _every_word(spark, folder, lambda w, d: N.char_substitution(w, quarter(d, 2), quarter(d, 3)))


@query(_every_word_sql(C.split_word("w", "u3")))
def word_split(spark, folder):
    return _every_word(spark, folder, lambda w, d: N.word_split(w, quarter(d, 3)))


@query(_every_word_sql(C.variant("w", "u2")))
def translit(spark, folder):
    return _every_word(spark, folder, lambda w, d: N.transliteration_variant(w, quarter(d, 2)))


@query(_every_word_sql(C.schwa("w")))
def schwa(spark, folder):
    return _every_word(spark, folder, lambda w, d: N.schwa_deletion(w))


_LISTS = f"""t AS (SELECT doc_id AS row_id, {words('text')} AS ws, md5('{fixed.SEED}|list|' || doc_id) AS d FROM documents),
  u AS (SELECT row_id, ws, {draw('d', 2)} AS u2, {draw('d', 3)} AS u3 FROM t)"""


@query(
    f"""WITH {_LISTS}, f AS (SELECT *, list_filter(range(1, len(ws) + 1), lambda i: {C.in_words('ws[i]')}) AS spots FROM u),
    g AS (SELECT row_id, ws, CASE WHEN len(spots) > 0 THEN spots[u2 % len(spots) + 1] ELSE 0 END AS gone FROM f)
    SELECT row_id, array_to_string(list_concat(ws[:gone - 1], ws[gone + 1:]), ' ') AS text FROM g WHERE gone > 0
    UNION ALL SELECT row_id, array_to_string(ws, ' ') FROM g WHERE gone = 0"""
)
def delete_function_word(spark, folder):
    rows = documents(spark, folder).select("row_id", tokens("text").alias("ws"), digest(fixed.SEED, "list", F.col("row_id")).alias("d"))
    return rows.select("row_id", F.array_join(N.delete_function_word(F.col("ws"), quarter(F.col("d"), 2)), " ").alias("text"))


@query(
    f"""WITH {_LISTS}, p AS (SELECT row_id, ws, u3 % (len(ws) + 1) AS p, {pick(fixed.FILLERS, 'u2')} AS filler FROM u)
    SELECT row_id, array_to_string(list_concat(list_concat(ws[:p], [filler]), ws[p + 1:]), ' ') AS text FROM p WHERE p > 0
    UNION ALL SELECT row_id, array_to_string(list_concat([filler], ws), ' ') FROM p WHERE p = 0"""
)
def insert_filler(spark, folder):
    rows = documents(spark, folder).select("row_id", tokens("text").alias("ws"), digest(fixed.SEED, "list", F.col("row_id")).alias("d"))
    u = quarter(F.col("d"), 2), quarter(F.col("d"), 3)
    return rows.select("row_id", F.array_join(N.insert_filler(F.col("ws"), *u), " ").alias("text"))


@query(
    f"""WITH src AS (SELECT doc_id AS row_id, text, 'high' AS level FROM documents), {C.token_noise('src')}
    SELECT row_id, noisy AS text FROM noisy_text"""
)
def token_noise(spark, folder):
    return documents(spark, folder).select("row_id", N.token_noise("text", F.lit("high"), "row_id").alias("text"))


@query(
    f"""WITH src AS (SELECT doc_id AS row_id, text, level FROM documents, {C.LEVEL_ROWS}), {C.token_noise('src')}
    SELECT row_id, level AS noise_level, noisy AS text, text_original FROM noisy_text"""
)
def noise_levels(spark, folder):
    return noisy_copies(documents(spark, folder), "row_id").select("row_id", "noise_level", "text", "text_original")


def _char_noise_sql(source: str) -> str:
    cases = []
    for n in (1, 2, 3, 4):
        limits = " ".join(f"WHEN {q(k)} THEN {int(v * n / 4 * (1 << 32))}" for k, v in fixed.CHARACTER_RATES.items())
        cases.append(f"CASE level {limits} END")
    letter = f"substr({q(N.LETTERS)}, (u % {len(N.LETTERS)} + 1)::INT, 1)"
    return f"""c0 AS (SELECT row_id, level, string_split(text, '') AS cs FROM {source} WHERE text <> ''),
      c1 AS (SELECT row_id, level, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS i FROM c0),
      c2 AS (SELECT row_id, level, b, md5(concat_ws('|', '{fixed.SEED}', level, row_id, 'c', b)) AS d
        FROM (SELECT DISTINCT row_id, level, i // 4 AS b FROM c1)),
      c3 AS (SELECT c1.row_id, c1.level, c, i, ('0x' || substr(d, (i % 4) * 8 + 1, 8))::BIGINT AS u
        FROM c1 JOIN c2 ON c1.row_id = c2.row_id AND c1.level = c2.level AND c2.b = i // 4),
      c4 AS (SELECT row_id, level, i, CASE WHEN u >= {cases[3]} THEN c WHEN u < {cases[0]} THEN {letter}
        WHEN u < {cases[1]} THEN c || {letter} WHEN u < {cases[2]} THEN '' ELSE c || ' ' END AS v FROM c3),
      c5 AS (SELECT row_id, level, string_agg(v, '' ORDER BY i) AS text FROM c4 GROUP BY ALL)"""


@query(
    f"""WITH src AS (SELECT doc_id AS row_id, text, level FROM documents, {C.LEVEL_ROWS}), {_char_noise_sql('src')}
    SELECT s.row_id, s.level AS noise_level, coalesce(c5.text, s.text) AS text
    FROM src s LEFT JOIN c5 ON s.row_id = c5.row_id AND s.level = c5.level"""
)
def char_noise(spark, folder):
    levels = F.array(*[F.lit(v) for v in fixed.CHARACTER_RATES])
    copies = documents(spark, folder).select("row_id", "text", F.explode(levels).alias("noise_level"))
    return copies.select("row_id", "noise_level", N.char_noise("text", "noise_level", "row_id").alias("text"))


@query(
    f"""WITH {C.CORPUS}, {{quotas}},
    src AS (SELECT row_id, text, level FROM parts, {C.LEVEL_ROWS} WHERE split = 'test'), {C.token_noise('src')}
    SELECT n.level AS noise_level, p.label, count(*) AS n,
      sum(CASE WHEN n.noisy <> n.text_original THEN 1 ELSE 0 END)::BIGINT AS changed, sum(length(n.noisy))::BIGINT AS n_chars
    FROM noisy_text n JOIN parts p USING (row_id) GROUP BY ALL"""
)
def noisy_test(spark, folder):
    test = split_rows(corpus(spark, folder), "row_id").filter("split = 'test'")
    noisy = noisy_copies(test, "row_id")
    return noisy.groupBy("noise_level", "label").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("text") != F.col("text_original")).alias("changed"),
        F.sum(F.length("text")).alias("n_chars"),
    )
