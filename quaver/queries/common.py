"""Views of the given tables in this library's shapes, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.functions import fixed
from quaver.functions.text import SPACE_RUN
from quaver.queries import table


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as unlabelled text rows."""
    d = table(spark, folder, "documents")
    return d.select(F.col("doc_id").alias("row_id"), "text", "source", F.col("lang").alias("lang_pair"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents: toxic is the label, quality stands in for a prediction."""
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("row_id"), F.col("toxic").alias("label"), F.col("quality").alias("prediction")
    )
    return documents(spark, folder).join(labels, "row_id")


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


CORPUS = """corpus AS (
  SELECT d.doc_id AS row_id, d.text, d.source, d.lang AS lang_pair, l.toxic AS label, l.quality AS prediction
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

DOCS = "docs AS (SELECT doc_id AS row_id, text, source, lang AS lang_pair FROM documents)"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {q(SPACE_RUN)}), lambda w: w <> '')"


def squeeze(text: str) -> str:
    return f"trim(regexp_replace({text}, {q(SPACE_RUN)}, ' ', 'g'))"


def draw(digest: str, k: int) -> str:
    return f"('0x' || substr({digest}, {8 * k + 1}, 8))::BIGINT"


def pick(values, number: str) -> str:
    values = list(values)
    return f"[{', '.join(q(v) for v in values)}][({number} % {len(values)} + 1)::INT]"


def swap_first(word: str, old: str, new: str) -> str:
    at = f"instr({word}, {q(old)})"
    return f"substr({word}, 1, {at} - 1) || {new} || substr({word}, {at} + {len(old)})"


def char_sub(w: str, choice: str, position: str) -> str:
    low = f"lower({w})"
    cases = " ".join(
        f"WHEN instr({low}, {q(old)}) > 0 THEN {swap_first(low, old, pick(new, choice))}"
        for old, *new in fixed.CHARACTER_CONFUSIONS
    )
    at = f"({position} % length({w}))"
    other = f"substr({w}, 1, {at}) || {pick(fixed.OVERWRITE_LETTERS, choice)} || substr({w}, {at} + 2)"
    return f"CASE {cases} WHEN length({w}) > 2 THEN {other} ELSE {w} END"


def split_word(w: str, position: str) -> str:
    at = f"({position} % (length({w}) - 3) + 2)"
    return f"CASE WHEN length({w}) > 4 THEN substr({w}, 1, {at}) || ' ' || substr({w}, {at} + 1) ELSE {w} END"


def variant(w: str, choice: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {pick(v, choice)}" for k, v in fixed.SPELLING_VARIANTS.items())
    return f"CASE lower({w}) {cases} ELSE {w} END"


def schwa(w: str) -> str:
    inner = f"substr({w}, 2, length({w}) - 2)"
    at = f"(instr({inner}, 'a') + 1)"
    return (
        f"CASE WHEN length({w}) > 4 AND instr({inner}, 'a') > 0 "
        f"THEN substr({w}, 1, {at} - 1) || substr({w}, {at} + 1) ELSE {w} END"
    )


def in_words(w: str) -> str:
    return f"lower({w}) IN ({', '.join(q(x) for x in fixed.FUNCTION_WORDS)})"


def token_table(source: str, level: str = "level", seed: int = fixed.SEED) -> str:
    """CTEs ``tok`` (one row per token with its digest) of a table (row_id, text, level)."""
    return f"""tok0 AS (SELECT row_id, {level} AS level, {words('text')} AS ws FROM {source}),
  tok1 AS (SELECT row_id, level, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM tok0),
  tok AS (SELECT *, md5(concat_ws('|', '{seed}', level, row_id, i)) AS d FROM tok1)"""


def token_noise(source: str, out: str = "noisy_text", seed: int = fixed.SEED) -> str:
    """CTEs ending in ``out`` (row_id, level, noisy) for a table (row_id, text, level)."""
    limit, limits = 0.0, []
    for share in fixed.TOKEN_ERROR_MIX.values():
        limit += share
        limits.append(int(round(limit, 6) * (1 << 32)))
    hit = " ".join(f"WHEN {q(k)} THEN {int(v * (1 << 32))}" for k, v in fixed.TOKEN_RATES.items())
    u = [draw("d", k) for k in range(4)]
    return f"""{token_table(source, seed=seed)},
  tok2 AS (SELECT row_id, level, i, w, {u[0]} AS u0, {u[1]} AS u1, {u[2]} AS u2, {u[3]} AS u3 FROM tok),
  tok3 AS (SELECT row_id, level, i, CASE
      WHEN u0 >= CASE level {hit} ELSE 0 END THEN w
      WHEN u1 < {limits[0]} THEN {char_sub('w', 'u2', 'u3')}
      WHEN u1 < {limits[1]} THEN {split_word('w', 'u3')}
      WHEN u1 < {limits[2]} THEN CASE WHEN {in_words('w')} THEN NULL ELSE w END
      WHEN u1 < {limits[3]} THEN w || ' ' || {pick(fixed.FILLERS, 'u2')}
      ELSE {variant('w', 'u2')} END AS v FROM tok2),
  {out}0 AS (SELECT row_id, level, string_agg(v, ' ' ORDER BY i) AS noisy FROM tok3 GROUP BY ALL),
  {out} AS (SELECT s.row_id, s.level, s.text AS text_original,
      CASE WHEN len({words('s.text')}) = 0 THEN s.text ELSE coalesce(n.noisy, '') END AS noisy
    FROM {source} s LEFT JOIN {out}0 n ON s.row_id = n.row_id AND s.level = n.level)"""


LEVEL_ROWS = "(VALUES ('low'), ('medium'), ('high')) lv(level)"
CODE = "CASE {0} WHEN 'clean' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END"
