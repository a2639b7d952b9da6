"""Clean-noisy pairs, Jaro-Winkler and phonetic weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import similarity as S
from quaver.functions.noise import token_noise
from quaver.functions.text import tokens
from quaver.operators import pairing as P
from quaver.operators.splits import noise_levels, stratified_split
from quaver.operators.tables import level_code
from quaver.queries import common as C
from quaver.queries import query
from quaver.queries.common import corpus, documents, words
from quaver.queries.split_queries import AUGMENTED

# The SQL engine compares bytes; every accented letter of the tables becomes one.
_ACCENTS = "éóèñüçäöêßí"
_BYTES = " || ".join(f"chr({14 + i})" for i in range(len(_ACCENTS)))


def _plain(text: str) -> str:
    return f"translate(lower({text}), '{_ACCENTS}', {_BYTES})"


def similarity_sql(a: str, b: str) -> str:
    """Mean Jaro-Winkler by position of two word lists."""
    return f"""CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 1.0
      ELSE coalesce(list_sum(list_transform(range(1, least(len({a}), len({b})) + 1),
        lambda i: jaro_winkler_similarity({a}[i], {b}[i]))), 0) / greatest(len({a}), len({b})) END"""


def _phi_sql(source: str, keys: str, clean: str = "clean_text", noisy: str = "noisy_text") -> str:
    return f"""SELECT {keys}, round(1 - ({similarity_sql('a', 'b')}), 6) AS phi
      FROM (SELECT *, {words(_plain(clean))} AS a, {words(_plain(noisy))} AS b FROM {source})"""


_HIGH = f"src AS (SELECT doc_id AS row_id, text, 'high' AS level FROM documents), {C.token_noise('src')}"


@query(
    f"""WITH {_HIGH}, w AS (SELECT row_id, {words(_plain('text_original'))} AS a, {words(_plain('noisy'))} AS b FROM noisy_text),
    p AS (SELECT unnest(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: {{'x': a[i], 'y': b[i]}})) AS p FROM w)
    SELECT length(p.x)::INT AS x_length, length(p.y)::INT AS y_length, count(*) AS n,
      round(avg(jaro_winkler_similarity(p.x, p.y)), 6) AS mean_similarity FROM p WHERE p.x <> p.y GROUP BY ALL"""
)
def jaro_winkler(spark, folder):
    """Similarity of every changed word pair, summed up by word lengths."""
    noisy = documents(spark, folder).withColumn("noisy", token_noise("text", F.lit("high"), "row_id"))
    both = F.arrays_zip(tokens(F.lower("text")).alias("x"), tokens(F.lower("noisy")).alias("y"))
    changed = F.filter(both, lambda p: p["x"] != p["y"])
    # Nearly all pairs differ once words are out of step, so pairs are scored where they are and only sums move.
    scored = noisy.select(F.inline(changed)).withColumn("s", S.jaro_winkler("x", "y"))
    return scored.groupBy(F.length("x").alias("x_length"), F.length("y").alias("y_length")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("s"), 6).alias("mean_similarity")
    )


@query(
    f"""WITH src AS (SELECT doc_id AS row_id, text, level FROM documents, {C.LEVEL_ROWS}), {C.token_noise('src')}
    {_phi_sql('noisy_text', 'row_id, level AS noise_level', 'text_original', 'noisy')}"""
)
def phi(spark, folder):
    copies = noise_levels(documents(spark, folder), "row_id")
    return copies.select("row_id", "noise_level", F.round(S.phi("text_original", "text"), 6).alias("phi"))


def train_and_source(spark, folder):
    """Clean training rows, and the rows whose noisy copies go with them."""
    rows = corpus(spark, folder).select("row_id", "text", "label")
    return stratified_split(rows, "row_id").filter("split = 'train'").drop("split"), rows


def anchors(spark, folder):
    return P.late_anchor_pairs(*train_and_source(spark, folder), "row_id")


def in_order(pairs, code):
    """Rows named by their place in the augmented table."""
    return pairs.select((F.col("row_id") * 4 + code).alias("ordinal"), "*").drop("row_id")


_TRAIN = f"{AUGMENTED}, tr AS (SELECT *, row_id * 4 + {C.CODE.format('noise_level')} AS ordinal FROM train)"
_PARTNER = """SELECT text_original, text AS partner, {code} AS code FROM (SELECT *, row_number() OVER (
  PARTITION BY text_original ORDER BY ordinal {way}) AS k FROM tr WHERE text_original IS NOT NULL {where}) WHERE k = 1"""
ANCHORS = f"""{_TRAIN}, partner AS ({_PARTNER.format(code=C.CODE.format('noise_level'), way='', where='')}),
  anchors AS (
    SELECT c.ordinal, c.noise_level, c.text AS clean_text, coalesce(p.partner, c.text) AS noisy_text, c.label,
      coalesce(p.code, 0) AS noise_id, true AS ce_mask_clean, false AS ce_mask_noisy, p.partner IS NOT NULL AS has_pair
    FROM tr c LEFT JOIN partner p ON c.text = p.text_original WHERE c.noise_level = 'clean'
    UNION ALL
    SELECT n.ordinal, n.noise_level, CASE WHEN k.text IS NOT NULL THEN n.text_original ELSE n.text END, n.text, n.label,
      {C.CODE.format('n.noise_level')}, false, true, k.text IS NOT NULL
    FROM tr n LEFT JOIN (SELECT DISTINCT text FROM tr WHERE noise_level = 'clean') k ON n.text_original = k.text
    WHERE n.noise_level <> 'clean')"""


@query(f"WITH {ANCHORS} SELECT * FROM anchors")
def pair_anchor(spark, folder):
    return in_order(anchors(spark, folder), level_code())


@query(
    f"""WITH {_TRAIN}, partner AS ({_PARTNER.format(code=C.CODE.format('noise_level'), way='DESC', where="AND noise_level = 'medium'")}),
    first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY ordinal) AS k FROM tr WHERE noise_level = 'clean') WHERE k = 1),
    pairs AS (SELECT c.ordinal, c.text AS clean_text, coalesce(p.partner, c.text) AS noisy_text, c.label, coalesce(p.code, 0) AS noise_id,
      p.partner IS NOT NULL AS has_pair FROM first c LEFT JOIN partner p ON c.text = p.text_original)
    {_phi_sql('pairs', 'ordinal, clean_text, noisy_text, label, noise_id, has_pair')}"""
)
def pair_clean_only(spark, folder):
    pairs = P.late_clean_only_pairs(*train_and_source(spark, folder), "row_id", "medium")
    return in_order(pairs, F.lit(0)).withColumn("phi", F.round("phi", 6))


@query(
    f"""WITH src AS (SELECT doc_id AS row_id, text, level FROM documents, {C.LEVEL_ROWS}), {C.token_noise('src')},
    {C.CORPUS}
    SELECT c.text AS text_original, c.text, n.noisy AS text_noisy, c.label, n.level AS noise_level_noisy, count(*) AS n_pairs
    FROM corpus c JOIN noisy_text n ON c.text = n.text_original GROUP BY ALL"""
)
def pair_inner(spark, folder):
    clean = corpus(spark, folder).withColumn("text_original", F.col("text"))
    return P.pair_inner(clean, noise_levels(documents(spark, folder), "row_id"))


@query(
    f"""WITH {ANCHORS} SELECT sum(has_pair::INT)::BIGINT AS n_pair, sum((NOT has_pair)::INT)::BIGINT AS n_solo, count(*) AS n_total,
    count(DISTINCT CASE WHEN has_pair THEN noise_id END) AS n_levels,
    count(DISTINCT CASE WHEN has_pair THEN noise_id END) >= 2 AS has_diverse_noise FROM anchors"""
)
def pair_stats(spark, folder):
    return P.pair_statistics(anchors(spark, folder))


_WEIGHED = f"w AS ({_phi_sql('anchors', 'noise_level, has_pair')})"


@query(
    f"""WITH {ANCHORS}, {_WEIGHED} SELECT noise_level, count(*) AS n, round(avg(phi), 5) AS mean_phi
    FROM w WHERE has_pair GROUP BY noise_level"""
)
def phi_by_level(spark, folder):
    pairs = P.with_phi(anchors(spark, folder).filter("has_pair")).withColumn("phi", F.round("phi", 6))
    return P.phi_by_level(pairs, "noise_level").withColumn("mean_phi", F.round("mean_phi", 5))


@query(
    f"""WITH {ANCHORS}, {_WEIGHED} SELECT noise_level, least(floor(phi * 20)::BIGINT, 19) AS bin, count(*) AS n
    FROM w WHERE has_pair GROUP BY ALL"""
)
def phi_histogram(spark, folder):
    pairs = P.with_phi(anchors(spark, folder).filter("has_pair")).withColumn("phi", F.round("phi", 6))
    return P.phi_histogram(pairs, "noise_level")
