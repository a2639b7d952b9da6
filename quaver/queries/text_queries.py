"""Clean-up, junk, repair and encoding over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import fixed
from quaver.functions import text as X
from quaver.operators.tfidf import MAX_TERMS, term_counts, tfidf as weigh_terms, vocabulary
from quaver.queries import query, table
from quaver.queries.common import documents, q, squeeze, words

def _without(pattern: str, text: str) -> str:
    return f"regexp_replace({text}, {q(pattern)}, ' ', 'g')"


def _no_punctuation(text: str) -> str:
    return f"translate({text}, {q(fixed.PUNCTUATION)}, '')"


def clean_sql(text: str = "text") -> str:
    bare = _no_punctuation(_without(X.URL, _without(X.MENTION, _without(X.EMOJI, text))))
    return f"lower({squeeze(bare)})"


@query(f"SELECT doc_id AS row_id, {clean_sql()} AS clean_text FROM documents")
def clean_row(spark, folder):
    return documents(spark, folder).select("row_id", X.clean_text("text").alias("clean_text"))


# The tables hold no emoji, so some are put in: a run, a joined sign, a tone, a flag, a keycap.
SIGNS = "a😀😀b 👨‍👩‍👧 👍🏽 🇮🇳 1️⃣"
_SMILING = "CASE WHEN {1} % 2 = 0 THEN {0} || ' " + SIGNS + "' ELSE {0} END"


def smiling(text, key):
    return F.when(F.col(key) % 2 == 0, F.concat(F.col(text), F.lit(" " + SIGNS))).otherwise(F.col(text))


@query(
    f"""SELECT page_id, regexp_replace(html, {q(X.URL)}, ' ', 'g') AS no_url,
    regexp_replace(html, {q(X.MENTION)}, ' ', 'g') AS no_mention,
    regexp_replace({_SMILING.format('html', 'page_id')}, {q(X.EMOJI)}, ' ', 'g') AS no_emoji, {_no_punctuation('html')} AS no_punctuation,
    {squeeze('html')} AS squeezed FROM pages"""
)
def remove_parts(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id",
        X.remove_url("html").alias("no_url"),
        X.remove_mention("html").alias("no_mention"),
        X.remove_emoji(smiling("html", "page_id")).alias("no_emoji"),
        X.remove_punctuation("html").alias("no_punctuation"),
        X.squeeze("html").alias("squeezed"),
    )


@query(f"SELECT doc_id AS row_id, regexp_replace(text, {q(X.HASHTAG)}, ' ', 'g') AS text FROM documents")
def remove_hashtag(spark, folder):
    return documents(spark, folder).select("row_id", X.remove_hashtag("text").alias("text"))


BAD_WORDS = ["worthless", "hate", "stupid"]


@query(
    f"""WITH s AS (SELECT doc_id AS row_id, {_SMILING.format('text', 'doc_id')} AS text FROM documents),
    t AS (SELECT row_id, text, {words('text')} AS ws, len(regexp_extract_all(text, '\\p{{Lu}}')) AS capitals FROM s)
    SELECT row_id, len(ws) AS num_words, length(text) AS total_length, len(list_distinct(ws)) AS num_unique_words,
      round(CASE WHEN len(ws) > 0 THEN len(list_distinct(ws)) / len(ws) ELSE 0.0 END, 6) AS words_vs_unique,
      capitals, round(CASE WHEN length(text) > 0 THEN capitals / length(text) ELSE 0.0 END, 6) AS caps_vs_length,
      len(regexp_extract_all(text, {q(X.EMOJI)})) AS emoji, len(regexp_extract_all(text, {q(X.URL)})) AS num_urls,
      len(regexp_extract_all(text, '!')) AS exclamations, len(regexp_extract_all(text, '\\?')) AS question_marks,
      len(list_filter(ws, lambda w: lower(w) IN ({', '.join(map(q, BAD_WORDS))}))) AS bad_word_count FROM t"""
)
def lexical_features(spark, folder):
    features = X.lexical_features("text", BAD_WORDS)
    shares = {"words_vs_unique", "caps_vs_length"}
    return documents(spark, folder).withColumn("text", smiling("text", "row_id")).select(
        "row_id",
        *[(F.round(c, 6) if n in shares else c.cast("bigint")).alias(n) for n, c in features.items()],
    )


_STRIPPED = f"replace(text, {q(X.ZERO_WIDTH)}, '')"
_JUNK = " ".join(f"WHEN regexp_matches({_STRIPPED}, {q(p)}) THEN {q(n)}" for n, p in X.JUNK)


@query(f"SELECT doc_id AS row_id, CASE {_JUNK} END AS junk_class, {_STRIPPED} AS text FROM documents")
def junk_classes(spark, folder):
    return documents(spark, folder).select(
        "row_id", X.junk_class("text").alias("junk_class"), X.strip_zero_width("text").alias("text")
    )


@query(
    f"""SELECT coalesce(junk_class, 'kept') AS junk_class, count(*) AS n
    FROM (SELECT CASE {_JUNK} END AS junk_class FROM (
      SELECT text FROM documents UNION ALL SELECT text FROM conversations UNION ALL SELECT l_orderkey::VARCHAR FROM lineitem))
    GROUP BY 1"""
)
def junk_counts(spark, folder):
    texts = table(spark, folder, "documents").select("text")
    texts = texts.unionByName(table(spark, folder, "conversations").select("text"))
    texts = texts.unionByName(table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("text")))
    kind = F.coalesce(X.junk_class("text"), F.lit("kept"))
    return texts.groupBy(kind.alias("junk_class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH c AS (SELECT doc_id AS row_id, text, unnest(string_split(text, '')) AS ch,
      generate_subscripts(string_split(text, ''), 1) AS k FROM documents)
    SELECT row_id, (k - 1)::INT AS "position", ch AS "character",
      substr(text, greatest(k - 5, 1), k + 9 - greatest(k - 5, 1) + 1) AS context
    FROM c WHERE unicode(ch) BETWEEN 128 AND 255"""
)
def mojibake_scan(spark, folder):
    characters = documents(spark, folder).select(
        "row_id", "text", F.posexplode(F.split("text", "")).alias("position", "character")
    )
    start = F.greatest(F.col("position") - 4, F.lit(1))
    return characters.filter(F.col("character").between("\u0080", "ÿ")).select(
        "row_id", "position", "character",
        F.substring("text", start, F.col("position") + 10 - start + 1).alias("context"),
    )


def _repair_sql(text: str) -> str:
    for bad, good in fixed.MOJIBAKE:
        text = f"replace({text}, {q(bad)}, {q(good)})"
    return text


# Double encoding is put in by the same rule on both sides, then repaired.
_BROKEN_SQL = f"replace(replace(text, '. ', ' {fixed.MOJIBAKE[0][0]} '), ', ', ' {fixed.MOJIBAKE[1][0]}� ')"


@query(
    f"""WITH b AS (SELECT doc_id AS row_id, {_BROKEN_SQL} AS broken FROM documents)
    SELECT row_id, {_repair_sql('broken')} AS repaired,
      len(regexp_extract_all(broken, {q('|'.join(b for b, _ in fixed.MOJIBAKE))})) AS replaced,
      regexp_matches({_repair_sql('broken')}, '[{fixed.MOJIBAKE_STARTS}]') AS still_bad FROM b"""
)
def mojibake_repair(spark, folder):
    broken = F.replace(F.col("text"), F.lit(". "), F.lit(f" {fixed.MOJIBAKE[0][0]} "))
    broken = F.replace(broken, F.lit(", "), F.lit(f" {fixed.MOJIBAKE[1][0]}� "))
    rows = documents(spark, folder).select("row_id", broken.alias("broken"))
    rows = rows.withColumn("repaired", X.repair_mojibake("broken"))
    return rows.select(
        "row_id", "repaired", X.count_mojibake("broken").cast("bigint").alias("replaced"),
        X.has_mojibake("repaired").alias("still_bad"),
    )


_N = fixed.ENCODER_LENGTH
_PAD = len(fixed.ENCODER_ALPHABET)
_IDS = (
    f"list_transform(list_filter(string_split(substr(text, 1, {_N}), ''), lambda c: c <> ''), lambda c: "
    f"CASE WHEN instr({q(fixed.ENCODER_ALPHABET)}, c) > 0 THEN instr({q(fixed.ENCODER_ALPHABET)}, c) - 1 ELSE {_PAD + 1} END)"
)


@query(
    f"""WITH t AS (SELECT doc_id AS row_id, {_IDS} AS ids FROM documents)
    SELECT row_id, array_to_string(list_concat(ids, list_transform(range({_N} - len(ids)), lambda i: {_PAD})), ',') AS char_ids
    FROM t"""
)
def char_ids(spark, folder):
    return documents(spark, folder).select("row_id", F.array_join(X.character_ids("text"), ",").alias("char_ids"))


@query(
    f"""WITH t AS (SELECT doc_id AS row_id, list_transform({words('text')}, lambda w: length(w)) AS ids FROM documents),
    p AS (SELECT row_id, list_concat(ids[:64], list_transform(range(greatest(64 - len(ids), 0)), lambda i: 0)) AS ids FROM t)
    SELECT row_id, array_to_string(ids, ',') AS ids,
      array_to_string(list_transform(ids, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END), ',') AS mask FROM p"""
)
def pad_mask(spark, folder):
    lengths = F.transform(X.tokens("text"), lambda w: F.length(w))
    rows = documents(spark, folder).select("row_id", X.pad_ids(lengths, 64).alias("ids"))
    return rows.select("row_id", F.array_join("ids", ",").alias("ids"), F.array_join(X.attention_mask("ids"), ",").alias("mask"))


_GRAMS = f"""w AS (SELECT row_id, ' ' || unnest({words('lower(text)')}) || ' ' AS p FROM docs),
  n AS (SELECT row_id, p, unnest([2, 3, 4]) AS n FROM w),
  g AS (SELECT row_id, p, n, unnest(range(1, length(p) - n + 2)) AS i FROM n WHERE length(p) >= n),
  tf AS (SELECT row_id, substr(p, i, n) AS term, count(*) AS tf FROM g GROUP BY ALL),
  vocab AS (SELECT term, sum(tf)::BIGINT AS corpus_tf, count(*) AS df FROM tf GROUP BY term
    ORDER BY corpus_tf DESC, term LIMIT {MAX_TERMS})"""
_ALL_DOCS = "docs AS (SELECT doc_id AS row_id, text FROM documents)"


@query(f"WITH {_ALL_DOCS}, {_GRAMS} SELECT term, sum(tf)::BIGINT AS corpus_tf, count(*) AS df FROM tf GROUP BY term")
def char_ngrams_df(spark, folder):
    counts = term_counts(documents(spark, folder), "row_id")
    return counts.groupBy("term").agg(F.sum("tf").alias("corpus_tf"), F.count(F.lit(1)).alias("df"))


@query(
    f"""WITH {_ALL_DOCS}, {_GRAMS}, nd AS (SELECT count(*) AS n FROM docs),
    r AS (SELECT row_id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w
      FROM tf JOIN vocab USING (term), nd)
    SELECT row_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS weight FROM r"""
)
def tfidf(spark, folder):
    weights = weigh_terms(documents(spark, folder), "row_id")
    return weights.select("row_id", "term", F.round("weight", 6).alias("weight"))


@query(f"WITH {_ALL_DOCS}, {_GRAMS} SELECT * FROM vocab")
def topk_vocab(spark, folder):
    return vocabulary(term_counts(documents(spark, folder), "row_id"))


@query(
    f"""SELECT doc_id AS row_id, trim(text) AS text, length(text) AS n_chars FROM documents
    WHERE length(text) > 5 AND length(regexp_replace(text, {q('^' + X.SPACE_RUN + '|' + X.SPACE_RUN + '$')}, '', 'g')) > 3"""
)
def min_length(spark, folder):
    rows = documents(spark, folder).filter(X.longer_than("text", 5) & X.longer_than(X.strip_spaces("text"), 3))
    return rows.select("row_id", F.btrim("text").alias("text"), F.length("text").cast("bigint").alias("n_chars"))


@query(
    """SELECT event_id, replace(replace(trim(list_text, '[]'), '''', ''), ',', '') AS text
    FROM (SELECT event_id, '[''' || event_type || ''', ''' || user_id || ''']' AS list_text FROM events)"""
)
def list_literals(spark, folder):
    literal = F.concat(F.lit("['"), "event_type", F.lit("', '"), "user_id", F.lit("']"))
    return table(spark, folder, "events").select("event_id", X.list_literal_text(literal).alias("text"))


# Soundex from its rules: letters to digits, h and w silent, runs of a digit once, zeros out, three digits.
_BIG = "translate({0}, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
_DIGITS = "translate(regexp_replace({0}, '[^A-Z]', 'A', 'g'), 'AEIOUYBFPVCGJKQSXZDTLMNRHW', '00000011112222222233455677')"
_ONCE = "{0}"
for _d in "123456":
    _ONCE = f"regexp_replace({_ONCE}, '{_d}+', '{_d}', 'g')"
_SOUNDEX = f"""c AS (SELECT word, n, {_BIG.format('word')} AS u FROM d),
  k AS (SELECT word, n, u, {_DIGITS.format('u[1:1]')} || replace({_DIGITS.format('u[2:]')}, '7', '') AS ds FROM c),
  x AS (SELECT word, n, CASE WHEN NOT regexp_full_match(word, '\\p{{L}}+') THEN '0000' WHEN NOT regexp_matches(u, '^[A-Z]') THEN word
    ELSE u[1:1] || rpad(replace(({_ONCE.format('ds')})[2:], '0', '')[1:3], 3, '0') END AS code FROM k)"""


@query(
    f"""WITH d AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest({words('text')}) AS w FROM documents) GROUP BY w), {_SOUNDEX}
    SELECT word, n, round((('0x' || md5(code)[1:8])::BIGINT % 1000) / 1000, 6) AS sound_bucket, round(length(word) / 20, 6) AS scaled_length,
      round(len(list_distinct(string_split(word, ''))) / length(word), 6) AS letter_variety FROM x"""
)
def soundex_features(spark, folder):
    """Token features of every distinct word."""
    found = documents(spark, folder).select(F.explode(X.tokens("text")).alias("word"))
    counted = found.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("word", "n", *[F.round(c, 6).alias(k) for k, c in X.token_features("word").items()])
