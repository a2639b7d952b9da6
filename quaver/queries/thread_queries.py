"""Conversations read as threads: turn 0 is the root, then a comment and two replies each."""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import text as X
from quaver.operators import tables as T
from quaver.operators import threads as H
from quaver.queries import query, table
from quaver.queries.common import q

SEP = H.SEP
STOP_WORDS = "the and of to in is it that for on with as by this an be are".split()

PLACED = """turns AS (SELECT conv_id, turn + CASE WHEN conv_id % 7 = 3 THEN 1 ELSE 0 END AS turn, role, text FROM conversations),
  placed AS (SELECT conv_id, turn, role, text,
    CASE WHEN turn = 0 THEN 0 ELSE (turn - 1) // 3 + 1 END AS comment_no,
    CASE WHEN turn = 0 THEN 'root' WHEN (turn - 1) % 3 = 0 THEN 'comment' ELSE 'reply' END AS kind FROM turns),
  prev AS (SELECT *, coalesce(string_agg(CASE WHEN kind = 'reply' THEN ' [SEP] ' || text END, '') OVER (
    PARTITION BY conv_id, comment_no ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS previous FROM placed)"""
CONTEXT = f"""{PLACED}, ctx AS (SELECT p.conv_id, p.turn, p.kind, p.text,
    coalesce(r.text, '') || CASE WHEN p.kind = 'reply' THEN coalesce(c.text, '') || p.previous ELSE '' END AS context
  FROM prev p LEFT JOIN placed r ON r.conv_id = p.conv_id AND r.kind = 'root'
  LEFT JOIN placed c ON c.conv_id = p.conv_id AND c.comment_no = p.comment_no AND c.kind = 'comment')"""


def placed(spark, folder):
    return H.place_turns(conversations(spark, folder), "conv_id", "turn")


def conversations(spark, folder):
    """All turns; in every seventh conversation they are numbered from 1, so that threads without a root are among them."""
    shift = F.when(F.col("conv_id") % 7 == 3, 1).otherwise(0)
    return table(spark, folder, "conversations").withColumn("turn", F.col("turn") + shift)


def contexts(spark, folder):
    return H.flat_context_rows(placed(spark, folder), "conv_id", "turn").select("conv_id", "turn", "kind", "text", "context")


@query(f"WITH {CONTEXT} SELECT * FROM ctx")
def thread_context(spark, folder):
    return contexts(spark, folder)


@query(f"WITH {CONTEXT} SELECT conv_id, turn, part_no::INT AS part_no, part FROM (SELECT conv_id, turn, unnest(range(len(ps))) AS part_no, unnest(ps) AS part FROM (SELECT conv_id, turn, string_split(context, ' [SEP] ') AS ps FROM ctx))")
def context_split(spark, folder):
    rows = contexts(spark, folder).select("conv_id", "turn", H.split_context().alias("parts"))
    return rows.select("conv_id", "turn", F.posexplode("parts").alias("part_no", "part"))


_KEY = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{X.SPACES}]"
_STOP = ", ".join(q(w) for w in STOP_WORDS)


def _keywords(text: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all({text}, {q(_KEY)})), lambda w: w NOT IN ({_STOP}))"


@query(
    f"""WITH {CONTEXT}, p AS (SELECT conv_id, turn, {_keywords('text')} AS mine, string_split(context, ' [SEP] ') AS ps FROM ctx),
    e AS (SELECT conv_id, turn, mine, unnest(range(len(ps))) AS part_no, unnest(ps) AS part FROM p),
    k AS (SELECT conv_id, turn, part_no, mine, {_keywords('part')} AS theirs FROM e),
    o AS (SELECT *, len(list_intersect(mine, theirs)) AS n FROM k),
    w AS (SELECT *, CASE WHEN n = 0 THEN 0.001 ELSE n END::DOUBLE AS weight FROM o)
    SELECT conv_id, turn, part_no::INT AS part_no, weight,
      round(weight / sum(weight) OVER (PARTITION BY conv_id, turn), 6) AS normalised,
      round(CASE WHEN len(mine) * len(theirs) > 0 THEN n / sqrt(len(mine) * len(theirs)) END, 6) AS set_cosine FROM w"""
)
def overlap_weights(spark, folder):
    rows = contexts(spark, folder).withColumn("parts", H.split_context())
    mine = X.keywords("text", STOP_WORDS)
    rows = rows.withColumn("weights", X.context_weights("text", "parts", STOP_WORDS))
    cosines = F.transform("parts", lambda p: X.set_cosine(mine, X.keywords(p, STOP_WORDS)))
    zipped = F.arrays_zip(F.col("weights").alias("weight"), X.normalised("weights").alias("normalised"), cosines.alias("set_cosine"))
    long = rows.select("conv_id", "turn", F.posexplode(zipped).alias("part_no", "z")).select("conv_id", "turn", "part_no", "z.*")
    return long.withColumns({c: F.round(c, 6) for c in ("normalised", "set_cosine")})


# Odd turns carry a label; the others fall back to NONE.
_TAGS = "tags AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'HOF' ELSE 'NONE' END AS label_str FROM conversations WHERE turn % 2 = 1)"
_STRIP = f"regexp_replace(text, {q('^' + X.SPACE_RUN + '|' + X.SPACE_RUN + '$')}, '', 'g')"


def labelled_turns(spark, folder):
    turns = table(spark, folder, "conversations")
    tags = turns.filter("turn % 2 = 1").select(
        "conv_id", "turn", F.when(F.col("role") == "assistant", "HOF").otherwise("NONE").alias("label_str")
    )
    rows = turns.select("conv_id", "turn", X.strip_spaces("text").alias("text")).filter(X.longer_than("text", 3))
    out = H.join_labels(rows, tags, ["conv_id", "turn"])
    return out.withColumn("label", T.binary_label("label_str"))


@query(
    f"""WITH {_TAGS}, t AS (SELECT conv_id, turn, {_STRIP} AS text FROM conversations)
    SELECT t.conv_id, t.turn, t.text, coalesce(g.label_str, 'NONE') AS label_str, (coalesce(g.label_str, 'NONE') = 'HOF')::INT AS label
    FROM t LEFT JOIN tags g ON t.conv_id = g.conv_id AND t.turn = g.turn WHERE length(t.text) > 3"""
)
def thread_flatten(spark, folder):
    return labelled_turns(spark, folder)


@query(
    f"""WITH {_TAGS}, t AS (SELECT conv_id, turn, {_STRIP} AS text FROM conversations)
    SELECT t.conv_id, count(*) AS n, sum((coalesce(g.label_str, 'NONE') = 'HOF')::INT)::BIGINT AS positive,
      round(avg((coalesce(g.label_str, 'NONE') = 'HOF')::INT), 6) AS positive_ratio
    FROM t LEFT JOIN tags g ON t.conv_id = g.conv_id AND t.turn = g.turn WHERE length(t.text) > 3 GROUP BY t.conv_id"""
)
def topic_report(spark, folder):
    report = H.topic_report(labelled_turns(spark, folder), "conv_id")
    return report.withColumn("positive_ratio", F.round("positive_ratio", 6))


HIERARCHY = f"""{PLACED}, hier AS (SELECT p.conv_id, p.turn, coalesce(r.text, '') AS post,
    CASE WHEN p.kind = 'root' THEN '' WHEN p.kind = 'comment' THEN c.text ELSE coalesce(c.text, '') || {{previous}} END AS context,
    CASE WHEN p.kind = 'reply' THEN p.text ELSE '' END AS text
  FROM prev p LEFT JOIN placed r ON r.conv_id = p.conv_id AND r.kind = 'root'
  LEFT JOIN placed c ON c.conv_id = p.conv_id AND c.comment_no = p.comment_no AND c.kind = 'comment')"""


def hierarchy(spark, folder, running):
    rows = H.flat_hierarchical_rows(placed(spark, folder), "conv_id", "turn", running=running)
    return rows.select("conv_id", "turn", "post", "context", "text")


@query(f"WITH {HIERARCHY.format(previous=chr(39) * 2)} SELECT * FROM hier")
def hierarchical_rows(spark, folder):
    return hierarchy(spark, folder, False)


@query(f"WITH {HIERARCHY.format(previous='p.previous')} SELECT * FROM hier")
def hierarchical_rows_running(spark, folder):
    return hierarchy(spark, folder, True)


@query(
    f"""WITH {HIERARCHY.format(previous=chr(39) * 2)},
    s AS (SELECT *, CASE WHEN post <> '' AND context = '' AND text = '' THEN 'post' WHEN post <> '' AND context <> '' AND text = ''
      THEN 'post_context' WHEN post <> '' AND context <> '' AND text <> '' THEN 'post_context_text' END AS shape FROM hier)
    SELECT shape, count(*) AS n, sum(length(post) + length(context) + length(text))::BIGINT AS n_chars FROM s WHERE shape IS NOT NULL GROUP BY shape"""
)
def row_shape(spark, folder):
    rows = hierarchy(spark, folder, False).withColumn("shape", T.row_shape()).filter(F.col("shape").isNotNull())
    return rows.groupBy("shape").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("post") + F.length("context") + F.length("text")).alias("n_chars")
    )
