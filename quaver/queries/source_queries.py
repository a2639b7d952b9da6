"""Adapters, routing, parsers and nested threads over the given tables in the layouts of the sources.

Each input is a projection of whole tables; the projection is spelled once, in a form that both
dialects read, and the expected rows are worked out in SQL on their own.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import text as X
from quaver.operators import embeddings as E
from quaver.operators import tables as T
from quaver.operators import threads as H
from quaver.queries import query, table
from quaver.queries.common import q
from quaver.queries.thread_queries import SEP
from quaver.queries.vector_queries import shown, shown_sql
from quaver.sources import adapters as A
from quaver.sources import readers as R


def chosen(key: str, *values: str | None) -> str:
    """One of the values by row number, null where the value is None."""
    cases = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values) if v is not None)
    return f"CASE {key} % {len(values)} {cases} END"


# name: (adapter, table, columns of the source layout, label in SQL, source, language pair, least length)
SOURCES = {
    "hasoc": (A.adapt_hasoc, "documents", {"tweet_text": "text", "task_1": chosen("doc_id", " hof ", "NONE", "off", "1", None)},
              "trim(upper(coalesce(task_1, ''))) IN ('HOF', '1', 'HATE', 'OFF', 'OFFENSIVE', 'TRUE')", "hasoc2021", "hi-en", 6),
    "davidson": (A.adapt_davidson, "documents", {"tweet": "text", "class": chosen("doc_id", "0", "1", "2", "oops", "1.0")},
                 "class IN ('0', '1', '1.0')", "davidson", "en", 0),
    "semeval": (A.adapt_semeval, "documents", {"uid": "doc_id", "text": "text"}, "false", "semeval2020", "hi-en", 6),
    "hindi_offensive": (A.adapt_hindi_offensive, "documents", {"sentence": "text", "category": chosen("doc_id", "hate", "not", "true", "0")},
                        "category IN ('hate', 'true')", "hindi_offensive", "hi-en", 0),
    "olid": (A.adapt_olid, "documents", {"id": "doc_id", "tweet": "text", "subtask_a": chosen("doc_id", "OFF", "NOT", "off")},
             "subtask_a IN ('OFF', 'off')", "olid", "en", 0),
    "hateval": (A.adapt_hateval, "documents", {"text": "text", "HS": chosen("doc_id", "1", "0", "True", "TRUE", "hate")},
                "HS IN ('1', 'True', 'hate')", "hateval2019", "en", 0),
    "hatexplain": (A.adapt_hatexplain, "documents", {"post_tokens": "concat('[''', source, ''', ''', lang, ''']')", "label": chosen("doc_id", "hatespeech", "Offensive", "normal")},
                   "lower(label) IN ('hatespeech', 'offensive')", "hatexplain", "en", 0),
    "tweeteval": (A.adapt_tweeteval_hate, "documents", {"text": "text", "label": chosen("doc_id", "1", "0")}, "label = '1'", "tweeteval_hate", "en", 0),
}
_TEXT = {"hatexplain": "replace(replace(replace(replace(post_tokens, '[', ''), ']', ''), '''', ''), ',', '')"}


def layout(spark, folder, name):
    _, source, columns, *_ = SOURCES[name]
    return table(spark, folder, source).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def _expected(name: str) -> str:
    _, source, columns, label, tag, pair, least = SOURCES[name]
    text = _TEXT.get(name) or next(c for c in columns if columns[c] == "text")
    rows = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    keep = f"{text} IS NOT NULL" + (f" AND length({text}) >= {least}" if least else "")
    return f"SELECT {text} AS text, ({label})::INT AS label, '{tag}' AS source, '{pair}' AS lang_pair FROM (SELECT {rows} FROM {source}) WHERE {keep}"


def _adapter_query(name: str) -> None:
    def run(spark, folder):
        return SOURCES[name][0](layout(spark, folder, name))

    run.__name__ = f"adapt_{name}"
    query(_expected(name))(run)


for _name in SOURCES:
    _adapter_query(_name)


# Several scores per item, some of which are no numbers; the first text is the least.
_ANNOTATED = f"doc_id - doc_id % 3 AS comment_id, text, {chosen('doc_id', '0.9', '-1', 'oops', '0.4', '1.5', None, '0.5')} AS hate_speech_score"
_UCB = f"""SELECT text, coalesce((score >= 0.5)::INT, 0) AS label, 'ucb_measuring_hate' AS source, 'en' AS lang_pair FROM (
  SELECT comment_id, min(text) AS text, avg(try_cast(hate_speech_score AS DOUBLE)) AS score FROM (SELECT {_ANNOTATED} FROM documents) GROUP BY comment_id) WHERE text IS NOT NULL"""


@query(_UCB)
def adapt_ucb_hate(spark, folder):
    return A.adapt_ucb_hate(table(spark, folder, "documents").selectExpr(*_split_list(_ANNOTATED)))


def _split_list(columns: str) -> list[str]:
    """Parts of a select list whose commas inside CASE have been left out by design."""
    return [c.strip() for c in columns.split(", ")]


_ROUTED = {"a_davidson.csv": "davidson", "b_olid_train.csv": "olid", "c_hasoc.csv": "hasoc"}


@query(
    "SELECT priority AS source_priority, source, label, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM ("
    + " UNION ALL ".join(f"SELECT {i}::INT AS priority, * FROM ({_expected(n)})" for i, n in enumerate(_ROUTED.values()))
    + ") GROUP BY ALL"
)
def route_and_stack(spark, folder):
    """Routing by file name: an unknown name is ignored, a table that doesn't fit is skipped."""
    tables = {f: layout(spark, folder, n) for f, n in _ROUTED.items()}
    tables |= {"other.csv": table(spark, folder, "labels"), "z_hateval.csv": table(spark, folder, "labels").select("doc_id")}
    stacked = A.adapt_all(tables)
    return stacked.groupBy("source_priority", "source", "label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


# Tagged blocks: a line before the first block, a block without sentiment, a tokenless block, a token without tag.
_TAGGED = r"""concat('lost Eng\nmeta ', conv_id, '.', turn, CASE WHEN turn % 2 = 0 THEN ' Positive' ELSE '' END, '\n', role, ' Eng\nbhasha HIN\nalone\n\nmeta empty neutral\n')"""
_TAGGED_ROWS = """SELECT conv_id || '.' || turn AS uid, role || ' bhasha alone' AS text, CASE WHEN turn % 2 = 0 THEN 'positive' END AS sentiment,
  'Eng HIN O' AS lang_ids, round(1 / 3, 6) AS hindi_ratio, conv_id FROM conversations"""


def tagged(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", F.expr(_TAGGED).alias("file"))
    return R.parse_tagged_texts(rows, "file").drop("tokens", "langs").withColumn("hindi_ratio", F.round("hindi_ratio", 6))


@query(_TAGGED_ROWS)
def parse_blocks(spark, folder):
    return tagged(spark, folder)


@query(f"SELECT text, 0 AS label, 'semeval2020' AS source, 'hi-en' AS lang_pair FROM ({_TAGGED_ROWS})")
def adapt_blocks(spark, folder):
    return A.adapt_tagged_blocks(tagged(spark, folder))


@query(f"SELECT t.* EXCLUDE (sentiment), CASE WHEN t.conv_id % 2 = 0 THEN 'neg' END AS sentiment FROM ({_TAGGED_ROWS}) t")
def blocks_with_labels(spark, folder):
    tweets = tagged(spark, folder)
    labels = tweets.where("conv_id % 2 = 0").select("uid", F.lit("neg").alias("sentiment"))
    return R.attach_test_labels(tweets, labels)


# Result records in the three spellings.
_RECORD = """CASE doc_id % 3 WHEN 0 THEN 'clean' END AS noise_level, CASE doc_id % 3 WHEN 1 THEN 'low' END AS noise,
  CASE doc_id % 3 WHEN 2 THEN 'high' END AS test_noise, CASE WHEN doc_id % 3 <> 1 THEN quality * 0.5 END AS test_f1_macro,
  CASE WHEN doc_id % 3 = 1 THEN toxic * 0.25 END AS test_f1, CASE WHEN doc_id % 3 = 0 THEN 0.5 END AS val_f1_macro,
  CASE WHEN doc_id % 3 = 1 THEN 0.25 END AS val_f1, CASE WHEN doc_id % 3 = 2 THEN 0.75 END AS best_val_f1"""


@query(
    """SELECT doc_id, ['clean', 'low', 'high'][(doc_id % 3 + 1)::INT] AS test_noise,
    (CASE WHEN doc_id % 3 = 1 THEN toxic * 0.25 ELSE quality * 0.5 END)::DOUBLE AS test_f1_macro, [0.5, 0.25, 0.75][(doc_id % 3 + 1)::INT]::DOUBLE AS best_val_f1 FROM labels"""
)
def results_normalised(spark, folder):
    record = [c.strip().replace("\n", " ") for c in _RECORD.split(",")]
    rows = table(spark, folder, "labels").selectExpr("doc_id", *record)
    scores = [c for c in rows.columns if "f1" in c]
    return R.normalise_results(rows.withColumns({c: F.col(c).cast("double") for c in scores}))


def nested(spark, folder):
    """Conversations as nested threads: turn 0, then comments with two replies each."""
    turns = H.place_turns(table(spark, folder, "conversations"), "conv_id", "turn")
    node = [F.concat_ws("/", "conv_id", "turn").alias("tweet_id"), F.col("text").alias("tweet")]
    of = lambda kind: turns.filter(F.col("kind") == kind)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("turn", *c))), lambda s: s["n"])
    replies = of("reply").groupBy("conv_id", "comment_no").agg(listed([F.struct(*node).alias("n")]).alias("replies"))
    comments = of("comment").join(replies, ["conv_id", "comment_no"], "left")
    comments = comments.groupBy("conv_id").agg(listed([F.struct(*node, "replies").alias("n")]).alias("comments"))
    tags = turns.filter("turn % 2 = 1").groupBy("conv_id").agg(
        F.map_from_entries(F.collect_list(F.struct(node[0], F.when(F.col("role") == "assistant", "HOF").otherwise("NONE")))).alias("labels")
    )
    labels = F.coalesce("labels", F.create_map().cast("map<string,string>"))
    return of("root").select("conv_id", *node).join(comments, "conv_id", "left").join(tags, "conv_id", "left").withColumn("labels", labels)


_TURNS = """p AS (SELECT *, CASE WHEN turn = 0 THEN 0 ELSE (turn - 1) // 3 + 1 END AS comment_no,
    CASE WHEN turn = 0 THEN 'root' WHEN (turn - 1) % 3 = 0 THEN 'comment' ELSE 'reply' END AS kind,
    CASE WHEN turn % 2 = 1 AND role = 'assistant' THEN 'HOF' ELSE 'NONE' END AS tag FROM conversations),
  v AS (SELECT *, coalesce(string_agg(CASE WHEN kind = 'reply' THEN {sep} || text END, '') OVER (
    PARTITION BY conv_id, comment_no ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS previous FROM p),
  t AS (SELECT v.*, r.text AS root, c.text AS comment FROM v JOIN p r ON r.conv_id = v.conv_id AND r.kind = 'root'
    LEFT JOIN p c ON c.conv_id = v.conv_id AND c.comment_no = v.comment_no AND c.kind = 'comment')""".format(sep=q(SEP))


@query(
    rf"""WITH {_TURNS}, s AS (SELECT *, regexp_replace(text, {q('^' + X.SPACE_RUN + '|' + X.SPACE_RUN + '$')}, '', 'g') AS bare FROM t)
    SELECT conv_id, conv_id || '/' || turn AS tweet_id, bare AS text, (tag = 'HOF')::INT AS label, tag AS label_str FROM s WHERE length(bare) > 3"""
)
def nested_flatten(spark, folder):
    return H.flatten_threads(nested(spark, folder))


@query(
    f"""WITH {_TURNS} SELECT conv_id, conv_id || '/' || turn AS tweet_id, text, tag AS label,
    root || CASE WHEN kind = 'reply' THEN comment || previous ELSE '' END AS context FROM t"""
)
def nested_context(spark, folder):
    return H.context_rows(nested(spark, folder))


def _hierarchy_sql(previous: str) -> str:
    return f"""WITH {_TURNS} SELECT conv_id, root AS post, CASE kind WHEN 'root' THEN '' WHEN 'comment' THEN text ELSE comment || {previous} END AS context,
    CASE WHEN kind = 'reply' THEN text ELSE '' END AS text, (tag = 'HOF')::INT AS label FROM t"""


@query(_hierarchy_sql("''"))
def nested_hierarchy(spark, folder):
    return H.hierarchical_rows(nested(spark, folder))


@query(_hierarchy_sql("previous"))
def nested_hierarchy_running(spark, folder):
    return H.hierarchical_rows(nested(spark, folder), running=True)


_HOLES = "SELECT doc_id, nullif(lang, 'fr') AS lang, nullif(source, 'src3') AS source FROM documents"


@query(f"SELECT * FROM ({_HOLES}) WHERE lang IS NOT NULL AND source IS NOT NULL")
def drop_missing(spark, folder):
    return T.drop_missing(table(spark, folder, "documents").selectExpr("doc_id", "nullif(lang, 'fr') AS lang", "nullif(source, 'src3') AS source"))


@query("SELECT doc_id, lang AS lang_pair FROM documents WHERE lang = 'de'")
def language_pair_subset(spark, folder):
    return T.language_subset(table(spark, folder, "documents").select("doc_id", F.col("lang").alias("lang_pair")), "de")


@query("SELECT e.vec_id, e.label, d.n_chars, list_sum(e.embedding::DOUBLE[]) > 0 AS positive FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def feature_tables_side_by_side(spark, folder):
    """Columns of two feature tables by row, then those that both halves share."""
    e = table(spark, folder, "embeddings")
    left = e.select("vec_id", "label", (F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x) > 0).alias("positive"))
    right = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "n_chars")
    both = E.side_by_side(left, right, "vec_id")
    return both.select(*E.shared_columns(both, both.drop("other")))


_MASKED = """list_transform(range(1, 5), lambda j: list_sum(list_transform(range(0, 16), lambda i:
    CASE WHEN (vec_id + i) % 3 > 0 THEN v[(4 * i + j)::INT] ELSE 0 END)) / greatest(list_sum(list_transform(range(0, 16), lambda i:
    CASE WHEN (vec_id + i) % 3 > 0 THEN 1 ELSE 0 END)), 1e-9))"""


@query(f"SELECT vec_id, {shown_sql(_MASKED)} AS pooled FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def masked_token_mean(spark, folder):
    """Sixteen token vectors of four elements each, under a mask."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("v", 4 * i + 1, 4))
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when((F.col("vec_id") + i) % 3 > 0, 1.0).otherwise(0.0))
    pooled = rows.select("vec_id", tokens.alias("tokens"), mask.alias("mask")).select("vec_id", E.masked_mean("tokens", "mask").alias("m"))
    return pooled.select("vec_id", shown("m").alias("pooled"))


_KEY = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{X.SPACES}]"


@query(
    f"""WITH w AS (SELECT a.conv_id, a.turn, list_distinct(regexp_extract_all(a.text, {q(_KEY)})) AS x, list_distinct(regexp_extract_all(b.text, {q(_KEY)})) AS y
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1)
    SELECT conv_id, turn, len(list_distinct(list_concat(x, y))) AS n_union, len(list_intersect(x, y)) AS n_shared FROM w"""
)
def token_sets(spark, folder):
    turns = table(spark, folder, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    x, y = X.keywords("text", []), X.keywords("before", [])
    both = turns.join(before, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.size(X.token_union(x, y)).cast("bigint").alias("n_union"), X.overlap(x, y).cast("bigint").alias("n_shared"))
