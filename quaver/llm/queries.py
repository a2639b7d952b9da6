"""Registered queries of the operators in this folder, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaver.llm.common import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op6_token_counts(spark, folder):
    from quaver.llm.token_counts import token_counts

    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts(docs, tokenizer_file("word_bpe_49k.json"), new_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query()
def op7_pii_anchors(spark, folder):
    from quaver.llm.pii import BASE, kind_count, pii_spans, span_list

    found = pii_spans(table(spark, folder, "documents").select("doc_id", "text"), mask=False)
    s = F.col("pii_spans")
    return found.select(
        "doc_id",
        *[kind_count(s, k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_list(s, base_only=True), 256).alias("base_sha256"),
        span_list(s).alias("spans"),
    )


@query()
def op10_best_fit(spark, folder):
    from quaver.llm.packing import best_fit, word_length

    return best_fit(table(spark, folder, "documents").select("doc_id", word_length(F.col("text")).alias("n_tokens")))


def held_out(modulus: int, remainder: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder


@query()
def op1_byte_cnn(spark, folder):
    from quaver.llm.language_id import fit_languages, predict_languages

    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", held_out(3, 1).alias("held_out"))
    net = fit_languages(docs.where(~F.col("held_out")))
    found = predict_languages(docs.drop("lang"), net)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))


@query()
def op4_pigeonhole(spark, folder):
    from quaver.llm.decontamination import contaminated

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, folder, "benchmark"))


@query()
def op3_lsh_forest(spark, folder):
    from quaver.llm.lsh_forest import near_duplicates

    found = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), size=3, percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def span_total(spans: str):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


@query()
def op8_suffix_array(spark, folder):
    from quaver.llm.suffix_dedup import later_bytes

    found = later_bytes(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", span_total("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query()
def op9_recompression(spark, folder):
    from quaver.llm.recompression import repeated_words

    found = repeated_words(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", span_total("spans").alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


@query()
def op2_nn_descent(spark, folder):
    from quaver.llm.nn_descent import near_vectors

    found = near_vectors(table(spark, folder, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query()
def op5_gru_lm(spark, folder):
    from quaver.llm.gru_lm import score_documents

    docs = table(spark, folder, "documents").select("doc_id", "text", held_out(7, 2).alias("held_out"))
    scored = score_documents(docs.select("doc_id", "text"), docs.where(~F.col("held_out")).select("doc_id", "text"))
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return scored.select("doc_id", held_out(7, 2).alias("held_out"), *names)


@query()
def op11_byte_cnn_quality(spark, folder):
    from quaver.llm.quality import fit_quality, score_quality

    docs = table(spark, folder, "documents").select("doc_id", "text", held_out(5, 0).alias("held_out"))
    labels = table(spark, folder, "labels").where(~held_out(5, 0)).select("doc_id", "quality")
    scored = score_quality(docs, fit_quality(docs.where(~F.col("held_out")), labels))
    score = F.col("quality_score")
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


@query()
def op13_spectrum_slicing(spark, folder):
    from quaver.llm.whitening import whiten

    return whiten(table(spark, folder, "embeddings"))


#: Bit by bit, as no SQL function of DuckDB gives it.
CRC32 = """xor(4294967295, list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda z: ascii(z)::BIGINT),
      lambda a, z: list_reduce(range(8), lambda u, k: xor(u >> 1, 3988292384 * (u & 1)), xor(a, z)), 4294967295::BIGINT))"""

TRIE_SQL = f"""WITH turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
    FROM conversations WHERE conv_id IS NOT NULL),
  convs AS (SELECT c, {CRC32} % 6 AS h, c - c % 100 AS base FROM (SELECT DISTINCT c FROM turns)),
  built AS (
    SELECT v.c, 0 AS own, t.p, t.r, t.x FROM convs v JOIN turns t ON t.c = v.base AND t.p <= v.h
    UNION ALL SELECT v.c, 1, t.p, t.r, t.x FROM convs v JOIN turns t ON t.c = v.c AND t.p > v.h),
  prefixes AS (
    SELECT c, row_number() OVER w AS depth, list(md5(length(r) || ':' || r || x)) OVER w AS path, length(x) AS chars
    FROM built WINDOW w AS (PARTITION BY c ORDER BY own, p)
    UNION ALL SELECT c, 0, []::VARCHAR[], 0 FROM convs),
  nodes AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM prefixes GROUP BY path, depth),
  kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
  valued AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
  sums AS (
    SELECT path[1:k] AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
    FROM (SELECT *, unnest(range(depth + 1)) AS k FROM valued) GROUP BY 1),
  ends AS (
    SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends_sha256
    FROM (SELECT c, max_by(path, depth) AS path FROM prefixes GROUP BY c) GROUP BY path)
  SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves::BIGINT AS n_leaves,
    saved_tokens::BIGINT AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
  FROM valued v JOIN sums USING (path) LEFT JOIN ends USING (path)
  LEFT JOIN nodes u ON v.depth > 0 AND u.path = v.path[1:v.depth - 1]"""


@query(TRIE_SQL)
def op12_depth_bands(spark, folder):
    from quaver.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, folder, "conversations"))
