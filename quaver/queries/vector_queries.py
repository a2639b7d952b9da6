"""Vector operators over the embeddings table.

Vectors are shown as integers (5 decimal places) joined by commas, so that both
engines print them alike.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quaver.functions import fixed
from quaver.functions import vectors as V
from quaver.functions.draws import RANGE, digest, quarter
from quaver.operators import embeddings as E
from quaver.operators.tables import row_shape
from quaver.queries import query, table
from quaver.queries.common import draw

DECIMALS = 100_000.0


def shown(vector):
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.array_join(F.transform(v, lambda x: F.round(x * DECIMALS).cast("bigint")), ",")


def shown_sql(v: str) -> str:
    return f"array_to_string(list_transform({v}, lambda x: round(x * {DECIMALS})::BIGINT), ',')"


def embeddings(spark, folder):
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_NORM = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"
_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i] * {1}[i]))"
_PAIRS = f"{_E}, p AS (SELECT a.vec_id, a.v AS v, b.v AS w FROM e a JOIN e b ON b.vec_id = a.vec_id - 1)"


def with_previous(spark, folder):
    e = embeddings(spark, folder)
    return e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")


@query(
    f"""WITH {_PAIRS} SELECT vec_id, {shown_sql(f'list_transform(range(1, len(v) + 1), lambda i: v[i] * {fixed.TEXT_WEIGHT} + w[i] * {fixed.CONTEXT_WEIGHT})')} AS blended FROM p"""
)
def vec_blend(spark, folder):
    return with_previous(spark, folder).select("vec_id", shown(V.blend("w", "v")).alias("blended"))


@query(
    f"""WITH {_PAIRS} SELECT vec_id, round({_DOT.format('v', 'w')} / ({_NORM.format('v')} * {_NORM.format('w')}), 6) AS cosine,
    round(1 - {_DOT.format('v', 'w')} / ({_NORM.format('v')} * {_NORM.format('w')}), 6) AS distance FROM p"""
)
def vec_cosine(spark, folder):
    return with_previous(spark, folder).select(
        "vec_id", F.round(V.cosine("v", "w"), 6).alias("cosine"), F.round(V.cosine_distance("v", "w"), 6).alias("distance")
    )


# The two vectors before a vector are its contexts.
_CTX = f"{_E}, c AS (SELECT a.vec_id, a.v AS v, b.v AS w, a.vec_id - b.vec_id AS gap FROM e a JOIN e b ON b.vec_id BETWEEN a.vec_id - 2 AND a.vec_id - 1)"


def _context_sum_sql(weight: str) -> str:
    return f"""WITH {_CTX}, t AS (SELECT vec_id, v, w, {weight} AS k FROM c),
      x AS (SELECT vec_id, unnest(range(1, len(w) + 1)) AS i, unnest(list_transform(w, lambda x: x * k)) AS x FROM t
        UNION ALL SELECT vec_id, unnest(range(1, len(v) + 1)), unnest(v) FROM e),
      s AS (SELECT vec_id, i, sum(x) AS x FROM x GROUP BY ALL), l AS (SELECT vec_id, list(x ORDER BY i) AS v FROM s GROUP BY vec_id)
    SELECT vec_id, {shown_sql('v')} AS embedding FROM l"""


def contexts(spark, folder):
    gaps = F.explode(F.array(F.lit(1), F.lit(2))).alias("gap")
    later = embeddings(spark, folder).select("vec_id", "v", gaps)
    return later.select((F.col("vec_id") + F.col("gap")).alias("vec_id"), "v", "gap")


@query(_context_sum_sql(f"1 - {_DOT.format('v', 'w')} / ({_NORM.format('v')} * {_NORM.format('w')})"))
def ctx_embedding(spark, folder):
    text = embeddings(spark, folder).select("vec_id", "v")
    return E.context_sum(text, contexts(spark, folder), "vec_id", "v").select("vec_id", shown("embedding").alias("embedding"))


@query(_context_sum_sql("1.0 / gap"))
def ctx_embedding_weighted(spark, folder):
    text = embeddings(spark, folder).select("vec_id", "v")
    ctx = contexts(spark, folder).select("vec_id", "v", (1.0 / F.col("gap")).alias("weight"))
    return E.context_sum(text, ctx, "vec_id", "v", "weight").select("vec_id", shown("embedding").alias("embedding"))


@query(
    f"""WITH {_E}, x AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e WHERE vec_id % 5 <> 0),
    m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY ALL) SELECT label, {shown_sql('list(x ORDER BY i)')} AS pooled FROM m GROUP BY label"""
)
def mean_pool(spark, folder):
    pooled = E.mean_pool(embeddings(spark, folder), ["label"], "v", F.col("vec_id") % 5 != 0)
    return pooled.select("label", shown("pooled").alias("pooled"))


@query(f"WITH {_E} SELECT vec_id, {shown_sql('list_transform(v, lambda x: x / n)')} AS unit, round(n, 6) AS norm FROM (SELECT *, {_NORM.format('v')} AS n FROM e)")
def l2_norm(spark, folder):
    return embeddings(spark, folder).select("vec_id", shown(V.unit("v")).alias("unit"), F.round(V.norm("v"), 6).alias("norm"))


# Parts of a vector play post, context and text; ids choose which parts are filled.
_SHAPE = "CASE vec_id % 4 WHEN 0 THEN 'post' WHEN 1 THEN 'post_context' WHEN 2 THEN 'post_context_text' END"


@query(
    f"""WITH {_E}, s AS (SELECT vec_id, {_SHAPE} AS shape, v[1:len(v) // 3] AS p, v[len(v) // 3 + 1:2 * (len(v) // 3)] AS c, v[2 * (len(v) // 3) + 1:] AS t FROM e)
    SELECT vec_id, shape, {shown_sql("CASE shape WHEN 'post' THEN p WHEN 'post_context' THEN list_concat(p, c) ELSE list_concat(t, list_concat(p, c)) END")} AS features,
      {shown_sql('list_concat(t, p)')} AS text_post FROM s WHERE shape IS NOT NULL"""
)
def vec_concat(spark, folder):
    k = F.col("vec_id") % 4
    rows = embeddings(spark, folder).select(
        "vec_id",
        F.when(k != 3, "p").otherwise("").alias("post"),
        F.when(k.isin(1, 2), "c").otherwise("").alias("context"),
        F.when(k == 2, "t").otherwise("").alias("text"),
        F.expr("slice(v, 1, size(v) div 3)").alias("vp"), F.expr("slice(v, size(v) div 3 + 1, size(v) div 3)").alias("vc"),
        F.expr("slice(v, 2 * (size(v) div 3) + 1, size(v))").alias("vt"),
    )
    rows = rows.withColumn("shape", row_shape()).filter(F.col("shape").isNotNull())
    return rows.select(
        "vec_id", "shape", shown(V.concat_by_shape("shape", "vt", "vp", "vc")).alias("features"),
        shown(V.concat_selected({"text": "vt", "post": "vp", "context": "vc"}, ["text", "post"])).alias("text_post"),
    )


@query(
    f"WITH {_E} SELECT vec_id, {shown_sql('list_transform(range(1, len(v) + 1), lambda i: (v[i] + v[len(v) + 1 - i] + v[i] * 0.5) / 3)')} AS average FROM e"
)
def vec_avg(spark, folder):
    mean = V.average("v", F.reverse("v"), V.scale("v", 0.5))
    return embeddings(spark, folder).select("vec_id", shown(mean).alias("average"))


@query(
    f"""WITH {_E}, a AS (SELECT CASE WHEN vec_id % 2 = 0 THEN vec_id ELSE -vec_id END AS vec_id, v FROM e), b AS (SELECT CASE WHEN vec_id % 3 <> 1 THEN vec_id ELSE -vec_id END AS vec_id, v FROM e)
    SELECT coalesce(a.vec_id, b.vec_id) AS vec_id, {shown_sql('list_transform(range(1, len(coalesce(a.v, b.v)) + 1), lambda i: coalesce(a.v[i], 0) + coalesce(b.v[i], 0))')} AS features
    FROM a FULL JOIN b ON a.vec_id = b.vec_id"""
)
def add_features(spark, folder):
    e = embeddings(spark, folder)
    # Negative ids make rows that the other side may lack; every vector is on both sides.
    signed = lambda keep: e.select(F.when(keep, F.col("vec_id")).otherwise(-F.col("vec_id")).alias("vec_id"), "v")
    both = E.add_features(signed(F.col("vec_id") % 2 == 0), signed(F.col("vec_id") % 3 != 1), "vec_id", "v")
    return both.select("vec_id", shown("features").alias("features"))


_B = 32


@query(
    f"""WITH {_E}, p AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1) // {_B} AS batch, vec_id, v,
      list_transform(range(1, len(v) + 1), lambda i: v[i] * (1 + 0.2 * ((i - 1) % 3))) AS w,
      {draw("md5('phi|' || vec_id)", 0)} / {RANGE}::DOUBLE AS phi FROM e),
    z AS (SELECT batch, vec_id, 0 AS side, phi, list_transform(v, lambda x: x / {_NORM.format('v')}) AS z FROM p
      UNION ALL SELECT batch, vec_id, 1, phi, list_transform(w, lambda x: x / {_NORM.format('w')}) FROM p),
    s AS (SELECT a.batch, a.vec_id, a.side, a.phi, a.vec_id = b.vec_id AS twin, {_DOT.format('a.z', 'b.z')} / {fixed.TEMPERATURE} AS s
      FROM z a JOIN z b ON a.batch = b.batch AND NOT (a.vec_id = b.vec_id AND a.side = b.side)),
    l AS (SELECT batch, vec_id, side, phi, ln(sum(exp(s))) - sum(CASE WHEN twin THEN s ELSE 0 END) AS loss FROM s GROUP BY ALL)
    SELECT batch::BIGINT AS batch, (count(*) // 2)::BIGINT AS pairs, round(sum(phi * loss) / greatest(sum(phi), 1e-8), 6) AS alignment FROM l GROUP BY batch"""
)
def alignment(spark, folder):
    noisy = F.transform("v", lambda x, i: x * (1 + 0.2 * (i % 3)))
    phi = quarter(digest("phi", F.col("vec_id")), 0) / float(RANGE)
    pairs = embeddings(spark, folder).select("vec_id", F.col("v").alias("clean"), noisy.alias("noisy"), phi.alias("phi"))
    return E.alignment(pairs, "vec_id", batch_size=_B).withColumn("alignment", F.round("alignment", 6))
