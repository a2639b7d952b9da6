"""Dense-vector arithmetic over array columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaver.functions import fixed


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def scale(v, factor) -> Column:
    return F.transform(_col(v), lambda x: x * factor)


def add(a, b) -> Column:
    """Element-wise sum; a missing vector or element counts as 0."""
    a, b = _col(a), _col(b)
    summed = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    return F.coalesce(summed, a, b)


def blend(context, text, context_weight: float = fixed.CONTEXT_WEIGHT, text_weight: float = fixed.TEXT_WEIGHT) -> Column:
    return add(scale(text, text_weight), scale(context, context_weight))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """Cosine similarity; null when either vector is zero."""
    scale_ = norm(a) * norm(b)
    return F.when(scale_ > 0, dot(a, b) / scale_)


def cosine_distance(a, b) -> Column:
    return F.lit(1.0) - cosine(a, b)


def unit(v, floor: float = 1e-12) -> Column:
    """Divide by the Euclidean norm, which is kept away from zero."""
    return F.get(
        F.transform(
            F.array(F.greatest(norm(v), F.lit(floor))), lambda n: F.transform(_col(v), lambda x: x / n)
        ),
        F.lit(0),
    )


def average(*vectors) -> Column:
    total = reduce(add, vectors)
    return F.transform(total, lambda x: x / float(len(vectors)))


def concat_by_shape(shape, text, post, context) -> Column:
    """Feature layout by row shape: post; post and context; text, post and context."""
    shape, text, post, context = map(_col, (shape, text, post, context))
    return (
        F.when(shape == "post", post)
        .when(shape == "post_context", F.concat(post, context))
        .when(shape == "post_context_text", F.concat(text, post, context))
    )


def concat_selected(parts: dict[str, object], keep: list[str]) -> Column:
    """Concatenate a chosen subset of named vectors (feature ablations)."""
    return F.concat(*[_col(parts[name]) for name in keep])
