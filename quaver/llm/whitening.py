"""Embedding whitening by spectrum slicing.

Entries become integers, so counts, sums and the scatter matrix are exact whatever the partitions. The leading
eigenvalues of the covariance are isolated by inertia: an LDL' factorisation of the shifted matrix
counts the eigenvalues below the shift. Rayleigh quotient iteration, started inside an isolating interval,
converges cubically to the pair, and two more counts on either side certify its number.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.llm.common import stored

#: Entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Integers up to this size are exact in double precision.
_EXACT = 1 << 53
_LARGEST = (1 << 63) - 1
_EPS = float(np.finfo(float).eps)


# Spectrum slicing of one small symmetric matrix.


def ldl(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """P, L and the diagonal blocks of P A P' = L D L', by Bunch and Kaufman's pivots of size one and two."""
    a = matrix.astype(float).copy()
    n = len(a)
    order, low, blocks = np.arange(n), np.eye(n), []
    bound = (1 + np.sqrt(17)) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            order[[i, j]] = order[[j, i]]
            low[[i, j], :k] = low[[j, i], :k]

    k = 0
    while k < n:
        size = 1
        if k + 1 < n:
            column = np.abs(a[k + 1 :, k])
            r = int(column.argmax())
            most, r = column[r], r + k + 1
            if most > 0 and abs(a[k, k]) < bound * most:
                other = np.abs(a[k:, r])
                other[r - k] = 0
                if abs(a[k, k]) * other.max() >= bound * most * most:
                    pass
                elif abs(a[r, r]) >= bound * other.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    size = 2
        d = a[k : k + size, k : k + size].copy()
        blocks.append((k, d))
        rest = slice(k + size, n)
        c = a[rest, k : k + size]
        if c.size and np.any(d):
            part = c / d[0, 0] if size == 1 else np.linalg.solve(d, c.T).T
            low[rest, k : k + size] = part
            a[rest, rest] -= part @ c.T
        k += size
    return order, low, blocks


def below(blocks: list[tuple[int, np.ndarray]]) -> int:
    """Negative eigenvalues of the block diagonal, which by Sylvester's law are those of the factored matrix."""
    count = 0
    for _, d in blocks:
        if len(d) == 1:
            count += d[0, 0] < 0
        else:
            product = d[0, 0] * d[1, 1] - d[0, 1] * d[1, 0]
            count += 1 if product < 0 else 2 * (d[0, 0] + d[1, 1] < 0)
    return int(count)


def inertia(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues below ``shift``."""
    return below(ldl(matrix - shift * np.eye(len(matrix)))[2])


def _shifted_solve(matrix: np.ndarray, shift: float, v: np.ndarray, floor: float) -> np.ndarray:
    """Solution of (A - shift) y = v; vanishing pivots count as ``floor``, as inverse iteration wants."""
    order, low, blocks = ldl(matrix - shift * np.eye(len(matrix)))
    y = v[order].copy()
    for k in range(len(y)):
        y[k + 1 :] -= low[k + 1 :, k] * y[k]
    for k, d in blocks:
        at = slice(k, k + len(d))
        if len(d) == 1:
            y[at] /= d[0, 0] if abs(d[0, 0]) > floor else floor
        else:
            y[at] = np.linalg.solve(d, y[at])
    for k in range(len(y) - 1, -1, -1):
        y[k] -= low[k + 1 :, k] @ y[k + 1 :]
    out = np.empty_like(y)
    out[order] = y
    return out


def leading_pairs(matrix: np.ndarray, most: int = COMPONENTS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues above rounding, falling, and their unit eigenvectors as columns.

    Counts halve an interval until it holds the wanted eigenvalue alone, or a cluster that no count can divide; Rayleigh
    quotient iteration, kept orthogonal to the vectors found, refines it. Counts just beside the result must
    give its number, or the interval is halved further.
    """
    n = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max()) if n else 0.0
    if norm == 0.0:
        return np.zeros(0), np.zeros((n, 0))
    noise = 8 * n * _EPS * norm
    least = max(noise, _EPS * norm)
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in counts:
            counts[shift] = n - inertia(matrix, shift)
        return counts[shift]

    top = norm * (1 + 4 * _EPS) + least
    counts[top] = 0
    total = min(most, above(least))
    rng = np.random.default_rng(seed)
    values, vectors = np.zeros(0), np.zeros((n, 0))
    for number in range(total):
        # Shifts already counted give the first interval: at most `number` eigenvalues above it, more from its low end on.
        high = min(s for s, c in counts.items() if c <= number)
        low = max(s for s, c in counts.items() if c > number)
        found = None
        while found is None:
            alone = above(high) == number and above(low) == number + 1
            if not alone and high - low > noise:
                middle = (low + high) / 2
                low, high = (middle, high) if above(middle) > number else (low, middle)
                continue
            found = _refine(matrix, low, high, vectors, rng, norm, noise)
            if found is not None and above(found[0] + 2 * noise) <= number < above(found[0] - 2 * noise):
                break
            if high - low <= noise:
                raise ArithmeticError("inertia counts do not certify an eigenvalue to double precision")
            found, middle = None, (low + high) / 2
            low, high = (middle, high) if above(middle) > number else (low, middle)
        value, vector = found
        values, vectors = np.append(values, value), np.column_stack([vectors, vector])
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _refine(matrix, low, high, known, rng, norm, noise):
    """Rayleigh quotient iteration from the interval's middle; None if it leaves the interval (narrow it then)."""
    floor = _EPS * norm
    shift = (low + high) / 2
    v = rng.normal(size=len(matrix))
    v -= known @ (known.T @ v)
    v /= np.linalg.norm(v)
    best = None
    for step in range(16):
        y = _shifted_solve(matrix, shift, v, floor)
        y /= np.linalg.norm(y)
        for _ in range(2):
            y -= known @ (known.T @ y)
        size = np.linalg.norm(y)
        if size < 1e-8:
            return None
        v = y / size
        quotient = float(v @ matrix @ v)
        rest = float(np.linalg.norm(matrix @ v - quotient * v))
        inside = low - noise <= quotient <= high + noise
        if best is not None and rest >= best[0] / 2 and best[0] <= noise:
            break
        if inside and (best is None or rest < best[0]):
            best = (rest, quotient, v)
        # The first solves draw the vector into the interval, then the quotient is the shift.
        if step >= 1 and inside:
            shift = quotient
    return (best[1], best[2]) if best is not None and best[0] <= noise else None


# The passes over the vectors.


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, flat double entries, usable) of a list column; a null or non-finite entry spoils its list."""
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = column.flatten()
    entries = np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64)
    usable = np.asarray(column.is_valid()) & (lengths > 0)
    ends = np.cumsum(lengths)
    bad = np.cumsum(np.concatenate([[0], ~np.isfinite(entries)]))
    usable &= bad[ends] == bad[ends - lengths]
    return lengths, entries, usable


def _integers(entries: np.ndarray) -> np.ndarray:
    x = np.floor(SCALE * entries)
    if x.size and np.abs(x).max() >= _EXACT:
        raise OverflowError("an entry times 64 is beyond the integers that double precision holds")
    return x.astype(np.int64) + OFFSET


def _rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the usable rows with ``dim`` entries, and their integers."""
    lengths, entries, usable = _parts(column)
    keep = usable & (lengths == dim)
    return np.flatnonzero(keep), _integers(entries[np.repeat(keep, lengths)]).reshape(-1, dim)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length and place: number of vectors and sum, one row a task or whenever a sum might pass 2**62."""
    held: dict[int, tuple[int, np.ndarray, int]] = {}

    def rows(dim: int) -> pa.RecordBatch:
        n, total, _ = held.pop(dim)
        columns = [np.full(dim, dim), np.arange(dim), np.full(dim, n), total]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["dim", "place", "n", "total"])

    for batch in batches:
        lengths, _, usable = _parts(batch.column(0))
        for dim in np.unique(lengths[usable]).tolist():
            _, x = _rows(batch.column(0), dim)
            most = int(np.abs(x).max()) * len(x)
            if most >= 1 << 62:
                raise OverflowError("the entries of one batch sum beyond 64 bits")
            if dim in held and held[dim][2] + most >= 1 << 62:
                yield rows(dim)
            n, total, reach = held.get(dim, (0, np.zeros(dim, np.int64), 0))
            held[dim] = (n + len(x), total + x.sum(axis=0), reach + most)
    for dim in sorted(held):
        yield rows(dim)


def _exact_products(z: np.ndarray) -> np.ndarray:
    """z' z in exact integers: BLAS in double precision on as many rows as stay below 2**53."""
    most = int(np.abs(z).max()) if z.size else 0
    if most * most >= _EXACT:
        wide = z.astype(object)
        return wide.T @ wide
    rows = max(1, (_EXACT - 1) // max(1, most * most))
    out = np.zeros((z.shape[1],) * 2, dtype=object if most * most * len(z) >= 1 << 62 else np.int64)
    for lo in range(0, len(z), rows):
        part = z[lo : lo + rows].astype(float)
        out += (part.T @ part).astype(np.int64)
    return out


def _triangle(matrix: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    i, j = np.triu_indices(len(matrix))
    values = matrix[i, j].tolist()
    if pa.types.is_decimal(kind):
        values = [Decimal(int(v)) for v in values]
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(values, kind)], ["i", "j", "value"])


def _full(cells, dim: int) -> np.ndarray:
    out = np.zeros((dim, dim), dtype=object)
    for i, j, value in cells:
        out[i, j] = out[j, i] = value
    return out


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each usable row and leading component.

    Rows whose vector is null, empty or holds a null or non-finite entry are dropped; where lengths differ, the most
    frequent one is the space (the longest of equally frequent ones) and other rows are dropped. Null and repeated keys keep their rows. Components without
    variance beyond rounding cannot be whitened and are left out, so a table of equal vectors, like an empty
    one, gives no row. Of equal eigenvalues any orthonormal vectors are taken, the same for all rows. Only the two named
    columns are read. ``deviation`` past 64 bits raises OverflowError.

    Four scans without a shuffle of rows: counts and sums; the scatter matrix; the covariance of the whitened
    values; the output. What moves is a triangle of dim * (dim + 1) / 2 numbers per task, and the driver
    holds such a triangle: it grows with the dimension alone.
    """
    spark = vectors.sparkSession
    column = vectors.select(F.col(vector))
    shape = T.StructType([vectors.select(F.col(key).alias("k")).schema[0]])
    fields = [T.StructField(key, shape[0].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType())]
    fields += [T.StructField("deviation", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    schema = T.StructType(fields)

    tasks = stored(column.mapInArrow(_sums, "dim LONG, place LONG, n LONG, total LONG"), "whitening-sums")
    chosen = tasks.where("place = 0").groupBy("dim").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not chosen:
        return spark.createDataFrame([], schema)
    dim, n = int(chosen[0]["dim"]), int(chosen[0]["n"])
    exact = F.sum(F.col("total").cast("decimal(38,0)"))
    sums = [int(r["total"]) for r in tasks.where(F.col("dim") == dim).groupBy("place").agg(exact.alias("total")).orderBy("place").collect()]
    # Entries are centred by the rounded mean before multiplying; what rounding left over is taken off exactly below.
    near = np.array([round(Fraction(s, n)) for s in sums], dtype=np.int64)
    rest = [s - n * int(m) for s, m in zip(sums, near, strict=True)]

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim), dtype=object)
        for batch in batches:
            total = total + _exact_products(_rows(batch.column(0), dim)[1] - near)
        yield _triangle(total, pa.decimal128(38, 0))

    cells = column.mapInArrow(scatter, "i INT, j INT, value DECIMAL(38,0)").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    products = _full([(r["i"], r["j"], int(r["value"])) for r in cells], dim)
    covariance = np.array([[float(Fraction(n * products[i, j] - rest[i] * rest[j], n * n)) for j in range(dim)] for i in range(dim)])
    trace = float(Fraction(sum(n * products[i, i] - rest[i] * rest[i] for i in range(dim)), n * n))
    values, axes = leading_pairs(covariance, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    left = np.array([float(Fraction(r, n)) for r in rest])
    shared = spark.sparkContext.broadcast((near, left, axes / np.sqrt(values)))

    def projected(z: np.ndarray) -> np.ndarray:
        _, remainder, scaled = shared.value
        return (z - remainder) @ scaled

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Projections of centred entries have mean zero but for rounding, which a row of ones measures.
        total = np.zeros((len(values) + 1,) * 2)
        for batch in batches:
            w = projected(_rows(batch.column(0), dim)[1] - shared.value[0])
            w = np.column_stack([w, np.ones(len(w))])
            total += w.T @ w
        yield _triangle(total, pa.float64())

    cells = column.mapInArrow(moments, "i INT, j INT, value DOUBLE").groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    second = _full(cells, len(values) + 1).astype(float) / n
    mean = second[:-1, -1]
    error = float(np.abs(second[:-1, :-1] - np.outer(mean, mean) - np.eye(len(values))).max())
    explained = values / trace
    numbers = np.arange(1, len(values) + 1)

    def output(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, x = _rows(batch.column(1), dim)
            if not len(kept):
                continue
            z = x - shared.value[0]
            # n * x - S = n * z - rest, entry by entry.
            far = int(np.abs(z).max()) * n + max(map(abs, rest))
            if far * far * dim <= _LARGEST:
                d = n * z - np.array(rest)
                deviation = (d * d).sum(axis=1)
            else:
                whole = [sum((n * int(c) - r) ** 2 for c, r in zip(row, rest, strict=True)) for row in z]
                if max(whole) > _LARGEST:
                    raise OverflowError("a deviation is beyond 64 bits")
                deviation = np.array(whole, np.int64)
            k = len(numbers)
            arrays = [batch.column(0).take(pa.array(np.repeat(kept, k))), np.tile(numbers, len(kept)), np.full(len(kept) * k, n), np.repeat(deviation, k)]
            arrays += [projected(z).reshape(-1), np.tile(explained, len(kept)), np.full(len(kept) * k, error)]
            kinds = [None, pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 3]
            arrays = [a if t is None else pa.array(a, t) for a, t in zip(arrays, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return vectors.select(F.col(key), F.col(vector)).mapInArrow(output, schema)
