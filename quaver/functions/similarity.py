"""Jaro-Winkler word similarity and the phonetic dissimilarity weight.

Spark has no built-in Jaro-Winkler, so this is the one place that uses an
Arrow-batched Python function. It works row by row on the two texts, needs no
shuffle, and scores each distinct word pair of some batches once.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX_LIMIT = 4
PREFIX_WEIGHT = 0.1
BOOST_ABOVE = 0.7
SHORT = 24  # longest word scored in the vectorised path
_BLOCK = 8192  # pairs scored together


def _by_pointers(a: str, b: str) -> float:
    """Jaro-Winkler of one pair in time linear in the word lengths.

    The search window only moves right, so the leftmost free match of a
    character is always the next of its remaining positions.
    """
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    spots: dict[str, list[int]] = {}
    for j, ch in enumerate(b):
        spots.setdefault(ch, []).append(j)
    nxt = dict.fromkeys(spots, 0)
    left, taken = [], []
    for i, ch in enumerate(a):
        places = spots.get(ch)
        if places is None:
            continue
        k = nxt[ch]
        while k < len(places) and places[k] < i - reach:
            k += 1
        if k < len(places) and places[k] <= i + reach:
            left.append(ch)
            taken.append(places[k])
            k += 1
        nxt[ch] = k
    m = len(left)
    if m == 0:
        return 0.0
    right = [b[j] for j in sorted(taken)]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    return _boosted(m, swaps, len(a), len(b), _shared_prefix(a, b))


def _shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a[:PREFIX_LIMIT], b[:PREFIX_LIMIT]):
        if x != y:
            break
        n += 1
    return n


def _boosted(m, swaps, len_a, len_b, prefix):
    jaro = (m / len_a + m / len_b + (m - swaps) / m) / 3.0
    return jaro + prefix * PREFIX_WEIGHT * (1.0 - jaro) if jaro > BOOST_ABOVE else jaro


def _block(ca: np.ndarray, cb: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Jaro-Winkler of aligned short non-empty words of one larger length each.

    Words are given as a row per place, of codes whose padding differs between both sides. In order of places a character
    takes the first equal free one in reach. The k-th matched characters of both sides are in reach of each other too.
    """
    width, n = ca.shape
    reach = max(width // 2 - 1, 0)
    near = [range(max(0, i - reach), min(width, i + reach + 1)) for i in range(width)]
    rank_a, rank_b = np.zeros((width, n), np.uint8), np.full((width, n), 255, np.uint8)
    free = np.ones((width, n), bool)
    m = np.zeros(n, np.uint8)
    for i in range(width):
        open_ = np.ones(n, bool)
        for j in near[i]:
            hit = ca[i] == cb[j]
            hit &= free[j]
            hit &= open_
            free[j] ^= hit
            open_ ^= hit
        m += ~open_
        np.copyto(rank_a[i], m, where=~open_)
    at = np.zeros(n, np.uint8)
    for j in range(width):
        at += ~free[j]
        np.copyto(rank_b[j], at, where=~free[j])
    swaps = np.zeros(n, np.uint8)
    for i in range(width):
        for j in near[i]:
            swaps += (rank_a[i] == rank_b[j]) & (ca[i] != cb[j])
    prefix, same = np.zeros(n, np.uint8), np.ones(n, bool)
    for i in range(min(PREFIX_LIMIT, width)):
        same &= ca[i] == cb[i]
        prefix += same
    m, swaps = m.astype(np.int64), swaps.astype(np.int64) // 2
    safe = np.maximum(m, 1)
    jaro = (m / la + m / lb + (safe - swaps) / safe) / 3.0
    score = np.where(jaro > BOOST_ABOVE, jaro + prefix * PREFIX_WEIGHT * (1.0 - jaro), jaro)
    return np.where(m == 0, 0.0, score)


def _score_ids(words: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of word pairs given as positions in ``words``; equal pairs once."""
    back, keys = pd.factorize(a.astype(np.int64) * len(words) + b)
    a, b = keys // len(words), keys % len(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    long_ = (lengths > SHORT) | np.fromiter(("\0" in w for w in words), bool, len(words))
    table = np.array(["" if x else w for w, x in zip(words, long_)] + ["x"])
    points = table.view(np.uint32).reshape(len(table), -1)
    # Codes from 2 on, by rank among the characters there are; 0 and 1 pad the two sides.
    known = np.unique(points)
    kind = np.uint8 if len(known) < 250 else np.uint32
    left = np.where(points == 0, 0, np.searchsorted(known, points) + 2).astype(kind)
    right = np.where(points == 0, 1, left).astype(kind)
    out = np.ones(len(keys))
    differ = a != b
    out[differ & ((lengths[a] == 0) | (lengths[b] == 0))] = 0.0
    for k in np.flatnonzero(differ & (long_[a] | long_[b])):
        out[k] = _by_pointers(words[a[k]], words[b[k]])
    short = np.flatnonzero(differ & ~long_[a] & ~long_[b] & (lengths[a] > 0) & (lengths[b] > 0))
    # Pairs of one larger length together, so that they share their reach.
    larger = np.maximum(lengths[a[short]], lengths[b[short]])
    order = np.argsort(larger.astype(np.uint8), kind="stable")
    short, cuts = short[order], np.searchsorted(larger[order], np.arange(1, SHORT + 2))
    for width in range(1, SHORT + 1):
        for lo in range(cuts[width - 1], cuts[width], _BLOCK):
            ks = short[lo : min(lo + _BLOCK, cuts[width])]
            ca, cb = (np.ascontiguousarray(side[ids[ks], :width].T) for side, ids in ((left, a), (right, b)))
            out[ks] = _block(ca, cb, lengths[a[ks]], lengths[b[ks]])
    return out[back]


def _score_words(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Jaro-Winkler similarity of aligned words, none of them null."""
    both = pa.concat_arrays([a, b]).dictionary_encode()
    ids = both.indices.to_numpy().astype(np.int64)
    return _score_ids(both.dictionary.to_pylist(), ids[: len(a)], ids[len(a) :]) if len(a) else np.empty(0)


def jaro_winkler_many(a: list[str], b: list[str]) -> np.ndarray:
    """Jaro-Winkler similarity of aligned word lists."""
    return _score_words(pa.array(a, pa.string()), pa.array(b, pa.string()))


#: Word pairs that are scored at once, whatever the length of the texts.
PAIRS_AT_ONCE = 1 << 18


def _mean_similarity(left: pd.Series, right: pd.Series) -> np.ndarray:
    result, sums, longest = np.full(len(left), np.nan), np.zeros(len(left)), np.ones(len(left))
    firsts: list[str] = []
    seconds: list[str] = []
    rows: list[int] = []
    counts: list[int] = []

    def flush() -> None:
        owner = np.repeat(np.array(rows, np.int64), counts)
        for lo in range(0, len(firsts), PAIRS_AT_ONCE):
            part = slice(lo, lo + PAIRS_AT_ONCE)
            np.add.at(sums, owner[part], jaro_winkler_many(firsts[part], seconds[part]))
        for x in (firsts, seconds, rows, counts):
            x.clear()

    for k, (x, y) in enumerate(zip(left, right)):
        if x is None or y is None:
            continue
        # The whitespace on which str.split breaks is that of quaver.functions.text.SPACES.
        p, q = x.lower().split(), y.lower().split()
        if not p or not q:
            result[k] = 1.0
            continue
        result[k], longest[k] = 0.0, max(len(p), len(q))
        n = min(len(p), len(q))
        firsts += p[:n]
        seconds += q[:n]
        rows.append(k)
        counts.append(n)
        if len(firsts) >= PAIRS_AT_ONCE:
            flush()
    flush()
    return np.where(np.isnan(result) | (result == 1.0), result, sums / longest)


@F.arrow_udf(T.DoubleType())
def _word_udf(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    held: list[tuple[pa.Array, pa.Array]] = []

    def scored() -> Iterator[pa.Array]:
        known = [pc.and_(pc.is_valid(a), pc.is_valid(b)) for a, b in held]
        sides = [pa.concat_arrays([pair[side].filter(k).cast(pa.string()) for pair, k in zip(held, known)]) for side in (0, 1)]
        scores, at = _score_words(*sides), 0
        for k in known:
            mine = np.asarray(k)
            out = np.zeros(len(mine))
            n = int(mine.sum())
            out[mine] = scores[at : at + n]
            at += n
            yield pa.array(out, pa.float64(), mask=~mine)
        held.clear()

    # A block's cost hardly falls with fewer pairs, so batches are scored together.
    for a, b in batches:
        held.append((a, b))
        if sum(len(x) for x, _ in held) >= PAIRS_AT_ONCE:
            yield from scored()
    if held:
        yield from scored()


@F.pandas_udf(T.DoubleType())
def _text_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(_mean_similarity(a, b))


# Marked so that a later filter is not pushed below them, which would copy the
# call, and the texts computed for it, into the filter.
_word_udf = _word_udf.asNondeterministic()
_text_udf = _text_udf.asNondeterministic()


def jaro_winkler(a, b) -> Column:
    """Similarity of two words in [0, 1]."""
    return _word_udf(a, b)


def phonetic_similarity(a, b) -> Column:
    """Mean word similarity by position, over the longer word count.

    Equal texts score 1 without being sent to Python.
    """
    a = a if isinstance(a, Column) else F.col(a)
    b = b if isinstance(b, Column) else F.col(b)
    scored = F.nanvl(_text_udf(F.when(a != b, a), F.when(a != b, b)), F.lit(None).cast("double"))
    return F.when(a == b, F.lit(1.0)).otherwise(scored)


def phi(a, b) -> Column:
    """Phonetic dissimilarity weight, 1 - phonetic_similarity."""
    return F.lit(1.0) - phonetic_similarity(a, b)
