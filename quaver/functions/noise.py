"""Speech-recognition-style noise as column expressions.

Word operators take their draws as columns (integers in [0, 2**32)), so a test
can fix them and an SQL engine can repeat them. :func:`token_noise` and :func:`char_noise`
go over whole texts in Arrow batches: Spark interprets array lambdas, a digest and a dozen
expressions for every token, at several times the cost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.functions import fixed
from quaver.functions.draws import RANGE, digest_at, key_prefix, let, pick, quarter, quarters_at, threshold
from quaver.functions.text import tokens


def _swap_first(word: Column, old: str, new: Column) -> Column:
    at = F.instr(word, F.lit(old))
    return F.concat(F.substring(word, F.lit(1), at - 1), new, F.substring(word, at + len(old), F.length(word)))


def char_substitution(word: Column, choice: Column, position: Column, low: Column | None = None) -> Column:
    """Swap the first confusable character group; else overwrite one character.

    ``low`` may carry the lower-cased word if it is already at hand.
    """
    low = F.lower(word) if low is None else low
    out = F
    for old, *targets in fixed.CHARACTER_CONFUSIONS:
        out = out.when(F.instr(low, F.lit(old)) > 0, _swap_first(low, old, pick(targets, choice)))
    at = (position % F.length(word)).cast("int") + 1
    overwritten = F.concat(
        F.substring(word, F.lit(1), at - 1),
        pick(list(fixed.OVERWRITE_LETTERS), choice),
        F.substring(word, at + 1, F.length(word)),
    )
    return out.when(F.length(word) > 2, overwritten).otherwise(word)


def word_split(word: Column, position: Column) -> Column:
    """Words over four characters get one space, at least two characters from either end."""
    at = (position % (F.length(word) - 3)).cast("int") + 2
    return F.when(
        F.length(word) > 4,
        F.concat(F.substring(word, F.lit(1), at), F.lit(" "), F.substring(word, at + 1, F.length(word))),
    ).otherwise(word)


def transliteration_variant(word: Column, choice: Column) -> Column:
    """Another spelling of a known transliterated word."""
    low = F.lower(word)
    out = F
    for key, variants in fixed.SPELLING_VARIANTS.items():
        out = out.when(low == key, pick(variants, choice))
    return out.otherwise(word)


def schwa_deletion(word: Column) -> Column:
    """Words over four characters lose their first interior 'a'."""
    inner = F.substring(word, F.lit(2), F.length(word) - 2)
    at = F.instr(inner, F.lit("a")) + 1
    return F.when(
        (F.length(word) > 4) & (F.instr(inner, F.lit("a")) > 0),
        F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, F.length(word))),
    ).otherwise(word)


def delete_function_word(words: Column, choice: Column) -> Column:
    """Drop one of the function words of a token array, if it has any."""
    spots = F.filter(
        F.transform(words, lambda w, i: F.when(F.lower(w).isin(fixed.FUNCTION_WORDS), i)), lambda i: i.isNotNull()
    )
    return let(
        spots,
        lambda found: F.when(F.size(found) == 0, words).otherwise(
            let(
                F.get(found, (choice % F.size(found)).cast("int")),
                lambda gone: F.filter(words, lambda w, i: i != gone),
            )
        ),
    )


def insert_filler(words: Column, choice: Column, position: Column) -> Column:
    """Put one filler at any of the n + 1 gaps of a token array."""
    at = (position % (F.size(words) + 1)).cast("int") + 1
    return F.array_insert(words, at, pick(fixed.FILLERS, choice))


def per_level(level: Column, limits: dict[str, int]) -> Column:
    """The level's limit; an unknown level has no noise."""
    out = F
    for name, value in limits.items():
        out = out.when(level == name, F.lit(value).cast("bigint"))
    return out.otherwise(F.lit(0).cast("bigint"))


def token_limits() -> list[int]:
    """Cumulative draw limits of the token error mix, in its order."""
    total, limits = 0.0, []
    for share in fixed.TOKEN_ERROR_MIX.values():
        total += share
        limits.append(threshold(round(total, 6)))
    return limits


def _keyed(text: Column, prefix: Column) -> Column:
    return F.transform(tokens(text), lambda w, i: F.struct(w.alias("w"), digest_at(prefix, i).alias("d")))


def keyed_words(text: Column, key: list) -> Column:
    """Array of (w, d): every token with the digest of the key and its position."""
    return let(key_prefix(*key), lambda prefix: _keyed(text, prefix))


def map_words(text: Column, key: list, change: Callable[[Column, Column], Column]) -> Column:
    """Apply ``change(word, digest)`` to every token and join by single spaces."""
    return F.array_join(F.transform(keyed_words(text, key), lambda s: change(s["w"], s["d"])), " ")


#: Words or digests that are handled at once, whatever the length of the texts but the longest.
AT_ONCE = 1 << 18


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Rows from and to, of about AT_ONCE in ``sizes`` together."""
    begin = held = 0
    for k, size in enumerate(sizes):
        held += size
        if held >= AT_ONCE:
            yield begin, k + 1
            begin, held = k + 1, 0
    if begin < len(sizes):
        yield begin, len(sizes)


_FUNCTION_WORDS = frozenset(fixed.FUNCTION_WORDS)


def corrupted(word: str, op: int, choice: int, position: int, limits: list[int]) -> str | None:
    """A hit token after its error, None if it is deleted; equal to the column operators of the same names."""
    if op < limits[0]:
        low = word.lower()
        for old, *targets in fixed.CHARACTER_CONFUSIONS:
            if old in low:
                return low.replace(old, targets[choice % len(targets)], 1)
        if len(word) <= 2:
            return word
        at = position % len(word)
        return word[:at] + fixed.OVERWRITE_LETTERS[choice % len(fixed.OVERWRITE_LETTERS)] + word[at + 1 :]
    if op < limits[1]:
        if len(word) <= 4:
            return word
        at = position % (len(word) - 3) + 2
        return f"{word[:at]} {word[at:]}"
    if op < limits[2]:
        return None if word.lower() in _FUNCTION_WORDS else word
    if op < limits[3]:
        return f"{word} {fixed.FILLERS[choice % len(fixed.FILLERS)]}"
    variants = fixed.SPELLING_VARIANTS.get(word.lower())
    return variants[choice % len(variants)] if variants else word


@F.pandas_udf(T.StringType())
def _token_udf(text: pd.Series, prefix: pd.Series, limit: pd.Series) -> pd.Series:
    out, texts, prefixes, bounds = text.tolist(), text.tolist(), prefix.tolist(), limit.to_numpy(np.int64)
    limits = token_limits()[:4]
    for begin, end in _groups([len(t or "") // 6 + 1 for t in texts]):
        # The whitespace on which str.split breaks is that of quaver.functions.text.SPACES.
        split = [t.split() if t else [] for t in texts[begin:end]]
        counts = np.fromiter(map(len, split), np.int64, end - begin)
        words: list[str | None] = list(chain.from_iterable(split))
        draws = quarters_at([p.encode() for p in prefixes[begin:end]], counts)
        hit = np.flatnonzero(draws[:, 0] < np.repeat(bounds[begin:end], counts))
        for k, op, choice, position in zip(hit.tolist(), *draws[hit, 1:].T.tolist()):
            words[k] = corrupted(words[k], op, choice, position, limits)
        at = 0
        for k, n in enumerate(counts.tolist(), begin):
            if n:
                out[k] = " ".join([w for w in words[at : at + n] if w is not None])
                at += n
    return pd.Series(out, dtype=object)


def token_noise(text, level, row_id, seed: int = fixed.SEED, rates: dict[str, float] | None = None) -> Column:
    """Corrupt each token with the level's probability by one weighted error.

    Tokens' draws are made side by side in Arrow batches; the key's prefix and the limit come from Spark, a row each.
    """
    text, level, row_id = (c if isinstance(c, Column) else F.col(c) for c in (text, level, row_id))
    hit_below = per_level(level, {k: threshold(v) for k, v in (rates or fixed.TOKEN_RATES).items()})
    return _token_udf(text, key_prefix(seed, level, row_id), hit_below)


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@F.pandas_udf(T.StringType())
def _char_udf(text: pd.Series, prefix: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    out, texts, prefixes = text.tolist(), text.tolist(), prefix.tolist()
    cuts = np.array([x.to_numpy(np.int64) for x in (a, b, c, d)])
    letters = np.frombuffer(LETTERS.encode("utf-32-le"), "<u4")
    for begin, end in _groups([len(t or "") // 4 + 1 for t in texts]):
        n = np.array([len(t or "") for t in texts[begin:end]])
        blocks = (n + 3) // 4
        draws = quarters_at([p.encode() for p in prefixes[begin:end]], blocks).ravel()
        chars = np.frombuffer("".join(t or "" for t in texts[begin:end]).encode("utf-32-le"), "<u4").copy()
        first = np.cumsum(n) - n
        u = draws[np.arange(len(chars)) + np.repeat(4 * (np.cumsum(blocks) - blocks) - first, n)]
        hit = np.flatnonzero(u < np.repeat(cuts[3, begin:end], n))
        own, (one, two, three) = u[hit].astype(np.int64), cuts[:3, begin + np.searchsorted(first + n, hit, "right")]
        letter = letters[own % len(LETTERS)]
        swap, add, gone = own < one, (own >= one) & (own < two), (own >= two) & (own < three)
        chars[hit[swap]] = letter[swap]
        copies = np.ones(len(chars), np.int64)
        copies[hit] = np.where(swap, 1, np.where(gone, 0, 2))
        ends = np.cumsum(copies)
        made = np.repeat(chars, copies)
        twice = ~swap & ~gone
        made[ends[hit[twice]] - 1] = np.where(add, letter, ord(" "))[twice]
        at = 0
        for k, stop in zip(np.flatnonzero(n).tolist(), ends[(first + n)[n > 0] - 1].tolist()):
            out[begin + k] = made[at:stop].tobytes().decode("utf-32-le")
            at = stop
    return pd.Series(out, dtype=object)


def char_noise(text, level, row_id, seed: int = fixed.SEED, rates: dict[str, float] | None = None) -> Column:
    """Substitute, insert, delete or split after each character, each with p/4.

    One digest serves four characters, 32 bits each; the low bits pick the letter. Draws are made as in :func:`token_noise`.
    """
    text, level, row_id = (c if isinstance(c, Column) else F.col(c) for c in (text, level, row_id))
    rates = rates or fixed.CHARACTER_RATES
    cut = [per_level(level, {k: int(v * n / 4 * RANGE) for k, v in rates.items()}) for n in (1, 2, 3, 4)]
    return _char_udf(text, key_prefix(seed, level, row_id, "c"), *cut)
