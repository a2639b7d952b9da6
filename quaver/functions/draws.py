"""Stateless random draws: every draw is a function of its key, so results do
not depend on partitioning, retries or task order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 32


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Each evaluation also walks the body's type, so keep it out of per-element
    lambdas with large bodies; chain ``transform`` over structs there.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digest(*parts) -> Column:
    """md5 of the parts joined by '|', 32 hex digits."""
    return F.md5(F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def key_prefix(*parts) -> Column:
    """The part of a digest's key that is the same for a whole row."""
    return F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts], F.lit(""))


def digest_at(prefix: Column, position: Column) -> Column:
    """Digest of the prefix's parts and a position."""
    return F.md5(F.concat(prefix, position.cast("string")))


def quarter(hexdigest: Column, k: int | Column) -> Column:
    """Quarter ``k`` (0..3) of a digest as an integer in [0, 2**32)."""
    start = k * F.lit(8) + F.lit(1) if isinstance(k, Column) else F.lit(8 * k + 1)
    return F.conv(F.substring(hexdigest, start, F.lit(8)), 16, 10).cast("bigint")


def threshold(probability: float) -> int:
    """Draws below this value happen with the given probability."""
    return int(probability * RANGE)


def pick(values: list[str], draw: Column) -> Column:
    """One of the literal values, chosen by the draw."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (draw % len(values) + 1).cast("int"))


#: Digests that are computed side by side, and the longest message of one md5 block.
_SIDE_BY_SIDE, _ONE_BLOCK = 8192, 55
_TURNS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2.0**32).astype(np.uint32)
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)


def _md5_blocks(m: np.ndarray) -> np.ndarray:
    """md5 of messages of one padded block each, given as 16 rows of little-endian words; four rows of words."""
    a, b, c, d = (np.full(m.shape[1], v, np.uint32) for v in _START)
    f = np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        f += a
        f += m[g]
        f += _SINES[i]
        np.left_shift(f, np.uint32(_TURNS[i]), out=a)
        f >>= np.uint32(32 - _TURNS[i])
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return np.stack([a, b, c, d]) + _START[:, None]


def quarters_at(prefixes: list[bytes], counts: np.ndarray) -> np.ndarray:
    """The quarters of :func:`digest_at` for positions 0 to ``counts`` - 1 of each prefix: (digests, 4) numbers below 2**32.

    Prefixes that leave no room for a position in one md5 block are digested one by one.
    """
    out = np.empty((int(counts.sum()), 4), np.uint32)
    first = np.cumsum(counts) - counts
    size = np.fromiter(map(len, prefixes), np.int64, len(prefixes))
    fits = size + np.char.str_len(np.maximum(counts, 1).astype(str)) <= _ONE_BLOCK
    for r in np.flatnonzero(~fits).tolist():
        joined = b"".join(hashlib.md5(prefixes[r] + b"%d" % i).digest() for i in range(int(counts[r])))
        out[first[r] : first[r] + counts[r]] = np.frombuffer(joined, ">u4").reshape(-1, 4)
    rows = np.flatnonzero(fits & (counts > 0))
    if not len(rows):
        return out
    base = np.frombuffer(b"".join(prefixes[r].ljust(64, b"\0") for r in rows.tolist()), np.uint8).reshape(-1, 64)
    ends = np.cumsum(counts[rows])
    for lo in range(0, int(ends[-1]), _SIDE_BY_SIDE):
        flat = np.arange(lo, min(lo + _SIDE_BY_SIDE, int(ends[-1])))
        owner = np.searchsorted(ends, flat, "right")
        place = flat - (ends - counts[rows])[owner]
        n = np.searchsorted(10 ** np.arange(1, 19), place, "right") + 1
        message, width, at = base[owner], size[rows][owner] + n, np.arange(len(flat))
        rest = place
        for k in range(int(n.max())):
            some = at if k == 0 else at[n > k]
            rest, digit = np.divmod(rest, 10)
            message[some, width[some] - 1 - k] = digit[some] + 48
        message[at, width] = 0x80
        words = np.ascontiguousarray(message.view("<u4").T).astype(np.uint32, copy=False)
        words[14] = width * 8
        out[first[rows][owner] + place] = _md5_blocks(words).T.byteswap()
    return out
