"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are reduced to lower-case letters and digits with single blanks. An item of m characters
may occur with at most k = floor(rate * m) edits. Cut into k + 1 pieces, any such occurrence holds at least one
piece unchanged; one Aho-Corasick pass finds all exact piece hits, and Myers' bit-parallel distance, on
the stretch of text around a hit, decides. Items are a query set: they go to the executors in blocks
of bounded size, and each block passes over all documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Edits per character of an item.
EDIT_RATE = 0.08
#: Shortest piece; items that would need shorter ones get a smaller edit budget.
LEAST_PIECE = 10
#: Characters of items that one pass over the documents takes.
BLOCK_CHARS = 2_000_000

_OTHER = re.compile(r"[\W_]+")


def reduced(text: str | None) -> str:
    """Lower-case letters and digits, one blank between runs."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def budget(length: int, rate: float = EDIT_RATE, least: int = LEAST_PIECE) -> int:
    return max(0, min(int(rate * length), length // least - 1))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces that cover the item, as (offset, piece)."""
    n, m = edits + 1, len(item)
    cuts = [m * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, most: int) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any substring of ``text`` and that substring's first possible end.

    Myers' bit vectors, one integer as wide as the pattern; ``(most + 1, -1)`` if above ``most``.
    """
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    masks = dict(masks)
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = most + 1, -1
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full  # a match may begin anywhere: no cost flows into row 0
        mh = (mh << 1) & full
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Matcher:
    """All items of a block: (item id, reduced text)."""

    def __init__(self, items: list[tuple[Any, str]], rate: float, least: int):
        import ahocorasick

        self.items = items
        self.edits = [budget(len(t), rate, least) for _, t in items]
        homes: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, t) in enumerate(items):
            for offset, piece in pieces(t, self.edits[i]):
                homes[piece].append((i, offset))
        self.machine = ahocorasick.Automaton()
        for piece, places in homes.items():
            self.machine.add_word(piece, (len(piece), places))
        self.machine.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int]]:
        """(item id, edits) of every item that occurs within its budget."""
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for last, (size, places) in self.machine.iter(text):
            for i, offset in places:
                begin, slack = last + 1 - size - offset, self.edits[i]
                spans[i].append((begin - slack, begin + len(self.items[i][1]) + slack))
        found = []
        for i, stretches in spans.items():
            name, item = self.items[i]
            best = self.edits[i] + 1
            for a, b in _merged(stretches):
                stretch = text[max(0, a) : b]
                best = min(best, 0 if item in stretch else myers(item, stretch, self.edits[i])[0])
                if best == 0:
                    break
            if best <= self.edits[i]:
                found.append((name, best))
        return found


def _merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@lru_cache(maxsize=2)
def _matcher(items: tuple[tuple[Any, str], ...], rate: float, least: int) -> Matcher:
    return Matcher(list(items), rate, least)


def _blocks(items: DataFrame, item_id: str, item_text: str, block_chars: int) -> Iterator[list[tuple[Any, str]]]:
    """Reduced items, a bounded number of characters at a time, but for the texts of one id, which stay together; one partition of them is held at once."""
    block, size, held = [], 0, set()
    rows = items.select(F.col(item_id), F.col(item_text)).where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull())
    for name, text in rows.orderBy(item_id, item_text).toLocalIterator():
        text = reduced(text)
        if block and block[-1][0] != name:
            held.clear()
            if size + len(text) > block_chars:
                yield block
                block, size = [], 0
        # Texts of an id that reduce alike match alike.
        if not text or text in held:
            continue
        held.add(text)
        block.append((name, text))
        size += len(text)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = EDIT_RATE, least: int = LEAST_PIECE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``key``, ``item_id``, ``edits``: one row per document and item that occurs in it within its budget.

    Null or empty texts match nothing, nor do null or empty items or items without letters and digits.
    Repeated document rows come back as often as they occur; repeated item ids give the best match of any of their
    texts, in one row. Very long texts are read whole, in one linear pass. Empty tables give no rows; columns of other names are not
    read, and ids of either side may be of any type that Arrow holds. No shuffle of documents.
    """
    spark = docs.sparkSession
    kind, name_kind = docs.schema[key].dataType.simpleString(), items.schema[item_id].dataType
    schema = f"`{key}` {kind}, item_id {name_kind.simpleString()}, edits BIGINT"
    arrow_name = to_arrow_type(name_kind)
    slim = docs.select(F.col(key), F.col(text)).where(F.col(text).isNotNull())
    result = spark.createDataFrame([], schema)
    for block in _blocks(items, item_id, item_text, block_chars):
        shared = spark.sparkContext.broadcast(tuple(block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(shared.value, rate, least)
            for batch in batches:
                rows, names, edits = [], [], []
                for row, value in enumerate(batch.column(1)):
                    best: dict[int, int] = {}
                    for name, distance in matcher.matches(reduced(value.as_py())):
                        best[name] = min(distance, best.get(name, distance))
                    rows += [row] * len(best)
                    names += best
                    edits += best.values()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(names, arrow_name), pa.array(edits, pa.int64())], [key, "item_id", "edits"])

        result = result.unionByName(slim.mapInArrow(run, schema))
    return result
