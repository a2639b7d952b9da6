"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, plus signs, schemes, digits and identifier cues. At each anchor
a small deterministic parser expands to both sides, checks the boundaries and validates. Matches of a
kind never overlap; a candidate that fails its validation still uses up its characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The base kinds, in the order in which digests list them; the rest are found by cues.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "userinfo")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
#: Words after which an identifier is expected.
CUES = ("account", "acct", "iban", "ssn", "passport", "user id", "customer id", "token", "api_key", "api key", "password")

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LABEL = _DIGITS | _LETTERS | {"-"}
_LOCAL = _LABEL | set("._%+")
_DIAL = _DIGITS | set(" ().-")
_GLUE = frozenset(" \t:=#\"'.")
_USERINFO = _LOCAL | set(":!$&*~")


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for mark in ("@", "+", "://", *_DIGITS):
        found.add_word(mark, (mark if mark not in _DIGITS else "0", 1))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that begins at ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Around the at-sign at ``at``: local part back to ``floor`` at most, then labels and dots."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == ".":
        after = _run(text, end + 1, _LABEL)
        if after == end + 1:
            break
        end, dots = after, dots + 1
    return (start, end) if dots else None


def _ip(text: str, at: int) -> tuple[int, bool]:
    """From a digit: end of what is used up, and whether it is an address."""
    end = first = _run(text, at, _DIGITS)
    parts = [text[at:end]]
    while len(parts) < 4 and end < len(text) and text[end] == ".":
        after = _run(text, end + 1, _DIGITS)
        if after == end + 1:
            break
        parts.append(text[end + 1 : after])
        end = after
    if len(parts) < 4:
        return first, False
    return end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _card(text: str, at: int) -> tuple[int, bool]:
    """From a digit: digits with single blanks or hyphens between them."""
    end, n, digits = at + 1, len(text), [text[at]]
    while end < n:
        if text[end] in _DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in _CARD_GLUE and end + 1 < n and text[end + 1] in _DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    return end, 13 <= len(digits) <= 19 and luhn("".join(digits))


#: ``[\x20-]``: blank and hyphen.
_CARD_GLUE = frozenset(" -")


def _phone(text: str, at: int) -> tuple[int, bool] | None:
    """From a plus sign; None if it begins nothing."""
    if at + 1 >= len(text) or text[at + 1] not in _DIGITS:
        return None
    end = _run(text, at + 2, _DIAL)
    while end > at + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end <= at + 3:
        return None
    return end, 9 <= sum(c in _DIGITS for c in text[at:end]) <= 15


def _account(text: str, at: int) -> tuple[int, int] | None:
    """After a cue: at most six joining characters, then an identifier with four digits or more."""
    start = at
    while start < len(text) and start < at + 6 and text[start] in _GLUE:
        start += 1
    # Without a joining character the label goes on, maybe very far: nothing is read again for each cue in it.
    if start == at:
        return None
    end = _run(text, start, _LABEL)
    digits = sum(c in _DIGITS for c in text[start:end])
    return (start, end) if end - start >= 6 and digits >= 4 else None


def _userinfo(text: str, at: int) -> tuple[int, int] | None:
    """After a scheme: what stands before an at-sign."""
    end = _run(text, at, _USERINFO)
    return (at, end) if end > at and end < len(text) and text[end] == "@" else None


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind in the order of ``KINDS``, then start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    used = dict.fromkeys(KINDS, 0)
    for last, (mark, size) in _automaton().iter(text):
        if mark == "0":
            if last >= used["ip"] and not (last > used["ip"] and text[last - 1] in _DIGITS):
                end, valid = _ip(text, last)
                used["ip"] = max(end, last + 1)
                if valid:
                    found["ip"].append((last, end))
            if last >= used["card"]:
                end, valid = _card(text, last)
                used["card"] = end
                if valid:
                    found["card"].append((last, end))
        elif mark == "@":
            if span := _email(text, last, used["email"]):
                found["email"].append(span)
                used["email"] = span[1]
        elif mark == "+":
            if last >= used["phone"] and (dial := _phone(text, last)):
                used["phone"] = dial[0]
                if dial[1]:
                    found["phone"].append((last, dial[0]))
        elif mark == "://":
            if span := _userinfo(text, last + 1):
                found["userinfo"].append(span)
        elif last + 1 >= used["account"] and (span := _account(text, last + 1)):
            found["account"].append(span)
            used["account"] = span[1]
    return [(kind, a, b) for kind in KINDS for a, b in found[kind]]


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each run of spans replaced by the kind that begins first."""
    if not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame, text: str = "text", mask: bool = True) -> DataFrame:
    """``docs`` with ``pii_spans`` (kind, start, end in code points) and, if ``mask``, the text
    with its spans replaced by their kinds in ``pii_masked``.

    Null and empty texts have no spans; whole texts are read in one linear pass, whatever their
    length. Rows, repeated ones too, and other columns are kept; columns of those two names are
    replaced. No shuffle.
    """
    kept = [c for c in docs.columns if c not in ("pii_spans", "pii_masked")]
    docs = docs.select(*kept)
    place, names = kept.index(text), [*kept, "pii_spans", *["pii_masked"] * mask]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            spans = [find_spans(t) for t in texts]
            rows = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            columns = [*batch.columns, pa.array(rows, kind)]
            if mask:
                columns.append(pa.array([masked(t, s) for t, s in zip(texts, spans, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    added = [T.StructField("pii_spans", SPANS), *[T.StructField("pii_masked", T.StringType())] * mask]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def span_list(spans, base_only: bool = False):
    """``kind:start:end``, comma-joined, as a column expression."""
    if base_only:
        spans = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def kind_count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
