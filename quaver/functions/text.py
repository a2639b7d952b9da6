"""Text clean-up, junk detection, repair and encoding as column expressions.

Patterns use explicit character classes and no look-around, so that Java's and
RE2's dialects read them alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaver.functions import fixed
from quaver.functions.draws import let

# The characters on which a Unicode-aware whitespace split breaks.
SPACES = (
    r"\x{09}-\x{0d}\x{1c}-\x{1f}\x{20}\x{85}\x{a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE_RUN = f"[{SPACES}]+"
NOT_BLANK = f"[^{SPACES}]"
URL = f"https?://[^{SPACES}]+"
MENTION = "@[A-Za-z0-9_]+"
HASHTAG = r"[^\n]*?(#[\p{L}\p{N}_]+)|[^\n]+"
# One emoji: a flag, or a sign with its tone and joined signs.
_SIGN = (
    r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1F64F}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}"
    r"\x{1F7E0}-\x{1F7EB}\x{1F90C}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{2600}-\x{27BF}"
    r"\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{231A}\x{231B}\x{23E9}-\x{23F3}"
    r"\x{23F8}-\x{23FA}]"
)
_TONED = _SIGN + r"[\x{1F3FB}-\x{1F3FF}]?\x{FE0F}?"
EMOJI = (
    r"(?:[\x{1F1E6}-\x{1F1FF}][\x{1F1E6}-\x{1F1FF}]|" + _TONED + r"(?:\x{200D}" + _TONED + r")*|[0-9#*]\x{FE0F}?\x{20E3})"
)
ZERO_WIDTH = "\u200b"


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def tokens(text) -> Column:
    """Whitespace tokens, no empty strings."""
    return F.filter(F.split(_col(text), SPACE_RUN), lambda w: w != "")


def squeeze(text) -> Column:
    """Whitespace runs to single spaces, ends trimmed."""
    return F.btrim(F.regexp_replace(_col(text), SPACE_RUN, " "))


def strip_spaces(text) -> Column:
    """Trim all kinds of whitespace from both ends."""
    return F.regexp_replace(_col(text), f"^{SPACE_RUN}|{SPACE_RUN}$", "")


def remove_punctuation(text) -> Column:
    return F.translate(_col(text), fixed.PUNCTUATION, "")


def remove_url(text) -> Column:
    return F.regexp_replace(_col(text), URL, " ")


def remove_mention(text) -> Column:
    return F.regexp_replace(_col(text), MENTION, " ")


def remove_hashtag(text) -> Column:
    """Blank everything up to and including each tag, then the rest of the line."""
    return F.regexp_replace(_col(text), HASHTAG, " ")


def remove_emoji(text) -> Column:
    return F.regexp_replace(_col(text), EMOJI, " ")


def clean_text(text) -> Column:
    """Emoji, mentions, URLs and punctuation out; whitespace squeezed; lower case."""
    return F.lower(squeeze(remove_punctuation(remove_url(remove_mention(remove_emoji(text))))))


def list_literal_text(text) -> Column:
    """"['a', 'b']" to "a b"."""
    return F.translate(F.btrim(_col(text), F.lit("[]")), "',", "")


def longer_than(text, n: int) -> Column:
    return F.length(_col(text)) > n


# Junk classes in the order in which they are tried.
_S = f"[{SPACES}]"
JUNK = (
    ("numeric_id", r"^[0-9]{15,}$"),
    ("digits_and_spaces", f"^{_S}*[0-9][0-9{SPACES}]*$"),
    ("one_letter_in_digits", r"^([0-9]+[A-Za-z][0-9]*|[A-Za-z][0-9]+)$"),
    ("scientific_notation", r"^[0-9]+(\.[0-9]+)?[eE][+]?[0-9]+$"),
    ("formula_error", r"^#NAME\?$"),
    ("id_and_filler", f"^[0-9]{{15,}}{_S}+({'|'.join(fixed.FILLERS)})$"),
    ("arrow_artifact", f"^[A-Za-z]{{1,3}}{_S}*⇒$"),
    ("nan_artifact", f"…{_S}*nan$"),
    ("name_fragment", f"^[A-Za-z]+[0-9]+({_S}+[A-Za-z]{{1,3}})?$"),
)


def junk_class(text) -> Column:
    """First matching junk class after zero-width spaces are stripped, else null."""
    stripped = F.translate(_col(text), ZERO_WIDTH, "")
    out = None
    for name, pattern in JUNK:
        hit = stripped.rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def strip_zero_width(text) -> Column:
    return F.translate(_col(text), ZERO_WIDTH, "")


def repair_mojibake(text) -> Column:
    out = _col(text)
    for bad, good in fixed.MOJIBAKE:
        out = F.replace(out, F.lit(bad), F.lit(good))
    return out


def count_mojibake(text) -> Column:
    """Number of replacements :func:`repair_mojibake` makes."""
    return F.regexp_count(_col(text), F.lit("|".join(bad for bad, _ in fixed.MOJIBAKE)))


def has_mojibake(text) -> Column:
    return _col(text).rlike(f"[{fixed.MOJIBAKE_STARTS}]")


def character_ids(text, length: int = fixed.ENCODER_LENGTH) -> Column:
    """Alphabet positions of the first ``length`` characters, padded on the right."""
    alphabet = fixed.ENCODER_ALPHABET
    pad, unknown = len(alphabet), len(alphabet) + 1
    at = lambda c: F.instr(F.lit(alphabet), c)
    return pad_ids(
        F.transform(
            F.filter(F.split(F.substring(_col(text), 1, length), ""), lambda c: c != ""),
            lambda c: F.when(at(c) > 0, at(c) - 1).otherwise(unknown),
        ),
        length,
        pad,
    )


def pad_ids(ids, length: int, pad: int = 0) -> Column:
    """Cut or right-pad an id array to exactly ``length``."""
    ids = _col(ids)
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def attention_mask(ids, pad: int = 0) -> Column:
    return F.transform(_col(ids), lambda x: (x != pad).cast("int"))


def lexical_features(text, bad_words: list[str] | None = None) -> dict[str, Column]:
    """Surface counts used as extra feature columns."""
    t = _col(text)
    words = tokens(t)
    n = F.size(words)
    uniq = F.size(F.array_distinct(words))
    total = F.length(t)
    capitals = F.regexp_count(t, F.lit(r"\p{Lu}"))
    return {
        "num_words": n,
        "total_length": total,
        "num_unique_words": uniq,
        "words_vs_unique": F.when(n > 0, uniq / n).otherwise(F.lit(0.0)),
        "capitals": capitals,
        "caps_vs_length": F.when(total > 0, capitals / total).otherwise(F.lit(0.0)),
        "emoji": F.regexp_count(t, F.lit(EMOJI)),
        "num_urls": F.regexp_count(t, F.lit(URL)),
        "exclamations": F.regexp_count(t, F.lit("!")),
        "question_marks": F.regexp_count(t, F.lit(r"\?")),
        "bad_word_count": F.size(F.filter(words, lambda w: F.lower(w).isin(bad_words or ["__none__"]))),
    }


def word_ngrams(text, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside words padded by one space on each side.

    A padded word shorter than ``n`` yields no ``n``-gram beyond its own length.
    """
    grams = lambda w, n: F.transform(
        F.when(F.length(w) >= n, F.sequence(F.lit(1), F.length(w) - n + 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.substring(w, i, F.lit(n)),
    )
    padded = F.transform(tokens(F.lower(_col(text))), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.concat(*[grams(w, n) for n in range(low, high + 1)])))


def token_features(token) -> dict[str, Column]:
    """Sound code bucket, scaled length and letter variety of one token.

    The bucket comes from a stable digest, so it is the same in every process.
    """
    w = _col(token)
    code = F.when(w.rlike(r"^\p{L}+$"), F.soundex(w)).otherwise("0000")
    return {
        "sound_bucket": (F.conv(F.substring(F.md5(code), 1, 8), 16, 10).cast("bigint") % 1000) / 1000.0,
        "scaled_length": F.length(w) / 20.0,
        "letter_variety": F.size(F.array_distinct(F.filter(F.split(w, ""), lambda c: c != "")))
        / F.greatest(F.length(w), F.lit(1)),
    }


def keywords(text, stop_words: list[str]) -> Column:
    """Distinct word and punctuation tokens minus stop words."""
    found = F.regexp_extract_all(_col(text), F.lit(rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACES}]"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(s) for s in stop_words]).cast("array<string>"))


def overlap(left: Column, right: Column) -> Column:
    """Number of shared keywords of two keyword sets."""
    return F.size(F.array_intersect(left, right))


def token_union(left: Column, right: Column) -> Column:
    """Keywords of either set."""
    return F.array_union(left, right)


def set_cosine(left: Column, right: Column) -> Column:
    """|X and Y| / sqrt(|X| |Y|); null when either set is empty."""
    sizes = F.size(left) * F.size(right)
    return F.when(sizes > 0, overlap(left, right) / F.sqrt(sizes))


def context_weights(text, contexts, stop_words: list[str]) -> Column:
    """Keyword overlap of the text with each context part; 0 becomes 0.001."""
    return let(
        keywords(text, stop_words),
        lambda mine: F.transform(
            _col(contexts),
            lambda part: let(
                overlap(mine, keywords(part, stop_words)),
                lambda n: F.when(n == 0, F.lit(fixed.ZERO_OVERLAP)).otherwise(n.cast("double")),
            ),
        ),
    )


def normalised(weights) -> Column:
    """Weights divided by their sum."""
    return let(
        _col(weights),
        lambda ws: let(
            F.aggregate(ws, F.lit(0.0), lambda a, x: a + x),
            lambda total: F.transform(ws, lambda x: x / total),
        ),
    )
