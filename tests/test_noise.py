import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaver.functions import fixed
from quaver.functions import noise as N
from quaver.functions.draws import quarters_at
from quaver.functions.text import NOT_BLANK
from quaver.operators.splits import noise_levels

def word():
    return F.col("text")


def n(value):
    """A draw."""
    return F.lit(value).cast("bigint")


@pytest.mark.parametrize("old, first, second", fixed.CHARACTER_CONFUSIONS)
def test_every_confusion(one, old, first, second):
    # An earlier key may be contained in a later one; the earlier wins.
    winner = next(c for c in fixed.CHARACTER_CONFUSIONS if c[0] in old)
    got = {one(N.char_substitution(word(), n(k), n(0)), "Q" + old.upper()) for k in (0, 1)}
    assert got == {("q" + old).replace(winner[0], t, 1) for t in winner[1:]}
    if winner[0] == old:
        assert winner[1:] == (first, second)


def test_char_substitution_fallback(one):
    assert one(N.char_substitution(word(), n(7), n(1)), "Bed") == "Bmd"
    assert one(N.char_substitution(word(), n(7), n(0)), "be") == "be"


@pytest.mark.parametrize("text, point, out", [("abcde", 0, "ab cde"), ("abcde", 1, "abc de"), ("abcd", 3, "abcd"), ("abcdef", 2, "abcd ef")])
def test_word_split(one, text, point, out):
    assert one(N.word_split(word(), n(point)), text) == out


@pytest.mark.parametrize("text, out", [("prakar", "prkar"), ("again", "agin"), ("abcd", "abcd"), ("hello", "hello"), ("apple", "apple"), ("banana", "bnana")])
def test_schwa_deletion(one, text, out):
    assert one(N.schwa_deletion(word()), text) == out


@pytest.mark.parametrize("key", fixed.SPELLING_VARIANTS)
def test_transliteration(one, key):
    variants = fixed.SPELLING_VARIANTS[key]
    got = [one(N.transliteration_variant(word(), n(i)), key.upper()) for i in range(len(variants))]
    assert got == variants
    assert one(N.transliteration_variant(word(), n(0)), "other") == "other"


def test_list_level_operators(spark):
    words = F.array(*[F.lit(w) for w in ("go", "The", "shop", "ka")])
    run = lambda c: spark.range(1).select(c).first()[0]
    assert run(N.delete_function_word(words, n(0))) == ["go", "shop", "ka"]
    assert run(N.delete_function_word(words, n(1))) == ["go", "The", "shop"]
    assert run(N.delete_function_word(F.array(F.lit("go")), n(0))) == ["go"]
    assert run(N.insert_filler(words, n(0), n(4))) == ["go", "The", "shop", "ka", "umm"]
    assert run(N.insert_filler(words, n(0), n(0)))[0] == "umm"


@pytest.fixture(scope="module")
def long_text(spark):
    words = ["lorem", "the", "kya", "vase", "ok", "shadow", "nahi", "is", "quick", "brown"]
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.element_at(F.array(*map(F.lit, words)), (i % 10 + 1).cast("int"))), " ")
    return spark.range(50).select(F.col("id").alias("row_id"), text.alias("text"))


def test_zero_rate_is_identity(long_text):
    noisy = N.token_noise("text", F.lit("low"), "row_id", rates={"low": 0.0})
    assert long_text.filter(noisy != F.col("text")).count() == 0
    noisy = N.char_noise("text", F.lit("low"), "row_id", rates={"low": 0.0})
    assert long_text.filter(noisy != F.col("text")).count() == 0


@pytest.mark.parametrize("level", list(fixed.TOKEN_RATES))
def test_token_rate_and_mix(long_text, level):
    rate = fixed.TOKEN_RATES[level]
    draws = long_text.select(F.explode(N.keyed_words(F.col("text"), [fixed.SEED, F.lit(level), F.col("row_id")])).alias("s"))
    total = draws.count()
    hit = draws.filter(N.quarter(F.col("s.d"), 0) < N.threshold(rate))
    k = hit.count()
    assert abs(k - total * rate) <= 4 * math.sqrt(total * rate * (1 - rate))
    limits = [0, *N.token_limits()]
    for i, share in enumerate(fixed.TOKEN_ERROR_MIX.values()):
        op = N.quarter(F.col("s.d"), 1)
        got = hit.filter((op >= limits[i]) & (op < limits[i + 1])).count()
        assert abs(got - k * share) <= 4 * math.sqrt(k * share * (1 - share))


@pytest.mark.parametrize("level", list(fixed.CHARACTER_RATES))
def test_char_noise_keeps_length_on_average(long_text, level):
    p = fixed.CHARACTER_RATES[level]
    sums = long_text.select(
        F.sum(F.length("text")).alias("before"), F.sum(F.length(N.char_noise("text", F.lit(level), "row_id"))).alias("after")
    ).first()
    # Insert and split add p/4 each, delete takes p/4.
    grown = sums.after - sums.before
    assert abs(grown - sums.before * p / 4) <= 5 * math.sqrt(sums.before * p)


def test_noise_does_not_depend_on_partitioning(long_text):
    same = [{tuple(r) for r in noise_levels(long_text.repartition(p), "row_id").collect()} for p in (1, 17)]
    assert same[0] == same[1]


def test_blank_text_is_unchanged(rows):
    df = rows([(1, ""), (2, " \t "), (3, None)], "row_id BIGINT, text STRING")
    out = {r.row_id: r.text for r in noise_levels(df, "row_id", levels=("high",)).collect()}
    assert out == {1: "", 2: " \t ", 3: None}


def test_pieces_join_by_single_spaces(rows):
    df = rows([(i, "some  longer\nsentence with the words") for i in range(200)], "row_id BIGINT, text STRING")
    assert noise_levels(df, "row_id").filter(F.col("text").rlike(r"\s\s|\n|^\s|\s$")).count() == 0


def test_draws_side_by_side_equal_md5():
    prefixes = [b"42|high|7|", b"", "42|ü|ç|".encode(), b"x" * 45, b"x" * 53, b"x" * 90, b"unused"]
    counts = np.array([1203, 1, 30, 12, 120, 11, 0])
    plain = [hashlib.md5(p + b"%d" % i).hexdigest() for p, n in zip(prefixes, counts) for i in range(n)]
    assert [[f"{q:08x}" for q in row] for row in quarters_at(prefixes, counts).tolist()] == [[d[k : k + 8] for k in (0, 8, 16, 24)] for d in plain]


def test_hit_tokens_equal_the_column_operators(spark, monkeypatch):
    words = ["The", "is", "shadow", "KYA", "naHi", "Straße", "İxyİ", "ΟΔΟΣ", "ΣΑΣ", "\U0001f600ab\U0001f600de", "ab", "oo", "KelvinK", "phthisis", "ábcd", "zz\0z"]
    text = " ".join(words * 60)
    df = spark.createDataFrame([(1, text, "high"), (None, text, "all"), (3, " \n", "all"), (4, text, None), (5, "one", "all")], "row_id BIGINT, text STRING, level STRING")
    limits = N.token_limits()
    key = [fixed.SEED, F.col("level"), F.col("row_id")]

    def plain(w, d):
        op, choice, position = N.quarter(d, 1), N.quarter(d, 2), N.quarter(d, 3)
        changed = (
            F.when(op < limits[0], N.char_substitution(w, choice, position))
            .when(op < limits[1], N.word_split(w, position))
            .when(op < limits[2], F.when(~F.lower(w).isin(fixed.FUNCTION_WORDS), w))
            .when(op < limits[3], F.concat(w, F.lit(" "), N.pick(fixed.FILLERS, choice)))
            .otherwise(N.transliteration_variant(w, choice))
        )
        rate = F.when(F.col("level") == "all", N.threshold(1.0)).when(F.col("level") == "high", N.threshold(0.35)).otherwise(0)
        return F.when(N.quarter(d, 0) < rate, changed).otherwise(w)

    wanted = F.when(F.col("text").rlike(NOT_BLANK), N.map_words(F.col("text"), key, plain)).otherwise(F.col("text"))
    noisy = N.token_noise("text", "level", "row_id", rates={"high": 0.35, "all": 1.0})
    both = df.select("row_id", wanted.alias("a"), noisy.alias("b")).collect()
    assert [r.b for r in both] == [r.a for r in both]
    assert both[0].b != text
    # No digest is left to be interpreted for each token.
    assert "md5" not in df.select(noisy)._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(N, "AT_ONCE", 40)
    texts = pd.Series([text, None, "", text]), pd.Series(["42|a|", "42|b|", "42|c|", "42|d|"]), pd.Series([1 << 31] * 4)
    small = N._token_udf.func(*texts)
    monkeypatch.setattr(N, "AT_ONCE", 1 << 18)
    assert small.equals(N._token_udf.func(*texts))


def test_character_noise_equals_a_plain_one(spark):
    texts = ["", None, "abcde", "\U0001f600é x", "long " * 700]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row_id BIGINT, text STRING").coalesce(1)
    got = {r.row_id: r.n for r in df.select("row_id", N.char_noise("text", F.lit("high"), "row_id").alias("n")).collect()}
    cut = [int(fixed.CHARACTER_RATES["high"] * n / 4 * (1 << 32)) for n in (1, 2, 3, 4)]
    for i, text in enumerate(texts):
        out = []
        for at, c in enumerate(text or ""):
            u = int(hashlib.md5(f"42|high|{i}|c|{at // 4}".encode()).hexdigest()[at % 4 * 8 :][:8], 16)
            letter = N.LETTERS[u % 26]
            out.append(c if u >= cut[3] else letter if u < cut[0] else c + letter if u < cut[1] else "" if u < cut[2] else c + " ")
        assert got[i] == (None if text is None else "".join(out))
