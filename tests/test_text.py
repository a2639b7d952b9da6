import pytest
from pyspark.sql import functions as F

from quaver.functions import fixed
from quaver.functions import text as X
from quaver.operators.tfidf import term_counts, tfidf


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("Hi @you_2 see https://a.b/c?d NOW!!", "hi see now"),
        ("a\tb c d", "a b c d"),
        ("ok \U0001f600‍\U0001f525 go", "ok go"),
        ("#Tag, it's", "tag its"),
        ("", ""),
    ],
)
def test_clean_text(one, raw, clean):
    assert one(X.clean_text("text"), raw) == clean


def test_remove_hashtag(one):
    assert one(X.remove_hashtag("text"), "one #two three #four five") == "   "
    assert one(X.remove_hashtag("text"), "plain\n#x y") == " \n  "


@pytest.mark.parametrize(
    "raw, kind",
    [
        ("1392749481536286721", "numeric_id"),
        ("13971018 27116703744", "digits_and_spaces"),
        ("13s0940892903608321", "one_letter_in_digits"),
        ("1.39E+21", "scientific_notation"),
        ("#NAME?", "formula_error"),
        ("1392749481536286721 umm", "id_and_filler"),
        ("v   ⇒", "arrow_artifact"),
        ("_… nan", "nan_artifact"),
        ("yadav88", "name_fragment"),
        ("a77 pak", "name_fragment"),
        ("real text​", None),
        ("yadav88 said a longer thing", None),
    ],
)
def test_junk_class(one, raw, kind):
    assert one(X.junk_class("text"), raw) == kind


def test_zero_width_is_stripped_not_dropped(one):
    assert one(X.strip_zero_width("text"), "real​ text") == "real text"


def test_mojibake_repair(one):
    broken = "a â€” b â†’ c� â\u0080\u0094"
    assert one(X.repair_mojibake("text"), broken) == "a — b → c —"
    assert one(X.count_mojibake("text"), broken) == 4
    assert one(X.has_mojibake(X.repair_mojibake("text")), broken) is False


def test_list_literal(one):
    assert one(X.list_literal_text("text"), "['a', 'b', 'c']") == "a b c"


def test_character_ids(one):
    ids = one(X.character_ids("text", 8), "aZ9\n\tß")
    pad, unknown = len(fixed.ENCODER_ALPHABET), len(fixed.ENCODER_ALPHABET) + 1
    assert ids == [1, 52, 62, 76, 77, unknown, pad, pad]
    assert len(one(X.character_ids("text"), "x" * 500)) == 300
    assert one(X.attention_mask(F.array(F.lit(0), F.lit(7)))) == [0, 1]


def test_word_ngrams(one):
    assert one(X.word_ngrams("text"), "a") == [" a", "a ", " a "]
    assert one(X.word_ngrams("text"), "Ab") == [" a", "ab", "b ", " ab", "ab ", " ab "]
    assert one(X.word_ngrams("text"), " ") == []


def test_term_counts_agree_with_word_ngrams(rows):
    df = rows([(1, "aa aa bcd a"), (2, "bcd")], "row_id BIGINT, text STRING")
    direct = df.select("row_id", F.explode(X.word_ngrams("text")).alias("term")).groupBy("row_id", "term").count()
    assert {tuple(r) for r in term_counts(df, "row_id").collect()} == {tuple(r) for r in direct.collect()}


def test_tfidf_rows_have_unit_length(rows):
    df = rows([(1, "aa bb"), (2, "bb cc")], "row_id BIGINT, text STRING")
    lengths = tfidf(df, "row_id").groupBy("row_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert [round(r.s, 9) for r in lengths] == [1.0, 1.0]


def test_context_weights(rows):
    df = rows([("the red cat", ["the dog", "red cat sat"])], "text STRING, parts ARRAY<STRING>")
    weights = X.context_weights("text", "parts", ["the"])
    got = df.select(weights.alias("w"), X.normalised(weights).alias("n")).first()
    assert got.w == [0.001, 2.0]
    assert sum(got.n) == pytest.approx(1.0)


def test_set_cosine_of_empty_set_is_null(one):
    empty = X.keywords(F.lit(""), ["the"])
    assert one(X.set_cosine(empty, empty)) is None
    assert one(X.set_cosine(X.keywords(F.lit("a b"), ["x"]), X.keywords(F.lit("b c"), ["x"]))) == pytest.approx(0.5)


def test_token_features(one):
    features = X.token_features("text")
    assert one(features["scaled_length"], "hello") == pytest.approx(0.25)
    assert one(features["letter_variety"], "hello") == pytest.approx(0.8)
    assert one(features["sound_bucket"], "12") == one(features["sound_bucket"], "3x")


def test_lexical_features(one):
    f = X.lexical_features("text", ["bad"])
    text = "Bad DAY bad day! Why? http://x.y"
    got = {k: one(c, text) for k, c in f.items()}
    assert (got["num_words"], got["num_unique_words"], got["bad_word_count"]) == (6, 6, 2)
    assert (got["capitals"], got["exclamations"], got["question_marks"], got["num_urls"]) == (5, 1, 1, 1)


def test_ngrams_are_counted_in_bounded_groups(rows, monkeypatch):
    """Repeated and null ids, rare letters and many groups against a plain count; no n-gram is grouped, sorted or shuffled by Spark."""
    from collections import Counter

    from quaver.operators import tfidf as T

    monkeypatch.setattr(T, "HELD_LETTERS", 8)
    texts = [(1, "Ab ab cd"), (1, "ab x"), (None, "q"), (None, "q qq"), (2, None), (3, " \t"), (4, "a\0 \U0001f600一" + "b" * 30)]
    wanted = Counter()
    for key, text in texts:
        for word in (text or "").lower().split():
            p = f" {word} "
            wanted.update((key, p[i : i + k]) for k in (2, 3, 4) for i in range(len(p) - k + 1))
    df = rows(texts, "row_id BIGINT, text STRING")
    counts, weights = term_counts(df, "row_id"), tfidf(df, "row_id")
    for made in (counts, weights):
        text = made._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in text and "Window" not in text and text.count("Exchange") == 1
    assert {(r.row_id, r.term): r.tf for r in counts.collect()} == wanted
    assert {(r.row_id, r.term) for r in weights.collect()} == set(wanted)


def test_ngrams_of_many_letters():
    from collections import Counter

    from quaver.operators.tfidf import _grams

    word = "".join(map(chr, range(0x4E00, 0x4E00 + 40000)))
    row, gram, tf, names = _grams([Counter({word: 3}), Counter({"ab": 1 << 40})], 2, 4)
    got = {(r, names[g]): n for r, g, n in zip(row.tolist(), gram.tolist(), tf.tolist(), strict=True)}
    p = f" {word} "
    assert got == {(0, p[i : i + k]): 3 for k in (2, 3, 4) for i in range(len(p) - k + 1)} | {(1, t): 1 << 40 for t in (" a", "ab", "b ", " ab", "ab ", " ab ")}
