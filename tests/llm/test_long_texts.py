"""Time of the local parsers on long texts made to be read again and again."""

import random
import time

import pytest

from quaver.llm.pii import find_spans

HARD = ["token" * 200_000, "token-" * 100_000, "://" * 200_000, "a@" * 200_000, "x@" + "a." * 200_000, "1." * 200_000, "+1" * 200_000, "1 " * 200_000, "iban:" * 100_000, "iban: " * 100_000]


@pytest.mark.parametrize("text", HARD, ids=lambda t: t[:6])
def test_linear(text):
    began = time.process_time()
    find_spans(text)
    # Two thirds of a second here on the slowest; a quadratic reader takes hours.
    assert time.process_time() - began < 10


def test_an_account_needs_a_joining_character():
    assert [s[0] for s in find_spans("token: ab1234cd9")] == ["account"]
    assert find_spans("tokenab1234cd9") == [] and find_spans("token" * 50 + ": ab1234cd9")[0][0] == "account"


def test_repeated_strings_in_several_groups_of_long_texts(spark):
    from quaver.llm.suffix_dedup import later_bytes

    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghijklmnop ", k=700_000)) for _ in range(4)]
    rows = [(i, t if i == 0 else t[:1000] + str(i) + texts[0][5000:5300] + str(i) + t[1000:]) for i, t in enumerate(texts)]
    found = later_bytes(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").coalesce(1)).collect()
    assert {r.doc_id: [(s.start, s.end) for s in r.spans] for r in found} == {0: [], **{i: [(1001, 1301)] for i in (1, 2, 3)}}
