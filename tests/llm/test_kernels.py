"""Parts that need no session: parsers, distances, sorts, windows, networks."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quaver.llm import common, decontamination, gru_lm, language_id, packing, pii, recompression, suffix_dedup, token_counts

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and pii.luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def by_pattern(text):
    return [(k, m.start(), m.end()) for k in pii.BASE for m in re.finditer(PATTERNS[k], text) if valid(k, m.group())]


@pytest.mark.parametrize("letters", ["a.@-1", "12.3", "+1 ()-.2a", "4 -1@.+", "a1.@+ -(2)é\n", "4111 1111-1111 1111 4"])
def test_spans_are_those_of_the_patterns(letters):
    rng = random.Random(3)
    for size in (4, 8, 20, 60):
        for _ in range(400):
            text = "".join(rng.choice(letters) for _ in range(size))
            assert [s for s in pii.find_spans(text) if s[0] in pii.BASE] == by_pattern(text)


def test_cues_and_userinfo():
    text = "Account: AB-12345 and https://ann:pw@host.org token = \"9b0b3c6a43eb\" account of mine"
    spans = {(k, text[a:b]) for k, a, b in pii.find_spans(text)}
    assert {("account", "AB-12345"), ("userinfo", "ann:pw"), ("account", "9b0b3c6a43eb")} <= spans
    assert pii.masked(text, pii.find_spans(text)).startswith("Account: [ACCOUNT] and https://")
    assert pii.find_spans(None) == pii.find_spans("") == [] and pii.masked(None, []) is None


def least_edits(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_distance():
    rng = random.Random(1)
    for _ in range(3000):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 20)))
        assert decontamination.myers(pattern, text, len(pattern))[0] == least_edits(pattern, text)


def test_pieces_find_every_occurrence_within_budget():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(25))) for i in range(12)]
    matcher = decontamination.Matcher(items, decontamination.EDIT_RATE, decontamination.LEAST_PIECE)
    for i, item in items:
        edits = decontamination.budget(len(item))
        assert edits > 0 and "".join(p for _, p in decontamination.pieces(item, edits)) == item
        for k in range(edits + 6):
            changed = list(item)
            for at in rng.sample(range(len(item)), k):
                changed[at] = "z"
            text = " ".join(rng.choice(words) for _ in range(30)) + " " + "".join(changed) + " tail"
            expected = {j: d for j, t in items if (d := least_edits(t, text)) <= decontamination.budget(len(t))}
            assert dict(matcher.matches(text)) == expected


def test_suffixes_and_prefixes():
    rng = random.Random(5)
    for _ in range(600):
        letters = rng.choice([b"ab", b"\0ab", b"a", b"abcdefgh"])
        text = bytes(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        order = suffix_dedup.suffix_order(np.frombuffer(text, np.uint8))
        assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))
        found = suffix_dedup.common_prefixes(np.frombuffer(text, np.uint8), order, 20)
        for k in range(1, len(text)):
            a, b = text[order[k] :], text[order[k - 1] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert found[k] == min(same, 20)
    assert len(suffix_dedup.suffix_order(np.zeros(0, np.uint8))) == 0


def test_equal_windows_have_equal_anchors():
    """Whatever stands around a window, and whatever runs it holds."""
    rng = random.Random(7)
    for trial in range(60):
        alphabet = rng.choice([2, 3, 50])
        middle = [rng.randrange(alphabet) for _ in range(60)]
        if trial % 3 == 0:
            middle[10:40] = [1] * 30
        seen = {}
        for _ in range(3):
            words = [rng.randrange(alphabet) for _ in range(rng.randrange(30))] + middle + [rng.randrange(alphabet) for _ in range(rng.randrange(30))]
            names = common.mixed(np.array(words, np.uint64))
            starts, anchor, _ = recompression.window_anchors(names, np.array([0]))
            for s, a in zip(starts.tolist(), anchor.tolist(), strict=True):
                assert seen.setdefault(tuple(words[s : s + recompression.WINDOW]), a) == a


def test_words_and_fingerprints():
    texts = ["a bc\td", "", None, "  x\x0b\x0cy\r\nz ", "é b"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    rows = []
    for _, _, data, offsets in common.text_groups(batch, "text", most=4):
        starts, ends, first = common.word_bounds(data, offsets)
        words = [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
        rows += [words[a:b] for a, b in zip(first, first[1:], strict=False)]
    assert rows == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    data = np.frombuffer(b"abcxabcyab", np.uint8)
    h = common.span_hashes(data, np.array([0, 4, 8, 0]), np.array([3, 7, 10, 2]))
    assert h[0] == h[1] and h[2] == h[3] and h[0] != h[2]


def test_packing_fills_and_shrinks_bins():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 4097, 500))[::-1]
    bins, offsets, sizes = packing.pack(lengths)
    for b in range(len(sizes)):
        own = np.flatnonzero(bins == b)
        ends = offsets[own] + lengths[own]
        assert sorted(offsets[own]) == sorted(np.concatenate([[0], np.sort(ends)[:-1]]))
        smaller = [c for c in packing.CAPACITIES if c < sizes[b]]
        assert ends.max() <= sizes[b] and all(c < ends.max() for c in smaller)
    assert lengths.sum() > 0.95 * sizes.sum()


def test_gradients_of_the_recurrent_network():
    rng = np.random.default_rng(0)
    net = gru_lm.Gru(3)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    x, y = rng.integers(0, gru_lm.SYMBOLS, (5, 3)), rng.integers(0, gru_lm.SYMBOLS, (5, 3))
    y[4, 2] = -1
    resets, state = rng.random((5, 3)) < 0.2, rng.normal(size=(3, gru_lm.HIDDEN))

    def loss():
        states, _ = net.steps(x, resets, state, net.embed @ net.inp + net.shift)
        return -net.log_probs(states[y >= 0].astype(np.float64), y[y >= 0])[0].mean()

    grads, _, _ = net.learn(x, y, resets, state)
    for name in net.NAMES:
        w, g = getattr(net, name), grads[name]
        at = int(np.abs(g).argmax())
        old, e = w.flat[at], 1e-3
        w.flat[at] = old + e
        up = loss()
        w.flat[at] = old - e
        down = loss()
        w.flat[at] = old
        assert (up - down) / (2 * e) == pytest.approx(float(g.flat[at]), rel=1e-3)


def test_lanes_and_windows_do_not_change_scores():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 90, 40)
    symbols = rng.integers(0, gru_lm.SYMBOLS, sizes.sum())
    net = gru_lm.Gru(5)
    one = [gru_lm.score_texts(net, s, np.array([len(s)]))[0] for s in np.split(symbols, np.cumsum(sizes)[:-1])]
    for lanes, window in ((1, 7), (8, 64), (64, 16)):
        assert gru_lm.score_texts(net, symbols, sizes, lanes, window) == pytest.approx(one, rel=1e-4)


def test_windows_cover_texts():
    texts = ["x" * 200, "ÀB", "12 34", ""]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    windows, owner = language_id.text_windows(np.frombuffer(data, np.uint8), offsets)
    assert owner.tolist() == [0, 0, 0, 0, 1]
    assert b"".join(w.tobytes() for w in windows[:4]).rstrip() == b"x" * 200
    assert windows[4].tobytes().rstrip().decode() == "àb"


def test_counting_by_parts():
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    whole, parts = Tokenizer.from_file(path), token_counts._counter(path)
    rng = random.Random(1)
    letters = list("aB.,'’!\n\t   ẖH̱İΣς1٣é\x0b\x1c-_²ªʰ") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s "]
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (3, 9, 30, 90) for _ in range(400)]
    assert parts(texts) == [len(whole.encode(t, add_special_tokens=False)) for t in texts]
