"""Whole operators on small tables, against brute force: nulls, empty and long texts, copies, ties, clashing columns, empty tables."""

import hashlib
import importlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaver.llm import queries as Q

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, spans STRING, lang_pred STRING"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made():
    rng = random.Random(11)
    en = "the and of ing tion ther ering hat for shon".split()
    de = "der ung sch keit ver für ich ein zuß lich".split()

    def text(parts, n):
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."

    rows = [(text(en, rng.randint(20, 160)), "en") for _ in range(45)] + [(text(de, rng.randint(20, 160)), "de") for _ in range(25)]
    base = rows[0][0] + " " + text(en, 300)
    rows += [(base, "en"), (base, "en"), (base.replace(" the", " xe", 1), "en"), (base + " more", "en"), (base.upper(), None)]
    passage = text(en, 60)
    rows += [(text(en, 30) + " " + passage + " " + text(en, 20 + i), "en") for i in range(6)]
    rows += [("x " * 200, "en"), ("y x " + "x " * 70 + "z", "en"), ("=" * 350, None), ("ab" * 300, "en")]
    rows += [(None, "en"), ("", None), (" \t\n", "de"), ("12 34!", "en"), ("Hi", "en"), ("a\x0bb\x0cc", None), (text(en, 9000), "en")]
    rows += [(passage + " mail ann.b@host.example.org or +1 (017) 555-7713, 10.0.0.255, 4111 1111 1111 1111", "en")]
    docs = [(i, t, lang, "s", len(t or ""), "own", "own") for i, (t, lang) in enumerate(rows)]
    return docs


DOCS = made()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(DOCS, SCHEMA).repartition(5).write.parquet(str(root / "documents.parquet"))
    items = [(1, DOCS[3][1][:150]), (2, DOCS[7][1][10:160].upper().replace(" ", " | ")), (3, None), (4, ""), (5, "nowhere at all to be found in any of these texts, surely"), (6, "?!")]
    spark.createDataFrame(items, "item_id BIGINT, text STRING").write.parquet(str(root / "benchmark.parquet"))
    rng = np.random.default_rng(2)
    v = rng.normal(size=(150, 16))
    v[100:] = v[0] + rng.normal(size=(50, 16)) * 0.02
    v[90:95] = v[1] * 2
    v[95:98] = v[2] + rng.normal(size=(3, 16)) * 0.25
    vectors = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    vectors += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [], 0), (204, [1.0, None] * 8, 0), (205, [float("inf")] * 16, 0), (206, [1.0, 2.0], 0)]
    spark.createDataFrame(vectors, "vec_id BIGINT, embedding ARRAY<DOUBLE>, label INT").write.parquet(str(root / "embeddings.parquet"))
    return str(root)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([], "item_id BIGINT, text STRING").write.parquet(str(root / "benchmark.parquet"))
    spark.createDataFrame([], "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT").write.parquet(str(root / "embeddings.parquet"))
    spark.createDataFrame([], "doc_id BIGINT, quality INT, toxic INT").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([], "conv_id BIGINT, turn BIGINT, role STRING, text STRING").write.parquet(str(root / "conversations.parquet"))
    return str(root)


def by_id(df):
    rows = [r.asDict() for r in df.collect()]
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: r for r in rows}


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def held_out(i, modulus, remainder):
    return zlib.crc32(str(i).encode()) % modulus == remainder


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables(spark, empty, name):
    assert Q.QUERIES[name](spark, empty).count() == 0


def test_language(spark, folder):
    got = by_id(Q.op1_byte_cnn(spark, folder))
    assert len(got) == len(DOCS)
    known = 0
    for i, text, lang, *_ in DOCS:
        row = got[i]
        assert row["held_out"] == held_out(i, 3, 1) and 0 <= row["score"] <= 1
        assert (row["lang_pred"] == "und") == (not any(c.isalpha() for c in text or ""))
        known += lang is not None and row["held_out"] and i < 70 and row["lang_pred"] == lang
    assert known >= 0.9 * sum(held_out(i, 3, 1) for i in range(70))


def components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_vectors(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    unit = {}
    for r in rows:
        v = r.embedding
        if v and None not in v and np.isfinite(v).all() and any(v):
            unit[r.vec_id] = np.array(v) / np.linalg.norm(v)
    linked = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    n = Counter(x for pair in linked for x in pair)
    root = components([r.vec_id for r in rows], linked)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in Q.op2_nn_descent(spark, folder).collect()}
    assert got == {i: (n[i], root[i], root[i] == i) for i in root}


def near(size, percent):
    sets = {}
    for i, text, *_ in DOCS:
        w = WORD.findall(low(text))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, components(sets, linked)


def test_near_duplicates(spark, folder):
    sets, root = near(3, 85)
    got = by_id(Q.op3_lsh_forest(spark, folder))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}


def near_groups(spark, texts, size, percent):
    """Components by the operator and by brute force."""
    from quaver.llm.lsh_forest import near_duplicates

    sets = [{tuple(w[k : k + size]) for k in range(len(w) - size + 1)} for w in (t.split() for t in texts)]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING").repartition(3)
    return {r.doc_id: r.component_id for r in near_duplicates(rows, size=size, percent=percent).collect()}, components(range(len(texts)), linked)


def edited(rng, words, places):
    out = list(words)
    for at in places:
        out[at] = f"e{rng.random()}"
    return " ".join(out)


@pytest.mark.parametrize("rows", [512, 40])
def test_many_copies_link_to_one_original_only(spark, monkeypatch, rows):
    from quaver.llm import lsh_forest

    monkeypatch.setattr(lsh_forest, "BLOCK_ROWS", rows)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    spots = range(4, 396, 4)
    got, want = near_groups(spark, [edited(rng, words, rng.sample(spots, 10)) for _ in range(200)] + [" ".join(words)], 3, 85)
    assert set(want.values()) == {0}
    assert got == want


def test_benchmark_items(spark, folder):
    got = {(r.doc_id, r.item_id): r.edits for r in Q.op4_pigeonhole(spark, folder).collect()}
    assert got[(3, 1)] == 0 and got[(7, 2)] == 0 and {i for _, i in got} == {1, 2}


def test_benchmark_items_in_blocks(spark, folder):
    from quaver.llm.decontamination import contaminated

    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (sorted(map(tuple, contaminated(docs, items, block_chars=n).collect())) for n in (10**6, 1))
    assert one == many and one


def test_scores(spark, folder):
    tokens = {i: [*WORD.findall(low(t)), None] for i, t, *_ in DOCS}
    c = Counter(w for i, ws in tokens.items() if not held_out(i, 7, 2) for w in ws)
    n, v = sum(c.values()), len(c)
    got = by_id(Q.op5_gru_lm(spark, folder))
    for i, ws in tokens.items():
        row = got[i]
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (held_out(i, 7, 2), len(ws), sum(c[w] > 0 for w in ws), n)
        assert row["base_score"] == pytest.approx(base) and row["score"] < 0


def test_rare_counts_are_joined(spark, folder, monkeypatch):
    from quaver.llm import gru_lm

    whole = {i: (r["base_score"], r["n_known"]) for i, r in by_id(Q.op5_gru_lm(spark, folder)).items()}
    monkeypatch.setattr(gru_lm, "SHARED_WORDS", 5)
    few = {i: (r["base_score"], r["n_known"]) for i, r in by_id(Q.op5_gru_lm(spark, folder)).items()}
    assert all(few[i][0] == pytest.approx(whole[i][0]) and few[i][1] == whole[i][1] for i in whole)


def test_token_counts_and_their_cache(spark, folder, tmp_path):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    from quaver.llm.token_counts import token_counts

    model = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.unionByName(docs.limit(5)).withColumn("n_bytes", F.lit("own"))
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = token_counts(docs, path, cache).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(
            (r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or "", add_special_tokens=False))) for r in docs.collect()
        )
        stored = spark.read.parquet(cache)
        assert stored.count() == stored.distinct().count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_other_tokenizers(spark, tmp_path):
    files = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer

    from quaver.llm.token_counts import token_counts

    texts = [(1, "Some words, <|endoftext|> and  more\n\n"), (2, None), (3, "Äpfel ☃")]
    docs = spark.createDataFrame(texts, "doc_id BIGINT, text STRING")
    bpe, piece = Tokenizer.from_file(files.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=files.path("piece_bpe_32k.model"))
    for name, count in (("byte_bpe_50k.json", lambda t: len(bpe.encode(t, add_special_tokens=False))), ("piece_bpe_32k.model", lambda t: len(piece.encode(t)))):
        got = {r.doc_id: r.n_tokens for r in token_counts(docs, files.path(name), str(tmp_path / name)).collect()}
        assert got == {i: count(t or "") for i, t in texts}


def test_personal_data(spark, folder):
    from quaver.llm.pii import find_spans
    from tests.llm.test_kernels import by_pattern

    for i, row in by_id(Q.op7_pii_anchors(spark, folder)).items():
        base = by_pattern(DOCS[i][1] or "")
        assert [row[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert row["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in find_spans(DOCS[i][1]))
    assert row is not None and len(by_pattern(DOCS[-1][1])) == 4


def later_bytes(window=100):
    seen, out = set(), {}
    for i, text, *_ in DOCS:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            if data[p : p + window] in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(data[p : p + window])
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most_variants", [64, 1])
def test_byte_strings(spark, folder, monkeypatch, most_variants):
    """Runs of an anchor in suffix arrays, and, where there are too many, window by window."""
    module = importlib.import_module("quaver.llm.suffix_dedup")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = module.later_bytes(docs, most_variants=most_variants, array_bytes=2000)
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found.collect()}
    assert got == later_bytes()
    if most_variants > 1:
        query = {i: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i, r in by_id(Q.op8_suffix_array(spark, folder)).items()}
        assert query == got


def repeated_words(window=35):
    words = {i: WORD.findall(t or "") for i, t, *_ in DOCS}
    n = Counter(tuple(w[p : p + window]) for w in words.values() for p in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if n[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_word_windows(spark, folder):
    got = {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in by_id(Q.op9_recompression(spark, folder)).items()}
    assert got == repeated_words()


def test_long_texts_in_parts(spark, folder):
    """Texts longer than a part are cut with an overlap; the runs differ, the windows don't."""
    from quaver.llm.recompression import word_runs
    from quaver.llm.suffix_dedup import byte_runs

    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for runs, most in ((word_runs, 50), (byte_runs, 500)):
        windows = [defaultdict(set), defaultdict(set)]
        for found, df in zip(windows, (runs(docs), runs(docs, most=most)), strict=True):
            for r in df.collect():
                found[r.doc_id] |= {(r.start + k, r.anchor) for k in range(r.size)}
        assert windows[0] == windows[1]


def test_repeated_rows_do_no_harm(spark, folder):
    from quaver.llm.lsh_forest import near_duplicates
    from quaver.llm.packing import best_fit
    from quaver.llm.recompression import repeated_words as words
    from quaver.llm.suffix_dedup import later_bytes as strings

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    twice = docs.unionByName(docs.limit(20)).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    n = twice.count()
    assert near_duplicates(twice).count() == n - 3
    assert words(twice).count() == strings(twice).count() == n
    assert best_fit(twice, length="n_chars").select("doc_id").count() >= n


def test_packing(spark, folder):
    from quaver.llm.packing import CAPACITIES, best_fit

    lengths = {i: len(WORD.findall(t or "")) + 1 for i, t, *_ in DOCS}
    rows = Q.op10_best_fit(spark, folder).collect()
    total, bins = Counter(), defaultdict(list)
    for r in rows:
        assert r.piece_start == r.piece * max(CAPACITIES)
        total[r.doc_id] += r.piece_tokens
        bins[r.bin_id].append((r.bin_offset, r.bin_offset + r.piece_tokens, r.bin_size))
    assert total == lengths
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert spans[-1][1] <= spans[0][2] == min(c for c in CAPACITIES if c >= spans[-1][1])
    odd = spark.createDataFrame([(1, None), (2, 0), (3, -4), (4, 9000)], "doc_id BIGINT, n_tokens INT")
    got = [(r.doc_id, r.piece, r.piece_tokens, r.bin_size) for r in best_fit(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, None, None), (2, 0, 0, None), (3, 0, -4, None), (4, 0, 4096, 4096), (4, 1, 4096, 4096), (4, 2, 808, 1024)], key=str)


def test_components_of_chains_and_hubs(spark, monkeypatch):
    from quaver.llm import components as C

    monkeypatch.setattr(C, "BLOCK", 7)
    rng = random.Random(3)
    order = list(range(300))
    rng.shuffle(order)
    linked = list(zip(order, order[1:], strict=False))[:250] + [(1000, 1000 + k) for k in range(1, 90)] + [(5000, 5000)]
    got = {r.id: r.component_id for r in C.components(spark.createDataFrame(linked, "a BIGINT, b BIGINT").repartition(5)).collect()}
    want = components({x for p in linked for x in p}, linked)
    assert got == {i: r for i, r in want.items() if i != 5000}


def test_pipeline(spark, folder, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        kept = {r.doc_id: r for r in out.collect()}
        if name == "language":
            assert set(kept) == {i for i in rows if any(c.isalpha() for c in rows[i].text or "")}
            assert all(r.lang in ("en", "de") and r.lang_pred == "own" for r in kept.values())
        elif name == "near_duplicate":
            _, root = near(5, 80)
            groups = defaultdict(list)
            for i in rows:
                groups[root[i]].append(i)
            assert set(kept) == {min(g) for g in groups.values()}
        elif name == "benchmark":
            assert set(rows) - set(kept) == {3, 7} & set(rows)
        elif name == "personal_data":
            assert set(kept) == set(rows) and all(r.n_chars == len(r.text) for r in kept.values())
            assert "@host" not in "".join(r.text for r in kept.values())
        docs, rows = spark.createDataFrame(out.collect(), out.schema), kept
    assert corpus_pipeline.run(spark, folder).count() >= len(rows)
    assert corpus_pipeline.run(spark, empty).count() == 0
