"""Phrases, whitening and packing against plain whole-table versions, on the small tables and on hand-made rows."""

import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.llm import packing, phrases, queries, whitening

ROWS = [
    (1, "Ab cd ef. ab CD; ab\tcd ef", "en", 0), (2, None, "en", 0), (3, "", None, 0), (4, " .;\n\x0b ", "fr", 0), (None, "ab cd ef " * 20, None, 0), (5, "ab cd ef " * 20, "und", 0),
    (6, "x y z, " * 12 + "É é É é É é " * 9, "fr", 0), (6, "x y z, " * 12, "fr", 0), (7, "a a a a a a a a a a a a a a a", "de", 0), (8, " ".join(f"w{i % 31}" for i in range(40_000)), "de", 0),
    (9, "the cat sat\x1con the mat " * 15, "en", 0), (10, "w" * 30_000, "en", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, n int").withColumns({c: F.lit("x") for c in ("size", "phrase", "part", "length", "sequence_id")}).repartition(3)


def brute_phrases(rows, least=10, inside=50, limit=2000):
    fold = {i: i + 32 for i in range(65, 91)}
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(fold)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = defaultdict(list)
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longer = Counter()
    for (lang, *w), a in candidates.items():
        if len(w) == 3:
            for part in (w[:2], w[1:]):
                longer[lang, *part] = max(longer[lang, *part], a)
    for (lang, *w), a in candidates.items():
        score, _, left, r = min((10**6 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        if not 0 < longer[lang, *w] * 100 >= inside * a:
            out[lang].append((-score, -a, " ".join(w).encode(), left, r))
    return {(lang, k, p.decode(), -a, left, r, n[lang], -s) for lang, found in out.items() for k, (s, a, p, left, r) in enumerate(sorted(found)[:limit], 1)}


def found_phrases(df):
    rows = df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("sample", [0.0, phrases.SAMPLE, 1.0])
def test_op11_whatever_the_sample_proposes(spark, odd, sample):
    assert found_phrases(phrases.collocations(odd, sample=sample)) == brute_phrases([(r[1], r[2]) for r in ROWS])


def test_op11_table_and_limits(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert found_phrases(phrases.collocations(docs)) == brute_phrases(rows)
    assert found_phrases(phrases.collocations(docs, min_count=3, inside=90, limit=5)) == brute_phrases(rows, 3, 90, 5)


def test_op11_passes_close(spark, odd):
    assert phrases.counts(odd, 10, 0.0)[1] == 3  # words, then their pairs, then triples of those
    assert phrases.counts(odd, 10, 1.0, 1)[1] == 1  # everything proposed: no failure on the border


def test_op11_filter_hashes_agree(spark):
    rows = [("en", 2, "ab cdé", 1), ("en", 1, "ab", 1), ("frÄ", 1, "é", 1)]
    df = spark.createDataFrame(rows, phrases.COUNTS)
    p = phrases.Proposals(phrases._bitmap(df, 1, phrases.WORD_BITS), phrases._bitmap(df, 2, phrases.PAIR_BITS))
    h = lambda lang, w: np.array([phrases.xxhash.xxh64_intdigest(f"{lang}\0{w}".encode(), 42)], np.uint64)
    assert p._held(p.words, h("en", "ab")) and p._held(p.words, h("frÄ", "é")) and not p._held(p.words, h("en", "é"))
    assert p._held(p.pairs, phrases._pair_hash(h("en", "ab"), h("en", "cdé"))) and not p._held(p.pairs, phrases._pair_hash(h("en", "cdé"), h("en", "ab")))


@pytest.mark.parametrize("segment", [1, 2, 7, 1000])
def test_op11_segments_of_one_text(monkeypatch, segment):
    monkeypatch.setattr(phrases, "SEGMENT", segment)
    rng = random.Random(3)
    found = [b"." if (i := rng.randrange(6)) == 5 else b"abcde"[i : i + 1] for _ in range(60)]
    got, want = Counter(), Counter()
    for size, names, n in phrases._count(found, "en", phrases.Proposals(), None, 3):
        got.update({(size, p): int(c) for p, c in zip((x.decode() for x in names.to_pylist()), n, strict=True) if size})
    for k in (1, 2, 3):
        want.update((k, b" ".join(found[i : i + k]).decode()) for i in range(len(found) - k + 1) if b"." not in found[i : i + k])
    assert got == want


def test_op11_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000
    df = spark.createDataFrame([(big, big + 1, big + 3)], "a long, l long, r long")
    got = df.select(F.expr("(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")).first()[0]
    assert got == 10**6 * big * big // ((big + 1) * (big + 3)) == 999999


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1) for i, v in rows], "vec_id long, embedding array<float>, x string, n int").repartition(2)


def brute_whitening(rows, most=4):
    """vec_id -> deviations, and per component (whitened up to sign, explained); exact sums in Python."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    d = np.array([[(n * c - t) / n for c, t in zip(x, s, strict=True)] for x in fit])
    e, q = np.linalg.eigh(d.T @ d / n)
    e, q = e[::-1][:most], q[:, ::-1][:, :most]
    rest = lambda x: np.array([(n * c - t) / n for c, t in zip(x, s, strict=True)])
    return n, e, np.trace(d.T @ d / n), [(i, sum((n * c - t) ** 2 for c, t in zip(x, s, strict=True)), rest(x) @ q / np.sqrt(e)) for i, x in kept]


def check_whitening(df, rows):
    n, e, trace, want = brute_whitening(rows)
    got = defaultdict(list)
    for r in df.collect():
        assert r.n == n and r.identity_error < 1e-9 and r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9)
        got[r.component].append((-1 if r.vec_id is None else r.vec_id, r.deviation, r.whitened))
    assert sorted(got) == [1, 2, 3, 4]
    for k, found in got.items():
        theirs = sorted((-1 if i is None else i, d, w[k - 1]) for i, d, w in want)
        found.sort()
        assert [x[:2] for x in found] == [x[:2] for x in theirs]
        mine, other = (np.array([x[2] for x in y]) for y in (found, theirs))
        assert min(np.abs(mine - other).max(), np.abs(mine + other).max()) < 1e-8


def test_op12(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check_whitening(queries.op12_whitening(spark, sf_dir), [(r.vec_id, r.embedding) for r in df.collect()])


def test_op12_edges(spark):
    rng = random.Random(5)
    f32 = lambda v: float(np.float32(v))
    rows = [(i, [f32(rng.gauss(1e3 if j == 2 else 0, 1 + j)) for j in range(6)]) for i in range(80)]
    rows += [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [float("nan")] * 6), (104, [float("inf")] * 6), (3, rows[3][1]), (None, rows[4][1]), (105, rows[4][1]), (105, rows[4][1]), (106, [-0.0] * 6), (107, [f32(-1e-9)] * 6)]
    check_whitening(whitening.whiten(vectors(spark, rows)), rows)
    large = [(i, [f32(v * 3e4) for v in v[1]]) for i, v in enumerate(rows[:12])]  # squares beyond 53 bits
    check_whitening(whitening.whiten(vectors(spark, large)), large)
    for none in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(vectors(spark, none)).collect() == []
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1} and all(r.explained == pytest.approx(1) for r in line)
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(vectors(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


@pytest.mark.parametrize("e", [np.linspace(1, 1.2, 40), np.ones(30), np.r_[[5.0] * 6, np.linspace(1, 2, 20)], [3, 0, 0, 0, 0], [3, 2, 1e-5, 1e-9], [2.0], np.exp(np.random.default_rng(2).normal(0, 3, 90)), np.r_[1e4, 1, 1 - 1e-9, 1 - 2e-9, 1 - 3e-9, np.linspace(0.1, 0.9, 30)]])
def test_feast_finds_all_components(e):
    e = np.sort(np.array(e, float))[::-1]
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((len(e),) * 2))
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    value, vector = whitening.components(a, 4)
    assert len(value) == min(4, (e > 0).sum())
    assert np.abs(value - e[: len(value)]).max() < 1e-13 * e[0]
    assert np.abs(a @ vector - vector * value).max() < 1e-12 * e[0] and np.abs(vector.T @ vector - np.eye(len(value))).max() < 1e-13
    band = whitening.tridiagonal(a)
    for shift in (-1.0, 0.3, e[0] * 0.99, e[0] * 1.01):
        assert whitening.above(band, shift) == (e > shift).sum()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_op13_ids_are_the_library_s(library):
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        own = packing.Ids(f.read())
    rng = random.Random(7)
    alphabet = [*"abzAZ09 .,;:!?'\"<|>-_\t\n\x0b\x0c\r\x1c\x85\xa0éÉßŒİıΣςσǰＡ٣½Ⅷ中́̌ 　😀ꟋK", "J̌", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "the", "The ", "don't", "it's,", "\U00010d50", "Ǆ"]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(4000)] + ["".join(map(chr, range(i, min(i + 64, 0xD800)))) for i in range(0, 0xD800, 64)] + [f"a{chr(i)}B" for i in range(1, 0x250)] + ["x" * 20_000, "ab. " * 9000]
    for at in range(0, len(texts), 300):
        part = texts[at : at + 300]
        got = own.encode(packing.pa.array(part, packing.pa.string()))
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in part]
    assert max(map(len, own.memo)) <= packing.LONGEST


def test_op13_letters_are_learnt_without_their_punctuation(library):
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        own = packing.Ids(f.read())
    words, ends = ["abcd", "Straße", "ÀÞªµ", "it"], [",", "###", "...", "'", "_\"", "<|", "|>"]
    texts = [" ".join(w + e for w in words for e in ["", *ends]), " ".join(w.swapcase() + e for w in words[:1] for e in ends), "it's, don't''s 'sit 's"]
    got = own.encode(packing.pa.array(texts, packing.pa.string()))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert {k.decode() for k in own.memo} == {w.lower() for w in words} | set(ends) | {"it's,", "don't''s", "'sit", "'s"}


@pytest.mark.parametrize("change", ["cased", "unstated", "letters", "ending"])
def test_op13_other_vocabularies_go_to_the_library_whole(change):
    from tokenizers import Tokenizer

    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        stated = json.load(f)
    if change == "cased":
        stated["normalizer"] = None
    elif change == "unstated":
        del stated["normalizer"]
    else:
        stated["added_tokens"].append(stated["added_tokens"][-1] | {"id": 49408, "content": {"letters": "cd", "ending": "d."}[change]})
    own, plain = packing.Ids(json.dumps(stated)), Tokenizer.from_str(json.dumps(stated))
    texts = ["abcd. ABCD, Abcd.. É", "cd d. CD D.", ""]
    got = own.encode(packing.pa.array(texts, packing.pa.string()))
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def best_fit_decreasing(lengths, capacity):
    gaps, used = Counter(), 0
    for s in sorted(lengths, reverse=True):
        room = [g for g, n in gaps.items() if n and g >= s]
        gap = min(room) if room else capacity
        used += not room
        gaps[gap] -= bool(room)
        gaps[gap - s] += 1
    return used


def check_packing(df, rows, library, capacity=4096):
    want = Counter()
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        want.update((doc, k, at, len(p := ids[at : at + capacity]), zlib.crc32(np.array(p, "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), capacity)))
    found = df.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    places = defaultdict(list)
    for r in found:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = [r.length for r in found]
    return len(places), -(-sum(lengths) // capacity), best_fit_decreasing(lengths, capacity)


def test_op13(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    used, least, best_fit = check_packing(queries.op13_packing(spark, sf_dir), [(r.doc_id, r.text) for r in docs.collect()], library)
    assert least <= used <= best_fit


def test_op13_edges(spark, odd, library):
    rows = [(r[0], r[1]) for r in ROWS]
    used, least, best_fit = check_packing(packing.pack(odd, queries.tokenizer_path()), rows, library)
    assert least <= used <= best_fit
    check_packing(packing.pack(odd, queries.tokenizer_path(), capacity=7), rows, library, 7)
    assert packing.pack(odd.limit(0), queries.tokenizer_path()).collect() == []


def test_op13_counts_move_by_powers(monkeypatch):
    many = {4096: 10**9, 1500: 64**4 + 5, 1100: 3 * 64**4, 37: 123_456_789, 1: 7}
    steps = packing.plan(many).tolist()
    assert len(steps) <= len(many) * (packing.BASE**2 + packing.BASE * packing.POWERS)
    assert {s: sum(packing.BASE**p for length, p, *_ in steps if length == s) for s in many} == many
    used = max(first + packing.BASE**p for _, p, _, first, _ in steps)
    unit = 64**3
    assert used <= 1.01 * unit * best_fit_decreasing([s for s, c in many.items() for _ in range(round(c / unit))], 4096)

    monkeypatch.setattr(packing, "BASE", 3)
    rng = random.Random(2)
    few = {rng.randrange(1, 30): rng.randrange(1, 60) for _ in range(12)} | {30: 25}
    held = defaultdict(list)
    for length, power, _, first, offset in packing.plan(few, 30).tolist():
        for k in range(3**power):
            held[first + k].append((offset, length))
    assert Counter(length for x in held.values() for _, length in x) == few
    for x in held.values():
        x.sort()
        assert [o for o, _ in x] == [sum(s for _, s in x[:i]) for i in range(len(x))] and sum(s for _, s in x) <= 30


def test_op13_follows_the_plan_by_powers(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "BASE", 2)
    rows = [(i, "a " * (i % 5)) for i in range(83)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    used, least, _ = check_packing(packing.pack(docs, queries.tokenizer_path(), capacity=11), rows, library, 11)
    assert used <= least + 3
