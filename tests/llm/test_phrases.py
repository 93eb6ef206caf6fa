"""Collocations against counting in plain Python, parts of texts against whole ones, and exact arithmetic beyond 64 bits."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from rootloom.llm.phrase_stripes import _PLAIN, Words, bloom_bits, collocations, cut_text, frequent_buckets, in_bloom, word_hash


def brute(rows, longest, least, contained=100, top=2000):
    out = []
    by_lang = {}
    for lang, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            by_lang.setdefault("und" if lang is None else lang, []).append([w for w in re.split("[ \t]", piece) if w])
    for lang, pieces in by_lang.items():
        f = Counter(tuple(p[i : i + k]) for p in pieces for k in range(1, longest + 1) for i in range(len(p) - k + 1))
        n = sum(map(len, pieces))
        found = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        rows = []
        for g, a in found.items():
            inside = any(len(h) > len(g) and 100 * b >= contained * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in found.items())
            if not inside:
                score, j = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), a, f[g[:j]], f[g[j:]], n, score))
        out += [(lang, k + 1, r[2].decode(), *r[3:]) for k, r in enumerate(sorted(rows)[:top])]
    return sorted(out)


def corpus(seed, n=300):
    rnd = random.Random(seed)
    words = ["the", "of", "A", "b", "né", "éa", "x1", "y,", "z.", "The", "new york", "new york city", "a\tb", "w\n", "q?r", "\x0c", "日本 語"]
    rows = [(rnd.choice(["en", "de", None]), " ".join(rnd.choices(words, k=rnd.randint(0, 40)))) for _ in range(n)]
    return rows + [("en", None), ("en", ""), (None, " \t "), ("fr", "new york " * 50), ("fr", "one two three four five six. " * 30)] * 3


@pytest.mark.parametrize(("seed", "longest", "least", "contained", "chunk"), [(1, 5, 10, 100, 8 << 20), (2, 5, 5, 80, 200), (3, 2, 4, 100, 64), (4, 3, 20, 50, 1000)])
def test_against_counting(spark, seed, longest, least, contained, chunk):
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, phrase int, n string").repartition(3)
    got = sorted(tuple(r) for r in collocations(docs, longest, least, contained, chunk=chunk).collect())
    assert got == brute(rows, longest, least, contained) and len(got) > 10


def test_top_and_ties(spark):
    rows = [("en", f"{a} {b}. " * 7) for a, b in zip("abcdef", "ghijkl")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    got = sorted(tuple(r) for r in collocations(docs, least=5, top=4).collect())
    assert got == brute(rows, 5, 5, top=4) and [r[2] for r in got] == ["a g", "b h", "c i", "d j"]


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


def test_cut_texts_lose_nothing():
    rnd = random.Random(5)
    for _ in range(200):
        text = "".join(rnd.choices(["a", "b", " ", "  ", ".", "\n", "word "], k=rnd.randint(0, 80))).encode().translate(_PLAIN)
        for carried in (0, 2, 4):
            parts = list(cut_text(text, carried, rnd.randint(1, 20)))
            assert b"".join(p for _, p in parts) == text
            grams, k = Counter(), carried + 1
            for carry, part in parts:
                assert len(carry.split()) <= carried
                lead = len(carry.split())
                for at, piece in enumerate((carry + part).split(b"\n")):
                    words = piece.split()
                    grams.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1) if at or i + k > lead)
            whole = [p.split() for p in text.split(b"\n")]
            assert grams == Counter(tuple(p[i : i + k]) for p in whole for i in range(len(p) - k + 1))


def test_filters_let_all_through(spark):
    rows = [("en", f"w{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "lang string, a string").select(word_hash("lang", "a").alias("h"))
    bits = bloom_bits(df)
    (_, ends, hashes), = Words([(b"", " ".join(w for _, w in rows).encode())], "en").phrases(1, [])
    assert sorted(hashes.view(np.int64).tolist()) == sorted(r["h"] for r in df.collect()) and len(ends) == 3000
    assert in_bloom(bits, hashes).all()
    assert in_bloom(bits, np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)).mean() < 0.1


@pytest.mark.parametrize("bits", [16, 30])
def test_buckets_hold_all_frequent_phrases(spark, bits):
    docs = spark.createDataFrame(corpus(7), "lang string, text string").repartition(3)
    got = {r["h"] for r in frequent_buckets(docs, 2, 20, [], bits, 500).collect()}
    count = Counter()
    for lang, text in corpus(7):
        *_, (_, ends, hashes) = Words([(b"", (text or "").encode().translate(_PLAIN))], lang or "und").phrases(2, [])
        count.update((hashes[ends] >> np.uint64(64 - bits) << np.uint64(64 - bits)).view(np.int64).tolist())
    assert got == {h for h, n in count.items() if n >= 20} and len(got) > 10


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, l, r = 10**12 + 7, 10**15 + 3, 10**13 + 1, 3 * 10**12 + 11
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    got = df.selectExpr("(1000 * cast(a as decimal(38,0)) * cast(n as decimal(38,0))) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0))) as s").first()["s"]
    assert got == 1000 * a * n // (l * r)
