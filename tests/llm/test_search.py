"""Near-duplicates, top-k and URL filters against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rootloom.llm.components import connected_components
from rootloom.llm.simhash_index import fingerprint, fingerprint_links, gray_leaves, gray_rank, near_codes, shared_pattern, simhash_classes, spanning_forest, tree_levels
from rootloom.llm.topk_histogram import exact_top_k, integer_vectors
from rootloom.llm.url_cascade import build_cascade, judge_urls, mark_listed


def union_find(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def clustered(n, seed, base=3, flips=6):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**63, base, dtype=np.uint64)
    codes = set()
    while len(codes) < n:
        c = int(centres[rng.integers(base)])
        for b in rng.integers(0, 64, rng.integers(0, flips)):
            c ^= 1 << int(b)
        codes.add(c)
    return np.array(sorted(codes), np.uint64)


def brute_pairs(codes, distance):
    return [(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= distance]


def test_gray_rank():
    ranks = np.arange(1000, dtype=np.uint64)
    assert (gray_rank(ranks ^ (ranks >> np.uint64(1))) == ranks).all()


@pytest.mark.parametrize("n", [2, 9, 70, 500])
def test_near_codes(n):
    codes = clustered(n, n)
    codes = codes[np.argsort(gray_rank(codes))]
    row = np.concatenate([codes, np.repeat(codes[-1:], -n % 8)])[None, :]
    a, b, compared = near_codes(row, row, 2)
    assert {(int(x), int(y)) for x, y in zip(a, b)} == {(int(codes[k]), int(codes[m])) for i, j in brute_pairs(codes, 2) for k, m in ((i, j), (j, i))}
    assert compared <= row.size**2


def test_groups_are_pruned_by_their_patterns():
    codes = np.unique(np.concatenate([clustered(400, 2, base=60, flips=4), np.random.default_rng(3).integers(0, 2**64, 624, dtype=np.uint64)]))[:1024]
    codes = codes[np.argsort(gray_rank(codes))].reshape(2, 512)
    for x, y in ((codes[:1], codes[:1]), (codes[:1], codes[1:])):
        a, b, compared = near_codes(x, y, 2)
        want = {(int(p), int(q)) for p in x[0] for q in y[0] if p != q and int(p ^ q).bit_count() <= 2}
        assert {(int(p), int(q)) for p, q in zip(a, b)} == want
        assert compared < 0.6 * 512 * 512


def test_spanning_forest_joins_what_is_linked():
    codes = clustered(300, 7)
    pairs = brute_pairs(codes, 2)
    a, b = spanning_forest(*(codes[[p[k] for p in pairs]] for k in (0, 1)))
    place = {int(c): i for i, c in enumerate(codes)}
    mine = [(place[int(x)], place[int(y)]) for x, y in zip(a, b)]
    root = union_find(len(codes), pairs)
    assert union_find(len(codes), mine) == root and len(mine) == len(codes) - len(set(root))
    none = np.empty(0, np.uint64)
    assert len(spanning_forest(none, none)[0]) == 0


def test_tree_of_shared_patterns(spark):
    codes = np.unique(np.concatenate([clustered(400, 5, base=4), np.random.default_rng(6).integers(0, 2**64, 900, dtype=np.uint64)]))
    leaves = gray_leaves(spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long"), 8).collect()
    order = np.concatenate([np.frombuffer(r["codes"], np.uint64) for r in sorted(leaves, key=lambda r: (r["part"], r["k"]))])
    assert (np.diff(gray_rank(order).astype(object)) >= 0).all() and set(order.tolist()) == set(codes.tolist())
    levels = [{r["node"]: (r["mask"], r["value"]) for r in level.collect()} for level in tree_levels(spark.createDataFrame(leaves))]
    assert len(levels) > 2 and len(levels[-1]) == 1
    for r in leaves:
        mask, value = (int(x) for x in shared_pattern(np.frombuffer(r["codes"], np.uint64)))
        assert (mask, value) == (r["mask"] % 2**64, r["value"] % 2**64)
    for below, above in zip(levels, levels[1:]):
        for node, (mask, value) in above.items():
            inside = [v for n, v in below.items() if n >> 4 == node]
            assert all(m & mask == mask and v & mask == value for m, v in inside)


def brute_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in ("", "  \n", "One", "ÉA b", "a b c", "A  B\tc\x0bd e f", "x y z " * 50, "non breaking space"):
        assert fingerprint(text.encode()) == brute_fingerprint(text), text


@pytest.mark.parametrize("leaf", [8, 64, 512])
def test_links_connect_all_near_fingerprints(spark, leaf):
    codes = np.concatenate([clustered(300, 1, base=2, flips=5), np.random.default_rng(2).integers(0, 2**63, 200, dtype=np.uint64), [np.uint64(0)]])
    codes = np.unique(codes)
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    links = fingerprint_links(df, 2, leaf)
    place = {int(x): i for i, x in enumerate(codes.view(np.int64))}
    pairs = [(place[r["a"]], place[r["b"]]) for r in links.collect()]
    assert union_find(len(codes), pairs) == union_find(len(codes), brute_pairs(codes, 2))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(1000, x) for x in range(1001, 1100)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = union_find(1100, [e for e in edges if None not in e])
    assert got == {i: r for i, r in enumerate(root) if r != i}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_classes(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(120)) for _ in range(25)]
    near = [t.rsplit(" ", 1)[0] + " changed" for t in texts[:10]]
    rows = list(enumerate(texts + near + texts[:5] + ["", None, " \n", "w " * 9000])) + [(3, texts[3]), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as fp", "6 as root")
    got = simhash_classes(df).collect()
    assert len(got) == len(rows)
    prints = [brute_fingerprint(t or "") for _, t in rows]
    root = union_find(len(rows), brute_pairs(np.array(prints, np.uint64), 2))
    least = {}
    for r, (d, _) in zip(root, rows):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = sorted((str(d), p, least[r]) for (d, _), p, r in zip(rows, prints, root))
    assert sorted((str(r["doc_id"]), r["fp"] % 2**64, r["component_id"]) for r in got) == want
    assert simhash_classes(df.limit(0)).count() == 0


def brute_top_k(rows, k):
    vectors = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in vectors:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_top_k(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) * scale for x in rng.normal(size=6)]) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 600)]  # ties
    rows += [(700, None), (701, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (720, [float("nan")] * 6), (None, [1.0] * 6), (740, [float("inf")] * 6), (760, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as rank").repartition(5)
    got = exact_top_k(integer_vectors(df), F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted(tuple(r) for r in got) == brute_top_k(rows, 20)


def test_top_k_of_uneven_and_repeated_vectors(spark, monkeypatch):
    from rootloom.llm import topk_histogram as t

    for name, value in (("QUERY_BLOCK", 16), ("VECTOR_BLOCK", 32), ("STEP", 8), ("HELD", 100)):
        monkeypatch.setattr(t, name, value)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, rng.integers(1, 5))]) for i in range(500)] + [(i, [1.0, 1.0, 1.0]) for i in range(500, 900)]
    filled = [(i, v + [0.0] * (4 - len(v))) for i, v in rows]
    schema = "vec_id long, embedding array<double>"
    got = exact_top_k(integer_vectors(spark.createDataFrame(rows, schema)), F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted(tuple(r) for r in got) == brute_top_k(filled, 20)
    # An id that comes twice is ranked for each of its rows, and neither is a candidate of the other.
    twice = [(0, [1.0]), (0, [2.0]), (1, [1.0]), (2, [3.0])]
    got = exact_top_k(integer_vectors(spark.createDataFrame(twice, schema)), F.col("vec_id") % 20 == 0, 20).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 2, 3 * 64 * 64), (1, 2, 6 * 64 * 64), (2, 1, 64 * 64), (2, 1, 2 * 64 * 64)]


def test_top_k_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    one = exact_top_k(integer_vectors(spark.createDataFrame([(0, [1.0]), (3, [0.5]), (4, [0.5])], schema)), F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in one.collect()) == [(0, 1, 3, 2048), (0, 2, 4, 2048)]
    for rows in ([], [(1, [1.0])], [(0, [1.0])]):
        assert exact_top_k(integer_vectors(spark.createDataFrame(rows, schema)), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize(("n", "listed"), [(3000, 40), (500, 250), (200, 0), (5, 5), (0, 0)])
def test_cascade_is_exact(spark, n, listed):
    keys = [f"host{i}.example" for i in range(n)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    chosen = spark.createDataFrame([(k,) for k in keys[:listed]], "key string")
    cascade = build_cascade(chosen, universe)
    got = {r["key"] for r in universe.where(cascade.contains(F.col("key"))).collect()}
    assert got == set(keys[:listed])
    marked = mark_listed(universe.union(spark.createDataFrame([(None,)], "key string")), "key", chosen, universe)
    assert marked.where("listed").count() == listed


def test_cascades_of_parts_are_exact(spark):
    keys = [f"host{i}.example" for i in range(4000)]
    rows = [(i, keys[i % 4000 if i % 3 else 7]) for i in range(6000)] + [(-1, None), (-2, keys[9]), (-2, keys[9])]
    df = spark.createDataFrame(rows, "page_id long, host string")
    universe = df.select(F.col("host").alias("key"))
    chosen = spark.createDataFrame([(k,) for k in keys[:1500] + keys[:20]], "key string")
    got = mark_listed(df, "host", chosen, universe, max_bits=4096)
    assert "BloomFilter" not in got._jdf.queryExecution().toString() and "Join" not in got._jdf.queryExecution().toString()
    want = set(keys[:1500])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, k, k in want)) for i, k in rows)


def test_urls_by_the_longest_rule(spark):
    urls = ["http://www.example.com/fr/1", "http://www.example.com/en/1", "http://m.www.example.com/en/", "http://example.com/en/" + "x" * 100_000, "http://b.example.com/en/1"]
    df = spark.createDataFrame([(None if k == 4 else k, u) for k, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string")
    got = sorted((str(r["page_id"]), r["rule"], r["verdict"]) for r in judge_urls(df).collect())
    allow = "www.example.com/en/"
    assert got == [("0", "com/", "allow"), ("0", "com/", "allow"), ("1", allow, "allow"), ("2", allow, "allow"), ("3", "example.com/en/", "block"), ("None", "example.com/en/", "block")]


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/x?q#f", "https://a.example.com/en/", "https://example.com", "http://x.net/es/1", "http://xnet/es/1", "ftp://spam-farm.example.org/a", "no scheme", None, "", "http://", "http://É.COM/a b", "x://y.net/fr", "http://example.com/en/?a://b.net/es/", "http://a.b\nc.com/\nx"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 as host", "2 as verdict")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(df).collect()}
    assert got == {
        0: ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        1: ("a.example.com", "/en/", "example.com/en/", "block"),
        2: ("example.com", "", None, "allow"),
        3: ("x.net", "/es/1", "net/es/", "block"),
        4: ("xnet", "/es/1", None, "allow"),
        5: ("spam-farm.example.org", "/a", None, "block"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("", "", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("É.com", "/a b", "com/", "allow"),
        11: ("y.net", "/fr", None, "allow"),
        12: ("example.com", "/en/", "example.com/en/", "block"),
        13: ("a.b\nc.com", "/\nx", "com/", "allow"),
    }
    assert judge_urls(df.limit(0)).count() == 0
