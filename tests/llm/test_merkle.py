"""The Merkle manifest against trees built whole in plain Python, over one and many blocks, and against tampering."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from rootloom.llm.merkle_manifest import WitnessStream, audit_documents, build_manifest, fold, sha


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    sides = []
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        sides.append(("".join(run[: i % 16]), "".join(run[i % 16 + 1 :])))
        i //= 16
    return sides


def named(*values):
    return hashlib.sha256(b"".join(b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode()) for v in values)).hexdigest()


def brute(rows):
    groups = {}
    for doc_id, source, lang, n, text in rows:
        leaf = named(doc_id, source, lang, n, text)
        other = leaf
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            other = named(doc_id, source, lang, n, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf, other, doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, leaf, other, doc_id) in enumerate(sorted(groups[s])):
            sides = path(trees[s], i) + path(top, k)
            folded = fold(other, sides)
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in sides)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 256, 257, 4096, 4100])
def test_streams_make_the_tree(n):
    leaves = [sha(str(k)) for k in range(n)]
    levels = tree(leaves)
    stream = WitnessStream(len(levels) - 1)
    witnesses = [stream.append(x) for x in leaves]
    assert stream.close() == levels[-1][0]
    assert all(w == path(levels, i) for i, w in enumerate(witnesses))
    assert all(fold(leaf, w) == levels[-1][0] for leaf, w in zip(leaves, witnesses))
    assert fold(sha("other"), witnesses[0]) != levels[-1][0]


def test_many_sources_and_blocks(spark):
    rnd = random.Random(3)
    rows = [(i, "hot", "en", i % 7, f"Text {i}") for i in range(9000)]
    rows += [(i, f"s{i % 40}", None, None, rnd.choice([None, "", "Ä b", "lower"])) for i in range(700)]
    rows += [(i, None, "de", 1, "X") for i in range(20)] + [(None, "null id", "de", 1, "X")] * 2 + [(5, "twice", "fr", 2, "Y")] * 3 + [(7, "ä", "fr", 2, "Z")]
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("node", F.lit("x")).withColumn("g", F.lit(1))
    got = sorted((tuple(r) for r in audit_documents(docs).collect()), key=str)
    want = brute(rows)
    assert got == want
    tampered = [r for r in got if not r[-1]]
    assert 1000 < len(tampered) < 2500 and all(zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in tampered)


def test_whole_witnesses_fold_to_the_root(spark):
    leaves = spark.range(5000).select((F.col("id") % 3).alias("g"), "id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.lit(None).cast("binary").alias("claimed"))
    manifest = build_manifest(leaves)
    rows = manifest.witnesses().collect()
    assert len(rows) == 5000
    for r in rows:
        sides = [(w["left"], w["right"]) for w in r["witness"]]
        assert fold(bytes(r["digest"]).hex(), sides) == r["root"] == manifest.root
        assert fold(bytes(r["digest"]).hex(), sides[:3]) == r["subroot"]


def test_no_rows_and_one_row(spark):
    docs = spark.createDataFrame([(4, "s", "en", 1, "A")], "doc_id long, source string, lang string, n_chars long, text string")
    assert [tuple(r) for r in audit_documents(docs).collect()] == brute([(4, "s", "en", 1, "A")])
    assert audit_documents(docs.limit(0)).collect() == []
