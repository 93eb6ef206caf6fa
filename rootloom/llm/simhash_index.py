"""SimHash near-duplicates, found with a hierarchical index over Gray-ordered fingerprints.

Fingerprints are made per document; everything after that works on different fingerprints, so exact copies cost nothing.

The index is one tree over all different fingerprints in Gray order, where neighbours share most bits:

* Fingerprints are range-partitioned and sorted by Gray rank; runs of ``LEAF`` are leaves. A node's pattern is (mask, value):
  the bits that all fingerprints below it share, factored out of them. Sixteen nodes side by side make a node of the level
  above, up to a single root, by grouped bit operations.
* The tree is joined with itself from the root down. Differences of two nodes on the bits that both of their patterns hold add
  up on the way down, since a pattern holds all bits of the one above; a pair of nodes with over ``distance`` of them is
  pruned with everything below it. Each level is a table of pairs, and a pair meets the children of its two nodes by equalities.
* Pairs of leaves that are left go to tasks with their fingerprints, where runs of ``GROUP`` are pruned in the same way before
  fingerprints are compared.

A task gives back a spanning forest of the links it finds, not all pairs, and the components of those are the classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootloom.llm.components import connected_components
from rootloom.llm.shared import kept
from rootloom.llm.text_counts import shingle_hashes

SEED = 42
#: Fingerprints of a leaf, and of a run inside it; nodes of a node, as a number of bits.
LEAF, GROUP, FAN_BITS = 64, 8, 4
#: Nodes of a level whose pairs a task expands.
NODES_AT_ONCE = 2_048
#: Hashes whose bits are counted at once.
RUN = 1 << 14
#: Codes of a piece of a leaf that is longer than that.
WIDE = 128


def fingerprint(text: bytes, words: int = 3) -> int:
    """64 bits of a UTF-8 text: A-Z lower-cased, ``words``-word shingles with repeats, XXH64; a bit is set if over half have it. Shingles are counted in runs, so a long text takes no more memory."""
    n, ones = 0, np.zeros(64, np.int64)
    for block in shingle_hashes(text, words, SEED):
        for k in range(0, len(block), RUN):
            part = block[k : k + RUN]
            n += len(part)
            ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) for each row; a null text has no words, so its fingerprint is 0."""

    def make(batches):
        for batch in batches:
            fps = np.array([fingerprint(t or b"", words) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(make, T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the binary-reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_order(code: Column) -> Column:
    """A long that sorts as the unsigned Gray rank does."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def shared_pattern(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask, value) of the codes along the last axis."""
    ones = np.bitwise_and.reduce(codes, axis=-1)
    mask = ~(ones ^ np.bitwise_or.reduce(codes, axis=-1))
    return mask, ones & mask


def _places(hit: np.ndarray) -> tuple[np.ndarray, ...]:
    """np.nonzero; faster where few are set."""
    return np.unravel_index(np.flatnonzero(hit), hit.shape)


def near_codes(x: np.ndarray, y: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Different codes (a, b) at most ``distance`` bits apart, a in a row of ``x`` and b in the same row of ``y``, and how many were compared.

    Rows are Gray-ordered, and their lengths a multiple of GROUP.
    """
    found, compared = [], 0
    n, width = x.shape
    runs = width // GROUP
    step = max(1, (1 << 19) // (runs * runs))
    for at in range(0, n, step):
        xs, ys = (z[at : at + step].reshape(-1, runs, GROUP) for z in (x, y))
        (mx, vx), (my, vy) = shared_pattern(xs), shared_pattern(ys)
        row, i, j = _places(np.bitwise_count((vx[:, :, None] ^ vy[:, None, :]) & mx[:, :, None] & my[:, None, :]) <= distance)
        for k in range(0, len(row), 1 << 14):
            p, q = xs[row[k : k + (1 << 14)], i[k : k + (1 << 14)]], ys[row[k : k + (1 << 14)], j[k : k + (1 << 14)]]
            s, u, v = _places(np.bitwise_count(p[:, :, None] ^ q[:, None, :]) - 1 < distance)  # equal codes: 255
            found.append((p[s, u], q[s, v]))
            compared += len(p) * GROUP * GROUP
    a, b = (np.concatenate([f[k] for f in found] or [np.empty(0, np.uint64)]) for k in (0, 1))
    return a, b, compared


def near_codes_of_wide(x: np.ndarray, y: np.ndarray, distance: int):
    """The same for two long rows of codes, some of them at a time: pieces of ``WIDE`` are pruned by their patterns before their runs are."""
    xs, ys = (np.concatenate([z, np.repeat(z[-1:], -len(z) % WIDE)]).reshape(-1, WIDE) for z in (x, y))
    (mx, vx), (my, vy) = shared_pattern(xs), shared_pattern(ys)
    for i in range(len(xs)):
        j = np.flatnonzero(np.bitwise_count((vx[i] ^ vy) & mx[i] & my) <= distance)
        if len(j):
            a, b, _ = near_codes(np.broadcast_to(xs[i], (len(j), WIDE)), ys[j], distance)
            yield a, b


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same codes as the given ones, one for each code but one of a tree."""
    codes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = at[: len(a)], at[len(a) :], np.arange(len(codes))
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(codes)))
    return codes[moved], codes[label[moved]]


def gray_leaves(fps: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(part, k, mask, value, codes) of the leaves in Gray order; the last leaf of a part is filled up with its last code."""

    def cut(batches):
        part, k, held = TaskContext.get().partitionId(), 0, np.empty(0, np.uint64)

        def rows(codes):
            codes = np.concatenate([codes, np.repeat(codes[-1:], -len(codes) % leaf)]).reshape(-1, leaf)
            mask, value = shared_pattern(codes)
            n = len(codes)
            data = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * leaf * 8).astype("<i4")), pa.py_buffer(np.ascontiguousarray(codes))])
            cols = [np.full(n, part, np.int64), np.arange(k, k + n), mask.view(np.int64), value.view(np.int64)]
            return pa.RecordBatch.from_arrays([*map(pa.array, cols), data], ["part", "k", "mask", "value", "codes"])

        for batch in batches:
            held = np.concatenate([held, np.asarray(batch.column(0)).view(np.uint64)])
            whole = len(held) // leaf * leaf
            if whole:
                yield rows(held[:whole])
                k, held = k + whole // leaf, held[whole:]
        if len(held):
            yield rows(held)

    ordered = fps.select("fp", gray_order(F.col("fp")).alias("o")).repartitionByRange("o").sortWithinPartitions("o")
    return ordered.select("fp").mapInArrow(cut, "part long, k long, mask long, value long, codes binary")


def tree_levels(leaves: DataFrame) -> list[DataFrame]:
    """(node, mask, value) of each level, from the leaves up to the single root; a node's parent is node >> FAN_BITS."""
    last_part, last_k = leaves.agg(F.coalesce(F.max("part"), F.lit(0)), F.coalesce(F.max("k"), F.lit(0))).first()
    bits = -(-int(last_k).bit_length() // FAN_BITS) * FAN_BITS
    levels = [leaves.select(F.shiftleft("part", bits).bitwiseOR(F.col("k")).alias("node"), "mask", "value")]
    for _ in range(-(-((last_part << bits) | last_k).bit_length() // FAN_BITS)):
        shared = F.expr("bit_and(mask) & ~(bit_and(value) ^ bit_or(value))")
        up = levels[-1].groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(shared.alias("mask"), (F.expr("bit_and(value)").bitwiseAND(shared)).alias("value"))
        levels.append(kept(up, "level"))
    return levels


def fingerprint_links(fps: DataFrame, distance: int = 2, leaf: int = LEAF) -> DataFrame:
    """Edges (a, b) between different fingerprints ``fp`` that connect all those at most ``distance`` bits apart, and no others."""
    leaves = kept(gray_leaves(fps, leaf), "leaves")
    levels = tree_levels(leaves)
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        a, b = (level.select(F.shiftright("node", FAN_BITS).alias(x), F.col("node").alias(f"{x}_node"), F.col("mask").alias(f"{x}_mask"), F.col("value").alias(f"{x}_value")) for x in "ab")
        differences = F.bit_count((F.col("a_value").bitwiseXOR(F.col("b_value"))).bitwiseAND(F.col("a_mask")).bitwiseAND(F.col("b_mask")))
        parts = -(-level.count() // NODES_AT_ONCE)
        spread = pairs.repartition(parts, "a", "b") if parts > 1 else pairs
        near = spread.join(a, "a").join(b, "b").where((F.col("a_node") <= F.col("b_node")) & (differences <= distance))
        pairs = kept(near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), "pairs")

    def solve(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, leaf) for c in (0, 1))
            if leaf > WIDE:
                found = [spanning_forest(a, b) for p, q in zip(x, y) for a, b in near_codes_of_wide(p, q, distance) if len(a)]
                a, b = spanning_forest(*(np.concatenate([f[k] for f in found] or [np.empty(0, np.uint64)]) for k in (0, 1)))
            else:
                a, b = spanning_forest(*near_codes(x, y, distance)[:2])
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    bits = -(-int(leaves.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]).bit_length() // FAN_BITS) * FAN_BITS
    codes = leaves.select(F.shiftleft("part", bits).bitwiseOR(F.col("k")).alias("node"), "codes").hint("merge")
    both = pairs.join(codes.toDF("a", "x"), "a").join(codes.toDF("b", "y"), "b")
    return both.select("x", "y").mapInArrow(solve, "a long, b long")


def simhash_classes(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for each row: the smallest id among all rows reachable over links of ``distance`` bits or fewer.

    A null text, and a text without words, has fingerprint 0 and is linked like any other. Null ids are not counted for a
    component's smallest id (null if it has no other). Repeated rows each give a row; an empty table gives no rows; other
    columns aren't read.
    """
    prints = kept(fingerprints(docs, words, id_col, text_col), "fingerprints")
    fps = kept(prints.groupBy("fp").agg(F.min("id").alias("first")), "different")
    roots = connected_components(fingerprint_links(fps, distance)).select(F.col("node").alias("fp"), "root")
    rooted = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = rooted.select("fp", "root").join(classes, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def fingerprint_hex(fp) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
