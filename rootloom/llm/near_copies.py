"""Near copies by wide SimHash: five-word shingles, Jaccard similarity 0.8 or more, each link verified exactly.

Two bits of a SimHash agree with probability 1 - angle/pi: 0.8485 at Jaccard 0.8 and equal sizes. A 64-bit code and a fixed
number of differing bits can't tell such copies from others, so a text has 1024 bits. Of 896 of them several fingerprints are made,
each of a table of its own, and the hierarchical index of ``simhash_index`` over all of them in Gray order finds those of one table that are
at most three bits apart. Texts whose fingerprints of a table are linked by it meet; of each, 128 more bits are compared, which
leaves out what met by chance.

* The fingerprints' length grows with the logarithm of the number of texts, so that chance links a text to a tenth of another in a table; as many
  tables are taken as find a pair of similarity 0.8 with probability ``1 - MISSED``. A table's number stands three times above its
  fingerprints, so those of different tables are never near.
* In a group each text proposes its nearest other and its best hub: of those under the distance, the one that is nearest
  to the most. So copies of one text, which may be no near copies of one another, meet that text, and a cluster is
  proposed as a web of links, not as all its pairs. Groups come sorted and are compared in pieces of bounded size; the hubs of each
  piece then meet all rows of their group. A group too large for one task is dealt to several, whose hubs meet all its rows, too.
* Proposed links are verified by the Jaccard similarity of the whole shingle sets, and only those are links.
* Then all other pairs of a group that could still join two components are compared, on the check's bits and on all 1024, and verified: the
  components are those of all pairs that meet under the distance. Pairs within one component can't change them and are left out. Groups are dealt
  out by pairs of parts of bounded size, and pairs are verified in cells, to which each set of shingles is sent once.

Texts with the same set of shingles are one node, so exact copies cost nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootloom.llm.components import connected_components
from rootloom.llm.shared import kept, rest_of_row
from rootloom.llm.simhash_index import fingerprint_links
from rootloom.llm.text_counts import different, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
SEED = 42
BITS, TABLE_BITS = 1024, 896
#: Bits that differ between fingerprints that are linked, texts that chance links to one in a table, and fingerprints of a leaf of the index.
DISTANCE, BY_CHANCE, LEAVES = 3, 0.1, (512, 1 << 20)
#: Pairs of similarity 0.8 that no table finds, at most; 128 bits differ in 19.4 on average there, with a deviation of 4.1.
MISSED, CHECK_DISTANCE = 0.02, 36
#: Of all 1024 bits 155.1 differ on average there, with a deviation of 11.5: five deviations more.
WIDE_DISTANCE = 212
AGREE = 1 - math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
#: Links that a row proposes in a piece: to its nearest row, and to its best hub; hubs that a piece names to the whole group.
NEAREST, HUBS, NAMED = 1, 1, 8
#: Rows looked at together, the most that are compared with one another, and the most of one group that a task holds (32 bytes each).
BLOCK, GROUP, PART = 65_536, 2_048, 1 << 19
#: Pieces up to this size are compared side by side, larger ones each by itself.
SPARSE = 32
#: Rows of a part of a group that meets another part in one task, rows of either side compared at once, and rows of either side whose pairs are verified together.
UNIT, ACROSS, CELL = 16_384, (256, 4096), 256
#: Broadcast only up to so many nodes of cells (16 bytes each).
BROADCAST_ENDS = 200_000
#: One in so many nodes says which groups are larger than PART; that only decides how rows are dealt out.
SAMPLED = 64
_SALTS = np.random.default_rng(SEED).integers(1, 2**63, BITS // 64, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of whole numbers (splitmix)."""
    x = x.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The different shingles of a UTF-8 text as sorted hashes: A-Z lower-cased, ``words`` words each; of a shorter text all its words."""
    parts = [different(h) for h in shingle_hashes(text, words, SEED)]
    return parts[0] if len(parts) == 1 else different(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def sketch(hashes: np.ndarray) -> bytes:
    """1024 bits: each is set if over half of the shingles have it."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255):
        x = hashes[at : at + 255, None] ^ _SALTS[None, :]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def tables(n_texts: int) -> np.ndarray:
    """The bits of each table's fingerprint (tables x bits)."""
    near = lambda size: sum(math.comb(size, k) for k in range(DISTANCE + 1))
    size = next((k for k in range(16, 40) if BY_CHANCE * 2**k >= n_texts * near(k)), 40)
    met = sum(math.comb(size, k) * AGREE ** (size - k) * (1 - AGREE) ** k for k in range(DISTANCE + 1))
    n = math.ceil(math.log(MISSED) / math.log1p(-met))
    rng = np.random.default_rng(SEED)
    order = np.concatenate([rng.permutation(TABLE_BITS) for _ in range(-(-n * size // TABLE_BITS))])
    return order[: n * size].reshape(n, size)


def table_codes(bits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """(tables, rows): each row's fingerprint in each table, 40 bits below the table's number three times."""
    size = chosen.shape[1]
    weights = np.int64(1) << np.arange(40 - size, 40, dtype=np.int64)
    return np.stack([bits[:, places].astype(np.int64) @ weights + ((k * 0x10101) << 40) for k, places in enumerate(chosen)])


def mark_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_key, node, sketch, row, text): row_key tells all rows apart, node is the same for the same set of shingles."""

    def mark(batches):
        import xxhash

        key = TaskContext.get().partitionId() << 33
        for batch in batches:
            sets = [shingles(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            cols = [batch.column(0), pa.array(np.arange(key, key + len(sets))), pa.array(nodes), pa.array(map(sketch, sets), pa.binary()), batch.column(2), batch.column(1)]
            key += len(sets)
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in fields])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), rest_of_row(docs, text_col))
    fields = [rows.schema["id"], T.StructField("row_key", T.LongType()), T.StructField("node", T.LongType()), T.StructField("sketch", T.BinaryType()), rows.schema["row"], rows.schema["text"]]
    return rows.mapInArrow(mark, T.StructType(fields))


def _first(a: np.ndarray, b: np.ndarray, by: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each a, the ``most`` pairs that are least in ``by``."""
    order = np.lexsort((b, by, a))
    a, b = a[order], b[order]
    begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
    nth = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
    return a[nth < most], b[nth < most]


def piece_links(piece: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places (a, b) of proposed links in small pieces (rows of a piece lie together), each row's closeness: how far below the distance all its near rows are, added up; and how many these are."""
    at, left, right, far = np.arange(len(piece)), [], [], []
    for step in range(1, SPARSE):
        at = at[: np.searchsorted(at, len(piece) - step)]
        at = at[piece[at] == piece[at + step]]
        if not len(at):
            break
        d = np.bitwise_count(check[at] ^ check[at + step]).sum(axis=1, dtype=np.int64)
        near = d <= CHECK_DISTANCE
        left.append(at[near].astype(np.int32))
        right.append((at[near] + step).astype(np.int32))
        far.append(d[near].astype(np.int16))
    close = np.zeros(len(piece), np.int64)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64), close, close
    a, b, d = np.concatenate(left + right), np.concatenate(right + left), np.concatenate(far * 2)
    close = np.bincount(a, CHECK_DISTANCE + 1 - d.astype(np.int64), len(piece)).astype(np.int64)
    found = [_first(a, b, d, NEAREST), _first(a, b, -close[b], HUBS)]
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]), close, np.bincount(a, minlength=len(piece))


def dense_links(check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for one piece of any size, from all its distances."""
    n = len(check)
    d = np.bitwise_count(check[:, None, 0] ^ check[None, :, 0]) + np.bitwise_count(check[:, None, 1] ^ check[None, :, 1])
    np.fill_diagonal(d, 255)
    close = np.maximum(CHECK_DISTANCE + 1 - d.astype(np.int16), 0).sum(axis=1, dtype=np.int64)
    order = np.argsort(-close, kind="stable")
    a, b, rows, hub = [], [], np.arange(n), (d <= CHECK_DISTANCE)[:, order]
    near_rows = hub.sum(axis=1)
    for _ in range(NEAREST):
        k = d.argmin(axis=1)
        near = d[rows, k] <= CHECK_DISTANCE
        a.append(rows[near])
        b.append(k[near])
        d[rows, k] = 255
    for _ in range(HUBS):
        k = hub.argmax(axis=1)
        near = hub[rows, k]
        a.append(rows[near])
        b.append(order[k[near]])
        hub[rows, k] = False
    return np.concatenate(a), np.concatenate(b), close, near_rows


def hub_links(check: np.ndarray, hubs: np.ndarray, close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in ``hubs``): each row with its best hub, the closest of those under the distance, and its nearest one."""
    best, least = np.full(len(check), -1), np.full(len(check), CHECK_DISTANCE + 1)
    nearest = best.copy()
    for k in np.argsort(close, kind="stable"):  # better ones overwrite
        d = np.bitwise_count(check ^ hubs[k]).sum(axis=1, dtype=np.int64)
        best[d <= CHECK_DISTANCE] = k
        nearer = d < least
        nearest[nearer], least[nearer] = k, d[nearer]
    rows = np.flatnonzero(best >= 0)
    return np.tile(rows, 2), np.concatenate([best[rows], nearest[rows]])


def group_links(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (a, b) of proposed links, places of the rows that are hubs of a piece of a group of several, and of those that are open: near others that no proposed link joins them with; rows (key, node, check, check), sorted."""
    key, node, check = rows[:, 0], rows[:, 1], rows[:, 2:].view(np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.append(begin[1:], len(key))
    nth = np.arange(len(key)) - np.repeat(begin, ends - begin)
    piece = np.cumsum((nth % GROUP == 0))
    sizes = np.bincount(piece)
    small = np.flatnonzero(sizes[piece] <= SPARSE)
    near_rows, close = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    x, y, close[small], near_rows[small] = piece_links(piece[small], check[small])
    a, b, named = [small[x]], [small[y]], []
    starts = np.flatnonzero(np.diff(piece, prepend=0))
    for s, size in zip(starts.tolist(), sizes[piece[starts]].tolist()):
        if size > SPARSE:
            x, y, close[s : s + size], near_rows[s : s + size] = dense_links(check[s : s + size])
            a.append(s + x)
            b.append(s + y)
    x, y = np.concatenate(a), np.concatenate(b)
    links = np.unique(np.minimum(x, y) << 32 | np.maximum(x, y))
    a, b = [links >> 32], [links & 0xFFFFFFFF]
    # A group of several pieces is open as a whole.
    open_ = (near_rows > np.bincount(np.concatenate([*a, *b]), minlength=len(key))) | np.repeat(ends - begin > GROUP, ends - begin)
    for s, e in zip(begin.tolist(), ends.tolist()):
        if e - s > GROUP:
            hubs = np.concatenate([k + np.argsort(-close[k : min(k + GROUP, e)], kind="stable")[:NAMED] for k in range(s, e, GROUP)])
            row, hub = hub_links(check[s:e], check[hubs], close[hubs])
            a.append(s + row)
            b.append(hubs[hub])
            named.append(hubs)
        elif e - s > 1:
            named.append(s + np.argsort(-close[s:e], kind="stable")[:NAMED])
    return node[np.concatenate(a)], node[np.concatenate(b)], np.concatenate(named) if named else np.empty(0, np.int64), np.flatnonzero(open_)


def _whole_groups(batches):
    """Rows of whole groups, about BLOCK at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(np.stack([np.asarray(c) for c in batch.columns], axis=1))
        n += len(batch)
        if n < BLOCK:
            continue
        rows = np.concatenate(held)
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last group may go on
        if last:
            yield rows[:last]
        held, n = [rows[last:]], len(rows) - last
    if n:
        yield np.concatenate(held)


def proposed_links(nodes: DataFrame, part: int = PART, sampled: int = SAMPLED) -> tuple[DataFrame, DataFrame]:
    """Different pairs (a, b), a < b, of near nodes, and the open rows (key, node) of groups. nodes: (node, sketch), each node once."""
    n_nodes = nodes.count()
    chosen = tables(n_nodes)

    def spread(batches):
        for batch in batches:
            for some in (batch.slice(k, 2048) for k in range(0, len(batch), 2048)):
                raw = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(len(some), BITS // 8)
                bits = np.unpackbits(raw, axis=1)
                check = raw[:, TABLE_BITS // 8 :].copy().view(np.int64)
                node = np.asarray(some.column(0))
                cols = [table_codes(bits, chosen).ravel(), *(np.tile(x, len(chosen)) for x in (node, check[:, 0], check[:, 1]))]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], ["key", "node", "c0", "c1"])

    def meet(batches):
        for rows in _whole_groups(batches):
            a, b, _, more = group_links(rows)
            linked = np.repeat([True, False], [len(a), len(more)])
            first, second = np.concatenate([np.minimum(a, b), rows[more, 1]]), np.concatenate([np.maximum(a, b), rows[more, 0]])
            yield pa.RecordBatch.from_arrays([pa.array(first), pa.array(second, mask=~linked), pa.array(second, mask=linked)], ["a", "b", "key"])

    def name_hubs(batches):
        for rows in _whole_groups(batches):
            hubs = rows[group_links(rows)[2]]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in hubs.T], ["key", "node", "c0", "c1"])

    shape, met_shape = "key long, node long, c0 long, c1 long", "a long, b long, key long"
    spread_rows = nodes.select("node", "sketch").mapInArrow(spread, shape)
    codes = kept(spread_rows.groupBy("key").agg(F.count("*").alias("n")), "codes")
    least, most = LEAVES
    leaf = min(most, max(least, 1 << max(n_nodes // 4, 1).bit_length() - 1))
    roots = kept(connected_components(fingerprint_links(codes.select(F.col("key").alias("fp")), DISTANCE, leaf)), "roots")
    # A text that meets no other in a table goes no further there.
    linked = roots.select(F.col("node").alias("key"), "root").union(roots.select(F.col("root").alias("key"), "root").distinct())
    groups = kept(codes.join(linked, "key", "left").where("n > 1 or root is not null").select("key", F.coalesce("root", "key").alias("group")), "groups")
    grouped = lambda some: some.join(groups, "key").select(F.col("group").alias("key"), "node", "c0", "c1")
    rows = grouped(spread_rows)
    if n_nodes <= part:
        met = kept(rows.repartition("key").sortWithinPartitions("key", "c0", "c1", "node").mapInArrow(meet, met_shape), "met")
        return met.where("a <> b").select("a", "b").distinct(), met.where("b is null").select("key", F.col("a").alias("node"))
    # Keys that more than ``part`` nodes seem to share are dealt to several tasks by the node, under keys of their own (below zero).
    some = grouped(nodes.where(F.pmod(F.xxhash64("node"), F.lit(sampled)) == 0).select("node", "sketch").mapInArrow(spread, shape))
    hot = kept(some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * sampled > part).select("key", F.ceil(F.col("n") * sampled * 2 / part).alias("parts")), "hot")
    hot = F.broadcast(hot) if hot.count() <= 100_000 else hot
    dealt = rows.join(hot, "key", "left").withColumn("own", F.when(F.col("parts").isNull(), F.col("key")).otherwise(-1 - F.abs(F.xxhash64("key", F.pmod(F.xxhash64("node", F.lit(1)), "parts")) % (1 << 62))))
    dealt = dealt.select(F.col("own").alias("key"), "node", "c0", "c1").repartition("key").sortWithinPartitions("key", "c0", "c1", "node")
    met = kept(dealt.mapInArrow(meet, met_shape), "met")
    links = met.where("b is not null").select("a", "b")
    in_parts = rows.join(hot, "key").select((F.col("key") * 1).alias("key"), F.pmod(F.xxhash64("node", F.lit(1)), "parts").alias("p"), "node", "c0", "c1")
    own = F.xxhash64("key", "p")
    named = kept(in_parts.select(own.alias("key"), "node", "c0", "c1").repartition("key").sortWithinPartitions("key", "c0", "c1", "node").mapInArrow(name_hubs, shape).join(in_parts.select("key", "p").distinct().select(own.alias("own"), F.col("key").alias("whole")), F.col("key") == F.col("own")).select(F.col("whole").alias("key"), F.col("node").alias("hub"), F.col("c0").alias("h0"), F.col("c1").alias("h1")), "hubs")
    named = F.broadcast(named) if named.count() <= 100_000 else named
    d = F.bit_count(F.col("c0").bitwiseXOR(F.col("h0"))) + F.bit_count(F.col("c1").bitwiseXOR(F.col("h1")))
    across = in_parts.join(named, "key").where((d <= CHECK_DISTANCE) & (F.col("node") != F.col("hub"))).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    # Groups that were dealt out are open as a whole.
    more = met.where("b is null and key >= 0").select("key", F.col("a").alias("node")).union(in_parts.select("key", "node"))
    return links.union(across).where("a <> b").distinct(), more


def pairs_across(unit: np.ndarray, part: np.ndarray, root: np.ndarray, sketches: np.ndarray):
    """(a, b, cell of a, cell of b) as places of all pairs of near rows of different roots, some at a time; rows of a unit lie together, by root.

    Where a unit has rows of two parts, only pairs of one and the other are meant.
    """
    begin = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    sizes = np.diff(np.append(begin, len(unit)))
    least, most = np.minimum.reduceat(part, begin), np.maximum.reduceat(part, begin)
    of = np.repeat(np.arange(len(begin)), sizes)
    two = (least < most)[of]

    def near(x, y):
        x, y = x[hit := (root[x] != root[y]) & (~two[x] | (part[x] != part[y]))], y[hit]
        for words, distance in ((slice(-2, None), CHECK_DISTANCE), (slice(None), WIDE_DISTANCE)):
            hit = np.bitwise_count(sketches[x, words] ^ sketches[y, words]).sum(axis=1, dtype=np.int64) <= distance
            x, y = x[hit], y[hit]
        return x, y

    at = np.flatnonzero(sizes[of] <= SPARSE)
    for step in range(1, SPARSE):
        at = at[at < len(unit) - step]
        at = at[of[at] == of[at + step]]
        if not len(at):
            break
        x, y = near(at, at + step)
        yield x, y, np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    check = sketches[:, -2:]
    for s, n in zip(begin[sizes > SPARSE].tolist(), sizes[sizes > SPARSE].tolist()):
        e = s + n
        for x in range(s, e, ACROSS[0]):
            end = min(x + ACROSS[0], e)
            for y in range(s + int(np.searchsorted(root[s:e], root[x], "right")), e, ACROSS[1]):
                c, d = check[x:end, None], check[None, y : min(y + ACROSS[1], e)]
                i, j = np.nonzero(np.bitwise_count(c[..., 0] ^ d[..., 0]) + np.bitwise_count(c[..., 1] ^ d[..., 1]) <= CHECK_DISTANCE)
                i, j = i + x, j + y
                i, j = near(i[root[i] < root[j]], j[root[i] < root[j]])
                yield i, j, (i - s) // CELL, (j - s) // CELL


def remaining_pairs(open_rows: DataFrame, roots: DataFrame, nodes: DataFrame, unit: int = UNIT) -> DataFrame:
    """(a, b, cell), a < b: all near pairs of a group whose nodes aren't of one component yet. open_rows: (key, node) from ``proposed_links``; nodes: (node, sketch)."""
    rooted = kept(open_rows.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "open")
    several = rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    rows = rooted.join(several.select("key", F.ceil(F.col("n") / unit).cast("long").alias("parts")), "key").join(nodes.select("node", "sketch"), "node")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), "parts")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    # Each part meets itself and each other part.
    names = ["key", "i", "j", "root", "node", "part"]
    rows = rows.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).select(*names, "sketch")

    def compare(batches):
        held = []
        for batch in batches:
            held.append((np.stack([np.asarray(c) for c in batch.columns[:-1]], axis=1), np.frombuffer(b"".join(batch.column(len(names)).to_pylist()), np.uint64).reshape(-1, BITS // 64)))
            if sum(len(h[0]) for h in held) < BLOCK:
                continue
            found, sketches = (np.concatenate(h) for h in zip(*held))
            last = int(np.argmax((found[:, :3] == found[-1, :3]).all(axis=1)))  # the last unit may go on
            if last:
                yield from told(found[:last], sketches[:last])
            held = [(found[last:], sketches[last:])]
        if held:
            yield from told(*(np.concatenate(h) for h in zip(*held)))

    def told(found, sketches):
        if not len(found):
            return
        new = np.concatenate([[True], (found[1:, :3] != found[:-1, :3]).any(axis=1)])
        for x, y, p, q in pairs_across(np.cumsum(new), found[:, 5], found[:, 3], sketches):
            cell = mix(found[x, 0])
            for k in (found[x, 1], found[x, 2], p, q):
                cell = mix(cell ^ k.view(np.uint64))
            a, b = found[x, 4], found[y, 4]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(cell.view(np.int64))], ["a", "b", "cell"])

    pairs = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "root", "node").mapInArrow(compare, "a long, b long, cell long")
    return pairs.groupBy("a", "b").agg(F.min("cell").alias("cell"))


def shingle_sets(ends: DataFrame, marked: DataFrame) -> DataFrame:
    """(node, s): the sorted set of shingles of each of the different nodes ``ends``."""

    def sets(batches):
        for batch in batches:
            found = [shingles(t or b"").view(np.int64) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "s"])

    rows = marked.groupBy("node").agg(F.min("row_key").alias("row_key")).join(ends, "node", "left_semi").select("row_key")
    return kept(marked.join(rows, "row_key", "left_semi").select("node", "text").mapInArrow(sets, "node long, s array<bigint>"), "shingles")


def ends_of(links: DataFrame, *names: str) -> DataFrame:
    """The different nodes of pairs (a, b), in each value of the columns ``names``."""
    return links.select(*names, F.col("a").alias("node")).union(links.select(*names, F.col("b").alias("node"))).distinct()


def verified_links(links: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of ``SIMILARITY`` or more. found: (node, s) of all their nodes."""
    both = links.join(found.toDF("a", "sa"), "a").join(found.toDF("b", "sb"), "b")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    return both.where(F.col("n") >= F.lit(SIMILARITY) * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b")


def common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many numbers each of the others has in common with the sorted ``one``."""
    if not len(one):
        return np.zeros(len(others), np.int64)
    x = np.concatenate(others)
    hits = np.append(0, np.cumsum(one[np.minimum(np.searchsorted(one, x), len(one) - 1)] == x))
    ends = np.cumsum([len(o) for o in others])
    return hits[ends] - hits[np.append(0, ends[:-1])]


def verified_in_cells(pairs: DataFrame, found: DataFrame, marked: DataFrame) -> DataFrame:
    """The same for pairs (a, b, cell): a set goes once to each cell that has pairs of it, so many pairs of the same nodes don't carry their sets each. Nodes that ``found`` hasn't are made from their texts."""
    ends = kept(ends_of(pairs, "cell"), "ends")
    missing = kept(ends.select("node").distinct().join(found.select("node"), "node", "left_anti"), "missing")
    sets = found if missing.isEmpty() else found.union(shingle_sets(missing, marked))
    sets = sets.join(F.broadcast(ends) if ends.count() <= BROADCAST_ENDS else ends, "node").select("cell", "node", F.lit(None).cast("long").alias("other"), "s")
    rows = sets.union(pairs.select("cell", F.col("a").alias("node"), F.col("b").alias("other"), F.lit(None).cast("array<bigint>").alias("s")))

    def check(batches):
        at, sets = None, {}
        for batch in batches:
            cell, node, is_pair = np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2).is_valid())
            other, s = np.asarray(batch.column(2).fill_null(0)), batch.column(3)
            begin = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (node[1:] != node[:-1]) | (is_pair[1:] != is_pair[:-1])])).tolist() if len(cell) else []
            a, b = [], []
            for k, e in zip(begin, [*begin[1:], len(cell)]):
                if cell[k] != at:
                    at, sets = cell[k], {}
                if not is_pair[k]:
                    sets[int(node[k])] = np.array(s[k].values).view(np.uint64)
                    continue
                one, others = sets[int(node[k])], [sets[o] for o in other[k:e].tolist()]
                n = common(one, others)
                hit = n >= SIMILARITY * (len(one) + np.array([len(o) for o in others]) - n)
                a.append(node[k:e][hit])
                b.append(other[k:e][hit])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return rows.repartition("cell").sortWithinPartitions("cell", F.col("other").isNotNull(), "node", "other").mapInArrow(check, "a long, b long")


def near_copy_roots(marked: DataFrame) -> DataFrame:
    """(node, root) for each node that isn't its component's root. marked: from ``mark_rows``, written down."""
    nodes = kept(marked.groupBy("node").agg(F.first("sketch").alias("sketch")), "nodes")
    links, open_rows = proposed_links(nodes)
    links = kept(links, "proposed")
    found = shingle_sets(ends_of(links), marked)
    roots = kept(connected_components(verified_links(links, found)), "roots")
    pairs = kept(remaining_pairs(open_rows, roots, nodes), "remaining")
    if pairs.isEmpty():
        return roots
    return connected_components(roots.toDF("a", "b").union(verified_in_cells(pairs, found, marked)))


def rejected_rows(marked: DataFrame) -> DataFrame:
    """row_key of all rows but one of each component: the one with the smallest id (null ids last), the first row of equals."""
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key")).alias("first")
    nodes = marked.groupBy("node").agg(first)
    rooted = nodes.join(near_copy_roots(marked), "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    return marked.select("row_key").join(rooted.select(F.col("first.row_key").alias("row_key")), "row_key", "left_anti")
