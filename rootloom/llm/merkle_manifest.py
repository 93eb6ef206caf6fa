"""Merkle manifest of a dataset, with a witness for every row, by streaming aligned append.

Rows are leaves, in order within their group (a source); while several nodes are left, every ``FAN`` consecutive ones become
their hash. The groups' roots, in order, likewise give the root of the dataset.

Trees are cut into aligned blocks of ``FAN ** BLOCK_LEVELS`` leaves, and a task takes a block as a stream. A leaf that is
appended starts an empty witness, attached to the open subtree that it is; when a node gets its last sibling it is closed into
the next level, and what is attached to each of its children is extended by the hashes of the others. So a witness is
complete when its block is, and a witness's parts are shared by all leaves below. Block roots are then nothing but leaves that
are appended further up, by the same code, until one root is left; what is above a block is sent to it once, with the block.

No task holds more than a block, whatever the size of a group: a hot source is many blocks. Digests are 32 bytes in tables and
64 hexadecimal digits where they are hashed.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rootloom.llm.shared import kept

FAN, FAN_BITS, BLOCK_LEVELS = 16, 4, 3
BLOCK_BITS = FAN_BITS * BLOCK_LEVELS
#: Broadcast only up to so many rows of offsets (about 50 bytes each); beyond, the join shuffles.
BROADCAST_PARTS = 100_000
WITNESS = "array<struct<left: string, right: string>>"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def levels_of(n: Column) -> Column:
    """Levels above n leaves: the least k with FAN^k >= n, by the bits of n - 1."""
    bits = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    return F.ceil(bits / FAN_BITS).cast("int")


class WitnessStream:
    """Appends the leaves of one block in order; ``levels`` is how many levels the block is closed to."""

    def __init__(self, levels: int):
        self.levels = levels
        self.open: list[list[tuple[str, list[list]]]] = [[] for _ in range(levels + 1)]

    def append(self, digest: str) -> list[tuple[str, str]]:
        """The leaf's witness: hashes left and right of it on each level, from the leaf up; it grows as siblings are completed."""
        witness: list[tuple[str, str]] = []
        self._add(0, digest, [witness])
        return witness

    def append_only(self, digest: str) -> None:
        """The same without a witness."""
        self._add(0, digest, [])

    def _add(self, level: int, digest: str, attached: list[list]) -> None:
        self.open[level].append((digest, attached))
        if level < self.levels and len(self.open[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        nodes, self.open[level] = self.open[level], []
        digests = [d for d, _ in nodes]
        for k, (_, attached) in enumerate(nodes):
            sides = ("".join(digests[:k]), "".join(digests[k + 1 :]))
            for witness in attached:
                witness.append(sides)
        self._add(level + 1, sha("".join(digests)), [w for _, attached in nodes for w in attached])

    def close(self) -> str:
        """The block's root: what is open is completed with the siblings it has."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.open[self.levels][0][0]


def fold(digest: str, witness: list[tuple[str, str]]) -> str:
    """The root that a leaf and its witness give."""
    for left, right in witness:
        digest = sha(left + digest + right)
    return digest


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``node`` (from 0, in the order given, within the group) and ``n`` (rows of the group): range partitions and their counts, no window over a group."""
    by = [F.asc_nulls_first(c) for c in [group, *order]]
    names = rows.columns

    def count(batches):
        part, at, last = TaskContext.get().partitionId(), -1, None
        for batch in batches:
            places = []
            for g in batch.column(names.index(group)).to_pylist():
                at = at + 1 if last == (g,) else 0
                last = (g,)
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(places), pa.int64()), pa.array(places, pa.int64())], [*names, "_part", "_k"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_part", T.LongType()), T.StructField("_k", T.LongType())])
    placed = kept(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(count, schema), "numbered")
    # One row for each group and each partition that has rows of it.
    parts = placed.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count("*").alias("_m"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = kept(parts.withColumns({"_before": F.coalesce(F.sum("_m").over(before), F.lit(0)), "n": F.sum("_m").over(Window.partitionBy("_g"))}).drop("_m"), "parts")
    if parts.count() <= BROADCAST_PARTS:
        parts = F.broadcast(parts)
    return placed.join(parts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).select(*names, (F.col("_k") + F.col("_before")).alias("node"), "n")


def _by_block(nodes: DataFrame, *within: str) -> DataFrame:
    """Each block in one partition, its rows in order."""
    return nodes.withColumn("block", F.shiftright("node", BLOCK_BITS)).repartition("g", "block").sortWithinPartitions("g", "block", *within, "node")


def _runs(batches, key: int = 2):
    """(batch columns as lists, first row, end) of runs of rows with the same first ``key`` columns within a batch, and whether the run goes on from before."""
    last = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        at = 0
        for k in range(batch.num_rows):
            now = tuple(c[k] for c in columns[:key])
            if now != last:
                if k > at:
                    yield columns, at, k, last
                at, last = k, now
        if batch.num_rows > at:
            yield columns, at, batch.num_rows, last


def close_blocks(nodes: DataFrame) -> DataFrame:
    """(g, node, n, digest) of the blocks' roots from those of their leaves: nodes of the next round."""

    def close(batches):
        stream, at = None, None
        done: list[tuple] = []

        def result():
            return pa.RecordBatch.from_pylist([dict(zip(("g", "node", "n", "digest"), r)) for r in done], schema=arrow)

        for (_, _, levels, n, digests), a, b, key in _runs(batches):
            if key != at:
                if stream:
                    done.append((*at_row, bytes.fromhex(stream.close())))
                stream, at, at_row = WitnessStream(levels[a]), key, (*key, -(-n[a] >> BLOCK_BITS))
            for d in digests[a:b]:
                stream.append_only(d.hex())
            if len(done) >= 5000:
                yield result()
                done = []
        if stream:
            done.append((*at_row, bytes.fromhex(stream.close())))
        if done:
            yield result()

    group = nodes.schema["g"].dataType
    arrow = to_arrow_schema(T.StructType([T.StructField("g", group), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType())]))
    levels = F.least(F.lit(BLOCK_LEVELS), levels_of(F.col("n"))).alias("levels")
    rows = _by_block(nodes).select("g", "block", levels, "n", "digest")
    return rows.mapInArrow(close, T.StructType([T.StructField("g", group), T.StructField("node", T.LongType()), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType())]))


def grow(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of nodes (g, node, n, digest) from the leaves up, and (g, digest) of each group's root."""
    rounds = [leaves]
    most = leaves.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    roots = None
    while True:
        above = kept(close_blocks(rounds[-1]), "blocks")
        done = above.where("n = 1").select("g", "digest")
        roots = done if roots is None else roots.union(done)
        most = -(-most >> BLOCK_BITS)
        if most <= 1:
            return rounds, roots
        rounds.append(above.where("n > 1"))


def witness_rows(nodes: DataFrame, above: DataFrame, carried: list[str], digest: bool = False) -> DataFrame:
    """(g, node, digest, ``carried`` of the nodes and of what is above) with the witness of each node, up to the root.

    ``above``: (g, block, witness, and other columns) for each block. ``digest``: instead of the witness proof_sha256 and
    folded_root, which is folded from ``claimed`` (where it isn't null, else from the digest) and the witness.
    """
    own = [c for c in carried if c in nodes.columns]
    handed = [c for c in carried if c not in nodes.columns]
    leaf_row = F.lit(1).alias("leaf_row")
    claimed = F.col("claimed") if "claimed" in nodes.columns else F.lit(None).cast("binary").alias("claimed")
    levels = F.least(F.lit(BLOCK_LEVELS), levels_of(F.col("n"))).alias("levels")
    none = F.lit(None).cast(WITNESS)
    both = nodes.select("g", "node", leaf_row, levels, "digest", claimed, none.alias("witness"), *own, *[F.lit(None).cast(above.schema[c].dataType).alias(c) for c in handed]).unionByName(
        above.select("g", F.shiftleft("block", BLOCK_BITS).alias("node"), F.lit(0).alias("leaf_row"), F.lit(0).alias("levels"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("binary").alias("claimed"), "witness", *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in own], *handed)
    )
    rows = _by_block(both, "leaf_row").select("g", "block", "node", "leaf_row", "levels", "digest", "claimed", "witness", *own, *handed)
    out = [T.StructField("g", rows.schema["g"].dataType), T.StructField("node", T.LongType()), T.StructField("digest", T.BinaryType()), *(rows.schema[c] for c in own + handed)]
    out += [T.StructField("proof_sha256", T.StringType()), T.StructField("folded_root", T.StringType())] if digest else [T.StructField("witness", rows.schema["witness"].dataType)]
    schema = T.StructType(out)

    def extend(batches):
        stream, at, head, waiting = None, None, None, []

        def finish():
            stream.close()
            outer = [(w["left"], w["right"]) for w in head[0]]
            tail = "".join(a + b for a, b in outer)
            results = []
            for node, digest_of, start, witness, mine in waiting:
                if digest:
                    own_part = "".join(a + b for a, b in witness)
                    last = [sha(own_part + tail), fold(start, witness + outer)]
                else:
                    last = [[{"left": a, "right": b} for a, b in witness + outer]]
                results.append((at[0], node, digest_of, *mine, *head[1], *last))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*results), arrow)], schema=arrow)

        for columns, a, b, key in _runs(batches):
            _, _, nodes_at, leaf_rows, levels_at, digests, claims, witnesses, *more = columns
            if key != at:
                if waiting:
                    yield finish()
                stream, at, head, waiting = None, key, None, []
            for k in range(a, b):
                mine = tuple(c[k] for c in more)
                if leaf_rows[k]:
                    stream = stream or WitnessStream(levels_at[k])
                    waiting.append((nodes_at[k], digests[k], (digests[k] if claims[k] is None else claims[k]).hex(), stream.append(digests[k].hex()), mine[: len(own)]))
                else:
                    head = (witnesses[k], mine[len(own) :])
        if waiting:
            yield finish()

    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(extend, schema)


def send_down(rounds: list[DataFrame], top: DataFrame, carried: list[str], digest: bool = False) -> DataFrame:
    """Witnesses of the lowest round's nodes; ``top``: (g, witness, and other columns) above each group's root."""
    handed = [c for c in top.columns if c not in ("g", "witness")]
    below = None
    for level in range(len(rounds) - 1, -1, -1):
        nodes = rounds[level]
        # A group of one block has above it what is above the group; the others' blocks are nodes of the next round.
        single = nodes.where(F.col("n") <= 1 << BLOCK_BITS).select("g").distinct()
        above = top.join(single.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g"))).select("g", F.lit(0).cast("long").alias("block"), "witness", *handed)
        if below is not None:
            above = above.unionByName(below.select("g", F.col("node").alias("block"), "witness", *handed))
        below = witness_rows(nodes, above, (carried if level == 0 else []) + handed, digest and level == 0)
        if level:
            below = kept(below, "witnesses")
    return below


@dataclass
class Manifest:
    """leaves: (g, node, n, digest, id, claimed). roots: (g, digest). root: 64 hexadecimal digits, null if there are no rows. rounds, top: for witnesses."""

    leaves: DataFrame
    roots: DataFrame
    root: str | None
    rounds: list[DataFrame]
    top: DataFrame

    def witnesses(self, digest: bool = False) -> DataFrame:
        """(g, node, id, digest, subroot, root, witness array of (left, right) from the leaf up) of each leaf; ``digest``: see ``witness_rows``."""
        leaves = [self.leaves, *self.rounds[1:]]
        return send_down(leaves, self.top, ["id"], digest)


def build_manifest(leaves: DataFrame) -> Manifest:
    """From rows (g, id, digest binary, claimed binary: what is checked instead of the digest, or null).

    Leaves ascend by id within a group, those of equal id by digest; null groups and null ids come first. An empty table has no root.
    """
    placed = kept(numbered(leaves.select("g", "id", "digest", "claimed"), "g", ["id", "digest"]), "leaves")
    rounds, roots = grow(placed)
    roots = kept(roots, "roots")
    tops = roots.select(F.lit(0).alias("all"), F.col("g").alias("group"), "digest")
    over = kept(numbered(tops, "all", ["group"]), "groups").select(F.col("all").alias("g"), "node", "n", "digest", F.col("group").alias("group"))
    upper, last = grow(over)
    found = last.first()
    root = found["digest"].hex() if found else None
    nothing = leaves.sparkSession.createDataFrame([(0, [])], f"g int, witness {WITNESS}")
    top = send_down(upper, nothing, ["group"])
    top = kept(top.select(F.col("group").alias("g"), "witness", F.lower(F.hex("digest")).alias("subroot"), F.lit(root).cast("string").alias("root")), "top")
    return Manifest(placed, roots, root, rounds, top)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(g, id, digest, claimed) of documents: the leaf hashes doc_id, source, lang, n_chars and text; claimed, of a fifth of the ids: with the text's A-Z lower-cased."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_hash(*columns, plain))
    return docs.select(F.col("source").alias("g"), F.col("doc_id").alias("id"), leaf_hash(*columns, F.col("text")).alias("digest"), tampered.alias("claimed"))


def audit_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row, tampered with in a fifth of the ids.

    Null fields are hashed as ``-``; a null id isn't tampered with; repeated rows are leaves each; texts of any length are hashed
    whole; an empty table gives no rows; other columns aren't read.
    """
    found = build_manifest(document_leaves(docs)).witnesses(digest=True)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("digest")).alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _levels_sql(name: str, key: str, most: int) -> str:
    """CTEs ``{name}0`` (given: key, i, d) up to ``{name}{most}``: what is left of each level; a group of one node stays as it is."""
    out = []
    for k in range(1, most + 1):
        out.append(
            f"{name}{k} as (select {key}, case when n = 1 then i else i // 16 end as i, case when max(n) = 1 then max(d) else sha256(string_agg(d, '' order by i)) end as d "
            f"from (select *, count(*) over (partition by {key}) as n from {name}{k - 1}) group by {key}, case when n = 1 then i else i // 16 end)"
        )
    return ",\n".join(out)


def _proof_sql(name: str, key: str, most: int, start: str) -> str:
    """CTEs ``{name}p0`` (given: id, key, i, d, proof) up to ``{name}p{most}``: the node above, folded, and the siblings so far."""
    out = []
    for k in range(1, most + 1):
        at = start if k == 1 else f"{name}p{k - 1}"
        out.append(
            f"{name}s{k} as (select {key}, i // 16 as up, count(*) over (partition by {key}) as n, i, d from {name}{k - 1}),\n"
            f"{name}p{k} as (select p.id, p.{key}, case when max(s.n) = 1 then max(p.i) else max(p.i) // 16 end as i, "
            f"case when max(s.n) = 1 then max(p.d) else sha256(string_agg(case when s.i = p.i then p.d else s.d end, '' order by s.i)) end as d, "
            f"p.proof || coalesce(string_agg(case when s.i <> p.i then s.d end, '' order by s.i), '') as proof "
            f"from {at} p join {name}s{k} s on s.{key} is not distinct from p.{key} and s.up = p.i // 16 group by p.id, p.{key}, p.proof)"
        )
    return ",\n".join(out)


#: For up to 16^3 rows of a source and 16^3 sources. CRC-32 bit by bit.
ORACLE = f"""
with crc as (
  select *, row_number() over () as id, case when doc_id is not null then xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, range(8 * length(doc_id::varchar))), lambda c, b:
    case when (case when b % 8 = 0 then xor(c, ord(substr(doc_id::varchar, b // 8 + 1, 1))::bigint) else c end) & 1 = 1
      then xor((case when b % 8 = 0 then xor(c, ord(substr(doc_id::varchar, b // 8 + 1, 1))::bigint) else c end) >> 1, 3988292384::bigint)
      else (case when b % 8 = 0 then xor(c, ord(substr(doc_id::varchar, b // 8 + 1, 1))::bigint) else c end) >> 1 end)) end as crc from documents),
field as (
  select id, doc_id, source, crc, text,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') as head,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from crc),
leaf as (
  select id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    case when crc % 5 = 0 then sha256(head || coalesce(strlen(low) || ':' || low, '-')) end as claimed from field),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from leaf),
t0 as (select source, i, leaf as d from placed),
{_levels_sql("t", "source", 3)},
r0 as (select 0 as one, source, row_number() over (order by source nulls first) - 1 as i, d from t3),
{_levels_sql("r", "one", 3)},
start as (select id, source, i, coalesce(claimed, leaf) as d, '' as proof from placed),
{_proof_sql("t", "source", 3, "start")},
middle as (select p.id, 0 as one, r.i, p.d, p.proof from tp3 p join r0 r on r.source is not distinct from p.source),
{_proof_sql("r", "one", 3, "middle")}
select l.doc_id, l.leaf, s.d as subroot, r.d as root, sha256(p.proof) as proof_sha256, p.d as folded_root, p.d = r.d as verified
from placed l join rp3 p on p.id = l.id join t3 s on s.source is not distinct from l.source, r3 r
"""
