"""Best-fit packing by minimum bin slack.

Documents are interchangeable within a length, so the packing is planned on the histogram of lengths, which has at most
``capacity`` entries however large the corpus is. Each planned sequence starts with the longest length left; a subset-sum
dynamic program over the lengths still available, on the bits of one integer, finds the fullest feasible completion. That
combination is then taken out as many times as the counts allow, so planning takes a few thousand steps for any corpus.

Which document takes which planned place is a distributed ranking: pieces get a running number within their length, from
row numbers inside (length, salt) groups plus the sizes of the groups before; no group holds a whole hot length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootloom.llm.chunk_memo import crc32_of_ids, memo_for, tokenizer_path
from rootloom.llm.shared import kept

#: Expected pieces in a group that is ranked in one go.
RANKED_AT_ONCE = 50_000


def fullest_combination(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """{length: times}: holds the longest length that fits, and fills the rest as far as the available lengths can.

    Bit i of ``reach`` says that i is a sum of available lengths, each used as often as it is there. Going back over the
    stages from the longest length, longer pieces are preferred among equally full combinations.
    """
    seed = max((x for x, n in counts.items() if n and x <= capacity), default=0)
    if not seed:
        return {}
    room = capacity - seed
    mask, reach, stages = (1 << (room + 1)) - 1, 1, []
    for length in sorted(x for x in counts if x <= room):
        left = min(counts[length] - (length == seed), room // length)
        before, times = reach, 1
        while left > 0:
            step = min(times, left)
            reach |= (reach << (step * length)) & mask
            left, times = left - step, times * 2
        stages.append((length, before))
    found, total = {seed: 1}, reach.bit_length() - 1
    for length, before in reversed(stages):
        # As many of the longer ones as can be, such that shorter ones make up the rest.
        times = next(k for k in range(min(counts[length] - (length == seed), total // length), -1, -1) if before >> (total - k * length) & 1)
        if times:
            found[length] = found.get(length, 0) + times
            total -= times * length
    return found


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(combination, times it is used)] until no piece is left."""
    left, plan = {x: n for x, n in counts.items() if n > 0}, []
    while left:
        combination = fullest_combination(left, capacity)
        times = min(left[x] // n for x, n in combination.items())
        plan.append((combination, times))
        for x, n in combination.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return plan


def places(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where its runs of places begin, and each run's pieces per sequence, first sequence and offset."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for combination, times in plan:
        offset = 0
        for length in sorted(combination, reverse=True):
            n = combination[length]
            rows.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for length, r in rows.items()}


def document_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and ``end_id``, cut only if there are over ``capacity``."""
    path = tokenizer_path(tokenizer)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def cut(batches):
        memo = memo_for(path)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), memo.encode(pc.fill_null(batch.column(1), "")), strict=True):
                ids = ids if end_id is None else np.append(ids, memo.dtype.type(end_id))
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, piece, start, len(part), crc32_of_ids(part)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows that have a ``length`` of 1 to ``capacity`` and the columns doc_id and piece."""
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    where = places(plan_sequences(counts, capacity))
    salts = max(1, -(-sum(counts.values()) // RANKED_AT_ONCE)) * 4
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("at", rank).join(before, ["length", "salt"]).withColumn("at", (F.col("at") + F.col("before")).cast("long")).drop("before", "salt")
    schema = T.StructType([*ranked.drop("at").schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def assign(batches):
        for batch in batches:
            lengths, at = (np.asarray(batch.column(n)) for n in ("length", "at"))
            sequence, offset = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            order = np.argsort(lengths, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                length = int(lengths[rows[0]])
                begin, each, first, base = where[length]
                run = np.searchsorted(begin, at[rows], "right") - 1
                nth = at[rows] - begin[run]
                sequence[rows] = first[run] + nth // each[run]
                offset[rows] = base[run] + nth % each[run] * length
            keep = [n for n in batch.schema.names if n != "at"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(assign, schema)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 2048, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all documents in sequences of at most ``capacity`` ids.

    Only documents of more ids are cut, into pieces of ``capacity``, the last one shorter. A null text is empty: its end id
    alone (with no end id, empty texts give no piece). A null id is kept as null; repeated rows are packed each; an empty
    table gives no rows; other columns aren't read. Within a sequence, offsets are gapless from 0. Sequence numbers are dense.
    """
    pieces = kept(document_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), "pieces")  # texts are tokenised once
    return pack_pieces(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
