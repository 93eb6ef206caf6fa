"""Exact top-k search by distributed histogram selection.

Every query is scored against every vector, block by block. Scores are integers, so the k-th highest of each query is located
like a number's digits: a histogram of its scores over the whole range, summed over all blocks, says which cell holds it; the
next histogram divides that cell; and so on until a cell is one score. Then only scores from there on are given out, ties cut
by vector id, and ranked. Large blocks of queries meet slices of blocks of vectors, so no task and no broadcast holds all of
either, and a vector is sent as often as there are blocks of ``QUERY_BYTES`` of queries.

A task adds up the histograms of its slice and tells only the cells down to the one where its own count reaches what is needed:
lower ones can't hold the k-th.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootloom.llm.shared import kept

#: Vectors of a block at most, and their bytes at most as 64-bit integers, of queries and of all; queries scored at once.
QUERY_BLOCK, QUERY_BYTES, VECTOR_BLOCK, VECTOR_BYTES, STEP = 16_384, 64 << 20, 1024, 4 << 20, 512
#: Vector blocks that one query block meets in a group, on average at most.
SLICE = 32
CELLS = 256
#: Chosen pairs that a task holds before it cuts them to the best of each query; QUERY_BLOCK * k are left at most.
HELD = 1 << 21
_BLOCK = "block long, n int, dim int, kind string, ids binary, data binary, norm double"


def integer_vectors(vectors: DataFrame, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x), x as double; without null ids, null vectors, and null or non-finite components."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def pack_blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors each, sorted by id, in the narrowest integer type; shorter vectors are filled with zeros."""

    def block(number: int, own: np.ndarray, flat: np.ndarray, lens: np.ndarray):
        data = np.zeros((len(own), int(lens.max(initial=0))), np.int64)
        data[np.repeat(np.arange(len(own)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
        order = np.argsort(own, kind="stable")
        kind = next(k for k in ("i1", "i2", "i4", "i8") if k == "i8" or np.abs(data).max(initial=0) < np.iinfo(k).max)
        norm = float(np.sqrt((data.astype(float) ** 2).sum(axis=1).max(initial=0)))
        row = [number, len(own), data.shape[1], kind, own[order].tobytes(), data[order].astype(kind).tobytes(), norm]
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True))], schema)

    def pack(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            lists, at = batch.column(1), 0
            ids, ends = batch.column(0).to_numpy(), lists.offsets.to_numpy().astype(np.int64)
            flat, lens = lists.flatten().to_numpy(), np.diff(ends)
            while at < len(ids):
                end = min(len(ids), at + size - sum(len(h[0]) for h in held))
                held.append((ids[at:end], flat[ends[at] - ends[0] : ends[end] - ends[0]], lens[at:end]))
                at = end
                if sum(len(h[0]) for h in held) == size:
                    yield block(number, *map(np.concatenate, zip(*held, strict=True)))
                    number, held = number + 1, []
        if held:
            yield block(number, *map(np.concatenate, zip(*held, strict=True)))

    schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("data", pa.binary()), ("norm", pa.float64())])
    return rows.select("vec_id", "v").mapInArrow(pack, _BLOCK)


def _unpack(row: dict, side: str, dtype) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(row[side + "data"], row[side + "kind"]).reshape(row[side + "n"], row[side + "dim"])
    return np.frombuffer(row[side + "ids"], np.int64), data.astype(dtype)


def _scores(asked: dict, blocks: list[dict], dtype):
    """For runs of a block's queries against each vector block: (first query, vector ids, integer scores, which pairs count: not those of one id)."""
    q_ids, q = _unpack(asked, "q_", dtype)
    for block in blocks:
        ids, v = _unpack(block, "", dtype)
        d = min(q.shape[1], v.shape[1])
        for at in range(0, len(q), STEP):
            yield at, ids, (q[at : at + STEP, :d] @ v[:, :d].T).astype(np.int64), q_ids[at : at + STEP, None] != ids[None, :]


def _meet(queries: DataFrame, vectors: DataFrame, state: DataFrame, n_queries: int, n_slices: int, solve, schema: str) -> DataFrame:
    """``solve`` over each query block (with its state) and slice of vector blocks: a group has one of the former and SLICE of the latter."""
    per_block = state.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("row", "lo", "need"))).alias("state"))  # QUERY_BLOCK rows
    names = [F.col(c).alias("q_" + c) for c in ("n", "dim", "kind", "ids", "data")]
    left = queries.join(per_block, "q").select("q", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("slice"), "state.lo", "state.need", *names)
    right = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("q"), "slice", "n", "dim", "kind", "ids", "data")
    return left.groupBy("q", "slice").cogroup(right.groupBy("q", "slice")).applyInArrow(solve, schema)


def exact_top_k(rows: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the ``k`` rows of highest integer inner product, or all, if fewer.

    ``rows``: (vec_id, v array<long>). Ties go to the smaller vec_id. Rows that share a query's id, itself among them, are not
    its candidates; a query id that is repeated is ranked for each of its rows; vectors of different lengths are compared over
    the shorter one (what is missing counts as zero); no queries or no other rows give no result. Scores are 64-bit integers and wrap beyond.
    """
    n_rows, widest = rows.agg(F.count_if(is_query), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    size, v_size = (max(1, min(most, room // (8 * max(widest, 1)))) for most, room in ((QUERY_BLOCK, QUERY_BYTES), (VECTOR_BLOCK, VECTOR_BYTES)))
    vectors = kept(pack_blocks(rows, v_size), "vector-blocks")
    asked = rows.where(is_query)
    queries = kept(pack_blocks(asked.repartition(-(-n_rows // size)) if n_rows else asked, size), "query-blocks")
    (nq, q_norm), (nv, v_norm) = (tuple(b.agg(F.count("*"), F.max("norm")).first()) for b in (queries, vectors))
    if not nq:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Blocks are numbered by their keys alone, one for QUERY_BLOCK queries; their data isn't moved for that.
    numbers = queries.select("block", (F.row_number().over(Window.orderBy("block")) - 1).cast("int").alias("q"))
    queries = queries.join(kept(numbers, "query-numbers"), "block")
    # Slices of SLICE blocks, or smaller ones where all cores wouldn't have one.
    n_slices = max(-(-nv // SLICE), min(nv, -(-2 * rows.sparkSession.sparkContext.defaultParallelism // nq)))
    vectors = vectors.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(n_slices)).cast("int"))
    bound = min(math.ceil(q_norm * v_norm) + 1, 1 << 61)
    dtype = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 52 else np.int64
    passes = 1
    while CELLS**passes < 2 * bound + 1:
        passes += 1
    state = queries.select("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("row"), F.lit(-bound).cast("long").alias("lo"), F.lit(k).cast("long").alias("need"))
    for p in range(passes):
        shift = 8 * (passes - 1 - p)
        counts = _meet(queries, vectors, state, nq, n_slices, _histogram(shift, dtype), "q int, row int, cell int, n long")
        summed = counts.groupBy("q", "row", "cell").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q", "row").orderBy(F.col("cell").desc())  # CELLS rows at most
        above = summed.withColumn("upto", F.sum("n").over(down))
        # The first cell down from the top that reaches the need; if none does, everything is wanted: the lowest cell.
        joined = state.join(above, ["q", "row"], "left")
        reached = F.max(F.when(F.col("upto") >= F.col("need"), F.struct("cell", (F.col("upto") - F.col("n")).alias("over"))))
        found = joined.groupBy("q", "row", "lo", "need").agg(reached.alias("hit"))
        state = kept(
            found.select(
                "q", "row",
                (F.col("lo") + F.coalesce(F.col("hit.cell"), F.lit(0)).cast("long") * (1 << shift)).alias("lo"),
                (F.col("need") - F.when(F.col("hit").isNotNull(), F.col("hit.over")).otherwise(0)).alias("need"),
            ),
            "cells",
        )
    chosen = _meet(queries, vectors, state, nq, n_slices, _choose(k, dtype), "q int, row int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q", "row").orderBy(F.col("score").desc(), "vec_id"))
    return chosen.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _histogram(shift: int, dtype):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = left.to_pylist()[0]
        lo, need = np.array(asked["lo"], np.int64), np.array(asked["need"], np.int64)
        hist = np.zeros((len(lo), CELLS), np.int64)
        for at, _, scores, counts in _scores(asked, right.to_pylist(), dtype):
            n = len(scores)
            cell = (scores - lo[at : at + n, None]) >> shift
            inside = counts & (cell >= 0) & (cell < CELLS)
            flat = (cell + np.arange(n)[:, None] * CELLS)[inside]
            hist[at : at + n] += np.bincount(flat, minlength=n * CELLS).reshape(n, CELLS)
        above = hist[:, ::-1].cumsum(axis=1)[:, ::-1] - hist
        r, c = np.nonzero((hist > 0) & (above < need[:, None]))
        return pa.table([np.full(len(r), asked["q"], np.int32), r.astype(np.int32), c.astype(np.int32), hist[r, c]], ["q", "row", "cell", "n"])

    return run


def _choose(k: int, dtype):
    def best(found):
        """The ``k`` best of each query's row, so that very many ties don't pile up."""
        row, query, vec, score = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((vec, -score, row))
        row, query, vec, score = (x[order] for x in (row, query, vec, score))
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
        first = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row)))) < k
        return [x[first] for x in (row, query, vec, score)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = left.to_pylist()[0]
        q_ids = np.frombuffer(asked["q_ids"], np.int64)
        all_lo, all_need = np.array(asked["lo"], np.int64), np.array(asked["need"], np.int64)
        found = [[np.empty(0, np.int64)] * 4]
        for at, ids, scores, counts in _scores(asked, right.to_pylist(), dtype):
            lo, need = all_lo[at : at + len(scores), None], all_need[at : at + len(scores), None]
            ties = counts & (scores == lo)
            # Ids ascend within a block: of its ties at the k-th score, the first ``need`` are enough.
            r, c = np.nonzero((counts & (scores > lo)) | (ties & (np.cumsum(ties, axis=1) <= need)))
            found.append([at + r, q_ids[at + r], ids[c], scores[r, c]])
            if sum(len(f[0]) for f in found) > HELD:
                found = [best(found)]
        row, query, vec, score = best(found)
        return pa.table([np.full(len(row), asked["q"], np.int32), row.astype(np.int32), query, vec, score], ["q", "row", "query_id", "vec_id", "score"])

    return run
