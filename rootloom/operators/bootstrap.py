"""Bootstrap intervals of means: n of n draws, by counts of different values instead of rows.

A repetition's counts of the different values of a group are multinomial. They come from binary splitting: of the draws that fall into a range of values,
a binomial number falls into its left half, and so on down to single values. Each split's draw is keyed by (seed, repetition,
range) and inverts the binomial distribution, so results don't depend on how values are dealt out. The draws of parts of a group's values are found
in two steps, of the upper and of the lower levels, and go to the tasks of the parts. Work is repetitions times different values. Where a
range has many values of few rows each, its draws are picked one by one, by a keyed hash: the same distribution, at a fraction of a split's cost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootloom.session import written

#: A prime whose square fits into 64 bits: keyed numbers are mixed below it.
PRIME = 2**31 - 1
#: Different values of a group that a task holds, and standard deviations (and draws) to either side that an inversion looks at.
TOGETHER, DEVIATIONS = 2048, 10
#: A group of very many different values has some PARTS parts, of MOST_TOGETHER values at most.
PARTS, MOST_TOGETHER = 256, 65_536
#: Draws are picked one by one in ranges of so many values or more with so many rows a value or fewer; picks made at once.
PICKED, ROWS_A_VALUE, AT_ONCE = 64, 32, 1 << 17
#: Draws up to which the distributions of all sizes are tabled together (some 1000 x 20 deviations).
TABLED = 20_000
#: The most tasks that draw.
TASKS = 1024
#: Multipliers of a range's level, begin and end, and of the seed and the repetition.
KEYS = {"level": 15485863, "begin": 104729, "end": 32452843, "seed": 7919, "rep": 1299709}
ROUNDS = ((48271, 11), (69621, 7))


def uniform(seed: int, reps: np.ndarray, level: int, begin: int, end: int) -> np.ndarray:
    """One number between 0 and 1 for each repetition: two rounds of an affine step and a fifth power below the prime, which permutes."""
    x = (reps.astype(np.int64) * KEYS["rep"] + (seed * KEYS["seed"] + level * KEYS["level"] + begin * KEYS["begin"] + end * KEYS["end"]) % PRIME) % PRIME
    for a, c in ROUNDS:
        x = (x * a + c) % PRIME
        y = x * x % PRIME
        x = y * y % PRIME * x % PRIME
    return (x + 0.5) / PRIME


def binomial(n: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """For each n and u the least k with P(X <= k) > u, X binomial(n, p)."""
    if p <= 0 or p >= 1:
        return np.zeros_like(n) if p <= 0 else n.copy()
    out = np.zeros_like(n)
    sizes, row = np.unique(n, return_inverse=True)
    if len(sizes) > 1 and sizes[-1] <= TABLED:
        # All sizes' distributions side by side, from their own least k on; the same steps as below.
        spread = DEVIATIONS * np.sqrt(sizes * p * (1 - p)) + DEVIATIONS
        first = np.maximum(0, np.floor(sizes * p - spread)).astype(np.int64)
        last = np.minimum(sizes, np.ceil(sizes * p + spread)).astype(np.int64)
        k = first[:, None] + np.arange((last - first).max() + 1)
        inside = k[:, 1:] <= last[:, None]
        steps = np.where(inside, np.log(np.where(inside, (sizes[:, None] - k[:, :-1]) / k[:, 1:], 1.0)) + np.log(p / (1 - p)), -np.inf)
        log = np.concatenate([np.zeros((len(sizes), 1)), np.cumsum(steps, axis=1)], axis=1)
        mass = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
        at = u * mass[row, -1]
        low, high = np.zeros(len(n), np.int64), np.full(len(n), k.shape[1])
        while (open_ := low < high).any():  # a binary search for each draw
            mid = (low + high) // 2
            right = open_ & (mass[row, np.minimum(mid, k.shape[1] - 1)] <= at)
            low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
        return first[row] + np.minimum(low, (last - first)[row])
    for m in sizes:
        spread = DEVIATIONS * np.sqrt(m * p * (1 - p)) + DEVIATIONS
        k = np.arange(max(0, int(np.floor(m * p - spread))), min(m, int(np.ceil(m * p + spread))) + 1)
        log = np.append(0.0, np.cumsum(np.log((m - k[:-1]) / k[1:]) + np.log(p / (1 - p))))
        mass = np.cumsum(np.exp(log - log.max()))
        mine = n == m
        out[mine] = k[np.minimum(np.searchsorted(mass, u[mine] * mass[-1], side="right"), len(k) - 1)]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of whole numbers (splitmix's output)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def is_picked(counts: np.ndarray) -> bool:
    return len(counts) >= PICKED and counts.sum() <= ROWS_A_VALUE * len(counts)


def picks(draws: np.ndarray, counts: np.ndarray, seed: int, level: int):
    """(first repetition, repetition from there on of each draw, its place), some repetitions at a time: each draw takes one of all rows of the values, each as likely."""
    step, rows = np.uint64(0x9E3779B97F4A7C15), int(counts.sum())
    place = np.repeat(np.arange(len(counts)), counts)
    key = np.array([seed % 2**64, level % 2**64], np.uint64)
    keys = _mix(_mix(_mix(key[:1] + step) ^ key[1:] + step) + np.arange(len(draws), dtype=np.uint64) * step)
    before, at = np.append(0, np.cumsum(draws)), 0
    while at < len(draws):
        end = max(at + 1, int(np.searchsorted(before, before[at] + AT_ONCE, "right")) - 1)
        n = draws[at:end]
        rep = np.repeat(np.arange(end - at), n)
        nth = np.arange(1, before[end] - before[at] + 1) - (before[at:end] - before[at])[rep]
        u = (_mix(_mix(keys[at:end])[rep] + nth.astype(np.uint64) * step) >> np.uint64(11)) * 2.0**-53
        yield at, rep, place[(u * rows).astype(np.int64)]
        at = end


def sums_of(draws: np.ndarray, values: np.ndarray, counts: np.ndarray, seed: int, level: int) -> np.ndarray:
    """The sum of the values drawn in each repetition, by the draws of ``counts_of``."""
    sums = np.zeros(len(draws))
    if is_picked(counts):
        for at, rep, place in picks(draws, counts, seed, level):
            found = np.bincount(rep, values[place])
            sums[at : at + len(found)] = found
        return sums
    for place, drawn in counts_of(draws, counts, seed, level):
        sums += values[place] * drawn
    return sums


def counts_of(draws: np.ndarray, counts: np.ndarray, seed: int, level: int):
    """(place, draws of each repetition) of each value, from the draws that fall into all of them."""
    if is_picked(counts):
        found = np.zeros((len(counts), len(draws)), np.int64)
        for at, rep, place in picks(draws, counts, seed, level):
            np.add.at(found, (place, at + rep), 1)
        yield from enumerate(found)
        return
    before = np.append(0, np.cumsum(counts))
    reps = np.arange(len(draws))
    stack = [(0, len(counts), draws)]
    while stack:
        begin, end, n = stack.pop()
        if end - begin == 1:
            yield begin, n
            continue
        mid = (begin + end) // 2
        share = (before[mid] - before[begin]) / (before[end] - before[begin])
        left = binomial(n, share, uniform(seed, reps, level, begin, end))
        stack += [(begin, mid, left), (mid, end, n - left)]


def bootstrap_means(rows: DataFrame, keys: list[str], value: str, reps: int, seed: int = 7, together: int = TOGETHER) -> DataFrame:
    """(keys, rep, mean): the mean of n draws of a group's n values with replacement, in each repetition."""
    values = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    values = written(values, "values")
    of = [F.col(k) for k in keys] or [F.lit(0).alias("_all")]
    names = keys or ["_all"]
    most = values.groupBy(*of).agg(F.count("*").alias("k")).agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    together = max(together, min(MOST_TOGETHER, most // PARTS))
    bits = max(0, (-(-most // together) - 1).bit_length())
    part = F.pmod(F.xxhash64("_v"), F.lit(1 << bits)).alias("_b") if bits else F.lit(0).cast("long").alias("_b")
    placed = values.select(*of, part, "_v", "_c")
    sizes = written(placed.groupBy(*names, "_b").agg(F.sum("_c").alias("_n")), "sizes")
    number = len(names)
    key_shape = [f"`{n}` {placed.schema[n].dataType.simpleString()}" for n in names]

    def walk(high, low):
        """From ranges of one level, with the draws of each, down to those of a lower one: each split is drawn once."""

        def down(batches):
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    k, inside, total, drawn = row[number:]
                    rows = np.zeros(1 << (high - low), np.int64)
                    for at in inside:
                        rows[at["_at"] - (k << (high - low))] = at["_n"]
                    before = np.append(0, np.cumsum(rows))
                    stack = [(high, k, np.full(reps, before[-1], np.int64) if drawn is None else np.array(drawn, np.int64))]
                    while stack:
                        level, at, n = stack.pop()
                        width = 1 << (level - low)
                        first = (at << (level - low)) - (k << (high - low))
                        whole = before[first + width] - before[first]
                        if not whole:
                            continue
                        if level == low:
                            columns = [pa.array([v], f.type) for v, f in zip(row, batch.schema)]
                            yield pa.RecordBatch.from_arrays([*columns[:number], pa.array([at]), pa.array([int(before[-1]) if total is None else total]), pa.array([n], pa.list_(pa.int64()))], [*names, "_k", "_total", "_draws"])
                            continue
                        share = (before[first + width // 2] - before[first]) / whole
                        left = binomial(n, share, uniform(seed, np.arange(reps), level, at, at + 1))
                        stack += [(level - 1, 2 * at, left), (level - 1, 2 * at + 1, n - left)]

        return down

    def ranges(high, low):
        """(names, _k, _inside): the sizes of the ranges of a level inside each of a higher one."""
        inside = sizes.groupBy(*names, F.shiftright("_b", low).alias("_at")).agg(F.sum("_n").alias("_n"))
        return inside.groupBy(*names, F.shiftright("_at", high - low).alias("_k")).agg(F.collect_list(F.struct("_at", "_n")).alias("_inside"))

    walked = ", ".join([*key_shape, "_k long, _total long, _draws array<bigint>"])
    same, middle, most_tasks = [*names, "_k"], bits // 2, min(TASKS, max(1, sizes.count()))
    upper = ranges(bits, middle).select(*same, "_inside", F.lit(None).cast("long").alias("_total"), F.lit(None).cast("array<bigint>").alias("_draws"))
    upper = written(upper.repartition(most_tasks, *same).mapInArrow(walk(bits, middle), walked), "upper")
    # Few bytes but much work: as many tasks as there are ranges, which adaptive execution doesn't merge.
    lower = upper
    if middle:
        lower = ranges(middle, 0).join(upper, same).select(*same, "_inside", "_total", "_draws")
        lower = written(lower.repartition(most_tasks, *same).mapInArrow(walk(middle, 0), walked), "lower")
    heads = lower.select(*names, F.col("_k").alias("_b"), F.lit(True).alias("_first"), F.lit(None).cast("double").alias("_v"), F.lit(None).cast("long").alias("_c"), "_total", "_draws")
    tails = placed.select(*names, "_b", F.lit(False).alias("_first"), "_v", "_c", F.lit(None).cast("long").alias("_total"), F.lit(None).cast("array<bigint>").alias("_draws"))
    dealt = heads.union(tails).repartition(most_tasks, *names, "_b").sortWithinPartitions(*names, "_b", F.desc("_first"), "_v")

    def draw(batches):
        head, held = None, []

        def finish():
            key, bucket, total, drawn = head
            values, counts = (np.concatenate(h) for h in zip(*held))
            sums = sums_of(np.array(drawn, np.int64), values, counts, seed, -bucket)
            columns = [pa.array([k] * reps, f.type) for k, f in zip(key, fields)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.arange(reps)), pa.array(np.full(reps, total)), pa.array(sums)], [*names, "_rep", "_total", "_s"])

        for batch in batches:
            fields, v, c = list(batch.schema)[:number], batch.column(number + 2).to_numpy(zero_copy_only=False), batch.column(number + 3).fill_null(0).to_numpy()
            starts = np.flatnonzero(batch.column(number + 1).to_numpy(zero_copy_only=False)).tolist()
            if head and len(batch):
                held.append((v[: starts[0]], c[: starts[0]]) if starts else (v, c))
            for k, e in zip(starts, [*starts[1:], len(batch)]):
                if head:
                    yield finish()
                one = [x.slice(k, 1).to_pylist()[0] for x in batch.columns]
                head, held = (one[:number], one[number], one[number + 4], one[number + 5]), [(v[k + 1 : e], c[k + 1 : e])]
        if head:
            yield finish()

    shape = ", ".join([*key_shape, "_rep long, _total long, _s double"])
    # Sums of parts are added as decimals, so that their order changes nothing.
    sums = dealt.mapInArrow(draw, shape).groupBy(*names, "_rep", "_total").agg(F.sum(F.col("_s").cast("decimal(38,12)")).cast("double").alias("_s"))
    return sums.select(*keys, F.col("_rep").alias("rep"), (F.col("_s") / F.col("_total")).alias("mean"))


def bootstrap_ci(rows: DataFrame, keys: list[str], value: str, reps: int = 1000, seed: int = 7, alpha: float = 0.05, together: int = TOGETHER) -> DataFrame:
    """(keys, n, mean, low, high): percentile bootstrap of a mean, by order statistics at floor(alpha / 2 * reps) and its mirror. Nulls don't count."""
    means = written(bootstrap_means(rows, keys, value, reps, seed, together), "means")
    low, high = int(alpha / 2 * reps), min(reps - 1, int((1 - alpha / 2) * reps))
    order = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("mean")  # reps rows for each key
    at = lambda r: F.round(F.max(F.when(F.col("_r") == r, F.col("mean"))), 6)
    ends = means.withColumn("_r", F.row_number().over(order) - 1).groupBy(*keys).agg(at(low).alias("low"), at(high).alias("high"))
    sums = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(F.col(value).cast("double")), 6).alias("mean"))
    return sums.join(ends, keys) if keys else sums.join(F.broadcast(ends), how="left")  # a row each
