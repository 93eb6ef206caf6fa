"""Order statistics and ranks of groups of any size, without holding or sorting a group in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootloom.session import written

ACCURACY = 10_000
#: The most groups whose statistics are broadcast to their rows (about 100 bytes each).
FEW_GROUPS = 200_000
#: The most rows of a group that a task sorts (about 40 bytes each); of larger ones, quantiles are found by brackets.
WHOLE = 1 << 20


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``groups`` (a row for each group, written down first; rows of other groups are left out).

    Up to ``FEW_GROUPS`` groups go to the rows. A shuffle by the keys would gather and sort each group in one task, and few groups are large ones.
    """
    groups = written(groups, "groups")
    return rows.join(F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups, keys)


def group_quantiles(rows: DataFrame, keys: list[str], value: Column, shares: dict[str, float], whole: int = WHOLE) -> DataFrame:
    """(keys, one column for each of ``shares``): exact quantiles of each group, interpolated between neighbours.

    Groups are counted first. Those of up to ``whole`` rows are sorted, as pairs of a number for the group and the value; larger
    ones are never held or sorted in one task (``_bracketed``). Rows with a null in a key are left out.
    """
    keyed = rows.select(*keys, value.cast("double").alias("_x")).where("_x is not null").dropna(subset=keys)
    sizes = written(keyed.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn("_i", F.monotonically_increasing_id()), "sizes")
    most, n_groups = sizes.agg(F.max("_n"), F.count("*")).first()
    numbered = keyed.join(F.broadcast(sizes) if n_groups <= FEW_GROUPS else sizes, keys)
    if (most or 0) <= whole:
        return _sorted(numbered, sizes, keys, shares)
    small = _sorted(numbered.where(F.col("_n") <= whole), sizes.where(F.col("_n") <= whole), keys, shares)
    return small.unionByName(_bracketed(numbered.where(F.col("_n") > whole).select(*keys, "_x"), keys, shares))


def _place(share: Column | float) -> Column:
    """A quantile's place in a group of ``_n`` rows (from 0), rounded a little, so that 0.7 * 10 is 7."""
    return F.round((F.col("_n") - 1) * share, 9)


def _sorted(numbered: DataFrame, sizes: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """The quantiles of groups that a task can sort. numbered: (keys, _x, _n, _i); sizes: (keys, _n, _i)."""
    place = {name: _place(F.lit(q)) for name, q in shares.items()}
    ranked = numbered.select("_i", "_x", "_n").withColumn("_r", F.row_number().over(Window.partitionBy("_i").orderBy("_x")) - 1)
    wanted = F.lit(False)
    for at in place.values():
        wanted |= (F.col("_r") == F.floor(at)) | (F.col("_r") == F.ceil(at))
    ends = [F.max(F.when(F.col("_r") == end(at), F.col("_x"))).alias(f"_{side}{k}") for k, at in enumerate(place.values()) for side, end in (("a", F.floor), ("b", F.ceil))]
    found = sizes.join(ranked.where(wanted).groupBy("_i").agg(*ends), "_i")
    return found.select(*keys, *[(F.col(f"_a{k}") + (F.col(f"_b{k}") - F.col(f"_a{k}")) * (at - F.floor(at))).alias(name) for k, (name, at) in enumerate(place.items())])


def _bracketed(keyed: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """The quantiles of groups of any size. keyed: (keys, _x).

    A sketch of fixed size brackets each between two values of nearby rank; one more pass counts what lies below a bracket
    and the few different values inside, and the two neighbours are picked from those.
    """
    near = 4.0 / ACCURACY
    ends = [min(1.0, max(0.0, q + d)) for q in shares.values() for d in (-near, near)]
    sketch = keyed.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_x", ends, ACCURACY).alias("_b"))
    low, high = (lambda k: F.col("_b")[2 * k]), (lambda k: F.col("_b")[2 * k + 1])
    # What lies below a bracket is one cell, and what lies above another; a neighbour just outside is the greatest or least of these.
    side = lambda k: F.when(F.col("_x") < low(k), -1).when(F.col("_x") > high(k), 1).otherwise(0)
    cells = [F.struct(F.lit(k).alias("_q"), side(k).alias("_s"), F.when(side(k) == 0, F.col("_x")).alias("_cell")) for k in range(len(shares))]
    joined = join_groups(keyed, sketch, keys).select(*keys, "_n", "_x", F.explode(F.array(*cells)).alias("_c")).select(*keys, "_n", "_x", "_c.*")
    counts = joined.groupBy(*keys, "_q", "_s", "_cell").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"))
    counts = counts.withColumn("_v", F.when(F.col("_s") < 0, F.col("_most")).otherwise(F.col("_least")))
    upto = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys, "_q").orderBy("_v")))
    share = F.element_at(F.array(*map(F.lit, shares.values())), F.col("_q") + 1)
    place = _place(share)
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.col("_v")))
    found = upto.groupBy(*keys, "_q").agg(at(F.floor(place)).alias("_a"), at(F.ceil(place)).alias("_b"), F.first(place - F.floor(place)).alias("_t"))
    picked = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_t")
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == k, picked)).alias(n) for k, n in enumerate(shares)])


def group_median(rows: DataFrame, keys: list[str], value: Column, into: str = "median") -> DataFrame:
    """(keys, into): the exact median of each group."""
    return group_quantiles(rows, keys, value, {into: 0.5})


def order_statistic(rows: DataFrame, column: str, share: float, before: bool = False) -> float | None:
    """The value at floor(n * share) of the sorted column (from 0), bracketed and picked in the same way; ``before``: at ceil(n * share) - 1."""
    near = 4.0 / ACCURACY
    n, bracket = rows.where(F.col(column).isNotNull()).agg(F.count("*"), F.percentile_approx(column, [max(0.0, share - near), min(1.0, share + near)], ACCURACY)).first()
    if not n:
        return None
    place = min(max(math.ceil(n * share) - 1, 0) if before else int(n * share), n - 1)
    cell = F.when(F.col(column) >= bracket[0], F.col(column))
    counts = rows.where(F.col(column).isNotNull()).groupBy(cell.alias("v")).agg(F.count("*").alias("c")).where(F.col("v").isNull() | (F.col("v") <= F.lit(bracket[1])))
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy(F.col("v").asc_nulls_first())))
    found = upto.where(F.col("upto") > place).agg(F.min("v")).first()[0]
    # The next value above the bracket, for a place just beyond it.
    return found if found is not None else rows.where(F.col(column) > bracket[1]).agg(F.min(column)).first()[0]


def hash_rank(rows: DataFrame, keys: list[str], hash_col: str, ties: list[str], into: str) -> DataFrame:
    """Row numbers (from 1) in the order of a hexadecimal hash within each group: by hash prefixes, which split any group evenly, plus the sizes of the prefixes before."""
    rows = rows.withColumn("_p", F.substring(hash_col, 1, 2))
    sizes = rows.groupBy(*keys, "_p").agg(F.count("*").alias("_s"))
    before = sizes.withColumn("_before", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_s")).drop("_s")
    own = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(hash_col, *ties))
    return rows.withColumn("_own", own).join(before, [*keys, "_p"]).withColumn(into, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_p")


def by_ranges(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` in ranges of (keys, order), with the range's number ``_part`` and ``_u``, which tells equal rows apart; nulls come first.

    Rows are numbered before they are dealt out, so even a group of nothing but equal rows is many ranges. Both steps are written down:
    what a range holds stays the same if an executor is lost.
    """
    tagged = written(rows.withColumn("_u", F.monotonically_increasing_id()), "tagged")
    by = [F.col(c).asc_nulls_first() for c in (*keys, *order, "_u")]
    return written(tagged.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")


def range_rank(rows: DataFrame, keys: list[str], order: list[str], into: str) -> DataFrame:
    """Row numbers (from 0) in ascending order within each group: within ranges of the order, plus the sizes of the group's ranges before. Rows that are equal in it are numbered in any order; nulls come first."""
    placed = by_ranges(rows, keys, order)
    sizes = placed.groupBy(*keys, "_part").agg(F.count("*").alias("_s"))
    upto = Window.partitionBy(*keys).orderBy("_part")  # a row for each range of a group
    before = sizes.withColumn("_before", F.sum("_s").over(upto) - F.col("_s")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"), "_before")
    own = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*[F.col(c).asc_nulls_first() for c in (*order, "_u")])) - 1
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return placed.withColumn("_own", own).join(before, same).withColumn(into, (F.col("_own") + F.col("_before")).cast("long")).select(*rows.columns, into)
