"""Evaluation: metrics by system, intervals, paired tests, multiple-testing adjustment, splits and samples."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootloom.operators.bootstrap import bootstrap_ci
from rootloom.operators.findings import best
from rootloom.operators.order_stats import hash_rank, order_statistic


def by_system(scored: DataFrame) -> DataFrame:
    """hit@1, hit@3, hit@5, average of hit@1 to hit@5, and reciprocal rank, for each system and for each system and fault type."""
    at = lambda k: F.when(F.col("place").between(1, k), 1.0).otherwise(0.0)
    rows = scored.withColumn("avg5", F.when(F.col("place").between(1, 5), (6 - F.col("place")) / 5).otherwise(0.0))
    sums = [F.count("*").alias("n"), *[F.round(F.avg(at(k)), 6).alias(f"hit_at_{k}") for k in (1, 3, 5)], F.round(F.avg("avg5"), 6).alias("avg_at_5"), F.round(F.avg("mrr"), 6).alias("mrr")]
    grouped = rows.groupingSets([("system",), ("system", "fault_type")], "system", "fault_type").agg(*sums, F.grouping("fault_type").alias("_all"))
    return grouped.withColumn("fault_type", F.when(F.col("_all") == 1, "all").otherwise(F.col("fault_type"))).drop("_all")


def same_text(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def set_prf1(rows: DataFrame, predicted: str = "predicted", expected: str = "expected") -> DataFrame:
    """precision, recall, f1 and exact match of two sets of names in each row; both empty is a full match."""
    p, e = (F.array_distinct(F.transform(c, same_text)) for c in (predicted, expected))
    hit = F.size(F.array_intersect(p, e))
    rows = rows.withColumns({"_p": F.size(p), "_e": F.size(e), "_h": hit})
    ratio = lambda n: F.when(F.col(n) > 0, F.col("_h") / F.col(n)).when((F.col("_p") == 0) & (F.col("_e") == 0), 1.0).otherwise(0.0)
    rows = rows.withColumns({"precision": ratio("_p"), "recall": ratio("_e")})
    total = F.col("precision") + F.col("recall")
    return rows.withColumns({"f1": F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0), "exact": (F.col("_h") == F.col("_p")) & (F.col("_h") == F.col("_e"))}).drop("_p", "_e", "_h")


ROOTS = ("root1", "root2", "root3")


def challenge_score(rows: DataFrame) -> DataFrame:
    """(true positives - false positives) / true roots of each case; predictions are columns p_root1 to p_root3."""
    hits = sum((F.col(r) * F.col(f"p_{r}") for r in ROOTS), F.lit(0))
    false = sum(((1 - F.col(r)) * F.col(f"p_{r}") for r in ROOTS), F.lit(0))
    return rows.withColumn("challenge_score", (hits - false) / F.greatest(sum((F.col(r) for r in ROOTS), F.lit(0)), F.lit(1)))


def multilabel_report(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each root and of all together (``micro``)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("root"), F.col(r).alias("y"), F.col(f"p_{r}").alias("p")) for r in ROOTS]))
    long = rows.select(pairs.alias("x")).select("x.*")
    sums = long.groupingSets([("root",), ()], "root").agg(F.sum(F.col("y") * F.col("p")).alias("tp"), F.sum((1 - F.col("y")) * F.col("p")).alias("fp"), F.sum(F.col("y") * (1 - F.col("p"))).alias("fn"), F.sum("y").cast("long").alias("support"))
    over = lambda n, d: F.round(F.when(d > 0, n / d).otherwise(0.0), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(F.coalesce("root", F.lit("micro")).alias("root"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"), "support")


def wilson_ci(hits: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high) of a share."""
    p, zz = hits / n, z * z
    centre, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.struct(F.round(F.greatest(F.lit(0.0), centre - half), 6).alias("low"), F.round(F.least(F.lit(1.0), centre + half), 6).alias("high"))


#: Nodes and weights of a fixed quadrature on [0, 1], and ln k! - ln of Stirling's formula for small k.
_NODES, _QUADRATURE = ((v / 2).tolist() for v in (lambda x, w: (x + 1, w))(*np.polynomial.legendre.leggauss(64)))
_STIRLING = [0.0] + [math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, 16)]


def _stirling_rest(k: Column) -> Column:
    k = k.cast("double")
    series = 1 / (12 * k) - 1 / (360 * k * k * k) + 1 / (1260 * k * k * k * k * k)
    return F.when(k < 16, F.get(F.array(*map(F.lit, _STIRLING)), F.least(k, F.lit(15.0)).cast("int"))).otherwise(series)


def half_binomial_tail(m: Column, n: Column) -> Column:
    """P(X <= m) for n fair draws, 2 m <= n: any n, in a fixed number of steps.

    The tail is (n - m) P(X = m) times the integral of (1 - s)^(n - m - 1) (1 + s)^m from 0 to 1, which is taken up to where nothing
    is left of it; P(X = m) comes from its distance to the mean and the small rests of Stirling's formula, so that large logarithms don't cancel.
    """
    m, n = m.cast("double"), n.cast("double")
    half = n / 2
    away = lambda x: half * ((x / half) * F.log1p((x - half) / half) - (x - half) / half)
    log = _stirling_rest(n) - _stirling_rest(m) - _stirling_rest(n - m) - away(m) - away(n - m) - 0.5 * F.log(2 * math.pi * m * (n - m) / n)
    at = F.when(m > 0, log).otherwise(-n * math.log(2.0))
    a, b = F.greatest(n - 1, F.lit(1.0)), F.greatest(n - 2 * m - 1, F.lit(0.0))
    end = F.least(F.lit(1.0), (F.sqrt(b * b + 80 * a) - b) / a)
    power = lambda base, e: F.when(e == 0, 0.0).otherwise(e * F.log1p(base))
    points = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in zip(_NODES, _QUADRATURE)])
    area = F.aggregate(points, F.lit(0.0), lambda s, p: s + p["w"] * F.exp(power(-p["x"] * end, n - m - 1) + power(p["x"] * end, m)))
    return F.when(n > 0, (n - m) * F.exp(at) * end * area).otherwise(1.0)


def mcnemar(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Discordant counts, corrected chi-square and exact two-sided binomial p of paired 0/1 columns baseline and treatment."""
    counts = pairs.groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.count_if((F.col("baseline") > 0) & (F.col("treatment") <= 0)).alias("baseline_only"), F.count_if((F.col("baseline") <= 0) & (F.col("treatment") > 0)).alias("treatment_only"))
    b, c = F.col("baseline_only"), F.col("treatment_only")
    total = b + c
    p = F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * half_binomial_tail(F.least(b, c), total)))
    chi = F.when(total > 0, F.pow(F.greatest(F.abs(b - c) - 1, F.lit(0)), F.lit(2)) / total).otherwise(0.0)
    return counts.withColumns({"chi_square": F.round(chi, 6), "p_value": F.round(p, 9)})


def holm_adjust(rows: DataFrame, family: list[str], ties: list[str], p: str = "p_value") -> DataFrame:
    """Step-down Holm: the running greatest of (m - rank + 1) p, up to 1."""
    order = Window.partitionBy(*family).orderBy(p, *ties) if family else Window.orderBy(p, *ties)
    m = F.count("*").over(Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0)))
    rows = rows.withColumns({"_r": F.row_number().over(order), "_m": m}).withColumn("_s", (F.col("_m") - F.col("_r") + 1) * F.col(p))
    return rows.withColumn("holm_p", F.round(F.least(F.lit(1.0), F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))), 9)).drop("_r", "_m", "_s")


def usage_totals(rows: DataFrame, treatment: str) -> DataFrame:
    """Cases, tokens, calls and latency of each system, and its tokens over the treatment's."""
    sums = rows.groupBy("system").agg(F.count("*").alias("n"), F.sum("total_tokens").cast("long").alias("total_tokens"), F.sum("llm_calls").cast("long").alias("llm_calls"), F.round(F.avg("latency_s"), 6).alias("latency_s"))
    base = sums.where(F.col("system") == treatment).select(F.col("total_tokens").alias("_t"))
    return sums.join(F.broadcast(base), how="left").withColumn("token_ratio", F.round(F.col("total_tokens") / F.col("_t"), 6)).drop("_t")


def strongest_baseline(rows: DataFrame, treatment: str) -> DataFrame:
    """Of the other systems, over the cases they share with the treatment: the most accurate, then by reciprocal rank, fewer tokens, name."""
    cases = rows.where(F.col("system") == treatment).select("case_id").distinct()
    sums = rows.where(F.col("system") != treatment).join(cases, "case_id", "left_semi").groupBy("system").agg(F.count("*").alias("n"), F.round(F.avg("hit_at_1"), 9).alias("accuracy"), F.round(F.avg("mrr"), 9).alias("mrr"), F.sum("total_tokens").cast("long").alias("tokens"))
    return sums.orderBy(F.col("accuracy").desc(), F.col("mrr").desc(), "tokens", "system").limit(1)


def win_gate(tests: DataFrame, gain: float = 0.10, error_cut: float = 0.20, level: float = 0.05) -> DataFrame:
    """passes: a gain of 0.10, or a fifth fewer errors, at p up to 0.05; from baseline_rate, treatment_rate, p_value."""
    delta = F.col("treatment_rate") - F.col("baseline_rate")
    cut = F.when(F.col("baseline_rate") < 1, delta / (1 - F.col("baseline_rate"))).otherwise(0.0)
    return tests.withColumns({"delta": F.round(delta, 6), "error_reduction": F.round(cut, 6), "passes": ((delta >= gain) | (cut >= error_cut)) & (F.col("p_value") <= level)})


#: What makes a case hard without a look at its label.
HARD_CRITERIA = {
    "suite_re2_or_re3": "suite in ('RE2', 'RE3')",
    "train_ticket_system": "system = 'TT'",
    "telemetry_bytes_ge_median": "telemetry_bytes >= _median",
    "has_logs": "has_logs",
    "has_traces": "has_traces",
    "wide_metric_table": "metric_columns >= 120",
}


def hard_split(cases: DataFrame, least: int = 3, size: str = "telemetry_bytes", criteria: dict[str, str] = HARD_CRITERIA) -> DataFrame:
    """Cases that meet ``least`` of the label-free criteria, with criteria_score; ``_median`` in a criterion is the median size of all cases."""
    middle = (order_statistic(cases, size, 0.5), order_statistic(cases, size, 0.5, before=True))
    rows = cases.withColumn("_median", F.lit((middle[0] + middle[1]) / 2 if middle[0] is not None else None).cast("double"))
    score = sum((F.coalesce(F.expr(e), F.lit(False)).cast("int") for e in criteria.values()), F.lit(0))
    return rows.withColumn("criteria_score", score).where(F.col("criteria_score") >= least).drop("_median")


def high_volume_split(cases: DataFrame, size: str, share: float, excluded: DataFrame | None = None, key: str = "case_id") -> DataFrame:
    """Cases with logs and traces and at least the order statistic at floor(n * share) of the size of those, less the ``excluded`` ones; volume_bin is high."""
    whole = cases.where("has_logs and has_traces")
    rows = whole.where(F.col(size) >= F.lit(order_statistic(whole, size, share)))
    rows = rows if excluded is None else rows.join(excluded.select(key).distinct(), key, "left_anti")
    return rows.withColumn("volume_bin", F.lit("high"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, quota: int, n: int, seed: int = 7) -> DataFrame:
    """``quota`` of each stratum, then others up to ``n`` in all, in the order of a keyed hash."""
    mark = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    # Of a stratum no more than its quota's rows and n further ones can be taken, so ranks beyond are cut off before the shuffle.
    rows = best(rows.withColumn("_h", mark), [stratum], ["_h", key], quota + n, rank="_r")
    return rows.orderBy(F.when(F.col("_r") <= quota, 0).otherwise(1), "_h", key).limit(n).drop("_h", "_r")


def round_robin_select(rows: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """Alternately from each stratum until ``n``."""
    return best(rows, [stratum], [key], n, rank="_r").orderBy("_r", stratum, key).limit(n).drop("_r")


def budget_allocation(findings: DataFrame, truth: DataFrame, budgets: list[int]) -> DataFrame:
    """(budget, global_kept, shard_kept, gamma): shares of cases whose true component is among B findings taken by score over all, or in turn from each shard; gamma: findings of a case over B, on average."""
    order = [F.col("score").desc(), "component", "signal"]
    ranked = findings.withColumns({"_g": F.row_number().over(Window.partitionBy("case_id").orderBy(*order)), "_s": F.row_number().over(Window.partitionBy("case_id", "shard_id").orderBy(*order))})
    ranked = ranked.withColumn("_t", F.row_number().over(Window.partitionBy("case_id").orderBy("_s", "shard_id"))).join(truth, "case_id")
    rows = ranked.withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    hit = lambda r: F.max(F.when((F.col(r) <= F.col("budget")) & (F.col("component") == F.col("true_root")), 1).otherwise(0))
    cases = rows.groupBy("case_id", "budget").agg(hit("_g").alias("g"), hit("_t").alias("t"), F.count("*").alias("n"))
    return cases.groupBy("budget").agg(F.round(F.avg("g"), 6).alias("global_kept"), F.round(F.avg("t"), 6).alias("shard_kept"), F.round(F.avg(F.col("n") / F.col("budget")), 6).alias("gamma"))


def threshold_calibration(rows: DataFrame, keys: list[str], steps: list[float]) -> DataFrame:
    """(keys, threshold, value): where +1 for a hit and -1 for a false alarm is greatest on average; of equals the nearest to 0.5, then the larger.

    The rows meet as counts of (key, cell of the grid, label), so the grid multiplies a small table only.
    """
    grid = F.array(*map(F.lit, steps))
    cells = rows.withColumn("_cell", F.size(F.filter(grid, lambda s: s <= F.col("p")))).groupBy(*keys, "_cell", "y").agg(F.count("*").alias("_c"))
    spread = cells.select(*keys, "_cell", "y", "_c", F.posexplode(grid).alias("_k", "threshold"))
    gain = F.sum(F.when(F.col("_cell") > F.col("_k"), F.when(F.col("y") == 1, F.col("_c")).otherwise(-F.col("_c"))).otherwise(0)) / F.sum("_c")
    values = spread.groupBy(*keys, "threshold").agg(F.round(gain, 9).alias("value"))
    return best(values, keys, [F.col("value").desc(), F.round(F.abs(F.col("threshold") - 0.5), 9), F.col("threshold").desc()], 1)


def label_strata(labels: DataFrame, train: float, folds: int, key: str = "sample_index", seed: int = 7) -> DataFrame:
    """stratum: the labels' bits; split by keyed-hash order within it, and folds."""
    stratum = sum((F.shiftleft(F.col(r), k) for k, r in enumerate(ROOTS)), F.lit(0))
    rows = labels.withColumn("stratum", stratum).withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("_n"))  # eight rows
    rows = hash_rank(rows, ["stratum"], "_h", [key], "_r").join(F.broadcast(sizes), "stratum")
    return rows.withColumns({"split": F.when(F.col("_r") <= F.floor(F.col("_n") * train), "train").otherwise("held_out"), "fold": ((F.col("_r") - 1) % folds).cast("int")}).drop("_h", "_r", "_n")


def rank_diagnostics(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """How often the true component is among the 1, 3 or 5 loudest of its case, or absent."""
    loud = findings.groupBy("case_id", "component").agg(F.max("score").alias("s"))
    ranked = loud.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("s").desc(), "component")))
    rows = truth.join(ranked.select("case_id", F.col("component").alias("true_root"), "rank"), ["case_id", "true_root"], "left")
    return rows.agg(F.count("*").alias("cases"), *[F.count_if(F.col("rank") <= k).alias(f"top_{k}") for k in (1, 3, 5)], F.count_if(F.col("rank").isNull()).alias("absent"))


def exact_comparison(pairs: DataFrame) -> DataFrame:
    d = F.col("treatment") - F.col("baseline")
    return pairs.agg(F.count_if(d > 0).alias("better"), F.count_if(d < 0).alias("worse"), F.count_if(d == 0).alias("tied"), F.round(F.avg(d), 6).alias("mean_difference"))


def slice_comparison(rows: DataFrame, roles: dict[str, str], treatment: str, value: str = "hit_at_1", reps: int = 1000) -> DataFrame:
    """(slice, role, baseline, n, counts, delta, low, high, p_value, holm_p, passes): the treatment against each role's system in each slice.

    rows: (slice, case_id, system, value). delta is the mean paired difference, low and high its bootstrap interval, p_value exact
    McNemar, holm_p adjusted over the roles of a slice; passes: the gate of ``win_gate`` at holm_p.
    """
    of = lambda s: F.avg(F.when(F.col("system") == s, F.col(value).cast("double")))
    wide = rows.groupBy("slice", "case_id").agg(of(treatment).alias("treatment"), *[of(s).alias(f"_{r}") for r, s in roles.items()])
    pairs = wide.select("slice", "case_id", "treatment", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(s).alias("baseline_system"), F.col(f"_{r}").alias("baseline")) for r, s in roles.items()])).alias("x"))
    pairs = pairs.select("slice", "case_id", "treatment", "x.*").where("baseline is not null and treatment is not null").withColumn("d", F.col("treatment") - F.col("baseline"))
    keys = ["slice", "role"]
    tests = holm_adjust(mcnemar(pairs, keys).select(*keys, "n", "baseline_only", "treatment_only", "p_value"), ["slice"], ["role"])
    effect = bootstrap_ci(pairs, keys, "d", reps).select(*keys, F.col("mean").alias("delta"), "low", "high")
    rates = pairs.groupBy(*keys, "baseline_system").agg(F.avg("baseline").alias("_rate"))
    found = tests.join(effect, keys).join(rates, keys)
    cut = F.when(F.col("_rate") < 1, F.col("delta") / (1 - F.col("_rate"))).otherwise(0.0)
    return found.withColumn("passes", ((F.col("delta") >= 0.10) | (cut >= 0.20)) & (F.col("holm_p") <= 0.05)).select(*keys, F.col("baseline_system").alias("baseline"), "n", "baseline_only", "treatment_only", "delta", "low", "high", "p_value", "holm_p", "passes")
