"""Findings: shifts of metrics, spans and log templates between two phases, scored and ranked.

Everything is keyed by the case, so any number of incidents is one job: one grouped aggregation over the raw rows, then
expressions and windows over the much smaller groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootloom.operators.order_stats import FEW_GROUPS, by_ranges, group_median, group_quantiles, range_rank
from rootloom.session import written

LEAST_P = 1e-300


def prepost_moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, mean, sample variance, extremes and first and last time in each phase; combined before the shuffle."""
    aggregates = []
    for phase in ("pre", "post"):
        v, t = F.when(F.col("phase") == phase, F.col("value")), F.when((F.col("phase") == phase) & F.col("value").isNotNull(), F.col("ts"))
        aggregates += [F.count(v).alias(f"{phase}_n"), F.avg(v).alias(f"{phase}_mean"), F.var_samp(v).alias(f"{phase}_var")]
        aggregates += [F.min(v).alias(f"{phase}_min"), F.max(v).alias(f"{phase}_max"), F.min(t).alias(f"{phase}_first"), F.max(t).alias(f"{phase}_last")]
    return rows.where("phase is not null").groupBy(*keys).agg(*aggregates)


def welch_shift(moments: DataFrame) -> DataFrame:
    """Adds delta, standard_error, t_stat, df, t_infinite. Under two values in a phase: no statistic. No variance: t is infinite (null here) unless there is no difference."""
    share = lambda p: F.greatest(F.coalesce(f"{p}_var", F.lit(0.0)), F.lit(0.0)) / F.col(f"{p}_n")
    enough = (F.col("pre_n") >= 2) & (F.col("post_n") >= 2)
    rows = moments.where("pre_n > 0 and post_n > 0").withColumns({"delta": F.col("post_mean") - F.col("pre_mean"), "_a": share("pre"), "_b": share("post")})
    rows = rows.withColumn("standard_error", F.sqrt(F.col("_a") + F.col("_b")))
    solid = enough & (F.col("standard_error") > 0)
    df = (F.col("_a") + F.col("_b")) ** 2 / (F.col("_a") ** 2 / (F.col("pre_n") - 1) + F.col("_b") ** 2 / (F.col("post_n") - 1))
    return rows.withColumns({
        "t_stat": F.when(solid, F.col("delta") / F.col("standard_error")).when(enough & (F.col("delta") == 0), 0.0),
        "df": F.when(solid, df),
        "t_infinite": enough & (F.col("standard_error") == 0) & (F.col("delta") != 0),
    }).drop("_a", "_b")


def shift_findings(moments: DataFrame) -> DataFrame:
    """welch_shift with direction and magnitude."""
    rows = welch_shift(moments)
    return rows.withColumns({"direction": F.when(F.col("delta") >= 0, "high").otherwise("low"), "magnitude": F.round(F.abs("delta") / (F.abs("pre_mean") + 1), 6)})


def with_p_values(shifts: DataFrame) -> DataFrame:
    from rootloom.functions.student_t import welch_p_value

    known = welch_p_value(F.col("t_stat"), F.col("df"))
    return shifts.withColumn("p_value", F.when(F.col("t_infinite"), LEAST_P).when(F.col("df").isNull(), 1.0).otherwise(known))


def bh_fdr(rows: DataFrame, family: list[str], ties: list[str], p: str = "p_value", q: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg q values over each family: the running least, from the largest p down, of p * m / rank."""
    order = Window.partitionBy(*family).orderBy(p, *ties)
    rows = rows.withColumns({"_rank": F.row_number().over(order), "_m": F.count("*").over(Window.partitionBy(*family))})
    scaled = F.greatest(F.col(p), F.lit(LEAST_P)) * F.col("_m") / F.col("_rank")
    least = F.min("_scaled").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return rows.withColumn("_scaled", scaled).withColumn(q, F.least(F.lit(1.0), F.greatest(least, F.lit(LEAST_P)))).drop("_rank", "_m", "_scaled")


def metric_findings(rows: DataFrame, keys: list[str], family: list[str], limit: int | None = None) -> DataFrame:
    """Moments, Welch shift, p, q; score -log10 q; the ``limit`` best of each family by score and magnitude."""
    shifts = with_p_values(shift_findings(prepost_moments(rows, keys)))
    ties = [k for k in keys if k not in family]
    scored = bh_fdr(shifts, family, ties).withColumn("score", F.round(F.greatest(F.lit(0.0), -F.log10("q_value")), 6))
    return scored if limit is None else best(scored, family, [F.col("score").desc(), F.col("magnitude").desc(), *ties], limit)


def best(rows: DataFrame, keys: list[str], order: list, limit: int, rank: str | None = None) -> DataFrame:
    """The first ``limit`` rows of each group."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = rows.withColumn(rank or "_rank", place).where(F.col(rank or "_rank") <= limit)
    return out if rank else out.drop("_rank")


def log_template(message: Column) -> Column:
    """The message without what varies: hexadecimal runs, times, numbers and spacing; 300 characters of it. Patterns and names are fixed values."""
    text = F.lower(F.trim(message))
    for pattern, name in ((r"\b[0-9a-f]{8,}\b", "<hex>"), (r"\b\d{4}-\d{2}-\d{2}[ t]\d{2}:\d{2}:\d{2}(?:\.\d+)?\b", "<datetime>"), (r"\b\d+(?:\.\d+)?\b", "<num>"), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, name)
    return F.substring(text, 1, 300)


def log_pattern_shift(lines: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Counts of each template before and after, from rows with ``phase``; score |ln((post+1)/(pre+1))| sqrt(n/(n+2))."""
    counts = lines.where("phase is not null").withColumn("template", log_template(F.col("message"))).groupBy(*keys, "template")
    rows = counts.agg(F.count(F.when(F.col("phase") == "pre", 1)).alias("pre_count"), F.count(F.when(F.col("phase") == "post", 1)).alias("post_count"))
    n = F.col("pre_count") + F.col("post_count")
    score = F.abs(F.log((F.col("post_count") + 1) / (F.col("pre_count") + 1))) * F.sqrt(n / (n + 2))
    rows = rows.withColumns({"direction": F.when(F.col("post_count") >= F.col("pre_count"), "more").otherwise("less"), "magnitude": F.abs(F.col("post_count") - F.col("pre_count")).cast("double"), "score": F.round(score, 6)})
    return rows if limit is None else best(rows, keys[:1], [F.col("score").desc(), *keys[1:], "template"], limit)


def metric_shift_top(rows: DataFrame, most: int = 25) -> DataFrame:
    """The best-shifted metric of each component in each case, then the ``most`` best components: |delta| / (|pre| + 1)."""
    means = rows.where("phase is not null").groupBy("case_id", "component", "metric").agg(F.avg(F.when(F.col("phase") == "pre", F.col("value"))).alias("pre_mean"), F.avg(F.when(F.col("phase") == "post", F.col("value"))).alias("post_mean"))
    scored = means.withColumn("score", F.round(F.abs(F.col("post_mean") - F.col("pre_mean")) / (F.abs("pre_mean") + 1), 6)).where("score is not null and not isnan(score) and score < double('Infinity')")
    one = best(scored, ["case_id", "component"], [F.col("score").desc(), "metric"], 1)
    return best(one, ["case_id"], [F.col("score").desc(), "component"], most, rank="rank")


def _first_hit(text: Column, table, otherwise: str) -> Column:
    """The name of the first entry of ``table`` that has a word which the text contains."""
    out = F.lit(otherwise)
    for name, words in reversed(table):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), name).otherwise(out)
    return out


#: Other names of fault families, tried first, and the families, each in order.
FAULT_ALIASES = (("mem", ("memory",)), ("delay", ("latency",)), ("delay", ("response_time",)), ("loss", ("packet_loss",)), ("socket", ("tcp",)))
FAULT_FAMILIES = ("cpu", "mem", "disk", "delay", "loss", "socket")


def fault_family(name: Column, otherwise: str = "unknown") -> Column:
    """The fault family that a metric's name tells."""
    return _first_hit(F.lower(F.trim(F.coalesce(name, F.lit("")))), (*FAULT_ALIASES, *((f, (f,)) for f in FAULT_FAMILIES)), otherwise)


#: Reasons in the order they are tried, and the words in the evidence that mean them.
EVIDENCE_REASONS = (
    ("cpu", ("cpu", "processor")),
    ("mem", ("mem", "memory", "rss", "heap")),
    ("disk", ("disk", "fs-", "blkio", "io")),
    ("loss", ("loss", "drop", "dropped", "error-total", "errors")),
    ("delay", ("delay", "latency", "duration", "timeout", "slow")),
    ("socket", ("socket", "sockets", "connection reset")),
    ("db", ("db", "database", "sql", "connection limit", "close")),
    ("network", ("network", "rx", "tx", "packet")),
)


def infer_reason(text: Column) -> Column:
    """The reason that evidence speaks for; ``text``: its signals, summaries and directions, joined by spaces."""
    return _first_hit(F.lower(F.coalesce(text, F.lit(""))), EVIDENCE_REASONS, "unknown")


def case_profile(top: DataFrame, files: DataFrame | None = None, most: int = 10) -> DataFrame:
    """For each case its ``most`` first shifts, the likely family, how clear the first is, top / (top + second), and which telemetry it has.

    files: (case_id, modality) of its files; without them has_logs and has_traces are false.
    """
    rows = top.where(F.col("rank") <= most).groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("rank", "component", "metric", "score"))).alias("shifts"))
    one, two = F.get("shifts", 0), F.get("shifts", 1)
    total = one["score"] + F.coalesce(two["score"], F.lit(0.0))
    clear = F.when(total > 0, one["score"] / total).otherwise(0.0)
    has = lambda m: F.coalesce(F.col(m), F.lit(False)).alias(m)
    if files is None:
        rows = rows.withColumns({"has_logs": F.lit(False), "has_traces": F.lit(False)})
    else:
        rows = rows.join(files.groupBy("case_id").agg(F.max(F.col("modality") == "logs").alias("has_logs"), F.max(F.col("modality") == "traces").alias("has_traces")), "case_id", "left")
    return rows.select("case_id", F.size("shifts").alias("n_shifts"), one["component"].alias("top_component"), fault_family(one["metric"]).alias("family"), F.round(clear, 6).alias("confidence"), has("has_logs"), has("has_traces"))


def daily_baseline(rows: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    """Count, mean, deviation, extremes and four percentiles; ``exact=False`` takes the percentiles of sketches, which saves a pass. Memory grows with no group either way."""
    shares = {"p05": 0.05, "p15": 0.15, "p90": 0.90, "p95": 0.95}
    known = rows.where("value is not null")
    rough = [] if exact else [F.percentile_approx("value", q, 10000).alias(n) for n, q in shares.items()]
    sums = known.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("most"), *rough)
    return sums.join(group_quantiles(known, keys, F.col("value"), shares), keys) if exact else sums


def threshold_anomaly(window_rows: DataFrame, baseline: DataFrame, window: list[str], keys: list[str]) -> DataFrame:
    """The worst excess over p95 or lack under p05 of each window's extremes, over |threshold| + 1, with the time of that sample."""
    ends = window_rows.where("value is not null").groupBy(*window, *keys).agg(
        F.max("value").alias("top"), F.min("value").alias("bottom"), F.max_by("ts", F.struct("value", -F.col("ts"))).alias("top_ts"), F.min_by("ts", F.struct("value", "ts")).alias("bottom_ts")
    )
    rows = ends.join(baseline.select(*keys, "p05", "p95"), keys)
    high = (F.col("top") - F.col("p95")) / (F.abs("p95") + 1)
    low = (F.col("p05") - F.col("bottom")) / (F.abs("p05") + 1)
    rows = rows.withColumns({"_high": high, "_low": low}).where("_high > 0 or _low > 0")
    up = F.col("_high") >= F.col("_low")
    return rows.select(*window, *keys, F.when(up, "high").otherwise("low").alias("direction"), F.round(F.greatest("_high", "_low"), 6).alias("score"), F.when(up, F.col("top_ts")).otherwise(F.col("bottom_ts")).alias("ts"))


def trace_summary(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Latency and failures of each (component, service, data source, call type); nulls are groups of their own."""
    failed = F.lower("success").isin("false", "0", "fail", "failed")  # fixed values
    # Groups are numbered, so that rows are sorted by a number. Nulls in a key would not meet in a join, but in a struct they do.
    marked = spans.select(F.struct(*keys).alias("_g"), "elapsed", "start_ms", failed.alias("_failed"))
    groups = written(marked.select("_g").distinct().withColumn("_k", F.monotonically_increasing_id()), "groups")
    numbered = marked.join(F.broadcast(groups) if groups.count() <= FEW_GROUPS else groups, "_g").select("_k", "elapsed", "start_ms", "_failed")
    sums = numbered.groupBy("_k").agg(
        F.count("*").alias("n"), F.avg("elapsed").alias("mean_elapsed"), F.max("elapsed").alias("max_elapsed"),
        F.min("start_ms").alias("first_start"), F.max_by("start_ms", F.struct("elapsed", -F.col("start_ms"))).alias("max_start"), F.count(F.when(F.col("_failed"), 1)).alias("failures"),
    )
    medians = group_median(numbered, ["_k"], F.col("elapsed"), "median_elapsed")
    return groups.join(sums, "_k").join(medians, "_k", "left").select("_g.*", *sums.columns[1:], "median_elapsed")


def trace_latency_findings(summary: DataFrame) -> DataFrame:
    """score: the mean's excess over the case's median of means, relative, and a tenth of the relative excess of the maximum over the mean."""
    middle = group_median(summary, ["case_id"], F.col("mean_elapsed"), "_gm")
    rows = summary.join(middle, "case_id")
    lag = F.greatest(F.col("mean_elapsed") - F.col("_gm"), F.lit(0.0)) / (F.abs("_gm") + 1)
    burst = F.greatest(F.col("max_elapsed") - F.col("mean_elapsed"), F.lit(0.0)) / (F.abs("mean_elapsed") + 1)
    return rows.withColumns({"score": F.round(lag + 0.1 * burst, 9), "hint": F.when(F.col("failures") > 0, "loss").otherwise("delay")}).drop("_gm")


def window_mean_anomaly(rows: DataFrame, start_ts: float, end_ts: float, most: int = 100) -> DataFrame:
    """Mean inside a time range against the mean outside it, by component and metric; the ``most`` severest."""
    inside = (F.col("ts") >= start_ts) & (F.col("ts") <= end_ts)
    means = rows.groupBy("component", "metric").agg(F.avg(F.when(inside, F.col("value"))).alias("window_mean"), F.avg(F.when(~inside, F.col("value"))).alias("baseline_mean"))
    scored = means.where("window_mean is not null and baseline_mean is not null").withColumn("severity", F.round(F.abs(F.col("window_mean") - F.col("baseline_mean")) / (F.abs("baseline_mean") + 1), 6))
    return scored.orderBy(F.col("severity").desc(), "component", "metric").limit(min(most, 100))


#: Reasons in the order they are tried, and the words in a metric's name that hint at them.
HINTS = (
    ("network loss", ("success", "succee", "loss", "drop", "error", "fail")),
    ("db close", ("close", "closed", "on_off_state", "onoff")),
    ("db connection limit", ("connect", "client", "session", "login", "blocked", "rejected", "row_lock", "hang")),
    ("CPU fault", ("cpu", "processor", "load")),
    ("network delay", ("delay", "latency", "elapsed", "time")),
)


def reason_hint(metric: Column) -> Column:
    """The reason that a metric's name hints at; empty without a hint."""
    return _first_hit(F.lower(F.coalesce(metric, F.lit(""))), HINTS, "")


def dedup_findings(findings: DataFrame) -> DataFrame:
    """The best finding of each (case, modality, component, signal, direction), names compared without case and outer spaces."""
    name = lambda c: F.lower(F.trim(c))
    keys = Window.partitionBy("case_id", "modality", name("component"), name("signal"), "direction").orderBy(F.col("score").desc(), F.col("magnitude").desc(), "component", "signal")
    return findings.withColumn("_r", F.row_number().over(keys)).where("_r = 1").drop("_r")


def component_scores(findings: DataFrame, top: int = 3, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """For each component the sum over modalities of its ``top`` highest positive scores."""
    order = Window.partitionBy(*keys, "component", "modality").orderBy(F.col("score").desc(), "signal", "direction")
    first = findings.where("component <> ''").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    return first.groupBy(*keys, "component").agg(F.round(F.sum(F.greatest("score", F.lit(0.0))), 6).alias("component_score"))


def top_components(findings: DataFrame, limit: int = 10, keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    return best(component_scores(findings, keys=keys), list(keys), [F.col("component_score").desc(), "component"], limit, rank="rank")


def evidence_for(findings: DataFrame, limit: int = 8) -> DataFrame:
    """The ranked findings of each component of each case."""
    return best(findings, ["case_id", "component"], [F.col("score").desc(), F.col("magnitude").desc(), "signal", "direction"], limit, rank="rank")


def symptomatic(findings: DataFrame, limit: int = 20) -> DataFrame:
    return top_components(findings.where("score > 0"), limit).where("component_score > 0").select("case_id", "component")


def component_onsets(findings: DataFrame) -> DataFrame:
    """The earliest finding of each component, and its precedence: 1 for a case's first, 0 for its last, 1 for all without a spread."""
    onset = findings.where("window_start is not null").groupBy("case_id", "component").agg(F.min("window_start").alias("onset"))
    case = Window.partitionBy("case_id")
    low, high = F.min("onset").over(case), F.max("onset").over(case)
    return onset.withColumns({"_low": low, "_high": high}).withColumn("precedence", F.when(F.col("_high") > F.col("_low"), F.round(1 - (F.col("onset") - F.col("_low")) / (F.col("_high") - F.col("_low")), 6)).otherwise(1.0)).drop("_low", "_high")


def onset_mad(series: DataFrame, keys: list[str]) -> DataFrame:
    """The first time after the baseline that lies over five deviations from it; null under six points or without one.

    Baseline: the first max(3, n / 5) points; its centre and deviation are medians. A deviation of 0 counts as a twentieth of
    the centre. Places come from ``range_rank`` and medians from sketches and counts, so no series is sorted in one task.
    """
    rows = series.where("value is not null and ts is not null")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    rows = range_rank(rows, keys, ["ts", "value"], "_i").join(sizes, keys)
    rows = rows.withColumn("_base", F.col("_i") < F.greatest(F.lit(3), F.floor(F.col("_n") / 5)))
    rows = rows.join(group_median(rows.where("_base"), keys, F.col("value"), "_centre"), keys).withColumn("_off", F.abs(F.col("value") - F.col("_centre")))
    rows = rows.join(group_median(rows.where("_base"), keys, F.col("_off"), "_mad"), keys)
    spread = F.when(F.col("_mad") > 0, F.col("_mad")).otherwise(0.05 * (F.abs("_centre") + 1e-6))
    beyond = ~F.col("_base") & (F.col("_n") >= 6) & (F.col("_off") > 5 * spread)
    return rows.groupBy(*keys).agg(F.min(F.when(beyond, F.col("ts"))).alias("onset_ts"))


def row_volume(rows: DataFrame, keys: list[str], modality: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).withColumn("modality", F.lit(modality))


def volume_tertiles(volumes: DataFrame, size: str = "n_rows", key: str = "row_id") -> DataFrame:
    """low, middle, high by size and id: the first and second third end at floor(n / 3) rows each."""
    n = volumes.count()
    ranked = range_rank(volumes.withColumn("_all", F.lit(0)), ["_all"], [size, key], "_r").drop("_all")
    edge = n // 3
    return ranked.withColumn("volume_bin", F.when(F.col("_r") < edge, "low").when(F.col("_r") < 2 * edge, "middle").otherwise("high")).drop("_r")


#: Names of the statistics.
STATS = ("mean", "min", "max", "median", "q25", "q75", "first", "last", "std", "iqr", "range", "mean_abs_diff", "std_diff", "slope")


def kpi_features(kpi: DataFrame) -> DataFrame:
    """Fourteen statistics of each (sample, feature) over its finite values in order of t.

    A series of any length is cut into ranges of t. Of a range stand first and last value, count, sums of differences and of value times
    place, which add up in order: a difference for each border, and places moved on by the counts before.
    """
    finite = kpi.where("value is not null and not isnan(value) and abs(value) < double('Infinity')").select("sample_index", "feature", "t", "value")
    keys = ["sample_index", "feature"]
    placed = by_ranges(finite, keys, ["t"])
    order = Window.partitionBy(*keys, "_part").orderBy(F.col("t").asc_nulls_first(), "_u")
    steps = placed.withColumns({"_i": (F.row_number().over(order) - 1).cast("double"), "_d": F.col("value") - F.lag("value").over(order)})
    sums = [F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("_i") * F.col("value")).alias("iv"), F.min_by("value", "_i").alias("first"), F.max_by("value", "_i").alias("last")]
    ranges = steps.groupBy(*keys, "_part").agg(*sums, F.coalesce(F.sum(F.abs("_d")), F.lit(0.0)).alias("ad"), F.coalesce(F.sum(F.col("_d") * F.col("_d")), F.lit(0.0)).alias("dd"))
    along = Window.partitionBy(*keys).orderBy("_part")  # a row for each range of a series
    border = F.coalesce(F.col("first") - F.lag("last").over(along), F.lit(0.0))
    ranges = ranges.withColumns({"border": border, "before": F.sum("n").over(along) - F.col("n")})
    whole = ranges.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("iv") + F.col("before") * F.col("s")).alias("iv"), F.min_by("first", "_part").alias("first"), F.max_by("last", "_part").alias("last"),
        F.sum(F.col("ad") + F.abs("border")).alias("ad"), F.sum(F.col("dd") + F.col("border") * F.col("border")).alias("dd"),
    )
    m = F.greatest(F.col("n") - 1, F.lit(1))
    mean_diff = (F.col("last") - F.col("first")) / m
    places = F.col("n") * (F.col("n") * F.col("n") - 1) / 12.0  # squared distances of the places from their mean
    slope = F.when(places > 0, (F.col("iv") - (F.col("n") - 1) / 2.0 * F.col("s")) / places).otherwise(0.0)
    whole = whole.select(*keys, "first", "last", (F.col("ad") / m).alias("mean_abs_diff"), F.sqrt(F.greatest(F.col("dd") / m - mean_diff * mean_diff, F.lit(0.0))).alias("std_diff"), slope.alias("slope"))
    plain = finite.groupBy(*keys).agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_pop("value").alias("std"))
    quantiles = group_quantiles(finite, keys, F.col("value"), {"q25": 0.25, "median": 0.5, "q75": 0.75})
    rows = plain.join(quantiles, keys).join(whole, keys).withColumns({"iqr": F.col("q75") - F.col("q25"), "range": F.col("max") - F.col("min")})
    return rows.select(*keys, *[F.col(s) for s in STATS])


def feature_views(features: DataFrame, names: list[str], stats: tuple[str, ...] = STATS) -> DataFrame:
    """One wide row for each sample, columns feature__stat; a feature without values is 0."""
    long = features.unpivot(["sample_index", "feature"], list(stats), "stat", "v").withColumn("name", F.concat("feature", F.lit("__"), "stat"))
    wanted = [f"{f}__{s}" for f in names for s in stats]
    if not wanted:
        raise ValueError("no feature is selected")
    return long.groupBy("sample_index").pivot("name", wanted).agg(F.first("v")).fillna(0.0)
