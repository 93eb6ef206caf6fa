"""Columns and times: choosing columns by name, time units, phases before and after a pivot, and task windows from prose."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootloom.operators.order_stats import group_median, join_groups, range_rank


def first_column(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    """The first candidate that is a column, whatever the case of its letters."""
    by_name: dict[str, str] = {}
    for c in columns:
        by_name[c.lower()] = c
    return next((by_name[c.lower()] for c in candidates if c.lower() in by_name), None)


def resolve_long_columns(df: DataFrame, value: Iterable[str], component: Iterable[str], metric: Iterable[str]) -> DataFrame | None:
    """(component, metric, value) if the table has a column for each, else None: it isn't in long form."""
    found = [first_column(df.columns, c) for c in (component, metric, value)]
    return None if None in found else df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(found, ("component", "metric", "value"), strict=True)])


#: Names of time columns, best first, and those that count without punctuation.
TS_COLUMNS = ("timestamp", "starttimemillis", "start_time_millis", "start_time", "endtimemillis", "ts", "time", "datetime", "date", "starttime")
PLAIN_TS_COLUMNS = ("timestamp", "starttimemillis", "time", "datetime")


def choose_ts_column(columns: list[str], candidates: Iterable[str] = TS_COLUMNS) -> str | None:
    """An exact match (letters' case aside) in the candidates' order, else the first column that is one of ``PLAIN_TS_COLUMNS`` without punctuation."""
    found = first_column(columns, candidates)
    plain = lambda c: "".join(ch for ch in c.lower() if ch.isascii() and ch.isalnum())
    return found if found is not None else next((c for c in columns if plain(c) in PLAIN_TS_COLUMNS), None)


def ts_column(names: Column) -> Column:
    """The same choice over an array of names."""
    named = lambda c: F.get(F.filter(names, lambda n: F.lower(n) == c), 0)
    plain = F.get(F.filter(names, lambda n: F.regexp_replace(F.lower(n), "[^a-z0-9]", "").isin(*PLAIN_TS_COLUMNS)), 0)
    return F.coalesce(*map(named, TS_COLUMNS), plain)


def coerce_time(df: DataFrame, column: str, keys: list[str], into: str = "ts") -> DataFrame:
    """Seconds or other epoch numbers as double. In a group of ``keys`` with any number, texts that are none are null; else they are read as UTC times."""
    number = F.expr(f"try_cast(`{column}` as double)")
    parsed = F.unix_micros(F.expr(f"try_cast(`{column}` as timestamp)")) / 1e6
    any_number = df.groupBy(*keys).agg(F.max(number.isNotNull()).alias("_any"))
    return df.join(any_number, keys).withColumn(into, F.when(F.col("_any"), number).otherwise(parsed)).drop("_any")


def time_unit(median: Column) -> Column:
    """Ticks in a second, from the median of the absolute epoch numbers."""
    return F.when(median > 1e17, 1e9).when(median > 1e14, 1e6).when(median > 1e11, 1e3).otherwise(1.0)


def infer_time_unit(rows: DataFrame, keys: list[str]) -> DataFrame:
    return group_median(rows, keys, F.abs("ts"), "_m").select(*keys, time_unit(F.col("_m")).alias("unit"))


def align_bounds(bounds: list[Column], median: Column) -> list[Column]:
    """The bounds of one range in the unit of a series: seconds to milliseconds or nanoseconds as the series' median tells, and back.

    All are scaled alike, by the greatest of their magnitudes; without a median they stay.
    """
    most = F.greatest(*map(F.abs, bounds)) if len(bounds) > 1 else F.abs(bounds[0])
    # Magnitudes that tell the units of epoch numbers apart.
    to_nanos, to_millis = (median > 1e15) & (most < 1e12), (median > 1e12) & (most < 1e10)
    from_nanos, from_millis = (median < 1e11) & (most > 1e15), (median < 1e11) & (most > 1e12)
    return [F.when(to_nanos, b * 1e9).when(to_millis, b * 1e3).when(from_nanos, b / 1e9).when(from_millis, b / 1e3).otherwise(b) for b in bounds]


def align_bound(bound: Column, median: Column) -> Column:
    return align_bounds([bound], median)[0]


def phase_bounds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Median, first and last time of each group, and the median of the absolute times."""
    ends = rows.where("ts is not null").groupBy(*keys).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    middle = group_median(rows, keys, F.col("ts"), "median_ts")
    return ends.join(middle, keys).join(group_median(rows, keys, F.abs("ts"), "abs_median"), keys)


def phase_split(rows: DataFrame, keys: list[str], bounds: DataFrame | None = None, lookback_s: float = 1800.0, lookahead_s: float = 1800.0) -> DataFrame:
    """Adds ``phase``: pre in [start, pivot), post in [pivot, end], else null.

    Without ``bounds`` the pivot is the median time of each group of ``keys`` and the range is all of it. ``bounds`` has the keys
    and either pivot_ts (the range is lookback and lookahead around it, in the series' unit), or start_ts and end_ts (the pivot
    is the middle). Rows with a null key, or of a group without a time or bounds, are left out.
    """
    if bounds is None:
        # The range is all there is, so only the pivot has to be found.
        middle = group_median(rows, keys, F.col("ts"), "_pivot")
        phase = F.when(F.col("ts") < F.col("_pivot"), "pre").when(F.col("ts") >= F.col("_pivot"), "post")
        return join_groups(rows, middle, keys).withColumn("phase", phase).drop("_pivot")
    stats = group_median(rows, keys, F.abs("ts"), "abs_median")
    if "pivot_ts" in bounds.columns:
        pivot, unit = align_bound(F.col("pivot_ts").cast("double"), F.col("abs_median")), time_unit(F.col("abs_median"))
        limits = stats.join(bounds, keys).select(*keys, (pivot - unit * lookback_s).alias("_from"), pivot.alias("_pivot"), (pivot + unit * lookahead_s).alias("_to"))
    else:
        start, end = align_bounds([F.col(c).cast("double") for c in ("start_ts", "end_ts")], F.col("abs_median"))
        limits = stats.join(bounds, keys).select(*keys, start.alias("_from"), ((start + end) / 2).alias("_pivot"), end.alias("_to"))
    phase = F.when((F.col("ts") >= F.col("_from")) & (F.col("ts") < F.col("_pivot")), "pre").when((F.col("ts") >= F.col("_pivot")) & (F.col("ts") <= F.col("_to")), "post")
    return join_groups(rows, limits, keys).withColumn("phase", phase).drop("_from", "_pivot", "_to")


def inject_split(rows: DataFrame, injections: DataFrame, order: list[str]) -> DataFrame:
    """pre before the case's inject_ts, post from it on; by halves of the rows if there is none, or if one side would be empty. ``order``: of rows with the same ts."""
    rows = rows.join(injections, "case_id", "left")
    sizes = rows.groupBy("case_id").agg(F.count("*").alias("_n"), F.count(F.when(F.col("ts") < F.col("inject_ts"), 1)).alias("_before"))
    rows = range_rank(rows, ["case_id"], ["ts", *order], "_place").join(sizes, "case_id")
    by_time = F.when(F.col("ts") < F.col("inject_ts"), "pre").otherwise("post")
    by_half = F.when(F.col("_place") < F.floor(F.col("_n") / 2), "pre").otherwise("post")
    usable = F.col("inject_ts").isNotNull() & (F.col("_before") > 0) & (F.col("_before") < F.col("_n"))
    return rows.withColumn("phase", F.when(usable, by_time).otherwise(by_half)).drop("_n", "_before", "_place", "inject_ts")


TIME_LIKE = ("time", "timestamp", "ts", "date", "datetime")


def wide_to_long(df: DataFrame, ids: list[str], skip: Iterable[str] = TIME_LIKE) -> DataFrame:
    """(ids, column, value double): metric columns, without time-like ones and those of the middle latency."""
    values = [c for c in df.columns if c not in ids and c.lower() not in set(skip) and not c.endswith("latency-50")]
    return df.select(*ids, *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in values]).unpivot(ids, values, "column", "value")


def split_metric_name(name: Column) -> Column:
    """struct(component, metric): parted at the last underscore; ``a_b_container-x`` is a and b_container-x."""
    head, tail = F.regexp_extract(name, "^(.*)_([^_]*)$", 1), F.regexp_extract(name, "^(.*)_([^_]*)$", 2)
    moved = tail.startswith("container-") & head.contains("_")
    component = F.when(~name.contains("_"), name).when(moved, F.substring_index(head, "_", 1)).otherwise(head)
    metric = F.when(~name.contains("_"), "").when(moved, F.concat(F.regexp_extract(head, "^[^_]*_(.*)$", 1), F.lit("_"), tail)).otherwise(tail)
    return F.struct(component.alias("component"), metric.alias("metric"))


def service_metric(name: Column) -> Column:
    """The other variant: the last underscore, and latency-90 is latency."""
    head, tail = F.regexp_extract(name, "^(.*)_([^_]*)$", 1), F.regexp_extract(name, "^(.*)_([^_]*)$", 2)
    return F.struct(F.when(name.contains("_"), head).otherwise(name).alias("service"), F.when(name.contains("_"), F.replace(tail, F.lit("latency-90"), F.lit("latency"))).otherwise(F.lit("")).alias("metric"))


def component_filter(rows: DataFrame, wanted: DataFrame, column: str = "component") -> DataFrame:
    """Rows whose component is in ``wanted``, whatever the case of the letters."""
    keys = wanted.select(F.lower(column).alias("_wanted")).distinct()
    return rows.join(keys, F.lower(F.col(column)) == F.col("_wanted"), "left_semi")


def normalize_spans(df: DataFrame, numbers: Iterable[str] = ("start_ms", "elapsed")) -> DataFrame:
    numbers = set(numbers)
    return df.select(*[F.expr(f"try_cast(`{c}` as double)").alias(c) if c in numbers else F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def valid_component(name: Column) -> Column:
    """Names of the three layers; letters' case counts. Texts that stand for nothing aren't names."""
    text = F.trim(name)
    return F.coalesce(text.rlike("^(os_|docker_|db_)") & ~F.lower(text).isin("", "nan", "<na>", "none"), F.lit(False))


#: How names of machines and load generators begin, and a part of them.
BLOCKED_STARTS, BLOCKED_PART = ("ip-", "gke-", "node-", "loadgenerator"), "compute.internal"


def modelled_component(name: Column) -> Column:
    """False for machines, load generators, and empty names; null for a null name."""
    text = F.lower(name)
    out = (text != "") & ~text.contains(BLOCKED_PART)
    for start in BLOCKED_STARTS:
        out = out & ~text.startswith(start)
    return out


def list_cell_mean(cell: Column) -> Column:
    """Mean of the numeric parts of ``a;b;c``; null without any."""
    parts = F.filter(F.transform(F.split(cell, ";"), lambda p: F.trim(p).try_cast("double")), lambda p: p.isNotNull())
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, p: a + p) / F.size(parts))


def opaque_case_id(source: Column, case_id: Column) -> Column:
    return F.concat(source, F.lit("-"), F.substring(F.sha2(case_id, 256), 1, 12))


_DATES = r"(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})"


def instruction_range(text: Column) -> Column:
    """struct(start_s, end_s): the two first ISO times of a text; of one alone, half an hour on either side."""
    found = F.transform(F.regexp_extract_all(text, F.lit(_DATES), 1), lambda d: F.unix_timestamp(F.to_timestamp(F.replace(d, F.lit("T"), F.lit(" ")))))
    one, two = F.get(found, 0), F.get(found, 1)
    return F.struct(F.when(F.size(found) > 1, one).when(F.size(found) == 1, one - 1800).alias("start_s"), F.when(F.size(found) > 1, two).when(F.size(found) == 1, one + 1800).alias("end_s"))


def format_occurrence(epoch: Column, zone: str = "UTC") -> Column:
    """An epoch number of any unit as text."""
    seconds = F.when(epoch > 1e15, epoch / 1e9).when(epoch > 1e12, epoch / 1e3).otherwise(epoch)
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(F.floor(seconds)), zone), "yyyy-MM-dd HH:mm:ss")


#: The catalogue's reasons, and the fault families that mean them.
REASONS = ("CPU fault", "network delay", "network loss", "db connection limit", "db close")
REASON_OF = {"cpu": "CPU fault", "delay": "network delay", "socket": "network delay", "network": "network delay", "loss": "network loss", "db": "db connection limit"}


def canonical_reason(reason: Column) -> Column:
    """A reason of the catalogue as it is, the one that a fault family means, else null."""
    text = F.trim(reason)
    meant = F.create_map(*[F.lit(x) for kv in REASON_OF.items() for x in kv])
    return F.when(text.isin(*REASONS), text).otherwise(F.try_element_at(meant, F.lower(text)))


def log_search(lines: DataFrame, keyword: str, start_ts: float, end_ts: float, most: int) -> DataFrame:
    """The first ``most`` lines in a time range with a keyword, whatever the letters' case, cut at 500 characters."""
    hit = lines.where((F.col("ts") >= start_ts) & (F.col("ts") <= end_ts) & F.lower("message").contains(keyword.lower()))
    return hit.withColumn("message", F.substring("message", 1, 500)).orderBy("ts", "line_no").limit(most)


_MONTH_DATE = r"([A-Z][a-z]+ \d{1,2}, \d{4})"
#: What each task asks for.
REQUESTED = {"task_1": ("time",), "task_2": ("reason",), "task_3": ("component",), "task_4": ("time", "reason"), "task_5": ("time", "component"), "task_6": ("component", "reason"), "task_7": ("time", "component", "reason")}


def parse_task_window(tasks: DataFrame, zone: str = "Asia/Shanghai") -> DataFrame:
    """(row_id, task_index, start_ms, end_ms, date_key, requested, n_failures, which is always 1): a date and two clock times out of prose, local to ``zone``; an end not after the start is on the next day."""
    text = F.col("instruction")
    read = lambda pattern, form: F.try_to_timestamp(F.regexp_extract(text, pattern, 1), F.lit(form))
    day = F.coalesce(read(_MONTH_DATE, "MMMM d, yyyy"), read(r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"))
    clock = F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}:\d{2})(?::\d{2})?\b"), 1)
    minutes = lambda k: F.get(F.split(F.get(clock, k), ":"), 0).cast("int") * 60 + F.get(F.split(F.get(clock, k), ":"), 1).cast("int")
    local = F.unix_seconds(day.cast("timestamp"))
    first, last = minutes(0), minutes(1)
    utc = lambda s: F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(s), zone)) * 1000
    end = local + last * 60 + F.when(last <= first, 86400).otherwise(0)
    wanted = F.create_map(*[x for k, v in REQUESTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return tasks.select("row_id", "task_index", utc(local + first * 60).alias("start_ms"), utc(end).alias("end_ms"), F.date_format(day, "yyyy_MM_dd").alias("date_key"), F.try_element_at(wanted, F.col("task_index")).alias("requested"), F.lit(1).alias("n_failures"))
