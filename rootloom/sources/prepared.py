"""A cache of all that incidents need of raw telemetry: slices, statistics of days, summaries of traces, edges, volumes; refused once it is stale."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rootloom.operators.findings import daily_baseline, trace_summary, volume_tertiles
from rootloom.operators.graph import span_edges, window_interval_join
from rootloom.sources.files import file_manifest, write_partitioned

VERSION = 1
PARTS = ("metric", "trace", "metric_stats", "trace_summary", "trace_edges", "volume")
_TRACE_KEYS = ["row_id", "component", "service", "ds_name", "call_type"]


class StaleCache(ValueError):
    """The cache isn't complete, or was built by another version or from other sources."""


def source_mark(catalog: DataFrame, windows: DataFrame) -> str:
    """One hash of the source files (path, bytes) and of the windows' rows, whatever their order."""
    lines = windows.select(F.to_json(F.struct(*sorted(windows.columns))).alias("path"), F.lit(0).alias("bytes"))
    marks = [file_manifest(t).first() for t in (catalog, lines)]
    return hashlib.sha256(":".join(f"{m['files']},{m['bytes']},{m['sha256']}" for m in marks).encode()).hexdigest()


def _day(time_ms: str):
    return F.date_format(F.timestamp_millis(F.col(time_ms).cast("long")), "yyyy-MM-dd")


def prepare(metrics: DataFrame, spans: DataFrame, windows: DataFrame, folder: str, mark: str) -> None:
    """Writes ``PARTS`` below a new folder, and a manifest last of all: a build that was broken off has none.

    metrics: (source, component, metric, time_ms, value); spans: (span_id, parent_id, component, service, ds_name, call_type, start_ms,
    elapsed, success); windows: (row_id, start_ms, end_ms), both ends included. Raw rows meet all windows in one pass each; the parts about
    windows are made from what that wrote. Slices are zstd Parquet in a directory for each day and window, large ones over several
    files. metric_stats: whole days on which a window begins, values that are null left out. trace_edges: calls whose two ends lie in the window.
    volume: each window's rows by modality, 0 where there are none, and its third by total. Rows without a time are in no window. Windows of one row_id count as one.
    """
    spark = metrics.sparkSession
    days = windows.select("row_id", "start_ms", "end_ms", _day("start_ms").alias("date_key"))
    dated = metrics.select("source", "component", "metric", "time_ms", "value")
    write_partitioned(window_interval_join(dated, days).drop("start_ms", "end_ms"), f"{folder}/metric", ["date_key", "row_id"])
    timed = spans.select("span_id", "parent_id", "component", "service", "ds_name", "call_type", F.col("start_ms").alias("time_ms"), "elapsed", "success")
    write_partitioned(window_interval_join(timed, days).drop("start_ms", "end_ms"), f"{folder}/trace", ["date_key", "row_id"])
    ours = dated.withColumn("date_key", _day("time_ms")).join(days.select("date_key").distinct(), "date_key", "left_semi")
    daily_baseline(ours, ["date_key", "source", "component", "metric"]).write.option("compression", "zstd").parquet(f"{folder}/metric_stats")

    whole = days.select("date_key", "row_id").schema
    schemas = {"metric": StructType([*dated.schema, *whole]), "trace": StructType([*timed.schema, *whole])}
    kept = {part: spark.read.schema(schema).parquet(f"{folder}/{part}") for part, schema in schemas.items()}
    traces = kept["trace"].withColumnRenamed("time_ms", "start_ms")
    trace_summary(traces, _TRACE_KEYS).write.option("compression", "zstd").parquet(f"{folder}/trace_summary")
    span_edges(traces, ["row_id"]).write.option("compression", "zstd").parquet(f"{folder}/trace_edges")
    counts = [kept[part].groupBy("row_id").agg(F.count("*").alias(f"{part}_rows")) for part in ("metric", "trace")]
    sizes = days.select("row_id").distinct().join(counts[0], "row_id", "left").join(counts[1], "row_id", "left").fillna(0)
    volume_tertiles(sizes.withColumn("total_rows", F.col("metric_rows") + F.col("trace_rows")), "total_rows").write.parquet(f"{folder}/volume")
    done = spark.read.parquet(f"{folder}/volume").agg(F.lit(VERSION).alias("version"), F.lit(mark).alias("mark"), F.count("*").alias("windows"), *[F.coalesce(F.sum(f"{p}_rows"), F.lit(0)).cast("long").alias(f"{p}_rows") for p in schemas], *[F.lit(t.json()).alias(f"{p}_schema") for p, t in schemas.items()])
    done.write.parquet(f"{folder}/manifest")


def open_prepared(spark: SparkSession, folder: str, mark: str) -> dict[str, DataFrame]:
    """The parts of a cache by name; ``StaleCache`` without a manifest, or where its version, its sources or its slices' rows aren't as they were."""
    from pyspark.errors import AnalysisException

    try:
        manifest = spark.read.parquet(f"{folder}/manifest").first()
    except AnalysisException as e:
        raise StaleCache(f"{folder} has no manifest: its build wasn't finished") from e
    if manifest is None or manifest["version"] != VERSION or manifest["mark"] != mark:
        raise StaleCache(f"{folder} was built by another version or from other sources")
    parts = {part: spark.read.parquet(f"{folder}/{part}") for part in PARTS[2:]}
    for part in PARTS[:2]:
        parts[part] = spark.read.schema(StructType.fromJson(json.loads(manifest[f"{part}_schema"]))).parquet(f"{folder}/{part}")
        if parts[part].count() != manifest[f"{part}_rows"]:
            raise StaleCache(f"{folder}/{part} has not the rows that were written")
    return parts
