"""Queries of the streaming operators: the events table worked off as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootloom.plans.registry import query
from rootloom.sources import canonical as c
from rootloom.sources.files import shared_folder
from rootloom.streaming import incremental as ops


def _stream(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    # As a pattern the path may be one file or a folder of them; a plain path has to be a folder.
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")
    case = F.concat(F.lit("case-"), F.floor((F.dayofmonth("ts") - 1) / 5).cast("int").cast("string"))
    return e.select(case.alias("case_id"), F.concat(F.lit("svc-"), (F.col("user_id") % 12).cast("string")).alias("component"), F.col("event_type").alias("metric"), F.lit("events").alias("source"), F.col("ts").cast("timestamp").alias("event_time"), "value", F.concat("event_type", F.lit(" user "), F.col("user_id").cast("string")).alias("message"))


def _run(spark, streamed):
    return ops.run_to_table(streamed, shared_folder(spark, "stream"), shared_folder(spark, "stream-state"))


_CLOSED = "date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 10 minutes"


@query("streaming_moments", f"select epoch(date_trunc('hour', ts))::bigint as window_s, 'case-' || ((day(ts) - 1) // 5)::int::varchar as case_id, 'svc-' || (user_id % 12)::varchar as component, event_type as metric, count(value) as n, round(sum(value), 4) as total, min(value) as least, max(value) as most from events where {_CLOSED} group by all")
def _(spark, sf_dir):
    windows = _run(spark, ops.windowed_moments(_stream(spark, sf_dir)))
    return windows.select(F.unix_timestamp("window_start").alias("window_s"), "case_id", "component", "metric", "n", F.round("total", 4).alias("total"), "least", "most")


@query("streaming_templates", f"select 'case-' || ((day(ts) - 1) // 5)::int::varchar as case_id, 'svc-' || (user_id % 12)::varchar as component, event_type || ' user <num>' as template, count(*) as n from events where {_CLOSED} group by all")
def _(spark, sf_dir):
    windows = _run(spark, ops.windowed_templates(_stream(spark, sf_dir)))
    return windows.groupBy("case_id", "component", "template").agg(F.sum("n").alias("n"))


@query("merged_moments", f"""with e as (select 'case-' || ((day(ts) - 1) // 5)::int::varchar as case_id, 'svc-' || (user_id % 12)::varchar as component, event_type as metric, case when extract(hour from ts) < 12 then 'pre' else 'post' end as phase, value from events where {_CLOSED})
    select case_id, component, metric, count(*) filter (phase = 'pre') as pre_n, round(avg(value) filter (phase = 'pre'), 6) as pre_mean, round(stddev_samp(value) filter (phase = 'pre'), 6) as pre_std, count(*) filter (phase = 'post') as post_n, round(avg(value) filter (phase = 'post'), 6) as post_mean, round(stddev_samp(value) filter (phase = 'post'), 6) as post_std from e group by all""")
def _(spark, sf_dir):
    windows = _run(spark, ops.windowed_moments(_stream(spark, sf_dir)))
    phase = F.when(F.hour("window_start") < 12, "pre").otherwise("post")
    merged = ops.merge_moments(windows, phase)
    return merged.select("case_id", "component", "metric", "pre_n", F.round("pre_mean", 6).alias("pre_mean"), F.round(F.sqrt("pre_var"), 6).alias("pre_std"), "post_n", F.round("post_mean", 6).alias("post_mean"), F.round(F.sqrt("post_var"), 6).alias("post_std"))
