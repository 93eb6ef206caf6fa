"""Incremental forms of the grouped statistics with Structured Streaming.

Windows of mergeable sums go out once the watermark has passed them; any phase split afterwards is a merge of windows, so
the raw rows are read once. State is bounded by the watermark's delay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootloom.operators.findings import log_template

KEYS = ["case_id", "component", "metric", "source"]


def windowed_moments(stream: DataFrame, time: str = "event_time", width: str = "1 hour", delay: str = "10 minutes", keys: list[str] = KEYS) -> DataFrame:
    """(window_start, keys, n, total, squares, least, most) of each closed window; rows later than the delay are left out."""
    grouped = stream.withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), *keys)
    sums = grouped.agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"), F.min("value").alias("least"), F.max("value").alias("most"))
    return sums.select(F.col("w.start").alias("window_start"), *keys, "n", "total", "squares", "least", "most")


def windowed_templates(stream: DataFrame, time: str = "event_time", width: str = "1 hour", delay: str = "10 minutes", keys: tuple[str, ...] = ("case_id", "component")) -> DataFrame:
    """(window_start, keys, template, n) of each closed window."""
    rows = stream.withColumn("template", log_template(F.col("message"))).withWatermark(time, delay)
    counts = rows.groupBy(F.window(time, width).alias("w"), *keys, "template").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), *keys, "template", "n")


def merge_moments(windows: DataFrame, phase: Column, keys: list[str] = KEYS) -> DataFrame:
    """The phase moments of findings, merged from windows: counts, means and sample variances before and after."""
    rows = windows.withColumn("phase", phase)
    out = []
    for p in ("pre", "post"):
        of = lambda c, f=F.sum, p=p: f(F.when(F.col("phase") == p, F.col(c)))
        n, total, squares = F.coalesce(of("n"), F.lit(0)), of("total"), of("squares")
        variance = F.when(n > 1, F.greatest(F.lit(0.0), squares - total * total / n) / (n - 1))
        out += [n.cast("long").alias(f"{p}_n"), F.when(n > 0, total / n).alias(f"{p}_mean"), variance.alias(f"{p}_var"), of("least", F.min).alias(f"{p}_min"), of("most", F.max).alias(f"{p}_max")]
    return rows.where("phase is not null").groupBy(*keys).agg(*out)


def run_to_table(streamed: DataFrame, folder: str, state: str) -> DataFrame:
    """Works off what is there now, appends closed windows to Parquet, and gives the table. Later runs go on where this one ended."""
    query = streamed.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return streamed.sparkSession.read.schema(streamed.schema).parquet(folder)
