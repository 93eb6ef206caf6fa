"""The canonical telemetry tables, built from the driver's tables.

Timestamps in the Parquet files have no zone; they are read as UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rootloom.operators.findings import prepost_moments, shift_findings
from rootloom.operators.time_ops import phase_split


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1e6


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    case = F.concat(F.lit("case-"), F.floor((F.dayofmonth("ts") - 1) / 5).cast("int").cast("string"))
    return e.withColumns({"case_id": case, "component": F.concat(F.lit("svc-"), (F.col("user_id") % 12).cast("string")), "at": epoch_seconds("ts")})


def metric_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("case_id", "component", F.col("event_type").alias("metric"), F.lit("events").alias("source"), F.col("at").alias("ts"), "value")


def log_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat("event_type", F.lit(" user "), F.col("user_id").cast("string"), F.lit(" props "), "props")
    return _events(spark, sf_dir).select("case_id", "component", F.col("at").alias("ts"), message.alias("message"), F.col("event_id").alias("line_no"))


def span(spark: SparkSession, sf_dir: str) -> DataFrame:
    three = lambda c: F.lpad(c.cast("string"), 3, "0")
    span_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("case-"), (F.col("l_orderkey") % 6).cast("string")).alias("case_id"),
        span_id.alias("span_id"),
        F.when(F.col("l_linenumber") > 1, span_id - 1).alias("parent_id"),
        F.concat(F.lit("docker_"), three(F.col("l_suppkey") % 8 + 1)).alias("component"),
        F.concat(F.lit("svc-"), (F.col("l_partkey") % 12).cast("string")).alias("service"),
        F.concat(F.lit("db_"), three(F.col("l_partkey") % 13 + 1)).alias("ds_name"),
        F.when(F.col("l_linestatus") == "O", "JDBC").otherwise("RPC").alias("call_type"),
        (F.unix_micros(F.col("l_shipdate").cast("timestamp")) / 1e3).alias("start_ms"),
        F.col("l_quantity").alias("elapsed"),
        F.when(F.col("l_returnflag") != "R", "true").otherwise("false").alias("success"),
    )


def incident_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = ((F.lit(1704067200).cast("long") + F.col("n_nationkey").cast("long") * 86400) * 1000).alias("start_ms")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), F.concat(F.lit("task_"), (F.col("n_nationkey") % 7 + 1).cast("string")).alias("task_index"), start)
    return n.withColumn("end_ms", F.col("start_ms") + 36 * 3600 * 1000)


def kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_index"), F.posexplode("embedding").alias("pos", "value"))
    return e.select("sample_index", F.concat(F.lit("feature"), (F.col("pos") % 8).cast("string")).alias("feature"), F.floor(F.col("pos") / 8).cast("int").alias("t"), F.col("value").cast("double").alias("value"))


def kpi_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda c: F.when(c, 1).otherwise(0)
    label, vec = F.col("label"), F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(vec.alias("sample_index"), one((label % 3 == 0) | (vec % 7 == 0)).alias("root1"), one(label % 3 == 1).alias("root2"), one((label % 3 == 2) | (vec % 5 == 0)).alias("root3"))


def case(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    fault = F.when(F.col("o_orderstatus") == "F", "cpu").when(F.col("o_orderstatus") == "O", "delay").otherwise("loss")
    return o.select(F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("case_id"), F.col("o_orderpriority").alias("source"), F.concat(F.lit("svc-"), (F.col("o_custkey") % 6).cast("string")).alias("true_root"), fault.alias("fault_type"), F.col("o_totalprice").alias("telemetry_bytes"))


def task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each order: its day, and what is asked for by its index."""
    o = table(spark, sf_dir, "orders")
    day = F.date_trunc("day", F.col("o_orderdate").cast("timestamp"))
    return o.select(F.col("o_orderkey").alias("row_id"), F.concat(F.lit("task_"), (F.col("o_orderkey") % 7 + 1).cast("string")).alias("task_index"), day.alias("day"))


SYSTEMS = (("single", 2), ("sharded", 3), ("repaired", 4))


def prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three systems; the first root is wrong where the order key is divisible by 2, 3 or 4. Usage figures follow from the key."""
    o = table(spark, sf_dir, "orders")
    systems = F.explode(F.array(*[F.struct(F.lit(s).alias("system"), F.lit(m).alias("m")) for s, m in SYSTEMS])).alias("s")
    rows = o.select("o_orderkey", "o_custkey", systems).select("o_orderkey", "o_custkey", "s.*")
    root = lambda k: F.concat(F.lit("svc-"), ((F.col("o_custkey") + k) % 6).cast("string"))
    wrong = F.col("o_orderkey") % F.col("m") == 0
    ranked = F.when(wrong, F.array(root(1), root(0), root(2))).otherwise(F.array(root(0), root(1), root(2)))
    return rows.select(
        F.concat(F.lit("C"), F.col("o_orderkey").cast("string")).alias("case_id"), "system", ranked.alias("ranked_roots"),
        (F.lit(100) * F.col("m") + F.col("o_orderkey") % 50).cast("long").alias("total_tokens"), (F.col("o_orderkey") % 7).cast("long").alias("llm_calls"),
        (F.col("o_orderkey") % 11 / 2.0).alias("latency_s"), ((F.col("o_orderkey") % 10) / 10.0).alias("confidence"),
    )


def opinion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON opinion for each customer: cases of five workers, two candidates, and mass for anything else."""
    n = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    candidate = lambda add, reason, p: F.concat(F.lit('{"component":"svc-'), ((key + add) % 6).cast("string"), F.lit(f'","reason":"{reason}","probability":'), p.cast("string"), F.lit(',"evidence_ptrs":["ptr-'), key.cast("string"), F.lit('","bad"]}'))
    raw = F.concat(F.lit('{"candidates":['), candidate(0, "cpu", (key % 4 + 3) / 10.0), F.lit(","), candidate(1, "delay", (key % 3 + 1) / 10.0), F.lit('],"other_mass":0.2}'))
    return n.select(F.concat(F.lit("case-"), F.floor(key / 5).cast("long").cast("string")).alias("case_id"), F.concat(F.lit("worker-"), (key % 5).cast("string")).alias("worker_id"), raw.alias("raw"))


def finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean-shift findings of the metric table, all phases split at each case's median time. Score: the absolute Welch t."""
    rows = phase_split(metric_long(spark, sf_dir), ["case_id", "source"])
    moments = prepost_moments(rows, ["case_id", "component", "metric", "source"])
    found = shift_findings(moments)
    modality = F.when(F.col("metric").isin("click", "view"), "metrics").when(F.col("metric") == "error", "logs").when(F.col("metric") == "purchase", "traces").otherwise("auxiliary")
    return found.select("case_id", modality.alias("modality"), "component", F.col("metric").alias("signal"), "direction", "magnitude", F.round(F.abs("t_stat"), 6).alias("score"), F.col("post_first").alias("window_start"), F.concat("metric", F.lit(":"), "component").alias("evidence_ptr")).where("score is not null")
