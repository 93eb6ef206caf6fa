"""Queries of the column and time operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootloom.operators import time_ops as ops
from rootloom.plans.registry import query
from rootloom.sources import canonical as c


@query("resolve_long_columns", "select 'svc-' || (user_id % 12)::varchar as component, event_type as metric, value from events")
def _(spark, sf_dir):
    renamed = c.metric_long(spark, sf_dir).withColumnRenamed("component", "CMDB_ID").withColumnRenamed("metric", "Name")
    return ops.resolve_long_columns(renamed, ("value", "avg"), ("component", "cmdb_id"), ("name", "metric"))


@query("choose_ts_column", "select case_id, count(*) as n, min(ts) as first_ts from metric_long group by case_id")
def _(spark, sf_dir):
    rows = c.metric_long(spark, sf_dir).withColumnRenamed("ts", "Start_Time")
    at = ops.choose_ts_column(rows.columns)
    return rows.groupBy("case_id").agg(F.count("*").alias("n"), F.min(at).alias("first_ts"))


@query("coerce_time", """select event_id, case when user_id % 2 = 0 then epoch_us(ts) / 1e6 else case when event_id % 3 = 0 then event_id::double end end as ts from events""")
def _(spark, sf_dir):
    e = c.table(spark, sf_dir, "events")
    text = F.when(F.col("user_id") % 2 == 0, F.col("ts").cast("string")).otherwise(F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise("n/a"))
    rows = e.select("event_id", (F.col("user_id") % 2).alias("file"), text.alias("raw"))
    return ops.coerce_time(rows, "raw", ["file"]).select("event_id", "ts")


@query("infer_time_unit", """select case_id, case when m > 1e17 then 1e9 when m > 1e14 then 1e6 when m > 1e11 then 1e3 else 1.0 end as unit from (
    select case_id, median(abs(ts * case right(case_id, 1) when '0' then 1 when '1' then 1e3 when '2' then 1e6 else 1e9 end)) as m from metric_long group by case_id)""")
def _(spark, sf_dir):
    last = F.substring("case_id", -1, 1)
    scale = F.when(last == "0", 1.0).when(last == "1", 1e3).when(last == "2", 1e6).otherwise(1e9)
    return ops.infer_time_unit(c.metric_long(spark, sf_dir).withColumn("ts", F.col("ts") * scale), ["case_id"])


_BOUNDS = {"0": (1.0, 1704067200.0, 1704153600.0), "1": (1e3, 1704067200.0, 1704153600.0), "2": (1e9, 1704067200.0, 2e12), "3": (1.0, 1704067200000.0, 1704153600000.0), "4": (1.0, 1704067200e9, 1704153600e9), "5": (30.0, 1704067200000.0, 1704153600000.0), "6": (1e9, 0.0, 1704153600.0)}


@query("align_bounds", """with m as (select case_id, right(case_id, 1) as k, median(abs(ts)) as m from metric_long group by case_id),
    b as (select case_id, m * case k when '0' then 1 when '1' then 1e3 when '2' then 1e9 when '5' then 30 when '6' then 1e9 else 1 end as m,
      case k when '3' then 1704067200000.0 when '4' then 1704067200e9 when '5' then 1704067200000.0 when '6' then 0.0 else 1704067200.0 end::double as a,
      case k when '2' then 2e12 when '3' then 1704153600000.0 when '4' then 1704153600e9 when '5' then 1704153600000.0 else 1704153600.0 end::double as z from m),
    f as (select *, case when m > 1e15 and greatest(a, z) < 1e12 then 1 when m > 1e12 and greatest(a, z) < 1e10 then 2 when m < 1e11 and greatest(a, z) > 1e15 then 3 when m < 1e11 and greatest(a, z) > 1e12 then 4 end as how from b)
    select case_id, case how when 1 then a * 1e9 when 2 then a * 1e3 when 3 then a / 1e9 when 4 then a / 1e3 else a end as start_ts, case how when 1 then z * 1e9 when 2 then z * 1e3 when 3 then z / 1e9 when 4 then z / 1e3 else z end as end_ts from f""")
def _(spark, sf_dir):
    last = F.substring("case_id", -1, 1)
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for n, v in _BOUNDS.items() for x in (n, v[k])]), last)
    rows = ops.phase_bounds(c.metric_long(spark, sf_dir), ["case_id"])
    start, end = ops.align_bounds([of(1), of(2)], F.col("abs_median") * of(0))
    return rows.select("case_id", start.alias("start_ts"), end.alias("end_ts"))


@query("phase_split", """with b as (select case_id, median(ts) as mid from metric_long group by case_id),
    modes as (
      select case_id, 'median' as mode, ts, case when ts < mid then 'pre' else 'post' end as phase from metric_long join b using (case_id)
      union all select case_id, 'pivot', ts, case when ts >= mid - 216000 and ts < mid then 'pre' when ts >= mid and ts <= mid + 216000 then 'post' end from metric_long join b using (case_id)
      union all select case_id, 'range', ts, case when ts >= mid - 100000 and ts < mid + 50000 then 'pre' when ts >= mid + 50000 and ts <= mid + 200000 then 'post' end from metric_long join b using (case_id))
    select case_id, mode, phase, count(*) as n from modes where phase is not null group by all""")
def _(spark, sf_dir):
    rows = c.metric_long(spark, sf_dir).select("case_id", "ts")
    pivots = rows.groupBy("case_id").agg(F.median("ts").alias("pivot_ts"))
    ranges = pivots.select("case_id", (F.col("pivot_ts") - 100000).alias("start_ts"), (F.col("pivot_ts") + 200000).alias("end_ts"))
    modes = (("median", ops.phase_split(rows, ["case_id"])), ("pivot", ops.phase_split(rows, ["case_id"], pivots, 216000.0, 216000.0)), ("range", ops.phase_split(rows, ["case_id"], ranges)))
    out = None
    for name, df in modes:
        part = df.where("phase is not null").groupBy("case_id", "phase").agg(F.count("*").alias("n")).withColumn("mode", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("inject_split", """with i as (select case_id, case right(case_id, 1) when '0' then null when '1' then 0.0 else 1704500000.0 + 432000 * right(case_id, 1)::int - 864000 end as inject_ts from (select distinct case_id from metric_long)),
    n as (select m.*, i.inject_ts, count(*) over (partition by m.case_id) as n, count(*) filter (ts < inject_ts) over (partition by m.case_id) as before,
                 row_number() over (partition by m.case_id order by ts, component, metric, value) as r from metric_long m join i using (case_id))
    select case_id, phase, count(*) as n, round(sum(value), 4) as total from (
      select *, case when inject_ts is not null and before > 0 and before < n then case when ts < inject_ts then 'pre' else 'post' end else case when r <= n // 2 then 'pre' else 'post' end end as phase
      from n) group by case_id, phase""")
def _(spark, sf_dir):
    rows = c.metric_long(spark, sf_dir)
    last = F.substring("case_id", -1, 1)
    inject = F.when(last == "0", F.lit(None).cast("double")).when(last == "1", 0.0).otherwise(F.lit(1704500000.0) + 432000 * last.cast("int") - 864000)
    injections = rows.select("case_id").distinct().withColumn("inject_ts", inject)
    split = ops.inject_split(rows, injections, ["component", "metric", "value"])
    return split.groupBy("case_id", "phase").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("wide_to_long", """select c_custkey as id, k as "column", v as value from (select c_custkey, unnest([{'k': 'acct_bal', 'v': c_acctbal}, {'k': 'nation_cpu', 'v': c_nationkey::double}]) as u from customer), lateral (select u.k as k, u.v as v)""")
def _(spark, sf_dir):
    wide = c.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acct_bal"), F.col("c_nationkey").alias("nation_cpu"), F.col("c_custkey").alias("time"), F.col("c_acctbal").alias("svc_latency-50"))
    return ops.wide_to_long(wide, ["id"])


_NAMES = """select p_partkey, case p_partkey % 4 when 0 then replace(p_name, ' ', '_') when 1 then replace(p_name, ' ', '_') || '_container-cpu' when 2 then p_type else replace(p_name, ' ', '-') || '_latency-90' end as name from part"""


def _names(spark, sf_dir):
    k, name = F.col("p_partkey") % 4, F.replace("p_name", F.lit(" "), F.lit("_"))
    out = F.when(k == 0, name).when(k == 1, F.concat(name, F.lit("_container-cpu"))).when(k == 2, F.col("p_type")).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("_latency-90")))
    return c.table(spark, sf_dir, "part").select("p_partkey", out.alias("name"))


@query("split_metric_name", f"""with n as ({_NAMES}), s as (select *, regexp_extract(name, '^(.*)_([^_]*)$', 1) as head, regexp_extract(name, '^(.*)_([^_]*)$', 2) as tail from n)
    select p_partkey, case when not contains(name, '_') then name when starts_with(tail, 'container-') and contains(head, '_') then split_part(head, '_', 1) else head end as component,
           case when not contains(name, '_') then '' when starts_with(tail, 'container-') and contains(head, '_') then regexp_extract(head, '^[^_]*_(.*)$', 1) || '_' || tail else tail end as metric,
           case when contains(name, '_') then head else name end as service, case when contains(name, '_') then replace(tail, 'latency-90', 'latency') else '' end as service_metric from s""")
def _(spark, sf_dir):
    rows = _names(spark, sf_dir).withColumns({"a": ops.split_metric_name(F.col("name")), "b": ops.service_metric(F.col("name"))})
    return rows.select("p_partkey", "a.component", "a.metric", "b.service", F.col("b.metric").alias("service_metric"))


@query("component_filter", "select component, count(*) as n from metric_long where component in ('svc-1', 'svc-5', 'svc-11') group by component")
def _(spark, sf_dir):
    wanted = c.table(spark, sf_dir, "nation").where("n_nationkey in (1, 5, 11)").select(F.concat(F.lit("SVC-"), F.col("n_nationkey").cast("string")).alias("component"))
    return ops.component_filter(c.metric_long(spark, sf_dir), wanted).groupBy("component").agg(F.count("*").alias("n"))


@query("normalize_spans", "select case_id, span_id::varchar as span_id, start_ms, case when span_id % 5 <> 0 then elapsed end as elapsed from span")
def _(spark, sf_dir):
    raw = c.span(spark, sf_dir).select("case_id", "span_id", F.col("start_ms").cast("string").alias("start_ms"), F.when(F.col("span_id") % 5 == 0, "n/a").otherwise(F.col("elapsed").cast("string")).alias("elapsed"))
    return ops.normalize_spans(raw)


_COMPONENTS = ("os_001", " docker_002 ", "Docker_003", "db_004", "nan", "gke-node-1", "", "svc-host", "IP-10-0-0-1", "a.compute.internal", "LoadGenerator-2", "node-7", "mynode", "None", "os_", "<NA>")


@query("valid_component", """with n as (select s_suppkey, case s_suppkey % 17 when 0 then 'os_001' when 1 then ' docker_002 ' when 2 then 'Docker_003' when 3 then 'db_004' when 4 then 'nan' when 5 then 'gke-node-1' when 6 then '' when 7 then 'svc-host' when 8 then 'IP-10-0-0-1'
      when 9 then 'a.compute.internal' when 10 then 'LoadGenerator-2' when 11 then 'node-7' when 12 then 'mynode' when 13 then 'None' when 14 then 'os_' when 15 then '<NA>' end as name from supplier)
    select s_suppkey, name, coalesce(trim(name) in ('os_001', 'docker_002', 'db_004', 'os_'), false) as valid, coalesce(trim(name) in ('os_001', 'docker_002', 'Docker_003', 'db_004', 'nan', 'svc-host', 'mynode', 'None', 'os_', '<NA>'), false) as modelled from n""")
def _(spark, sf_dir):
    name = F.get(F.array(*map(F.lit, _COMPONENTS)), (F.col("s_suppkey") % 17).cast("int"))
    return c.table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name")).select("s_suppkey", "name", ops.valid_component(F.col("name")).alias("valid"), F.coalesce(ops.modelled_component(F.col("name")), F.lit(False)).alias("modelled"))


@query("forbidden_columns", "select sample_index, feature, t, value from kpi")
def _(spark, sf_dir):
    from rootloom.sources.files import drop_forbidden

    rows = c.kpi(spark, sf_dir).withColumn("root1", F.lit(1)).withColumn("Label", F.lit("x"))
    return drop_forbidden(rows, ("root1", "root2", "root3", "label"))


@query("list_cell_mean", """select p_partkey, case p_partkey % 4 when 0 then (p_size + 2.5) / 2 when 1 then p_size::double when 2 then null else p_retailprice end as mean from part""")
def _(spark, sf_dir):
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    cell = F.when(k == 0, F.concat(size, F.lit(";2.5;x"))).when(k == 1, size).when(k == 2, "none;").otherwise(F.col("p_retailprice").cast("string"))
    return c.table(spark, sf_dir, "part").select("p_partkey", ops.list_cell_mean(cell).alias("mean"))


@query("opaque_case_id", "select case_id, source || '-' || substr(sha256(case_id), 1, 12) as opaque_id from cases")
def _(spark, sf_dir):
    return c.case(spark, sf_dir).select("case_id", ops.opaque_case_id(F.col("source"), F.col("case_id")).alias("opaque_id"))


@query("label_safe_payload", "select case_id, source, telemetry_bytes from cases")
def _(spark, sf_dir):
    from rootloom.sources.files import label_safe

    return label_safe(c.case(spark, sf_dir))


@query("instruction_range", """with t as (select o_orderkey, o_orderdate as d, o_orderkey % 3 as k from orders)
    select o_orderkey, case k when 0 then epoch(d)::bigint when 1 then epoch(d)::bigint - 1800 end as start_s, case k when 0 then epoch(d)::bigint + 7200 when 1 then epoch(d)::bigint + 1800 end as end_s from t""")
def _(spark, sf_dir):
    k, d = F.col("o_orderkey") % 3, F.col("o_orderdate")
    text = F.when(k == 0, F.concat(F.lit("between "), F.date_format(d, "yyyy-MM-dd HH:mm:ss"), F.lit(" and "), F.date_format(d + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss"))).when(k == 1, F.concat(F.lit("at "), F.date_format(d, "yyyy-MM-dd HH:mm:ss"))).otherwise("some time")
    return c.table(spark, sf_dir, "orders").select("o_orderkey", ops.instruction_range(text).alias("r")).select("o_orderkey", "r.start_s", "r.end_s")


@query("format_occurrence", """select event_id, strftime(make_timestamp((floor(epoch_us(ts) / 1e6) * 1000000)::bigint), '%Y-%m-%d %H:%M:%S') as utc_text,
    strftime(make_timestamp((floor(epoch_us(ts) / 1e6) * 1000000)::bigint) + interval 8 hours, '%Y-%m-%d %H:%M:%S') as local_text from events""")
def _(spark, sf_dir):
    e = c.table(spark, sf_dir, "events").select("event_id", c.epoch_seconds("ts").alias("s"))
    k = F.col("event_id") % 2
    raw = F.when(k == 0, F.col("s")).otherwise(F.col("s") * 1e3)
    return e.select("event_id", ops.format_occurrence(raw).alias("utc_text"), ops.format_occurrence(raw, "Asia/Shanghai").alias("local_text"))


_SAID = ("CPU fault", "cpu", " CPU ", "delay", "Socket", "network", "loss", "db", "db close", "DB close", "high cpu", "latency", "")


@query("canonical_reason", """select event_id, case event_id % 14 when 0 then 'CPU fault' when 1 then 'CPU fault' when 2 then 'CPU fault' when 3 then 'network delay' when 4 then 'network delay' when 5 then 'network delay' when 6 then 'network loss'
    when 7 then 'db connection limit' when 8 then 'db close' end as reason from events""")
def _(spark, sf_dir):
    said = F.get(F.array(*map(F.lit, _SAID)), (F.col("event_id") % 14).cast("int"))
    return c.table(spark, sf_dir, "events").select("event_id", ops.canonical_reason(said).alias("reason"))


@query("log_search", """select case_id, component, ts, substr(message, 1, 500) as message, line_no from log_line
    where ts between 1704153600 and 1705017600 and contains(lower(message), 'error') order by ts, line_no limit 50""")
def _(spark, sf_dir):
    return ops.log_search(c.log_line(spark, sf_dir), "ERROR", 1704153600.0, 1705017600.0, 50)


@query("date_prune", "select row_id, count(*) as n from incident_window, (select distinct date_trunc('day', ts) as d from events) where epoch_ms(d) <= end_ms and epoch_ms(d) + 86400000 > start_ms group by row_id")
def _(spark, sf_dir):
    from rootloom.operators.graph import window_interval_join

    days = c.table(spark, sf_dir, "events").select(F.date_trunc("day", "ts").alias("d")).distinct().select((F.unix_micros(F.col("d").cast("timestamp")) / 1000).cast("long").alias("day_ms"))
    windows = c.incident_window(spark, sf_dir).withColumn("start_ms", F.floor(F.col("start_ms") / 86400000) * 86400000)
    return window_interval_join(days, windows, "day_ms").groupBy("row_id").agg(F.count("*").alias("n"))


@query("parse_task_window", """select row_id, task_index, epoch_ms(day) - 8 * 3600000 as start_ms, epoch_ms(day) - 8 * 3600000 + 1800000 + case when row_id % 2 = 1 then 84600000 else 0 end as end_ms,
    strftime(day, '%Y_%m_%d') as date_key, requested, 1 as n_failures from task""")
def _(spark, sf_dir):
    t, day = c.task(spark, sf_dir), F.col("day")
    text = F.when(F.col("row_id") % 2 == 0, F.concat(F.lit("On "), F.date_format(day, "MMMM d, yyyy"), F.lit(", between 0:00 and 00:30, a failure was seen."))).otherwise(F.concat(F.lit("On "), F.date_format(day, "yyyy-MM-dd"), F.lit(" from 00:00 to 0:00 there was one failure.")))
    return ops.parse_task_window(t.select("row_id", "task_index", text.alias("instruction")))
