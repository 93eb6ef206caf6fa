"""Queries of the finding operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootloom.operators import findings as ops
from rootloom.operators.time_ops import phase_split
from rootloom.plans.registry import query
from rootloom.sources import canonical as c

KEYS = ["case_id", "component", "metric", "source"]


def _phased(spark, sf_dir):
    return phase_split(c.metric_long(spark, sf_dir), ["case_id", "source"])


def _moments(spark, sf_dir):
    return ops.prepost_moments(_phased(spark, sf_dir), KEYS)


def _rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


@query("prepost_moments", "select * replace (round(pre_mean, 6) as pre_mean, round(pre_var, 6) as pre_var, round(post_mean, 6) as post_mean, round(post_var, 6) as post_var) from moments")
def _(spark, sf_dir):
    return _rounded(_moments(spark, sf_dir), "pre_mean", "pre_var", "post_mean", "post_var")


@query("welch_shift", "select case_id, component, metric, round(delta, 6) as delta, round(se, 6) as standard_error, round(t_stat, 6) as t_stat, round(df, 5) as df, pre_n >= 2 and post_n >= 2 and se = 0 and delta <> 0 as t_infinite from welch")
def _(spark, sf_dir):
    rows = ops.welch_shift(_moments(spark, sf_dir)).withColumn("df", F.round("df", 5))
    return _rounded(rows, "delta", "standard_error", "t_stat").select("case_id", "component", "metric", "delta", "standard_error", "t_stat", "df", "t_infinite")


@query("welch_pvalue")
def _(spark, sf_dir):
    return ops.with_p_values(ops.shift_findings(_moments(spark, sf_dir))).select("case_id", "component", "metric", "t_stat", "df", "p_value")


@query("bh_fdr", """with p as (select case_id, component, metric, exp(-abs(t_stat)) as p from welch where t_stat is not null),
    r as (select *, row_number() over (partition by case_id order by p, component, metric) as r, count(*) over (partition by case_id) as m from p)
    select case_id, component, metric, round(p, 9) as p_value, round(least(1.0, min(greatest(p, 1e-300) * m / r) over (partition by case_id order by r desc)), 9) as q_value from r""")
def _(spark, sf_dir):
    shifts = ops.welch_shift(_moments(spark, sf_dir)).where("t_stat is not null").select("case_id", "component", "metric", F.exp(-F.abs("t_stat")).alias("p_value"))
    return _rounded(ops.bh_fdr(shifts, ["case_id"], ["component", "metric"]), "p_value", "q_value", places=9)


@query("metric_findings")
def _(spark, sf_dir):
    rows = ops.metric_findings(_phased(spark, sf_dir), KEYS, ["case_id"], 20)
    return rows.select("case_id", "component", "metric", "direction", "magnitude", "score", "p_value", "q_value")


@query("trace_findings_shift")
def _(spark, sf_dir):
    spans = c.span(spark, sf_dir).select("case_id", "component", F.col("call_type").alias("metric"), F.lit("spans").alias("source"), (F.col("start_ms") / 1e3).alias("ts"), F.col("elapsed").alias("value"))
    rows = ops.metric_findings(phase_split(spans, ["case_id", "source"]), KEYS, ["case_id"], 20)
    return rows.select("case_id", "component", "metric", "direction", "magnitude", "score", "p_value", "q_value")


_TEMPLATE = r"""substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(message)), '\b[0-9a-f]{8,}\b', '<hex>', 'g'), '\b\d{4}-\d{2}-\d{2}[ t]\d{2}:\d{2}:\d{2}(?:\.\d+)?\b', '<datetime>', 'g'), '\b\d+(?:\.\d+)?\b', '<num>', 'g'), '\s+', ' ', 'g'), 1, 300)"""


@query("log_template", f"with m as (select line_no, message || ' at 2024-01-02 03:04:05.6   id deadbeef01' as message from log_line) select line_no, {_TEMPLATE} as template from m")
def _(spark, sf_dir):
    lines = c.log_line(spark, sf_dir).select("line_no", F.concat("message", F.lit(" at 2024-01-02 03:04:05.6   id DEADBEEF01")).alias("message"))
    return lines.select("line_no", ops.log_template(F.col("message")).alias("template"))


@query("log_pattern_shift", f"""with b as (select case_id, median(ts) as mid from log_line group by case_id),
    k as (select case_id, component, {_TEMPLATE} as template, count(*) filter (ts < mid) as pre_count, count(*) filter (ts >= mid) as post_count from log_line join b using (case_id) group by all)
    select *, case when post_count >= pre_count then 'more' else 'less' end as direction, abs(post_count - pre_count)::double as magnitude,
      round(abs(ln((post_count + 1) / (pre_count + 1))) * sqrt((pre_count + post_count) / (pre_count + post_count + 2)), 6) as score from k""")
def _(spark, sf_dir):
    return ops.log_pattern_shift(phase_split(c.log_line(spark, sf_dir), ["case_id"]), ["case_id", "component"])


_SHIFT_TOP = """m as (select case_id, component, metric, round(abs(post_mean - pre_mean) / (abs(pre_mean) + 1), 6) as score, pre_mean, post_mean from moments where pre_n > 0 and post_n > 0),
    one as (select * from (select *, row_number() over (partition by case_id, component order by score desc, metric) as r from m) where r = 1),
    top as (select * exclude r, row_number() over (partition by case_id order by score desc, component)::int as rank from one)"""


@query("metric_shift_top", f"with {_SHIFT_TOP} select case_id, component, metric, score, rank from top where rank <= 25")
def _(spark, sf_dir):
    return ops.metric_shift_top(_phased(spark, sf_dir)).select("case_id", "component", "metric", "score", "rank")


#: Names of metrics that reach every branch of the vocabularies.
NAMES = ("duration_ms", "connection_count", "ratio_x", "response_time", "tcp_retrans", "success_rate", "row_lock_waits", "login_count", "on_off_state", "client_rejected", "CPU_load", "Memory_rss", "disk_blkio", "packet_loss", "socket_reset", "latency-90", "heap_used", "processor_q", "rx_bytes", "sql_limit", "errors_all", "fs-free", "elapsed", "plain")
_NAMED = f"(select event_id, lower([{', '.join(repr(n) for n in NAMES)}][event_id % {len(NAMES)} + 1]) as m from events)"


def named(spark, sf_dir):
    return c.table(spark, sf_dir, "events").select("event_id", F.get(F.array(*map(F.lit, NAMES)), (F.col("event_id") % len(NAMES)).cast("int")).alias("m"))


FAMILY = """case when contains({0}, 'memory') then 'mem' when contains({0}, 'latency') or contains({0}, 'response_time') then 'delay' when contains({0}, 'packet_loss') then 'loss' when contains({0}, 'tcp') then 'socket' when contains({0}, 'cpu') then 'cpu' when contains({0}, 'mem') then 'mem' when contains({0}, 'disk') then 'disk' when contains({0}, 'delay') then 'delay' when contains({0}, 'loss') then 'loss' when contains({0}, 'socket') then 'socket' else 'unknown' end"""


@query("case_profile", f"""with {_SHIFT_TOP}, p as (select case_id, count(*)::int as n_shifts, max(component) filter (rank = 1) as top_component, max(metric) filter (rank = 1) as m1, max(score) filter (rank = 1) as s1, coalesce(max(score) filter (rank = 2), 0) as s2 from top where rank <= 10 group by case_id)
    select case_id, n_shifts, top_component, {FAMILY.format('m1')} as family, round(case when s1 + s2 > 0 then s1 / (s1 + s2) else 0 end, 6) as confidence,
      coalesce(case_id in (select case_id from log_line where contains(message, 'error')), false) as has_logs, coalesce(case_id in (select case_id from span), false) as has_traces from p""")
def _(spark, sf_dir):
    logs = c.log_line(spark, sf_dir).where("contains(message, 'error')").select("case_id", F.lit("logs").alias("modality"))
    traces = c.span(spark, sf_dir).select("case_id", F.lit("traces").alias("modality"))
    return ops.case_profile(ops.metric_shift_top(_phased(spark, sf_dir)), logs.union(traces))


_BASELINE = """select component, metric, source, count(value) as n, avg(value) as mean, stddev_samp(value) as std, min(value) as least, max(value) as most,
    quantile_cont(value, 0.05) as p05, quantile_cont(value, 0.15) as p15, quantile_cont(value, 0.90) as p90, quantile_cont(value, 0.95) as p95 from metric_long group by all"""


@query("daily_baseline", f"with b as ({_BASELINE}) select component, metric, source, n, round(mean, 6) as mean, round(std, 6) as std, least, most, round(p05, 6) as p05, round(p15, 6) as p15, round(p90, 6) as p90, round(p95, 6) as p95 from b")
def _(spark, sf_dir):
    return _rounded(ops.daily_baseline(c.metric_long(spark, sf_dir), ["component", "metric", "source"]), "mean", "std", "p05", "p15", "p90", "p95")


_WINDOWED = "select w.row_id, m.component, m.metric, m.source, m.ts, m.value from metric_long m join incident_window w on m.ts * 1000 between w.start_ms and w.end_ms"


def _windowed(spark, sf_dir):
    from rootloom.operators.graph import window_interval_join

    rows = c.metric_long(spark, sf_dir).withColumn("time_ms", F.col("ts") * 1000)
    return window_interval_join(rows, c.incident_window(spark, sf_dir)).select("row_id", "component", "metric", "source", "ts", "value")


@query("threshold_anomaly", f"""with b as ({_BASELINE}), w as ({_WINDOWED}),
    e as (select row_id, component, metric, source, max(value) as top, min(value) as bottom, arg_max(ts, (value, -ts)) as top_ts, arg_min(ts, (value, ts)) as bottom_ts from w group by all),
    s as (select e.*, (top - p95) / (abs(p95) + 1) as hi, (p05 - bottom) / (abs(p05) + 1) as lo from e join b using (component, metric, source))
    select row_id, component, metric, source, case when hi >= lo then 'high' else 'low' end as direction, round(greatest(hi, lo), 6) as score, case when hi >= lo then top_ts else bottom_ts end as ts from s where hi > 0 or lo > 0""")
def _(spark, sf_dir):
    keys = ["component", "metric", "source"]
    return ops.threshold_anomaly(_windowed(spark, sf_dir), ops.daily_baseline(c.metric_long(spark, sf_dir), keys), ["row_id"], keys)


_SUMMARY = """select case_id, component, service, ds_name, call_type, count(*) as n, avg(elapsed) as mean_elapsed, median(elapsed) as median_elapsed, max(elapsed) as max_elapsed, min(start_ms) as first_start,
    arg_max(start_ms, (elapsed, -start_ms)) as max_start, count(*) filter (lower(success) in ('false', '0', 'fail', 'failed')) as failures from span group by all"""
_SUMMARY_KEYS = ["case_id", "component", "service", "ds_name", "call_type"]


@query("trace_summary", f"select * replace (round(mean_elapsed, 6) as mean_elapsed) from ({_SUMMARY})")
def _(spark, sf_dir):
    return _rounded(ops.trace_summary(c.span(spark, sf_dir), _SUMMARY_KEYS), "mean_elapsed")


@query("trace_latency_findings", f"""with s as ({_SUMMARY}), g as (select case_id, median(mean_elapsed) as gm from s group by case_id)
    select case_id, component, service, ds_name, call_type, round(greatest(mean_elapsed - gm, 0) / (abs(gm) + 1) + 0.1 * greatest(max_elapsed - mean_elapsed, 0) / (abs(mean_elapsed) + 1), 9) as score, case when failures > 0 then 'loss' else 'delay' end as hint from s join g using (case_id)""")
def _(spark, sf_dir):
    return ops.trace_latency_findings(ops.trace_summary(c.span(spark, sf_dir), _SUMMARY_KEYS)).select(*_SUMMARY_KEYS, "score", "hint")


@query("window_mean_anomaly", """with m as (select component, metric, avg(value) filter (ts between 1704153600 and 1704412800) as window_mean, avg(value) filter (not (ts between 1704153600 and 1704412800)) as baseline_mean from metric_long group by all)
    select component, metric, round(window_mean, 6) as window_mean, round(baseline_mean, 6) as baseline_mean, round(abs(window_mean - baseline_mean) / (abs(baseline_mean) + 1), 6) as severity from m where window_mean is not null and baseline_mean is not null order by severity desc, component, metric limit 30""")
def _(spark, sf_dir):
    return _rounded(ops.window_mean_anomaly(c.metric_long(spark, sf_dir), 1704153600.0, 1704412800.0, 30), "window_mean", "baseline_mean")


HINT = """case when regexp_matches({0}, 'success|succee|loss|drop|error|fail') then 'network loss' when regexp_matches({0}, 'close|closed|on_off_state|onoff') then 'db close'
    when regexp_matches({0}, 'connect|client|session|login|blocked|rejected|row_lock|hang') then 'db connection limit' when regexp_matches({0}, 'cpu|processor|load') then 'CPU fault' when regexp_matches({0}, 'delay|latency|elapsed|time') then 'network delay' else '' end"""
REASON = """case when regexp_matches({0}, 'cpu|processor') then 'cpu' when regexp_matches({0}, 'mem|memory|rss|heap') then 'mem' when regexp_matches({0}, 'disk|fs-|blkio|io') then 'disk' when regexp_matches({0}, 'loss|drop|dropped|error-total|errors') then 'loss'
    when regexp_matches({0}, 'delay|latency|duration|timeout|slow') then 'delay' when regexp_matches({0}, 'socket|sockets|connection reset') then 'socket' when regexp_matches({0}, 'db|database|sql|connection limit|close') then 'db' when regexp_matches({0}, 'network|rx|tx|packet') then 'network' else 'unknown' end"""


@query("reason_hint", f"select event_id, {HINT.format('m')} as hint from {_NAMED}")
def _(spark, sf_dir):
    return named(spark, sf_dir).select("event_id", ops.reason_hint(F.col("m")).alias("hint"))


@query("fault_family", f"select event_id, {FAMILY.format('m')} as family from {_NAMED}")
def _(spark, sf_dir):
    return named(spark, sf_dir).select("event_id", ops.fault_family(F.col("m")).alias("family"))


@query("infer_reason", f"""with t as (select case_id, component, string_agg(signal || ' high ' || direction, ' ' order by rank) as t from (select case_id, component, signal, direction, row_number() over (partition by case_id, component order by score desc, magnitude desc, signal, direction) as rank from finding) where rank <= 2 group by case_id, component)
    select 'board' as kind, case_id || ' ' || component as id, {REASON.format('t')} as reason from t union all select 'name', event_id::varchar, {REASON.format('m')} from {_NAMED}""")
def _(spark, sf_dir):
    found = ops.evidence_for(c.finding(spark, sf_dir), 2)
    text = found.groupBy("case_id", "component").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "signal", "direction"))), lambda x: F.concat_ws(" ", x["signal"], F.lit("high"), x["direction"])), " ").alias("text"))
    board = text.select(F.lit("board").alias("kind"), F.concat_ws(" ", "case_id", "component").alias("id"), ops.infer_reason(F.col("text")).alias("reason"))
    return board.union(named(spark, sf_dir).select(F.lit("name"), F.col("event_id").cast("string"), ops.infer_reason(F.col("m"))))


_DUP = "(select * from finding union all select case_id, modality, upper(component), signal, direction, magnitude, score - 1, window_start, evidence_ptr from finding)"


@query("dedup_findings", f"select case_id, modality, component, signal, direction, score from (select *, row_number() over (partition by case_id, modality, lower(trim(component)), lower(trim(signal)), direction order by score desc, magnitude desc, component, signal) as r from {_DUP}) where r = 1")
def _(spark, sf_dir):
    f = c.finding(spark, sf_dir)
    twice = f.union(f.withColumns({"component": F.upper("component"), "score": F.col("score") - 1}))
    return ops.dedup_findings(twice).select("case_id", "modality", "component", "signal", "direction", "score")


@query("component_scores", "select case_id, component, component_score from component_total")
def _(spark, sf_dir):
    return ops.component_scores(c.finding(spark, sf_dir))


_TOP = "select case_id, component, component_score, row_number() over (partition by case_id order by component_score desc, component)::int as rank from component_total"


@query("top_components", f"select * from ({_TOP}) where rank <= 10")
def _(spark, sf_dir):
    return ops.top_components(c.finding(spark, sf_dir))


@query("evidence_for", "select case_id, component, signal, direction, score, rank from (select *, row_number() over (partition by case_id, component order by score desc, magnitude desc, signal, direction)::int as rank from finding) where rank <= 3")
def _(spark, sf_dir):
    return ops.evidence_for(c.finding(spark, sf_dir), 3).select("case_id", "component", "signal", "direction", "score", "rank")


@query("component_max_score", "select case_id, component, max(score) as max_score, round(sum(score), 6) as sum_score from finding group by all")
def _(spark, sf_dir):
    return c.finding(spark, sf_dir).groupBy("case_id", "component").agg(F.max("score").alias("max_score"), F.round(F.sum("score"), 6).alias("sum_score"))


@query("component_sum_score", "select case_id, component, score, rank from (select *, row_number() over (partition by case_id order by score desc, component)::int as rank from (select case_id, component, round(sum(score), 6) as score from finding group by all)) where rank <= 5")
def _(spark, sf_dir):
    sums = c.finding(spark, sf_dir).groupBy("case_id", "component").agg(F.round(F.sum("score"), 6).alias("score"))
    return ops.best(sums, ["case_id"], [F.col("score").desc(), "component"], 5, rank="rank")


@query("symptomatic_set", f"select case_id, component from ({_TOP}) where rank <= 5 and component_score > 0")
def _(spark, sf_dir):
    return ops.symptomatic(c.finding(spark, sf_dir), 5)


@query("onset_mad", """with r as (select case_id, component, metric, ts, value, row_number() over (partition by case_id, component, metric order by ts, value) as i, count(*) over (partition by case_id, component, metric) as n from metric_long),
    b as (select case_id, component, metric, median(value) as c from r where i <= greatest(3, n // 5) group by all),
    o as (select r.*, c, abs(value - c) as off from r join b using (case_id, component, metric)),
    d as (select case_id, component, metric, median(off) as mad from o where i <= greatest(3, n // 5) group by all)
    select case_id, component, metric, min(ts) filter (i > greatest(3, n // 5) and n >= 6 and off > 5 * case when mad > 0 then mad else 0.05 * (abs(c) + 1e-6) end) as onset_ts from o join d using (case_id, component, metric) group by all""")
def _(spark, sf_dir):
    return ops.onset_mad(c.metric_long(spark, sf_dir).select("case_id", "component", "metric", "ts", "value"), ["case_id", "component", "metric"])


_ONSETS = """select *, case when max(onset) over (partition by case_id) > min(onset) over (partition by case_id) then round(1 - (onset - min(onset) over (partition by case_id)) / (max(onset) over (partition by case_id) - min(onset) over (partition by case_id)), 6) else 1.0 end as precedence
    from (select case_id, component, min(window_start) as onset from finding where window_start is not null group by all)"""


@query("component_onsets", _ONSETS)
def _(spark, sf_dir):
    return ops.component_onsets(c.finding(spark, sf_dir))


_VOLUME = f"select row_id, 'metrics' as modality, count(*) as n_rows from ({_WINDOWED}) group by row_id"


@query("row_volume", _VOLUME)
def _(spark, sf_dir):
    return ops.row_volume(_windowed(spark, sf_dir), ["row_id"], "metrics")


@query("volume_tertiles", f"with v as ({_VOLUME}), r as (select *, row_number() over (order by n_rows, row_id) as r, count(*) over () as n from v) select row_id, n_rows, modality, case when r <= n // 3 then 'low' when r <= 2 * (n // 3) then 'middle' else 'high' end as volume_bin from r")
def _(spark, sf_dir):
    return ops.volume_tertiles(ops.row_volume(_windowed(spark, sf_dir), ["row_id"], "metrics"))


_FEATURES = """with r as (select sample_index, feature, value, (row_number() over w - 1)::double as i, value - lag(value) over w as d from kpi window w as (partition by sample_index, feature order by t))
    select sample_index, feature, round(avg(value), 6) as mean, min(value) as min, max(value) as max, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.25), 6) as q25, round(quantile_cont(value, 0.75), 6) as q75,
      arg_min(value, i) as first, arg_max(value, i) as last, round(stddev_pop(value), 6) as std, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) as iqr, round(max(value) - min(value), 6) as range,
      round(coalesce(avg(abs(d)), 0), 6) as mean_abs_diff, round(coalesce(stddev_pop(d), 0), 6) as std_diff, round(coalesce(regr_slope(value, i), 0), 6) as slope from r group by sample_index, feature"""
_CALCULATED = ("mean", "median", "q25", "q75", "std", "iqr", "range", "mean_abs_diff", "std_diff", "slope")


@query("kpi_features", _FEATURES)
def _(spark, sf_dir):
    return _rounded(ops.kpi_features(c.kpi(spark, sf_dir)), *_CALCULATED)


@query("feature_views", f"""with f as ({_FEATURES}) select sample_index, {", ".join(f"coalesce(max({s}) filter (feature = 'feature{k}'), 0) as feature{k}__{s}" for k in range(8) for s in ops.STATS)} from f group by sample_index""")
def _(spark, sf_dir):
    features = _rounded(ops.kpi_features(c.kpi(spark, sf_dir)), *_CALCULATED)
    return ops.feature_views(features, [f"feature{k}" for k in range(8)])


@query("metric_scope_findings", f"""with b as ({_BASELINE}), w as ({_WINDOWED}), e as (select row_id, component, metric, source, max(value) as top, min(value) as bottom from w group by all),
    s as (select row_id, component, metric, round(greatest((top - p95) / (abs(p95) + 1), (p05 - bottom) / (abs(p05) + 1)), 6) as score, case when component in ('svc-0', 'svc-1', 'svc-2', 'svc-3') then 'node' when component in ('svc-4', 'svc-5', 'svc-6', 'svc-7') then 'container' else 'service' end as scope from e join b using (component, metric, source) where top > p95 or bottom < p05)
    select row_id, scope, component, metric, score, rank from (select *, row_number() over (partition by row_id, scope order by score desc, component, metric)::int as rank from s) where rank <= 5""")
def _(spark, sf_dir):
    keys = ["component", "metric", "source"]
    found = ops.threshold_anomaly(_windowed(spark, sf_dir), ops.daily_baseline(c.metric_long(spark, sf_dir), keys), ["row_id"], keys)
    number = F.regexp_extract("component", r"(\d+)$", 1).cast("int")
    scoped = found.withColumn("scope", F.when(number < 4, "node").when(number < 8, "container").otherwise("service"))
    return ops.best(scoped, ["row_id", "scope"], [F.col("score").desc(), "component", "metric"], 5, rank="rank").select("row_id", "scope", "component", "metric", "score", "rank")


@query("app_findings", """with l as (select 'svc-' || (l_partkey % 12)::varchar as component, unnest(['quantity', 'discount', 'tax']) as metric, unnest([l_quantity, l_discount, l_tax]) as value, l_linestatus from lineitem),
    b as (select component, metric, quantile_cont(value, 0.05) as p05, quantile_cont(value, 0.95) as p95 from l group by all), w as (select component, metric, max(value) as top, min(value) as bottom from l where l_linestatus = 'O' group by all)
    select component, metric, case when (top - p95) / (abs(p95) + 1) >= (p05 - bottom) / (abs(p05) + 1) then 'high' else 'low' end as direction, round(greatest((top - p95) / (abs(p95) + 1), (p05 - bottom) / (abs(p05) + 1)), 6) as score from w join b using (component, metric) where top > p95 or bottom < p05""")
def _(spark, sf_dir):
    li = c.table(spark, sf_dir, "lineitem")
    wide = li.select(F.concat(F.lit("svc-"), (F.col("l_partkey") % 12).cast("string")).alias("component"), c.epoch_seconds("l_shipdate").alias("ts"), "l_linestatus", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    long = wide.unpivot(["component", "ts", "l_linestatus"], ["quantity", "discount", "tax"], "metric", "value")
    inside = long.where("l_linestatus = 'O'").withColumn("row_id", F.lit(0))
    return ops.threshold_anomaly(inside, ops.daily_baseline(long, ["component", "metric"]), ["row_id"], ["component", "metric"]).select("component", "metric", "direction", "score")
