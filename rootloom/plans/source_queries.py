"""Queries of the source and catalogue operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootloom.plans.registry import query
from rootloom.sources import canonical as c
from rootloom.sources import files as ops
from rootloom.sources import prepared, readiness


@query("scan_metrics", "select event_type, count(*) as n, round(sum(value), 4) as total from events group by event_type")
def _(spark, sf_dir):
    return ops.scan_metrics(spark, [f"{sf_dir}/events.parquet"]).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("metric_file_choice", """with f as (select 'case-' || l_orderkey::varchar as case_id, ['readme.md', 'data.csv', 'metrics.csv', 'simple_metrics.csv', 'metrics.json', 'simple_data.csv'][(l_orderkey // 50 % 3 + l_linenumber) % 6 + 1] as file from lineitem),
    k as (select case_id, file, case file when 'simple_metrics.csv' then 1 when 'simple_data.csv' then 2 when 'data.csv' then 3 when 'metrics.json' then 4 when 'metrics.csv' then 5 end as r from f)
    select case_id, arg_min(file, r) as file from k where r is not null group by case_id""")
def _(spark, sf_dir):
    names = F.array(*map(F.lit, ("readme.md", "data.csv", "metrics.csv", "simple_metrics.csv", "metrics.json", "simple_data.csv")))
    k = ((F.floor(F.col("l_orderkey") / 50) % 3 + F.col("l_linenumber")) % 6).cast("int")
    rows = c.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("case-"), F.col("l_orderkey").cast("string")).alias("case_id"), F.get(names, k).alias("file"))
    return ops.metric_file_choice(rows)


@query("case_labels", "select case_id, true_root || '_x' as true_root, fault_type from cases")
def _(spark, sf_dir):
    rows = c.case(spark, sf_dir)
    return ops.case_labels(rows.select("case_id", F.concat_ws("_", "true_root", F.lit("x"), "fault_type").alias("label")))


@query("inject_time", "select event_id, case event_id % 3 when 0 then epoch(ts)::double::bigint when 1 then floor(value)::bigint end as inject_s from (select event_id, date_trunc('second', ts) as ts, value from events)")
def _(spark, sf_dir):
    k, s = F.col("event_id") % 3, F.floor(c.epoch_seconds("ts"))
    text = F.when(k == 0, F.concat(F.lit(" "), s.cast("string"), F.lit(".0\n"))).when(k == 1, F.col("value").cast("string")).otherwise("soon")
    return c.table(spark, sf_dir, "events").select("event_id", ops.inject_time(text).alias("inject_s"))


_NAMES = ("Metrics/{}", "trace/{}", "log_metric/{}", "event/{}.json", "x/{}", "x/data.csv", "span/{}", "x/Span_{}.csv", "Logs/{}", "x/simple_data.csv")
_CATALOG = "select p_partkey as id, case p_partkey % 10 " + " ".join(f"when {k} then " + "'" + n.replace("{}", "' || p_name || '") + "'" for k, n in enumerate(_NAMES)) + " end as name, p_size::bigint as bytes, (p_size * 3)::bigint as rows from part"
_MODALITY = """case when contains(lower(name), 'metric') or lower(name) in ('x/data.csv', 'x/simple_data.csv') then 'metrics' when contains(lower(name), 'trace') or contains(split_part(lower(name), '/', 2), 'span') then 'traces'
    when contains(lower(name), 'log') then 'logs' when ends_with(lower(name), '.json') then 'auxiliary' else 'events' end"""


def _catalog(spark, sf_dir):
    name = F.lit(None).cast("string")
    for k, n in enumerate(_NAMES):
        name = F.when(F.col("p_partkey") % 10 == k, F.concat(F.lit(n.partition("{}")[0]), *([F.col("p_name"), F.lit(n.partition("{}")[2])] if "{}" in n else []))).otherwise(name)
    return c.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_size").cast("long").alias("bytes"), (F.col("p_size") * 3).cast("long").alias("rows"))


@query("infer_modality", f"with k as ({_CATALOG}) select id, {_MODALITY} as modality from k")
def _(spark, sf_dir):
    return _catalog(spark, sf_dir).select("id", ops.infer_modality(F.col("name")).alias("modality"))


@query("catalog_summary", f"with k as (select *, {_MODALITY} as modality from ({_CATALOG})) select coalesce(modality, 'all') as modality, count(*) as files, sum(bytes)::bigint as bytes, sum(rows)::bigint as rows from k group by rollup (modality)")
def _(spark, sf_dir):
    return ops.catalog_summary(_catalog(spark, sf_dir).withColumn("modality", ops.infer_modality(F.col("name"))))


@query("window_extract", "select * from metric_long where ts between 1704153600 and 1704412800")
def _(spark, sf_dir):
    return ops.window_extract(c.metric_long(spark, sf_dir), 1704153600.0, 1704412800.0)


@query("scan_tasks", "select row_id, task_index, 'find ' || task_index as instruction from task")
def _(spark, sf_dir):
    return ops.scan_tasks(c.task(spark, sf_dir).select("row_id", "task_index", F.concat(F.lit("find "), "task_index").alias("instruction"), F.lit("secret").alias("scoring_points")))


@query("scan_kpi", "select sample_index, feature, t, case when t % 2 = 0 then value end as value from kpi")
def _(spark, sf_dir):
    text = F.when(F.col("t") % 2 == 0, F.col("value").cast("string")).otherwise("bad")
    rows = c.kpi(spark, sf_dir).withColumn("raw", text).drop("value").withColumn("featureX_if", F.lit(1))
    return ops.drop_forbidden(rows, ("featureX_if",)).select("sample_index", "feature", "t", F.col("raw").try_cast("double").alias("value"))


@query("scan_kpi_labels", "select count(*) as n, count(*) filter (not (root1 in (0, 1) and root2 in (0, 1) and root3 in (0, 1))) as not_binary, count(*) filter (root1 + root2 + root3 < 1) as without_root, sum(root1)::bigint as root1, sum(root2)::bigint as root2, sum(root3)::bigint as root3 from kpi_label")
def _(spark, sf_dir):
    return ops.scan_kpi_labels(c.kpi_label(spark, sf_dir))


@query("stale_manifest", "select coalesce(d.doc_id, p.page_id) as path, case when d.doc_id is null then 'new' when p.page_id is null then 'gone' else 'changed' end as state from documents d full join pages p on d.doc_id = p.page_id where md5(d.text) is distinct from md5(p.html)")
def _(spark, sf_dir):
    stored = c.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    current = c.table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.sha2("html", 256).alias("sha256"))
    return ops.stale_manifest(stored, current)


@query("scan_results", "select case_id, system, hit_at_1 from scored")
def _(spark, sf_dir):
    from rootloom.operators.scoring import score_join

    rows = score_join(c.prediction(spark, sf_dir), c.case(spark, sf_dir))
    doc = rows.select("case_id", F.to_json(F.struct(F.struct("system").alias("meta"), F.array(F.struct("case_id", "hit_at_1")).alias("rows"))).alias("raw"))
    read = doc.select(F.from_json("raw", "meta struct<system:string>, rows array<struct<case_id:string,system:string,hit_at_1:int>>").alias("r"))
    return read.select("r.meta.system", F.explode("r.rows").alias("row")).select("row.case_id", F.coalesce("row.system", "system").alias("system"), "row.hit_at_1")


@query("scan_ranked_indicators", """with i as (select 'case-' || (l_orderkey % 2000)::varchar as case_id, l_linenumber as pos, 'svc' || (l_partkey % 4)::varchar as service, row_number() over (partition by l_orderkey % 2000 order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as r from lineitem),
    f as (select case_id, service, min(r) as r from i group by all) select case_id, service, row_number() over (partition by case_id order by r)::int as rank from f""")
def _(spark, sf_dir):
    li = c.table(spark, sf_dir, "lineitem")
    name = F.concat(F.lit("svc"), (F.col("l_partkey") % 4).cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "-db").otherwise(""), F.lit("_cpu"))
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", name.alias("name"))
    raw = li.groupBy((F.col("l_orderkey") % 2000).alias("k")).agg(F.sort_array(F.collect_list(order)).alias("items"))
    docs = raw.select(F.concat(F.lit("case-"), F.col("k").cast("string")).alias("case_id"), F.to_json(F.create_map(F.lit("0"), F.col("items.name"))).alias("raw"))
    return ops.ranked_indicators(docs)


@query("pending_work", "select case_id, system, total_tokens as fingerprint from prediction where not (total_tokens % 3 = 0)")
def _(spark, sf_dir):
    work = c.prediction(spark, sf_dir).select("case_id", "system", F.col("total_tokens").alias("fingerprint"))
    done = work.withColumn("fingerprint", F.when(F.col("fingerprint") % 3 == 0, F.col("fingerprint")).otherwise(F.lit(-1)))
    return ops.pending_work(work, done, ["case_id", "system", "fingerprint"])


@query("suite_counts", "select r_name as suite, (r_regionkey * 20)::bigint as expected, count(n_name) as observed, count(n_name) = r_regionkey * 20 as ok from region left join (select n_regionkey, n_name from nation join customer on c_nationkey = n_nationkey) on n_regionkey = r_regionkey group by r_name, r_regionkey")
def _(spark, sf_dir):
    r, n, cu = (c.table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    cases = cu.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("suite"))
    return ops.suite_counts(cases, r.select(F.col("r_name").alias("suite"), (F.col("r_regionkey") * 20).cast("long").alias("expected")))


#: Archives of a nation's suppliers each, one of which is short; pairs of files of orders, some without the second; labels of embeddings.
@query("dataset_readiness", """with found as (
      select 'archive:' || n_nationkey::varchar as item, count(s_suppkey)::bigint as found from nation left join supplier on s_nationkey = n_nationkey and s_suppkey % 9 <> 4 group by n_nationkey
      union all select 'pairs', count(*) filter (o_orderkey % 50 <> 7) from orders
      union all select 'label_sum:root1', sum(root1) from kpi_label union all select 'label_sum:root2', sum(root2) from kpi_label union all select 'inactive_sum:root3', sum(root3) from kpi_label),
    expected as (select 'archive:' || n_nationkey::varchar as item, count(s_suppkey)::bigint as expected from nation left join supplier on s_nationkey = n_nationkey group by n_nationkey
      union all select 'pairs', count(*) from orders union all select 'inactive_sum:root3', 0 union all select 'labels', 1),
    compared as (select item, expected, coalesce(found, 0)::bigint as found, coalesce(expected = found, expected is null) as ok from expected full join found using (item))
    select item, expected, found, ok from compared union all select 'ready', count(expected), count(*) filter (ok and expected is not null), count(expected) = count(*) filter (ok and expected is not null) from compared""")
def _(spark, sf_dir):
    suppliers, nations, orders = (c.table(spark, sf_dir, t) for t in ("supplier", "nation", "orders"))
    held = nations.select("n_nationkey").join(suppliers.where("s_suppkey % 9 <> 4"), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    archive = F.concat(F.lit("baseline/"), F.col("n_nationkey").cast("string"), F.lit(".zip"))
    at = readiness.write_archives(held.select(archive.alias("archive"), F.concat(F.lit("case_"), F.col("s_suppkey").cast("string"), F.lit(".csv")).alias("member"), F.col("s_name").alias("content")), ops.shared_folder(spark, "archives"))
    members = readiness.zip_members(spark, at).groupBy(F.concat(F.lit("archive:"), F.regexp_extract("path", r"([^/]+)\.zip$", 1)).alias("item")).agg(F.count_if(F.col("member").endswith(".csv")).alias("found"))
    order = F.concat(F.lit("/anomaly/"), F.col("o_orderkey").cast("string"))
    paths = orders.select(F.explode(F.array_compact(F.array(F.concat(order, F.lit("/platform.csv")), F.when(F.col("o_orderkey") % 50 != 7, F.concat(order, F.lit("/radio.csv")))))).alias("path"))
    pairs = readiness.file_pairs(paths, "platform.csv", "radio.csv").agg(F.lit("pairs").alias("item"), F.count_if("whole").alias("found"))
    checks = members.unionByName(pairs).unionByName(readiness.label_checks(c.kpi_label(spark, sf_dir), ["root1", "root2"], ["root3"]))
    counted = nations.select("n_nationkey").join(suppliers, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy(F.concat(F.lit("archive:"), F.col("n_nationkey").cast("string")).alias("item")).agg(F.count("s_suppkey").alias("expected"))
    fixed = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("item"), F.lit(n).cast("long").alias("expected")) for k, n in (("inactive_sum:root3", 0), ("labels", 1))])).alias("x")).select("x.*")
    return readiness.dataset_readiness(checks, counted.unionByName(orders.agg(F.lit("pairs").alias("item"), F.count("*").alias("expected"))).unionByName(fixed))


@query("file_manifest", """with h as (select p_size as bytes, sha256(p_name || p_partkey::varchar || ':' || p_size::varchar) as h from part), s as (select count(*) as files, sum(bytes)::bigint as bytes,
    sum(('0x' || substr(h, 1, 16))::ubigint) as a, sum(('0x' || substr(h, 17, 16))::ubigint) as b, sum(('0x' || substr(h, 33, 16))::ubigint) as c, sum(('0x' || substr(h, 49, 16))::ubigint) as d from h)
    select files, bytes, sha256(files::varchar || ':' || a::varchar || ':' || b::varchar || ':' || c::varchar || ':' || d::varchar) as sha256 from s""")
def _(spark, sf_dir):
    return ops.file_manifest(c.table(spark, sf_dir, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").alias("bytes")))


#: Spans moved into the days of the windows; whole days are kept apart.
_MOVED = "moved as (select span_id, parent_id, component, service, ds_name, call_type, (1704067200000 + start_ms::bigint % 2160000000)::double as start_ms, elapsed, success from span)"


@query("prepared_cache", f"""with {_MOVED}, ms as (select row_id, component, metric, value from metric_long m join incident_window w on m.ts * 1000 between w.start_ms and w.end_ms),
    days as (select distinct strftime(make_timestamp(start_ms * 1000), '%Y-%m-%d') as date_key from incident_window), ts as (select w.row_id, s.* from moved s join incident_window w on s.start_ms between w.start_ms and w.end_ms),
    st as (select strftime(make_timestamp((ts * 1e6)::bigint), '%Y-%m-%d') as date_key, component, metric, count(value) as n, avg(value) as mean, coalesce(stddev_samp(value), 0) as std, quantile_cont(value, 0.05) as p05, quantile_cont(value, 0.15) as p15, quantile_cont(value, 0.9) as p90, quantile_cont(value, 0.95) as p95, min(value) as least, max(value) as most from metric_long where value is not null group by all),
    su as (select row_id, component, service, ds_name, call_type, count(*) as n, avg(elapsed) as mean, median(elapsed) as mid, max(elapsed) as most, count(*) filter (success = 'false') as failures from ts group by all),
    vo as (select row_id, (select count(*) from ms where ms.row_id = w.row_id) as m, (select count(*) from ts where ts.row_id = w.row_id) as t from incident_window w), vr as (select *, row_number() over (order by m + t, row_id) - 1 as r, count(*) over () as n from vo)
    select 'metric' as part, row_id::varchar as key, component || '|' || metric as name, count(*) as n, round(sum(value), 4) as value from ms group by all
    union all select 'trace', row_id::varchar, component, count(*), round(sum(elapsed), 4) from ts group by all
    union all select 'metric_stats', date_key, component || '|' || metric, n, round(mean + std + p05 + 2 * p15 + 3 * p90 + 5 * p95 + least + most, 4) from st join days using (date_key)
    union all select 'trace_summary', row_id::varchar, concat_ws('|', component, service, ds_name, call_type), n, round(mean + 2 * mid + 3 * most + 5 * failures, 4) from su
    union all select 'trace_edges', c.row_id::varchar, p.component || '|' || c.component, count(*), 0 from ts c join (select * from (select *, row_number() over (partition by row_id, span_id order by start_ms, component) as r from ts) where r = 1) p on c.row_id = p.row_id and c.parent_id = p.span_id where p.component <> c.component group by all
    union all select 'volume', row_id::varchar, case when r < n // 3 then 'low' when r < 2 * (n // 3) then 'middle' else 'high' end, m + t, t from vr""")
def _(spark, sf_dir):
    metrics = c.metric_long(spark, sf_dir).withColumn("time_ms", F.col("ts") * 1000)
    spans = c.span(spark, sf_dir).withColumn("start_ms", (F.lit(1704067200000) + F.col("start_ms").cast("long") % 2160000000).cast("double"))
    windows = c.incident_window(spark, sf_dir)
    mark = prepared.source_mark(ops.list_files(spark, sf_dir, "{events,lineitem}.parquet"), windows)
    folder = ops.shared_folder(spark, "prepared")
    prepared.prepare(metrics, spans, windows, folder, mark)
    part = prepared.open_prepared(spark, folder, mark)
    name = lambda *cols: F.concat_ws("|", *cols)
    digests = [
        ("metric", part["metric"].groupBy("row_id", "component", "metric").agg(F.count("*").alias("n"), F.sum("value").alias("v")), "row_id", name("component", "metric"), F.col("v")),
        ("trace", part["trace"].groupBy("row_id", "component").agg(F.count("*").alias("n"), F.sum("elapsed").alias("v")), "row_id", F.col("component"), F.col("v")),
        ("metric_stats", part["metric_stats"], "date_key", name("component", "metric"), F.expr("mean + coalesce(std, 0) + p05 + 2 * p15 + 3 * p90 + 5 * p95 + least + most")),
        ("trace_summary", part["trace_summary"], "row_id", name("component", "service", "ds_name", "call_type"), F.expr("mean_elapsed + 2 * median_elapsed + 3 * max_elapsed + 5 * failures")),
        ("trace_edges", part["trace_edges"], "row_id", name("parent", "child"), F.lit(0.0)),
        ("volume", part["volume"].withColumn("n", F.col("total_rows")), "row_id", F.col("volume_bin"), F.col("trace_rows").cast("double")),
    ]
    out = None
    for kind, rows, key, of, value in digests:
        mine = rows.select(F.lit(kind).alias("part"), F.col(key).cast("string").alias("key"), of.alias("name"), "n", F.round(value.cast("double"), 4).alias("value"))
        out = mine if out is None else out.union(mine)
    return out
