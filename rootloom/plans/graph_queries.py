"""Queries of the join and graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootloom.operators import graph as ops
from rootloom.operators.findings import best, daily_baseline
from rootloom.operators.order_stats import group_median
from rootloom.operators.scoring import score_join
from rootloom.plans.registry import query
from rootloom.sources import canonical as c


def edges(spark, sf_dir):
    return ops.service_graph(c.span(spark, sf_dir))


def symptomatic(spark, sf_dir):
    return c.metric_long(spark, sf_dir).groupBy("case_id", F.col("component").alias("node")).agg(F.avg("value").alias("v")).where("v > 50").select("case_id", "node")


@query("window_interval_join", "select w.row_id, m.case_id, m.component, m.metric, m.ts, m.value from metric_long m join incident_window w on m.ts * 1000 between w.start_ms and w.end_ms")
def _(spark, sf_dir):
    rows = c.metric_long(spark, sf_dir).withColumn("time_ms", F.col("ts") * 1000)
    return ops.window_interval_join(rows, c.incident_window(spark, sf_dir)).select("row_id", "case_id", "component", "metric", "ts", "value")


@query("stats_join", "select component, metric, count(*) as n, max(value) as most, median(ts) as mid_ts from metric_long group by all")
def _(spark, sf_dir):
    rows, keys = c.metric_long(spark, sf_dir), ["component", "metric"]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max("value").alias("most")).join(group_median(rows, keys, F.col("ts"), "mid_ts"), keys)


@query("span_edges", "select case_id, parent, child, n from call")
def _(spark, sf_dir):
    return ops.span_edges(c.span(spark, sf_dir), ["case_id"])


@query("service_graph", "select case_id, src, dst from graph_edge")
def _(spark, sf_dir):
    return edges(spark, sf_dir)


@query("container_service_edges", "select distinct case_id, component as src, ds_name as dst from span where component is not null and ds_name is not null and component <> ds_name")
def _(spark, sf_dir):
    return ops.container_service_edges(c.span(spark, sf_dir))


@query("undirected_adjacency", "with e as (select case_id, parent as src, child as dst from call union select case_id, component, ds_name from span) select case_id, src, dst from e union select case_id, dst, src from e")
def _(spark, sf_dir):
    calls = ops.span_edges(c.span(spark, sf_dir), ["case_id"]).select("case_id", F.col("parent").alias("src"), F.col("child").alias("dst"))
    return ops.undirected(calls.union(ops.container_service_edges(c.span(spark, sf_dir))))


@query("ancestors", "with recursive a as (select case_id, dst as start, src as node from graph_edge union select a.case_id, a.start, e.src from a join graph_edge e on e.case_id = a.case_id and e.dst = a.node) select case_id, start, node from a where start <> node")
def _(spark, sf_dir):
    e = edges(spark, sf_dir)
    return ops.ancestors(e, ops.graph_nodes(e))


@query("descendants_hops", """with recursive h as (select distinct case_id, src as start, src as node, 0 as hop from graph_edge union select h.case_id, h.start, e.dst, h.hop + 1 from h join graph_edge e on e.case_id = h.case_id and e.src = h.node where h.hop < 12)
    select case_id, start, node, min(hop)::int as hop from h group by case_id, start, node""")
def _(spark, sf_dir):
    e = edges(spark, sf_dir)
    return ops.hops(e, e.select("case_id", F.col("src").alias("node")))


#: Two steps, from each node to the symptoms around it.
CONNECTED = """u as (select case_id, src, dst from graph_edge union select case_id, dst, src from graph_edge), r as (select case_id, src, dst from u union select a.case_id, a.src, b.dst from u a join u b on a.case_id = b.case_id and a.dst = b.src),
    connected as (select n.case_id, n.node, count(s.node) as n from (select distinct case_id, src as node from u) n left join r on r.case_id = n.case_id and r.src = n.node and r.dst <> n.node left join symptoms s on s.case_id = r.case_id and s.node = r.dst group by n.case_id, n.node)"""


@query("k_hop_connectivity", f"with {CONNECTED} select case_id, node, n from connected")
def _(spark, sf_dir):
    return ops.k_hop_connectivity(ops.undirected(edges(spark, sf_dir)), symptomatic(spark, sf_dir))


#: Upwards from each node, as the coverage is defined.
COVERAGE = """recursive a as (select case_id, dst as start, src as node from graph_edge union select a.case_id, a.start, e.src from a join graph_edge e on e.case_id = a.case_id and e.dst = a.node),
    n as (select case_id, src as node from graph_edge union select case_id, dst from graph_edge), k as (select case_id, start, node from a union select case_id, node, node from n),
    coverage as (select n.case_id, n.node, round(coalesce(count(distinct s.node) / (select nullif(count(*), 0) from symptoms x where x.case_id = n.case_id), 0), 6) as coverage from n left join k on k.case_id = n.case_id and k.start = n.node left join symptoms s on s.case_id = k.case_id and s.node = k.node group by n.case_id, n.node)"""


@query("explanatory_coverage", f"with {COVERAGE} select case_id, node, coverage from coverage")
def _(spark, sf_dir):
    return ops.explanatory_coverage(edges(spark, sf_dir), symptomatic(spark, sf_dir))


@query("baseline_lookup", """with b as (select component, metric, avg(value) as mean from metric_long group by all) select case_id, component, signal, score, round(b.mean, 6) as mean from finding f join b using (component) where b.metric = f.signal""")
def _(spark, sf_dir):
    base = daily_baseline(c.metric_long(spark, sf_dir), ["component", "metric"], exact=False).select("component", F.col("metric").alias("signal"), F.round("mean", 6).alias("mean"))
    return c.finding(spark, sf_dir).join(base, ["component", "signal"]).select("case_id", "component", "signal", "score", "mean")


@query("score_join", "select case_id, system, true_root, hit_at_1, hit_at_3, round(mrr, 6) as mrr from scored")
def _(spark, sf_dir):
    return score_join(c.prediction(spark, sf_dir), c.case(spark, sf_dir)).select("case_id", "system", "true_root", "hit_at_1", "hit_at_3", F.round("mrr", 6).alias("mrr"))


@query("paired_systems", "select case_id, max(hit_at_1) filter (system = 'single')::double as baseline, max(hit_at_1) filter (system = 'repaired')::double as treatment from scored group by case_id")
def _(spark, sf_dir):
    return ops.paired_systems(score_join(c.prediction(spark, sf_dir), c.case(spark, sf_dir)), "single", "repaired", "hit_at_1", majority=True)


@query("split_alignment", "select coalesce(d.doc_id, l.doc_id) as doc_id, case when d.doc_id is null then 'right' else 'left' end as side from documents d full join labels l on d.doc_id = l.doc_id where d.doc_id is null or l.doc_id is null")
def _(spark, sf_dir):
    return ops.mismatched_ids(c.table(spark, sf_dir, "documents"), c.table(spark, sf_dir, "labels"), "doc_id")


@query("exclude_cases", "select case_id from cases where fault_type <> 'cpu'")
def _(spark, sf_dir):
    cases = c.case(spark, sf_dir)
    return cases.select("case_id").join(cases.where("fault_type = 'cpu'").select("case_id"), "case_id", "left_anti")


@query("select_pinned", "select p.pos::int as pos, p.case_id, c.case_id is not null as found from (select row_number() over (order by n_nationkey desc) - 1 as pos, 'C' || (n_nationkey * 1000)::varchar as case_id from nation) p left join cases c using (case_id)")
def _(spark, sf_dir):
    n = c.table(spark, sf_dir, "nation")
    pins = n.agg(F.sort_array(F.collect_list(F.struct((-F.col("n_nationkey")).alias("k"), F.concat(F.lit("C"), (F.col("n_nationkey") * 1000).cast("string")).alias("case_id")))).alias("pins"))
    pinned = pins.select(F.posexplode("pins.case_id").alias("pos", "case_id"))
    return pinned.join(c.case(spark, sf_dir).select("case_id", F.lit(True).alias("f")), "case_id", "left").select("pos", "case_id", F.coalesce("f", F.lit(False)).alias("found"))


@query("peer_pairs", """with t as (select * from (select case_id, modality as agent, component, component_score, row_number() over (partition by case_id, modality order by component_score desc, component) as r from (select case_id, modality, component, round(sum(score), 6) as component_score from finding group by all)) where r = 1)
    select a.case_id, a.agent, b.agent as peer, b.component as proposal from t a join t b on a.case_id = b.case_id and a.agent <> b.agent""")
def _(spark, sf_dir):
    sums = c.finding(spark, sf_dir).groupBy("case_id", F.col("modality").alias("agent"), "component").agg(F.round(F.sum("score"), 6).alias("s"))
    top = best(sums, ["case_id", "agent"], [F.col("s").desc(), "component"], 1).select("case_id", "agent", "component")
    peers = top.select("case_id", F.col("agent").alias("peer"), F.col("component").alias("proposal"))
    return top.select("case_id", "agent").join(peers, "case_id").where("agent <> peer")


@query("disagreements", "select a.case_id, a.ranked_roots[1] as left_root, b.ranked_roots[1] as right_root from scored a join scored b using (case_id) where a.system = 'single' and b.system = 'sharded' and a.ranked_roots[1] is distinct from b.ranked_roots[1]")
def _(spark, sf_dir):
    p = c.prediction(spark, sf_dir).select("case_id", "system", F.get("ranked_roots", 0).alias("root"))
    both = p.where("system in ('single', 'sharded')").groupBy("case_id").agg(F.max(F.when(F.col("system") == "single", F.col("root"))).alias("left_root"), F.max(F.when(F.col("system") == "sharded", F.col("root"))).alias("right_root"))
    return both.where("not (left_root <=> right_root)")


@query("overlap_refusal", "select count(*) as overlap from (select case_id from cases where telemetry_bytes > 400000 intersect select case_id from cases where fault_type = 'cpu')")
def _(spark, sf_dir):
    cases = c.case(spark, sf_dir)
    return cases.where("telemetry_bytes > 400000").select("case_id").intersect(cases.where("fault_type = 'cpu'").select("case_id")).agg(F.count("*").alias("overlap"))
