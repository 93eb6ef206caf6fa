"""Queries of evidence checks, revisions, answers, knowledge graphs and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootloom.operators import checks as ops
from rootloom.operators import fusion, graph
from rootloom.operators import knowledge as kg
from rootloom.operators.findings import kpi_features, feature_views, metric_shift_top, reason_hint, top_components
from rootloom.operators.time_ops import phase_split
from rootloom.plans.finding_queries import HINT
from rootloom.plans.fusion_queries import _EVIDENCE, _FUSED, _HINT, _PARSED, _SHIFTS, _parsed, fused
from rootloom.plans.registry import query
from rootloom.session import written
from rootloom.sources import canonical as c
from rootloom.sources import files


def _hinted(spark, sf_dir):
    """Findings with hints of their signals; of some components the signal tells more."""
    signal = F.concat("signal", F.when(F.col("component") == "svc-1", "_cpu").when(F.col("component") == "svc-2", "_latency").when(F.col("component") == "svc-4", "_closed").otherwise(""))
    return c.finding(spark, sf_dir).withColumn("hint", reason_hint(signal))


_TOLD = "signal || case component when 'svc-1' then '_cpu' when 'svc-2' then '_latency' when 'svc-4' then '_closed' else '' end"
_REASONED = "case f_rank % 4 when 1 then 'network loss' when 2 then 'CPU fault' when 3 then 'unknown' else 'network delay' end"


def _candidates(spark, sf_dir):
    """Fused candidates with a reason of the catalogue by their rank."""
    k = F.col("rank") % 4
    reason = F.when(k == 1, "network loss").when(k == 2, "CPU fault").when(k == 3, "unknown").otherwise("network delay")
    return written(fused(spark, sf_dir).withColumn("reason", reason), "candidates")


_CHECKED = f"""{_EVIDENCE}, {_FUSED}, cands as (select case_id, component, {_REASONED.replace('f_rank', 'rank')} as reason, score, rank from fused),
    hinted as (select *, {HINT.format(f"({_TOLD})")} as hint, row_number() over (partition by case_id, component order by score desc, magnitude desc, signal, direction) as e from finding),
    checks as (select k.case_id, k.component, k.reason, round(coalesce(sum(case when reason = 'unknown' or hint = '' or hint = reason then h.score else 0.25 * h.score end), 0), 9) as support_score, round(coalesce(sum(case when reason = 'unknown' or hint = '' or hint = reason then 0 else 0.5 * h.score end), 0), 9) as refute_score, count(h.score) as n
      from cands k left join hinted h on h.case_id = k.case_id and h.component = k.component and h.e <= 12 group by all),
    checked as (select case_id, component, reason, support_score, refute_score, case when n = 0 then 'REFUTED' when support_score > refute_score then 'SUPPORTED' when refute_score > support_score then 'REFUTED' else 'INCONCLUSIVE' end as status from checks)"""


@query("targeted_check", f"with {_CHECKED} select * from checked")
def _(spark, sf_dir):
    return ops.targeted_check(_candidates(spark, sf_dir), _hinted(spark, sf_dir))


@query("select_by_checks", f"""with {_CHECKED}, t as (select k.case_id, max(k.component) filter (rank = 1) as a, max(k.component) filter (rank = 2) as b, max(support_score) filter (rank = 1) as sa, max(support_score) filter (rank = 2) as sb, max(status) filter (rank = 1) as ta, max(status) filter (rank = 2) as tb from cands k join checked using (case_id, component, reason) where rank <= 2 group by all)
    select case_id, case when sb > sa or (tb = 'SUPPORTED' and ta = 'REFUTED' and sb >= sa) then b else a end as winner, coalesce(sb > sa or (tb = 'SUPPORTED' and ta = 'REFUTED' and sb >= sa), false) as runner_taken from t""")
def _(spark, sf_dir):
    candidates = _candidates(spark, sf_dir)
    return ops.select_by_checks(candidates, ops.targeted_check(candidates, _hinted(spark, sf_dir)))


@query("conflict_refine", f"""with {_CHECKED}, two as (select case_id, component, reason, support_score, refute_score, greatest(0, support_score - refute_score) as net from cands join checked using (case_id, component, reason) where rank <= 2)
    select case_id, component, reason, round(case when sum(net) over (partition by case_id) > 0 then 0.9 * net / sum(net) over (partition by case_id) else 0 end, 9) as probability, support_score, refute_score from two""")
def _(spark, sf_dir):
    candidates = _candidates(spark, sf_dir)
    workers = candidates.select("case_id", "component", "reason", F.col("confidence").alias("probability"), F.concat(F.lit("w"), F.col("rank").cast("string")).alias("worker_id"))
    return ops.conflict_refine(candidates, workers, ops.targeted_check(candidates, _hinted(spark, sf_dir)))


@query("refinement_workers", f"""with {_PARSED}, two as (select case_id, component from (select *, row_number() over (partition by case_id order by component) as r from (select distinct case_id, component from parsed)) where r = 2 and right(case_id, 1) <> '3' union all select distinct case_id, 'nobody' from parsed where right(case_id, 1) = '3'),
    n as (select distinct p.case_id, p.worker_id from parsed p join two t on t.case_id = p.case_id and lower(t.component) = lower(p.component)), w as (select case_id, worker_id, row_number() over (partition by case_id order by worker_id) as r from (select distinct case_id, worker_id from parsed))
    select case_id, worker_id from n union all select case_id, worker_id from w where r <= 2 and case_id not in (select case_id from n)""")
def _(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    second = ops.best(parsed.select("case_id", "component").distinct(), ["case_id"], ["component"], 2, rank="r").where("r = 2 and right(case_id, 1) <> '3'").select("case_id", F.upper("component").alias("component"))
    nobody = parsed.where("right(case_id, 1) = '3'").select("case_id", F.lit("nobody").alias("component")).distinct()
    return ops.refinement_workers(parsed, second.union(nobody))


_NET = "case when substr(component, 5)::int % 2 = 0 then 5.0 else -5.0 end"


@query("distribution_revision", f"""with {_PARSED}, tops as (select case_id, worker_id as peer, arg_min(component, (-probability, component)) as component from parsed group by all),
    asked as (select distinct w.case_id, w.worker_id, t.component from (select distinct case_id, worker_id from parsed) w join tops t on t.case_id = w.case_id and t.peer <> w.worker_id),
    r as (select p.*, greatest(0, probability + 0.01 * coalesce(case when a.component is not null then {_NET.replace('component', 'p.component')} end, 0)) as q from parsed p left join asked a using (case_id, worker_id, component))
    select case_id, worker_id, component, reason, round(0.9 * q / sum(q) over (partition by case_id, worker_id), 9) as probability from r""")
def _(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    net = F.when(F.substring("component", 5, 3).cast("int") % 2 == 0, 5.0).otherwise(-5.0)
    return ops.distribution_revision(parsed, parsed.select("case_id", "worker_id", "component", net.alias("net")))


@query("review_validate", """select case_id, worker_id as agent, p::int as pos, case when p = 0 then 'all' else 'x' end as "to", case when k % 3 = 0 then 'abstain' else 'support' end as verdict, 'svc-' || (k % 6)::varchar as component,
    case when p = 1 then 0.0 else least(k / 10.0::double, 1.5) end as support, case when p = 1 then 0.0 else 0.0::double end as refute, 1 - p::int as n_pointers from opinion, range(2) q(p)""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    n = c.table(spark, sf_dir, "customer")
    item = lambda to, ptr: F.concat(F.lit(f'{{{to}"verdict":"'), F.when(k % 3 == 0, "shout").otherwise("support"), F.lit('","component":"svc-'), (k % 6).cast("string"), F.lit('","support":'), (k / 10.0).cast("string"), F.lit(f',"refute":-1.0,"evidence_ptrs":["{ptr}"]}}'))
    raw = F.concat(F.lit("["), item("", "ptr-1"), F.lit(","), item('"to":"x",', "zzz"), F.lit("]"))
    messages = n.select(F.concat(F.lit("case-"), F.floor(k / 5).cast("long").cast("string")).alias("case_id"), F.concat(F.lit("worker-"), (k % 5).cast("string")).alias("agent"), raw.alias("raw"))
    return ops.review_validate(messages, F.array(F.lit("ptr-1")), F.lit(1.5))


@query("metric_specialist", f"with {_SHIFTS} select case_id, component, score, rank, round(score - coalesce(lead(score) over (partition by case_id order by rank), 0), 6) as margin from rk where rank <= 8")
def _(spark, sf_dir):
    shifts = metric_shift_top(phase_split(c.metric_long(spark, sf_dir), ["case_id", "source"]))
    return ops.metric_specialist(shifts.select("case_id", "component", "metric", "score"))


_BOARD = "board as (select * from (select case_id, component, row_number() over (partition by case_id order by component_score desc, component)::int as rank from component_total) where rank <= 10)"
_ROOTS = f"""{_EVIDENCE}, {_FUSED}, {_BOARD}, u as (select case_id, component, 0 as s, -score as a, -confidence as b from fused union all select case_id, component, 1, rank, 0 from board),
    lst as (select case_id, component, min((s, a, b, component)) as o from u group by all), ord as (select case_id, component, row_number() over (partition by case_id order by o) as r from lst)"""


@query("ranked_roots", f"with {_ROOTS} select case_id, array_to_string(list(component order by r), ',') as roots from ord where r <= 10 group by case_id")
def _(spark, sf_dir):
    return ops.ranked_roots(fused(spark, sf_dir), top_components(c.finding(spark, sf_dir))).select("case_id", F.array_join("ranked_roots", ",").alias("roots"))


@query("primary_first", "select case_id, system, array_to_string(list_concat([true_root], list_filter(ranked_roots, lambda x: x <> true_root)), ',') as roots from scored")
def _(spark, sf_dir):
    rows = c.prediction(spark, sf_dir).join(c.case(spark, sf_dir).select("case_id", F.col("true_root").alias("root")), "case_id")
    return ops.primary_first(rows).select("case_id", "system", F.array_join("ranked_roots", ",").alias("roots"))


@query("occurrence_choice", """with a as (select case_id, 'svc-' || (right(case_id, 1)::int)::varchar as component, case when right(case_id, 1) = '4' then 77.0 end::double as occ, 0.0::double as s, 900.0::double as e, right(case_id, 1)::int % 2 = 0 as asked from (select distinct case_id from metric_long)),
    t as (select case_id, component, arg_max(window_start, (score, magnitude, -window_start)) as own from finding group by all)
    select a.case_id, case when not asked then 300.0 else coalesce(occ, own, 450.0) end as occurrence from a left join t using (case_id, component)""")
def _(spark, sf_dir):
    last = F.substring("case_id", -1, 1)
    answers = c.metric_long(spark, sf_dir).select("case_id").distinct().select("case_id", F.concat(F.lit("svc-"), last).alias("component"), F.when(last == "4", 77.0).alias("occurrence_time"), F.lit(0.0).alias("start_ms"), F.lit(900.0).alias("end_ms"), F.when(last.cast("int") % 2 == 0, F.array(F.lit("component"))).otherwise(F.array(F.lit("time"))).alias("requested"))
    return ops.occurrence_choice(answers, c.finding(spark, sf_dir))


@query("decollapse_component", "select case_id, component from (select *, row_number() over (partition by case_id order by score desc, magnitude desc, component) as r from finding where component in (select service from span)) where r = 1")
def _(spark, sf_dir):
    f = c.finding(spark, sf_dir)
    winners = f.select("case_id").distinct().withColumn("component", F.lit("svc-0"))
    return ops.decollapse_component(winners, f, c.span(spark, sf_dir).select(F.col("service").alias("component")))


@query("additive_candidate", f"with {_PARSED}, s as (select case_id, component, reason, round(sum(probability), 9) as mass from parsed group by all) select case_id, component, reason, mass from (select *, row_number() over (partition by case_id order by mass desc, component, reason) as r from s) where r = 1")
def _(spark, sf_dir):
    return ops.additive_candidate(_parsed(spark, sf_dir))


@query("heuristic_floor", f"""with k as (select *, {HINT.format(f"({_TOLD})")} as hint from finding where component in (select service from span)), t as (select * from (select case_id, component, component_score, row_number() over (partition by case_id order by component_score desc, component)::int as rank from component_total where component in (select service from span)) where rank <= 8),
    h as (select case_id, component, arg_min(hint, (-s, hint)) as reason from (select case_id, component, hint, sum(greatest(score, 0)) as s from k group by all) group by all) select case_id, component, reason, component_score, rank from t join h using (case_id, component)""")
def _(spark, sf_dir):
    f = _hinted(spark, sf_dir)
    return ops.heuristic_floor(f, c.span(spark, sf_dir).select(F.col("service").alias("component")))


@query("mine_by_modality")
def _(spark, sf_dir):
    spans = c.span(spark, sf_dir).select("case_id", "component", F.col("call_type").alias("metric"), F.lit("spans").alias("source"), (F.col("start_ms") / 1e3).alias("ts"), F.col("elapsed").alias("value"))
    keys = ["case_id", "component", "metric", "source"]
    return ops.mine_by_modality(phase_split(c.metric_long(spark, sf_dir), ["case_id", "source"]), phase_split(spans, ["case_id", "source"]), phase_split(c.log_line(spark, sf_dir), ["case_id"]), keys)


@query("serial_read")
def _(spark, sf_dir):
    spans = c.span(spark, sf_dir).select("case_id", "component", F.col("call_type").alias("metric"), F.lit("spans").alias("source"), (F.col("start_ms") / 1e3).alias("ts"), F.col("elapsed").alias("value"))
    keys = ["case_id", "component", "metric", "source"]
    mined = ops.mine_by_modality(phase_split(c.metric_long(spark, sf_dir), ["case_id", "source"]), phase_split(spans, ["case_id", "source"]), phase_split(c.log_line(spark, sf_dir), ["case_id"]), keys, 30)
    return fusion.heuristic_candidates(mined)


_KG_NODES = """kn as (select 'kg-' || (s_suppkey % 5)::varchar as case_id, s_suppkey as pos, 's' || s_suppkey::varchar as rid, case s_suppkey % 4 when 0 then 'Root_Cause' when 1 then 'Alarm' when 2 then 'Alarm_Cause' else 'Device' end as kind, s_name as name, s_nationkey as n from supplier),
    kc as (select *, case when kind in ('Root_Cause', 'Alarm_Cause') then 'candidate' when kind = 'Alarm' then 'alarm' else 'resource' end as class from kn),
    ke as (select a.case_id, a.rid as src, b.rid as dst, case when a.pos % 2 = 0 then 'CausedBy' else 'linked' end as relation from kn a join kn b on a.case_id = b.case_id and b.pos = a.pos + 5)"""


def _kg_nodes(spark, sf_dir):
    s, k = c.table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 4
    kind = F.when(k == 0, "Root_Cause").when(k == 1, "Alarm").when(k == 2, "Alarm_Cause").otherwise("Device")
    props = F.create_map(F.lit("title"), F.when(k == 2, " ").otherwise(F.col("s_name")), F.lit("causeName"), F.col("s_name"))
    return s.select(F.concat(F.lit("kg-"), (F.col("s_suppkey") % 5).cast("string")).alias("case_id"), F.col("s_suppkey").alias("pos"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("rid"), kind.alias("kind"), F.array(F.when(k == 3, "x").otherwise("RootCause")).alias("labels"), props.alias("props"))


def _kg_edges(spark, sf_dir):
    n = _kg_nodes(spark, sf_dir)
    a = n.select("case_id", F.col("rid").alias("src"), "pos")
    b = n.select("case_id", F.col("rid").alias("dst"), (F.col("pos") - 5).alias("pos"))
    return a.join(b, ["case_id", "pos"]).select("case_id", "src", "dst", F.when(F.col("pos") % 2 == 0, "CausedBy").otherwise("linked").alias("relation"))


@query("kg_views", f"""with {_KG_NODES}, al as (select * from kc where class in ('alarm', 'candidate'))
    select e.case_id, src, dst, relation from ke e where (exists (select 1 from al where al.case_id = e.case_id and rid = src) and exists (select 1 from al where al.case_id = e.case_id and rid = dst))
      or (contains(lower(relation), 'caus') and (exists (select 1 from al where al.case_id = e.case_id and rid = src) or exists (select 1 from al where al.case_id = e.case_id and rid = dst)))""")
def _(spark, sf_dir):
    nodes = _kg_nodes(spark, sf_dir).withColumn("class", kg.node_class(F.col("kind")))
    return kg.graph_view(nodes, _kg_edges(spark, sf_dir), ("alarm", "candidate"), causal=True)


@query("kg_candidates", f"with {_KG_NODES}, f as (select case_id, name, min(pos) as pos from kc where class = 'candidate' group by all) select case_id, name, row_number() over (partition by case_id order by pos)::int as rank from f")
def _(spark, sf_dir):
    return kg.kg_candidates(_kg_nodes(spark, sf_dir))


@query("graph_root_labels", f"with {_KG_NODES} select distinct case_id, name from kn where kind <> 'Device'")
def _(spark, sf_dir):
    return kg.root_labels(_kg_nodes(spark, sf_dir))


@query("sanitize_graph", f"""with {_KG_NODES} select case_id, rid, 'causeName,detail,title' as keys, case pos % 3 when 0 then '{{"a":[3,{{"keep":"' || name || '"}},"Ground Truth"],"n":{{}}}}' when 1 then '{{"n":{{"mark":"gold"}}}}' else '[1, 2]' end as detail from kn""")
def _(spark, sf_dir):
    nodes, k = _kg_nodes(spark, sf_dir), F.col("pos") % 3
    leaky = F.concat(F.lit('{"n":{"mark":"goldAnswer"},"groundTruth":{"x":1},"a":[3,{"keep":"'), F.col("props")["causeName"], F.lit('","correct_answer":[]},"Ground Truth"]}'))
    detail = F.when(k == 0, leaky).when(k == 1, '{"n":{"mark":"gold"}}').otherwise("[1, 2]")
    props = F.map_concat("props", F.create_map(F.lit("mark"), F.lit("Ground Truth"), F.lit("detail"), detail))
    return kg.sanitize_props(nodes.withColumn("props", props)).select("case_id", "rid", F.array_join(F.sort_array(F.map_keys("props")), ",").alias("keys"), F.col("props")["detail"].alias("detail"))


@query("leakage_audit", """select c_custkey as case_id, u.path, u.kind, u.value from customer, lateral (select unnest(
    case c_custkey % 3 when 0 then [{'path': 'edges[0].is_root-cause', 'kind': 'answer_key', 'value': 'true'}] when 1 then [{'path': 'nodes[1].props.note', 'kind': 'answer_marker', 'value': 'Ground Truth'}] else [] end) as u)""")
def _(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, '{"nodes":[{"a":1}],"edges":[{"in":"x","is_root-cause":true}]}').when(k % 3 == 1, '{"nodes":[{"a":1},{"props":{"note":"Ground Truth","b":[1,2]}}]}').otherwise('{"nodes":[{"title":"answers"}]}')
    return kg.leakage_audit(c.table(spark, sf_dir, "customer").select(k.alias("case_id"), raw.alias("raw")))


#: Lists of one to six roots that can be told apart; the answers come in the other order, with some fields wrong.
_FIELD_N = "(total_tokens % 6 + 1)"


@query("field_score", f"""with p as (select case_id, system, {_FIELD_N} as n, total_tokens % 7 = 0 as short from scored), r as (select case_id, system, n, short, unnest(range(1, n + 1)) as i from p),
    m as (select *, case when short then [] else list_filter([case when i % 3 <> 0 then 'c' || i::varchar end, case when i % 2 <> 0 then 'r' || i::varchar end, case when i <= 3 then '2024-01-01 0' || i::varchar || ':00:00' end], lambda x: x is not null) end as hit, ['c' || i::varchar, 'r' || i::varchar, '2024-01-01 0' || i::varchar || ':00:00'] as every from r)
    select case_id, system, round(sum(len(hit)) / (3.0 * max(n)), 2) as score, array_to_string(flatten(list(hit order by i)), ',') as passed,
      array_to_string(list_sort(list_filter(flatten(list(every)), lambda x: not list_contains(flatten(list(hit)), x))), ',') as failed from m group by case_id, system""")
def _(spark, sf_dir):
    from rootloom.operators.scoring import field_score, score_join

    n = (F.col("total_tokens") % 6 + 1).cast("int")
    at = lambda i: F.lit(1704067200.0) + i * 3600.0
    text = lambda p, i: F.concat(F.lit(p), i.cast("string"))
    root = lambda i, wrong: F.struct(F.when(wrong & (i % 3 == 0), "none").otherwise(text("c", i)).alias("component"), F.when(wrong & (i % 2 == 0), "none").otherwise(text("r", i)).alias("reason"), (at(i) + F.when(wrong, i * 20.0).otherwise(0.0)).alias("time_s"))
    rows = score_join(c.prediction(spark, sf_dir), c.case(spark, sf_dir)).withColumn("_n", n)
    every = F.sequence(F.lit(1), F.col("_n"))
    predicted = F.reverse(F.transform(every, lambda i: root(i, F.lit(True))))
    rows = rows.select("case_id", "system", F.transform(every, lambda i: root(i, F.lit(False))).alias("expected"), F.when(F.col("total_tokens") % 7 == 0, F.slice(predicted, 1, F.col("_n") - 1)).otherwise(predicted).alias("predicted"))
    found = field_score(rows, ["case_id", "system"])
    return found.select("case_id", "system", "score", F.array_join("passed", ",").alias("passed"), F.array_join("failed", ",").alias("failed"))


@query("artifact_diagnostics", """with p as (select *, total_tokens % 3 as k from prediction) select kind, value, count(*) as n from (select 'falsifier_selected' as kind, case k when 0 then 'unknown' else 'top' end as value from p where k <> 2 union all select 'fusion_top_component', ranked_roots[1] from p
    union all select 'worker_top_component', 'w1:' || ranked_roots[2] from p where k <> 1 union all select 'candidate_catalog_source', 'a=x,b=' || system from p where k = 0) group by all""")
def _(spark, sf_dir):
    from rootloom.operators.scoring import artifact_diagnostics

    k = F.col("total_tokens") % 3
    root = lambda i: F.struct(F.get("ranked_roots", i).alias("component"))
    nothing = F.array().cast("array<struct<component:string>>")
    worker = lambda name, tops: F.struct(F.lit(name).alias("worker_id"), tops.alias("candidates"))
    raw = F.to_json(F.struct(
        F.when(k != 2, F.struct(F.when(k == 1, "top").alias("selected"))).alias("falsifier"), F.array(root(0), root(1)).alias("fusion_candidates"),
        F.array(worker("w1", F.when(k != 1, F.array(root(1), root(0))).otherwise(nothing)), worker("w2", nothing)).alias("worker_distributions"),
        F.when(k == 0, F.create_map(F.lit("b"), F.col("system"), F.lit("a"), F.lit("x"))).alias("candidate_catalog_source"),
    ))
    return artifact_diagnostics(c.prediction(spark, sf_dir).select(raw.alias("artifacts")))


@query("scan_graph_json", "select 'c' || s_suppkey::varchar as case_id, sha256('{\"nodes\":[{\"id\":' || s_suppkey::varchar || '}]}') as sha256, s_name as label from supplier where s_suppkey % 5 <> 0")
def _(spark, sf_dir):
    # Pairs of files are written first, one of them alone for every fifth case.
    s, k = c.table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    pairs = s.select(F.concat(F.lit("c"), k.cast("string")).alias("case"), F.concat(F.lit('{"nodes":[{"id":'), k.cast("string"), F.lit("}]}")).alias("input"), F.when(k % 5 != 0, F.to_json(F.struct("s_name"))).alias("label"))
    return kg.scan_graph_json(spark, kg.write_graph_json(pairs, files.shared_folder(spark, "graphs"))).select("case_id", "sha256", F.get_json_object("label", "$.s_name").alias("label"))


@query("write_results", "select case_id, system, hit_at_1 from scored")
def _(spark, sf_dir):
    from rootloom.operators.scoring import score_join

    rows = score_join(c.prediction(spark, sf_dir), c.case(spark, sf_dir)).select("case_id", "system", F.col("hit_at_1").cast("long").alias("hit_at_1"))
    folder = files.shared_folder(spark, "results")
    for kind in ("parquet", "json"):
        files.write_results(rows, f"{folder}/{kind}", kind)
    schema = "case_id string, system string, hit_at_1 long"
    return spark.read.schema(schema).parquet(f"{folder}/parquet").intersect(spark.read.schema(schema).json(f"{folder}/json"))


_DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("file_catalog", " union all ".join(f"select '{t}.parquet' as name, 'events' as modality, count(*) as n_rows, " + ("'ts' as time_column, min(epoch_us(ts)) / 1e6 as start_time, max(epoch_us(ts)) / 1e6 as end_time" if t == "events" else "null::varchar, null::double, null::double") + f" from {t}" for t in sorted(_DRIVER_TABLES, key=lambda t: t != "events")))
def _(spark, sf_dir):
    return files.table_catalog(files.file_catalog(spark, sf_dir, "*.parquet"), sf_dir)


@query("scan_cases", "select distinct 'RE' || (l_orderkey % 3 + 1)::varchar as suite, 'svc-' || (l_partkey % 12)::varchar as root, case when l_linenumber % 2 = 0 then 'cpu' else 'loss' end as fault, l_linenumber as run from lineitem where l_suppkey % 3 <> 0")
def _(spark, sf_dir):
    li = c.table(spark, sf_dir, "lineitem")
    text = lambda x: x.cast("string")
    base = F.concat(F.lit("/data/RE"), text(F.col("l_orderkey") % 3 + 1), F.lit("-OB/svc-"), text(F.col("l_partkey") % 12), F.when(F.col("l_linenumber") % 2 == 0, "_cpu/").otherwise("_loss/"), text(F.col("l_linenumber")))
    whole = F.col("l_suppkey") % 3 != 0
    paths = li.select(F.explode(F.array_compact(F.array(F.when(whole, F.concat(base, F.lit("/inject_time.txt"))), F.when(whole, F.concat(base, F.lit("/metrics.csv"))), F.concat(base, F.lit("x/metrics.csv"))))).alias("path"))
    return files.scan_cases(paths)


@query("prepare_windows", "select row_id, strftime(make_timestamp((start_ms * 1000)::bigint), '%Y-%m-%d') as date_key, component, metric, count(*) as n, round(sum(value), 4) as total from metric_long m join incident_window w on m.ts * 1000 between w.start_ms and w.end_ms group by all")
def _(spark, sf_dir):
    windows = c.incident_window(spark, sf_dir).withColumn("date_key", F.date_format(F.timestamp_millis("start_ms"), "yyyy-MM-dd"))
    rows = graph.window_interval_join(c.metric_long(spark, sf_dir).withColumn("time_ms", F.col("ts") * 1000), windows)
    folder = files.shared_folder(spark, "windows")
    files.write_partitioned(rows.select("date_key", "row_id", "component", "metric", "ts", "value"), folder, ["date_key"])
    stored = spark.read.schema("row_id long, component string, metric string, ts double, value double, date_key string").parquet(folder)
    return stored.groupBy("row_id", "date_key", "component", "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


#: The statistics of level and of dynamics; the features on the paths that lead to a root stand in for a causal graph.
_LEVEL, _DYNAMICS = ("mean", "min", "max", "median", "q25", "q75", "first", "last"), ("std", "iqr", "range", "mean_abs_diff", "std_diff", "slope")
_CAUSAL = ("feature0", "feature1", "feature2", "feature3")


def model_rows(spark, sf_dir):
    """All statistics of all features, with labels, split and fold, written down; and the three views."""
    from rootloom.operators.evaluation import label_strata
    from rootloom.operators.findings import STATS

    names = [f"feature{i}" for i in range(8)]
    wide = feature_views(kpi_features(c.kpi(spark, sf_dir)), names)
    rows = written(wide.join(label_strata(c.kpi_label(spark, sf_dir), 0.7, 5), "sample_index"), "model-rows")
    views = {"level": [f"{n}__{s}" for n in names for s in _LEVEL], "dynamics": [f"{n}__{s}" for n in names for s in _DYNAMICS], "causal": [f"{n}__{s}" for n in _CAUSAL for s in STATS]}
    return rows.where("split = 'train'"), rows.where("split = 'held_out'"), views


@query("ensemble_classifier")
def _(spark, sf_dir):
    from rootloom.operators.models import ensemble_classifier

    train, rest, views = model_rows(spark, sf_dir)
    return ensemble_classifier(train, rest, [*views["level"], *views["dynamics"]])


@query("stacked_adjudicator")
def _(spark, sf_dir):
    from rootloom.operators.models import stacked_adjudicator

    return stacked_adjudicator(*model_rows(spark, sf_dir))
