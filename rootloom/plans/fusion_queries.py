"""Queries of the fusion operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootloom.operators import fusion as ops
from rootloom.operators import graph
from rootloom.operators.findings import component_onsets, component_scores, metric_shift_top, reason_hint, top_components
from rootloom.operators.time_ops import phase_split
from rootloom.plans.finding_queries import HINT, REASON
from rootloom.plans.graph_queries import CONNECTED, COVERAGE, edges, symptomatic
from rootloom.plans.registry import query
from rootloom.session import written
from rootloom.sources import canonical as c

_HINT = HINT.format("signal")
_WEIGHT = "case modality when 'metrics' then 1.0 when 'logs' then 1.15 when 'traces' then 1.15 when 'events' then 1.05 when 'auxiliary' then 0.8 else 1.0 end"


def _sharded(spark, sf_dir):
    """The findings, a shard for each modality, made once and written down."""
    return written(c.finding(spark, sf_dir).withColumn("shard_id", F.col("modality")), "findings")


_FILES = """select 'case-' || (p_partkey % 40)::varchar as case_id, case p_size % 5 when 0 then 'metrics' when 1 then 'traces' when 2 then 'logs' when 3 then 'auxiliary' else 'events' end as modality,
    case when p_size % 10 = 5 and p_partkey % 3 = 0 then 'x/simple_metrics.csv' else p_name end as name, p_size::bigint as bytes from part"""


def _files(spark, sf_dir):
    k = F.col("p_size") % 5
    modality = F.when(k == 0, "metrics").when(k == 1, "traces").when(k == 2, "logs").when(k == 3, "auxiliary").otherwise("events")
    name = F.when((F.col("p_size") % 10 == 5) & (F.col("p_partkey") % 3 == 0), "x/simple_metrics.csv").otherwise(F.col("p_name"))
    return c.table(spark, sf_dir, "part").select(F.concat(F.lit("case-"), (F.col("p_partkey") % 40).cast("string")).alias("case_id"), modality.alias("modality"), name.alias("name"), F.col("p_size").cast("long").alias("bytes"))


@query("default_shards", f"""with f as ({_FILES}), m as (select *, modality = 'metrics' and name = 'x/simple_metrics.csv' as s, max(modality = 'metrics' and name = 'x/simple_metrics.csv') over (partition by case_id, modality) as any_s from f where modality in ('metrics', 'logs', 'traces')),
    o as (select case_id, modality || '_0' as shard_id, modality, count(*) as n_files, sum(bytes)::bigint as bytes from m where s or not any_s group by case_id, modality)
    select * from (select *, row_number() over (partition by case_id order by case modality when 'metrics' then 1 when 'logs' then 2 else 3 end)::int as shard_no from o) where shard_no <= 2""")
def _(spark, sf_dir):
    return ops.default_shards(_files(spark, sf_dir), 2)


_SHARDS = """shards as (select k.case_id, k.component, m.modality, m.modality || '_' || g::varchar as shard_id from (select case_id, component, (row_number() over (partition by case_id order by component) - 1) // 6 as g from (select distinct case_id, component from finding)) k join (select distinct case_id, modality from finding) m using (case_id))"""


@query("component_group_shards", f"with {_SHARDS} select * from shards")
def _(spark, sf_dir):
    f = c.finding(spark, sf_dir)
    return ops.component_group_shards(f, f)


@query("shared_scan_partition", f"with {_SHARDS} select case_id, shard_id, component, signal, score, rank from (select s.case_id, s.shard_id, s.component, f.signal, f.score, row_number() over (partition by s.case_id, s.shard_id order by score desc, magnitude desc, component, signal)::int as rank from finding f join shards s using (case_id, component, modality)) where rank <= 4")
def _(spark, sf_dir):
    f = c.finding(spark, sf_dir)
    return ops.shared_scan_partition(f, ops.component_group_shards(f, f), 4).select("case_id", "shard_id", "component", "signal", "score", "rank")


@query("component_universe", "with s as (select case_id, component from metric_long union select case_id, component from span), p as (select distinct case_id, true_root as component from cases) select * from s union all select * from p where case_id not in (select case_id from s)")
def _(spark, sf_dir):
    prior = c.case(spark, sf_dir).select("case_id", F.col("true_root").alias("component"))
    return ops.component_universe([c.metric_long(spark, sf_dir), c.span(spark, sf_dir)], prior)


@query("budgeted_probe", f"with {_SHARDS} select case_id, shard_id, modality, call from (select *, row_number() over (partition by case_id order by list_position(['metrics', 'traces', 'logs', 'auxiliary'], modality), shard_id)::int as call from (select distinct case_id, shard_id, modality from shards)) where call <= 4")
def _(spark, sf_dir):
    f = c.finding(spark, sf_dir)
    return ops.budgeted_probe(ops.component_group_shards(f, f), 5)


@query("shard_listing", f"""with {_SHARDS}, f as ({_FILES}), z as (select case_id, modality, count(*) as file_count, sum(bytes)::bigint as bytes from f group by all), u as (select case_id, count(distinct component) as calls from finding group by all),
    l as (select case_id, shard_id, modality, list_sort(list(distinct component)) as components from shards group by all)
    select case_id, shard_id, modality, coalesce(file_count, 0)::bigint as file_count, coalesce(bytes, 0)::bigint as bytes, array_to_string(components, ',') as components, greatest(12 - coalesce(calls, 0), 0)::bigint as calls_left from l left join z using (case_id, modality) left join u using (case_id)""")
def _(spark, sf_dir):
    f = c.finding(spark, sf_dir)
    used = f.groupBy("case_id").agg(F.count_distinct("component").alias("calls"))
    return ops.shard_listing(ops.component_group_shards(f, f), _files(spark, sf_dir), 12, used).withColumn("components", F.array_join("components", ","))


_EVIDENCE = f"""sc as (select case_id, modality as shard_id, component, modality, round(sum(greatest(score, 0)), 6) as support_score from (select *, row_number() over (partition by case_id, component, modality order by score desc, signal, direction) as r from finding) where r <= 3 group by all),
    tp as (select * from (select *, row_number() over (partition by case_id, shard_id order by support_score desc, component)::int as local_rank from sc) where local_rank <= 6),
    ev as (select * from (select f.*, row_number() over (partition by f.case_id, f.modality, f.component order by score desc, magnitude desc, signal, direction) as e from finding f join tp on tp.case_id = f.case_id and tp.shard_id = f.modality and tp.component = f.component) where e <= 6),
    tx as (select case_id, modality as shard_id, component, string_agg(signal || ' ' || direction, ' ' order by e) as t, list(evidence_ptr order by e) as evidence_ptrs from ev group by all),
    evidence as (select case_id, shard_id, component, support_score, 0.0::double as refute_score, local_rank, modality, {REASON.format('t')} as reason, evidence_ptrs from tp join tx using (case_id, shard_id, component))"""


@query("candidate_evidence", f"with {_EVIDENCE} select * replace (list_distinct_in_order(evidence_ptrs) as evidence_ptrs) from evidence".replace("list_distinct_in_order(evidence_ptrs)", "list_filter(evidence_ptrs, lambda x, i: list_position(evidence_ptrs, x) = i)"))
def _(spark, sf_dir):
    return ops.candidate_evidence(_sharded(spark, sf_dir)).drop("evidence")


@query("heuristic_candidates", f"""with r as (select * from (select *, row_number() over (partition by case_id order by component_score desc, component)::int as rank from component_total) where rank <= 5), t as (select *, sum(component_score) over (partition by case_id) as total from r),
    e as (select *, row_number() over (partition by case_id, component order by score desc, magnitude desc, signal, direction) as e from finding), x as (select case_id, component, {REASON.format("string_agg(signal || ' ' || direction, ' ' order by e)")} as reason, max(window_start) filter (e = 1) as occurrence from e where e <= 8 group by case_id, component)
    select case_id, component, component_score, round(least(0.95, greatest(0.05, component_score / total)), 6) as confidence, rank, reason, occurrence from t join x using (case_id, component)""")
def _(spark, sf_dir):
    return ops.heuristic_candidates(c.finding(spark, sf_dir))


_FUSED = f"""w as (select *, (support_score - refute_score) * {_WEIGHT} / sqrt(local_rank) as w from evidence), s as (select case_id, component, sum(w) as score from w group by all),
    rs as (select case_id, component, arg_min(reason, (-sw, reason)) as reason from (select case_id, component, reason, sum(w) as sw from w group by all) group by all),
    f as (select s.case_id, s.component, reason, round(score, 6) as score, round(case when tot > 0 then least(0.95, greatest(score, 0) / tot) else 0 end, 6) as confidence from (select *, sum(greatest(score, 0)) over (partition by case_id) as tot from s) s join rs using (case_id, component)),
    fused as (select * from (select *, row_number() over (partition by case_id order by score desc, lower(component))::int as rank from f) where rank <= 5)"""


def fused(spark, sf_dir):
    """The fused candidates, made once and written down."""
    return written(ops.additive_fusion(ops.candidate_evidence(_sharded(spark, sf_dir))), "fused")


@query("additive_fusion", f"""with {_EVIDENCE}, {_FUSED}, pt as (select case_id, component, shard_id, w, unnest(evidence_ptrs) as p, unnest(range(len(evidence_ptrs))) as i from w), ps as (select case_id, component, array_to_string(list(p order by w desc, shard_id, i)[1:8], ',') as pointers from pt group by all),
    oc as (select case_id, component, arg_min(window_start, (-score, -magnitude, signal, direction)) as occurrence from finding group by all)
    select case_id, component, reason, score, confidence, rank, pointers, occurrence from fused join ps using (case_id, component) join oc using (case_id, component)""")
def _(spark, sf_dir):
    return ops.additive_fusion(ops.candidate_evidence(_sharded(spark, sf_dir))).withColumn("evidence_ptrs", F.array_join("evidence_ptrs", ",")).withColumnRenamed("evidence_ptrs", "pointers")


@query("unknown_candidate", f"with {_EVIDENCE}, {_FUSED} select case_id, component, reason, score, confidence, rank from fused union all select 'kg-' || n_nationkey::varchar, 'UNKNOWN', 'unknown', 0, 0, 1 from nation")
def _(spark, sf_dir):
    cases = c.table(spark, sf_dir, "nation").select(F.concat(F.lit("kg-"), F.col("n_nationkey").cast("string")).alias("case_id"))
    found = fused(spark, sf_dir)
    return ops.with_unknown(found, cases.union(found.select("case_id"))).select("case_id", "component", "reason", "score", "confidence", "rank")


@query("vote_fusion", f"""with {_EVIDENCE}, cd as (select case_id, shard_id as worker_id, component, least(1.0, support_score / 10) - case when local_rank > 5 then 1 else 0 end as confidence, len(evidence_ptrs) > 0 and local_rank % 2 = 1 as has from evidence),
    v as (select case_id, component, round(sum(round(greatest(0, confidence), 9)::decimal(20, 9) + case when has then 0.05 else 0 end::decimal(20, 9)), 6)::double as votes, arg_min(worker_id, (-confidence, worker_id)) as backer from cd group by all)
    select case_id, component, votes, backer from (select *, row_number() over (partition by case_id order by votes desc, component) as r from v) where r = 1""")
def _(spark, sf_dir):
    e = ops.candidate_evidence(_sharded(spark, sf_dir))
    confidence = F.least(F.lit(1.0), F.col("support_score") / 10) - F.when(F.col("local_rank") > 5, 1).otherwise(0)
    return ops.vote_fusion(e.select("case_id", F.col("shard_id").alias("worker_id"), "component", confidence.alias("confidence"), ((F.size("evidence_ptrs") > 0) & (F.col("local_rank") % 2 == 1)).alias("has_evidence")))


_PARSED = """parsed as (select case_id, worker_id, component, reason, round(p / (p1 + p2 + 0.2), 9) as probability, round(0.2 / (p1 + p2 + 0.2), 9) as other_mass, ['ptr-' || k::varchar] as evidence_ptrs from (
    select case_id, worker_id, k, (k % 4 + 3) / 10.0::double as p1, (k % 3 + 1) / 10.0::double as p2, unnest(['svc-' || (k % 6)::varchar, 'svc-' || ((k + 1) % 6)::varchar]) as component, unnest(['cpu', 'delay']) as reason, unnest([(k % 4 + 3) / 10.0::double, (k % 3 + 1) / 10.0::double]) as p from opinion))"""


def _parsed(spark, sf_dir):
    return ops.opinion_parse(c.opinion(spark, sf_dir), c.metric_long(spark, sf_dir), ["cpu", "delay", "loss"])


@query("opinion_parse", f"with {_PARSED} select case_id, worker_id, component, reason, probability, other_mass, evidence_ptrs from parsed")
def _(spark, sf_dir):
    return _parsed(spark, sf_dir)


@query("fallback_distribution", f"with s as (select case_id, component, {_HINT} as reason, sum(score) as s from finding group by all), t as (select * from (select *, row_number() over (partition by case_id order by s desc, component, reason) as r from s) where r <= 8), e as (select *, exp(s / max(s) over (partition by case_id) / 0.3) as e from t) select case_id, component, reason, round(0.9 * e / sum(e) over (partition by case_id), 9) as probability from e")
def _(spark, sf_dir):
    return ops.fallback_distribution(c.finding(spark, sf_dir), reason_hint(F.col("signal")))


@query("opinion_errors", """with k as (select case_id, worker_id, k, k % 7 as how from opinion)
    select case_id, worker_id, case how when 1 then 'unreadable' when 2 then 'unknown component' when 3 then 'unknown reason' when 4 then 'probability out of range' when 5 then 'other mass out of range' when 6 then 'unknown component,unsupported pointer' else 'unsupported pointer' end as errors from k""")
def _(spark, sf_dir):
    how = F.col("key") % 7
    rows = c.opinion(spark, sf_dir).withColumn("key", F.regexp_extract("raw", r"ptr-(\d+)", 1).cast("int"))
    raw = F.when(how == 1, "no json").when(how == 2, F.replace("raw", F.lit("svc-"), F.lit("host-"))).when(how == 3, F.replace("raw", F.lit('"cpu"'), F.lit('"magic"'))).when(how == 4, F.regexp_replace("raw", r'"probability":[0-9.]+', '"probability":1.5')).when(how == 5, F.replace("raw", F.lit('"other_mass":0.2'), F.lit('"other_mass":-2'))).when(how == 6, F.replace("raw", F.lit("svc-"), F.lit("host-"))).otherwise(F.col("raw"))
    raw = F.when(how.isin(2, 3, 4, 5), F.replace(raw, F.lit(',"bad"'), F.lit(""))).otherwise(raw)
    found = ops.opinion_errors(rows.withColumn("raw", raw), c.metric_long(spark, sf_dir), ["cpu", "delay", "loss"])
    return found.select("case_id", "worker_id", F.array_join("errors", ",").alias("errors"))


_PAIRS = "pairs as (select k.case_id, 'svc-' || i::varchar as component, reason from (select distinct case_id from opinion) k, range(6) r(i), (values ('cpu'), ('delay'), ('loss')) q(reason))"


def _pairs(spark, sf_dir):
    cases = c.opinion(spark, sf_dir).select("case_id").distinct()
    return cases.select("case_id", F.explode(F.array(*[F.lit(f"svc-{i}") for i in range(6)])).alias("component")).withColumn("reason", F.explode(F.array(*map(F.lit, ("cpu", "delay", "loss")))))


@query("pair_space", f"with {_PARSED}, {_PAIRS} select case_id, component, reason, count(*) as n_workers, count(probability) as n_explicit from (select p.*, w.worker_id, x.probability from pairs p join (select distinct case_id, worker_id from opinion) w using (case_id) left join parsed x using (case_id, worker_id, component, reason)) group by all")
def _(spark, sf_dir):
    workers = c.opinion(spark, sf_dir).select("case_id", "worker_id").distinct()
    space = _pairs(spark, sf_dir).join(workers, "case_id").join(_parsed(spark, sf_dir).select("case_id", "worker_id", "component", "reason", "probability"), ["case_id", "worker_id", "component", "reason"], "left")
    return space.groupBy("case_id", "component", "reason").agg(F.count("*").alias("n_workers"), F.count("probability").alias("n_explicit"))


_POOL = """sp as (select p.*, w.worker_id, x.probability as prob, substr(p.component, 5)::int < 5 as inside, 0.2 as om, count(*) over (partition by p.case_id, w.worker_id) as n from pairs p join (select distinct case_id, worker_id from opinion) w using (case_id) left join parsed x using (case_id, worker_id, component, reason)),
    ms as (select *, coalesce(sum(case when inside then prob end) over g, 0) as mass, count(case when inside then prob end) over g as said, count(*) filter (inside) over g as size from sp window g as (partition by case_id, worker_id)),
    lg as (select case_id, component, reason, sum(ln(case when not inside then 1.0 / n else greatest(1e-6, coalesce(prob * case when mass > 1 + 1e-6 then 1 / mass else 1 end, greatest(1e-6, least(om, greatest(0, 1 - least(mass, 1))) / greatest(1, size - said)))) end)) - ln(first(n)) as logp, count(case when inside then prob end) as supporters from ms group by all),
    ex as (select *, exp(logp - max(logp) over (partition by case_id)) as e from lg), po as (select case_id, component, reason, round(e / sum(e) over (partition by case_id), 9) as posterior, supporters from ex)"""


@query("log_opinion_pool", f"with {_PARSED}, {_PAIRS}, {_POOL} select * from (select *, row_number() over (partition by case_id order by posterior desc, supporters desc, component, reason)::int as rank from po) where rank <= 8")
def _(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    scope = F.array(*[F.lit(f"svc-{i}") for i in range(5)])
    workers = c.opinion(spark, sf_dir).select("case_id", "worker_id", F.lit(0.2).alias("other_mass"), scope.alias("scope"))
    return ops.log_opinion_pool(parsed, workers, _pairs(spark, sf_dir))


_VECTORS = f"vec as (select p.case_id, w.worker_id, p.component, coalesce(sum(x.probability), 0) as p from (select distinct case_id, component from pairs) p join (select distinct case_id, worker_id from opinion) w using (case_id) left join parsed x using (case_id, worker_id, component) group by all)"


def _vectors(spark, sf_dir):
    sums = _parsed(spark, sf_dir).groupBy("case_id", "worker_id", "component").agg(F.sum("probability").alias("p"))
    workers = c.opinion(spark, sf_dir).select("case_id", "worker_id").distinct()
    space = _pairs(spark, sf_dir).select("case_id", "component").distinct().join(workers, "case_id")
    return space.join(sums, ["case_id", "worker_id", "component"], "left").fillna(0.0, ["p"])


@query("worker_pairs", f"with {_PARSED}, {_PAIRS}, {_VECTORS} select a.case_id, a.worker_id as wa, b.worker_id as wb, round(coalesce(corr(a.p, b.p), 0), 6) as r from vec a join vec b on a.case_id = b.case_id and a.component = b.component and a.worker_id < b.worker_id group by all")
def _(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    a, b = (v.select("case_id", "component", F.col("worker_id").alias(w), F.col("p").alias(p)) for w, p in (("wa", "pa"), ("wb", "pb")))
    return a.join(b, ["case_id", "component"]).where("wa < wb").groupBy("case_id", "wa", "wb").agg(F.round(F.coalesce(F.corr("pa", "pb"), F.lit(0.0)), 6).alias("r"))


@query("effective_weight", f"with {_PARSED}, {_PAIRS}, {_VECTORS}, r as (select a.case_id, greatest(0, coalesce(corr(a.p, b.p), 0)) as r from vec a join vec b on a.case_id = b.case_id and a.component = b.component and a.worker_id < b.worker_id group by a.case_id, a.worker_id, b.worker_id) select case_id, 5::bigint as workers, round((1 + 4 * (1 - avg(r))) / 5, 9) as weight from r group by case_id")
def _(spark, sf_dir):
    return ops.effective_weight(_vectors(spark, sf_dir))


@query("peer_review", f"""with {_EVIDENCE}, own as (select case_id, shard_id as agent, component, support_score - case when substr(component, 5)::int % 3 = 0 then 2 * support_score else 0 end as net, local_rank from evidence),
    props as (select case_id, agent, component from own where local_rank = 1), ag as (select case_id, agent, sum(greatest(net, 0)) as pos from own group by all),
    bud as (select *, pos / greatest(count(*) over (partition by case_id) - 1, 1) as budget from ag)
    select b.case_id, b.agent, p.agent as peer, p.component as proposal, case when coalesce(o.net, 0) > 0 then 'support' when coalesce(o.net, 0) < 0 then 'challenge' else 'abstain' end as verdict, round(least(abs(coalesce(o.net, 0)), budget), 6) as strength
    from bud b join props p on b.case_id = p.case_id and b.agent <> p.agent left join own o on o.case_id = b.case_id and o.agent = b.agent and o.component = p.component""")
def _(spark, sf_dir):
    e = ops.candidate_evidence(_sharded(spark, sf_dir))
    doubt = F.substring("component", 5, 3).cast("int") % 3 == 0
    own = e.select("case_id", F.col("shard_id").alias("agent"), "component", (F.col("support_score") - F.when(doubt, 2 * F.col("support_score")).otherwise(0.0)).alias("net"), "local_rank")
    return ops.peer_review(own.where("local_rank = 1"), own, own.select("case_id", "agent").distinct())


_RERANKED = "select case_id, component, reason, round(s2, 9) as score, round(least(0.95, greatest(0.05, case when tot > 0 then greatest(s2, 0) / tot else 0 end)), 6) as confidence, row_number() over (partition by case_id order by round(s2, 9) desc, component)::int as rank from (select *, sum(greatest(s2, 0)) over (partition by case_id) as tot from (select f.*, f.score * (1 + 0.5 * coalesce(k.{factor}, 0)) as s2 from fused f left join {table} k on {on}))"


@query("topology_rerank", f"with {COVERAGE}, {_EVIDENCE}, {_FUSED} " + _RERANKED.format(factor="coverage", table="coverage", on="k.case_id = f.case_id and k.node = f.component"))
def _(spark, sf_dir):
    coverage = graph.explanatory_coverage(edges(spark, sf_dir), symptomatic(spark, sf_dir)).withColumnRenamed("node", "component")
    return ops.rerank(fused(spark, sf_dir), coverage, "coverage", 0.5, ["case_id", "component"]).select("case_id", "component", "reason", "score", "confidence", "rank")


_ON = "on_ as (select case_id, component, min(window_start) as onset from finding group by all), prec as (select case_id, component, onset, case when max(onset) over c > min(onset) over c then round(1 - (onset - min(onset) over c) / (max(onset) over c - min(onset) over c), 6) else 1.0 end as precedence from on_ window c as (partition by case_id))"


@query("temporal_rerank", f"with {_EVIDENCE}, {_FUSED}, {_ON} " + _RERANKED.format(factor="precedence", table="prec", on="k.component = f.component and k.case_id = f.case_id"))
def _(spark, sf_dir):
    f = _sharded(spark, sf_dir)
    return ops.rerank(ops.additive_fusion(ops.candidate_evidence(f)), component_onsets(f), "precedence", 0.5, ["case_id", "component"]).select("case_id", "component", "reason", "score", "confidence", "rank")


_LOUD = "l as (select *, row_number() over (partition by case_id order by max_score desc, component)::int as loudness from (select case_id, component, max(score) as max_score from finding group by all))"


@query("causal_pick", f"""with {CONNECTED}, {_LOUD},
    p as (select l.case_id, l.component, coalesce(k.n, 0) as neighbours, loudness, row_number() over (partition by l.case_id order by coalesce(k.n, 0) desc, loudness) as r from l left join connected k on k.case_id = l.case_id and k.node = l.component where loudness <= 15)
    select case_id, component, neighbours, loudness from p where r = 1""")
def _(spark, sf_dir):
    loud = c.finding(spark, sf_dir).groupBy("case_id", "component").agg(F.max("score").alias("max_score"))
    return ops.causal_pick(loud, graph.k_hop_connectivity(graph.undirected(edges(spark, sf_dir)), symptomatic(spark, sf_dir)))


@query("onset_pick", f"""with {_LOUD}, cd as (select case_id, component, loudness as rank from l where loudness <= 8), sg as (select case_id, component, arg_min(signal, (-score, -magnitude, signal, direction)) as signal from finding group by all),
    sd as (select m.case_id, m.component, metric, stddev_samp(value) as std, any_value(signal) as signal from metric_long m join cd using (case_id, component) left join sg using (case_id, component) where m.component <> 'svc-3' or metric <> signal group by all),
    dm as (select case_id, component, metric from (select *, row_number() over (partition by case_id, component order by case when metric = signal then 0 else 1 end, std desc nulls last, metric) as r from sd) where r = 1),
    r as (select case_id, component, ts, value, row_number() over (partition by case_id, component order by ts, value) as i, count(*) over (partition by case_id, component) as n from metric_long join dm using (case_id, component, metric)),
    b as (select case_id, component, median(value) as c from r where i <= greatest(3, n // 5) group by all), o as (select r.*, c, abs(value - c) as off from r join b using (case_id, component)),
    d as (select case_id, component, median(off) as mad from o where i <= greatest(3, n // 5) group by all),
    t as (select case_id, component, min(ts) filter (i > greatest(3, n // 5) and n >= 6 and off > 5 * case when mad > 0 then mad else 0.05 * (abs(c) + 1e-6) end) as onset_ts from o join d using (case_id, component) group by all),
    u as (select case_id, src, dst from graph_edge union select case_id, dst, src from graph_edge), nb as (select u.case_id, u.src as component, count(*) as n from u join t on t.case_id = u.case_id and t.component = u.dst where t.onset_ts is not null group by all),
    f as (select cd.*, t.onset_ts, case when t.onset_ts is not null then coalesce(nb.n, 0) else 0 end as neighbours from cd left join t using (case_id, component) left join nb using (case_id, component))
    select case_id, component, onset_ts, neighbours from (select *, row_number() over (partition by case_id order by onset_ts nulls last, neighbours desc, rank, component) as r from f) where r = 1""")
def _(spark, sf_dir):
    f = _sharded(spark, sf_dir)
    loud = f.groupBy("case_id", "component").agg(F.max("score").alias("s"))
    candidates = ops.best(loud, ["case_id"], [F.col("s").desc(), "component"], 8, rank="rank").select("case_id", "component", "rank")
    # One component lacks the series that its best finding names.
    named = ops.best(f, ["case_id", "component"], [F.col("score").desc(), F.col("magnitude").desc(), "signal", "direction"], 1).where("component = 'svc-3'").select("case_id", "component", F.col("signal").alias("metric"))
    series = c.metric_long(spark, sf_dir).join(named, ["case_id", "component", "metric"], "left_anti")
    return ops.onset_pick(candidates, f, series, graph.undirected(edges(spark, sf_dir)))


_NODES = f"{COVERAGE}, {_ON}, pk as (select case_id, component, max(score) as peak from finding group by all), nd as (select pk.case_id, pk.component, peak, onset, coalesce(v.coverage, 0) as coverage from pk join prec using (case_id, component) left join coverage v on v.case_id = pk.case_id and v.node = pk.component)"


def _rule_sql(rule, order):
    return f"with {_NODES} select case_id, '{rule}' as rule, component, row_number() over (partition by case_id order by {order}, component)::int as rank from nd"


def _rule(name, rule):
    def run(spark, sf_dir):
        f = c.finding(spark, sf_dir)
        peak = f.groupBy("case_id", "component").agg(F.max("score").alias("peak"))
        coverage = graph.explanatory_coverage(edges(spark, sf_dir), symptomatic(spark, sf_dir)).withColumnRenamed("node", "component")
        nodes = peak.join(component_onsets(f).select("case_id", "component", "onset"), ["case_id", "component"]).join(coverage, ["case_id", "component"], "left").fillna(0.0, ["coverage"])
        return ops.ranking_rules(nodes).where(F.col("rule") == rule)

    return run


for _name, _r, _o in (("rank_loudest", "loudest", "peak desc"), ("rank_topology", "topology", "coverage desc, peak desc"), ("rank_temporal", "temporal", "onset, coverage desc, peak desc"), ("rank_alarm_correlation", "alarm_correlation", "coverage desc, onset, peak desc")):
    query(_name, _rule_sql(_r, _o))(_rule(_name, _r))


@query("falsify_board", f"""with {_EVIDENCE}, {_FUSED}, t as (select f.case_id, max(f.component) filter (rank = 1) as a, max(f.component) filter (rank = 2) as b, max(component_score) filter (rank = 1) as sa, max(component_score) filter (rank = 2) as sb from fused f left join component_total using (case_id, component) where rank <= 2 group by all)
    select case_id, case when coalesce(sb > coalesce(sa, 0), false) then b else a end as winner, coalesce(sb > coalesce(sa, 0), false) as promoted from t""")
def _(spark, sf_dir):
    f = _sharded(spark, sf_dir)
    return ops.falsify(ops.additive_fusion(ops.candidate_evidence(f)), component_scores(f))


@query("majority_roots", f"""with {_PARSED}, w as (select case_id, count(distinct worker_id) + 2 as k from opinion group by case_id), n as (select case_id, component, count(distinct worker_id) as n from parsed group by all)
    select case_id, component, n from (select n.*, k, max(n) over (partition by case_id) as m from n join w using (case_id)) where n >= k // 2 + 1 or (m < k // 2 + 1 and n = m)""")
def _(spark, sf_dir):
    # Two workers of each case name nothing; they count, too.
    workers = c.opinion(spark, sf_dir).select("case_id", "worker_id").distinct()
    silent = workers.select("case_id").distinct().withColumn("worker_id", F.explode(F.array(F.lit("silent-1"), F.lit("silent-2"))))
    return ops.majority_roots(_parsed(spark, sf_dir), workers.union(silent))


_SHIFTS = """sh as (select case_id, component, metric, round(abs(post_mean - pre_mean) / (abs(pre_mean) + 1), 6) as score from moments where pre_n > 0 and post_n > 0), o1 as (select case_id, component, max(score) as score from sh group by all),
    rk as (select *, row_number() over (partition by case_id order by score desc, component)::int as rank from o1), prior as (select case_id, max(component) filter (rank = 1) as component, max(score) filter (rank = 1) as a, coalesce(max(score) filter (rank = 2), 0) as b from rk group by case_id)"""


@query("metric_prior", f"with {_SHIFTS} select case_id, component, round(case when a + b > 0 then a / (a + b) else 0 end, 6) as margin, a / (a + b) >= 0.625 as strong from prior")
def _(spark, sf_dir):
    return ops.metric_prior(metric_shift_top(phase_split(c.metric_long(spark, sf_dir), ["case_id", "source"])))


@query("apply_prior", """with p as (select p.*, true_root, c.fault_type as own, telemetry_bytes > 250000 as strong, telemetry_bytes < 50000 as none, 'svc-' || ((substr(true_root, 5)::int + 3) % 6)::varchar as other from prediction p join cases c using (case_id)),
    q as (select *, case when none then []::varchar[] else [other, true_root, 'svc-9', 'svc-8', 'svc-7'] end as pr, case when none then []::varchar[] else ['', own, 'mem', 'disk', 'cpu'] end as pf from p),
    l as (select *, case when none then ranked_roots when strong then list_concat(list_concat(pr[1:1], ranked_roots), pr) else list_concat(list_concat(list_concat(ranked_roots[1:1], pr[1:4]), ranked_roots), pr) end as r, case when strong and not none then pr[1] else ranked_roots[1] end as root from q),
    f as (select *, nullif(pf[list_position(pr, root)], '') as told from l)
    select case_id, system, array_to_string(list_filter(r, lambda x, i: list_position(r, x) = i), ',') as roots, case when none then 'odd' else coalesce(told, '') end as fault_type, case when strong and not none then greatest(confidence, 0.75) else confidence end as confidence from f""")
def _(spark, sf_dir):
    cases = c.case(spark, sf_dir)
    other = F.concat(F.lit("svc-"), ((F.substring("true_root", 5, 3).cast("int") + 3) % 6).cast("string"))
    some = lambda *x: F.when(F.col("telemetry_bytes") >= 50000, F.array(*x)).otherwise(F.array().cast("array<string>"))
    prior = cases.select("case_id", (F.col("telemetry_bytes") > 250000).alias("strong"), F.lit(0.75).alias("margin"), some(other, F.col("true_root"), *map(F.lit, ("svc-9", "svc-8", "svc-7"))).alias("prior_roots"), some(F.lit(""), F.col("fault_type"), *map(F.lit, ("mem", "disk", "cpu"))).alias("prior_faults"))
    rows = ops.apply_prior(c.prediction(spark, sf_dir).withColumn("fault_type", F.lit("odd")), prior)
    return rows.select("case_id", "system", F.array_join("ranked_roots", ",").alias("roots"), "fault_type", "confidence")


@query("eligible_candidates", f"""with {_SHIFTS}, u as (select case_id, component, 0 as s, rank from (select *, row_number() over (partition by case_id order by component_score desc, component) as rank from component_total) where rank <= 3 union all select case_id, upper(component), 1, rank from rk where rank <= 4),
    f as (select case_id, lower(component) as k, arg_min(component, (s, rank)) as component, min((s, rank)) as o from u group by all) select case_id, component, row_number() over (partition by case_id order by o, component)::int as rank from f""")
def _(spark, sf_dir):
    board = top_components(c.finding(spark, sf_dir), 3).select("case_id", "component", "rank")
    names = metric_shift_top(phase_split(c.metric_long(spark, sf_dir), ["case_id", "source"]), 4).select("case_id", F.upper("component").alias("component"), "rank")
    return ops.eligible_candidates([board, names])


@query("panel_vote", """with o as (select case_id, worker_id, (k % 10) / 10.0::double as confidence, unnest(['svc-' || (k % 6)::varchar, 'svc-' || ((k * 2 + 1) % 6)::varchar, 'svc-' || ((k + 3) % 6)::varchar, 'nobody']) as component, unnest([0, 1, 2, 3]) as pos from opinion),
    i as (select *, row_number() over (partition by case_id, worker_id order by pos) as place, count(*) over (partition by case_id, worker_id) as n from o where component <> 'nobody'),
    s as (select case_id, component, round(sum(case when place = 1 then 1 + confidence else 0 end), 6) as votes, sum(n - place)::bigint as points from i group by all)
    select *, row_number() over (partition by case_id order by votes desc, points desc, component)::int as rank from s""")
def _(spark, sf_dir):
    n = c.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    svc = lambda e: F.concat(F.lit("svc-"), (e % 6).cast("string"))
    opinions = n.select(F.concat(F.lit("case-"), F.floor(k / 5).cast("long").cast("string")).alias("case_id"), F.concat(F.lit("worker-"), (k % 5).cast("string")).alias("worker_id"), ((k % 10) / 10.0).alias("confidence"), F.array(svc(k), svc(k * 2 + 1), svc(k + 3), F.lit("nobody")).alias("ranked"))
    eligible = _pairs(spark, sf_dir).select("case_id", "component").distinct()
    return ops.panel_vote(opinions, eligible)


@query("prior_only_winner", "select p.case_id, p.system from prediction p left join (select distinct 'C' || l_orderkey::varchar as case_id, 'svc-' || (l_partkey % 6)::varchar as component from lineitem) e on e.case_id = p.case_id and e.component = p.ranked_roots[1] where e.case_id is null")
def _(spark, sf_dir):
    li = c.table(spark, sf_dir, "lineitem")
    seen = li.select(F.concat(F.lit("C"), F.col("l_orderkey").cast("string")).alias("case_id"), F.concat(F.lit("svc-"), (F.col("l_partkey") % 6).cast("string")).alias("component")).distinct()
    return c.prediction(spark, sf_dir).select("case_id", "system", F.get("ranked_roots", 0).alias("component")).join(seen, ["case_id", "component"], "left_anti").select("case_id", "system")


@query("requested_output", """select row_id, '{"1":{' || array_to_string(list_filter([case when list_contains(requested, 'time') then '"root cause occurrence datetime":"t' || row_id || '"' end, case when list_contains(requested, 'component') then '"root cause component":"svc-' || (row_id % 6) || '"' end, case when list_contains(requested, 'reason') then '"root cause reason":"CPU fault"' end], lambda x: x is not null), ',') || '}}' as prediction from task""")
def _(spark, sf_dir):
    from rootloom.operators.time_ops import REQUESTED

    wanted = F.create_map(*[x for k, v in REQUESTED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    text = F.col("row_id").cast("string")
    return ops.requested_output(c.task(spark, sf_dir).select("row_id", F.try_element_at(wanted, F.col("task_index")).alias("requested"), F.concat(F.lit("t"), text).alias("occurrence"), F.concat(F.lit("svc-"), (F.col("row_id") % 6).cast("string")).alias("component"), F.lit("CPU fault").alias("reason")))


@query("graph_context", f"""with {_EVIDENCE}, {_FUSED}, x as (select distinct case_id, component from fused)
    select case_id, component, coalesce((select array_to_string(list_sort(list(dst))[1:8], ',') from graph_edge e where e.case_id = x.case_id and e.src = x.component), '') as calls, coalesce((select array_to_string(list_sort(list(src))[1:8], ',') from graph_edge e where e.case_id = x.case_id and e.dst = x.component), '') as called_by,
      (case_id, component) in (select (case_id, node) from symptoms) as is_symptomatic, (case_id, component) in (select (case_id, src) from graph_edge union select (case_id, dst) from graph_edge) as in_graph from x""")
def _(spark, sf_dir):
    found = graph.graph_context(fused(spark, sf_dir), edges(spark, sf_dir), symptomatic(spark, sf_dir))
    return found.select("case_id", "component", F.array_join("calls", ",").alias("calls"), F.array_join("called_by", ",").alias("called_by"), "is_symptomatic", "in_graph")
