"""Queries of the weight fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootloom.operators import fusion, graph, weight_fit
from rootloom.operators.findings import component_onsets
from rootloom.plans.evaluation_queries import _GRID, _POOLED
from rootloom.plans.fusion_queries import _EVIDENCE, _ON, _PAIRS, _PARSED, _VECTORS, _pairs, _parsed, _sharded, _vectors
from rootloom.plans.graph_queries import COVERAGE, edges, symptomatic
from rootloom.plans.registry import query
from rootloom.session import written
from rootloom.sources import canonical as c

#: Settings beside the fixed grid: all boosts of the pool's grid.
_BOOSTS = weight_fit.POOL_GRID[0]


def _rows(table: str, names: str, *grid) -> str:
    """A CTE of the numbered product of lists, in order."""
    columns = names.split()
    cross = ", ".join(f"(select unnest({list(g)}::double[]) as {n}, unnest(range({len(g)})) as i{k}) t{k}" for k, (n, g) in enumerate(zip(columns, grid, strict=True)))
    place = "0"
    for k, g in enumerate(grid):
        place = f"({place}) * {len(g)} + i{k}"
    return f"{table} as (select ({place})::int as trial, {names.replace(' ', ', ')} from {cross})"


#: From {n}_c0 (trial, gamma, beta, case_id, component, reason, score, rank, confidence) to {n}_c2, by coverage and then by precedence.
_REORDERED = """{n}_a1 as (select x.*, gamma > 0 and x.case_id in (select case_id from coverage) as is_on, coalesce(k.coverage, 0) as factor from {n}_c0 x left join coverage k on k.case_id = x.case_id and k.node = x.component),
    {n}_b1 as (select * exclude (factor), case when is_on then score * (1 + gamma * factor) else score end as s from {n}_a1),
    {n}_c1 as (select * replace (case when is_on then round(s, 6) else score end as score, case when is_on then least(0.95, greatest(0.05, s / coalesce(nullif(sum(s) over p, 0), 1))) else confidence end as confidence, row_number() over (partition by trial, case_id order by s desc, rank) as rank) from {n}_b1 window p as (partition by trial, case_id)),
    {n}_a2 as (select x.* exclude (is_on, s), beta > 0 and x.case_id in (select case_id from prec) as is_on, coalesce(k.precedence, 0) as factor from {n}_c1 x left join prec k on k.case_id = x.case_id and k.component = x.component),
    {n}_b2 as (select * exclude (factor), case when is_on then score * (1 + beta * factor) else score end as s from {n}_a2),
    {n}_c2 as (select * replace (case when is_on then least(0.95, greatest(0.05, s / coalesce(nullif(sum(s) over p, 0), 1))) else confidence end as confidence, row_number() over (partition by trial, case_id order by s desc, rank) as rank) from {n}_b2 window p as (partition by trial, case_id))"""


def _factors(spark, sf_dir):
    coverage = graph.explanatory_coverage(edges(spark, sf_dir), symptomatic(spark, sf_dir)).withColumnRenamed("node", "component")
    return written(coverage, "coverage"), written(component_onsets(_sharded(spark, sf_dir)), "onsets")


@query("fit_additive", f"""with {COVERAGE}, {_EVIDENCE}, {_ON}, {_rows("grid", "boost gamma beta", _BOOSTS, *weight_fit.ADDITIVE_GRID[1:])},
    g as (select trial + 1 as trial, boost, gamma, beta from grid union all select 0, null, 0, 0), tr as (select distinct case_id, 'SVC_' || (right(case_id, 1)::int * 5 % 12)::varchar as true_root, case when right(case_id, 1)::int % 3 = 2 then 'val' else 'dev' end as split from finding),
    sm as (select case_id, component, modality, sum((support_score - refute_score) / sqrt(local_rank)) as s from evidence group by all),
    fs as (select trial, gamma, beta, case_id, component, round(sum(s * case when modality in ('logs', 'traces') then coalesce(boost, 1.15) when modality = 'auxiliary' then 0.8 else 1 end), 6) as score from sm, g group by all),
    f_c0 as (select *, 0.0::double as confidence from (select *, row_number() over (partition by trial, case_id order by score desc, component) as rank from fs) where rank <= 5), {_REORDERED.format(n="f")},
    cs as (select g.trial, boost, g.gamma, g.beta, split, tr.case_id, coalesce(1.0 / min(rank) filter (component = replace(lower(true_root), '_', '-')), 0) as rr from g, tr left join f_c2 x on x.trial = g.trial and x.case_id = tr.case_id group by all),
    sco as (select trial, boost, gamma, beta, count(*) filter (split = 'dev') as dev_n, coalesce(round(round(avg((rr = 1)::int) filter (split = 'dev'), 9), 4), 0) as dev_hit_at_1, coalesce(round(round(avg(rr) filter (split = 'dev'), 9), 4), 0) as dev_mrr,
        count(*) filter (split = 'val') as val_n, coalesce(round(round(avg((rr = 1)::int) filter (split = 'val'), 9), 4), 0) as val_hit_at_1, coalesce(round(round(avg(rr) filter (split = 'val'), 9), 4), 0) as val_mrr from cs group by trial, boost, gamma, beta)
    select *, row_number() over (order by dev_hit_at_1 desc, dev_mrr desc, trial) = 1 as chosen from sco""")
def _(spark, sf_dir):
    findings = _sharded(spark, sf_dir)
    case = F.substring("case_id", -1, 1).cast("int")
    truth = findings.select("case_id").distinct().select("case_id", F.concat(F.lit("SVC_"), (case * 5 % 12).cast("string")).alias("true_root"), F.when(case % 3 == 2, "val").otherwise("dev").alias("split"))
    return weight_fit.fit_additive(fusion.candidate_evidence(findings), *_factors(spark, sf_dir), truth, boosts=_BOOSTS)


@query("fit_pool", f"""with {COVERAGE}, {_ON}, {_PARSED}, {_PAIRS}, {_VECTORS}, {_GRID} {_rows("p_q0", "boost rho temperature", *weight_fit.POOL_GRID[:3])}, p_q as (select trial as id, boost, rho, temperature from p_q0), {_POOLED.format(n="p")}, {_rows("gains", "gamma beta", *weight_fit.POOL_GRID[3:])},
    g as (select id * (select count(*) from gains) + gains.trial as trial, boost, rho, temperature, gamma, beta from p_q, gains),
    p_c0 as (select id * (select count(*) from gains) + gains.trial as trial, gamma, beta, case_id, component, posterior as score, rank, posterior as confidence from p_rk, gains where rank <= 8), {_REORDERED.format(n="p")},
    cs as (select g.trial, boost, rho, temperature, g.gamma, g.beta, tr.case_id, coalesce(1.0 / min(x.rank) filter (component = true_root), 0) as rr, coalesce(max(confidence) filter (x.rank = 1), 0) as sure from g, tr left join p_c2 x on x.trial = g.trial and x.case_id = tr.case_id group by all),
    sco as (select trial::int as trial, boost, rho, temperature, gamma, beta, count(*) as n_cases, round(round(avg((rr = 1)::int), 9), 4) as hit_at_1, round(round(avg(rr), 9), 4) as mrr, round(round(avg((sure - (rr = 1)::int) ** 2), 9), 6) as brier from cs group by trial, boost, rho, temperature, gamma, beta)
    select *, row_number() over (order by hit_at_1 desc, mrr desc, brier, trial) = 1 as chosen from sco""")
def _(spark, sf_dir):
    modality = F.element_at(F.array(*map(F.lit, ("metrics", "logs", "traces", "events", "auxiliary"))), F.substring("worker_id", -1, 1).cast("int") + 1)
    workers = c.opinion(spark, sf_dir).select("case_id", "worker_id").distinct().select("case_id", "worker_id", modality.alias("modality"), F.lit(0.2).alias("other_mass"), F.array(*[F.lit(f"svc-{i}") for i in range(5)]).alias("scope"))
    truth = workers.select("case_id").distinct().withColumn("true_root", F.concat(F.lit("svc-"), (F.replace("case_id", F.lit("case-"), F.lit("")).cast("int") * 5 % 6).cast("string")))
    explicit = _parsed(spark, sf_dir).select("case_id", "worker_id", "component", "reason", "probability")
    return weight_fit.fit_pool(explicit, workers, _pairs(spark, sf_dir), _vectors(spark, sf_dir), *_factors(spark, sf_dir), truth)
