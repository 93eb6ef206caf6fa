"""Queries of answers completed from the board, and of reviews between agents."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootloom.operators import fusion
from rootloom.operators import opinions as ops
from rootloom.plans.finding_queries import REASON
from rootloom.plans.fusion_queries import _EVIDENCE, _sharded
from rootloom.plans.registry import query
from rootloom.sources import canonical as c

#: Answers of six kinds, some of cases without a finding; {0} is the component's number.
_RAWS = ("no json", '{{"component":" svc-{0} ","confidence":0.4,"reason":"cpu","occurrence_time":"noon","evidence":["p1","p2"]}}', '{{"root":"SVC-{0}","confidence":"high"}}', '{{"component":"","confidence":7,"reason":""}}', '{{"root_cause_component":"svc-{0}","evidence":[]}}', '{{"component":"ghost","confidence":-1}}')


@query("opinion_answer", f"""with op as (select 'case-' || (c_custkey % 9)::varchar as case_id, 'worker-' || c_custkey::varchar as worker_id, c_custkey % 6 as how, 'svc-' || (c_custkey % 12)::varchar as x from customer),
    e as (select *, row_number() over (partition by case_id, component order by score desc, magnitude desc, signal, direction) as e from finding),
    bd as (select t.case_id, t.component, component_score, {REASON.format("string_agg(signal || ' ' || direction, ' ' order by e)")} as reason, list(evidence_ptr order by e) as ptrs, arg_min(window_start, e) as told from component_total t join e using (case_id, component) where e <= 8 group by all),
    fi as (select case_id, component as first from (select *, row_number() over (partition by case_id order by component_score desc, component) as r from component_total) where r = 1),
    nm as (select op.*, case when how = 2 then upper(x) when how in (1, 4) then x when how = 5 then 'ghost' else coalesce(first, 'UNKNOWN') end as component from op left join fi using (case_id))
    select nm.case_id, worker_id, nm.component, case when how = 1 then 'cpu' else coalesce(bd.reason, 'unknown') end as reason, case how when 1 then 0.4 when 3 then 1.0 else 0.0 end::double as confidence, case when how = 1 then 'noon' end as told_time,
        case when how <> 1 then told end as occurrence, case when how = 1 then 'p1,p2' else coalesce(array_to_string(ptrs, ','), '') end as evidence_ptrs, coalesce(component_score, 0) as score from nm left join bd on bd.case_id = nm.case_id and bd.component = lower(nm.component)""")
def _(spark, sf_dir):
    key = F.col("c_custkey")
    named = [F.replace(F.lit(r.replace("{{", "{").replace("}}", "}")), F.lit("{0}"), (key % 12).cast("string")) for r in _RAWS]
    raw = F.element_at(F.array(*named), (key % 6 + 1).cast("int"))
    opinions = c.table(spark, sf_dir, "customer").select(F.concat(F.lit("case-"), (key % 9).cast("string")).alias("case_id"), F.concat(F.lit("worker-"), key.cast("string")).alias("worker_id"), raw.alias("raw"))
    return ops.opinion_answer(opinions, c.finding(spark, sf_dir)).withColumn("evidence_ptrs", F.array_join("evidence_ptrs", ","))


#: Every third component is doubted. rv: what each agent (its own columns behind own_) says of each peer's proposal.
_REVIEWS = f"""{_EVIDENCE}, ev2 as (select * replace (case when substr(component, 5)::int % 3 = 0 then 2 * support_score else 0 end as refute_score) from evidence),
    od as (select *, support_score - refute_score as net, row_number() over (partition by case_id, shard_id order by support_score - refute_score desc, local_rank, component) as spot from ev2),
    ag as (select *, count(*) over (partition by case_id) - 1 as peers from (select case_id, shard_id as agent, sum(greatest(net, 0)) as pos from od group by all)), pr as (select * from od where spot = 1),
    rv as (select a.case_id, agent, p.shard_id as peer, p.component, p.reason, case when o.net > 0 then 'support' when o.net < 0 then 'challenge' else 'abstain' end as verdict, least(abs(o.net), pos / peers) as w, o.evidence_ptrs as ptrs, o.modality as own_modality, o.reason as own_reason
        from ag a join pr p on a.case_id = p.case_id and a.agent <> p.shard_id left join od o on o.case_id = a.case_id and o.shard_id = a.agent and o.component = p.component)"""


def _doubted(spark, sf_dir):
    doubt = F.substring("component", 5, 3).cast("int") % 3 == 0
    return fusion.candidate_evidence(_sharded(spark, sf_dir)).withColumn("refute_score", F.when(doubt, 2 * F.col("support_score")).otherwise(0.0))


@query("review_transcript", f"""with {_REVIEWS}, ms as (select case_id, 0 as round, shard_id as sender, 'all' as receiver, 'proposal' as kind, null::varchar as verdict, component, reason, round(support_score, 6) as support, round(refute_score, 6) as refute, evidence_ptrs as p from pr
    union all select case_id, 1, agent, peer, 'peer_review', verdict, component, reason, case when verdict = 'support' then round(w, 6) else 0 end, case when verdict = 'challenge' then round(w, 6) else 0 end, case when verdict <> 'abstain' then ptrs end from rv)
    select * exclude (p), coalesce(array_to_string(p[1:6], ','), '') as evidence_ptrs, row_number() over (partition by case_id order by round, sender, receiver)::int as place from ms""")
def _(spark, sf_dir):
    return ops.review_transcript(_doubted(spark, sf_dir)).withColumn("evidence_ptrs", F.array_join("evidence_ptrs", ","))


@query("reviewed_evidence", f"""with {_REVIEWS} select case_id, shard_id, component, round(support_score, 6) as support_score, round(refute_score, 6) as refute_score, local_rank, modality, reason, null::varchar as worker_id from ev2
    union all select case_id, agent, component, case when verdict = 'support' then round(w, 6) else 0 end, case when verdict = 'challenge' then round(w, 6) else 0 end, 1, own_modality, own_reason, agent || '_peer_review' from rv where verdict <> 'abstain'""")
def _(spark, sf_dir):
    rows = ops.reviewed_evidence(_doubted(spark, sf_dir))
    return rows.withColumns({x: F.round(x, 6) for x in ("support_score", "refute_score")}).drop("evidence_ptrs", "evidence")
