"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from rootloom.operators import evaluation as ops
from rootloom.operators import fusion, scoring
from rootloom.operators.bootstrap import KEYS, PRIME, ROUNDS
from rootloom.operators.graph import paired_systems
from rootloom.operators.scoring import score_join
from rootloom.plans.fusion_queries import _PAIRS, _PARSED, _VECTORS, _parsed, _vectors
from rootloom.plans.fusion_queries import _pairs as _opinion_pairs
from rootloom.plans.registry import query
from rootloom.sources import canonical as c


def _scored(spark, sf_dir):
    return score_join(c.prediction(spark, sf_dir), c.case(spark, sf_dir))


def _pairs(spark, sf_dir, a="single", b="repaired"):
    return paired_systems(_scored(spark, sf_dir), a, b, "hit_at_1")


_PAIR = "pr as (select case_id, max(hit_at_1) filter (system = 'single') as b, max(hit_at_1) filter (system = 'repaired') as t from scored group by case_id)"


@query("hit_mrr", "select system, count(*) as n, sum(hit_at_1)::bigint as hits, round(avg(mrr), 6) as mrr from scored group by system")
def _(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("system").agg(F.count("*").alias("n"), F.sum("hit_at_1").alias("hits"), F.round(F.avg("mrr"), 6).alias("mrr"))


@query("avg_at_5", "select system, coalesce(fault_type, 'all') as fault_type, count(*) as n, round(avg((place <= 1)::int), 6) as hit_at_1, round(avg((place <= 3)::int), 6) as hit_at_3, round(avg((place <= 5)::int), 6) as hit_at_5, round(avg((6 - place) / 5), 6) as avg_at_5, round(avg(mrr), 6) as mrr from scored group by grouping sets ((system), (system, fault_type))")
def _(spark, sf_dir):
    return ops.by_system(_scored(spark, sf_dir))


@query("set_prf1", """with x as (select case_id, system, list_distinct(list_transform(ranked_roots[1:2], lambda r: lower(r))) as p, list_distinct([true_root, 'svc-0']) as e from scored),
    y as (select *, len(list_intersect(p, e)) as h, len(p) as np, len(e) as ne from x) select case_id, system, round(h / np, 6) as precision, round(h / ne, 6) as recall, round(case when h > 0 then 2.0 * h / (np + ne) else 0 end, 6) as f1, h = np and h = ne as exact from y""")
def _(spark, sf_dir):
    rows = _scored(spark, sf_dir).select("case_id", "system", F.transform(F.slice("ranked_roots", 1, 2), lambda r: F.concat(F.lit("  "), F.upper(r))).alias("predicted"), F.array(F.col("true_root"), F.lit("SVC-0 ")).alias("expected"))
    out = ops.set_prf1(rows)
    return out.select("case_id", "system", *[F.round(n, 6).alias(n) for n in ("precision", "recall", "f1")], "exact")


_KPI = "kp as (select *, case when sample_index % 4 = 0 then 1 - root1 else root1 end as p_root1, case when sample_index % 6 = 1 then 1 - root2 else root2 end as p_root2, case when sample_index % 9 = 2 then 0 else root3 end as p_root3 from kpi_label)"


def _predicted(spark, sf_dir):
    k, s = c.kpi_label(spark, sf_dir), F.col("sample_index")
    return k.withColumns({"p_root1": F.when(s % 4 == 0, 1 - F.col("root1")).otherwise(F.col("root1")), "p_root2": F.when(s % 6 == 1, 1 - F.col("root2")).otherwise(F.col("root2")), "p_root3": F.when(s % 9 == 2, 0).otherwise(F.col("root3"))})


@query("challenge_score", f"with {_KPI} select sample_index, round(((root1 * p_root1 + root2 * p_root2 + root3 * p_root3) - ((1 - root1) * p_root1 + (1 - root2) * p_root2 + (1 - root3) * p_root3)) / greatest(root1 + root2 + root3, 1), 6) as challenge_score from kp")
def _(spark, sf_dir):
    return ops.challenge_score(_predicted(spark, sf_dir)).select("sample_index", F.round("challenge_score", 6).alias("challenge_score"))


@query("multilabel_report", f"""with {_KPI}, l as (select unnest(['root1', 'root2', 'root3']) as root, unnest([root1, root2, root3]) as y, unnest([p_root1, p_root2, p_root3]) as p from kp),
    s as (select coalesce(root, 'micro') as root, sum(y * p) as tp, sum((1 - y) * p) as fp, sum(y * (1 - p)) as fn, sum(y)::bigint as support from l group by grouping sets ((root), ()))
    select root, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1, support from s""")
def _(spark, sf_dir):
    return ops.multilabel_report(_predicted(spark, sf_dir))


@query("wilson_ci", """with s as (select system, sum(hit_at_1)::double as h, count(*)::double as n, 1.959963984540054 as z from scored group by system), q as (select *, h / n as p, (h / n + z * z / (2 * n)) / (1 + z * z / n) as c, z * sqrt((h / n) * (1 - h / n) / n + z * z / (4 * n * n)) / (1 + z * z / n) as w from s)
    select system, round(greatest(0, c - w), 6) as low, round(least(1, c + w), 6) as high from q""")
def _(spark, sf_dir):
    sums = _scored(spark, sf_dir).groupBy("system").agg(F.sum("hit_at_1").cast("double").alias("h"), F.count("*").cast("double").alias("n"))
    return sums.select("system", ops.wilson_ci(F.col("h"), F.col("n")).alias("w")).select("system", "w.low", "w.high")


def _draw(name, need, keys):
    """CTEs: ``name`` has (keys, rep, k) for rows (keys, rep, n, p, x) of ``need``: x is mixed below a prime, and k is the least with P(X <= k) above it, X binomial(n, p)."""
    prime, steps, at = PRIME, [], need
    for i, (a, c) in enumerate(ROUNDS):
        steps += [f"{name}a{i} as (select * replace ((x * {a} + {c}) % {prime} as x) from {at})", f"{name}b{i} as (select *, (x * x) % {prime} as y from {name}a{i})"]
        steps.append(f"{name}c{i} as (select * exclude (x, y), ((y * y) % {prime} * x) % {prime} as x from {name}b{i})")
        at = f"{name}c{i}"
    return ", ".join(steps) + f""", {name}w as (select distinct n, p from {at} where p > 0 and p < 1), {name}k as (select n, p, unnest(range(greatest(0, floor(n * p - 10 * sqrt(n * p * (1 - p)) - 10))::bigint, least(n, ceil(n * p + 10 * sqrt(n * p * (1 - p)) + 10))::bigint + 1)) as k from {name}w),
    {name}m as (select *, case when k = 0 then n * ln(1 - p) when k = n then n * ln(p) else lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p) end as l from {name}k),
    {name}f as (select n, p, k, sum(exp(l)) over (partition by n, p order by k) / sum(exp(l)) over (partition by n, p) as f from {name}m),
    {name} as (select {keys}, rep, case when any_value(s.p) <= 0 then 0 when any_value(s.p) >= 1 then any_value(s.n) else coalesce(min(k) filter (f > (x + 0.5) / {prime}), max(k)) end as k from {at} s left join {name}f using (n, p) group by {keys}, rep)"""


def _boot(source, keys, reps):
    """CTEs: ends has the interval of each key of a source (keys, v) with three different values at most: draws of the first value, then of the second among the rest."""
    low, high = int(0.025 * reps), min(reps - 1, int(0.975 * reps))
    node = lambda begin, end: (7 * KEYS["seed"] + begin * KEYS["begin"] + end * KEYS["end"]) % PRIME
    return f"""vc as materialized (select {keys}, v, count(*)::bigint as c from {source} where v is not null group by all),
    vi as materialized (select *, row_number() over (partition by {keys} order by v) as i, count(*) over (partition by {keys}) as vk, (sum(c) over (partition by {keys}))::bigint as total from vc),
    n1 as (select {keys}, rep, total as n, (case when vk = 1 then 1.0 else c / total end)::double as p, (rep * {KEYS["rep"]} + case vk when 3 then {node(0, 3)} else {node(0, 2)} end) % {PRIME} as x from vi, range({reps}) q(rep) where i = 1),
    {_draw("k1", "n1", keys)},
    n2 as (select {keys}, rep, vi.total - k1.k as n, (case when vk = 2 then 1.0 else c / (total - (select o.c from vi o where o.i = 1 and o.{keys} = vi.{keys})) end)::double as p, (rep * {KEYS["rep"]} + {node(1, 3)}) % {PRIME} as x from vi join k1 using ({keys}) where i = 2),
    {_draw("k2", "n2", keys)},
    mn as (select {keys}, rep, (sum(v * case i when 1 then k1.k when 2 then k2.k else total - k1.k - k2.k end) / any_value(total))::double as m from vi join k1 using ({keys}) left join k2 using ({keys}, rep) group by {keys}, rep),
    bt as (select {keys}, m, row_number() over (partition by {keys} order by m) - 1 as r from mn),
    ends as (select {keys}, round(max(m) filter (r = {low}), 6) as low, round(max(m) filter (r = {high}), 6) as high from bt group by {keys})"""


@query("bootstrap_ci")
def _(spark, sf_dir):
    return ops.bootstrap_ci(c.case(spark, sf_dir), ["fault_type"], "telemetry_bytes")


@query("aggregate_ci")
def _(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    share = rows.groupBy("system").agg(F.sum("hit_at_1").cast("double").alias("h"), F.count("*").cast("double").alias("n")).select("system", F.lit("hit_at_1").alias("metric"), ops.wilson_ci(F.col("h"), F.col("n")).alias("w")).select("system", "metric", "w.low", "w.high")
    mean = ops.bootstrap_ci(rows, ["system"], "latency_s").select("system", F.lit("latency_s").alias("metric"), "low", "high")
    return mean.unionByName(share)


_BINOMIAL = "(select sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2.0))) from range(0, least(b, c) + 1) q(k))"


@query("mcnemar", """with m as (select case_id, max(hit_at_1) filter (system = 'single') as b, max(hit_at_1) filter (system = 'repaired') as t, fault_type from scored group by case_id, fault_type),
    s as (select fault_type, count(*) as n, count(*) filter (b > 0 and t <= 0) as bo, count(*) filter (b <= 0 and t > 0) as tr from m group by fault_type),
    tl as (select fault_type, sum(exp(lgamma(bo + tr + 1) - lgamma(k + 1) - lgamma(bo + tr - k + 1) - (bo + tr) * ln(2.0))) as tail from s, lateral (select unnest(range(0, least(bo, tr) + 1)) as k) group by fault_type)
    select fault_type, n, bo as baseline_only, tr as treatment_only, round(case when bo + tr > 0 then greatest(abs(bo - tr) - 1, 0) ** 2 / (bo + tr) else 0 end, 6) as chi_square, round(case when bo + tr = 0 then 1.0 else least(1.0, 2 * tail) end, 9) as p_value from s join tl using (fault_type)""")
def _(spark, sf_dir):
    pairs = paired_systems(_scored(spark, sf_dir), "single", "repaired", "hit_at_1").join(c.case(spark, sf_dir).select("case_id", "fault_type"), "case_id")
    return ops.mcnemar(pairs, ["fault_type"])


@query("paired_bootstrap", f"with {_PAIR}, src as (select (t - b)::double as v, 0 as whole from pr), {_boot('src', 'whole', 10000)} select count(v) as n, round(avg(v), 6) as mean, max(low) as low, max(high) as high from src, ends")
def _(spark, sf_dir):
    d = _pairs(spark, sf_dir).select("case_id", (F.col("treatment") - F.col("baseline")).alias("d"))
    return ops.bootstrap_ci(d, [], "d", reps=10_000)


@query("holm_adjust", "with p as (select case_id, component, metric, exp(-abs(t_stat)) as p from welch where t_stat is not null), r as (select *, row_number() over (partition by case_id order by p, component, metric) as r, count(*) over (partition by case_id) as m from p) select case_id, component, metric, round(p, 9) as p_value, round(least(1.0, max((m - r + 1) * p) over (partition by case_id order by r)), 9) as holm_p from r")
def _(spark, sf_dir):
    from rootloom.operators.findings import prepost_moments, welch_shift
    from rootloom.operators.time_ops import phase_split

    moments = prepost_moments(phase_split(c.metric_long(spark, sf_dir), ["case_id", "source"]), ["case_id", "component", "metric", "source"])
    rows = welch_shift(moments).where("t_stat is not null").select("case_id", "component", "metric", F.exp(-F.abs("t_stat")).alias("p_value"))
    return ops.holm_adjust(rows, ["case_id"], ["component", "metric"]).withColumn("p_value", F.round("p_value", 9))


@query("usage_totals", "with s as (select system, count(*) as n, sum(total_tokens)::bigint as total_tokens, sum(llm_calls)::bigint as llm_calls, round(avg(latency_s), 6) as latency_s from prediction group by system) select *, round(total_tokens / (select total_tokens from s where system = 'repaired'), 6) as token_ratio from s")
def _(spark, sf_dir):
    return ops.usage_totals(c.prediction(spark, sf_dir), "repaired")


@query("strongest_baseline", "select system, count(*) as n, round(avg(hit_at_1), 9) as accuracy, round(avg(mrr), 9) as mrr, sum(total_tokens)::bigint as tokens from scored where system <> 'repaired' group by system order by accuracy desc, mrr desc, tokens, system limit 1")
def _(spark, sf_dir):
    return ops.strongest_baseline(_scored(spark, sf_dir), "repaired")


_TAIL = "tl as (select {keys}, sum(exp(lgamma(bo + tr + 1) - lgamma(k + 1) - lgamma(bo + tr - k + 1) - (bo + tr) * ln(2.0))) as tail from s, lateral (select unnest(range(0, least(bo, tr) + 1)) as k) group by {keys})"


@query("win_gate", f"""with m as (select case_id, fault_type, max(hit_at_1) filter (system = 'single') as b, max(hit_at_1) filter (system = 'repaired') as t from scored group by all), s as (select fault_type, avg(b) as b, avg(t) as t, count(*) filter (b > t) as bo, count(*) filter (b < t) as tr from m group by fault_type), {_TAIL.format(keys="fault_type")},
    g as (select fault_type, t - b as d, case when b < 1 then (t - b) / (1 - b) else 0 end as e, case when bo + tr = 0 then 1.0 else least(1.0, 2 * tail) end as p from s join tl using (fault_type)) select fault_type, round(d, 6) as delta, round(e, 6) as error_reduction, round(p, 9) as p_value, (d >= 0.1 or e >= 0.2) and p <= 0.05 as passes from g""")
def _(spark, sf_dir):
    pairs = paired_systems(_scored(spark, sf_dir), "single", "repaired", "hit_at_1").join(c.case(spark, sf_dir).select("case_id", "fault_type"), "case_id")
    rates = pairs.groupBy("fault_type").agg(F.avg("baseline").alias("baseline_rate"), F.avg("treatment").alias("treatment_rate"))
    tests = rates.join(ops.mcnemar(pairs, ["fault_type"]).select("fault_type", "p_value"), "fault_type")
    return ops.win_gate(tests).select("fault_type", "delta", "error_reduction", "p_value", "passes")


_FACTS = """facts as (select case_id, telemetry_bytes, 'RE' || (substr(case_id, 2)::int % 3 + 1)::varchar as suite, case when substr(case_id, 2)::int % 4 = 0 then 'TT' else 'OB' end as system, fault_type <> 'cpu' as has_logs, substr(case_id, 2)::int % 5 <> 0 as has_traces, substr(case_id, 2)::int % 240 as metric_columns from cases)"""


def _facts(spark, sf_dir):
    k = F.substring("case_id", 2, 20).cast("int")
    return c.case(spark, sf_dir).withColumns({"suite": F.concat(F.lit("RE"), (k % 3 + 1).cast("string")), "system": F.when(k % 4 == 0, "TT").otherwise("OB"), "has_logs": F.col("fault_type") != "cpu", "has_traces": k % 5 != 0, "metric_columns": k % 240})


@query("hard_split", f"with {_FACTS}, h as (select *, (suite in ('RE2', 'RE3'))::int + (system = 'TT')::int + (telemetry_bytes >= (select median(telemetry_bytes) from facts))::int + has_logs::int + has_traces::int + (metric_columns >= 120)::int as criteria_score from facts) select case_id, criteria_score from h where criteria_score >= 3")
def _(spark, sf_dir):
    return ops.hard_split(_facts(spark, sf_dir)).select("case_id", "criteria_score")


@query("high_volume_split", f"with {_FACTS}, w as (select * from facts where has_logs and has_traces), r as (select *, row_number() over (order by telemetry_bytes) - 1 as i, count(*) over () as n from w) select case_id, 'high' as volume_bin from w where telemetry_bytes >= (select telemetry_bytes from r where i = floor(n * 0.8)) and suite <> 'RE1'")
def _(spark, sf_dir):
    facts = _facts(spark, sf_dir)
    return ops.high_volume_split(facts, "telemetry_bytes", 0.8, facts.where("suite = 'RE1'")).select("case_id", "volume_bin")


@query("stratified_sample", "with r as (select *, md5('7:' || case_id) as h, row_number() over (partition by source order by md5('7:' || case_id), case_id) as r from cases) select case_id, source from (select *, row_number() over (order by case when r <= 10 then 0 else 1 end, h, case_id) as k from r) where k <= 80")
def _(spark, sf_dir):
    return ops.stratified_sample(c.case(spark, sf_dir), "source", "case_id", 10, 80).select("case_id", "source")


@query("round_robin_select", "with r as (select case_id, fault_type, row_number() over (partition by fault_type order by case_id) as r from cases) select case_id, fault_type from (select *, row_number() over (order by r, fault_type, case_id) as k from r) where k <= 50")
def _(spark, sf_dir):
    return ops.round_robin_select(c.case(spark, sf_dir), "fault_type", "case_id", 50).select("case_id", "fault_type")


_TRUTH = "truth as (select case_id, 'svc-' || (right(case_id, 1)::int * 2 % 12)::varchar as true_root from (select distinct case_id from finding))"


def _truth(spark, sf_dir):
    return c.metric_long(spark, sf_dir).select("case_id").distinct().withColumn("true_root", F.concat(F.lit("svc-"), (F.substring("case_id", -1, 1).cast("int") * 2 % 12).cast("string")))


@query("budget_allocation", f"""with {_TRUTH}, r as (select *, row_number() over (partition by case_id order by score desc, component, signal) as g, row_number() over (partition by case_id, modality order by score desc, component, signal) as s from finding),
    t as (select r.*, row_number() over (partition by r.case_id order by s, modality) as t, true_root from r join truth using (case_id)), k as (select case_id, b::int as budget, max((g <= b and component = true_root)::int) as g, max((t <= b and component = true_root)::int) as t, count(*) as n from t, (values (2), (4), (8), (16)) q(b) group by all)
    select budget, round(avg(g), 6) as global_kept, round(avg(t), 6) as shard_kept, round(avg(n / budget), 6) as gamma from k group by budget""")
def _(spark, sf_dir):
    f = c.finding(spark, sf_dir).withColumn("shard_id", F.col("modality"))
    return ops.budget_allocation(f, _truth(spark, sf_dir), [2, 4, 8, 16])


_GRID = """sp as (select p.*, w.worker_id, x.probability as prob, substr(p.component, 5)::int < 5 as inside, 0.2 as om, count(*) over (partition by p.case_id, w.worker_id) as n from pairs p join (select distinct case_id, worker_id from opinion) w using (case_id) left join parsed x using (case_id, worker_id, component, reason)),
    ms as (select *, coalesce(sum(case when inside then prob end) over g, 0) as mass, count(case when inside then prob end) over g as said, count(*) filter (inside) over g as size from sp window g as (partition by case_id, worker_id)),
    ll as (select *, ln(case when not inside then 1.0 / n else greatest(1e-6, coalesce(prob * case when mass > 1 + 1e-6 then 1 / mass else 1 end, greatest(1e-6, least(om, greatest(0, 1 - least(mass, 1))) / greatest(1, size - said)))) end) as l from ms),
    rc as (select case_id, count(distinct worker_id) as k from opinion group by case_id), rp as (select a.case_id, greatest(0, coalesce(corr(a.p, b.p), 0)) as r from vec a join vec b on a.case_id = b.case_id and a.component = b.component and a.worker_id < b.worker_id group by a.case_id, a.worker_id, b.worker_id),
    cr as (select rc.case_id, k, coalesce(avg(r), 0) as r from rc left join rp using (case_id) group by rc.case_id, k), tr as (select case_id, 'svc-' || (replace(case_id, 'case-', '')::int * 5 % 6)::varchar as true_root from rc),"""
_POOLED = """{n}_lg as (select q.*, case_id, component, reason, sum(l * case worker_id when 'worker-1' then boost when 'worker-2' then boost when 'worker-3' then 1 + (boost - 1) / 2 when 'worker-4' then case when boost = 1 then 1 else 0.8 end else 1 end * case when k < 2 then 1 else (1 + (k - 1) * (1 - rho * r)) / k end) - ln(first(n)) as logp, count(case when inside then prob end) as supporters from ll join cr using (case_id), {n}_q q group by all),
    {n}_po as (select *, round(e / sum(e) over (partition by id, case_id), 9) as posterior from (select *, exp((logp - max(logp) over (partition by id, case_id)) / temperature) as e from {n}_lg)),
    {n}_rk as (select *, row_number() over (partition by id, case_id order by posterior desc, supporters desc, component, reason) as rank from {n}_po),
    {n}_cs as (select id, boost, rho, temperature, case_id, coalesce(1.0 / min(rank) filter (rank <= 8 and component = true_root), 0) as rr, max(posterior) filter (rank = 1) as sure from {n}_rk join tr using (case_id) group by all),
    {n}_sc as (select id, boost, rho, temperature, round(avg(rr), 9) as mrr, round(avg((rr = 1)::int), 9) as hit_at_1, round(avg((sure - (rr = 1)::int) ** 2), 9) as brier from {n}_cs group by all)"""


@query("grid_search", f"""with {_PARSED}, {_PAIRS}, {_VECTORS}, {_GRID}
    a_q as (select * from (values (0, 1.0::double, 0.0::double, 1.0::double), (1, 1.15, 0.0, 1.0), (2, 1.3, 0.0, 1.0), (3, 1.5, 0.0, 1.0), (4, 2.0, 0.0, 1.0)) q(id, boost, rho, temperature)), {_POOLED.format(n="a")},
    a_bs as (select *, row_number() over (order by mrr desc, hit_at_1 desc, id) = 1 as chosen from a_sc),
    b_q as (select (r * 4 + t)::int as id, (select boost from a_bs where chosen) as boost, r / 4.0::double as rho, [1.0, 1.5, 2.0, 3.0][t + 1]::double as temperature from range(5) x(r), range(4) y(t)), {_POOLED.format(n="b")}
    select 'reliability' as stage, boost, rho, temperature, mrr, hit_at_1, brier, chosen from a_bs union all select 'calibration', boost, rho, temperature, mrr, hit_at_1, brier, row_number() over (order by brier, id) = 1 from b_sc""")
def _(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    modality = F.element_at(F.array(*map(F.lit, ("metrics", "logs", "traces", "events", "auxiliary"))), F.substring("worker_id", -1, 1).cast("int") + 1)
    workers = c.opinion(spark, sf_dir).select("case_id", "worker_id").distinct().select("case_id", "worker_id", modality.alias("modality"), F.lit(0.2).alias("other_mass"), F.array(*[F.lit(f"svc-{i}") for i in range(5)]).alias("scope"))
    truth = workers.select("case_id").distinct().withColumn("true_root", F.concat(F.lit("svc-"), (F.replace("case_id", F.lit("case-"), F.lit("")).cast("int") * 5 % 6).cast("string")))
    return fusion.grid_search(parsed.select("case_id", "worker_id", "component", "reason", "probability"), workers, _opinion_pairs(spark, sf_dir), truth, _vectors(spark, sf_dir))


@query("brier", "select system, round(avg((confidence - hit_at_1) ** 2), 6) as brier from scored group by system")
def _(spark, sf_dir):
    e = F.col("confidence") - F.col("hit_at_1")
    return _scored(spark, sf_dir).groupBy("system").agg(F.round(F.avg(e * e), 6).alias("brier"))


@query("threshold_calibration", """with x as (select 'root1' as root, root1 as y, ((sample_index * 37) % 100) / 100.0::double as p from kpi_label union all select 'root3', root3, ((sample_index * 53) % 100) / 100.0::double from kpi_label),
    v as (select root, t / 100.0::double as threshold, round(avg(case when p >= t / 100.0::double then case when y = 1 then 1 else -1 end else 0 end), 9) as value from x, range(5, 96) q(t) group by all)
    select root, threshold, value from (select *, row_number() over (partition by root order by value desc, round(abs(threshold - 0.5), 9), threshold desc) as r from v) where r = 1""")
def _(spark, sf_dir):
    k, s = c.kpi_label(spark, sf_dir), F.col("sample_index")
    one = k.select(F.lit("root1").alias("root"), F.col("root1").alias("y"), (s * 37 % 100 / 100.0).alias("p"))
    two = k.select(F.lit("root3").alias("root"), F.col("root3").alias("y"), (s * 53 % 100 / 100.0).alias("p"))
    return ops.threshold_calibration(one.union(two), ["root"], [t / 100.0 for t in range(5, 96)])


@query("label_strata", """with s as (select *, root1 + 2 * root2 + 4 * root3 as stratum, md5('7:' || sample_index::varchar) as h from kpi_label), r as (select *, row_number() over (partition by stratum order by h, sample_index) as r, count(*) over (partition by stratum) as n from s)
    select sample_index, stratum, case when r <= floor(n * 0.7) then 'train' else 'held_out' end as split, ((r - 1) % 5)::int as fold from r""")
def _(spark, sf_dir):
    return ops.label_strata(c.kpi_label(spark, sf_dir), 0.7, 5).select("sample_index", "stratum", "split", "fold")


@query("root_rank_diag", f"with {_TRUTH}, l as (select case_id, component, row_number() over (partition by case_id order by max(score) desc, component) as rank from finding group by case_id, component) select count(*) as cases, count(*) filter (rank <= 1) as top_1, count(*) filter (rank <= 3) as top_3, count(*) filter (rank <= 5) as top_5, count(*) filter (rank is null) as absent from truth left join l on l.case_id = truth.case_id and l.component = truth.true_root")
def _(spark, sf_dir):
    return ops.rank_diagnostics(c.finding(spark, sf_dir), _truth(spark, sf_dir))


@query("exact_case_comparison", f"with {_PAIR} select count(*) filter (t > b) as better, count(*) filter (t < b) as worse, count(*) filter (t = b) as tied, round(avg(t - b), 6) as mean_difference from pr")
def _(spark, sf_dir):
    return ops.exact_comparison(_pairs(spark, sf_dir))


@query("rerank_fixed_broken", f"with {_PAIR} select count(*) filter (b <= 0 and t > 0) as fixed, count(*) filter (b > 0 and t <= 0) as broken from pr")
def _(spark, sf_dir):
    return ops.mcnemar(_pairs(spark, sf_dir)).select(F.col("treatment_only").alias("fixed"), F.col("baseline_only").alias("broken"))


@query("difficulty_summary", "select coalesce(source, 'total') as difficulty, count(*) as n, round(avg(hit_at_1), 6) as strict, round(avg(mrr), 6) as partial from scored group by rollup (source)")
def _(spark, sf_dir):
    out = _scored(spark, sf_dir).rollup("source").agg(F.count("*").alias("n"), F.round(F.avg("hit_at_1"), 6).alias("strict"), F.round(F.avg("mrr"), 6).alias("partial"))
    return out.select(F.coalesce("source", F.lit("total")).alias("difficulty"), "n", "strict", "partial")


@query("prior_effect", "select fault_type, count(*) as n, count(*) filter (a < b) as improved, count(*) filter (a > b) as worsened from (select case_id, fault_type, max(hit_at_1) filter (system = 'sharded') as a, max(hit_at_1) filter (system = 'repaired') as b from scored group by all) group by fault_type")
def _(spark, sf_dir):
    pairs = _pairs(spark, sf_dir, "sharded", "repaired").join(c.case(spark, sf_dir).select("case_id", "fault_type"), "case_id")
    return ops.mcnemar(pairs, ["fault_type"]).select("fault_type", "n", F.col("treatment_only").alias("improved"), F.col("baseline_only").alias("worsened"))


#: Answers with one root each, in eight ways to be wrong or right by the row's tokens.
_ANSWERS = """ans as (select case_id, system, total_tokens % 8 as k, telemetry_bytes > 250000 as large, 'os_00' || (total_tokens % 5 + 1)::varchar as comp from scored)"""


def _answers(spark, sf_dir):
    k = F.col("total_tokens") % 8
    comp = F.concat(F.lit("os_00"), (F.col("total_tokens") % 5 + 1).cast("string"))
    name = F.when(k == 2, "os_009").when(k == 4, "strange").otherwise(comp)
    root = F.concat(F.lit('{"root cause component":"'), F.when(k == 3, "").otherwise(name), F.lit('","root cause reason":"'), F.when(k == 5, "db close").otherwise("CPU fault"), F.lit('","root cause occurrence datetime":"2024-01-01 00:0'), F.when(k == 6, "3").otherwise("1"), F.lit(':00"}'))
    raw = F.when(k == 0, "no answer").when(k == 1, F.concat(F.lit('{"1":'), root, F.lit(',"2":'), root, F.lit("}"))).otherwise(F.concat(F.lit('{"1":'), root, F.lit("}")))
    points = F.concat(F.lit("The only predicted root cause component is "), comp, F.lit("\nThe only predicted root cause reason is CPU fault\nThe only root cause occurrence time is within 1 minutes (i.e., <=1min) of 2024-01-01 00:00:00\n"))
    return _scored(spark, sf_dir).select("case_id", "system", raw.alias("prediction"), points.alias("scoring_points"), "telemetry_bytes")


@query("score_answers", f"""with {_ANSWERS} select case_id, system, case when k in (0, 1) then 0.0 when k = 7 then 1.0 else 0.67 end::double as score,
    array_to_string(list_filter([case when k not in (0, 1, 2, 3, 4) then comp end, case when k not in (0, 1, 5) then 'CPU fault' end, case when k not in (0, 1, 6) then '2024-01-01 00:00:00' end], lambda x: x is not null), ',') as passed,
    array_to_string(list_sort(list_filter([case when k in (0, 1, 2, 3, 4) then comp end, case when k in (0, 1, 5) then 'CPU fault' end, case when k in (0, 1, 6) then '2024-01-01 00:00:00' end], lambda x: x is not null)), ',') as failed, k = 7 as strict_correct from ans""")
def _(spark, sf_dir):
    found = scoring.score_answers(_answers(spark, sf_dir), ["case_id", "system"])
    return found.select("case_id", "system", "score", F.array_join("passed", ",").alias("passed"), F.array_join("failed", ",").alias("failed"), "strict_correct")


_KINDS = """kinds as (select *, case k when 0 then ['format', 'multi_root_count', 'missing_field', 'component', 'reason', 'time'] when 1 then ['multi_root_count', 'component', 'reason', 'time'] when 2 then ['invalid_catalog', 'component'] when 3 then ['missing_field', 'component']
    when 4 then ['invalid_catalog', 'component'] when 5 then ['reason'] when 6 then ['time'] else []::varchar[] end as categories, case when k in (0, 3) then 'missing' when k = 2 then 'os_009' when k = 4 then 'strange' else comp end as pc, case when k = 0 then 'missing' when k = 5 then 'db close' else 'CPU fault' end as pr from ans)"""
_CATALOGUE = [f"os_00{i}" for i in range(1, 6)]


def _classified(spark, sf_dir):
    from rootloom.operators.time_ops import REASONS

    keys = ["case_id", "system", "volume_bin"]
    rows = scoring.read_answers(_answers(spark, sf_dir).withColumn("volume_bin", F.when(F.col("telemetry_bytes") > 250000, "high").otherwise("low")))
    strict = scoring.score_answers(rows, [*keys, "_points", "_answer"])
    return scoring.error_taxonomy(strict, keys, _CATALOGUE, list(REASONS))


@query("error_taxonomy", f"with {_ANSWERS}, {_KINDS} select case_id, system, k = 7 as strict_correct, array_to_string(categories, ',') as categories, pc as predicted_component, pr as predicted_reason from kinds")
def _(spark, sf_dir):
    return _classified(spark, sf_dir).drop("volume_bin").withColumn("categories", F.array_join("categories", ","))


@query("bias_tables", f"""with {_ANSWERS}, {_KINDS}, x as (select unnest(list_concat([{{'kind': 'predicted_component', 'value': pc}}, {{'kind': 'predicted_reason', 'value': pr}}, {{'kind': 'volume_bin', 'value': case when large then 'high' else 'low' end}}], list_transform(categories, lambda c: {{'kind': 'by_system_category', 'value': system || ':' || c}}))) as x from kinds where k <> 7)
    select x.kind as kind, x.value as value, count(*) as n from x group by all""")
def _(spark, sf_dir):
    return scoring.bias_tables(_classified(spark, sf_dir), ["predicted_component", "predicted_reason", "volume_bin"])


_ROLES = {"operational_single": "single", "architecture_baseline": "sharded"}


@query("slice_comparison", f"""with a as (select *, unnest(['all', case when telemetry_bytes > 250000 then 'high_volume' end]) as slice from scored), w as (select slice, case_id, max(hit_at_1) filter (system = 'single') as b1, max(hit_at_1) filter (system = 'sharded') as b2, max(hit_at_1) filter (system = 'repaired') as t from a where slice is not null group by all),
    src as (select slice || '|' || role as sr, slice, role, case_id, b, t, (t - b)::double as v from (select slice, case_id, t, unnest(['operational_single', 'architecture_baseline']) as role, unnest([b1, b2]) as b from w)),
    s as (select sr, slice, role, count(*) as n, count(*) filter (b > t) as bo, count(*) filter (b < t) as tr, avg(b) as rate, round(avg(v), 6) as delta from src group by all), {_TAIL.format(keys="sr")},
    ps as (select s.*, round(case when bo + tr = 0 then 1.0 else least(1.0, 2 * tail) end, 9) as p from s join tl using (sr)), rk as (select *, row_number() over (partition by slice order by p, role) as i from ps),
    hm as (select *, round(least(1.0, max((3 - i) * p) over (partition by slice order by i)), 9) as holm from rk), {_boot('src', 'sr', 1000)}
    select slice, role, case role when 'operational_single' then 'single' else 'sharded' end as baseline, n, bo as baseline_only, tr as treatment_only, delta, low, high, p as p_value, holm as holm_p, (delta >= 0.1 or case when rate < 1 then delta / (1 - rate) else 0 end >= 0.2) and holm <= 0.05 as passes from hm join ends using (sr)""")
def _(spark, sf_dir):
    sliced = _scored(spark, sf_dir).withColumn("slice", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("telemetry_bytes") > 250000, "high_volume")))))
    return ops.slice_comparison(sliced.select("slice", "case_id", "system", "hit_at_1"), _ROLES, "repaired")


@query("candidate_recall", "select system, k, round(avg((place <= k)::int), 6) as recall from scored, (values (1), (3), (5)) q(k) group by all")
def _(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))))
    return rows.groupBy("system", "k").agg(F.round(F.avg(F.when(F.col("place").between(1, F.col("k")), 1.0).otherwise(0.0)), 6).alias("recall"))
