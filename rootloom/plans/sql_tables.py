"""The canonical tables in DuckDB SQL, and what is derived from them for more than one query."""

from __future__ import annotations

import re

TABLES: dict[str, str] = {
    "metric_long": """select 'case-' || ((day(ts) - 1) // 5)::int::varchar as case_id, 'svc-' || (user_id % 12)::varchar as component,
        event_type as metric, 'events' as source, epoch_us(ts) / 1e6 as ts, value from events""",
    "log_line": """select 'case-' || ((day(ts) - 1) // 5)::int::varchar as case_id, 'svc-' || (user_id % 12)::varchar as component,
        epoch_us(ts) / 1e6 as ts, event_type || ' user ' || user_id::varchar || ' props ' || props as message, event_id as line_no from events""",
    "span": """select 'case-' || (l_orderkey % 6)::varchar as case_id, l_orderkey * 10 + l_linenumber as span_id,
        case when l_linenumber > 1 then l_orderkey * 10 + l_linenumber - 1 end as parent_id,
        'docker_' || lpad((l_suppkey % 8 + 1)::varchar, 3, '0') as component, 'svc-' || (l_partkey % 12)::varchar as service,
        'db_' || lpad((l_partkey % 13 + 1)::varchar, 3, '0') as ds_name, case when l_linestatus = 'O' then 'JDBC' else 'RPC' end as call_type,
        epoch_us(l_shipdate) / 1e3 as start_ms, l_quantity as elapsed, case when l_returnflag <> 'R' then 'true' else 'false' end as success from lineitem""",
    "incident_window": """select n_nationkey::bigint as row_id, 'task_' || (n_nationkey % 7 + 1)::varchar as task_index,
        ((1704067200 + n_nationkey::bigint * 86400) * 1000)::bigint as start_ms, ((1704067200 + n_nationkey::bigint * 86400) * 1000 + 36 * 3600 * 1000)::bigint as end_ms from nation""",
    "kpi": """select vec_id as sample_index, 'feature' || ((i - 1) % 8)::varchar as feature, ((i - 1) // 8)::int as t, embedding[i]::double as value
        from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings)""",
    "kpi_label": """select vec_id as sample_index, case when label % 3 = 0 or vec_id % 7 = 0 then 1 else 0 end as root1,
        case when label % 3 = 1 then 1 else 0 end as root2, case when label % 3 = 2 or vec_id % 5 = 0 then 1 else 0 end as root3 from embeddings""",
    "cases": """select 'C' || o_orderkey::varchar as case_id, o_orderpriority as source, 'svc-' || (o_custkey % 6)::varchar as true_root,
        case o_orderstatus when 'F' then 'cpu' when 'O' then 'delay' else 'loss' end as fault_type, o_totalprice as telemetry_bytes from orders""",
    "prediction": """select 'C' || o_orderkey::varchar as case_id, system,
        case when o_orderkey % m = 0 then ['svc-' || ((o_custkey + 1) % 6)::varchar, 'svc-' || (o_custkey % 6)::varchar, 'svc-' || ((o_custkey + 2) % 6)::varchar]
             else ['svc-' || (o_custkey % 6)::varchar, 'svc-' || ((o_custkey + 1) % 6)::varchar, 'svc-' || ((o_custkey + 2) % 6)::varchar] end as ranked_roots,
        (100 * m + o_orderkey % 50)::bigint as total_tokens, (o_orderkey % 7)::bigint as llm_calls, (o_orderkey % 11) / 2.0::double as latency_s, (o_orderkey % 10) / 10.0::double as confidence
        from orders, (values ('single', 2), ('sharded', 3), ('repaired', 4)) s(system, m)""",
    "opinion": """select 'case-' || (c_custkey // 5)::varchar as case_id, 'worker-' || (c_custkey % 5)::varchar as worker_id, c_custkey as k from customer""",
    "task": """select o_orderkey as row_id, 'task_' || (o_orderkey % 7 + 1)::varchar as task_index, date_trunc('day', o_orderdate) as day,
        case o_orderkey % 7 when 0 then ['time'] when 1 then ['reason'] when 2 then ['component'] when 3 then ['time', 'reason'] when 4 then ['time', 'component'] when 5 then ['component', 'reason'] else ['time', 'component', 'reason'] end as requested from orders""",
    "phased": """select m.*, case when m.ts < b.mid then 'pre' else 'post' end as phase from metric_long m
        join (select case_id, source, median(ts) as mid from metric_long group by all) b using (case_id, source)""",
    "moments": """select case_id, component, metric, source,
        count(value) filter (phase = 'pre') as pre_n, avg(value) filter (phase = 'pre') as pre_mean, var_samp(value) filter (phase = 'pre') as pre_var,
        min(value) filter (phase = 'pre') as pre_min, max(value) filter (phase = 'pre') as pre_max, min(ts) filter (phase = 'pre') as pre_first, max(ts) filter (phase = 'pre') as pre_last,
        count(value) filter (phase = 'post') as post_n, avg(value) filter (phase = 'post') as post_mean, var_samp(value) filter (phase = 'post') as post_var,
        min(value) filter (phase = 'post') as post_min, max(value) filter (phase = 'post') as post_max, min(ts) filter (phase = 'post') as post_first, max(ts) filter (phase = 'post') as post_last
        from phased group by all""",
    "welch": """select *, case when pre_n >= 2 and post_n >= 2 and se > 0 then delta / se when pre_n >= 2 and post_n >= 2 and delta = 0 then 0.0 end as t_stat,
        case when pre_n >= 2 and post_n >= 2 and se > 0 then (a + b) ** 2 / (a ** 2 / (pre_n - 1) + b ** 2 / (post_n - 1)) end as df,
        case when delta >= 0 then 'high' else 'low' end as direction, round(abs(delta) / (abs(pre_mean) + 1), 6) as magnitude
        from (select *, post_mean - pre_mean as delta, coalesce(pre_var, 0) / pre_n as a, coalesce(post_var, 0) / post_n as b, sqrt(coalesce(pre_var, 0) / pre_n + coalesce(post_var, 0) / post_n) as se
              from moments where pre_n > 0 and post_n > 0)""",
    "finding": """select case_id, case when metric in ('click', 'view') then 'metrics' when metric = 'error' then 'logs' when metric = 'purchase' then 'traces' else 'auxiliary' end as modality,
        component, metric as signal, direction, magnitude, round(abs(t_stat), 6) as score, post_first as window_start, metric || ':' || component as evidence_ptr from welch where t_stat is not null""",
    "component_total": """select case_id, component, round(sum(greatest(score, 0)), 6) as component_score from (
        select *, row_number() over (partition by case_id, component, modality order by score desc, signal, direction) as r from finding) where r <= 3 group by all""",
    "call": """select c.case_id, p.component as parent, c.component as child, count(*) as n from span c
        join (select * from (select *, row_number() over (partition by case_id, span_id order by start_ms, component) as r from span) where r = 1) p
          on c.case_id = p.case_id and c.parent_id = p.span_id where p.component <> c.component group by all""",
    "graph_edge": """select distinct case_id, src, dst from (
        select c.case_id, lower(p.service) as src, lower(c.service) as dst from span c join span p on c.case_id = p.case_id and c.parent_id = p.span_id) where src <> dst""",
    "symptoms": """select case_id, component as node from metric_long group by case_id, component having avg(value) > 50""",
    "scored": """select p.*, c.source, c.fault_type, c.true_root, c.telemetry_bytes, list_position(ranked_roots, true_root) as place,
        (ranked_roots[1] = true_root)::int as hit_at_1, (list_position(ranked_roots[1:3], true_root) is not null)::int as hit_at_3,
        case when list_position(ranked_roots, true_root) is null then 0.0 else 1.0 / list_position(ranked_roots, true_root) end as mrr
        from prediction p join cases c using (case_id)""",
}


def with_tables(sql: str) -> str:
    """``sql`` behind the definitions of the canonical tables it names, in an order that works."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in TABLES:
            if re.search(rf"\b{name}\b", text) and name not in order:
                need(TABLES[name])
                if name not in order:
                    order.append(name)

    need(sql)
    parts = [f"{n} as materialized ({TABLES[n]})" for n in order]
    if m := re.match(r"\s*with\s+(recursive\s+)?", sql, flags=re.I):
        return f"with {m[1] or ''}" + ", ".join([*parts, sql[m.end() :].strip()])
    return ("with " + ", ".join(parts) + " " if parts else "") + sql.strip()
