"""Every registered telemetry query against its SQL in DuckDB, over the smallest scale."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from rootloom.plans import catalog
from rootloom.plans.sql_tables import with_tables

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        v = list(v.asDict().values())
    if isinstance(v, dict):
        v = list(v.values())
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted(([plain(r[n]) for n in names] for r in df.collect()), key=repr)
    cur = duck.execute(catalog.ORACLES[name])
    at = [d[0] for d in cur.description]
    assert sorted(at) == names
    assert got == sorted(([plain(r[at.index(n)]) for n in names] for r in cur.fetchall()), key=repr)


NODES, WEIGHTS = np.polynomial.legendre.leggauss(300)


def integral_p(t, df):
    """P(|T| > t) by Gauss-Legendre over the angle whose tangent is t / sqrt(df)."""
    low, high = math.atan(abs(t) / math.sqrt(df)), math.pi / 2
    angle = low + (high - low) * (NODES + 1) / 2
    log = (df - 1) * np.log(np.cos(angle)) + math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - math.log(math.pi) / 2
    return float(2 * (high - low) / 2 * (WEIGHTS * np.exp(log)).sum())


def brute_findings(duck, source, keys, limit=None):
    """Rows (keys, direction, magnitude, score) by case from Welch tests in plain numbers; source: SQL of phased values."""
    found = {}
    for *key, phase, values in duck.execute(f"select {', '.join(keys)}, phase, list(value) from ({source}) where value is not null group by all").fetchall():
        found.setdefault(tuple(key), {})[phase] = np.array(values)
    cases = {}
    for key, phases in found.items():
        if len(phases) < 2:
            continue
        pre, post = phases["pre"], phases["post"]
        delta, p = post.mean() - pre.mean(), 1.0
        if len(pre) > 1 and len(post) > 1:
            a, b = pre.var(ddof=1) / len(pre), post.var(ddof=1) / len(post)
            if a + b > 0:
                p = max(integral_p(delta / math.sqrt(a + b), (a + b) ** 2 / (a**2 / (len(pre) - 1) + b**2 / (len(post) - 1))), 1e-300)
            elif abs(delta) > 0:
                p = 1e-300
        cases.setdefault(key[0], []).append((p, key, "high" if delta >= 0 else "low", abs(delta) / (abs(pre.mean()) + 1)))
    rows = []
    for items in cases.values():
        items.sort(key=lambda x: (x[0], x[1]))
        least, q = 1.0, [0.0] * len(items)
        for i in range(len(items) - 1, -1, -1):
            least = min(least, items[i][0] * len(items) / (i + 1))
            q[i] = max(least, 1e-300)
        scored = [(round(max(0.0, -math.log10(x)), 6), round(m, 6), key, direction) for x, (_, key, direction, m) in zip(q, items)]
        scored.sort(key=lambda x: (-x[0], -x[1], x[2]))
        rows += scored[:limit]
    return {key: (direction, pytest.approx(m, abs=2e-6), pytest.approx(score, abs=2e-5)) for score, m, key, direction in rows}


METRICS = "select case_id, component, metric, value, phase from phased"
SPANS = """select case_id, component, call_type as metric, elapsed as value, case when start_ms / 1e3 < mid then 'pre' else 'post' end as phase from span join (select case_id, median(start_ms / 1e3) as mid from span group by case_id) using (case_id)"""
KEYS = ["case_id", "component", "metric"]


@pytest.fixture(scope="module")
def telemetry(duck):
    for name in ("metric_long", "phased", "span"):
        duck.execute(f"create table if not exists {name} as {with_tables(f'select * from {name}')}")
    return duck


def test_p_values_are_integrals(spark):
    rows = [r for r in catalog.QUERIES["welch_pvalue"](spark, DATA).collect()]
    known = [r for r in rows if r["df"] is not None]
    assert len(known) > 50 and all(r["p_value"] == pytest.approx(max(integral_p(r["t_stat"], r["df"]), 1e-300), rel=1e-6) for r in known)
    assert all(r["p_value"] in (1.0, 1e-300) for r in rows if r["df"] is None)


@pytest.mark.parametrize(("name", "source"), [("metric_findings", METRICS), ("trace_findings_shift", SPANS)])
def test_findings_are_those_of_plain_numbers(spark, telemetry, name, source):
    got = {tuple(r[k] for k in KEYS): (r["direction"], r["magnitude"], r["score"]) for r in catalog.QUERIES[name](spark, DATA).collect()}
    want = brute_findings(telemetry, source, KEYS, 20)
    assert got == want and len(got) > 20


def test_mined_findings_and_the_serial_reader(spark, telemetry):
    rows = catalog.QUERIES["mine_by_modality"](spark, DATA).collect()
    for modality, source in (("metrics", METRICS), ("traces", SPANS)):
        got = {(r["case_id"], r["component"], r["signal"]): (r["direction"], r["magnitude"], r["score"]) for r in rows if r["modality"] == modality}
        assert got == brute_findings(telemetry, source, KEYS)
    logs = catalog.QUERIES["log_pattern_shift"](spark, DATA).collect()
    assert sorted((r["case_id"], r["component"], r["signal"], r["score"]) for r in rows if r["modality"] == "logs") == sorted((r["case_id"], r["component"], r["template"], r["score"]) for r in logs)
    # The serial reader: each miner's 30 best of a case, three best of a component and modality, five components, their shares.
    sums = {}
    for case in {r["case_id"] for r in rows}:
        kept = []
        for modality in ("metrics", "traces", "logs"):
            own = sorted((r for r in rows if r["case_id"] == case and r["modality"] == modality), key=lambda r: (-r["score"], -r["magnitude"] if modality != "logs" else 0, r["component"], r["signal"]))
            kept += own[:30]
        for key in {(r["component"], r["modality"]) for r in kept}:
            best = sorted((r["score"] for r in kept if (r["component"], r["modality"]) == key), reverse=True)[:3]
            sums[case, key[0]] = sums.get((case, key[0]), 0.0) + sum(best)
    for case in {c for c, _ in sums}:
        top = sorted(((-round(s, 6), c) for (k, c), s in sums.items() if k == case))[:5]
        total = -sum(s for s, _ in top)
        got = sorted((r["rank"], r["component"], r["component_score"], r["confidence"]) for r in catalog.QUERIES["serial_read"](spark, DATA).where(F.col("case_id") == case).collect())
        assert [(k, c) for k, c, _, _ in got] == [(k + 1, c) for k, (_, c) in enumerate(top)]
        assert all(s == pytest.approx(-x, abs=1e-4) and conf == pytest.approx(min(0.95, max(0.05, -x / total)), abs=1e-4) for (_, _, s, conf), (x, _) in zip(got, top))


@pytest.mark.parametrize("name", ["ensemble", "stacked"])
def test_classifiers_learn_held_out_rows(spark, name):
    from rootloom.operators import models
    from rootloom.plans.check_queries import model_rows

    train, rest, views = model_rows(spark, DATA)
    # Labels that a statistic decides: forests of a few trees must find them on rows they haven't seen.
    rule = {"root1": "feature0__mean > 0", "root2": "feature1__max > 0.15", "root3": "feature2__slope > 0"}
    train, rest = (df.withColumns({r: F.expr(f"cast({e} as int)") for r, e in rule.items()}).cache() for df in (train, rest))
    small = {"seeds": (1, 2), "trees": 15, "share": 1.0}
    few = {"level": ["feature0__mean", "feature1__max"], "dynamics": ["feature2__slope", "feature0__mean"]}
    assert all(set(columns) <= {*views["level"], *views["dynamics"]} for columns in few.values()) and len(views["level"]) + len(views["dynamics"]) == 112
    if name == "ensemble":
        out = models.ensemble_classifier(train, rest, [*few["level"], "feature2__slope"], **small)
    else:
        out = models.stacked_adjudicator(train, rest, few, folds=2, **small)
    rows = out.join(rest.select("sample_index", *rule), "sample_index").collect()
    assert len(rows) == rest.count() and all(0 <= r[f"p_{c}"] <= 1 for r in rows for c in rule)
    for c in rule:
        right = np.mean([(r[f"p_{c}"] >= 0.5) == (r[c] == 1) for r in rows])
        assert right > max(np.mean([r[c] for r in rows]), 1 - np.mean([r[c] for r in rows])) + 0.05, (c, right)


def interval(values, reps=1000):
    """Ends of a percentile bootstrap with the library's keyed draws, each group whole in numpy."""
    from rootloom.operators.bootstrap import counts_of

    different, counts = np.unique(np.array([v for v in values if v is not None], float), return_counts=True)
    means = np.zeros(reps)
    for place, drawn in counts_of(np.full(reps, counts.sum()), counts, 7, 0):
        means += different[place] * drawn / counts.sum()
    ordered = np.sort(means)
    return round(ordered[int(0.025 * reps)], 6), round(ordered[min(reps - 1, int(0.975 * reps))], 6)


def test_bootstrap_queries_over_their_whole_results(spark, telemetry):
    telemetry.execute(f"create table if not exists cases_t as {with_tables('select * from cases')}")
    telemetry.execute(f"create table if not exists scored_t as {with_tables('select * from scored')}")
    got = {r["fault_type"]: r for r in catalog.QUERIES["bootstrap_ci"](spark, DATA).collect()}
    want = dict(telemetry.execute("select fault_type, list(telemetry_bytes) from cases_t group by all").fetchall())
    assert set(got) == set(want)
    for kind, values in want.items():
        low, high = interval(values)
        assert (got[kind]["n"], got[kind]["mean"]) == (len(values), pytest.approx(np.mean([float(v) for v in values]), abs=1e-5))
        assert (got[kind]["low"], got[kind]["high"]) == (pytest.approx(low, abs=1e-5), pytest.approx(high, abs=1e-5)) and got[kind]["low"] < got[kind]["mean"] < got[kind]["high"]
    rows = catalog.QUERIES["aggregate_ci"](spark, DATA).collect()
    found = {(r["system"], r["metric"]): (r["low"], r["high"]) for r in rows}
    assert len(rows) == len(found) == 6
    for system, latency, hits in telemetry.execute("select system, list(latency_s), list(hit_at_1) from scored_t group by all").fetchall():
        assert found[system, "latency_s"] == pytest.approx(interval(latency), abs=1e-5)
        n, p, z = len(hits), sum(hits) / len(hits), 1.959963984540054
        centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
        assert found[system, "hit_at_1"] == pytest.approx((centre - half, centre + half), abs=2e-6)


@pytest.mark.parametrize("name", ["ensemble_classifier", "stacked_adjudicator"])
def test_registered_classifiers_run_at_full_size(spark, name):
    from rootloom.plans.check_queries import model_rows

    rows = catalog.QUERIES[name](spark, DATA).collect()
    held_out = {r["sample_index"] for r in model_rows(spark, DATA)[1].select("sample_index").collect()}
    assert {r["sample_index"] for r in rows} == held_out and len(rows) == len(held_out)
    shares = np.array([[r["p_root1"], r["p_root2"], r["p_root3"]] for r in rows])
    assert (shares > 0).all() and (shares < 1).all() and len(np.unique(shares.round(6), axis=0)) > len(rows) // 2
