"""The cache of incidents, and the weight fit, on small tables worked out in plain Python."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from rootloom.operators import weight_fit
from rootloom.sources import prepared

SPANS = "span_id long, parent_id long, component string, service string, ds_name string, call_type string, start_ms double, elapsed double, success string"
METRICS = "source string, component string, metric string, time_ms double, value double"
DAY = 86_400_000


def test_a_cache_is_whole_or_refused(spark, tmp_path):
    metrics = [("m", "a", "cpu", 0.0, 1.0), ("m", "a", "cpu", 10.0, 3.0), ("m", "a", "cpu", DAY - 1.0, None), ("m", "b", "cpu", DAY + 5.0, 9.0), ("m", "b", "cpu", None, 4.0)]
    spans = [(1, None, "x", "s", None, "RPC", 5.0, 2.0, "true"), (2, 1, "y", "s", None, "RPC", 6.0, 4.0, "False"), (3, 2, "y", "s", None, "RPC", 50.0, 8.0, "true")]
    windows = spark.createDataFrame([(1, 0.0, 10.0), (2, 0.0, 60.0), (3, 9.0 * DAY, 9.0 * DAY + 1)], "row_id long, start_ms double, end_ms double")
    catalog = spark.createDataFrame([("/a.csv", 3), ("/b.csv", 4)], "path string, bytes long")
    mark, at = prepared.source_mark(catalog, windows), str(tmp_path / "whole")
    prepared.prepare(spark.createDataFrame(metrics, METRICS), spark.createDataFrame(spans, SPANS), windows, at, mark)
    parts = prepared.open_prepared(spark, at, mark)
    rows = lambda part, *cols: sorted(tuple(r) for r in parts[part].select(*cols).collect())
    assert rows("metric", "row_id", "time_ms", "value") == [(1, 0.0, 1.0), (1, 10.0, 3.0), (2, 0.0, 1.0), (2, 10.0, 3.0)]
    assert rows("trace", "row_id", "span_id") == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]
    assert rows("metric_stats", "date_key", "component", "n", "mean", "p05") == [("1970-01-01", "a", 2, 2.0, pytest.approx(1.1))]
    assert rows("trace_summary", "row_id", "component", "n", "median_elapsed", "failures") == [(1, "x", 1, 2.0, 0), (1, "y", 1, 4.0, 1), (2, "x", 1, 2.0, 0), (2, "y", 2, 6.0, 1)]
    assert rows("trace_edges", "row_id", "parent", "child", "n") == [(1, "x", "y", 1), (2, "x", "y", 1)]
    assert rows("volume", "row_id", "metric_rows", "trace_rows", "total_rows", "volume_bin") == [(1, 2, 2, 4, "middle"), (2, 2, 3, 5, "high"), (3, 0, 0, 0, "low")]

    for other in (prepared.source_mark(catalog.withColumn("bytes", F.col("bytes") + 1), windows), prepared.source_mark(catalog, windows.where("row_id < 3"))):
        with pytest.raises(prepared.StaleCache):
            prepared.open_prepared(spark, at, other)
    with pytest.raises(prepared.StaleCache):
        prepared.open_prepared(spark, str(tmp_path / "none"), mark)
    next(iter((tmp_path / "whole" / "trace").rglob("*.parquet"))).unlink()
    with pytest.raises(prepared.StaleCache):
        prepared.open_prepared(spark, at, mark)


def test_a_cache_of_nothing_can_be_read(spark, tmp_path):
    windows = spark.createDataFrame([], "row_id long, start_ms double, end_ms double")
    prepared.prepare(spark.createDataFrame([], METRICS), spark.createDataFrame([], SPANS), windows, str(tmp_path / "e"), "m")
    assert {k: v.count() for k, v in prepared.open_prepared(spark, str(tmp_path / "e"), "m").items()} == dict.fromkeys(prepared.PARTS, 0)


def brute_fit(evidence, coverage, onsets, truth, grid):
    """Scores of each setting, case by case; a re-ranking sorts a list anew and leaves equals in their order."""
    plain = {"metrics": 1.0, "logs": 1.15, "traces": 1.15, "events": 1.05, "auxiliary": 0.8}
    out = []
    for trial, (boost, gamma, beta) in enumerate([(None, 0.0, 0.0), *grid]):
        weights = plain if boost is None else {"metrics": 1.0, "logs": boost, "traces": boost, "events": 1 + (boost - 1) / 2, "auxiliary": 0.8}
        scores = {"dev": [], "val": []}
        for case, root, split in truth:
            sums = {}
            for c, name, modality, support, refute, rank in evidence:
                if c == case and name.strip():
                    key = name.strip().lower()
                    sums[key] = sums.get(key, 0.0) + (support - refute) * weights[modality] / math.sqrt(max(rank, 1))
            ranked = sorted(((round(s, 6), k) for k, s in sums.items()), key=lambda x: (-x[0], x[1]))[:5]
            for gain, table in ((gamma, coverage), (beta, onsets)):
                mine = {k: v for (c, k), v in table.items() if c == case}
                if gain > 0 and mine:
                    ranked = sorted(((s * (1 + gain * mine.get(k, 0.0)), k) for s, k in ranked), key=lambda x: -x[0])
                    ranked = [(round(s, 6), k) for s, k in ranked]
            names = [k.replace("_", "-") for _, k in ranked]
            want = root.strip().lower().replace("_", "-")
            scores[split].append(1 / (names.index(want) + 1) if want in names else 0.0)
        mean = lambda v: round(sum(v) / len(v), 4) if v else 0.0
        out.append((trial, *[x for s in ("dev", "val") for x in (len(scores[s]), mean([float(r == 1) for r in scores[s]]), mean(scores[s]))]))
    return out


def test_weights_are_chosen_on_dev_cases_alone(spark):
    import random

    draw = random.Random(5)
    names = ["svc-a", "SVC-B ", "svc_c", "svc-d", "svc-e", "svc-f", "svc-g"]
    evidence = [(f"c{k}", n, m, draw.randint(0, 8) / 4, draw.choice([0.0, 0.0, 1.0]), draw.randint(1, 6)) for k in range(14) for n in names for m in ("metrics", "logs", "events", "auxiliary") if draw.random() < 0.6]
    evidence.append(("c0", "  ", "logs", 99.0, 0.0, 1))
    low = [n.strip().lower() for n in names]
    coverage = {(f"c{k}", n): draw.randint(0, 4) / 4 for k in range(9) for n in low if draw.random() < 0.8}
    onsets = {(f"c{k}", n): draw.randint(0, 4) / 4 for k in range(4, 14) for n in low if draw.random() < 0.8}
    truth = [(f"c{k}", draw.choice([" Svc-A", "svc-b", "svc-c", "svc-d"]), "val" if k % 3 == 2 else "dev") for k in range(16)]
    boosts, gammas, betas = (1.0, 2.0), (0.0, 2.0), (0.0, 1.0, 8.0)
    factor = lambda table, of: spark.createDataFrame([(c, n, v) for (c, n), v in table.items()], f"case_id string, component string, {of} double")
    rows = weight_fit.fit_additive(
        spark.createDataFrame(evidence, "case_id string, component string, modality string, support_score double, refute_score double, local_rank int"),
        factor(coverage, "coverage"), factor(onsets, "precedence"), spark.createDataFrame(truth, "case_id string, true_root string, split string"), boosts, gammas, betas,
    ).orderBy("trial").collect()
    want = brute_fit(evidence, coverage, onsets, truth, list(itertools.product(boosts, gammas, betas)))
    assert [(r["trial"], r["dev_n"], r["dev_hit_at_1"], r["dev_mrr"], r["val_n"], r["val_hit_at_1"], r["val_mrr"]) for r in rows] == [pytest.approx(w) for w in want]
    assert len({w[1:] for w in want}) > 3
    chosen = min(want, key=lambda w: (-w[2], -w[3], w[0]))[0]
    assert [r["trial"] for r in rows if r["chosen"]] == [chosen]


def test_quantiles_of_sorted_and_of_bracketed_groups_agree(spark):
    import numpy as np

    from rootloom.operators.order_stats import group_quantiles

    rnd = np.random.default_rng(2)
    groups = {"a": rnd.normal(size=900).round(1).tolist(), "b": rnd.normal(size=40).tolist(), "c": [2.0], "d": [1.0] * 300}
    rows = [(k, v) for k, values in groups.items() for v in [*values, None]] + [(None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for whole in (10_000, 299, 10, 0):  # all sorted, some, all bracketed
        got = {r["k"]: (r["m"], r["high"]) for r in group_quantiles(df, ["k"], F.col("v"), {"m": 0.5, "high": 0.9}, whole).collect()}
        assert got == {k: (pytest.approx(np.quantile(v, 0.5)), pytest.approx(np.quantile(v, 0.9))) for k, v in groups.items()}


def test_groups_of_trace_summaries_are_sorted_by_a_number(spark):
    from rootloom.operators.findings import trace_summary

    rows = [(1, "x", None, 5.0, 2.0, "FAIL"), (1, "x", None, 4.0, 2.0, "true"), (1, "x", "", 6.0, None, "0"), (2, None, None, 7.0, 9.0, None)]
    df = spark.createDataFrame(rows, "row_id long, component string, service string, start_ms double, elapsed double, success string")
    out = trace_summary(df, ["row_id", "component", "service"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate(key=[_k" in plan and "to_json" not in plan and "SortAggregate(key=[_g" not in plan
    got = {tuple(r)[:3]: (r["n"], r["median_elapsed"], r["max_start"], r["failures"]) for r in out.collect()}
    assert got == {(1, "x", None): (2, 2.0, 4.0, 1), (1, "x", ""): (1, None, 6.0, 1), (2, None, None): (1, 9.0, 7.0, 0)}
