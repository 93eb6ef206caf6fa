"""Known values and invariants of the telemetry operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rootloom.functions.student_t import two_sided
from rootloom.operators import evaluation, findings, fusion, graph, time_ops


def test_student_t_known_values():
    # Closed forms: one degree of freedom is the Cauchy distribution, two have sqrt.
    t = np.array([0.0, 0.5, 1.0, 3.0, 12.0])
    assert np.allclose(two_sided(t, np.ones(5)), 1 - 2 / math.pi * np.arctan(t), rtol=1e-10)
    assert np.allclose(two_sided(t, np.full(5, 2.0)), 1 - t / np.sqrt(2 + t * t), rtol=1e-9)
    assert np.allclose(two_sided(np.array([1.96]), np.array([1e9])), 0.0499957, rtol=1e-4)
    assert two_sided(np.array([np.inf, np.nan]), np.array([5.0, 5.0])).tolist() == [1e-300, 1.0]


def test_top_finding_is_the_shifted_component(spark):
    rows = [("c", s, "cpu", "m", float(t), (1.0 if s != "adservice" or t < 30 else 9.0) + 0.01 * (t % 5)) for s in ("adservice", "cart", "frontend") for t in range(60)]
    df = spark.createDataFrame(rows, "case_id string, component string, metric string, source string, ts double, value double")
    phased = time_ops.phase_split(df, ["case_id", "source"])
    top = findings.metric_findings(phased, ["case_id", "component", "metric", "source"], ["case_id"], 5).orderBy(F.col("score").desc(), F.col("magnitude").desc()).first()
    assert (top["component"], top["metric"], top["direction"]) == ("adservice", "cpu", "high")


def test_window_extract_counts(spark):
    from rootloom.sources.files import window_extract

    df = spark.range(10).select(F.col("id").cast("double").alias("ts"))
    assert window_extract(df, 3.0, 5.0).count() == 3


def test_challenge_score(spark):
    df = spark.createDataFrame([(1, 1, 0, 1, 0, 0), (1, 0, 0, 0, 0, 1)], "root1 int, root2 int, root3 int, p_root1 int, p_root2 int, p_root3 int")
    assert [r["challenge_score"] for r in evaluation.challenge_score(df).collect()] == [0.5, -1.0]


def test_mcnemar_seven_to_none(spark):
    df = spark.createDataFrame([(0.0, 1.0)] * 7 + [(1.0, 1.0)] * 3, "baseline double, treatment double")
    r = evaluation.mcnemar(df).first()
    assert (r["treatment_only"], r["p_value"]) == (7, 0.015625)


def test_gain_of_zero_changes_no_order(spark):
    df = spark.createDataFrame([("c", "a", 3.0), ("c", "b", 2.0), ("c", "d", 1.0)], "case_id string, component string, score double")
    factors = spark.createDataFrame([("b", 1.0)], "component string, coverage double")
    order = lambda g: [r["component"] for r in fusion.rerank(df, factors, "coverage", g, ["component"]).orderBy("rank").collect()]
    assert order(0.0) == ["a", "b", "d"] and order(2.0) == ["b", "a", "d"]


def reach(edges, starts):
    """{(start, node): least steps} by plain breadth-first search."""
    out, ways = {}, {}
    for a, b in edges:
        ways.setdefault(a, []).append(b)
    for s in starts:
        seen, front = {s: 0}, [s]
        while front:
            front = [y for x in front for y in ways.get(x, []) if y not in seen and not seen.update({y: seen[x] + 1})]
        out |= {(s, n): h for n, h in seen.items()}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_searches_of_random_graphs(spark, seed):
    rnd = np.random.default_rng(seed)
    graphs = {c: {(f"n{a}", f"n{b}") for a, b in rnd.integers(0, 25, (10 * c + 8, 2))} | {(f"p{k}", f"p{k + 1}") for k in range(11)} | {("n3", "p0"), ("p11", "p0") if seed % 2 else ("p11", "n5")} for c in range(3)}
    edges = spark.createDataFrame([(c, a, b) for c, e in graphs.items() for a, b in e], "case_id int, src string, dst string")
    nodes = {c: sorted({x for e in g for x in e} | {"lone"}) for c, g in graphs.items()}
    starts = spark.createDataFrame([(c, n) for c in graphs for n in nodes[c][::2]], "case_id int, node string")
    got = {(r["case_id"], r["start"], r["node"]): r["hop"] for r in graph.hops(edges, starts).collect()}
    assert got == {(c, *k): h for c in graphs for k, h in reach(graphs[c], nodes[c][::2]).items()}
    symptoms = spark.createDataFrame([(c, f" {n.upper()}") for c in graphs for n in nodes[c][::3]] * 2, "case_id int, node string")
    got = {(r["case_id"], r["node"]): r["coverage"] for r in graph.explanatory_coverage(edges, symptoms).collect()}
    for c, g in graphs.items():
        pairs = reach(g, nodes[c][::3])
        for n in {x for e in g for x in e}:
            assert got.pop((c, n)) == round(sum((s, n) in pairs for s in nodes[c][::3]) / len(nodes[c][::3]), 6)
    assert not got


def test_long_chains_and_many_symptoms(spark):
    chain = spark.range(5000).select(F.lit(1).alias("case_id"), F.format_string("n%05d", "id").alias("src"), F.format_string("n%05d", F.col("id") + 1).alias("dst"))
    symptoms = spark.range(0, 5000, 25).select(F.lit(1).alias("case_id"), F.format_string("n%05d", "id").alias("node"))
    got = {r["node"]: r["coverage"] for r in graph.explanatory_coverage(chain, symptoms).collect()}
    assert len(got) == 5001 and all(got[f"n{k:05d}"] == round((k // 25 + 1 if k < 5000 else 200) / 200, 6) for k in range(5001))
    short = chain.where("src < 'n00700'")
    rows = graph.hops(short, graph.graph_nodes(short)).groupBy().agg(F.count("*").alias("n"), F.sum(F.col("hop")).alias("s"), F.max("hop").alias("m")).first()
    assert (rows["n"], rows["s"], rows["m"]) == (701 * 702 // 2, sum(k * (701 - k) for k in range(701)), 700)


def test_cycles_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string").withColumn("case_id", F.lit(1))
    got = {(r["start"], r["node"]) for r in graph.ancestors(edges, spark.createDataFrame([(1, "a"), (1, "d")], "case_id int, node string")).collect()}
    assert got == {("a", "b"), ("a", "c"), ("d", "a"), ("d", "b"), ("d", "c")}


def test_coverage(spark):
    edges = spark.createDataFrame([("front", "cart"), ("cart", "db")], "src string, dst string").withColumn("case_id", F.lit(1))
    got = {r["node"]: r["coverage"] for r in graph.explanatory_coverage(edges, spark.createDataFrame([(1, "front"), (1, "cart")], "case_id int, node string")).collect()}
    assert got == {"front": 0.5, "cart": 1.0, "db": 1.0}


def test_no_variance_is_an_infinite_shift(spark):
    rows = [("c", "a", "m", "s", "pre", float(i), 1.0) for i in range(3)] + [("c", "a", "m", "s", "post", float(i), 2.0) for i in range(3)]
    df = spark.createDataFrame(rows, "case_id string, component string, metric string, source string, phase string, ts double, value double")
    r = findings.with_p_values(findings.shift_findings(findings.prepost_moments(df, ["case_id", "component", "metric", "source"]))).first()
    assert r["t_infinite"] and r["t_stat"] is None and r["p_value"] == 1e-300


@pytest.mark.parametrize(("name", "want"), [("a_b_cpu", ("a_b", "cpu")), ("plain", ("plain", "")), ("svc_x_container-cpu", ("svc", "x_container-cpu"))])
def test_split_metric_name(spark, name, want):
    r = spark.range(1).select(time_ops.split_metric_name(F.lit(name)).alias("s")).first()["s"]
    assert (r["component"], r["metric"]) == want


def test_interval_join_repeats_rows_in_overlapping_windows(spark):
    rows = spark.createDataFrame([(float(t),) for t in (0, 50, 100, 150)], "time_ms double")
    windows = spark.createDataFrame([(1, 0, 100), (2, 50, 150)], "row_id int, start_ms long, end_ms long")
    got = sorted((r["row_id"], r["time_ms"]) for r in graph.window_interval_join(rows, windows, bucket_ms=40).collect())
    assert got == [(1, 0.0), (1, 50.0), (1, 100.0), (2, 50.0), (2, 100.0), (2, 150.0)]


def test_files(spark, tmp_path):
    from rootloom.sources import files

    (tmp_path / "metrics").mkdir()
    (tmp_path / "metrics" / "a.csv").write_text("ts,value\n1,2\n")
    (tmp_path / "x.log").write_text("hello")
    catalog = files.file_catalog(spark, str(tmp_path), hashed=True)
    assert sorted((r["bytes"], r["modality"]) for r in catalog.collect()) == [(5, "logs"), (13, "metrics")]
    assert files.file_manifest(catalog).first()["files"] == 2
    assert files.stale_manifest(catalog, catalog.withColumn("sha256", F.lit("z"))).count() == 2
    with pytest.raises(ValueError, match="scoring_points"):
        files.scan_tasks(spark.createDataFrame([(1, "x")], "task_index int, instruction string"))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 11, 5000, 30001])
def test_group_median_and_order_statistic(spark, n):
    from rootloom.operators.order_stats import group_median, group_quantiles, order_statistic

    rng = np.random.default_rng(n)
    values = np.round(rng.normal(size=n) * 100, 1 if n < 100 else 3)
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0), ("b", None)], "k string, x double")
    got = {r["k"]: r["median"] for r in group_median(df, ["k"], F.col("x")).collect()}
    assert got == {"a": pytest.approx(float(np.median(values)), abs=1e-12), "b": 1.0}
    shares = {"a": 0.05, "b": 0.15, "c": 0.9, "d": 0.95, "e": 1.0}
    found = {r["k"]: r for r in group_quantiles(df, ["k"], F.col("x"), shares).collect()}
    assert all(found["a"][c] == pytest.approx(float(np.quantile(values, q)), abs=1e-9) and found["b"][c] == 1.0 for c, q in shares.items())
    assert order_statistic(df.where("k = 'a'"), "x", 0.5, before=True) == np.sort(values)[max((n + 1) // 2 - 1, 0)]
    for share in (0.0, 0.05, 0.5, 0.8, 1.0):
        assert order_statistic(df.where("k = 'a'"), "x", share) == np.sort(values)[min(int(n * share), n - 1)]


def test_ranks(spark):
    from rootloom.operators.order_stats import hash_rank, range_rank

    df = spark.range(3000).select((F.col("id") % 2).alias("k"), F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") * 7 % 1000).cast("double").alias("x"))
    rows = hash_rank(range_rank(df, ["k"], ["x"], "i"), ["k"], "h", [], "r").toPandas()
    for _, g in rows.groupby("k"):
        assert (g.sort_values("h").r.to_numpy() == np.arange(1, len(g) + 1)).all()
        assert sorted(g.i) == list(range(len(g))) and g.sort_values("i").x.is_monotonic_increasing


def test_leaks_of_any_depth_and_name(spark):
    from rootloom.operators import knowledge

    deep = '{"isTargetRootCause":1}'
    for _ in range(14):
        deep = '{"a":[' + deep + "]}"
    raws = ['{"edges":[{"label":"targetRootCause"}]}', '{"gold_answer":{"x":"y"}}', '{"answer":"a","rootCauseLabel":"b","list":["groundTruth"]}', deep, "no json", None]
    df = spark.createDataFrame(list(enumerate(raws)), "case_id long, raw string")
    got = {(r["case_id"], r["path"], r["kind"]) for r in knowledge.leakage_audit(df).collect()}
    assert got == {(0, "edges[0].label", "answer_marker"), (1, "gold_answer", "answer_key"), (3, ".".join(["a[0]"] * 14) + ".isTargetRootCause", "answer_key")}
    props = spark.createDataFrame([({"label": "targetRootCause", "Gold Answer": "x", "answer": "stays", "title": "t"},)], "props map<string,string>")
    assert knowledge.sanitize_props(props).first()["props"] == {"answer": "stays", "title": "t"}


def test_documents_are_clean_at_any_depth(spark):
    import json

    from rootloom.operators import knowledge

    squeeze = lambda v: "".join(c.lower() for c in str(v) if c.isalnum())

    def clean(v):
        if isinstance(v, dict):
            return {k: clean(x) for k, x in v.items() if squeeze(k) not in knowledge.FORBIDDEN_KEYS and (isinstance(x, (dict, list)) or squeeze(x) not in knowledge.FORBIDDEN_VALUES)}
        return [clean(x) for x in v] if isinstance(v, list) else v

    deep = {"isRootCause": True, "a/b": 1}
    for k in range(9):
        deep = {"x": [k, deep, {"label": "targetRootCause", "y\"z": [[], {}, [[{"goldAnswer": []}]]]}]}
    docs = [{"n": {"mark": "goldAnswer"}}, {"groundTruth": "x"}, deep, [[{"correct-answer": 1}], 2, None, "groundTruth", {"k": None, "t": True, "f": 1.5}], {"fine": [1, {"groundwater": "x"}]}, {"isTargetRootCause": {"a": [1]}}, [{"label": "Gold Answer"}] * 12]
    raws = [json.dumps(d) for d in docs] + ["no json", None, '"groundTruth"', json.dumps(docs[0])]
    df = spark.createDataFrame([(k, r, "x") for k, r in enumerate(raws)], "doc long, raw string, at string")
    got = {r["doc"]: r["raw"] for r in knowledge.sanitize_json(df, "raw").collect()}
    assert len(got) == len(raws) and got[7] == "no json" and got[8] is None and got[9] == '"groundTruth"' and got[4] == raws[4]
    assert all(json.loads(got[k]) == clean(json.loads(raws[k])) for k in (*range(7), 10))
    again = spark.createDataFrame([(k, v) for k, v in got.items()], "case_id long, raw string")
    assert knowledge.leakage_audit(again).count() == 0
    props = spark.createDataFrame([({"a": raws[0], "groundTruth": "y", "b": "[x", "c": None},), (None,), ({},)], "props map<string,string>")
    assert [r["props"] for r in knowledge.sanitize_props(props).collect() if r["props"]] == [{"a": '{"n":{}}', "b": "[x", "c": None}]
    assert knowledge.sanitize_props(props).count() == 3


def test_assignments_are_the_best_and_first_of_all():
    import itertools
    import time

    from rootloom.operators.scoring import assignment

    rnd = np.random.default_rng(4)
    for n in (1, 2, 3, 4, 5, 6, 7, 8):
        for _ in range(20 if n < 7 else 3):
            gains = rnd.integers(0, 4, (n, n)).tolist()
            best = max(itertools.permutations(range(n)), key=lambda p: (sum(gains[i][j] for i, j in enumerate(p)), [-j for j in p]))
            assert assignment(gains) == list(best)
    start = time.time()
    assert sorted(assignment(rnd.integers(0, 4, (60, 60)).tolist())) == list(range(60))
    assert time.time() - start < 2


@pytest.fixture
def many_ranges(spark):
    """Small tables stay in as many partitions as large ones have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranks_of_equal_rows_over_many_ranges(spark, many_ranges):
    from rootloom.operators.order_stats import by_ranges, range_rank

    df = spark.range(4000).select(F.when(F.col("id") < 3600, "hot").when(F.col("id") < 3990, "other").alias("k"), F.when(F.col("id") % 3 > 0, F.lit(1.5)).alias("x"), F.lit("same").alias("y"))
    hot = by_ranges(df, ["k"], ["x"]).where("k = 'hot'").groupBy("_part").count().collect()
    assert len(hot) > 1
    for key, g in range_rank(df, ["k"], ["x"], "i").toPandas().groupby("k", dropna=False):
        g = g.sort_values("i")
        assert list(g.i) == list(range(len(g))) and g.x.isna().tolist() == sorted(g.x.isna().tolist(), reverse=True)


def test_statistics_of_one_long_series(spark, many_ranges):
    rnd = np.random.default_rng(8)
    v = np.cumsum(rnd.normal(size=5000))
    rows = [(1, "a", int(t), float(x)) for t, x in enumerate(v)] + [(1, "b", 3, 2.0), (1, "b", 4, float("nan")), (2, "a", 0, 1.0), (2, "a", 5, 4.0), (2, "b", 1, None)]
    df = spark.createDataFrame(rows, "sample_index int, feature string, t int, value double").repartition(4)
    got = {(r["sample_index"], r["feature"]): r for r in findings.kpi_features(df).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "a")}
    for key, x in (((1, "a"), v), ((1, "b"), np.array([2.0])), ((2, "a"), np.array([1.0, 4.0]))):
        d, i = np.diff(x), np.arange(len(x))
        q = np.quantile(x, [0.25, 0.5, 0.75])
        slope = ((i - i.mean()) * x).sum() / ((i - i.mean()) ** 2).sum() if len(x) > 1 else 0.0
        want = (x.mean(), x.min(), x.max(), q[1], q[0], q[2], x[0], x[-1], x.std(), q[2] - q[0], x.max() - x.min(), np.abs(d).mean() if len(d) else 0.0, d.std() if len(d) else 0.0, slope)
        assert [got[key][s] for s in findings.STATS] == pytest.approx(want, abs=1e-9), key


def test_archives_are_listed_by_their_directories(spark, tmp_path):
    import zipfile

    from rootloom.sources import readiness

    want = {}
    for name, members, comment in (("a", 3, b""), ("b", 0, b""), ("c", 3000, b"PK\\x05 not the end" * 9), ("sub/d", 1, b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.comment = comment
            for k in range(members):
                z.writestr(f"ordner/é_{k}.csv", "x" * (k % 50))
        want[name.rsplit("/", 1)[-1]] = sorted((f"ordner/é_{k}.csv", k % 50) for k in range(members)) or [(None, None)]
    with zipfile.ZipFile(tmp_path / "wide.zip", "w") as z, z.open("big.csv", "w", force_zip64=True) as f:
        f.write(b"abc")
    want["wide"] = [("big.csv", 3)]
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    (tmp_path / "empty.zip").write_bytes(b"")
    want |= {"bad": [(None, None)]}
    got = {}
    for r in readiness.zip_members(spark, f"file://{tmp_path}").collect():
        got.setdefault(r["path"].rsplit("/", 1)[-1][:-4], []).append((r["member"], r["bytes"]))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}


def test_a_dataset_with_a_missing_pair_isnt_ready(spark):
    from rootloom.sources import readiness

    paths = spark.createDataFrame([("/x/1/platform.csv",), ("/x/1/radio.csv",), ("/x/2/platform.csv",), ("/x/3/radio.csv",)], "path string")
    pairs = readiness.file_pairs(paths, "platform.csv", "radio.csv")
    assert {(r["folder"], r["whole"]) for r in pairs.collect()} == {("/x/1", True), ("/x/2", False)}
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 0)], "root1 int, root2 int, root4 int")
    checks = pairs.agg(F.lit("pairs").alias("item"), F.count_if("whole").alias("found")).union(readiness.label_checks(labels, ["root1", "root2"], ["root4"]))
    for n, ready in ((2, False), (1, True)):
        expected = spark.createDataFrame([("pairs", n), ("inactive_sum:root4", 0)], "item string, expected long")
        got = {r["item"]: (r["expected"], r["found"], r["ok"]) for r in readiness.dataset_readiness(checks, expected).collect()}
        assert got["ready"][2] is ready and got["pairs"] == (n, 1, ready) and got["label_sum:root1"] == (None, 2, True) and got["inactive_sum:root4"] == (0, 0, True)


def test_group_statistics_go_to_the_rows(spark):
    """Raw rows of few groups are neither shuffled by the group nor sorted: a task would hold a whole group."""
    from rootloom.operators import order_stats, time_ops

    rows = spark.range(3000).selectExpr("concat('c', id % 2) as case_id", "cast(id as double) as ts")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = time_ops.phase_split(rows, ["case_id"])
        assert "SortMergeJoin" not in split._jdf.queryExecution().executedPlan().toString()
        assert split.where("phase = 'pre'").count() == 1500
        few, order_stats.FEW_GROUPS = order_stats.FEW_GROUPS, 1
        try:
            assert time_ops.phase_split(rows, ["case_id"]).where("phase = 'pre'").count() == 1500
        finally:
            order_stats.FEW_GROUPS = few
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_bootstrap_draws_in_as_many_tasks_as_parts(spark):
    """Parts of values are few bytes and much work; merged into one task they would be drawn one after another."""
    from rootloom.operators import bootstrap

    df = spark.range(400).selectExpr("cast(id as double) as v")
    assert bootstrap.bootstrap_means(df, [], "v", 20, together=16)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 1


def test_splits_of_a_range_are_drawn_once(spark, monkeypatch):
    """However many parts a group has, each split above them is drawn once, and the means are those of the whole tree by plain steps."""
    from rootloom.operators import bootstrap

    df = spark.range(6400).select((F.col("id") % 160).cast("double").alias("v"), (F.col("id") % 160 < 3).alias("g"))
    values = df.where("not g").groupBy("v").agg(F.count("*").alias("c"), F.pmod(F.xxhash64("v"), F.lit(32)).alias("b")).orderBy("v").collect()
    of = {k: [r for r in values if r["b"] == k] for k in range(32)}
    inside = lambda level, at: sum(r["c"] for k in range(at << level, at + 1 << level) for r in of[k])

    def means(level, at, n):
        if not inside(level, at):
            return np.zeros(20)
        if level:
            left = bootstrap.binomial(n, inside(level - 1, 2 * at) / inside(level, at), bootstrap.uniform(7, np.arange(20), level, at, at + 1))
            return means(level - 1, 2 * at, left) + means(level - 1, 2 * at + 1, n - left)
        return sum(of[at][k]["v"] * d for k, d in bootstrap.counts_of(n, np.array([r["c"] for r in of[at]]), 7, -at))

    got = bootstrap.bootstrap_means(df, ["g"], "v", 20, together=5).where("not g").orderBy("rep").collect()
    assert [r["mean"] for r in got] == pytest.approx((means(5, 0, np.full(20, 6280)) / 6280).tolist(), abs=1e-9)


def test_picked_draws_are_n_of_n():
    from rootloom.operators import bootstrap

    rnd = np.random.default_rng(3)
    counts, values = rnd.integers(1, 9, 3000), rnd.gamma(2, 3, 3000)
    n = np.full(2000, counts.sum())
    assert bootstrap.is_picked(counts) and not bootstrap.is_picked(counts[:63]) and not bootstrap.is_picked(counts * 40)
    sums = bootstrap.sums_of(n, values, counts, 7, 0)
    mean = counts @ values / counts.sum()
    deviation = np.sqrt(counts @ (values - mean) ** 2 / counts.sum() / counts.sum())
    assert abs((sums / n).mean() - mean) < 4 * deviation / np.sqrt(2000) and abs((sums / n).std() / deviation - 1) < 0.07
    few = np.array([0, 5, 7, 0, 100_000])
    table = np.stack([d for _, d in bootstrap.counts_of(few, counts, 7, 0)])
    assert table.sum(axis=0).tolist() == few.tolist()
    assert (values @ table).tolist() == pytest.approx(bootstrap.sums_of(few, values, counts, 7, 0).tolist())


def test_tabled_binomials_are_the_plain_ones(monkeypatch):
    from rootloom.operators import bootstrap

    rng = np.random.default_rng(1)
    for mean in (1, 60, 2000):
        n, u = rng.poisson(mean, 300), rng.random(300)
        for p in (0.5, 0.013, 0.97):
            tabled = bootstrap.binomial(n, p, u).tolist()
            monkeypatch.setattr(bootstrap, "TABLED", 0)
            assert bootstrap.binomial(n, p, u).tolist() == tabled
            monkeypatch.undo()


def test_opinions_are_pooled_once_for_all_parameters(spark):
    """Under each parameter as if pooled by itself, and without a broadcast of opinions, whose size no file tells."""
    explicit = spark.createDataFrame([("c", "w1", "a", "cpu", 0.6), ("c", "w2", "b", "cpu", 0.5), ("d", "w1", "b", "cpu", 0.7)], "case_id string, worker_id string, component string, reason string, probability double")
    workers = spark.createDataFrame([(k, w, m, 0.2, ["a", "b"]) for k in "cd" for w, m in (("w1", "logs"), ("w2", "metrics"))], "case_id string, worker_id string, modality string, other_mass double, scope array<string>")
    pairs = spark.createDataFrame([(k, c, "cpu") for k in "cd" for c in "abx"], "case_id string, component string, reason string")
    correlation = spark.createDataFrame([("c", 2, 0.5), ("d", 2, 0.0)], "case_id string, workers long, correlation double")
    params = [(1.0, 0.0, 1.0), (2.0, 1.0, 1.0), (2.0, 1.0, 3.0)]
    pooled = fusion.pooled_under(params, explicit, workers, pairs, correlation)
    got = {(r["param_id"], r["case_id"], r["component"]): (r["posterior"], r["rank"]) for r in pooled.collect()}
    assert len(got) == 18
    for k, (boost, rho, temperature) in enumerate(params):
        weighted = workers.join(correlation, "case_id").withColumn("_weight", fusion.boosted_weight(F.col("modality"), F.lit(boost)) * fusion.effective_share(F.col("workers"), F.col("correlation"), F.lit(rho)))
        alone = fusion.log_opinion_pool(explicit, weighted.drop("workers", "correlation"), pairs, F.col("_weight"), temperature=temperature)
        for r in alone.collect():
            assert got[k, r["case_id"], r["component"]] == (pytest.approx(r["posterior"], abs=2e-9), r["rank"])
    assert "BroadcastHashJoin" not in fusion.worker_logs(explicit, workers, pairs)._jdf.queryExecution().executedPlan().toString()
