"""Joins of telemetry with incidents, and dependency graphs: edges from spans, reachability, coverage.

Graphs are keyed: ``keys`` (the case, by default) stand in edges, nodes and symptoms, and nothing crosses from one to another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootloom.session import written

KEYS = ("case_id",)


def window_interval_join(rows: DataFrame, windows: DataFrame, time_ms: str = "time_ms", bucket_ms: int = 86_400_000) -> DataFrame:
    """Rows inside windows (start_ms to end_ms, both included); a row in several windows comes several times.

    Each window is listed under every bucket it touches, and rows meet it by an equality on the bucket, so there is no
    comparison of all rows with all windows whatever their numbers.
    """
    first, last = (F.floor(F.col(c) / bucket_ms) for c in ("start_ms", "end_ms"))
    listed = windows.withColumn("_bucket", F.explode(F.sequence(first, last)))
    hit = (F.col("_row_bucket") == F.col("_bucket")) & (F.col(time_ms) >= F.col("start_ms")) & (F.col(time_ms) <= F.col("end_ms"))
    return rows.withColumn("_row_bucket", F.floor(F.col(time_ms) / bucket_ms)).join(listed, hit).drop("_bucket", "_row_bucket")


def span_edges(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parent, child, n): calls from one component to another. Of spans that share an id, the first counts as parent."""
    at = ["parent_id", *keys]  # the id first: sorting by what differs is far faster
    one = Window.partitionBy("span_id", *keys).orderBy("start_ms", "component")
    parents = spans.where("span_id is not null").select(*keys, "span_id", "start_ms", "component").withColumn("_r", F.row_number().over(one)).where("_r = 1").select(*keys, F.col("span_id").alias("parent_id"), F.col("component").alias("parent"))
    calls = spans.where("parent_id is not null").select(*keys, "parent_id", F.col("component").alias("child"))
    return calls.join(parents, at).where("parent <> child").groupBy(*keys, "parent", "child").agg(F.count("*").alias("n"))


def service_graph(spans: DataFrame, node: str = "service", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Different directed edges (keys, src, dst) from caller to callee, names in lower case, without empty ones and loops.

    Both sides are dealt by the ids that they meet on, once: names of spans that share an id are made different where they are, so
    a call meets each name once, and calls need not be different before they meet.
    """
    name = F.lower(F.trim(node))
    ends = spans.where(name != "")
    parts = int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number isn't lessened, so that ids of few spans are in a task's memory
    at = ["parent_id", *keys]  # the id first: sorting by a number that differs is far faster than by texts that don't
    parents = ends.select(*keys, F.col("span_id").alias("parent_id"), name.alias("src")).where("parent_id is not null").repartition(parts, *at).distinct()
    calls = ends.where("parent_id is not null").select(*at, name.alias("dst"))
    return calls.join(parents, at).where("src <> dst").select(*keys, "src", "dst").distinct()


def container_service_edges(spans: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return spans.where("component is not null and ds_name is not null and component <> ds_name").select(*keys, F.col("component").alias("src"), F.col("ds_name").alias("dst")).distinct()


def undirected(edges: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return edges.select(*keys, "src", "dst").union(edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def graph_nodes(edges: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    return edges.select(*keys, F.col("src").alias("node")).union(edges.select(*keys, "dst")).distinct()


def hops(edges: DataFrame, starts: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, start, node, hop): everything that each ``node`` of ``starts`` reaches, with the least number of steps; the start itself at 0.

    By doubling: of pairs less than 2^k steps apart and pairs that are exactly so far apart come those of 2^(k+1), so rounds grow
    with the logarithm of the depth and a shortest path is put together once a round. Cycles end, as a pair is exactly so far apart only if it
    isn't nearer. Each round is written to the shared folder.
    """
    ends = edges.where("src <> dst").select(*keys, F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    far, length = written(ends, "far"), 1
    nodes = graph_nodes(edges, keys).union(starts.select(*keys, "node")).distinct()
    near = written(nodes.select(*keys, F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("hop")), "near")
    while not far.isEmpty():
        on = far.withColumnRenamed("b", "m")
        further = on.join(near.withColumnRenamed("a", "m"), [*keys, "m"]).select(*keys, "a", "b", (F.col("hop") + length).alias("hop"))
        near = written(near.unionByName(further).groupBy(*keys, "a", "b").agg(F.min("hop").alias("hop")), "near")
        twice = on.join(far.withColumnRenamed("a", "m"), [*keys, "m"]).select(*keys, "a", "b").distinct()
        far, length = written(twice.join(near, [*keys, "a", "b"], "left_anti"), "far"), 2 * length
    wanted = starts.select(*keys, F.col("node").alias("a")).distinct()
    return near.join(wanted, [*keys, "a"], "left_semi").select(*keys, F.col("a").alias("start"), F.col("b").alias("node"), "hop")


def within(edges: DataFrame, starts: DataFrame, radius: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, start, node): what each ``node`` of ``starts`` reaches in ``radius`` steps or fewer, itself included."""
    ways = edges.select(*keys, F.col("src").alias("node"), "dst").distinct()
    seen = starts.select(*keys, F.col("node").alias("start"), F.col("node")).distinct()
    for _ in range(radius):
        seen = seen.union(seen.join(ways, [*keys, "node"]).select(*keys, "start", F.col("dst").alias("node"))).distinct()
    return seen


def ancestors(edges: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, start, node): the transitive callers of each node, without itself."""
    back = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    return hops(back, nodes, keys).where("start <> node").select(*keys, "start", "node")


def _symptoms(symptomatic: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Names as a graph has them (``service_graph``): trimmed, in lower case."""
    return symptomatic.select(*keys, F.lower(F.trim("node")).alias("node")).distinct()


def k_hop_connectivity(adjacency: DataFrame, symptomatic: DataFrame, radius: int = 2, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, node, n): other symptomatic nodes within ``radius`` steps of each node of an undirected graph; found from the symptoms outwards."""
    near = within(adjacency, _symptoms(symptomatic, keys), radius, keys).where("start <> node").groupBy(*keys, "node").agg(F.count("*").alias("n"))
    nodes = adjacency.select(*keys, F.col("src").alias("node")).distinct()
    return nodes.join(near, [*keys, "node"], "left").select(*keys, "node", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def reaching_symptoms(edges: DataFrame, symptomatic: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, node, hits): how many symptomatic nodes reach each node along the edges, itself included; nodes that none reaches are left out.

    A case's symptoms are numbered, and a node has one bit for each, in words of 63: a row for a node and a word, never one for a
    node and a symptom. Words are merged along edges until no bit is new, so cycles need no care. A node with one caller takes
    over its caller's only caller in each round, so a long chain is done in the logarithm of its length.
    """
    order = Window.partitionBy(*keys).orderBy("node")  # a row for each symptomatic node of a case
    numbered = _symptoms(symptomatic, keys).withColumn("_i", F.row_number().over(order) - 1)
    bit = F.expr("shiftleft(1L, _i % 63)")
    masks = written(numbered.select(*keys, "node", F.floor(F.col("_i") / 63).alias("word"), bit.alias("mask")), "masks")
    ways = written(edges.where("src <> dst").select(*keys, "src", "dst").distinct(), "ways")
    bits = None
    while True:
        passed = ways.join(masks.withColumnRenamed("node", "src"), [*keys, "src"]).select(*keys, F.col("dst").alias("node"), "word", "mask")
        masks = written(masks.unionByName(passed).groupBy(*keys, "node", "word").agg(F.bit_or("mask").alias("mask")), "masks")
        now = masks.agg(F.sum(F.bit_count("mask"))).first()[0]
        if now == bits:
            return masks.groupBy(*keys, "node").agg(F.sum(F.bit_count("mask")).cast("long").alias("hits"))
        bits = now
        single = ways.groupBy(*keys, "dst").agg(F.count("*").alias("_n"), F.min("src").alias("_up")).where("_n = 1").select(*keys, "dst", "_up")
        own = single.select(*keys, "dst", F.lit(True).alias("_one"))
        up = single.select(*keys, F.col("dst").alias("src"), "_up")
        moved = F.when(F.col("_one"), F.coalesce("_up", "src")).otherwise(F.col("src"))
        ways = written(ways.join(own, [*keys, "dst"], "left").join(up, [*keys, "src"], "left").select(*keys, moved.alias("src"), "dst").where("src <> dst"), "ways")


def explanatory_coverage(edges: DataFrame, symptomatic: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, node, coverage): the share of symptomatic nodes that a node or its transitive callers are."""
    total = _symptoms(symptomatic, keys).groupBy(*keys).agg(F.count("*").alias("total"))
    rows = graph_nodes(edges, keys).join(reaching_symptoms(edges, symptomatic, keys), [*keys, "node"], "left").join(total, list(keys), "left")
    return rows.select(*keys, "node", F.round(F.coalesce(F.col("hits") / F.col("total"), F.lit(0.0)), 6).alias("coverage"))


def graph_context(candidates: DataFrame, edges: DataFrame, symptomatic: DataFrame, most: int = 8, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, component, calls, called_by, is_symptomatic, in_graph): what surrounds each candidate, ``most`` names either way, in their order."""
    node = F.lower(F.trim("component"))
    side = lambda mine, other, into: edges.groupBy(*keys, F.col(mine).alias("_node")).agg(F.array_sort(F.collect_set(other)).alias(into))  # noqa: E731  the neighbours of one node of one case
    rows = candidates.select(*keys, "component", node.alias("_node")).distinct()
    rows = rows.join(side("src", "dst", "calls"), [*keys, "_node"], "left").join(side("dst", "src", "called_by"), [*keys, "_node"], "left")
    rows = rows.join(symptomatic.select(*keys, F.lower(F.trim("node")).alias("_node"), F.lit(True).alias("_symptom")).distinct(), [*keys, "_node"], "left")
    names = lambda c: F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, most).alias(c)
    in_graph = F.col("calls").isNotNull() | F.col("called_by").isNotNull()
    return rows.select(*keys, "component", names("calls"), names("called_by"), F.coalesce("_symptom", F.lit(False)).alias("is_symptomatic"), in_graph.alias("in_graph"))


def paired_systems(rows: DataFrame, baseline: str, treatment: str, value: str, majority: bool = False) -> DataFrame:
    """(case_id, baseline, treatment) for cases that have both; repeats are averaged, or decided by majority (ties count as 1)."""
    of = lambda s: F.avg(F.when(F.col("system") == s, F.col(value).cast("double")))
    pairs = rows.groupBy("case_id").agg(of(baseline).alias("baseline"), of(treatment).alias("treatment")).where("baseline is not null and treatment is not null")
    if majority:
        pairs = pairs.select("case_id", *[F.when(F.col(c) >= 0.5, 1.0).otherwise(0.0).alias(c) for c in ("baseline", "treatment")])
    return pairs


def mismatched_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids that only one of the two tables has."""
    a, b = (t.select(key).distinct().withColumn(n, F.lit(True)) for t, n in ((left, "_l"), (right, "_r")))
    return a.join(b, key, "full_outer").where("_l is null or _r is null").select(key, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("side"))
