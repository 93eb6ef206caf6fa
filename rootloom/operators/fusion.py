"""Candidates from findings, their fusion, votes and re-ranking. Keyed by case: all incidents in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootloom.operators.findings import FAULT_FAMILIES, best, component_scores, infer_reason, onset_mad
from rootloom.session import written

#: Weights of modalities in additive fusion.
MODALITY_WEIGHTS = {"metrics": 1.0, "logs": 1.15, "traces": 1.15, "events": 1.05, "auxiliary": 0.8}


def modality_weight(modality: Column, weights: dict[str, float] = MODALITY_WEIGHTS) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), modality), F.lit(1.0))


#: The modalities that are sharded, in order, and the names of simple metric files.
SHARD_MODALITIES, SIMPLE_METRICS = ("metrics", "logs", "traces"), ("simple_metrics.csv", "simple_data.csv", "data.csv", "metrics.json")


def default_shards(catalog: DataFrame, most: int = 3, simple: bool = True) -> DataFrame:
    """(case_id, shard_id, modality, n_files, bytes, shard_no): one shard for each modality of a case, ``most`` at most.

    catalog: (case_id, modality, name, bytes). ``simple``: of a case's metric files only the simple ones, if it has any.
    """
    is_simple = (F.col("modality") == "metrics") & F.substring_index("name", "/", -1).isin(*SIMPLE_METRICS)
    one = catalog.where(F.col("modality").isin(*SHARD_MODALITIES)).groupBy("case_id", "modality").agg(
        F.count("*").alias("_n"), F.sum("bytes").alias("_b"), F.count_if(is_simple).alias("_sn"), F.sum(F.when(is_simple, F.col("bytes"))).alias("_sb")
    )
    chosen = (F.col("_sn") > 0) & F.lit(simple)
    one = one.select("case_id", F.concat("modality", F.lit("_0")).alias("shard_id"), "modality", F.when(chosen, F.col("_sn")).otherwise(F.col("_n")).alias("n_files"), F.when(chosen, F.col("_sb")).otherwise(F.col("_b")).cast("long").alias("bytes"))
    return best(one, ["case_id"], [F.array_position(F.array(*map(F.lit, SHARD_MODALITIES)), F.col("modality"))], most, rank="shard_no")


def component_group_shards(components: DataFrame, modalities: DataFrame, size: int = 6) -> DataFrame:
    """(case_id, component, modality, shard_id): components in name order, in groups of ``size``, for each modality."""
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("component")) - 1
    grouped = components.select("case_id", "component").distinct().withColumn("group", F.floor(place / size).cast("int"))
    shard = F.concat_ws("_", "modality", F.col("group").cast("string"))
    return grouped.join(modalities.select("case_id", "modality").distinct(), "case_id").select("case_id", "component", "modality", shard.alias("shard_id"))


def shared_scan_partition(findings: DataFrame, shards: DataFrame, limit: int = 20) -> DataFrame:
    """Findings mined once, handed to the shards they belong to; the ``limit`` best of each shard."""
    dealt = findings.join(shards, ["case_id", "component", "modality"])
    return best(dealt, ["case_id", "shard_id"], [F.col("score").desc(), F.col("magnitude").desc(), "component", "signal"], limit, rank="rank")


def component_universe(sources: list[DataFrame], prior: DataFrame) -> DataFrame:
    """(case_id, component) of all sources; cases without any take the prior catalogue's."""
    found = None
    for s in sources:
        part = s.select("case_id", "component").where("component is not null and component <> ''")
        found = part if found is None else found.union(part)
    found = found.distinct()
    return found.union(prior.select("case_id", "component").distinct().join(found.select("case_id").distinct(), "case_id", "left_anti"))


def budgeted_probe(shards: DataFrame, budget: int) -> DataFrame:
    """The shards that a budget of calls reaches: one call lists them, then they go by modality."""
    order = F.array_position(F.array(*map(F.lit, ("metrics", "traces", "logs", "auxiliary"))), F.col("modality"))
    return best(shards.select("case_id", "shard_id", "modality").distinct(), ["case_id"], [order, "shard_id"], max(budget - 1, 0), rank="call")


def shard_listing(shards: DataFrame, files: DataFrame, budget: int, used: DataFrame | None = None) -> DataFrame:
    """(case_id, shard_id, modality, file_count, bytes, components, calls_left): what there is to ask, before anything is read.

    shards: (case_id, shard_id, modality, component), a row for each component; its names are listed in order, once. files: (case_id,
    modality, bytes); a shard has those of its modality, none counting as 0. used: (case_id, calls), none counting as 0. A budget that is used up leaves 0 calls.
    """
    sizes = files.groupBy("case_id", "modality").agg(F.count("*").alias("file_count"), F.sum("bytes").cast("long").alias("bytes"))
    listed = shards.groupBy("case_id", "shard_id", "modality").agg(F.array_sort(F.collect_set("component")).alias("components"))  # components of one shard
    rows = listed.join(sizes, ["case_id", "modality"], "left").fillna(0, ["file_count", "bytes"])
    calls = F.lit(0) if used is None else F.coalesce("calls", F.lit(0))
    rows = rows if used is None else rows.join(used.groupBy("case_id").agg(F.sum("calls").alias("calls")), "case_id", "left")
    return rows.select("case_id", "shard_id", "modality", "file_count", "bytes", "components", F.greatest(F.lit(budget) - calls, F.lit(0)).cast("long").alias("calls_left"))


def candidate_evidence(findings: DataFrame, most: int = 6, pointers: int = 6, top: int = 3) -> DataFrame:
    """For each shard its ``most`` best components, with rank, reason, dominant modality, pointers and times of their evidence.

    ``findings`` has case_id and shard_id. A component's score sums its ``top`` positive scores of each modality; its evidence
    is its ``pointers`` best findings. The dominant modality is the most frequent of the evidence, of equals the earlier. ``evidence``: the
    findings' order and window_start. All of it is windows over shards of the case, so findings are read and shuffled once.
    """
    keys = ["case_id", "shard_id"]
    by_modality = Window.partitionBy(*keys, "component", "modality").orderBy(F.col("score").desc(), "signal", "direction")
    by_component = Window.partitionBy(*keys, "component").orderBy(F.col("score").desc(), F.col("magnitude").desc(), "signal", "direction")
    rows = findings.where("component <> ''").withColumns({"_m": F.row_number().over(by_modality), "_e": F.row_number().over(by_component)})
    item = F.struct("_e", "score", "magnitude", "signal", "direction", "modality", "evidence_ptr", F.col("window_start").cast("double").alias("window_start"))
    grouped = rows.groupBy(*keys, "component").agg(
        F.round(F.sum(F.when(F.col("_m") <= top, F.greatest("score", F.lit(0.0))).otherwise(0.0)), 6).alias("support_score"),
        F.sort_array(F.collect_list(F.when(F.col("_e") <= pointers, item))).alias("items"),  # nulls aren't collected
    )
    ranked = best(grouped, keys, [F.col("support_score").desc(), "component"], most, rank="local_rank")
    modalities = F.col("items.modality")
    counted = F.transform(modalities, lambda m, i: F.struct(F.size(F.filter(modalities, lambda x: x == m)).alias("n"), (-i).alias("at"), m.alias("m")))
    text = F.array_join(F.transform("items", lambda x: F.concat_ws(" ", x["signal"], x["direction"])), " ")
    told = F.transform("items", lambda x: F.struct((-x["score"]).alias("score"), (-x["magnitude"]).alias("magnitude"), x["signal"].alias("signal"), x["direction"].alias("direction"), x["window_start"].alias("window_start")))
    pointed = F.filter(F.array_distinct("items.evidence_ptr"), lambda p: p.isNotNull() & (p != ""))
    return ranked.select(*keys, "component", "support_score", F.lit(0.0).alias("refute_score"), "local_rank", F.array_max(counted)["m"].alias("modality"), infer_reason(text).alias("reason"), pointed.alias("evidence_ptrs"), told.alias("evidence"))


def heuristic_candidates(findings: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` best components with their share of the scores of these, clipped to 0.05 and 0.95, reason and first time."""
    whole = findings.withColumn("shard_id", F.lit("all"))
    for name in ("evidence_ptr", "window_start"):
        whole = whole if name in whole.columns else whole.withColumn(name, F.lit(None).cast("string" if name == "evidence_ptr" else "double"))
    rows = candidate_evidence(whole, most, pointers=8)
    total = F.sum("support_score").over(Window.partitionBy("case_id"))
    share = F.when(total > 0, F.col("support_score") / total).otherwise(F.col("support_score"))
    return rows.select("case_id", "component", F.col("support_score").alias("component_score"), F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.05), share)), 6).alias("confidence"), F.col("local_rank").alias("rank"), "reason", first_time(F.col("evidence")).alias("occurrence"))


def first_time(evidence: Column, most: int = 8) -> Column:
    """The window_start of the best evidence that has one, among the ``most`` best."""
    return F.get(F.filter(F.slice(F.array_sort(evidence), 1, most), lambda x: x["window_start"].isNotNull()), 0)["window_start"]


def weighted_support(weights: dict[str, float] = MODALITY_WEIGHTS) -> Column:
    return (F.col("support_score") - F.col("refute_score")) * modality_weight(F.col("modality"), weights) / F.sqrt(F.greatest("local_rank", F.lit(1)))


def additive_fusion(evidence: DataFrame, most: int = 5, keys: tuple[str, ...] = ("case_id",), weights: dict[str, float] = MODALITY_WEIGHTS) -> DataFrame:
    """Sum of weighted support for each component (names without case), its best reason, and share of the positive sums up to 0.95.

    evidence_ptrs: up to eight different pointers, those of the best supported evidence first. occurrence: the first time among
    the component's six best findings. Two groupings, by reason and by component, and no join.
    """
    rows = evidence.withColumns({"_w": weighted_support(weights), "_key": F.lower(F.trim("component"))}).where("_key <> ''")
    # A component has a row for each shard of its case.
    part = F.struct((-F.col("_w")).alias("w"), "shard_id", "evidence_ptrs", "evidence")
    by_reason = rows.groupBy(*keys, "_key", "reason").agg(F.sum("_w").alias("_s"), F.min("component").alias("component"), F.collect_list(part).alias("_parts"))
    scores = by_reason.groupBy(*keys, "_key").agg(F.sum("_s").alias("score"), F.min("component").alias("component"), F.min_by("reason", F.struct((-F.col("_s")).alias("s"), "reason")).alias("reason"), F.flatten(F.collect_list("_parts")).alias("_parts"))
    positive = F.sum(F.greatest("score", F.lit(0.0))).over(Window.partitionBy(*keys))
    confidence = F.when(F.col("_total") > 0, F.least(F.lit(0.95), F.greatest("score", F.lit(0.0)) / F.col("_total"))).otherwise(0.0)
    rows = scores.withColumn("_total", positive).withColumns({"confidence": F.round(confidence, 6), "score": F.round("score", 6)})
    pointers = F.slice(F.array_distinct(F.flatten(F.transform(F.array_sort("_parts"), lambda p: p["evidence_ptrs"]))), 1, 8)
    rows = rows.withColumns({"evidence_ptrs": pointers, "occurrence": first_time(F.flatten("_parts.evidence"), 6)})
    return best(rows, list(keys), [F.col("score").desc(), "_key"], most, rank="rank").select(*keys, "component", "reason", "score", "confidence", "rank", "evidence_ptrs", "occurrence")


def with_unknown(fused: DataFrame, cases: DataFrame) -> DataFrame:
    """The fused candidates, and one UNKNOWN of rank 1 without score or confidence for each case that has none."""
    missing = cases.select("case_id").distinct().join(fused.select("case_id").distinct(), "case_id", "left_anti")
    none = {"component": F.lit("UNKNOWN"), "reason": F.lit("unknown"), "score": F.lit(0.0), "confidence": F.lit(0.0), "rank": F.lit(1)}
    columns = [none.get(c, F.lit(None)).cast(fused.schema[c].dataType).alias(c) for c in fused.columns if c != "case_id"]
    return fused.unionByName(missing.select("case_id", *columns))


def vote_fusion(candidates: DataFrame) -> DataFrame:
    """(case_id, component, votes, backer): confidences, at least 0, plus 0.05 for each with evidence; the winner, and who backs it most.

    Votes are summed as decimals of nine places, so their order doesn't matter.
    """
    vote = F.round(F.greatest(F.lit(0.0), F.col("confidence")), 9).cast("decimal(20,9)") + F.when(F.col("has_evidence"), F.lit("0.05")).otherwise("0").cast("decimal(20,9)")
    votes = candidates.groupBy("case_id", "component").agg(F.round(F.sum(vote), 6).cast("double").alias("votes"), F.min_by("worker_id", F.struct((-F.col("confidence")).alias("c"), "worker_id")).alias("backer"))
    return best(votes, ["case_id"], [F.col("votes").desc(), "component"], 1)


OPINION = "candidates array<struct<component:string,reason:string,probability:double,evidence_ptrs:array<string>>>, other_mass double"


def opinion_errors(opinions: DataFrame, components: DataFrame, reasons: list[str]) -> DataFrame:
    """(case_id, worker_id, errors): what is wrong with each JSON opinion, in order, each kind once; an empty list for a sound one."""
    parsed = opinions.select("case_id", "worker_id", F.from_json("raw", OPINION).alias("o"))
    items = parsed.select("case_id", "worker_id", F.col("o.other_mass").alias("other"), F.col("o.candidates").isNull().alias("unread"), F.explode_outer("o.candidates").alias("item"))
    known = components.select(F.col("component").alias("_known")).distinct()
    rows = items.join(known, F.col("item.component") == F.col("_known"), "left")
    named, p = F.col("item").isNotNull(), F.col("item.probability")
    wrong = (
        ("unreadable", F.col("unread")),
        ("unknown component", named & F.col("_known").isNull()),
        ("unknown reason", named & ~F.coalesce(F.col("item.reason").isin(reasons), F.lit(False))),
        ("probability out of range", named & ~F.coalesce(p.between(0, 1), F.lit(False))),
        ("other mass out of range", ~F.col("unread") & ~F.coalesce(F.col("other").between(0, 1), F.lit(False))),
        ("unsupported pointer", named & F.coalesce(F.exists("item.evidence_ptrs", lambda x: ~x.startswith("ptr-")), F.lit(False))),
    )
    flags = rows.groupBy("case_id", "worker_id").agg(*[F.max(test).alias(f"_{k}") for k, (_, test) in enumerate(wrong)])
    return flags.select("case_id", "worker_id", F.array_compact(F.array(*[F.when(F.col(f"_{k}"), name) for k, (name, _) in enumerate(wrong)])).alias("errors"))


def opinion_parse(opinions: DataFrame, components: DataFrame, reasons: list[str], most: int = 8) -> DataFrame:
    """Candidates out of JSON opinions: known components and reasons only, once each, probabilities clipped and renormalised with other_mass.

    Pointers are kept if they begin with ``ptr-``. A damaged opinion gives no rows (``opinion_errors`` tells why).
    """
    parsed = opinions.select("case_id", "worker_id", F.from_json("raw", OPINION).alias("o"))
    items = parsed.select("case_id", "worker_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("o.other_mass", F.lit(0.0)))).alias("other"), F.posexplode("o.candidates").alias("pos", "item"))
    rows = items.select("case_id", "worker_id", "other", "pos", "item.component", "item.reason", F.least(F.lit(1.0), F.greatest(F.lit(0.0), "item.probability")).alias("p"), F.filter("item.evidence_ptrs", lambda x: x.startswith("ptr-")).alias("evidence_ptrs"))
    rows = rows.where(F.col("reason").isin(reasons)).join(components.select("component").distinct(), "component", "left_semi")
    rows = best(rows, ["case_id", "worker_id", "component", "reason"], ["pos"], 1)
    rows = best(rows, ["case_id", "worker_id"], ["pos"], most)
    total = F.sum("p").over(Window.partitionBy("case_id", "worker_id")) + F.col("other")
    return rows.withColumn("_t", total).select("case_id", "worker_id", "component", "reason", F.round(F.when(F.col("_t") > 0, F.col("p") / F.col("_t")).otherwise(0.0), 9).alias("probability"), F.round(F.when(F.col("_t") > 0, F.col("other") / F.col("_t")).otherwise(1.0), 9).alias("other_mass"), "evidence_ptrs")


def fallback_distribution(findings: DataFrame, hint: Column, most: int = 8, temperature: float = 0.3, mass: float = 0.9) -> DataFrame:
    """Softmax of the summed scores of (component, hint) over the greatest, at a temperature, with ``mass`` in all."""
    sums = findings.withColumn("reason", hint).groupBy("case_id", "component", "reason").agg(F.sum("score").alias("s"))
    top = best(sums, ["case_id"], [F.col("s").desc(), "component", "reason"], most)
    case = Window.partitionBy("case_id")
    top = top.withColumn("_top", F.max("s").over(case)).withColumn("_e", F.when(F.col("_top") > 0, F.exp(F.col("s") / F.col("_top") / temperature)).otherwise(1.0))
    return top.withColumn("probability", F.round(mass * F.col("_e") / F.sum("_e").over(case), 9)).select("case_id", "component", "reason", "probability")


def log_opinion_pool(explicit: DataFrame, workers: DataFrame, pairs: DataFrame, weight: Column | None = None, most: int = 8, epsilon: float = 1e-6, temperature: float | Column = 1.0) -> DataFrame:
    """The product of the workers' distributions over all (component, reason) pairs of a case.

    explicit: (case_id, worker_id, component, reason, probability); workers: (case_id, worker_id, other_mass, scope array);
    pairs: (case_id, component, reason). A worker's pairs without an opinion share its other mass, pairs out of its scope
    count as uniform. Probabilities that sum to over 1 are scaled. ``weight``: of a worker, ``temperature``: of a case, over the columns of workers
    and pairs (default 1).
    """
    rows = worker_logs(explicit, workers, pairs, epsilon)
    logs = rows.withColumn("_l", F.col("_lp") * (F.lit(1.0) if weight is None else weight)).groupBy("case_id", "component", "reason").agg((F.sum("_l") - F.log(F.first("_n"))).alias("logp"), F.count("_p").alias("supporters"), F.first(temperature if isinstance(temperature, Column) else F.lit(temperature)).alias("_temperature"))
    return _posteriors(logs, ["case_id"], most)


def worker_logs(explicit: DataFrame, workers: DataFrame, pairs: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """Columns of pairs and workers, with the number of a case's pairs (_n), a worker's probability if it said one (_p), and the logarithm of what counts for it (_lp).

    Tables out of nested columns have more rows than their files' sizes tell, so none is broadcast by these sizes: joins merge.
    """
    worker = Window.partitionBy("case_id", "worker_id")
    case = Window.partitionBy("case_id")
    space = pairs.withColumn("_n", F.count("*").over(case)).hint("merge").join(workers.where(F.size("scope") > 0), "case_id")  # workers x pairs of one case
    rows = space.hint("merge").join(explicit.select("case_id", "worker_id", "component", "reason", "probability"), ["case_id", "worker_id", "component", "reason"], "left")
    inside = F.array_contains("scope", F.col("component"))
    rows = rows.withColumns({"_in": inside, "_p": F.when(inside & F.col("probability").isNotNull(), F.greatest("probability", F.lit(0.0)))})
    rows = rows.withColumns({"_mass": F.coalesce(F.sum("_p").over(worker), F.lit(0.0)), "_said": F.count("_p").over(worker), "_size": F.count_if(F.col("_in")).over(worker)})
    scale = F.when(F.col("_mass") > 1 + 1e-6, 1 / F.col("_mass")).otherwise(1.0)
    other = F.least(F.col("other_mass"), F.greatest(F.lit(0.0), 1 - F.least(F.col("_mass"), F.lit(1.0))))
    rest = F.greatest(F.lit(epsilon), other / F.greatest(F.lit(1), F.col("_size") - F.col("_said")))
    p = F.when(~F.col("_in"), 1.0 / F.col("_n")).otherwise(F.greatest(F.lit(epsilon), F.coalesce(F.col("_p") * scale, rest)))
    return rows.withColumn("_lp", F.log(p))


def _posteriors(logs: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The ``most`` best pairs of each group with their posteriors. logs: (keys, component, reason, logp, supporters, _temperature)."""
    case = Window.partitionBy(*keys)
    logs = logs.withColumn("_top", F.max("logp").over(case)).withColumn("_e", F.exp((F.col("logp") - F.col("_top")) / F.greatest("_temperature", F.lit(1e-6))))
    ranked = logs.withColumn("posterior", F.round(F.col("_e") / F.sum("_e").over(case), 9))
    return best(ranked, keys, [F.col("posterior").desc(), F.col("supporters").desc(), "component", "reason"], most, rank="rank").select(*keys, "component", "reason", "posterior", "supporters", "rank")


def worker_correlation(vectors: DataFrame) -> DataFrame:
    """(case_id, workers, correlation): the mean positive correlation of the workers' vectors; 0 for a single worker.

    vectors: (case_id, worker_id, component, p), with a row for each worker and component of a case.
    """
    a, b = (vectors.select("case_id", "component", F.col("worker_id").alias(w), F.col("p").alias(p)) for w, p in (("wa", "pa"), ("wb", "pb")))
    pairs = a.join(b, ["case_id", "component"]).where("wa < wb").groupBy("case_id", "wa", "wb").agg(F.greatest(F.lit(0.0), F.coalesce(F.when((F.stddev_pop("pa") > 0) & (F.stddev_pop("pb") > 0), F.corr("pa", "pb")), F.lit(0.0))).alias("r"))
    n = vectors.groupBy("case_id").agg(F.count_distinct("worker_id").alias("workers"))
    return n.join(pairs.groupBy("case_id").agg(F.avg("r").alias("correlation")), "case_id", "left").fillna(0.0, ["correlation"])


def effective_share(workers: Column, correlation: Column, rho: Column) -> Column:
    """N_eff / N, N_eff = 1 + (N - 1)(1 - rho * correlation)."""
    return F.when(workers < 2, 1.0).otherwise((1 + (workers - 1) * (1 - rho * correlation)) / workers)


def effective_weight(vectors: DataFrame, rho: float = 1.0) -> DataFrame:
    """(case_id, workers, weight): how many independent workers a case's workers come to, as a share of them."""
    return worker_correlation(vectors).select("case_id", "workers", F.round(effective_share(F.col("workers"), F.col("correlation"), F.lit(rho)), 9).alias("weight"))


#: The grid of the fit.
BOOSTS, RHOS, TEMPERATURES = (1.0, 1.15, 1.3, 1.5, 2.0), (0.0, 0.25, 0.5, 0.75, 1.0), (1.0, 1.5, 2.0, 3.0)


def boosted_weight(modality: Column, boost: Column) -> Column:
    """A worker's reliability in the fit; a boost of 1 leaves all alike."""
    of = F.when(modality.isin("logs", "traces"), boost).when(modality == "events", 1 + (boost - 1) / 2).when(modality == "auxiliary", 0.8).otherwise(1.0)
    return F.when(boost == 1.0, 1.0).otherwise(of)


def pooled_under(params: list[tuple[float, float, float]], explicit: DataFrame, workers: DataFrame, pairs: DataFrame, correlation: DataFrame, most: int = 8) -> DataFrame:
    """(param_id, case_id, component, reason, posterior, supporters, rank): the opinions pooled anew for each of params (boost, rho, temperature).

    What a worker says of a pair is the same under all of them, so workers meet pairs once, with a sum for each different weight; only the
    sums of pairs are repeated for each parameter, and stay with their case.
    """
    weights = list(dict.fromkeys((b, r) for b, r, _ in params))
    rows = worker_logs(explicit, workers.hint("merge").join(correlation, "case_id"), pairs.select("case_id", "component", "reason"))
    under = lambda b, r: boosted_weight(F.col("modality"), F.lit(float(b))) * effective_share(F.col("workers"), F.col("correlation"), F.lit(float(r)))
    sums = F.array(*[F.sum(F.col("_lp") * under(b, r)) - F.log(F.first("_n")) for b, r in weights])
    # Few bytes that become many rows, so adaptive execution mustn't merge the tasks.
    tasks = int(explicit.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    logs = rows.groupBy("case_id", "component", "reason").agg(sums.alias("_logs"), F.count("_p").alias("supporters")).repartition(tasks, "case_id")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("param_id"), F.lit(weights.index((b, r))).alias("w"), F.lit(float(t)).alias("t")) for k, (b, r, t) in enumerate(params)]))
    logs = logs.withColumn("_q", each).select("_q.param_id", "case_id", "component", "reason", F.get("_logs", F.col("_q.w")).alias("logp"), "supporters", F.col("_q.t").alias("_temperature"))
    return _posteriors(logs, ["param_id", "case_id"], most)


def pool_scores(params: list[tuple[float, float, float]], explicit: DataFrame, workers: DataFrame, pairs: DataFrame, truth: DataFrame, correlation: DataFrame) -> DataFrame:
    """(param_id, boost, rho, temperature, mrr, hit_at_1, brier) of each of params (boost, rho, temperature), over all cases of ``truth``."""
    pooled = pooled_under(params, explicit, workers, pairs, correlation).select("param_id", "case_id", "component", "posterior", "rank")
    names = ["param_id", "boost", "rho", "temperature"]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("param_id"), *[F.lit(float(x)).alias(n) for n, x in zip(names[1:], p)]) for k, p in enumerate(params)]))
    asked = truth.withColumn("_q", each).select("_q.*", "case_id", F.lower(F.trim("true_root")).alias("_true"))
    hit = F.lower(F.trim("component")) == F.col("_true")
    found = asked.hint("merge").join(pooled, ["param_id", "case_id"], "left").groupBy(*names, "case_id").agg(F.coalesce(1.0 / F.min(F.when(hit, F.col("rank"))), F.lit(0.0)).alias("rr"), F.max(F.when(F.col("rank") == 1, F.col("posterior"))).alias("sure"))
    right = F.when(F.col("rr") == 1.0, 1.0).otherwise(0.0)
    error = F.coalesce("sure", F.lit(0.0)) - right
    return found.groupBy(*names).agg(F.round(F.avg("rr"), 9).alias("mrr"), F.round(F.avg(right), 9).alias("hit_at_1"), F.round(F.avg(error * error), 9).alias("brier"))


def grid_search(explicit: DataFrame, workers: DataFrame, pairs: DataFrame, truth: DataFrame, vectors: DataFrame, boosts=BOOSTS, rhos=RHOS, temperatures=TEMPERATURES) -> DataFrame:
    """(stage, boost, rho, temperature, mrr, hit_at_1, brier, chosen): weights of the opinion pool fitted on labelled cases, in two stages.

    Reliability first: the boost of best mean reciprocal rank, then hit@1, the smallest of equals (1: none). Then rho and
    temperature at that boost: the least Brier score, the first of equals. workers: (case_id, worker_id, modality, other_mass, scope).
    """
    correlation = written(worker_correlation(vectors), "correlation")

    def tried(stage, grid):
        rows = written(pool_scores(grid, explicit, workers, pairs, truth, correlation).withColumn("stage", F.lit(stage)), "grid")
        order = [F.col("mrr").desc(), F.col("hit_at_1").desc(), "param_id"] if stage == "reliability" else ["brier", "param_id"]
        return rows.withColumn("chosen", F.row_number().over(Window.orderBy(*order)) == 1)  # a row for each parameter

    one = tried("reliability", [(b, 0.0, 1.0) for b in boosts])
    boost = one.where("chosen").first()["boost"]
    two = tried("calibration", [(boost, r, t) for r in rhos for t in temperatures])
    return one.unionByName(two).select("stage", "boost", "rho", "temperature", "mrr", "hit_at_1", "brier", "chosen")


def peer_review(proposals: DataFrame, evidence: DataFrame, agents: DataFrame) -> DataFrame:
    """(case_id, agent, peer, proposal, verdict, strength): what each agent's own evidence says of each peer's proposal.

    evidence: (case_id, agent, component, net). Verdict by the sign of the net support; strength is the net support within
    the agent's budget, its positive support over its number of peers.
    """
    budget = evidence.groupBy("case_id", "agent").agg(F.sum(F.greatest("net", F.lit(0.0))).alias("_positive"))
    peers = agents.withColumn("_peers", F.greatest(F.count("*").over(Window.partitionBy("case_id")) - 1, F.lit(1))).join(budget, ["case_id", "agent"], "left").withColumn("_budget", F.coalesce("_positive", F.lit(0.0)) / F.col("_peers"))
    pairs = peers.join(proposals.select("case_id", F.col("agent").alias("peer"), F.col("component").alias("proposal")), "case_id").where("agent <> peer")
    own = evidence.groupBy("case_id", "agent", F.col("component").alias("proposal")).agg(F.sum("net").alias("_net"))
    rows = pairs.join(own, ["case_id", "agent", "proposal"], "left").withColumn("_net", F.coalesce("_net", F.lit(0.0)))
    verdict = F.when(F.col("_net") > 0, "support").when(F.col("_net") < 0, "challenge").otherwise("abstain")
    return rows.select("case_id", "agent", "peer", "proposal", verdict.alias("verdict"), F.round(F.least(F.abs("_net"), F.col("_budget")), 6).alias("strength"))


def rerank(candidates: DataFrame, factors: DataFrame, factor: str, gain: float, keys: list[str]) -> DataFrame:
    """score * (1 + gain * factor), ranked anew, with confidences as clipped shares. A gain of 0 changes no order."""
    case = Window.partitionBy("case_id")
    rows = candidates.join(factors.select(*keys, factor), keys, "left")
    rows = rows.withColumn("score", F.col("score") * (1 + gain * F.coalesce(factor, F.lit(0.0)))).withColumn("_total", F.sum(F.greatest("score", F.lit(0.0))).over(case))
    share = F.when(F.col("_total") > 0, F.greatest("score", F.lit(0.0)) / F.col("_total")).otherwise(0.0)
    rows = rows.withColumns({"confidence": F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.05), share)), 6), "score": F.round("score", 9)})
    return rows.withColumn("rank", F.row_number().over(case.orderBy(F.col("score").desc(), "component"))).drop("_total")


def causal_pick(loudest: DataFrame, connectivity: DataFrame, most: int = 15) -> DataFrame:
    """Of the ``most`` loudest components, the one with most symptomatic neighbours in its case's graph (the louder of equals); without any, the loudest.

    connectivity: (case_id, node, n).
    """
    top = best(loudest, ["case_id"], [F.col("max_score").desc(), "component"], most, rank="loudness")
    rows = top.join(connectivity.select("case_id", F.col("node").alias("component"), F.col("n").alias("neighbours")), ["case_id", "component"], "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)).cast("long"))
    return best(rows, ["case_id"], [F.col("neighbours").desc(), "loudness"], 1).select("case_id", "component", "neighbours", "loudness")


def onset_pick(candidates: DataFrame, findings: DataFrame, series: DataFrame, adjacency: DataFrame) -> DataFrame:
    """(case_id, component, onset_ts, neighbours): the candidate whose dominant series breaks out first.

    candidates: (case_id, component, rank); series: (case_id, component, metric, ts, value); adjacency: undirected (case_id, src, dst).
    A candidate's dominant series is that of its best finding's signal, or, where there is none of that name, the most varying
    one. Of equal onsets the candidate with more neighbours among those with an onset wins, then the better rank; a case
    without any onset takes its first candidate.
    """
    own = ["case_id", "component"]
    signal = best(findings, own, [F.col("score").desc(), F.col("magnitude").desc(), "signal", "direction"], 1).select(*own, F.col("signal").alias("_signal"))
    wanted = series.join(candidates.select(*own).distinct(), own, "left_semi")
    spread = wanted.groupBy(*own, "metric").agg(F.stddev_samp("value").alias("_std")).join(signal, own, "left")
    chosen = best(spread, own, [F.when(F.col("metric") == F.col("_signal"), 0).otherwise(1), F.col("_std").desc_nulls_last(), "metric"], 1).select(*own, "metric")
    onsets = onset_mad(wanted.join(chosen, [*own, "metric"], "left_semi"), own).where("onset_ts is not null")
    ends = onsets.select("case_id", F.lower("component").alias("_other"))
    links = adjacency.select("case_id", F.lower("src").alias("_node"), F.lower("dst").alias("_other")).where("_node <> _other").distinct()
    near = links.join(ends, ["case_id", "_other"], "left_semi").groupBy("case_id", "_node").agg(F.count("*").alias("neighbours"))
    rows = candidates.join(onsets, own, "left").withColumn("_node", F.lower("component")).join(near, ["case_id", "_node"], "left")
    rows = rows.withColumn("neighbours", F.when(F.col("onset_ts").isNotNull(), F.coalesce("neighbours", F.lit(0))).otherwise(0).cast("long"))
    return best(rows, ["case_id"], [F.col("onset_ts").asc_nulls_last(), F.col("neighbours").desc(), "rank", "component"], 1).select("case_id", "component", "onset_ts", "neighbours")


RULES = {"loudest": ("peak",), "topology": ("coverage", "peak"), "temporal": ("onset", "coverage", "peak"), "alarm_correlation": ("coverage", "onset", "peak")}


def ranking_rules(nodes: DataFrame) -> DataFrame:
    """(case_id, rule, component, rank) under the four rules, from (case_id, component, peak, coverage, onset)."""
    out = None
    for rule, columns in RULES.items():
        order = [F.col(x).asc_nulls_last() if x == "onset" else F.col(x).desc() for x in columns]
        part = nodes.select("case_id", F.lit(rule).alias("rule"), "component", F.row_number().over(Window.partitionBy("case_id").orderBy(*order, "component")).alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


def falsify(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """(case_id, winner, promoted): the second candidate takes over if its own component score is strictly higher."""
    rows = candidates.where(F.col("rank") <= 2).join(scores, ["case_id", "component"], "left")
    pick = lambda k, col: F.max(F.when(F.col("rank") == k, F.col(col)))
    two = rows.groupBy("case_id").agg(pick(1, "component").alias("a"), pick(2, "component").alias("b"), pick(1, "component_score").alias("sa"), pick(2, "component_score").alias("sb"))
    over = F.coalesce(F.col("sb") > F.coalesce("sa", F.lit(0.0)), F.lit(False))
    return two.select("case_id", F.when(over, F.col("b")).otherwise(F.col("a")).alias("winner"), over.alias("promoted"))


def majority_roots(opinions: DataFrame, workers: DataFrame | None = None) -> DataFrame:
    """(case_id, component, n) named in more than half of a case's opinions; without any, all those named most.

    ``workers``: (case_id, worker_id) of all opinions, the empty ones among them; without it only those that name something count.
    """
    case = Window.partitionBy("case_id")
    counts = opinions.groupBy("case_id", "component").agg(F.count_distinct("worker_id").alias("n"))
    total = (opinions if workers is None else workers).groupBy("case_id").agg(F.count_distinct("worker_id").alias("_all"))
    rows = counts.join(total, "case_id").withColumn("_most", F.max("n").over(case)).withColumn("_needs", F.floor(F.col("_all") / 2) + 1)
    return rows.where((F.col("n") >= F.col("_needs")) | ((F.col("_most") < F.col("_needs")) & (F.col("n") == F.col("_most")))).select("case_id", "component", "n")


def metric_prior(top: DataFrame) -> DataFrame:
    """(case_id, component, margin, strong): the best-shifted component; margin top / (top + second), strong from 0.625 on."""
    rows = top.withColumn("_next", F.lead("score").over(Window.partitionBy("case_id").orderBy("rank"))).where("rank = 1")
    total = F.col("score") + F.coalesce("_next", F.lit(0.0))
    margin = F.when(total > 0, F.col("score") / total).otherwise(0.0)
    return rows.select("case_id", "component", F.round(margin, 6).alias("margin"), (margin >= 0.625).alias("strong"))


def apply_prior(predictions: DataFrame, prior: DataFrame, insert: int = 4) -> DataFrame:
    """Predictions led by a strong prior, or with a weak one's ``insert`` roots behind the first; the prior's other roots follow. Each root once.

    prior: (case_id, strong, margin, prior_roots, prior_faults), a fault family for each of its roots (null: none told); a case
    without prior roots stays as it is. A strong prior's root takes over, and the confidence is the greater of both; a weak one
    leaves root and confidence. The fault is the one that the prior tells for the root, else the prediction's own if it is a
    known family, else the prior's first (``unknown`` without).
    """
    none = F.array().cast("array<string>")
    rows = predictions.join(prior, "case_id", "left").withColumns({"prior_roots": F.coalesce("prior_roots", none), "prior_faults": F.coalesce("prior_faults", none)})
    roots, first = F.col("ranked_roots"), F.get("ranked_roots", 0)
    led = F.size("prior_roots") > 0
    strong = led & F.coalesce("strong", F.lit(False))
    ranked = F.when(strong, F.concat(F.slice("prior_roots", 1, 1), roots, "prior_roots")).when(led, F.concat(F.slice(roots, 1, 1), F.slice("prior_roots", 1, insert), roots, "prior_roots")).otherwise(roots)
    root = F.when(strong, F.get("prior_roots", 0)).otherwise(first)
    told = F.get("prior_faults", F.array_position("prior_roots", root).cast("int") - 1)
    known = lambda c: F.when(F.lower(F.trim(c)).isin(*FAULT_FAMILIES), F.lower(F.trim(c)))
    fault = F.when(led, F.coalesce(known(told), known(F.col("fault_type")), F.get("prior_faults", 0), F.lit("unknown"))).otherwise(F.col("fault_type"))
    sure = F.when(strong, F.greatest("confidence", "margin")).otherwise(F.col("confidence"))
    return rows.withColumns({"ranked_roots": F.array_distinct(ranked), "fault_type": fault, "confidence": sure}).drop("prior_roots", "prior_faults", "strong", "margin")


def eligible_candidates(sources: list[DataFrame], most: int = 10) -> DataFrame:
    """The ordered union of ranked lists (case_id, component, rank), without repeats whatever the letters' case."""
    out = None
    for k, s in enumerate(sources):
        part = s.select("case_id", "component", F.struct(F.lit(k).alias("source"), "rank").alias("_o"))
        out = part if out is None else out.union(part)
    first = out.groupBy("case_id", F.lower(F.trim("component")).alias("_key")).agg(F.min_by("component", "_o").alias("component"), F.min("_o").alias("_o"))
    return best(first, ["case_id"], ["_o", "component"], most, rank="rank").select("case_id", "component", "rank")


def panel_vote(opinions: DataFrame, eligible: DataFrame) -> DataFrame:
    """(case_id, component, votes, points, rank): first places with 1 + confidence, and Borda points, over ranked opinions restricted to eligible components."""
    items = opinions.select("case_id", "worker_id", "confidence", F.posexplode("ranked").alias("pos", "component")).join(eligible.select("case_id", "component"), ["case_id", "component"], "left_semi")
    place = F.row_number().over(Window.partitionBy("case_id", "worker_id").orderBy("pos"))
    n = F.count("*").over(Window.partitionBy("case_id", "worker_id"))
    rows = items.withColumns({"_place": place, "_n": n})
    sums = rows.groupBy("case_id", "component").agg(F.round(F.sum(F.when(F.col("_place") == 1, 1 + F.col("confidence")).otherwise(0.0)), 6).alias("votes"), F.sum(F.col("_n") - F.col("_place")).cast("long").alias("points"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("votes").desc(), F.col("points").desc(), "component")))


def requested_output(predictions: DataFrame) -> DataFrame:
    """A JSON object with only what was asked for, from (row_id, requested, occurrence, component, reason)."""
    named = (("time", "root cause occurrence datetime", "occurrence"), ("component", "root cause component", "component"), ("reason", "root cause reason", "reason"))
    entries = F.array(*[F.when(F.array_contains("requested", k), F.struct(F.lit(n).alias("key"), F.col(v).alias("value"))) for k, n, v in named])
    fields = F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))
    return predictions.select("row_id", F.to_json(F.create_map(F.lit("1"), fields)).alias("prediction"))
