"""Evidence checks, revisions and the choice of what is answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootloom.operators.findings import best, component_scores, metric_findings

CANDIDATE = ["case_id", "component", "reason"]


def targeted_check(candidates: DataFrame, findings: DataFrame, most: int = 12) -> DataFrame:
    """(case_id, component, reason, support_score, refute_score, status) from each candidate's ``most`` best findings (with ``hint``).

    A finding that hints at another reason counts a quarter for and a half against; no evidence at all refutes.
    """
    evidence = best(findings, ["case_id", "component"], [F.col("score").desc(), F.col("magnitude").desc(), "signal", "direction"], most)
    rows = candidates.select(*CANDIDATE).join(evidence.select("case_id", "component", "hint", "score"), ["case_id", "component"], "left")
    score = F.greatest(F.col("score"), F.lit(0.0))
    agrees = F.coalesce(F.col("reason"), F.lit("")).isin("", "unknown") | (F.coalesce(F.col("hint"), F.lit("")) == "") | (F.col("hint") == F.col("reason"))
    sums = rows.groupBy(*CANDIDATE).agg(F.count("score").alias("_n"), F.round(F.coalesce(F.sum(F.when(agrees, score).otherwise(0.25 * score)), F.lit(0.0)), 9).alias("support_score"), F.round(F.coalesce(F.sum(F.when(~agrees, 0.5 * score).otherwise(0.0)), F.lit(0.0)), 9).alias("refute_score"))
    status = F.when(F.col("_n") == 0, "REFUTED").when(F.col("support_score") > F.col("refute_score"), "SUPPORTED").when(F.col("refute_score") > F.col("support_score"), "REFUTED").otherwise("INCONCLUSIVE")
    return sums.withColumn("status", status).drop("_n")


def top_and_runner(candidates: DataFrame) -> DataFrame:
    """The first candidate of each case and the first behind it of another component, as ``place`` 1 and 2."""
    first = candidates.where("rank = 1").select("case_id", F.col("component").alias("_first"))
    rows = candidates.join(first, "case_id").where("rank = 1 or component <> _first")
    return best(rows, ["case_id"], ["rank"], 2, rank="place").drop("_first")


def select_by_checks(candidates: DataFrame, checks: DataFrame) -> DataFrame:
    """(case_id, winner, runner_taken): the runner-up wins with more support, or supported against a refuted first."""
    two = top_and_runner(candidates).join(checks.select(*CANDIDATE, "support_score", "status"), CANDIDATE, "left")
    of = lambda k, c: F.max(F.when(F.col("place") == k, F.col(c)))
    rows = two.groupBy("case_id").agg(of(1, "component").alias("a"), of(2, "component").alias("b"), of(1, "support_score").alias("sa"), of(2, "support_score").alias("sb"), of(1, "status").alias("ta"), of(2, "status").alias("tb"))
    better = (F.col("sb") > F.col("sa")) | ((F.col("tb") == "SUPPORTED") & (F.col("ta") == "REFUTED") & (F.col("sb") >= F.col("sa")))
    taken = F.coalesce(better, F.lit(False))
    return rows.select("case_id", F.when(taken, F.col("b")).otherwise(F.col("a")).alias("winner"), taken.alias("runner_taken"))


def worker_tops(distributions: DataFrame) -> DataFrame:
    """The likeliest candidate of each worker."""
    return best(distributions, ["case_id", "worker_id"], [F.col("probability").desc(), "component", "reason"], 1)


def conflict_refine(fused: DataFrame, distributions: DataFrame, checks: DataFrame, margin: float = 0.05, mass: float = 0.9) -> DataFrame:
    """(case_id, component, reason, probability, support_score, refute_score): for cases whose margin is small or whose workers' tops differ, ``mass``
    shared by the two best by what supports them beyond what refutes them (0 at least); without any such support both get 0."""
    two = top_and_runner(fused)
    gap = two.groupBy("case_id").agg(F.count("*").alias("_k"), (F.max(F.when(F.col("place") == 1, F.col("score"))) - F.max(F.when(F.col("place") == 2, F.col("score")))).alias("_gap"))
    tops = worker_tops(distributions).groupBy("case_id").agg(F.count_distinct("component").alias("_tops"))
    unstable = gap.join(tops, "case_id", "left").where((F.col("_k") == 2) & ((F.col("_gap") <= margin) | (F.col("_tops") > 1))).select("case_id")
    rows = two.join(unstable, "case_id", "left_semi").join(checks.select(*CANDIDATE, "support_score", "refute_score"), CANDIDATE, "left")
    rows = rows.fillna(0.0, ["support_score", "refute_score"]).withColumn("_net", F.greatest(F.lit(0.0), F.col("support_score") - F.col("refute_score")))
    total = F.sum("_net").over(Window.partitionBy("case_id"))
    return rows.withColumn("_t", total).select(*CANDIDATE, F.round(F.when(F.col("_t") > 0, mass * F.col("_net") / F.col("_t")).otherwise(0.0), 9).alias("probability"), "support_score", "refute_score")


def refinement_workers(distributions: DataFrame, refined: DataFrame, least: int = 2) -> DataFrame:
    """(case_id, worker_id): the workers to ask about a case under refinement: those that name one of its components, or, if none does, the first ``least``."""
    workers = distributions.select("case_id", "worker_id").distinct().join(refined.select("case_id").distinct(), "case_id", "left_semi")
    wanted = refined.select("case_id", F.lower(F.trim("component")).alias("_c")).distinct()
    naming = distributions.select("case_id", "worker_id", F.lower(F.trim("component")).alias("_c")).join(wanted, ["case_id", "_c"], "left_semi").select("case_id", "worker_id").distinct()
    first = best(workers.join(naming.select("case_id").distinct(), "case_id", "left_anti"), ["case_id"], ["worker_id"], least)
    return naming.unionByName(first)


def distribution_revision(distributions: DataFrame, evidence: DataFrame, gain: float = 0.01, mass: float = 0.9, most: int = 8) -> DataFrame:
    """Each worker's probabilities plus ``gain`` times the net of its own evidence on peers' top hypotheses, with ``mass`` in all again.

    distributions: (case_id, worker_id, component, reason, probability); evidence: (case_id, worker_id, component, net).
    """
    tops = best(distributions, ["case_id", "worker_id"], [F.col("probability").desc(), "component", "reason"], 1).select("case_id", F.col("worker_id").alias("_peer"), "component").alias("t")
    asked = tops.join(distributions.select("case_id", "worker_id").distinct(), "case_id").where("worker_id <> _peer").select("case_id", "worker_id", "component").distinct()
    nets = evidence.join(asked, ["case_id", "worker_id", "component"], "left_semi").groupBy("case_id", "worker_id", "component").agg(F.sum("net").alias("_net"))
    rows = distributions.join(nets, ["case_id", "worker_id", "component"], "left").withColumn("_p", F.greatest(F.lit(0.0), F.col("probability") + gain * F.coalesce("_net", F.lit(0.0))))
    rows = best(rows, ["case_id", "worker_id"], [F.col("_p").desc(), "component", "reason"], most)
    total = F.sum("_p").over(Window.partitionBy("case_id", "worker_id"))
    return rows.withColumn("_t", total).select("case_id", "worker_id", "component", "reason", F.round(F.when(F.col("_t") > 0, mass * F.col("_p") / F.col("_t")).otherwise(0.0), 9).alias("probability"))


REVIEW = "array<struct<to:string,verdict:string,component:string,support:double,refute:double,evidence_ptrs:array<string>>>"


def review_validate(messages: DataFrame, allowed: Column, budget: Column) -> DataFrame:
    """Messages out of JSON: known verdicts, allowed pointers, support and refutation within the budget and 0 without a pointer."""
    items = messages.withColumns({"_allowed": allowed, "_budget": F.greatest(budget, F.lit(0.0))}).select("*", F.posexplode(F.from_json("raw", REVIEW)).alias("pos", "m"))
    pointers = F.array_intersect(F.coalesce("m.evidence_ptrs", F.array().cast("array<string>")), "_allowed")
    amount = lambda c: F.when(F.size(pointers) > 0, F.least(F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0)), F.col("_budget"))).otherwise(0.0)
    verdict = F.when(F.col("m.verdict").isin("support", "challenge", "abstain"), F.col("m.verdict")).otherwise("abstain")
    return items.select("case_id", "agent", "pos", F.coalesce("m.to", F.lit("all")).alias("to"), verdict.alias("verdict"), "m.component", amount("m.support").alias("support"), amount("m.refute").alias("refute"), F.size(pointers).alias("n_pointers"))


def metric_specialist(shifts: DataFrame, most: int = 8) -> DataFrame:
    """(case_id, component, score, rank, margin): the ``most`` best finite shifts, a component once; margin to the next."""
    one = best(shifts.where("score is not null and not isnan(score) and abs(score) < double('Infinity')"), ["case_id", "component"], [F.col("score").desc(), "metric"], 1)
    rows = best(one, ["case_id"], [F.col("score").desc(), "component"], most, rank="rank")
    following = F.lead("score").over(Window.partitionBy("case_id").orderBy("rank"))
    return rows.select("case_id", "component", "score", "rank", F.round(F.col("score") - F.coalesce(following, F.lit(0.0)), 6).alias("margin"))


def ranked_roots(candidates: DataFrame, board: DataFrame, most: int = 10) -> DataFrame:
    """(case_id, ranked_roots): candidates by score and confidence, then the board's components, each once."""
    first = F.struct(F.lit(0).alias("s"), (-F.col("score")).alias("a"), (-F.col("confidence")).alias("b"), "component")
    then = F.struct(F.lit(1).alias("s"), F.col("rank").cast("double").alias("a"), F.lit(0.0).alias("b"), "component")
    rows = candidates.select("case_id", first.alias("o")).union(board.select("case_id", then.alias("o"))).where("o.component <> ''")
    return rows.groupBy("case_id").agg(F.slice(F.array_distinct(F.transform(F.sort_array(F.collect_list("o")), lambda o: o["component"])), 1, most).alias("ranked_roots"))


def primary_first(rows: DataFrame, root: str = "root") -> DataFrame:
    roots = F.array_distinct(F.filter(F.concat(F.array(F.col(root)), F.col("ranked_roots")), lambda r: r.isNotNull() & (r != "")))
    return rows.withColumn("ranked_roots", F.when(F.size(roots) > 0, roots).otherwise(F.array(F.lit("UNKNOWN"))))


def strongest_times(findings: DataFrame) -> DataFrame:
    """(case_id, component, time): of each component the time of its best finding; component null: of the whole case."""
    timed = findings.where("window_start is not null")
    best_time = F.max_by("window_start", F.struct("score", "magnitude", (-F.col("window_start")).alias("t"))).alias("time")
    return timed.groupBy("case_id", "component").agg(best_time).union(timed.groupBy("case_id").agg(best_time).select("case_id", F.lit(None).cast("string"), "time"))


def occurrence_choice(answers: DataFrame, findings: DataFrame) -> DataFrame:
    """(case_id, occurrence): a third into the window if the component isn't asked for; else the answer's, its component's, or the case's strongest time, or the middle.

    answers: (case_id, component, occurrence_time, start_ms, end_ms, requested).
    """
    times = strongest_times(findings)
    own = times.where("component is not null").withColumnRenamed("time", "_own")
    board = times.where("component is null").select("case_id", F.col("time").alias("_board"))
    rows = answers.join(own, ["case_id", "component"], "left").join(board, "case_id", "left")
    length = F.when(F.col("end_ms") > F.col("start_ms"), F.col("end_ms") - F.col("start_ms"))
    early, middle = F.col("start_ms") + length / 3.0, F.col("start_ms") + length / 2.0
    asked = F.array_contains("requested", "component")
    return rows.select("case_id", F.when(~asked, F.coalesce(early, "_board", "occurrence_time", "_own", middle)).otherwise(F.coalesce("occurrence_time", "_own", "_board", middle)).alias("occurrence"))


def decollapse_component(winners: DataFrame, findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """(case_id, component): the strongest known component of the findings; without any, the fused winner."""
    known = findings.where("component <> 'UNKNOWN'").join(catalog.select("component").distinct(), "component", "left_semi")
    strongest = best(known, ["case_id"], [F.col("score").desc(), F.col("magnitude").desc(), "component"], 1).select("case_id", F.col("component").alias("_strongest"))
    return winners.join(strongest, "case_id", "left").select("case_id", F.coalesce("_strongest", "component").alias("component"))


def additive_candidate(distributions: DataFrame) -> DataFrame:
    """(case_id, component, reason, mass): the pair with the greatest sum of probabilities over workers."""
    sums = distributions.groupBy(*CANDIDATE).agg(F.round(F.sum("probability"), 9).alias("mass"))
    return best(sums, ["case_id"], [F.col("mass").desc(), "component", "reason"], 1)


def heuristic_floor(findings: DataFrame, catalog: DataFrame, most: int = 8) -> DataFrame:
    """(case_id, component, reason, component_score, rank): known components by score, each with its heaviest hint."""
    known = findings.join(catalog.select("component").distinct(), "component", "left_semi")
    top = best(component_scores(known), ["case_id"], [F.col("component_score").desc(), "component"], most, rank="rank")
    hints = known.groupBy("case_id", "component", "hint").agg(F.sum(F.greatest("score", F.lit(0.0))).alias("_s")).groupBy("case_id", "component").agg(F.min_by("hint", F.struct((-F.col("_s")).alias("s"), "hint")).alias("reason"))
    return top.join(hints, ["case_id", "component"]).select("case_id", "component", "reason", "component_score", "rank")


def mine_by_modality(metrics: DataFrame, spans: DataFrame, logs: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """Findings of phased rows of each modality by its own miner, in one table."""
    from rootloom.operators.findings import log_pattern_shift

    out = None
    for modality, rows in (("metrics", metrics), ("traces", spans)):
        part = metric_findings(rows, keys, ["case_id"], limit).select("case_id", F.lit(modality).alias("modality"), "component", F.col("metric").alias("signal"), "direction", "magnitude", "score")
        out = part if out is None else out.unionByName(part)
    shifts = log_pattern_shift(logs, ["case_id", "component"], limit).select("case_id", F.lit("logs").alias("modality"), "component", F.col("template").alias("signal"), "direction", "magnitude", "score")
    return out.unionByName(shifts)
