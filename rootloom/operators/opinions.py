"""Opinions of agents: an answer completed from the board of findings, and a round of reviews between agents of a case."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rootloom.operators.findings import best
from rootloom.operators.fusion import candidate_evidence, first_time


def opinion_answer(opinions: DataFrame, findings: DataFrame, most: int = 8) -> DataFrame:
    """(case_id, worker_id, component, reason, confidence, told_time, occurrence, evidence_ptrs, score): one answer for each opinion, what it leaves out taken from the findings.

    raw: JSON with ``component`` (else ``root``, else ``root_cause_component``), ``reason``, ``confidence``, ``occurrence_time``, ``evidence``. Without a
    component, and where the JSON is damaged, the case's best component stands, and UNKNOWN where the case has no finding. An empty
    reason is that of the component's ``most`` best findings, an unknown one without any; so are its pointers (different ones), and ``occurrence`` is the
    first time among them where none is told. A confidence that is no number counts as 0, others are clipped to 0 and 1.
    """
    said = lambda f: F.nullif(F.trim(F.get_json_object("raw", f"$.{f}")), F.lit(""))
    listed = F.from_json(F.get_json_object("raw", "$.evidence"), "array<string>")
    number = F.coalesce(said("confidence").try_cast("double"), F.lit(0.0))
    rows = opinions.select(
        "case_id", "worker_id", F.coalesce(said("component"), said("root"), said("root_cause_component")).alias("_said"), said("reason").alias("_reason"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(F.isnan(number), 0.0).otherwise(number))).alias("confidence"), said("occurrence_time").alias("told_time"),
        F.when(F.size(listed) > 0, listed).alias("_pointers"),
    )
    board = candidate_evidence(findings.withColumn("shard_id", F.lit("all")), 2**31 - 1, pointers=most)
    board = board.select("case_id", "component", F.lower(F.trim("component")).alias("_name"), "local_rank", "support_score", F.col("reason").alias("_board_reason"), "evidence_ptrs", first_time(F.col("evidence"), most).alias("_time"))
    first = board.where("local_rank = 1").select("case_id", F.col("component").alias("_first"))
    rows = rows.join(first, "case_id", "left").withColumn("component", F.coalesce("_said", "_first", F.lit("UNKNOWN"))).withColumn("_name", F.lower("component"))
    known = best(board, ["case_id", "_name"], ["local_rank"], 1).drop("component")
    rows = rows.join(known, ["case_id", "_name"], "left")
    return rows.select(
        "case_id", "worker_id", "component", F.coalesce("_reason", "_board_reason", F.lit("unknown")).alias("reason"), "confidence", "told_time",
        F.when(F.col("told_time").isNull(), F.col("_time")).alias("occurrence"), F.coalesce("_pointers", "evidence_ptrs", F.array().cast("array<string>")).alias("evidence_ptrs"), F.coalesce("support_score", F.lit(0.0)).alias("score"),
    )


def _ordered(evidence: DataFrame) -> DataFrame:
    """Each agent's evidence with its net support and its place: the strongest first, of equals the better ranked."""
    rows = evidence.withColumn("_net", F.col("support_score") - F.col("refute_score"))
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy("case_id", "shard_id").orderBy(F.col("_net").desc(), "local_rank", "component")))


def _reviews(evidence: DataFrame) -> DataFrame:
    """A row for each agent and each other agent's proposal of a case, with the agent's own evidence of that component (null without any) and what it may weigh."""
    rows = _ordered(evidence)
    agents = rows.groupBy("case_id", F.col("shard_id").alias("agent")).agg(F.sum(F.greatest("_net", F.lit(0.0))).alias("_positive"))
    agents = agents.withColumn("_peers", F.count("*").over(Window.partitionBy("case_id")) - 1)
    proposals = rows.where("_at = 1").select("case_id", F.col("shard_id").alias("peer"), F.col("component").alias("proposal"), F.col("reason").alias("proposed_reason"), F.lower(F.trim("component")).alias("_name"))
    # Of names that differ in case only, an agent looks at its weakest.
    own = best(rows.withColumn("_name", F.lower(F.trim("component"))), ["case_id", "shard_id", "_name"], [F.col("_at").desc()], 1)
    own = own.select("case_id", F.col("shard_id").alias("agent"), "_name", F.struct(*evidence.columns).alias("own"), "_net")
    pairs = agents.join(proposals, "case_id").where("agent <> peer").join(own, ["case_id", "agent", "_name"], "left")
    weight = F.least(F.abs("_net"), F.col("_positive") / F.col("_peers"))
    verdict = F.when(F.col("_net") > 0, "support").when(F.col("_net") < 0, "challenge").otherwise("abstain")
    of = lambda v: F.when(F.col("verdict") == v, F.col("_weight")).otherwise(0.0)
    return pairs.withColumns({"verdict": verdict, "_weight": weight}).withColumns({"support": of("support"), "refute": of("challenge")})


def review_transcript(evidence: DataFrame, pointers: int = 6) -> DataFrame:
    """(case_id, place, round, sender, receiver, kind, verdict, component, reason, support, refute, evidence_ptrs): what the agents of each case say, in order.

    evidence: as ``candidate_evidence`` gives it; a shard is an agent. First (round 0) each agent proposes its strongest component to all;
    then each says of each peer's proposal whether its own evidence supports or challenges it, within its budget (its positive support
    over its number of peers), or abstains. An agent that is alone only proposes. An empty reason is ``unknown``.
    """
    none = F.array().cast("array<string>")
    proposed = _ordered(evidence).where("_at = 1").select(
        "case_id", F.lit(0).alias("round"), F.col("shard_id").alias("sender"), F.lit("all").alias("receiver"), F.lit("proposal").alias("kind"), F.lit(None).cast("string").alias("verdict"), "component", "reason",
        F.round("support_score", 6).alias("support"), F.round("refute_score", 6).alias("refute"), F.slice(F.coalesce("evidence_ptrs", none), 1, pointers).alias("evidence_ptrs"),
    )
    told = F.when(F.col("verdict") != "abstain", F.slice(F.coalesce("own.evidence_ptrs", none), 1, pointers)).otherwise(none)
    said = _reviews(evidence).select(
        "case_id", F.lit(1).alias("round"), F.col("agent").alias("sender"), F.col("peer").alias("receiver"), F.lit("peer_review").alias("kind"), "verdict", F.col("proposal").alias("component"), F.col("proposed_reason").alias("reason"),
        F.round("support", 6).alias("support"), F.round("refute", 6).alias("refute"), told.alias("evidence_ptrs"),
    )
    rows = proposed.unionByName(said).withColumn("reason", F.coalesce(F.nullif("reason", F.lit("")), F.lit("unknown")))
    order = Window.partitionBy("case_id").orderBy("round", "sender", "receiver")  # agents of a case, squared
    return rows.select("case_id", F.row_number().over(order).alias("place"), *rows.columns[1:])


def reviewed_evidence(evidence: DataFrame) -> DataFrame:
    """The evidence and, for each review that supports or challenges, the reviewer's own row with the review's weight instead, as rank 1.

    ``worker_id`` names the reviewer, null for evidence that was there before; the other columns are those of ``evidence``, so it can be fused.
    """
    kept = evidence.withColumn("worker_id", F.lit(None).cast("string"))
    new = {"support_score": F.col("support"), "refute_score": F.col("refute"), "local_rank": F.lit(1), "shard_id": F.col("agent")}
    columns = [(new[c] if c in new else F.col(f"own.{c}")).cast(evidence.schema[c].dataType).alias(c) for c in evidence.columns]
    said = _reviews(evidence).where("verdict <> 'abstain'").select(*columns, F.concat("agent", F.lit("_peer_review")).alias("worker_id"))
    return kept.unionByName(said)
