"""Reviews between agents and answers completed from the board, worked out by hand."""

import pytest

from rootloom.operators import opinions
from rootloom.operators.fusion import additive_fusion

EVIDENCE = "case_id string, shard_id string, component string, support_score double, refute_score double, local_rank int, modality string, reason string, evidence_ptrs array<string>, evidence array<struct<score:double,magnitude:double,signal:string,direction:string,window_start:double>>"


def test_reviews_stay_within_their_budget_and_are_fused(spark):
    rows = [
        ("k", "a", "X", 4.0, 0.0, 1, "metrics", "cpu", ["a1"], []), ("k", "a", "y", 2.0, 0.0, 2, "metrics", "", ["a2"], []),
        ("k", "b", "Y ", 3.0, 0.0, 1, "logs", "", ["b1"], []), ("k", "b", "x", 1.0, 9.0, 2, "logs", "mem", None, []),
        ("k", "c", "z", 1.0, 0.0, 1, "traces", "db", [], []), ("lone", "a", "x", 1.0, 0.0, 1, "logs", "cpu", ["p"], []),
    ]
    evidence = spark.createDataFrame(rows, EVIDENCE)
    said = [tuple(r) for r in opinions.review_transcript(evidence).orderBy("case_id", "place").collect()]
    # Budgets: a 6 / 2, b 3 / 2, c 1 / 2.
    assert said == [
        ("k", 1, 0, "a", "all", "proposal", None, "X", "cpu", 4.0, 0.0, ["a1"]), ("k", 2, 0, "b", "all", "proposal", None, "Y ", "unknown", 3.0, 0.0, ["b1"]), ("k", 3, 0, "c", "all", "proposal", None, "z", "db", 1.0, 0.0, []),
        ("k", 4, 1, "a", "b", "peer_review", "support", "Y ", "unknown", 2.0, 0.0, ["a2"]), ("k", 5, 1, "a", "c", "peer_review", "abstain", "z", "db", 0.0, 0.0, []),
        ("k", 6, 1, "b", "a", "peer_review", "challenge", "X", "cpu", 0.0, 1.5, []), ("k", 7, 1, "b", "c", "peer_review", "abstain", "z", "db", 0.0, 0.0, []),
        ("k", 8, 1, "c", "a", "peer_review", "abstain", "X", "cpu", 0.0, 0.0, []), ("k", 9, 1, "c", "b", "peer_review", "abstain", "Y ", "unknown", 0.0, 0.0, []),
        ("lone", 1, 0, "a", "all", "proposal", None, "x", "cpu", 1.0, 0.0, ["p"]),
    ]
    both = opinions.reviewed_evidence(evidence)
    new = {(r["shard_id"], r["component"]): (r["support_score"], r["refute_score"], r["local_rank"], r["worker_id"]) for r in both.where("worker_id is not null").collect()}
    assert new == {("a", "y"): (2.0, 0.0, 1, "a_peer_review"), ("b", "x"): (0.0, 1.5, 1, "b_peer_review")} and both.count() == 8
    scores = {(r["case_id"], r["component"].strip().lower()): r["score"] for r in additive_fusion(both).collect()}
    # x: 4 - 8 * 1.15 / sqrt(2) - 1.5 * 1.15; y: 2 / sqrt(2) + 3 * 1.15 + 2.
    assert scores == pytest.approx({("k", "x"): 4 - 9.2 / 2**0.5 - 1.725, ("k", "y"): 2 / 2**0.5 + 5.45, ("k", "z"): 1.15, ("lone", "x"): 1.15}, abs=1e-6)
    assert opinions.review_transcript(evidence.limit(0)).count() == opinions.reviewed_evidence(evidence.limit(0)).count() == 0


def test_an_answer_without_a_component_is_the_boards_first(spark):
    findings = spark.createDataFrame(
        [("k", "metrics", "svc-a", "cpu_load", "high", 1.0, 5.0, None, "p1"), ("k", "logs", "svc-a", "x", "high", 1.0, 2.0, 30.0, "p2"), ("k", "logs", "svc-b", "latency", "high", 1.0, 3.0, 10.0, "")],
        "case_id string, modality string, component string, signal string, direction string, magnitude double, score double, window_start double, evidence_ptr string",
    )
    raws = [("k", "1", "{}"), ("k", "2", None), ("k", "3", '{"component": " SVC-B", "confidence": "0.5", "occurrence_time": "t"}'), ("k", "4", '{"root": "svc-c", "reason": "r", "confidence": "NaN", "evidence": ["q"]}'), ("none", "5", '{"component": "  "}')]
    got = {r["worker_id"]: tuple(r)[2:] for r in opinions.opinion_answer(spark.createDataFrame(raws, "case_id string, worker_id string, raw string"), findings).collect()}
    first = ("svc-a", "cpu", 0.0, None, 30.0, ["p1", "p2"], 7.0)
    assert got == {"1": first, "2": first, "3": ("SVC-B", "delay", 0.5, "t", None, [], 3.0), "4": ("svc-c", "r", 0.0, None, None, ["q"], 0.0), "5": ("UNKNOWN", "unknown", 0.0, None, None, [], 0.0)}
