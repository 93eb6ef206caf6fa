"""Edges of services: spans that share ids, nulls, and how often rows are dealt out."""

from rootloom.operators.graph import service_graph

SHAPE = "case_id string, span_id long, parent_id long, service string"


def test_edges_of_shared_ids_and_nulls(spark):
    rows = [("a", 1, None, " X"), ("a", 1, None, "x"), ("a", 1, None, "y"), ("a", 2, 1, "Z"), ("a", 2, 1, "z"), ("a", 3, 1, "x"), ("b", 2, 1, "z"), ("a", None, None, "n"), ("a", 4, None, ""), ("a", 5, 4, "z"), ("a", 6, 2, None), (None, 1, None, "x"), (None, 2, 1, "z")]
    found = service_graph(spark.createDataFrame(rows, SHAPE)).collect()
    assert sorted(tuple(r) for r in found) == [("a", "x", "z"), ("a", "y", "x"), ("a", "y", "z")]


def test_spans_are_dealt_out_once_a_side(spark):
    # Without broadcasts, as for tables of any size.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = service_graph(spark.createDataFrame([("a", 1, None, "x")], SHAPE))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(") == 3
