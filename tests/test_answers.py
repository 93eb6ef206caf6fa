"""Answers are parsed once a form, whatever is asked of them."""

import pytest
from pyspark.sql import functions as F

from rootloom.operators import scoring
from rootloom.plans import evaluation_queries as q

ROOT = '{"root cause component":"a","root_cause_reason":"r","root cause occurrence datetime":"2024-01-01 00:00:00"}'


@pytest.mark.parametrize("raw", [f'{{"1":{ROOT}}}', f"[{ROOT}]", f'{{"root_causes":[{ROOT}]}}', f'{{"root\\u005fcauses":[{ROOT}]}}', f' \n{{"root_causes":[{ROOT}]}}'])
def test_forms_of_answers(spark, raw):
    found = scoring.with_answer(spark.createDataFrame([(raw,)], "t string"), "t", "a").select("a.error", "a.roots").first()
    assert (found["error"], [tuple(r) for r in found["roots"]]) == (False, [("a", "r", "2024-01-01 00:00:00")])


def test_damaged_answers_have_no_roots(spark):
    rows = spark.createDataFrame([("no answer",), ('{"1":',), (None,), ('{"1":2}',)], "t string")
    assert [(r["a"]["error"], r["a"]["roots"]) for r in scoring.with_answer(rows, "t", "a").collect()] == [(True, [])] * 4


def test_times_are_read_as_by_their_pattern(spark):
    texts = ["2024-02-29 23:59:59", " 2024-01-01 00:00:00 ", "2023-02-29 00:00:00", "2024-01-01 24:00:00", "0000-01-01 00:00:00", "2024-01-01 00:00", "2024-01-01T00:00:00", "2024-1-1 0:0:0", "2024-01-01 00:00:60", "", None, "2024-01-01 00:00:00\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    want = F.unix_micros(F.try_to_timestamp(F.trim("t"), F.lit("yyyy-MM-dd HH:mm:ss"))) / 1e6
    for r in rows.select("t", scoring._seconds(F.col("t")).alias("got"), want.alias("want")).collect():
        assert r["got"] == r["want"], r["t"]


def test_each_answer_is_parsed_once(spark):
    plan = q._classified(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 3 and plan.count("Join") == 1
