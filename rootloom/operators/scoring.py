"""Scoring of predictions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def same_name(name: Column) -> Column:
    return F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit("-"))


def score_join(predictions: DataFrame, cases: DataFrame) -> DataFrame:
    """Predictions with their case, the place of the true root (0: not there), hit at 1 and 3, and reciprocal rank."""
    rows = predictions.join(cases, "case_id")
    place = F.array_position(F.transform("ranked_roots", same_name), same_name(F.col("true_root")))
    rows = rows.withColumn("place", place)
    return rows.withColumns({"hit_at_1": F.when(F.col("place") == 1, 1).otherwise(0), "hit_at_3": F.when(F.col("place").between(1, 3), 1).otherwise(0), "mrr": F.when(F.col("place") > 0, 1.0 / F.col("place")).otherwise(0.0)})


FIELDS = ("component", "reason", "time_s")
_ROOT = "array<struct<component:string,reason:string,time_s:double>>"


def _seconds(text: Column) -> Column:
    text = F.trim(text)
    # Casts are far faster than patterns, and say the same of such texts.
    plain = text.rlike(r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z")
    return F.unix_micros(F.when(plain, text.try_cast("timestamp")).otherwise(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))) / 1e6


def scoring_points(text: Column) -> Column:
    """struct(components, reasons, times) of a prose list of scoring points, in order. The patterns are fixed values."""
    every = lambda pattern: F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1), lambda x: F.trim(x))
    which = r"The (?:\d+-th|only) "
    return F.struct(
        every(which + r"predicted root cause component is ([^\n]+)").alias("components"),
        every(which + r"predicted root cause reason is ([^\n]+)").alias("reasons"),
        every(which + r"root cause occurrence time is within 1 minutes \(i\.e\., <=1min\) of ([^\n]+)").alias("times"),
    )


def expected_roots(points: Column) -> Column:
    """One root for each place; fields that aren't told for every place are null."""
    n = F.greatest(F.size(points["components"]), F.size(points["reasons"]), F.size(points["times"]))
    told = lambda name, k: F.when(F.size(points[name]) == n, F.get(points[name], k))
    roots = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(told("components", k).alias("component"), told("reasons", k).alias("reason"), _seconds(told("times", k)).alias("time_s")))
    return F.when(n > 0, roots).otherwise(F.array().cast(_ROOT))


def with_answer(rows: DataFrame, raw: str, name: str) -> DataFrame:
    """``rows`` with struct(error, roots array of (component, reason, time)) of a JSON answer: an object of numbered roots, a list, or ``root_causes``; times stay texts.

    Each step is a column of its own, so a text is parsed once a form and not anew for each use.
    """
    item, text, start, kept = "map<string,string>", F.col(raw), F.col("_start"), rows.columns
    rows = rows.withColumn("_start", F.substring(F.ltrim(text), 1, 1))
    rows = rows.withColumns({"_listed": F.when(start == "[", F.from_json(text, f"array<{item}>")), "_named": F.when((start != "[") & (text.contains("root_causes") | text.contains("\\")), F.from_json(text, f"root_causes array<{item}>")["root_causes"])})  # names may be escaped
    rows = rows.withColumn("_numbered", F.when((start == "{") & F.col("_named").isNull(), F.from_json(text, f"map<string,{item}>")))
    in_order = F.array_sort(F.transform(F.map_keys("_numbered"), lambda k: F.struct(k.try_cast("int").alias("n"), k.alias("k"))))
    by_number = F.transform(in_order, lambda e: F.try_element_at("_numbered", e["k"]))
    complete = F.coalesce(F.forall(F.map_values("_numbered"), lambda v: v.isNotNull()), F.lit(False))
    rows = rows.withColumn("_items", F.when(start == "[", F.col("_listed")).when(F.col("_named").isNotNull(), F.col("_named")).when(start == "{", F.when(complete, by_number)))
    rows = rows.withColumn("_whole", F.coalesce(F.forall("_items", lambda m: m.isNotNull()), F.lit(False)))
    field = lambda m, *names: F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(n)), F.lit("")) for n in names], F.lit(""))
    read = lambda m: F.struct(field(m, "root cause component", "root_cause_component").alias("component"), field(m, "root cause reason", "root_cause_reason").alias("reason"), field(m, "root cause occurrence datetime", "root_cause_occurrence_datetime").alias("time"))
    rows = rows.withColumn("_roots", F.when(F.col("_whole"), F.transform("_items", read)).otherwise(F.array().cast("array<struct<component:string,reason:string,time:string>>")))
    return rows.select(*kept, F.struct((~F.col("_whole")).alias("error"), F.col("_roots").alias("roots")).alias(name))


def read_answers(rows: DataFrame) -> DataFrame:
    """``rows`` with the parsed ``scoring_points`` and ``prediction`` as ``_points`` and ``_answer``; as they are where they have them."""
    if "_answer" in rows.columns:
        return rows
    kept, parts = rows.columns, ("components", "reasons", "times")
    told = scoring_points(F.col("scoring_points"))
    rows = rows.withColumn("_told", told).select(*kept, *[F.col(f"_told.{c}").alias(f"_{c}") for c in parts])
    rows = rows.select(*kept, F.struct(*[F.col(f"_{c}").alias(c) for c in parts]).alias("_points"))
    return with_answer(rows, "prediction", "_answer")


def assignment(gains: list[list[int]]) -> list[int]:
    """The column of each row in a one-to-one assignment of the greatest gain; of equally good ones the first in order. Square, whole numbers.

    Shortest augmenting paths with potentials. Each row's column is written as a digit behind the gain, so that equals differ; numbers of any size are exact.
    """
    n = len(gains)
    cost = [[j * (n + 1) ** (n - 1 - i) - gains[i][j] * (n + 1) ** n for j in range(n)] for i in range(n)]
    of_row, of_column, owner = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # potentials, and the row of each column (from 1, 0: none)
    for i in range(1, n + 1):
        owner[0], at, way = i, 0, [0] * (n + 1)
        least: list[int | None] = [None] * (n + 1)
        used = [False] * (n + 1)
        while True:
            used[at] = True
            row, best = owner[at], None
            for j in range(1, n + 1):
                if used[j]:
                    continue
                reduced = cost[row - 1][j - 1] - of_row[row] - of_column[j]
                if least[j] is None or reduced < least[j]:
                    least[j], way[j] = reduced, at
                if best is None or least[j] < least[best]:
                    best = j
            step = least[best]
            for j in range(n + 1):
                if used[j]:
                    of_row[owner[j]] += step
                    of_column[j] -= step
                elif least[j] is not None:
                    least[j] -= step
            at = best
            if owner[at] == 0:
                break
        while at:
            owner[at], at = owner[way[at]], way[at]
    out = [0] * n
    for j in range(1, n + 1):
        out[owner[j] - 1] = j - 1
    return out


def best_assignment(rows: DataFrame, fits: Column, within_s: float) -> DataFrame:
    """``rows`` (expected, predicted) with ``_best``, a struct(score, path): the most matching fields over all ways to give each expected root a predicted one, and which; null where ``fits`` doesn't hold.

    Exact for lists of any length, in steps of their third power. Of equally good ways the one that comes first in order. Lists that
    fit have the same length, which isn't 0.
    """
    hit = lambda a: F.when(a, 1).otherwise(0)

    def match(e, p):
        return hit(e["component"] == p["component"]) + hit(e["reason"] == p["reason"]) + hit(F.abs(e["time_s"] - p["time_s"]) <= within_s)

    gains = F.when(fits, F.transform("expected", lambda e: F.transform("predicted", lambda p: match(e, p))))
    asked = rows.withColumn("_gains", gains)
    shape = T.StructType([*rows.schema.fields, T.StructField("_best", T.StructType([T.StructField("score", T.IntegerType()), T.StructField("path", T.ArrayType(T.IntegerType()))]))])
    arrow = pa.struct([("score", pa.int32()), ("path", pa.list_(pa.int32()))])

    def solve(batches):
        for batch in batches:
            # Different gains of a batch are solved once.
            known, found = {}, []
            for g in batch.column(batch.num_columns - 1).to_pylist():
                key = None if g is None else tuple(map(tuple, g))
                if g is not None and key not in known:
                    path = assignment(g)
                    known[key] = {"score": sum(row[j] for row, j in zip(g, path)), "path": path}
                found.append(known.get(key))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, arrow)], shape.names)

    return asked.mapInArrow(solve, shape)


def field_score(rows: DataFrame, keys: list[str], within_s: float = 60.0, asked: Column | None = None) -> DataFrame:
    """(keys, score, passed, failed): the best assignment of predicted to expected roots, as the share of expected fields that match, 2 places.

    Roots are structs (component, reason, time_s); null fields of the expected ones aren't asked for. Lists of different
    lengths match nothing. passed and failed: the expected fields as texts, passed in the order of the roots, failed each once,
    in order. ``asked``: number of fields to divide by (default: those that aren't null).
    """
    rows = rows.select(*keys, "expected", "predicted", (F.lit(None) if asked is None else asked).cast("int").alias("_given"))
    fits = (F.size("expected") == F.size("predicted")) & (F.size("expected") > 0)
    rows = best_assignment(rows, fits, within_s)
    text = lambda e, f: e[f] if f != "time_s" else F.date_format(F.timestamp_seconds(e[f]), "yyyy-MM-dd HH:mm:ss")
    same = lambda e, p, f: F.abs(e[f] - p[f]) <= within_s if f == "time_s" else e[f] == p[f]

    def hits(e, i):
        p = F.get("predicted", F.get(F.col("_best.path"), i))
        return F.array_compact(F.array(*[F.when(same(e, p, f), text(e, f)) for f in FIELDS]))

    passed = F.when(F.col("_best.score") > 0, F.flatten(F.transform("expected", hits))).otherwise(F.array().cast("array<string>"))
    fields = F.flatten(F.transform("expected", lambda e: F.array_compact(F.array(*[text(e, f) for f in FIELDS]))))
    n = F.coalesce("_given", F.size(fields))
    return rows.select(*keys, F.round(F.when(n > 0, F.coalesce("_best.score", F.lit(0)) / n).otherwise(0.0), 2).alias("score"), passed.alias("passed"), F.array_sort(F.array_except(fields, passed)).alias("failed"))


def score_answers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """field_score of JSON answers (``prediction``) against prose scoring points (``scoring_points``), with strict_correct.

    A field that the points don't tell for every root counts as asked, but can't be matched; a prediction that can't be read
    has no roots.
    """
    given = F.size("_told.components") + F.size("_told.reasons") + F.size("_told.times")
    found = read_answers(rows).select(*keys, F.col("_points").alias("_told"), F.col("_answer").alias("_said"))
    predicted = F.transform("_said.roots", lambda r: F.struct(r["component"].alias("component"), r["reason"].alias("reason"), _seconds(r["time"]).alias("time_s")))
    found = found.withColumns({"expected": expected_roots(F.col("_told")), "predicted": predicted})
    scored = field_score(found.withColumn("_n", given), keys, asked=F.col("_n"))
    return scored.withColumn("strict_correct", F.col("score") == 1.0)


#: What an answer can be wrong in.
ERROR_KINDS = ("format", "multi_root_count", "missing_field", "invalid_catalog", "component", "reason", "time", "unknown")


def error_taxonomy(rows: DataFrame, keys: list[str], components: list[str], reasons: list[str]) -> DataFrame:
    """(keys, strict_correct, categories, predicted_component, predicted_reason) of JSON answers against prose scoring points.

    Several categories may hold; a strictly correct answer has none, any other without one is unknown. Times are compared in
    their order, within a minute. ``components`` and ``reasons``: the catalogue.
    """
    rows = read_answers(rows).select(*keys, "strict_correct", F.col("_points").alias("_e"), F.col("_answer").alias("_a")).withColumn("_n", F.size("_a.roots"))
    count = F.greatest(F.size("_e.components"), F.size("_e.reasons"), F.size("_e.times"))
    roots = F.col("_a.roots")
    lists = (("components", "component"), ("reasons", "reason"), ("times", "time"))
    asked = {one: F.size(F.col(f"_e.{many}")) > 0 for many, one in lists}
    empty = lambda one: (F.col("_n") == 0) | F.exists(roots, lambda r: r[one] == "")
    lacking = F.lit(False)
    for one, wanted in asked.items():
        lacking = lacking | (wanted & empty(one))
    foreign = F.exists(roots, lambda r: ((r["component"] != "") & ~r["component"].isin(components)) | ((r["reason"] != "") & ~r["reason"].isin(reasons)))
    differs = lambda many, one: asked[one] & (F.array_sort(F.col(f"_e.{many}")) != F.array_sort(F.transform(roots, lambda r: r[one])))
    pairs = F.zip_with(F.array_sort("_e.times"), F.array_sort(F.transform(roots, lambda r: r["time"])), lambda e, p: F.coalesce(F.abs(_seconds(e) - _seconds(p)) <= 60, F.lit(False)))
    late = asked["time"] & ((F.size("_e.times") != F.col("_n")) | F.exists(pairs, lambda x: ~x))
    tests = (F.col("_a.error"), (count > 0) & (F.col("_n") != count), lacking, foreign, differs("components", "component"), differs("reasons", "reason"), late)
    found = F.array_compact(F.array(*[F.when(test, kind) for test, kind in zip(tests, ERROR_KINDS)]))
    rows = rows.withColumn("_found", found)
    kinds = F.when(F.col("strict_correct"), F.array().cast("array<string>")).when(F.size("_found") > 0, F.col("_found")).otherwise(F.array(F.lit(ERROR_KINDS[-1])))
    first = lambda one: F.coalesce(F.nullif(F.get(roots, 0)[one], F.lit("")), F.lit("missing"))
    return rows.select(*keys, "strict_correct", kinds.alias("categories"), first("component").alias("predicted_component"), first("reason").alias("predicted_reason"))


def bias_tables(classified: DataFrame, columns: list[str], system: str = "system") -> DataFrame:
    """(kind, value, n): of the answers that aren't strictly correct, how often each value of ``columns`` comes, and each category by system."""
    wrong = classified.where(~F.col("strict_correct"))
    values = F.array(*[F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("value")) for c in columns])
    by_system = F.transform("categories", lambda k: F.struct(F.lit("by_system_category").alias("kind"), F.concat(F.col(system), F.lit(":"), k).alias("value")))
    return wrong.select(F.explode(F.concat(values, by_system)).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


ARTIFACTS = """falsifier struct<selected:string>, fusion_candidates array<struct<component:string>>, worker_distributions array<struct<worker_id:string,candidates:array<struct<component:string>>>>, candidate_catalog_source map<string,string>"""


def artifact_diagnostics(rows: DataFrame, raw: str = "artifacts") -> DataFrame:
    """(kind, value, n) from JSON artifacts: the falsifier's choices, the fused and each worker's first component, sources of the catalogue."""
    a = rows.select(F.from_json(raw, ARTIFACTS).alias("a")).where("a is not null")
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    source = F.transform(F.array_sort(F.map_entries("a.candidate_catalog_source")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    single = F.array_compact(F.array(
        F.when(F.col("a.falsifier").isNotNull(), entry("falsifier_selected", F.coalesce(F.nullif("a.falsifier.selected", F.lit("")), F.lit("unknown")))),
        F.when(F.size("a.fusion_candidates") > 0, entry("fusion_top_component", F.coalesce(F.nullif(F.get("a.fusion_candidates", 0)["component"], F.lit("")), F.lit("missing")))),
        F.when(F.col("a.candidate_catalog_source").isNotNull(), entry("candidate_catalog_source", F.array_join(source, ","))),
    ))
    led = F.filter(F.coalesce("a.worker_distributions", F.array().cast("array<struct<worker_id:string,candidates:array<struct<component:string>>>>")), lambda w: F.size(w["candidates"]) > 0)
    tops = F.transform(led, lambda w: entry("worker_top_component", F.concat_ws(":", w["worker_id"], F.get(w["candidates"], 0)["component"])))
    return a.select(F.explode(F.concat(single, tops)).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))
