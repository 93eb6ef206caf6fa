"""Weights of fusion and of both re-rankings, fitted on labelled cases: a grid over all cases in one plan, with held-out cases beside it."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootloom.operators.findings import best
from rootloom.operators.fusion import modality_weight, pooled_under, worker_correlation
from rootloom.session import written

#: The grids of additive fusion (boost, gamma, beta), and of the opinion pool (boost, rho, temperature, gamma, beta).
ADDITIVE_GRID = ((1.0,), (0.0, 2.0), (0.0, 0.5, 1.0, 2.0, 4.0, 8.0))
POOL_GRID = ((1.0, 1.2, 1.5, 2.0), (0.0, 0.5, 1.0), (1.0, 2.0), (0.0, 1.0, 2.0), (0.0, 1.0, 2.0))


def same_name(name: Column) -> Column:
    """A name as it is compared with the truth: trimmed, in lower case, with hyphens for underscores."""
    return F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit("-"))


def boosted(modality: Column, boost: Column) -> Column:
    """The weight of a modality under a boost of logs and traces; without a boost, the weights of plain fusion."""
    of = F.when(modality.isin("logs", "traces"), boost).when(modality == "events", 1 + (boost - 1) / 2).when(modality == "auxiliary", 0.8).otherwise(1.0)
    return F.when(boost.isNull(), modality_weight(modality)).otherwise(of)


def fused_under(evidence: DataFrame, boosts: list[float | None], most: int = 5) -> DataFrame:
    """(boost, case_id, component, score, rank): the ``most`` best components of each case under each boost (none: plain fusion).

    A boost only weighs modalities, so evidence is summed by modality first and those sums are repeated for each boost, not the evidence.
    """
    name = F.lower(F.trim("component"))
    sums = evidence.withColumn("component", name).where("component <> ''").groupBy("case_id", "component", "modality").agg(F.sum((F.col("support_score") - F.col("refute_score")) / F.sqrt(F.greatest("local_rank", F.lit(1)))).alias("_s"))
    each = sums.withColumn("boost", F.explode(F.array(*[F.lit(b).cast("double") for b in boosts])))
    scores = each.groupBy("boost", "case_id", "component").agg(F.round(F.sum(F.col("_s") * boosted(F.col("modality"), F.col("boost"))), 6).alias("score"))
    return best(scores, ["boost", "case_id"], [F.col("score").desc(), "component"], most, rank="rank")


def reordered(rows: DataFrame, keys: list[str], coverage: DataFrame, onsets: DataFrame) -> DataFrame:
    """``rows`` with ``place`` and ``sure``: ranked anew by coverage (gamma), then by precedence (beta), and the confidence of each.

    rows: (keys, case_id, component, score, rank, confidence, gamma, beta); coverage: (case_id, component, coverage); onsets: (case_id,
    component, precedence). A gain of 0, or a case without a graph or an onset, leaves order and confidence as they were; of equal
    scores the one that was ahead stays ahead. A re-ranked score is rounded to six places, as the next step reads it.
    """
    of, name = Window.partitionBy(*keys), F.lower(F.trim("component"))
    for table, factor, gain, cases in ((coverage, "coverage", "gamma", "_graph"), (onsets, "precedence", "beta", "_onset")):
        known = table.groupBy("case_id", name.alias("_name")).agg(F.max(factor).alias(factor))
        rows = rows.withColumn("_name", name).join(known, ["case_id", "_name"], "left").drop("_name")
        rows = rows.join(table.select("case_id", F.lit(True).alias(cases)).distinct(), "case_id", "left")
        rows = rows.withColumn("_on", (F.col(gain) > 0) & F.coalesce(cases, F.lit(False)))
        rows = rows.withColumn("_s", F.when(F.col("_on"), F.col("score") * (1 + F.col(gain) * F.coalesce(factor, F.lit(0.0)))).otherwise(F.col("score")))
        total = F.sum("_s").over(of)
        share = F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col("_s") / F.when(total == 0, 1.0).otherwise(total)))
        rows = rows.withColumns({"_place": F.row_number().over(of.orderBy(F.col("_s").desc(), "rank")), "confidence": F.when(F.col("_on"), share).otherwise(F.col("confidence"))})
        rows = rows.withColumns({"score": F.when(F.col("_on"), F.round("_s", 6)).otherwise(F.col("score")), "rank": F.col("_place")}).drop("_on", "_s", "_place", cases, factor)
    return rows.withColumnsRenamed({"rank": "place", "confidence": "sure"})


def case_scores(ranked: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, columns of ``asked``, rr, right, error) of each asked row (keys, true_root): reciprocal rank, hit, and how far off the winner's confidence is.

    Without a ranking the rank counts as 0, and nothing was claimed.
    """
    hit = same_name(F.col("component")) == same_name(F.col("true_root"))
    found = asked.hint("merge").join(ranked, keys, "left").groupBy(*asked.columns).agg(F.coalesce(1.0 / F.min(F.when(hit, F.col("place"))), F.lit(0.0)).alias("rr"), F.coalesce(F.max(F.when(F.col("place") == 1, F.col("sure"))), F.lit(0.0)).alias("_sure"))
    right = F.when(F.col("rr") == 1.0, 1.0).otherwise(0.0)
    return found.select(*asked.columns, "rr", right.alias("right"), F.pow(F.col("_sure") - right, 2).alias("error"))


def _mean(column: str, digits: int, where: Column | None = None) -> Column:
    value = F.col(column) if where is None else F.when(where, F.col(column))
    return F.coalesce(F.round(F.round(F.avg(value), 9), digits), F.lit(0.0))


def _listed(trials: list[tuple], names: list[str]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(k).alias("trial"), *[F.lit(x).cast("double").alias(n) for n, x in zip(names, t, strict=True)]) for k, t in enumerate(trials)]))


def fit_additive(evidence: DataFrame, coverage: DataFrame, onsets: DataFrame, truth: DataFrame, boosts=ADDITIVE_GRID[0], gammas=ADDITIVE_GRID[1], betas=ADDITIVE_GRID[2]) -> DataFrame:
    """(trial, boost, gamma, beta, dev_n, dev_hit_at_1, dev_mrr, val_n, val_hit_at_1, val_mrr, chosen), a row for each setting of fusion and re-ranking.

    truth: (case_id, true_root, split), split ``dev`` or ``val``. Chosen is the setting of best hit@1, then mean reciprocal rank (both of four
    places) over the dev cases alone, the first of equals; trial 0 is plain fusion without a boost (null) or re-ranking, so it
    stays unless another is better. Held-out cases are scored, never looked at. Cases without evidence count with rank 0, equal rows of
    ``truth`` count once, and without any case there are no rows.
    """
    trials = [(None, 0.0, 0.0), *product(boosts, gammas, betas)]
    names = ["boost", "gamma", "beta"]
    grid = _listed(trials, names)
    fused = written(fused_under(evidence, [None, *boosts]), "fused-grid")
    rows = fused.withColumnRenamed("boost", "_b").withColumn("_t", grid).where("_t.boost <=> _b").select("_t.*", "case_id", "component", "score", "rank", F.lit(0.0).alias("confidence"))
    ranked = reordered(rows, ["trial", "case_id"], coverage, onsets).select("trial", "case_id", "component", "place", "sure")
    asked = truth.select("case_id", "true_root", "split").distinct().withColumn("_t", grid).select("_t.*", "case_id", "true_root", "split")
    dev, val = F.col("split") == "dev", F.col("split") == "val"
    scores = case_scores(ranked, asked, ["trial", "case_id"]).groupBy("trial", *names).agg(
        F.count_if(dev).alias("dev_n"), _mean("right", 4, dev).alias("dev_hit_at_1"), _mean("rr", 4, dev).alias("dev_mrr"),
        F.count_if(val).alias("val_n"), _mean("right", 4, val).alias("val_hit_at_1"), _mean("rr", 4, val).alias("val_mrr"),
    )
    order = Window.orderBy(F.col("dev_hit_at_1").desc(), F.col("dev_mrr").desc(), "trial")  # a row for each setting
    return scores.withColumn("chosen", F.row_number().over(order) == 1)


def fit_pool(explicit: DataFrame, workers: DataFrame, pairs: DataFrame, vectors: DataFrame, coverage: DataFrame, onsets: DataFrame, truth: DataFrame, grid=POOL_GRID) -> DataFrame:
    """(trial, boost, rho, temperature, gamma, beta, n_cases, hit_at_1, mrr, brier, chosen), a row for each setting of the opinion pool and of re-ranking.

    Opinions are pooled once for each (boost, rho, temperature), and those few candidates are re-ranked for each (gamma, beta). Chosen is
    the setting of best hit@1, then mean reciprocal rank, then the least Brier score, the first of equals. truth: (case_id, true_root), its
    cases are those declared for fitting. See ``grid_search`` for the other tables.
    """
    pools, gains = list(product(*grid[:3])), list(product(*grid[3:]))
    correlation = written(worker_correlation(vectors), "correlation")
    pooled = pooled_under(pools, explicit, workers, pairs, correlation)
    pooled = written(pooled.select(F.col("param_id").alias("pool"), "case_id", "component", F.col("posterior").alias("score"), "rank", F.col("posterior").alias("confidence")), "pooled-grid")
    names = ["boost", "rho", "temperature", "gamma", "beta"]
    # Cases without a graph and an onset are ranked alike under all gains, so they are scored once a pool.
    moved = written(coverage.select("case_id").union(onsets.select("case_id")).distinct(), "moved")
    truth = truth.select("case_id", "true_root").distinct()
    gain = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(g).alias("gamma"), F.lit(b).alias("beta")) for k, (g, b) in enumerate(gains)]))
    trial = (F.col("pool") * len(gains) + F.col("_g.k")).cast("int").alias("trial")
    every_pool = F.explode(F.sequence(F.lit(0), F.lit(len(pools) - 1))).alias("pool")
    sums = [F.count("*").alias("n"), *[F.sum(x).alias(x) for x in ("right", "rr", "error")]]
    rows = pooled.join(moved, "case_id", "left_semi").withColumn("_g", gain).select(trial, "case_id", "component", "score", "rank", "confidence", "_g.gamma", "_g.beta")
    ranked = reordered(rows, ["trial", "case_id"], coverage, onsets).select("trial", "case_id", "component", "place", "sure")
    asked = truth.join(moved, "case_id", "left_semi").select("*", every_pool).withColumn("_g", gain).select(trial, "case_id", "true_root")
    moving = case_scores(ranked, asked, ["trial", "case_id"]).groupBy("trial").agg(*sums)
    ranked = pooled.join(moved, "case_id", "left_anti").select("pool", "case_id", "component", F.col("rank").alias("place"), F.col("confidence").alias("sure"))
    asked = truth.join(moved, "case_id", "left_anti").select("*", every_pool)
    staying = case_scores(ranked, asked, ["pool", "case_id"]).groupBy("pool").agg(*sums).withColumn("_g", gain).select(trial, "n", "right", "rr", "error")
    setting = F.get(F.array(*[F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(names, p + g)]) for p in pools for g in gains]), F.col("trial")).alias("_t")
    share = lambda x, digits: F.round(F.round(F.sum(x) / F.sum("n"), 9), digits)
    scores = moving.unionByName(staying).groupBy("trial").agg(F.sum("n").alias("n_cases"), share("right", 4).alias("hit_at_1"), share("rr", 4).alias("mrr"), share("error", 6).alias("brier"))
    scores = scores.select("trial", setting, "n_cases", "hit_at_1", "mrr", "brier").select("trial", "_t.*", "n_cases", "hit_at_1", "mrr", "brier")
    order = Window.orderBy(F.col("hit_at_1").desc(), F.col("mrr").desc(), "brier", "trial")  # a row for each setting
    return scores.withColumn("chosen", F.row_number().over(order) == 1)
