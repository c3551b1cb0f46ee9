"""Evaluation operators: truth against predictions, agreement, calibration, intervals, percentiles, drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlens.functions.values import ratio, wilson


def match_fields(truth: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """All truth rows with their prediction, if any; predictions without truth are left out."""
    return truth.join(predictions, keys, "left")


def share(condition: Column) -> Column:
    """The share of rows for which a condition holds; null counts as not holding."""
    return F.avg(F.when(F.coalesce(condition, F.lit(False)), 1.0).otherwise(0.0))


def by_dimensions(df: DataFrame, dimensions: list[str], **aggregates: Column) -> DataFrame:
    """One row for all rows and one for each value of each dimension, in one pass: dimension, value, aggregates."""
    sets = df.groupingSets([[], *[[F.col(d)] for d in dimensions]], *[F.col(d) for d in dimensions])
    out = sets.agg(F.grouping_id().alias("__set"), *[a.alias(k) for k, a in aggregates.items()])
    full = (1 << len(dimensions)) - 1
    named = [(F.col("__set") == full - (1 << (len(dimensions) - 1 - k)), d) for k, d in enumerate(dimensions)]
    dimension = reduce(lambda c, n: c.when(n[0], n[1]), named, F.when(F.col("__set") == full, "all"))
    value = reduce(lambda c, n: c.when(n[0], F.col(n[1]).cast("string")), named, F.when(F.col("__set") == full, "all"))
    return out.select(dimension.alias("dimension"), value.alias("value"), *aggregates)


def accuracy_summary(matched: DataFrame, dimensions: list[str], expected: str, actual: str, accepted: Column) -> DataFrame:
    """Counts, accuracy, missing, false accepts and false reviews, overall and by dimension; empty equals null."""
    right = F.coalesce(F.col(expected).cast("string"), F.lit("")) == F.coalesce(F.col(actual).cast("string"), F.lit(""))
    taken = F.coalesce(accepted, F.lit(False))
    return by_dimensions(
        matched, dimensions,
        n=F.count(F.lit(1)), accuracy=F.round(share(right), 6), missing=F.round(share(F.col(actual).isNull()), 6),
        false_accepts=F.count_if(taken & ~right), false_reviews=F.count_if(~taken & right),
    )


def pareto(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows by key, most first, with shares and running shares."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    order = W.orderBy(F.desc("n"), *by)
    total = F.sum("n").over(W.partitionBy())
    running = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))
    return counts.select(*by, "n", F.round(F.col("n") / total, 6).alias("share"), F.round(running / total, 6).alias("running_share"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """For every label of either side: hits, false positives and negatives, precision and recall (0 without rows)."""
    cells = confusion(df, truth, predicted)
    label = F.explode(F.array_distinct(F.array(F.col(truth).cast("string"), F.col(predicted).cast("string")))).alias("label")
    each = cells.select(label, F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p"), "n")
    at = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = each.groupBy("label").agg(
        at((F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))).alias("tp"),
        at((F.col("t") != F.col("label")) & (F.col("p") == F.col("label"))).alias("fp"),
        at((F.col("t") == F.col("label")) & (F.col("p") != F.col("label"))).alias("fn"),
    )
    return out.select(
        "label", "tp", "fp", "fn", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"),
        F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"),
    )


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, raw agreement and Cohen's kappa of two raters; kappa is 1 where chance agreement is total."""
    cells = confusion(df, a, b)
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("agree"))
    margins = cells.select(F.col(a).alias("k"), F.col("n").alias("na"), F.lit(0).alias("nb")).union(cells.select(F.col(b), F.lit(0), F.col("n")))
    chance = margins.groupBy("k").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")).agg(F.sum(F.col("na") * F.col("nb")).alias("product"))
    observed, expected = F.col("agree") / F.col("n"), F.col("product") / (F.col("n") * F.col("n"))
    value = F.when(expected == 1, 1.0).otherwise((observed - expected) / (1 - expected))
    return total.crossJoin(chance).select("n", F.round(observed, 6).alias("agreement"), F.round(value, 6).alias("kappa"))


def reliability(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """Rows, mean score and share of positives for each bin of scores."""
    bin_of = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(bin_of.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("positive")
    )


def calibration(df: DataFrame, score: str, label: str, bins: int = 10, threshold: float = 0.5) -> DataFrame:
    """Brier score, expected calibration error, and precision and coverage at a threshold."""
    y, accept = F.col(label).cast("double"), F.col(score) >= threshold
    overall = df.agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(score) - y) ** 2).alias("brier"), F.avg(accept.cast("double")).alias("coverage"),
        F.avg(F.when(accept, y)).alias("precision"),
    )
    curve = reliability(df, score, label, bins)
    gap = curve.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("positive"))) / F.sum("n")).alias("ece"))
    return overall.crossJoin(gap).select("n", *[F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c) for c in ("brier", "ece", "precision", "coverage")])


#: The percentile definitions in use; they differ, so each has its name.
def nearest_rank(value: str, q: float) -> Column:
    """The smallest value with at least a share q of the values at or below it."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def floor_index(value: str, q: float) -> Column:
    """The value at index floor(q (n - 1)) of the sorted values."""
    values = F.array_sort(F.collect_list(value))
    return F.get(values, F.floor(F.lit(q) * (F.size(values) - 1)).cast("int"))


def upper_median(value: str) -> Column:
    """The value at index n / 2 of the sorted values."""
    values = F.array_sort(F.collect_list(value))
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def latency_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"),
        *[F.round(nearest_rank(value, q), 6).alias(f"p{round(q * 100)}") for q in (0.5, 0.95, 0.99)],
    )


def gates(row: DataFrame, conditions: dict[str, Column], keep: list[str]) -> DataFrame:
    """The names of the gates that a row fails, in order; a null condition fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in conditions.items()]), lambda g: g.isNotNull())
    return row.select(*keep, failed.alias("__failed")).select(*keep, F.array_join("__failed", ",").alias("blockers"), (F.size("__failed") == 0).alias("passed"))


#: What shadow traffic has to reach before it may serve.
SHADOW_POLICY = {
    "claims": 300, "accepted_critical": 1000, "review": 0.2, "review_upper": 0.25, "segment_review": 0.3, "false_accepts": 0.001, "critical_false_accepts": 0, "critical_precision": 0.999, "crop_recall": 0.95,
}


def shadow_gates(rows: DataFrame, prohibited: DataFrame, policy: dict[str, float]) -> DataFrame:
    """The rates of shadow claims and the gates that they fail, in one row.

    ``rows`` (claim_id, segment, group_id, review, locked, shadow_only, parity, governed, and numbers of fields accepted,
    accepted_critical, correct_critical, false_accepts, critical_false_accepts, wrong_crops, crops_found); ``prohibited``
    names group_ids of training and calibration. A rate of nothing fails its gate.
    """
    flags = {"locked": "LOCKED_HOLDOUT", "parity": "RUNTIME_PARITY", "governed": "ROUTE_GOVERNANCE", "shadow_only": "SHADOW_ONLY"}
    numbers = ("accepted", "accepted_critical", "correct_critical", "false_accepts", "critical_false_accepts", "wrong_crops", "crops_found")
    met = rows.join(prohibited.select("group_id").distinct().withColumn("__hit", F.lit(True)), "group_id", "left")
    per = met.groupBy("segment").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("review").alias("k"), F.coalesce(F.bool_or("__hit"), F.lit(False)).alias("hit"), *[F.bool_and(F.coalesce(c, F.lit(False))).alias(c) for c in flags], *[F.sum(c).alias(c) for c in numbers]
    )
    total = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("claims"), F.sum("k").alias("k"), F.max(F.col("k") / F.col("n")).alias("segment_review"), F.bool_or("hit").alias("hit"), *[F.bool_and(c).alias(c) for c in flags], *[F.sum(c).alias(c) for c in numbers]
    )
    n, k = F.col("claims").cast("double"), F.col("k").cast("double")
    rates = {
        "review": ratio(k, n), "review_upper": wilson(k, n), "segment_review": F.col("segment_review"), "false_accept_rate": ratio(F.col("false_accepts"), F.col("accepted")),
        "critical_precision": ratio(F.col("correct_critical"), F.col("accepted_critical")), "crop_recall": ratio(F.col("crops_found"), F.col("wrong_crops")),
    }
    row = total.select("*", *[F.round(c, 6).alias(f"r_{name}") for name, c in rates.items()])
    conditions = {
        "LOCKED_HOLDOUT": F.col("locked"), "SOURCE_DISJOINT": ~F.coalesce("hit", F.lit(False)), "MINIMUM_CLAIMS": F.col("claims") >= policy["claims"], "MINIMUM_ACCEPTED_CRITICAL_FIELDS": F.col("accepted_critical") >= policy["accepted_critical"],
        "CLAIM_HITL": F.col("r_review") <= policy["review"], "CLAIM_HITL_UPPER_95": F.col("r_review_upper") < policy["review_upper"], "SEGMENT_CLAIM_HITL": F.col("r_segment_review") <= policy["segment_review"],
        "FALSE_ACCEPT_RATE": F.col("r_false_accept_rate") <= policy["false_accepts"], "CRITICAL_FALSE_ACCEPTS": F.col("critical_false_accepts") <= policy["critical_false_accepts"],
        "CRITICAL_ACCEPTED_PRECISION": F.col("r_critical_precision") >= policy["critical_precision"], "WRONG_CROP_RECALL": F.col("r_crop_recall") >= policy["crop_recall"],
        "RUNTIME_PARITY": F.col("parity"), "ROUTE_GOVERNANCE": F.col("governed"), "SHADOW_ONLY": F.col("shadow_only"),
    }
    out = gates(row.select(F.struct("*").alias("r"), "*"), conditions, ["r"])
    return out.select("r.claims", *[F.col(f"r.r_{name}").alias(name) for name in rates], "blockers", "passed")


def routing_summary(rows: DataFrame, by: str, expected: str, predicted: str, route: str, expected_route: str, standard: tuple[str, ...], fixed: tuple[str, ...], latency: str) -> DataFrame:
    """Of each group and of all (group ALL): documents, accuracy of family and route, precision and recall of the standard families, standard routes given to other documents, and latency."""
    known, nominated = F.col(expected).isin(*standard), F.col(predicted).isin(*standard)
    hit = F.coalesce(F.col(expected) == F.col(predicted), F.lit(False))
    found = rows.groupingSets([[F.col(by)], []], F.col(by)).agg(
        F.grouping(by).alias("__all"), F.count(F.lit(1)).alias("documents"), F.round(F.avg(hit.cast("int")), 6).alias("family_accuracy"),
        F.round(F.avg(F.coalesce(F.col(route) == F.col(expected_route), F.lit(False)).cast("int")), 6).alias("route_accuracy"),
        F.round(ratio(F.count_if(nominated & known), F.count_if(nominated)), 6).alias("nomination_precision"), F.round(ratio(F.count_if(known & hit), F.count_if(known)), 6).alias("nomination_recall"),
        F.count_if(~known & F.col(route).isin(*fixed)).alias("false_standard"), F.round(nearest_rank(latency, 0.95), 6).alias("p95"), F.round(F.avg(latency), 4).alias("mean"),
    )
    return found.withColumn(by, F.when(F.col("__all") == 1, "ALL").otherwise(F.col(by))).drop("__all")


def segment_rates(df: DataFrame, segment: str, event: Column) -> DataFrame:
    """Rate of an event by segment with the bounds of its score interval."""
    out = df.groupBy(segment).agg(F.count(F.lit(1)).alias("n"), F.count_if(event).alias("k"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    return out.select(
        segment, "n", "k", F.round(k / n, 6).alias("rate"), (F.round(wilson(k, n, upper=False), 6) + F.lit(0.0)).alias("lower"), F.round(wilson(k, n), 6).alias("upper")
    )


def worst_and_best(per_source: DataFrame, source: str, higher: dict[str, bool]) -> DataFrame:
    """metric, worst, median (upper) and best over sources, by each metric's direction."""
    pairs = ", ".join(f"'{m}', {m}" for m in higher)
    long = per_source.select(source, F.expr(f"stack({len(higher)}, {pairs}) AS (metric, v)"))
    up = F.col("metric").isin([m for m, h in higher.items() if h])
    out = long.groupBy("metric").agg(F.min("v").alias("low"), F.max("v").alias("high"), upper_median("v").alias("median"))
    return out.select("metric", F.when(up, F.col("low")).otherwise(F.col("high")).alias("worst"), "median", F.when(up, F.col("high")).otherwise(F.col("low")).alias("best"))


def drift(df: DataFrame, run: str, first: str, second: str, features: list[str]) -> DataFrame:
    """For each feature: both runs' mean, median, p10, p90 and share of zeros, and Cohen's d with pooled variance."""
    pairs = ", ".join(f"'{f}', CAST({f} AS DOUBLE)" for f in features)
    long = df.filter(F.col(run).isin(first, second)).select(F.col(run).alias("run"), F.expr(f"stack({len(features)}, {pairs}) AS (feature, v)"))
    stats = long.groupBy("feature", "run").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), nearest_rank("v", 0.5).alias("p50"), nearest_rank("v", 0.1).alias("p10"),
        nearest_rank("v", 0.9).alias("p90"), F.avg((F.col("v") == 0).cast("double")).alias("zeros"), F.var_samp("v").alias("var"),
    )
    side = lambda r, p: stats.filter(F.col("run") == r).select("feature", *[F.col(c).alias(f"{p}_{c}") for c in stats.columns[2:]])
    both = side(first, "a").join(side(second, "b"), "feature")
    pooled = ((F.col("a_n") - 1) * F.col("a_var") + (F.col("b_n") - 1) * F.col("b_var")) / (F.col("a_n") + F.col("b_n") - 2)
    d = F.coalesce(F.try_divide(F.col("b_mean") - F.col("a_mean"), F.sqrt(pooled)), F.lit(0.0))
    kept = [F.round(f"{p}_{c}", 6).alias(f"{p}_{c}") for p in "ab" for c in ("mean", "p50", "p10", "p90", "zeros")]
    return both.select("feature", *kept, F.round(d, 6).alias("cohen_d"))


def corpus_error_rate(df: DataFrame, by: list[str], expected: str, actual: str) -> DataFrame:
    """Exact matches and the error rate of a corpus: summed edit distances over summed lengths."""
    e, a = F.coalesce(expected, F.lit("")), F.coalesce(actual, F.lit(""))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(e == a).alias("exact"),
        F.round(ratio(F.sum(F.levenshtein(e, a)), F.sum(F.length(e))), 6).alias("error_rate"),
    )


def isotonic_fit(df: DataFrame, by: str, score: str, label: str) -> DataFrame:
    """Monotone calibration points of each group by pooling adjacent violators; equal scores are averaged first.

    Scores are first combined to one row each, so a group's size in Python is its number of distinct scores.
    """
    import pandas as pd

    points = df.groupBy(F.col(by).alias("group"), F.round(score, 6).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("mean"))

    def pool(frame: pd.DataFrame) -> pd.DataFrame:
        blocks: list[list[float]] = []
        for s, n, m in frame.sort_values("score")[["score", "n", "mean"]].itertuples(index=False):
            blocks.append([m * n, n, s, s])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                total, weight, _, high = blocks.pop()
                blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + weight, blocks[-1][2], high]
        rows = [(frame["group"].iloc[0], low, high, total / weight) for total, weight, low, high in blocks]
        return pd.DataFrame(rows, columns=["group", "low", "high", "value"])

    kind = points.schema["group"].dataType.simpleString()
    return points.groupBy("group").applyInPandas(pool, f"group {kind}, low double, high double, value double")
