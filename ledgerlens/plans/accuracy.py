"""Evaluation queries: labels against rules on documents, and statistics of events and order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.functions.values import ratio, wilson
from ledgerlens.operators import metrics as M
from ledgerlens.session import table

LONG = 500


def _matched(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the rule's prediction: documents of LONG characters or more are good; the rest is reviewed."""
    truth = table(spark, d, "labels")
    rule = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.when(F.col("n_chars") >= 50, (F.col("n_chars") >= LONG).cast("int")).alias("predicted"))
    return M.match_fields(truth, rule, ["doc_id"])


_MATCHED = f"""m AS (
    SELECT l.*, lang, source, n_chars, CASE WHEN n_chars >= 50 THEN CASE WHEN n_chars >= {LONG} THEN 1 ELSE 0 END END AS predicted
    FROM labels l LEFT JOIN documents d USING (doc_id))"""


def accuracy_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.accuracy_summary(_matched(spark, d), ["lang", "source"], "quality", "predicted", F.col("predicted") == 1)


def error_pareto(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of disagreement by language, most first."""
    kind = F.when(F.col("predicted").isNull(), "MISSING").when(F.col("predicted") > F.col("quality"), "FALSE_ACCEPT").otherwise("FALSE_REVIEW")
    wrong = _matched(spark, d).filter(~F.coalesce(F.col("predicted") == F.col("quality"), F.lit(False)))
    return M.pareto(wrong.select(kind.alias("kind"), "lang"), ["kind", "lang"])


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return M.confusion(_matched(spark, d).filter("predicted is not null"), "quality", "predicted")


def class_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.class_metrics(_matched(spark, d).filter("predicted is not null"), "quality", "predicted")


def cohen_kappa(spark: SparkSession, d: str) -> DataFrame:
    return M.kappa(table(spark, d, "labels"), "quality", "toxic")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).select("lang", "quality", F.round(F.least(F.col("n_chars") / 4000.0, F.lit(1.0)), 6).alias("score"))


_SCORED = "s AS (SELECT lang, quality, round(least(n_chars / 4000.0, 1.0), 6) AS score FROM m)"


def calibration(spark: SparkSession, d: str) -> DataFrame:
    return M.calibration(_scored(spark, d), "score", "quality")


def reliability_curve(spark: SparkSession, d: str) -> DataFrame:
    out = M.reliability(_scored(spark, d), "score", "quality")
    return out.select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("positive", 6).alias("positive"))


def isotonic_curve(spark: SparkSession, d: str) -> DataFrame:
    out = M.isotonic_fit(_scored(spark, d), "lang", "score", "quality")
    return out.select("group", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), F.round("value", 6).alias("value"))


def event_latency(spark: SparkSession, d: str) -> DataFrame:
    return M.latency_summary(table(spark, d, "events"), "event_type", "value")


def event_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The other percentile definitions: floor index and upper median."""
    return table(spark, d, "events").groupBy("event_type").agg(
        F.round(M.floor_index("value", 0.95), 6).alias("p95_floor"), F.round(M.upper_median("value"), 6).alias("median_upper"), F.round(F.median("value"), 6).alias("median")
    )


def segment_rates(spark: SparkSession, d: str) -> DataFrame:
    return M.segment_rates(_matched(spark, d), "source", F.col("quality") == 0)


def shadow_qualification(spark: SparkSession, d: str) -> DataFrame:
    """Rates over all, the largest segment's, the interval's upper bound, and the gates that fail."""
    rates = M.segment_rates(_matched(spark, d), "source", F.col("quality") == 0)
    worst = rates.agg(F.max("rate").alias("segment_max"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    row = worst.select("n", "k", "segment_max", F.round(ratio(k, n), 6).alias("rate"), F.round(wilson(k, n), 6).alias("upper"))
    conditions = {
        "MIN_ROWS": F.col("n") >= 300, "RATE": F.col("rate") <= 0.2, "UPPER": F.col("upper") <= 0.25, "SEGMENT": F.col("segment_max") <= 0.2,
    }
    return M.gates(row, conditions, ["n", "k", "rate", "upper", "segment_max"])


def leave_one_source_out(spark: SparkSession, d: str) -> DataFrame:
    per = _matched(spark, d).groupBy("source").agg(
        F.round(M.share(F.col("quality") == F.col("predicted")), 6).alias("accuracy"), F.round(M.share(F.col("predicted").isNull()), 6).alias("missing")
    )
    return M.worst_and_best(per, "source", {"accuracy": True, "missing": False})


def feature_drift(spark: SparkSession, d: str) -> DataFrame:
    return M.drift(table(spark, d, "lineitem"), "l_returnflag", "A", "R", ["l_quantity", "l_discount", "l_tax"])


def corpus_error_rate(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select("p_brand", F.lower("p_type").alias("expected"), F.lower("p_name").alias("actual"))
    return M.corpus_error_rate(parts, ["p_brand"], "expected", "actual")


def cost_scenarios(spark: SparkSession, d: str) -> DataFrame:
    """Cost of reviewing orders by priority: rows times unit cost, and the reviewers that a day's rows need."""
    unit = F.create_map(*[F.lit(x) for x in ("1-URGENT", 4.0, "2-HIGH", 2.0, "3-MEDIUM", 1.0)])
    orders = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    cost = F.coalesce(unit[F.col("o_orderpriority")], F.lit(0.5))
    return orders.select("o_orderpriority", "n", F.round(F.col("n") * cost, 2).alias("cost"), F.ceil(F.col("n") / 1440 * 1.3 / 0.5).alias("workers"))


_WILSON = """(k / n + z * z / (2 * n) {sign} z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)"""
_RATES = f"""r AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 0) AS k FROM m GROUP BY source),
    w AS (SELECT *, 1.959963984540054::DOUBLE AS z FROM r)"""

QUERIES = {
    f.__name__: f
    for f in (
        accuracy_summary, error_pareto, confusion_matrix, class_metrics, cohen_kappa, calibration, reliability_curve, isotonic_curve, event_latency,
        event_percentiles, segment_rates, shadow_qualification, leave_one_source_out, feature_drift, corpus_error_rate, cost_scenarios,
    )
}
ORACLES = {
    "accuracy_summary": f"""
        WITH {_MATCHED}, e AS (
            SELECT *, coalesce(quality::VARCHAR, '') = coalesce(predicted::VARCHAR, '') AS ok, coalesce(predicted = 1, false) AS taken FROM m)
        SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS dimension,
               CASE WHEN grouping(lang) = 0 THEN lang WHEN grouping(source) = 0 THEN source ELSE 'all' END AS value,
               count(*) AS n, round(avg(ok::INT), 6) AS accuracy, round(avg((predicted IS NULL)::INT), 6) AS missing,
               count(*) FILTER (taken AND NOT ok) AS false_accepts, count(*) FILTER (NOT taken AND ok) AS false_reviews
        FROM e GROUP BY GROUPING SETS ((), (lang), (source))""",
    "error_pareto": f"""
        WITH {_MATCHED}, e AS (
            SELECT CASE WHEN predicted IS NULL THEN 'MISSING' WHEN predicted > quality THEN 'FALSE_ACCEPT' ELSE 'FALSE_REVIEW' END AS kind, lang
            FROM m WHERE predicted IS DISTINCT FROM quality),
        c AS (SELECT kind, lang, count(*) AS n FROM e GROUP BY ALL)
        SELECT kind, lang, n, round(n / sum(n) OVER (), 6) AS share,
               round(sum(n) OVER (ORDER BY n DESC, kind, lang ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS running_share FROM c""",
    "confusion_matrix": f"WITH {_MATCHED} SELECT quality, predicted, count(*) AS n FROM m WHERE predicted IS NOT NULL GROUP BY ALL",
    "class_metrics": f"""
        WITH {_MATCHED}, l AS (SELECT DISTINCT unnest([quality, predicted]) AS label FROM m WHERE predicted IS NOT NULL),
        c AS (SELECT label, count(*) FILTER (quality = label AND predicted = label) AS tp,
                     count(*) FILTER (quality <> label AND predicted = label) AS fp,
                     count(*) FILTER (quality = label AND predicted <> label) AS fn
              FROM l, m WHERE predicted IS NOT NULL GROUP BY label)
        SELECT label::VARCHAR AS label, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / (tp + fp), 6) END AS precision,
               CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / (tp + fn), 6) END AS recall FROM c""",
    "cohen_kappa": """
        WITH t AS (SELECT count(*) AS n, avg((quality = toxic)::INT) AS po, avg(quality) AS q, avg(toxic) AS x FROM labels),
        e AS (SELECT *, q * x + (1 - q) * (1 - x) AS pe FROM t)
        SELECT n, round(po, 6) AS agreement, round(CASE WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM e""",
    "calibration": f"""
        WITH {_MATCHED}, {_SCORED}, b AS (
            SELECT count(*) AS n, avg(score) AS s, avg(quality) AS p FROM s GROUP BY least(floor(score * 10), 9))
        SELECT (SELECT count(*) FROM s) AS n, (SELECT round(avg((score - quality) ** 2), 6) FROM s) AS brier,
               (SELECT round(sum(n * abs(s - p)) / sum(n), 6) FROM b) AS ece,
               (SELECT round(avg(quality) FILTER (score >= 0.5), 6) FROM s) AS precision,
               (SELECT round(avg((score >= 0.5)::INT), 6) FROM s) AS coverage""",
    "reliability_curve": f"""
        WITH {_MATCHED}, {_SCORED}
        SELECT least(floor(score * 10), 9)::INT AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(quality), 6) AS positive
        FROM s GROUP BY 1""",
    "event_latency": """
        SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_disc(value, 0.5), 6) AS p50,
               round(quantile_disc(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.99), 6) AS p99 FROM events GROUP BY event_type""",
    "event_percentiles": """
        WITH l AS (SELECT event_type, list(value ORDER BY value) AS v, median(value) AS m FROM events GROUP BY event_type)
        SELECT event_type, round(v[floor(0.95 * (len(v) - 1))::INT + 1], 6) AS p95_floor, round(v[floor(len(v) / 2)::INT + 1], 6) AS median_upper,
               round(m, 6) AS median FROM l""",
    "segment_rates": f"""
        WITH {_MATCHED}, {_RATES}
        SELECT source, n, k, round(k / n, 6) AS rate, round({_WILSON.format(sign='-')}, 6) + 0.0 AS lower, round({_WILSON.format(sign='+')}, 6) AS upper FROM w""",
    "shadow_qualification": f"""
        WITH {_MATCHED}, {_RATES}, a AS (SELECT sum(n)::BIGINT AS n, sum(k)::BIGINT AS k, max(round(k / n, 6)) AS segment_max, any_value(z) AS z FROM w),
        f AS (SELECT n, k, segment_max, round(k / n, 6) AS rate, round({_WILSON.format(sign='+')}, 6) AS upper FROM a)
        SELECT *, concat_ws(',', CASE WHEN NOT n >= 300 THEN 'MIN_ROWS' END, CASE WHEN NOT rate <= 0.2 THEN 'RATE' END,
                            CASE WHEN NOT upper <= 0.25 THEN 'UPPER' END, CASE WHEN NOT segment_max <= 0.2 THEN 'SEGMENT' END) AS blockers,
               n >= 300 AND rate <= 0.2 AND upper <= 0.25 AND segment_max <= 0.2 AS passed FROM f""",
    "leave_one_source_out": f"""
        WITH {_MATCHED}, p AS (
            SELECT source, round(avg(coalesce(quality = predicted, false)::INT), 6) AS accuracy, round(avg((predicted IS NULL)::INT), 6) AS missing
            FROM m GROUP BY source),
        u AS (SELECT 'accuracy' AS metric, accuracy AS v, true AS up FROM p UNION ALL SELECT 'missing', missing, false FROM p),
        l AS (SELECT metric, any_value(up) AS up, min(v) AS low, max(v) AS high, list(v ORDER BY v) AS vs FROM u GROUP BY metric)
        SELECT metric, CASE WHEN up THEN low ELSE high END AS worst, vs[floor(len(vs) / 2)::INT + 1] AS median,
               CASE WHEN up THEN high ELSE low END AS best FROM l""",
    "feature_drift": """
        WITH u AS (
            SELECT l_returnflag AS run, 'l_quantity' AS feature, l_quantity::DOUBLE AS v FROM lineitem
            UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem UNION ALL SELECT l_returnflag, 'l_tax', l_tax FROM lineitem),
        s AS (SELECT feature, run, count(v) AS n, avg(v) AS mean, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.1) AS p10,
                     quantile_disc(v, 0.9) AS p90, avg((v = 0)::INT) AS zeros, var_samp(v) AS var FROM u WHERE run IN ('A', 'R') GROUP BY ALL)
        SELECT feature, round(a.mean, 6) AS a_mean, round(a.p50, 6) AS a_p50, round(a.p10, 6) AS a_p10, round(a.p90, 6) AS a_p90, round(a.zeros, 6) AS a_zeros,
               round(b.mean, 6) AS b_mean, round(b.p50, 6) AS b_p50, round(b.p10, 6) AS b_p10, round(b.p90, 6) AS b_p90, round(b.zeros, 6) AS b_zeros,
               round((b.mean - a.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)), 6) AS cohen_d
        FROM (SELECT * FROM s WHERE run = 'A') a JOIN (SELECT * FROM s WHERE run = 'R') b USING (feature)""",
    "corpus_error_rate": """
        SELECT p_brand, count(*) AS n, count(*) FILTER (lower(p_type) = lower(p_name)) AS exact,
               round(sum(levenshtein(lower(p_type), lower(p_name))) / sum(length(p_type)), 6) AS error_rate FROM part GROUP BY p_brand""",
    "cost_scenarios": """
        WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
        SELECT o_orderpriority, n, round(n * CASE o_orderpriority WHEN '1-URGENT' THEN 4.0 WHEN '2-HIGH' THEN 2.0 WHEN '3-MEDIUM' THEN 1.0 ELSE 0.5 END, 2) AS cost,
               ceil(n / 1440 * 1.3 / 0.5) AS workers FROM c""",
}
