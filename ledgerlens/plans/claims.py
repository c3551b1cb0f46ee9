"""Claim queries: orders as claims, order lines as service lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.operators import claims as C, ranking as R
from ledgerlens.session import table


def claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("member"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"),
        F.to_date("o_orderdate").alias("received"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"),
    )


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("provider"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("charge"), F.col("l_quantity").cast("int").alias("units"), F.to_date("l_shipdate").alias("service_date"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"),
    )


CLAIMS = """claims AS (
    SELECT o_orderkey AS claim_id, o_custkey AS member, o_totalprice::DECIMAL(18,2) AS total, o_orderdate::DATE AS received,
           o_orderstatus AS status, o_orderpriority AS priority FROM orders),
    lines AS (
    SELECT l_orderkey AS claim_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS provider, l_extendedprice::DECIMAL(18,2) AS charge,
           l_quantity::INT AS units, l_shipdate::DATE AS service_date, l_discount AS discount, l_tax AS tax, l_returnflag AS flag FROM lineitem),
    totals AS (
    SELECT claim_id, sum(charge) AS line_total, count(*) AS n_lines, min(service_date) AS first_service, max(service_date) AS last_service
    FROM lines GROUP BY claim_id)"""


def line_total_check(spark: SparkSession, d: str) -> DataFrame:
    return C.reconcile(claims(spark, d), lines(spark, d)).select("claim_id", F.col("total").cast("double").alias("total"), F.col("line_total").cast("double").alias("line_total"), "exact")


def tolerance_check(spark: SparkSession, d: str) -> DataFrame:
    """By status: claims whose lines are within 25 % of the total."""
    out = C.reconcile(claims(spark, d), lines(spark, d), relative=0.25)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("within").alias("within"), F.sum("line_total").cast("double").alias("line_total"))


def service_date_checks(spark: SparkSession, d: str) -> DataFrame:
    joined = claims(spark, d).join(C.line_totals(lines(spark, d)), "claim_id", "left")
    out = C.date_checks(joined, "received", "first_service", "last_service")
    return out.groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.count_if("range_ok").alias("range_ok"), F.count_if("timely").alias("timely"))


def line_coherence(spark: SparkSession, d: str) -> DataFrame:
    """Order lines whose amount is quantity times the part's price, by flag."""
    priced = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    out = C.line_coherence(priced, "p_retailprice", "l_quantity", "l_extendedprice", 1.0)
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if("coherent").alias("coherent"))


def provider_consistency(spark: SparkSession, d: str) -> DataFrame:
    out = C.identity_consistency(lines(spark, d), "claim_id", F.col("provider").cast("string"))
    return out.groupBy("occurrences", "distinct_values", "consistent").agg(F.count(F.lit(1)).alias("claims"))


#: Rules that a claim has to pass.
def claim_rules() -> dict:
    return {
        "TOTAL_MATCH": F.col("within"),
        "TIMELY": F.col("timely"),
        "SINGLE_PROVIDER": F.col("n_lines") <= 4,
        "NOT_OPEN": F.col("status") != "O",
    }


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return C.date_checks(C.reconcile(claims(spark, d), lines(spark, d), relative=0.25), "received", "first_service", "last_service", days=90)


def _violations(spark: SparkSession, d: str) -> DataFrame:
    return C.violations(_checked(spark, d), ["claim_id", "priority"], claim_rules())


_CHECKED = f"""{CLAIMS}, checked AS (
    SELECT claims.*, coalesce(line_total, 0) AS line_total, n_lines,
           coalesce(abs(total - coalesce(line_total, 0))::DOUBLE <= greatest(0.01, greatest(abs(total), abs(coalesce(line_total, 0)), 1)::DOUBLE * 0.25), false) AS within,
           coalesce(date_diff('day', received, last_service) BETWEEN 0 AND 90, false) AS timely
    FROM claims LEFT JOIN totals USING (claim_id)),
    broken AS (
    SELECT claim_id, priority, unnest(list_filter([
        CASE WHEN NOT within THEN 'TOTAL_MATCH' END, CASE WHEN NOT timely THEN 'TIMELY' END,
        CASE WHEN NOT coalesce(n_lines <= 4, false) THEN 'SINGLE_PROVIDER' END, CASE WHEN NOT status <> 'O' THEN 'NOT_OPEN' END],
        lambda x: x IS NOT NULL)) AS rule FROM checked),
    blocked AS (
    SELECT claim_id, coalesce(b, []) AS blockers FROM claims
    LEFT JOIN (SELECT claim_id, list_sort(list(DISTINCT rule)) AS b FROM broken GROUP BY claim_id) USING (claim_id))"""


def claim_violations(spark: SparkSession, d: str) -> DataFrame:
    return _violations(spark, d).groupBy("priority", "rule").agg(F.count(F.lit(1)).alias("n"))


def blocker_pareto(spark: SparkSession, d: str) -> DataFrame:
    return C.blocker_pareto(C.blocking(_checked(spark, d), claim_rules()))


def blocker_sets(spark: SparkSession, d: str) -> DataFrame:
    return C.blocker_sets(C.blocking(_checked(spark, d), claim_rules()))


def review_load(spark: SparkSession, d: str) -> DataFrame:
    """Mean and median reviews of a claim, and the share without any, by priority."""
    per = C.blocking(_checked(spark, d), claim_rules())
    k = F.size("blockers")
    return per.groupBy("priority").agg(
        F.count(F.lit(1)).alias("claims"), F.round(F.avg(k), 6).alias("mean_reviews"), F.median(k).alias("median_reviews"), F.round(F.avg((k == 0).cast("int")), 6).alias("straight_through")
    )


def unlock_waterfall(spark: SparkSession, d: str) -> DataFrame:
    """Claims by what would release them: nothing, one reason, or several; the first in order of priority."""
    sets = C.blocking(_checked(spark, d), claim_rules())
    order = F.array(*[F.lit(x) for x in ("NOT_OPEN", "TOTAL_MATCH", "TIMELY", "SINGLE_PROVIDER")])
    kind = F.when(F.size("blockers") == 0, "RELEASED").when(F.size("blockers") == 1, "SOLE_BLOCKER").otherwise("SEVERAL")
    return sets.groupBy(kind.alias("kind"), F.coalesce(F.get(F.array_intersect(order, "blockers"), F.lit(0)), F.lit("NONE")).alias("primary")).agg(F.count(F.lit(1)).alias("claims"))


_OPTIONS = [["A", "N"], ["R", "N"], ["A", "R", "X"]]


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """The return flags of each claim's lines stand for its classes of evidence."""
    return lines(spark, d).groupBy("claim_id").agg(F.array_sort(F.collect_set("flag")).alias("available"))


_EVIDENCE = f"{CLAIMS}, evidence AS (SELECT claim_id, list_sort(list(DISTINCT flag)) AS available FROM lines GROUP BY claim_id)"


def closest_evidence(spark: SparkSession, d: str) -> DataFrame:
    best = _evidence(spark, d).select("claim_id", C.closest_option(F.col("available"), _OPTIONS).alias("b"))
    return best.groupBy(F.col("b.missing").alias("missing"), F.array_join("b.lacking", "+").alias("lacking")).agg(F.count(F.lit(1)).alias("claims"))


def counterfactual_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Lines with odd and with even numbers are a claim's two fields, each with evidence of its own."""
    fields = lines(spark, d).groupBy("claim_id", (F.col("line") % 2).alias("field")).agg(F.array_sort(F.collect_set("flag")).alias("available"))
    return C.counterfactual(fields, "claim_id", F.col("available"), _OPTIONS, ["A", "N", "R", "X"])


def threshold_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Limits by segment and nation with four levels of fallback; balances at or above them."""
    rules = spark.createDataFrame([("AUTOMOBILE", "7", 9000.0), ("BUILDING", "*", 5000.0), ("*", "3", 7000.0), ("*", "*", 4000.0)], "segment string, nation string, least double")
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"), "c_acctbal")
    out = C.fallback_lookup(rows, rules, "segment", "nation", "least", 1000.0)
    return out.groupBy("segment", "least").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") >= F.col("least")).alias("passed"))


def missing_required(spark: SparkSession, d: str) -> DataFrame:
    """Line numbers 1 to 3 are required of each claim; those missing, by number."""
    required = claims(spark, d).select("claim_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("line"))
    out = C.missing_fields(required, lines(spark, d).withColumn("v", F.col("part").cast("string")), ["claim_id", "line"], "v")
    return out.groupBy("line").agg(F.count(F.lit(1)).alias("claims"))


def status_report(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).withColumn("state", F.when(F.col("units") > 45, "INVALID").otherwise("VALID"))
    return C.status_report(rows, "claim_id", "state", F.col("line").cast("string"))


def review_priority(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 open claims to review: those with a due date first, then by value, age and number."""
    due = F.when(F.col("priority") == "1-URGENT", F.date_add("received", 2)).when(F.col("priority") == "2-HIGH", F.date_add("received", 10))
    rows = claims(spark, d).filter(F.col("status").isin("O", "P")).withColumn("due", due)
    return rows.orderBy(F.asc_nulls_last("due"), F.desc("total"), F.asc("received"), F.asc("claim_id")).limit(50).select("claim_id", "due", F.col("total").cast("double").alias("total"))


def claim_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 20 claims, newest first, with the number of all."""
    rows = claims(spark, d)
    page = rows.orderBy(F.desc("received"), F.asc("claim_id")).offset(20).limit(20).select("claim_id", "received")
    return page.crossJoin(rows.agg(F.count(F.lit(1)).alias("n_all")))


def worker_queue(spark: SparkSession, d: str) -> DataFrame:
    """Urgent open claims dealt to five reviewers in turn."""
    rows = claims(spark, d).filter("status = 'O' and priority = '1-URGENT'").select("claim_id")
    return R.round_robin(rows, "claim_id", 5)


def nested_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims rebuilt from their rows: lines in order as one text each."""
    part = F.concat_ws(":", F.col("line").cast("string"), F.col("part").cast("string"), F.col("charge").cast("string"))
    built = lines(spark, d).groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("line", part.alias("part")))).alias("rows"))
    return built.select("claim_id", F.array_join(F.transform("rows", lambda r: r["part"]), "|").alias("lines"))


QUERIES = {
    f.__name__: f
    for f in (
        line_total_check, tolerance_check, service_date_checks, line_coherence, provider_consistency, claim_violations, blocker_pareto, blocker_sets,
        review_load, unlock_waterfall, closest_evidence, counterfactual_evidence, threshold_lookup, missing_required, status_report, review_priority,
        claim_page, worker_queue, nested_claims,
    )
}

_LACK = "list_sort(list_filter({o}, lambda x: NOT list_contains(available, x)))"
_CLOSEST = "list_sort([" + ", ".join(f"{{'m': len({_LACK.format(o=o)}), 's': {len(o)}, 'l': {_LACK.format(o=o)}}}" for o in _OPTIONS) + "])[1]"
ORACLES = {
    "line_total_check": f"WITH {CLAIMS} SELECT claim_id, total::DOUBLE AS total, coalesce(line_total, 0)::DOUBLE AS line_total, coalesce(total = coalesce(line_total, 0), false) AS exact FROM claims LEFT JOIN totals USING (claim_id)",
    "tolerance_check": f"WITH {_CHECKED} SELECT status, count(*) AS n, count(*) FILTER (within) AS within, sum(line_total)::DOUBLE AS line_total FROM checked GROUP BY status",
    "service_date_checks": f"""
        WITH {CLAIMS} SELECT priority, count(*) AS n, count(*) FILTER (first_service <= last_service) AS range_ok,
               count(*) FILTER (date_diff('day', received, last_service) BETWEEN 0 AND 365) AS timely
        FROM claims LEFT JOIN totals USING (claim_id) GROUP BY priority""",
    "line_coherence": """
        SELECT l_returnflag, count(*) AS n, count(*) FILTER (abs(p_retailprice * l_quantity - l_extendedprice) <= 1.0) AS coherent
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_returnflag""",
    "provider_consistency": f"""
        WITH {CLAIMS}, p AS (SELECT claim_id, count(provider) AS occurrences, count(DISTINCT provider) AS distinct_values FROM lines GROUP BY claim_id)
        SELECT occurrences, distinct_values, occurrences >= 2 AND distinct_values = 1 AS consistent, count(*) AS claims FROM p GROUP BY ALL""",
    "claim_violations": f"WITH {_CHECKED} SELECT priority, rule, count(*) AS n FROM broken GROUP BY ALL",
    "blocker_pareto": f"""
        WITH {_CHECKED}, e AS (SELECT unnest(blockers) AS reason, len(blockers) AS k FROM blocked)
        SELECT reason, count(*) AS claims_blocked, count(*) FILTER (k = 1) AS unlocked_alone,
               round(count(*) FILTER (k = 1) / (SELECT count(*) FROM claims), 6) AS gain, round(avg(k - 1), 6) AS others FROM e GROUP BY reason""",
    "blocker_sets": f"WITH {_CHECKED} SELECT array_to_string(blockers, '+') AS blocker_set, count(*) AS claims FROM blocked GROUP BY 1",
    "review_load": f"""
        WITH {_CHECKED} SELECT priority, count(*) AS claims, round(avg(len(blockers)), 6) AS mean_reviews, median(len(blockers)) AS median_reviews,
               round(avg((len(blockers) = 0)::INT), 6) AS straight_through FROM blocked JOIN claims USING (claim_id) GROUP BY priority""",
    "unlock_waterfall": f"""
        WITH {_CHECKED} SELECT CASE len(blockers) WHEN 0 THEN 'RELEASED' WHEN 1 THEN 'SOLE_BLOCKER' ELSE 'SEVERAL' END AS kind,
               coalesce(list_filter(['NOT_OPEN', 'TOTAL_MATCH', 'TIMELY', 'SINGLE_PROVIDER'], lambda x: list_contains(blockers, x))[1], 'NONE') AS primary,
               count(*) AS claims FROM blocked GROUP BY 1, 2""",
    "closest_evidence": f"""
        WITH {_EVIDENCE}, b AS (SELECT {_CLOSEST} AS b FROM evidence)
        SELECT b.m AS missing, array_to_string(b.l, '+') AS lacking, count(*) AS claims FROM b GROUP BY 1, 2""",
    "counterfactual_evidence": f"""
        WITH {CLAIMS}, f AS (SELECT claim_id, line % 2 AS field, list(DISTINCT flag) AS available FROM lines GROUP BY ALL),
        t AS (SELECT a AS added, claim_id, list_append(available, a) AS h FROM f, unnest(['A', 'N', 'R', 'X']) u(a)),
        o AS (SELECT added, claim_id, list_has_all(h, ['A', 'N']) OR list_has_all(h, ['R', 'N']) OR list_has_all(h, ['A', 'R', 'X']) AS ok FROM t),
        p AS (SELECT added, claim_id, min(ok::INT) AS worst, max(ok::INT) AS best FROM o GROUP BY ALL)
        SELECT added, count(*) FILTER (worst = 1) AS claims_all, count(*) FILTER (best = 1) AS claims_any, count(*) AS claims FROM p GROUP BY added""",
    "threshold_lookup": """
        WITH r AS (
            SELECT c_mktsegment AS segment, c_acctbal, CASE WHEN c_mktsegment = 'AUTOMOBILE' AND c_nationkey = 7 THEN 9000.0
                   WHEN c_mktsegment = 'BUILDING' THEN 5000.0 WHEN c_nationkey = 3 THEN 7000.0 ELSE 4000.0 END::DOUBLE AS least FROM customer)
        SELECT segment, least, count(*) AS n, count(*) FILTER (c_acctbal >= least) AS passed FROM r GROUP BY ALL""",
    "missing_required": f"""
        WITH {CLAIMS}, q AS (SELECT claim_id, unnest([1, 2, 3]) AS line FROM claims)
        SELECT line, count(*) AS claims FROM q ANTI JOIN lines USING (claim_id, line) GROUP BY line""",
    "status_report": f"""
        WITH {CLAIMS} SELECT claim_id, count(*) AS n, count(*) FILTER (units > 45) AS n_failed,
               coalesce(string_agg(line::VARCHAR, ',' ORDER BY line::VARCHAR) FILTER (units > 45), '') AS failures FROM lines GROUP BY claim_id""",
    "review_priority": f"""
        WITH {CLAIMS}, d AS (SELECT *, CASE priority WHEN '1-URGENT' THEN received + 2 WHEN '2-HIGH' THEN received + 10 END AS due FROM claims WHERE status IN ('O', 'P'))
        SELECT claim_id, due, total::DOUBLE AS total FROM d ORDER BY due ASC NULLS LAST, total DESC, received, claim_id LIMIT 50""",
    "claim_page": f"""
        WITH {CLAIMS} SELECT claim_id, received, (SELECT count(*) FROM claims) AS n_all FROM claims ORDER BY received DESC, claim_id LIMIT 20 OFFSET 20""",
    "worker_queue": f"WITH {CLAIMS} SELECT claim_id, (row_number() OVER (ORDER BY claim_id) - 1) % 5 AS worker FROM claims WHERE status = 'O' AND priority = '1-URGENT'",
    "nested_claims": f"WITH {CLAIMS} SELECT claim_id, string_agg(concat_ws(':', line, part, charge), '|' ORDER BY line, concat_ws(':', line, part, charge)) AS lines FROM lines GROUP BY claim_id",
}
