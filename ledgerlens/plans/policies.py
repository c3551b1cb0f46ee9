"""Policy queries: rule systems on order lines, parts and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.functions import values as V
from ledgerlens.operators import policies as P
from ledgerlens.session import table


def _fields(spark: SparkSession, d: str) -> DataFrame:
    """Values of customers as named fields."""
    c = table(spark, d, "customer")
    pair = lambda name, value: F.struct(F.lit(name).alias("field"), value.alias("value"))
    named = F.explode(F.array(
        pair("billing_npi", F.lpad((F.col("c_custkey") * 7919 + 1000000007).cast("string"), 10, "0")),
        pair("service_date", F.concat(F.lit("20"), F.lpad((F.col("c_custkey") % 40).cast("string"), 2, "0"), F.lit("-0"), (F.col("c_custkey") % 10).cast("string"), F.lit("-15"))),
        pair("cpt_code", F.concat(F.lit("99"), F.col("c_custkey").cast("string"))),
        pair("total_charge", F.col("c_acctbal").cast("decimal(18,2)").cast("string")),
        pair("segment", F.when(F.col("c_custkey") % 9 == 0, F.lit("Patient Name")).when(F.col("c_custkey") % 11 == 0, F.lit(" ")).otherwise(F.col("c_mktsegment"))),
    ))
    return c.select("c_custkey", named.alias("f")).select("c_custkey", "f.field", "f.value")


_FIELDS = """f AS (
    SELECT c_custkey, 'billing_npi' AS field, lpad((c_custkey * 7919 + 1000000007)::VARCHAR, 10, '0') AS value FROM customer
    UNION ALL SELECT c_custkey, 'service_date', '20' || lpad((c_custkey % 40)::VARCHAR, 2, '0') || '-0' || (c_custkey % 10) || '-15' FROM customer
    UNION ALL SELECT c_custkey, 'cpt_code', '99' || c_custkey FROM customer
    UNION ALL SELECT c_custkey, 'total_charge', c_acctbal::DECIMAL(18,2)::VARCHAR FROM customer
    UNION ALL SELECT c_custkey, 'segment', CASE WHEN c_custkey % 9 = 0 THEN 'Patient Name' WHEN c_custkey % 11 = 0 THEN ' ' ELSE c_mktsegment END FROM customer),
    l AS (SELECT *, CASE WHEN field = 'billing_npi' THEN (list_sum(list_transform(range(1, 16), lambda k: CASE WHEN k % 2 = 0 THEN (reverse('80840' || value)[k]::INT * 2)
              - CASE WHEN reverse('80840' || value)[k]::INT > 4 THEN 9 ELSE 0 END ELSE reverse('80840' || value)[k]::INT END))) % 10 = 0 END AS npi FROM f)"""
AS_OF = "2024-06-30"


def deterministic_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = P.deterministic_evidence(F.col("field"), F.col("value"), F.to_date(F.lit(AS_OF)), ["Patient Name", "Segment"])
    return _fields(spark, d).select("field", e.alias("e")).groupBy("field", F.coalesce("e.evidence", F.lit("-")).alias("evidence"), F.coalesce("e.failure", F.lit("-")).alias("failure")).agg(F.count(F.lit(1)).alias("n"))


def field_verification(spark: SparkSession, d: str) -> DataFrame:
    v = P.verification(F.col("field"), F.col("value"), F.col("c_custkey") % 3, F.to_date(F.lit(AS_OF)))
    return _fields(spark, d).select("field", v.alias("v")).groupBy("field", "v.valid", "v.strength", "v.automatic").agg(F.count(F.lit(1)).alias("n"))


def _regions(spark: SparkSession, d: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    predicted = F.when(F.col("l_orderkey") % 13 != 0, V.box(q, n, q + 6 + n, n + 6))
    expected = V.box(F.lit(20.0), F.lit(3.0), F.lit(24.0), F.lit(7.0))
    neighbour = V.box(F.lit(30.0), F.lit(3.0), F.lit(34.0), F.lit(7.0))
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_discount", predicted.alias("p"))
    outcome = P.region_outcome(F.col("p"), expected, neighbour, F.lit(False))
    return rows.select("l_returnflag", (1 - F.col("l_discount") * 5).alias("confidence"), outcome.alias("outcome"))


_REGIONS = """b AS (SELECT l_returnflag, 1 - l_discount * 5 AS confidence, l_orderkey % 13 <> 0 AS found, l_quantity AS x0, l_linenumber AS y0, l_quantity + 6 + l_linenumber AS x1, l_linenumber + 6 AS y1 FROM lineitem),
    s AS (SELECT *, greatest(least(x1, 24) - greatest(x0, 20), 0) * greatest(least(y1, 7) - greatest(y0, 3), 0) AS ov, greatest(least(x1, 34) - greatest(x0, 30), 0) * greatest(least(y1, 7) - greatest(y0, 3), 0) AS nb, (x1 - x0) * (y1 - y0) AS own FROM b),
    r AS (SELECT l_returnflag, confidence, CASE WHEN NOT found THEN 'EMPTY_REGION' WHEN nb / 16 >= 0.5 AND ov / 16 < 0.95 THEN 'WRONG_NEIGHBOR' WHEN ov / 16 >= 0.95 AND own / 16 > 4 THEN 'OVER_CROP'
              WHEN ov / 16 >= 0.95 AND ov / (own + 16 - ov) >= 0.5 THEN 'GEOMETRIC_MATCH' WHEN ov / 16 >= 0.95 THEN 'VALUE_CONTAINED' WHEN ov > 0 THEN 'UNDER_CROP' ELSE 'WRONG_REGION' END AS outcome FROM s)"""


def region_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _regions(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def confidence_buckets(spark: SparkSession, d: str) -> DataFrame:
    usable = F.col("outcome").isin("GEOMETRIC_MATCH", "VALUE_CONTAINED", "OVER_CROP")
    return P.confidence_buckets(_regions(spark, d).withColumn("confidence", F.round("confidence", 6)), "confidence", usable, "l_returnflag")


def crop_detection(spark: SparkSession, d: str) -> DataFrame:
    wrong = ~F.col("outcome").isin("GEOMETRIC_MATCH", "VALUE_CONTAINED", "OVER_CROP")
    return P.detection_rates(_regions(spark, d), wrong, F.round("confidence", 6) < 0.8)


def straight_through(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as fields: lines 1 to 3 are required, those of flag R or A critical."""
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") <= 3).alias("required"), (F.col("l_quantity") > 3).alias("resolved"),
        F.when(F.col("l_returnflag") == "R", "C3").when(F.col("l_returnflag") == "A", "C2").otherwise("C0").alias("criticality"),
        F.round(1 - F.col("l_tax"), 6).alias("confidence"), (F.col("l_suppkey") % 2 == 0).alias("verified"), (F.col("l_discount") < 0.1).alias("valid"),
    )
    out = P.straight_through(rows, "l_orderkey", {"C2": 0.93, "C3": 0.95})
    return out.groupBy("score", "reasons", "eligible").agg(F.count(F.lit(1)).alias("n"))


def automation(spark: SparkSession, d: str) -> DataFrame:
    reference = F.when(F.col("l_suppkey") % 17 == 0, "CONTRADICTION").when(F.col("l_suppkey") % 19 == 0, "VERIFIED")
    quality = F.when(F.col("l_linenumber") <= 4, "GOOD").when(F.col("l_linenumber") == 5, "FAIR")
    outcome = P.automation(
        F.col("l_returnflag") != "A", reference, F.col("l_linestatus") == "O", F.col("l_partkey") % 5 != 0, F.round(1 - F.col("l_tax"), 6), F.lit(0.95), quality, ["GOOD", "FAIR"], F.col("l_discount") > 0.02
    )
    return table(spark, d, "lineitem").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def reviewer_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as reviewers of parts, flags as labels."""
    return P.pairwise_agreement(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", "l_returnflag")


def page_priority(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", (F.col("turn") % 3).alias("page"), "role", F.length("text").alias("n_chars"))
    return P.page_priority(rows, "conv_id", "page", "role", F.col("n_chars") > 500)


def permitted_customers(spark: SparkSession, d: str) -> DataFrame:
    grants = spark.createDataFrame([("BUILDING", "review"), ("MACHINERY", "review"), ("BUILDING", "export"), ("FURNITURE", "export")], "c_mktsegment string, permission string")
    return P.permitted(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), grants, "c_mktsegment", "review")


def taxonomy_paths(spark: SparkSession, d: str) -> DataFrame:
    """Flags and states as paths of a small tree of classes."""
    tree = {"claim": None, "F": "claim", "O": "claim", "A": "F", "R": "F", "N": "O"}
    rows = table(spark, d, "lineitem").groupBy("l_linestatus", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("valid", P.valid_path(F.array(F.lit("claim"), "l_linestatus", "l_returnflag"), tree))


def count_invariants(spark: SparkSession, d: str) -> DataFrame:
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 20).alias("a"), F.count_if(F.col("l_quantity") > 30).alias("b"), F.count_if(F.col("l_tax") > 0.05).alias("c"))
    return per.groupBy(P.count_chain(F.col("n"), F.col("a"), F.col("b"), F.col("c")).alias("ok")).agg(F.count(F.lit(1)).alias("orders"))


def crop_quality(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("l_quantity") - 1, F.col("l_linenumber") * 4.0
    return table(spark, d, "lineitem").groupBy(P.crop_quality(w, h, F.lit(50.0), F.lit(40.0), F.col("l_discount") > 0.01).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


def same_as_values(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("c_custkey") % 4 == 0, "SAME").when(F.col("c_custkey") % 4 == 1, "Same as above.").otherwise(F.col("c_mktsegment"))
    amount = P.first_amount(F.when(F.col("c_custkey") % 2 == 0, F.lit("n/a")), F.col("c_acctbal").cast("decimal(18,2)").cast("string"))
    return table(spark, d, "customer").select("c_custkey", P.same_as(said, F.col("c_name")).alias("value"), amount.cast("double").alias("amount"))


def phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    """How a phrase and types and names of parts match; one name in three has a letter read wrongly."""
    text = F.concat("p_type", F.lit(", "), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.expr("left(p_name, length(p_name) - 1)"), F.lit("q"))).otherwise(F.upper("p_name")))
    rows = table(spark, d, "part").select(text.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    out = rows.withColumn("m", P.phrase_match(F.col("text"), F.lit("Small Widget")))
    return out.groupBy("m.match").agg(F.sum("n").alias("n"))


def cross_field_facts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"), F.count(F.lit(1)).alias("k")), "o_orderkey")
    facts = P.cross_field(F.col("o_orderdate"), F.col("first"), F.date_sub("last", 30), F.lit(4), F.col("k"))
    return o.groupBy(F.array_join(facts, ",").alias("facts")).agg(F.count(F.lit(1)).alias("n"))


def review_economics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumn("reviewed", F.col("o_orderstatus") == "P")
    return P.economics(rows, "o_orderpriority", 0.002, 1.5)


QUERIES = {
    f.__name__: f
    for f in (
        deterministic_evidence, field_verification, region_outcomes, confidence_buckets, crop_detection, straight_through, automation, reviewer_agreement, page_priority,
        permitted_customers, taxonomy_paths, count_invariants, crop_quality, same_as_values, phrase_matches, cross_field_facts, review_economics,
    )
}
_DAY = "try_strptime(value, '%Y-%m-%d')::DATE"
ORACLES = {
    "phrase_matches": """
        WITH t AS (SELECT trim(regexp_replace(lower(p_type || ', ' || CASE WHEN p_partkey % 3 = 0 THEN p_name[:-2] || 'q' ELSE upper(p_name) END), '[^a-z0-9]+', ' ', 'g')) AS t FROM part),
        r AS (SELECT t, unnest([list_aggregate(string_split(t, ' ')[k:k + 1], 'string_agg', ' ') FOR k IN range(1, len(string_split(t, ' ')))]) AS run FROM t),
        b AS (SELECT t, max((levenshtein(run, 'small widget') <= 1)::INT) AS near FROM (SELECT DISTINCT * FROM r) GROUP BY 1)
        SELECT CASE WHEN contains(t, 'small widget') THEN 'EXACT' WHEN near = 1 THEN 'FUZZY' ELSE 'NONE' END AS match, count(*) AS n FROM t JOIN b USING (t) GROUP BY 1""",
    "deterministic_evidence": f"""
        WITH {_FIELDS}, e AS (
            SELECT field, trim(value) = '' AS blank, upper(value) = 'PATIENT NAME' OR upper(value) = 'SEGMENT' AS label,
                   CASE field WHEN 'billing_npi' THEN npi WHEN 'service_date' THEN coalesce({_DAY} <= DATE '{AS_OF}', false) WHEN 'cpt_code' THEN regexp_full_match(value, '[0-9]{{5}}')
                        WHEN 'total_charge' THEN value::DOUBLE >= 0 ELSE true END AS ok FROM l)
        SELECT field, CASE WHEN blank OR label OR NOT ok THEN '-' WHEN field = 'billing_npi' THEN 'CHECKSUM_VALID' WHEN field = 'service_date' THEN 'DATE_VALID' WHEN field = 'cpt_code' THEN 'CODE_SYNTAX_VALID'
                    WHEN field = 'total_charge' THEN 'AMOUNT_VALID' ELSE 'VALUE_PRESENT' END AS evidence,
               CASE WHEN blank THEN 'EMPTY_VALUE' WHEN label THEN 'LABEL_CONTAMINATION' WHEN ok THEN '-' WHEN field = 'billing_npi' THEN 'CHECKSUM_FAILURE' WHEN field = 'service_date' THEN 'INVALID_DATE'
                    WHEN field = 'cpt_code' THEN 'INVALID_CODE_SYNTAX' ELSE 'INVALID_AMOUNT' END AS failure, count(*) AS n FROM e GROUP BY ALL""",
    "field_verification": f"""
        WITH {_FIELDS}, e AS (
            SELECT *, CASE WHEN trim(value) = '' THEN false WHEN field = 'billing_npi' THEN npi WHEN field = 'service_date' THEN coalesce({_DAY} <= DATE '{AS_OF}', false) WHEN field = 'total_charge' THEN value::DOUBLE >= 0 ELSE true END AS valid FROM l)
        SELECT field, valid, CASE WHEN trim(value) = '' THEN 'NONE' WHEN field = 'billing_npi' THEN CASE WHEN npi THEN 'CHECKSUM' ELSE 'NONE' END WHEN field IN ('service_date', 'total_charge') THEN 'SEMANTIC' ELSE 'PRESENCE' END AS strength,
               valid AND field = 'billing_npi' AND c_custkey % 3 >= 2 AS automatic, count(*) AS n FROM e GROUP BY ALL""",
    "region_outcomes": f"WITH {_REGIONS} SELECT outcome, count(*) AS n FROM r GROUP BY 1",
    "confidence_buckets": f"""
        WITH {_REGIONS}, c AS (SELECT *, round(confidence, 6) AS k FROM r)
        SELECT CASE WHEN k >= 0.99::DOUBLE THEN 0.99 WHEN k >= 0.95::DOUBLE THEN 0.95 WHEN k >= 0.9::DOUBLE THEN 0.9 WHEN k >= 0.8::DOUBLE THEN 0.8 WHEN k >= 0.7::DOUBLE THEN 0.7 WHEN k >= 0.6::DOUBLE THEN 0.6 ELSE 0.5 END::DOUBLE AS bucket,
               count(*) AS n, round(avg((outcome IN ('GEOMETRIC_MATCH', 'VALUE_CONTAINED', 'OVER_CROP'))::INT), 6) AS accuracy, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS families
        FROM c WHERE k >= 0.5 GROUP BY 1""",
    "crop_detection": f"""
        WITH {_REGIONS}, w AS (SELECT outcome NOT IN ('GEOMETRIC_MATCH', 'VALUE_CONTAINED', 'OVER_CROP') AS w, round(confidence, 6) < 0.8::DOUBLE AS d FROM r)
        SELECT count(*) AS n, round(count(*) FILTER (w AND d) / count(*) FILTER (d), 6) AS precision, round(count(*) FILTER (w AND d) / count(*) FILTER (w), 6) AS recall FROM w""",
    "straight_through": """
        WITH f AS (SELECT *, l_linenumber <= 3 AS req, l_quantity > 3 AS res, l_returnflag IN ('R', 'A') AS crit, round(1 - l_tax, 6) AS conf,
                          CASE l_returnflag WHEN 'R' THEN 0.95 WHEN 'A' THEN 0.93 END::DOUBLE AS lim FROM lineitem),
        c AS (SELECT l_orderkey, count(*) FILTER (req) AS nr, count(*) FILTER (req AND res) AS ns, count(*) FILTER (crit) AS nc, coalesce(min(conf) FILTER (crit), 0) AS a,
                     coalesce(min(CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE conf END) FILTER (crit), 0) AS b, count(*) FILTER (crit AND NOT (res AND l_discount < 0.1::DOUBLE AND conf >= lim)) AS nf FROM f GROUP BY 1),
        s AS (SELECT *, CASE WHEN nr = 0 THEN 0 ELSE ns / nr END AS done FROM c),
        r AS (SELECT round(least(done, a, b), 6) AS score, concat_ws(',', CASE WHEN nr = 0 THEN 'REQUIRED_FIELD_POLICY_EMPTY' END, CASE WHEN done < 1 THEN 'REQUIRED_FIELDS_UNRESOLVED' END,
                     CASE WHEN nc = 0 THEN 'CRITICAL_FIELD_POLICY_EMPTY' END, CASE WHEN nf > 0 THEN 'CRITICAL_FIELD_FAILED' END) AS reasons FROM s)
        SELECT score, reasons, reasons = '' AS eligible, count(*) AS n FROM r GROUP BY ALL""",
    "automation": """
        SELECT CASE WHEN l_returnflag = 'A' THEN 'ALREADY_AUTOMATED' WHEN l_suppkey % 17 = 0 THEN 'BLOCKED_CONTRADICTION' WHEN l_suppkey % 19 = 0 THEN 'PROMOTED_REFERENCE_VERIFIED' WHEN l_linestatus = 'O' THEN 'BLOCKED_REFERENCE_REQUIRED'
                    WHEN l_partkey % 5 = 0 THEN 'BLOCKED_HOLDOUT_REQUIRED' WHEN round(1 - l_tax, 6) < 0.95::DOUBLE THEN 'BLOCKED_LOW_CONFIDENCE' WHEN l_linenumber > 5 THEN 'BLOCKED_CROP_QUALITY'
                    WHEN l_discount > 0.02::DOUBLE THEN 'PROMOTED_ACTIVE_ROUTE' ELSE 'BLOCKED_INSUFFICIENT_EVIDENCE' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1""",
    "reviewer_agreement": """
        WITH o AS (SELECT l_partkey, l_suppkey, min(l_returnflag) AS l FROM lineitem GROUP BY 1, 2)
        SELECT count(*) AS pairs, count(*) FILTER (a.l = b.l) AS agree FROM o a JOIN o b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey""",
    "page_priority": """
        SELECT conv_id, turn % 3 AS page, count(*) FILTER (length(text) > 500) AS critical, count(*) AS n, string_agg(DISTINCT role, ',' ORDER BY role) AS fields FROM conversations GROUP BY 1, 2""",
    "permitted_customers": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "taxonomy_paths": """
        SELECT l_linestatus, l_returnflag, count(*) AS n, (l_linestatus = 'F' AND l_returnflag IN ('A', 'R')) OR (l_linestatus = 'O' AND l_returnflag = 'N') AS valid FROM lineitem GROUP BY 1, 2""",
    "count_invariants": """
        WITH p AS (SELECT count(*) AS n, count(*) FILTER (l_quantity > 20) AS a, count(*) FILTER (l_quantity > 30) AS b, count(*) FILTER (l_tax > 0.05::DOUBLE) AS c FROM lineitem GROUP BY l_orderkey)
        SELECT a <= n AND b <= a AND c <= b AS ok, count(*) AS orders FROM p GROUP BY 1""",
    "crop_quality": """
        WITH b AS (SELECT l_quantity - 1 AS w, l_linenumber * 4.0::DOUBLE AS h, l_discount > 0.01::DOUBLE AS inside FROM lineitem)
        SELECT CASE WHEN w <= 0 OR h <= 0 THEN 'EMPTY' WHEN w < 8 OR h < 6 THEN 'TOO_SMALL' WHEN w * h / 2000 > 0.5 THEN 'TOO_LARGE' WHEN NOT inside THEN 'OUTSIDE' ELSE 'OK' END AS quality, count(*) AS n FROM b GROUP BY 1""",
    "same_as_values": "SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1) THEN c_name ELSE c_mktsegment END AS value, c_acctbal::DECIMAL(18,2)::DOUBLE AS amount FROM customer",
    "cross_field_facts": """
        WITH s AS (SELECT l_orderkey, min(l_shipdate) AS f, max(l_shipdate)::DATE - 30 AS l, count(*) AS k FROM lineitem GROUP BY 1)
        SELECT concat_ws(',', CASE WHEN o_orderdate < f THEN 'BIRTH_BEFORE_SERVICE' END, CASE WHEN f <= l THEN 'DATES_IN_ORDER' END, CASE WHEN k = 4 THEN 'LINES_EQUAL_TOTAL' END) AS facts, count(*) AS n
        FROM orders JOIN s ON l_orderkey = o_orderkey GROUP BY 1""",
    "review_economics": """
        SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS reviewed, round(count(*) * 0.002::DOUBLE + count(*) FILTER (o_orderstatus = 'P') * 1.5::DOUBLE, 4) AS cost,
               round((count(*) * 0.002::DOUBLE + count(*) FILTER (o_orderstatus = 'P') * 1.5::DOUBLE) / count(*) FILTER (o_orderstatus <> 'P'), 6) AS cost_of_automated FROM orders GROUP BY 1""",
}
