"""Queries of reconciliation and authority: order lines as candidates, customers as references, orders as tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.functions import text as X
from ledgerlens.operators import authority as A, metrics as M, reconcile as R
from ledgerlens.session import table
from ledgerlens.streaming import events as E


def same_page_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Return flags of an order's lines as candidates of one field, suppliers of three families; blanks have no value."""
    rows = table(spark, d, "lineitem").withColumns({"family": F.col("l_suppkey") % 3, "value": F.when(F.col("l_quantity") == 13, " ").otherwise(F.concat(F.lit(" "), F.lower("l_returnflag")))})
    signals = {"VALIDATED": F.col("l_linestatus") == "F", "MARK": F.col("l_discount") >= 0.1, "PAGE_TOKEN": F.col("l_tax") >= 0.08, "LINEAGE": F.col("l_quantity") > 45}
    out = R.same_page(rows, ["l_orderkey"], "value", "family", signals)
    return out.groupBy("value", "verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score"), F.round(F.sum("margin"), 4).alias("margin"))


def cascade_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Return flags of an order's lines by calibrated confidence; urgent orders are critical, finished ones have a reference."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", "R").alias("reference"), (F.col("o_orderpriority") == "1-URGENT").alias("critical"))
    rows = table(spark, d, "lineitem").join(orders, "l_orderkey", "left").withColumn("family", F.col("l_suppkey") % 4)
    out = R.cascade(
        rows, ["l_orderkey"], "l_linenumber", "l_returnflag", "family", R.logistic(F.col("l_discount") * 10, 1.5, 0.5), F.col("l_quantity") > 5, F.col("reference"), 1 - F.col("l_tax"), F.col("critical")
    )
    return out.groupBy("l_returnflag", "reason", "disposition").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 3).alias("score"))


def platt_fits(spark: SparkSession, d: str) -> DataFrame:
    """Logistic curves of return by discount for each status of lines."""
    rows = table(spark, d, "lineitem").select("l_linestatus", F.col("l_discount").alias("s"), F.col("l_returnflag") == "R")
    rows = rows.toDF("l_linestatus", "s", "returned")
    return R.fit_platt(rows, ["l_linestatus"], "s", "returned", iterations=200)


def selection_failures(spark: SparkSession, d: str) -> DataFrame:
    """An order's first line as the right candidate, its second as the chosen one."""
    side = lambda n: F.struct(F.col("l_tax").alias("validation"), F.col("l_quantity").alias("consensus"), F.col("l_discount").alias("score"))
    pick = lambda n: F.max(F.when(F.col("l_linenumber") == n, side(n)))
    both = table(spark, d, "lineitem").groupBy("l_orderkey").agg(pick(1).alias("a"), pick(2).alias("b"))
    kind = R.selection_failure(F.col("a"), F.col("b"), F.col("l_orderkey") % 10 == 0)
    return both.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def reference_acceptance(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    ok = A.reference_accepted(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 3 == 0, F.col("c_nationkey") / 25, F.col("c_custkey") % 5 == 0, F.when(F.col("c_nationkey") != 3, F.col("c_acctbal") / 10000))
    return c.groupBy(ok.alias("accepted")).agg(F.count(F.lit(1)).alias("n"))


def address_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Attributes matched and contradicted by digits of the customer's number."""
    k = F.col("c_custkey")
    matched = F.array_compact(F.array(F.lit("po_box"), F.when(k % 3 != 0, "postal_code"), F.lit("city"), F.when(k % 5 != 0, "state"), F.lit("street")))
    against = F.filter(F.array(F.when(k % 7 == 0, "city")), lambda x: x.isNotNull())
    ok = A.address_accepted(k % 11 != 0, k % 13 != 0, F.when(k % 17 != 0, F.lit(True)), matched, against, F.when(k % 19 != 0, F.col("c_name")))
    return table(spark, d, "customer").groupBy(ok.alias("accepted")).agg(F.count(F.lit(1)).alias("n"))


def escalation_orders(spark: SparkSession, d: str) -> DataFrame:
    """The next method for each order, after the kinds that its lines stand for."""
    tried = F.when(F.col("l_returnflag") == "R", "ALTERNATE_PREPROCESS_OCR").when(F.col("l_returnflag") == "A", "TABLE_TRANSFORMER").otherwise("LAYOUTLMV3")
    seen = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(tried).alias("tried"))
    rows = table(spark, d, "orders").join(seen, "o_orderkey", "left").withColumn("tried", F.coalesce("tried", F.array().cast("array<string>")))
    order = A.escalation(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderstatus") == "O")
    return rows.groupBy(F.array_join(order, ">").alias("order"), A.next_step(order, F.col("tried"), F.col("o_orderkey") % 2 == 0).alias("next")).agg(F.count(F.lit(1)).alias("n"))


def table_parser(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    ok = A.table_parser_eligible(F.col("o_orderpriority") == "5-LOW", F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000, F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey") % 2 == 0))
    return o.groupBy("o_orderstatus", ok.alias("eligible")).agg(F.count(F.lit(1)).alias("n"))


def route_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Parts' brands as routes by type, some for all types, for customers' segments as fields in three modes."""
    states = F.array(*[F.lit(s) for s in ("SHADOW", "PRODUCTION_APPROVED", "EXPERIMENTAL", "REJECTED", "EVALUATION_ONLY")])
    routes = table(spark, d, "part").select(
        (F.col("p_size") % 5).alias("field"), F.when(F.col("p_partkey") % 9 == 0, "*").otherwise(F.col("p_type")).alias("family"), F.get(states, (F.col("p_partkey") % 5).cast("int")).alias("status"),
        F.col("p_partkey").alias("place"), F.concat(F.lit("r"), F.col("p_partkey").cast("string")).alias("route_id"),
    )
    requests = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % 6).cast("int").alias("field"), F.when(F.col("n_nationkey") % 4 == 0, "OTHER").when(F.col("n_nationkey") % 4 == 1, "PROMO").when(F.col("n_nationkey") % 4 == 2, "SMALL").otherwise("LARGE").alias("family"))
    found = [A.routes_for(requests, routes, mode).withColumn("mode", F.lit(mode)) for mode in A.ROUTE_STATES]
    return reduce(DataFrame.unionByName, found).select("mode", "n_nationkey", "route_id")


def review_requests(spark: SparkSession, d: str) -> DataFrame:
    """Review events of orders' decisions; a few have no policy version. Ids are counted with how often each is made."""
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("field"), F.when(F.col("l_quantity") != 7, F.concat(F.lit("v"), F.col("l_returnflag"))).alias("policy"), (F.col("l_discount") > 0.05).alias("blocks"))
    made, refused = A.review_events(rows, "l_orderkey", "field", "policy", F.col("blocks"))
    out = made.groupBy("authorization_id").agg(F.count(F.lit(1)).alias("k"), F.max("impact").alias("impact"), F.max("policy").alias("policy"))
    out = out.groupBy("policy", "impact", "k").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(refused.groupBy(F.lit("-").alias("policy"), F.col("error").alias("impact")).agg(F.lit(0).cast("long").alias("k"), F.count(F.lit(1)).alias("n")))


def verified_closures(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tasks; their lines submit corrections (some invalid) or approve them, in order of their numbers."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey") * 10 + F.col("l_suppkey") % 10).alias("at"), (F.col("l_suppkey") % 5).alias("who"), "l_returnflag", "l_linestatus")
    sent = lines.filter("l_linestatus = 'F'").select("o_orderkey", "at", F.col("who").alias("reviewer"), F.when(F.col("l_returnflag") == "A", "A1").otherwise(F.concat(F.lit(" O'"), "l_returnflag")).alias("correction"))
    passed = lines.filter("l_linestatus = 'O'").select("o_orderkey", "at", F.col("who").alias("approver"))
    out = A.closures(table(spark, d, "orders").select("o_orderkey"), sent, passed, "o_orderkey", "at")
    return out.groupBy("state", "correction", "reviewer", "approved_by").agg(F.count(F.lit(1)).alias("n"))


_WEIGHTS = {"anchor": 0.3, "geometry": 0.25, "span": 0.2, "semantic": 0.15, "template": 0.1}


def localisation_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of lines, some without a template's or span's signal."""
    s = A.localisation_score(
        _WEIGHTS, anchor=F.col("l_discount") * 10, geometry=F.col("l_tax") * 10, span=F.when(F.col("l_quantity") > 10, F.lit(0.5)), semantic=F.col("l_quantity") / 50, template=F.when(F.col("l_returnflag") == "R", F.lit(1.0)), cross_field=F.lit(1.0)
    )
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(s), 4).alias("score"))


def extraction_failures(spark: SparkSession, d: str) -> DataFrame:
    """What went wrong with parts' names that should be others'."""
    k = F.col("p_partkey")
    outcome = F.when(k % 11 == 0, "WRONG_REGION").when(k % 7 == 0, "UNDER_CROP").otherwise("GEOMETRIC_MATCH")
    raw = F.when(k % 5 == 0, " ").otherwise(F.col("p_name"))
    chosen = F.when(k % 3 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.reverse("p_name"))
    kind = A.extraction_failure(outcome, raw, chosen, F.col("p_name"), F.when(k % 4 == 0, F.col("p_name")), k % 13 == 0, k % 17 == 0)
    likely = F.when(k % 3 == 0, "x").otherwise("reversed")  # likeness of reversed names isn't for SQL
    return table(spark, d, "part").filter("p_partkey % 3 = 0 OR p_partkey % 4 = 0").groupBy(likely.alias("how"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def coordinated_blockers(spark: SparkSession, d: str) -> DataFrame:
    """Orders with several blocked lines of one group of dependent numbers."""
    blocked = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_discount") > 0.05, F.col("l_linenumber").cast("string"))).alias("blocked"))
    hit = A.coordinated(F.col("blocked"), [["1", "2"], ["3", "5", "7"]])
    return blocked.groupBy(hit.alias("coordinated")).agg(F.count(F.lit(1)).alias("n"))


def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    """Nations as files of a frozen release: some changed, some gone."""
    n = table(spark, d, "nation")
    manifest = n.select(F.col("n_name").alias("path"), F.sha2("n_name", 256).alias("digest"))
    now = n.filter("n_nationkey % 5 <> 0").select(F.col("n_name").alias("path"), F.sha2(F.when(F.col("n_nationkey") % 3 == 0, F.lit("changed")).otherwise(F.col("n_name")), 256).alias("digest"))
    return A.manifest_issues(manifest, now, "FROZEN")


def retried_fields(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as attempts to read it again; a quarter of sure is what it had."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") > 0, F.col("l_returnflag")).alias("text"), "l_discount", F.lit(0.07).alias("had"))
    out = A.retried(rows, ["l_orderkey"], "l_linenumber", "l_discount", "text", "had")
    return out.groupBy("attempts", "improved", "text", F.col("l_linenumber").alias("place")).agg(F.count(F.lit(1)).alias("n"))


def page_choice(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers of an order as pages, flags as values, discounts as scores."""
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 6).alias("page"), "l_returnflag", "l_discount")
    out = A.page_winners(rows, ["l_orderkey"], "page", "l_returnflag", "l_discount", 0.02)
    return out.groupBy("page", "l_returnflag", "verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("margin"), 4).alias("margin"))


def name_readings(spark: SparkSession, d: str) -> DataFrame:
    """Ways to read part names, of which some have a comma and some a suffix."""
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, F.concat(F.replace("p_name", F.lit(" "), F.lit(", ")), F.when(k % 2 == 0, " x Jr.").otherwise(""))).otherwise(F.concat(F.lit(" "), "p_name", F.lit(".")))
    ways = table(spark, d, "part").select("p_partkey", F.posexplode(X.name_interpretations(name, "LAST_FIRST")).alias("place", "w"))
    return ways.groupBy("place", "w.convention", "w.first", "w.middle", "w.last", "w.suffix").agg(F.count(F.lit(1)).alias("n"))


def city_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat("c_mktsegment", F.lit(" 7 City!"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit(" -'"), F.lower("c_mktsegment"), F.lit(" 12  st. "))).when(F.col("c_custkey") % 4 == 2, " 9 ").otherwise(F.col("c_mktsegment"))
    second = F.concat(F.substring("c_mktsegment", 1, 1), F.lit(". "), F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, "MD").otherwise(" q"))
    return table(spark, d, "customer").groupBy(X.clean_city(raw).alias("city"), X.clean_secondary_name(second).alias("second")).agg(F.count(F.lit(1)).alias("n"))


def engine_families(spark: SparkSession, d: str) -> DataFrame:
    engines = F.array(*[F.lit(e) for e in ("PaddleOCR-v4", "pp-ocr", "Tesseract 5", "RapidOCR paddle", "trocr-base", "azure_read", "GOT-OCR", "my own")])
    name = F.get(engines, (F.col("event_id") % 8).cast("int"))
    e = table(spark, d, "events").select(X.engine_family(name).alias("family"), X.canonical_name(F.col("event_type"), {"view": "seen", "click": "seen"}).alias("field"))
    return e.groupBy("family", "field").agg(F.count(F.lit(1)).alias("n"))


def box_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    box = F.concat(F.lit("po box "), (k % 1000).cast("string"), F.when(k % 3 == 0, "B/").when(k % 3 == 1, "").otherwise("o"))
    postal = F.concat(F.lit("12345"), F.when(k % 5 != 0, "-").otherwise(""), F.lpad(((k * 7) % 10000).cast("string"), F.lit(4), F.lit("0")), F.when(k % 11 == 0, "9").otherwise(""))
    return table(spark, d, "customer").select("c_custkey", X.box_with_zip(box, postal).alias("address"))


def zone_scores(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("l_quantity") * 10, F.col("l_linenumber") * 100
    s = X.zone_score(x, y, x + 100, y + 40, (0.3, 0.2, 0.7, 0.6), F.lit(600), F.lit(800))
    return table(spark, d, "lineitem").groupBy(s.alias("score")).agg(F.count(F.lit(1)).alias("n"))


def topic_pools(spark: SparkSession, d: str) -> DataFrame:
    """The topics of the flow with the pool that consumes each."""
    topics = spark.createDataFrame(list(enumerate(E.TOPICS)), "place long, topic string")
    return topics.select("place", "topic", F.coalesce(E.pool_of(F.col("topic")), F.lit("none")).alias("pool"))


def shadow_gates(spark: SparkSession, d: str) -> DataFrame:
    """Orders as shadow claims, their lines as fields; suppliers of two nations were used in training."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(
        F.count(F.lit(1)).alias("accepted"), F.count_if(F.col("l_returnflag") == "R").alias("accepted_critical"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_tax") < 0.08)).alias("correct_critical"),
        F.count_if(F.col("l_discount") == 0.1).alias("false_accepts"), F.count_if((F.col("l_discount") == 0.1) & (F.col("l_returnflag") == "R")).alias("critical_false_accepts"),
        F.count_if(F.col("l_quantity") == 1).alias("wrong_crops"), F.count_if((F.col("l_quantity") == 1) & (F.col("l_tax") > 0)).alias("crops_found"),
    )
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_orderpriority").alias("segment"), F.col("o_custkey").alias("group_id"), (F.col("o_orderstatus") == "P").alias("review"), F.lit(True).alias("locked"), F.lit(True).alias("shadow_only"),
        (F.col("o_totalprice") > 0).alias("parity"), (F.col("o_orderkey") % 1000 != 0).alias("governed"),
    )
    none = ("accepted", "accepted_critical", "correct_critical", "false_accepts", "critical_false_accepts", "wrong_crops", "crops_found")
    rows = o.join(lines, "claim_id", "left").fillna(0, list(none))
    trained = table(spark, d, "customer").filter("c_nationkey < 2").select(F.col("c_custkey").alias("group_id"))
    return M.shadow_gates(rows, trained, M.SHADOW_POLICY)


def routing_report(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source: languages as families, predicted from labels; lengths stand for latency."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        "source", "lang", F.when(F.col("toxic") == 1, "xx").when(F.col("quality") == 0, "en").otherwise(F.col("lang")).alias("predicted"), F.when(F.col("n_chars") > 500, "LONG").otherwise("SHORT").alias("route"),
        F.when(F.col("lang").isin("en", "de"), "LONG").otherwise("SHORT").alias("wanted"), F.col("n_chars").cast("double").alias("ms"),
    )
    return M.routing_summary(rows, "source", "lang", "predicted", "route", "wanted", ("en", "de"), ("LONG",), "ms")


QUERIES = {
    f.__name__: f
    for f in (
        same_page_candidates, cascade_candidates, platt_fits, selection_failures, reference_acceptance, address_acceptance, escalation_orders, table_parser, route_lookup, review_requests,
        verified_closures, localisation_scores, extraction_failures, coordinated_blockers, manifest_check, retried_fields, page_choice, name_readings, city_names, engine_families, box_numbers,
        zone_scores, topic_pools, shadow_gates, routing_report,
    )
}
_TRIED = "CASE l_returnflag WHEN 'R' THEN 'ALTERNATE_PREPROCESS_OCR' WHEN 'A' THEN 'TABLE_TRANSFORMER' ELSE 'LAYOUTLMV3' END"
ORACLES = {
    "same_page_candidates": """
        WITH c AS (SELECT l_orderkey, CASE WHEN l_quantity = 13 THEN NULL ELSE l_returnflag END AS v, l_suppkey % 3 AS f, l_linestatus = 'F' AS a, l_quantity > 45 AS b, l_discount >= 0.1::DOUBLE AS m, l_tax >= 0.08::DOUBLE AS p FROM lineitem),
        t AS (SELECT l_orderkey, count(DISTINCT f) FILTER (v IS NOT NULL) AS tf, count(v) AS tn FROM c GROUP BY 1),
        g AS (SELECT l_orderkey, v, count(DISTINCT f) AS k, count(*) AS n, bool_or(a)::INT AS a, bool_or(b)::INT AS b, bool_or(m)::INT AS m, bool_or(p)::INT AS p FROM c WHERE v IS NOT NULL GROUP BY ALL),
        s AS (SELECT t.l_orderkey, v, n, round(least(1.0::DOUBLE, least(0.6::DOUBLE, 0.2::DOUBLE * k) + 0.2::DOUBLE * k / tf + 0.15::DOUBLE * n / tn + 0.25::DOUBLE * a + 0.1::DOUBLE * b + 0.2::DOUBLE * m + 0.1::DOUBLE * p), 6) AS s FROM t LEFT JOIN g USING (l_orderkey)),
        r AS (SELECT *, lead(s) OVER w AS nx, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY s DESC, n DESC, v)),
        z AS (SELECT *, round(s - coalesce(nx, 0), 6) AS mg FROM r WHERE rn = 1),
        y AS (SELECT *, CASE WHEN v IS NULL THEN 'NO_VALID_VALUE' WHEN nx IS NOT NULL AND mg < 0.08::DOUBLE THEN 'AMBIGUOUS' WHEN s < 0.45::DOUBLE THEN 'LOW_SCORE' ELSE 'SELECTED' END AS verdict FROM z)
        SELECT CASE WHEN verdict = 'SELECTED' THEN v END AS value, verdict, count(*) AS n, round(sum(coalesce(s, 0)), 4) AS score, round(sum(coalesce(mg, 0)), 4) AS margin FROM y GROUP BY 1, 2""",
    "cascade_candidates": """
        WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag AS v, l_suppkey % 4 AS f, l_quantity > 5 AS ok, coalesce(o_orderstatus = 'F' AND l_returnflag = 'R', false) AS r, coalesce(o_orderpriority = '1-URGENT', false) AS crit,
                          least(greatest(l_discount * 10, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS p, greatest(least(1 - l_tax, 1), 0) AS al FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey),
        g AS (SELECT l_orderkey, v, count(DISTINCT f) AS k, count(DISTINCT f) FILTER (ok) AS m FROM c GROUP BY ALL),
        s AS (SELECT c.*, m, round(0.55::DOUBLE / (1 + exp(-(1.5::DOUBLE * ln(p / (1 - p)) + 0.5::DOUBLE))) + 0.2::DOUBLE * least(k / 2, 1) + 0.15::DOUBLE * r::INT + 0.1::DOUBLE * al, 6) AS s FROM c JOIN g USING (l_orderkey, v)),
        b AS (SELECT * FROM s WHERE ok QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_linenumber, v DESC) = 1),
        a AS (SELECT DISTINCT c.l_orderkey, c.crit, b.v, b.s, b.m, b.r FROM c LEFT JOIN b USING (l_orderkey)),
        z AS (SELECT *, CASE WHEN v IS NULL THEN 'NO_VALID_CANDIDATE' WHEN s < 0.8::DOUBLE THEN 'LOW_SCORE' WHEN crit AND NOT (m >= 2 OR r) THEN 'CRITICAL_NEEDS_TWO' ELSE 'NONE' END AS reason FROM a)
        SELECT v AS l_returnflag, reason, CASE WHEN reason = 'NONE' THEN 'VALIDATED' ELSE 'REVIEW' END AS disposition, count(*) AS n, round(sum(s), 3) AS score FROM z GROUP BY ALL""",
    "platt_fits": """
        WITH RECURSIVE g AS (SELECT l_linestatus, round(l_discount * 1000) / 1000 AS s, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS k FROM lineitem GROUP BY ALL),
        t AS (SELECT l_linestatus, sum(n)::BIGINT AS n, sum(k) AS k, sum(s * n) AS t, list({'s': s, 'n': n, 'k': k}) AS p FROM g GROUP BY 1),
        f(l_linestatus, i, a, b) AS (
            SELECT l_linestatus, 0, 1.0::DOUBLE, ln(least(greatest(k / n, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) / (1 - least(greatest(k / n, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE))) - t / n FROM t
            UNION ALL
            SELECT f.l_linestatus, i + 1,
                   a - 0.08::DOUBLE * (list_sum(list_transform(p, lambda x: (x.n / (1 + exp(-least(30, greatest(-30, a * x.s + b)))) - x.k) * x.s)) / n + 0.001::DOUBLE * a),
                   b - 0.08::DOUBLE * list_sum(list_transform(p, lambda x: x.n / (1 + exp(-least(30, greatest(-30, a * x.s + b)))) - x.k)) / n
            FROM f JOIN t USING (l_linestatus) WHERE i < 200)
        SELECT l_linestatus, n, round(a, 6) AS slope, round(b, 6) AS intercept FROM f JOIN t USING (l_linestatus) WHERE i = 200""",
    "selection_failures": """
        WITH p AS (SELECT l_orderkey, max(l_tax) FILTER (l_linenumber = 1) AS v1, max(l_tax) FILTER (l_linenumber = 2) AS v2 FROM lineitem GROUP BY 1),
        a AS (SELECT l_orderkey, max({'v': l_tax, 'c': l_quantity, 's': l_discount}) FILTER (l_linenumber = 1) AS a, max({'v': l_tax, 'c': l_quantity, 's': l_discount}) FILTER (l_linenumber = 2) AS b FROM lineitem GROUP BY 1)
        SELECT CASE WHEN a IS NULL THEN 'FILTERED' WHEN b IS NULL THEN 'TIE_BREAK' WHEN a.v > b.v THEN 'VALIDATION_DOMINANCE' WHEN a.c > b.c THEN 'CONSENSUS_NOT_REWARDED' WHEN l_orderkey % 10 = 0 OR a.s = b.s THEN 'TIE_BREAK'
                    ELSE 'MISCALIBRATED' END AS kind, count(*) AS n FROM a GROUP BY 1""",
    "reference_acceptance": """
        SELECT (c_custkey % 6 = 0 AND c_nationkey / 25 >= 0.9::DOUBLE) OR coalesce(c_custkey % 5 = 0 AND CASE WHEN c_nationkey <> 3 THEN c_acctbal / 10000 END >= 0.85::DOUBLE, false) AS accepted, count(*) AS n FROM customer GROUP BY 1""",
    "address_acceptance": """
        SELECT c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 19 <> 0 AS accepted, count(*) AS n FROM customer GROUP BY 1""",
    "escalation_orders": f"""
        WITH s AS (SELECT l_orderkey, list(DISTINCT {_TRIED}) AS tried FROM lineitem GROUP BY 1),
        o AS (SELECT o_orderkey, coalesce(tried, []) AS tried, list_filter(['ALTERNATE_PREPROCESS_OCR', CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'TABLE_TRANSFORMER' END,
                     CASE WHEN o_orderstatus = 'O' THEN 'LAYOUTLMV3' END, 'VLM_FALLBACK', 'HUMAN_REVIEW'], lambda x: x IS NOT NULL) AS steps FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
        SELECT array_to_string(steps, '>') AS "order", list_filter(steps, lambda x: NOT list_contains(tried, x) AND (x <> 'VLM_FALLBACK' OR o_orderkey % 2 = 0))[1] AS next, count(*) AS n FROM o GROUP BY 1, 2""",
    "table_parser": """
        SELECT o_orderstatus, o_orderpriority = '5-LOW' OR coalesce(o_orderstatus = 'F' AND o_totalprice > 100000 AND CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 2 = 0 END, false) AS eligible, count(*) AS n FROM orders GROUP BY 1, 2""",
    "route_lookup": """
        WITH r AS (SELECT p_size % 5 AS field, CASE WHEN p_partkey % 9 = 0 THEN '*' ELSE p_type END AS family, ['SHADOW', 'PRODUCTION_APPROVED', 'EXPERIMENTAL', 'REJECTED', 'EVALUATION_ONLY'][p_partkey % 5 + 1] AS status, p_partkey FROM part),
        q AS (SELECT n_nationkey, n_nationkey % 6 AS field, ['OTHER', 'PROMO', 'SMALL', 'LARGE'][n_nationkey % 4 + 1] AS family FROM nation),
        m AS (SELECT * FROM (VALUES ('runtime', ['PRODUCTION_APPROVED']), ('shadow', ['SHADOW']), ('evaluation', ['EXPERIMENTAL', 'EVALUATION_ONLY', 'SHADOW', 'PRODUCTION_APPROVED'])) m(mode, states))
        SELECT mode, n_nationkey, 'r' || min(p_partkey) AS route_id FROM q CROSS JOIN m LEFT JOIN r ON r.field = q.field AND r.family IN (q.family, '*') AND list_contains(states, status) GROUP BY 1, 2""",
    "review_requests": """
        WITH l AS (SELECT l_orderkey, l_linenumber % 3 AS field, CASE WHEN l_quantity <> 7 THEN 'v' || l_returnflag END AS policy, l_discount > 0.05::DOUBLE AS b FROM lineitem),
        k AS (SELECT policy, max(CASE WHEN b THEN 'BLOCKS_CLAIM' ELSE 'NONBLOCKING_REVIEW' END) AS impact, count(*) AS k FROM l WHERE policy IS NOT NULL GROUP BY l_orderkey, field, policy)
        SELECT policy, impact, k, count(*) AS n FROM k GROUP BY ALL UNION ALL SELECT '-', 'REQUIRES_EVIDENCE_DECISION', 0, count(*) FROM l WHERE policy IS NULL""",
    "verified_closures": """
        WITH l AS (SELECT l_orderkey AS k, l_linenumber * 10000000 + l_partkey * 10 + l_suppkey % 10 AS pos, l_suppkey % 5 AS who, l_returnflag AS f, l_linestatus AS s FROM lineitem),
        m AS (SELECT k, min({'p': pos, 'c': 'O''' || f, 'w': who}) AS m FROM l WHERE s = 'F' AND f <> 'A' GROUP BY 1), g AS (SELECT k, m.w AS reviewer, m.c AS correction, m.p AS since FROM m),
        a AS (SELECT g.k, (min({'p': pos, 'w': who})).w AS approved_by FROM l JOIN g USING (k) WHERE s = 'O' AND pos > since AND who <> reviewer GROUP BY 1)
        SELECT CASE WHEN g.k IS NULL THEN 'OPEN' WHEN approved_by IS NULL THEN 'PENDING_SECOND_APPROVAL' ELSE 'VERIFIED_BY_HUMAN' END AS state, correction, reviewer, approved_by, count(*) AS n
        FROM orders LEFT JOIN g ON g.k = o_orderkey LEFT JOIN a ON a.k = o_orderkey GROUP BY ALL""",
    "localisation_scores": """
        WITH s AS (SELECT l_returnflag, l_linestatus, 0.3::DOUBLE * l_discount * 10 + 0.25::DOUBLE * l_tax * 10 + 0.15::DOUBLE * l_quantity / 50 + CASE WHEN l_quantity > 10 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 0.1::DOUBLE ELSE 0 END AS v,
                          0.7::DOUBLE + CASE WHEN l_quantity > 10 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 0.1::DOUBLE ELSE 0 END AS w FROM lineitem)
        SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(least(1, v / w)), 4) AS score FROM s GROUP BY 1, 2""",
    "extraction_failures": """
        SELECT CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE 'reversed' END AS how,
               CASE WHEN p_partkey % 11 = 0 THEN 'LOCALIZATION_WRONG' WHEN p_partkey % 7 = 0 THEN 'UNDER_CROP' WHEN p_partkey % 5 = 0 THEN 'OCR_EMPTY' WHEN p_partkey % 3 <> 0 AND p_name = reverse(p_name) THEN 'OCR_CHARACTER_ERROR'
                    WHEN p_partkey % 13 = 0 THEN 'CANDIDATE_RANKING_ERROR' WHEN p_partkey % 17 = 0 THEN 'SPAN_SELECTION_ERROR' WHEN p_partkey % 4 = 0 THEN 'NORMALIZATION_ERROR' ELSE 'OCR_CHARACTER_ERROR' END AS kind, count(*) AS n
        FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 4 = 0 GROUP BY 1, 2""",
    "coordinated_blockers": """
        WITH b AS (SELECT l_orderkey, count(DISTINCT l_linenumber) FILTER (l_linenumber IN (1, 2) AND l_discount > 0.05::DOUBLE) AS a, count(DISTINCT l_linenumber) FILTER (l_linenumber IN (3, 5, 7) AND l_discount > 0.05::DOUBLE) AS b FROM lineitem GROUP BY 1)
        SELECT a > 1 OR b > 1 AS coordinated, count(*) AS n FROM b GROUP BY 1""",
    "manifest_check": "SELECT n_name AS path, CASE WHEN n_nationkey % 5 = 0 THEN 'MISSING' ELSE 'CHANGED' END AS issue FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 3 = 0",
    "retried_fields": """
        WITH a AS (SELECT l_orderkey, l_linenumber AS place, CASE WHEN l_tax > 0 THEN l_returnflag END AS t, l_discount AS c, l_tax > 0 AND l_discount > 0.07::DOUBLE AS ok FROM lineitem),
        b AS (SELECT l_orderkey, place, t FROM a WHERE ok QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, place, t DESC) = 1),
        n AS (SELECT l_orderkey, count(*) AS attempts FROM a GROUP BY 1)
        SELECT attempts, place IS NOT NULL AS improved, t AS text, place, count(*) AS n FROM n LEFT JOIN b USING (l_orderkey) GROUP BY ALL""",
    "page_choice": """
        WITH p AS (SELECT l_orderkey, l_suppkey % 6 AS page, max({'s': l_discount, 'v': l_returnflag}) AS b FROM lineitem GROUP BY ALL),
        r AS (SELECT *, round(b.s - coalesce(lead(b.s) OVER w, 0), 6) AS margin, row_number() OVER w AS rn FROM p WINDOW w AS (PARTITION BY l_orderkey ORDER BY b.s DESC, page))
        SELECT page, b.v AS l_returnflag, CASE WHEN margin >= 0.02::DOUBLE THEN 'CHOSEN' ELSE 'AMBIGUOUS' END AS verdict, count(*) AS n, round(sum(margin), 4) AS margin FROM r WHERE rn = 1 GROUP BY 1, 2, 3""",
    "name_readings": """
        WITH p AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_partkey % 3 = 0 AS c, p_partkey % 6 = 0 AS s FROM part),
        w AS (SELECT k, CASE WHEN s THEN [{'p': 0, 'h': 'LAST_FIRST', 'f': b, 'm': 'x', 'l': a, 'x': 'JR'}, {'p': 1, 'h': 'LAST_FIRST', 'f': b, 'm': 'x Jr', 'l': a, 'x': ''}, {'p': 2, 'h': 'FIRST_LAST', 'f': a, 'm': b || ' x', 'l': 'Jr', 'x': ''}]
                             ELSE [{'p': 0, 'h': 'LAST_FIRST', 'f': b, 'm': '', 'l': a, 'x': ''}, {'p': 1, 'h': 'FIRST_LAST', 'f': a, 'm': '', 'l': b, 'x': ''}] END AS w FROM p),
        u AS (SELECT unnest(w) AS w FROM w)
        SELECT w.p AS place, w.h AS convention, w.f AS first, w.m AS middle, w.l AS last, w.x AS suffix, count(*) AS n FROM u GROUP BY ALL""",
    "city_names": """
        SELECT CASE c_custkey % 4 WHEN 1 THEN c_mktsegment || ' ST' WHEN 3 THEN c_mktsegment END AS city, c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ' MD' ELSE ' Q' END AS second, count(*) AS n FROM customer GROUP BY 1, 2""",
    "engine_families": """
        SELECT ['PADDLE_FAMILY', 'PADDLE_FAMILY', 'TESSERACT_FAMILY', 'RAPIDOCR_FAMILY', 'TROCR_FAMILY', 'AZURE_READ_FAMILY', 'GOT_OCR_FAMILY', 'MY OWN'][event_id % 8 + 1] AS family,
               CASE WHEN event_type IN ('view', 'click') THEN 'seen' ELSE event_type END AS field, count(*) AS n FROM events GROUP BY 1, 2""",
    "box_numbers": """
        WITH p AS (SELECT c_custkey, (c_custkey % 1000)::VARCHAR AS h, lpad(((c_custkey * 7) % 10000)::VARCHAR, 4, '0') AS e, c_custkey % 11 <> 0 AS ok FROM customer),
        o AS (SELECT *, CASE WHEN length(h) >= 4 AND h[-4:] = e THEN 4 WHEN length(h) >= 3 AND h[-3:] = e[:3] THEN 3 WHEN length(h) >= 2 AND h[-2:] = e[:2] THEN 2 WHEN h[-1:] = e[:1] THEN 1 ELSE 0 END AS r FROM p)
        SELECT c_custkey, CASE WHEN ok AND c_custkey % 3 <> 1 THEN 'PO BOX ' || h || e[r + 1:] ELSE 'po box ' || h || ['B/', '', 'o'][c_custkey % 3 + 1] END AS address FROM o""",
    "zone_scores": """
        WITH c AS (SELECT (l_quantity * 10 + 50) / 600 AS x, (l_linenumber * 100 + 20) / 800 AS y FROM lineitem)
        SELECT CASE WHEN x BETWEEN 0.3::DOUBLE AND 0.7::DOUBLE AND y BETWEEN 0.2::DOUBLE AND 0.6::DOUBLE THEN 1 WHEN x BETWEEN 0.3::DOUBLE - 0.08::DOUBLE AND 0.7::DOUBLE + 0.08::DOUBLE AND y BETWEEN 0.2::DOUBLE - 0.08::DOUBLE AND 0.6::DOUBLE + 0.08::DOUBLE
                    THEN 0.65 ELSE 0 END::DOUBLE AS score, count(*) AS n FROM c GROUP BY 1""",
    "topic_pools": """
        SELECT * FROM (VALUES (0, 'document.received', 'cpu_prep'), (1, 'document.prepared', 'none'), (2, 'page.classification.requested', 'cpu_prep'), (3, 'page.selected', 'none'), (4, 'extraction.standard.requested', 'cpu_ocr'),
            (5, 'extraction.unstructured.requested', 'gpu_ocr'), (6, 'extraction.completed', 'none'), (7, 'validation.requested', 'none'), (8, 'validation.completed', 'none'), (9, 'field.retry.requested', 'cpu_ocr'),
            (10, 'handwriting.extraction.requested', 'handwriting'), (11, 'vlm.requested', 'vlm'), (12, 'human.review.requested', 'none'), (13, 'claim.validated', 'none'), (14, 'claim.completed', 'none'),
            (15, 'output.requested', 'output'), (16, 'output.completed', 'none'), (17, 'processing.dlq', 'none')) t(place, topic, pool)""",
    "shadow_gates": """
        WITH l AS (SELECT l_orderkey, count(*) AS a, count(*) FILTER (l_returnflag = 'R') AS ac, count(*) FILTER (l_returnflag = 'R' AND l_tax < 0.08::DOUBLE) AS cc, count(*) FILTER (l_discount = 0.1::DOUBLE) AS fa,
                          count(*) FILTER (l_discount = 0.1::DOUBLE AND l_returnflag = 'R') AS cf, count(*) FILTER (l_quantity = 1) AS w, count(*) FILTER (l_quantity = 1 AND l_tax > 0) AS f FROM lineitem GROUP BY 1),
        o AS (SELECT *, o_orderstatus = 'P' AS r, o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 2) AS hit FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
        g AS (SELECT max(s) AS segment FROM (SELECT count(*) FILTER (r) / count(*) AS s FROM o GROUP BY o_orderpriority)),
        t AS (SELECT count(*) AS claims, count(*) FILTER (r) / count(*) AS p, sum(fa) / sum(a) AS fr, sum(cc) / sum(ac) AS cp, sum(f) / sum(w) AS cr, sum(ac) AS ac, sum(cf) AS cf, bool_or(hit) AS hit, bool_and(o_totalprice > 0) AS parity,
                     bool_and(o_orderkey % 1000 <> 0) AS governed FROM o),
        u AS (SELECT *, (p + 1.959963984540054 * 1.959963984540054 / (2 * claims) + 1.959963984540054 * sqrt(p * (1 - p) / claims + 1.959963984540054 * 1.959963984540054 / (4 * claims * claims))) / (1 + 1.959963984540054 * 1.959963984540054 / claims) AS up FROM t, g)
        SELECT claims, round(p, 6) AS review, round(up, 6) AS review_upper, round(segment, 6) AS segment_review, round(fr, 6) AS false_accept_rate, round(cp, 6) AS critical_precision, round(cr, 6) AS crop_recall,
               concat_ws(',', CASE WHEN hit THEN 'SOURCE_DISJOINT' END, CASE WHEN claims < 300 THEN 'MINIMUM_CLAIMS' END, CASE WHEN ac < 1000 THEN 'MINIMUM_ACCEPTED_CRITICAL_FIELDS' END, CASE WHEN p > 0.2::DOUBLE THEN 'CLAIM_HITL' END,
                         CASE WHEN up >= 0.25::DOUBLE THEN 'CLAIM_HITL_UPPER_95' END, CASE WHEN segment > 0.3::DOUBLE THEN 'SEGMENT_CLAIM_HITL' END, CASE WHEN fr > 0.001::DOUBLE THEN 'FALSE_ACCEPT_RATE' END,
                         CASE WHEN cf > 0 THEN 'CRITICAL_FALSE_ACCEPTS' END, CASE WHEN cp < 0.999::DOUBLE THEN 'CRITICAL_ACCEPTED_PRECISION' END, CASE WHEN cr < 0.95::DOUBLE THEN 'WRONG_CROP_RECALL' END,
                         CASE WHEN NOT parity THEN 'RUNTIME_PARITY' END, CASE WHEN NOT governed THEN 'ROUTE_GOVERNANCE' END) AS blockers, false AS passed FROM u""",
    "routing_report": """
        WITH r AS (SELECT source, lang, CASE WHEN toxic = 1 THEN 'xx' WHEN quality = 0 THEN 'en' ELSE lang END AS p, n_chars > 500 AS l, coalesce(lang IN ('en', 'de'), false) AS w, n_chars::DOUBLE AS ms FROM documents LEFT JOIN labels USING (doc_id))
        SELECT CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source, count(*) AS documents, round(avg(coalesce(lang = p, false)::INT), 6) AS family_accuracy, round(avg((coalesce(l, false) = w)::INT), 6) AS route_accuracy,
               round(count(*) FILTER (p IN ('en', 'de') AND w) / nullif(count(*) FILTER (p IN ('en', 'de')), 0), 6) AS nomination_precision, round(count(*) FILTER (w AND lang = p) / nullif(count(*) FILTER (w), 0), 6) AS nomination_recall,
               count(*) FILTER (NOT lang IN ('en', 'de') AND l) AS false_standard, round(quantile_disc(ms, 0.95), 6) AS p95, round(avg(ms), 4) AS mean FROM r GROUP BY GROUPING SETS ((source), ())""",
}
