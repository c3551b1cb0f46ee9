"""Window queries over events, order lines and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ledgerlens.operators import ranking as R
from ledgerlens.session import table


def latest_event(spark: SparkSession, d: str) -> DataFrame:
    return R.latest(table(spark, d, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


def line_margin(spark: SparkSession, d: str) -> DataFrame:
    """Each order's dearest line and its margin over the next."""
    out = R.top_with_margin(table(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice", "l_linenumber")
    return out.select("l_orderkey", "l_linenumber", F.round("margin", 2).alias("margin"))


def numeric_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent quantity of each part, with support and margin."""
    return R.consensus(table(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").cast("int").alias("quantity")), ["l_partkey"], "quantity")


def text_consensus(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent kind of event of each user."""
    return R.consensus(table(spark, d, "events"), ["user_id"], "event_type", least=3)


def candidate_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order as candidates, by a weighted sum of discount, tax and quantity."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("b"), (F.col("l_quantity") / 50).alias("c"))
    out = R.rank_candidates(rows, ["l_orderkey"], "l_linenumber", {"a": 0.5, "b": 0.3, "c": 0.2})
    return out.select("l_orderkey", "l_linenumber", "score", "rank", "close")


def evidence_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Return flags of an order's lines as values, suppliers as families, discounts as scores; urgent orders have a reference."""
    known = F.when(F.col("o_orderpriority") == "1-URGENT", F.when(F.col("o_orderstatus") == "O", " n").otherwise("R"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), known.alias("reference"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_suppkey", (F.col("l_discount") * 10).alias("score")).join(orders, "l_orderkey", "left")
    out = R.reconcile_evidence(rows, ["l_orderkey"], "l_returnflag", "l_suppkey", "score", "reference")
    return out.groupBy("l_returnflag", "families", "verdict").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


def role_islands(spark: SparkSession, d: str) -> DataFrame:
    """Parts of conversations that a user's turn begins: turns and characters."""
    out = R.islands(table(spark, d, "conversations"), ["conv_id"], "turn", F.col("role") == "user")
    return out.groupBy("conv_id", "island").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"))


def order_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of consecutive days on which a segment's customers order."""
    days = table(spark, d, "orders").select(F.date_diff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).alias("day"), "o_orderpriority").distinct()
    out = R.runs(days, ["o_orderpriority"], "day")
    return out.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"))


def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user in the last hour, at each event."""
    return R.rate_window(table(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "in_window")


def daily_budget(spark: SparkSession, d: str) -> DataFrame:
    return R.daily_budget(table(spark, d, "events"), "user_id", "ts", "value", "event_id", 100.0).select("event_id", "spent", "within")


def hash_chain(spark: SparkSession, d: str) -> DataFrame:
    """Chains of each user's events; one event in 50 is altered with its hash and the next one's pointer: rows, broken links, last hash."""
    payload = F.concat_ws("|", F.col("event_id").cast("string"), F.col("event_type"))
    chained = R.chain_hashes(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id", payload)
    hit, w = F.col("event_id") % 50 == 0, W.partitionBy("user_id").orderBy("event_id")
    altered = chained.withColumn("event_type", F.when(hit, "altered").otherwise(F.col("event_type")))
    altered = altered.withColumn("event_hash", F.when(hit, F.sha2(F.concat("previous_hash", payload), 256)).otherwise(F.col("event_hash")))
    altered = altered.withColumn("previous_hash", F.lag("event_hash", 1, R.START).over(w))
    return R.verify_chain(altered, ["user_id"], "event_id", payload)


def latest_distinct(spark: SparkSession, d: str) -> DataFrame:
    """The last five distinct kinds of line of each supplier, newest last."""
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", (F.unix_date(F.to_date("l_shipdate")).cast("long") * 100_000_000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return R.latest_distinct(rows, ["l_suppkey"], ["l_returnflag", "l_linestatus"], "at", 3).select("l_suppkey", "l_returnflag", "l_linestatus", "place")


def allocation(spark: SparkSession, d: str) -> DataFrame:
    return R.largest_remainder(table(spark, d, "documents"), ["lang", "source"], 120)


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """120 documents by language and source in order of their hash (a sampling operator)."""
    return R.stratified_pick(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 120, "sample").select("doc_id", "lang", "source")


def strata_turns(spark: SparkSession, d: str) -> DataFrame:
    """The first 40 labels to make when sources take turns, good documents first."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return R.strata_turns(rows, ["source"], F.col("quality") == 0, "doc_id", 40).select("doc_id", "source")


def next_method(spark: SparkSession, d: str) -> DataFrame:
    """The next priority to try for each customer, of those not seen in its orders."""
    seen = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("attempted"))
    order = ["5-LOW", "3-MEDIUM", "1-URGENT", "2-HIGH", "4-NOT SPECIFIED"]
    return seen.select("o_custkey", F.coalesce(R.next_untried(order, F.col("attempted")), F.lit("NONE")).alias("next"))


def top_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The ten kinds of part with most lines."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "p_type").limit(10)


QUERIES = {
    f.__name__: f
    for f in (
        latest_event, line_margin, numeric_consensus, text_consensus, candidate_ranking, evidence_reconciliation, role_islands, order_runs, rate_limit,
        daily_budget, hash_chain, latest_distinct, allocation, stratified_sample, strata_turns, next_method, top_reasons,
    )
}
_CONSENSUS = """
    WITH c AS (SELECT {k}, {v}, count(*) AS support FROM {t} GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(support) OVER w, 0) AS runner_up FROM c WINDOW w AS (PARTITION BY {k} ORDER BY support DESC, {v}))
    SELECT {k}, {v}, support, runner_up, support > runner_up AND support >= {n} AS accepted FROM r WHERE rn = 1"""
_ALLOCATION = """a AS (
    SELECT lang, source, count(*) AS size, count(*) * 120.0::DOUBLE / sum(count(*)) OVER () AS share FROM documents GROUP BY ALL),
    b AS (SELECT *, floor(share)::INT AS f, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, lang, source) AS place,
                 120 - sum(floor(share)::INT) OVER () AS rest FROM a),
    alloc AS (SELECT lang, source, size, f + CASE WHEN place <= rest THEN 1 ELSE 0 END AS allocated FROM b)"""
ORACLES = {
    "latest_event": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "line_margin": """
        SELECT l_orderkey, l_linenumber, round(l_extendedprice - coalesce(lead(l_extendedprice) OVER w, 0), 2) AS margin FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) QUALIFY row_number() OVER w = 1""",
    "numeric_consensus": _CONSENSUS.format(k="l_partkey", v="quantity", t="(SELECT l_partkey, l_quantity::INT AS quantity FROM lineitem)", n=2),
    "text_consensus": _CONSENSUS.format(k="user_id", v="event_type", t="(SELECT * FROM events WHERE event_type IS NOT NULL)", n=3),
    "candidate_ranking": """
        WITH s AS (SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, 0 + l_discount * 10 * 0.5::DOUBLE + l_tax * 10 * 0.3::DOUBLE + l_quantity / 50 * 0.2::DOUBLE)), 6) AS score FROM lineitem)
        SELECT *, row_number() OVER w AS rank, coalesce(score - lead(score) OVER w < 0.03::DOUBLE, false) AS close
        FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber DESC)""",
    "evidence_reconciliation": """
        WITH g AS (SELECT l_orderkey, l_returnflag, count(DISTINCT l_suppkey) AS families, max(l_discount * 10) AS best,
                          any_value(CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderstatus = 'O' THEN 'N' ELSE 'R' END END) AS ref
                   FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
        t AS (SELECT *, families >= 2 AS agreed, row_number() OVER w AS rn, lead(families >= 2) OVER w AS a2, lead(best) OVER w AS b2 FROM g
              WINDOW w AS (PARTITION BY l_orderkey ORDER BY (families >= 2)::INT DESC, best DESC, l_returnflag)),
        v AS (SELECT *, coalesce(ref = l_returnflag, false) AS hit FROM t WHERE rn = 1),
        c AS (SELECT *, CASE WHEN hit THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, best + CASE WHEN agreed THEN 0.04::DOUBLE ELSE 0 END) END AS confidence FROM v)
        SELECT l_returnflag, families, CASE WHEN ref IS NOT NULL AND NOT hit THEN 'CONTRADICTION' WHEN NOT hit AND coalesce(a2 = agreed AND best - b2 < 0.05::DOUBLE, false) THEN 'CONFLICT'
                    WHEN (agreed OR hit) AND confidence >= 0.45::DOUBLE THEN 'ACCEPT' ELSE 'REVIEW' END AS verdict,
               count(*) AS n, round(sum(round(confidence, 6)), 4) AS confidence FROM c GROUP BY ALL""",
    "role_islands": """
        WITH i AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS island FROM conversations)
        SELECT conv_id, island::BIGINT AS island, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM i GROUP BY ALL""",
    "order_runs": """
        WITH d AS (SELECT DISTINCT date_diff('day', DATE '1990-01-01', o_orderdate::DATE) AS day, o_orderpriority FROM orders),
        g AS (SELECT o_orderpriority, day - row_number() OVER (PARTITION BY o_orderpriority ORDER BY day) AS g FROM d),
        r AS (SELECT o_orderpriority, g, count(*) AS n FROM g GROUP BY ALL)
        SELECT o_orderpriority, count(*) AS runs, max(n) AS longest FROM r GROUP BY 1""",
    "rate_limit": """
        SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events""",
    "daily_budget": """
        WITH s AS (SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS spent FROM events)
        SELECT *, spent <= 100 AS within FROM s""",
    "hash_chain": """
        WITH l AS (SELECT *, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) % 50 = 0 AS after FROM events),
        c AS (SELECT user_id, count(*) AS n, count(*) FILTER (after) AS broken, max(event_id) % 50 = 0 AS last_hit, max(event_id) AS last,
                     list_prepend(repeat('0', 64), list(event_id || '|' || event_type ORDER BY event_id)) AS p FROM l GROUP BY 1)
        SELECT user_id, n, broken, CASE WHEN last_hit THEN sha256(list_reduce(p[:-2], lambda a, x: sha256(a || x)) || last || '|altered')
                                        ELSE list_reduce(p, lambda a, x: sha256(a || x)) END AS head FROM c""",
    "latest_distinct": """
        WITH n AS (SELECT l_suppkey, l_returnflag, l_linestatus, max(date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::BIGINT * 100000000 + l_orderkey * 10 + l_linenumber) AS pos
                   FROM lineitem GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY pos DESC, l_returnflag, l_linestatus) AS rn FROM n)
        SELECT l_suppkey, l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_suppkey ORDER BY rn DESC) AS place FROM r WHERE rn <= 3""",
    "allocation": f"WITH {_ALLOCATION} SELECT * FROM alloc",
    "stratified_sample": f"""
        WITH {_ALLOCATION}, r AS (
            SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('sample:' || doc_id), doc_id) AS rn FROM documents)
        SELECT doc_id, lang, source FROM r JOIN alloc USING (lang, source) WHERE rn <= allocated""",
    "strata_turns": """
        WITH r AS (SELECT doc_id, source, quality = 0 AS b, row_number() OVER (PARTITION BY source, quality = 0 ORDER BY doc_id) AS t
                   FROM labels JOIN documents USING (doc_id))
        SELECT doc_id, source FROM r ORDER BY b, t, source, doc_id LIMIT 40""",
    "next_method": """
        WITH s AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS a FROM orders GROUP BY 1)
        SELECT o_custkey, coalesce(list_filter(['5-LOW', '3-MEDIUM', '1-URGENT', '2-HIGH', '4-NOT SPECIFIED'], lambda x: NOT list_contains(a, x))[1], 'NONE') AS next FROM s""",
    "top_reasons": "SELECT p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY n DESC, p_type LIMIT 10",
}
