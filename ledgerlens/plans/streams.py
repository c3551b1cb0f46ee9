"""Streaming queries: what the stream operators give on the driver's events, run over all that is there."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.session import scratch_path, table
from ledgerlens.streaming import events as E


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files; a copy in a folder, as a stream reads folders."""
    folder = scratch_path(spark, "event-files")
    source = table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    source.write.parquet(folder)
    return spark.readStream.schema(source.schema).parquet(folder)


def _collected(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows of a stream, by a run over what is there."""
    out = scratch_path(spark, "stream-out")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "stream-state")).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each event twice in the stream, once in the result."""
    s = _stream(spark, d)
    twice = s.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    out = _collected(spark, E.deduplicated(twice, ["event_id"], "ts", "3650 days"))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_stage(spark: SparkSession, d: str) -> DataFrame:
    """A stage that takes events of known kinds and rejects the others, with both counted."""
    made, bad = scratch_path(spark, "stage-made"), scratch_path(spark, "stage-bad")
    known = F.col("event_type").isin("click", "view", "purchase")
    E.run_available(_stream(spark, d), E.stage(lambda b: (b.filter(known), b.filter(~known)), made, bad), scratch_path(spark, "stage-state"))
    read = lambda p, s: spark.read.option("recursiveFileLookup", "true").parquet(p).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(s))
    return read(made, "made").unionByName(read(bad, "rejected"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events of each kind by day."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = E.windowed_counts(rows, "ts", "event_type", "1 day")
    return out.select(F.to_date("start").alias("day"), "event_type", "n")


def envelope_checks(spark: SparkSession, d: str) -> DataFrame:
    """Events as envelopes, some without an id or with raw bytes."""
    payload = F.when(F.col("event_id") % 7 == 0, F.lit('{"bytes": "00"}')).otherwise(F.lit("{}"))
    fields = F.struct(F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string")).alias("event_id"), F.col("event_type"), F.lit(1).alias("attempt"), payload.alias("payload"))
    raw = table(spark, d, "events").select(F.to_json(fields).alias("value"))
    return E.envelopes(raw).groupBy("event_type", "ok").agg(F.count(F.lit(1)).alias("n"))


def outbox_relay(spark: SparkSession, d: str) -> DataFrame:
    """Published and waiting rows after one run of the relay."""
    box = table(spark, d, "orders").select("o_orderkey", "o_orderdate", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderdate").cast("timestamp")).alias("published"))
    _, after = E.relay(box.withColumn("place", F.struct("o_orderdate", "o_orderkey")), "o_orderkey", "place", "published", datetime(2024, 1, 1))
    return after.groupBy(F.col("published").isNull().alias("waiting"), (F.year("published") == 2024).alias("now")).agg(F.count(F.lit(1)).alias("n"))


def review_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Reviews asked for orders' parts that have no task yet."""
    tasks = table(spark, d, "lineitem").filter("l_linenumber = 1").select("l_orderkey", "l_partkey")
    asked = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.struct("l_linenumber").alias("place"), "l_linenumber")
    return E.new_tasks(tasks, asked, ["l_orderkey", "l_partkey"], "place").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))


def retention_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Orders kept and deleted by status, each status with a limit of its own."""
    days = spark.createDataFrame([("F", 2000), ("O", 3000)], "o_orderstatus string, days int")
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    stay, audit = E.retention(rows, "o_orderdate", "o_orderstatus", days, datetime(2001, 1, 1), 1000)
    return stay.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("kept")).unionByName(
        audit.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("deleted"))
    )


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Lines answered by a cache of parts, and the parts to compute."""
    cache = table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("key"), "p_name")
    hits, misses = E.cached(table(spark, d, "lineitem").select(F.col("l_partkey").alias("key")), cache, "key")
    return hits.agg(F.lit("hits").alias("side"), F.count(F.lit(1)).alias("n")).unionByName(misses.agg(F.lit("misses").alias("side"), F.count(F.lit(1)).alias("n")))


def retry_escalation(spark: SparkSession, d: str) -> DataFrame:
    """The next kind of event to try for each user on each day, after that day's kinds."""
    seen = table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("attempted"))
    n = E.next_attempt(["view", "click", "purchase", "logout", "login"], F.col("attempted"))
    return seen.groupBy(F.coalesce(n, F.lit("NONE")).alias("next")).agg(F.count(F.lit(1)).alias("n"))


def workflow_audit(spark: SparkSession, d: str) -> DataFrame:
    """How far orders come through three steps."""
    steps = [("RECEIVED", F.col("o_totalprice") > 1000), ("PRICED", F.col("o_totalprice") < 400000), ("CLOSED", F.col("o_orderstatus") != "O")]
    return E.workflow(table(spark, d, "orders"), steps, "o_orderkey").groupBy("place", "step", "ok").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        stream_dedup, stream_stage, event_windows, envelope_checks, outbox_relay, review_upserts, retention_sweep, cache_lookup, retry_escalation, workflow_audit,
    )
}
ORACLES = {
    "stream_dedup": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "stream_stage": "SELECT event_type, count(*) AS n, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'made' ELSE 'rejected' END AS side FROM events GROUP BY 1",
    "event_windows": "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "envelope_checks": "SELECT event_type, event_id % 5 <> 0 AND event_id % 7 <> 0 AS ok, count(*) AS n FROM events GROUP BY 1, 2",
    "outbox_relay": """
        WITH w AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders WHERE o_orderkey % 3 <> 0),
        s AS (SELECT o_orderkey % 3 = 0 AS old, coalesce(rn <= 100, false) AS sent FROM orders LEFT JOIN w USING (o_orderkey))
        SELECT NOT old AND NOT sent AS waiting, CASE WHEN old THEN false WHEN sent THEN true END AS now, count(*) AS n FROM s GROUP BY 1, 2""",
    "review_upserts": """
        WITH t AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = 1),
        a AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2)
        SELECT l_linenumber, count(*) AS n FROM a ANTI JOIN t USING (l_orderkey, l_partkey) GROUP BY 1""",
    "retention_sweep": """
        SELECT o_orderstatus, count(*) AS n,
               CASE WHEN o_orderdate < TIMESTAMP '2001-01-01' - to_days(CASE o_orderstatus WHEN 'F' THEN 2000 WHEN 'O' THEN 3000 ELSE 1000 END) THEN 'deleted' ELSE 'kept' END AS side FROM orders GROUP BY 1, 3""",
    "cache_lookup": """
        SELECT 'hits' AS side, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 2 = 0
        UNION ALL SELECT 'misses', count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0)""",
    "retry_escalation": """
        WITH s AS (SELECT user_id, list(DISTINCT event_type) AS a FROM events GROUP BY user_id, ts::DATE)
        SELECT coalesce(CASE WHEN len(a) < 3 THEN list_filter(['view', 'click', 'purchase', 'logout', 'login'], lambda x: NOT list_contains(a, x))[1] END, 'NONE') AS next, count(*) AS n FROM s GROUP BY 1""",
    "workflow_audit": """
        WITH s AS (SELECT o_totalprice > 1000 AS a, o_totalprice < 400000 AS b, o_orderstatus <> 'O' AS c FROM orders),
        r AS (SELECT 0 AS place, 'RECEIVED' AS step, a AS ok FROM s UNION ALL SELECT 1, 'PRICED', b FROM s WHERE a UNION ALL SELECT 2, 'CLOSED', c FROM s WHERE a AND b)
        SELECT place, step, ok, count(*) AS n FROM r GROUP BY 1, 2, 3""",
}
