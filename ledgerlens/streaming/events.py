"""Event streams: envelopes, deduplication, stage loops with rejects, outbox, review upserts, retention and governors.

Batch logic is in functions of (frame, batch id) for ``foreachBatch``, so that it is the same in tests, in batch and in
a stream; what a replayed batch would write again is keyed by the batch id or by content.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ledgerlens.session import small

#: The topics of the stages, in order of the flow.
TOPICS = (
    "document.received", "document.prepared", "page.classification.requested", "page.selected", "extraction.standard.requested", "extraction.unstructured.requested",
    "extraction.completed", "validation.requested", "validation.completed", "field.retry.requested", "handwriting.extraction.requested", "vlm.requested",
    "human.review.requested", "claim.validated", "claim.completed", "output.requested", "output.completed", "processing.dlq",
)
#: The pools of workers and the topics that each consumes.
POOLS = {
    "cpu_prep": ("document.received", "page.classification.requested"), "cpu_ocr": ("extraction.standard.requested", "field.retry.requested"),
    "gpu_ocr": ("extraction.unstructured.requested",), "handwriting": ("handwriting.extraction.requested",), "vlm": ("vlm.requested",), "output": ("output.requested",),
}
ENVELOPE = T.StructType(
    [
        T.StructField("event_id", T.StringType()), T.StructField("event_type", T.StringType()), T.StructField("event_version", T.StringType()), T.StructField("occurred_at", T.TimestampType()),
        T.StructField("correlation_id", T.StringType()), T.StructField("document_id", T.StringType()), T.StructField("claim_id", T.StringType()), T.StructField("attempt", T.IntegerType()),
        T.StructField("pipeline_version", T.StringType()), T.StructField("trace_context", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.StringType()),
    ]
)


def pool_of(topic: Column) -> Column:
    """The pool of workers that consumes a topic; null for topics that none of them does."""
    return F.coalesce(*[F.when(topic.isin(*topics), F.lit(pool)) for pool, topics in POOLS.items()])


def kafka_source(spark: SparkSession, servers: str, topics: list[str]) -> DataFrame:
    """Topics of a Kafka cluster as (topic, key, value, timestamp); needs the connector's package on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").load()


def kafka_sink(df: DataFrame, servers: str, topic: Column, key: Column, value: Column, checkpoint: str) -> StreamingQuery:
    out = df.select(topic.alias("topic"), key.cast("string").alias("key"), value.cast("string").alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("checkpointLocation", checkpoint).start()


def envelopes(raw: DataFrame, value: str = "value") -> DataFrame:
    """Parsed envelopes with ``ok``: an id, a type, a first attempt or later, and no raw bytes in the payload."""
    e = F.from_json(F.col(value).cast("string"), ENVELOPE)
    rows = raw.select(F.col(value).cast("string").alias("raw"), e.alias("e")).select("raw", "e.*")
    clean = ~F.coalesce(F.col("payload"), F.lit("")).rlike(r'"(bytes|content_base64)"\s*:')
    ok = F.col("event_id").isNotNull() & F.col("event_type").isNotNull() & (F.coalesce("attempt", F.lit(1)) >= 1) & clean
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False)))


def deduplicated(events: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """Rows with the first of each key: for good in batch, within the watermark's delay in a stream."""
    if events.isStreaming:
        return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    w = W.partitionBy(*keys).orderBy(ts)
    return events.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def windowed_counts(events: DataFrame, ts: str, by: str, length: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows of each kind in each tumbling window; late rows beyond the delay are left out in a stream."""
    rows = events.withWatermark(ts, delay) if events.isStreaming else events
    out = rows.groupBy(F.window(ts, length), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), by, "n")


def stage(handle: Callable[[DataFrame], tuple[DataFrame, DataFrame]], out: str, rejects: str) -> Callable[[DataFrame, int], None]:
    """A stage's batch: what it makes and what it rejects, each in a folder of the batch, so a replay overwrites its own."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        made, bad = handle(batch)
        made.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        batch.unpersist()

    return run


def run_available(stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Handles all that is there now and ends."""
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def outbox_batch(outbox: DataFrame, order: str, published: str, n: int = 100) -> DataFrame:
    """The oldest n rows that aren't published."""
    return outbox.filter(F.col(published).isNull()).orderBy(order).limit(n)


def relay(outbox: DataFrame, key: str, order: str, published: str, at: datetime, n: int = 100) -> tuple[DataFrame, DataFrame]:
    """The rows to publish, and the outbox with them marked."""
    chosen = outbox_batch(outbox, order, published, n)
    marked = outbox.join(chosen.select(key, F.lit(True).alias("__sent")), key, "left")
    after = marked.withColumn(published, F.when(F.col("__sent"), F.lit(at)).otherwise(F.col(published))).select(*outbox.columns)
    return chosen, after


def new_tasks(tasks: DataFrame, requests: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Requests (the first of each key) for which no task exists yet."""
    w = W.partitionBy(*keys).orderBy(order)
    first = requests.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
    return first.join(tasks.select(*keys).distinct(), keys, "left_anti").select(*requests.columns)


def retention(rows: DataFrame, received: str, tenant: str, days: DataFrame, as_of: datetime, default_days: int = 90) -> tuple[DataFrame, DataFrame]:
    """Rows that stay, and an audit row for each one deleted; ``days`` has each tenant's limit and is small."""
    limit = F.coalesce(F.col("days"), F.lit(default_days))
    joined = rows.join(small(days.select(tenant, "days")), tenant, "left")
    old = F.col(received).cast("timestamp") < F.lit(as_of) - F.make_interval(days=limit)
    marked = joined.withColumn("__old", F.coalesce(old, F.lit(False)))
    audit = marked.filter("__old").select(*rows.columns).withColumns({"action": F.lit("RETENTION_DELETE"), "audited_at": F.lit(as_of)})
    return marked.filter("not __old").select(*rows.columns), audit


def cached(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests answered by the cache, and the first request of each key that isn't."""
    hits = requests.join(cache, key)
    misses = requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    return hits, misses


def next_attempt(order: list[str], attempted: Column, most: int = 3) -> Column:
    """The next method of an escalation order, null once all or ``most`` have been tried."""
    left = F.array_except(F.array(*[F.lit(m) for m in order]), attempted)
    return F.when(F.size(attempted) < most, F.get(left, F.lit(0)))


def workflow(claims: DataFrame, steps: list[tuple[str, Column]], key: str) -> DataFrame:
    """Each claim's audit: a row for each step up to the first that doesn't hold, with its outcome."""
    n = len(steps)
    outcomes = F.array(*[F.coalesce(c, F.lit(False)) for _, c in steps])
    failed = F.array_position(outcomes, False)
    rows = claims.select(key, outcomes.alias("o"), F.when(failed == 0, n).otherwise(failed).alias("last"))
    names = F.array(*[F.lit(name) for name, _ in steps])
    long = rows.select(key, "last", F.posexplode(F.arrays_zip(names.alias("step"), F.col("o").alias("ok"))).alias("place", "s"))
    return long.filter("place < last").select(key, "place", "s.step", "s.ok")


class RateGovernor(StatefulProcessor):
    """Allows at most ``limit`` requests of a key in ``seconds``; refused ones don't count."""

    SCHEMA = "key string, at timestamp, allowed boolean"

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "at double")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        kept = [r[0] for r in self.times.get()] if self.times.exists() else []
        frame = pd.concat(list(rows)).sort_values("at", kind="stable")
        allowed = []
        for at in frame["at"]:
            now = at.timestamp()
            kept = [t for t in kept if now - t < self.seconds]
            ok = len(kept) < self.limit
            if ok:
                kept.append(now)
            allowed.append(ok)
        self.times.put([(t,) for t in kept])
        yield pd.DataFrame({"key": key[0], "at": frame["at"].values, "allowed": allowed})

    def close(self) -> None:
        pass


class Breaker(StatefulProcessor):
    """A circuit for each key: open after ``failures`` in a row, closed again ``reset`` seconds later."""

    SCHEMA = "key string, at timestamp, called boolean"

    def __init__(self, failures: int, reset: int) -> None:
        self.failures, self.reset = failures, reset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "failed int, opened double")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        failed, opened = self.state.get() if self.state.exists() else (0, 0.0)
        frame = pd.concat(list(rows)).sort_values("at", kind="stable")
        called = []
        for at, ok in zip(frame["at"], frame["ok"], strict=True):
            now = at.timestamp()
            if failed >= self.failures and now - opened >= self.reset:
                failed = 0
            open_now = failed >= self.failures
            called.append(not open_now)
            if not open_now:
                failed = 0 if ok else failed + 1
                opened = now if failed >= self.failures else opened
        self.state.update((int(failed), float(opened)))
        yield pd.DataFrame({"key": key[0], "at": frame["at"].values, "called": called})

    def close(self) -> None:
        pass


def governed(events: DataFrame, key: str, processor: StatefulProcessor, columns: list[str]) -> DataFrame:
    """A stateful processor over a stream keyed by ``key``."""
    rows = events.select(F.col(key).cast("string").alias("key"), *columns)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.SCHEMA, outputMode="append", timeMode="none")
