"""Stateful processors over file streams."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlens.streaming import events as E

START = datetime(2024, 1, 1)


def run(spark, tmp_path, batches, processor, columns):
    """Feeds the batches as files, one a trigger, and returns what the processor gives."""
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = None
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, f"key string, {columns}")
        schema = frame.schema
        frame.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = E.governed(stream, "key", processor, [c.split()[0] for c in columns.split(", ")])
    query = out.writeStream.format("memory").queryName(f"governed_{abs(hash(str(tmp_path)))}").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(query.name)


def at(seconds: int) -> datetime:
    return START + timedelta(seconds=seconds)


def test_rate_governor(spark, tmp_path) -> None:
    batches = [[("a", at(0)), ("a", at(10)), ("a", at(20)), ("b", at(5))], [("a", at(59)), ("a", at(61)), ("a", at(65))]]
    found = run(spark, tmp_path, batches, E.RateGovernor(2, 60), "at timestamp")
    by = {(r.key, (r.at - START).seconds): r.allowed for r in found.collect()}
    assert by == {("a", 0): True, ("a", 10): True, ("a", 20): False, ("b", 5): True, ("a", 59): False, ("a", 61): True, ("a", 65): False}


def test_breaker(spark, tmp_path) -> None:
    batches = [[("a", at(0), False), ("a", at(1), False), ("a", at(2), True)], [("a", at(40), True), ("a", at(41), False)]]
    found = run(spark, tmp_path, batches, E.Breaker(2, 30), "at timestamp, ok boolean")
    assert [r.called for r in found.orderBy(F.col("at")).collect()] == [True, True, False, True, True]
