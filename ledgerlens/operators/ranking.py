"""Window operators: newest rows, consensus with margins, rankings, running budgets, islands and hash chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ledgerlens.session import materialize


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__rn = 1").drop("__rn")


def top_with_margin(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """Each key's best row with its margin over the runner-up (the whole score where there is none)."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))
    ranked = df.withColumns({"__rn": F.row_number().over(w), "margin": F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0))})
    return ranked.filter("__rn = 1").drop("__rn")


def consensus(df: DataFrame, keys: list[str], value: str, least: int = 2) -> DataFrame:
    """The most frequent value of each key with its support and the runner-up's; accepted if ahead with enough support.

    Ties go to the smaller value. Counts are combined before the shuffle, so a frequent value is a few rows.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("support"))
    w = W.partitionBy(*keys).orderBy(F.desc("support"), F.asc(value))
    out = counts.withColumns({"__rn": F.row_number().over(w), "runner_up": F.coalesce(F.lead("support").over(w), F.lit(0))})
    accepted = (F.col("support") > F.col("runner_up")) & (F.col("support") >= least)
    return out.filter("__rn = 1").select(*keys, value, "support", "runner_up", accepted.alias("accepted"))


def rank_candidates(df: DataFrame, keys: list[str], identifier: str, weights: dict[str, float], tight: float = 0.03) -> DataFrame:
    """Candidates by a weighted sum of their features, clipped to [0, 1]; close where the next is within ``tight``."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    scored = df.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6))
    w = W.partitionBy(*keys).orderBy(F.desc("score"), F.desc(identifier))
    close = F.coalesce(F.col("score") - F.lead("score").over(w) < tight, F.lit(False))
    return scored.withColumns({"rank": F.row_number().over(w), "close": close})


#: What agreement of independent families adds to a value's confidence.
AGREEMENT_BONUS = 0.04


def reconcile_evidence(
    df: DataFrame, keys: list[str], value: str, family: str, score: str, reference: str | None = None, margin: float = 0.05, least: float = 0.45
) -> DataFrame:
    """The best value of each key: first what at least two independent families read, then by calibrated score, then by value.

    Its confidence is 1 where it is the verified ``reference`` (the same for all rows of a key; case and outer blanks
    don't count), else the best score and a bonus for agreement. CONTRADICTION with the reference, CONFLICT (the next
    agrees as well and is within the margin), ACCEPT (agreement or reference, and confidence enough) or REVIEW.
    """
    known = F.first(reference, ignorenulls=True) if reference else F.lit(None).cast("string")
    groups = df.filter(F.trim(value) != "").groupBy(*keys, value).agg(F.count_distinct(family).alias("families"), F.max(score).alias("best"), known.alias("__r"))
    groups = groups.withColumn("agreed", F.col("families") >= 2)
    w = W.partitionBy(*keys).orderBy(F.desc("agreed"), F.desc("best"), F.asc(value))
    top = groups.withColumns({"__rn": F.row_number().over(w), "__a": F.lead("agreed").over(w), "__b": F.lead("best").over(w)}).filter("__rn = 1")
    plain = lambda c: F.lower(F.trim(c))
    match = F.coalesce(plain(F.col(value)) == plain(F.col("__r")), F.lit(False))
    confidence = F.when(match, 1.0).otherwise(F.least(F.lit(1.0), F.col("best") + F.when(F.col("agreed"), AGREEMENT_BONUS).otherwise(0.0)))
    tied = F.coalesce((F.col("__a") == F.col("agreed")) & (F.col("best") - F.col("__b") < margin), F.lit(False))
    verdict = (
        F.when(F.col("__r").isNotNull() & ~match, "CONTRADICTION").when(tied & ~match, "CONFLICT")
        .when((F.col("agreed") | match) & (confidence >= least), "ACCEPT").otherwise("REVIEW")
    )
    return top.select(*keys, value, "families", "best", F.round(confidence, 6).alias("confidence"), verdict.alias("verdict"))


def islands(df: DataFrame, keys: list[str], order: str, start: Column) -> DataFrame:
    """Numbers the runs of rows that begin where ``start`` holds."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("island", F.sum(F.when(start, 1).otherwise(0)).over(w))


def runs(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Maximal runs of consecutive numbers: first, last, length."""
    w = W.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("__g", F.col(order) - F.row_number().over(w))
    return marked.groupBy(*keys, "__g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("__g")


def rate_window(df: DataFrame, key: str, ts: str, seconds: int = 60) -> DataFrame:
    """How many rows of the key fall in the last ``seconds`` seconds, this one included."""
    w = W.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return df.withColumn("in_window", F.count(F.lit(1)).over(w))


def daily_budget(df: DataFrame, key: str, ts: str, cost: str, tie: str, limit: float) -> DataFrame:
    """The running cost of the key on each UTC day, and whether it is within the limit."""
    w = W.partitionBy(key, F.to_date(ts)).orderBy(ts, tie).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("spent", F.round(F.sum(cost).over(w), 6)).withColumn("within", F.col("spent") <= limit)


START = "0" * 64


def chain_hashes(df: DataFrame, keys: list[str], order: str, payload: Column) -> DataFrame:
    """Each row with its predecessor's hash (zeros at the start) and its own: that of the predecessor's and its payload.

    A chain is sequential: rows are dealt by key and sorted, and each partition is read as a stream with one hash kept,
    so that no chain is held in memory.
    """
    at, width = [df.columns.index(k) for k in keys], len(df.columns)
    dealt = df.withColumn("__payload", payload).repartition(*keys).sortWithinPartitions(*keys, order)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, START
        for batch in batches:
            before, own = [], []
            for *found, text in zip(*(batch.column(k).to_pylist() for k in [*at, width]), strict=True):
                if found != key:
                    key, last = found, START
                before.append(last)
                last = hashlib.sha256((last + (text or "")).encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(before, pa.string()), pa.array(own, pa.string())], names)

    names = [*df.columns, "previous_hash", "event_hash"]
    schema = T.StructType([*df.schema.fields, T.StructField("previous_hash", T.StringType()), T.StructField("event_hash", T.StringType())])
    return dealt.mapInArrow(link, schema)


def verify_chain(df: DataFrame, keys: list[str], order: str, payload: Column) -> DataFrame:
    """Rows of each key, and of those the broken ones: the hash isn't that of the named predecessor's hash and the payload, or the one named isn't the predecessor's."""
    w = W.partitionBy(*keys).orderBy(order)
    expected = F.lag("event_hash", 1, START).over(w)
    own = F.sha2(F.concat("previous_hash", F.coalesce(payload, F.lit(""))), 256)
    checked = df.withColumn("__ok", F.coalesce((F.col("event_hash") == own) & (F.col("previous_hash") == expected), F.lit(False)))
    return checked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("__ok")).alias("broken"), F.max_by("event_hash", order).alias("head"))


def latest_distinct(df: DataFrame, keys: list[str], distinct: list[str], order: str, n: int) -> DataFrame:
    """The newest row of each distinct combination, of these the newest n for each key, oldest first by ``place``."""
    newest = latest(df, [*keys, *distinct], F.desc(order))
    w = W.partitionBy(*keys).orderBy(F.desc(order), *distinct)
    kept = newest.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    return kept.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("__rn")))).drop("__rn")


def ordered_parts(df: DataFrame, order: str) -> DataFrame:
    """``df`` dealt to ranges of ``order`` and sorted, written, with ``__part`` and ``__at`` (consecutive within a part)."""
    parts = df.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    at = F.monotonically_increasing_id()
    return materialize(parts.withColumns({"__part": F.spark_partition_id(), "__at": at.bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")


def offsets(parts: DataFrame, amount: Column) -> DataFrame:
    """Of each part the sum of ``amount`` over the parts before it, ``__before``: one row for each part."""
    sums = parts.groupBy("__part").agg(amount.alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return F.broadcast(sums.select("__part", before.alias("__before")))


def numbered(df: DataFrame, order: str, number: str = "number") -> DataFrame:
    """Rows numbered from 0 in a global order, without all of them in one task; equal values are in any order."""
    parts = ordered_parts(df, order)
    return parts.join(offsets(parts, F.count(F.lit(1))), "__part").withColumn(number, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def round_robin(df: DataFrame, order: str, n: int) -> DataFrame:
    """Assigns rows to n workers in turn, in a global order."""
    return numbered(df, order, "__number").withColumn("worker", (F.col("__number") % n).cast("int")).drop("__number")


def largest_remainder(df: DataFrame, strata: list[str], total: int) -> DataFrame:
    """How many of ``total`` picks each stratum gets: floors, then the largest remainders (ties by stratum)."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))
    share = F.col("size") * F.lit(float(total)) / F.sum("size").over(W.partitionBy())
    parts = sizes.withColumn("__share", share).withColumn("__floor", F.floor("__share").cast("int"))
    left = F.lit(total) - F.sum("__floor").over(W.partitionBy())
    place = F.row_number().over(W.orderBy(F.desc(F.round(F.col("__share") - F.col("__floor"), 9)), *strata))
    return parts.withColumn("allocated", F.col("__floor") + F.when(place <= left, 1).otherwise(0)).select(*strata, "size", "allocated")


def stratified_pick(df: DataFrame, strata: list[str], identifier: str, total: int, seed: str) -> DataFrame:
    """Rows picked for each stratum in the order of a hash."""
    order = F.sha2(F.concat(F.lit(seed + ":"), F.col(identifier).cast("string")), 256)
    w = W.partitionBy(*strata).orderBy(order, identifier)
    ranked = df.withColumn("__rn", F.row_number().over(w)).join(largest_remainder(df, strata, total), strata)
    return ranked.filter(F.col("__rn") <= F.col("allocated")).drop("__rn", "size", "allocated")


def strata_turns(df: DataFrame, strata: list[str], blank: Column, identifier: str, n: int) -> DataFrame:
    """The first n rows when strata take turns, rows that aren't blank first."""
    w = W.partitionBy(*strata, blank).orderBy(identifier)
    return df.withColumns({"__b": blank, "__t": F.row_number().over(w)}).orderBy("__b", "__t", *strata, identifier).limit(n).drop("__b", "__t")


def next_untried(order: list[str], attempted: Column) -> Column:
    """The first of an ordered list that hasn't been attempted, else null."""
    return F.get(F.array_except(F.array(*[F.lit(x) for x in order]), attempted), F.lit(0))
