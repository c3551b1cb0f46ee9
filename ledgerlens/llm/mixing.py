"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words: its share by weight of ``share`` times all words, at most ``cap`` times its own
size, the excess reshared by weight among the sources that are below their caps. A document's expected number of
copies is target / source size; its integral part is taken, and the fraction is a probability to round.

Rounding pairs documents of a source. Of two with fractions p and q, mass moves from one to the other, in words, until
one fraction is 0 or 1; the direction is drawn so that both expectations stay. Words of the pair are conserved, so a
source ends within one small document of its target. Pairing goes from large documents to small ones, so the one
left over is small.

Documents are dealt to buckets of about ``bucket_rows`` by (source, hash of id): a source with a third of all rows
has that many more buckets. A bucket is read in order and leaves at most one fraction, which goes up a reduction tree
with ``fan_in`` buckets to a node, until one fraction is left for a source and is rounded by its probability.
Draws are hashes of ids, so reruns agree whatever the partitioning.

Defined results: a null source is a source, last in order; null and empty texts have size 0 and take 0 words; rows
that repeat an id are documents of their own; an empty table gives no rows; further columns are ignored. The table
of sources (one row for each) is ordered in one task, as their order decides the weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ledgerlens.llm.arrow import bound_batches
from ledgerlens.session import materialize, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
BUCKET_ROWS = 4096
FAN_IN = 64
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of bytes other than space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, n_docs, source_size, target: shares by weight with caps, by filling all sources to one level.

    Sources are capped in order of cap / weight; the level is where the rest of the total, shared by weight among the
    sources not yet capped, exceeds none of their caps.
    """
    ordered = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    rows = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    rows = rows.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(cap))
    by_ratio = W.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, W.unboundedFollowing)
    rows = rows.withColumns(
        {
            "total": F.sum("source_size").over(W.partitionBy()) * F.lit(share),
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(onward),
        }
    )
    # The level if this source were the first below its cap; the first for which that holds has the level of all after it.
    rows = rows.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    below = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min_by("level", F.when(below, F.col("cap") / F.col("weight"))).over(W.partitionBy())
    found = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return rows.select("source", "n_docs", "source_size", found.alias("target"))


def draw(*parts: Column) -> Column:
    """A uniform number in [0, 1) from the parts."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _uniform(a: int, b: int) -> float:
    """A draw for a pair, from two integers."""
    x = (a * 0x9E3779B97F4A7C15 ^ b * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return ((x ^ x >> 31) >> 11) / float(1 << 53)


def transfer(p: float, a: int, q: float, b: int, u: float) -> tuple[float, float]:
    """Moves mass between fractions p and q of documents with a and b words until one is integral."""
    up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
    if u * (up + down) < down:
        p, q = (1.0 if up == (1 - p) * a else p + up / a), (0.0 if up == q * b else q - up / b)
    else:
        p, q = (0.0 if down == p * a else p - down / a), (1.0 if down == (1 - q) * b else q + down / b)
    return p, q


def _pivot(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rounds the rows of each (source, bucket), which come in order; the last fraction of a bucket stays open.

    One open document is carried from row to row and over batches; every other row is final.
    """
    held, key = None, None

    def out(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["id", "source", "size", "base", "frac", "bucket", "key", "done"])

    for frame in frames:
        ready = []
        for row in frame[["id", "source", "size", "base", "frac", "bucket", "key"]].itertuples(index=False, name=None):
            row = [*row, True]
            if (at := (row[1] if isinstance(row[1], str) else None, row[5])) != key:
                if held is not None:
                    held[7] = False
                    ready.append(held)
                held, key = None, at
            if row[4] <= 0 or row[2] == 0:
                ready.append(row)
                continue
            if held is None:
                held = row
                continue
            held[4], row[4] = transfer(held[4], held[2], row[4], row[2], _uniform(held[6], row[6]))
            for x in (held, row):
                if x[4] >= 1:
                    x[3], x[4] = x[3] + 1, 0.0
            first, second = held, row
            held = first if first[4] > 0 else second if second[4] > 0 else None
            ready += [x for x in (first, second) if x is not held]
        if ready:
            yield out(ready)
    if held is not None:
        held[7] = False
        yield out([held])


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple = WEIGHTS,
    share: float = SHARE, cap: float = CAP, bucket_rows: int = BUCKET_ROWS, fan_in: int = FAN_IN, seed: int = SEED,
) -> DataFrame:
    """id, source, size, source_size, target and copies (how often the mix takes it) for every row of ``docs``."""
    bound_batches(docs.sparkSession)
    sizes = materialize(docs.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, share, cap), "mix-targets")
    targets = targets.withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.xxhash64(F.lit(seed), "id")
    units = sizes.join(targets, sizes.source.eqNullSafe(targets.of)).select(
        "id", "source", "size", F.floor(rate).alias("base"), (rate - F.floor(rate)).alias("frac"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.ceil(F.col("n_docs") / bucket_rows)).alias("bucket"), key.alias("key"),
    )
    schema = "id string, source string, size long, base long, frac double, bucket long, key long, done boolean"

    def level(rows: DataFrame, label: str) -> DataFrame:
        dealt = rows.repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.desc("size"), "key", "id")
        return materialize(dealt.mapInPandas(_pivot, schema), label)

    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    nodes = math.ceil(largest / bucket_rows)
    done = level(units, "mix-level")
    parts = [done.filter("done")]
    while nodes > 1:
        nodes = math.ceil(nodes / fan_in)
        done = level(done.filter("not done").drop("done").withColumn("bucket", F.floor(F.col("bucket") / fan_in)), "mix-level")
        parts.append(done.filter("done"))
    last = done.filter("not done")
    parts.append(last.withColumn("base", F.col("base") + (draw(F.lit(seed + 2), F.col("key")) < F.col("frac")).cast("long")))
    rounded = parts[0]
    for part in parts[1:]:
        rounded = rounded.unionByName(part)
    return rounded.join(targets, rounded.source.eqNullSafe(targets.of)).select(
        F.col("id").cast(docs.schema[id_col].dataType).alias("id"), "source", "size", "source_size", "target", F.col("base").alias("copies")
    )


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``: words taken of each."""
    return mix_sources(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies"
    )


QUERIES = {"op7_source_mix": op7_source_mix}
ORACLES: dict[str, str] = {}
