"""Exact deduplication by skew-safe combining.

Texts are equal when identical after lower-casing A-Z only; a null text counts as empty. Three stages, each
grouping by the full normalised text next to its SHA-256, so that a digest collision never merges two texts:

1. every map task combines its own copies (partial aggregation before the shuffle),
2. groups are merged by (digest, salt), the salt being the map task's number modulo ``salts``: a group holding a
   third of all rows is spread over ``salts`` reducers,
3. the winners of the salts, at most ``salts`` for a text, are combined by digest.

Group facts return to the rows through the digest alone where it stands for one text, and through digest and full
text where several texts share it.

Defined results: empty and null texts form one group; of equal texts the largest id stays; rows that repeat the
largest id are all marked kept; a null id stays only if its whole group has none; an empty table gives no rows;
very long texts are compared whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerlens.session import materialize, table

SALTS = 16


def fold_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes empty. ``lower`` does the same on pure ASCII, and faster."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per row of ``docs``: id, digest, keep_id, group_size. ``digest`` may be weak: contents decide."""
    rows = docs.select(F.col(id_col).alias("id"), fold_ascii(F.col(text_col)).alias("norm")).withColumn("digest", digest(F.col("norm")))
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "norm")
        .agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    texts = salted.repartition("digest").groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    by_digest = materialize(
        texts.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")),
        "exact-groups",
    )
    light = rows.select("id", "digest")
    alone = by_digest.filter("texts = 1").drop("texts")
    found = light.join(alone, "digest").select("id", "digest", "keep_id", "group_size")
    shared = by_digest.filter("texts > 1").select("digest")
    if shared.isEmpty():
        return found
    shared_texts = texts.join(shared, "digest", "left_semi")
    return found.unionByName(
        rows.join(shared, "digest", "left_semi").join(shared_texts, ["digest", "norm"]).select("id", "digest", "keep_id", "group_size")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: one for each text.

    Rows that go are named by id and digest and taken out by an anti join; only where rows repeat both are the
    repeats dropped in a further step.
    """
    groups = materialize(exact_groups(docs, id_col, text_col, salts), "exact-members")
    gone = groups.filter(~F.col("id").eqNullSafe(F.col("keep_id"))).select(F.col("id").alias("__id"), F.col("digest").alias("__of"))
    marked = docs.withColumn("__digest", sha256(fold_ascii(F.col(text_col))))
    stay = marked.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__of")), "left_anti")
    kept = groups.filter(F.col("id").eqNullSafe(F.col("keep_id")))
    if not kept.groupBy("id", "digest").count().filter("count > 1").isEmpty():
        stay = stay.dropDuplicates([id_col, "__digest"])
    return stay.drop("__digest")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of ``documents`` with the row of their group that stays."""
    return exact_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {
    "op6_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
}
