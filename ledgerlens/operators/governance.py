"""Data governance: leakage between splits, overlaps, manifests, digests, sampling and label logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlens.functions.values import split_of


def split_leakage(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that are in more than one split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits"), F.count(F.lit(1)).alias("n")).filter("splits > 1")


def exact_overlap(candidates: DataFrame, history: DataFrame, digest: str) -> DataFrame:
    """Candidates whose digest occurs in the history."""
    return candidates.join(history.select(digest).distinct(), digest, "left_semi")


def representation_gaps(leaves: DataFrame, rows: DataFrame, leaf: str, source: str, least: int) -> DataFrame:
    """All leaves with fewer than ``least`` distinct sources, those without rows included."""
    counts = rows.groupBy(leaf).agg(F.count_distinct(source).alias("sources"))
    return leaves.join(counts, leaf, "left").withColumn("sources", F.coalesce("sources", F.lit(0))).filter(F.col("sources") < least)


def concentration(df: DataFrame, by: str, source: str, most: float = 0.7, least_rows: int = 20) -> DataFrame:
    """The largest source's share of each group, and whether it is too large for a group of enough rows."""
    counts = df.groupBy(by, source).agg(F.count(F.lit(1)).alias("k"))
    out = counts.groupBy(by).agg(F.sum("k").alias("n"), F.max("k").alias("top"), F.count(F.lit(1)).alias("sources"))
    share = F.col("top") / F.col("n")
    return out.select(by, "n", "sources", F.round(share, 6).alias("top_share"), ((share > most) & (F.col("n") >= least_rows)).alias("concentrated"))


def population_consensus(df: DataFrame, value: str, document: str, anchored: Column, least: int = 3) -> DataFrame:
    """Rows whose value occurs in at least ``least`` documents and is anchored in one of them."""
    good = df.groupBy(value).agg(F.count_distinct(document).alias("documents"), F.bool_or(anchored).alias("anchored")).filter((F.col("documents") >= least) & F.col("anchored"))
    return df.join(good.select(value, "documents"), value)


def split_manifest(df: DataFrame, identifier: str, group: str, seed: str = "17") -> DataFrame:
    """Each split's rows, groups and a digest of its ordered ids; digests of buckets are combined, so no split is one row."""
    rows = df.select(F.col(identifier).cast("string").alias("id"), F.col(group).alias("g")).withColumn("split", split_of(F.col("g"), seed))
    parts = rows.withColumn("part", F.substring(F.sha2("id", 256), 1, 2)).groupBy("split", "part").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")), "\n"), 256).alias("digest"))
    digests = parts.groupBy("split").agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "digest"))), lambda p: p["digest"]), "\n"), 256).alias("digest"))
    return digests.join(rows.groupBy("split").agg(F.count_distinct("g").alias("groups")), "split").select("split", "n", "groups", "digest")


def dataset_mark(df: DataFrame, columns: list[str]) -> DataFrame:
    """A digest of a table that doesn't depend on the order of its rows: a sum of row hashes, with the count."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(row).cast("string").alias("mark"))


def replay_differences(frozen: DataFrame, replayed: DataFrame) -> DataFrame:
    """Rows in one table and not in the other, with their side; duplicates count."""
    return frozen.exceptAll(replayed).withColumn("side", F.lit("frozen")).unionByName(replayed.exceptAll(frozen).withColumn("side", F.lit("replayed")))


def training_rows(df: DataFrame, document: str, field: str, value: str, digest: str, authorised: Column) -> DataFrame:
    """Authorised rows without (document, field) of conflicting values, one for each digest (the smallest document), with a split."""
    rows = df.filter(F.coalesce(authorised, F.lit(False)))
    single = rows.groupBy(document, field).agg(F.count_distinct(value).alias("__v")).filter("__v = 1").drop("__v")
    kept = rows.join(single, [document, field], "left_semi")
    first = F.row_number().over(W.partitionBy(digest).orderBy(document, field, value))
    return kept.withColumn("__rn", first).filter("__rn = 1").drop("__rn").withColumn("split", split_of(F.col(document).cast("string")))


def label_log(events: DataFrame, identifier: str, key: str, value: str, critical: Column, reviewer: str, second: str, order: str) -> DataFrame:
    """Each event's verdict: DUPLICATE id, CONTRADICTS the key's first approved value, NEEDS_SECOND reviewer, or APPROVED."""
    nth = F.row_number().over(W.partitionBy(identifier).orderBy(order))
    first = F.first(value).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    alone = critical & (F.col(second).isNull() | (F.col(second) == F.col(reviewer)))
    verdict = F.when(nth > 1, "DUPLICATE").when(F.col(value) != first, "CONTRADICTS").when(F.coalesce(alone, F.lit(False)), "NEEDS_SECOND").otherwise("APPROVED")
    return events.withColumn("verdict", verdict)


def paired_reviews(reviews: DataFrame, asset: str, reviewer: str, label: str, order: str) -> DataFrame:
    """Each asset's first two reviewers side by side and whether they agree; one review alone is PENDING."""
    ranked = reviews.withColumn("__k", F.row_number().over(W.partitionBy(asset).orderBy(order, reviewer))).filter("__k <= 2")
    out = ranked.groupBy(asset).agg(F.max(F.when(F.col("__k") == 1, F.col(label))).alias("first"), F.max(F.when(F.col("__k") == 2, F.col(label))).alias("second"), F.count(F.lit(1)).alias("__n"))
    state = F.when(F.col("__n") < 2, "PENDING").when(F.col("first") == F.col("second"), "AGREED").otherwise("ADJUDICATE")
    return out.withColumn("state", state).drop("__n")


def passage_leakage(documents: DataFrame, passages: DataFrame, document: str, text: str, passage: str, passage_text: str, words: int = 8) -> DataFrame:
    """Passages whose folded words all occur in order in a document, found by equality on their first ``words`` words.

    Only documents that hold a passage's opening as a run of words are compared with it, as whole folded texts.
    """
    from ledgerlens.functions.text import label_fold

    def opening(hashes: Column, at: Column | int) -> Column:
        """A number for the ``words`` words from a place on, from their hashes; equal words, equal numbers."""
        return reduce(lambda a, b: a.bitwiseXOR(b), [F.shiftleft(F.element_at(hashes, at + k), k) for k in range(words)])

    def runs(split: Column) -> Column:
        """The openings at all places; the inner functions see the words' hashes as a variable, so they are made once."""
        inner = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - words + 1), lambda k: opening(h, k))
        hashes = F.transform(split, lambda w: F.xxhash64(w))
        return F.flatten(F.transform(F.filter(F.array(hashes), lambda h: F.size(h) >= words), inner))

    known = passages.select(F.col(passage).alias("passage"), label_fold(F.col(passage_text)).alias("p")).withColumn("w", F.split("p", " ")).filter(F.size("w") >= words)
    known = known.select("passage", "p", opening(F.transform("w", lambda w: F.xxhash64(w)), F.lit(1)).alias("opening"))
    spelled = documents.select(F.col(document).alias("document"), label_fold(F.col(text)).alias("t"))
    openings = spelled.select("document", F.explode(runs(F.split("t", " "))).alias("opening"))
    met = openings.join(known.select("passage", "opening"), "opening").select("document", "passage").distinct()
    checked = met.join(spelled, "document").join(known.select("passage", "p"), "passage")
    return checked.filter(F.concat(F.lit(" "), "t", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("p"), F.lit(" ")))).select("document", "passage")
