"""Qualification of assets and claims: gates over counts, parity of runs, finalisation, routes, locations and token fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.text import contains_tokens
from ledgerlens.functions.values import ratio
from ledgerlens.operators.decisions import ladder, reasons
from ledgerlens.session import small


def qualify(assets: DataFrame, rules: dict[str, Column], review: list[str]) -> DataFrame:
    """state and reasons of each asset: REVIEW if only reasons of ``review`` hold, EXCLUDED for any other, else QUALIFIED."""
    found = reasons(list(rules.items()))
    hard = F.array_except(found, F.array(*[F.lit(r) for r in review]))
    state = F.when(F.size(hard) > 0, "EXCLUDED").when(F.size(found) > 0, "REVIEW").otherwise("QUALIFIED")
    return assets.withColumns({"state": state, "reasons": F.array_join(found, ",")})


def attestations(rows: DataFrame, source: str, attested: Column, least_share: float = 0.5) -> DataFrame:
    """Each source's rows and share attested: ATTESTED, PARTIAL or MISSING."""
    out = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(attested, F.lit(False))).alias("k"))
    share = ratio(F.col("k"), F.col("n"))
    return out.select(source, "n", F.round(share, 6).alias("share"), F.when(share >= least_share, "ATTESTED").when(F.col("k") > 0, "PARTIAL").otherwise("MISSING").alias("state"))


def corpus_gate(assets: DataFrame, state: str, source: str, leaf: str, least: dict[str, int]) -> DataFrame:
    """Counts of the qualified assets and the minimums they don't reach."""
    good = assets.filter(F.col(state) == "QUALIFIED")
    counts = good.agg(F.count(F.lit(1)).alias("assets"), F.count_distinct(source).alias("sources"), F.count_distinct(leaf).alias("classes"))
    failed = reasons([(f"FEW_{k.upper()}", F.col(k) < n) for k, n in least.items()])
    return counts.select("*", F.array_join(failed, ",").alias("blockers"), (F.size(failed) == 0).alias("passed"))


def parity(production: DataFrame, shadow: DataFrame, key: str, value: str) -> DataFrame:
    """How two runs' decisions compare: SAME, CHANGED, or only in one of them."""
    a = production.select(key, F.col(value).alias("__a"), F.lit(True).alias("__in_a"))
    b = shadow.select(key, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    joined = a.join(b, key, "full")
    kind = ladder([("ONLY_SHADOW", F.col("__in_a").isNull()), ("ONLY_PRODUCTION", F.col("__in_b").isNull()), ("SAME", F.col("__a").eqNullSafe(F.col("__b")))], "CHANGED")
    return joined.select(key, kind.alias("parity"))


def finalise(claims: DataFrame, stored: str, recomputed: Column) -> tuple[DataFrame, DataFrame]:
    """Claims whose stored decision is what recomputing gives, and those that are held back."""
    ok = F.col(stored).eqNullSafe(recomputed)
    return claims.filter(ok), claims.filter(~ok)


def can_finalise(fields: DataFrame, claim: str, disposition: str, critical: Column, accepted: tuple[str, ...]) -> DataFrame:
    """Claims whose critical fields are all accepted; a claim without critical fields isn't final."""
    taken = F.coalesce(F.col(disposition).isin(*accepted), F.lit(False))
    return fields.groupBy(claim).agg((F.bool_and(~critical | taken) & F.bool_or(critical)).alias("final"))


def weekly(rows: DataFrame, day: str, event: Column) -> DataFrame:
    """Rows and rate of an event for each ISO week."""
    week = F.date_format(F.date_trunc("week", day), "yyyy-MM-dd")
    return rows.groupBy(week.alias("week")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.coalesce(event, F.lit(False)).cast("int")), 6).alias("rate"))


def assemble_path(levels: list[tuple[Column, Column]], least: float) -> Column:
    """The labels of a hierarchy from the top as far as each level's confidence reaches ``least``; then abstention."""
    going, out = F.lit(True), []
    for label, confidence in levels:
        going = going & F.coalesce(confidence >= least, F.lit(False))
        out.append(F.when(going, label))
    return F.array_join(F.filter(F.array(*out), lambda x: x.isNotNull()), "/")


def locate(tokens: DataFrame, anchors: DataFrame, right: float = 400.0, below: float = 40.0) -> DataFrame:
    """The best token for each field of a page: right of its anchor on one line, or below it; nearer is better.

    ``anchors`` (field, alias) is small. The anchor is the first token that is an alias of the field.
    """
    found = tokens.join(small(anchors), contains_tokens(F.col("text"), F.col("alias")))
    first = found.groupBy("page_id", "field").agg(F.min(F.struct("y0", "x0", "x1", "y1")).alias("a"))
    pairs = first.join(tokens, "page_id")
    dx, dy = F.col("x0") - F.col("a.x1"), F.col("y0") - F.col("a.y0")
    beside = (F.abs(dy) < 1) & (dx >= 0) & (dx <= right)
    under = (dy > 0) & (dy <= below) & (F.abs(F.col("x0") - F.col("a.x0")) <= 30)
    score = F.when(beside, 1 - dx / right).when(under, 0.8 * (1 - dy / below))
    best = pairs.withColumn("score", F.round(score, 6)).filter("score is not null").groupBy("page_id", "field").agg(F.max(F.struct("score", -F.col("x0"), "text")).alias("b"))
    return best.select("page_id", "field", F.col("b.text").alias("text"), F.col("b.score").alias("score"))


def fuse_tokens(readings: DataFrame, keys: list[str], controlled: list[str]) -> DataFrame:
    """One text for each key from readings (keys, family, text, confidence), or null where none can be made of them.

    Readings of two families with as many words each are a pair; the pair of least edit distance counts, then that of
    most confidence. Word by word, a controlled term wins over a word one letter off, the surer reading's word over one
    at most two letters off; a word that differs more leaves the key without text. A key has a few readings, so pairs
    are made by a join.
    """
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    rows = readings.select(*keys, "family", words.alias("words"), F.coalesce("confidence", F.lit(0.0)).alias("sure")).filter(F.size("words") > 0)
    other = rows.select(*keys, F.col("family").alias("family2"), F.col("words").alias("words2"), F.col("sure").alias("sure2"))
    surer = (F.col("sure") > F.col("sure2")) | (F.col("sure") == F.col("sure2")) & (F.col("family") < F.col("family2"))
    apart = F.zip_with("words", "words2", lambda x, y: F.levenshtein(F.lower(x), F.lower(y)))
    pairs = rows.join(other, keys).filter((F.col("family") != F.col("family2")) & (F.size("words") == F.size("words2")) & surer)
    distance = F.aggregate(apart, F.lit(0), lambda a, d: a + d)
    rank = F.struct(distance, -(F.col("sure") + F.col("sure2")), "family", "family2", "words", "words2")
    best = pairs.groupBy(*keys).agg(F.min_by(F.struct("words", "words2"), rank).alias("p"))
    term = lambda w: F.lower(w).isin([t.lower() for t in controlled])

    def choose(x: Column, y: Column) -> Column:
        d = F.levenshtein(F.lower(x), F.lower(y))
        return F.when((d == 1) & ~term(x) & term(y), y).when(d <= 2, x)

    chosen = F.zip_with("p.words", "p.words2", choose)
    text = F.when(~F.exists(chosen, lambda w: w.isNull()), F.array_join(chosen, " "))
    return readings.select(*keys).distinct().join(best.select(*keys, text.alias("text")), keys, "left")
