"""Reconciliation of candidates for one field: weighted evidence of a page, calibrated cascades, Platt fits and what went wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: The weights of a page's candidates, and the score and margin that a choice needs.
FAMILY_STEP, FAMILY_MOST, CONSENSUS, SUPPORT = 0.2, 0.6, 0.2, 0.15
VALIDATED, LINEAGE, MARK, PAGE_TOKEN = 0.25, 0.10, 0.20, 0.10
LEAST_SCORE, LEAST_MARGIN = 0.45, 0.08
#: The weights of a cascade's candidates and the score that one needs.
CALIBRATED, AGREEMENT, REFERENCE, ALIGNMENT, CASCADE_SCORE = 0.55, 0.2, 0.15, 0.1, 0.8


def same_page(df: DataFrame, keys: list[str], value: str, family: str, signals: dict[str, Column]) -> DataFrame:
    """The best value of each key by its evidence, with score, margin over the next, and verdict.

    ``signals`` has conditions VALIDATED, LINEAGE, MARK and PAGE_TOKEN of a candidate; one candidate is enough for its
    value. Values are compared in upper case without outer blanks. SELECTED, LOW_SCORE, AMBIGUOUS (the next is within the margin; the
    choice is withheld) or NO_VALID_VALUE for keys without a value.
    """
    weights = {"VALIDATED": VALIDATED, "LINEAGE": LINEAGE, "MARK": MARK, "PAGE_TOKEN": PAGE_TOKEN}
    rows = df.withColumns({"__v": F.nullif(F.upper(F.trim(value)), F.lit("")), **{f"__{k}": F.coalesce(signals.get(k, F.lit(False)), F.lit(False)) for k in weights}})
    valid = F.col("__v").isNotNull()
    totals = rows.groupBy(*keys).agg(F.count_distinct(F.when(valid, F.col(family))).alias("__families"), F.count_if(valid).alias("__rows"))
    groups = rows.filter(valid).groupBy(*keys, "__v").agg(F.count_distinct(family).alias("families"), F.count(F.lit(1)).alias("support"), *[F.bool_or(f"__{k}").alias(f"__{k}") for k in weights])
    joined = totals.join(groups, keys, "left")
    score = F.least(F.lit(FAMILY_MOST), F.col("families") * FAMILY_STEP) + F.col("families") / F.greatest(F.col("__families"), F.lit(1)) * CONSENSUS + F.col("support") / F.greatest(F.col("__rows"), F.lit(1)) * SUPPORT
    for k, weight in weights.items():
        score = score + F.when(F.col(f"__{k}"), weight).otherwise(0.0)
    ranked = joined.withColumn("score", F.round(F.least(F.lit(1.0), score), 6))
    w = W.partitionBy(*keys).orderBy(F.desc("score"), F.desc("support"), F.asc("__v"))
    top = ranked.withColumns({"__rn": F.row_number().over(w), "__next": F.lead("score").over(w)}).filter("__rn = 1")
    margin = F.round(F.col("score") - F.coalesce("__next", F.lit(0.0)), 6)
    verdict = F.when(F.col("__v").isNull(), "NO_VALID_VALUE").when(F.col("__next").isNotNull() & (margin < LEAST_MARGIN), "AMBIGUOUS").when(F.col("score") < LEAST_SCORE, "LOW_SCORE").otherwise("SELECTED")
    return top.select(*keys, F.when(verdict == "SELECTED", F.col("__v")).alias("value"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce(margin, F.lit(0.0)).alias("margin"), verdict.alias("verdict"))


def logistic(probability: Column, slope: Column | float = 1.0, intercept: Column | float = 0.0) -> Column:
    """A probability moved along its log-odds; 0 and 1 count as a millionth from them."""
    slope, intercept = (x if isinstance(x, Column) else F.lit(x) for x in (slope, intercept))
    p = F.least(F.greatest(probability, F.lit(1e-6)), F.lit(1 - 1e-6))
    return 1 / (1 + F.exp(-(slope * F.log(p / (1 - p)) + intercept)))


def cascade(
    df: DataFrame, keys: list[str], identifier: str, value: str, family: str, confidence: Column, valid: Column, reference: Column, alignment: Column, critical: Column
) -> DataFrame:
    """Each key's best valid candidate by calibrated confidence, agreement of families, reference and alignment.

    VALIDATED, or REVIEW with a reason: no candidate is valid, the score is too low, or a critical field has neither two
    families nor the reference. ``reference`` and ``critical`` are the same for all rows of a key; ties go to the smallest identifier, then the largest value.
    """
    rows = df.withColumns({"__ok": F.coalesce(valid & (F.trim(value) != ""), F.lit(False)), "__c": confidence, "__r": F.coalesce(F.col(value) == reference, F.lit(False)), "__a": alignment, "__k": F.coalesce(critical, F.lit(False))})
    agree = rows.groupBy(*keys, value).agg(F.count_distinct(family).alias("__n"), F.count_distinct(F.when(F.col("__ok"), F.col(family))).alias("__m"))
    rows = rows.join(agree, [*keys, value], "left")
    score = F.col("__c") * CALIBRATED + F.least(F.col("__n") / 2, F.lit(1.0)) * AGREEMENT + F.col("__r").cast("int") * REFERENCE + F.greatest(F.least(F.col("__a"), F.lit(1.0)), F.lit(0.0)) * ALIGNMENT
    best = F.max_by(F.struct(value, F.col("__s").alias("score"), "__m", "__r"), F.when(F.col("__ok"), F.struct("__s", -F.col(identifier), value)))
    out = rows.withColumn("__s", F.round(score, 6)).groupBy(*keys).agg(best.alias("b"), F.bool_or("__k").alias("__k"), F.bool_or("__ok").alias("__any"))
    enough = (F.col("b.__m") >= 2) | F.col("b.__r")
    reason = F.when(~F.col("__any"), "NO_VALID_CANDIDATE").when(F.col("b.score") < CASCADE_SCORE, "LOW_SCORE").when(F.col("__k") & ~enough, "CRITICAL_NEEDS_TWO").otherwise("NONE")
    return out.select(*keys, F.when(F.col("__any"), F.col(f"b.{value}")).alias(value), F.when(F.col("__any"), F.col("b.score")).alias("score"), reason.alias("reason"), F.when(reason == "NONE", "VALIDATED").otherwise("REVIEW").alias("disposition"))


def selection_failure(correct: Column, selected: Column, ambiguous: Column) -> Column:
    """Why the right candidate wasn't chosen; both are structs of validation, consensus and score, null where there is none."""
    return (
        F.when(correct.isNull(), "FILTERED").when(selected.isNull(), "TIE_BREAK").when(correct["validation"] > selected["validation"], "VALIDATION_DOMINANCE")
        .when(correct["consensus"] > selected["consensus"], "CONSENSUS_NOT_REWARDED").when(ambiguous | (correct["score"] == selected["score"]), "TIE_BREAK").otherwise("MISCALIBRATED")
    )


def fit_platt(df: DataFrame, keys: list[str], score: str, label: str, iterations: int = 3000, rate: float = 0.08, ridge: float = 1e-3, steps: int = 1000) -> DataFrame:
    """slope and intercept of a logistic curve for each key, by gradient descent on the mean loss with a ridge on the slope.

    Scores are grouped to 1 / ``steps`` first, with the counts of each, so that a key's rows become at most as many
    values as its range has steps; the descent runs on them as one expression over arrays, without Python.
    """
    value = F.round(F.col(score) * steps) / steps
    grouped = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, value.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("k"))
    per = grouped.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("s"), F.col("n").cast("double").alias("n"), F.col("k")))).alias("p"), F.sum("n").cast("double").alias("n"), F.sum("k").alias("k"), F.sum(F.col("s") * F.col("n")).alias("t"))
    share = F.least(F.greatest(F.col("k") / F.col("n"), F.lit(1e-6)), F.lit(1 - 1e-6))
    begin = F.struct(F.lit(1.0).alias("a"), (F.log(share / (1 - share)) - F.col("t") / F.col("n")).alias("b"))

    def descend(at: Column, _: Column) -> Column:
        def add(total: Column, point: Column) -> Column:
            z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), at["a"] * point["s"] + at["b"]))
            off = point["n"] / (1 + F.exp(-z)) - point["k"]
            return F.struct((total["a"] + off * point["s"]).alias("a"), (total["b"] + off).alias("b"))

        g = F.aggregate("p", F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), add)
        return F.struct((at["a"] - rate * (g["a"] / F.col("n") + ridge * at["a"])).alias("a"), (at["b"] - rate * g["b"] / F.col("n")).alias("b"))

    fitted = per.withColumn("f", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), begin, descend))
    return fitted.select(*keys, F.col("n").cast("long").alias("n"), F.round("f.a", 6).alias("slope"), F.round("f.b", 6).alias("intercept"))
