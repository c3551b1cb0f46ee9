"""Rule systems over single rows and claims: deterministic evidence, verification, localisation, automation and permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions import values as V
from ledgerlens.functions.similarity import best_run_ratio
from ledgerlens.functions.text import currency, digits, identifier, label_fold, substitute_tokens
from ledgerlens.operators.decisions import ladder, reasons
from ledgerlens.session import small


def deterministic_evidence(field: Column, value: Column, as_of: Column, labels: list[str]) -> Column:
    """evidence and failure of a value by its field's name; the first kind that the name has decides.

    A blank value and one that is a registered label fail whatever the field.
    """
    name, raw = F.lower(field), F.trim(F.coalesce(value, F.lit("")))
    label = identifier(raw).isin([identifier_of(x) for x in labels])
    day = V.any_date(raw)
    amount = currency(raw)
    has = lambda *parts: name.rlike("|".join(parts))
    kinds = [
        (has("npi"), V.valid_npi(digits(raw)), "CHECKSUM_VALID", "CHECKSUM_FAILURE"),
        (has("date", "dob", "statement_period"), day.isNotNull() & (day <= as_of), "DATE_VALID", "INVALID_DATE"),
        (has("cpt", "hcpcs", "procedure_code"), V.valid_procedure(F.regexp_replace(raw, " ", "")), "CODE_SYNTAX_VALID", "INVALID_CODE_SYNTAX"),
        (has("modifier"), V.valid_modifier(raw), "CODE_SYNTAX_VALID", "INVALID_MODIFIER_SYNTAX"),
        (has("diagnos", "icd"), F.forall(F.split(raw, r"\s+"), V.valid_icd10), "CODE_SYNTAX_VALID", "INVALID_ICD10_SYNTAX"),
        (has("charge", "amount", "total"), F.coalesce(amount >= 0, F.lit(False)), "AMOUNT_VALID", "INVALID_AMOUNT"),
        (has("units", "quantity"), F.coalesce(raw.try_cast("double") > 0, F.lit(False)), "UNITS_VALID", "INVALID_UNITS"),
    ]
    good, bad = F.when(raw == "", None).when(label, None), F.when(raw == "", "EMPTY_VALUE").when(label, "LABEL_CONTAMINATION")
    for applies, ok, evidence, failure in kinds:
        ok = F.coalesce(ok, F.lit(False))
        good, bad = good.when(applies, F.when(ok, evidence)), bad.when(applies, F.when(~ok, failure))
    return F.struct(good.otherwise("VALUE_PRESENT").alias("evidence"), bad.otherwise(None).alias("failure"))


def identifier_of(text: str) -> str:
    return "".join(c for c in text.upper() if c.isascii() and c.isalnum())


def verification(field: Column, value: Column, agreement: Column, as_of: Column) -> Column:
    """valid, strength and automatic: a number's checksum with two agreeing readings may be accepted without more."""
    name, raw = F.lower(field), F.trim(F.coalesce(value, F.lit("")))
    npi = V.valid_npi(digits(raw))
    day = V.any_date(raw)
    strength = F.when(raw == "", "NONE").when(name.contains("npi"), F.when(npi, "CHECKSUM").otherwise("NONE")).when(name.rlike("diagnosis|^icd|type_of_bill"), "SYNTAX").when(name.rlike("dob|date|charge|amount"), "SEMANTIC").otherwise("PRESENCE")
    valid = (
        F.when(raw == "", False).when(name.contains("npi"), npi).when(name.rlike("diagnosis|^icd"), V.valid_icd10(raw)).when(name.contains("type_of_bill"), raw.rlike(r"^\d{3,4}$"))
        .when(name.rlike("dob|date"), F.coalesce(day <= as_of, F.lit(False))).when(name.rlike("charge|amount"), F.coalesce(currency(raw) >= 0, F.lit(False))).otherwise(True)
    )
    return F.struct(valid.alias("valid"), strength.alias("strength"), (valid & name.contains("npi") & (agreement >= 2)).alias("automatic"))


def region_outcome(predicted: Column, expected: Column, neighbour: Column, empty: Column, most_excess: float = 4.0) -> Column:
    """How a predicted box holds the expected value's box: shares are of the expected box's area."""
    inside = V.containment(expected, predicted)
    beside = F.coalesce(V.containment(neighbour, predicted), F.lit(0.0))
    excess = V.area(predicted) / F.greatest(F.lit(1.0), V.area(expected))
    return ladder(
        [
            ("EMPTY_REGION", predicted.isNull() | empty), ("WRONG_NEIGHBOR", (beside >= 0.5) & (inside < 0.95)), ("OVER_CROP", (inside >= 0.95) & (excess > most_excess)),
            ("GEOMETRIC_MATCH", (inside >= 0.95) & (V.iou(predicted, expected) >= 0.5)), ("VALUE_CONTAINED", inside >= 0.95), ("UNDER_CROP", inside > 0),
        ], "WRONG_REGION",
    )


#: Lower edges of the confidence buckets; the last one ends at 1.
BUCKETS = (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99)


def confidence_buckets(df: DataFrame, confidence: str, usable: Column, family: str) -> DataFrame:
    """Rows, accuracy and families for each bucket of confidence; less than the first edge is left out."""
    at = None
    for edge in reversed(BUCKETS):
        at = F.when(F.col(confidence) >= edge, edge) if at is None else at.when(F.col(confidence) >= edge, edge)
    rows = df.withColumn("bucket", at).filter("bucket is not null")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(usable.cast("int")), 6).alias("accuracy"), F.array_join(F.array_sort(F.collect_set(family)), ",").alias("families"))


def detection_rates(df: DataFrame, wrong: Column, detected: Column) -> DataFrame:
    """Precision and recall of a detector of wrong rows, 0 without rows."""
    hit = F.count_if(wrong & detected).cast("double")
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(V.ratio(hit, F.count_if(detected)), 6).alias("precision"), F.round(V.ratio(hit, F.count_if(wrong)), 6).alias("recall"))


def straight_through(fields: DataFrame, claim: str, thresholds: dict[str, float]) -> DataFrame:
    """Each claim's score and whether it may go straight through.

    ``fields`` has required, resolved, criticality, confidence, verified and valid. The score is the least of the share
    of required fields resolved, the critical fields' confidences, and these or 1 where verified elsewhere.
    """
    critical = F.col("criticality").isin("C2", "C3")
    limit = F.create_map(*[F.lit(x) for pair in thresholds.items() for x in pair])[F.col("criticality")]
    out = fields.groupBy(claim).agg(
        F.count_if("required").alias("n_required"), F.count_if(F.col("required") & F.col("resolved")).alias("n_resolved"), F.count_if(critical).alias("n_critical"),
        F.coalesce(F.min(F.when(critical, F.col("confidence"))), F.lit(0.0)).alias("least"),
        F.coalesce(F.min(F.when(critical, F.when(F.col("verified"), 1.0).otherwise(F.col("confidence")))), F.lit(0.0)).alias("reference"),
        F.count_if(critical & ~(F.col("resolved") & F.col("valid") & (F.col("confidence") >= limit))).alias("n_failed"),
    )
    complete = F.coalesce(F.try_divide("n_resolved", "n_required"), F.lit(0.0))
    why = reasons([("REQUIRED_FIELD_POLICY_EMPTY", F.col("n_required") == 0), ("REQUIRED_FIELDS_UNRESOLVED", complete < 1), ("CRITICAL_FIELD_POLICY_EMPTY", F.col("n_critical") == 0), ("CRITICAL_FIELD_FAILED", F.col("n_failed") > 0)])
    return out.select(claim, F.round(F.least(complete, "least", "reference"), 6).alias("score"), F.array_join(why, ",").alias("reasons"), (F.size(why) == 0).alias("eligible"))


def automation(review: Column, reference: Column, critical_identity: Column, active: Column, confidence: Column, least: Column, quality: Column, allowed: list[str], evidence: Column) -> Column:
    """What becomes of a reviewed prediction, the first rule that applies."""
    return ladder(
        [
            ("ALREADY_AUTOMATED", ~review), ("BLOCKED_CONTRADICTION", reference == "CONTRADICTION"), ("PROMOTED_REFERENCE_VERIFIED", reference == "VERIFIED"),
            ("BLOCKED_REFERENCE_REQUIRED", critical_identity), ("BLOCKED_HOLDOUT_REQUIRED", ~F.coalesce(active, F.lit(False))), ("BLOCKED_LOW_CONFIDENCE", F.coalesce(confidence, F.lit(0.0)) < least),
            ("BLOCKED_CROP_QUALITY", ~F.coalesce(quality, F.lit("UNKNOWN")).isin(allowed)), ("PROMOTED_ACTIVE_ROUTE", evidence),
        ], "BLOCKED_INSUFFICIENT_EVIDENCE",
    )


def pairwise_agreement(df: DataFrame, document: str, reviewer: str, label: str) -> DataFrame:
    """Pairs of reviewers of one document, and how many agree; counted from labels' sizes, not by spelling out pairs.

    Each reviewer counts once for a document.
    """
    one = df.groupBy(document, reviewer).agg(F.min(label).alias("l"))
    sizes = one.groupBy(document, "l").agg(F.count(F.lit(1)).alias("k"))
    per = sizes.groupBy(document).agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("agree"))
    return per.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), F.sum("agree").cast("long").alias("agree"))


def page_priority(df: DataFrame, document: str, page: str, field: str, critical: Column) -> DataFrame:
    """Pages to review: those with most critical fields first, then most fields; the fields as one text."""
    out = df.groupBy(document, page).agg(F.count_if(critical).alias("critical"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(field)), ",").alias("fields"))
    return out.orderBy(F.desc("critical"), F.desc("n"), document, page)


def permitted(actors: DataFrame, grants: DataFrame, role: str, permission: str) -> DataFrame:
    """Actors whose role has a permission; grants are a small table."""
    return actors.join(small(grants.filter(F.col("permission") == permission).select(role).distinct()), role, "left_semi")


def valid_path(labels: Column, parents: dict[str, str | None]) -> Column:
    """Whether a path of labels leads from a root to a leaf of a tree of classes."""

    def path(leaf: str) -> list[str]:
        out = [leaf]
        while parents[out[0]] is not None:
            out.insert(0, parents[out[0]])
        return out

    leaves = [k for k in parents if k not in parents.values()]
    known = ["/".join(path(leaf)) for leaf in leaves]
    return F.coalesce(F.array_join(labels, "/").isin(known), F.lit(False))


def count_chain(*counts: Column) -> Column:
    """Whether counts don't rise from left to right and none is negative or missing."""
    ok = F.lit(True)
    for a, b in zip(counts, counts[1:], strict=False):
        ok = ok & (b <= a) & (b >= 0)
    return F.coalesce(ok & (counts[0] >= 0), F.lit(False))


def crop_quality(width: Column, height: Column, page_width: Column, page_height: Column, inside: Column) -> Column:
    """The first fault of a crop: EMPTY, TOO_SMALL, TOO_LARGE, OUTSIDE; else OK."""
    share = F.try_divide(width * height, page_width * page_height)
    return ladder([("EMPTY", (width <= 0) | (height <= 0)), ("TOO_SMALL", (width < 8) | (height < 6)), ("TOO_LARGE", share > 0.5), ("OUTSIDE", ~inside)], "OK")


def same_as(value: Column, other: Column) -> Column:
    """A value that says it is the same as another, replaced by that; else itself."""
    return F.when(label_fold(value).isin("same", "same as above", "same as patient", "self"), other).otherwise(value)


def first_amount(*columns: Column) -> Column:
    """The first of several columns that reads as an amount."""
    return F.coalesce(*[currency(c) for c in columns])


#: Readings of words in labels, the shares that runs of words must reach, and what is too short for that.
ROUTING_READINGS = {"patlent": "patient", "diagnos1s": "diagnosis", "biil": "bill", "blll": "bill"}
LONG_PHRASE, LONG_SHARE, SHORT_SHARE, LEAST_PHRASE = 18, 0.82, 0.88, 8


def phrase_match(text: Column, phrase: Column) -> Column:
    """match and score of a phrase in a text, both folded: EXACT, NORMALIZED (after reading words), FUZZY or NONE.

    FUZZY is the best run of as many words, if its share of matching blocks reaches what the phrase's length calls for;
    phrases of one word or fewer than eight characters are never matched so.
    """
    plain = lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " "))
    read = lambda x: F.array_join(substitute_tokens(plain(x), ROUTING_READINGS), " ")
    t, p = read(text), read(phrase)
    fuzzy = p.contains(" ") & (F.length(p) >= LEAST_PHRASE)
    share = F.when(fuzzy, best_run_ratio(t, p)).otherwise(0.0)
    least = F.when(F.length(p) >= LONG_PHRASE, LONG_SHARE).otherwise(SHORT_SHARE)
    found = ladder([("NONE", (t == "") | (p == "")), ("EXACT", plain(text).contains(plain(phrase))), ("NORMALIZED", t.contains(p)), ("FUZZY", fuzzy & (share >= least))], "NONE")
    return F.struct(found.alias("match"), F.when(found.isin("EXACT", "NORMALIZED"), 1.0).otherwise(F.round(share, 6)).alias("score"))


def cross_field(birth: Column, start: Column, end: Column, total: Column, lines: Column) -> Column:
    """The facts that hold between a claim's fields."""
    return reasons([("BIRTH_BEFORE_SERVICE", birth < start), ("DATES_IN_ORDER", start <= end), ("LINES_EQUAL_TOTAL", lines == total)])


def economics(df: DataFrame, by: str, machine: float, review: float) -> DataFrame:
    """Cost of rows by group: machine cost for all, review cost for those reviewed; and cost for each that needed none."""
    reviewed = F.count_if("reviewed")
    cost = F.count(F.lit(1)) * machine + reviewed * review
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), reviewed.alias("reviewed"), F.round(cost, 4).alias("cost"), F.round(V.ratio(cost, F.count(F.lit(1)) - reviewed), 6).alias("cost_of_automated"))
