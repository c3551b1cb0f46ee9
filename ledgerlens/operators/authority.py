"""Who and what may decide: references, escalation, routes, review events, closures, localisation scores and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlens.functions.similarity import matching_ratio
from ledgerlens.operators.decisions import ladder

#: Attributes that a verified address must match, states of routes by mode, and the review authority's name.
ADDRESS_ATTRIBUTES = ("po_box", "postal_code", "city", "state")
ROUTE_STATES = {"runtime": ("PRODUCTION_APPROVED",), "evaluation": ("EXPERIMENTAL", "EVALUATION_ONLY", "SHADOW", "PRODUCTION_APPROVED"), "shadow": ("SHADOW",)}
REVIEW_AUTHORITY = "CANONICAL_POST_EVIDENCE_DECISION_V1"


def reference_accepted(member_exact: Column, birth_exact: Column, patient_score: Column, npi_exact: Column, provider_score: Column) -> Column:
    """Whether references settle a critical field: the member's id and birth date with the name, or the provider's number with the name."""
    member = member_exact & birth_exact & (patient_score >= 0.90)
    provider = npi_exact & (provider_score >= 0.85)
    return F.coalesce(member, F.lit(False)) | F.coalesce(provider, F.lit(False))


def address_accepted(authorised: Column, verified: Column, permitted: Column, matched: Column, contradictions: Column, address: Column) -> Column:
    """Whether a verified address needs no review: all attributes match, nothing contradicts and there is an address."""
    needed = F.array(*[F.lit(a) for a in ADDRESS_ATTRIBUTES])
    complete = (F.size(F.array_except(needed, matched)) == 0) & (F.size(contradictions) == 0)
    return F.coalesce(authorised & verified & permitted & complete & address.isNotNull(), F.lit(False))


def escalation(is_table: Column, is_unstructured: Column) -> Column:
    """The order in which methods are tried for a field."""
    steps = [F.lit("ALTERNATE_PREPROCESS_OCR"), F.when(is_table, "TABLE_TRANSFORMER"), F.when(is_unstructured, "LAYOUTLMV3"), F.lit("VLM_FALLBACK"), F.lit("HUMAN_REVIEW")]
    return F.filter(F.array(*steps), lambda s: s.isNotNull())


def next_step(order: Column, attempted: Column, vlm_enabled: Column) -> Column:
    """The first method of an order not tried yet, skipping a disabled VLM; people are asked last."""
    open_ = F.filter(order, lambda m: ~F.array_contains(attempted, m) & ((m != "VLM_FALLBACK") | vlm_enabled))
    return F.coalesce(F.get(open_, F.lit(0)), F.lit("HUMAN_REVIEW"))


def table_parser_eligible(table_heavy: Column, table_found: Column, template_failed: Column, regional_tried: Column) -> Column:
    """Whether the slow table parser may run: unstructured pages full of tables, or tables that all else failed on."""
    return F.coalesce(table_heavy, F.lit(False)) | F.coalesce(table_found & template_failed & regional_tried, F.lit(False))


def routes_for(requests: DataFrame, routes: DataFrame, mode: str, field: str = "field", family: str = "family", place: str = "place") -> DataFrame:
    """Each request with the first route (by place) of its field and family, or of any family, whose state the mode allows; null if none."""
    if mode not in ROUTE_STATES:
        raise ValueError(f"mode must be one of {sorted(ROUTE_STATES)}")
    allowed = routes.filter(F.col("status").isin(*ROUTE_STATES[mode])).select(F.col(field).alias("__field"), F.col(family).alias("__family"), place, "route_id")
    wanted = requests.select(field, family).distinct()
    met = wanted.join(allowed, (F.col(field) == F.col("__field")) & F.col("__family").isin(F.col(family), F.lit("*")))
    best = met.groupBy(field, family).agg(F.min_by("route_id", place).alias("route_id"))
    return requests.join(best, [field, family], "left")


def review_events(decisions: DataFrame, document: str, field: str, policy: str, blocks: Column) -> tuple[DataFrame, DataFrame]:
    """Review events of decisions under a policy's version, with an id that is the same whenever they are made; and those refused for want of one.

    The id is a digest of document, field and version in a namespace.
    """
    known = F.coalesce(F.trim(policy) != "", F.lit(False))
    name = F.concat_ws(":", F.lit(REVIEW_AUTHORITY), F.col(document).cast("string"), F.col(field).cast("string"), F.col(policy))
    impact = F.when(blocks, "BLOCKS_CLAIM").otherwise("NONBLOCKING_REVIEW")
    made = decisions.filter(known).withColumns({"authority": F.lit(REVIEW_AUTHORITY), "authorization_id": F.sha2(name, 256), "impact": impact})
    return made, decisions.filter(~known).withColumn("error", F.lit("REQUIRES_EVIDENCE_DECISION"))


def closures(tasks: DataFrame, submissions: DataFrame, approvals: DataFrame, task: str, at: str) -> DataFrame:
    """Each task's state after its first valid correction and the first later approval by someone else.

    A correction must have letters, blanks, hyphens, dots and apostrophes only. Approvals before it, or by the one who
    corrected, count for nothing. OPEN, PENDING_SECOND_APPROVAL or VERIFIED_BY_HUMAN.
    """
    value = F.trim("correction")
    good = submissions.filter(value.rlike(r"^[\p{L} '.-]+$")).groupBy(task).agg(F.min_by(F.struct(value.alias("correction"), F.col("reviewer"), F.col(at).alias("since")), F.struct(at, value, "reviewer")).alias("s"))
    joined = approvals.join(good, task).filter((F.col(at) > F.col("s.since")) & (F.col("approver") != F.col("s.reviewer")))
    second = joined.groupBy(task).agg(F.min_by("approver", F.struct(at, "approver")).alias("approved_by"))
    out = tasks.join(good, task, "left").join(second, task, "left")
    state = F.when(F.col("s").isNull(), "OPEN").when(F.col("approved_by").isNull(), "PENDING_SECOND_APPROVAL").otherwise("VERIFIED_BY_HUMAN")
    return out.select(tasks.columns + [F.col("s.correction").alias("correction"), F.col("s.reviewer").alias("reviewer"), "approved_by", state.alias("state")])


def localisation_score(weights: dict[str, float], **signals: Column) -> Column:
    """The mean of the signals that are known, weighted by the field's weights, at most 1; 0 where none has weight."""
    known = [(F.when(s.isNotNull(), weights.get(k, 0.0)).otherwise(0.0), F.coalesce(s, F.lit(0.0)) * weights.get(k, 0.0)) for k, s in signals.items()]
    total, value = sum((a for a, _ in known), F.lit(0.0)), sum((b for _, b in known), F.lit(0.0))
    return F.when(total > 0, F.least(F.lit(1.0), value / total)).otherwise(0.0)


def extraction_failure(outcome: Column, raw: Column, selected: Column, expected: Column, normalised: Column, has_candidate: Column, has_span: Column) -> Column:
    """What went wrong between a region and a value, the first that applies; likeness tells a misread character from a word."""
    wrong = F.coalesce(selected != expected, expected.isNotNull())
    likeness = matching_ratio(F.coalesce(F.nullif(selected, F.lit("")), raw), expected)
    return ladder(
        [
            ("LOCALIZATION_WRONG", outcome.isin("WRONG_NEIGHBOR", "WRONG_REGION", "EMPTY_REGION")), ("UNDER_CROP", outcome == "UNDER_CROP"), ("OCR_EMPTY", F.trim(F.coalesce(raw, F.lit(""))) == ""),
            ("CANDIDATE_RANKING_ERROR", has_candidate & wrong), ("SPAN_SELECTION_ERROR", has_span & wrong), ("NORMALIZATION_ERROR", (normalised == expected) & wrong), ("OCR_CHARACTER_ERROR", likeness >= 0.70),
        ],
        "OCR_WORD_ERROR",
    )


def coordinated(blocked: Column, groups: list[list[str]]) -> Column:
    """Whether several fields of one group of dependent fields are blocked."""
    return F.exists(F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups]), lambda g: F.size(F.array_intersect(g, blocked)) > 1)


def manifest_issues(manifest: DataFrame, files: DataFrame, status: str, path: str = "path", digest: str = "digest") -> DataFrame:
    """Entries of a release's manifest that don't hold: NOT_FROZEN, MISSING or CHANGED."""
    found = files.select(path, F.col(digest).alias("__now"))
    issue = F.when(F.lit(status) != "FROZEN", "NOT_FROZEN").when(F.col("__now").isNull(), "MISSING").when(F.col("__now") != F.col(digest), "CHANGED")
    return manifest.join(found, path, "left").withColumn("issue", issue).filter("issue is not null").select(path, "issue")


def retried(attempts: DataFrame, keys: list[str], place: str, confidence: str, text: str, original: str) -> DataFrame:
    """Each field's best attempt that is surer than what it had, the first of equals (of one place the largest text); not improved where none is."""
    better = F.col(confidence) > F.col(original)
    out = attempts.groupBy(*keys).agg(F.max_by(F.struct(text, confidence, place), F.when(better & (F.coalesce(text, F.lit("")) != ""), F.struct(confidence, -F.col(place), text))).alias("b"), F.count(F.lit(1)).alias("attempts"), F.bool_or(better & (F.coalesce(text, F.lit("")) != "")).alias("improved"))
    return out.select(*keys, "attempts", "improved", *[F.when(F.col("improved"), F.col(f"b.{c}")).alias(c) for c in (text, confidence, place)])


def page_winners(df: DataFrame, keys: list[str], page: str, value: str, score: str, least: float) -> DataFrame:
    """The best value of each page, then the best page of each key with its margin over the next page; too small a margin is AMBIGUOUS."""
    pages = df.groupBy(*keys, page).agg(F.max(F.struct(F.col(score).alias("s"), F.col(value).alias("v"))).alias("b"))
    w = W.partitionBy(*keys).orderBy(F.desc("b.s"), F.asc(page))
    ranked = pages.withColumns({"__rn": F.row_number().over(w), "margin": F.round(F.col("b.s") - F.coalesce(F.lead("b.s").over(w), F.lit(0.0)), 6)}).filter("__rn = 1")
    return ranked.select(*keys, page, F.col("b.v").alias(value), F.col("b.s").alias(score), "margin", F.when(F.col("margin") >= least, "CHOSEN").otherwise("AMBIGUOUS").alias("verdict"))
