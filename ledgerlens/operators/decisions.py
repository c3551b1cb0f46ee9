"""Field and claim decisions as ordered rules over evidence, in expressions; what isn't known is never accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ACCEPTED = ("AUTO_ACCEPTED", "REFERENCE_CONFIRMED", "HUMAN_CONFIRMED")


def ladder(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds; null doesn't hold."""
    out = None
    for name, condition in rules:
        met = F.coalesce(condition, F.lit(False))
        out = F.when(met, name) if out is None else out.when(met, name)
    return out.otherwise(otherwise)


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """The names of all rules that hold, in order, without repeats."""
    return F.array_distinct(F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]), lambda r: r.isNotNull()))


def evidence_bundle(candidates: DataFrame, keys: list[str], value: str, family: str, flags: dict[str, Column]) -> DataFrame:
    """Each key's classes of evidence: E1 candidate, E2 two families agree on a value, and each flag's class, as a sorted array."""
    per = candidates.groupBy(*keys, value).agg(F.count_distinct(family).alias("__f"), *[F.bool_or(F.coalesce(c, F.lit(False))).alias(f"__{k}") for k, c in flags.items()])
    out = per.groupBy(*keys).agg(F.max("__f").alias("families"), *[F.bool_or(f"__{k}").alias(f"__{k}") for k in flags], F.count(F.lit(1)).alias("values"))
    classes = reasons([("E1", F.lit(True)), ("E2", F.col("families") >= 2), *[(k, F.col(f"__{k}")) for k in flags]])
    return out.withColumn("evidence", F.array_sort(classes)).drop(*[f"__{k}" for k in flags])


def field_decision(rows: DataFrame, evidence: str, options: list[list[str]], contradicted: Column, invalid: Column, critical: Column) -> DataFrame:
    """disposition, action and reasons of each field: contradiction and failed checks come before complete evidence."""
    from ledgerlens.operators.claims import closest_option

    best = closest_option(F.col(evidence), options)
    disposition = ladder([("REJECTED", invalid), ("REVIEW", contradicted), ("AUTO_ACCEPTED", best["missing"] == 0)], "REVIEW")
    action = ladder([("NONE", (best["missing"] == 0) & ~contradicted & ~invalid), ("HUMAN", critical | contradicted), ("RETRY", best["missing"] == 1)], "HUMAN")
    why = reasons([("HARD_VALIDATION_FAILED", invalid), ("CONTRADICTION", contradicted), ("EVIDENCE_MISSING", best["missing"] > 0), ("CRITICAL_FIELD", critical & (best["missing"] > 0))])
    return rows.withColumns({"disposition": disposition, "action": action, "reasons": why, "lacking": best["lacking"]})


def claim_decision(fields: DataFrame, claims: DataFrame, claim: str, integrity: dict[str, Column], required: list[str], groups: list[list[str]], policy: Column) -> DataFrame:
    """disposition and blockers of each claim.

    In order: policy mismatch, failed integrity, missing required fields, contradictions, several blockers of one
    dependent group, single blockers, and then straight through, safe if every critical field is accepted completely.
    """
    taken = F.col("disposition").isin(*ACCEPTED)
    blocking = F.coalesce(F.col("blocks"), F.lit(True)) & ~taken
    per = fields.groupBy(claim).agg(
        F.collect_set("field").alias("present"),
        F.array_sort(F.collect_set(F.when(blocking, F.col("field")))).alias("blockers"),
        F.bool_or(F.coalesce("contradicted", F.lit(False))).alias("contradicted"),
        F.bool_and(~F.col("critical") | (taken & F.coalesce("complete", F.lit(False)))).alias("critical_ok"),
        F.count_if("critical").alias("n_critical"),
    )
    rows = claims.join(per, claim, "left")
    none = F.array().cast("array<string>")
    present, blockers = F.coalesce("present", none), F.coalesce("blockers", none)
    missing = F.array_except(F.array(*[F.lit(x) for x in required]), present)
    coordinated = F.exists(F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups]), lambda g: F.size(F.array_intersect(g, blockers)) > 1)
    failed = reasons([(n, ~F.coalesce(c, F.lit(False))) for n, c in integrity.items()])
    disposition = ladder(
        [
            ("CLAIM_REVIEW_REQUIRED", ~F.coalesce(policy, F.lit(False))), ("DOCUMENT_REJECTED", F.size(failed) > 0), ("FIELD_REVIEW_REQUIRED", F.size(missing) > 0),
            ("CLAIM_REVIEW_REQUIRED", F.col("contradicted") | coordinated), ("FIELD_REVIEW_REQUIRED", F.size(blockers) > 0),
            ("STP_SAFE", F.col("critical_ok") & (F.col("n_critical") > 0)),
        ], "STP_STANDARD",
    )
    return rows.select(*claims.columns, disposition.alias("claim_disposition"), F.array_join(F.array_union(missing, blockers), ",").alias("blocking"))


def cheapest_action(available: Column, options: list[tuple[str, list[str], float]]) -> Column:
    """The action whose evidence is wanted, by fewest missing classes, then cost, then name; null if nothing is missing."""
    tries = [F.struct(F.size(F.array_except(F.array(*[F.lit(x) for x in needs]), available)).alias("missing"), F.lit(cost).alias("cost"), F.lit(name).alias("name")) for name, needs, cost in options]
    best = F.array_min(F.filter(F.array(*tries), lambda t: t["missing"] > 0))
    done = F.exists(F.array(*tries), lambda t: t["missing"] == 0)
    return F.when(~done, best["name"])


def dependency(a: Column, b: Column) -> Column:
    """How two pieces of evidence depend on each other by their lineage structs; unknown lineage is never independent."""
    same = lambda c: F.coalesce(a[c] == b[c], F.lit(False))
    unknown = a["source"].isNull() | b["source"].isNull() | a["family"].isNull() | b["family"].isNull()
    return ladder([("UNKNOWN", unknown), ("SAME_CALL", same("call")), ("SAME_FAMILY", same("family")), ("SHARED_SOURCE", same("source"))], "INDEPENDENT")


def transitions(tasks: DataFrame, updates: DataFrame, key: str, version: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Tasks after compare-and-set updates, and the updates that were refused as their version is not the task's."""
    renamed = updates.select(key, F.col(version).alias("__v"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = tasks.join(renamed, (tasks[key] == renamed[key]) & (tasks[version] == F.col("__v")), "left").drop(renamed[key])
    hit = F.col("__v").isNotNull()
    after = joined.withColumns({**{c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in columns}, version: F.col(version) + hit.cast("int")}).select(*tasks.columns)
    refused = updates.join(tasks.select(key, version), [key, version], "left_anti")
    return after, refused


def bundle_class(pages: DataFrame, document: str, page_class: str) -> DataFrame:
    """Each document's class from its pages' classes: the single one, MIXED for several, UNKNOWN for none."""
    known = F.collect_set(F.when(F.col(page_class) != "UNKNOWN", F.col(page_class)))
    out = pages.groupBy(document).agg(known.alias("__c"), F.count(F.lit(1)).alias("pages"))
    return out.select(document, "pages", F.when(F.size("__c") == 0, "UNKNOWN").when(F.size("__c") == 1, F.get("__c", F.lit(0))).otherwise("MIXED").alias("bundle"))


def contradiction_veto(probabilities: DataFrame, key: str, label: str, p: str, most: float = 0.9, margin: float = 0.2) -> DataFrame:
    """Top class, margin over the second and entropy of each key's probabilities; vetoed if neither clear nor confident."""
    out = probabilities.groupBy(key).agg(
        F.max(F.struct(F.col(p).alias("p"), F.col(label).alias("label"))).alias("top"), F.sort_array(F.collect_list(p), asc=False).alias("__ps"),
        F.sum(F.when(F.col(p) > 0, -F.col(p) * F.log(p)).otherwise(0.0)).alias("entropy"),
    )
    gap = F.col("top.p") - F.coalesce(F.get("__ps", F.lit(1)), F.lit(0.0))
    return out.select(key, F.col("top.label").alias(label), F.round("top.p", 6).alias("p"), F.round(gap, 6).alias("margin"), F.round("entropy", 6).alias("entropy"), ((F.col("top.p") < most) & (gap < margin)).alias("vetoed"))


def wrong_crop_risk(signals: dict[str, Column], detect: float = 0.6) -> Column:
    """risk (the largest signal), detected, and the signals that reach the limit."""
    values = {k: F.coalesce(c, F.lit(0.0)) for k, c in signals.items()}
    risk = F.greatest(*values.values()) if len(values) > 1 else next(iter(values.values()))
    return F.struct(F.round(risk, 6).alias("risk"), (risk >= detect).alias("detected"), F.array_join(reasons([(k, v >= detect) for k, v in values.items()]), ",").alias("reasons"))
