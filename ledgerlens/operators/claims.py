"""Claim operators: reconciliation of lines with totals, validation rules, blockers and what would unlock claims.

``claims`` has claim_id and total, ``lines`` claim_id and charge. Amounts are decimals; sums are exact. A check that
can't be made because a value is missing fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.values import age_ok, within_days


def line_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("claim_id").agg(F.sum("charge").alias("line_total"), F.count(F.lit(1)).alias("n_lines"), F.min("service_date").alias("first_service"), F.max("service_date").alias("last_service"))


def reconcile(claims: DataFrame, lines: DataFrame, absolute: str = "0.01", relative: float = 0.0) -> DataFrame:
    """Claims with their lines' total, whether it is exact to the cent and whether it is within tolerance."""
    joined = claims.join(line_totals(lines), "claim_id", "left")
    total, found = F.col("total"), F.coalesce("line_total", F.lit(0).cast("decimal(18,2)"))
    gap = F.abs(total - found)
    allowed = F.greatest(F.lit(absolute).cast("double"), F.greatest(F.abs(total), F.abs(found), F.lit(1).cast("decimal(18,2)")).cast("double") * relative)
    return joined.withColumns(
        {
            "line_total": found,
            "exact": F.coalesce(gap == 0, F.lit(False)),
            "within": F.coalesce(gap.cast("double") <= allowed, F.lit(False)),
        }
    )


def line_coherence(lines: DataFrame, price: str, units: str, net: str, tolerance: float = 0.01) -> DataFrame:
    """Whether units times price is each line's amount, within tolerance."""
    off = F.abs(F.col(price) * F.col(units) - F.col(net))
    return lines.withColumn("coherent", F.coalesce(off <= tolerance, F.lit(False)))


def date_checks(claims: DataFrame, received: str, first: str, last: str, birth: str | None = None, days: int = 365) -> DataFrame:
    """Range order, not before receipt's window, and age at service where a birth date is known."""
    checks = {
        "range_ok": F.coalesce(F.col(first) <= F.col(last), F.lit(False)),
        "timely": within_days(F.col(received), F.col(last), days),
    }
    if birth:
        checks["age_ok"] = age_ok(F.col(birth), F.col(first))
    return claims.withColumns(checks)


def identity_consistency(rows: DataFrame, claim: str, value: Column) -> DataFrame:
    """For each claim: occurrences and distinct values of an identity; consistent with two or more that are all equal."""
    named = rows.select(F.col(claim), F.nullif(value, F.lit("")).alias("v"))
    out = named.groupBy(claim).agg(F.count("v").alias("occurrences"), F.count_distinct("v").alias("distinct_values"))
    return out.withColumn("consistent", (F.col("occurrences") >= 2) & (F.col("distinct_values") == 1))


def violations(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks; null breaks it. One pass: no union of scans."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda r: r.isNotNull())
    return rows.select(*keys, F.explode(broken).alias("rule"))


def missing_fields(required: DataFrame, fields: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Required (keys) without a value that isn't blank."""
    return required.join(fields.filter(F.trim(F.coalesce(value, F.lit(""))) != "").select(*keys), keys, "left_anti")


def blocking(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with ``blockers``, the sorted names of the rules they break; null breaks a rule. No shuffle: rules are of one row."""
    broken = F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in sorted(rules.items())])
    return rows.withColumn("blockers", F.filter(broken, lambda r: r.isNotNull()))


def blockers(found: DataFrame, claims: DataFrame, claim: str, reason: str) -> DataFrame:
    """All claims with the sorted distinct reasons that block them, where reasons come from several rows of a claim."""
    sets = found.groupBy(claim).agg(F.array_sort(F.collect_set(reason)).alias("blockers"))
    return claims.select(claim).join(sets, claim, "left").withColumn("blockers", F.coalesce("blockers", F.array().cast("array<string>")))


def blocker_pareto(blocked: DataFrame) -> DataFrame:
    """For each reason: claims it blocks, claims it alone blocks, their share of all, and how many others come with it."""
    n = blocked.agg(F.count(F.lit(1)).alias("claims"))
    each = blocked.select(F.explode("blockers").alias("reason"), F.size("blockers").alias("k"))
    out = each.groupBy("reason").agg(F.count(F.lit(1)).alias("claims_blocked"), F.count_if(F.col("k") == 1).alias("unlocked_alone"), F.avg(F.col("k") - 1).alias("others"))
    return out.crossJoin(n).select("reason", "claims_blocked", "unlocked_alone", F.round(F.col("unlocked_alone") / F.col("claims"), 6).alias("gain"), F.round("others", 6).alias("others"))


def blocker_sets(blocked: DataFrame) -> DataFrame:
    return blocked.groupBy(F.array_join("blockers", "+").alias("blocker_set")).agg(F.count(F.lit(1)).alias("claims"))


def closest_option(available: Column, options: list[list[str]]) -> Column:
    """Of alternative sets of evidence the one that lacks least: missing (how many), size and lacking."""
    tried = [F.array_sort(F.array_except(F.array(*[F.lit(x) for x in o]), available)) for o in options]
    return F.array_min(F.array(*[F.struct(F.size(m).alias("missing"), F.lit(len(o)).alias("size"), m.alias("lacking")) for o, m in zip(options, tried, strict=True)]))


def satisfiable(available: Column, options: list[list[str]]) -> Column:
    """Whether some option is a subset of what is available."""
    return closest_option(available, options)["missing"] == 0


def counterfactual(rows: DataFrame, claim: str, available: Column, options: list[list[str]], added: list[str]) -> DataFrame:
    """For each class that could be added: claims of which all, and of which any blocked field would be complete."""
    tries = [F.struct(F.lit(a).alias("added"), satisfiable(F.array_union(available, F.array(F.lit(a))), options).alias("ok")) for a in added]
    long = rows.select(F.col(claim).alias("claim_id"), F.explode(F.array(*tries)).alias("t")).select("claim_id", "t.*")
    per = long.groupBy("added", "claim_id").agg(F.bool_and("ok").alias("all_ok"), F.bool_or("ok").alias("any_ok"))
    return per.groupBy("added").agg(F.count_if("all_ok").alias("claims_all"), F.count_if("any_ok").alias("claims_any"), F.count(F.lit(1)).alias("claims"))


def fallback_lookup(rows: DataFrame, rules: DataFrame, first: str, second: str, value: str, default: float) -> DataFrame:
    """``value`` by (first, second), (first, *), (*, second), (*, *), else the default; rules are few and unique."""
    out = rows
    levels = [(first, second), (first, None), (None, second), (None, None)]
    for k, (a, b) in enumerate(levels):
        side = rules.filter((F.col(first) == "*" if a is None else F.col(first) != "*") & (F.col(second) == "*" if b is None else F.col(second) != "*"))
        side = side.select(*[F.col(c) for c in (a, b) if c], F.col(value).alias(f"__{k}"))
        keys = [c for c in (a, b) if c]
        out = out.join(side, keys, "left") if keys else out.join(side, F.lit(True), "left")
    picked = F.coalesce(*[F.col(f"__{k}") for k in range(4)], F.lit(default))
    return out.withColumn(value, picked).drop(*[f"__{k}" for k in range(4)])


def status_report(rows: DataFrame, claim: str, status: str, item: Column, failed: str = "INVALID") -> DataFrame:
    """For each claim: rows, those of each kind and the failing items in order."""
    bad = F.col(status) == failed
    return rows.groupBy(claim).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("n_failed"), F.array_join(F.array_sort(F.collect_list(F.when(bad, item))), ",").alias("failures")
    )
