"""Fixed-width records: specifications, parsing to columns, rendering of columns, and checks of files.

A specification is a record type, a length and fields with start (from 1), length, alignment, padding and data type;
it is small driver metadata, and all work on records is expressions over lines.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlens.operators.ranking import offsets, ordered_parts

from ledgerlens.functions.values import picture_length


@dataclass(frozen=True)
class FieldSpec:
    name: str
    start: int
    length: int
    align: str = "left"
    pad: str = " "
    kind: str = "string"
    required: bool = False
    default: str = ""
    source: str | None = None


@dataclass(frozen=True)
class RecordSpec:
    record_type: str
    length: int
    fields: tuple[FieldSpec, ...] = field(default=())


def load_specs(rows: list[dict]) -> dict[str, RecordSpec]:
    """Specifications by record type from plain mappings, as a YAML or JSON file gives them."""
    out = {}
    for r in rows:
        names = {"field_name": "name", "start_position": "start", "alignment": "align", "padding_character": "pad", "data_type": "kind", "source_field": "source"}
        fields = tuple(FieldSpec(**{names.get(k, k): v for k, v in f.items() if k != "format"}) for f in r["fields"])
        out[r["record_type"]] = RecordSpec(r["record_type"], r["record_length"], fields)
    return out


def spec_issues(spec: RecordSpec) -> list[str]:
    """Gaps, overlaps and fields beyond the record's end, each once, in order of position."""
    found, end = [], 0
    for f in sorted(spec.fields, key=lambda f: (f.start, f.name)):
        if f.start <= end:
            found.append(f"OVERLAP:{f.name}")
        elif f.start > end + 1:
            found.append(f"GAP:{f.name}")
        end = max(end, f.start + f.length - 1)
        if end > spec.length:
            found.append(f"BEYOND:{f.name}")
    if end < spec.length:
        found.append("GAP:END")
    return list(dict.fromkeys(found))


def spec_table_issues(fields: DataFrame) -> DataFrame:
    """The same for specifications as a table (record_type, field, start, length): GAP and OVERLAP rows."""
    w = W.partitionBy("record_type").orderBy("start", "field").rowsBetween(W.unboundedPreceding, -1)
    end = F.coalesce(F.max(F.col("start") + F.col("length") - 1).over(w), F.lit(0))
    kind = F.when(F.col("start") <= end, "OVERLAP").when(F.col("start") > end + 1, "GAP")
    return fields.withColumn("issue", kind).filter("issue is not null").select("record_type", "field", "issue")


def parse(lines: DataFrame, spec: RecordSpec, value: str = "value", trimmed: bool = False, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Records of the right length as columns, and the lines of another length."""
    cut = lambda f: F.substring(value, f.start, f.length)
    columns = [(F.trim(cut(f)) if trimmed else cut(f)).alias(f.name) for f in spec.fields]
    right = F.coalesce(F.length(value) == spec.length, F.lit(False))
    return lines.filter(right).select(*keep, *columns), lines.filter(~right)


def field_text(spec: FieldSpec, value: Column) -> Column:
    """A field's characters before padding: digits for numbers, cents for amounts, eight digits for dates."""
    text = F.coalesce(value.cast("string"), F.lit(spec.default))
    if spec.kind in ("numeric", "date"):
        return F.regexp_replace(text, "[^0-9]", "")
    if spec.kind == "decimal_implied":
        amount = F.regexp_replace(text, "[^0-9.-]", "").try_cast("decimal(20,4)")
        return F.coalesce(F.regexp_replace((amount * 100).cast("decimal(20,0)").cast("string"), "[^0-9]", ""), F.lit(""))
    return text


def place_field(spec: FieldSpec, text: Column) -> Column:
    """A field's text in its width: overlong text is cut, overlong numbers and missing required values fail."""
    placed = (F.lpad if spec.align == "right" else F.rpad)(F.substring(text, 1, spec.length), spec.length, spec.pad)
    if spec.kind in ("numeric", "decimal_implied"):
        placed = F.when(F.length(text) > spec.length, F.raise_error(F.concat(F.lit(f"{spec.name} overflows: "), text))).otherwise(placed)
    if spec.required:
        placed = F.when(text == "", F.raise_error(F.lit(f"{spec.name} is required"))).otherwise(placed)
    return placed


def render_field(spec: FieldSpec, value: Column) -> Column:
    return place_field(spec, field_text(spec, value))


def render(rows: DataFrame, spec: RecordSpec, values: dict[str, Column], batch: dict[str, Column] | None = None) -> DataFrame:
    """One line for each row, fields in order of position; batch values come before the row's own.

    Texts are a projection of their own, so that each is made once though it is tested and placed.
    """
    ordered = sorted(spec.fields, key=lambda f: f.start)
    texts = []
    for f in ordered:
        own = values.get(f.source or f.name, F.lit(f.default))
        texts.append(field_text(f, F.coalesce(batch[f.name], own) if batch and f.name in batch else own).alias(f.name))
    parts, end = [], 0
    for f in ordered:
        if f.start > end + 1:
            parts.append(F.lit(" " * (f.start - end - 1)))
        parts.append(place_field(f, F.col(f.name)))
        end = f.start + f.length - 1
    if end < spec.length:
        parts.append(F.lit(" " * (spec.length - end)))
    return rows.select(*texts).select(F.concat(*parts).alias("value"))


def source_value(value: Column, kind: str) -> Column:
    """A date as yyyyMMdd, an amount as whole cents (cut, not rounded), else text: what records take."""
    if kind == "date":
        return F.date_format(value, "yyyyMMdd")
    return (value * 100).cast("bigint").cast("string") if kind == "amount" else value.cast("string")


def claim_numbers(lines: DataFrame, order: str, start_types: tuple[str, ...] = ("10", "BA0"), value: str = "value", part: str | None = None) -> DataFrame:
    """Lines with the number of the claim they belong to: it rises at each line of a start type (within ``part``, a file).

    Without ``part`` the lines are dealt to ranges of ``order``; numbers run within a range and start where the ranges
    before it end, so no task has all lines.
    """
    starts = F.when(reduce(lambda a, b: a | b, [F.col(value).startswith(t) for t in start_types]), 1).otherwise(0)
    upto = lambda *by: F.sum(starts).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    if part:
        return lines.withColumn("claim_no", upto(part))
    parts = ordered_parts(lines, order)
    joined = parts.withColumn("claim_no", upto("__part")).join(offsets(parts, F.sum(starts)), "__part")
    return joined.withColumn("claim_no", F.col("claim_no") + F.col("__before")).drop("__part", "__at", "__before")


def labels(lines: DataFrame, specs: dict[str, RecordSpec], order: str, value: str = "value", part: str | None = None) -> DataFrame:
    """Every field of every record as a row: claim_no, record_type, field, text; the first matching type counts."""
    kind = F.coalesce(*[F.when(F.col(value).startswith(t), t) for t in sorted(specs, key=len, reverse=True)])
    cells = lambda s: F.array(*[F.struct(F.lit(f.name).alias("field"), F.trim(F.substring(value, f.start, f.length)).alias("text")) for f in s.fields])
    by_type = F.coalesce(*[F.when(F.col("record_type") == t, cells(s)) for t, s in specs.items()])
    numbered = claim_numbers(lines, order, value=value, part=part).withColumn("record_type", kind)
    return numbered.select("claim_no", "record_type", F.explode(by_type).alias("c")).select("claim_no", "record_type", "c.field", "c.text")


def file_structure(lines: DataFrame, specs: dict[str, RecordSpec], expected: dict[str, int] | None = None, value: str = "value") -> DataFrame:
    """Lines of each record type, those of wrong length, and the difference to the expected number; UNKNOWN for no type."""
    kind = F.coalesce(*[F.when(F.col(value).startswith(t), t) for t in sorted(specs, key=len, reverse=True)], F.lit("UNKNOWN"))
    size = F.create_map(*[F.lit(x) for t, s in specs.items() for x in (t, s.length)])
    out = lines.select(kind.alias("record_type"), F.length(value).alias("n")).groupBy("record_type").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.coalesce(F.col("n") != size[F.col("record_type")], F.lit(False))).alias("wrong_length")
    )
    if not expected:
        return out
    wanted = lines.sparkSession.createDataFrame(list(expected.items()), "record_type string, expected long")
    joined = out.join(wanted, "record_type", "full")
    return joined.withColumns({"lines": F.coalesce("lines", F.lit(0)), "wrong_length": F.coalesce("wrong_length", F.lit(0))}).withColumn("difference", F.col("lines") - F.coalesce("expected", F.lit(0)))


def sum_field(lines: DataFrame, spec: RecordSpec, name: str, value: str = "value") -> DataFrame:
    """The sum of a numeric field over the lines of its record type."""
    f = next(x for x in spec.fields if x.name == name)
    digits = F.nullif(F.regexp_replace(F.substring(value, f.start, f.length), "[^0-9]", ""), F.lit(""))
    return lines.filter(F.col(value).startswith(spec.record_type)).agg(F.coalesce(F.sum(digits.cast("bigint")), F.lit(0)).alias("total"))


def legacy_spec(lines: DataFrame, order: str, value: str = "value") -> DataFrame:
    """Field rows of a specification's text: record_type, number, field, picture, length and declared_length, ambiguous if they differ.

    A line ``RECORD XX`` begins a record; field lines are a number, a name, a picture and a length. A repeated page
    section of a record continues it: numbers are unique within a record, the first line counts.
    """
    w = W.partitionBy(F.lit(0)).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    record = F.nullif(F.regexp_extract(value, r"^\s*RECORD\s+(?:TYPE\s+)?([A-Z0-9]{2,3})\b", 1), F.lit(""))
    row = r"^\s*(\d+)\s+([A-Z][A-Z0-9 /-]*?)\s+([X9A](?:\(\d+\))?[X9AV()\d]*)\s+(\d+)\s*$"
    part = lambda k: F.regexp_extract(value, row, k)
    fields = lines.withColumn("record_type", F.last(record, ignorenulls=True).over(w)).filter(F.col(value).rlike(row))
    out = fields.select("record_type", F.col(order).alias("__o"), part(1).cast("int").alias("number"), F.trim(part(2)).alias("field"), part(3).alias("picture"), part(4).cast("int").alias("declared_length"))
    first = W.partitionBy("record_type", "number").orderBy("__o")
    out = out.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").drop("__rn", "__o").withColumn("length", picture_length(F.col("picture")))
    return out.withColumn("ambiguous", F.col("length") != F.col("declared_length"))


def cents(value: Decimal | str) -> int:
    """Whole cents of an amount, cut towards zero."""
    return int(Decimal(value) * 100)
