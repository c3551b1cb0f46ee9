"""Column functions on literal values."""

from __future__ import annotations

import math
import uuid
from datetime import date
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import similarity as S, text as X, values as V


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return frame.select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("fold", "value", "expected"),
    [
        (X.collapse_spaces, "  Jane   Doe ", "Jane Doe"), (X.identifier, " ab-12 3 ", "AB123"), (X.digits, "13-96827531", "1396827531"), (X.compact_upper, " e11. 9 ", "E11.9"),
        (X.label_fold, "Tota| Charge:", "totai charge"), (X.slug, " NSF Record--1 ", "nsf_record_1"), (X.collapse_spaces, None, ""), (X.name_key, "O'Neil, Mary", "MARY ONEIL"),
        (X.repair_house_number, "I23 Main St", "123 Main St"), (X.po_box, "P.O. Box 45", "45"), (X.numeric_glyphs, "O1S", "015"),
    ],
)
def test_folds(spark, fold, value, expected) -> None:
    assert one(spark, fold(F.col("x")), x=value) == expected


@pytest.mark.parametrize(("value", "expected"), [("$1,234.5", "1234.50"), ("(12.345)", "-12.34"), ("| 2.665 |", "2.66"), ("none", None), ("", None)])
def test_currency(spark, value, expected) -> None:
    found = one(spark, X.currency(F.col("x")), x=value)
    assert (None if found is None else str(found)) == expected


@pytest.mark.parametrize(("value", "expected"), [("X", True), ("[x]", True), ("", False), ("NO", False), ("maybe", None)])
def test_checkbox(spark, value, expected) -> None:
    assert one(spark, X.checkbox(F.col("x")), x=value) is expected


@pytest.mark.parametrize(
    ("value", "expected"),
    [("07/30/2026", date(2026, 7, 30)), ("2026-07-30", date(2026, 7, 30)), ("20260730", date(2026, 7, 30)), ("1/2/70", date(1970, 1, 2)), ("1/2/68", date(2068, 1, 2)), ("13/40/2020", None), ("", None)],
)
def test_dates(spark, value, expected) -> None:
    assert one(spark, V.any_date(F.col("x")), x=value) == expected


def test_identifiers(spark) -> None:
    assert one(spark, V.valid_npi(F.col("x")), x="1234567893") is True
    assert one(spark, V.valid_npi(F.col("x")), x="1234567890") is False
    assert one(spark, V.valid_npi(F.col("x")), x=None) is False
    tries = [str(p) + "234567893" for p in range(1, 10) if one(spark, V.valid_npi(F.col("x")), x=str(p) + "234567893")]
    assert one(spark, V.repaired_npi(F.col("x")), x="234567893") == (tries[0] if len(tries) == 1 else None)
    assert one(spark, V.valid_icd10(F.col("x")), x="E11.9") and not one(spark, V.valid_icd10(F.col("x")), x="U1")
    assert one(spark, V.picture_length(F.col("x")), x="9(7)V99") == 9


def test_names_and_addresses(spark) -> None:
    assert tuple(one(spark, X.person_name(F.col("x")), x="Doe, Jane Ann")) == ("DOE", "JANE", "ANN")
    assert tuple(one(spark, X.person_name(F.col("x")), x="Jane Doe")) == ("DOE", "JANE", "")
    assert tuple(one(spark, X.address(F.array(F.lit("1 Main St"), F.lit("Springfield, IL 62701-1234"))))) == ("1 Main St", None, "SPRINGFIELD", "IL", "62701")
    assert one(spark, X.names_agree(F.col("a"), F.col("b")), a="DOE, JANE", b="Jane Doe") is True
    assert one(spark, X.agreement_key(F.lit("total_charge"), F.col("x")), x="10.00") == "10"
    assert one(spark, X.agreement_key(F.lit("total_charge"), F.col("x")), x="1000") == "1000"
    assert one(spark, X.glyph_alternatives(F.col("x"), {"O": "0", "I": "1"}), x="OI") == ["0I", "O1"]


def test_geometry(spark) -> None:
    a, b = (V.box(*[F.lit(float(v)) for v in q]) for q in ((0, 0, 10, 10), (5, 0, 15, 10)))
    assert one(spark, V.iou(a, b)) == pytest.approx(1 / 3)
    assert one(spark, V.containment(a, b)) == pytest.approx(0.5)
    assert tuple(one(spark, V.homography([[1, 0, 5], [0, 1, 6], [0, 0, 1]], F.lit(1.0), F.lit(2.0)))) == (6.0, 8.0)


def test_hashes(spark) -> None:
    assert one(spark, V.hamming(F.lit("00000000000000ff"), F.lit("ff00000000000000"))) == 16
    assert one(spark, V.hex_distance(F.lit("abcd"), F.lit("abce"))) == 1
    assert one(spark, V.hex_distance(F.lit("ab"), F.lit("abce"))) == 4
    grey = F.array(*[F.lit(float(v)) for v in [0] * 60 + [9] * 4])
    assert one(spark, V.average_hash(grey)) == "000000000000000f"


def test_intervals(spark) -> None:
    upper, z, n, k = one(spark, V.wilson(F.lit(50.0), F.lit(1000.0))), V.Z95, 1000, 50
    p = k / n
    assert upper == pytest.approx((p + z * z / (2 * n) + z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))
    assert one(spark, V.wilson(F.lit(0.0), F.lit(0.0))) is None
    assert one(spark, V.interpolate(F.lit(0.5), [0.0, 1.0], [0.2, 0.6])) == pytest.approx(0.4)


def test_python_functions(spark) -> None:
    frame = spark.createDataFrame([("hello", "hallo"), (None, "x")], "a string, b string")
    assert [r[0] for r in frame.select(S.matching_ratio("a", "b")).collect()] == [SequenceMatcher(None, "hello", "hallo").ratio(), 0.0]
    space = str(uuid.NAMESPACE_URL)
    assert frame.select(S.named_id(F.col("b"), space)).first()[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "hallo"))
    text = spark.createDataFrame([('{"a": {"email": "x", "k": [ {"ssn": 1} ]}}',), ("no",)], "x string")
    assert [r[0] for r in text.select(S.redact_deep(F.col("x"), ("email", "ssn"))).collect()] == ['{"a": {"email": "[REDACTED]", "k": [{"ssn": "[REDACTED]"}]}}', None]


@pytest.mark.parametrize(
    ("matrix", "size", "found", "reason"),
    [
        ([[1, 0, 5], [0, 1, 6], [0, 0, 1]], (None, None), (15, 26, 35, 46), "TRANSFORMED_POLYGON_VALID"),
        ([[1, 0, 5], [0, 1, 6], [0, 0, 1]], (30, 40), (15, 26, 30, 40), "TRANSFORMED_POLYGON_VALID"),
        ([[1, 0, 0.5], [0, 1, 1.5], [0, 0, 1]], (None, None), (10, 22, 30, 42), "TRANSFORMED_POLYGON_VALID"),
        ([[1, 0, 50], [0, 1, 6], [0, 0, 1]], (30, 40), None, "TRANSFORM_OUTSIDE_PAGE"),
        ([[1, 0, 0], [0, 1, 0], [-0.1, 0, 1]], (None, None), None, "DEGENERATE_TRANSFORM"),
        ([[1, 0, 0], [0, 1, 0], [-0.05, 0.0, 1]], (None, None), None, "INVALID_TRANSFORMED_POLYGON"),
        ([[1, 0, 0], [1, 0, 0], [0, 0, 1]], (None, None), None, "INVALID_TRANSFORMED_POLYGON"),
        ([[1e308, 0, 0], [0, 1, 0], [0, 0, 1]], (None, None), None, "NONFINITE_TRANSFORM"),
        ([[1, 0, 0], [0, 1, 0]], (None, None), None, "INVALID_SOURCE_OR_MATRIX"),
        (None, (None, None), None, "INVALID_SOURCE_OR_MATRIX"),
    ],
)
def test_mapped_region(spark, matrix, size, found, reason) -> None:
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in matrix]) if matrix else F.lit(None).cast("array<array<double>>")
    source = V.box(*[F.lit(float(v)) for v in (10, 20, 30, 40)])
    got = one(spark, V.mapped_region(source, rows, *[F.lit(v).cast("double") for v in size]))
    assert (got.reason, got.box and tuple(got.box)) == (reason, found)
