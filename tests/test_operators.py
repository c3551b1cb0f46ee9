"""Operators on small tables: sources, streams, decisions and graph-like joins."""

from __future__ import annotations

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F, types as T

from ledgerlens.operators import claims as C, layout as L, matching as M, ranking as R
from ledgerlens.sources import files as S, fixed_width as X
from ledgerlens.streaming import events as E

SPEC = X.RecordSpec("01", 20, (X.FieldSpec("name", 1, 10), X.FieldSpec("n", 11, 6, "right", "0", "numeric"), X.FieldSpec("charge", 17, 4, "right", "0", "decimal_implied")))


def test_fixed_width_round_trip(spark) -> None:
    rows = spark.createDataFrame([("AB", "175", "1.75"), ("TOOLONGVALUE", "1", "0.05")], "name string, n string, charge string")
    lines = X.render(rows, SPEC, {c: F.col(c) for c in rows.columns})
    assert [r.value for r in lines.collect()] == ["AB        0001750175", "TOOLONGVAL0000010005"]
    good, bad = X.parse(lines.union(spark.createDataFrame([("short",), (None,)], "value string")), SPEC)
    assert [r.value for r in X.render(good, SPEC, {"name": F.col("name"), "n": F.col("n"), "charge": F.col("charge").cast("decimal(18,2)") / 100}).collect()] == [r.value for r in lines.collect()]
    assert bad.count() == 2
    with pytest.raises(Exception, match="overflows"):
        X.render(rows, SPEC, {"name": F.col("name"), "n": F.lit("12345678"), "charge": F.col("charge")}).collect()


def test_spec_issues() -> None:
    spec = X.RecordSpec("01", 10, (X.FieldSpec("a", 1, 4), X.FieldSpec("b", 4, 2), X.FieldSpec("c", 8, 5)))
    assert X.spec_issues(spec) == ["OVERLAP:b", "GAP:c", "BEYOND:c"]


def test_jsonl(spark, tmp_path) -> None:
    schema = T.StructType([T.StructField("a", T.LongType())])
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": \n\n{"a": 2}\n')
    assert sorted(r.a for r in S.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", schema).collect()) == [1, 2]
    with pytest.raises(Exception):  # noqa: B017, PT011
        S.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", schema, strict=True).collect()
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id long, v string")
    ledger = f"file://{tmp_path}/ledger"
    assert S.append_once(spark, rows, ledger, "id") == 2
    assert S.append_once(spark, rows, ledger, "id") == 0


def test_snapshot_and_select(spark, tmp_path) -> None:
    import hashlib

    body = b'{"a": 1}\n'
    (tmp_path / "s.json").write_bytes(body)
    (tmp_path / "m.json").write_text(json.dumps({"file": "s.json", "sha256": hashlib.sha256(body).hexdigest()}))
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert S.read_snapshot(spark, str(tmp_path), "m.json", schema).count() == 1
    (tmp_path / "m.json").write_text(json.dumps({"file": "../s.json", "sha256": ""}))
    with pytest.raises(ValueError, match="outside"):
        S.read_snapshot(spark, str(tmp_path), "m.json", schema)
    assert S.check_select(" SELECT 1; ") == "SELECT 1"
    for bad in ("DELETE FROM t", "SELECT 1; SELECT 2", "SELECT 1 FROM t; DROP TABLE t"):
        with pytest.raises(ValueError, match="SELECT"):
            S.check_select(bad)


def test_binary_scan(spark, tmp_path) -> None:
    (tmp_path / "a.bin").write_bytes(b"%PDF-1.4")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.bin").write_bytes(b"II*\x00data")
    found = {r.path.rsplit("/", 1)[1]: r.format for r in S.scan_directory(spark, f"file://{tmp_path}").collect()}
    assert found == {"a.bin": "PDF", "c.bin": "TIFF"}


def test_fallback_levels(spark) -> None:
    rules = spark.createDataFrame([("a", "x", 1.0), ("a", "*", 2.0), ("*", "x", 3.0)], "f string, g string, v double")
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")], "f string, g string")
    assert {(r.f, r.g): r.v for r in C.fallback_lookup(rows, rules, "f", "g", "v", 9.0).collect()} == {("a", "x"): 1.0, ("a", "y"): 2.0, ("b", "x"): 3.0, ("b", "y"): 9.0}


def test_unlock_vector(spark) -> None:
    rows = spark.createDataFrame([(1, ["name"]), (2, ["name", "dob"]), (3, [])], "claim long, blockers array<string>")
    found = {r.reason: r for r in C.blocker_pareto(rows).collect()}
    assert (found["name"].claims_blocked, found["name"].unlocked_alone, found["name"].gain) == (2, 1, pytest.approx(1 / 3, abs=1e-6))


def test_near_hashes_against_all_pairs(spark) -> None:
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(30)]
    values = base + [b ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for b in base] + base[:3]
    rows = spark.createDataFrame([(k, f"{v:016x}") for k, v in enumerate(values)], "id long, h string")
    found = {(r.a, r.b) for r in M.near_hash_pairs(rows, "id", "h", 4).collect()}
    assert found == {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= 4}


def test_nearest_against_all_pairs(spark) -> None:
    r = random.Random(3)
    points = [(k, r.randrange(3), None if k == 7 else r.randrange(100) / 4) for k in range(80)]
    targets = [(k, r.randrange(2), r.randrange(100) / 4) for k in range(30)]
    found = M.nearest(spark.createDataFrame(points, "p long, k long, v double"), spark.createDataFrame(targets, "t long, k long, w double"), ["k"], "p", "t", "v", "w")
    expected = {p: min((abs(v - w), t) for t, g, w in targets if g == k) for p, k, v in points if v is not None and k < 2}
    assert {r.p: (r.distance, r.t) for r in found.collect()} == expected


def test_numbers_over_ranges(spark) -> None:
    made = spark.range(1000).select((F.col("id") * 7 % 1009).alias("k")).repartition(6)
    assert sorted((r.k, r.number) for r in R.numbered(made, "k").collect()) == [(k, n) for n, k in enumerate(sorted(i * 7 % 1009 for i in range(1000)))]


def test_clustering_and_conflicts(spark) -> None:
    tokens = spark.createDataFrame([(1, "b", 50.0, 0.0, 60.0, 10.0), (1, "a", 0.0, 2.0, 9.0, 12.0), (1, "c", 0.0, 30.0, 9.0, 40.0)], "page_id long, text string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.line, r.place, r.text) for r in L.cluster_lines(tokens).orderBy("line", "place").collect()] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    boxes = [(1, "f", 0.9, 0.5, 0.0, 0.0, 5.0, 5.0), (1, "g", 0.8, 0.5, 0.02, 0.0, 5.0, 5.04), (1, "g", 0.5, 0.5, 1.0, 1.0, 4.0, 4.0), (1, "h", 0.7, 0.5, 9.0, 9.0, 12.0, 12.0), (1, "i", 0.7, 0.6, 9.0, 9.0, 12.0, 12.0)]
    kept = L.settle_conflicts(spark.createDataFrame(boxes, "page_id long, field string, score double, mapping double, x0 double, y0 double, x1 double, y1 double"))
    # g loses the box it shares with f to one decimal, not the one inside it; h loses to i by mapping and has no other.
    assert {(r.field, r.score) for r in kept.collect()} == {("f", 0.9), ("g", 0.5), ("i", 0.7)}


def test_line_rules_differ(spark) -> None:
    def lines(rule: str, *boxes: tuple) -> list:
        tokens = spark.createDataFrame([(1, t, float(x), float(y), float(x) + 5, float(y) + h) for t, x, y, h in boxes], "page_id long, text string, x0 double, y0 double, x1 double, y1 double")
        return [r.t for r in L.cluster_lines(tokens, rule).groupBy("line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda w: w["text"]), "").alias("t")).orderBy("line").collect()]

    # Centres 2.5 apart at height 4: within 3, but not within 0.55 of the height.
    low = (("a", 0, 0, 4), ("b", 9, 2.5, 4))
    assert lines("baseline", *low) == ["ab"] and lines("nearest", *low) == ["a", "b"]
    # Tops 0 and 5: a high token reaches the line above by its own height; by centres it is too far.
    tall = (("a", 0, 0, 6), ("b", 9, 5, 20))
    assert lines("block", *tall) == ["ab"] and lines("nearest", *tall) == ["a", "b"] and lines("baseline", *tall) == ["a", "b"]


def test_order_does_not_matter(spark) -> None:
    rows = spark.range(500).select((F.col("id") % 7).alias("k"), (F.col("id") % 11).alias("v"))
    a = sorted(map(tuple, R.consensus(rows, ["k"], "v").collect()))
    assert a == sorted(map(tuple, R.consensus(rows.repartition(3).orderBy(F.desc("v")), ["k"], "v").collect()))


def test_cache_and_retention(spark) -> None:
    hits, misses = E.cached(spark.createDataFrame([("a",), ("b",), ("b",)], "key string"), spark.createDataFrame([("a", 1)], "key string, v int"), "key")
    assert (hits.count(), misses.count()) == (1, 1)
    rows = spark.createDataFrame([(1, datetime(2020, 1, 1), "t"), (2, datetime(2020, 3, 1), "t"), (3, None, "u")], "id long, at timestamp, tenant string")
    stay, audit = E.retention(rows, "at", "tenant", spark.createDataFrame([("t", 30)], "tenant string, days int"), datetime(2020, 3, 10))
    assert sorted(r.id for r in stay.collect()) == [2, 3]
    assert [(r.id, r.action) for r in audit.collect()] == [(1, "RETENTION_DELETE")]


def test_empty_tables(spark) -> None:
    empty = spark.createDataFrame([], "k long, v string, h string")
    assert R.consensus(empty, ["k"], "v").count() == 0
    assert M.near_hash_pairs(empty, "k", "h").count() == 0
