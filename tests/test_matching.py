"""Best matches without all pairs, and likeness of names by classes of copies."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import DataFrame, functions as F

from ledgerlens.operators import matching as M
from ledgerlens.plans import governance as P


def most_rows(df: DataFrame) -> int:
    """Collects a frame; the largest number of rows that an operation of its plan made."""
    df.collect()

    def walk(node) -> int:  # noqa: ANN001
        found = node.metrics().get("numOutputRows")
        below = [node.children().apply(k) for k in range(node.children().size())]
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            below = [node.executedPlan()]
        elif name.endswith("QueryStageExec"):
            below = [node.plan()]
        return max([found.get().value() if found.isDefined() else 0, *map(walk, below)])

    return walk(df._jdf.queryExecution().executedPlan())


def by_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    near = 1 - F.least(F.abs(F.col("x") - F.col("y")) / 100, F.lit(1.0))
    return M.best_match(left, right, ["g"], "a", "b", {"near": (near, 0.7), "same": (F.when(F.col("a") % 10 == F.col("b") % 10, 1.0).otherwise(0.0), 0.3)}, 0.9)


@pytest.mark.parametrize("kind", ["cents", "dense", "far", "odd"])
def test_best_near_against_all_pairs(spark, kind: str) -> None:
    r = random.Random(kind)
    value = {
        "cents": lambda: r.randrange(-2000, 2000) / 100,
        # Distances that rounded scores don't tell apart, on both sides of the borders of cells.
        "dense": lambda: r.choice([0.0, 1.0, 7.0]) + r.randrange(-30, 30) * 3e-7,
        "far": lambda: r.choice([-1e18, -5000.0, 0.0, 99.99, 100.0, 100.01, 300.0, 1e18]),
        "odd": lambda: r.choice([None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 42.857142857, 100.0, r.random() * 200]),
    }[kind]
    # Group 4 has no targets, group 5 no points, null is no group; point 7 is there twice.
    points = [(k, r.choice([1, 2, 3, 4, None]), value()) for k in [*range(300), 7]]
    targets = [(k, r.choice([1, 1, 2, 3, 5, None]), value()) for k in r.sample(range(400), 90)]
    left, right = spark.createDataFrame(points, "a long, g int, x double"), spark.createDataFrame(targets, "b long, g int, y double")
    found = M.best_near(left, right, ["g"], "a", "b", ("x", "y"), 100.0, (F.col("a") % 10, F.col("b") % 10), (0.7, 0.3), 0.9)
    expected = by_pairs(left, right)
    assert found.columns == expected.columns
    rows = sorted(map(tuple, found.collect()))
    assert rows == sorted(map(tuple, expected.collect())) and len(rows) > 150


def test_best_near_of_empty_tables(spark) -> None:
    left, right = spark.createDataFrame([(1, 1, 2.0)], "a long, g int, x double"), spark.createDataFrame([(1, 1, 2.0)], "b long, g int, y double")
    for x, y in ((left.limit(0), right), (left, right.limit(0))):
        assert M.best_near(x, y, ["g"], "a", "b", ("x", "y"), 100.0, (F.col("a") % 10, F.col("b") % 10), (0.7, 0.3)).count() == 0


def test_best_supplier_makes_no_pairs(spark, tmp_path) -> None:
    """400 customers and 400 suppliers of one nation, half of the customers with one balance."""
    r = random.Random(1)
    customers = [(k, 1, 5.0 if k % 2 else r.randrange(100_000) / 100) for k in range(400)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, 1, r.randrange(100_000) / 100) for k in range(400)], "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    found = P.best_supplier(spark, str(tmp_path))
    assert most_rows(found) < 10_000
    assert found.count() == 400


def test_name_similarity_gives_all_pairs(spark) -> None:
    r = random.Random(4)
    names = ["", None, "ab", "abcd", "bcde", "tide", "diet", "hot ring", "ring hot", "x" * 300, "x" * 290 + "diet"]
    parts = [(k, r.choice([1, 2, None]), r.choice(names)) for k in range(120)]
    found = M.name_similarity(spark.createDataFrame(parts, "id long, g int, name string"), ["g"], "id", "name").collect()
    heads = {row.b: row.a for row in found if row.same}
    ratios = {(row.a, row.b): row for row in found if not row.same}
    kinds = {(row.a, row.b): row.ratio for row in found if row.same}
    assert len(found) == len(ratios) + len(heads)

    def of(x: int, y: int) -> float:
        a, b = heads.get(x, x), heads.get(y, y)
        if a == b:
            return kinds[(a, max(x, y))]
        return ratios[(a, b)].ratio if a < b else ratios[(b, a)].reverse

    n = 0
    for x, g, name in parts:
        for y, h, other in parts[x + 1 :]:
            if g is not None and g == h:
                assert of(x, y) == (0.0 if name is None or other is None else SequenceMatcher(None, name, other).ratio())
                n += 1
    assert n > 2000


def test_name_similarity_makes_no_pairs_of_copies(spark, tmp_path) -> None:
    """600 parts of one brand and size with three names are 179,700 pairs."""
    parts = [(k, "b", 1, ["hot ring", "red ring", "old rod"][k % 3]) for k in range(600)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    found = P.name_similarity(spark, str(tmp_path))
    assert most_rows(found) <= 600
    assert sorted(r.b for r in found.collect() if r.same) == list(range(3, 600)) and found.filter("not same").count() == 3
