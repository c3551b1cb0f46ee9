"""Connected components by alternating large-star and small-star.

Each round replaces the edges: large-star links every larger neighbour of a vertex to the smallest vertex in its
neighbourhood, small-star links the smaller neighbours and the vertex itself to it. When the edges no longer change
they are stars around each component's smallest vertex. The neighbourhood's minimum is a map-side combined aggregate
and the join that brings it back is split by adaptive execution, so a vertex with very many edges is no task of its
own. Every round's edges are written to the shared folder, which also cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerlens.session import discard, materialize


def _pairs(a: str, b: str) -> DataFrame:
    return F.least(F.col(a), F.col(b)).alias("low"), F.greatest(F.col(a), F.col(b)).alias("high")


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).union(edges.select(F.col("high").alias("u"), F.col("low").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("of", "m").alias("m"))
    return both.join(least, both.u == least.of).filter("v > u and v <> m").select(*_pairs("m", "v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("high").alias("u"), F.col("low").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "of")
    joined = down.join(least, down.u == least.of)
    moved = joined.filter("v <> m").select(*_pairs("m", "v"))
    return moved.union(least.select(*_pairs("m", "of"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    """A number for a set of edges, by which two rounds are compared."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """vertex and component (its smallest vertex) for every vertex of ``edges`` (low, high)."""
    edges = materialize(edges.select(*_pairs("low", "high")).filter("low <> high").distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        older, edges = edges, materialize(small_star(large_star(edges)), "edges")
        discard(older)
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    stars = edges.select(F.col("high").alias("vertex"), F.col("low").alias("component"))
    return stars.union(edges.select("low", "low")).distinct()
