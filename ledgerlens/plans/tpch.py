"""Star-schema reporting queries over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.session import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and means by return flag and line status."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(net), 2).alias("sum_net"),
            F.count(F.lit(1)).alias("n_lines"),
        )
    )


QUERIES = {"pricing_summary": pricing_summary}
ORACLES = {
    "pricing_summary": """
        SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
               round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, count(*) AS n_lines
        FROM lineitem GROUP BY ALL""",
}
