"""Qualification queries over documents, orders and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.operators import layout as L, qualification as Q
from ledgerlens.session import table


def _assets(spark: SparkSession, d: str) -> DataFrame:
    rules = {"TOO_SHORT": F.col("n_chars") < 100, "TOO_LONG": F.col("n_chars") > 10000, "NO_LABEL": F.col("quality").isNull(), "TOXIC": F.col("toxic") == 1}
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return Q.qualify(rows, rules, ["NO_LABEL", "TOO_LONG"])


_ASSETS = """a AS (
    SELECT d.*, quality, toxic, concat_ws(',', CASE WHEN n_chars < 100 THEN 'TOO_SHORT' END, CASE WHEN n_chars > 10000 THEN 'TOO_LONG' END, CASE WHEN quality IS NULL THEN 'NO_LABEL' END, CASE WHEN toxic = 1 THEN 'TOXIC' END) AS reasons,
           CASE WHEN n_chars < 100 OR coalesce(toxic = 1, false) THEN 'EXCLUDED' WHEN n_chars > 10000 OR quality IS NULL THEN 'REVIEW' ELSE 'QUALIFIED' END AS state FROM documents d LEFT JOIN labels USING (doc_id))"""


def asset_states(spark: SparkSession, d: str) -> DataFrame:
    return _assets(spark, d).groupBy("state", "reasons").agg(F.count(F.lit(1)).alias("n"))


def source_attestations(spark: SparkSession, d: str) -> DataFrame:
    return Q.attestations(_assets(spark, d), "source", F.col("quality") == 1, 0.3)


def corpus_gate(spark: SparkSession, d: str) -> DataFrame:
    return Q.corpus_gate(_assets(spark, d), "state", "source", "lang", {"assets": 500, "sources": 15, "classes": 5})


def shadow_parity(spark: SparkSession, d: str) -> DataFrame:
    """Statuses of orders against a second run that misses some and changes others."""
    a = table(spark, d, "orders").filter("o_orderkey % 11 <> 0").select("o_orderkey", "o_orderstatus")
    b = table(spark, d, "orders").filter("o_orderkey % 13 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return Q.parity(a, b, "o_orderkey", "o_orderstatus").groupBy("parity").agg(F.count(F.lit(1)).alias("n"))


def finalisation(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose status is what their lines' states give."""
    states = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_linestatus") == "O").alias("open"), F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "orders").join(states, "o_orderkey", "left")
    again = F.when(F.col("open") == 0, "F").when(F.col("open") == F.col("n"), "O").when(F.col("open") > 0, "P")
    ok, held = Q.finalise(rows, "o_orderstatus", again)
    return ok.agg(F.lit("final").alias("side"), F.count(F.lit(1)).alias("n")).unionByName(held.agg(F.lit("held").alias("side"), F.count(F.lit(1)).alias("n")))


def final_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumn("state", F.when(F.col("l_discount") < 0.08, "AUTO_ACCEPTED").otherwise("REVIEW"))
    return Q.can_finalise(rows, "l_orderkey", "state", F.col("l_returnflag") == "R", ("AUTO_ACCEPTED",)).groupBy("final").agg(F.count(F.lit(1)).alias("orders"))


def weekly_rates(spark: SparkSession, d: str) -> DataFrame:
    return Q.weekly(table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate")), "day", F.col("o_orderstatus") == "P")


def hierarchy_labels(spark: SparkSession, d: str) -> DataFrame:
    """State, flag and mode of a line as levels, their confidences from discount and tax."""
    path = Q.assemble_path([(F.col("l_linestatus"), F.lit(1.0)), (F.col("l_returnflag"), F.round(1 - F.col("l_discount"), 6)), (F.col("l_linenumber").cast("string"), F.round(1 - F.col("l_tax"), 6))], 0.95)
    return table(spark, d, "lineitem").groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"))


def located_fields(spark: SparkSession, d: str) -> DataFrame:
    """The word after the first of some short words in each turn, found by boxes."""
    t = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("page"), "text")
    anchors = spark.createDataFrame([("article", "the"), ("article", "la"), ("copula", "is")], "field string, alias string")
    return Q.locate(L.text_tokens(t, "page", "text"), anchors)


def fused_names(spark: SparkSession, d: str) -> DataFrame:
    """Readings of part names by two families that agree, miss a letter each, or miss a word; a third has another number of words."""
    name, kind = F.col("p_name"), F.col("p_partkey") % 5
    sure = F.when(kind == 1, F.concat(F.expr("left(p_name, length(p_name) - 1)"), F.lit("#"))).otherwise(name)
    other = F.when(kind == 2, F.concat(F.lit("#"), F.substring("p_name", 2, 99))).when(kind == 3, F.reverse(name)).when(kind == 4, F.upper(name)).otherwise(name)
    read = lambda f, t, c: F.struct(F.lit(f).alias("family"), t.alias("text"), F.lit(c).alias("confidence"))
    rows = table(spark, d, "part").select("p_partkey", F.explode(F.array(read("a", sure, 0.9), read("b", other, 0.7), read("c", F.concat(name, F.lit(" x")), 0.99))).alias("r"))
    out = Q.fuse_tokens(rows.select("p_partkey", "r.*"), ["p_partkey"], ["ring", "Gear", "bolt"])
    return out.groupBy("text").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (asset_states, source_attestations, corpus_gate, shadow_parity, finalisation, final_orders, weekly_rates, hierarchy_labels, located_fields, fused_names)
}
ORACLES = {
    "asset_states": f"WITH {_ASSETS} SELECT state, reasons, count(*) AS n FROM a GROUP BY 1, 2",
    "source_attestations": f"""
        WITH {_ASSETS}, s AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS k FROM a GROUP BY 1)
        SELECT source, n, round(k / n, 6) AS share, CASE WHEN k / n >= 0.3::DOUBLE THEN 'ATTESTED' WHEN k > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS state FROM s""",
    "corpus_gate": f"""
        WITH {_ASSETS}, c AS (SELECT count(*) AS assets, count(DISTINCT source) AS sources, count(DISTINCT lang) AS classes FROM a WHERE state = 'QUALIFIED')
        SELECT *, concat_ws(',', CASE WHEN assets < 500 THEN 'FEW_ASSETS' END, CASE WHEN sources < 15 THEN 'FEW_SOURCES' END, CASE WHEN classes < 5 THEN 'FEW_CLASSES' END) AS blockers,
               assets >= 500 AND sources >= 15 AND classes >= 5 AS passed FROM c""",
    "shadow_parity": """
        SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'ONLY_SHADOW' WHEN o_orderkey % 13 = 0 THEN 'ONLY_PRODUCTION' WHEN o_orderkey % 7 = 0 THEN 'CHANGED' ELSE 'SAME' END AS parity, count(*) AS n
        FROM orders WHERE o_orderkey % 143 <> 0 GROUP BY 1""",
    "finalisation": """
        WITH s AS (SELECT l_orderkey, count(*) FILTER (l_linestatus = 'O') AS o, count(*) AS n FROM lineitem GROUP BY 1),
        r AS (SELECT o_orderstatus IS NOT DISTINCT FROM CASE WHEN o = 0 THEN 'F' WHEN o = n THEN 'O' WHEN o > 0 THEN 'P' END AS ok FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
        SELECT 'final' AS side, count(*) FILTER (ok) AS n FROM r UNION ALL SELECT 'held', count(*) FILTER (NOT ok) FROM r""",
    "final_orders": """
        WITH f AS (SELECT bool_and(l_returnflag <> 'R' OR l_discount < 0.08::DOUBLE) AND bool_or(l_returnflag = 'R') AS final FROM lineitem GROUP BY l_orderkey)
        SELECT final, count(*) AS orders FROM f GROUP BY 1""",
    "weekly_rates": "SELECT strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week, count(*) AS n, round(avg((o_orderstatus = 'P')::INT), 6) AS rate FROM orders GROUP BY 1",
    "hierarchy_labels": """
        SELECT l_linestatus || CASE WHEN round(1 - l_discount, 6) >= 0.95::DOUBLE THEN '/' || l_returnflag || CASE WHEN round(1 - l_tax, 6) >= 0.95::DOUBLE THEN '/' || l_linenumber ELSE '' END ELSE '' END AS path, count(*) AS n
        FROM lineitem GROUP BY 1""",
    "fused_names": """
        WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN p_name[:-2] || '#' ELSE p_name END AS a,
                          CASE p_partkey % 5 WHEN 2 THEN '#' || p_name[2:] WHEN 3 THEN reverse(p_name) WHEN 4 THEN upper(p_name) ELSE p_name END AS b FROM part),
        w AS (SELECT p_partkey, unnest(string_split(a, ' ')) AS x, unnest(string_split(b, ' ')) AS y, generate_subscripts(string_split(a, ' '), 1) AS k FROM r),
        c AS (SELECT *, levenshtein(lower(x), lower(y)) AS d FROM w),
        o AS (SELECT *, CASE WHEN d = 1 AND lower(y) IN ('ring', 'gear', 'bolt') AND lower(x) NOT IN ('ring', 'gear', 'bolt') THEN y WHEN d <= 2 THEN x END AS z FROM c),
        t AS (SELECT p_partkey, CASE WHEN count(z) = count(*) THEN string_agg(z, ' ' ORDER BY k) END AS text FROM o GROUP BY 1)
        SELECT text, count(*) AS n FROM t GROUP BY 1""",
}
