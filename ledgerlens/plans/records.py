"""Source and sink queries: fixed-width records, JSON documents, digests and file kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerlens.functions.values import picture_length, tiff_compression
from ledgerlens.sources import files as S, fixed_width as X
from ledgerlens.session import scratch_path, table

LINE = X.RecordSpec(
    "20", 40,
    (
        X.FieldSpec("type", 1, 2, default="20"), X.FieldSpec("order", 3, 10, "right", "0", "numeric"), X.FieldSpec("line", 13, 2, "right", "0", "numeric"),
        X.FieldSpec("charge", 15, 10, "right", "0", "decimal_implied"), X.FieldSpec("day", 25, 8, "left", " ", "date"), X.FieldSpec("flag", 33, 1), X.FieldSpec("mode", 34, 7),
    ),
)
HEAD = X.RecordSpec("10", 24, (X.FieldSpec("type", 1, 2, default="10"), X.FieldSpec("order", 3, 10, "right", "0", "numeric"), X.FieldSpec("total", 13, 12, "right", "0", "decimal_implied")))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    charge = F.col("l_extendedprice").cast("decimal(18,2)")
    values = {
        "order": F.col("l_orderkey"), "line": F.col("l_linenumber"), "charge": charge, "day": F.date_format("l_shipdate", "yyyyMMdd"),
        "flag": F.col("l_returnflag"), "mode": F.col("l_linestatus"), "type": F.lit("20"),
    }
    return X.render(rows, LINE, values)


def _written(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """The lines written as text files and read back."""
    path = scratch_path(spark, "fixed-width")
    lines.write.text(path)
    return spark.read.text(path)


def fixed_width_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as records."""
    return _lines(spark, d)


def fixed_width_parsed(spark: SparkSession, d: str) -> DataFrame:
    """The records read back: sums by flag."""
    good, _ = X.parse(_written(spark, _lines(spark, d)), LINE, trimmed=True)
    return good.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("charge").cast("long")).alias("cents"), F.min("day").alias("first_day"))


def file_structure(spark: SparkSession, d: str) -> DataFrame:
    """Records by type with one in 50 cut short."""
    lines = _written(spark, _lines(spark, d))
    order = F.substring("value", 3, 10).cast("long")
    cut = lines.select(F.when(order % 50 == 0, F.substring("value", 1, 30)).otherwise(F.col("value")).alias("value"))
    return X.file_structure(cut, {"20": LINE, "10": HEAD}, {"20": 60000, "10": 1})


def field_total(spark: SparkSession, d: str) -> DataFrame:
    return X.sum_field(_written(spark, _lines(spark, d)), LINE, "charge")


def claim_labels(spark: SparkSession, d: str) -> DataFrame:
    """Records of all orders, heads before lines, split into claims and fields."""
    orders = table(spark, d, "orders")
    head = X.render(orders, HEAD, {"type": F.lit("10"), "order": F.col("o_orderkey"), "total": F.col("o_totalprice").cast("decimal(18,2)")})
    lines = _written(spark, head.union(_lines(spark, d))).withColumn("no", F.concat(F.substring("value", 3, 10), F.substring("value", 1, 2), F.substring("value", 13, 2)))
    out = X.labels(lines, {"10": HEAD, "20": LINE}, "no")
    return out.groupBy("claim_no", "record_type", "field").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("least"))


def spec_issues(spark: SparkSession, d: str) -> DataFrame:
    """A specification made of parts' sizes, whose fields overlap and leave gaps."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("record_type"), F.col("p_partkey").cast("string").alias("field"), (F.col("p_partkey") % 97 + 1).alias("start"), (F.col("p_size") % 4 + 1).alias("length"))
    return X.spec_table_issues(rows).groupBy("record_type", "issue").agg(F.count(F.lit(1)).alias("n"))


def legacy_spec(spark: SparkSession, d: str) -> DataFrame:
    """A specification's text made of nations: a record for each region, a field for each nation."""
    r = table(spark, d, "region").select((F.col("r_regionkey") * 1000).alias("no"), F.concat(F.lit("RECORD A"), F.col("r_regionkey").cast("string")).alias("value"))
    size = F.length("n_name")
    n = table(spark, d, "nation").select(
        (F.col("n_regionkey") * 1000 + 1 + F.col("n_nationkey")).alias("no"),
        F.concat_ws("  ", F.col("n_nationkey").cast("string"), F.regexp_replace("n_name", "[^A-Z ]", " "), F.concat(F.lit("X("), size.cast("string"), F.lit(")")), (size + F.when(F.col("n_nationkey") % 7 == 0, 1).otherwise(0)).cast("string")).alias("value"),
    )
    return X.legacy_spec(r.union(n), "no").select("record_type", "number", "picture", "length", "declared_length", "ambiguous")


def picture_lengths(spark: SparkSession, d: str) -> DataFrame:
    picture = F.concat(F.lit("9("), F.col("p_size").cast("string"), F.lit(")V99"))
    return table(spark, d, "part").groupBy(picture_length(picture).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def canonical_documents(spark: SparkSession, d: str) -> DataFrame:
    """Nations as JSON documents with sorted keys, and their digests."""
    n = table(spark, d, "nation")
    doc = S.canonical_json(n, ["n_name", "n_nationkey", "n_regionkey"])
    return n.select("n_nationkey", doc.alias("document"), F.sha2(doc, 256).alias("digest"))


def tolerant_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON lines, one in ten cut in the middle: rows read by type."""
    whole = F.to_json(F.struct("event_id", "event_type"))
    lines = table(spark, d, "events").select(F.when(F.col("event_id") % 10 == 0, F.substring(whole, 1, 9)).otherwise(whole).alias("value"))
    good, bad = S.split_jsonl(lines, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())]))
    return good.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).unionByName(bad.agg(F.lit("MALFORMED").alias("event_type"), F.count(F.lit(1)).alias("n")))


def object_keys(spark: SparkSession, d: str) -> DataFrame:
    """Objects of distinct documents' texts: repeats share a key."""
    docs = table(spark, d, "documents").select(S.content_key(F.sha2("text", 256), F.lit("text.txt")).alias("key"))
    return docs.groupBy("key").agg(F.count(F.lit(1)).alias("puts"))


def page_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Pages by the sort of their first bytes and by a compression tag made of their id."""
    from ledgerlens.functions.values import sniff

    html = F.col("html").cast("binary")
    kind = F.when(F.col("page_id") % 5 == 0, F.concat(F.unhex(F.lit("25504446")), html)).when(F.col("page_id") % 5 == 1, F.concat(F.unhex(F.lit("FFD8FF")), html)).otherwise(html)
    return table(spark, d, "pages").groupBy(sniff(kind).alias("kind"), tiff_compression(F.col("page_id") % 9).alias("compression")).agg(F.count(F.lit(1)).alias("n"))


def finalized_orders(spark: SparkSession, d: str) -> DataFrame:
    """Finished orders' lines for customers of one segment."""
    rows = table(spark, d, "orders").withColumn("done", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    wanted = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return S.finalized_fields(rows, wanted, "o_custkey", "done", ["o_orderkey", "o_orderpriority"])


QUERIES = {
    f.__name__: f
    for f in (
        fixed_width_lines, fixed_width_parsed, file_structure, field_total, claim_labels, spec_issues, legacy_spec, picture_lengths, canonical_documents,
        tolerant_jsonl, object_keys, page_kinds, finalized_orders,
    )
}
_CHARGE = "round(l_extendedprice * 100)::BIGINT"
ORACLES = {
    "fixed_width_lines": f"""
        SELECT '20' || lpad(l_orderkey::VARCHAR, 10, '0') || lpad(l_linenumber::VARCHAR, 2, '0') || lpad({_CHARGE}::VARCHAR, 10, '0') || strftime(l_shipdate, '%Y%m%d') || l_returnflag || rpad(l_linestatus, 7, ' ') AS value FROM lineitem""",
    "fixed_width_parsed": f"SELECT l_returnflag AS flag, count(*) AS n, sum({_CHARGE})::BIGINT AS cents, min(strftime(l_shipdate, '%Y%m%d')) AS first_day FROM lineitem GROUP BY 1",
    "file_structure": """
        SELECT '20' AS record_type, count(*) AS lines, count(*) FILTER (l_orderkey % 50 = 0) AS wrong_length, 60000 AS expected, count(*) - 60000 AS difference FROM lineitem
        UNION ALL SELECT '10', 0, 0, 1, -1""",
    "field_total": f"SELECT sum({_CHARGE})::BIGINT AS total FROM lineitem",
    "claim_labels": f"""
        WITH c AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS claim_no, round(o_totalprice * 100)::BIGINT AS t FROM orders),
        h AS (SELECT claim_no, '10' AS record_type, unnest([{{'f': 'type', 't': '10'}}, {{'f': 'order', 't': lpad(k::VARCHAR, 10, '0')}}, {{'f': 'total', 't': lpad(t::VARCHAR, 12, '0')}}]) AS x FROM c),
        l AS (SELECT claim_no, '20' AS record_type, unnest([{{'f': 'type', 't': '20'}}, {{'f': 'order', 't': lpad(l_orderkey::VARCHAR, 10, '0')}}, {{'f': 'line', 't': lpad(l_linenumber::VARCHAR, 2, '0')}},
              {{'f': 'charge', 't': lpad({_CHARGE}::VARCHAR, 10, '0')}}, {{'f': 'day', 't': strftime(l_shipdate, '%Y%m%d')}}, {{'f': 'flag', 't': l_returnflag}}, {{'f': 'mode', 't': l_linestatus}}]) AS x FROM c JOIN lineitem ON l_orderkey = k)
        SELECT claim_no, record_type, x.f AS field, count(*) AS n, min(x.t) AS least FROM (SELECT * FROM h UNION ALL SELECT * FROM l) GROUP BY 1, 2, 3""",
    "spec_issues": """
        WITH f AS (SELECT p_brand AS record_type, p_partkey::VARCHAR AS field, p_partkey % 97 + 1 AS start, p_size % 4 + 1 AS length FROM part),
        e AS (SELECT *, coalesce(max(start + length - 1) OVER (PARTITION BY record_type ORDER BY start, field ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f)
        SELECT record_type, CASE WHEN start <= before THEN 'OVERLAP' ELSE 'GAP' END AS issue, count(*) AS n FROM e WHERE start <= before OR start > before + 1 GROUP BY 1, 2""",
    "legacy_spec": """
        SELECT 'A' || n_regionkey AS record_type, n_nationkey AS number, 'X(' || length(n_name) || ')' AS picture, length(n_name) AS length,
               length(n_name) + (n_nationkey % 7 = 0)::INT AS declared_length, n_nationkey % 7 = 0 AS ambiguous FROM nation""",
    "picture_lengths": "SELECT p_size + 2 AS length, count(*) AS n FROM part GROUP BY 1",
    "canonical_documents": """
        WITH d AS (SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS document FROM nation)
        SELECT *, sha256(document) AS digest FROM d""",
    "tolerant_jsonl": """
        SELECT event_type, count(*) AS n FROM events WHERE event_id % 10 <> 0 GROUP BY 1 UNION ALL SELECT 'MALFORMED', count(*) FROM events WHERE event_id % 10 = 0""",
    "object_keys": "SELECT 'objects/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || '/text.txt' AS key, count(*) AS puts FROM documents GROUP BY 1",
    "page_kinds": """
        SELECT CASE page_id % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'JPEG' ELSE 'UNKNOWN' END AS kind,
               CASE page_id % 9 WHEN 1 THEN 'UNCOMPRESSED' WHEN 2 THEN 'CCITT_G3' WHEN 3 THEN 'CCITT_G3' WHEN 4 THEN 'CCITT_G4' WHEN 5 THEN 'LZW' WHEN 6 THEN 'JPEG' WHEN 7 THEN 'JPEG' WHEN 8 THEN 'DEFLATE' ELSE 'UNKNOWN' END AS compression,
               count(*) AS n FROM pages GROUP BY 1, 2""",
    "finalized_orders": "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING'",
}
