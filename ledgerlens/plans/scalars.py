"""Queries that apply the column functions to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.functions import text as X, values as V
from ledgerlens.session import table


def text_folds(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.sha2(X.collapse_spaces(t), 256).alias("collapsed"), F.sha2(X.identifier(t), 256).alias("identifier"), X.digits(t).alias("digits"),
        F.sha2(X.label_fold(t), 256).alias("label"), F.size(X.word_set(t)).alias("n_words"),
    )


def part_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes, slugs, glyph readings and spans of part descriptions."""
    return table(spark, d, "part").select(
        "p_partkey", X.compact_upper(F.col("p_type")).alias("code"), X.slug(F.col("p_name")).alias("slug"), X.numeric_glyphs(F.col("p_brand")).alias("glyphs"),
        V.valid_procedure(F.substring(X.compact_upper(F.col("p_brand")), -5, 5)).alias("procedure_ok"),
        V.valid_icd10(F.substring(X.compact_upper(F.col("p_type")), 1, 3)).alias("icd_ok"),
        X.select_span(F.concat_ws(" ", "p_name", F.col("p_retailprice").cast("decimal(18,2)").cast("string")), "amount")["value"].alias("amount"),
    )


def money_text(spark: SparkSession, d: str) -> DataFrame:
    """Balances written as text, negative ones in parentheses, and read back."""
    b = F.col("c_acctbal").cast("decimal(18,2)")
    said = F.when(b < 0, F.concat(F.lit("($"), F.format_number(F.abs(b), 2), F.lit(")"))).otherwise(F.concat(F.lit("| $"), F.format_number(b, 2)))
    return table(spark, d, "customer").select("c_custkey", X.currency(said).cast("double").alias("amount"))


def date_text(spark: SparkSession, d: str) -> DataFrame:
    """Order dates written in four forms and read back."""
    day = F.to_date("o_orderdate")
    forms = [F.date_format(day, p) for p in ("yyyy-MM-dd", "M/d/yyyy", "yyyyMMdd", "MM/dd/yy")]
    said = F.element_at(F.array(*forms), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", V.any_date(said).alias("day"), V.service_date(F.date_format(day, "MMddyy")).alias("service_day"))


def provider_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Ten-digit numbers of suppliers: checksum, validity and the repair of their last nine digits."""
    number = F.lpad((F.col("s_suppkey") * 7919 + 1000000007).cast("string"), 10, "0")
    return table(spark, d, "supplier").select(
        "s_suppkey", V.luhn_sum(number).alias("checksum"), V.valid_npi(number).alias("valid"), F.coalesce(V.repaired_npi(F.substring(number, 2, 9)), F.lit("")).alias("repaired")
    )


def name_keys(spark: SparkSession, d: str) -> DataFrame:
    """Names with their parts swapped agree with the names; some hold a form label's word."""
    name = F.regexp_replace("c_name", "#", " ")
    swapped = F.concat(F.element_at(F.split(name, " "), -1), F.lit(", "), F.element_at(F.split(name, " "), 1))
    return table(spark, d, "customer").select("c_custkey", X.name_key(swapped).alias("key"), X.label_contaminated(F.concat("c_name", F.when(F.col("c_custkey") % 7 == 0, " Insured").when(F.col("c_custkey") % 11 == 0, " Insuredx").otherwise(""))).alias("contaminated"))


def error_rates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(X.error_rate(F.lower("p_brand"), F.lower("p_type")), 6).alias("rate"))


def redacted_events(spark: SparkSession, d: str) -> DataFrame:
    """Properties of events with sensitive values replaced, counted by value."""
    props = F.to_json(F.struct(F.col("user_id").cast("string").alias("member_id"), F.col("event_type").alias("kind")))
    red = X.redact(props)
    return table(spark, d, "events").select(red["member_id"].alias("member"), red["kind"].alias("kind")).groupBy("member", "kind").agg(F.count(F.lit(1)).alias("n"))


def typed_values(spark: SparkSession, d: str) -> DataFrame:
    """How documents' words fit the data types; each distinct word is tested once."""
    words = table(spark, d, "documents").select(F.explode(F.split("text", "[ \\n]+")).alias("word")).filter("trim(word) <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.explode(F.array(*[F.lit(k) for k in V.TYPE_PATTERNS])).alias("kind")
    rows = words.select("word", "n", kinds)
    fits, score = V.valid_type(F.col("word"), F.col("kind")), V.type_score(F.col("word"), F.col("kind"))
    return rows.groupBy("kind").agg(F.sum(F.when(fits, F.col("n")).otherwise(0)).alias("valid"), F.round(F.sum(score * F.col("n")), 2).alias("score"))


def box_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Boxes from order lines: overlap with a fixed region, growth within the page, and what lies inside."""
    q, p = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    own = V.box(q, p * 10, q + 20, p * 10 + 8)
    fixed = V.box(F.lit(20.0), F.lit(15.0), F.lit(45.0), F.lit(40.0))
    grown = V.expand(own, 0.1, F.lit(60.0), F.lit(75.0))
    rows = table(spark, d, "lineitem").select("l_linenumber", V.iou(own, fixed).alias("iou"), V.containment(own, fixed).alias("inside"), V.area(grown).alias("area"))
    return rows.groupBy("l_linenumber").agg(*[F.round(F.sum(c), 4).alias(c) for c in ("iou", "inside", "area")], F.count_if(F.col("iou") >= 0.5).alias("n_half"))


def embedding_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each vector with the first of its label."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("base"))
    return e.join(first, "label").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("base")), 4).alias("cosine"))


def hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", F.sha2("text", 256).alias("content"), V.joined_hash(F.col("doc_id"), F.col("lang"), F.col("source"), length=24).alias("candidate"),
        V.hash_percent(F.lit("17"), F.col("source")).alias("percent"), V.split_of(F.col("source")).alias("split"),
    )


def label_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold the words of a phrase in order, and values that aren't labels."""
    rows = table(spark, d, "documents").select("lang", X.contains_tokens(F.col("text"), F.lit("all rights reserved")).alias("rights"), X.contains_tokens(F.col("text"), F.lit("mit license")).alias("mit"))
    return rows.groupBy("lang").agg(F.count_if("rights").alias("rights"), F.count_if("mit").alias("mit"))


QUERIES = {
    f.__name__: f
    for f in (
        text_folds, part_codes, money_text, date_text, provider_numbers, name_keys, error_rates, redacted_events, typed_values, box_overlaps,
        embedding_cosine, hashes, label_phrases,
    )
}
_COLLAPSE = r"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"
_FOLD = r"trim(regexp_replace(replace(lower(coalesce({x}, '')), '|', 'i'), '[^a-z0-9]+', ' ', 'g'))"
_LUHN = "list_sum(list_transform(range(1, len({x}) + 1), lambda k: CASE WHEN k % 2 = 0 THEN (reverse({x})[k]::INT * 2) - CASE WHEN reverse({x})[k]::INT > 4 THEN 9 ELSE 0 END ELSE reverse({x})[k]::INT END))::INT"
_BOX = """b AS (
    SELECT l_linenumber, l_quantity AS x0, l_linenumber * 10.0::DOUBLE AS y0, l_quantity + 20 AS x1, l_linenumber * 10.0::DOUBLE + 8 AS y1 FROM lineitem),
    o AS (SELECT *, greatest(least(x1, 45) - greatest(x0, 20), 0) * greatest(least(y1, 40) - greatest(y0, 15), 0) AS ov, (x1 - x0) * (y1 - y0) AS own,
          greatest(least(x1 + 2, 60) - greatest(x0 - 2, 0), 0) * greatest(least(y1 + 0.8::DOUBLE, 75) - greatest(y0 - 0.8::DOUBLE, 0), 0) AS area FROM b)"""
ORACLES = {
    "text_folds": f"""
        SELECT doc_id, sha256({_COLLAPSE.format(x='text')}) AS collapsed, sha256(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z0-9]', '', 'g')) AS identifier,
               regexp_replace(text, '[^0-9]', '', 'g') AS digits, sha256({_FOLD.format(x='text')}) AS label,
               len(list_filter(list_distinct(string_split({_FOLD.format(x='text')}, ' ')), lambda w: w <> '')) AS n_words FROM documents""",
    "part_codes": r"""
        SELECT p_partkey, regexp_replace(upper(p_type), '\s+', '', 'g') AS code, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
               translate(p_brand, 'OoQDIlL|SsBZz', '0000111155822') AS glyphs,
               regexp_full_match(right(regexp_replace(upper(p_brand), '\s+', '', 'g'), 5), '([0-9]{5}|[0-9]{4}[A-Z]|[A-Z][0-9]{4})') AS procedure_ok,
               regexp_full_match(left(regexp_replace(upper(p_type), '\s+', '', 'g'), 3), '[A-TV-Z][0-9A-Z]{2}(\.?[0-9A-Z]{1,4})?') AS icd_ok,
               list_last(regexp_extract_all(p_name || ' ' || p_retailprice::DECIMAL(18,2), '-?\d+(?:\.\d{2})?')) AS amount FROM part""",
    "money_text": "SELECT c_custkey, c_acctbal::DECIMAL(18,2)::DOUBLE AS amount FROM customer",
    "date_text": "SELECT o_orderkey, o_orderdate::DATE AS day, (o_orderdate + CASE WHEN year(o_orderdate) < 2000 THEN INTERVAL 100 YEAR ELSE INTERVAL 0 YEAR END)::DATE AS service_day FROM orders",
    "provider_numbers": f"""
        WITH n AS (SELECT s_suppkey, lpad((s_suppkey * 7919 + 1000000007)::VARCHAR, 10, '0') AS x FROM supplier),
        t AS (SELECT s_suppkey, x, '80840' || x AS full_x FROM n),
        r AS (SELECT s_suppkey, p || right(x, 9) AS y, '80840' || p || right(x, 9) AS full_y FROM n, unnest(['1','2','3','4','5','6','7','8','9']) u(p)),
        ok AS (SELECT s_suppkey, y FROM r WHERE {_LUHN.format(x='full_y')} % 10 = 0),
        one AS (SELECT s_suppkey, any_value(y) AS y FROM ok GROUP BY 1 HAVING count(*) = 1)
        SELECT s_suppkey, {_LUHN.format(x='x')} AS checksum, {_LUHN.format(x='full_x')} % 10 = 0 AS valid, coalesce(y, '') AS repaired FROM t LEFT JOIN one USING (s_suppkey)""",
    "name_keys": """
        SELECT c_custkey, trim(regexp_replace(regexp_replace(upper(split_part(replace(c_name, '#', ' '), ' ', 1) || ' ' || split_part(replace(c_name, '#', ' '), ' ', -1)), '[^A-Z ]', ' ', 'g'), ' +', ' ', 'g')) AS key,
               c_custkey % 7 = 0 AS contaminated FROM customer""",
    "error_rates": "SELECT p_partkey, round(levenshtein(lower(p_brand), lower(p_type)) / length(p_brand), 6) AS rate FROM part",
    "redacted_events": "SELECT '[REDACTED]' AS member, event_type AS kind, count(*) AS n FROM events GROUP BY event_type",
    "typed_values": r"""
        WITH w AS (SELECT v, count(*) AS n FROM (SELECT trim(unnest(regexp_split_to_array(text, '[ \n]+'))) AS v FROM documents) WHERE v <> '' GROUP BY 1),
        p AS (SELECT n, regexp_matches(v, '\d') AS d, regexp_matches(v, '[A-Za-z]') AS l, regexp_full_match(v, '(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{2}-\d{2})') AS date,
                     regexp_full_match(v, '\$?-?[0-9,]+(\.\d{2})?') AS amount, regexp_full_match(v, '\d+') AS digits, regexp_full_match(v, '[A-Z0-9.]{3,8}') AS code, regexp_full_match(v, '[A-Za-z][A-Za-z ,.''-]+') AS name FROM w),
        s AS (SELECT n, unnest([{'k': 'date', 'ok': date, 'part': d}, {'k': 'amount', 'ok': amount, 'part': d}, {'k': 'digits', 'ok': digits, 'part': d}, {'k': 'code', 'ok': code, 'part': l}, {'k': 'name', 'ok': name, 'part': l}]) AS x FROM p)
        SELECT x.k AS kind, coalesce(sum(n) FILTER (x.ok), 0)::BIGINT AS valid, round(sum(n * CASE WHEN x.ok THEN 1 WHEN x.part THEN 0.5 ELSE 0 END), 2) AS score FROM s GROUP BY 1""",
    "box_overlaps": f"""
        WITH {_BOX} SELECT l_linenumber, round(sum(ov / (own + 625 - ov)), 4) AS iou, round(sum(ov / own), 4) AS inside, round(sum(area), 4) AS area,
               count(*) FILTER (ov / (own + 625 - ov) >= 0.5) AS n_half FROM o GROUP BY l_linenumber""",
    "embedding_cosine": """
        WITH f AS (SELECT label, arg_min(embedding, vec_id) AS base FROM embeddings GROUP BY label)
        SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], base::DOUBLE[]), 4) AS cosine FROM embeddings JOIN f USING (label)""",
    "hashes": """
        WITH p AS (SELECT *, ('0x' || substr(sha256('17:' || source), 1, 8))::BIGINT % 100 AS percent FROM documents)
        SELECT doc_id, sha256(text) AS content, substr(sha256(doc_id || '|' || lang || '|' || source), 1, 24) AS candidate, percent,
               CASE WHEN percent < 70 THEN 'train' WHEN percent < 85 THEN 'calibration' ELSE 'holdout' END AS split FROM p""",
    "label_phrases": f"""
        WITH f AS (SELECT lang, ' ' || {_FOLD.format(x='text')} || ' ' AS t FROM documents)
        SELECT lang, count(*) FILTER (contains(t, ' all rights reserved ')) AS rights, count(*) FILTER (contains(t, ' mit license ')) AS mit FROM f GROUP BY lang""",
}
