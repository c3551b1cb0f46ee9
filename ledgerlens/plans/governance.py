"""Matching and governance queries over customers, suppliers, documents and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.functions.values import split_of
from ledgerlens.operators import governance as G, matching as M
from ledgerlens.session import table


def reference_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Customers checked against the suppliers of their nation whose balance has the same hundreds: one and in credit is verified."""
    band = lambda c: F.floor(F.col(c) / 100).alias("band")
    requests = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), band("c_acctbal"), "c_acctbal")
    records = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), band("s_acctbal"), "s_acctbal")
    out = M.reference_decision(requests, records, ["nation", "band"], F.col("s_acctbal") > 0, F.col("c_acctbal") <= F.col("s_acctbal"))
    return out.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def best_supplier(spark: SparkSession, d: str) -> DataFrame:
    """The supplier of each customer's nation that is most alike by balance and number."""
    left = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    right = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    same = (F.col("c_custkey") % 10, F.col("s_suppkey") % 10)
    return M.best_near(left, right, ["nation"], "c_custkey", "s_suppkey", ("c_acctbal", "s_acctbal"), 10000.0, same, (0.7, 0.3), 0.9)


def name_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Likeness of part names within a brand and size by matching blocks, for different names, and the parts of each name."""
    found = M.name_similarity(table(spark, d, "part"), ["p_brand", "p_size"], "p_partkey", "p_name")
    return found.withColumns({"ratio": F.round("ratio", 6), "reverse": F.round("reverse", 6)})


#: Bits in which hashes of near vectors may differ.
NEAR_BITS = 4


def _vector_hash(e: DataFrame) -> DataFrame:
    """Signs of the sums of every 64th number of each vector as a hash."""
    every = lambda k: F.aggregate(F.filter("embedding", lambda v, i: i % 64 == k), F.lit(0.0), lambda a, v: a + v)
    bits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(every(k) > 0, "1").otherwise("0")), "")
    half = lambda k: F.lpad(F.lower(F.conv(F.substring(bits, k, 32), 2, 16)), 8, "0")
    return e.select("vec_id", F.concat(half(1), half(33)).alias("h"))


def near_hash_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near vectors; to one vector in ten a copy is added with two numbers turned."""
    own = table(spark, d, "embeddings").select("vec_id", "embedding")
    turned = F.transform("embedding", lambda v, i: F.when(i < 2, -v).otherwise(v))
    copies = own.filter("vec_id % 10 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), turned.alias("embedding"))
    return M.near_hash_pairs(_vector_hash(own.unionByName(copies)), "vec_id", "h", NEAR_BITS)


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of an order's lines from different suppliers with one flag."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_suppkey")
    return M.pairs_within(rows, ["l_orderkey", "l_returnflag"], "l_linenumber", "l_suppkey").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("pairs"))


def discount_bands(spark: SparkSession, d: str) -> DataFrame:
    bands = spark.createDataFrame([("low", 0.0, 10.5), ("middle", 10.5, 30.5), ("high", 30.5, 45.5)], "band string, low double, high double")
    out = M.band_join(table(spark, d, "lineitem"), bands, "l_quantity", "low", "high")
    return out.groupBy(F.coalesce("band", F.lit("NONE")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


def nearest_supplier(spark: SparkSession, d: str) -> DataFrame:
    """The supplier of its nation whose balance is nearest to each customer's."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    return M.nearest(c, s, ["nation"], "c_custkey", "s_suppkey", "c_acctbal", "s_acctbal").select("c_custkey", "s_suppkey", F.round("distance", 2).alias("distance"))


def following_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns up to two after each system turn."""
    t = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return M.following(t, t.filter("role = 'system'"), "conv_id", "turn").groupBy("offset", "role").agg(F.count(F.lit(1)).alias("n"))


def overlapping_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of order lines that overlap boxes of other lines of the order."""
    x = F.col("l_quantity").cast("double")
    boxes = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("id"), x.alias("x0"), (F.col("l_linenumber") * 4.0).alias("y0"), (x + 10).alias("x1"), (F.col("l_linenumber") * 4.0 + 6).alias("y1"))
    return M.overlapping(boxes, boxes, "l_orderkey", 8.0).filter("id_a < id_b").groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n"))


def complete_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders by how many of the flags A, N and R their lines have."""
    flags = spark.createDataFrame([("A",), ("N",), ("R",)], "l_returnflag string")
    out = M.all_cells(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), flags, table(spark, d, "lineitem"), ["l_orderkey"], "l_returnflag")
    return out.groupBy("done", "complete").agg(F.count(F.lit(1)).alias("orders"))


def merged_routes(spark: SparkSession, d: str) -> DataFrame:
    """Labels of documents, and the language rule's for those without."""
    first = table(spark, d, "labels").select("doc_id", F.col("quality").alias("value"))
    second = table(spark, d, "documents").select("doc_id", (F.col("lang") == "en").cast("int").alias("value"))
    return M.merge_routes(first, second, ["doc_id"])


def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    """Texts that a split by document would put in several splits."""
    rows = table(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), split_of(F.col("doc_id").cast("string")).alias("split"))
    return G.split_leakage(rows, "digest", "split")


def representation_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Types and sizes of parts with fewer than eight brands; every type could have every size."""
    rows = table(spark, d, "part").select("p_brand", F.concat_ws(" ", "p_type", "p_size").alias("leaf"))
    sizes = table(spark, d, "part").agg(F.sequence(F.min("p_size"), F.max("p_size")).alias("sizes"))
    leaves = table(spark, d, "part").select("p_type").distinct().crossJoin(sizes).select("p_type", F.explode("sizes").alias("size")).select(F.concat_ws(" ", "p_type", "size").alias("leaf"))
    return G.representation_gaps(leaves, rows, "leaf", "p_brand", 8)


def concentration(spark: SparkSession, d: str) -> DataFrame:
    return G.concentration(table(spark, d, "documents"), "source", "lang", 0.6)


def population_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Users' kinds of event that many users share and that once had a high value."""
    out = G.population_consensus(table(spark, d, "events"), "event_type", "user_id", F.col("value") > 20)
    return out.groupBy("event_type", "documents").agg(F.count(F.lit(1)).alias("n"))


def split_manifest(spark: SparkSession, d: str) -> DataFrame:
    return G.split_manifest(table(spark, d, "documents"), "doc_id", "source")


def dataset_mark(spark: SparkSession, d: str) -> DataFrame:
    return G.dataset_mark(table(spark, d, "documents"), ["doc_id", "lang", "source", "text"])


def replay_differences(spark: SparkSession, d: str) -> DataFrame:
    """A replay in which every hundredth label is turned around."""
    frozen = table(spark, d, "labels").select("doc_id", "quality")
    replayed = frozen.withColumn("quality", F.when(F.col("doc_id") % 100 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    return G.replay_differences(frozen, replayed)


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents of three quarters of the sources, one for each text, with their splits."""
    rows = table(spark, d, "documents").select("doc_id", F.lit("lang").alias("field"), F.col("lang").alias("value"), F.sha2("text", 256).alias("digest"), "source")
    return G.training_rows(rows, "doc_id", "field", "value", "digest", ~F.col("source").like("%5")).select("doc_id", "value", "split")


def label_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as labels of users: repeated ids, contradictions, and large values without a second reviewer."""
    e = table(spark, d, "events").select((F.col("event_id") % 9000).alias("id"), "user_id", "event_type", "value", "event_id")
    e = e.withColumns({"reviewer": (F.col("event_id") % 3).cast("string"), "second": F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 5).cast("string"))})
    out = G.label_log(e, "id", "user_id", "event_type", F.col("value") > 20, "reviewer", "second", "event_id")
    return out.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def paired_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Parts' first two lines by supplier as reviews."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return G.paired_reviews(rows, "l_partkey", "l_suppkey", "l_returnflag", "at").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def passage_leakage(spark: SparkSession, d: str) -> DataFrame:
    return G.passage_leakage(table(spark, d, "documents"), table(spark, d, "benchmark"), "doc_id", "text", "item_id", "text").withColumnsRenamed({"document": "doc_id", "passage": "item_id"})


QUERIES = {
    f.__name__: f
    for f in (
        reference_decisions, best_supplier, name_similarity, near_hash_pairs, candidate_pairs, discount_bands, nearest_supplier, following_turns,
        overlapping_boxes, complete_orders, merged_routes, split_leakage, representation_gaps, concentration, population_consensus, split_manifest,
        dataset_mark, replay_differences, training_rows, label_log, paired_reviews, passage_leakage,
    )
}
_SPLIT = "CASE WHEN ('0x' || substr(sha256('17:' || {k}), 1, 8))::BIGINT % 100 < 70 THEN 'train' WHEN ('0x' || substr(sha256('17:' || {k}), 1, 8))::BIGINT % 100 < 85 THEN 'calibration' ELSE 'holdout' END"
_FOLD = r"trim(regexp_replace(replace(lower(coalesce({x}, '')), '|', 'i'), '[^a-z0-9]+', ' ', 'g'))"
ORACLES = {
    "reference_decisions": """
        WITH r AS (SELECT s_nationkey AS n, floor(s_acctbal / 100) AS f, count(*) AS k, bool_and(s_acctbal > 0) AS ok, any_value(s_acctbal) AS b FROM supplier GROUP BY 1, 2)
        SELECT CASE WHEN k IS NULL THEN 'MISSING' WHEN k > 1 THEN 'AMBIGUOUS' WHEN NOT ok THEN 'UNAUTHORISED' WHEN NOT c_acctbal <= b THEN 'CONTRADICTION' ELSE 'VERIFIED' END AS verdict,
               count(*) AS n FROM customer LEFT JOIN r ON c_nationkey = r.n AND floor(c_acctbal / 100) = r.f GROUP BY 1""",
    "best_supplier": """
        WITH p AS (SELECT c_custkey, s_suppkey, 1 - least(abs(c_acctbal - s_acctbal) / 10000, 1) AS b, (c_custkey % 10 = s_suppkey % 10)::INT AS k
                   FROM customer JOIN supplier ON c_nationkey = s_nationkey),
        s AS (SELECT *, round((b * 0.7::DOUBLE + k * 0.3::DOUBLE) / (0.7::DOUBLE + 0.3::DOUBLE), 8) AS score FROM p)
        SELECT c_custkey, s_suppkey, score, score >= 0.9 AND (b = 1 OR k = 1) AS verified FROM s
        QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, s_suppkey) = 1""",
    "near_hash_pairs": f"""
        WITH e AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + 1000000, [-embedding[1], -embedding[2]] || embedding[3:] FROM embeddings WHERE vec_id % 10 = 0),
        h AS (SELECT vec_id, list_transform(range(1, 65), lambda k: (list_sum([embedding[i] FOR i IN range(k, len(embedding) + 1, 64)]) > 0)::INT) AS b FROM e),
        p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_sum(list_transform(range(1, 65), lambda k: (x.b[k] <> y.b[k])::INT))::INT AS distance FROM h x JOIN h y ON x.vec_id < y.vec_id)
        SELECT * FROM p WHERE distance <= {NEAR_BITS}""",
    "candidate_pairs": """
        SELECT l_returnflag, count(*) AS pairs FROM lineitem x JOIN lineitem y USING (l_orderkey, l_returnflag)
        WHERE x.l_linenumber < y.l_linenumber AND x.l_suppkey <> y.l_suppkey GROUP BY 1""",
    "discount_bands": """
        SELECT CASE WHEN l_quantity >= 0 AND l_quantity < 10.5 THEN 'low' WHEN l_quantity >= 10.5 AND l_quantity < 30.5 THEN 'middle'
                    WHEN l_quantity >= 30.5 AND l_quantity < 45.5 THEN 'high' ELSE 'NONE' END AS band, count(*) AS n FROM lineitem GROUP BY 1""",
    "nearest_supplier": """
        SELECT c_custkey, s_suppkey, round(abs(c_acctbal - s_acctbal), 2) AS distance FROM customer JOIN supplier ON c_nationkey = s_nationkey
        QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY round(abs(c_acctbal - s_acctbal), 6), s_suppkey) = 1""",
    "following_turns": """
        SELECT y.turn - x.turn AS "offset", y.role, count(*) AS n FROM conversations x JOIN conversations y USING (conv_id)
        WHERE x.role = 'system' AND y.turn - x.turn BETWEEN 0 AND 2 GROUP BY 1, 2""",
    "overlapping_boxes": """
        WITH b AS (SELECT l_orderkey, l_linenumber AS id, l_quantity AS x0, l_linenumber * 4 AS y0, l_quantity + 10 AS x1, l_linenumber * 4 + 6 AS y1 FROM lineitem),
        p AS (SELECT DISTINCT a.l_orderkey, a.id AS id_a, b.id AS id_b FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.id < b.id
              WHERE a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1)
        SELECT id_a, id_b, count(*) AS n FROM p GROUP BY 1, 2""",
    "complete_orders": """
        WITH f AS (SELECT o_orderkey, count(DISTINCT l_returnflag) FILTER (l_returnflag IN ('A', 'N', 'R')) AS done FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
        SELECT done, done = 3 AS complete, count(*) AS orders FROM f GROUP BY 1, 2""",
    "merged_routes": """
        SELECT doc_id, quality AS value FROM labels
        UNION ALL SELECT doc_id, (lang = 'en')::INT FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "split_leakage": f"""
        WITH s AS (SELECT sha256(text) AS digest, {_SPLIT.format(k='doc_id')} AS split FROM documents)
        SELECT digest, count(DISTINCT split) AS splits, count(*) AS n FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1""",
    "representation_gaps": """
        WITH l AS (SELECT DISTINCT p_type || ' ' || s AS leaf FROM part, (SELECT unnest(generate_series(min(p_size), max(p_size))) AS s FROM part)),
        c AS (SELECT p_type || ' ' || p_size AS leaf, count(DISTINCT p_brand) AS sources FROM part GROUP BY 1)
        SELECT leaf, coalesce(sources, 0) AS sources FROM l LEFT JOIN c USING (leaf) WHERE coalesce(sources, 0) < 8""",
    "concentration": """
        WITH c AS (SELECT source, lang, count(*) AS k FROM documents GROUP BY ALL)
        SELECT source, sum(k)::BIGINT AS n, count(*) AS sources, round(max(k) / sum(k), 6) AS top_share, max(k) / sum(k) > 0.6 AND sum(k) >= 20 AS concentrated FROM c GROUP BY source""",
    "population_consensus": """
        WITH g AS (SELECT event_type, count(DISTINCT user_id) AS documents FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 3 AND bool_or(value > 20))
        SELECT event_type, documents, count(*) AS n FROM events JOIN g USING (event_type) GROUP BY 1, 2""",
    "split_manifest": f"""
        WITH s AS (SELECT doc_id::VARCHAR AS id, source, {_SPLIT.format(k='source')} AS split, substr(sha256(doc_id::VARCHAR), 1, 2) AS part FROM documents),
        p AS (SELECT split, part, count(*) AS n, sha256(string_agg(id, chr(10) ORDER BY id)) AS digest FROM s GROUP BY 1, 2),
        d AS (SELECT split, sum(n)::BIGINT AS n, sha256(string_agg(digest, chr(10) ORDER BY part)) AS digest FROM p GROUP BY 1)
        SELECT split, n, groups, digest FROM d JOIN (SELECT split, count(DISTINCT source) AS groups FROM s GROUP BY 1) USING (split)""",
    "dataset_mark": "SELECT count(*) AS n, sum(('0x' || substr(sha256(concat_ws('|', doc_id, lang, source, text)), 1, 15))::BIGINT)::VARCHAR AS mark FROM documents",
    "replay_differences": """
        SELECT doc_id, quality, 'frozen' AS side FROM labels WHERE doc_id % 100 = 0
        UNION ALL SELECT doc_id, 1 - quality, 'replayed' FROM labels WHERE doc_id % 100 = 0""",
    "training_rows": f"""
        SELECT doc_id, lang AS value, {_SPLIT.format(k='doc_id')} AS split FROM documents WHERE source NOT LIKE '%5'
        QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1""",
    "label_log": """
        WITH e AS (SELECT *, event_id % 9000 AS id, event_id % 3 AS reviewer, CASE WHEN event_id % 2 = 0 THEN event_id % 5 END AS second FROM events),
        v AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id) AS nth, first(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS f FROM e)
        SELECT CASE WHEN nth > 1 THEN 'DUPLICATE' WHEN event_type <> f THEN 'CONTRADICTS' WHEN value > 20 AND (second IS NULL OR second = reviewer) THEN 'NEEDS_SECOND' ELSE 'APPROVED' END AS verdict,
               count(*) AS n FROM v GROUP BY 1""",
    "paired_reviews": """
        WITH r AS (SELECT l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber, l_suppkey) AS k FROM lineitem),
        p AS (SELECT l_partkey, max(l_returnflag) FILTER (k = 1) AS a, max(l_returnflag) FILTER (k = 2) AS b FROM r GROUP BY 1)
        SELECT CASE WHEN b IS NULL THEN 'PENDING' WHEN a = b THEN 'AGREED' ELSE 'ADJUDICATE' END AS state, count(*) AS n FROM p GROUP BY 1""",
    "passage_leakage": f"""
        WITH d AS (SELECT doc_id, ' ' || {_FOLD.format(x='text')} || ' ' AS t FROM documents), b AS (SELECT item_id, {_FOLD.format(x='text')} AS p FROM benchmark)
        SELECT doc_id, item_id FROM d JOIN b ON contains(t, ' ' || p || ' ') WHERE len(string_split(p, ' ')) >= 8""",
}
