"""Near-duplicate detection by MinHash with banding, verification and connected components.

1. A document's set is the set of hashes of its ``shingle``-word shingles. Documents with equal sets are one class
   (by a 128-bit digest of the set and its size); the smallest id represents it. Only classes go on, so exact copies,
   however many, cost one aggregation with map-side combine.
2. A class has ``bands`` x ``rows`` universal hash minima; the hash of each band's minima is a bucket key.
3. Buckets of at most ``small`` classes give all their pairs. A larger bucket gives pairs of its members with one
   center, as many as it has members. Texts of buckets that aren't in one component then are joined on their rarest
   shingles (prefix filtering, which is exact): first one text of each component, then all pairs that are still between
   different components. So no link is lost to bucket size, and pairs within a component aren't spelled out.
   Texts of different components that share rare shingles are compared one by one, by their minima first: a family of
   n texts made of the same passages, just under the similarity, costs n * n such comparisons, in blocks of a shingle's
   texts. Keys of very many rows are joined by broadcast (``skew``) or in blocks, so that none is a task of its own.
4. Candidates whose sizes or minima can't reach the similarity are dropped (the estimate must be ``slack`` below it to
   drop a pair, five standard deviations); the others are confirmed on full sets, recomputed from whole texts.
5. Confirmed links are joined to components by alternating large-star and small-star.

With 36 bands of 5 minima a pair at similarity 0.8 shares no bucket with probability 6e-7.

Defined results: null, empty and blank texts have no shingles, are linked with nothing and kept; fewer words than
``shingle`` give one shingle of all words; a row with null id joins no link but that of equal sets, its component is
the smallest id reachable or null, and it is not kept; rows that repeat an id share its component; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ledgerlens.llm.arrow import bound_batches, mix, odd_numbers, words
from ledgerlens.llm.graph import components
from ledgerlens.llm.skew import join_facts
from ledgerlens.session import materialize, table

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 36, 5
SMALL = 8
#: Ids of candidate texts are broadcast up to this many bytes.
BROADCAST_BYTES = 32 << 20
#: Texts with one shingle that one task compares with all others of the shingle.
PAIR_BLOCK = 1024
SLACK = 0.16

_PLACES = odd_numbers(64, 41)
_A = odd_numbers(1024, 42).astype(np.uint32) | np.uint32(1)
_B = odd_numbers(1024, 43).astype(np.uint32)
_DIGEST = odd_numbers(2, 44)


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for found in words(texts):
        hashes, first = found.hashes, found.first
        n = np.diff(first)
        every = np.zeros(max(0, len(hashes) - shingle + 1), np.uint64)
        for k in range(shingle):
            every += hashes[k : k + len(every)] * _PLACES[k]
        every = mix(every)
        for row in range(len(n)):
            if n[row] >= shingle:
                part = np.sort(every[first[row] : first[row + 1] - shingle + 1])
                yield part[np.r_[True, part[1:] != part[:-1]]]
            elif n[row]:
                own = hashes[first[row] : first[row + 1]]
                yield mix(np.array([(own * _PLACES[: len(own)]).sum() + np.uint64(len(own))], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def minima(shingles: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each of n universal hashes over a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        values = x[at : at + 512, None] * _A[:n]
        values += _B[:n]
        np.minimum(out, values.min(axis=0), out=out)
    return out


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that stand for a set."""
    first = mix(shingles * _DIGEST[0]).sum(dtype=np.uint64)
    second = mix(shingles ^ _DIGEST[1]).sum(dtype=np.uint64)
    return int(first.view(np.int64)), int(second.view(np.int64))


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """id, n, d1, d2 (the set's digest), minima (16 bits of each), keys (of the bands) for each row of ``docs``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            n, d1, d2, low, keys = [], [], [], [], []
            for found in shingle_sets(batch.column(1), shingle):
                n.append(len(found))
                a, b = set_digest(found)
                d1.append(a)
                d2.append(b)
                if len(found):
                    own = minima(found, bands * rows)
                    low.append(own.astype(np.uint16).tobytes())
                    hashed = (own.reshape(bands, rows).astype(np.uint64) * _PLACES[:rows]).sum(axis=1, dtype=np.uint64)
                    keys.append(mix(hashed * np.uint64(64) + band * _PLACES[9]).view(np.int64))
                else:
                    low.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(low, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "n", "d1", "d2", "minima", "keys"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(sign, f"id {kind}, n long, d1 long, d2 long, minima binary, keys array<long>")


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int, slack: float) -> DataFrame:
    """The pairs (low, high) that sizes and minima allow to be similar."""
    side = lambda name: nodes.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("minima").alias(f"m_{name}"))
    joined = pairs.join(side("low"), "low").join(side("high"), "high")
    joined = joined.filter(F.least("n_low", "n_high") * 100 >= F.greatest("n_low", "n_high") * percent)
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["low", "high"]).filter(pa.array((a == b).mean(axis=1) >= percent / 100 - slack))

    return joined.select("low", "high", "m_low", "m_high").mapInArrow(compare, f"low {kinds['low']}, high {kinds['high']}")


def candidate_texts(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text of the rows of ``docs`` that ``ids`` names; the ids are broadcast only if small enough."""
    size = F.octet_length(F.col("id").cast("string")) if ids.schema["id"].dataType.simpleString() in ("string", "binary") else F.lit(0)
    if (ids.agg(F.sum(size + 16)).first()[0] or 0) <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return materialize(texts.join(ids, "id", "left_semi"), "near-texts")


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (low, high) whose texts' full sets are similar."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    joined = pairs.join(texts.select(F.col("id").alias("low"), F.col("text").alias("a")), "low")
    joined = joined.join(texts.select(F.col("id").alias("high"), F.col("text").alias("b")), "high").select("low", "high", "a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = []
            for a, b in zip(shingle_sets(batch.column(2), shingle), shingle_sets(batch.column(3), shingle), strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                similar.append(both * 100 >= percent * (len(a) + len(b) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["low", "high"]).filter(pa.array(similar, pa.bool_()))

    return joined.mapInArrow(compare, f"low {kinds['low']}, high {kinds['high']}").distinct()


def still_open(entries: DataFrame) -> DataFrame:
    """The entries (key, id, members, component) of buckets with more than one component."""
    entries = materialize(entries, "near-many")
    split = entries.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("last"), F.max("members").alias("members"))
    split = materialize(split.filter("first <> last").select("key", "members"), "near-split")
    return materialize(join_facts(entries.drop("members"), split, ["key"]), "near-open")


def prefixes(entries: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """shingle, texts, id, component, n and place: of each open text its rarest shingles, so many that similar texts share one of them.

    Texts of n and m shingles need percent / (100 + percent) of n + m in common; m is at least percent of n and at least
    the smallest size in the buckets. If fewer than that many of a text's shingles come after its prefix, in one order
    of all shingles by rarity, two similar texts have a shingle of both prefixes in common. One order, by the number of
    open texts with a shingle, puts what is peculiar to a text first, and what only one has is left out.
    """
    kind = entries.schema["id"].dataType.simpleString()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), shingle))
            row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
            every = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(every)], ["id", "shingle"])

    sized = materialize(entries.join(nodes.select("id", "n"), "id"), "near-sized")
    least = materialize(sized.groupBy("key").agg(F.min("n").alias("least"), F.max("members").alias("members")), "near-least")
    facts = join_facts(sized.drop("members"), least, ["key"]).groupBy("id").agg(F.first("n").alias("n"), F.min("least").alias("least"), F.first("component").alias("component"))
    smallest = F.greatest(F.ceil(F.col("n") * percent / 100.0), F.col("least"))
    common = F.ceil((F.col("n") + smallest) * percent / F.lit(100.0 + percent))
    facts = facts.select("id", "component", "n", (F.col("n") - common + 1).alias("prefix"))
    spelled = materialize(texts.join(facts.select("id"), "id", "left_semi").select("id", "text").mapInArrow(spell, f"id {kind}, shingle long"), "near-spelled")
    texts_of = materialize(spelled.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")), "near-shingles")
    counted = join_facts(spelled, texts_of, ["shingle"], "texts")
    place = F.row_number().over(W.partitionBy("id").orderBy("texts", "shingle"))
    return counted.withColumn("place", place).join(facts, "id").filter("place <= prefix and texts > 1").select("shingle", "texts", "id", "component", "n", "place")


def prefix_pairs(rare: DataFrame, percent: int) -> DataFrame:
    """x and id of different components that share a shingle in the prefixes which their two sizes call for.

    What precedes the shared shingle, and what follows it, can hold no more in common than the shorter part has. The
    texts of a frequent shingle are dealt to blocks, each of which meets all of them.
    """
    blocks = F.ceil(F.col("texts") / PAIR_BLOCK)
    left = rare.withColumn("block", F.pmod(F.xxhash64("id"), blocks)).withColumnsRenamed({"id": "x", "component": "cx", "n": "nx", "place": "px"}).drop("texts")
    rare = rare.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    common = F.ceil((F.col("nx") + F.col("n")) * percent / F.lit(100.0 + percent))
    most = F.least("px", "place") + F.least(F.col("nx") - F.col("px"), F.col("n") - F.col("place"))
    near = (F.col("px") <= F.col("nx") - common + 1) & (F.col("place") <= F.col("n") - common + 1) & (most >= common)
    return left.join(rare, (left.shingle == rare.shingle) & (left.block == rare.block) & (F.col("x") < F.col("id")) & (F.col("cx") != F.col("component")) & near).select("x", "id")


def closest_of_each(rare: DataFrame) -> DataFrame:
    """Of each shingle and component the text with the fewest rarer shingles: one stands for all to join components by."""
    return rare.groupBy("shingle", "component").agg(F.min(F.struct("place", "id", "n", "texts")).alias("r")).select("shingle", "r.texts", "component", "r.id", "r.n", "r.place")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS,
    rows: int = ROWS, small: int = SMALL, slack: float = SLACK,
) -> DataFrame:
    """id_col, n_shingles, component_id and kept for every row of ``docs``."""
    bound_batches(docs.sparkSession)
    signed = materialize(signatures(docs, id_col, text_col, shingle, bands, rows), "near-signed")
    classes = materialize(signed.filter("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members")), "near-classes")
    match = ["n", "d1", "d2"]
    reps = classes.filter("rep is not null").withColumnRenamed("rep", "id").drop("members")
    nodes = materialize(signed.join(reps, [*match, "id"], "left_semi").dropDuplicates(["id"]), "near-nodes")

    entries = nodes.select("id", F.explode("keys").alias("key"))
    buckets = materialize(entries.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("center")).filter("members > 1"), "near-buckets")
    shared = materialize(join_facts(entries, buckets, ["key"]), "near-entries")
    texts = candidate_texts(docs, materialize(shared.select("id").distinct(), "near-ids"), id_col, text_col)

    def pairs_of(frame: DataFrame, a: str, b: str) -> DataFrame:
        return frame.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).filter("low <> high")

    def links(pairs: DataFrame) -> DataFrame:
        likely = plausible(pairs.distinct(), nodes, percent, slack)
        return materialize(confirm(likely, texts, shingle, percent), "near-links")

    few = shared.filter(F.col("members") <= small).groupBy("key").agg(F.collect_list("id").alias("ids"))
    few = few.select(F.explode("ids").alias("x"), "ids").select("x", F.explode("ids").alias("y")).filter("x < y")
    many = shared.filter(F.col("members") > small).select("key", "id", "center", "members")
    found = links(pairs_of(few, "x", "y").union(pairs_of(many, "id", "center")))
    grouped = components(found)

    def component_of(rows: DataFrame) -> DataFrame:
        named = rows.join(grouped, F.col("id") == grouped.vertex, "left")
        return named.withColumn("component", F.coalesce("component", "id")).drop("vertex")

    apart = still_open(component_of(many.select("key", "id", "members")))
    if not apart.isEmpty():
        # First one text for each shingle and component, which joins large components that are one; then all that is left.
        rare = materialize(prefixes(apart, texts, nodes, shingle, percent), "near-prefixes")
        for chosen in (closest_of_each, lambda rows: rows):
            found = found.union(links(pairs_of(prefix_pairs(chosen(rare), percent), "x", "id")))
            grouped = components(found)
            rare = component_of(rare.drop("component")).select(*rare.columns)

    of_class = classes.join(grouped, classes.rep == grouped.vertex, "left").select(*match, "members", F.coalesce("component", "rep").alias("component_id"))
    rows_of = signed.select("id", *match)
    with_set = join_facts(rows_of.filter("n > 0"), materialize(of_class, "near-components"), match).select("id", "n", "component_id")
    every = with_set.unionByName(rows_of.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return every.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay: of each component the document with the smallest id.

    Rows with null id stay; they have no place in a component.
    """
    found = near_duplicates(docs, id_col, text_col, **how)
    gone = found.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    gone = materialize(gone, "near-gone")
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents``: four-word shingles, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


QUERIES = {"op5_near_dedup": op5_near_dedup}
ORACLES: dict[str, str] = {}
