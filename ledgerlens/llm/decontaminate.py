"""Benchmark decontamination by latent semantic retrieval.

1. Space: passages of all documents are term-frequency rows over ``FEATURES`` hashed words. A random sign sketch adds
   each passage to one of ``SKETCH`` rows; sketch and document frequencies are sums, so map tasks combine their own
   passages and a two-level reduction adds the tasks' sums. Scaled by inverse document frequency, the sketch's right
   singular vectors are the randomised SVD of the TF-IDF matrix; the first ``RANK`` of them are the latent space. A
   vector also keeps ``RANK`` random projections of what lies outside that space, as rare words do.
   Words are runs of letters and digits in lower case. Words in a run of ``MIN_WORDS`` words that an item holds count
   nowhere in the space, so copies of an item don't lower the weight of its words.
2. Retrieval: windows of ``WINDOW`` words, ``STRIDE`` apart, over whole documents are compared by cosine with those of
   the benchmark items; benchmark vectors go to the workers in blocks of about ``BLOCK_WORDS`` words. Besides, every
   run of ``MIN_WORDS`` words that a document shares with an item makes the place where the item would begin a
   candidate, whatever the cosine: no verbatim copy is missed.
3. Checks: for a candidate the longest common subsequence of the item's words and the words around the window
   must hold a share ``lcs`` of the item, and the item's answer (its last ``ANSWER`` words) a share ``answer``; a share
   of ``sure`` is enough alone. Paraphrases that keep most words in order are found so, not just copies. Items of fewer
   than ``SHORT`` words need ``STRICT`` shares, as a few common words in order are met by chance.
4. Items of fewer than ``MIN_WORDS`` words have no such checks: those of ``PHRASE`` words or more match texts that hold
   them as a run of words, shorter ones texts that consist of them.

Only the latent basis and the benchmark with its runs' hashes, which don't grow with the corpus, reach driver and workers; documents aren't
shuffled.

Defined results: null and empty texts match nothing, nor do items without words; very long texts are compared whole, a
block of their own; of windows that match alike the first is reported; equal items are each reported; rows that repeat an id are each compared and reported once for
each item; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerlens.llm.arrow import SIGNS, Words, bound_batches, mix, odd_numbers, words
from ledgerlens.session import table

FEATURE_BITS = 14
FEATURES = 1 << FEATURE_BITS
SKETCH, RANK = 128, 64
WINDOW, STRIDE = 32, 16
COSINE = 0.45
LCS, ANSWER_SHARE, SURE = 0.55, 0.33, 0.85
#: Least shares for items of fewer words than SHORT.
SHORT, STRICT = 16, (0.6, 0.5)
ANSWER = 6
MIN_WORDS, PHRASE = 6, 3
#: Words of the items of a block: it has about an eighth as many windows, of 512 bytes each.
BLOCK_WORDS = 1 << 16
#: The benchmark is read at once up to so many bytes, else as a stream.
BENCHMARK_BYTES = 64 << 20
#: Cosines that are held at once.
CELLS = 1 << 22
#: Partial sums of a sketch row, or of the document frequencies, at the first level of the reduction.
SALTS = 64

#: Pairs of a document's run and an item's that are handled at once.
RUN_PAIRS = 1 << 20
_FILTER_BITS = 22

_KEY = odd_numbers(2, 61)


def feature_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def run_hashes(found: Words, size: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of so many words of one text begin, and a hash of each."""
    every, owner = hashes_of(found), found.owner
    n = max(0, len(every) - size + 1)
    total = every[:n].copy()
    for k in range(1, size):
        total = total * _KEY[0] + every[k : k + n]
    at = np.flatnonzero(owner[:n] == owner[len(every) - n :])
    return at, mix(total[at])


class Runs:
    """Runs of MIN_WORDS words of benchmark items, in order of their hashes, with the item and the place of each."""

    def __init__(self, hashes: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], item[order], place[order]
        self.some = np.zeros(1 << _FILTER_BITS, bool)
        self.some[self.hashes >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where runs of a block begin that items hold, and the first and the number of equal ones."""
        at, hashes = run_hashes(found)
        maybe = self.some[hashes >> np.uint64(64 - _FILTER_BITS)]
        at, hashes = at[maybe], hashes[maybe]
        low = np.searchsorted(self.hashes, hashes, "left")
        size = np.searchsorted(self.hashes, hashes, "right") - low
        return at[size > 0], low[size > 0], size[size > 0]

    def held(self, found: Words) -> np.ndarray:
        """Whether each word of a block is in such a run."""
        at, _, _ = self.find(found)
        edge = np.zeros(len(found.starts) + 1, np.int64)
        edge[at] += 1
        edge[at + MIN_WORDS] -= 1
        return np.cumsum(edge[:-1]) > 0


def known_runs(benchmark: DataFrame, text_col: str) -> Runs:
    """The distinct runs of all items."""
    hashes = np.zeros(0, np.uint64)
    for block in item_blocks(benchmark, text_col, text_col):
        found = [run_hashes(f)[1] for f in words(pa.array([r[1] for r in block], pa.string()), apart=SIGNS)]
        hashes = np.unique(np.concatenate([hashes, *found]))
    return Runs(hashes, np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64))


def sketch_block(found: Words, seeds: np.ndarray, sketch: np.ndarray, df: np.ndarray, held: np.ndarray | None = None) -> int:
    """Adds a block's passages, without the words ``held``, to the sums; returns how many there were."""
    n = np.diff(found.first)
    passages = -(-n // WINDOW)
    first = np.cumsum(passages) - passages
    owner = found.owner
    passage = first[owner] + (np.arange(len(owner)) - found.first[owner]) // WINDOW
    total = int(passages.sum())
    text = np.repeat(np.arange(len(n)), passages)
    draw = mix(seeds[text] * _KEY[0] + (np.arange(total) - first[text]).astype(np.uint64) * _KEY[1])
    row, sign = (draw >> np.uint64(57)).astype(np.int64) % SKETCH, np.where(draw & np.uint64(1), 1, -1)
    feature = feature_of(hashes_of(found))
    if held is not None:
        passage, feature = passage[~held], feature[~held]
    np.add.at(sketch, row[passage] * FEATURES + feature, sign[passage].astype(np.int32))
    pairs = passage * FEATURES + feature
    pairs = np.sort(pairs.astype(np.int32) if total < 1 << (31 - FEATURE_BITS) else pairs)
    df += np.bincount(pairs[np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)]] % FEATURES, minlength=FEATURES)
    return total


@dataclass
class Space:
    """Vectors of words: inverse document frequency times the latent basis, and times random directions; a zero last."""

    vectors: np.ndarray

    def windows(self, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of all windows, the text of each, and each one's first word."""
        n = np.diff(found.first)
        strides = -(-n // STRIDE)
        owner = np.repeat(np.arange(len(n)), strides)
        if not len(owner):
            return np.zeros((0, self.vectors.shape[1]), np.float32), owner, owner
        order = np.arange(len(owner)) - np.repeat(np.cumsum(strides) - strides, strides)
        begin = found.first[owner] + order * STRIDE
        # The words of each stride as a row; places after a text's end have the last vector, which is zero.
        features = np.append(feature_of(hashes_of(found)), FEATURES)
        stop = found.first[owner + 1]
        sums = self.vectors.take(features[begin], axis=0)
        for k in range(1, STRIDE):
            sums += self.vectors.take(features[np.where(begin + k < stop, begin + k, len(features) - 1)], axis=0)
        both = sums.copy()
        for k in range(1, WINDOW // STRIDE):
            more = owner[k:] == owner[:-k]
            both[:-k][more] += sums[k:][more]
        # A window that only repeats the end of the one before it adds nothing.
        keep = (order == 0) | (order + WINDOW // STRIDE <= strides[owner])
        both, owner, begin = both[keep], owner[keep], begin[keep]
        norm = np.sqrt((both * both).sum(axis=1, keepdims=True))
        return both / np.maximum(norm, 1e-9), owner, begin


def latent_space(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: Runs | None = None) -> Space:
    """The space of all passages of ``docs``, without the words in ``runs``."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(runs)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, df, passages = np.zeros(SKETCH * FEATURES, np.int32), np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            seeds = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for found in words(batch.column(0), 1 << 18, SIGNS):
                held = shared.value and shared.value.held(found)
                passages += sketch_block(found, seeds[found.rows.start : found.rows.stop], sketch, df, held)
        if passages:
            yield packed({SKETCH: np.r_[df, passages], **{k: sketch[k * FEATURES : (k + 1) * FEATURES] for k in range(SKETCH)}})

    def packed(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        at = {k: np.flatnonzero(v) for k, v in sums.items()}
        return pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([at[k].astype(np.int32).tobytes() for k in sums]), pa.array([sums[k][at[k]].astype(np.int64).tobytes() for k in sums])],
            ["row", "features", "sums"],
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for row, features, sums in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if row != key:
                    if total is not None:
                        yield packed({key: total})
                    key, total = row, np.zeros(FEATURES + 1, np.int64)
                total[np.frombuffer(features, np.int32)] += np.frombuffer(sums, np.int64)
        if total is not None:
            yield packed({key: total})

    kind = "row int, features binary, sums binary"
    source = docs.select(F.coalesce(F.lower(text_col), F.lit("")).alias("text"), F.xxhash64(F.col(id_col)).alias("seed"))
    parts = source.mapInArrow(add, kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    level = parts.repartition("row", "salt").sortWithinPartitions("row", "salt").drop("salt").mapInArrow(merge, kind)
    level = level.repartition("row").sortWithinPartitions("row").mapInArrow(merge, kind)
    sketch, df, passages = np.zeros((SKETCH, FEATURES)), np.zeros(FEATURES), 0
    for r in level.collect():
        total = np.zeros(FEATURES + 1)
        total[np.frombuffer(r.features, np.int32)] = np.frombuffer(r.sums, np.int64)
        if r.row == SKETCH:
            df, passages = total[:FEATURES], int(total[FEATURES])
        else:
            sketch[r.row] = total[:FEATURES]
    return solve(sketch, df, passages)


def solve(sketch: np.ndarray, df: np.ndarray, passages: int) -> Space:
    """The latent space of a sketch."""
    # Above zero for words in every passage, too: else a corpus of one passage has no vectors.
    idf = np.log1p((passages + 1) / (df + 1)) ** 1.5
    scaled = sketch * idf
    gram = scaled @ scaled.T
    values, left = np.linalg.eigh(gram)
    values, left = values[::-1][:RANK], left[:, ::-1][:, :RANK]
    good = values > max(values[0], 0) * 1e-12
    basis = np.zeros((FEATURES, RANK))
    basis[:, good] = scaled.T @ left[:, good] / np.sqrt(values[good])
    random = np.random.default_rng(62).choice([-1.0, 1.0], (FEATURES, RANK)) / np.sqrt(RANK)
    outside = random - basis @ (basis.T @ random)
    vectors = np.hstack([basis, outside]) * idf[:, None]
    return Space(np.vstack([vectors, np.zeros((1, 2 * RANK))]).astype(np.float32))


@dataclass
class Items:
    """Benchmark items: ids, words as hashes, window vectors with the item of each, and runs of words."""

    ids: list
    hashes: list
    vectors: np.ndarray
    item: np.ndarray
    runs: Runs
    short: dict[int, dict[int, list[int]]]

    @staticmethod
    def of(ids: list, texts: list, space: Space) -> Items:
        hashes, vectors, owners, runs = [], [], [], []
        short: dict[int, dict[int, list[int]]] = {}
        for found in words(pa.array(texts, pa.string()), apart=SIGNS):
            every = hashes_of(found)
            at, run = run_hashes(found)
            runs.append((run, found.owner[at] + found.rows.start, at - found.first[found.owner[at]]))
            hashes += [every[a:b] for a, b in zip(found.first[:-1], found.first[1:], strict=True)]
            for size in range(1, MIN_WORDS):
                for k, h in zip(*(x.tolist() for x in run_hashes(found, size)), strict=True):
                    row = int(found.owner[k])
                    if found.first[row + 1] - found.first[row] == size:
                        short.setdefault(size, {}).setdefault(h, []).append(row + found.rows.start)
            for shift in range(0, STRIDE, STRIDE // 2):
                # Windows that begin between strides as well; a short item has one.
                n = np.diff(found.first)
                begin = np.minimum(found.first[:-1] + shift, found.first[1:])
                if shift and not (n > WINDOW).any():
                    break
                part = [np.arange(b, e) for b, e in zip(begin, found.first[1:], strict=True)]
                size = np.array([len(x) if not shift or k > WINDOW else 0 for x, k in zip(part, n, strict=True)])
                take = np.concatenate([x[:s] for x, s in zip(part, size, strict=True)])
                moved = Words(found.data, found.starts[take], found.ends[take], np.r_[0, np.cumsum(size)], found.rows)
                v, owner, _ = space.windows(moved)
                vectors.append(v)
                owners.append(owner + found.rows.start)
        keep = np.array([len(h) >= MIN_WORDS for h in hashes], bool)
        item = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        vector = np.concatenate(vectors) if vectors else np.zeros((0, 2 * RANK), np.float32)
        run = Runs(*(np.concatenate(x) for x in zip(*runs, strict=True))) if runs else Runs(np.zeros(0, np.uint64), item[:0], item[:0])
        return Items(ids, hashes, np.ascontiguousarray(vector[keep[item]].T), item[keep[item]], run, short)


def masks(item: np.ndarray) -> dict[int, int]:
    """For each word, the bits of its places in the item."""
    out: dict[int, int] = {}
    for k, h in enumerate(item.tolist()):
        out[h] = out.get(h, 0) | 1 << k
    return out


def lcs_bits(of: dict[int, int], n: int, text: list[int]) -> int:
    """The bits of an item's n words that are in a longest common subsequence with ``text`` (bit-parallel rows)."""
    full = (1 << n) - 1
    row = full
    for h in text:
        m = of.get(h, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return full & ~row


def check(item: np.ndarray, text: np.ndarray) -> tuple[float, float]:
    """Shares of the item's words, and of its answer's words, that occur in order in ``text``."""
    of, answer = masks(item), item[-ANSWER:]
    known = text[np.isin(text, item)].tolist()
    whole = lcs_bits(of, len(item), known).bit_count() / len(item)
    return whole, lcs_bits(masks(answer), len(answer), known).bit_count() / len(answer)


def shared_runs(found: Words, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, where the item would begin, runs there) for texts and items that share runs; most runs first."""
    at, low, size = items.runs.find(found)
    longest = max(map(len, items.hashes), default=0)
    span, owner = len(found.starts) + longest + 1, found.owner
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    part = (np.cumsum(size) - size) // RUN_PAIRS
    for k in np.unique(part):
        a, n = at[part == k], size[part == k]
        pair = np.repeat(low[part == k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        a = np.repeat(a, n)
        key = (owner[a] * len(items.ids) + items.runs.item[pair]) * span + a - items.runs.place[pair] + longest
        keys, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([counts, np.ones(len(key))])).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    both, begin = np.divmod(keys[order], span)
    yield from zip(*(x.tolist() for x in (*np.divmod(both, len(items.ids)), begin - longest, counts[order])), strict=True)


def short_hits(found: Words, items: Items) -> Iterator[tuple[int, int]]:
    """(row, item) for texts that hold items of fewer than MIN_WORDS words."""
    for size, known in items.short.items():
        at, hashes = run_hashes(found, size)
        hit = np.isin(hashes, np.array(list(known), np.uint64))
        for k, h in zip(at[hit].tolist(), hashes[hit].tolist(), strict=True):
            row = int(found.owner[k])
            if size >= PHRASE or found.first[row + 1] - found.first[row] == size:
                yield from ((row, item) for item in known[h])


def accepted(n: int, whole: float, told: float, lcs: float, answer: float, sure: float) -> bool:
    """Whether the shares of an item of n words are enough."""
    if n < SHORT:
        lcs, answer = max(lcs, STRICT[0]), max(answer, STRICT[1])
    return whole >= sure or whole >= lcs and told >= answer


def scan(texts: pa.Array, space: Space, items: Items, cosine: float, lcs: float, answer: float, sure: float) -> Iterator[tuple]:
    """(row, item index, cosine, lcs share, answer share) for each text and item that match; the best window's."""
    for found in words(texts, 1 << 18, SIGNS):
        vectors, owner, begin = space.windows(found)
        best: dict[tuple[int, int], tuple] = {pair: (1.0, 1.0, 1.0) for pair in short_hits(found, items)}
        for row, item, at, runs in shared_runs(found, items):
            held = best.get((row, item))
            if held and held[1] >= 1:
                continue
            n = len(items.hashes[item])
            if runs == n - MIN_WORDS + 1:
                whole, told = 1.0, 1.0
            else:
                a, b = max(found.first[row], at - n), min(found.first[row + 1], at + 2 * n)
                whole, told = check(items.hashes[item], hashes_of(found)[a:b])
            if accepted(n, whole, told, lcs, answer, sure) and (held is None or (whole, told) > held[1:]):
                w = np.searchsorted(owner, row) + max(0, np.searchsorted(begin[owner == row], at, "right") - 1)
                best[row, item] = (float((vectors[w] @ items.vectors[:, items.item == item]).max()), whole, told)
        step = max(1, CELLS // max(1, len(items.item)))
        for at in range(0, len(vectors), step):
            near = vectors[at : at + step] @ items.vectors
            for w, v in zip(*np.nonzero(near >= cosine), strict=True):
                row, item = int(owner[at + w]), int(items.item[v])
                held = best.get((row, item))
                if held and held[1] >= 1:
                    continue
                n = len(items.hashes[item])
                a = max(found.first[row], begin[at + w] - n)
                b = min(found.first[row + 1], begin[at + w] + WINDOW + n)
                whole, told = check(items.hashes[item], hashes_of(found)[a:b])
                if accepted(n, whole, told, lcs, answer, sure) and (held is None or (whole, told) > held[1:]):
                    best[row, item] = (float(near[w, v]), whole, told)
        for (row, item), (c, whole, told) in best.items():
            yield found.rows.start + row, item, c, whole, told


def hashes_of(found: Words) -> np.ndarray:
    """The block's word hashes, computed once."""
    kept = found.__dict__.get("_hashes")
    if kept is None:
        kept = found.__dict__["_hashes"] = found.hashes
    return kept


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER_SHARE, sure: float = SURE, space: Space | None = None,
) -> DataFrame:
    """id_col, item_col, cosine, lcs_share, answer_share for each document and benchmark item that match."""
    spark = docs.sparkSession
    bound_batches(spark)
    if space is None:
        space = latent_space(docs, id_col, text_col, known_runs(benchmark, item_text_col))
    rows = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text"))
    item_kind = benchmark.schema[item_col].dataType
    shares = "cosine double, lcs_share double, answer_share double"
    result = None
    for block in item_blocks(benchmark, item_col, item_text_col):
        shared = spark.sparkContext.broadcast((space, Items.of([r[0] for r in block], [r[1] for r in block], space)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            space, items = shared.value
            for batch in batches:
                hits = list(scan(batch.column(1), space, items, cosine, lcs, answer, sure))
                if hits:
                    row, item, *numbers = zip(*hits, strict=True)
                    columns = [batch.column(0).take(pa.array(row)), pa.array([items.ids[k] for k in item]), *(pa.array(x, pa.float64()) for x in numbers)]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "item", "cosine", "lcs_share", "answer_share"])

        out = f"id {rows.schema['id'].dataType.simpleString()}, item {item_kind.simpleString()}, {shares}"
        part = rows.mapInArrow(search, out)
        result = part if result is None else result.unionByName(part)
    if result is None:
        empty = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("item", item_kind), *(T.StructField(x.split()[0], T.DoubleType()) for x in shares.split(", "))])
        result = spark.createDataFrame([], empty)
    best = F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("best")
    result = result.groupBy("id", "item").agg(best)
    return result.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.cosine", "best.lcs_share", "best.answer_share")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text_col: str = "text",
    cosine: float = COSINE, lcs: float = LCS, answer: float = ANSWER_SHARE, sure: float = SURE,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item; a filter for each block of items."""
    spark = docs.sparkSession
    space = latent_space(docs, id_col, text_col, known_runs(benchmark, item_text_col))
    lowered = "__lowered"
    kept = docs.withColumn(lowered, F.lower(text_col))
    for block in item_blocks(benchmark, item_text_col, item_text_col):
        shared = spark.sparkContext.broadcast((space, Items.of([None] * len(block), [r[1] for r in block], space)))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            space, items = shared.value
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                good[[hit[0] for hit in scan(batch.column(batch.num_columns - 1), space, items, cosine, lcs, answer, sure)]] = False
                yield batch.filter(pa.array(good))

        kept = kept.mapInArrow(clean, kept.schema)
    return kept.drop(lowered)


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, most: int = BLOCK_WORDS) -> Iterator[list]:
    """The items, about ``most`` words at a time; a benchmark beyond ``BENCHMARK_BYTES`` is read as a stream."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.lower(text_col).alias("words")).filter("words is not null")
    size = rows.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    block, held = [], 0
    for row in rows.collect() if size <= BENCHMARK_BYTES else rows.toLocalIterator(prefetchPartitions=True):
        block.append((row[0], row[1]))
        held += len(row[1].split()) + 1
        if held >= most:
            yield block
            block, held = [], 0
    if block:
        yield block


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` that hold items of ``benchmark``, with those items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES: dict[str, str] = {}
