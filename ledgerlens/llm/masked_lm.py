"""Language-model scoring by masked pseudo-likelihood.

A window network predicts every token from the ``SPAN`` tokens on either side of it: the sum of the neighbours'
vectors, each scaled by weights of its distance, goes through tanh; one softmax gives the token's class and a second
one, which also sees the class, its place in the class. A document's score is the sum of its tokens' conditional
log-probabilities, a proper distribution over the vocabulary at each place.

Vocabulary: the most frequent words over all documents; the rest share the ``SPARE`` last ids, by their last two bytes,
so that the network can tell what kind of rare word stands at a place. Classes are runs of 64 ids in order of frequency.
Counts are combined by map tasks before they are shuffled.

Rarer words share an id's probability by their counts over all documents: in a bucket of T tokens of D words, a word
of count c takes c / (T + D + 1), a word never counted 1 / (T + D + 1). These counts grow with the corpus; they stay in
a table. Of its words the most frequent, at most ``KNOWN``, are broadcast; documents' other words are joined with it.
Logarithms are summed in units of 1 / ``UNIT``, so that their order doesn't matter.

Training, in numpy: texts are turned into ids once, into a table that training and scoring read. All documents are
dealt by hash to ``ROUNDS`` rounds and in each to trainers of about ``TRAINER_DOCS`` documents, or at most ``TRAINERS``
larger ones. A trainer starts from the common parameters and reads its documents in chunks of ``CHUNK`` tokens; of each
chunk a random share ``TARGETS`` of the tokens is predicted, all are context. Parameters are then averaged, weighted by
tokens, in a tree whose nodes add up ``FAN_IN`` models in a fixed order. They have one size; they are all that reaches
the driver.

Defined results: null, empty and blank texts have no tokens, sum 0 and a null perplexity; very long texts are read in
chunks and scored whole; repeated rows are scored each; an empty table gives no rows; further columns are ignored.
Reruns agree: dealing, order and start are hashes, and sums have an order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm.arrow import Words, bound_batches, mix, words
from ledgerlens.session import discard, materialize, table

CLASS = 64
VOCABULARY = CLASS * CLASS
SPARE = 512
PAD = VOCABULARY
WIDTH, SPAN = 32, 3
#: Words whose counts are broadcast (12 bytes each).
KNOWN = 1 << 20
TARGETS = 0.125
TRAINER_DOCS, TRAINERS = 4096, 1024
TASK_TRAINERS = 1
ROUNDS = 4
FAN_IN = 16
UNIT = 1 << 24
BATCH, RATE = 512, 0.16
CHUNK = 1 << 18
_COUNTED = 1 << 20
#: Steps of a doubling in which counts are grouped to find the least count that is broadcast.
_STEPS = 64

#: Parameters and their shapes, in the order in which they are packed.
SHAPES = {
    "word": (VOCABULARY + 1, WIDTH), "place": (2 * SPAN, WIDTH), "shift": (WIDTH,), "to_class": (WIDTH, CLASS), "class_bias": (CLASS,),
    "of_class": (CLASS, WIDTH), "to_member": (WIDTH, CLASS), "member_bias": (CLASS, CLASS),
}


def marked_hashes(found: Words) -> np.ndarray:
    """A hash of each word; its last bits stand for the word's last two bytes."""
    hashes = found.hashes
    if not len(hashes):
        return hashes
    last = found.data[found.ends - 1].astype(np.uint64)
    before = np.where(found.lengths > 1, found.data[np.maximum(found.ends - 2, 0)], 0).astype(np.uint64)
    low = np.uint64(SPARE - 1)
    return hashes & ~low | mix(last << np.uint64(8) | before) & low


class Lexicon:
    """Ids of words and units of rare ones, by their hashes, which are grouped by their first bits."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, units: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.keys, self.ids, self.units = hashes[order], ids[order].astype(np.int32), units[order].astype(np.int64)
        self.shift = np.uint64(64 - max(1, int(len(hashes)).bit_length()))
        groups = np.arange((1 << int(64 - self.shift)) + 1, dtype=np.uint64)
        self.first = np.searchsorted((self.keys >> self.shift).astype(np.int64), groups.astype(np.int64)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max()) if len(hashes) else 0

    def find(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Id, units and whether it is here, for each word; a word that isn't has the id of its ending."""
        ids = (VOCABULARY - SPARE + (found & np.uint64(SPARE - 1)).astype(np.int64)).astype(np.int32)
        units, here = np.zeros(len(found), np.int64), np.zeros(len(found), bool)
        group = (found >> self.shift).astype(np.int64)
        at, stop, left = self.first[group], self.first[group + 1], np.arange(len(found))
        for _ in range(self.deepest):
            open_ = at < stop
            left, at, stop = left[open_], at[open_], stop[open_]
            hit = self.keys[at] == found[left]
            where, which = left[hit], at[hit]
            ids[where], units[where], here[where] = self.ids[which], self.units[which], True
            left, at, stop = left[~hit], at[~hit] + 1, stop[~hit]
        return ids, units, here


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """hash and n for every word of all documents."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            parts = [np.unique(x, return_counts=True) for x in [np.concatenate(waiting)]] if waiting else []
            every = np.concatenate([keys, *(p[0] for p in parts)])
            found, back = np.unique(every, return_inverse=True)
            return found, np.bincount(back, np.concatenate([counts, *(p[1] for p in parts)]), len(found)).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["hash", "n"])

        size = 0
        for batch in batches:
            for found in words(batch.column(0)):
                waiting.append(marked_hashes(found))
                size += len(waiting[-1])
                if size >= _COUNTED:
                    keys, counts = merged()
                    waiting, size = [], 0
                    if len(keys) >= _COUNTED:
                        yield out()
                        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, counts = merged()
        if len(keys):
            yield out()

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(tally, "hash long, n long")
    return counted.groupBy("hash").agg(F.sum("n").alias("n"))


def start(counts: np.ndarray) -> dict[str, np.ndarray]:
    """First parameters: biases that give each id its frequency, small random vectors."""
    random = np.random.default_rng(91)
    p = {k: (random.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    n = (counts + 0.5).reshape(CLASS, CLASS)
    p["class_bias"] = np.log(n.sum(axis=1) / n.sum()).astype(np.float32)
    p["member_bias"] = np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)
    p["place"] += 0.3
    p["shift"][:] = 0
    p["word"][PAD] = 0
    p["of_class"] *= 0
    return p


def pack(p: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([p[k].ravel() for k in SHAPES]).astype(np.float32).tobytes()


def unpack(packed: bytes) -> dict[str, np.ndarray]:
    flat, at, p = np.frombuffer(packed, np.float32), 0, {}
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        p[k] = flat[at : at + n].reshape(s).copy()
        at += n
    return p


def padded(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with SPAN pads before, between and after the texts; and where each token went."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(ids)) + (owner + 1) * SPAN
    out = np.full(len(ids) + len(first) * SPAN, PAD, np.int32)
    out[at] = ids
    return out, at


_ONES = np.ones((CLASS, 1), np.float32)


def bounded(p: dict[str, np.ndarray]) -> bool:
    """Whether no score can leave the range of exp, as hidden values lie in [-1, 1]; else rows are shifted by their largest."""
    reach = [np.abs(p[w]).sum(axis=0).max() + np.abs(b).max() for w, b in (("to_class", p["class_bias"]), ("to_member", member_scores(p)))]
    return max(reach) < 60


def member_scores(p: dict[str, np.ndarray]) -> np.ndarray:
    """What a class adds to the scores of its places."""
    return p["of_class"] @ p["to_member"] + p["member_bias"]


def _log_picked(x: np.ndarray, rows: np.ndarray, picked: np.ndarray, safe: bool) -> np.ndarray:
    """The logarithm of the picked column's softmax in each row; changes ``x``."""
    if not safe:
        x -= x.max(axis=1, keepdims=True)
    own = x[rows, picked]
    np.exp(x, out=x)
    return own - np.log(x @ _ONES)[:, 0]


def _offsets() -> list[tuple[int, int]]:
    return list(enumerate([*range(-SPAN, 0), *range(1, SPAN + 1)]))


def log_probabilities(p: dict[str, np.ndarray], ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The conditional log-probability of each token given those around it."""
    out = np.zeros(len(ids))
    line, at = padded(ids, first)
    safe, members = bounded(p), member_scores(p)
    tables = [(d, p["word"] * p["place"][o]) for o, d in _offsets()]
    for k in range(0, len(ids), 4096):
        here = at[k : k + 4096]
        hidden = np.tile(p["shift"], (len(here), 1))
        for d, vectors in tables:
            hidden += vectors.take(line[here + d], axis=0)
        np.tanh(hidden, out=hidden)
        group, member = np.divmod(ids[k : k + 4096], CLASS)
        rows = np.arange(len(here))
        found = _log_picked(hidden @ p["to_class"] + p["class_bias"], rows, group, safe)
        scores = hidden @ p["to_member"]
        scores += members.take(group, axis=0)
        out[k : k + 4096] = found + _log_picked(scores, rows, member, safe)
    return out


def _softmax(x: np.ndarray, safe: bool) -> np.ndarray:
    if not safe:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x *= 1 / (x @ _ONES.astype(x.dtype))
    return x


def gradients(p: dict[str, np.ndarray], line: np.ndarray, here: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of the negative log-probabilities of the tokens ``here``; those of words only for the words near them, which come second."""
    group, member = np.divmod(line[here], CLASS)
    rows, safe = np.arange(len(here)), bounded(p)
    near = [line[here + d] for _, d in _offsets()]
    vectors = [p["word"].take(x, axis=0) for x in near]
    hidden = np.tanh(p["shift"] + sum(v * p["place"][o] for o, v in enumerate(vectors)))
    g = {}
    off = _softmax(hidden @ p["to_class"] + p["class_bias"], safe)
    off[rows, group] -= 1
    g["to_class"], g["class_bias"] = hidden.T @ off, off.sum(axis=0)
    back = off @ p["to_class"].T
    off = _softmax(hidden @ p["to_member"] + member_scores(p).take(group, axis=0), safe)
    off[rows, member] -= 1
    mine = np.zeros((CLASS, len(here)), off.dtype)
    mine[group, rows] = 1
    g["member_bias"] = mine @ off
    g["to_member"] = hidden.T @ off + p["of_class"].T @ g["member_bias"]
    g["of_class"] = g["member_bias"] @ p["to_member"].T
    back += off @ p["to_member"].T
    back *= 1 - hidden * hidden
    g["shift"] = back.sum(axis=0)
    g["place"] = np.stack([np.einsum("tc,tc->c", v, back) for v in vectors])
    # Only words that are near have a gradient; the others stay as they are.
    used, where = np.unique(np.concatenate(near).astype(np.uint16), return_inverse=True)
    cells = (where[:, None] * WIDTH + np.arange(WIDTH)).ravel()
    each = np.concatenate([back * p["place"][o] for o, _ in _offsets()])
    g["word"] = np.bincount(cells, each.ravel(), len(used) * WIDTH).reshape(-1, WIDTH).astype(each.dtype)
    g["word"][used == PAD] = 0
    return g, used


def train(p: dict[str, np.ndarray], seen: dict[str, np.ndarray], ids: np.ndarray, first: np.ndarray, seed: int, targets: float) -> int:
    """Predicts a share of the tokens in random order, by gradient descent with adaptive rates; changes ``p`` and ``seen``."""
    line, at = padded(ids, first)
    order = np.random.default_rng(seed).permutation(len(ids))[: -int(-len(ids) * targets // 1)]
    for k in range(0, len(order), BATCH):
        take = order[k : k + BATCH]
        found, used = gradients(p, line, at[take])
        for name, grad in found.items():
            grad /= len(take)
            if name == "word":
                seen[name][used] += grad * grad
                p[name][used] -= RATE * grad / np.sqrt(seen[name][used])
                continue
            seen[name] += grad * grad
            p[name] -= (RATE if name in ("place", "to_class", "to_member", "of_class", "shift") else RATE / 4) * grad / np.sqrt(seen[name])
    return len(order)


def fresh() -> dict[str, np.ndarray]:
    """Squared gradients before the first step."""
    return {k: np.full(s, 1e-2, np.float32) for k, s in SHAPES.items()}


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums parameters, already weighted by tokens, and tokens, in the order of the rows."""
    total, tokens = None, 0
    for batch in batches:
        for model, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(model, np.float64)
            total = own.copy() if total is None else total + own
            tokens += n
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([tokens], pa.int64())], ["model", "tokens"])


def average(models: DataFrame, parts: int) -> bytes | None:
    """The average of models (model, tokens; one for each of ``parts`` partitions), in a tree of ``FAN_IN``."""
    while parts > 1:
        parts = -(-parts // FAN_IN)
        numbered = models.withColumn("at", F.spark_partition_id())
        level = numbered.repartition(parts, F.floor(F.col("at") / FAN_IN)).sortWithinPartitions("at")
        models = level.select("model", "tokens").mapInArrow(add_up, "model binary, tokens long")
    sums = models.collect()
    return (np.frombuffer(sums[0].model, np.float64) / sums[0].tokens).astype(np.float32).tobytes() if sums else None


@dataclass
class Model:
    """The lexicon, the rare words' shares of their ids (hash, units), those of words never counted, and parameters."""

    lexicon: Lexicon
    shares: DataFrame
    unseen: list[int]
    parameters: bytes


def rare_shares(counts: DataFrame, last: int, floor: tuple[int, int]) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Shares of the words from the place ``floor`` (count, hash) on; tokens of each bucket, and units of a word never counted."""
    n, at = floor
    rare = counts.filter((F.col("n") < n) | (F.col("n") == n) & (F.col("hash") > at)) if last else counts.limit(0)
    bucket = F.col("hash").bitwiseAND(F.lit(SPARE - 1)).cast("int")
    tokens, size = np.zeros(SPARE), np.ones(SPARE)
    for r in rare.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")).collect():
        tokens[r.bucket], size[r.bucket] = r.n, r.n + r.words + 1
    of = F.array(*[F.lit(float(x)) for x in size])
    units = F.round(F.log(F.col("n") / of[bucket]) * UNIT).cast("long")
    return rare.select("hash", "n", units.alias("units")), tokens, [round(float(x) * UNIT) for x in -np.log(size)]


def most_frequent(rare: DataFrame, most: int) -> DataFrame:
    """Rare words of at least such a count that they are at most ``most``; counts are grouped, so few rows reach the driver."""
    step = F.floor(F.log2("n") * _STEPS).cast("long")
    left, least = most, None
    for r in sorted(rare.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r.step):
        left -= r.words
        if left < 0:
            break
        least = r.step
    return rare.filter(step >= least) if least is not None else rare.limit(0)


def encode(docs: DataFrame, lexicon: Lexicon, unseen: list[int], id_col: str, text_col: str) -> DataFrame:
    """id, key (a hash of the row), n_tokens, ids (two bytes each), units and the words to be joined (hashes) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            n, ids, units, other = [], [], [], []
            for found in words(batch.column(2)):
                hashes = marked_hashes(found)
                each, unit, here = own.find(hashes)
                edges = found.first.astype(np.int64)
                n.append(np.diff(edges))
                ids.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges * 2), pa.py_buffer(each.astype(np.uint16))]).cast(pa.binary()))
                units.append(np.diff(np.r_[0, np.cumsum(unit)][edges]))
                ends = np.r_[0, np.cumsum(~here)][edges].astype(np.int32)
                other.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes[~here].view(np.int64))))
            if n:
                numbers = [pa.array(np.concatenate(x).astype(np.int64)) for x in (n, units)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), numbers[0], pa.concat_arrays(ids), numbers[1], pa.concat_arrays(other)], ["id", "key", "n_tokens", "ids", "units", "other"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(10), id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(spell, f"id {rows.schema['id'].dataType.simpleString()}, key long, n_tokens long, ids binary, units long, other array<long>")


def prepare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model before training, and the documents as ids."""
    bound_batches(docs.sparkSession)
    counts = materialize(word_counts(docs, text_col), "lm-words")
    top = counts.orderBy(F.desc("n"), "hash").limit(VOCABULARY - SPARE).collect()
    n = np.zeros(VOCABULARY)
    n[: len(top)] = [r.n for r in top]
    shares, n[-SPARE:], unseen = rare_shares(counts, len(top), (top[-1].n, top[-1].hash) if top else (0, 0))
    known = most_frequent(shares, KNOWN).select("hash", "units").toArrow()
    hashes = np.concatenate([np.array([r.hash for r in top], np.int64), known.column("hash").to_numpy()]).view(np.uint64)
    rare = VOCABULARY - SPARE + (hashes[len(top) :] & np.uint64(SPARE - 1)).astype(np.int64)
    lexicon = Lexicon(hashes, np.concatenate([np.arange(len(top)), rare]), np.concatenate([np.zeros(len(top), np.int64), known.column("units").to_numpy()]))
    return Model(lexicon, shares, unseen, pack(start(n))), materialize(encode(docs, lexicon, unseen, id_col, text_col), "lm-ids")


def learn(model: Model, encoded: DataFrame, targets: float = TARGETS, rounds: int = ROUNDS) -> Model:
    """The model trained on all documents of ``encoded``."""
    if not rounds:
        return model
    spark = encoded.sparkSession
    trainers = min(TRAINERS, max(1, round(encoded.count() / (TRAINER_DOCS * rounds))))
    parts = -(-trainers // TASK_TRAINERS)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model.parameters)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            yield from add_up(trained(batches, shared.value, turn))

        def trained(batches: Iterator[pa.RecordBatch], current: bytes, turn: int) -> Iterator[pa.RecordBatch]:
            """Each trainer's parameters, weighted by its tokens; its documents come in a row."""
            key, p, seen, waiting, size, done = None, None, None, [], 0, 0

            def flush() -> int:
                every = np.concatenate(waiting).astype(np.int64)
                return train(p, seen, every, np.r_[0, np.cumsum([len(x) for x in waiting])], (int(key) * rounds + turn) * 1_000_003 + done, targets)

            def result() -> pa.RecordBatch:
                weighted = np.frombuffer(pack(p), np.float32).astype(np.float64) * done
                return pa.RecordBatch.from_arrays([pa.array([weighted.tobytes()], pa.binary()), pa.array([done], pa.int64())], ["model", "tokens"])

            for batch in batches:
                for trainer, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if trainer != key:
                        if key is not None:
                            done += flush() if waiting else 0
                            yield result()
                        key, p, seen, waiting, size, done = trainer, unpack(current), fresh(), [], 0, 0
                    ids = np.frombuffer(packed.as_buffer(), np.uint16)
                    for k in range(0, len(ids), CHUNK):
                        waiting.append(ids[k : k + CHUNK])
                        size += len(waiting[-1])
                        if size >= CHUNK:
                            done += flush()
                            waiting, size = [], 0
            if key is not None:
                done += flush() if waiting else 0
                yield result()

        mine = encoded.filter((F.col("n_tokens") > 0) & (F.pmod("key", F.lit(rounds)) == turn))
        dealt = mine.select(F.pmod(F.shiftright("key", 16), F.lit(trainers)).cast("int").alias("trainer"), "ids", "key")
        dealt = dealt.repartition(parts, F.floor(F.col("trainer") / TASK_TRAINERS)).sortWithinPartitions("trainer", "key", "ids")
        found = average(dealt.select("trainer", "ids").mapInArrow(run, "model binary, tokens long"), parts)
        if found:
            model = Model(model.lexicon, model.shares, model.unseen, found)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: float = TARGETS, rounds: int = ROUNDS) -> Model:
    """The model trained on ``docs``."""
    model, encoded = prepare(docs, id_col, text_col)
    model = learn(model, encoded, targets, rounds)
    discard(encoded)
    return model


def score_encoded(encoded: DataFrame, model: Model) -> DataFrame:
    """id, n_tokens, sum_log_prob and perplexity for every row of ``encoded``, which is a written table."""
    shared = encoded.sparkSession.sparkContext.broadcast(model.parameters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = unpack(shared.value)
        for batch in batches:
            n, total = batch.column(1).to_numpy(), np.zeros(batch.num_rows)
            edges, row = np.r_[0, np.cumsum(n)], 0
            while row < batch.num_rows:
                last = max(row + 1, int(np.searchsorted(edges, edges[row] + CHUNK, "right")) - 1)
                ids = np.frombuffer(b"".join(batch.column(2)[row:last].to_pylist()), np.uint16).astype(np.int64)
                each = log_probabilities(p, ids, edges[row : last + 1] - edges[row])
                total[row:last] = np.bincount(np.repeat(np.arange(last - row), n[row:last]), each, last - row)
                row = last
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total), batch.column(3), batch.column(4)], ["id", "n_tokens", "total", "units", "other"])

    kind = encoded.schema["id"].dataType.simpleString()
    scored = encoded.select("id", "n_tokens", "ids", "units", "other").mapInArrow(run, f"id {kind}, n_tokens long, total double, units long, other array<long>")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    other = scored.select("row", F.explode("other").alias("hash")).join(model.shares.select("hash", F.col("units").alias("own")), "hash", "left")
    unseen = F.array(*[F.lit(x) for x in model.unseen])[F.col("hash").bitwiseAND(F.lit(SPARE - 1)).cast("int")]
    other = other.groupBy("row").agg(F.sum(F.coalesce("own", unseen)).alias("more"))
    total = F.col("total") + (F.col("units") + F.coalesce("more", F.lit(0))) / UNIT
    scored = scored.drop("other").join(other, "row", "left").select("id", "n_tokens", total.alias("sum_log_prob"))
    perplexity = F.when(F.col("n_tokens") > 0, F.exp(-F.col("sum_log_prob") / F.col("n_tokens")))
    return scored.select("id", "n_tokens", "sum_log_prob", perplexity.alias("perplexity"))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, sum_log_prob and perplexity for every row of ``docs``."""
    bound_batches(docs.sparkSession)
    return score_encoded(materialize(encode(docs, model.lexicon, model.unseen, id_col, text_col), "lm-ids"), model).withColumnRenamed("id", id_col)


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: float = TARGETS, rounds: int = ROUNDS) -> DataFrame:
    """The scores of ``docs`` by a model trained on them; their ids are made once."""
    model, encoded = prepare(docs, id_col, text_col)
    return score_encoded(encoded, learn(model, encoded, targets, rounds)).withColumnRenamed("id", id_col)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a network trained on them."""
    return fit_and_score(table(spark, sf_dir, "documents"))


QUERIES = {"op9_lm_score": op9_lm_score}
ORACLES: dict[str, str] = {}
