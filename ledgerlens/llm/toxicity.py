"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities and counts of a lexicon's words and stems, nearness of second-person words to
them, shares of capitals, digits and punctuation, rates of exclamation, of spellings that only give a lexicon word
once symbols are read as letters, and of words that mix letters with other signs; length.

The lexicon is learned: words and stems (a word's first 5 to 8 bytes) by the log-odds of the labelled texts that
hold them. Trees are grown on histograms of binned features with logistic loss; calibration pools adjacent violators
on labelled texts that the trees haven't seen. All is fitted on a sample of labelled texts, without repeats, of about
``train_docs``, a parameter; features and scores of all documents are one pass without a shuffle.

Defined results: null and empty texts have all features 0 and the score of those; without labels of both kinds every
score is the share of label 1, or 0; a null label isn't used; of labels that differ for one text the largest counts;
repeated rows are scored each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerlens.llm.arrow import bound_batches, blocks, cut, words
from ledgerlens.session import materialize, table

#: Labels that are broadcast at most (a number or short id and a label each).
BROADCAST_LABELS = 1_000_000
TRAIN_DOCS = 20_000
THRESHOLD = 0.7
LEXICON = 1024
STEMS = (5, 6, 7, 8)
STRONG = 3.5
NEAR = 5
#: Second-person words of English, German, French and Spanish.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deiner deinen ihr euch euer sie tu te toi ton ta tes vous votre vos usted ustedes ti tú vosotros tus"
).split()
FEATURES = (
    "strong_density", "stem_density", "weight_density", "strong_count", "stem_count", "max_weight", "second_person", "near_second_person",
    "capitals", "exclamations", "punctuation", "digits", "disguised", "mixed", "n_words", "word_bytes",
)

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SIGN = ~(_LETTER | _DIGIT | _BLANK)
_APART = ~(_LETTER | _DIGIT)
_READ = np.arange(256, dtype=np.uint8)
_READ[0x41:0x5B] += 32
for _sign, _letter in zip("013457@$!|", "oieastasii", strict=True):
    _READ[ord(_sign)] = ord(_letter)
_DROPPED = _SIGN.copy()
_DROPPED[[ord(c) for c in "@$!|"]] = False


def _hashes_of(texts: list[str]) -> np.ndarray:
    return np.concatenate([w.hashes for w in words(pa.array(texts))])


@dataclass
class Lexicon:
    """Hashes of words and stems, in order, with their weights."""

    keys: np.ndarray
    weights: np.ndarray

    def weight(self, found: np.ndarray) -> np.ndarray:
        """The weight of each hash, 0 if it isn't an entry."""
        if not len(self.keys):
            return np.zeros(len(found))
        at = np.searchsorted(self.keys, found).clip(max=len(self.keys) - 1)
        return np.where(self.keys[at] == found, self.weights[at], 0.0)


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES for each text."""
    second = np.sort(_hashes_of(SECOND_PERSON))
    out = np.zeros((len(texts), len(FEATURES)))
    for data, at, rows in blocks(texts):
        n_texts = len(rows)
        found = cut(data, at, rows, _APART)
        owner, n = found.owner, np.diff(found.first)
        per_text = lambda values, by=owner: np.bincount(by, values, n_texts)  # noqa: B023, E731
        weight = lexicon.weight(found.hashes)
        stem = np.zeros(len(weight))
        for k in STEMS:
            np.maximum(stem, lexicon.weight(found.prefixes(k)), out=stem)
        best = np.maximum(weight, stem)
        strong = weight >= STRONG
        you = np.isin(found.hashes, second, kind="sort")
        place = np.flatnonzero(you)
        near = np.zeros(len(you))
        hits = np.flatnonzero(best > 0)
        if len(place) and len(hits):
            before = place[np.searchsorted(place, hits, "right").clip(1) - 1]
            after = place[np.searchsorted(place, hits).clip(max=len(place) - 1)]
            for other in (before, after):
                near[hits[(np.abs(other - hits) <= NEAR) & (owner[other] == owner[hits])]] = 1
        # The same words with signs dropped or read as letters: what hits only now was disguised.
        keep = ~_DROPPED[data]
        moved = np.r_[0, np.cumsum(keep)]
        plain = cut(data[keep], moved[at], rows, _BLANK, _READ)
        read = np.bincount(plain.owner, lexicon.weight(plain.hashes) >= STRONG, n_texts)
        count = lambda which: np.diff(np.r_[0, np.cumsum(which[data])][at])  # noqa: B023, E731
        letters, size = count(_LETTER), np.maximum(np.diff(at), 1)
        apart = cut(data, at, rows)
        inner = np.r_[0, np.cumsum(_SIGN[data] | _DIGIT[data])]
        begun = np.r_[0, np.cumsum(_LETTER[data])]
        a, b = apart.starts, apart.ends
        mixed = (inner[np.maximum(b - 1, a)] > inner[np.minimum(a + 1, b - 1)]) & (begun[b] - begun[a] >= 2)
        m = np.maximum(n, 1)
        top = np.zeros(n_texts)
        np.maximum.at(top, owner[hits], best[hits])
        out[rows.start : rows.stop] = np.column_stack(
            [
                per_text(strong) / m, per_text(stem > 0) / m, per_text(best) / m, np.log1p(per_text(strong)), np.log1p(per_text(stem > 0)), top,
                per_text(you) / m, per_text(near) / m, count(_UPPER) / np.maximum(letters, 1), count(np.arange(256) == ord("!")) / size,
                count(_SIGN) / size, count(_DIGIT) / size, np.maximum(read - per_text(strong), 0) / m, np.bincount(apart.owner, mixed, n_texts) / m,
                np.log1p(n), per_text(found.lengths) / m,
            ]
        )
    return out


def learn_lexicon(sample: DataFrame, size: int = LEXICON) -> Lexicon:
    """Words and stems by the log-odds of the texts with them; ``sample`` has text and label."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for data, at, rows in blocks(batch.column(0)):
                found = cut(data, at, rows, _APART)
                keys = np.concatenate([found.hashes, *(found.prefixes(k) for k in STEMS)])
                owner = np.tile(found.owner, 1 + len(STEMS))
                order = np.lexsort((keys, owner))
                keys, owner = keys[order], owner[order]
                new = np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])][: len(keys)] & (keys > 0)
                entry, back = np.unique(keys[new], return_inverse=True)
                toxic = np.bincount(back, label[rows.start + owner[new]], len(entry)).astype(np.int64)
                texts = np.bincount(back, minlength=len(entry)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(entry.view(np.int64)), pa.array(toxic), pa.array(texts)], ["entry", "toxic", "texts"])

    counts = sample.select("text", "label").mapInArrow(tally, "entry long, toxic long, texts long")
    n, n_toxic = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n_toxic or n_toxic == n:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    clean = F.col("texts") - F.col("toxic")
    odds = F.log((F.col("toxic") + 0.1) / F.lit(float(n_toxic))) - F.log((clean + 0.5) / F.lit(float(n - n_toxic)))
    found = counts.groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("texts").alias("texts")).withColumn("weight", odds)
    worth = F.col("toxic") * F.col("weight")
    top = found.filter("toxic >= 5 and weight >= 1").orderBy(worth.desc(), "entry").select("entry", "weight").limit(size).collect()
    keys = np.array([r.entry for r in top], np.int64).view(np.uint64)
    order = np.argsort(keys)
    return Lexicon(keys[order], np.array([r.weight for r in top])[order])


class Trees:
    """Gradient-boosted trees of one depth, grown level by level on histograms."""

    def __init__(self, depth: int = 4, rounds: int = 120, rate: float = 0.1, bins: int = 64, least: int = 15, ridge: float = 1.0) -> None:
        self.depth, self.rounds, self.rate, self.bins, self.least, self.ridge = depth, rounds, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for f in range(width)]
        binned = np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature, self.cut = np.zeros((self.rounds, inner), np.int64), np.full((self.rounds, inner), np.inf)
        self.value = np.zeros((self.rounds, leaves))
        margin = np.full(n, self.base)
        for t in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, width_now = 2**level - 1, 2**level
                gain_of = np.full(width_now, 1e-6)
                for f in range(width):
                    at = node * self.bins + binned[:, f]
                    sums = [np.bincount(at, w, width_now * self.bins).reshape(width_now, self.bins).cumsum(axis=1) for w in (g, h, np.ones(n))]
                    (gl, hl, nl), (ga, ha, na) = sums, [s[:, -1:] for s in sums]
                    r = self.ridge
                    gain = gl**2 / (hl + r) + (ga - gl) ** 2 / (ha - hl + r) - ga**2 / (ha + r)
                    gain[(nl < self.least) | (na - nl < self.least)] = -np.inf
                    gain = gain[:, : len(cuts[f])]
                    if gain.shape[1]:
                        where = gain.argmax(axis=1)
                        best = gain[np.arange(width_now), where]
                        better = best > gain_of
                        gain_of[better] = best[better]
                        nodes = first + np.flatnonzero(better)
                        self.feature[t, nodes], self.cut[t, nodes] = f, cuts[f][where[better]]
                here = first + node
                node = node * 2 + (x[np.arange(n), self.feature[t, here]] > self.cut[t, here])
            total = np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            self.value[t] = self.rate * total
            margin += self.value[t, node]
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        """The sum of all trees' values for each row."""
        if not len(x):
            return np.zeros(0)
        tree = np.arange(len(self.value))
        node = np.zeros((len(x), len(tree)), np.int64)
        for level in range(self.depth):
            here = 2**level - 1 + node
            node = node * 2 + (np.take_along_axis(x, self.feature[tree, here], axis=1) > self.cut[tree, here])
        return self.base + self.value[tree, node].sum(axis=1)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins and shares of label 1, both rising: adjacent violators pooled. Read by interpolation."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []
    for m, v in zip(margin[order], y[order], strict=True):
        pools.append([float(v), 1.0, float(m)])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, at = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, (pools[-1][2] * pools[-1][1] + at * n) / (pools[-1][1] + n)]
    return np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools])


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    points: np.ndarray
    shares: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.shares[0])
        return np.interp(self.trees.margins(features(texts, self.lexicon)), self.points, self.shares)


def held_out(id_col: Column, remainder: int = 1, parts: int = 3) -> Column:
    """Whether the id's checksum puts the row aside."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(parts)) == remainder


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> Model:
    """The model of the labelled texts among ``docs``; ``labels`` has id_col and label_col."""
    bound_batches(docs.sparkSession)
    labels = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label is not null")
    n = labels.count()
    part = F.xxhash64("text").bitwiseAND((1 << 30) - 1) / float(1 << 30)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    texts = texts.filter(part < min(1.0, train_docs / max(1, n)))
    # Labels are broadcast if they are few, so that only labelled texts are shuffled.
    labels = F.broadcast(labels) if n <= BROADCAST_LABELS else labels
    chosen = texts.join(labels, "id").groupBy(F.sha2("text", 256).alias("h")).agg(F.first("text").alias("text"), F.max("label").alias("label"))
    chosen = materialize(chosen.select("text", "label"), "toxicity-sample")
    lexicon = learn_lexicon(chosen)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([features(batch.column(0), lexicon), [zlib.crc32(t.encode()) % 10 for t in batch.column(0).to_pylist()]])
            yield pa.RecordBatch.from_arrays([pa.array(list(x)), batch.column(1).cast(pa.int64())], ["x", "label"])

    rows = sorted((tuple(r.x), r.label) for r in chosen.select("text", "label").mapInArrow(measure, "x array<double>, label long").toLocalIterator())
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return Model(lexicon, None, np.zeros(1), np.array([y.mean() if len(y) else 0.0]))
    x = np.array([r[0] for r in rows])
    x, aside = x[:, :-1], x[:, -1] < 4
    if min(y[aside].sum(), y[~aside].sum(), (1 - y[aside]).sum(), (1 - y[~aside]).sum()) < 5:
        aside = np.zeros(len(y), bool)
    trees = Trees().fit(x[~aside], y[~aside])
    seen = aside if aside.any() else ~aside
    return Model(lexicon, trees, *isotonic(trees.margins(x[seen]), y[seen]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score for every row of ``docs``."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(batch.column(1)))], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def reject(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score less than ``threshold``, with all their columns; one pass, no join."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column(at)) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learned from the labelled rows that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
