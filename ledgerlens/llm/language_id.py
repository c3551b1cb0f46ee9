"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text. A document is parsed greedily from left to right
into the longest phrases that occur in that text; a phrase ends at the letter that no longer fits, and the next one
begins there. The phrases needed, times log2 of the reference's length and divided by the document's length, estimate
its cross-entropy in bits a letter; the language with the lowest estimate wins.

The automaton's transitions are a hash table of (state, letter), so that a few array operations step all blocks of a
batch by a letter. Texts are parsed whole: their blocks of ``BLOCK`` letters are first stepped side by side, then again
from where the block before ended, until both parses meet, so that no phrase ends because a block does. Letters are
folded to lower case; every letter of any reference text is itself, whatever its script, letters of none are one that
no language knows, and runs of anything else are one space.

References: labelled texts are cut into pieces of ``PIECE`` characters; of the distinct pieces of each language that
hold a letter those with the smallest hash of their content, at most ``ref_docs`` of them and ``ref_letters`` letters
in all. So copies, or a head that many texts share, count once, and every language whose texts have letters is kept.
Tasks choose among their own pieces, and two levels of merging among those. Only the chosen pieces reach the driver,
and every Python worker builds its automata from them.

Defined results: a text that is null or has no letter is ``und`` with score 0; without labelled text every document
is ``und``; equal estimates go to the language first in order; repeated rows are predicted each; further columns are
ignored. The score is the runner-up's estimate over the sum of both, 1 if there is but one language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ledgerlens.llm.arrow import bound_batches
from ledgerlens.session import table

UNKNOWN = "und"
REF_DOCS, REF_LETTERS, PIECE = 200, 60_000, 4000
SALTS = 64
BLOCK = 512
#: Parses of a block are compared each time so many letters are done.
MARK = 32
#: So few blocks are stepped letter by letter, one after the other, as arrays would cost more.
FEW = 16
#: Classes besides letters: no letter at all, and letters that no reference has.
SPACE, OTHER = 0, 1
_PIECE = 1 << 20
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def held_out(id_col: Column, remainder: int = 2, parts: int = 4) -> Column:
    """Whether the id's checksum puts the row aside."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))), F.lit(parts)) == remainder


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool)


def letter_classes(frequent: str) -> np.ndarray:
    """The class of every code point; a form of several letters is the most frequent one's."""
    of = np.where(is_letter(), OTHER, SPACE).astype(np.int32)
    for k, c in reversed(list(enumerate(frequent))):
        for form in {c.upper(), c.title()}:
            if len(form) == 1:
                of[ord(form)] = k + 2
    for k, c in enumerate(frequent):
        of[ord(c)] = k + 2
    return of


class Automaton:
    """A suffix automaton's transitions: a table with open addressing of (letter, state) with the next state.

    Where a state has no transition the phrase ends, and the next one begins with that letter in the first state.
    """

    def __init__(self, nexts: list[dict[int, int]], classes: int) -> None:
        self.bits = np.int64(len(nexts).bit_length())
        self.start = np.zeros(classes, np.int64)
        for c, s in nexts[0].items():
            self.start[c] = s
        sizes = [len(x) for x in nexts]
        n = sum(sizes)
        state = np.repeat(np.arange(len(nexts)), sizes)
        letter = np.fromiter((c for x in nexts for c in x), np.int64, n)
        entry = (letter << self.bits | state) << self.bits | np.fromiter((s for x in nexts for s in x.values()), np.int64, n)
        width = max(4, (3 * n).bit_length())
        self.shift, self.last = np.uint64(64 - width), (1 << width) - 1
        self.table = np.full(1 << width, -1, np.int64)
        at = self.slot(entry >> self.bits)
        while len(at):
            free = self.table[at] < 0
            self.table[at[free]] = entry[free]
            placed = self.table[at] == entry
            at, entry = (at[~placed] + 1) & self.last, entry[~placed]

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _SPREAD) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state of each, and whether a phrase ended."""
        key = letter << self.bits | state
        at = self.slot(key)
        entry = self.table.take(at)
        lost = np.flatnonzero((entry >> self.bits != key) & (entry >= 0))
        while len(lost):
            at[lost] = (at[lost] + 1) & self.last
            found = self.table.take(at[lost])
            entry[lost] = found
            lost = lost[(found >> self.bits != key[lost]) & (found >= 0)]
        ended = entry < 0
        return np.where(ended, self.start.take(letter), entry & ((1 << self.bits) - 1)), ended


    def walk(self, state: int, letters: list[int]) -> Iterator[tuple[int, bool]]:
        """``step`` for one text, letter by letter."""
        bits, shift, last, spread = int(self.bits), int(self.shift), self.last, int(_SPREAD)
        for letter in letters:
            key = letter << bits | state
            at = (key * spread & 0xFFFFFFFFFFFFFFFF) >> shift
            while (entry := self.table.item(at)) >= 0 and entry >> bits != key:
                at = (at + 1) & last
            state = self.start.item(letter) if entry < 0 else entry & (1 << bits) - 1
            yield state, entry < 0


def suffix_automaton(letters: np.ndarray, classes: int) -> Automaton:
    """The suffix automaton of ``letters``."""
    nexts, link, length, last = [{}], [-1], [0], 0
    for c in letters.tolist():
        new = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return Automaton(nexts, classes)


def phrase_ends(moves: Automaton, letters: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How many phrases end within each block: ``size[b]`` letters, in falling order, of column b of ``letters``.

    A block goes on where block ``before[b]`` ended, or begins a text if that is -1. All blocks are parsed from the
    first state; those that begin in another one are parsed again, up to a mark where the state is that of their last
    parse, as from there on both are the same. Only a block that ends in another state than before changes the next.
    """
    blocks = len(size)
    after = np.full(blocks, -1)
    after[before[before >= 0]] = np.flatnonzero(before >= 0)
    states = np.full((len(letters) // MARK, blocks), -1)
    counts = np.zeros_like(states)
    begun, end, total = (np.zeros(blocks, np.int64) for _ in range(3))
    todo = np.arange(blocks)
    while len(todo):
        for b in todo if len(todo) <= FEW else ():
            n = 0
            for k, (at, ended) in enumerate(moves.walk(int(begun[b]), letters[: size[b], b].tolist())):
                n += ended
                if (k + 1) % MARK == 0:
                    mark = k // MARK
                    if states[mark, b] == at:
                        more = n - counts[mark, b]
                        counts[mark:, b] += more
                        total[b] += more
                        break
                    states[mark, b], counts[mark, b] = at, n
            else:
                end[b], total[b] = at, n
        live = todo if len(todo) > FEW else todo[:0]
        state, count = begun[live], np.zeros(len(live), np.int64)
        for k in range(len(letters)):
            n = len(live)
            while n and size[live[n - 1]] <= k:
                n -= 1
            if n < len(live):
                end[live[n:]], total[live[n:]] = state[n:], count[n:]
                live, state, count = live[:n], state[:n], count[:n]
            if not n:
                break
            state, ended = moves.step(state, letters[k].take(live))
            count = count + ended
            if (k + 1) % MARK == 0:
                at = k // MARK
                same = states[at, live] == state
                if same.any():
                    met, more = live[same], count[same] - counts[at, live[same]]
                    counts[at:, met] += more
                    total[met] += more
                    live, state, count = live[~same], state[~same], count[~same]
                states[at, live], counts[at, live] = state, count
        if len(live):
            end[live], total[live] = state, count
        todo = after[todo]
        todo = todo[todo >= 0]
        todo = np.sort(todo[begun[todo] != end[before[todo]]])
        begun[todo] = end[before[todo]]
    return total


def to_classes(texts: list[str], of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts on end, runs of SPACE as one; and where each text ends."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(x) for x in texts])
    found = of[points]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] != SPACE) | (found[:-1] != SPACE)
    starts = ends[:-1]
    keep[starts[starts < len(found)]] = True
    return found[keep], np.r_[0, np.cumsum(keep)][ends]


class Languages:
    """The automata, and the parse of texts by all of them."""

    def __init__(self, references: dict[str, list[str]], ref_letters: int = REF_LETTERS) -> None:
        self.names = sorted(references)
        seen = Counter()
        for texts in references.values():
            for text in texts:
                seen.update(c for c in text.lower() if c.isalpha())
        frequent = sorted(seen, key=lambda c: (-seen[c], c))
        self.of = letter_classes("".join(frequent))
        self.moves, self.bits = [], []
        for name in self.names:
            letters, _ = to_classes([f"{x}\n" for x in references[name]], self.of)
            letters = letters[:ref_letters]
            self.moves.append(suffix_automaton(letters, len(frequent) + 2))
            self.bits.append(np.log2(max(2, len(letters))))

    def estimates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a letter of each text in each language, and whether the text has a letter."""
        found, ends = to_classes(texts, self.of)
        starts = np.r_[0, ends[:-1]]
        length = ends - starts
        blocks = -(-length // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        order = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[owner] + order * BLOCK
        size = np.minimum(BLOCK, ends[owner] - begin)
        by_size = np.argsort(-size, kind="stable")
        place = np.empty_like(by_size)
        place[by_size] = np.arange(len(by_size))
        before = np.where(order[by_size] > 0, place[by_size - 1], -1)
        owner, begin, size = owner[by_size], begin[by_size], size[by_size]
        some = np.r_[0, np.cumsum(found > SPACE)]
        lettered = some[ends] > some[starts]
        needed = np.zeros((len(self.names), len(texts)))
        if len(owner):
            steps = int(size[0])
            # The blocks that still have a letter at each step come first.
            active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
            letters = np.zeros((steps, len(owner)), np.int64)
            for k in range(steps):
                n = active[k]
                letters[k, :n] = found[begin[:n] + k]
            for lang, moves in enumerate(self.moves):
                needed[lang] = np.bincount(owner, phrase_ends(moves, letters, size, before), len(texts)) + (length > 0)
        return needed.T * np.array(self.bits) / np.maximum(length, 1)[:, None], lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        bits, lettered = self.estimates(texts)
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(texts)), best]
        rest = bits.copy()
        rest[np.arange(len(texts)), best] = np.inf
        second = rest.min(axis=1)
        score = np.ones(len(texts)) if len(self.names) == 1 else np.divide(second, low + second, out=np.full(len(texts), 0.5), where=low + second > 0)
        return [self.names[k] if ok else UNKNOWN for k, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


@lru_cache(maxsize=2)
def languages(references: tuple) -> Languages:
    """A worker's automata; kept between tasks."""
    return Languages({name: list(texts) for name, texts in references})


class Smallest:
    """Of each language the distinct pieces with the smallest hashes, as many as its reference may need."""

    def __init__(self, ref_docs: int, ref_letters: int) -> None:
        self.ref_docs, self.ref_letters = ref_docs, ref_letters
        self.held: dict[str, dict] = {}
        self.limit: dict[str, int] = {}

    def add(self, lang: str, key: int, piece: str) -> None:
        held = self.held.setdefault(lang, {})
        if key in held or key > self.limit.get(lang, key):
            return
        if letters := sum(map(str.isalpha, piece)):
            held[key] = (letters, piece)
            if len(held) >= 2 * self.ref_docs:
                self.trim(lang)

    def trim(self, lang: str) -> None:
        total, kept = 0, {}
        for key in sorted(self.held[lang]):
            if len(kept) == self.ref_docs or total >= self.ref_letters:
                break
            kept[key] = self.held[lang][key]
            total += kept[key][0]
        if len(kept) == self.ref_docs or total >= self.ref_letters:
            self.limit[lang] = max(kept)
        self.held[lang] = kept

    def out(self) -> Iterator[pa.RecordBatch]:
        for lang in sorted(self.held):
            self.trim(lang)
            if held := self.held[lang]:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held)), pa.array(list(held), pa.int64()), pa.array([x for _, x in held.values()])], ["lang", "key", "piece"])


def references(rows: DataFrame, lang_col: str, text_col: str, ref_docs: int = REF_DOCS, ref_letters: int = REF_LETTERS) -> tuple:
    """Pieces of each language's labelled texts, a bounded number by smallest content hash; (name, pieces) in order."""
    bound_batches(rows.sparkSession)
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null and text <> ''")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Smallest(ref_docs, ref_letters)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                for k in range(0, len(text), PIECE):
                    piece = text[k : k + PIECE]
                    found.add(lang, int.from_bytes(blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True), piece)
        yield from found.out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Smallest(ref_docs, ref_letters)
        for batch in batches:
            for lang, key, piece in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found.add(lang, key, piece)
        yield from found.out()

    kind = "lang string, key long, piece string"
    parts = rows.mapInArrow(choose, kind).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    parts = parts.repartition("lang", "salt").drop("salt").mapInArrow(merge, kind)
    found: dict[str, list] = {}
    for row in parts.repartition("lang").mapInArrow(merge, kind).collect():
        found.setdefault(row.lang, []).append((row.key, row.piece))
    return tuple((lang, tuple(x for _, x in sorted(found[lang]))) for lang in sorted(found))


def identify(docs: DataFrame, refs: tuple, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred and score for every row of ``docs``."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(refs)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = languages(shared.value)
        for batch in batches:
            names, scores, texts, size = [], [], [], 0
            for text in batch.column(1).to_pylist():
                texts.append(text or "")
                size += len(texts[-1])
                if size >= _PIECE:
                    part = model.predict(texts)
                    names, scores, texts, size = names + part[0], [*scores, part[1]], [], 0
            if texts:
                part = model.predict(texts)
                names, scores = names + part[0], [*scores, part[1]]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(predict, out).withColumnRenamed("id", id_col)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of ``documents``, learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    refs = references(docs.filter(~held_out(F.col("doc_id"))), "lang", "text")
    return identify(docs, refs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op1_language_id": op1_language_id}
ORACLES: dict[str, str] = {}
